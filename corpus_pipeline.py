"""The corpus pipeline: documents without toxic ones, copies, near copies and benchmark passages, encoded at its end.

Each stage takes whole documents with whatever columns and judges each row by its own text: rows without a doc_id and
rows that share one stay or go each by itself. Null and empty texts are documents without words: they are never toxic,
near copies or contaminated, and count as copies of each other. Repeated rows are copies. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quadrille.llm import decontamination, exact_dedup, sentencepiece_codec, simhash, toxicity
from quadrille.llm.common import staged, table


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; without labels none does."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (null and empty are equal) the smallest doc_id stays; of rows that repeat it one."""
    return exact_dedup.drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the smallest doc_id stays, and one of its rows without a doc_id; rows without words stay."""
    return simhash.drop_near_copies(docs)


def contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go; with an empty benchmark none does."""
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of what is left; a null text is encoded as an empty one."""
    import public_tokenizers

    return sentencepiece_codec.encode_decode(docs, public_tokenizers.path("piece_bpe_32k.model"), digests=True)


STAGES = [("toxicity", toxic), ("exact_dedup", exact_copies), ("near_dedup", near_copies), ("decontamination", contaminated), ("sentencepiece", encoded)]

#: A trained classifier, SimHash and SentencePiece are beyond SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
