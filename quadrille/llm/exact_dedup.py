"""Exact deduplication by recipes of content-defined chunks, in DataFrame functions alone.

A text is cut where its own characters say so, so equal texts have equal chunks. Each distinct chunk is moved once
and its identifier is verified: chunks that share a hash but differ get different numbers. A document is then the
ordered list of its chunks' identifiers, a few hundredths of its bytes, and only these lists are compared and joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.llm.common import join_counted, shared_dir, staged, texts


def _class(first: int, end: int, step: int, taken: int) -> str:
    """A class of characters: the first `taken` of every `step` from first on, before end."""
    return f"[{chr(first)}-{chr(end - 1)}&&[" + "".join(f"{chr(k)}-{chr(k + taken - 1)}" for k in range(first, end, step)) + "]]"


#: A chunk has 384 to 4096 characters and ends behind a space that follows one of some letters or marks (some of every
#: script that has spaces), or behind some characters of scripts without spaces.
CHUNK = rf"(?s).{{384,4095}}?(?<=[aglmsty.,] |{_class(0x80, 0x2000, 32, 8)} |{_class(0x2E80, 0xD680, 512, 2)})|.{{1,4096}}"


def normalised(text: Column) -> Column:
    """Each run of space, tab, line feed, vertical tab, form feed and carriage return as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def chunks(norm: Column) -> Column:
    return F.regexp_extract_all(norm, F.lit(CHUNK), F.lit(0))


def exact_groups(docs: DataFrame) -> DataFrame:
    """One row per document, dropped ones too: doc_id, keep_id, group_size, kept, text_sha256. Other columns are left out.

    Texts are equal when they are so after normalised(). Of equal texts the row with the smallest doc_id stays; a
    null text counts as empty and all empty texts are equal. Of rows that repeat that doc_id with that text, one
    is kept. Rows with a null doc_id are grouped, but stay only where their group has no other. An empty table
    gives no rows.
    """
    return _groups(texts(docs).withColumn("row", F.lit(0).cast("long"))).drop("row")


def _groups(rows: DataFrame) -> DataFrame:
    """exact_groups of rows (doc_id, text, row), with their row."""
    shared_dir(rows.sparkSession)
    own = rows.select("row", "doc_id", normalised(F.col("text")).alias("norm"))
    recipes = own.select("row", "doc_id", F.sha2("norm", 256).alias("text_sha256"), F.transform(chunks(F.col("norm")), lambda c: F.xxhash64(c)).alias("recipe"), F.octet_length("norm").alias("bytes"))
    shared = shared_hashes(own).checkpoint()
    if not shared.isEmpty():
        recipes = _numbered(own, clashing_chunks(own, shared))
    recipes = recipes.select("row", "doc_id", "text_sha256", F.struct("recipe", "bytes").alias("whole"), F.monotonically_increasing_id().alias("copy")).checkpoint()
    stays = recipes.groupBy(F.col("whole").alias("of")).agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "copy")).alias("first"), F.count(F.lit(1)).alias("_n")).withColumn("group_size", F.col("_n")).checkpoint()
    joined = join_counted(recipes, stays, "whole")  # a large group of copies is dealt over all tasks
    return joined.select("row", "doc_id", F.col("first.doc_id").alias("keep_id"), "group_size", (F.col("copy") == F.col("first.copy")).alias("kept"), "text_sha256")


def distinct_chunks(own: DataFrame) -> DataFrame:
    return own.select(F.explode(chunks(F.col("norm"))).alias("chunk")).distinct().withColumn("id", F.xxhash64("chunk"))


def shared_hashes(own: DataFrame) -> DataFrame:
    """The verification: hashes that more than one distinct chunk has. Usually none."""
    return distinct_chunks(own).groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("id")


def clashing_chunks(own: DataFrame, shared: DataFrame) -> DataFrame:
    """The chunks that have those hashes, numbered within each: id, chunk, nth."""
    members = distinct_chunks(own).join(shared, "id").groupBy("id").agg(F.array_sort(F.collect_set("chunk")).alias("all"))
    return members.select("id", F.posexplode("all").alias("nth", "chunk"))


def _numbered(own: DataFrame, clashes: DataFrame) -> DataFrame:
    """Recipes in which a chunk whose hash is shared also has its number."""
    rows = own.select("row", F.monotonically_increasing_id().alias("nth_row"), "doc_id", F.sha2("norm", 256).alias("text_sha256"), F.octet_length("norm").alias("bytes"), chunks(F.col("norm")).alias("all"))
    whole = ["nth_row", "row", "doc_id", "text_sha256", "bytes"]
    pieces = rows.select(*whole, F.posexplode_outer("all").alias("pos", "chunk")).withColumn("id", F.xxhash64("chunk"))
    pieces = pieces.join(clashes, ["id", "chunk"], "left")
    listed = pieces.groupBy(*whole).agg(F.array_sort(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", "id", F.coalesce("nth", F.lit(0)).alias("nth"))))).alias("p"))
    return listed.select("row", "doc_id", "text_sha256", F.flatten(F.transform("p", lambda x: F.array(x["id"], x["nth"].cast("long")))).alias("recipe"), "bytes")


def drop_copies(docs: DataFrame) -> DataFrame:
    """docs with one row of each group of equal texts (exact_groups); columns as they are, whatever their names.

    Each row is judged by its own text: rows of one doc_id, and rows without one, stay or go each by itself. Null and
    empty texts are one group. Of rows that repeat the smallest doc_id of a group one stays. An empty table gives no
    rows. docs is staged once with a number for each row.
    """
    numbered = staged(docs.select(F.monotonically_increasing_id().alias("row"), F.struct("*").alias("own")), "rows")
    own = numbered.select("row", F.col("own.doc_id").cast("long").alias("doc_id"), F.col("own.text").cast("string").alias("text"))
    gone = _groups(own).filter("NOT kept").select(F.col("row").alias("gone"))
    return numbered.join(gone, F.col("row") == F.col("gone"), "left_anti").select("own.*")
