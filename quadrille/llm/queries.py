"""The registered queries of this subpackage, with the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.llm import decontamination, exact_dedup, language_id, merkle, minhash, search, secrets, sentencepiece_codec, sharding, simhash, token_files, toxicity, warc
from quadrille.llm.common import table


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode_decode(table(spark, sf_dir, "documents"), _vocabulary("piece_bpe_32k.model"), digests=True)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = token_files.write_token_files(table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"))
    return token_files.read_token_files(spark, folder, digests=True)


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.balanced_shards(table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = warc.write_archives(table(spark, sf_dir, "pages"))
    return warc.read_archives(warc.normalise_archives(files), with_payload=False).drop("url", "payload")


def _held_out(folds: int, fold: int) -> Column:
    """A document's fold is held out; one without a doc_id has no fold and is not."""
    return F.coalesce(language_id.fold(F.col("doc_id"), folds) == fold, F.lit(False))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", _held_out(5, 0).alias("held_out"), "score", "predicted")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.judged(decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_documents(table(spark, sf_dir, "documents"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = _held_out(3, 1)
    return language_id.predict(docs, language_id.fit_profiles(docs.filter(~held_out))).withColumn("held_out", held_out).select("doc_id", "held_out", "lang_pred", "score")


def op11_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    tampered = F.when(changed, merkle.leaf_of(n_chars=F.col("n_chars") + 1)).otherwise(merkle.leaf_of())
    proofs = merkle.manifest(docs, start=tampered).proofs()
    found = proofs.select("doc_id", "leaf", "subroot", "root", merkle.siblings_digest(F.col("proof")).alias("proof_sha256"), merkle.folded(F.col("start"), F.col("proof")).alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_groups(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_sentencepiece, op2_simhash, op3_token_files, op4_sharding, op5_warc, op6_toxicity, op7_exact_dedup, op8_decontamination, op9_secrets, op10_language, op11_search, op12_manifest, op13_minhash, pipeline)}

#: SimHash, language profiles, token files, checksums (crc32), base 32 and the classifiers are beyond DuckDB's SQL.
ORACLE_SQL = {
    "op7_exact_dedup": r"""
        WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
        FROM n WINDOW w AS (PARTITION BY norm)
    """,
    "op11_search": r"""
        WITH d AS (
            SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents
        ),
        q AS (
            SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
        ),
        whole AS (SELECT count(DISTINCT doc_id) AS n_docs, count(*) AS n_terms FROM d),
        lengths AS (SELECT doc_id, 75 + (25 * count(*) * n_docs) // n_terms AS m FROM d, whole GROUP BY doc_id, n_docs, n_terms),
        times AS (SELECT doc_id, term, count(*) AS tf FROM d WHERE term IN (SELECT term FROM q) GROUP BY doc_id, term),
        weights AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM times, whole GROUP BY term, n_docs),
        scores AS (
            SELECT item_id, doc_id, sum(asked * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
            FROM (SELECT item_id, term, count(*) AS asked FROM q GROUP BY item_id, term) JOIN times USING (term) JOIN weights USING (term) JOIN lengths USING (doc_id)
            GROUP BY item_id, doc_id
        )
        SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM scores WHERE score > 0 QUALIFY rank <= 20
    """,
    "op12_manifest": r"""
        WITH RECURSIVE crc AS (
            SELECT doc_id, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
                lambda acc, x: CASE WHEN x >= 0 THEN xor(acc, x) WHEN acc % 2 = 1 THEN xor(acc // 2, 3988292384) ELSE acc // 2 END) AS inverted
            FROM documents
        ),
        d AS (
            SELECT documents.*, coalesce(xor(inverted, 4294967295) % 7 = 0, false) AS changed FROM documents LEFT JOIN crc ON crc.doc_id = documents.doc_id
        ),
        leaves AS (
            SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS pos, sha256(before || coalesce(octet_length(encode((n_chars)::VARCHAR)) || ':' || (n_chars)::VARCHAR, '-') || after) AS leaf,
                sha256(before || coalesce(octet_length(encode((CASE WHEN changed THEN n_chars + 1 ELSE n_chars END)::VARCHAR)) || ':' || (CASE WHEN changed THEN n_chars + 1 ELSE n_chars END)::VARCHAR, '-') || after) AS start
            FROM (SELECT *, coalesce(octet_length(encode((doc_id)::VARCHAR)) || ':' || (doc_id)::VARCHAR, '-') || coalesce(octet_length(encode((source)::VARCHAR)) || ':' || (source)::VARCHAR, '-') || coalesce(octet_length(encode((lang)::VARCHAR)) || ':' || (lang)::VARCHAR, '-') AS before, coalesce(octet_length(encode((text)::VARCHAR)) || ':' || (text)::VARCHAR, '-') AS after FROM d)
        ),
        level AS (
            SELECT lang, 0 AS height, pos, leaf AS digest, count(*) OVER (PARTITION BY lang) AS n FROM leaves
            UNION ALL
            SELECT lang, height + 1, pos // 2, sha256(digest || coalesce(next, '')), (n + 1) // 2
            FROM (SELECT *, lead(digest) OVER (PARTITION BY lang, height ORDER BY pos) AS next FROM level WHERE n > 1)
            WHERE pos % 2 = 0
        ),
        subroots AS (SELECT lang, digest AS subroot, row_number() OVER (ORDER BY lang IS NOT NULL, encode(lang)) - 1 AS nth FROM level WHERE n = 1),
        upper AS (
            SELECT 0 AS height, nth AS pos, subroot AS digest, count(*) OVER () AS n FROM subroots
            UNION ALL
            SELECT height + 1, pos // 2, sha256(digest || coalesce(next, '')), (n + 1) // 2 FROM (SELECT *, lead(digest) OVER (PARTITION BY height ORDER BY pos) AS next FROM upper WHERE n > 1) WHERE pos % 2 = 0
        ),
        climb AS (
            SELECT doc_id, leaf, lang, 0 AS height, pos, '' AS proof, start AS folded, (SELECT max(n) FROM level WHERE level.lang IS NOT DISTINCT FROM leaves.lang AND level.height = 0) AS n FROM leaves
            UNION ALL
            SELECT doc_id, leaf, climb.lang, climb.height + 1, climb.pos // 2, proof || coalesce(level.digest, ''),
                sha256(CASE WHEN climb.pos % 2 = 1 THEN level.digest || folded ELSE folded || coalesce(level.digest, '') END), (climb.n + 1) // 2
            FROM climb LEFT JOIN level ON level.lang IS NOT DISTINCT FROM climb.lang AND level.height = climb.height AND level.pos = xor(climb.pos, 1)
            WHERE climb.n > 1
        ),
        final AS (
            SELECT doc_id, leaf, subroot, 0 AS height, nth AS pos, proof, folded, (SELECT count(*) FROM subroots) AS n FROM climb JOIN subroots ON climb.lang IS NOT DISTINCT FROM subroots.lang WHERE climb.n = 1
            UNION ALL
            SELECT doc_id, leaf, subroot, final.height + 1, final.pos // 2, proof || coalesce(upper.digest, ''),
                sha256(CASE WHEN final.pos % 2 = 1 THEN upper.digest || folded ELSE folded || coalesce(upper.digest, '') END), (final.n + 1) // 2
            FROM final LEFT JOIN upper ON upper.height = final.height AND upper.pos = xor(final.pos, 1)
            WHERE final.n > 1
        )
        SELECT doc_id, leaf, subroot, digest AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = digest AS verified
        FROM final, (SELECT digest FROM upper WHERE n = 1) WHERE final.n = 1
    """,
    "op13_minhash": r"""
        WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
        s AS (
            SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) < 3 THEN list_filter([array_to_string(words, ' ')], lambda x: x <> '') ELSE list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]) END) AS shingle
            FROM w
        ),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
        links AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared.n >= 85 * (x.n + y.n - shared.n)),
        reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.other)
        SELECT doc_id, coalesce(n, 0) AS n_shingles, min(other) AS component_id, doc_id = min(other) AS kept
        FROM reach LEFT JOIN n USING (doc_id) GROUP BY doc_id, n
    """,
}
