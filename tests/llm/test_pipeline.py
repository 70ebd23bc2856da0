"""Each stage of the pipeline against its plain version."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quadrille.llm import common, decontamination, exact_dedup, minhash, simhash, toxicity
from tests.llm import plain

SF = "/root/testdata/sf0.001"


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "decontamination", "sentencepiece"]


def test_each_stage(spark, docs):
    bench = [(str(r["item_id"]), r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    scored = toxicity.score(docs, toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet")))
    expected = {
        "toxicity": [r["doc_id"] for r in scored.filter("predicted = 0").collect()],
        "exact_dedup": [r[0] for r in plain.op7(pairs(docs)) if r[3]],
        "near_dedup": plain.near_kept(pairs(docs)),
        "decontamination": [r[0] for r in plain.op8(pairs(docs), bench) if not r[5]],
        "sentencepiece": [r[0] for r in plain.op1(pairs(docs))],
    }
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert ids(out) == sorted(expected[name]), name
        assert name == "sentencepiece" or out.columns == docs.columns
        assert stage(spark, docs.limit(0), SF).isEmpty()


def test_near_copies_of_similarity(spark):
    rng = random.Random(5)
    docs, at = [], 0
    for group in range(12):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([4, 30, 120, 400]))]
        for copy in range(rng.choice([1, 2, 5, 25])):
            own = list(base)
            for k in rng.sample(range(len(own)), round(len(own) * rng.choice([0, 0.01, 0.02, 0.03, 0.06]))):
                own[k] = f"x{rng.randrange(9000)}"
            docs.append((at, " ".join(own)))
            at += 1
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    expected = sorted(plain.near_kept(docs))
    assert len(expected) < len(docs) and ids(simhash.drop_near_copies(rows)) == expected
    rows = rows.withColumnRenamed("doc_id", "row")
    sketches = rows.mapInArrow(simhash._sketches(4, 5, 40, 5), "row long, fp long, n long, same binary, cells array<long>").dropDuplicates(["same"]).checkpoint()
    whole = minhash.similar_links(rows, sketches, 5, (4, 5))
    cut = minhash.similar_links(rows, sketches, 5, (4, 5), block_shingles=900)  # groups in blocks
    assert simhash.components(whole).filter("node <> root").count() == simhash.components(cut).filter("node <> root").count() > 0


def test_near_copies_of_odd_rows(spark):
    text = " ".join(f"a{k}" for k in range(60))
    rows = spark.createDataFrame([(3, text, 1), (1, text + " b", 2), (None, text, 3), (7, None, 4), (8, "", 5), (9, None, 6), (3, text, 7)], "doc_id long, text string, fp long")
    out = simhash.drop_near_copies(rows)
    assert out.columns == rows.columns and sorted(r["fp"] for r in out.collect()) == [2, 3, 4, 5, 6]
    assert simhash.drop_near_copies(rows.limit(0)).isEmpty()


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert 0 < out.count() < 200 and out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_rows_of_odd_texts_pass_through(spark):
    rows = spark.createDataFrame([(1, None, "en", "s", 0), (2, "", "en", "s", 0), (3, "a", None, None, None), (None, "b c", "en", "s", 1), (5, "  ", "en", "s", 2)], "doc_id long, text string, lang string, source string, n_chars long")
    docs = rows
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 4  # null and empty are one text; blanks are another


def test_verdicts_belong_to_rows(spark):
    """Rows without a doc_id and rows of one doc_id: one toxic, one contaminated, two near copies, others clean."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{name}.parquet") for name in ("documents", "labels"))
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    model = toxicity.fit(docs, labels)
    bad = toxicity.score(docs, model).filter("predicted = 1").join(docs, "doc_id").orderBy("doc_id").first()["text"]
    item = bench.filter("size(split(text, ' ')) >= 13").orderBy("item_id").first()["text"]
    clean = [" ".join(f"c{k}x{i}" for i in range(60)) for k in range(4)]
    near = clean[3] + " more"
    for doc_id in (None, 5):
        mixed = spark.createDataFrame([(doc_id, t, k) for k, t in enumerate([clean[0], bad, clean[1], item, clean[2], clean[3], near])], "doc_id long, text string, nth int")
        left = lambda df: sorted(r["nth"] for r in df.collect())
        # the training rows come along, so that the stage fits the same model
        trained = docs.select("doc_id", "text", F.lit(-1).alias("nth")).unionByName(mixed.withColumn("doc_id", F.col("doc_id") + 10**9))
        assert [n for n in left(toxicity.drop_toxic(trained, labels)) if n >= 0] == [0, 2, 3, 4, 5, 6]
        assert left(decontamination.drop_contaminated(mixed, bench)) == [0, 1, 2, 4, 5, 6]
        assert left(simhash.drop_near_copies(mixed)) in ([0, 1, 2, 3, 4, 5], [0, 1, 2, 3, 4, 6])
        assert decontamination.drop_contaminated(mixed, bench).schema == simhash.drop_near_copies(mixed).schema == mixed.schema


def test_near_copies_of_repeated_lines(spark):
    rng = random.Random(11)
    docs = []
    for k in range(20):
        prose = [f"p{rng.randrange(10**6)}" for _ in range(rng.choice([200, 400, 800]))]
        line = [f"l{rng.randrange(10**6)}" for _ in range(10)]
        docs += [(2 * k, " ".join(prose + line)), (2 * k + 1, " ".join(prose + line * rng.choice([15, 40, 100])))]
    far = [(simhash.fingerprint(a) ^ simhash.fingerprint(b)).bit_count() for (_, a), (_, b) in zip(docs[::2], docs[1::2])]
    assert sum(d > 20 for d in far) >= 5
    assert plain.near_kept(docs) == list(range(0, 40, 2))
    assert ids(simhash.drop_near_copies(spark.createDataFrame(docs, "doc_id long, text string"))) == list(range(0, 40, 2))


def test_similar_forest_is_exact():
    rng = np.random.default_rng(3)
    sets = []
    for _ in range(60):
        base = rng.integers(0, 2000, rng.integers(1, 60))
        for _ in range(rng.integers(1, 5)):
            sets.append(np.unique(np.where(rng.random(len(base)) < 0.08, rng.integers(0, 2000, len(base)), base)))
    near = [(a, b) for b in range(len(sets)) for a in range(b) if 5 * len(np.intersect1d(sets[a], sets[b])) >= 4 * len(np.union1d(sets[a], sets[b]))]
    assert near and groups(minhash.similar_forest(np.arange(len(sets)), sets, (4, 5)), len(sets)) == groups(near, len(sets))


def groups(pairs, n):
    root = list(range(n))
    for a, b in pairs:
        x, y = root[a], root[b]
        root = [min(x, y) if r in (x, y) else r for r in root]
    return root


CLASHING = ("row", "own", "fp", "member", "gone", "id", "_row", "_own", "_scored", "_of", "_id", "same", "bands", "spans", "items", "n_words", "norm", "copy", "of", "_n", "root", "node", "block", "lang_pred", "TEXT_")


def test_stages_on_odd_rows_with_clashing_columns(spark):
    """Nulls, empty and long texts, repeated rows and ids, and columns named as the stages' own: each stage keeps what its
    plain version keeps, with all columns."""
    from tests.llm.test_operators import ODD

    rows = spark.createDataFrame([(d, t, k) for k, (d, t) in enumerate(ODD)], "doc_id long, text string, nth long")
    rows = rows.select("*", *(F.lit(f"{c}'s").alias(c) for c in CLASHING))
    bench = spark.createDataFrame([("b", "one two three"), ("n", None)], "item_id string, text string")
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{name}.parquet") for name in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    nth = lambda keep: {k for k, x in enumerate(keep) if x}
    expected = {
        "toxic": {k for k, (_, t) in enumerate(ODD) if plain.toxic_score(t, model.entries, model.beta) < 0.5},
        "copies": nth(r[3] for r in plain.op7(ODD)),
        "contaminated": nth(not r[5] for r in plain.op8(ODD, [("b", "one two three"), ("n", None)])),
    }
    trained = rows.unionByName(docs.select("doc_id", "text").withColumn("nth", F.lit(-1)), allowMissingColumns=True)
    assert model.entries == toxicity.fit(trained, labels).entries
    got = {
        "toxic": toxicity.drop_toxic(trained, labels).filter("nth >= 0"),
        "copies": exact_dedup.drop_copies(rows),
        "contaminated": decontamination.drop_contaminated(rows, bench),
        "near": simhash.drop_near_copies(rows),
    }
    expected["near"] = {k for k, (d, t) in enumerate(ODD) if not plain.shingles(t)} | {k for k, keep in enumerate(plain.near_rows(ODD)) if keep}
    for name, df in got.items():
        kept = df.collect()
        assert df.columns == rows.columns and all(r[c] == f"{c}'s" for r in kept for c in CLASHING), name
        assert {r["nth"] for r in kept} == expected[name], name


def test_near_copies_move_no_text_and_follow_rows(spark):
    """No stage shuffles whole documents, and a small table is not spread over all of a session's partitions."""
    base = [" ".join(f"t{k}x{i}" for i in range(4000)) for k in range(12)]
    docs = [(2 * k, t) for k, t in enumerate(base)] + [(2 * k + 1, t + " more") for k, t in enumerate(base[:6])] + [(40, base[0].upper()), (41, None)]
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    context, before = spark.sparkContext, spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "48")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    context.setJobGroup("near-copies", "")
    try:
        out = simhash.drop_near_copies(rows)
        assert "Exchange" not in out._jdf.queryExecution().optimizedPlan().toString() + out._jdf.queryExecution().executedPlan().toString()
        assert ids(out) == [*range(0, 24, 2), 41]
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    told = context.statusTracker()
    stages = {s for j in told.getJobIdsForGroup("near-copies") for s in told.getJobInfo(j).stageIds}
    tasks = sum(i.numTasks for s in stages if (i := told.getStageInfo(s)) and i.numCompletedTasks)
    assert tasks < 1000


def test_facts_beside_rows(spark):
    """Facts meet their rows over chunks, also where a batch has rows of several chunks or of none."""
    step = 1 << common.CHUNK_BITS
    told = [5, step - 1, step, 3 * step + 7, (1 << 33) + 2]
    path = common.beside(spark.createDataFrame([(r, 10 * r) for r in told], "row long, fact long"), "facts")
    known = common.facts_of(path)
    for rows in ([step, 4, 5, step - 1], [2 * step], [(1 << 33) + 2, 3 * step + 7, 9], [], told[::-1]):
        has, facts = known(np.array(rows, np.int64))
        assert has.tolist() == [r in told for r in rows]
        assert (facts.column("fact").to_pylist() if facts is not None else []) == [10 * r for r in rows if r in told]
