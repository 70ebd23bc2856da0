"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import json
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: So many blocks (of a benchmark, of profiles) are read one after the other in one stage: as many Python workers at once for a core.
PASSES = 4


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a folder of our own on one
    machine (local masters); on a cluster ValueError, since executors could not see such a folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="quadrille-")
        spark.conf.set("spark.checkpoint.dir", found)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written once to the shared folder and read again: later reads repeat none of its work, and lost executors none of its tasks."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def store(uri: str):
    """The store of a path or URI, and the path in it, for files that Spark has no sink for."""
    from pyarrow import fs

    return (fs.LocalFileSystem(), uri) if uri.startswith("/") else fs.FileSystem.from_uri(uri)


def write_json(path: str, value) -> None:
    there, place = store(path)
    there.create_dir(place.rpartition("/")[0], recursive=True)
    with there.open_output_stream(place, compression="gzip") as f:
        f.write(json.dumps(value).encode())


def read_json(path: str):
    there, place = store(path)
    with there.open_input_stream(place, compression="gzip") as f:
        return json.loads(f.read())


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bounds what one Arrow batch of whole texts holds in a Python worker. Spark reads these limits when a plan is run,
    so they stay set in the session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", 16 << 20)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """doc_id and text alone, whatever else docs carries."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def block_count(df: DataFrame, column: str, block_bytes: int) -> int:
    """How many blocks of about block_bytes the column's bytes fill; one pass that moves a number."""
    total = df.agg(F.sum(F.octet_length(column))).first()[0] or 0
    return max(1, -(-int(total) // block_bytes))


#: Facts about rows lie in a folder for each 2**CHUNK_BITS row numbers in a row, so what a task reads of them is bounded.
CHUNK_BITS = 16


def beside(facts: DataFrame, name: str) -> str:
    """Writes facts (row, a long, each once; other columns) by chunks of row numbers, for tasks that pass over the rows
    themselves (facts_of): large rows then stay where they are instead of being shuffled to a few facts."""
    path = f"{shared_dir(facts.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    facts.withColumn("chunk", F.shiftright("row", CHUNK_BITS)).repartition("chunk").write.partitionBy("chunk").parquet(path)
    return path


def facts_of(path: str):
    """For a task: a function from row numbers to a mask of those that have facts, and these facts in the same order (None
    where no chunk has any). Only the chunks of the rows asked for last are held."""
    import pyarrow as pa
    from pyarrow import fs, parquet

    there, place = store(path)
    held: dict[int, pa.Table | None] = {}

    def read(chunk: int) -> pa.Table | None:
        files = there.get_file_info(fs.FileSelector(f"{place}/chunk={chunk}", allow_not_found=True))
        found = [parquet.ParquetFile(there.open_input_file(f.path)).read() for f in files if f.path.endswith(".parquet")]
        return pa.concat_tables(found).sort_by("row") if found else None

    def of(rows: np.ndarray) -> tuple[np.ndarray, pa.Table | None]:
        chunks = np.unique(rows >> CHUNK_BITS).tolist()
        for chunk in set(held).difference(chunks):
            del held[chunk]
        for chunk in set(chunks).difference(held):
            held[chunk] = read(chunk)
        if not (found := [held[c] for c in chunks if held[c] is not None]):
            return np.zeros(len(rows), bool), None
        facts = pa.concat_tables(found)  # chunks ascend, and so do rows in each
        known = facts.column("row").to_numpy()
        at = np.minimum(np.searchsorted(known, rows), len(known) - 1)
        has = known[at] == rows
        return has, facts.take(pa.array(at[has]))

    return of


#: Joins by counted keys broadcast the keys that have over one in so many of all rows, and over a task's worth of them:
#: fewer keys than this.
HOT_KEYS = 1000
HOT_ROWS = 1000


def join_counted(rows: DataFrame, facts: DataFrame, key: str, how: str = "inner", hot_keys: int = HOT_KEYS, hot_rows: int = HOT_ROWS, totals: tuple | None = None) -> DataFrame:
    """rows and what facts knows of their key: facts has one row a key (`of`), the number `_n` of its rows and values.

    Keys that have over one in hot_keys of all rows (and over hot_rows), and so fewer keys than hot_keys, are broadcast,
    and their rows are dealt over all tasks by number; the other keys' rows meet them by a shuffle, where none has more
    than that share. Rows must be numbered alike whenever they are read again, as staged, checkpointed and scanned
    tables are. A null key, and one that facts lacks, has null values (how = "left") or no row ("inner"). totals: sum and greatest of `_n`, where they are known.
    """
    values = [c for c in facts.columns if c not in ("of", "_n")]
    total, top = totals or facts.agg(F.sum("_n"), F.max("_n")).first()
    often_from = max(hot_rows, int(total or 0) // hot_keys)
    if (top or 0) <= often_from and how == "inner":
        told = facts.select(F.col("of").alias("_of"), F.struct(*values).alias("_known"))
        return rows.join(told, F.col(key) == F.col("_of")).select(*rows.columns, *(F.col("_known")[v].alias(v) for v in values))
    # always 0, but no literal: the planner would take one out of the join's keys, and then deal rows by the key alone
    zero = F.pmod(F.col("_n"), F.lit(1)).cast("long").alias("_rare_deal")
    known = facts.select("of", F.struct(*values).alias("_known"), (F.col("_n") > often_from).alias("_often"), zero)
    often = known.filter("_often").select(F.col("of").alias("_often_of"), F.col("_known").alias("_often_known"))
    rare = known.filter("NOT _often").select(F.col("of").alias("_rare_of"), F.col("_known").alias("_rare_known"), F.col("_rare_deal"))
    dealt = rows.join(F.broadcast(often), F.col(key) == F.col("_often_of"), "left")
    dealt = dealt.withColumn("_deal", F.when(F.col(key).isNotNull() & F.col("_often_known").isNull(), F.lit(0).cast("long")).otherwise(F.monotonically_increasing_id() + 1))
    joined = dealt.join(rare, (F.col(key) == F.col("_rare_of")) & (F.col("_deal") == F.col("_rare_deal")), "left").withColumn("_known", F.coalesce("_often_known", "_rare_known"))
    if how == "inner":
        joined = joined.filter("_known IS NOT NULL")
    return joined.select(*rows.columns, *(F.col("_known")[v].alias(v) for v in values))
