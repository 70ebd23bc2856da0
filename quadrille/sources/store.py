"""A keyed table in versions: merges write new files and one small manifest names the version, so readers see all of a
change or none of it, and a change that runs twice counts once.

A folder holds `data/<transaction>/bucket=<k>` (Parquet) and `versions/<n>.json`. A version names the folder of each
bucket of keys and the transactions that led to it. A merge rewrites the buckets that its keys fall into, and no
others, then puts the next version's manifest in place by a rename that fails where that version exists; then it starts
again from there. Old versions stay readable until their folders are removed.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType, TimestampType

c = F.col
TRIES = 20


class Files:
    """The file system of a path, as Spark sees it."""

    def __init__(self, spark: SparkSession, path: str):
        jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self._path, self._io = jvm.org.apache.hadoop.fs.Path, jvm.org.apache.commons.io.IOUtils
        self.fs = self._path(path).getFileSystem(self.conf)
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf)
        self._none = spark._sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)

    def names(self, folder: str) -> list[str]:
        at = self._path(folder)
        return [f.getPath().getName() for f in self.fs.listStatus(at)] if self.fs.exists(at) else []

    def read(self, path: str) -> str:
        stream = self.fs.open(self._path(path))
        try:
            return self._io.toString(stream, "UTF-8")
        finally:
            stream.close()

    def put(self, path: str, text: str) -> bool:
        """Writes a file whole; False where it exists."""
        draft = self._path(f"{path.rpartition('/')[0]}/.{uuid.uuid4().hex}")
        stream = self.fs.create(draft, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        try:
            if self.fs.exists(self._path(path)):
                return False
            self._context.rename(draft, self._path(path), self._none)
            return True
        except Exception as e:
            if "FileAlreadyExists" in str(e):
                return False
            raise
        finally:
            if self.fs.exists(draft):
                self.fs.delete(draft, False)


@dataclass
class Store:
    """A table with a key. key columns must not be null in what is merged."""

    spark: SparkSession
    path: str
    schema: StructType
    key: list[str]
    buckets: int

    @classmethod
    def create(cls, spark: SparkSession, path: str, schema: StructType, key: list[str], buckets: int = 64) -> Store:
        """A new, empty table; ValueError where there is one."""
        files = Files(spark, path)
        first = {"version": 0, "schema": schema.json(), "key": key, "buckets": buckets, "folders": {}, "done": []}
        if not files.put(f"{path}/versions/{0:012d}.json", json.dumps(first)):
            raise ValueError(f"there is a table at {path}")
        return cls(spark, path, schema, key, buckets)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Store:
        told = json.loads(Files(spark, path).read(f"{path}/versions/{0:012d}.json"))
        return cls(spark, path, StructType.fromJson(json.loads(told["schema"])), told["key"], told["buckets"])

    def versions(self) -> list[int]:
        return sorted(int(n[:-5]) for n in Files(self.spark, self.path).names(f"{self.path}/versions") if n.endswith(".json") and not n.startswith("."))

    def _manifest(self, version: int | None = None) -> dict:
        version = self.versions()[-1] if version is None else version
        return json.loads(Files(self.spark, self.path).read(f"{self.path}/versions/{version:012d}.json"))

    def _rows(self, manifest: dict, only: list[str] | None = None) -> DataFrame:
        folders = [f"{self.path}/{f}" for b, f in manifest["folders"].items() if only is None or b in only]
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def read(self, version: int | None = None) -> DataFrame:
        """The table as the last version, or an earlier one, has it."""
        return self._rows(self._manifest(version))

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def _merged(self, changes: DataFrame, transaction: str, combine) -> int:
        """The version after combine(old rows, changes) on the buckets of changes; a transaction that is done changes nothing."""
        files = Files(self.spark, self.path)
        touched = [str(r[0]) for r in changes.select(self._bucket().alias("b")).distinct().collect()]  # as many as buckets at most
        for _ in range(TRIES):
            now = self._manifest()
            if transaction in now["done"]:
                return now["version"]
            folder = f"data/{uuid.uuid4().hex}"
            new = combine(self._rows(now, touched), changes).select(*self.schema.names).withColumn("_bucket", self._bucket())
            new.repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/{folder}")
            have = {n.partition("=")[2] for n in files.names(f"{self.path}/{folder}") if n.startswith("_bucket=")}
            folders = {b: f for b, f in now["folders"].items() if b not in touched} | {b: f"{folder}/_bucket={b}" for b in have}
            then = now | {"version": now["version"] + 1, "folders": folders, "done": [*now["done"], transaction]}
            if files.put(f"{self.path}/versions/{then['version']:012d}.json", json.dumps(then)):
                return then["version"]
        raise RuntimeError(f"{TRIES} other changes came first")

    def upsert(self, rows: DataFrame, transaction: str, order: str | None = None) -> int:
        """Rows of new keys are added, those of known ones replace what was there. Of rows that repeat a key the one with
        the greatest `order` counts, else any one. Rows with a null key raise ValueError. Gives the version."""
        if not rows.filter(" OR ".join(f"`{k}` IS NULL" for k in self.key)).isEmpty():
            raise ValueError("a key is null")
        best = F.struct(*([order] if order else []), *[n for n in self.schema.names if n != order])
        single = rows.groupBy(*self.key).agg(F.max_by(F.struct(*self.schema.names), best if order is None else c(order)).alias("_row")).select("_row.*")
        return self._merged(single, transaction, lambda old, new: old.join(new.select(*self.key), self.key, "left_anti").select(*self.schema.names).unionByName(new))

    def update(self, keys: DataFrame, transaction: str, **values: Column) -> int:
        """Sets columns of the rows that keys names; keys of no row are passed over. values may use columns of both, those of
        keys as `with.<name>`."""
        named = keys.dropDuplicates(self.key)

        def combine(old, new):
            told = new.select(*[c(k).alias(f"_{k}") for k in self.key], F.struct("*").alias("with"))
            both = old.join(told, [c(k) == c(f"_{k}") for k in self.key], "left")
            hit = c("with").isNotNull()
            return both.select(*[F.when(hit, values[n]).otherwise(c(n)).cast(self.schema[n].dataType).alias(n) if n in values else c(n) for n in self.schema.names])

        return self._merged(named, transaction, combine)

    def delete(self, keys: DataFrame, transaction: str) -> int:
        """Removes the rows that keys names."""
        return self._merged(keys.select(*self.key).distinct(), transaction, lambda old, new: old.join(new, self.key, "left_anti"))


#: A run of checks, from opening to closing.
RUNS = StructType([StructField(n, t) for n, t in (("run_id", StringType()), ("started", TimestampType()), ("ended", TimestampType()), ("status", StringType()), ("total_errors", LongType()), ("total_warnings", LongType()), ("summary", StringType()))])


def open_run(runs: Store, run_id: str, started) -> int:
    """A run's row with status Running; opening it again changes nothing."""
    row = runs.spark.createDataFrame([(run_id, started, None, "Running", 0, 0, None)], RUNS)
    return runs.upsert(row, f"open {run_id}")


def close_run(runs: Store, run_id: str, ended, errors: DataFrame, status: str = "Completed", summary: str | None = None) -> int:
    """Ends a run with the counts of its errors (run_id, severity): warnings apart from all else. A run that was not
    opened stays unknown; closing it again changes nothing."""
    warned = F.coalesce(c("severity") == "Warning", F.lit(False))
    totals = errors.filter(c("run_id") == run_id).agg(F.count_if(~warned).alias("errors"), F.count_if(warned).alias("warnings")).select(F.lit(run_id).alias("run_id"), "errors", "warnings")
    values = {"ended": F.lit(ended), "status": F.lit(status), "total_errors": c("with.errors"), "total_warnings": c("with.warnings"), "summary": F.lit(summary)}
    return runs.update(totals, f"close {run_id}", **values)
