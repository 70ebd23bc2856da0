"""Edits of a layer that is kept in versions: batches of creations, changes and deletions, with their conflicts.

A batch gives what its edits give one after the other. The edits of a feature are folded in their order, starting from
what the layer has, so a batch moves the touched buckets and its own edits once, whatever the number of edits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.sources.store import Store

c = F.col
CREATE, SET, DELETE = "create", "set", "delete"
#: Why an edit is not made.
EXISTS, GONE, UNKNOWN = "it is there already", "it is not there", "the edit is unknown"


def _told(t: Store, edits: DataFrame) -> DataFrame:
    values = F.struct(*[(c(n) if n in edits.columns else F.lit(None)).cast(t.schema[n].dataType).alias(n) for n in t.schema.names])
    return edits.select(*t.key, F.struct("seq", "op", values.alias("new")).alias("edit")).groupBy(*t.key).agg(F.array_sort(F.collect_list("edit")).alias("edits"))


def _folded(t: Store, edits: DataFrame, old: DataFrame) -> DataFrame:
    """For each feature with edits: its key, what is left of it (null: nothing) and its conflicts."""
    have = old.select(*[c(k).alias(f"_{k}") for k in t.key], F.struct(*t.schema.names).alias("had"))
    both = _told(t, edits).join(have, [c(k) == c(f"_{k}") for k in t.key], "left")
    conflict = lambda e, why: F.array(F.struct(e["seq"].alias("seq"), e["op"].alias("op"), F.lit(why).alias("reason")))

    def step(state, e):
        row, there, new = state["row"], state["row"].isNotNull(), e["new"]
        changed = F.struct(*[(row[n] if n in t.key else F.coalesce(new[n], row[n])).alias(n) for n in t.schema.names])
        op = e["op"]
        then = F.when((op == CREATE) & ~there, new).when((op == SET) & there, changed).when((op == DELETE) & there, F.lit(None)).otherwise(row)
        wrong = F.when(op == CREATE, F.when(there, conflict(e, EXISTS))).when(op.isin(SET, DELETE), F.when(~there, conflict(e, GONE))).otherwise(conflict(e, UNKNOWN))
        return F.struct(then.alias("row"), F.concat(state["conflicts"], F.coalesce(wrong, state["none"])).alias("conflicts"), state["none"].alias("none"))

    kind = "array<struct<seq:long,op:string,reason:string>>"
    none = F.expr(f"cast(array() as {kind})")
    start = F.struct(c("had").alias("row"), none.alias("conflicts"), none.alias("none"))
    end = F.aggregate("edits", start, step)
    return both.select(*t.key, end.alias("end")).select(*t.key, c("end.row").alias("row"), c("end.conflicts").alias("conflicts"))


def apply(t: Store, edits: DataFrame, transaction: str) -> DataFrame:
    """Makes the edits of a batch in one version and gives those that could not be made: the key, seq, op and reason.

    edits has the layer's key, seq (their order, a number that no two edits of a feature share), op (create, set or delete)
    and any of the layer's columns; a column that is null in a set stays as it was. Creating what is there and setting or
    deleting what is not are conflicts, and the edits behind them go on from what there is. A batch that runs again changes
    nothing and gives the same conflicts, which lie beside the layer's data. Edits without a key raise ValueError.
    """
    path = f"{t.path}/conflicts/{transaction}"
    if not edits.filter(" OR ".join(f"`{k}` IS NULL" for k in t.key)).isEmpty():
        raise ValueError("a key is null")
    edits = edits.withColumn("seq", c("seq").cast("long"))

    def combine(old: DataFrame, new: DataFrame) -> DataFrame:
        end = _folded(t, new, old)
        end.select(*t.key, F.explode("conflicts").alias("x")).select(*t.key, "x.*").write.mode("overwrite").parquet(path)
        stay = old.join(new.select(*t.key).distinct(), t.key, "left_anti").select(*t.schema.names)
        return stay.unionByName(end.filter("row IS NOT NULL").select("row.*"))

    t._merged(edits, transaction, combine)
    key = ", ".join(f"`{k}` {t.schema[k].dataType.simpleString()}" for k in t.key)
    return t.spark.read.schema(f"{key}, seq long, op string, reason string").parquet(path)
