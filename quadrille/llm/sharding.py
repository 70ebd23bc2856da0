"""Contiguous shards of near-equal bytes, in DataFrame functions alone.

Rows are put in doc_id order over range partitions; each partition's totals give, summed up before it, where its
rows begin in the whole order. A row's shard then follows from the bytes before it. Only sizes move, no texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadrille.llm.common import shared_dir, texts


def balanced_shards(docs: DataFrame, shards: int = 24, row_overhead: int = 8) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null).

    size is the text's UTF-8 bytes (null: none) plus row_overhead. Shard k takes the rows whose middle byte lies
    in the k-th of `shards` equal parts of all bytes, so shards are contiguous in doc_id order and differ by one
    row's size at most; a row larger than a part leaves neighbours empty. slot counts a shard's rows from 0. Rows
    of one doc_id are ordered by checksum and size, a null doc_id comes first, and equal rows are interchangeable.
    Where shards are fewer bytes than rows, some stay empty. An empty table gives no rows; other columns are left out.
    """
    spark = docs.sparkSession
    shared_dir(spark)
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce("text", F.lit(""))
    rows = texts(docs).select("doc_id", (F.octet_length(text) + F.lit(row_overhead)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    order = ["doc_id", "text_crc32", "size"]
    rows = rows.repartitionByRange(partitions, *order).withColumn("part", F.spark_partition_id()).checkpoint()
    totals = rows.groupBy("part").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # a row for each partition, not for each document
    starts = totals.select("part", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rows_before")).checkpoint()
    total = totals.agg(F.sum("bytes")).first()[0] or 1
    upto = Window.partitionBy("part").orderBy(*order)
    placed = (
        rows.withColumn("within", F.sum("size").over(upto.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("nth", F.row_number().over(upto))
        .join(F.broadcast(starts), "part")
        .select(*order, ((2 * (F.col("bytes_before") + F.col("within")) - F.col("size")) * F.lit(shards)).alias("twice"), (F.col("rows_before") + F.col("nth") - 1).alias("place"))
        .withColumn("shard", F.least(F.expr(f"twice div {2 * total}"), F.lit(shards - 1)).cast("int"))
        .checkpoint()
    )
    firsts = placed.groupBy("shard").agg(F.min("place").alias("first"))  # at most `shards` rows
    return placed.join(F.broadcast(firsts), "shard").select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("place") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
