from pyspark.sql import functions as F

from quadrille.streaming import counters

SF = "/root/testdata/sf0.001"


def test_counts_and_sink(spark, tmp_path):
    batch = spark.read.parquet(f"{SF}/events.parquet")
    batch.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = counters.events(spark, str(tmp_path / "in"), batch.schema, 1)
    running = counters.counts(stream, "event_type").writeStream.format("memory").queryName("running").outputMode("complete").trigger(availableNow=True).start()
    running.awaitTermination(120)
    assert {tuple(r) for r in spark.table("running").collect()} == {tuple(r) for r in batch.groupBy("event_type").count().collect()}
    counters.write_violations(stream, F.col("value") > 50, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == batch.filter("value > 50").count()
