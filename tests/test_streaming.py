"""The stream gives what the batch gives, once its windows are closed."""

from pyspark.sql import functions as F

from corpusloom.operators import episodes
from corpusloom.streaming import episodes as stream


def test_attempts_equal_the_batch(spark, sf_dir, tmp_path):
    batch = spark.read.parquet(f"{sf_dir}/episodes.parquet").select("episode_id", "ok", "num_output_tokens", "traces", "arrived_at")
    batch.where("arrived_at is not null").withColumn("arrived_at", F.col("arrived_at").cast("timestamp")).repartition(4).write.parquet(str(tmp_path / "in"))
    source = spark.read.parquet(str(tmp_path / "in"))
    live = stream.read_episodes(spark, str(tmp_path / "in"), source.schema, 1)
    # Time stands still at one day for all rows, so nothing is late and one window holds everything.
    live = live.withColumn("arrived_at", F.lit("2025-01-01 12:00:00").cast("timestamp"))
    query = stream.attempts(live).writeStream.outputMode("update").format("memory").queryName("attempts").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert query.exception() is None
    latest = spark.table("attempts").groupBy("task").agg(F.max(F.struct("attempts", "errors", "passes")).alias("x")).select("task", "x.attempts", "x.passes")
    want = episodes.attempts_by_task(episodes.summaries(source)).select("task", "attempts", "passes")
    assert sorted(map(tuple, latest.collect())) == sorted(map(tuple, want.collect()))
