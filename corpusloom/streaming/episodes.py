"""Pass rates of episodes as they arrive.

The batch operators are used unchanged; what a stream adds is the bound on state: deliveries of one episode are told
apart within the watermark only, and a window's tasks are final once the watermark has passed its end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.episodes import attempts_by_task, flatten


def read_episodes(spark: SparkSession, path: str, schema, files_per_trigger: int = 16) -> DataFrame:
    """Parquet files of episodes in a folder, as a stream with an explicit schema."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def attempts(stream: DataFrame, event_time: str = "arrived_at", late: str = "7 days", window: str = "1 day") -> DataFrame:
    """attempts_by_task per window of *event_time*; rows later than *late* are dropped, repeated deliveries count once.

    Rows with a null time have no window and are left out.
    """
    timed = stream.withColumn(event_time, F.col(event_time).cast("timestamp")).where(F.col(event_time).isNotNull())
    unique = flatten(timed.withWatermark(event_time, late), event_time).dropDuplicatesWithinWatermark(["episode_id"])
    return attempts_by_task(unique, F.window(event_time, window))
