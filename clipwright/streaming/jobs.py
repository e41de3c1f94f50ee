"""Request queues and status as streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

REQUEST = (
    "request_id long, video_id string, uploaded_video_id string, linear_cut boolean, linear_duration int, no_of_videos int, final_video_ids array<int>, canvas_type string, "
    "min_duration int, max_duration int, aspect_ratio string, llm_provider string, overlay_x int"
)


def request_stream(spark: SparkSession, path: str, per_batch: int = 100) -> DataFrame:
    """Requests as they arrive as JSON files."""
    return spark.readStream.schema(REQUEST).option("maxFilesPerTrigger", per_batch).json(path)


def run_requests(stream: DataFrame, accept: Callable[[DataFrame], None], quarantine: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Valid requests to `accept`, invalid ones with their errors to Parquet in `quarantine`."""
    from clipwright.sources.requests import split, validated

    def batch(rows: DataFrame, number: int) -> None:
        rows = rows.persist()
        good, bad = split(validated(rows))
        bad.withColumn("batch", F.lit(number)).write.mode("append").parquet(quarantine)
        accept(good)
        rows.unpersist()

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def latest_status(events: DataFrame) -> DataFrame:
    """The last status of each job, of (task_id, video_id, status, ts); batch or, in complete mode, stream."""
    return events.groupBy("task_id").agg(F.max_by("video_id", "ts").alias("video_id"), F.max_by("status", "ts").alias("status"), F.max("ts").alias("ts"))
