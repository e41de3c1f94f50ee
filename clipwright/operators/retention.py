"""Which files to delete: plans, never deletions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: What is never deleted, and what counts as a video.
KEPT_EXTENSIONS = (".log", ".json", ".srt", ".ass")
KEPT_NAMES = ("example", "sample", "demo")
VIDEO_EXTENSIONS = (".mp4", ".avi", ".mov", ".mkv", ".wmv", ".flv", ".webm", ".m4v")
RETENTION_HOURS = {"input": 48, "output": 48, "temp": 24}


def may_delete(now: int) -> Column:
    """Not of a kept kind or name, and five minutes old."""
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    kept = F.lower("extension").isin(*KEPT_EXTENSIONS)
    for part in KEPT_NAMES:
        kept = kept | name.contains(part)
    return ~kept & (F.lit(now) - F.col("mtime") >= 300)


def _videos(files: DataFrame) -> DataFrame:
    return files.where(F.lower("extension").isin(*VIDEO_EXTENSIONS))


def by_age(files: DataFrame, now: int) -> DataFrame:
    hours = F.element_at(F.create_map(*[F.lit(x) for pair in RETENTION_HOURS.items() for x in pair]), F.col("directory"))
    return _videos(files).where((F.col("mtime") < now - hours * 3600) & may_delete(now)).select("directory", "path", "size", F.lit("age").alias("rule"))


def _earlier(rows: DataFrame, value: Column, newest_first: bool = False, width: int = 60) -> DataFrame:
    """Adds `before`: the sum of `value` over the files of the directory that come earlier, by age and path.

    Files are summed by minutes first, and only minutes are brought in order for a directory, so that one with any share of all files is many tasks.
    """
    sign = -1 if newest_first else 1
    dealt = rows.withColumn("_v", value).withColumn("_minute", F.floor(F.col("mtime") / width) * sign)
    sums = dealt.groupBy("directory", "_minute").agg(F.sum("_v").alias("_s"))
    base = F.coalesce(F.sum("_s").over(Window.partitionBy("directory").orderBy("_minute").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = Window.partitionBy("directory", "_minute").orderBy(F.col("mtime") * sign, "path").rowsBetween(Window.unboundedPreceding, -1)
    local = dealt.withColumn("_local", F.coalesce(F.sum("_v").over(inside), F.lit(0)))
    joined = local.join(sums.select("directory", "_minute", base.alias("_base")), ["directory", "_minute"])
    return joined.withColumn("before", F.col("_local") + F.col("_base")).drop("_v", "_minute", "_local", "_base")


def by_size(files: DataFrame, now: int, most_bytes: int) -> DataFrame:
    """Of each directory the oldest deletable videos, until enough bytes are freed that it holds `most_bytes`."""
    total = files.groupBy("directory").agg(F.sum("size").alias("total"))
    rows = _videos(files).where(may_delete(now))
    return _earlier(rows, F.col("size")).join(total, "directory").where(F.col("before") < F.col("total") - most_bytes).select("directory", "path", "size", F.lit("size").alias("rule"))


def by_count(files: DataFrame, now: int, most: int) -> DataFrame:
    """Deletable videos beyond the newest `most` of each directory."""
    return _earlier(_videos(files), F.lit(1), newest_first=True).where((F.col("before") >= most) & may_delete(now)).select("directory", "path", "size", F.lit("count").alias("rule"))


def plan(files: DataFrame, now: int, most_bytes: int, most: int) -> DataFrame:
    """Every rule's files, each once, under the first rule that names it."""
    order = F.when(F.col("rule") == "age", 1).when(F.col("rule") == "size", 2).otherwise(3)
    rows = by_age(files, now).unionByName(by_size(files, now, most_bytes)).unionByName(by_count(files, now, most))
    return rows.groupBy("directory", "path", "size").agg(F.min_by("rule", order).alias("rule"))


def directory_info(files: DataFrame) -> DataFrame:
    return files.groupBy("directory").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"), F.min_by("path", F.struct("mtime", "path")).alias("oldest"), F.max_by("path", F.struct("mtime", "path")).alias("newest"))


def finished_inputs(outputs: DataFrame, files: DataFrame) -> DataFrame:
    """Inputs (input, output: a row per output) of which every output is still there."""
    there = files.select(F.col("path").alias("output"), F.lit(True).alias("there"))
    return outputs.join(there, "output", "left").groupBy("input").agg(F.bool_and(F.coalesce("there", F.lit(False))).alias("finished")).where("finished").select("input")
