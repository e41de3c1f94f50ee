"""A keyed store of transcripts in Parquet: whole values by video id or by upload id, written bucket by bucket."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clipwright.sources.documents import TRANSCRIPT, sentence_transcript

ENTRY = "kind string, id string, value string, bucket int"
MARK = "bucket int, version long, folder string"


def _entries(rows: DataFrame, buckets: int) -> DataFrame:
    """An entry for each id that a row (video_id, uploaded_video_id, value) has; of several values of an id the greatest stays. Rows without an id go."""
    ids = F.array(F.struct(F.lit("video").alias("kind"), F.col("video_id").cast("string").alias("id")), F.struct(F.lit("upload").alias("kind"), F.col("uploaded_video_id").cast("string").alias("id")))
    each = rows.select("value", F.explode(ids).alias("e")).where("e.id is not null").groupBy("e.kind", "e.id").agg(F.max("value").alias("value"))
    return each.withColumn("bucket", F.pmod(F.xxhash64("kind", "id"), F.lit(buckets)).cast("int"))


def _marks(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(MARK).parquet(f"{path}/marks")
    except AnalysisException:
        return spark.createDataFrame([], MARK)


def stored(spark: SparkSession, path: str, only: list[int] | None = None) -> DataFrame:
    """The entries that are in force: of each bucket (or of `only` those) the folder that its last mark names. A row for each bucket reaches the driver."""
    marks = _marks(spark, path).groupBy("bucket").agg(F.max_by("folder", "version").alias("folder")).collect()
    paths = [f"{path}/data/{m['folder']}/bucket={m['bucket']}" for m in marks if only is None or m["bucket"] in only]
    parts = [spark.read.schema("kind string, id string, value string").parquet(p).withColumn("bucket", F.lit(int(p.rpartition("=")[2]))) for p in paths]
    out = spark.createDataFrame([], ENTRY)
    for part in parts:
        out = out.unionByName(part)
    return out


def save(rows: DataFrame, path: str, buckets: int = 16) -> None:
    """Put the values of `rows` (video_id, uploaded_video_id, value) into the store at `path`, in place of older ones of the same ids.

    Only buckets with a new entry are written, into a folder of their own; then one file marks that folder as the buckets' last. A save that
    fails before has changed nothing, and what it has written is never read. Saves at the same time need a lock of the caller's.
    """
    spark, new = rows.sparkSession, _entries(rows, buckets)
    touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]
    if not touched:
        return
    old = stored(spark, path, touched).join(new, ["kind", "id"], "left_anti").select("kind", "id", "value", "bucket")
    folder = uuid.uuid4().hex
    old.unionByName(new).write.partitionBy("bucket").parquet(f"{path}/data/{folder}")
    version = (_marks(spark, path).agg(F.max("version")).first()[0] or 0) + 1
    spark.createDataFrame([(b, version, folder) for b in touched], MARK).coalesce(1).write.mode("append").parquet(f"{path}/marks")


def found(asked: DataFrame, entries: DataFrame) -> DataFrame:
    """`asked` (video_id, uploaded_video_id, ...) with the value stored under the video id, or else under the upload id."""
    by = lambda kind, name: entries.where(F.col("kind") == kind).select(F.col("id").alias(name), F.col("value").alias(f"_{kind}"))
    own = asked.withColumn("_v", F.col("video_id").cast("string")).withColumn("_u", F.col("uploaded_video_id").cast("string"))
    both = own.join(by("video", "_v"), "_v", "left").join(by("upload", "_u"), "_u", "left")
    return both.withColumn("value", F.coalesce("_video", "_upload")).drop("_v", "_u", "_video", "_upload")


def _document(value: Column) -> Column:
    return F.from_json(value, TRANSCRIPT)


def lines(values: DataFrame) -> DataFrame:
    """(video_id, seg_idx, start, end, text) of values (video_id, value): a JSON transcript's own lines, or else the sentences of the text."""
    read = values.withColumn("_json", F.try_parse_json("value").isNotNull() & F.ltrim("value").startswith("{"))
    own = read.where("_json").select("video_id", F.posexplode(_document(F.col("value"))["segments"]).alias("seg_idx", "s")).select("video_id", "seg_idx", "s.start", "s.end", "s.text")
    plain = sentence_transcript(read.where("not _json").select("video_id", F.col("value").alias("text"))).select("video_id", "seg_idx", "start", "end", "text")
    return own.unionByName(plain)
