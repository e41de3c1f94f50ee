"""The tables that the operators work on, derived from the driver's tables.

Times are seconds from the start of the media, as doubles. Each table can be replaced by one
of the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clipwright.functions.text import n_words


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def transcript(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(video_id, seg_idx, speaker, text, n_words, start, end): turns of conversations, half a second a word."""
    said = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("video_id"), F.col("turn").alias("seg_idx"), F.col("role").alias("speaker"), "text", n_words(F.col("text")).alias("n_words"))
    gap = F.element_at(F.array(F.lit(0.0), F.lit(0.5), F.lit(1.0), F.lit(2.5)), (F.col("seg_idx") % 4 + 1).cast("int"))
    dur = F.col("n_words") * 0.5
    end = F.sum(dur + gap).over(Window.partitionBy("video_id").orderBy("seg_idx"))
    return said.withColumn("end", end).withColumn("start", F.col("end") - dur).select("video_id", "seg_idx", "speaker", "text", "n_words", "start", "end")


def videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(video_id, duration, width, height, fps)."""
    length = transcript(spark, sf_dir).groupBy("video_id").agg((F.max("end") + 5).alias("duration"))
    return length.select("video_id", "duration", F.lit(1920).alias("width"), F.lit(1080).alias("height"), F.lit(25.0).alias("fps"))


def breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(video_id, ts, type, confidence): pauses of a second or more, and a visual break every seven seconds."""
    order = Window.partitionBy("video_id").orderBy("seg_idx")
    said = transcript(spark, sf_dir).withColumn("before", F.lag("end").over(order))
    audio = said.where("start - before >= 1").select("video_id", F.col("before").alias("ts"), F.lit("audio").alias("type"), F.lit(0.8).alias("confidence"))
    visual = videos(spark, sf_dir).where("duration >= 7").select("video_id", F.explode(F.sequence(F.lit(1), F.floor(F.col("duration") / 7))).alias("i"))
    visual = visual.select("video_id", (F.col("i") * 7.0).alias("ts"), F.lit("visual").alias("type"), ((F.col("i") % 10) / 10.0).alias("confidence"))
    return audio.unionByName(visual)


def appearances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(video_id, actor, t): distinct minutes since the first of January 2024."""
    seen = table(spark, sf_dir, "events")
    minute = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000 - 1_704_067_200) / 60).cast("long")
    return seen.select(F.col("event_type").alias("video_id"), F.concat(F.lit("u"), F.col("user_id") % 10).alias("actor"), minute.alias("t")).distinct()


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(video_id, det_id, ts, class_name, confidence, relevance, x1, y1, x2, y2, cx, cy): one object per event."""
    seen = table(spark, sf_dir, "events")
    seconds = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).cast("long") - 1_704_067_200
    cx, cy, half = F.col("event_id") * 37 % 1920, F.col("event_id") * 91 % 1080, 20 + F.col("event_id") % 60
    return seen.select(
        F.col("user_id").alias("video_id"),
        F.col("event_id").alias("det_id"),
        seconds.alias("ts"),
        F.col("event_type").alias("class_name"),
        (F.col("event_id") % 100 / 100.0).alias("confidence"),
        (F.col("event_id") % 8 / 8.0).alias("relevance"),
        (cx - half).alias("x1"),
        (cy - half).alias("y1"),
        (cx + half).alias("x2"),
        (cy + half).alias("y2"),
        cx.alias("cx"),
        cy.alias("cy"),
    )


def frame_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(video_id, frame_no, ts, motion, complexity): one sample every two seconds."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    seen = table(spark, sf_dir, "events").withColumn("frame_no", F.row_number().over(order))
    k = F.get_json_object("props", "$.k").cast("double")
    return seen.select(F.col("user_id").alias("video_id"), "frame_no", (F.col("frame_no") * 2.0).alias("ts"), F.col("value").alias("motion"), (k / 100.0).alias("complexity"))


def vision_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(video_id, pos, start, visual_score, visual_interest, people_count, scene_type)."""
    kinds = F.array(*[F.lit(x) for x in ("action", "talking_head", "demonstration", "unknown")])
    return transcript(spark, sf_dir).select(
        "video_id",
        F.col("seg_idx").alias("pos"),
        (F.col("start") + F.col("seg_idx") % 5 - 2).alias("start"),
        (F.col("n_words") % 11 / 10.0).alias("visual_score"),
        (F.col("n_words") % 7 / 7.0).alias("visual_interest"),
        (F.col("seg_idx") % 3).cast("long").alias("people_count"),
        F.element_at(kinds, (F.col("seg_idx") % 4 + 1).cast("int")).alias("scene_type"),
    )


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(directory, path, extension, size, mtime): a file per document; mtime in seconds."""
    docs = table(spark, sf_dir, "documents")
    ext = F.element_at(F.array(*[F.lit(x) for x in (".mp4", ".mov", ".log", ".mkv", ".json")]), (F.col("doc_id") % 5 + 1).cast("int"))
    name = F.when(F.col("doc_id") % 17 == 0, "sample").otherwise("clip")
    directory = F.element_at(F.array(*[F.lit(x) for x in ("input", "output", "temp")]), (F.col("doc_id") % 3 + 1).cast("int"))
    return docs.select(
        directory.alias("directory"),
        F.concat(directory, F.lit("/"), name, F.lit("_"), F.col("doc_id"), ext).alias("path"),
        ext.alias("extension"),
        F.col("n_chars").alias("size"),
        (F.lit(1_704_067_200) + F.col("doc_id") * 3600).cast("long").alias("mtime"),
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Job requests made of orders, some of which break each rule."""
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        key.alias("request_id"),
        F.when(key % 11 != 0, F.concat(F.lit("v"), key)).alias("video_id"),
        F.when(key % 22 == 0, F.concat(F.lit("up"), key)).alias("uploaded_video_id"),
        (key % 2 == 0).alias("linear_cut"),
        (key % 700).cast("int").alias("linear_duration"),
        (key % 4).cast("int").alias("no_of_videos"),
        F.slice(F.array(*[F.lit(i) for i in (1, 2, 3)]), 1, (key % 4).cast("int")).alias("final_video_ids"),
        F.when(key % 13 == 0, "square").when(key % 3 == 0, "shorts").otherwise("clips").alias("canvas_type"),
        F.lit(15).alias("min_duration"),
        (key % 120).cast("int").alias("max_duration"),
        F.when(key % 19 == 0, "9x16").when(key % 7 == 0, None).otherwise("9:16").alias("aspect_ratio"),
        F.when(key % 23 == 0, "other").when(key % 5 == 0, "openai").otherwise("ollama").alias("llm_provider"),
        (key % 2300 - 50).cast("int").alias("overlay_x"),
    )


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(request_id, prompt): what the first turn of each conversation says, after one of seven requests."""
    asked = (
        "Show me a few funny moments", "The most dramatic turning point, in detail", "Many short clips that explain how to learn this", "The 5000 mAh battery and 120 Hz display of the X200 in 4k",
        "Quick action and movement, visual only", "Touching people, please", "Anything",
    )
    first = table(spark, sf_dir, "conversations").where("turn = 0")
    ask = F.element_at(F.array(*[F.lit(a) for a in asked]), (F.col("conv_id") % len(asked) + 1).cast("int"))
    return first.select(F.col("conv_id").alias("request_id"), F.concat_ws(". ", ask, "text").alias("prompt"))
