"""Rankings by intensity, seeded variation, summaries of runs and layouts of frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clipwright.functions import lexicons as lx
from clipwright.functions.text import hits
from clipwright.operators.intervals import interval_join


def segment_intensity(segments: DataFrame, timeline: DataFrame) -> DataFrame:
    """Mean intensity of the timeline rows (seg_idx, start, end, intensity) that overlap each segment, 0 where none does.

    It adds up in the order of lines: segments of one mean would else differ in the last bit, by which they are ranked and rounded.
    """
    points = timeline.select("video_id", "seg_idx", F.col("start").alias("_s"), F.col("end").alias("_e"), "intensity")
    met = interval_join(segments.select("video_id", "segment_id", "seg_start", "seg_end"), points, ["video_id"], ("seg_start", "seg_end"), ("_s", "_e"))
    lines = met.groupBy("video_id", "segment_id").agg(F.array_sort(F.collect_list(F.when(F.col("intensity").isNotNull(), F.struct("seg_idx", "intensity")))).alias("_lines"))
    total = F.aggregate("_lines", F.lit(0.0), lambda a, x: a + x["intensity"])
    means = lines.select("video_id", "segment_id", F.when(F.size("_lines") > 0, total / F.size("_lines")).alias("intensity"))
    return segments.join(means, ["video_id", "segment_id"], "left").withColumn("intensity", F.coalesce("intensity", F.lit(0.0)))


def climax_scores(segments: DataFrame, timeline: DataFrame, climax_at: float = 0.75, semantic: float = 0.0) -> DataFrame:
    """Segments (text, quality_score) with climax_score: intensity, place, quality and length, less for credits and what comes after 87 %."""
    rows = segment_intensity(segments, timeline)
    stop = timeline.groupBy("video_id").agg(F.max("end").alias("stop"))
    rows = rows.join(stop, "video_id").withColumn("place", (F.col("seg_start") + F.col("seg_end")) / 2 / F.col("stop"))
    place, dur = F.col("place"), F.col("seg_end") - F.col("seg_start")
    length = F.when((dur >= 30) & (dur <= 90), 0.1).when((dur >= 20) & (dur <= 120), 0.08).when((dur >= 15) & (dur <= 150), 0.06).otherwise(0.03)
    credit = (place > 0.92) | (hits(F.col("text"), lx.CREDITS) >= 2)
    late = F.when(credit, -0.9).when(place > 0.9, -0.7).when(place > 0.87, -0.4).otherwise(0.0)
    bonus = F.when((place >= 0.6) & (place <= 0.8), 0.15).when((place >= 0.5) & (place <= 0.85), 0.1).otherwise(0.0)
    near = F.greatest(F.lit(0.0), 1 - F.abs(place - climax_at) * 2)
    score = semantic * 0.3 + F.col("intensity") * 0.25 + near * 0.2 + F.col("quality_score") * 0.15 + length + late + bonus
    return rows.withColumn("climax_score", F.greatest(F.lit(0.0), score)).drop("stop", "place")


def climax_top(scored: DataFrame, most: int = 10, confidence: float = 0.0) -> DataFrame:
    """Of a video's first 2 * most segments by climax_score, those above 0.4 with an intensity above 0.3; the first `most`."""
    w = Window.partitionBy("video_id").orderBy(F.desc("climax_score"), "segment_id")
    rows = scored.withColumn("_p", F.row_number().over(w)).where(F.col("_p") <= 2 * most).withColumn("climax_score", F.col("climax_score") + confidence * 0.1)
    rows = rows.where((F.col("climax_score") > 0.4) & (F.col("intensity") > 0.3))
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most).drop("_p")


def seeded(seed: Column | str, *parts: str) -> Column:
    """A number in (0, 1) of the seed and the parts, the same in every run."""
    seed = F.lit(seed) if isinstance(seed, str) else seed
    return (F.pmod(F.xxhash64(seed, *parts), F.lit(1 << 30)).cast("double") + 0.5) / float(1 << 30)


def varied(segments: DataFrame, most: int = 5, seed: str = "0", high_share: float = 0.45) -> DataFrame:
    """A seeded draw without replacement: a share from the better half by early starts, the rest from the other by rank.

    Keys -ln(u) / weight decide, so a segment's chance follows its weight; starts are distinct.
    """
    by_score = Window.partitionBy("video_id").orderBy(F.desc("quality_score"), "segment_id")
    rows = segments.withColumn("_rank", F.row_number().over(by_score)).withColumn("_n", F.count("*").over(Window.partitionBy("video_id")))
    rows = rows.withColumn("_first", F.row_number().over(Window.partitionBy("video_id", "seg_start").orderBy("_rank"))).where("_first = 1")
    rows = rows.withColumn("tier", F.when(F.col("_rank") <= F.floor(F.col("_n") / 2), "high").otherwise("medium"))
    order = F.when(F.col("tier") == "high", F.col("seg_start")).otherwise(F.col("_rank"))
    rows = rows.withColumn("_at", F.row_number().over(Window.partitionBy("video_id", "tier").orderBy(order, "segment_id")))
    key = -F.log(seeded(seed, "video_id", "segment_id")) * F.col("_at")
    rows = rows.withColumn("_place", F.row_number().over(Window.partitionBy("video_id", "tier").orderBy(key)))
    high = max(1, int(most * high_share))
    return rows.where(F.when(F.col("tier") == "high", F.col("_place") <= high).otherwise(F.col("_place") <= most - high)).drop("_rank", "_n", "_first", "_at", "_place")


def segment_summary(segments: DataFrame) -> DataFrame:
    """Number, length, means and bands of a video's scored segments."""
    dur = F.col("seg_end") - F.col("seg_start")
    return segments.groupBy("video_id").agg(
        F.count("*").alias("segments"), F.sum(dur).alias("total_duration"), F.min(dur).alias("shortest"), F.max(dur).alias("longest"), F.avg("quality_score").alias("mean_quality"), F.avg("engagement_score").alias("mean_engagement"),
        F.count_if(F.col("quality_score") > 0.7).alias("high"), F.count_if((F.col("quality_score") >= 0.4) & (F.col("quality_score") <= 0.7)).alias("medium"), F.count_if(F.col("quality_score") < 0.4).alias("low"), F.count_distinct("content_type").alias("content_types"),
    )


def type_counts(segments: DataFrame) -> DataFrame:
    return segments.groupBy("video_id", "content_type").count().withColumnRenamed("count", "segments")


def run_summary(segments: DataFrame, videos: DataFrame) -> DataFrame:
    """Of a whole run: videos, those without segments, segments, and segments a video."""
    per = videos.select("video_id").join(segments.groupBy("video_id").count(), "video_id", "left")
    return per.agg(F.count("*").alias("videos"), F.count_if(F.col("count").isNull()).alias("without_segments"), F.coalesce(F.sum("count"), F.lit(0)).alias("segments"), F.avg(F.coalesce("count", F.lit(0))).alias("segments_per_video"))


def video_issues(videos: DataFrame, shortest: float = 1.0) -> DataFrame:
    """Videos (duration, fps, width, height) with what is wrong with them."""
    rules = {"too_short": F.col("duration") < shortest, "low_fps": F.col("fps") < 10, "low_resolution": (F.col("width") < 640) | (F.col("height") < 480)}
    return videos.withColumn("issues", F.filter(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()]), lambda x: x.isNotNull()))


def every_kth(segments: DataFrame, most: int = 20) -> DataFrame:
    """Evenly spread segments by start, `most` a video at most."""
    w = Window.partitionBy("video_id")
    rows = segments.withColumn("_i", F.row_number().over(w.orderBy("seg_start", "seg_end", "segment_id")) - 1).withColumn("_n", F.count("*").over(w))
    return rows.where(F.col("_i") % F.greatest(F.lit(1), F.floor(F.col("_n") / most)) == 0).where(F.col("_i") / F.greatest(F.lit(1), F.floor(F.col("_n") / most)) < most).drop("_i", "_n")


def primary_subjects(detections: DataFrame, cell: str, most: int = 3) -> DataFrame:
    """In each cell the `most` detections of highest relevance, confidence and area."""
    area = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    w = Window.partitionBy("video_id", cell).orderBy(F.desc("relevance"), F.desc("confidence"), area.desc(), "det_id")
    return detections.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)


def frame_layouts(detections: DataFrame, cell: str) -> DataFrame:
    """One speaker, or the two most confident from left to right with their mean confidence."""
    w = Window.partitionBy("video_id", cell).orderBy(F.desc("confidence"), "x1", "det_id")
    two = detections.withColumn("_r", F.row_number().over(w)).where("_r <= 2")
    found = two.groupBy("video_id", cell).agg(F.array_sort(F.collect_list(F.struct("x1", "det_id"))).alias("s"), F.avg("confidence").alias("confidence"))
    return found.select("video_id", cell, F.when(F.size("s") == 1, "single_speaker").otherwise("split_screen").alias("layout"), F.col("s")[0]["det_id"].alias("left_id"), F.try_element_at("s", F.lit(2))["det_id"].alias("right_id"), "confidence")


def smoothed_speakers(detections: DataFrame, last: int = 5) -> DataFrame:
    """Boxes as the mean of the last `last` of their cell of a hundred pixels, newer ones weighing more (1 to n)."""
    key = F.concat_ws("_", F.floor(F.col("cx") / 100), F.floor(F.col("cy") / 100))
    rows = detections.withColumn("speaker", key)
    w = Window.partitionBy("video_id", "speaker").orderBy("ts", "det_id").rowsBetween(-last + 1, 0)
    rows = rows.withColumn("_h", F.collect_list(F.struct("x1", "y1", "x2", "y2")).over(w))
    weight = F.size("_h") * (F.size("_h") + 1) / 2
    mean = lambda c: F.floor(F.aggregate(F.transform("_h", lambda b, i: b[c] * (i + 1)), F.lit(0).cast("long"), lambda a, x: a + x) / weight).alias(f"s_{c}")
    return rows.select("video_id", "speaker", "det_id", *[mean(c) for c in ("x1", "y1", "x2", "y2")])


def log_entries(transcript: DataFrame, detections: DataFrame, vision: DataFrame) -> DataFrame:
    """(kind, video_id, class, words, chars, score): one row for each line, detection and vision segment, by speaker, class and scene type."""
    unknown = lambda c: F.coalesce(c, F.lit("unknown")).alias("class")
    nothing, none = F.lit(0).cast("long"), F.lit(None).cast("double").alias("score")
    audio = transcript.select(F.lit("audio").alias("kind"), "video_id", unknown("speaker"), F.col("n_words").cast("long").alias("words"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("chars"), none)
    objects = detections.select(F.lit("object").alias("kind"), "video_id", unknown("class_name"), nothing.alias("words"), nothing.alias("chars"), none)
    scenes = vision.select(F.lit("vision").alias("kind"), "video_id", unknown("scene_type"), nothing.alias("words"), nothing.alias("chars"), F.nullif(F.col("visual_interest"), F.lit(0.0)).alias("score"))
    return audio.unionByName(objects).unionByName(scenes)


def run_report(entries: DataFrame) -> DataFrame:
    """Counts of `log_entries` by kind, by kind and class, by kind and video, and by all three, in one pass.

    Adds words and characters, the number of distinct classes and videos, and the mean, least and largest score, of which zero and missing ones are
    left out (0 without any). `level` names what a row is about; the columns that it isn't about are null.
    """
    sets = [["kind"], ["kind", "class"], ["kind", "video_id"], ["kind", "class", "video_id"]]
    score = lambda f: F.coalesce(f("score"), F.lit(0.0))
    level = F.concat_ws("+", F.lit("kind"), F.when(F.grouping("class") == 0, "class"), F.when(F.grouping("video_id") == 0, "video"))
    return entries.groupingSets([[F.col(c) for c in s] for s in sets], "kind", "class", "video_id").agg(
        level.alias("level"), F.count("*").alias("entries"), F.sum("words").alias("words"), F.sum("chars").alias("chars"), F.count_distinct("class").alias("classes"), F.count_distinct("video_id").alias("videos"),
        score(F.avg).alias("mean_score"), score(F.min).alias("least_score"), score(F.max).alias("most_score"),
    )
