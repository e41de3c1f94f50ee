"""Joins of intervals and points in time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clipwright.functions.text import NOTES, line_notes, strip


def interval_join(left: DataFrame, right: DataFrame, by: Sequence[str], left_span: tuple[str, str], right_span: tuple[str, str], width: float = 60.0, closed: bool = False, how: str = "inner") -> DataFrame:
    """Rows of equal `by` whose spans overlap, with all columns of both; `by` once, other names must differ.

    Spans overlap if each starts before the other ends (`closed`: or just then). Both sides are
    dealt to buckets of `width` seconds that they touch, so a video of any length is joined by many
    tasks; a pair that shares several buckets comes from the first one only. `how` may be `left`: rows without a match
    are told from others by a hash of all their columns.
    """
    bucket = lambda c: F.floor(F.col(c) / width).cast("long")
    spread = lambda df, span, name: df.withColumn(name, F.explode(F.sequence(bucket(span[0]), F.greatest(bucket(span[0]), bucket(span[1])))))
    a, b = left_span
    c, d = right_span
    keyed = left.withColumn("_row", F.struct(F.xxhash64(*left.columns), F.xxhash64(F.lit(1), *left.columns))) if how == "left" else left
    lhs = spread(keyed, left_span, "_bucket")
    rhs = spread(right, right_span, "_bucket")
    meet = (F.col(a) <= F.col(d)) & (F.col(c) <= F.col(b)) if closed else (F.col(a) < F.col(d)) & (F.col(c) < F.col(b))
    joined = lhs.join(rhs, [*by, "_bucket"]).where(meet & (F.col("_bucket") == F.greatest(bucket(a), bucket(c)))).drop("_bucket")
    if how == "inner":
        return joined
    alone = keyed.join(joined.select("_row").distinct(), "_row", "left_anti")
    others = [x for x in right.columns if x not in by]
    found = joined.select(*left.columns, *others)
    return found.unionByName(alone.select(*left.columns, *[F.lit(None).cast(right.schema[x].dataType).alias(x) for x in others]))


def segment_text(segments: DataFrame, transcript: DataFrame, width: float = 60.0, notes: bool = False) -> DataFrame:
    """`segments` (video_id, segment_id, seg_start, seg_end, ...) with `text`: the trimmed, non-empty lines that overlap, in order, joined by spaces.

    Segments that nothing overlaps have an empty text. `notes` adds what is noted of the lines for scores (`NOTES`): words found, and numbers of words.
    """
    lines = transcript.select("video_id", "seg_idx", F.col("start").alias("_start"), F.col("end").alias("_end"), strip(F.col("text")).alias("_text")).where("_text <> ''")
    if notes:
        lines = lines.select("*", *line_notes(F.col("_text")))
    met = interval_join(segments.select("video_id", "segment_id", "seg_start", "seg_end"), lines, ["video_id"], ("seg_start", "seg_end"), ("_start", "_end"), width)
    texts = met.groupBy("video_id", "segment_id").agg(F.array_sort(F.collect_list(F.struct("_start", "seg_idx", "_text", *(NOTES[:1] if notes else [])))).alias("_lines"), *[F.sum(c).alias(c) for c in NOTES[1:] if notes])
    found = [F.array_distinct(F.flatten(F.transform("_lines", lambda x: x["_found"]))).alias("_found"), *NOTES[1:]]
    texts = texts.select("video_id", "segment_id", F.array_join(F.transform("_lines", lambda x: x["_text"]), " ").alias("text"), *(found if notes else []))
    rows = segments.join(texts, ["video_id", "segment_id"], "left").withColumn("text", F.coalesce("text", F.lit("")))
    if not notes:
        return rows
    return rows.withColumns({"_found": F.coalesce("_found", F.array().cast("array<string>")), **{c: F.coalesce(c, F.lit(0)) for c in NOTES[1:]}})


def break_counts(segments: DataFrame, breaks: DataFrame) -> DataFrame:
    """Breaks strictly inside each segment, 0 where there are none."""
    points = breaks.select("video_id", F.col("ts").alias("_ts"), F.col("ts").alias("_to"))
    met = interval_join(segments.select("video_id", "segment_id", "seg_start", "seg_end"), points, ["video_id"], ("seg_start", "seg_end"), ("_ts", "_to"))
    counts = met.groupBy("video_id", "segment_id").agg(F.count("*").alias("break_count"))
    return segments.join(counts, ["video_id", "segment_id"], "left").withColumn("break_count", F.coalesce("break_count", F.lit(0)))


def nearest_vision(segments: DataFrame, vision: DataFrame, within: float = 10.0) -> DataFrame:
    """Each segment with the vision row that starts nearest, less than `within` away; of rows of one start the last, of equally near ones the first."""
    last = vision.groupBy("video_id", F.col("start").alias("v_start")).agg(
        F.min("pos").alias("pos"), *[F.max_by(c, "pos").alias(c) for c in ("visual_score", "visual_interest", "people_count", "scene_type")]
    )
    kept = F.struct("v_start", "pos", "visual_score", "visual_interest", "people_count", "scene_type")
    marks = last.select("video_id", F.col("v_start").alias("_at"), kept.alias("v"), F.lit(0).alias("_asks"), F.lit(None).cast(segments.schema["segment_id"].dataType).alias("segment_id"))
    asked = segments.select("video_id", F.col("seg_start").alias("_at"), F.lit(None).cast(marks.schema["v"].dataType).alias("v"), F.lit(1).alias("_asks"), "segment_id")
    # one sort by video and time brings both sides together: the nearest is the last before or the first after
    w = Window.partitionBy("video_id").orderBy("_at", "_asks")
    before = F.last("v", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first("v", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    both = marks.unionByName(asked).select("video_id", "segment_id", "_at", "_asks", F.array(before, after).alias("_both")).where("_asks = 1")
    away = lambda v: F.struct(F.abs(v["v_start"] - F.col("_at")).alias("dt"), v["pos"].alias("pos"), v.alias("v"))
    near = F.array_min(F.filter(F.transform(F.filter("_both", lambda v: v.isNotNull()), away), lambda x: x["dt"] < within))
    best = both.select("video_id", "segment_id", near["v"].alias("v")).where("v is not null")
    joined = segments.join(best, ["video_id", "segment_id"], "left")
    people = F.when(F.col("v.people_count") > 0, 0.1).otherwise(0.0)
    lively = F.when(F.col("v.scene_type").isin("action", "demonstration", "presentation"), 0.05).otherwise(0.0)
    seen = F.col("v").isNotNull()
    quality = F.least(F.lit(1.0), F.col("quality_score") * 0.6 + F.col("v.visual_score") * 0.4 + people)
    engagement = F.least(F.lit(1.0), F.col("engagement_score") * 0.6 + F.col("v.visual_interest") * 0.4 + people + lively)
    return joined.select(
        *[c for c in segments.columns if c not in ("quality_score", "engagement_score")],
        F.when(seen, quality).otherwise(F.col("quality_score")).alias("quality_score"),
        F.when(seen, engagement).otherwise(F.col("engagement_score")).alias("engagement_score"),
        seen.alias("has_vision"),
        F.col("v.v_start").alias("vision_start"),
        F.col("v.scene_type").alias("scene_type"),
    )


def actor_coverage(segments: DataFrame, appearances: DataFrame, confidence: DataFrame | None = None) -> DataFrame:
    """Share of each segment's seconds in which an actor is seen, ends included, at most 1; only actors who are.

    `confidence` (video_id, actor, conf) defaults to 1.
    """
    points = appearances.select("video_id", "actor", F.col("t").cast("double").alias("_t"), F.col("t").cast("double").alias("_to"))
    met = interval_join(segments.select("video_id", "segment_id", "seg_start", "seg_end"), points, ["video_id"], ("seg_start", "seg_end"), ("_t", "_to"), closed=True)
    length = F.greatest(F.first("seg_end") - F.first("seg_start"), F.lit(1e-6))
    found = met.groupBy("video_id", "segment_id", "actor").agg(F.least(F.count("*") / length, F.lit(1.0)).alias("coverage"))
    if confidence is None:
        return found.withColumn("conf", F.lit(1.0))
    return found.join(confidence, ["video_id", "actor"], "left").withColumn("conf", F.coalesce("conf", F.lit(1.0)))


def weighted_presence(coverage: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """Per segment, the sum of weight * coverage * confidence over actors, at most 1; `weights` (actor, weight) defaults to 1."""
    rows = coverage.withColumn("weight", F.lit(1.0)) if weights is None else coverage.join(weights, "actor", "left").withColumn("weight", F.coalesce("weight", F.lit(1.0)))
    return rows.groupBy("video_id", "segment_id").agg(
        F.least(F.sum(F.col("weight") * F.col("coverage") * F.col("conf")), F.lit(1.0)).alias("presence"), F.max_by("actor", F.struct("coverage", "actor")).alias("top_actor")
    )


def object_coverage(segments: DataFrame, objects: DataFrame, short: float | None = None) -> DataFrame:
    """Summed overlap of each object's spans (object_id, obj_start, obj_end, score) with each segment as a share of it, at most 1, and the best score.

    With `short`, spans of that length or less are met in buckets of that width.
    """
    own = segments.select("video_id", "segment_id", "seg_start", "seg_end")
    join = lambda spans, width: interval_join(own, spans, ["video_id"], ("seg_start", "seg_end"), ("obj_start", "obj_end"), width=width)
    if short is None:
        met = join(objects, 3600.0)
    else:
        brief = F.col("obj_end") - F.col("obj_start") <= short
        met = join(objects.where(brief), float(short)).unionByName(join(objects.where(~brief), 3600.0))
    overlap = F.least("seg_end", "obj_end") - F.greatest("seg_start", "obj_start")
    length = F.greatest(F.first("seg_end") - F.first("seg_start"), F.lit(1e-6))
    return met.groupBy("video_id", "segment_id", "object_id").agg(F.least(F.sum(overlap) / length, F.lit(1.0)).alias("coverage"), F.max("score").alias("score"))


def object_scores(segments: DataFrame, detections: DataFrame) -> DataFrame:
    """Means and counts of the detections within each segment, ends included; zeros where there are none."""
    points = detections.select("video_id", F.col("ts").cast("double").alias("_t"), F.col("ts").cast("double").alias("_to"), "class_name", "confidence", "relevance")
    met = interval_join(segments.select("video_id", "segment_id", "seg_start", "seg_end"), points, ["video_id"], ("seg_start", "seg_end"), ("_t", "_to"), width=3600.0, closed=True)
    found = met.groupBy("video_id", "segment_id").agg(
        F.avg("relevance").alias("object_relevance"), F.avg("confidence").alias("object_confidence"), F.count("*").alias("objects_detected"), F.count_distinct("class_name").alias("object_classes")
    )
    zero = {"object_relevance": 0.0, "object_confidence": 0.0, "objects_detected": 0, "object_classes": 0}
    return segments.join(found, ["video_id", "segment_id"], "left").fillna(zero)


def asof_detection(frames: DataFrame, detections: DataFrame, interval: float = 30.0) -> DataFrame:
    """Each frame (video_id, ts) with the last detection at or before it, else the first after it.

    The confidence decays with the distance, to half at `interval`, no further. One sort by
    video and time brings both sides together.
    """
    kept = F.struct(F.col("ts").alias("ts"), "det_id", "confidence")
    marks = detections.select("video_id", "ts", kept.alias("det"), F.lit(0).alias("frame"), F.col("det_id").alias("order"))
    asked = frames.select("video_id", "ts", F.lit(None).cast(marks.schema["det"].dataType).alias("det"), F.lit(1).alias("frame"), F.lit(0).cast("long").alias("order"))
    w = Window.partitionBy("video_id").orderBy("ts", "frame", "order")
    past = F.last("det", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.first("det", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    found = marks.unionByName(asked).withColumn("d", F.coalesce(past, ahead)).where("frame = 1")
    decay = F.greatest(F.lit(0.5), 1.0 - F.abs(F.col("ts") - F.col("d.ts")) / (2.0 * interval))
    return found.select("video_id", "ts", F.col("d.det_id").alias("det_id"), (F.col("d.confidence") * decay).alias("confidence"))


def without_overlapping(candidates: DataFrame, existing: DataFrame, share: float = 0.3) -> DataFrame:
    """Candidates of whose length no existing segment covers more than `share`."""
    others = existing.select("video_id", F.col("seg_start").alias("_s"), F.col("seg_end").alias("_e"))
    met = interval_join(candidates.select("video_id", "segment_id", "seg_start", "seg_end"), others, ["video_id"], ("seg_start", "seg_end"), ("_s", "_e"))
    covered = met.where((F.least("seg_end", "_e") - F.greatest("seg_start", "_s")) / (F.col("seg_end") - F.col("seg_start")) > share)
    return candidates.join(covered.select("video_id", "segment_id").distinct(), ["video_id", "segment_id"], "left_anti")


def caption_lines(clips: DataFrame, transcript: DataFrame, offset: float = 1.7) -> DataFrame:
    """Transcript lines of which half or more lies within a clip, in the clip's time plus `offset`."""
    lines = transcript.select("video_id", "seg_idx", F.col("start").alias("_s"), F.col("end").alias("_e"), strip(F.col("text")).alias("text")).where("text <> ''")
    met = interval_join(clips.select("video_id", "segment_id", "seg_start", "seg_end"), lines, ["video_id"], ("seg_start", "seg_end"), ("_s", "_e"))
    low, high, length = F.greatest("_s", "seg_start"), F.least("_e", "seg_end"), F.col("_e") - F.col("_s")
    met = met.withColumn("share", F.when(length > 0, (high - low) / length).otherwise(0.0)).where("share >= 0.5")
    start = F.greatest(F.lit(0.0), low - F.col("seg_start") + offset)
    end = F.greatest(start + 0.1, high - F.col("seg_start") + offset)
    least = F.when(F.col("share") >= 0.8, 0.0).when(F.col("share") >= 0.6, 0.1).otherwise(0.3)
    return met.withColumn("cap_start", start).withColumn("cap_end", end).where(F.col("cap_start") >= least).select("video_id", "segment_id", "seg_idx", "cap_start", "cap_end", "text")


def gaps_between(segments: DataFrame, least: float = 5.0) -> DataFrame:
    """Gaps longer than `least` seconds between consecutive segments."""
    w = Window.partitionBy("video_id").orderBy("seg_start", "seg_end")
    return segments.select("video_id", F.col("seg_end").alias("gap_start"), F.lead("seg_start").over(w).alias("gap_end")).where(F.col("gap_end") - F.col("gap_start") > least)


def first_containing(points: DataFrame, spans: DataFrame, by: Sequence[str] = ("video_id", "ts"), key: Column | str = "span_start", width: float = 60.0) -> DataFrame:
    """Each point (video_id, ts; told apart by `by`) with the first span (video_id, span_start, span_end, ...) that holds it, ends included; points in none are left out.

    A span is a row in each bucket of `width` that it touches, so `width` should be about the spans' length.
    """
    at = points.withColumn("_to", F.col("ts"))
    met = interval_join(at, spans, ["video_id"], ("ts", "_to"), ("span_start", "span_end"), width, closed=True)
    w = Window.partitionBy(*by).orderBy(key)
    return met.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "_to")


def tolerant_match(segments: DataFrame, analyses: DataFrame, tolerance: float = 2.0, data: str = "data") -> DataFrame:
    """Each segment (video_id, segment_id, seg_start, seg_end) with the `data` of the analysis (video_id, pos, v_start, v_end, data) of the same times, or else of the first one whose times both differ by less than `tolerance`.

    Of analyses with the same times the last one's data stand in the first one's place. Analyses are dealt to the nine cells of a grid over start and end around
    their own, segments to their own cell, so that a pair meets once or never. Adds `exact`; both are null without a match.
    """
    cell = lambda c: F.floor(F.col(c) / tolerance).cast("long")
    around = lambda c: F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: cell(c) + d))
    once = analyses.groupBy("video_id", "v_start", "v_end").agg(F.min("pos").alias("pos"), F.max_by(data, "pos").alias(data))
    near = once.withColumn("_i", around("v_start")).withColumn("_j", around("v_end"))
    own = segments.withColumn("_i", cell("seg_start")).withColumn("_j", cell("seg_end"))
    exact = (F.col("v_start") == F.col("seg_start")) & (F.col("v_end") == F.col("seg_end"))
    close = (F.abs(F.col("v_start") - F.col("seg_start")) < tolerance) & (F.abs(F.col("v_end") - F.col("seg_end")) < tolerance)
    met = own.join(near, ["video_id", "_i", "_j"], "left")
    row = F.struct("exact", data)
    best = met.withColumn("exact", exact).groupBy(*segments.columns).agg(F.min_by(row, F.when(close, F.struct(~exact, "pos"))).alias("best"))
    return best.select(*segments.columns, "best.exact", f"best.{data}")
