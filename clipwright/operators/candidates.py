"""Candidate segments. Columns: video_id, seg_start, seg_end, method, priority, and what the method adds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clipwright.functions import lexicons as lx
from clipwright.functions.text import any_of, n_words, words


def sliding_durations(shortest: int, longest: int) -> list[int]:
    """Every five seconds of the range, and five values near its ends and middle."""
    extra = [shortest + 2, shortest + 7, (shortest + longest) // 2, longest - 7, longest - 2]
    return sorted({*range(shortest, longest + 1, 5), *[d for d in extra if shortest <= d <= longest]})


def sliding_windows(videos: DataFrame, shortest: int = 15, longest: int = 60, step: int = 5) -> DataFrame:
    """Windows of all durations, every `step` seconds, as long as they fit."""
    rows = videos.select("video_id", "duration", F.explode(F.array(*[F.lit(d) for d in sliding_durations(shortest, longest)])).alias("d")).where("d <= duration")
    rows = rows.select("video_id", "d", F.explode(F.sequence(F.lit(0), F.floor((F.col("duration") - F.col("d")) / step))).alias("i"))
    return rows.select("video_id", (F.col("i") * step).cast("double").alias("seg_start"), (F.col("i") * step + F.col("d")).cast("double").alias("seg_end"), F.lit("sliding_window").alias("method"), F.lit(10).alias("priority"))


def _pairs(points: DataFrame, shortest: float, longest: float, method: str, priority: int) -> DataFrame:
    """Pairs of a video's distinct points that lie in the range, with the points between.

    The points of the range are looked up in buckets as wide as it, so that a long video's points
    don't all meet each other.
    """
    ranked = points.select("video_id", "ts").distinct().withColumn("rank", F.row_number().over(Window.partitionBy("video_id").orderBy("ts")))
    width = float(longest)
    first = ranked.select("video_id", F.col("ts").alias("seg_start"), F.col("rank").alias("r1"), F.explode(F.array(F.floor(F.col("ts") / width), F.floor(F.col("ts") / width) + 1)).alias("b"))
    second = ranked.select("video_id", F.col("ts").alias("seg_end"), F.col("rank").alias("r2"), F.floor(F.col("ts") / width).alias("b"))
    span = F.col("seg_end") - F.col("seg_start")
    found = first.join(second, ["video_id", "b"]).where((span >= shortest) & (span <= longest))
    return found.select("video_id", "seg_start", "seg_end", F.lit(method).alias("method"), F.lit(priority).alias("priority"), (F.col("r2") - F.col("r1") - 1).alias("inner_points"))


def _bounds(videos: DataFrame) -> DataFrame:
    return videos.select("video_id", F.explode(F.array(F.lit(0.0), F.col("duration"))).alias("ts"))


def break_pairs(breaks: DataFrame, videos: DataFrame, shortest: float = 15, longest: float = 60) -> DataFrame:
    """All pairs of breaks, and the video's ends, that are `shortest` to `longest` apart."""
    inside = breaks.join(videos.select("video_id", "duration"), "video_id").where("ts between 0 and duration").select("video_id", "ts")
    return _pairs(inside.unionByName(_bounds(videos)), shortest, longest, "scene_based", 2)


def audio_cue_pairs(transcript: DataFrame, videos: DataFrame, shortest: float = 15, longest: float = 60) -> DataFrame:
    """The same over ends of lines with a sentence end, or before a pause over a second."""
    after = F.lead("start").over(Window.partitionBy("video_id").orderBy("seg_idx"))
    cues = transcript.withColumn("next_start", after).where(F.col("text").rlike("[.!?]") | (F.col("next_start") - F.col("end") > 1.0))
    return _pairs(cues.select("video_id", F.col("end").alias("ts")).unionByName(_bounds(videos)), shortest, longest, "audio_cue", 3)


def content_groups(transcript: DataFrame) -> DataFrame:
    """Runs of two or more lines that follow within five seconds or share over a fifth of their words."""
    w = Window.partitionBy("video_id").orderBy("seg_idx")
    low = words(F.lower("text"))
    rows = transcript.withColumn("w", low).withColumn("v", F.lag("w").over(w)).withColumn("before", F.lag("end").over(w))
    longest = F.greatest(F.size("w"), F.size("v"))
    alike = F.when(longest > 0, F.size(F.array_intersect("w", "v")) / longest).otherwise(0.0) > 0.2
    new = F.when(F.col("before").isNull() | ~(alike | (F.col("start") - F.col("before") < 5.0)), 1).otherwise(0)
    rows = rows.withColumn("new", new).withColumn("grp", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("video_id", "grp").agg(F.min("start").alias("group_start"), F.max("end").alias("group_end"), F.count("*").alias("lines")).where("lines >= 2")


def content_aware(transcript: DataFrame, shortest: int = 15, longest: int = 60) -> DataFrame:
    """Whole groups within the range, and parts of them: every whole duration, every ten seconds."""
    groups = content_groups(transcript).withColumn("dur", F.col("group_end") - F.col("group_start")).where(F.col("dur") >= shortest)
    whole = groups.where(F.col("dur") <= longest).select("video_id", F.col("group_start").alias("seg_start"), F.col("group_end").alias("seg_end"), F.lit("content_aware").alias("method"), F.lit(1).alias("priority"))
    most = F.least(F.lit(longest), F.floor("dur").cast("int") - 1)
    parts = groups.where(most >= shortest).select("video_id", "group_start", "dur", F.explode(F.sequence(F.lit(shortest), most)).alias("d"))
    parts = parts.select("video_id", "group_start", "d", F.explode(F.sequence(F.lit(0), F.floor((F.floor(F.col("dur") - F.col("d"))) / 10))).alias("i"))
    start = F.col("group_start") + F.col("i") * 10
    parts = parts.select("video_id", start.alias("seg_start"), (start + F.col("d")).alias("seg_end"), F.lit("content_aware_partial").alias("method"), F.lit(3).alias("priority"))
    return whole.unionByName(parts)


def _centred(rows: DataFrame, videos: DataFrame, shortest: int, longest: int, step: int) -> DataFrame:
    """Windows of every duration around each row's middle, kept within the video."""
    # lines and videos lie by video already: a broadcast of the lines would leave all windows to the few tasks of the videos
    rows = rows.join(videos.select("video_id", "duration").hint("merge"), "video_id").withColumn("d", F.explode(F.sequence(F.lit(shortest), F.lit(longest), F.lit(step))))
    rows = rows.withColumn("seg_start", F.greatest(F.lit(0.0), (F.col("start") + F.col("end")) / 2 - F.col("d") / 2))
    rows = rows.withColumn("seg_end", F.least("duration", F.col("seg_start") + F.col("d")))
    return rows.where(F.col("seg_end") - F.col("seg_start") >= shortest)


def high_value_windows(transcript: DataFrame, videos: DataFrame, shortest: int = 15, longest: int = 60) -> DataFrame:
    low = F.lower("text")
    found = F.filter(F.array(*[F.when(low.contains(k), F.lit(k)) for k in lx.HIGH_VALUE]), lambda k: k.isNotNull())
    rows = transcript.where(any_of(F.col("text"), lx.HIGH_VALUE)).withColumn("keywords", found)
    return _centred(rows, videos, shortest, longest, 15).select("video_id", "seg_idx", "seg_start", "seg_end", F.lit("content_aware").alias("method"), F.lit(1).alias("priority"), "keywords")


def line_quality(text: Column) -> Column:
    return (
        F.when(n_words(text) >= 5, 0.3).otherwise(0.0)
        + F.when(text.rlike("[.!?]"), 0.2).otherwise(0.0)
        + F.when(any_of(text, lx.QUALITY_ENGAGEMENT), 0.3).otherwise(0.0)
        + F.when(any_of(text, lx.DIRECT_ADDRESS), 0.2).otherwise(0.0)
    )


def quality_windows(transcript: DataFrame, videos: DataFrame, shortest: int = 15, longest: int = 60, least: float = 0.4) -> DataFrame:
    rows = transcript.withColumn("quality_score", F.round(line_quality(F.col("text")), 4)).where(F.col("quality_score") >= least)
    return _centred(rows, videos, shortest, longest, 10).select("video_id", "seg_idx", "seg_start", "seg_end", F.lit("quality_driven").alias("method"), F.lit(2).alias("priority"), "quality_score")


def actor_windows(appearances: DataFrame, length: float = 60.0, longest: float = 120.0) -> DataFrame:
    """A centred window and a doubled one around every appearance (video_id, actor, t)."""
    both = F.array(F.lit(length), F.lit(min(longest, 2 * length)))
    rows = appearances.select("video_id", "actor", "t", F.explode(F.array_distinct(both)).alias("d"))
    start = F.greatest(F.lit(0.0), F.col("t") - F.col("d") / 2)
    return rows.select("video_id", "actor", "t", start.alias("seg_start"), (start + F.col("d")).alias("seg_end"), F.lit("actor_based").alias("method"), F.lit(1).alias("priority"))


def linear_cuts(videos: DataFrame, parts: int = 5, length: float = 30.0) -> DataFrame:
    """Part i is [i * length, (i + 1) * length], cut at the end of the video."""
    rows = videos.select("video_id", "duration", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part")).where(F.col("part") * length < F.col("duration"))
    return rows.select("video_id", "part", (F.col("part") * length).alias("seg_start"), F.least("duration", (F.col("part") + 1) * length).alias("seg_end"))


def representative_times(segments: DataFrame) -> DataFrame:
    """Two, three or four moments of a segment: under 15 seconds, under 45, or longer."""
    dur = F.col("seg_end") - F.col("seg_start")
    shares = F.when(dur < 15, F.array(F.lit(0.25), F.lit(0.75))).when(dur < 45, F.array(F.lit(0.2), F.lit(0.5), F.lit(0.8))).otherwise(F.array(F.lit(0.15), F.lit(0.4), F.lit(0.6), F.lit(0.85)))
    rows = segments.select("video_id", "segment_id", "seg_start", dur.alias("dur"), F.posexplode(shares).alias("i", "share"))
    return rows.select("video_id", "segment_id", "i", (F.col("seg_start") + F.col("share") * F.col("dur")).alias("ts"))


def numbered(segments: DataFrame) -> DataFrame:
    """`segments` with segment_id, their place in the video by start, end, method and priority."""
    w = Window.partitionBy("video_id").orderBy("seg_start", "seg_end", "method", "priority")
    return segments.withColumn("segment_id", F.row_number().over(w))


def all_candidates(transcript: DataFrame, breaks: DataFrame, videos: DataFrame, shortest: int = 15, longest: int = 60) -> DataFrame:
    """Every method's candidates."""
    parts = [
        high_value_windows(transcript, videos, shortest, longest), content_aware(transcript, shortest, longest), quality_windows(transcript, videos, shortest, longest),
        break_pairs(breaks, videos, shortest, longest), audio_cue_pairs(transcript, videos, shortest, longest), sliding_windows(videos, shortest, longest),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out
