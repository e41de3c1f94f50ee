"""Scoring, ranking, greedy selection and merging of segments.

Selections that depend on what was taken before run once per video: Spark has generated,
joined, scored and ordered the rows by then. A video's rows are what one task holds.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from itertools import chain

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from clipwright.functions import lexicons as lx
from clipwright.functions.text import NOTES, any_of, clip_engagement, clip_text_quality, clip_type, end_quality, flow_quality, hits, noted, prepared, same_texts, segment_text_quality, segments_of, start_quality
from clipwright.operators.intervals import interval_join
from clipwright.operators.windows import sentence_starts


def duration_factor(duration: Column) -> Column:
    return F.when((duration >= 60) & (duration <= 90), 1.0).when((duration > 90) & (duration <= 120), 0.95).when((duration >= 45) & (duration < 60), 0.8).otherwise(0.7)


def scored(segments: DataFrame) -> DataFrame:
    """Quality, engagement and content type of segments with text; with the notes of their lines (`NOTES`, which go), texts needn't be looked through."""
    given = "_found" in segments.columns
    texts, text = noted(segments) if given else prepared(same_texts(segments, "video_id"), dealt=True)
    texts = texts.withColumn("_quality", clip_text_quality(text)).withColumn("_engagement", clip_engagement(text)).withColumn("content_type", clip_type(text)).drop("_low", "_pieces")
    rows = texts if given else segments_of(texts, "_quality", "_engagement", "content_type")
    quality = F.least(F.lit(1.0), (F.lit(0.5) + F.col("_quality")) * duration_factor(F.col("seg_end") - F.col("seg_start")))
    engagement = F.least(F.lit(1.0), F.lit(0.5) + F.col("_engagement"))
    return rows.select(*[c for c in segments.columns if c not in NOTES], F.round(quality, 4).alias("quality_score"), F.round(engagement, 4).alias("engagement_score"), "content_type")


def preliminary_quality(segments: DataFrame) -> DataFrame:
    """Quality from text, duration, method and coherence (text, method, priority)."""
    dur = F.col("seg_end") - F.col("seg_start")
    score = (
        segment_text_quality(F.col("text")) * 0.4
        + F.when((dur >= 20) & (dur <= 90), 0.2).when((dur >= 15) & (dur <= 120), 0.1).otherwise(0.0)
        + F.greatest(F.lit(0.0), (10 - F.col("priority")) / 10.0) * 0.2
        + F.when(F.col("method").startswith("content_aware"), 0.15).otherwise(0.0)
        + F.when(F.col("method") == "quality_driven", 0.05).otherwise(0.0)
    )
    return segments.withColumn("preliminary_quality", F.round(F.least(F.lit(1.0), score), 4))


def combined_score(profile: str = "live") -> Column:
    """Order key from prompt and object scores; `references` also counts actors and reference objects."""
    objects = F.col("object_relevance") * 0.3 + F.col("object_confidence") * 0.2 + F.col("object_prompt_match") * 0.4
    if profile == "live":
        bonus = F.least(F.lit(0.2), F.col("objects_detected") * 0.05 + F.col("object_classes") * 0.1)
        score = F.col("prompt_match_score") * 0.4 + objects * 0.6 + bonus
    else:
        bonus = F.least(F.lit(0.1), F.col("objects_detected") * 0.03 + F.col("object_classes") * 0.05)
        reference = F.when(F.col("reference_score") > 0, 0.8).otherwise(0.0)
        score = F.col("prompt_match_score") * 0.25 + objects * 0.4 + F.col("presence") * 0.25 + reference + bonus
    return F.least(F.lit(1.0), score)


def greedy(df: DataFrame, order: Sequence[tuple[str, bool]], conflict: Callable[[dict, dict], bool], most: int | None = None, by: Sequence[str] = ("video_id",)) -> DataFrame:
    """Rows in `order` (column, ascending), each taken unless it conflicts with one taken before, `most` at most."""
    names, ascending = [c for c, _ in order], [a for _, a in order]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        kept: list[dict] = []
        where: list[int] = []
        rows = rows.sort_values(names, ascending=ascending, kind="stable")
        for i, row in enumerate(rows.to_dict("records")):
            if most is not None and len(kept) >= most:
                break
            if not any(conflict(row, other) for other in kept):
                kept.append(row)
                where.append(i)
        return rows.iloc[where]

    return df.groupBy(*by).applyInPandas(run, df.schema)


def overlaps(a: dict, b: dict) -> bool:
    return a["seg_start"] < b["seg_end"] and b["seg_start"] < a["seg_end"]


def greedy_top(segments: DataFrame, most: int = 3) -> DataFrame:
    """The best segments of each video that don't overlap. What is carried from row to row are the few that are taken."""
    columns = ["segment_id", "seg_start", "seg_end", "quality_score"]
    row = F.struct((-F.col("quality_score")).alias("q"), "seg_start", "seg_end", "segment_id", "quality_score")
    rows = segments.groupBy("video_id").agg(F.array_sort(F.collect_list(row)).alias("_rows"))
    kind = rows.schema["_rows"].dataType.simpleString()
    clash = lambda a, b: (a["seg_start"] < b["seg_end"]) & (b["seg_start"] < a["seg_end"])
    step = lambda kept, r: F.when((F.size(kept) < most) & ~F.exists(kept, lambda k: clash(r, k)), F.array_append(kept, r)).otherwise(kept)
    return rows.select("video_id", F.explode(F.aggregate("_rows", F.array().cast(kind), step)).alias("_r")).select("video_id", *[f"_r.{c}" for c in columns])


def deduplicated(segments: DataFrame, most: int | None = None, similarity: float = 0.9, overlap: float = 0.5, width: float = 60.0) -> DataFrame:
    """Segments by priority, preliminary quality and length, each left out if it is much like one kept before: it overlaps that by more than `overlap` of the shorter one and is alike in text and method above `similarity`.

    All that are unlike stay, or the first `most` of a video. A row is compared with those kept that touch one of its cells of `width`
    seconds, as no others overlap it, and with those kept that touch too many cells to be noted there.
    """
    stop = {"", *lx.STOP_WORDS}
    space = re.compile("[ \\t\\n\\x0b\\f\\r]+")
    sets: dict[str, set[str]] = {}
    cells: dict[int, list[list]] = {}
    wide: list[list] = []
    order = ["priority", "q", "d", "seg_start", "segment_id"]
    rows = segments.select("video_id", "segment_id", "seg_start", "seg_end", "method", F.lower(F.coalesce("text", F.lit(""))).alias("low"), "priority", (-F.col("preliminary_quality")).alias("q"), (F.col("seg_start") - F.col("seg_end")).alias("d"))

    def words_of(low: str) -> set[str]:
        # windows around a line often hold the same lines, so the last texts are kept
        if low not in sets:
            if len(sets) >= 4096:
                sets.clear()
            sets[low] = set(space.split(low)) - stop
        return sets[low]

    def alike(a: list, b: list) -> bool:
        shared = min(a[2], b[2]) - max(a[1], b[1])
        if not (shared > 0 and shared / min(a[2] - a[1], b[2] - b[1]) > overlap) or not (isinstance(a[3], str) and isinstance(b[3], str)):
            return False
        w, v, same = words_of(a[4]), words_of(b[4]), float(a[3] == b[3])
        both = len(w & v)
        union = len(w) + len(v) - both
        return (both / union * 0.5 + same * 0.2) / 0.7 > similarity if union else same > similarity

    def step(kept: list[list], row: list) -> None:
        if not kept:
            cells.clear()
            wide.clear()
        if most is not None and len(kept) >= most:
            return
        if row[1] < row[2]:  # a row without length, or a time that is null, overlaps nothing
            first, last = row[1] // width, row[2] // width
            touched = range(int(first), int(last) + 1) if last - first < 64 else None
            near = kept if touched is None else chain(wide, *(cells.get(c, ()) for c in touched))
            if any(k[1] < k[2] and alike(row, k) for k in near):
                return
            if touched is None:
                wide.append(row)
            else:
                for c in touched:
                    cells.setdefault(c, []).append(row)
        kept.append(row)

    kept = _fold(rows, ["video_id"], ["segment_id", "seg_start", "seg_end", "method", "low", "priority", "q", "d"], order, step, ["segment_id"])
    return segments.join(kept, ["video_id", "segment_id"], "left_semi")


def _fold(df: DataFrame, by: Sequence[str], columns: Sequence[str], order: Sequence[str], step: Callable[[list[list], list], None], out: Sequence[str] | None = None) -> DataFrame:
    """The rows (columns) of each `by` in order, of which `step(kept, row)` makes the list of those that stay: it adds rows at the end or changes the last one. Of these the columns `out` (all) come back.

    Rows are dealt by a hash of `by`, not by `by` itself: Spark would leave that out above a union of tables that are dealt by `by`, whose
    partitions it may then put together differently, so that a group is cut in two.
    """
    rows = df.select(*by, *columns)
    given = rows.select(*by, *(out or columns)).schema
    schema, n, at = to_arrow_schema(given), len(by), [list(columns).index(c) for c in out or columns]

    def batch_of(done: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], f.type, from_pandas=True) for i, f in enumerate(schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # sorted rows of one group after the other: a call for each group would cost more than its rows
        now, kept, done = None, [], []
        for batch in batches:
            for values in zip(*(c.to_pylist() for c in batch.columns)):
                if values[:n] != now:
                    done += [[*now, *(row[i] for i in at)] for row in kept]
                    now, kept = values[:n], []
                step(kept, [float("nan") if v is None else v for v in values[n:]])
            if len(done) > 10_000:
                yield batch_of(done)
                done = []
        yield batch_of(done + [[*now, *(row[i] for i in at)] for row in kept])

    return rows.repartition(F.xxhash64(*by)).sortWithinPartitions(*by, *[F.asc_nulls_last(c) for c in order]).mapInArrow(run, given)


def near_duplicates_merged(segments: DataFrame, within: float = 5.0) -> DataFrame:
    """By start, of segments whose ends both lie within `within` of the last kept, the better one stays."""

    def step(kept: list[list], row: list) -> None:
        if not kept or abs(row[1] - kept[-1][1]) > within or abs(row[2] - kept[-1][2]) > within:
            kept.append(row)
        elif row[3] > kept[-1][3]:
            kept[-1] = row

    return _fold(segments, ["video_id"], ["segment_id", "seg_start", "seg_end", "quality_score"], ["seg_start", "seg_end", "segment_id"], step)


def merged_breaks(breaks: DataFrame, gap: float = 2.0) -> DataFrame:
    """Breaks in order: one less than `gap` after the last kept replaces it if its confidence is higher, and else is dropped."""

    def step(kept: list[list], row: list) -> None:
        if not kept or row[0] - kept[-1][0] >= gap:
            kept.append(row)
        elif row[2] > kept[-1][2]:
            kept[-1] = row

    return _fold(breaks, ["video_id"], ["ts", "type", "confidence"], ["ts", "type", "confidence"], step)


def resolved_overlaps(segments: DataFrame) -> DataFrame:
    """By start, each segment that begins before the last one's end is split from it in the middle of what the two share.

    The last one is taken as earlier splits have left it, and what is shared ends with the segment that
    ends first, so a segment within another one takes the second half of its own length and the
    outer one ends there. No segment is dropped and none ends before it starts; the results don't
    overlap, but a segment of no length left (one within rows of equal start) has start = end.
    """

    def step(kept: list[list], row: list) -> None:
        if kept and row[1] < kept[-1][2]:
            start = max(kept[-1][1], row[1])
            middle = (start + max(start, min(kept[-1][2], row[2]))) / 2
            kept[-1][2], row[1], row[2] = middle, middle, max(middle, row[2])
        kept.append(row)

    return _fold(segments, ["video_id"], ["segment_id", "seg_start", "seg_end"], ["seg_start", "seg_end", "segment_id"], step)


def spaced(points: DataFrame, gap: float) -> DataFrame:
    """Points (video_id, ts) at least `gap` after the last accepted one."""

    def step(kept: list[list], row: list) -> None:
        if not kept or row[0] - kept[-1][0] >= gap:
            kept.append(row)

    return _fold(points, ["video_id"], ["ts"], ["ts"], step)


def actor_segments(appearances: DataFrame, length: float = 60.0) -> DataFrame:
    """For each actor, windows around appearances in time order, each left out if it overlaps the one taken before."""
    start = F.greatest(F.lit(0.0), F.col("t") - length / 2)
    rows = appearances.select("video_id", "actor", F.col("t").cast("double").alias("t"), start.alias("seg_start"), (start + length).alias("seg_end")).distinct()

    def step(kept: list[list], row: list) -> None:
        if not kept or row[1] >= kept[-1][2]:
            kept.append(row)

    return _fold(rows, ["video_id", "actor"], ["t", "seg_start", "seg_end"], ["t"], step)


def diverse(segments: DataFrame, most: int = 5, gap: float = 15.0) -> DataFrame:
    """The best of each category, then the best of the rest whose starts keep `gap` seconds apart."""
    stop = F.max("seg_end").over(Window.partitionBy("video_id"))
    text, place, dur = F.col("text"), F.col("seg_start") / stop, F.col("seg_end") - F.col("seg_start")
    has = lambda name: any_of(text, lx.DIVERSITY[name])
    lively, calm = has("high_energy"), ~has("high_energy") & has("calm")
    rules = {
        "instruction": has("instruction") | (~lively & ~calm & (dur >= 25)),
        "demonstration": has("demonstration") | (~lively & ~calm & (dur < 25)),
        "transition": has("transition"),
        "introduction": place < 0.1,
        "conclusion": place > 0.9,
        "high_energy": lively,
        "calm": calm,
        "interactive": has("interactive") | text.contains("?"),
    }
    labels = F.filter(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()]), lambda x: x.isNotNull())
    rows = segments.select("video_id", "segment_id", "seg_start", "seg_end", "quality_score", labels.alias("categories"))
    names = list(rules)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["quality_score", "seg_start", "seg_end", "segment_id"], ascending=[False, True, True, True]).reset_index(drop=True)
        if len(pdf) <= most:
            return pdf
        kept: list[int] = []
        for name in names:
            best = next((i for i in range(len(pdf)) if i not in kept and name in pdf["categories"][i]), None)
            if best is not None and len(kept) < most:
                kept.append(best)
        for i in range(len(pdf)):
            if len(kept) < most and i not in kept and all(abs(pdf["seg_start"][i] - pdf["seg_start"][j]) >= gap for j in kept):
                kept.append(i)
        return pdf.iloc[kept]

    return rows.groupBy("video_id").applyInPandas(run, rows.schema)


def platform_top(segments: DataFrame, most: int = 3) -> DataFrame:
    """The best segments (viral, optimization) of each video for each platform."""
    weights = F.array(*[F.struct(F.lit(p).alias("platform"), F.lit(v).alias("wv"), F.lit(e).alias("we")) for p, (v, e) in lx.PLATFORMS.items()])
    rows = segments.select("video_id", "segment_id", "viral", "optimization", F.explode(weights).alias("p")).select("video_id", "segment_id", "viral", "optimization", "p.*")
    rows = rows.withColumn("platform_score", F.round(F.col("viral") * F.col("wv") + F.col("optimization") * F.col("we"), 4))
    w = Window.partitionBy("video_id", "platform").orderBy(F.desc("platform_score"), "segment_id")
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most).select("video_id", "platform", "place", "segment_id", "platform_score")


def tiered(segments: DataFrame, score: str, threshold: float = 0.7, least: int = 3, relax: float = 0.8) -> DataFrame:
    """Rows at or above the threshold; where fewer than `least` are, those above `relax` times it; where none are, the best `least`."""
    w = Window.partitionBy("video_id")
    high = F.sum((F.col(score) >= threshold).cast("int")).over(w)
    low = F.sum((F.col(score) >= threshold * relax).cast("int")).over(w)
    place = F.row_number().over(w.orderBy(F.desc(score), "segment_id"))
    rows = segments.withColumn("_high", high).withColumn("_low", low).withColumn("_place", place)
    keep = F.when(F.col("_high") >= least, F.col(score) >= threshold).when(F.col("_low") > 0, F.col(score) >= threshold * relax).otherwise(F.col("_place") <= least)
    return rows.where(keep).drop("_high", "_low", "_place")


def clean_boundaries(segments: DataFrame, transcript: DataFrame, shortest: float = 15.0, longest: float = 60.0, within: float = 5.0) -> DataFrame:
    """Segments moved to the best line starts and ends within reach, then stretched or trimmed to the range.

    The better boundary wins, then the nearer one. A segment without a boundary in reach keeps its own.
    """
    marked = sentence_starts(transcript).withColumn("said", F.regexp_replace("text", "^\\s+|\\s+$", "")).where("said <> ''")
    marked = marked.select("video_id", "start", "end", F.round(start_quality(F.col("said"), F.col("sentence_start"), F.col("pause_before")), 4).alias("sq"), F.round(end_quality(F.col("said")), 4).alias("eq"))
    own = segments.select("video_id", "segment_id", "seg_start", "seg_end")

    def best(rows: DataFrame, order: list[Column], at: str, name: str) -> DataFrame:
        w = Window.partitionBy("video_id", "segment_id").orderBy(*order)
        return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").select("video_id", "segment_id", F.col(at).alias(name))

    # lines are met by time, in buckets, and not by video alone
    near = lambda at, point: interval_join(own.withColumn("_f", F.col(point) - within).withColumn("_t", F.col(point) + within), marked, ["video_id"], ("_f", "_t"), (at, at), closed=True)
    starts = best(near("start", "seg_start"), [F.desc("sq"), F.abs(F.col("start") - F.col("seg_start")), F.col("start")], "start", "new_start")
    ends = best(near("end", "seg_end"), [F.desc("eq"), F.abs(F.col("end") - F.col("seg_end")), F.col("end")], "end", "new_end")
    rows = own.join(starts, ["video_id", "segment_id"], "left").join(ends, ["video_id", "segment_id"], "left")
    rows = rows.select("video_id", "segment_id", F.coalesce("new_start", "seg_start").alias("s"), F.coalesce("new_end", "seg_end").alias("e"))
    reach = rows.withColumn("_f", F.col("s") + min(shortest, longest * 0.8) - 1).withColumn("_t", F.col("s") + longest + 1)
    met = interval_join(reach, marked.select("video_id", "end", "eq"), ["video_id"], ("_f", "_t"), ("end", "end"), closed=True).withColumn("d", F.col("end") - F.col("s"))
    longer = best(met.where((F.col("d") >= shortest) & (F.col("d") <= longest)), [F.desc("eq"), F.col("d")], "end", "stretched")
    shorter = best(met.where((F.col("d") <= longest) & (F.col("d") >= longest * 0.8)), [F.desc("eq"), F.desc("d")], "end", "trimmed")
    rows = rows.join(longer, ["video_id", "segment_id"], "left").join(shorter, ["video_id", "segment_id"], "left")
    length = F.col("e") - F.col("s")
    end = F.when(length < shortest, F.coalesce("stretched", F.col("s") + shortest)).when(length > longest, F.coalesce("trimmed", F.col("s") + longest)).otherwise(F.col("e"))
    return rows.select("video_id", "segment_id", F.col("s").alias("seg_start"), end.alias("seg_end"))


def flow_labels(segments: DataFrame) -> DataFrame:
    texts = same_texts(segments, "video_id").withColumn("flow", flow_quality(F.col("text")))
    return segments_of(texts, "flow").select(*segments.columns, "flow")


def theme_matches(segments: DataFrame, least: float = 0.05) -> DataFrame:
    """Themes of each segment's text above `least`."""
    from clipwright.functions.text import theme_score

    scores = F.array(*[F.struct(F.lit(t).alias("theme"), F.round(theme_score(F.col("text"), t), 4).alias("score")) for t in lx.THEMES])
    rows = segments.select("video_id", "segment_id", F.explode(scores).alias("s")).select("video_id", "segment_id", "s.*")
    return rows.where(F.col("score") >= least)


def is_credits(segments: DataFrame) -> Column:
    """Credits by position or words, of rows with seg_start, seg_end, duration and text."""
    return ((F.col("seg_start") + F.col("seg_end")) / 2 / F.col("duration") > 0.92) | (hits(F.col("text"), lx.CREDITS) >= 2)
