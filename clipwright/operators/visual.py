"""What frames show: scene changes from feature vectors, and visual segments of several kinds merged."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def correlation(a: Column, b: Column) -> Column:
    """Pearson's correlation of two vectors; 1 where either of them is constant."""
    n = F.size(a).cast("double")
    sa, sb = total(a), total(b)
    ab, aa, bb = (total(F.zip_with(x, y, lambda p, q: p * q)) for x, y in ((a, b), (a, a), (b, b)))
    spread = (aa - sa * sa / n) * (bb - sb * sb / n)
    return F.when(F.abs(spread) > 2.220446049250313e-16, (ab - sa * sb / n) / F.sqrt(spread)).otherwise(1.0)


def with_previous(df: DataFrame, by: Sequence[str], order: str, columns: Sequence[str], width: int) -> DataFrame:
    """Adds `before`: a struct of the `columns` of the row before in `order` (a number), null for the first of `by`.

    Rows are dealt to buckets of `width` along `order`, and each bucket gets the last row of the one before it, so that a group with
    any share of all rows is the work of many tasks.
    """
    row = F.struct(*columns)
    dealt = df.withColumn("_bucket", F.floor(F.col(order) / width))
    lasts = dealt.groupBy(*by, "_bucket").agg(F.max_by(row, order).alias("_last"))
    carried = lasts.select(*by, "_bucket", F.lag("_last").over(Window.partitionBy(*by).orderBy("_bucket")).alias("_carried"))
    inside = dealt.withColumn("_inside", F.lag(row).over(Window.partitionBy(*by, "_bucket").orderBy(order)))
    joined = inside.join(carried, [*by, "_bucket"])
    return joined.withColumn("before", F.coalesce("_inside", "_carried")).drop("_bucket", "_inside", "_carried")


def running_most(df: DataFrame, by: Sequence[str], order: str, value: str, width: int) -> DataFrame:
    """Adds `so_far`: the largest `value` of the rows up to this one in `order`, in buckets as `with_previous` does it."""
    dealt = df.withColumn("_bucket", F.floor(F.col(order) / width))
    tops = dealt.groupBy(*by, "_bucket").agg(F.max(value).alias("_top"))
    earlier = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = tops.select(*by, "_bucket", F.max("_top").over(earlier).alias("_carried"))
    inside = F.max(value).over(Window.partitionBy(*by, "_bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return dealt.withColumn("_inside", inside).join(carried, [*by, "_bucket"]).withColumn("so_far", F.greatest("_inside", "_carried")).drop("_bucket", "_inside", "_carried")


def spaced_rows(rows: DataFrame, by: str, order: str, gap: float, width: int) -> DataFrame:
    """The rows that come `gap` or more after the last accepted one of their group; the first is accepted.

    A row that comes `gap` or more after the row before it is accepted whatever came earlier. It begins an island, and islands are
    gone through independently, row by row, with one number to remember.
    """
    marked = with_previous(rows, [by], order, [order], width)
    fresh = F.col("before").isNull() | (F.col(order) - F.col(f"before.{order}") >= gap)
    islands = running_most(marked.withColumn("_fresh", F.when(fresh, F.col(order))).drop("before"), [by], order, "_fresh", width)
    islands = islands.select(*rows.columns, F.col("so_far").alias("_island"))
    schema = to_arrow_schema(rows.schema)

    def accepted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last = None, 0.0
        for batch in batches:
            keep = []
            groups, points, island = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in (by, order, "_island"))
            for i, key in enumerate(zip(groups, island, strict=True)):
                if key != now or points[i] - last >= gap:
                    now, last = key, points[i]
                    keep.append(i)
            yield batch.take(pa.array(keep, pa.int64())).select(schema.names)

    return islands.repartition(by, "_island").sortWithinPartitions(by, "_island", order).mapInArrow(accepted, rows.schema)


def scene_changes(frames: DataFrame, fps: float = 25.0, threshold: float = 0.3, spacing: float = 5.0, every: int = 10) -> DataFrame:
    """(video_id, frame_no, ts, confidence): breaks where a sampled frame is unlike the one sampled before it, `spacing` seconds apart at least.

    Of `frames` (video_id, frame_no, vector) every tenth is sampled. Unlike means a correlation under 1 - `threshold`; the confidence is 1 less
    the correlation. Frames without a vector aren't sampled; frame numbers are unique in a video.
    """
    minutes = round(600 * fps)
    sampled = frames.where((F.col("frame_no") % every == 0) & F.col("vector").isNotNull()).select("video_id", "frame_no", F.col("vector").cast("array<double>").alias("vector"))
    met = with_previous(sampled, ["video_id"], "frame_no", ["vector"], minutes).where("before is not null")
    scored = met.select("video_id", "frame_no", (F.col("frame_no") / fps).alias("ts"), correlation(F.col("before.vector"), F.col("vector")).alias("alike"))
    breaks = scored.where(F.col("alike") < 1 - threshold).select("video_id", "frame_no", "ts", (1 - F.col("alike")).alias("confidence"))
    return spaced_rows(breaks, "video_id", "ts", spacing, 600)


#: What is taken for granted of each kind of visual segment.
KINDS = {
    "motion": {"activity": 0.8, "scene_type": "action", "motion_level": "high", "has_people": True, "color_diversity": 0.6, "complexity": 0.5, "silence": 0.0},
    "complexity": {"activity": 0.7, "scene_type": "detailed", "motion_level": "medium", "has_people": False, "color_diversity": 0.8, "complexity": 0.9, "silence": 0.3},
    "silence": {"activity": 0.6, "scene_type": "silent_visual", "motion_level": "unknown", "has_people": False, "color_diversity": 0.5, "complexity": 0.6, "silence": 1.0},
}


def visual_segments(motion: DataFrame, complexity: DataFrame, silences: DataFrame, tolerance: float = 5.0, shortest_silence: float = 30.0) -> DataFrame:
    """Runs (video_id, run_start, run_end) of three kinds, silences of `shortest_silence` or more, merged where one starts within `tolerance` of the end of those before it.

    A merged segment has the largest of most columns, the scene types one after the other, the last known motion level, and the silence share
    halved with each that joins. Runs are taken by start, of equal starts motion first, then complexity, then the shorter. Islands
    come from the largest end so far, so runs within runs and chains of runs stay together.
    """
    every = [df.select("video_id", "run_start", "run_end", F.lit(i).alias("kind")) for i, df in enumerate((motion, complexity, silences.where(F.col("run_end") - F.col("run_start") >= shortest_silence)))]
    rows = every[0].unionByName(every[1]).unionByName(every[2])
    order = Window.partitionBy("video_id").orderBy("run_start", "kind", "run_end")
    before = F.max("run_end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(F.col("run_start") <= before + tolerance, 0).otherwise(1)
    islands = rows.withColumn("fresh", fresh).withColumn("island", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    of = lambda name: F.element_at(F.array(*[F.lit(k[name]) for k in KINDS.values()]), F.col("kind") + 1)
    step = F.struct("run_start", "kind", "run_end", of("silence").alias("silence"), of("motion_level").alias("level"), of("scene_type").alias("scene"))
    merged = islands.groupBy("video_id", "island").agg(
        F.min("run_start").alias("seg_start"), F.max("run_end").alias("seg_end"), F.max(of("activity")).alias("activity"), F.bool_or(of("has_people")).alias("has_people"),
        F.max(of("color_diversity")).alias("color_diversity"), F.max(of("complexity")).alias("complexity"), F.array_sort(F.collect_list(step)).alias("steps"),
    )
    known = F.filter("steps", lambda s: s["level"] != "unknown")
    silence = F.aggregate(F.slice("steps", 2, F.greatest(F.size("steps") - 1, F.lit(0))), F.col("steps")[0]["silence"], lambda now, s: (now + s["silence"]) / 2)
    return merged.select(
        "video_id", "seg_start", "seg_end", "activity", F.array_join(F.transform("steps", lambda s: s["scene"]), "+").alias("scene_type"),
        F.when(F.size(known) > 0, F.element_at(known, -1)["level"]).otherwise("unknown").alias("motion_level"), "has_people", "color_diversity", "complexity", silence.alias("silence"),
    )
