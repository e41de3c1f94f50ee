"""Zoom and crop decisions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def clamp(x: Column, low, high) -> Column:
    low, high = (v if isinstance(v, Column) else F.lit(v) for v in (low, high))
    return F.greatest(low, F.least(high, x))


def composite_boxes(detections: DataFrame, cell: str) -> DataFrame:
    """The box around all boxes of a cell."""
    return detections.groupBy("video_id", cell).agg(F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"), F.count("*").alias("subjects"))


def zoom_plan(boxes: DataFrame, width: int = 1920, height: int = 1080, ratio: tuple[int, int] = (9, 16), smallest: float = 0.3, largest: float = 0.8) -> DataFrame:
    """Zoom, position and crop of each box (x1, y1, x2, y2): the subject takes between `smallest` and `largest` of the height,
    its centre is kept within the frame and drawn to the nearer third if that is close."""
    share = (F.col("y2") - F.col("y1")) / float(height)
    zoom = clamp(F.when(share < smallest, smallest / share).when(share > largest, largest / share).otherwise(1.0), 1.0, 3.0)
    rows = boxes.withColumn("zoom", zoom)
    half = 0.5 / F.col("zoom")
    cx = clamp((F.col("x1") + F.col("x2")) / 2 / width, half, 1 - half)
    cy = clamp((F.col("y1") + F.col("y2")) / 2 / height, half, 1 - half)
    rows = rows.withColumn("px", cx).withColumn("py", cy)
    third = F.when(F.abs(F.col("px") - 1 / 3) <= F.abs(F.col("px") - 2 / 3), 1 / 3).otherwise(2 / 3)
    rows = rows.withColumn("px", F.when(F.abs(third - F.col("px")) < 0.1, F.col("px") * 0.7 + third * 0.3).otherwise(F.col("px")))
    aspect = ratio[0] / ratio[1]
    if width / height > aspect:
        h = F.lit(float(height)) / F.col("zoom")
        w = h * aspect
    else:
        w = F.lit(float(width)) / F.col("zoom")
        h = w / aspect
    w, h = F.least(w, F.lit(float(width))), F.least(h, F.lit(float(height)))
    whole = lambda x: F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("long")
    rows = rows.withColumn("crop_w", whole(w + 1e-9)).withColumn("crop_h", whole(h + 1e-9))
    x = clamp(whole(F.col("px") * width - w / 2 + 1e-9), F.lit(0), width - F.col("crop_w"))
    y = clamp(whole(F.col("py") * height - h / 2 + 1e-9), F.lit(0), height - F.col("crop_h"))
    return rows.withColumn("crop_x", x.cast("long")).withColumn("crop_y", y.cast("long"))


def smoothed_zoom(decisions: DataFrame, most_per_second: float = 0.1) -> DataFrame:
    """Decisions (video_id, ts, zoom): the mean of three, then no faster than `most_per_second` from the one put out before."""
    w = Window.partitionBy("video_id").orderBy("ts")
    rows = decisions.select("video_id", "ts", F.avg("zoom").over(w.rowsBetween(-1, 1)).alias("zoom"))
    rows = rows.groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("ts", "zoom"))).alias("r"))

    def step(kept: Column, row: Column) -> Column:
        last = F.element_at(kept, -1)
        reach = (row["ts"] - last["ts"]) * most_per_second
        zoom = clamp(row["zoom"], last["zoom"] - reach, last["zoom"] + reach)
        return F.when(F.size(kept) == 0, F.array(row)).otherwise(F.array_append(kept, row.withField("zoom", zoom)))

    kind = rows.schema["r"].dataType.simpleString()
    return rows.select("video_id", F.explode(F.aggregate("r", F.array().cast(kind), step)).alias("d")).select("video_id", "d.*")


def gaussian_smoothed(regions: DataFrame, columns: list[str], sigma: float) -> DataFrame:
    """`columns` of regions (video_id, ts) under a Gaussian kernel of radius int(4 sigma + 0.5), reflected at the ends; fewer than three rows stay."""
    radius = int(4 * sigma + 0.5)
    kernel = [math.exp(-0.5 * (i / sigma) ** 2) for i in range(-radius, radius + 1)]
    kernel = [k / sum(kernel) for k in kernel]
    rows = regions.groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("ts", *columns))).alias("r"))
    n = F.size("r")

    def at(i: Column) -> Column:
        j = F.pmod(i, 2 * n)
        return F.when(j < n, j).otherwise(2 * n - 1 - j)

    def one(row: Column, i: Column) -> Column:
        values = []
        for c in columns:
            total = sum((F.get("r", at(i + k - radius))[c] * w for k, w in enumerate(kernel)), F.lit(0.0))
            values.append(F.when(n < 3, row[c].cast("double")).otherwise(total).alias(c))
        return F.struct(row["ts"].alias("ts"), *values)

    return rows.select("video_id", F.explode(F.transform("r", one)).alias("d")).select("video_id", "d.*")


def zoom_quality(decisions: DataFrame) -> DataFrame:
    """Per video, how steady its zoom (ts, zoom) is: 1 less the fastest change over half a unit a second."""
    w = Window.partitionBy("video_id").orderBy("ts")
    dt = F.col("ts") - F.lag("ts").over(w)
    rate = F.when(dt > 0, F.abs(F.col("zoom") - F.lag("zoom").over(w)) / dt).otherwise(0.0)
    found = decisions.withColumn("rate", rate).groupBy("video_id").agg(F.max("rate").alias("fastest"))
    stability = 1.0 - F.least(F.coalesce("fastest", F.lit(0.0)) / 0.5, F.lit(1.0))
    return found.select("video_id", stability.alias("stability"), (stability < 0.8).alias("too_fast"))


def rescaled(regions: DataFrame, factor: Column, width: int = 1920, height: int = 1080) -> DataFrame:
    """Crops (x1, y1, x2, y2) around (cx, cy) made `factor` times as large, within the frame."""
    w, h = F.floor((F.col("x2") - F.col("x1")) * factor + 1e-9), F.floor((F.col("y2") - F.col("y1")) * factor + 1e-9)
    x1 = F.greatest(F.lit(0), F.col("cx") - F.floor(w / 2))
    y1 = F.greatest(F.lit(0), F.col("cy") - F.floor(h / 2))
    return regions.withColumns({"x1": x1, "y1": y1, "x2": F.least(F.lit(width), x1 + w), "y2": F.least(F.lit(height), y1 + h)})


def adaptive_factor(relevance: Column, objects: Column) -> Column:
    return clamp(0.9 + relevance * 0.3 - objects * 0.1, 0.7, 1.3)


def aggregated_vision(frames: DataFrame) -> DataFrame:
    """Visual score of segments from their frames (visual_interest 0 to 10, scene_type, people_count, has_action, has_emotion); the commonest scene type, by name of equal ones."""
    kinds = frames.groupBy("video_id", "segment_id", "scene_type").agg(F.count("*").alias("n"))
    mode = kinds.groupBy("video_id", "segment_id").agg(F.min_by("scene_type", F.struct((-F.col("n")).alias("n"), "scene_type")).alias("scene_type"))
    found = frames.groupBy("video_id", "segment_id").agg(
        F.avg("visual_interest").alias("interest"), F.max("visual_interest").alias("most"), F.var_pop("visual_interest").alias("variance"),
        F.max("people_count").alias("people"), F.bool_or("has_action").alias("action"), F.bool_or("has_emotion").alias("emotion"),
    ).join(mode, ["video_id", "segment_id"])
    bonus = lambda cond, x: F.when(cond, x).otherwise(0.0)
    scene = F.when(F.col("scene_type").isin("demonstration", "action"), 0.1).when(F.col("scene_type").isin("presentation", "interview", "talking_head"), 0.05).otherwise(0.0)
    score = (
        F.col("interest") / 10.0 + bonus(F.col("most") > F.col("interest") + 1, 0.05) + bonus(F.col("people") > 0, 0.08) + bonus(F.col("people") > 1, 0.04)
        + scene + bonus(F.col("action"), 0.05) + bonus(F.col("emotion"), 0.03) + bonus(F.col("variance") > 2.0, 0.05)
    )
    return found.withColumn("visual_score", F.least(F.lit(1.0), score))
