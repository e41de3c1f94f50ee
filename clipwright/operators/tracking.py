"""Objects in frames: boxes, tracks, crops and layouts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def iou(a: tuple[str, str, str, str], b: tuple[str, str, str, str]) -> Column:
    """Intersection over union of two boxes of columns x1, y1, x2, y2."""
    (ax1, ay1, ax2, ay2), (bx1, by1, bx2, by2) = [tuple(F.col(c) for c in box) for box in (a, b)]
    w = F.greatest(F.least(ax2, bx2) - F.greatest(ax1, bx1), F.lit(0))
    h = F.greatest(F.least(ay2, by2) - F.greatest(ay1, by1), F.lit(0))
    union = (ax2 - ax1) * (ay2 - ay1) + (bx2 - bx1) * (by2 - by1) - w * h
    return F.when(union > 0, w * h / union).otherwise(0.0)


def overlapping_boxes(detections: DataFrame, cell: str, least: float = 0.0) -> DataFrame:
    """Pairs of a video's boxes of one `cell` (a frame, an hour) with an IoU above `least`."""
    names = {c: f"{c}_2" for c in ("det_id", "x1", "y1", "x2", "y2")}
    own = detections.select("video_id", cell, *names)
    met = own.join(own.withColumnsRenamed(names), ["video_id", cell]).where("det_id < det_id_2")
    met = met.withColumn("iou", iou(("x1", "y1", "x2", "y2"), ("x1_2", "y1_2", "x2_2", "y2_2")))
    return met.where(F.col("iou") > least).select("video_id", cell, "det_id", F.col("det_id_2").alias("other_id"), "iou")


def without_duplicates(detections: DataFrame, cell: str, most: float = 0.5) -> DataFrame:
    """In each frame, boxes by falling confidence, without those whose IoU with one kept is above `most`.

    Frames are sorted and gone through as a stream: what is held are the kept boxes of one frame. A box without all its sides meets no other.
    """
    columns = ["video_id", cell, "det_id", "confidence", "x1", "y1", "x2", "y2"]
    rows = detections.select(*columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, kept, many, n = None, [], np.empty((256, 4)), 0
        for batch in batches:
            video, frame, *box = (batch.column(i).to_pylist() for i in (0, 1, 4, 5, 6, 7))
            keep = []
            for i, (key, b) in enumerate(zip(zip(video, frame), zip(*box))):
                if key != now:
                    now, kept, n = key, [], 0
                if None not in b:
                    # a few are looked at one by one, more at once
                    if any(_iou(b, k) > most for k in kept) or (n and (_ious(b, many[:n]) > most).any()):
                        continue
                    if len(kept) < 32:
                        kept.append(b)
                    else:
                        if n == len(many):
                            many = np.concatenate([many, np.empty_like(many)])
                        many[n] = b
                        n += 1
                keep.append(i)
            yield batch.take(pa.array(keep, pa.int64()))

    order = ["video_id", cell, F.desc("confidence"), "det_id"]
    return rows.repartition("video_id", cell).sortWithinPartitions(*order).mapInArrow(run, rows.schema)


def _iou(a: tuple, b: tuple) -> float:
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    return w * h / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h) if w > 0 and h > 0 else 0.0


def _ious(a: tuple, boxes: np.ndarray) -> np.ndarray:
    x1, y1, x2, y2 = boxes.T
    shared = np.maximum(np.minimum(a[2], x2) - np.maximum(a[0], x1), 0) * np.maximum(np.minimum(a[3], y2) - np.maximum(a[1], y1), 0)
    union = (a[2] - a[0]) * (a[3] - a[1]) + (x2 - x1) * (y2 - y1) - shared
    return np.divide(shared, union, out=np.zeros_like(shared), where=shared > 0)


def track_summary(detections: DataFrame) -> DataFrame:
    """Tracks by class and cell of a hundred pixels, of two detections or more."""
    key = F.concat_ws("_", "class_name", F.floor(F.col("cx") / 100), F.floor(F.col("cy") / 100))
    found = detections.withColumn("track", key).groupBy("video_id", "track").agg(
        F.count("*").alias("detections"), F.avg("confidence").alias("mean_confidence"), F.max("confidence").alias("best_confidence"), F.avg("relevance").alias("relevance"), (F.max("ts") - F.min("ts")).alias("span")
    )
    steady = F.least(F.lit(1.0), F.col("detections") / F.greatest(F.lit(1), F.col("span")))
    return found.where("detections >= 2").withColumn("consistency", steady)


def class_summary(detections: DataFrame) -> DataFrame:
    return detections.groupBy("video_id", "class_name").agg(F.count("*").alias("detections"), F.count_if(F.col("relevance") > 0.5).alias("relevant"), F.avg("confidence").alias("mean_confidence"))


def weighted_crops(detections: DataFrame, cell: str, width: int = 1920, height: int = 1080, ratio: tuple[int, int] = (9, 16)) -> DataFrame:
    """A crop of `ratio` around the centre of each cell's boxes, weighted by relevance, confidence and area, kept within the frame."""
    if width / height > ratio[0] / ratio[1]:
        h, w = height, int(height * ratio[0] / ratio[1])
    else:
        w, h = width, int(width * ratio[1] / ratio[0])
    weight = F.col("relevance") * F.col("confidence") * (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    found = detections.withColumn("w", weight).groupBy("video_id", cell).agg(
        F.sum(F.col("w") * F.col("cx")).alias("wx"), F.sum(F.col("w") * F.col("cy")).alias("wy"), F.sum("w").alias("w"),
        F.sum("cx").alias("sx"), F.sum("cy").alias("sy"), F.count("*").alias("n"), F.avg("confidence").alias("confidence"),
    )
    centre = lambda weighted, plain: F.when(F.col("w") > 0, F.floor(F.col(weighted) / F.col("w") + 1e-9)).otherwise(F.floor(F.col(plain) / F.col("n"))).cast("long")
    found = found.withColumn("cx", centre("wx", "sx")).withColumn("cy", centre("wy", "sy"))
    x1 = F.greatest(F.lit(0), F.col("cx") - w // 2)
    y1 = F.greatest(F.lit(0), F.col("cy") - h // 2)
    return found.select("video_id", cell, "cx", "cy", x1.alias("x1"), y1.alias("y1"), F.least(F.lit(width), x1 + w).alias("x2"), F.least(F.lit(height), y1 + h).alias("y2"), F.col("n").alias("objects"), "confidence")


def pan_speed(regions: DataFrame) -> DataFrame:
    """Distance of each region's centre (ts, cx, cy) to the one before over the time between; 0 for the first."""
    w = Window.partitionBy("video_id").orderBy("ts")
    dx, dy, dt = (F.col(c) - F.lag(c).over(w) for c in ("cx", "cy", "ts"))
    return regions.select("video_id", "ts", F.coalesce(F.when(dt > 0, F.sqrt(dx * dx + dy * dy) / dt), F.lit(0.0)).alias("pan_speed"))


def gaps_filled(regions: DataFrame, least: float = 2.0) -> DataFrame:
    """A row half-way between two (ts, x1, y1, x2, y2) that are more than `least` apart."""
    w = Window.partitionBy("video_id").orderBy("ts")
    box = ["x1", "y1", "x2", "y2"]
    rows = regions.select("video_id", "ts", *box, *[F.lag(c).over(w).alias(f"p_{c}") for c in ("ts", *box)])
    toward_zero = lambda x: F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("long")
    middle = F.struct(((F.col("ts") + F.col("p_ts")) / 2).alias("ts"), *[toward_zero((F.col(c) + F.col(f"p_{c}")) / 2).alias(c) for c in box], F.lit(True).alias("filled"))
    own = F.struct(F.col("ts").cast("double").alias("ts"), *[F.col(c).cast("long").alias(c) for c in box], F.lit(False).alias("filled"))
    return rows.select("video_id", F.explode(F.when(F.col("ts") - F.col("p_ts") > least, F.array(middle, own)).otherwise(F.array(own))).alias("r")).select("video_id", "r.*")


def predicted_centres(detections: DataFrame, track: str, ahead: int = 5) -> DataFrame:
    """Each track's last centre moved on by the mean of its last four steps, `ahead` times."""
    w = Window.partitionBy("video_id", track).orderBy("ts", "det_id")
    rows = detections.select("video_id", track, "ts", "det_id", "cx", "cy", (F.col("cx") - F.lag("cx").over(w)).alias("dx"), (F.col("cy") - F.lag("cy").over(w)).alias("dy"))
    recent = w.rowsBetween(-3, 0)
    rows = rows.withColumn("vx", F.avg("dx").over(recent)).withColumn("vy", F.avg("dy").over(recent)).where("vx is not null")
    last = rows.groupBy("video_id", track).agg(F.max(F.struct("ts", "det_id", "cx", "cy", "vx", "vy")).alias("l"))
    toward_zero = lambda x: F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("long")
    return last.select("video_id", track, toward_zero(F.col("l.cx") + F.col("l.vx") * ahead).alias("px"), toward_zero(F.col("l.cy") + F.col("l.vy") * ahead).alias("py"))


def tracked(detections: DataFrame, reach: float = 100.0, lost_after: int = 10) -> DataFrame:
    """Detections (frame_no, det_id, class_name, cx, cy) with a track id: the nearest live track of the class closer than `reach`, else a new one.

    Tracks unseen for more than `lost_after` frames end.
    """
    rows = detections.select("video_id", "frame_no", "det_id", "class_name", "cx", "cy")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        live: dict[str, list] = {}
        made = 0
        out = []
        for r in pdf.sort_values(["frame_no", "det_id"]).itertuples():
            live = {k: t for k, t in live.items() if r.frame_no - t[0] <= lost_after}
            near = [(((r.cx - t[1]) ** 2 + (r.cy - t[2]) ** 2) ** 0.5, k) for k, t in live.items() if t[3] == r.class_name]
            near = [n for n in near if n[0] < reach]
            if near:
                track = min(near, key=lambda n: n[0])[1]
            else:
                made += 1
                track = f"{r.class_name}_{made}"
            live[track] = [r.frame_no, r.cx, r.cy, r.class_name]
            out.append((r.video_id, r.frame_no, r.det_id, track))
        return pd.DataFrame(out, columns=["video_id", "frame_no", "det_id", "track"])

    kind = rows.schema["video_id"].dataType.simpleString()
    return rows.groupBy("video_id").applyInPandas(run, f"video_id {kind}, frame_no int, det_id long, track string")


def stable_layout(frames: DataFrame, steady: int = 5) -> DataFrame:
    """The layout of each frame (video_id, frame_no, speakers): its own if the last `steady` agree, else the one that the `steady` before them agreed on, else its own."""
    w = Window.partitionBy("video_id").orderBy("frame_no")
    rows = frames.select("video_id", "frame_no", F.when(F.col("speakers") >= 2, "split_screen").otherwise("single_speaker").alias("own"))
    now, old = w.rowsBetween(-steady + 1, 0), w.rowsBetween(-2 * steady + 1, -steady)
    agreed = (F.count("own").over(now) == steady) & (F.min("own").over(now) == F.max("own").over(now))
    # before there are two full stretches, the earlier one is shorter
    before = (F.count("own").over(old) > 0) & (F.min("own").over(old) == F.max("own").over(old))
    return rows.select("video_id", "frame_no", F.when(agreed, F.col("own")).when(before, F.min("own").over(old)).otherwise(F.col("own")).alias("layout"))


def frame_quality(features: DataFrame) -> DataFrame:
    """Quality of frames from brightness, contrast, sharpness and content share."""
    light = 1.0 - F.abs(F.col("brightness") / 255.0 - 0.5) * 2
    score = light * 0.25 + F.least(F.lit(1.0), F.col("contrast") / 100.0) * 0.25 + F.least(F.lit(1.0), F.col("sharpness") / 1000.0) * 0.3 + F.col("content_ratio") * 0.2
    return features.withColumn("quality", F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))
