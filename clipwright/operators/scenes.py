"""What detections and features say about frames: composition, faces, presence, speech, crops."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: How much each kind of object matters, and how sure a detector has to be of each type.
PRIORITIES = {
    "person": 1.0, "face": 1.0, "car": 0.6, "bicycle": 0.5, "motorcycle": 0.5, "airplane": 0.7, "bus": 0.6, "train": 0.6, "truck": 0.6, "boat": 0.5, "dog": 0.7, "cat": 0.7,
    "bird": 0.6, "horse": 0.7, "elephant": 0.8, "giraffe": 0.8, "sports ball": 0.4, "book": 0.3, "laptop": 0.5, "cell phone": 0.4, "tv": 0.5,
}
THRESHOLDS = {"face": 0.55, "person": 0.6, "object": 0.5}
WEIGHTS = {"face": 1.0, "person": 0.8, "object": 0.3, "unknown": 0.1}
ORIENTATIONS = {"frontal": 1.0, "profile": 0.7, "back": 0.2, "unknown": 0.3}


def looked_up(values: Mapping[str, float], key: Column, default: float) -> Column:
    known = F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
    return F.coalesce(F.try_element_at(known, F.lower(key)), F.lit(default))


def object_priority(class_name: Column) -> Column:
    return looked_up(PRIORITIES, class_name, 0.3)


def prioritised(subjects: DataFrame, by: list[str]) -> DataFrame:
    """Subjects (type, class_name, confidence, det_id) of which the detector is sure enough for their type, with their place by priority and confidence within `by`."""
    rows = subjects.where(F.col("confidence") >= looked_up(THRESHOLDS, F.col("type"), 0.5)).withColumn("priority", object_priority(F.col("class_name")))
    w = Window.partitionBy(*by).orderBy(F.desc("priority"), F.desc("confidence"), "det_id")
    return rows.withColumn("place", F.row_number().over(w))


def weighted_confidence(subjects: DataFrame, by: list[str]) -> DataFrame:
    """Mean confidence by type's weight, at most 1. Sums are of decimals of nine and two places, so they don't hang on the order of rows."""
    weight = looked_up(WEIGHTS, F.col("type"), 0.1).cast("decimal(6,2)")
    exact = lambda c: F.sum(c).cast("double")
    return subjects.groupBy(*by).agg(F.least(F.lit(1.0), exact(F.col("confidence").cast("decimal(18,9)") * weight) / exact(weight)).alias("confidence"))


def decision_confidence(objects: DataFrame, by: list[str]) -> DataFrame:
    """Means of confidence and relevance, and their product."""
    found = objects.groupBy(*by).agg(F.avg("confidence").alias("confidence"), F.avg("relevance").alias("relevance"))
    return found.withColumn("focus", F.col("confidence") * F.col("relevance"))


def _size() -> tuple[Column, Column]:
    return F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")


def frame_composition(subjects: DataFrame, by: list[str], width: int = 1920, height: int = 1080) -> DataFrame:
    """Of the boxes (x1, y1, x2, y2, is_face) of each frame: how near they stand to the thirds and how large they are, what share the faces take, how much risks to be cut, and a score of the three."""
    w, h = _size()
    cx, cy, share = (F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2, w * h / float(width * height)
    near = lambda c, n: 1.0 - F.least(F.lit(1.0), F.least(F.abs(c - n / 3), F.abs(c - 2 * n / 3)) / (n / 6))
    size = F.when((share >= 0.1) & (share <= 0.6), 1.0).otherwise(F.greatest(F.lit(0.2), 1.0 - F.abs(share - 0.35) / 0.35))
    composed = (near(cx, width) + near(cy, height)) * 0.3 + size * 0.7
    edge = F.least(F.col("x1"), F.col("y1"), width - F.col("x2"), height - F.col("y2"))
    outside = F.when((cx < width * 0.1) | (cx > width * 0.9), 0.5).otherwise(0.0) + F.when((cy < height * 0.1) | (cy > height * 0.9), 0.5).otherwise(0.0)
    risk = F.greatest(F.when(edge < 10, 1.0).otherwise(F.greatest(F.lit(0.0), 1.0 - edge / 50)), F.when(share < 0.05, 1.0).otherwise(0.0), outside)
    faces = F.sum(F.when(F.col("is_face"), w * h).otherwise(0)) / float(width * height)
    found = subjects.groupBy(*by).agg(F.avg(composed).alias("composition"), F.least(F.lit(1.0), faces).alias("face_ratio"), F.avg(risk).alias("risk"))
    return found.withColumn("frame_score", F.least(F.lit(1.0), F.col("composition") * 0.3 + F.col("face_ratio") * 0.4 + (1.0 - F.col("risk")) * 0.3))


def quality_flags(frames: DataFrame, risk: float = 0.3) -> DataFrame:
    """What is wrong with frames (face_ratio, risk, composition, zoom, subjects)."""
    rules = {"low_face_visibility": F.col("face_ratio") < 0.1, "awkward_crop_risk": F.col("risk") > risk, "poor_composition": F.col("composition") < 0.5, "high_zoom_level": F.col("zoom") > 2.5, "no_primary_subjects": F.col("subjects") == 0}
    return frames.withColumn("flags", F.filter(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()]), lambda x: x.isNotNull()))


def enhanced_confidence(base: Column, face_focus: Column, orientation: Column, composition: Column) -> Column:
    return F.least(F.lit(1.0), base * 0.3 + face_focus * 0.3 + orientation * 0.2 + composition * 0.2)


def multi_subject_strategy(subjects: Column) -> Column:
    return F.when(subjects == 0, "none").when(subjects == 1, "single").otherwise("group")


def face_priority(faces: DataFrame, width: int = 1920, height: int = 1080, least: float = 0.15, most: float = 0.8) -> DataFrame:
    """How well faces (box, orientation, confidence) can be seen, and how much they matter."""
    w, h = _size()
    area = (w * h).cast("double")
    inside = F.greatest(F.lit(0), F.least(F.col("x2"), F.lit(width)) - F.greatest(F.col("x1"), F.lit(0))) * F.greatest(F.lit(0), F.least(F.col("y2"), F.lit(height)) - F.greatest(F.col("y1"), F.lit(0)))
    share = area / float(width * height)
    size = F.when((share >= least) & (share <= most), 1.0).when(share < least, share / least).otherwise(most / share)
    rows = faces.withColumn("visibility", F.when(area > 0, inside / area).otherwise(0.0) * size)
    return rows.withColumn("face_priority", F.least(F.lit(1.0), looked_up(ORIENTATIONS, F.col("orientation"), 0.3) * F.col("confidence") * 0.6 + F.col("visibility") * 0.4))


def centres(boxes: DataFrame) -> DataFrame:
    """Whole-number centre and area."""
    w, h = _size()
    return boxes.withColumns({"centre_x": F.floor((F.col("x1") + F.col("x2")) / 2), "centre_y": F.floor((F.col("y1") + F.col("y2")) / 2), "area": w * h})


def padded_crops(boxes: DataFrame, padding: int = 50, width: int = 1920, height: int = 1080) -> DataFrame:
    """A box with `padding` around it, for a place in a layout of two, and the upright crop around its centre for one that stands alone."""
    w = int(height * 9 / 16)
    rows = centres(boxes)
    x1, y1 = F.greatest(F.lit(0), F.col("centre_x") - w // 2), F.greatest(F.lit(0), F.col("centre_y") - height // 2)
    return rows.withColumns({
        "pad_x1": F.greatest(F.lit(0), F.col("x1") - padding), "pad_y1": F.greatest(F.lit(0), F.col("y1") - padding), "pad_x2": F.least(F.lit(width), F.col("x2") + padding), "pad_y2": F.least(F.lit(height), F.col("y2") + padding),
        "crop_x1": x1, "crop_y1": y1, "crop_x2": F.least(F.lit(width), x1 + w), "crop_y2": F.least(F.lit(height), y1 + height),
    })


def active_speakers(faces: DataFrame, by: list[str], width: int = 1920, height: int = 1080) -> DataFrame:
    """Of each frame's faces while someone speaks (speaking), the one nearest to a little above the middle, by confidence."""
    x, y = (F.col("x1") + F.col("x2")) / 2 / width, (F.col("y1") + F.col("y2")) / 2 / height
    score = F.col("confidence") / (1.0 + F.abs(x - 0.5) + F.abs(y - 0.4))
    rows = faces.where("speaking").withColumn("speaker_score", F.round(score, 9)).where("speaker_score > 0")
    return rows.groupBy(*by).agg(F.min_by("det_id", F.struct((-F.col("speaker_score")).alias("s"), "det_id")).alias("det_id"), F.max("speaker_score").alias("speaker_score"))


def stability(framings: DataFrame, last: int = 5) -> DataFrame:
    """How little framings (video_id, ts, crop_x, crop_y, zoom) differ from the `last` before them; 1 for the first."""
    w = Window.partitionBy("video_id").orderBy("ts").rowsBetween(-last, -1)
    rows = framings.withColumn("_h", F.collect_list(F.struct("crop_x", "crop_y", "zoom")).over(w))
    mean = lambda f: F.aggregate(F.transform("_h", f), F.lit(0.0), lambda a, x: a + x) / F.size("_h")
    moved = mean(lambda p: (F.abs(F.col("crop_x") - p["crop_x"]) + F.abs(F.col("crop_y") - p["crop_y"])).cast("double"))
    zoomed = mean(lambda p: F.abs(F.col("zoom") - p["zoom"]).cast("double"))
    steady = lambda x, most: F.greatest(F.lit(0.0), 1.0 - x / most)
    return rows.withColumn("stability", F.when(F.size("_h") == 0, 1.0).otherwise((steady(moved, 100.0) + steady(zoomed, 0.5)) / 2)).drop("_h")


def presence_runs(frames: DataFrame, most_apart: int = 1) -> DataFrame:
    """Runs of consecutive frames (video_id, frame_no, objects) that have objects: first, last, number, and the objects of the last."""
    w = Window.partitionBy("video_id").orderBy("frame_no")
    rows = frames.where("objects > 0").withColumn("_new", F.when(F.col("frame_no") - F.lag("frame_no").over(w) <= most_apart, 0).otherwise(1))
    rows = rows.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("video_id", "_run").agg(F.min("frame_no").alias("first_frame"), F.max("frame_no").alias("last_frame"), F.count("*").alias("frames"), F.max_by("objects", "frame_no").alias("objects")).drop("_run")


def speech_runs(samples: DataFrame, value: str, share: float = 0.3, least: float = 0.5) -> DataFrame:
    """Runs of samples above `share` of the video's mean that last `least` seconds, to the first sample after them or the video's last."""
    w = Window.partitionBy("video_id").orderBy("frame_no")
    rows = samples.withColumn("_high", F.col(value) > share * F.avg(value).over(Window.partitionBy("video_id"))).withColumn("_next", F.coalesce(F.lead("ts").over(w), F.col("ts")))
    rows = rows.withColumn("_run", F.row_number().over(w) - F.sum(F.col("_high").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = rows.where("_high").groupBy("video_id", "_run").agg(F.min("ts").alias("run_start"), F.max("_next").alias("run_end"))
    return runs.where(F.col("run_end") - F.col("run_start") >= least).drop("_run")


def decisions_at(frames: DataFrame, decisions: DataFrame) -> DataFrame:
    """Each frame (video_id, ts) with the decision (decision_id, start, stop) that it lies in, ends included, else the one that starts nearest, the earlier of two.

    Decisions of a video don't overlap; one sort by video and time brings both sides together.
    """
    kept = F.struct("decision_id", "start", "stop")
    marks = decisions.select("video_id", F.col("start").alias("ts"), kept.alias("d"), F.lit(0).alias("is_frame"))
    asked = frames.select("video_id", F.col("ts").cast("double").alias("ts"), F.lit(None).cast(marks.schema["d"].dataType).alias("d"), F.lit(1).alias("is_frame"))
    w = Window.partitionBy("video_id").orderBy("ts", "is_frame")
    before = F.last("d", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first("d", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    rows = marks.unionByName(asked).withColumn("b", before).withColumn("a", after).where("is_frame = 1")
    inside = F.col("b").isNotNull() & (F.col("ts") <= F.col("b.stop"))
    nearer = F.col("a").isNull() | (F.col("b").isNotNull() & (F.col("ts") - F.col("b.start") <= F.col("a.start") - F.col("ts")))
    return rows.select("video_id", "ts", F.when(inside | nearer, F.col("b.decision_id")).otherwise(F.col("a.decision_id")).alias("decision_id"), inside.alias("inside"))


def best_frames(frames: DataFrame, by: list[str], score: str) -> DataFrame:
    """The frame of the highest score of each `by`, the first of equal ones."""
    return frames.groupBy(*by).agg(F.min_by("frame_no", F.struct((-F.col(score)).alias("s"), "frame_no")).alias("frame_no"), F.max(score).alias("score"))


def representative_frames(frames: DataFrame, by: list[str], seconds: float = 30.0) -> DataFrame:
    """Of more than three frames of a `by` the first, the last and evenly stepped ones between, three to five by its length in seconds."""
    n = max(3, min(5, int(seconds // 10)))
    w = Window.partitionBy(*by)
    rows = frames.withColumn("_i", F.row_number().over(w.orderBy("frame_no")) - 1).withColumn("_n", F.count("*").over(w))
    step = F.floor(F.col("_n") / (n - 1))
    stepped = F.lit(False)
    for i in range(1, n - 1):
        stepped = stepped | (F.col("_i") == F.least(i * step, F.col("_n") - 1))
    rule = F.when(F.col("_n") <= 3, True).when(F.col("_n") < n, F.col("_i") < n).otherwise((F.col("_i") == 0) | (F.col("_i") == F.col("_n") - 1) | stepped)
    return rows.where(rule).drop("_i", "_n")


def quick_assessment(frames: DataFrame, score: str, most: int = 5) -> DataFrame:
    """A video's interest (1 to 10) from its `most` best frames, and what that makes it."""
    w = Window.partitionBy("video_id").orderBy(F.desc(score), "frame_no")
    found = frames.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most).groupBy("video_id").agg(F.count("*").alias("frames"), F.avg(score).alias("quality"))
    rows = found.withColumn("interest", F.least(F.lit(10.0), F.greatest(F.lit(1.0), F.col("quality") * 10)))
    return rows.withColumn("assessment", F.when(F.col("interest") >= 7, "good").when(F.col("interest") >= 5, "fair").otherwise("poor")).withColumn("suitable", F.col("quality") > 0.6)


def track_counts(tracks: DataFrame, active_below: int = 30) -> DataFrame:
    """Tracks (kind, detections) of each video by kind, and those of fewer than `active_below` detections."""
    return tracks.groupBy("video_id", "kind").agg(F.count("*").alias("tracks"), F.count_if(F.col("detections") < active_below).alias("active"))


def recent_boxes(detections: DataFrame, track: str, last: int = 30) -> DataFrame:
    """The last boxes and confidences of each track, in order."""
    w = Window.partitionBy("video_id", track).orderBy(F.desc("ts"), F.desc("det_id"))
    rows = detections.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= last)
    return rows.groupBy("video_id", track).agg(F.array_sort(F.collect_list(F.struct("ts", "det_id", "x1", "y1", "x2", "y2", "confidence"))).alias("boxes"))


def actor_requests(asked: DataFrame, appearances: DataFrame) -> DataFrame:
    """Asked actors (video_id, asked), whatever their case, with how often they appear; 0 and not found otherwise."""
    seen = appearances.groupBy("video_id", F.lower("actor").alias("_actor")).agg(F.count("*").alias("appearances"))
    rows = asked.join(seen, (F.lower("asked") == F.col("_actor")) & (asked["video_id"] == seen["video_id"]), "left").select(asked["video_id"], "asked", F.coalesce("appearances", F.lit(0)).alias("appearances"))
    return rows.withColumn("found", F.col("appearances") > 0)
