"""Registered queries: each applies an operator to the staged tables of `sf_dir`."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clipwright import staging as st
from clipwright.functions import lexicons as lx
from clipwright.functions import text as tx
from clipwright.functions import titles as tt
from clipwright.operators import candidates as cd
from clipwright.operators import captions as cp
from clipwright.operators import framing as fr
from clipwright.operators import intervals as iv
from clipwright.operators import prompts as pr
from clipwright.operators import reports as rs
from clipwright.operators import retention as rt
from clipwright.operators import select as sl
from clipwright.operators import tracking as tk
from clipwright.operators import vectors as vc
from clipwright.operators import windows as wd
from clipwright.sources import replies as rp
from clipwright.sources import requests as rq

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
#: The literal "now" of the retention queries, in seconds.
NOW = 1_704_067_200 + 600 * 3600


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def rounded(df: DataFrame, *columns: str, places: int = 4) -> DataFrame:
    """Halves go away from zero, and so does a double that lies next below a half: 0.084375 counts as that half, as it does in SQL."""
    scale = 10.0**places
    return df.withColumns({c: F.round(F.col(c).cast("double") * scale, 0) / scale for c in columns})


def clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality-driven windows, numbered within their video."""
    windows = cd.quality_windows(st.transcript(spark, sf_dir), st.videos(spark, sf_dir))
    order = ["seg_start", "seg_end", "seg_idx"]
    w = cd.Window.partitionBy("video_id").orderBy(*order)
    return windows.select("video_id", F.row_number().over(w).alias("segment_id"), "seg_start", "seg_end", "method", "priority")


def clip_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iv.segment_text(clips(spark, sf_dir), st.transcript(spark, sf_dir))


def noted_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`clip_texts` with the notes of their lines."""
    return iv.segment_text(clips(spark, sf_dir), st.transcript(spark, sf_dir), notes=True)


def scored_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sl.scored(noted_clips(spark, sf_dir))


@query
def pause_patterns(spark, sf_dir):
    return wd.pause_patterns(st.transcript(spark, sf_dir))


@query
def silence_periods(spark, sf_dir):
    return wd.silence_periods(st.transcript(spark, sf_dir))


@query
def long_silences(spark, sf_dir):
    return wd.long_silences(st.transcript(spark, sf_dir), 2.0)


@query
def speaker_changes(spark, sf_dir):
    return rounded(wd.speaker_changes(st.transcript(spark, sf_dir)), "confidence")


@query
def topic_cuts(spark, sf_dir):
    return wd.topic_cuts(st.transcript(spark, sf_dir))


@query
def smoothed_intensity(spark, sf_dir):
    return rounded(wd.smoothed_intensity(st.transcript(spark, sf_dir)), "intensity")


@query
def intensity_summary(spark, sf_dir):
    return rounded(wd.intensity_summary(st.transcript(spark, sf_dir)), "mean", "most", "variance").drop("climax_start")


@query
def sentence_starts(spark, sf_dir):
    return wd.sentence_starts(st.transcript(spark, sf_dir)).select("video_id", "seg_idx", "sentence_start", "pause_before")


@query
def transcript_stats(spark, sf_dir):
    return rounded(wd.transcript_stats(st.transcript(spark, sf_dir)), "words_per_segment", "words_per_minute")


@query
def speech_stats(spark, sf_dir):
    found = wd.speech_stats(st.transcript(spark, sf_dir))
    return rounded(found, *[c for c in found.columns if c not in ("video_id", "segments", "pauses")])


@query
def transcript_enriched(spark, sf_dir):
    return rounded(wd.enriched(st.transcript(spark, sf_dir)), "rate")


@query
def appearance_sessions(spark, sf_dir):
    return wd.sessions(st.appearances(spark, sf_dir), ["video_id", "actor"], "t", 10)


@query
def motion_runs(spark, sf_dir):
    return wd.motion_runs(st.frame_features(spark, sf_dir), 30.0, 4.0)


@query
def complexity_runs(spark, sf_dir):
    return wd.complexity_runs(st.frame_features(spark, sf_dir), 1.5, 4.0)


@query
def preroll_end(spark, sf_dir):
    return wd.preroll_end(st.transcript(spark, sf_dir), st.videos(spark, sf_dir))


@query
def text_quality(spark, sf_dir):
    docs = st.table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.round(tx.segment_text_quality(F.col("text")), 4).alias("segment_quality"), F.round(tx.clip_text_quality(F.col("text")), 4).alias("clip_quality"))


@query
def text_engagement(spark, sf_dir):
    docs, text = tx.prepared(st.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", F.round(tx.clip_engagement(text), 4).alias("engagement"))


@query
def content_type(spark, sf_dir):
    docs = st.table(spark, sf_dir, "documents")
    return docs.select("doc_id", tx.clip_type(F.col("text")).alias("clip_type"), tx.speech_type(F.col("text")).alias("speech_type"), tx.best_label(F.col("text"), lx.CATEGORIES, "general").alias("category"))


@query
def emotional_intensity(spark, sf_dir):
    docs = st.table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.round(tx.emotional_intensity(F.col("text")), 4).alias("emotion"), tx.best_label(F.col("text"), lx.ZOOM, "medium_shot").alias("zoom"))


@query
def viral_potential(spark, sf_dir):
    docs, text = tx.prepared(st.table(spark, sf_dir, "documents").select("doc_id", "text"))
    docs = docs.withColumn("viral", F.round(tx.viral_potential(text), 4))
    score = tx.optimization_score(text, F.col("viral"), F.lit(30.0), F.lit(0.5))
    return docs.select("doc_id", "viral", F.round(score, 4).alias("optimization"), tx.audience(text).alias("audience"))


@query
def speech_tokens(spark, sf_dir):
    low = F.lower("text")
    count = lambda words: F.size(tx.token_hits(low, words)).cast("long")
    return st.table(spark, sf_dir, "documents").select(
        "doc_id", tx.n_words(F.col("text")).alias("n_words"), count(lx.ENGAGEMENT_TOKENS).alias("engagement"), count(lx.EMOTION_TOKENS).alias("emotion"), count(lx.FILLER_TOKENS).alias("filler"), count(lx.ACTION_TOKENS).alias("actions")
    )


@query
def music_pattern(spark, sf_dir):
    return st.transcript(spark, sf_dir).select("video_id", "seg_idx", tx.music_pattern(F.col("text")).alias("music"))


@query
def sentence_pieces(spark, sf_dir):
    rows = st.transcript(spark, sf_dir).select("video_id", "seg_idx", F.posexplode(tx.sentences(F.col("text"))).alias("i", "sentence"))
    return rows.select("video_id", "seg_idx", F.col("i").cast("long").alias("i"), "sentence")


@query
def prompt_theme_score(spark, sf_dir):
    return sl.theme_matches(clip_texts(spark, sf_dir).select("video_id", "segment_id", "text"), 0.01)


@query
def segment_text(spark, sf_dir):
    return clip_texts(spark, sf_dir).select("video_id", "segment_id", "seg_start", "seg_end", "text")


@query
def break_counts(spark, sf_dir):
    return iv.break_counts(clips(spark, sf_dir), st.breaks(spark, sf_dir)).select("video_id", "segment_id", "break_count")


@query
def clip_scores(spark, sf_dir):
    return scored_clips(spark, sf_dir).select("video_id", "segment_id", "quality_score", "engagement_score", "content_type")


@query
def candidate_quality(spark, sf_dir):
    return sl.preliminary_quality(clip_texts(spark, sf_dir)).select("video_id", "segment_id", "preliminary_quality")


@query
def nearest_vision(spark, sf_dir):
    found = iv.nearest_vision(scored_clips(spark, sf_dir), st.vision_segments(spark, sf_dir))
    return rounded(found, "quality_score", "engagement_score").select("video_id", "segment_id", "quality_score", "engagement_score", "has_vision", "vision_start", "scene_type")


def every_other(times: DataFrame, width: int) -> DataFrame:
    """(video_id, segment_id): the number of each stretch of `width` from the first to the last of a video's times."""
    ends = times.groupBy("video_id").agg(F.floor(F.min("t") / width).cast("int").alias("lo"), F.floor(F.max("t") / width).cast("int").alias("hi"))
    return ends.select("video_id", F.explode(F.sequence("lo", "hi")).alias("segment_id"))


def hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An hour of minutes every two hours, as segments of each event type's timeline from its first event to its last."""
    minute = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000 - 1_704_067_200) / 60)
    rows = every_other(st.table(spark, sf_dir, "events").select(F.col("event_type").alias("video_id"), minute.alias("t")), 120)
    return rows.select("video_id", "segment_id", (F.col("segment_id") * 120.0).alias("seg_start"), (F.col("segment_id") * 120.0 + 60).alias("seg_end"))


@query
def actor_coverage(spark, sf_dir):
    return rounded(iv.actor_coverage(hours(spark, sf_dir), st.appearances(spark, sf_dir)), "coverage")


@query
def actor_presence(spark, sf_dir):
    return rounded(iv.weighted_presence(iv.actor_coverage(hours(spark, sf_dir), st.appearances(spark, sf_dir))), "presence")


@query
def object_coverage(spark, sf_dir):
    spans = wd.sessions(st.appearances(spark, sf_dir), ["video_id", "actor"], "t", 10)
    objects = spans.select("video_id", F.col("actor").alias("object_id"), F.col("start_sec").cast("double").alias("obj_start"), F.col("end_sec").cast("double").alias("obj_end"), (F.col("n") / 10.0).alias("score"))
    return rounded(iv.object_coverage(hours(spark, sf_dir), objects), "coverage")


def days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A day of seconds every two days for each user, from the first event to the last."""
    second = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000) - 1_704_067_200
    rows = every_other(st.table(spark, sf_dir, "events").select(F.col("user_id").alias("video_id"), second.alias("t")), 172_800)
    return rows.select("video_id", "segment_id", (F.col("segment_id") * 172800.0).alias("seg_start"), (F.col("segment_id") * 172800.0 + 86400).alias("seg_end"))


@query
def object_scores(spark, sf_dir):
    return rounded(iv.object_scores(days(spark, sf_dir), st.detections(spark, sf_dir)), "object_relevance", "object_confidence", places=6)


@query
def asof_detection(spark, sf_dir):
    frames = days(spark, sf_dir).select("video_id", F.col("seg_start").cast("long").alias("ts"))
    return rounded(iv.asof_detection(frames, st.detections(spark, sf_dir), 43200.0), "confidence", places=6)


@query
def caption_lines(spark, sf_dir):
    return rounded(iv.caption_lines(clips(spark, sf_dir), st.transcript(spark, sf_dir)), "cap_start", "cap_end")


@query
def sliding_windows(spark, sf_dir):
    return cd.sliding_windows(st.videos(spark, sf_dir), 15, 60, 15)


@query
def break_pair_candidates(spark, sf_dir):
    return cd.break_pairs(st.breaks(spark, sf_dir), st.videos(spark, sf_dir))


@query
def audio_cue_candidates(spark, sf_dir):
    return cd.audio_cue_pairs(st.transcript(spark, sf_dir), st.videos(spark, sf_dir))


@query
def content_groups(spark, sf_dir):
    return cd.content_groups(st.transcript(spark, sf_dir)).select("video_id", "group_start", "group_end", "lines")


@query
def content_aware_candidates(spark, sf_dir):
    return cd.content_aware(st.transcript(spark, sf_dir), 15, 30)


@query
def high_value_windows(spark, sf_dir):
    found = cd.high_value_windows(st.transcript(spark, sf_dir), st.videos(spark, sf_dir))
    return found.withColumn("keywords", F.array_join("keywords", ","))


@query
def quality_windows(spark, sf_dir):
    return cd.quality_windows(st.transcript(spark, sf_dir), st.videos(spark, sf_dir))


@query
def linear_cuts(spark, sf_dir):
    return cd.linear_cuts(st.videos(spark, sf_dir))


@query
def platform_top_k(spark, sf_dir):
    text = F.col("text")
    rows = clip_texts(spark, sf_dir).withColumn("viral", F.round(tx.viral_potential(text), 4))
    score = tx.optimization_score(text, F.col("viral"), F.col("seg_end") - F.col("seg_start"), F.lit(0.5))
    return sl.platform_top(rows.withColumn("optimization", F.round(score, 4)))


@query
def greedy_top_n(spark, sf_dir):
    return sl.greedy_top(scored_clips(spark, sf_dir), 3)


@query
def dedup_candidates(spark, sf_dir):
    kept = sl.deduplicated(sl.preliminary_quality(clip_texts(spark, sf_dir)), similarity=0.8)
    return kept.select("video_id", "segment_id", "seg_start", "seg_end", "preliminary_quality")


@query
def near_duplicates_merged(spark, sf_dir):
    return sl.near_duplicates_merged(scored_clips(spark, sf_dir))


@query
def resolved_overlaps(spark, sf_dir):
    return sl.resolved_overlaps(clips(spark, sf_dir))


@query
def diverse_selection(spark, sf_dir):
    return sl.diverse(scored_clips(spark, sf_dir)).withColumn("categories", F.array_join("categories", ","))


@query
def tiered_selection(spark, sf_dir):
    return sl.tiered(scored_clips(spark, sf_dir), "engagement_score", 0.9, 3).select("video_id", "segment_id", "engagement_score")


@query
def boundary_adjust(spark, sf_dir):
    return sl.clean_boundaries(clips(spark, sf_dir), st.transcript(spark, sf_dir))


@query
def flow_labels(spark, sf_dir):
    return sl.flow_labels(clip_texts(spark, sf_dir)).select("video_id", "segment_id", "flow")


@query
def merged_breaks(spark, sf_dir):
    return sl.merged_breaks(st.breaks(spark, sf_dir))


@query
def actor_segments(spark, sf_dir):
    return sl.actor_segments(st.appearances(spark, sf_dir))


@query
def vector_search(spark, sf_dir):
    vectors = st.table(spark, sf_dir, "embeddings")
    references = vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("ref_id"), F.col("embedding").alias("ref"))
    return vc.search(vectors, references, 0.2, 5)


@query
def leader_clusters(spark, sf_dir):
    return vc.leader_clusters(st.table(spark, sf_dir, "embeddings"), "label", 0.3)


@query
def track_summary(spark, sf_dir):
    return rounded(rounded(tk.track_summary(st.detections(spark, sf_dir)), "consistency"), "mean_confidence", "relevance", places=6)


@query
def class_summary(spark, sf_dir):
    return rounded(tk.class_summary(st.detections(spark, sf_dir)), "mean_confidence", places=6)


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.detections(spark, sf_dir).withColumn("day", F.floor(F.col("ts") / 86400))


@query
def weighted_crop_center(spark, sf_dir):
    return rounded(tk.weighted_crops(daily(spark, sf_dir), "day"), "confidence", places=6)


@query
def iou_pairs(spark, sf_dir):
    return rounded(tk.overlapping_boxes(daily(spark, sf_dir), "day"), "iou")


@query
def nms_subjects(spark, sf_dir):
    return tk.without_duplicates(daily(spark, sf_dir), "day", 0.1).select("video_id", "day", "det_id")


@query
def pan_speed(spark, sf_dir):
    crops = tk.weighted_crops(daily(spark, sf_dir), "day").withColumnRenamed("day", "ts")
    return rounded(tk.pan_speed(crops), "pan_speed")


@query
def gap_fill(spark, sf_dir):
    crops = tk.weighted_crops(daily(spark, sf_dir), "day").withColumnRenamed("day", "ts")
    return tk.gaps_filled(crops, 1.0)


@query
def predicted_centres(spark, sf_dir):
    return tk.predicted_centres(st.detections(spark, sf_dir), "class_name")


def framed(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = cd.Window.partitionBy("video_id").orderBy("ts", "det_id")
    return st.detections(spark, sf_dir).withColumn("frame_no", F.row_number().over(w))


@query
def tracker(spark, sf_dir):
    return tk.tracked(framed(spark, sf_dir), 300.0)


@query
def layout_hysteresis(spark, sf_dir):
    frames = framed(spark, sf_dir).select("video_id", "frame_no", (F.floor(F.col("det_id") / 4) % 3).alias("speakers"))
    return tk.stable_layout(frames, 3)


@query
def caption_chunks(spark, sf_dir):
    found = cp.chunks(cp.timed_words(st.transcript(spark, sf_dir)))
    return rounded(found, "start", "end")


@query
def srt_cues(spark, sf_dir):
    return cp.srt_lines(iv.caption_lines(clips(spark, sf_dir), st.transcript(spark, sf_dir)))


@query
def retention_by_age(spark, sf_dir):
    return rt.by_age(st.files(spark, sf_dir), NOW)


@query
def retention_by_size(spark, sf_dir):
    return rt.by_size(st.files(spark, sf_dir), NOW, 100_000)


@query
def retention_by_count(spark, sf_dir):
    return rt.by_count(st.files(spark, sf_dir), NOW, 20)


@query
def retention_plan(spark, sf_dir):
    return rt.plan(st.files(spark, sf_dir), NOW, 100_000, 20)


@query
def directory_info(spark, sf_dir):
    return rt.directory_info(st.files(spark, sf_dir))


@query
def request_validation(spark, sf_dir):
    checked = rq.validated(st.requests(spark, sf_dir))
    return checked.select("request_id", F.array_join("errors", ",").alias("errors"))


@query
def reply_parse(spark, sf_dir):
    return rp.parsed(rp.staged(st.table(spark, sf_dir, "labels")))


@query
def generated_titles(spark, sf_dir):
    text = F.col("text")
    docs = tt.titled(st.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", "title", F.array_join("tags", ",").alias("tags"), tt.fallback_title(F.lit("clip"), text, F.lit(30)).alias("fallback"))


@query
def clean_names(spark, sf_dir):
    return st.files(spark, sf_dir).select("path", tt.clean_filename(F.col("path")).alias("name"))


@query
def excerpts(spark, sf_dir):
    return st.table(spark, sf_dir, "documents").select("doc_id", tt.excerpt(F.col("text")).alias("excerpt"))


@query
def prompt_analysis(spark, sf_dir):
    found = pr.analysed(st.prompts(spark, sf_dir))
    return found.drop("prompt", "themes")


@query
def prompt_focus_tokens(spark, sf_dir):
    return st.prompts(spark, sf_dir).select("request_id", F.array_join(pr.focus_tokens(F.col("prompt")), ",").alias("tokens"))


def prompt_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each request's score of every clip of its video."""
    asked = st.prompts(spark, sf_dir).select("request_id", F.col("request_id").alias("video_id"), pr.intent_keywords(F.col("prompt")).alias("keywords"))
    stop = st.transcript(spark, sf_dir).groupBy("video_id").agg(F.max("end").alias("stop"))
    return pr.heuristic_scores(clip_texts(spark, sf_dir).join(asked, "video_id").join(stop, "video_id"))


@query
def prompt_heuristic(spark, sf_dir):
    return prompt_scores(spark, sf_dir).select("request_id", "segment_id", "heuristic")


@query
def prompt_matches(spark, sf_dir):
    return pr.best_matches(prompt_scores(spark, sf_dir).select("request_id", "segment_id", F.col("heuristic").alias("score")), 3, 3, 0.6, 0.5)


@query
def zoom_plan(spark, sf_dir):
    found = fr.zoom_plan(fr.composite_boxes(daily(spark, sf_dir), "day"))
    return rounded(found.select("video_id", "day", "subjects", "zoom", "crop_x", "crop_y", "crop_w", "crop_h"), "zoom")


def zooms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fr.zoom_plan(fr.composite_boxes(daily(spark, sf_dir), "day")).select("video_id", F.col("day").alias("ts"), "zoom")


@query
def smoothed_zoom(spark, sf_dir):
    return rounded(fr.smoothed_zoom(zooms(spark, sf_dir)), "zoom")


@query
def zoom_quality(spark, sf_dir):
    return rounded(fr.zoom_quality(zooms(spark, sf_dir)), "stability")


@query
def gaussian_crops(spark, sf_dir):
    crops = tk.weighted_crops(daily(spark, sf_dir), "day").withColumnRenamed("day", "ts")
    return rounded(fr.gaussian_smoothed(crops, ["x1", "y1"], 0.5), "x1", "y1")


def climaxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rs.climax_scores(scored_clips(spark, sf_dir), wd.smoothed_intensity(st.transcript(spark, sf_dir)))


@query
def climax_scores(spark, sf_dir):
    return rounded(climaxes(spark, sf_dir).select("video_id", "segment_id", "intensity", "climax_score"), "intensity", "climax_score")


@query
def climax_top(spark, sf_dir):
    scored = climaxes(spark, sf_dir).withColumn("intensity", F.col("intensity") * 4)
    return rounded(rs.climax_top(scored, 3).select("video_id", "segment_id", "place", "climax_score"), "climax_score")


@query
def seeded_variation(spark, sf_dir):
    return rs.varied(scored_clips(spark, sf_dir)).select("video_id", "segment_id", "tier")


@query
def segment_summary(spark, sf_dir):
    return rounded(rs.segment_summary(scored_clips(spark, sf_dir)), "mean_quality", "mean_engagement", places=6)


@query
def content_type_counts(spark, sf_dir):
    return rs.type_counts(scored_clips(spark, sf_dir))


@query
def sampled_candidates(spark, sf_dir):
    return rs.every_kth(clips(spark, sf_dir), 10).select("video_id", "segment_id")


@query
def primary_subjects(spark, sf_dir):
    return rs.primary_subjects(daily(spark, sf_dir), "day").select("video_id", "day", "det_id", "place")


@query
def frame_layouts(spark, sf_dir):
    return rounded(rs.frame_layouts(daily(spark, sf_dir), "day"), "confidence", places=6)


@query
def smoothed_speakers(spark, sf_dir):
    return rs.smoothed_speakers(st.detections(spark, sf_dir))
