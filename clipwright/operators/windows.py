"""Consecutive rows of a video: pauses, runs, sessions, smoothing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from clipwright.functions import lexicons as lx
from clipwright.functions.text import any_of, hits, words


def _lines() -> WindowSpec:
    return Window.partitionBy("video_id").orderBy("seg_idx")


def pause_patterns(transcript: DataFrame) -> DataFrame:
    """Pauses over a tenth of a second before the next line, classed by length."""
    rows = transcript.withColumn("next_start", F.lead("start").over(_lines())).withColumn("pause", F.col("next_start") - F.col("end")).where("pause > 0.1")
    kind = F.when(F.col("pause") < 0.5, "short").when(F.col("pause") < 1.5, "medium").when(F.col("pause") < 3.0, "long").otherwise("extended")
    return rows.select("video_id", "seg_idx", F.col("end").alias("pause_start"), F.col("next_start").alias("pause_end"), "pause", kind.alias("kind"))


def silence_periods(transcript: DataFrame, least: float = 0.5) -> DataFrame:
    """Gaps of more than `least` seconds between consecutive lines."""
    rows = transcript.withColumn("silence_start", F.lag("end").over(_lines())).where(F.col("start") > F.col("silence_start") + least)
    return rows.select("video_id", "seg_idx", "silence_start", F.col("start").alias("silence_end"))


def long_silences(transcript: DataFrame, least: float = 5.0) -> DataFrame:
    """Speech gaps and silences of at least `least` seconds; a stretch may be both."""
    gaps = silence_periods(transcript, 0.0).where(F.col("silence_end") - F.col("silence_start") >= least)
    marked = silence_periods(transcript).where(F.col("silence_end") - F.col("silence_start") >= least)
    return gaps.withColumn("kind", F.lit("speech_gap")).unionAll(marked.withColumn("kind", F.lit("detected_silence")))


def speaker_changes(transcript: DataFrame) -> DataFrame:
    """A pause over two seconds, or a speaking rate that changes by more than half, to the next line; both may hold."""
    rate = F.col("n_words") / (F.col("end") - F.col("start") + 0.001)
    rows = transcript.withColumn("rate", rate).select("*", F.lead("start").over(_lines()).alias("next_start"), F.lead(rate).over(_lines()).alias("next_rate")).where("next_start is not null")
    pause = F.col("next_start") - F.col("end")
    change = F.abs(F.col("rate") - F.col("next_rate")) / (F.col("rate") + 0.001)
    found = F.array(
        F.when(pause > 2.0, F.struct(F.col("end").alias("ts"), F.least(pause / 5.0, F.lit(1.0)).alias("confidence"), F.lit("long_pause").alias("indicator"))),
        F.when(change > 0.5, F.struct(F.col("next_start").alias("ts"), F.least(change, F.lit(1.0)).alias("confidence"), F.lit("rate_change").alias("indicator"))),
    )
    return rows.select("video_id", "seg_idx", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("c")).select("video_id", "seg_idx", "c.*")


def topic_cuts(transcript: DataFrame) -> DataFrame:
    """Cuts at silences over a second, and where consecutive lines share under three tenths of their words."""
    natural = silence_periods(transcript).where(F.col("silence_end") - F.col("silence_start") > 1.0)
    natural = natural.select("video_id", F.col("silence_start").alias("ts"), F.lit("natural_break").alias("kind"), F.lit(0.8).alias("confidence"))
    own = F.array_distinct(words(F.lower("text")))
    rows = transcript.withColumn("w", own).withColumn("v", F.lag("w").over(_lines())).where("v is not null")
    union = F.size(F.array_union("w", "v"))
    share = F.when(union > 0, F.size(F.array_intersect("w", "v")) / union).otherwise(0.0)
    topic = rows.where(share < 0.3).select("video_id", F.col("start").alias("ts"), F.lit("topic_change").alias("kind"), F.lit(0.6).alias("confidence"))
    return natural.unionByName(topic)


def intensity(transcript: DataFrame) -> DataFrame:
    """Intensity of each line: signs of volume, of emotion, and pace. Its terms have three decimals at most, and it is the double next to their exact sum."""
    pace = F.col("n_words") / (F.col("end") - F.col("start"))
    volume = F.least(hits(F.col("text"), lx.INTENSITY_VOLUME) * 0.2, F.lit(1.0))
    emotion = F.least(hits(F.col("text"), lx.INTENSITY_EMOTION) * 0.15, F.lit(1.0))
    speech = F.when(F.col("end") <= F.col("start"), 0.0).when((pace > 3) | (pace < 1), 0.8).when((pace > 2.5) | (pace < 1.5), 0.6).otherwise(0.4)
    return transcript.select("video_id", "seg_idx", "start", "end", F.round(volume * 0.4 + emotion * 0.4 + speech * 0.2, 3).alias("intensity"))


def smoothed_intensity(transcript: DataFrame) -> DataFrame:
    """Intensity as the mean of three lines, but for the first and last."""
    rows = intensity(transcript)
    before, after = F.lag("intensity").over(_lines()), F.lead("intensity").over(_lines())
    mean = (before + F.col("intensity") + after) / 3
    return rows.select("video_id", "seg_idx", "start", "end", F.coalesce(mean, F.col("intensity")).alias("intensity"))


def intensity_summary(transcript: DataFrame) -> DataFrame:
    """Mean, largest and population variance of a video's intensity, its peaks above 0.7, and where it is highest in the first nine tenths."""
    rows = intensity(transcript).withColumn("stop", F.max("end").over(Window.partitionBy("video_id")))
    early = F.when(F.col("end") <= F.col("stop") * 0.9, F.struct("intensity", (-F.col("seg_idx")).alias("first"), "start"))
    return rows.groupBy("video_id").agg(
        F.avg("intensity").alias("mean"), F.max("intensity").alias("most"), F.var_pop("intensity").alias("variance"), F.count_if(F.col("intensity") > 0.7).alias("peaks"), F.max(early)["start"].alias("climax_start")
    )


def sentence_starts(transcript: DataFrame) -> DataFrame:
    """Whether a line begins a sentence, and whether a pause comes before it."""
    said = F.regexp_replace("text", "^\\s+|\\s+$", "")
    rows = transcript.select("*", said.alias("said"), F.lag(said).over(_lines()).alias("before"), F.lag("end").over(_lines()).alias("before_end"))
    start = (F.length("said") >= 3) & F.col("before").rlike("[.!?]$") & F.col("said").rlike("^[\\p{Lu}\"']")
    pause = (F.col("start") - F.col("before_end") >= 0.5) | F.col("before").rlike("(,|;|:|--|—)$")
    return rows.select("video_id", "seg_idx", "start", "end", "text", F.coalesce(start, F.lit(False)).alias("sentence_start"), F.coalesce(pause, F.lit(False)).alias("pause_before"))


def sessions(points: DataFrame, by: list[str], ts: str, gap: float) -> DataFrame:
    """Runs of points no more than `gap` apart: first, last and number of each."""
    w = Window.partitionBy(*by).orderBy(ts)
    flagged = points.withColumn("_new", F.when(F.col(ts) - F.lag(ts).over(w) <= gap, 0).otherwise(1))
    numbered = flagged.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*by, "_run").agg(F.min(ts).alias("start_sec"), F.max(ts).alias("end_sec"), F.count("*").alias("n")).drop("_run")


def runs_above(samples: DataFrame, value: str, threshold, least: float) -> DataFrame:
    """Runs of samples above `threshold`, from the first of them to the first sample after them, that last `least` seconds; a run still open at the end is left out."""
    w = Window.partitionBy("video_id").orderBy("frame_no")
    high = F.col(value) > threshold
    rows = samples.withColumn("_high", high).withColumn("_next", F.lead("ts").over(w))
    rows = rows.withColumn("_run", F.row_number().over(w) - F.sum(F.col("_high").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = rows.where("_high").groupBy("video_id", "_run").agg(F.min("ts").alias("run_start"), F.max_by("_next", "frame_no").alias("run_end"))
    return runs.where(F.col("run_end") - F.col("run_start") >= least).drop("_run")


def motion_runs(samples: DataFrame, threshold: float = 30.0, least: float = 10.0) -> DataFrame:
    return runs_above(samples, "motion", F.lit(threshold), least)


def complexity_runs(samples: DataFrame, factor: float = 1.5, least: float = 15.0) -> DataFrame:
    """Runs above `factor` times a video's mean, which is summed in the order of frames: a sample may equal the threshold but for the last bit of a sum, which depends on its order."""
    w = Window.partitionBy("video_id").orderBy("frame_no").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    mean = samples.withColumn("_mean", F.avg("complexity").over(w))
    return runs_above(mean, "complexity", F.col("_mean") * factor, least)


def preroll_end(transcript: DataFrame, videos: DataFrame) -> DataFrame:
    """Where a video's lead-in ends: after the last greeting, or silence over five seconds, of its first minute or 15 %; at most at 25 %."""
    early = F.least(F.lit(60.0), F.col("duration") * 0.15)
    said = transcript.join(videos.select("video_id", "duration"), "video_id").withColumn("before", F.lag("end").over(_lines()))
    greeting = F.when((F.col("start") <= early) & any_of(F.col("text"), lx.INTRO), F.col("end"))
    silence = F.when((F.col("before") < early) & (F.col("start") - F.col("before") > 5.0), F.col("start"))
    found = said.groupBy("video_id").agg(F.max("duration").alias("duration"), F.coalesce(F.greatest(F.max(greeting), F.max(silence)), F.lit(0.0)).alias("end"))
    return found.select("video_id", F.least(F.col("end"), F.col("duration") * 0.25).alias("preroll_end"))


def transcript_stats(transcript: DataFrame) -> DataFrame:
    found = transcript.groupBy("video_id").agg(F.max("end").alias("total_duration"), F.sum("n_words").alias("total_words"), F.count("*").alias("total_segments"), F.count_distinct("speaker").alias("speakers"))
    rate = F.when(F.col("total_duration") > 0, F.col("total_words") / F.col("total_duration") * 60).otherwise(0.0)
    return found.select("*", (F.col("total_words") / F.col("total_segments")).alias("words_per_segment"), rate.alias("words_per_minute"))


def speech_stats(transcript: DataFrame) -> DataFrame:
    """Rates, emotion, pauses and how often each framing is called for."""
    from clipwright.functions.text import best_label, emotional_intensity

    rate = F.col("n_words") / (F.col("end") - F.col("start") + 0.001)
    zoom = best_label(F.col("text"), lx.ZOOM, "medium_shot")
    rows = transcript.select("video_id", rate.alias("rate"), emotional_intensity(F.col("text")).alias("emotion"), zoom.alias("zoom"))
    found = rows.groupBy("video_id").agg(
        F.count("*").alias("segments"), F.avg("rate").alias("mean_rate"), F.var_pop("rate").alias("rate_variance"), F.avg("emotion").alias("mean_emotion"), F.max("emotion").alias("peak_emotion"),
        *[(F.count_if(F.col("zoom") == z) / F.count("*") * 100).alias(f"{z}_percent") for z in lx.ZOOM],
    )
    pauses = pause_patterns(transcript).groupBy("video_id").agg(F.count("*").alias("pauses"), F.avg("pause").alias("mean_pause"))
    return found.join(pauses, "video_id", "left").fillna({"pauses": 0, "mean_pause": 0.0})


def enriched(transcript: DataFrame) -> DataFrame:
    """Rate, energy, emphasis, zoom strategy, engagement and viral label of each line."""
    from clipwright.functions.text import occurrences, token_hits

    text, dur = F.col("text"), F.col("end") - F.col("start")
    rate = F.when(dur > 0, F.col("n_words") / dur * 60).otherwise(0.0)
    energy = F.when((F.col("rate") > 180) | (occurrences(text, "!") + occurrences(text, "?") > 0), "high").when(F.col("rate") > 120, "medium").otherwise("low")
    rows = transcript.withColumn("rate", rate).withColumn("energy", energy).withColumn("emphasis", F.size(token_hits(text, lx.KEY_TOKENS)).cast("long")).withColumn("personal", any_of(text, lx.PERSONAL))
    strategy = (
        F.when((F.col("emphasis") > 0) | F.col("personal"), "close_up").when(any_of(text, lx.GROUP), "wide_shot").when(F.col("energy") == "high", "dynamic").otherwise("medium_shot")
    )
    score = (
        F.lit(0.5)
        + F.when(F.col("emphasis") > 0, 0.2).otherwise(0.0)
        + F.when(F.col("energy") == "high", 0.2).when(F.col("energy") == "medium", 0.1).otherwise(0.0)
        + F.when(F.col("personal"), 0.1).otherwise(0.0)
        + F.when((F.col("rate") >= 120) & (F.col("rate") <= 200), 0.1).otherwise(0.0)
    )
    rows = rows.withColumn("strategy", strategy).withColumn("engagement", F.round(F.least(score, F.lit(1.0)), 4))
    viral = F.when(F.col("engagement") > 0.8, "high").when(F.col("engagement") > 0.6, "medium").otherwise("low")
    return rows.select("video_id", "seg_idx", "rate", "energy", "emphasis", "strategy", "engagement", viral.alias("viral"))
