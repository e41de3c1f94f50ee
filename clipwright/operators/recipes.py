"""Evaluating, filtering and choosing segments against a request, step by step.

Each step takes and gives rows, so that a recipe is a row of steps; what a step depends on within
a video or a request is a window or a grouped aggregate over it.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clipwright.functions import lexicons as lx
from clipwright.functions.text import any_of, capped, hits, let, n_words, occurrences, words
from clipwright.operators.intervals import interval_join
from clipwright.operators.select import _fold

#: Words of the rules below.
CONTEXT = ["this", "that", "here", "now", "today"]
TUTORIAL = ["learn", "how", "step", "method", "technique", "way", "process"]
ENTERTAINMENT = ["fun", "funny", "amazing", "incredible", "wow", "great"]
ATTRACTION = ["amazing", "incredible", "important", "key", "best", "must", "wow", "great"]
ENERGY = ["amazing", "incredible", "unbelievable", "wow", "shocking"]
PHRASES = ["you won't believe", "this is crazy", "wait for it", "watch this"]
TEXT_PULL = ["amazing", "incredible", "important", "key", "secret", "wow"]
SHOWN = ["move", "show", "demonstrate", "look", "see", "watch"]
PERSONAL = ["i", "you", "we", "feel", "think", "believe"]
STEPS = ["how", "step", "first", "next", "then", "now"]


def bonus(rule: Column, x: float) -> Column:
    return F.when(rule, x).otherwise(0.0)


# Scores of refinement


def duration_fit(dur: Column) -> Column:
    return F.when((dur >= 15) & (dur <= 60), 1.0).when((dur >= 10) & (dur <= 90), 0.7).otherwise(0.3)


def content_density(text: Column, dur: Column) -> Column:
    """Five characters count as a word."""
    rate = F.length(text) / F.greatest(dur, F.lit(1.0)) / 5
    return F.when((rate >= 2) & (rate <= 4), 1.0).when((rate >= 1) & (rate <= 6), 0.7).otherwise(0.4)


def sentence_length_fit(text: Column, parts: Column | None = None) -> Column:
    """`parts`: how many words the text has with points as spaces, where that is known."""
    parts = n_words(F.replace(text, F.lit("."), F.lit(" "))) if parts is None else parts
    fit = let(parts / (occurrences(text, ".") + 1), lambda mean: F.when((mean >= 8) & (mean <= 20), 0.8).otherwise(0.5))
    return F.when(text == "", 0.0).otherwise(fit)


def standalone(text: Column) -> Column:
    return F.when(text == "", 0.0).otherwise(capped(0.5 + bonus(text.rlike("[.!?]"), 0.3) + bonus(any_of(text, CONTEXT), 0.2), 1.0))


def validated(segments: DataFrame, audio: float = 0.7, transitions: float = 0.6, narrative: float = 0.6) -> DataFrame:
    """Adds heuristic and coherence to segments with text; what isn't measured has the value given for it. Notes of their lines spare counting words."""
    parts = F.col("_parts") if "_parts" in segments.columns else None
    text, dur = F.col("text"), F.col("seg_end") - F.col("seg_start")
    heuristic = duration_fit(dur) * 0.25 + audio * 0.3 + transitions * 0.25 + content_density(text, dur) * 0.2
    return segments.withColumn("heuristic", heuristic).withColumn("coherence", (sentence_length_fit(text, parts) + narrative + standalone(text)) / 3)


def cross_validated(segments: DataFrame, least: float = 0.6) -> DataFrame:
    """Adds composite (of model_score, heuristic and coherence), passed and confidence, the lowest of the three."""
    composite = F.col("model_score") * 0.5 + F.col("heuristic") * 0.3 + F.col("coherence") * 0.2
    rows = segments.withColumn("composite", F.round(composite, 6))
    return rows.withColumn("passed", F.col("composite") >= least).withColumn("confidence", F.least("model_score", "heuristic", "coherence"))


def validation_summary(rows: DataFrame) -> DataFrame:
    """Of a video's cross-validated segments: how many, how many passed, their share, and the means of those and of all."""
    passed = F.count_if("passed")
    return rows.groupBy("video_id").agg(
        F.count("*").alias("segments"), passed.alias("passed"), (passed / F.count("*")).alias("rate"), F.coalesce(F.avg(F.when(F.col("passed"), F.col("composite"))), F.lit(0.0)).alias("confidence"), F.avg("composite").alias("mean")
    )


def engagement_potential(text: Column) -> Column:
    return capped(0.5 + capped(hits(text, ATTRACTION) * 0.1, 0.3) + capped(occurrences(text, "?") * 0.05, 0.1) + capped(occurrences(text, "!") * 0.05, 0.1), 1.0)


def enhanced_quality(segments: DataFrame, technical: float = 0.7, narrative: float = 0.6) -> DataFrame:
    """Adds enhanced, from composite, the words of `prompt`, the `factors` (array) looked for, and content_kind."""
    low = F.lower("text")
    keywords = words(F.lower("prompt"))
    share = lambda ws: F.size(F.filter(ws, lambda w: low.contains(F.lower(w)))) / F.greatest(F.size(ws), F.lit(1))
    relevance = share(keywords) * 0.6 + F.when(F.size("factors") > 0, share(F.col("factors"))).otherwise(0.5) * 0.4
    kind = F.col("content_kind")
    alignment = F.when(kind == "tutorial", capped(hits(F.col("text"), TUTORIAL) / 3, 1.0)).when(kind == "entertainment", capped(hits(F.col("text"), ENTERTAINMENT) / 2, 1.0)).otherwise(0.5)
    score = F.col("composite") * 0.3 + relevance * 0.25 + alignment * 0.15 + engagement_potential(F.col("text")) * 0.15 + technical * 0.1 + narrative * 0.05
    return segments.withColumn("enhanced", F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))


def unlike_selection(segments: DataFrame, most: int = 10, shortest: float = 15.0, longest: float = 60.0, alike: float = 0.7) -> DataFrame:
    """By falling quality_score, segments whose length is in the range and whose words share no more than `alike` (Jaccard) with one chosen before; `most` at most.

    What is carried from row to row are the chosen ones, which are few. Words are split only while fewer than `most` are chosen, and sets met only where their sizes let them be alike.
    """
    dur = F.col("seg_end") - F.col("seg_start")
    rows = segments.where((dur >= shortest) & (dur <= longest))
    rows = rows.select("video_id", "segment_id", F.lit(0).alias("place"), F.lower(F.coalesce("text", F.lit(""))).alias("low"), (-F.col("quality_score")).alias("q"), "seg_start")
    space = re.compile("[ \\t\\n\\x0b\\f\\r]+")
    sets: dict[str, set[str]] = {}

    def near(a: set[str], b: set[str]) -> bool:
        few, many = sorted((len(a), len(b)))
        if many == 0 or few / many <= alike:
            return 0.0 > alike
        both = len(a & b)
        return both / (few + many - both) > alike

    def words_of(low: str) -> set[str]:
        # windows around a line often hold the same lines, so the last texts are kept
        if low not in sets:
            if len(sets) >= 256:
                sets.clear()
            sets[low] = set(space.split(low)) - {""}
        return sets[low]

    def step(kept: list[list], row: list) -> None:
        if len(kept) < most and not any(near(words_of(row[2]), k[-1]) for k in kept):
            kept.append([row[0], len(kept) + 1, *row[2:], words_of(row[2])])

    return _fold(rows, ["video_id"], ["segment_id", "place", "low", "q", "seg_start"], ["q", "seg_start", "segment_id"], step, ["place", "segment_id"])


def filled_scores(segments: DataFrame, score: str, others: Sequence[str]) -> DataFrame:
    """`score` where it is there and not 0, else the largest of `others` within 0 to 1, else 0.05 for a segment with text."""
    best = F.greatest(*others) if len(others) > 1 else F.col(others[0])
    other = F.coalesce(F.when(best.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), best))), bonus(F.coalesce("text", F.lit("")) != "", 0.05))
    return segments.withColumn(score, F.when(F.col(score) != 0, F.col(score)).otherwise(other))


def position_bonus(place: Column) -> Column:
    """Of a start as a share of the video's length."""
    return F.when(place <= 0.1, 0.8).when(place >= 0.85, 0.9).when((place >= 0.4) & (place <= 0.6), 0.7).otherwise(0.5)


# Evaluation against a request


def contextual_scores(segments: DataFrame) -> DataFrame:
    """Relevance, engagement and recommendation of segments (text, seg_start, stop, prompt, content_kind, preferred: `peak`, `end`, `beginning` or other)."""
    place = F.when(F.col("stop") > 0, F.col("seg_start") / F.col("stop")).otherwise(0.5)
    asked, kind, preferred = F.lower("prompt"), F.col("content_kind"), F.col("preferred")
    fits = ((kind == "tutorial") & asked.contains("educational")) | (kind.isin("movie", "documentary") & any_of(F.col("prompt"), ["climax", "dramatic", "best"]))
    placed = F.when(preferred == "peak", (place >= 0.3) & (place <= 0.8)).when(preferred == "end", place > 0.7).when(preferred == "beginning", place < 0.3).otherwise(F.lit(False))
    n = n_words(F.col("text"))
    whole = (n >= 10) & (n <= 100) & F.col("text").rlike("[.!?]")
    score = F.round(0.5 + bonus(fits, 0.2) + bonus(placed, 0.1) + bonus(whole, 0.15), 6)
    rows = segments.withColumn("relevance", F.least(F.lit(1.0), score)).withColumn("engagement", F.least(F.lit(1.0), F.round(score * 0.9, 6)))
    return rows.withColumn("recommended", score > 0.6)


def recommended_or_best(scores: DataFrame, threshold: float = 0.45, standard: float = 0.6, least: int = 3) -> DataFrame:
    """Rows (request_id, segment_id, score, recommended), in which a request without any recommendation has those at `threshold` recommended, else those at `standard`, else its best `least`."""
    w = Window.partitionBy("request_id")
    level = lambda x: F.max((F.col("score") >= x).cast("int")).over(w) == 1
    place = F.row_number().over(w.orderBy(F.desc("score"), "segment_id"))
    rows = scores.withColumn("_own", F.max(F.col("recommended").cast("int")).over(w) == 1).withColumn("_low", level(threshold)).withColumn("_high", level(standard)).withColumn("_place", place)
    tier = F.when(F.col("_own"), F.col("recommended")).when(F.col("_low"), F.col("score") >= threshold).when(F.col("_high"), F.col("score") >= standard).otherwise(F.col("_place") <= least)
    return rows.withColumn("recommended", tier).drop("_own", "_low", "_high", "_place")


def matched_tokens(text: Column, tokens: Column) -> Column:
    return let(F.lower(F.coalesce(text, F.lit(""))), lambda low: F.filter(tokens, lambda t: low.contains(t)))


def boosted(scores: DataFrame, least: float = 0.3) -> DataFrame:
    """Rows with `text` and `tokens` become recommended if the text has one of the tokens and the score is `least` or more; adds matches."""
    rows = scores.withColumn("matches", matched_tokens(F.col("text"), F.col("tokens")))
    return rows.withColumn("recommended", F.col("recommended") | ((F.size("matches") > 0) & (F.col("score") >= least)))


def qualified(scores: DataFrame, relevance: float = 0.3, engagement: float = 0.3) -> DataFrame:
    """A request's rows (relevance, engagement, score) at both thresholds; if none are, at thresholds lower by 0.2; if none are then, the better half, or three of a single row's like."""
    w = Window.partitionBy("request_id")
    meets = lambda less: (F.col("relevance") >= max(0.1, relevance - less) if less else F.col("relevance") >= relevance) & (F.col("engagement") >= max(0.1, engagement - less) if less else F.col("engagement") >= engagement)
    any_ = lambda rule: F.max(rule.cast("int")).over(w) == 1
    half = F.floor(F.count("*").over(w) / 2)
    place = F.row_number().over(w.orderBy(F.desc("score"), "segment_id"))
    rows = scores.withColumn("_first", any_(meets(0))).withColumn("_second", any_(meets(0.2))).withColumn("_half", F.when(half == 0, 3).otherwise(half)).withColumn("_place", place)
    return rows.where(F.when(F.col("_first"), meets(0)).when(F.col("_second"), meets(0.2)).otherwise(F.col("_place") <= F.col("_half"))).drop("_first", "_second", "_half", "_place")


def topped_up(chosen: DataFrame, candidates: DataFrame, by: str, least: int, score: str) -> DataFrame:
    """`chosen` and, where a `by` has fewer than `least` of them, its best candidates that aren't among them."""
    have = chosen.groupBy(by).agg(F.count("*").alias("_have"))
    rest = candidates.join(chosen.select(by, "segment_id"), [by, "segment_id"], "left_anti").join(have, by, "left")
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(score), "segment_id"))
    more = rest.withColumn("_place", place).where(F.col("_place") <= least - F.coalesce("_have", F.lit(0))).drop("_place", "_have")
    return chosen.unionByName(more.select(*chosen.columns))


def at_least(rows: DataFrame, rule: Column, by: str, least: int, score: str) -> DataFrame:
    """The rows that `rule` holds for and, where a `by` has fewer than `least` of them, its best others: `topped_up` of rows of its own candidates, in one pass."""
    ruled = rows.withColumn("_in", F.coalesce(rule, F.lit(False)))
    have = F.count_if("_in").over(Window.partitionBy(by))
    place = F.row_number().over(Window.partitionBy(by).orderBy("_in", F.desc(score), "segment_id"))
    return ruled.withColumn("_have", have).withColumn("_place", place).where(F.col("_in") | (F.col("_place") <= least - F.col("_have"))).drop("_in", "_have", "_place")


def appended(rows: DataFrame, more: DataFrame, key: Sequence[str]) -> DataFrame:
    """`rows`, and those of `more` whose key isn't among theirs."""
    return rows.unionByName(more.join(rows.select(*key).distinct(), list(key), "left_anti").select(*rows.columns))


def first_of(segments: DataFrame, key: Sequence[Column], order: Sequence[Column | str]) -> DataFrame:
    """The first row of each video and key."""
    w = Window.partitionBy("video_id", *key).orderBy(*order)
    return segments.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def confidence_distribution(scores: DataFrame, score: str) -> DataFrame:
    c = F.col(score)
    return scores.groupBy("video_id").agg(
        F.count_if(c > 0.7).alias("high"), F.count_if((c >= 0.4) & (c <= 0.7)).alias("medium"), F.count_if(c < 0.4).alias("low"), F.avg(c).alias("mean"), F.min(c).alias("least"), F.max(c).alias("most")
    )


# Breaks and windows


def filtered_breaks(breaks: DataFrame, spans: DataFrame, preroll: DataFrame) -> DataFrame:
    """Breaks (video_id, ts, ...) after their video's preroll_end and in none of the spans (video_id, span_start, span_end) that begin before it; where none is left, the first one after it."""
    rows = breaks.join(preroll.select("video_id", "preroll_end"), "video_id", "left").where(F.col("ts") > F.coalesce("preroll_end", F.lit(0.0)))
    early = spans.join(preroll.select("video_id", "preroll_end"), "video_id").where(F.col("span_start") < F.col("preroll_end")).select("video_id", "span_start", "span_end")
    points = rows.select("video_id", "ts", F.col("ts").alias("_to")).distinct()
    inside = interval_join(points, early, ["video_id"], ("ts", "_to"), ("span_start", "span_end"), closed=True).select("video_id", "ts", F.lit(True).alias("_in")).distinct()
    marked = rows.join(inside, ["video_id", "ts"], "left").withColumn("_in", F.coalesce("_in", F.lit(False)))
    w = Window.partitionBy("video_id")
    marked = marked.withColumn("_none", F.min(F.col("_in").cast("int")).over(w) == 1).withColumn("_first", F.row_number().over(w.orderBy("ts", "type")) == 1)
    return marked.where(~F.col("_in") | (F.col("_none") & F.col("_first"))).select(*breaks.columns)


def break_points(breaks: DataFrame, silences: DataFrame, preroll: DataFrame) -> DataFrame:
    """(video_id, ts): distinct breaks after the preroll, and starts and ends of silences (silence_start, silence_end) that end after it, no start before it."""
    known = lambda df: df.join(preroll.select("video_id", "preroll_end"), "video_id", "left").withColumn("preroll_end", F.coalesce("preroll_end", F.lit(0.0)))
    points = known(breaks).where(F.col("ts") > F.col("preroll_end")).select("video_id", "ts")
    ends = known(silences).where(F.col("silence_end") > F.col("preroll_end")).select("video_id", F.explode(F.array(F.greatest("silence_start", "preroll_end"), F.col("silence_end"))).alias("ts"))
    return points.unionByName(ends).distinct()


def gated(segments: DataFrame, quality: float = 0.7, shortest: float = 60.0, longest: float = 120.0) -> DataFrame:
    """Segments good and long enough, with their place by engagement."""
    dur = F.col("seg_end") - F.col("seg_start")
    w = Window.partitionBy("video_id").orderBy(F.desc("engagement_score"), "segment_id")
    return segments.where((F.col("quality_score") >= quality) & (dur >= shortest) & (dur <= longest)).withColumn("place", F.row_number().over(w))


def fallback_windows(videos: DataFrame, length: float = 60.0, most: int = 10) -> DataFrame:
    """A video of 45 seconds or less as a whole; of a longer one windows that overlap by half, without ten seconds (or a twentieth) at either end, none below 15 seconds."""
    d = F.col("duration")
    margin = F.least(F.lit(10.0), d * 0.05)
    short = videos.where(d <= 45).select("video_id", F.lit(0.0).alias("seg_start"), F.greatest(F.lit(5.0), d - 0.1).alias("seg_end"))
    rows = videos.where(d > 45).select("video_id", margin.alias("m"), (d - margin).alias("limit"), F.explode(F.sequence(F.lit(0), F.lit(most - 1))).alias("i"))
    start = F.col("m") + F.col("i") * (length / 2)
    long = rows.where(start + 15 < F.col("limit")).select("video_id", start.alias("seg_start"), F.least(F.col("limit"), start + length).alias("seg_end"))
    return short.unionByName(long)


# What is seen together with what is said


def motion_level(mean: Column) -> Column:
    return F.when(mean > 0.7, "high").when(mean > 0.3, "medium").otherwise("low")


def visual_quality() -> Column:
    """Of has_faces, motion_level, scene_changes and face_count."""
    motion = F.when(F.col("motion_level") == "medium", 0.3).when(F.col("motion_level") == "high", 0.25).otherwise(0.2)
    steady = F.when(F.col("scene_changes") <= 2, 0.2).when(F.col("scene_changes") <= 5, 0.1).otherwise(0.0)
    return capped(bonus(F.col("has_faces"), 0.3) + motion + steady + bonus(F.col("face_count") >= 2, 0.1), 1.0)


def visual_content(segments: DataFrame, seen: DataFrame, width: float = 3600.0) -> DataFrame:
    """What is seen in each segment, ends included, from rows (video_id, pos, ts, face_id, motion, is_change), each of which tells one thing.

    The mean of motion adds up in the order of `pos`: it may equal the bound of a level but for the last bit of a sum, which depends on its order.
    `width` should be about the segments' length, as a segment is a row in each bucket that it touches.
    """
    points = seen.withColumn("_t", F.col("ts").cast("double")).withColumn("_to", F.col("_t")).drop("ts")
    met = interval_join(segments.select("video_id", "segment_id", "seg_start", "seg_end"), points, ["video_id"], ("seg_start", "seg_end"), ("_t", "_to"), width=width, closed=True)
    found = met.groupBy("video_id", "segment_id").agg(F.count_distinct("face_id").alias("face_count"), F.array_sort(F.collect_list(F.when(F.col("motion").isNotNull(), F.struct("pos", "motion")))).alias("_motions"), F.count_if("is_change").alias("scene_changes"))
    total = F.aggregate("_motions", F.lit(0.0), lambda a, x: a + x["motion"])
    found = found.withColumn("_motion", F.when(F.size("_motions") > 0, total / F.size("_motions"))).drop("_motions")
    rows = segments.select("video_id", "segment_id").join(found, ["video_id", "segment_id"], "left").fillna({"face_count": 0, "scene_changes": 0})
    rows = rows.withColumn("has_faces", F.col("face_count") > 0).withColumn("motion_level", motion_level(F.col("_motion"))).drop("_motion")
    return rows.withColumn("visual_quality", visual_quality())


def segment_quality() -> Column:
    """Of n_words, clarity, engaging, questions, emotional, duration and what `visual_content` gives."""
    n, dur = F.col("n_words"), F.col("duration")
    rate = n / (dur / 60)
    pace = F.when((rate >= 120) & (rate <= 180), 0.3).when((rate >= 100) & (rate <= 200), 0.2).otherwise(0.1)
    speech = F.when(n > 0, F.col("clarity") * 0.4 + pace + bonus(F.col("engaging") > 0, 0.2) + bonus(F.col("questions") > 0, 0.1)).otherwise(0.0)
    lively = bonus(F.col("emotional") > 0, 0.3) + bonus(F.col("has_faces"), 0.3) + bonus(F.col("motion_level") != "low", 0.2) + bonus(F.col("questions") > 0, 0.2)
    made = 0.5 + F.when((dur >= 20) & (dur <= 45), 0.3).when((dur >= 15) & (dur <= 60), 0.2).otherwise(0.0) + bonus(n > 10, 0.2)
    return capped(speech * 0.25 + F.col("visual_quality") * 0.25 + lively * 0.30 + made * 0.20, 1.0)


def segment_engagement() -> Column:
    """Of text, questions, emotional and what `visual_content` gives."""
    motion = F.when(F.col("motion_level") == "high", 0.1).when(F.col("motion_level") == "medium", 0.05).otherwise(0.0)
    score = (
        capped(hits(F.col("text"), ENERGY) * 0.1, 0.3) + capped(F.col("questions") * 0.1, 0.2) + capped(F.col("emotional") * 0.05, 0.2) + bonus(F.col("has_faces"), 0.15)
        + motion + bonus(F.col("face_count") >= 2, 0.1) + bonus(any_of(F.col("text"), PHRASES), 0.15)
    )
    return capped(score, 1.0)


def text_pull(text: Column) -> Column:
    score = capped(hits(text, TEXT_PULL) * 0.1, 0.3) + capped(occurrences(text, "?") * 0.1, 0.2) + capped(occurrences(text, "!") * 0.05, 0.1) + bonus(any_of(text, lx.DIRECT_ADDRESS), 0.2)
    return F.when(text == "", 0.0).otherwise(capped(score, 1.0))


def alignment() -> Column:
    """How well what is said (text) goes with what is seen (scene_type, has_people, has_action)."""
    text, scene = F.col("text"), F.col("scene_type")
    personal = any_of(text, PERSONAL)
    score = (
        0.5 + bonus(F.col("has_action") & any_of(text, SHOWN), 0.2) + bonus(F.col("has_people") & personal, 0.2) + bonus((scene == "demonstration") & any_of(text, STEPS), 0.2)
        - bonus((scene == "slides") & personal, 0.1)
    )
    return F.when(text == "", 0.3).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))


def recommendation(aligned: Column) -> Column:
    """Of visual_interest and engagement (0 to 10) and text."""
    visual = (F.col("visual_interest") + F.col("engagement")) / 2
    said = n_words(F.col("text")) > 5
    score = F.round((visual * 0.6 + text_pull(F.col("text")) * 5 * 0.4) * aligned, 6)
    return F.when((score >= 8) & said, "highly_recommended").when((score >= 6) & said, "recommended").when((score >= 4) | ((visual >= 6) & ~said), "consider").otherwise("not_recommended")


def visual_recommendation() -> Column:
    """Of visual_interest, engagement, scene_type, has_people, has_action and has_emotion."""
    interest, engagement, scene = (F.col(c) for c in ("visual_interest", "engagement", "scene_type"))
    good = F.when(F.col("has_emotion") | F.col("has_action"), "excellent_for_shorts").otherwise("good_for_shorts")
    fair = F.when(scene.isin("talking_head", "demonstration") & F.col("has_people"), "suitable_for_shorts").otherwise("consider_for_shorts")
    poor = F.when((scene == "slides") | ~F.col("has_people"), "poor_for_shorts").otherwise("marginal_for_shorts")
    return F.when((interest >= 7) & (engagement >= 7), good).when((interest >= 5) & (engagement >= 5), fair).otherwise(poor)


def with_first_vision(segments: DataFrame, vision: DataFrame, within: float = 5.0) -> DataFrame:
    """Segments (audio_score) with the first vision row, by pos, that starts less than `within` away, and combined: both scores, more if they go together."""
    reach = segments.select("video_id", "segment_id", (F.col("seg_start") - within).alias("_from"), (F.col("seg_start") + within).alias("_upto"))
    points = vision.select("video_id", "pos", F.col("start").alias("_at"), F.col("start").alias("_till"), "visual_score", "scene_type", "people_count", "alignment")
    met = interval_join(reach, points, ["video_id"], ("_from", "_upto"), ("_at", "_till"))
    first = met.groupBy("video_id", "segment_id").agg(F.min_by(F.struct("pos", "visual_score", "scene_type", "people_count", "alignment"), "pos").alias("v"))
    both = F.least(F.lit(1.0), (F.col("audio_score") * 0.6 + F.col("v.visual_score") * 0.4) * (1 + F.col("v.alignment") * 0.2))
    return segments.join(first, ["video_id", "segment_id"], "left").select(*segments.columns, F.col("v.pos").alias("vision_pos"), F.col("v.scene_type").alias("scene_type"), (F.col("v.people_count") > 0).alias("people_visible"), F.when(F.col("v").isNotNull(), both).alias("combined"))


def selection_report(segments: DataFrame) -> DataFrame:
    """What a run has made, by method: segments, videos and lengths."""
    dur = F.col("seg_end") - F.col("seg_start")
    return segments.groupBy("method").agg(F.count("*").alias("segments"), F.count_distinct("video_id").alias("videos"), F.sum(dur).alias("seconds"), F.min(dur).alias("shortest"), F.max(dur).alias("longest"))
