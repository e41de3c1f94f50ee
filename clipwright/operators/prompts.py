"""What a request's free text asks for, and how well segments answer it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clipwright.functions import lexicons as lx
from clipwright.functions.text import any_of, clip_engagement, hits, n_words, prepared, same_texts, segments_of, words


def is_climax_request(text: Column) -> Column:
    low = F.lower(text)
    score = hits(text, lx.CLIMAX_CLUES) * 0.5
    for phrase in lx.CLIMAX:
        parts = [w for w in phrase.split() if len(w) > 4] if " " in phrase else []
        score = score + (F.when(low.contains(phrase), 1.0).when(any_of(text, parts), 0.3).otherwise(0.0) if parts else F.when(low.contains(phrase), 1.0).otherwise(0.0))
    barred = any_of(text, lx.NOT_CLIMAX) | (any_of(text, lx.NOT_CLIMAX_UNLESS_PEAK) & ~low.contains("peak"))
    return ~barred & (F.round(score, 6) >= 1.2)


def is_comedy_request(text: Column) -> Column:
    return hits(text, lx.COMEDY_WORDS) + hits(text, lx.COMEDY_PHRASES) * 1.5 >= 1.0


def themes(text: Column) -> Column:
    """Structs (theme, confidence) of the themes above 0.1, in their order."""
    out = []
    for theme, (keywords, feelings, _) in lx.THEMES.items():
        k, f = keywords, feelings
        score = F.when(F.lower(text).contains(theme), 0.5).otherwise(0.0) + hits(text, k) / len(k) * 0.3 + hits(text, f) / len(f) * 0.2
        if theme == "comedy":
            score = score + F.when(is_comedy_request(text), 0.8).otherwise(0.0)
        out.append(F.struct(F.lit(theme).alias("theme"), F.round(score, 4).alias("confidence")))
    return F.filter(F.array(*out), lambda x: x["confidence"] > 0.1)


def primary_theme(found: Column) -> Column:
    best = F.array_max(F.transform(found, lambda x, i: F.struct(x["confidence"].alias("c"), (-i).alias("i"), x["theme"].alias("theme"))))
    return F.coalesce(best["theme"], F.lit("general"))


def analysed(prompts: DataFrame) -> DataFrame:
    """`prompts` (request_id, prompt) with theme, durations, counts and required content."""
    p = F.col("prompt")
    has = lambda *ws: any_of(p, list(ws))
    short, long = has("short", "brief", "quick"), has("long", "extended", "detailed")
    few, many = has("few", "couple", "some"), has("many", "several", "multiple")
    silent = has("silent", "quiet", "no speech", "visual only")
    return prompts.withColumn("themes", themes(p)).select(
        *prompts.columns,
        "themes",
        primary_theme(F.col("themes")).alias("theme"),
        is_climax_request(p).alias("climax"),
        is_comedy_request(p).alias("comedy"),
        F.when(~short & long, 45).otherwise(15).alias("min_duration"),
        F.when(short, 30).when(long, 120).otherwise(60).alias("max_duration"),
        F.when(~few & many, 7).otherwise(3).alias("min_count"),
        F.when(few, 5).when(many, 15).otherwise(10).alias("max_count"),
        (~silent).alias("needs_speech"),
        has("visual", "see", "show", "watch", "look").alias("needs_visuals"),
        has("people", "person", "speaker", "presenter").alias("needs_people"),
        has("action", "movement", "demo", "demonstrate").alias("needs_action"),
    )


def focus_tokens(text: Column) -> Column:
    """Rates, sizes with units, resolutions, components and model numbers, of three characters or more."""
    low = F.lower(text)
    every = lambda x, pattern, group=1: F.regexp_extract_all(x, F.lit(pattern), F.lit(group))
    # fixed values: the rates, units and resolutions that count
    rates = F.transform(every(low, r"\b(60|75|90|100|120|144|150|165|170|180|200|240|300|360)\s*-?\s*(?:hz|hertz)\b"), lambda x: F.concat(x, F.lit("hz")))
    refresh = F.when(any_of(text, lx.HIGH_REFRESH), F.array(F.lit("high_refresh"))).otherwise(F.array().cast("array<string>"))
    sizes = F.transform(every(low, r"\b(\d+[\d.,]*\s?(?:mah|gb|g|w|nm|fps|nit|nits|inch|in|mm|ghz|khz|mhz|k|kwh|%|mp))\b"), lambda x: F.regexp_replace(x, "[\\s,]", ""))
    parts = F.filter(F.array(*[F.when(low.contains(c), F.lit(c)) for c in lx.COMPONENTS]), lambda x: x.isNotNull())
    models = F.transform(every(text, r"\b([a-zA-Z]+\d+[a-zA-Z\d]*)\b"), F.lower)
    found = F.concat(rates, refresh, sizes, every(low, r"\b(4k|8k|2k|1080p|1440p|2160p|720p)\b"), parts, models)
    return F.array_sort(F.array_distinct(F.filter(found, lambda t: (F.length(t) >= 3) & ~t.isin(*lx.FOCUS_STOP))))


def intent_keywords(text: Column) -> Column:
    """The words of every intent that is touched on, and the prompt's own words of over three letters; sorted, distinct."""
    none = F.array().cast("array<string>")
    groups = [F.when(any_of(text, ws), F.array(*[F.lit(w) for w in ws])).otherwise(none) for ws in lx.INTENTS.values()]
    own = F.transform(F.filter(words(F.lower(text)), lambda w: F.length(w) > 3), lambda w: F.regexp_replace(w, "^[.,?!]+|[.,?!]+$", ""))
    return F.array_sort(F.array_distinct(F.concat(*groups, own)))


def mentioned(prompts: DataFrame, entities: DataFrame) -> DataFrame:
    """(request_id, entity) of the entities (entity) that a prompt names in full or by any of its words.

    Each word of a prompt is looked up among the words of the names, so that prompts don't meet all
    entities; a name's word counts as one of the prompt's only if it stands there as a word.
    """
    signs = "^\\p{Punct}+|\\p{Punct}+$"
    said = prompts.select("request_id", F.explode(F.array_distinct(F.transform(words(F.lower("prompt")), lambda w: F.regexp_replace(w, signs, "")))).alias("_w"))
    names = entities.select("entity", F.explode(F.array_distinct(words(F.lower("entity")))).alias("_w"))
    return said.join(names, "_w").select("request_id", "entity").distinct()


def heuristic_scores(segments: DataFrame) -> DataFrame:
    """Score of segments (text, seg_start, seg_end, keywords, and `stop`, the video's end) against a prompt's keywords."""
    texts, text = prepared(same_texts(segments, "video_id", "keywords"), dealt=True)
    found = F.size(F.filter("keywords", lambda k: text.low.contains(k)))
    texts = texts.withColumn("_found", found).withColumn("_words", n_words(text.raw)).withColumn("_engagement", clip_engagement(text)).drop("_low", "_pieces")
    rows = segments_of(texts, "_found", "_words", "_engagement")
    dur = F.col("seg_end") - F.col("seg_start")
    match = F.when(F.size("keywords") > 0, F.least(F.lit(1.0), F.col("_found") / F.size("keywords") * 2)).otherwise(0.5)
    length = F.when((dur >= 15) & (dur <= 45), 1.0).when(((dur >= 10) & (dur < 15)) | ((dur > 45) & (dur <= 60)), 0.8).when(((dur >= 5) & (dur < 10)) | ((dur > 60) & (dur <= 90)), 0.5).otherwise(0.2)
    rate = F.col("_words") / F.greatest(dur, F.lit(1.0))
    density = F.when(F.col("text") == "", 0.3).when((rate >= 1.5) & (rate <= 3.5), 1.0).when((rate >= 1) & (rate <= 5), 0.7).otherwise(0.4)
    place = F.col("seg_start") / F.col("stop")
    position = F.when(place <= 0.1, 0.8).when(place >= 0.85, 0.9).when((place >= 0.4) & (place <= 0.6), 0.7).otherwise(0.5)
    score = match * 0.3 + 0.6 * 0.2 + length * 0.15 + density * 0.15 + position * 0.1 + F.col("_engagement") * 0.2
    return rows.select(*segments.columns, F.round(F.least(F.lit(1.0), score), 6).alias("heuristic"))


def dynamic_threshold(scores: DataFrame) -> DataFrame:
    """(request_id, threshold): how high a score (request_id, matches, score) has to be, from the most matches and the mean score of rows with any."""
    with_any = F.when(F.col("matches") > 0, F.col("score"))
    found = scores.groupBy("request_id").agg(F.max("matches").alias("m"), F.avg(with_any).alias("a"))
    level = F.when(F.col("m") >= 3, 0.3).when(F.col("m") >= 2, 0.4).when((F.col("m") >= 1) & (F.col("a") >= 0.25), 0.45).when(F.col("m") >= 1, 0.55).otherwise(0.6)
    return found.select("request_id", level.alias("threshold"))


def best_matches(scores: DataFrame, most: int = 5, least: int = 3, strict: float = 0.3, loose: float = 0.1) -> DataFrame:
    """Rows (request_id, segment_id, score) at `strict` or above, or at `loose` where fewer than `least` are; the best `most`."""
    w = Window.partitionBy("request_id")
    enough = F.sum((F.col("score") >= strict).cast("int")).over(w) >= least
    rows = scores.withColumn("_least", F.when(enough, strict).otherwise(loose)).where(F.col("score") >= F.col("_least"))
    return rows.withColumn("place", F.row_number().over(w.orderBy(F.desc("score"), "segment_id"))).where(F.col("place") <= most).drop("_least")
