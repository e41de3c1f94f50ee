"""Titles, highlights and tags of texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipwright.functions import lexicons as lx
from clipwright.functions.text import any_of, best_label, capped, hits, let, n_words, occurrences, prepared, strip, words


def long_sentences(text: Column) -> Column:
    """Trimmed pieces between full stops, of more than ten characters."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\\."), strip), lambda s: F.length(s) > 10)


def highlights(text: Column) -> Column:
    """Sentences with viral words, two with question marks, two with strong feelings: five distinct ones at most."""
    pieces = long_sentences(text)
    viral = F.filter(pieces, lambda s: any_of(s, lx.VIRAL))
    asked = F.slice(F.filter(pieces, lambda s: s.contains("?")), 1, 2)
    felt = F.slice(F.filter(pieces, lambda s: any_of(s, lx.HIGHLIGHT_EMOTIONS)), 1, 2)
    return F.slice(F.array_distinct(F.concat(viral, asked, felt)), 1, 5)


def key_phrases(text: Column) -> Column:
    """The three sentences with the most viral (2) and action (1) words, those with none left out."""
    scored = F.transform(long_sentences(text), lambda s, i: F.struct((-(hits(s, lx.VIRAL) * 2 + hits(s, lx.PHRASE_ACTIONS))).alias("score"), i.alias("i"), s.alias("s")))
    return F.transform(F.slice(F.array_sort(F.filter(scored, lambda x: x["score"] < 0)), 1, 3), lambda x: x["s"])


def _short(text: Column) -> Column:
    return F.concat(F.substring(text, 1, 50), F.when(F.length(text) > 50, "...").otherwise(""))


def best_phrase(text: Column) -> Column:
    """The first of `key_phrases`: only sentences with one of the words are trimmed and measured."""
    scored = F.transform(F.split(F.coalesce(text, F.lit("")), "\\."), lambda s, i: F.struct((-(hits(s, lx.VIRAL) * 2 + hits(s, lx.PHRASE_ACTIONS))).alias("score"), i.alias("i"), s.alias("s")))
    return strip(F.array_min(F.filter(scored, lambda x: (x["score"] < 0) & (F.length(strip(x["s"])) > 10)))["s"])


def first_question(text: Column) -> Column:
    return strip(F.try_element_at(F.filter(F.split(text, "\\."), lambda s: s.contains("?")), F.lit(1)))


def _title(viral: Column, phrase: Column, asked: Column, category: Column) -> Column:
    out = F.when(viral & phrase.isNotNull(), F.concat(F.lit("This Will Blow Your Mind: "), phrase)).when(asked.isNotNull(), _short(asked))
    for name, pattern in lx.TITLE_PATTERNS.items():
        out = out.when((category == name) & phrase.isNotNull(), F.format_string(pattern, phrase))
    return out.when(phrase.isNotNull(), _short(phrase)).otherwise("Amazing Short Video")


def _tags(text: Column, viral: Column, feelings: Column, category: Column) -> Column:
    arrays = lambda ws: F.array(*[F.lit(w) for w in ws])
    own = arrays(["general", "content"])
    for name, names in lx.CATEGORY_TAGS.items():
        own = F.when(category == name, arrays(names)).otherwise(own)
    none = F.array().cast("array<string>")
    parts = [
        own,
        F.when(viral, arrays(["viral", "trending", "amazing", "mustwatch"])).otherwise(none),
        F.when(text.contains("?"), arrays(["interactive"])).otherwise(none),
        F.when(capped(feelings * 0.2, 1.0) > 0.5, arrays(["emotional"])).otherwise(none),
        arrays(["shorts", "short", "quickwatch", "vertical"]),
    ]
    return F.slice(F.array_distinct(F.concat(*parts)), 1, 10)


def title(text: Column) -> Column:
    """A title from the best phrase, a question, or the category's pattern."""
    return _title(hits(text, lx.VIRAL) > 0, best_phrase(text), first_question(text), best_label(text, lx.CATEGORIES, "general"))


def tags(text: Column) -> Column:
    """Ten distinct tags at most: of the category, of what the text has, and general ones."""
    return _tags(text, hits(text, lx.VIRAL) > 0, hits(text, lx.FEELINGS), best_label(text, lx.CATEGORIES, "general"))


def titled(df: DataFrame) -> DataFrame:
    """`df` with the `title` and `tags` of its text, for which each text is looked at once: an expression names its category and phrase once for each pattern."""
    rows, text = prepared(df)
    rows = rows.withColumns({
        "_viral": any_of(text, lx.VIRAL), "_feelings": hits(text, lx.FEELINGS), "_category": best_label(text, lx.CATEGORIES, "general"), "_asked": first_question(text.raw),
        "_phrase": F.when(any_of(text, [*lx.VIRAL, *lx.PHRASE_ACTIONS]), best_phrase(text.raw)),
    })
    title = _title(F.col("_viral"), F.col("_phrase"), F.col("_asked"), F.col("_category"))
    return rows.select(*df.columns, title.alias("title"), _tags(text.raw, F.col("_viral"), F.col("_feelings"), F.col("_category")).alias("tags"))


def hashtags(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit("#(\\w+)"), F.lit(1)), F.lower))


def clean_filename(path: Column) -> Column:
    """A file's stem as words with capitals, without resolutions and formats."""
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), "\\.[^.]*$", "")
    plain = F.regexp_replace(F.regexp_replace(stem, "[_\\-.]", " "), "(?i)\\b(720p|1080p|4k|hd|sd|mp4|avi|mov)\\b", "")
    return F.initcap(strip(F.regexp_replace(plain, "\\s+", " ")))


def fallback_title(filename: Column, text: Column, seconds: Column) -> Column:
    """The first five words, fifty characters at most, or the file's name and length."""
    # five words are among the first six pieces, of which the first may be empty; the seventh is the rest
    first = F.array_join(F.slice(F.filter(F.split(F.coalesce(text, F.lit("")), "\\s+", 7), lambda w: w != ""), 1, 5), " ")
    short = F.when(F.length(first) > 50, F.concat(F.substring(first, 1, 47), F.lit("..."))).otherwise(first)
    return F.when(F.length(text) > 20, short).otherwise(F.concat(filename, F.lit(" - "), seconds.cast("string"), F.lit("s Clip")))


def excerpt(text: Column) -> Column:
    """Over 500 characters and 80 words: the first and last forty."""
    flat = strip(F.regexp_replace(text, "\\s+", " "))
    w = words(flat)
    cut = F.concat(F.array_join(F.slice(w, 1, 40), " "), F.lit(" ... "), F.array_join(F.slice(w, -40, 40), " "))
    return F.when((F.length(flat) > 500) & (F.size(w) > 80), cut).otherwise(flat)


def cleaned_reply(text: Column) -> Column:
    """A generated text out of its JSON wrapper, quotes, label and marks."""
    keys = ["title", "description", "response", "content", "text", "message"]
    wrapped = F.coalesce(*[F.get_json_object(text, f"$.{k}") for k in keys])
    inner = F.when(strip(text).startswith("{"), F.coalesce(wrapped, text)).otherwise(text)
    inner = F.regexp_replace(inner, "^[\"']+|[\"']+$", "")
    inner = F.regexp_replace(inner, "(?i)^(title:|description:)\\s*", "")
    return strip(F.regexp_replace(F.regexp_replace(inner, "^[*_`]+|[*_`]+$", ""), "\\s+", " "))


# Words of file names and texts that tell what a video is.
NAMES = {"educational": ["tutorial", "lesson", "course", "guide", "how"], "entertainment": ["funny", "comedy", "entertainment", "fun"]}
KIND_WORDS = {
    "educational": ["learn", "tutorial", "how to", "explain", "lesson", "course", "teach", "education", "study", "guide", "training", "tip", "technique", "method", "process", "step", "instruction"],
    "entertainment": ["funny", "laugh", "comedy", "joke", "entertainment", "fun", "amazing", "incredible", "wow", "cool", "awesome", "epic", "hilarious", "crazy", "wild", "unbelievable", "shocking"],
}


def video_kind(name: Column, text: Column) -> Column:
    """By the file's name, else by which words the text has more of, three at least."""
    taught, fun = hits(text, KIND_WORDS["educational"]), hits(text, KIND_WORDS["entertainment"])
    named = F.when(any_of(name, NAMES["educational"]), "educational").when(any_of(name, NAMES["entertainment"]), "entertainment")
    return named.when((taught > fun) & (taught > 2), "educational").when(fun > 2, "entertainment").otherwise("social_media")


def emphasis_level(text: Column) -> Column:
    """Words of emphasis and words in capitals as shares of the words, and exclamation and question marks of the characters; 1 at most."""
    loud = lambda w: (F.upper(w) == w) & (F.lower(w) != w)
    score = let(words(text), lambda ws: (F.size(F.filter(ws, lambda w: w.isin(*lx.EMPHASIS_TOKENS))) + F.size(F.filter(ws, loud))) / F.size(ws))
    signs = (occurrences(text, "!") + occurrences(text, "?")) / F.length(text)
    return F.when(n_words(text) > 0, F.least(F.lit(1.0), score + signs)).otherwise(0.0)


def text_transform(text: Column, how: str) -> Column:
    """`uppercase`, `lowercase`, `capitalize` (the first letter, the others small), or as it is."""
    capital = F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substr(text, F.lit(2))))
    return {"uppercase": F.upper(text), "lowercase": F.lower(text), "capitalize": capital}.get(how, text)


def frame_seconds(frame: Column, fps: Column) -> Column:
    """The time of a frame counted from 1."""
    return (frame - 1) / fps


def clock(seconds: Column) -> Column:
    """HH:MM:SS"""
    whole = F.floor(seconds)
    return F.format_string("%02d:%02d:%02d", F.floor(whole / 3600), F.floor(whole % 3600 / 60), whole % 60)


def technical_notes(emotion: Column, questions: Column, urgency: Column, viral: Column, has_faces: Column, motion: Column, duration: Column) -> Column:
    """Advice by thresholds: a struct of arrays."""
    some = lambda *rules: F.filter(F.array(*[F.when(rule, F.lit(note)) for rule, note in rules]), lambda x: x.isNotNull())
    always = F.lit(True)
    return F.struct(
        some((emotion > 0.7, "Add dynamic cuts during emotional peaks"), (questions > 0, "Pause briefly after questions for impact")).alias("recommended_edits"),
        some((always, "Ensure clear speech throughout"), (urgency > 0, "Consider faster pacing for urgency")).alias("audio_recommendations"),
        some((has_faces, "Ensure faces are clearly visible"), (motion == "low", "Consider adding motion or zoom effects")).alias("visual_recommendations"),
        some((duration > 45, "Consider faster pacing or cutting content"), (duration < 20, "Could expand with additional context")).alias("pacing_notes"),
        some((viral == 0, "Consider adding hook words or phrases"), (questions == 0, "Add rhetorical questions to engage viewers")).alias("engagement_tips"),
    )
