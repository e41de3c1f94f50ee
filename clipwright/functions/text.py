"""Text scores and labels as column expressions."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipwright.functions import lexicons as lx


def words(text: Column) -> Column:
    """Pieces between white space; none for null or blank text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\\s+"), lambda w: w != "")


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("\\S+")).cast("long")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, "^\\s+|\\s+$", "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)`, with `value` computed once however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


@dataclass(frozen=True)
class Text:
    """A text with what the word scores look at: itself in lower case, its distinct pieces between white space, and how many words it has where that is known."""

    raw: Column
    low: Column
    pieces: Column
    n: Column | None = None

    def n_words(self) -> Column:
        return n_words(self.raw) if self.n is None else self.n


def spread(df: DataFrame) -> DataFrame:
    """`df`, dealt anew where it would be fewer tasks than there are cores, as a file of one row group is; larger tables stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def prepared(df: DataFrame, column: str = "text", dealt: bool = False) -> tuple[DataFrame, Text]:
    """`df` with the columns that a `Text` of `column` needs, _low and _pieces, so that each is made once for all scores.

    `dealt` says that `df` comes from a shuffle and needs no `spread`, which would run that to count its partitions.
    """
    rows = (df if dealt else spread(df)).withColumn("_low", F.lower(F.coalesce(column, F.lit(""))))
    rows = rows.withColumn("_pieces", F.array_join(F.array_distinct(F.split("_low", "\\s+")), " "))
    return rows, Text(F.col(column), F.col("_low"), F.col("_pieces"))


#: What is noted of lines, see `line_notes`.
NOTES = ["_found", "_words", "_parts"]


def _clip_words() -> list[str]:
    """The words without white space that the clip scores look for."""
    lists = [lx.CLIP_ENGAGEMENT, lx.CLIP_PRACTICE, lx.CLIP_INSTRUCTION, lx.CLIP_ADDRESS, lx.CLIP_BREATH, lx.CLIP_MOVEMENT, lx.POSE, YOGA_BREATHING, YOGA_MOVEMENT, *lx.CLIP_TYPES.values()]
    return list(dict.fromkeys(w for ws in lists for w in ws if not any(c.isspace() for c in w)))


def line_notes(text: Column) -> list[Column]:
    """What the clip scores need of a line: its words of their lexicons (_found), how many words it has (_words), and how many with points as spaces (_parts).

    Windows around a line hold the same lines, so lines are looked at once instead of the text of each window: a word
    without white space is in lines joined by spaces if and only if it is in one of them, and numbers of words add up.
    """
    known = F.array(*[F.lit(w) for w in _clip_words()])
    found = let(F.lower(text), lambda low: F.filter(known, lambda w: low.contains(w)))
    return [found.alias("_found"), n_words(text).alias("_words"), n_words(F.replace(text, F.lit("."), F.lit(" "))).alias("_parts")]


def noted(df: DataFrame, column: str = "text") -> tuple[DataFrame, Text]:
    """As `prepared`, for texts that come with the notes of their lines."""
    # a known word is in the known words found, joined, if and only if it is in the text
    rows = df.withColumn("_low", F.lower(column)).withColumn("_pieces", F.array_join("_found", " "))
    return rows, Text(F.col(column), F.col("_low"), F.col("_pieces"), F.col("_words"))


def same_texts(segments: DataFrame, *by: str, width: float = 600.0) -> DataFrame:
    """Segments (`by`, seg_start, text, ...) with one row for those of equal `by` and text, so that a text is looked at once; `segments_of` has them back.

    Windows around a line often hold the same lines. Rows are gathered by `width` seconds, so that a long video of equal texts is many rows.
    """
    others = [c for c in segments.columns if c not in (*by, "text")]
    return segments.groupBy(*by, "text", F.floor(F.col("seg_start") / width).alias("_part")).agg(F.collect_list(F.struct(*others)).alias("_rows")).drop("_part")


def segments_of(texts: DataFrame, *columns: str) -> DataFrame:
    """The segments that `same_texts` has gathered, with the `columns` that were added to their texts."""
    rows = texts.select("*", F.explode("_rows").alias("_row"))
    own = [c for c in texts.columns if c != "_rows" and c not in columns]
    return rows.select(*own, "_row.*", *columns)


def raw(text: Column | Text) -> Column:
    return text.raw if isinstance(text, Text) else text


def _each(text: Column | Text, lexicon: Sequence[str], look: Callable[[Column, Column], Column], join: Callable[[Column, Column], Column]) -> Column:
    """`look(part, words)` for the words of the lexicon and the part of the text to look in, as arrays: an expression for each word makes methods that are too long for the JVM to compile."""
    array = lambda ws: F.array(*[F.lit(w) for w in ws])
    if isinstance(text, Text):
        # a word without white space is in the text if and only if it is in one of its pieces
        phrases = [w for w in lexicon if any(c.isspace() for c in w)]
        plain = [w for w in lexicon if w not in phrases]
        found = [look(part, array(ws)) for part, ws in ((text.pieces, plain), (text.low, phrases)) if ws]
        return reduce(join, found)
    return let(F.lower(F.coalesce(text, F.lit(""))), lambda low: look(low, array(lexicon)))


def hits(text: Column | Text, lexicon: Sequence[str]) -> Column:
    """How many words of the lexicon occur in the lower-cased text."""
    return _each(text, lexicon, lambda part, ws: F.size(F.filter(ws, lambda w: part.contains(w))), lambda a, b: a + b)


def any_of(text: Column | Text, lexicon: Sequence[str]) -> Column:
    return _each(text, lexicon, lambda part, ws: F.exists(ws, lambda w: part.contains(w)), lambda a, b: a | b)


def occurrences(text: Column, sign: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(sign), F.lit("")))


def token_hits(text: Column, lexicon: Sequence[str]) -> Column:
    """Words of the lower-cased text that are in the lexicon, in order, repeats kept."""
    return F.filter(words(F.lower(text)), lambda w: w.isin(*lexicon))


def capped(x: Column, most: float) -> Column:
    return F.least(x.cast("double"), F.lit(float(most)))


def _open_end(text: Column) -> Column:
    return text.endswith("...") | text.endswith("-") | text.endswith(",")


def segment_text_quality(text: Column) -> Column:
    """Length, sentences, engaging words and a finished end: 0 to 1."""
    n = n_words(text)
    score = (
        F.when((n >= 5) & (n <= 50), 0.3).when(n > 0, 0.1).otherwise(0.0)
        + F.when(text.rlike("[.!?]"), 0.3).otherwise(0.0)
        + capped(hits(text, lx.TEXT_ENGAGEMENT) * 0.1, 0.2)
        + F.when(_open_end(text), 0.0).otherwise(0.2)
    )
    return F.when(F.coalesce(text, F.lit("")) == "", 0.0).otherwise(capped(score, 1.0))


def clip_text_quality(text: Column | Text) -> Column:
    score = lambda n: (
        F.when((n >= 10) & (n <= 100), 0.3).when(n >= 5, 0.1).otherwise(0.0)
        + F.when(raw(text).rlike("[^.\\s]"), 0.2).otherwise(0.0)
        + F.when(_open_end(raw(text)), 0.0).otherwise(0.1)
        + F.when(raw(text).rlike("[?!]"), 0.1).otherwise(0.0)
    )
    n = text.n_words() if isinstance(text, Text) else n_words(text)
    return F.when(F.coalesce(raw(text), F.lit("")) == "", 0.0).otherwise(let(n, score))


YOGA_BREATHING = ["breathe", "inhale", "exhale", "hold"]
YOGA_MOVEMENT = ["move", "flow", "transition"]


def clip_engagement(text: Column | Text) -> Column:
    score = (
        capped(hits(text, lx.CLIP_ENGAGEMENT) * 0.05, 0.2)
        + capped(hits(text, lx.CLIP_PRACTICE) * 0.08, 0.3)
        + capped(hits(text, lx.CLIP_INSTRUCTION) * 0.06, 0.2)
        + capped(occurrences(raw(text), "?") * 0.08, 0.15)
        + capped(occurrences(raw(text), "!") * 0.05, 0.1)
        + F.when(any_of(text, lx.CLIP_ADDRESS), 0.15).otherwise(0.0)
        + F.when(any_of(text, lx.CLIP_BREATH), 0.1).otherwise(0.0)
        + F.when(any_of(text, lx.CLIP_MOVEMENT), 0.1).otherwise(0.0)
    )
    return F.when(F.coalesce(raw(text), F.lit("")) == "", 0.0).otherwise(capped(score, 1.0))


def clip_type(text: Column | Text) -> Column:
    pose = any_of(text, lx.POSE)
    out = (
        F.when(F.coalesce(raw(text), F.lit("")) == "", "general")
        .when(pose & any_of(text, YOGA_BREATHING), "yoga_breathing")
        .when(pose & any_of(text, YOGA_MOVEMENT), "yoga_movement")
        .when(pose, "yoga_instruction")
    )
    for label, lexicon in lx.CLIP_TYPES.items():
        rule = any_of(text, lexicon)
        out = out.when(rule | raw(text).contains("?") if label == "interactive" else rule, label)
    return out.otherwise("instruction")


def speech_type(text: Column | Text) -> Column:
    out = F.when(raw(text).contains("?"), "question")
    for label, lexicon in lx.SPEECH_TYPES.items():
        out = out.when(any_of(text, lexicon), label)
    return out.otherwise("general")


def best_label(text: Column | Text, groups: dict[str, Sequence[str]], default: str) -> Column:
    """The group with most hits; the first of equal ones; `default` without any."""
    scored = F.array(*[F.struct(hits(text, lexicon).alias("n"), F.lit(-i).alias("first"), F.lit(label).alias("label")) for i, (label, lexicon) in enumerate(groups.items())])
    return let(F.array_max(scored), lambda best: F.when(best["n"] > 0, best["label"]).otherwise(default))


def emotional_intensity(text: Column | Text) -> Column:
    n = n_words(raw(text))
    score = hits(text, lx.EMOTION["high"]) * 1.0 + hits(text, lx.EMOTION["medium"]) * 0.5 + hits(text, lx.EMOTION["low"]) * 0.1
    score = score + occurrences(raw(text), "!") * 0.2 + occurrences(raw(text), "?") * 0.1
    return F.when(n > 0, capped(score / n, 1.0)).otherwise(0.0)


def music_pattern(text: Column) -> Column:
    """A music marker, or one word of more than two letters over three times in a text of more than eight."""
    low = words(F.lower(text))
    often = F.exists(F.array_distinct(low), lambda w: (F.length(w) > 2) & (F.size(F.filter(low, lambda x: x == w)) > 3))
    return any_of(text, lx.MUSIC) | ((F.size(low) > 8) & often)


def theme_score(text: Column, theme: str) -> Column:
    keywords, feelings, patterns = lx.THEMES[theme]
    found = sum((any_of(text, p.split()).cast("int") for p in patterns), F.lit(0))
    score = hits(text, keywords) / len(keywords) * 0.5 + hits(text, feelings) / len(feelings) * 0.3 + found / len(patterns) * 0.2
    return F.when(F.coalesce(text, F.lit("")) == "", 0.0).otherwise(capped(score, 1.0))


def viral_potential(text: Column | Text, has_faces: Column | None = None, high_motion: Column | None = None) -> Column:
    flag = lambda c: F.lit(0.0) if c is None else F.when(c, 0.05).otherwise(0.0)
    feeling = capped(hits(text, lx.FEELINGS) * 0.2, 1.0)
    score = (
        capped(hits(text, lx.VIRAL) * 0.1, 0.3)
        + capped(hits(text, lx.HOOKS) * 0.1, 0.2)
        + capped(feeling * 0.15, 0.15)
        + capped(occurrences(raw(text), "?") * 0.05, 0.1)
        + capped(hits(text, lx.URGENCY) * 0.05, 0.1)
        + capped(hits(text, lx.SOCIAL_PROOF) * 0.05, 0.1)
        + flag(has_faces)
        + flag(high_motion)
    )
    return capped(score, 1.0)


def optimization_score(text: Column | Text, viral: Column, duration: Column, quality: Column) -> Column:
    content = (
        capped(hits(text, lx.VIRAL) * 0.1, 0.3)
        + capped(hits(text, lx.HOOKS) * 0.15, 0.3)
        + capped(capped(hits(text, lx.FEELINGS) * 0.2, 1.0), 0.2)
        + capped(hits(text, lx.ACTIONS) * 0.1, 0.2)
    )
    length = F.when((duration >= 15) & (duration <= 30), 1.0).when((duration >= 30) & (duration <= 45), 0.8).when((duration >= 45) & (duration <= 60), 0.6).otherwise(0.3)
    return quality * 0.4 + viral * 0.3 + content * 0.2 + length * 0.1


def audience(text: Column | Text) -> Column:
    def of_category(category: Column) -> Column:
        out = F.when(F.lit(False), "general")
        for label, target in lx.CATEGORY_AUDIENCE.items():
            out = out.when(category == label, target)
        return out.otherwise("general")

    out = F.when(F.lit(False), "general")
    for label, lexicon in lx.AUDIENCES.items():
        out = out.when(any_of(text, lexicon), label)
    return out.otherwise(let(best_label(text, lx.CATEGORIES, "general"), of_category))


def start_quality(text: Column, sentence_start: Column, pause_before: Column) -> Column:
    """How well a clip may begin with this line, 0 to 1."""
    first = F.coalesce(F.try_element_at(words(F.lower(text)), F.lit(1)), F.lit(""))
    score = (
        F.lit(0.5)
        - F.when(first.isin(*lx.CONTINUATION), 0.4).otherwise(0.0)
        + F.when(first.isin(*lx.OPENERS), 0.3).otherwise(0.0)
        + F.when(sentence_start, 0.3).otherwise(0.0)
        + F.when(first.isin(*lx.QUESTION_WORDS), 0.2).otherwise(0.0)
        + F.when(pause_before, 0.2).otherwise(0.0)
        - F.when(text.rlike("^\\p{Ll}"), 0.2).otherwise(0.0)
    )
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def end_quality(text: Column) -> Column:
    """How well a clip may end with this line, 0 to 1."""
    score = (
        F.lit(0.5)
        + F.when(text.rlike("[.!?]$"), 0.4).when(text.rlike("(,|;|:|--|—)$"), 0.2).otherwise(0.0)
        - F.when(F.lower(text).rlike(lx.INCOMPLETE), 0.4).otherwise(0.0)
        - F.when(n_words(text) < 3, 0.2).otherwise(0.0)
        + F.when(any_of(text, lx.CLOSING), 0.1).otherwise(0.0)
    )
    return F.when(F.coalesce(text, F.lit("")) == "", 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))


def flow_quality(text: Column) -> Column:
    def of(text: Column) -> Column:
        first = F.coalesce(F.try_element_at(words(F.lower(text)), F.lit(1)), F.lit(""))
        sentences = F.size(F.filter(F.split(text, "[.!?]"), lambda s: s.rlike("\\S")))
        length = let(n_words(text), lambda n: F.when((n >= 20) & (n <= 150), 0.25).when((n >= 10) & (n <= 200), 0.15).otherwise(0.0))
        score = (
            F.when(~first.isin(*lx.CONTINUATION) & text.rlike("^\\p{Lu}"), 0.25).otherwise(0.0)
            + F.when(text.rlike("[.!?]$"), 0.25).otherwise(0.0)
            + let(sentences, lambda n: F.when(n >= 2, 0.25).when(n >= 1, 0.15).otherwise(0.0))
            + length
        )
        label = let(score, lambda x: F.when(x >= 0.8, "excellent").when(x >= 0.6, "good").when(x >= 0.4, "acceptable").otherwise("poor"))
        return F.when(F.coalesce(text, F.lit("")) == "", "poor").otherwise(label)

    return let(strip(text), of)


def sentences(text: Column, chunk: int = 50) -> Column:
    """Pieces between sentence ends; runs of `chunk` words where there is nothing between them."""
    pieces = F.filter(F.transform(F.split(text, "[.!?]+"), strip), lambda s: s != "")
    w = words(text)
    runs = F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.size(w) - 1) / chunk), F.lit(0)).cast("int")), lambda i: F.array_join(F.slice(w, i * chunk + 1, F.lit(chunk)), " "))
    return F.when(F.size(pieces) > 0, pieces).otherwise(F.when(F.size(w) > 0, runs).otherwise(F.array().cast("array<string>")))


def wrapped_caption(text: Column, width: int = 40) -> Column:
    """White space squeezed; longer than `width`: broken at words into two lines at most, then `...`."""
    flat = F.regexp_replace(strip(text), "\\s+", " ")

    def put(state: Column, word: Column) -> Column:
        fits = state["n"] + F.length(word) + 1 <= width
        started = state["line"] != ""
        return F.struct(
            F.when(~fits & started, F.array_append(state["lines"], state["line"])).otherwise(state["lines"]).alias("lines"),
            F.when(fits & started, F.concat(state["line"], F.lit(" "), word)).otherwise(word).alias("line"),
            F.when(fits, state["n"] + F.length(word) + 1).otherwise(F.length(word)).alias("n"),
        )

    zero = F.struct(F.array().cast("array<string>").alias("lines"), F.lit("").alias("line"), F.lit(0).alias("n"))
    lines = F.aggregate(F.split(flat, " "), zero, put, lambda s: F.array_append(s["lines"], s["line"]))
    two = F.concat(F.element_at(lines, 1), F.lit("\n"), F.element_at(lines, 2), F.lit("..."))
    return F.when(F.length(flat) <= width, flat).when(F.size(lines) > 2, two).otherwise(F.array_join(lines, "\n"))


def srt_time(seconds: Column) -> Column:
    ms = F.floor((seconds - F.floor(seconds)) * 1000)
    whole = F.floor(seconds)
    return F.format_string("%02d:%02d:%02d,%03d", F.floor(whole / 3600), F.floor(whole % 3600 / 60), whole % 60, ms)
