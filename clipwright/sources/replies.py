"""Stored model replies: JSON out of prose, fences and broken text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEMA = "segments array<struct<segment_index:int,relevance_score:double,engagement_score:double,overall_score:double,recommended:boolean,reasoning:string>>"


def _segments(text: Column) -> Column:
    return F.from_json(text, SCHEMA)["segments"]


def repaired(text: Column) -> Column:
    """Trailing commas dropped, bare keys quoted, single quotes made double."""
    text = F.regexp_replace(F.regexp_replace(text, ",\\s*\\}", "}"), ",\\s*\\]", "]")
    return F.replace(F.regexp_replace(text, "(?<![\"\\w])(\\w+)\\s*:", "\"$1\":"), F.lit("'"), F.lit('"'))


def rescued(text: Column) -> Column:
    """Indices, scores and recommendations picked out of text around each mention of a segment."""
    pieces = F.regexp_extract_all(text, F.lit("(?is)segment[\\s_\"]*(?:index|\\d+)[\":\\s]*\\d+.{0,200}"), F.lit(0))

    def one(piece: Column) -> Column:
        number = F.regexp_extract(piece, "(?i)segment[\\s_\"]*(?:index|\\d+)[\":\\s]*(\\d+)", 1)
        found = F.regexp_extract(piece, "(?i)(?:score|rating)[\":\\s]*(\\d*\\.?\\d+)", 1)
        score = F.when(found == "", 0.7).otherwise(F.expr("1.0") * F.nullif(found, F.lit("")).try_cast("double"))
        said = F.lower(F.regexp_extract(piece, "(?i)(?:recommended|recommend)[\":\\s]*(true|false|yes|no)", 1))
        return F.struct(
            number.try_cast("int").alias("segment_index"), score.alias("relevance_score"), score.alias("engagement_score"), score.alias("overall_score"),
            (said.isin("true", "yes") | (score > 0.6)).alias("recommended"), F.lit("rescued").alias("reasoning"),
        )

    return F.transform(pieces, one)


def parsed(replies: DataFrame) -> DataFrame:
    """A row for each evaluated segment of `replies` (reply_id, raw): as JSON, as a fenced block, as the outermost braces, as these repaired, or rescued.

    Replies of which nothing can be read give no rows.
    """
    raw = F.trim("raw")
    fence = F.regexp_extract("raw", "(?s)```(?:json)?\\s*(.*?)\\s*```", 1)
    braces = F.regexp_extract("raw", "(?s)(\\{.*\\})", 1)
    tries = [F.when(raw.startswith("{"), _segments(raw)), F.when(fence != "", _segments(fence)), F.when(braces != "", _segments(braces)), F.when(braces != "", _segments(repaired(braces)))]
    picked = rescued(F.col("raw"))
    found = F.coalesce(*tries, F.when(F.size(picked) > 0, picked.cast(SCHEMA.removeprefix("segments "))))
    rows = replies.select("reply_id", F.explode(found).alias("s"))
    return rows.select("reply_id", "s.segment_index", "s.overall_score", "s.recommended")


def staged(labels: DataFrame) -> DataFrame:
    """Replies made of labels: plain, fenced, with a trailing comma, or cut off."""
    score = F.round(F.col("doc_id") % 10 / 10.0, 1)
    body = F.concat(
        F.lit('{"segments": [{"segment_index": '), F.col("doc_id") % 7, F.lit(', "overall_score": '), score, F.lit(', "recommended": '), F.when(F.col("quality") == 1, "true").otherwise("false"), F.lit("}")
    )
    k = F.col("doc_id") % 4
    raw = (
        F.when(k == 0, F.concat(body, F.lit("]}")))
        .when(k == 1, F.concat(F.lit("Here it is:\n```json\n"), body, F.lit("]}\n```\nDone.")))
        .when(k == 2, F.concat(F.lit("Result: "), body, F.lit(",]}")))
        .otherwise(body)
    )
    return labels.select(F.col("doc_id").alias("reply_id"), raw.alias("raw"))


def as_variant(raw: Column) -> Column:
    """A reply as VARIANT: the text itself, a fenced block, its outermost braces, or these repaired; null if nothing can be read."""
    fence = F.regexp_extract(raw, "(?s)```(?:json)?\\s*(.*?)\\s*```", 1)
    braces = F.regexp_extract(raw, "(?s)(\\{.*\\})", 1)
    return F.coalesce(*[F.when(text.startswith("{"), F.try_parse_json(text)) for text in (F.trim(raw), fence, braces, repaired(braces))])


def staged_analyses(labels: DataFrame) -> DataFrame:
    """(video_id, pos, raw): analyses of eight videos' labels each, of seven shapes: lists under one name or the other, an error, no list, metadata, and broken text."""
    k, t = F.col("doc_id") % 7, F.col("doc_id") % 50
    span = lambda a, b, share: F.concat(F.lit('{"confidence":0.'), share, F.lit(',"end_time":'), t + b, F.lit(',"start_time":'), t + a, F.lit("}"))
    tenth = F.col("doc_id") % 9 + 1
    raw = (
        F.when(k == 0, F.concat(F.lit('{"segments":['), span(0, 5, tenth), F.lit(',{"end_time":9,"start_time":6},{"note":"open"}]}')))
        .when(k == 1, F.concat(F.lit('{"segments":[],"zoom_decisions":['), span(1, 4, tenth), F.lit("]}")))
        .when(k == 2, F.concat(F.lit('{"engagement_analysis":[0.'), tenth, F.lit(',0.5],"scenes":[{"at":'), t, F.lit('},{"at":'), t + 3, F.lit("}]}")))
        .when(k == 3, F.concat(F.lit('{"error":null,"segments":['), span(0, 1, tenth), F.lit("]}")))
        .when(k == 4, F.concat(F.lit('{"scenes":"none","segments":{"start_time":'), t, F.lit("}}")))
        .when(k == 5, F.concat(F.lit('{"content_category":"'), F.when(F.col("quality") == 1, "tutorial").otherwise("talk"), F.lit('","mood'), F.col("doc_id") % 3, F.lit('":'), tenth, F.lit(',"segments":['), span(2, 8, tenth), F.lit("]}")))
        .otherwise(F.concat(F.lit('{"segments":['), span(0, 5, tenth), F.lit(",")))
    )
    return labels.select(F.floor(F.col("doc_id") / 8).alias("video_id"), F.col("doc_id").alias("pos"), raw.alias("raw"))


def staged_batches(places: DataFrame, key: str, index: str) -> DataFrame:
    """(video_id, batch, raw): replies about (video_id, batch, idx, quality_score); some are missing, others fenced, broken, cut, without the key, or name a place that isn't there."""
    one = F.concat(F.lit(f'{{"{index}":'), "idx", F.lit(',"overall_score":'), F.round("quality_score", 2), F.lit(',"recommended":'), F.when(F.col("quality_score") >= 0.5, "true").otherwise("false"), F.lit("}"))
    some = F.array_sort(F.collect_list(F.when(F.col("idx") % 3 != 2, F.struct("idx", one.alias("x")))))
    rows = places.groupBy("video_id", "batch").agg(F.transform(some, lambda s: s["x"]).alias("xs"))
    body, k = F.concat(F.lit(f'{{"{key}": ['), F.array_join("xs", ", ")), (F.col("video_id") * 3 + F.col("batch")) % 7
    raw = (
        F.when(k == 0, F.concat(body, F.lit("]}")))
        .when(k == 1, F.concat(F.lit("Here:\n```json\n"), body, F.lit("]}\n```")))
        .when(k == 2, F.concat(F.lit("So: "), body, F.lit(",]}")))
        .when(k == 3, F.concat(body, F.lit(f', {{"{index}": 99, "overall_score": 1}}]}}')))
        .when(k == 4, F.lit('{"other": []}'))
        .when(k == 5, F.concat(body, F.lit(", {")))
    )
    return rows.select("video_id", "batch", raw.alias("raw")).where("raw is not null")
