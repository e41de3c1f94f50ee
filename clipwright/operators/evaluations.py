"""Stored model analyses: merged across replies of unlike shape, and joined to the candidates that they are about."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clipwright.functions.text import n_words
from clipwright.sources.replies import as_variant

#: What a merged analysis collects, and where replies have it.
LISTS = {"zoom": "segments", "scene": "scenes", "engagement": "engagement_analysis"}
#: JSON values that count as nothing.
EMPTY = ("[]", "{}", "null", '""', "0", "false")


def part(reply: Column, key: str) -> Column:
    """The value of a key of an object, as VARIANT; null if there is none."""
    return F.try_variant_get(reply, f"$.{key}", "variant")


def items(value: Column) -> Column:
    """The elements of a VARIANT array; of anything else none."""
    return F.coalesce(value.try_cast("array<variant>"), F.array().cast("array<variant>"))


def number(value: Column, key: str, default: float | None = None) -> Column:
    found = F.try_variant_get(value, f"$.{key}", "double")
    return found if default is None else F.coalesce(found, F.lit(default))


def analyses(replies: DataFrame) -> DataFrame:
    """(video_id, pos, reply): the replies (video_id, pos, raw) that are objects and report no error, as VARIANT."""
    read = replies.select("video_id", "pos", F.try_parse_json("raw").alias("reply"))
    return read.where(F.schema_of_variant("reply").startswith("OBJECT") & part(F.col("reply"), "error").isNull())


def zoom_decisions(replies: DataFrame) -> DataFrame:
    """(video_id, pos, i, start_time, end_time, confidence) of each reply's decisions that have both times.

    They are its `segments`, or if these are missing or empty its `zoom_decisions`; a value that is no array gives none.
    """
    read = analyses(replies)
    first = part(F.col("reply"), "segments")
    chosen = F.when(first.isNull() | F.to_json(first).isin(*EMPTY), part(F.col("reply"), "zoom_decisions")).otherwise(first)
    rows = read.select("video_id", "pos", F.posexplode(items(chosen)).alias("i", "x"))
    timed = rows.where(part(F.col("x"), "start_time").isNotNull() & part(F.col("x"), "end_time").isNotNull())
    return timed.select("video_id", "pos", "i", number(F.col("x"), "start_time").alias("start_time"), number(F.col("x"), "end_time").alias("end_time"), number(F.col("x"), "confidence").alias("confidence"))


def merged_items(replies: DataFrame) -> DataFrame:
    """(video_id, kind, place, item): the lists of all of a video's analyses one after the other, items as JSON.

    Places come from running sums of the lists' lengths, so only a row for each analysis and list is brought in order.
    """
    kinds = F.explode(F.map_from_arrays(F.array(*map(F.lit, LISTS)), F.array(*[items(part(F.col("reply"), key)) for key in LISTS.values()]))).alias("kind", "found")
    earlier = Window.partitionBy("video_id", "kind").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    lists = analyses(replies).select("video_id", "pos", kinds).withColumn("before", F.coalesce(F.sum(F.size("found")).over(earlier), F.lit(0)))
    rows = lists.select("video_id", "kind", "before", F.posexplode("found").alias("i", "x"))
    return rows.select("video_id", "kind", (F.col("before") + F.col("i")).alias("place"), F.to_json("x").alias("item"))


def merged_summary(replies: DataFrame) -> DataFrame:
    """(video_id, zooms, scenes, engagements, confidence, metadata) of each video with an analysis.

    The confidence is the mean over all zoom recommendations, 0.5 for one that has none, and 0 without any. The metadata are all keys of
    the analyses that name a content category, as sorted `key=JSON`; the last analysis that has a key decides.
    """
    read = analyses(replies)
    found = items(part(F.col("reply"), LISTS["zoom"]))
    sums = F.aggregate(F.transform(found, lambda x: number(x, "confidence", 0.5)), F.lit(0.0), lambda a, x: a + x)
    size = lambda name: F.size(items(part(F.col("reply"), LISTS[name])))
    counted = read.select("video_id", size("zoom").alias("z"), size("scene").alias("s"), size("engagement").alias("e"), sums.alias("c"))
    totals = counted.groupBy("video_id").agg(F.sum("z").alias("zooms"), F.sum("s").alias("scenes"), F.sum("e").alias("engagements"), F.coalesce(F.try_divide(F.sum("c"), F.sum("z")), F.lit(0.0)).alias("confidence"))
    named = read.where(part(F.col("reply"), "content_category").isNotNull()).withColumnRenamed("pos", "at").alias("r")
    keys = named.lateralJoin(read.sparkSession.tvf.variant_explode(F.col("r.reply").outer()))
    last = keys.groupBy("video_id", "key").agg(F.max_by(F.to_json("value"), "at").alias("value"))
    metadata = last.groupBy("video_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "key", "value"))), "; ").alias("metadata"))
    return totals.join(metadata, "video_id", "left").withColumn("metadata", F.coalesce("metadata", F.lit("")))


def placed(candidates: DataFrame, size: int) -> DataFrame:
    """Candidates with their place in their video's list, their batch of `size` and their place in that."""
    place = F.row_number().over(Window.partitionBy("video_id").orderBy("segment_id")) - 1
    return candidates.withColumn("place", place).withColumn("batch", F.floor(F.col("place") / size)).withColumn("idx", F.col("place") % size)


def evaluations(replies: DataFrame, key: str, index: str) -> DataFrame:
    """(video_id, batch, read, idx, e): a row for each evaluation under `key` in the replies (video_id, batch, raw), and one without evaluation for a reply that has none.

    `read` tells whether the reply could be read. Text around the JSON, fences, trailing commas and single quotes are put up with.
    """
    parsed = replies.select("video_id", "batch", as_variant(F.col("raw")).alias("reply"))
    rows = parsed.select("video_id", "batch", F.col("reply").isNotNull().alias("read"), F.explode_outer(items(part(F.col("reply"), key))).alias("e"))
    return rows.withColumn("idx", F.try_variant_get("e", f"$.{index}", "int"))


def contextual_evaluations(candidates: DataFrame, replies: DataFrame, size: int = 10) -> DataFrame:
    """The candidates that a model has evaluated: (video_id, segment_id, relevance, intent, overall, recommended).

    Replies are joined by video, batch and place in the batch. Scores that are missing are 0.5; candidates without an evaluation go, as do
    batches that failed. An index evaluated twice gives two rows.
    """
    found = evaluations(replies, "evaluations", "segment_index")
    met = placed(candidates, size).select("video_id", "segment_id", "batch", "idx").join(found, ["video_id", "batch", "idx"])
    score = lambda name: number(F.col("e"), name, 0.5)
    return met.select(
        "video_id", "segment_id", score("contextual_relevance_score").alias("relevance"), score("intent_alignment_score").alias("intent"), score("overall_score").alias("overall"),
        F.coalesce(F.try_variant_get("e", "$.recommended", "boolean"), F.lit(False)).alias("recommended"),
    )


def basic_score(text: Column, prompt: Column) -> Column:
    """0.2 for each word of the prompt in the text, 0.3 for ten to a hundred words, 0.2 for a closing sign."""
    low = F.lower(text)
    asked = F.filter(F.split(F.lower(prompt), "\\s+"), lambda w: w != "")
    hit = F.size(F.filter(asked, lambda w: F.contains(low, w)))
    fit = F.when(text == "", 0.0).otherwise(F.when(n_words(text).between(10, 100), 0.3).otherwise(0.0) + F.when(text.rlike("[.!?]"), 0.2).otherwise(0.0))
    return F.round(hit * 0.2 + fit, 6)


def batch_evaluations(candidates: DataFrame, replies: DataFrame, size: int = 8, failed: float = 0.3) -> DataFrame:
    """Candidates with a model's overall score: (video_id, segment_id, overall, recommended, method).

    `model`: evaluated, 0 if the score is missing. `fallback`: the whole batch has no reply that can be read; it gets
    `failed` and isn't recommended. Candidates that a good reply leaves out go.
    """
    found = evaluations(replies, "segments", "index").withColumn("_there", F.lit(True))
    own = placed(candidates, size).select("video_id", "segment_id", "batch", "idx")
    readable = found.groupBy("video_id", "batch").agg(F.bool_or("read").alias("readable"))
    lost = own.join(readable.where("readable"), ["video_id", "batch"], "left_anti")
    model = own.join(found, ["video_id", "batch", "idx"]).select("video_id", "segment_id", number(F.col("e"), "overall_score", 0.0).alias("overall"), F.coalesce(F.try_variant_get("e", "$.recommended", "boolean"), F.lit(False)).alias("recommended"), F.lit("model").alias("method"))
    return model.unionByName(lost.select("video_id", "segment_id", F.lit(failed).alias("overall"), F.lit(False).alias("recommended"), F.lit("fallback").alias("method")))


def basic_matches(candidates: DataFrame, most: int = 5) -> DataFrame:
    """Where no model answers: the best `most` of each video by `basic_score` of (text, prompt); recommended above 0.4."""
    scored = candidates.select("video_id", "segment_id", basic_score(F.col("text"), F.col("prompt")).alias("score"))
    rows = scored.select("video_id", "segment_id", F.least(F.lit(1.0), "score").alias("overall"), (F.col("score") > 0.4).alias("recommended"))
    place = F.row_number().over(Window.partitionBy("video_id").orderBy(F.desc("overall"), "segment_id"))
    return rows.withColumn("place", place).where(F.col("place") <= most)


def refined(candidates: DataFrame, replies: DataFrame, score: str) -> DataFrame:
    """Candidates (video_id, segment_id, `score`) with a model's refinements by place in the list: (video_id, segment_id, refined, priority, recommendation, rank).

    A refinement counts 0.7 and what there was 0.3, one after the other if a place has several; one without a score keeps what there was. The
    last one's priority and recommendation stay. Places out of the list count for nothing, as do replies that can't be read.
    """
    found = replies.select("video_id", F.posexplode(items(part(as_variant(F.col("raw")), "segment_refinements"))).alias("i", "e"))
    one = F.struct("i", number(F.col("e"), "refined_score").alias("s"), F.coalesce(F.try_variant_get("e", "$.priority", "string"), F.lit("medium")).alias("p"), F.coalesce(F.try_variant_get("e", "$.recommendation", "string"), F.lit("consider")).alias("r"))
    by_place = found.groupBy("video_id", F.try_variant_get("e", "$.index", "int").alias("place")).agg(F.array_sort(F.collect_list(one)).alias("steps"))
    rows = placed(candidates, 1).join(by_place, ["video_id", "place"], "left")
    mixed = F.aggregate("steps", F.col(score), lambda now, x: F.coalesce(x["s"], now) * 0.7 + now * 0.3)
    last = F.element_at("steps", -1)
    out = rows.select("video_id", "segment_id", "place", F.round(F.coalesce(mixed, F.col(score)), 6).alias("refined"), last["p"].alias("priority"), last["r"].alias("recommendation"))
    rank = F.row_number().over(Window.partitionBy("video_id").orderBy(F.desc("refined"), "place"))
    return out.withColumn("rank", rank).drop("place")
