"""Job requests: rules, and the split into good and quarantined rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def validated(requests: DataFrame) -> DataFrame:
    """`requests` with `errors`, the names of the rules that each row breaks; a null field breaks none but its own."""
    c = F.col
    blank = lambda x: F.coalesce(c(x), F.lit("")) == ""
    linear = F.coalesce(c("linear_cut"), F.lit(False))
    rules = {
        "identifier": blank("video_id") & blank("uploaded_video_id"),
        "linear_duration": linear & ~F.coalesce(c("linear_duration").between(5, 600), F.lit(False)),
        "final_video_ids": linear & (F.coalesce(F.size("final_video_ids"), F.lit(0)) == 0),
        "final_video_count": linear & (F.size("final_video_ids") > 0) & (F.size("final_video_ids") != c("no_of_videos")),
        "canvas_type": ~c("canvas_type").isin("shorts", "clips"),
        "duration": c("max_duration") <= c("min_duration"),
        "aspect_ratio": ~c("aspect_ratio").rlike("^\\s*[+-]?\\d+\\s*:\\s*[+-]?\\d+\\s*$"),
        "llm_provider": ~c("llm_provider").isin("openai", "ollama"),
        "overlay_x": ~c("overlay_x").between(0, 2000),
    }
    return requests.withColumn("errors", F.filter(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()]), lambda x: x.isNotNull()))


def split(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows without errors, and rows with."""
    return checked.where(F.size("errors") == 0).drop("errors"), checked.where(F.size("errors") > 0)


def derived(requests: DataFrame) -> DataFrame:
    """Adds what requests (video_id, uploaded_video_id, aspect_ratio, canvas_type, subtitle_overlay, external_srt_url) imply: media_id, ratio_w, ratio_h and whether captions are kinetic.

    A ratio that isn't two numbers is the canvas's own; captions are kinetic if an overlay is asked for and no file with captions is given.
    """
    parts = F.split("aspect_ratio", ":")
    given = F.col("aspect_ratio").rlike("^[0-9]+:[0-9]+$")
    shorts = F.col("canvas_type") == "shorts"
    return requests.withColumns({
        "media_id": F.coalesce("video_id", "uploaded_video_id"),
        "ratio_w": F.when(given, parts[0].cast("int")).when(shorts, 9).otherwise(16),
        "ratio_h": F.when(given, parts[1].cast("int")).when(shorts, 16).otherwise(9),
        "kinetic": F.coalesce("subtitle_overlay", F.lit(False)) & F.col("external_srt_url").isNull(),
    })
