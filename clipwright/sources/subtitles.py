"""SRT and ASS caption files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ASS_HEADER = """[Script Info]
ScriptType: v4.00+
PlayResX: 1080
PlayResY: 1920

[V4+ Styles]
Format: Name, Fontname, Fontsize, PrimaryColour, OutlineColour, Bold, Alignment, MarginV
Style: Default,Arial,72,&H00FFFFFF,&H00000000,1,2,120

[Events]
Format: Layer, Start, End, Style, Text"""


def _seconds(stamp: Column) -> Column:
    """Of `H:MM:SS,mmm`; null if it is none."""
    part = lambda i: F.regexp_extract(stamp, r"^\s*(\d+):(\d+):(\d+),(\d+)\s*$", i).try_cast("double")
    return part(1) * 3600 + part(2) * 60 + part(3) + part(4) / 1000


def read_srt(spark: SparkSession, path: str) -> DataFrame:
    """(path, start, end, text) of the cues of SRT files; malformed cues are left out."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.regexp_replace("value", "\r", "").alias("value"))
    cues = files.select("path", F.posexplode(F.split(F.regexp_replace("value", r"^\s+|\s+$", ""), r"\n\s*\n")).alias("i", "cue"))
    line = F.regexp_extract("cue", r"(?m)^(.*-->.*)$", 1)
    start, end = F.split(line, "-->")[0], F.try_element_at(F.split(line, "-->"), F.lit(2))
    text = F.regexp_replace(F.regexp_extract("cue", r"(?s)-->[^\n]*\n(.*)$", 1), r"^\s+|\s+$", "")
    return cues.where(F.col("cue").contains("-->")).select("path", "i", _seconds(start).alias("start"), _seconds(end).alias("end"), text.alias("text")).where("start is not null and end is not null").drop("i")


def write_srt(cues: DataFrame, path: str) -> None:
    """A file for each clip: the cues of `captions.srt_lines` in order."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "cue"))), lambda c: c["cue"]), "\n\n")
    cues.groupBy("video_id", "segment_id").agg(F.concat(text, F.lit("\n")).alias("value")).write.partitionBy("video_id", "segment_id").text(path)


def ass_time(seconds: Column) -> Column:
    """H:MM:SS.cc"""
    whole = F.floor(seconds / 60)
    return F.format_string("%d:%02d:%05.2f", F.floor(whole / 60), whole % 60, seconds - whole * 60)


def ass_color(color: Column) -> Column:
    """`#RRGGBB` to ASS's &HAABBGGRR&, opaque."""
    hexes = F.upper(F.regexp_extract(color, "^#([0-9A-Fa-f]{6})$", 1))
    return F.when(hexes != "", F.concat(F.lit("&H00"), F.substring(hexes, 5, 2), F.substring(hexes, 3, 2), F.substring(hexes, 1, 2), F.lit("&")))


def ass_events(chunks: DataFrame, offset: float = 1.7) -> DataFrame:
    """A dialogue line for each chunk of words (video_id, seg_idx, chunk, start, end, text)."""
    line = F.concat(F.lit("Dialogue: 0,"), ass_time(F.col("start") + offset), F.lit(","), ass_time(F.col("end") + offset), F.lit(",Default,"), "text")
    return chunks.select("video_id", F.row_number().over(Window.partitionBy("video_id").orderBy("seg_idx", "chunk")).alias("n"), line.alias("line"))


def write_ass(events: DataFrame, path: str) -> None:
    """A file for each video: the header, then its lines."""
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda c: c["line"]), "\n")
    events.groupBy("video_id").agg(F.concat(F.lit(ASS_HEADER + "\n"), lines).alias("value")).write.partitionBy("video_id").text(path)
