"""Caption lines and their chunks of words."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clipwright.functions.text import srt_time, words, wrapped_caption
from clipwright.operators.intervals import interval_join


def timed_words(transcript: DataFrame) -> DataFrame:
    """Lines with their words spread evenly over them; lines without words are left out."""
    w = words(F.col("text"))
    rows = transcript.select("video_id", "seg_idx", "start", "end", F.posexplode(w).alias("i", "word"))
    each = (F.col("end") - F.col("start")) / F.count("*").over(Window.partitionBy("video_id", "seg_idx"))
    rows = rows.withColumn("each", each)
    word = F.struct("i", F.struct("word", (F.col("start") + F.col("i") * F.col("each")).alias("start"), (F.col("start") + (F.col("i") + 1) * F.col("each")).alias("end")).alias("w"))
    found = rows.groupBy("video_id", "seg_idx").agg(F.array_sort(F.collect_list(word)).alias("ws"))
    return found.select("video_id", "seg_idx", F.transform("ws", lambda x: x["w"]).alias("words"))


def chunks(timed: DataFrame, most: int = 4) -> DataFrame:
    """Words in chunks that end after `most` words or at a closing sign: a row per chunk.

    A closing sign starts the count anew, so a chunk is known by the closing words before it and
    the place since the last of them.
    """
    line = Window.partitionBy("video_id", "seg_idx").orderBy("i")
    rows = timed.select("video_id", "seg_idx", F.posexplode("words").alias("i", "w")).withColumn("closes", F.col("w.word").rlike("[.!?,]$").cast("int"))
    rows = rows.withColumn("run", F.coalesce(F.sum("closes").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    place = F.row_number().over(Window.partitionBy("video_id", "seg_idx", "run").orderBy("i"))
    rows = rows.withColumn("part", F.floor((place - 1) / most))
    found = rows.groupBy("video_id", "seg_idx", "run", "part").agg(F.array_sort(F.collect_list(F.struct("i", "w"))).alias("ws"))
    number = F.row_number().over(Window.partitionBy("video_id", "seg_idx").orderBy("run", "part")) - 1
    text = F.array_join(F.transform("ws", lambda x: x["w"]["word"]), " ")
    return found.select("video_id", "seg_idx", number.alias("chunk"), text.alias("text"), F.element_at("ws", 1)["w"]["start"].alias("start"), F.element_at("ws", -1)["w"]["end"].alias("end"), F.size("ws").alias("n_words"))


def typewriter(chunked: DataFrame) -> DataFrame:
    """Each chunk as growing lines, one per word, evenly spread."""
    rows = chunked.select("*", F.explode(F.sequence(F.lit(1), F.col("n_words"))).alias("k"))
    each = (F.col("end") - F.col("start")) / F.col("n_words")
    text = F.array_join(F.slice(F.split("text", " "), F.lit(1), F.col("k")), " ")
    return rows.select("video_id", "seg_idx", "chunk", "k", text.alias("text"), (F.col("start") + (F.col("k") - 1) * each).alias("start"), (F.col("start") + F.col("k") * each).alias("end"))


def srt_lines(captions: DataFrame) -> DataFrame:
    """Numbered SRT cues of each clip's captions (video_id, segment_id, cap_start, cap_end, text), empty ones left out."""
    clean = captions.withColumn("caption", wrapped_caption(F.col("text"))).where("caption <> ''")
    n = F.row_number().over(Window.partitionBy("video_id", "segment_id").orderBy("cap_start", "cap_end", "text"))
    clean = clean.withColumn("n", n)
    cue = F.concat_ws("\n", F.col("n").cast("string"), F.concat_ws(" --> ", srt_time(F.col("cap_start")), srt_time(F.col("cap_end"))), "caption")
    return clean.select("video_id", "segment_id", "n", cue.alias("cue"))


def has_word_timing(lines: DataFrame) -> DataFrame:
    """(video_id, words, timed, has_timing): whether any word of a video's lines (video_id, words) ends elsewhere than it starts."""
    moves = lambda w: w["start"] != w["end"]
    sizes = lines.select("video_id", F.coalesce(F.size("words"), F.lit(0)).alias("n"), F.coalesce(F.size(F.filter("words", moves)), F.lit(0)).alias("t"))
    return sizes.groupBy("video_id").agg(F.sum("n").alias("words"), F.sum("t").alias("timed"), (F.sum("t") > 0).alias("has_timing"))


def clip_words(clips: DataFrame, lines: DataFrame) -> DataFrame:
    """(video_id, segment_id, seg_idx, line_start, line_end, words): the lines with words that lie at least half in a clip, on the clip's own time.

    A line's words (word, start, end) are filtered, moved and put back as one array. Words outside the clip go, as do those that would start too
    early: before 0 where four fifths of the line lie in the clip, 0.1 s where three fifths do, else 0.3 s. A line that loses all its words goes.
    """
    met = interval_join(clips.select("video_id", "segment_id", "seg_start", "seg_end"), lines.select("video_id", "seg_idx", "start", "end", "words"), ["video_id"], ("seg_start", "seg_end"), ("start", "end"))
    share = (F.least("end", "seg_end") - F.greatest("start", "seg_start")) / (F.col("end") - F.col("start"))
    rows = met.where(F.size("words") > 0).withColumn("share", share).where("share >= 0.5").withColumn("early", F.when(F.col("share") >= 0.8, 0.0).when(F.col("share") >= 0.6, 0.1).otherwise(0.3))
    inside = F.filter("words", lambda w: (w["end"] > F.col("seg_start")) & (w["start"] < F.col("seg_end")) & (w["start"] - F.col("seg_start") >= F.col("early")))
    at = lambda w: w["start"] - F.col("seg_start")
    moved = F.transform(inside, lambda w: F.struct(w["word"].alias("word"), at(w).alias("start"), F.greatest(at(w) + 0.01, w["end"] - F.col("seg_start")).alias("end")))
    begin = F.greatest(F.lit(0.0), F.col("start") - F.col("seg_start"))
    rows = rows.withColumn("moved", moved).where(F.size("moved") > 0)
    return rows.select("video_id", "segment_id", "seg_idx", F.greatest(begin, "early").alias("line_start"), F.greatest(begin + 0.01, F.col("end") - F.col("seg_start")).alias("line_end"), F.col("moved").alias("words"))
