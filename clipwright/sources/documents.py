"""JSON documents: transcripts, face and object indexes, clip records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = "struct<word:string,start:double,end:double>"
TRANSCRIPT = f"video_id string, text string, language string, segments array<struct<start:double,end:double,text:string,speaker:string,avg_logprob:double,words:array<{WORD}>>>"
INDEX = (
    "video string, fps double, celebrities array<struct<name:string,face_id:string,confidence:double,appearances:array<struct<timestamp_sec:int,timestamp:string>>>>, "
    "objects array<struct<object_id:string,id:string,label:string,score:double,confidence:double,segments:array<struct<start_sec:double,end_sec:double,reference_match:struct<score:double>>>,appearances:array<struct<start_sec:double,end_sec:double>>>>"
)


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """(video_id, seg_idx, start, end, text, speaker, avg_logprob, words): a row per line of stored transcripts."""
    docs = spark.read.schema(TRANSCRIPT).json(path)
    return docs.select("video_id", F.posexplode("segments").alias("seg_idx", "s")).select("video_id", "seg_idx", "s.*")


def transcript_documents(transcript: DataFrame) -> DataFrame:
    """A document per video, ready for `write.json`."""
    rows = F.array_sort(F.collect_list(F.struct("seg_idx", "start", "end", "text", "speaker")))
    found = transcript.groupBy("video_id").agg(rows.alias("rows"))
    segments = F.transform("rows", lambda r: r.dropFields("seg_idx"))
    return found.select("video_id", F.array_join(F.transform("rows", lambda r: r["text"]), " ").alias("text"), segments.alias("segments"))


def sentence_transcript(texts: DataFrame) -> DataFrame:
    """Lines for stored texts (video_id, text) without times: their sentences, half a second a word, a second at least."""
    from clipwright.functions.text import n_words, sentences

    rows = texts.select("video_id", F.posexplode(sentences(F.col("text"))).alias("seg_idx", "text"))
    from pyspark.sql.window import Window

    length = F.greatest(F.lit(1.0), n_words(F.col("text")) * 0.5)
    end = F.sum(length).over(Window.partitionBy("video_id").orderBy("seg_idx"))
    return rows.withColumn("end", end).withColumn("start", F.col("end") - length)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(INDEX).json(path, multiLine=True)


def actor_index(index: DataFrame) -> DataFrame:
    """(video_id, actor, times, conf): the distinct seconds of a name over all its faces, and the first confidence; names never seen are left out."""
    faces = index.select(F.col("video").alias("video_id"), F.posexplode("celebrities").alias("pos", "c"))
    first = faces.groupBy("video_id", F.col("c.name").alias("actor")).agg(F.min_by("c.confidence", "pos").alias("conf"))
    seen = faces.select("video_id", F.col("c.name").alias("actor"), F.explode("c.appearances").alias("a")).groupBy("video_id", "actor").agg(F.array_sort(F.collect_set("a.timestamp_sec")).alias("times"))
    return seen.join(first, ["video_id", "actor"])


def object_index(index: DataFrame, matched_only: bool = False) -> DataFrame:
    """(video_id, object_id, label, obj_start, obj_end, score) of the objects' spans; `matched_only`: those with a reference match."""
    objects = index.select(F.col("video").alias("video_id"), F.explode("objects").alias("o"))
    spans = F.when(F.size("o.segments") > 0, F.col("o.segments")).otherwise(F.transform("o.appearances", lambda a: F.struct(a["start_sec"].alias("start_sec"), a["end_sec"].alias("end_sec"), F.lit(None).cast("struct<score:double>").alias("reference_match"))))
    rows = objects.select("video_id", F.coalesce("o.object_id", "o.id", "o.label", F.lit("unknown")).alias("object_id"), F.coalesce("o.label", F.lit("unknown")).alias("label"), F.coalesce("o.score", "o.confidence").alias("own"), F.explode(spans).alias("s"))
    if matched_only:
        rows = rows.where(F.col("s.reference_match").isNotNull())
    return rows.select("video_id", "object_id", "label", F.col("s.start_sec").alias("obj_start"), F.col("s.end_sec").alias("obj_end"), F.coalesce("s.reference_match.score", "own", F.lit(1.0)).alias("score"))


def clip_records(clips: DataFrame) -> DataFrame:
    """A JSON record for each clip (clip_id, video_id, key, thumbnail, title, description, tags, duration)."""
    record = F.struct("clip_id", "video_id", "key", "thumbnail", F.substring("title", 1, 100).alias("ai_title"), F.substring("description", 1, 500).alias("ai_description"), "tags", F.round("duration", 2).alias("duration"))
    return clips.select("clip_id", F.to_json(record).alias("record"))


def cache_key(*parts: str, **named: str):
    """MD5 of positional parts and sorted named ones."""
    return F.md5(F.concat_ws("|", *[F.col(p).cast("string") for p in parts], *[F.concat(F.lit(f"{k}="), F.col(v).cast("string")) for k, v in sorted(named.items())]))


def cache_lookup(asked: DataFrame, cache: DataFrame, now: int, max_age_days: int = 7) -> DataFrame:
    """Asked keys (cache_key) with their stored data, if not older than `max_age_days`; `hit` tells."""
    live = cache.where(F.col("cached_at") >= now - max_age_days * 86400).groupBy("cache_key").agg(F.max_by("data", "cached_at").alias("data"))
    return asked.join(live, "cache_key", "left").withColumn("hit", F.col("data").isNotNull())


def expired(cache: DataFrame, now: int, max_age_days: int = 7) -> DataFrame:
    return cache.where(F.col("cached_at") < now - max_age_days * 86400)


def duplicates(files: DataFrame) -> DataFrame:
    """MD5 of contents (id, content: text or binary) that more than one file has, with how many and the first id."""
    return files.where("content is not null").groupBy(F.md5("content").alias("hash")).agg(F.count("*").alias("files"), F.min("id").alias("first")).where("files > 1")


def json_record(*columns: str):
    """The columns as one line of JSON; null ones are left out."""
    return F.to_json(F.struct(*columns))


def cache_stats(files: DataFrame) -> DataFrame:
    """Files, bytes and share of hits of cache files (size, hit)."""
    return files.agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.coalesce(F.avg(F.col("hit").cast("double")), F.lit(0.0)).alias("hit_rate"))
