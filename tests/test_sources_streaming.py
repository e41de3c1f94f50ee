import json

from pyspark.sql import functions as F

from clipwright.operators import captions, tracking, windows
from clipwright.sources import documents, replies, requests, subtitles
from clipwright.streaming import jobs, sessions


def test_srt_round_trip(spark, tmp_path):
    (tmp_path / "a.srt").write_text("1\n00:00:01,500 --> 00:00:03,000\nHello\nthere\n\nbroken\n\n2\n00:01:00,000 --> x\nno\n\n3\n01:00:00,250 --> 01:00:02,000\nLast one\n")
    found = subtitles.read_srt(spark, str(tmp_path / "a.srt")).orderBy("start").collect()
    assert [(r["start"], r["end"], r["text"]) for r in found] == [(1.5, 3.0, "Hello\nthere"), (3600.25, 3602.0, "Last one")]
    rows = spark.createDataFrame([("v", 1, 1.5, 3.0, "Hello   there"), ("v", 1, 61.25, 62.0, "x" * 30 + " " + "y" * 30 + " " + "z" * 30)], "video_id string, segment_id int, cap_start double, cap_end double, text string")
    subtitles.write_srt(captions.srt_lines(rows), str(tmp_path / "out"))
    again = subtitles.read_srt(spark, str(tmp_path / "out/video_id=v/segment_id=1")).orderBy("start").collect()
    assert [(r["start"], r["text"]) for r in again] == [(1.5, "Hello there"), (61.25, "x" * 30 + "\n" + "y" * 30 + "...")]


def test_ass_lines(spark, tmp_path):
    chunks = spark.createDataFrame([("v", 0, 0, 1.0, 2.5, "One two")], "video_id string, seg_idx int, chunk int, start double, end double, text string")
    events = subtitles.ass_events(chunks, 0.0)
    assert events.first()["line"] == "Dialogue: 0,0:00:01.00,0:00:02.50,Default,One two"
    subtitles.write_ass(events, str(tmp_path / "ass"))
    assert "[Events]" in "".join(p.read_text() for p in (tmp_path / "ass").rglob("*.txt"))
    assert spark.range(1).select(subtitles.ass_color(F.lit("#FF8000"))).first()[0] == "&H000080FF&"


def test_documents(spark, tmp_path):
    index = {"video": "v", "fps": 1.0, "celebrities": [{"name": "A", "face_id": "1", "confidence": 0.9, "appearances": [{"timestamp_sec": 3}, {"timestamp_sec": 1}]}, {"name": "A", "face_id": "2", "confidence": 0.5, "appearances": [{"timestamp_sec": 3}]}, {"name": "B", "face_id": "3", "confidence": 0.5, "appearances": []}],
             "objects": [{"object_id": "o1", "label": "cup", "segments": [{"start_sec": 1.0, "end_sec": 2.0, "reference_match": {"score": 0.8}}]}, {"label": "hat", "confidence": 0.4, "appearances": [{"start_sec": 5.0, "end_sec": 6.0}]}]}
    (tmp_path / "i.json").write_text(json.dumps(index))
    read = documents.read_index(spark, str(tmp_path / "i.json"))
    assert [(r["actor"], r["times"], r["conf"]) for r in documents.actor_index(read).collect()] == [("A", [1, 3], 0.9)]
    assert sorted((r["object_id"], r["score"]) for r in documents.object_index(read).collect()) == [("hat", 0.4), ("o1", 0.8)]
    assert documents.object_index(read, matched_only=True).count() == 1
    lines = spark.createDataFrame([("v", 0, 0.0, 1.0, "a b", "s"), ("v", 1, 1.0, 2.0, "c", "s")], "video_id string, seg_idx int, start double, end double, text string, speaker string")
    documents.transcript_documents(lines).write.json(str(tmp_path / "t"))
    assert documents.read_transcripts(spark, str(tmp_path / "t")).count() == 2
    timed = documents.sentence_transcript(spark.createDataFrame([("v", "One two three. Four.")], "video_id string, text string")).orderBy("seg_idx").collect()
    assert [(r["start"], r["end"], r["text"]) for r in timed] == [(0.0, 1.5, "One two three"), (1.5, 2.5, "Four")]


def test_cache(spark):
    cache = spark.createDataFrame([("a", 100_000, "old"), ("a", 900_000, "new"), ("b", 1, "gone")], "cache_key string, cached_at long, data string")
    asked = spark.createDataFrame([("a",), ("b",), ("c",)], "cache_key string")
    found = {r["cache_key"]: (r["data"], r["hit"]) for r in documents.cache_lookup(asked, cache, 1_000_000).collect()}
    assert found == {"a": ("new", True), "b": (None, False), "c": (None, False)}
    assert documents.expired(cache, 1_000_000).count() == 2


def test_replies(spark):
    raw = ['{"segments": [{"segment_index": 1, "overall_score": 0.9, "recommended": true}]}', "x ```json\n{\"segments\": [{\"segment_index\": 2, \"overall_score\": 0.1}]}\n``` y", "so {segments: [{'segment_index': 3, 'overall_score': 0.5,},]} ok", "Segment index: 4 score: 0.65 fine", "nothing at all"]
    found = replies.parsed(spark.createDataFrame(list(enumerate(raw)), "reply_id int, raw string")).collect()
    assert {r["reply_id"]: (r["segment_index"], r["overall_score"]) for r in found} == {0: (1, 0.9), 1: (2, 0.1), 2: (3, 0.5), 3: (4, 0.65)}


def test_request_stream(spark, tmp_path):
    rows = [{"request_id": i, "video_id": "v" if i % 2 else None, "canvas_type": "shorts", "min_duration": 5, "max_duration": 10, "llm_provider": "openai", "overlay_x": 0} for i in range(10)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text("\n".join(map(json.dumps, rows)))
    taken = []
    query = jobs.run_requests(jobs.request_stream(spark, str(tmp_path / "in")), lambda df: taken.extend(r["request_id"] for r in df.collect()), str(tmp_path / "bad"), str(tmp_path / "ck"))
    query.awaitTermination(120)
    assert sorted(taken) == [1, 3, 5, 7, 9]
    bad = spark.read.parquet(str(tmp_path / "bad"))
    assert {r["errors"][0] for r in bad.collect()} == {"identifier"} and bad.count() == 5
    assert requests.validated(bad.drop("errors", "batch")).count() == 5


def stream_all(spark, rows, build, tmp_path, files=3):
    """Run `build` over `rows` arriving in several files, and return what comes out."""
    ordered = rows.toPandas()
    source = tmp_path / "s"
    source.mkdir()
    step = -(-len(ordered) // files)
    for i in range(files):
        ordered.iloc[i * step : (i + 1) * step].to_parquet(source / f"{i}.parquet", coerce_timestamps="us")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    query = build(stream).writeStream.format("memory").queryName(f"q{abs(hash(str(tmp_path)))}").option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(180)
    return spark.sql(f"select * from {query.name}")


def detections(spark):
    import random

    r = random.Random(1)
    rows = [(v, f, f * 10 + k, r.choice("ab"), r.randrange(400), r.randrange(300)) for f in range(40) for v in (1, 2) for k in range(3) if f % 17 < 14]
    return spark.createDataFrame(rows, "video_id long, frame_no int, det_id long, class_name string, cx long, cy long")


def test_tracker_stream_equals_batch(spark, tmp_path):
    rows = detections(spark)
    out = stream_all(spark, rows, sessions.tracked, tmp_path)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, tracking.tracked(rows).collect()))


def test_layout_stream_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([(v, f, (f // (3 + v)) % 3) for f in range(60) for v in (1, 2)], "video_id long, frame_no int, speakers int")
    out = stream_all(spark, rows, lambda s: sessions.stable_layout(s, 4), tmp_path)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, tracking.stable_layout(rows, 4).collect()))


def test_session_stream_equals_batch(spark, tmp_path):
    base = 1_700_000_000
    seconds = [0, 1, 3, 10, 11, 20, 22, 24, 40]
    events = [(1, "a", base + s) for s in seconds] + [(1, "b", base + 5), (9, "z", base + 1000)]
    rows = spark.createDataFrame(sorted(events, key=lambda e: e[2]), "video_id long, actor string, s long").withColumn("ts", F.timestamp_seconds("s")).select("video_id", "actor", "ts")
    out = stream_all(spark, rows, sessions.appearance_sessions, tmp_path, files=4)
    batch = windows.sessions(rows.withColumn("t", F.unix_seconds("ts")), ["video_id", "actor"], "t", 2).where("actor <> 'z'")
    assert sorted((r["actor"], int(r["start"].timestamp()), int(r["end"].timestamp()), r["n"]) for r in out.where("actor <> 'z'").collect()) == sorted((r["actor"], r["start_sec"], r["end_sec"], r["n"]) for r in batch.collect())


def test_status(spark):
    rows = spark.createDataFrame([("t", "v", "queued", 1), ("t", "v", "done", 5), ("u", "w", "queued", 2)], "task_id string, video_id string, status string, ts long")
    assert {r["task_id"]: r["status"] for r in jobs.latest_status(rows).collect()} == {"t": "done", "u": "queued"}
