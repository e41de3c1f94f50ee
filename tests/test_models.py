"""Stored analyses, nested documents, tolerant matches and visual scenes against values worked out by hand or by plain Python."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from clipwright.operators import captions as cp
from clipwright.operators import evaluations as ev
from clipwright.operators import intervals as iv
from clipwright.operators import objects as ob
from clipwright.operators import reports as rs
from clipwright.operators import visual as vs
from clipwright.sources import replies as rp

REPLIES = [
    (1, 0, '{"segments": [{"start_time": 1, "end_time": 2.5, "confidence": 0.9}, {"start_time": 3}, 7, "x"]}'),
    (1, 1, '{"segments": [], "zoom_decisions": [{"start_time": 4, "end_time": 5}]}'),
    (1, 2, '{"scenes": [1, {"at": 2}], "engagement_analysis": "high", "content_category": "talk", "mood": "calm"}'),
    (1, 3, '{"error": "timeout", "segments": [{"start_time": 9, "end_time": 10}]}'),
    (1, 4, '{"content_category": "tutorial", "segments": {"start_time": 0}, "engagement_analysis": [0.5]}'),
    (2, 0, "no json"),
    (2, 1, "[1, 2]"),
    (3, 0, None),
    (4, 0, '{"error": null, "scenes": [1]}'),
    (5, 0, "{}"),
]


@pytest.fixture(scope="module")
def replies(spark):
    return spark.createDataFrame(REPLIES, "video_id long, pos long, raw string").repartition(3)


def test_zoom_decisions_of_unlike_replies(replies):
    found = sorted(tuple(r) for r in ev.zoom_decisions(replies).collect())
    assert found == [(1, 0, 0, 1.0, 2.5, 0.9), (1, 1, 0, 4.0, 5.0, None)]


def test_merged_analyses(replies):
    assert sorted(tuple(r) for r in ev.merged_summary(replies).collect()) == [
        (1, 4, 2, 1, pytest.approx((0.9 + 0.5 * 3) / 4), 'content_category="tutorial"; engagement_analysis=[0.5]; mood="calm"; scenes=[1,{"at":2}]; segments={"start_time":0}'),
        (5, 0, 0, 0, 0.0, ""),
    ]
    items = {(r.kind, r.place): r.item for r in ev.merged_items(replies).collect()}
    assert items == {("zoom", 0): '{"confidence":0.9,"end_time":2.5,"start_time":1}', ("zoom", 1): '{"start_time":3}', ("zoom", 2): "7", ("zoom", 3): '"x"', ("scene", 0): "1", ("scene", 1): '{"at":2}', ("engagement", 0): "0.5"}


def test_broken_and_missing_batches(spark):
    candidates = spark.createDataFrame([(1, i, 0.5) for i in range(7)], "video_id long, segment_id int, quality double")
    raws = [
        (1, 0, 'Sure:\n```json\n{"segments": [{"index": 1, "overall_score": 0.9, "recommended": true}, {"index": 5, "overall_score": 1.0}, {"index": 0}]}\n```'),
        (1, 1, "sorry"),
        (1, 2, None),
    ]
    found = ev.batch_evaluations(candidates, spark.createDataFrame(raws, "video_id long, batch long, raw string"), 2)
    assert sorted(tuple(r) for r in found.collect()) == [(1, 0, 0.0, False, "model"), (1, 1, 0.9, True, "model"), *((1, i, 0.3, False, "fallback") for i in range(2, 7))]
    said = [(1, 0, '{"evaluations": [{"segment_index": 1, "overall_score": 0.8, "recommended": true,}, {"segment_index": 1},]}'), (1, 1, "{'evaluations': [{'segment_index': 0, 'intent_alignment_score': 0.1}]}")]
    found = ev.contextual_evaluations(candidates, spark.createDataFrame(said, "video_id long, batch long, raw string"), 2)
    assert sorted(tuple(r) for r in found.collect()) == [(1, 1, 0.5, 0.5, 0.5, False), (1, 1, 0.5, 0.5, 0.8, True), (1, 2, 0.5, 0.1, 0.5, False)]


def test_refinements_follow_each_other(spark):
    candidates = spark.createDataFrame([(1, i, 0.5) for i in range(3)], "video_id long, segment_id int, score double")
    raw = '{"segment_refinements": [{"index": 1, "refined_score": 1.0, "priority": "high"}, {"index": 1, "refined_score": 0.0}, {"index": 9, "refined_score": 1.0}, {"index": 2}, {"refined_score": 1}]}'
    found = ev.refined(candidates, spark.createDataFrame([(1, raw)], "video_id long, raw string"), "score")
    assert sorted(tuple(r) for r in found.collect()) == [(1, 0, 0.5, None, None, 1), (1, 1, round((0.7 + 0.15) * 0.3, 6), "medium", "consider", 3), (1, 2, 0.5, "medium", "consider", 2)]


def test_basic_matches(spark):
    rows = spark.createDataFrame([(1, 1, "learn to cook. " * 4, "Learn to cook"), (1, 2, "", "x"), (1, 3, "cook", "x cook")], "video_id long, segment_id int, text string, prompt string")
    assert [(r.segment_id, r.overall, r.recommended) for r in ev.basic_matches(rows).orderBy("place").collect()] == [(1, 1.0, True), (3, 0.2, False), (2, 0.0, False)]


def test_scores_go_into_matching_elements_only(spark):
    spans = spark.createDataFrame([("v", "a", 0.0, 5.0), ("v", "a", 9.0, 12.0), ("v", "b", 0.0, 5.0), ("w", "a", 0.0, 5.0), ("x", "c", 1.0, 2.0)], "video_id string, object_id string, start_sec double, end_sec double")
    documents = ob.object_documents(spans)
    hits = spark.createDataFrame([(1, "a", 0.9, 1), (1, "a", 0.8, 2), (1, "zz", 0.9, 3), (2, "a", 0.7, 1)], "ref_id long, object_id string, score double, place int")
    matched = ob.hit_segments(documents, hits)
    assert sorted(tuple(r) for r in matched.where("video_id = 'w'").collect()) == [("w", 1, "a", 0.0, 5.0, 0.9), ("w", 2, "a", 0.0, 5.0, 0.7)]
    partial = matched.where("not (video_id = 'v' and start_sec = 9) and not video_id = 'w'")
    found = {r.video_id: [(o.object_id, [(s.start_sec, s.reference_match and s.reference_match.score) for s in o.segments]) for o in r.objects] for r in ob.with_reference_scores(documents, partial).collect()}
    assert found == {"v": [("a", [(0.0, 0.7), (9.0, None)]), ("b", [(0.0, None)])], "w": [("a", [(0.0, None)])], "x": [("c", [(1.0, None)])]}
    again = ob.with_reference_scores(ob.with_reference_scores(documents, partial), matched.where("video_id = 'w'"))
    kept = again.where("video_id = 'v'").first().objects[0].segments[0].reference_match.score
    assert kept == 0.7


def test_windows_of_objects(spark):
    spans = spark.createDataFrame([("v", "a", 100.0, 104.0, 0.5), ("v", "b", 90.0, 200.0, 0.8), ("v", "c", 900.0, 910.0, 1.0)], "video_id string, object_id string, obj_start double, obj_end double, score double")
    bounds = spark.createDataFrame([("v", 10.0, 500.0)], "video_id string, range_start double, range_end double")
    found = {(r.object_id, r.method): (r.seg_start, r.seg_end, round(r.object_score, 6), r.top_object) for r in ob.object_windows(spans, bounds).collect()}
    assert found == {("a", "object_appearance"): (94.5, 109.5, round(4 / 15 * 0.5 + 0.8, 6), "b"), ("b", "object_appearance"): (137.5, 152.5, 0.8, "b"), ("b", "object_appearance_long"): (90.0, 150.0, round(4 / 60 * 0.5 + 0.8, 6), "b")}


def test_tolerant_match(spark):
    rng = random.Random(2)
    segments = [(v, i, round(rng.uniform(0, 60), 1), 0.0) for v in (1, 2) for i in range(60)]
    segments = [(v, i, s, round(s + rng.uniform(0, 6), 1)) for v, i, s, _ in segments]
    analyses = [(v, i, round(rng.uniform(0, 60), 1), 0.0, f"d{i}") for v in (1, 2, 3) for i in range(60)]
    analyses = [(v, i, s, round(s + rng.uniform(0, 6), 1), d) for v, i, s, _, d in analyses] + [(v, 100 + i, s, e, f"same{i}") for v, i, s, e in segments[:20]] + [(1, 200, segments[0][2], segments[0][3], "later")]
    plan = iv.tolerant_match(spark.createDataFrame(segments, "video_id int, segment_id int, seg_start double, seg_end double"), spark.createDataFrame(analyses, "video_id int, pos int, v_start double, v_end double, data string"))
    want = {}
    for v, i, s, e in segments:
        lookup = {}
        for a, _, s2, e2, d in sorted(analyses, key=lambda a: a[1]):
            if a == v:
                lookup[s2, e2] = d
        near = [d for (s2, e2), d in lookup.items() if abs(s2 - s) < 2 and abs(e2 - e) < 2]
        want[v, i] = (True, lookup[s, e]) if (s, e) in lookup else (False, near[0]) if near else (None, None)
    assert {(r.video_id, r.segment_id): (r.exact, r.data) for r in plan.collect()} == want
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in text and "Cartesian" not in text and "_i#" in text


def test_spaced_rows(spark):
    rng = random.Random(4)
    points = sorted({(v, round(rng.uniform(0, 300), 2)) for v in range(3) for _ in range(120 if v else 5)})
    got = {tuple(r) for r in vs.spaced_rows(spark.createDataFrame(points, "video_id int, ts double").repartition(5), "video_id", "ts", 5.0, 20).collect()}
    want, last = set(), {}
    for v, t in points:
        if v not in last or t - last[v] >= 5.0:
            last[v] = t
            want.add((v, t))
    assert got == want


def test_scene_changes(spark):
    rng = np.random.default_rng(7)
    frames = [(v, n * 5, [float(x) for x in (rng.normal(size=8) if n % 9 == 0 else np.arange(8) * 1.0 + n)] if n % 13 else None) for v in range(2) for n in range(400)] + [(9, 0, [1.0, 1.0]), (9, 10, [2.0, 2.0]), (9, 200, [1.0, 2.0]), (9, 400, [2.0, 1.0])]
    got = {(r.video_id, r.frame_no): round(r.confidence, 9) for r in vs.scene_changes(spark.createDataFrame(frames, "video_id int, frame_no int, vector array<double>").repartition(4), 2.0).collect()}
    want = {}
    for v in (0, 1, 9):
        before, last = None, None
        for _, n, x in sorted(f for f in frames if f[0] == v and f[2] is not None and f[1] % 10 == 0):
            if before is not None:
                r = 1.0 if np.ptp(x) == 0 or np.ptp(before) == 0 else np.corrcoef(before, x)[0, 1]
                if r < 0.7 and (last is None or n / 2.0 - last >= 5.0):
                    last = n / 2.0
                    want[v, n] = round(1 - r, 9)
            before = x
    assert got == want and (9, 400) in got


def test_visual_segments_nested_and_chained(spark):
    kind = "video_id int, run_start double, run_end double"
    motion = spark.createDataFrame([(1, 0.0, 100.0), (1, 300.0, 310.0), (2, 0.0, 10.0)], kind)
    complexity = spark.createDataFrame([(1, 10.0, 20.0), (1, 90.0, 120.0), (1, 315.0, 330.0), (2, 15.1, 20.0)], kind)
    silence = spark.createDataFrame([(1, 124.0, 160.0), (1, 200.0, 229.0), (2, 40.0, 80.0)], kind)
    found = sorted(tuple(r) for r in vs.visual_segments(motion, complexity, silence).collect())
    assert [f[:3] for f in found] == [(1, 0.0, 160.0), (1, 300.0, 330.0), (2, 0.0, 10.0), (2, 15.1, 20.0), (2, 40.0, 80.0)]
    assert found[0][3:] == (0.8, "action+detailed+detailed+silent_visual", "medium", True, 0.8, 0.9, pytest.approx((((0.0 + 0.3) / 2 + 0.3) / 2 + 1.0) / 2))
    assert found[4][3:] == (0.6, "silent_visual", "unknown", False, 0.5, 0.6, 1.0)


def test_clip_words(spark):
    words = [("a", 8.0, 9.0), ("b", 9.9, 10.2), ("c", 10.2, 10.4), ("d", 11.0, 11.0), ("e", 13.0, 14.0)]
    lines = spark.createDataFrame([(1, 0, 8.0, 12.0, words), (1, 1, 10.0, 10.5, []), (1, 2, 10.0, 12.0, words[2:4]), (1, 3, 5.0, 11.0, words)], "video_id int, seg_idx int, start double, end double, words array<struct<word:string,start:double,end:double>>")
    clips = spark.createDataFrame([(1, 7, 10.0, 13.0)], "video_id int, segment_id int, seg_start double, seg_end double")
    found = {r.seg_idx: (round(r.line_start, 6), round(r.line_end, 6), [(w.word, round(w.start, 6), round(w.end, 6)) for w in r.words]) for r in cp.clip_words(clips, lines).collect()}
    assert found == {0: (0.3, 2.0, [("d", 1.0, 1.01)]), 2: (0.0, 2.0, [("c", 0.2, 0.4), ("d", 1.0, 1.01)])}
    assert [tuple(r) for r in cp.has_word_timing(lines.select("video_id", "words")).collect()] == [(1, 12, 9, True)]
    still = lines.select(F.lit(2).alias("video_id"), F.transform("words", lambda w: w.withField("end", w["start"])).alias("words"))
    assert [tuple(r) for r in cp.has_word_timing(still).collect()] == [(2, 12, 0, False)]


def test_run_report_levels(spark):
    entries = spark.createDataFrame([("vision", 1, "action", 0, 0, 0.5), ("vision", 2, "action", 0, 0, None), ("audio", 1, "user", 5, 20, None)], "kind string, video_id int, class string, words long, chars long, score double")
    found = {(r.level, r.kind, r["class"], r.video_id): (r.entries, r.words, r.classes, r.videos, r.mean_score) for r in rs.run_report(entries).collect()}
    assert found["kind", "vision", None, None] == (2, 0, 1, 2, 0.5) and found["kind+class", "audio", "user", None] == (1, 5, 1, 1, 0.0)
    assert found["kind+video", "vision", None, 2] == (1, 0, 1, 1, 0.0) and len(found) == 10


def test_staged_replies_have_all_shapes(spark, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    raws = [r.raw for r in rp.staged_analyses(labels).collect()]
    assert all(any(part in r for r in raws) for part in ('"zoom_decisions"', '"error":null', '"scenes":"none"', '"content_category"')) and any(r.endswith(",") for r in raws)
