import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from clipwright.functions import text as tx
from clipwright.operators import candidates, captions, intervals, select, tracking, vectors, windows

SEGMENT = "video_id long, segment_id int, seg_start double, seg_end double, quality_score double, text string, method string, priority int, preliminary_quality double"


def segments(spark, n=60, seed=0):
    r = random.Random(seed)
    rows = []
    for v in (1, 2):
        for i in range(n):
            start = r.randrange(400) / 2
            words = " ".join(r.choice(["how", "you", "breathe", "move", "fast", "calm", "alpha", "beta"]) for _ in range(4))
            rows.append((v, i + 1, start, start + r.randrange(20, 120) / 2, r.randrange(100) / 100, words, r.choice(["content_aware", "quality_driven"]), r.randrange(1, 4), r.randrange(100) / 100))
    return spark.createDataFrame(rows, SEGMENT), rows


def by_video(rows):
    return {v: list(g) for v, g in itertools.groupby(sorted(rows), key=lambda r: r[0])}


@pytest.mark.parametrize("width", [7.0, 60.0, 10_000.0])
@pytest.mark.parametrize("closed", [False, True])
def test_interval_join_equals_nested_loops(spark, width, closed):
    r = random.Random(1)
    left = [(r.randrange(3), i, float(r.randrange(200)), 0.0) for i in range(80)]
    left = [(v, i, s, s + r.randrange(60)) for v, i, s, _ in left]
    right = [(r.randrange(3), i, float(r.randrange(200)), 0.0) for i in range(80)]
    right = [(v, i, s, s + r.randrange(30)) for v, i, s, _ in right]
    a, b = spark.createDataFrame(left, "video_id int, a int, s1 double, e1 double"), spark.createDataFrame(right, "video_id int, b int, s2 double, e2 double")
    got = {(x["a"], x["b"]) for x in intervals.interval_join(a, b, ["video_id"], ("s1", "e1"), ("s2", "e2"), width, closed).collect()}
    meet = (lambda x, y: x[2] <= y[3] and y[2] <= x[3]) if closed else (lambda x, y: x[2] < y[3] and y[2] < x[3])
    assert got == {(x[1], y[1]) for x in left for y in right if x[0] == y[0] and meet(x, y)}
    outer = intervals.interval_join(a, b, ["video_id"], ("s1", "e1"), ("s2", "e2"), width, closed, "left")
    assert outer.where("b is null").count() == len({x[1] for x in left} - {p for p, _ in got}) and outer.where("b is not null").count() == len(got)


def test_greedy_selection(spark):
    table, rows = segments(spark)
    got = {(r["video_id"], r["segment_id"]) for r in select.greedy_top(table, 4).collect()}
    assert got == {(r["video_id"], r["segment_id"]) for r in select.greedy_top(table.repartition(17), 4).collect()}
    want = set()
    for v, group in by_video(rows).items():
        kept = []
        for r in sorted(group, key=lambda r: (-r[4], r[2], r[3], r[1])):
            if len(kept) < 4 and all(r[2] >= k[3] or k[2] >= r[3] for k in kept):
                kept.append(r)
        want |= {(v, k[1]) for k in kept}
    assert got == want


def test_deduplication(spark):
    table, rows = segments(spark)
    got = {(r["video_id"], r["segment_id"]) for r in select.deduplicated(table, 25, 0.5).collect()}
    want = set()
    for v, group in by_video(rows).items():
        kept = []
        for r in sorted(group, key=lambda r: (r[7], -r[8], r[2] - r[3], r[2], r[1])):
            for k in kept:
                shared = min(r[3], k[3]) - max(r[2], k[2])
                a, b = set(r[5].split()), set(k[5].split())
                alike = (len(a & b) / len(a | b) * 0.5 + (r[6] == k[6]) * 0.2) / 0.7
                if shared > 0 and shared / min(r[3] - r[2], k[3] - k[2]) > 0.5 and alike > 0.5:
                    break
            else:
                if len(kept) < 25:
                    kept.append(r)
        want |= {(v, k[1]) for k in kept}
    assert got == want


def test_folds(spark):
    table, rows = segments(spark, 40, 3)
    near = {(r["video_id"], r["segment_id"]) for r in select.near_duplicates_merged(table).collect()}
    want = set()
    for v, group in by_video(rows).items():
        kept = []
        for r in sorted(group, key=lambda r: (r[2], r[3], r[1])):
            if kept and abs(r[2] - kept[-1][2]) <= 5 and abs(r[3] - kept[-1][3]) <= 5:
                if r[4] > kept[-1][4]:
                    kept[-1] = r
            else:
                kept.append(r)
        want |= {(v, k[1]) for k in kept}
    assert near == want
    split = select.resolved_overlaps(table).orderBy("video_id", "seg_start").collect()
    assert len(split) == len(rows)
    points = spark.createDataFrame([(1, t) for t in (0.0, 1.0, 5.0, 5.5, 9.9, 10.0)], "video_id int, ts double")
    assert sorted(r["ts"] for r in select.spaced(points, 5.0).collect()) == [0.0, 5.0, 10.0]
    breaks = spark.createDataFrame([(1, 0.0, "a", 0.5), (1, 1.0, "v", 0.9), (1, 2.5, "v", 0.1), (1, 3.1, "a", 0.2), (1, 9.0, "a", 0.1)], "video_id int, ts double, type string, confidence double")
    assert sorted((r["ts"], r["confidence"]) for r in select.merged_breaks(breaks).collect()) == [(1.0, 0.9), (3.1, 0.2), (9.0, 0.1)]


@pytest.mark.parametrize(
    ("times", "want"),
    [
        ([10, 20, 30, 40, 50], [(0, 60)]),
        ([10, 100, 200, 300], [(0, 60), (70, 130), (170, 230), (270, 330)]),
    ],
)
def test_actor_windows(spark, times, want):
    seen = spark.createDataFrame([(1, "x", t) for t in times], "video_id int, actor string, t int")
    assert sorted((r["seg_start"], r["seg_end"]) for r in select.actor_segments(seen).collect()) == want


def test_diverse_selection(spark):
    table, rows = segments(spark)
    found = select.diverse(table, 6).collect()
    for v in (1, 2):
        own = [r for r in found if r["video_id"] == v]
        assert 1 <= len(own) <= 6 and len({r["segment_id"] for r in own}) == len(own)
        best = max((r for r in rows if r[0] == v and ("how" in r[5])), key=lambda r: (r[4], -r[2]))
        assert best[4] <= max(r["quality_score"] for r in own if "instruction" in r["categories"])


def test_boundaries_stay_in_range(spark, sf):
    from clipwright import staging

    lines = staging.transcript(spark, sf)
    clips = lines.groupBy("video_id").agg(F.lit(1).alias("segment_id"), F.lit(3.0).alias("seg_start"), F.lit(9.0).alias("seg_end"))
    for r in select.clean_boundaries(clips, lines).collect():
        assert 15.0 <= r["seg_end"] - r["seg_start"] <= 60.0


def test_tracker_and_layout(spark):
    rows = [(1, f, f * 2 + k, "a", 100 * k * 5 + f, 10) for f in range(20) for k in (0, 1)] + [(1, 40, 99, "a", 19, 10)]
    got = {r["det_id"]: r["track"] for r in tracking.tracked(spark.createDataFrame(rows, "video_id long, frame_no int, det_id long, class_name string, cx long, cy long")).collect()}
    assert {got[i] for i in range(0, 40, 2)} == {"a_1"} and {got[i] for i in range(1, 40, 2)} == {"a_2"} and got[99] == "a_3"
    flips = [1, 1, 1, 2, 1, 2, 2, 2, 1]
    frames = spark.createDataFrame([(1, i, s) for i, s in enumerate(flips)], "video_id int, frame_no int, speakers int")
    got = [r["layout"][0] for r in tracking.stable_layout(frames, 3).orderBy("frame_no").collect()]
    buffer, want = [], []
    for s in flips:
        own = "split_screen" if s >= 2 else "single_speaker"
        buffer = [*buffer, own][-6:]
        old = buffer[-6:-3]
        want.append((own if len(buffer) >= 3 and set(buffer[-3:]) == {own} else old[0] if old and len(set(old)) == 1 else own)[0])
    assert got == want


def test_non_max_suppression(spark):
    boxes = [(1, 0, 1, 0.9, 0, 0, 10, 10), (1, 0, 2, 0.8, 1, 1, 11, 11), (1, 0, 3, 0.7, 50, 50, 60, 60), (1, 1, 4, 0.1, 0, 0, 10, 10)]
    table = spark.createDataFrame(boxes, "video_id int, day int, det_id int, confidence double, x1 int, y1 int, x2 int, y2 int")
    assert sorted(r["det_id"] for r in tracking.without_duplicates(table, "day").collect()) == [1, 3, 4]


def test_leader_clusters(spark):
    r = np.random.default_rng(0)
    rows = [(i, r.standard_normal(8).tolist(), i % 2) for i in range(60)]
    got = {x["vec_id"]: x["leader_id"] for x in vectors.leader_clusters(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), "label", 0.5).collect()}
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v, _ in rows}
    for label in (0, 1):
        leaders = []
        for i, _, own in rows:
            if own == label:
                near = [k for k in leaders if unit[k] @ unit[i] > 0.5]
                assert got[i] == (near[0] if near else i)
                leaders += [] if near else [i]


def test_caption_chunks(spark):
    lines = spark.createDataFrame([(1, 0, 0.0, 7.0, "One two, three four five six. Seven"), (1, 1, 7.0, 8.0, None)], "video_id int, seg_idx int, start double, end double, text string")
    found = captions.chunks(captions.timed_words(lines)).orderBy("chunk").collect()
    assert [(r["text"], r["start"], r["end"]) for r in found] == [("One two,", 0.0, 2.0), ("three four five six.", 2.0, 6.0), ("Seven", 6.0, 7.0)]
    assert [r["text"] for r in captions.typewriter(captions.chunks(captions.timed_words(lines))).where("chunk = 1").orderBy("k").collect()] == ["three", "three four", "three four five", "three four five six."]


def test_wrapped_captions(spark):
    cases = ["short", "  a \n b  ", "x" * 30 + " " + "y" * 30, " ".join(["word"] * 30), "z" * 90]

    def plain(text):
        text = " ".join(text.split())
        if len(text) <= 40:
            return text
        lines, line, n = [], [], 0
        for w in text.split():
            if n + len(w) + 1 <= 40:
                line.append(w)
                n += len(w) + 1
            else:
                if line:
                    lines.append(" ".join(line))
                line, n = [w], len(w)
        lines.append(" ".join(line))
        return "\n".join(lines) if len(lines) <= 2 else f"{lines[0]}\n{lines[1]}..."

    got = [r[0] for r in spark.createDataFrame([(c,) for c in cases], "t string").select(tx.wrapped_caption(F.col("t"))).collect()]
    assert got == [plain(c) for c in cases]


def test_null_and_empty_texts(spark):
    table = spark.createDataFrame([(None,), ("",), (" ",), ("Hello you.",)], "t string")
    t = F.col("t")
    row = table.select(tx.segment_text_quality(t), tx.clip_engagement(t), tx.clip_type(t), tx.emotional_intensity(t), tx.viral_potential(F.coalesce(t, F.lit(""))), tx.end_quality(t), tx.flow_quality(t), tx.n_words(t)).collect()
    assert row[0][0] == row[1][0] == 0.0 and row[0][2] == "general" and row[3][7] == 2 and row[0][6] == "poor"


def test_empty_tables(spark, sf):
    from clipwright import staging

    lines, videos = staging.transcript(spark, sf).limit(0), staging.videos(spark, sf).limit(0)
    for found in (windows.pause_patterns(lines), windows.speech_stats(lines), candidates.quality_windows(lines, videos), candidates.content_aware(lines), candidates.sliding_windows(videos), windows.preroll_end(lines, videos)):
        assert found.count() == 0


def test_all_candidates_are_in_range(spark, sf):
    from clipwright import staging

    lines, videos = staging.transcript(spark, sf), staging.videos(spark, sf)
    found = candidates.numbered(candidates.all_candidates(lines, staging.breaks(spark, sf), videos, 15, 30)).join(videos.select("video_id", "duration"), "video_id")
    assert found.count() > 100
    assert found.where("seg_start < 0 or seg_end > duration or seg_end - seg_start < 15 or seg_end - seg_start > 30").count() == 0


def test_titles_and_highlights(spark):
    from clipwright.functions import titles as tt

    text = "This secret trick is amazing. Nothing here. Do you want to learn it? Short. It is shocking to discover this. Plain words follow here"
    t = F.col("t")
    row = spark.createDataFrame([(text,)], "t string").select(tt.highlights(t).alias("h"), tt.key_phrases(t).alias("k"), tt.title(t).alias("title"), tt.tags(t).alias("tags"), tt.hashtags(F.lit("#One two #one #Three")).alias("hash"), tt.clean_filename(F.lit("/a/my_clip-1080p.final.mp4")).alias("name"), tt.cleaned_reply(F.lit('{"title": "**A  b**"}')).alias("reply"), tt.cleaned_reply(F.lit('"Title: C"')).alias("label")).first()
    assert row["h"] == ["This secret trick is amazing", "It is shocking to discover this", "Do you want to learn it? Short"]
    assert row["k"] == ["This secret trick is amazing", "It is shocking to discover this", "Do you want to learn it? Short"]
    assert row["title"] == "This Will Blow Your Mind: This secret trick is amazing"
    assert row["tags"] == ["learn", "tutorial", "education", "howto", "tips", "viral", "trending", "amazing", "mustwatch", "interactive"]
    assert (row["hash"], row["name"], row["reply"], row["label"]) == (["one", "three"], "My Clip Final", "A b", "C")


def test_prompts(spark):
    from clipwright.operators import prompts as pr

    rows = [(1, "Show the dramatic climax scenes"), (2, "make me laugh"), (3, "120 Hz display, 5,000 mAh on the X200 in 4k"), (4, "Anna Berg and the hat"), (5, "an emotional part")]
    table = spark.createDataFrame(rows, "request_id int, prompt string")
    found = {r["request_id"]: r for r in pr.analysed(table).collect()}
    assert found[1]["climax"] and found[2]["comedy"] and found[2]["theme"] == "comedy" and not found[5]["climax"] and found[5]["theme"] == "emotional"
    tokens = {r["request_id"]: r["t"] for r in table.select("request_id", pr.focus_tokens(F.col("prompt")).alias("t")).collect()}
    assert tokens[3] == ["120hz", "5000mah", "display", "x200"] and tokens[2] == []
    names = spark.createDataFrame([("Anna Berg",), ("Bob Hat",), ("Carl",)], "entity string")
    assert {(r["request_id"], r["entity"]) for r in pr.mentioned(table, names).collect()} == {(4, "Anna Berg"), (4, "Bob Hat")}
    scores = spark.createDataFrame([(1, 3, 0.1), (1, 0, 0.9), (2, 1, 0.2), (3, 1, 0.3), (4, 0, 0.9), (5, 2, 0.0)], "request_id int, matches int, score double")
    assert {r["request_id"]: r["threshold"] for r in pr.dynamic_threshold(scores).collect()} == {1: 0.3, 2: 0.55, 3: 0.45, 4: 0.6, 5: 0.4}


def test_framing_folds(spark):
    from clipwright.operators import framing as fr

    zooms = [1.0, 3.0, 1.0, 1.0, 2.0]
    table = spark.createDataFrame([(1, i, z) for i, z in enumerate(zooms)], "video_id int, ts int, zoom double")
    got = [r["zoom"] for r in fr.smoothed_zoom(table, 0.1).orderBy("ts").collect()]
    mean = [np.mean(zooms[max(0, i - 1) : i + 2]) for i in range(5)]
    want = [mean[0]]
    for m in mean[1:]:
        want.append(min(max(m, want[-1] - 0.1), want[-1] + 0.1))
    assert np.allclose(got, want)
    smooth = [r["zoom"] for r in fr.gaussian_smoothed(table, ["zoom"], 0.7).orderBy("ts").collect()]
    radius = int(4 * 0.7 + 0.5)
    kernel = np.exp(-0.5 * (np.arange(-radius, radius + 1) / 0.7) ** 2)
    padded = np.pad(zooms, radius, mode="symmetric")
    assert np.allclose(smooth, np.convolve(padded, kernel / kernel.sum(), "valid"))
    frames = spark.createDataFrame([(1, 1, 8.0, "action", 2, True, False), (1, 1, 4.0, "slides", 0, False, True), (1, 1, 6.0, "action", 1, False, False)], "video_id int, segment_id int, visual_interest double, scene_type string, people_count int, has_action boolean, has_emotion boolean")
    row = fr.aggregated_vision(frames).first()
    assert row["scene_type"] == "action" and abs(row["visual_score"] - min(1.0, 0.6 + 0.05 + 0.12 + 0.1 + 0.05 + 0.03 + 0.05)) < 1e-9


def test_resolved_overlaps_dense_and_nested(spark):
    import __spark_entry__ as entry
    from clipwright.plans import queries

    rows = [(1, 1, 0.0, 10.0), (1, 2, 8.0, 20.0), (2, 1, 0.0, 100.0), (2, 2, 10.0, 20.0), (2, 3, 12.0, 14.0), (2, 4, 13.0, 60.0), (3, 1, 0.0, 8.0), (3, 2, 0.0, 8.0), (3, 3, 0.0, 8.0), (3, 4, 8.0, 9.0)]
    table = spark.createDataFrame(rows, "video_id int, segment_id int, seg_start double, seg_end double")
    got = {(r["video_id"], r["segment_id"]): (r["seg_start"], r["seg_end"]) for r in select.resolved_overlaps(table).collect()}
    assert got[1, 1] == (0.0, 9.0) and got[1, 2] == (9.0, 20.0)
    assert got[2, 1] == (0.0, 15.0) and got[2, 2][0] == 15.0
    assert set(got) == {r[:2] for r in rows}
    for a, b in [(k, (k[0], k[1] + 1)) for k in got if (k[0], k[1] + 1) in got]:
        assert got[a][0] <= got[a][1] <= got[b][0] <= got[b][1]
    folder = "/root/testdata/sf0.001"
    assert entry.queries()["resolved_overlaps"](spark, folder).count() == queries.clips(spark, folder).count()


def test_search_in_blocks(spark):
    r = np.random.default_rng(1)
    rows = [(i, r.standard_normal(6).tolist()) for i in range(200)] + [(200, [0.0] * 6), (201, None)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    refs = table.where("vec_id % 5 = 0").selectExpr("vec_id as ref_id", "embedding as ref")
    x = {i: np.array(v, np.float32).astype(float) for i, v in rows if v}
    want = []
    for i in range(0, 200, 5):
        scored = sorted((-round(float(x[i] @ x[j] / np.linalg.norm(x[i]) / np.linalg.norm(x[j])), 3), j) for j in range(200))
        want += [(i, j, -s, k + 1) for k, (s, j) in enumerate(y for y in scored[:4] if -y[0] >= 0.3)]
    found = vectors.search(table, refs, 0.3, 4, block=7, piece=30)
    assert sorted(tuple(y) for y in found.collect()) == sorted(want)
    assert "Cartesian" not in (plan := found._jdf.queryExecution().toString()) and "NestedLoop" not in plan
