"""What the later findings of round 3 were about."""

import random

from pyspark.sql import functions as F

from clipwright.functions import lexicons as lx
from clipwright.functions import titles as tt
from clipwright.operators import objects as ob
from clipwright.operators import recipes as rc
from clipwright.operators import windows as wd


def test_mean_motion_adds_up_in_order(spark):
    values = [85, 28, 97]
    orders = [(0, 1, 2), (2, 1, 0), (1, 2, 0)]
    levels = []
    for video, order in enumerate(orders):
        mean = 0.0
        for i in order:
            mean += values[i] / 100
        levels.append("high" if mean / 3 > 0.7 else "medium")
    assert set(levels) == {"high", "medium"}
    rows = [(video, pos, 10, values[i] / 100) for video, order in enumerate(orders) for pos, i in enumerate(order)]
    shape = "video_id long, pos long, ts long, motion double"
    segments = spark.createDataFrame([(v, 0, 0.0, 20.0) for v in range(3)], "video_id long, segment_id long, seg_start double, seg_end double")
    for given in (rows, rows[::-1]):
        seen = spark.createDataFrame(given, shape).coalesce(1).withColumn("face_id", F.lit(None).cast("long")).withColumn("is_change", F.lit(False))
        found = rc.visual_content(segments, seen, 86_400.0).orderBy("video_id").collect()
        assert [x["motion_level"] for x in found] == levels


def test_mean_complexity_adds_up_in_order(spark):
    # in the order of frames the threshold is next above 0.62, in the other order next below
    values = [0.12, 0.72, 0.13, 0.83, 0.62, 0.06]
    rows = [(1, i + 1, i * 2.0, x) for i, x in enumerate(values)]
    for given in (rows, rows[::-1]):
        table = spark.createDataFrame(given, "video_id long, frame_no int, ts double, complexity double").coalesce(1)
        found = wd.complexity_runs(table, 1.5, 2.0).orderBy("run_start").collect()
        assert [(x["run_start"], x["run_end"]) for x in found] == [(2.0, 4.0), (6.0, 8.0)]


def test_windows_of_many_objects_need_no_pairs(spark):
    r = random.Random(2)
    rows = []
    for video, n, longest in ((1, 300, 3000), (2, 40, 100), (3, 6, 400)):
        for i in range(n):
            start = r.randrange(2000) / 2
            rows.append((video, f"o{i % (n - 5)}", start, start + r.choice([0, 0, 10, 30, 60, longest * r.random() // 1]), r.choice([0.1, 0.4, 0.6, 0.9])))
    rows += [(2, "o1", 500.0, 700.0, -0.4), (2, "o2", 510.0, 530.0, -2.0)]
    spans = spark.createDataFrame(rows, "video_id int, object_id string, obj_start double, obj_end double, score double")
    bounds = spans.groupBy("video_id").agg((F.min("obj_start") + 60).alias("range_start"), (F.max("obj_end") - 60).alias("range_end"))
    found = ob.object_windows(spans, bounds)
    got = found.collect()
    assert len(got) > 200
    capped = 0
    for w in got:
        s, e = w["seg_start"], w["seg_end"]
        met = {}
        for video, o, a, b, score in rows:
            if video == w["video_id"] and a < e and b > s:
                met.setdefault(o, []).append((min(e, b) - max(s, a), score))
        best = {o: max(x[1] for x in xs) for o, xs in met.items()}
        total = sum(min(1.0, sum(x[0] for x in xs) / max(e - s, 1e-6)) * best[o] for o, xs in met.items())
        assert abs(w["object_score"] - min(1.0, total)) < 1e-9, w
        assert w["top_object"] == min(met, key=lambda o: (-best[o], o), default=None), w
        capped += w["object_score"] == 1
    assert 50 < capped < len(got)
    # the pairs are those of the windows that few objects are in
    windows = found.select("video_id", "seg_start", "seg_end").distinct()
    sure = ob._presence_over_one(windows, spans, 60.0)
    assert sure.where("video_id = 1").count() > 0.8 * windows.where("video_id = 1").count()


def test_titles_look_at_a_text_once(spark, sf):
    from clipwright.plans.queries import QUERIES

    plan = QUERIES["generated_titles"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    # the words of the categories don't stand in the plan once for each pattern and tag
    assert max(plan.count(ws[0]) for ws in lx.CATEGORIES.values()) <= 4
    texts = ["", None, "  \n ", " One two three four five six seven eight nine", "a b", "You won't believe this amazing trick. Watch it. Is it? No", ". . amazing . Tech? software is here for all of us.", "learn this tutorial today with all of us. So be it", "a b c d e. ", "secret   sauce and more words. secret hacks that all know, of amazing size"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    for x in tt.titled(rows).select("*", tt.title(F.col("text")).alias("want"), tt.tags(F.col("text")).alias("wanted"), F.get(tt.key_phrases(F.col("text")), F.lit(0)).alias("phrase"), tt.best_phrase(F.col("text")).alias("best")).collect():
        assert x["title"] == x["want"] and x["tags"] == x["wanted"] and x["phrase"] == x["best"]
    first = rows.select("text", tt.fallback_title(F.lit("clip"), F.col("text"), F.lit(30)).alias("f")).where("length(text) > 20").collect()
    assert first and all(x["f"] == (w if len(w := " ".join(x["text"].split()[:5])) <= 50 else w[:47] + "...") for x in first)


def test_candidates_are_compared_with_those_kept(spark):
    from clipwright.operators import select

    r = random.Random(4)
    texts = ["alpha beta gamma delta", "alpha  beta gamma\tdelta epsilon", "the and of", None, "", "Zeta eta theta"]
    rows = [(v, i, s := r.randrange(80) / 2, s + r.randrange(15, 30), r.choice(texts), r.choice(["a", "a", None]), r.randrange(3), r.randrange(9) / 9) for v in range(6) for i in range(40)]
    table = spark.createDataFrame(rows, "video_id int, segment_id int, seg_start double, seg_end double, text string, method string, priority int, preliminary_quality double")
    found = select.deduplicated(table.repartition(3), 12, 0.7)
    plan = found._jdf.queryExecution().toString()
    assert "FlatMapGroups" not in plan and "_bucket" not in plan
    stop, want = set(lx.STOP_WORDS), set()
    for v in range(6):
        kept = []
        for x in sorted((x for x in rows if x[0] == v), key=lambda x: (x[6], -x[7], x[2] - x[3], x[2], x[1])):
            near = False
            for k in kept:
                shared = min(x[3], k[3]) - max(x[2], k[2])
                a, b = (set((y[4] or "").lower().split()) - stop for y in (x, k))
                if shared > 0 and shared / min(x[3] - x[2], k[3] - k[2]) > 0.5 and x[5] and k[5]:
                    near |= ((len(a & b) / len(a | b)) * 0.5 + 0.2) / 0.7 > 0.7 if a | b else 1.0 > 0.7
            if not near and len(kept) < 12:
                kept.append(x)
        want |= {(v, k[1]) for k in kept}
    assert {(x["video_id"], x["segment_id"]) for x in found.collect()} == want


def noted_case(spark):
    from clipwright.operators import intervals as iv

    texts = ["Breathe in.", " we come", "into it!  Bring ", "your best", None, "", "  \n ", "...", "How to. do...it", "take", "a pose, now", "this WHICH\tthat", "Σ ÉÀ hello?", "stretch-", "a.b.c. d"]
    r = random.Random(6)
    lines = [(v, i, r.choice(texts) if v else texts[i], i * 4.0, i * 4.0 + r.choice([0.0, 3.0, 6.0])) for v in range(12) for i in range(12)]
    lines = spark.createDataFrame(lines, "video_id int, seg_idx int, text string, start double, end double")
    spans = [(v, i, s := float(r.randrange(60)), s + r.randrange(1, 70)) for v in range(13) for i in range(15)]
    spans = spark.createDataFrame(spans, "video_id int, segment_id int, seg_start double, seg_end double")
    return iv.segment_text(spans, lines), iv.segment_text(spans, lines, notes=True)


def test_scores_from_notes_of_lines_equal_those_of_texts(spark):
    from clipwright.operators import select

    plain, noted = noted_case(spark)
    assert plain.where("contains(lower(text), 'come into')").count() and plain.where("text = ''").count()
    a, b = select.scored(rc.validated(plain)), select.scored(rc.validated(noted))
    assert a.columns == b.columns
    key = lambda x: (x["video_id"], x["segment_id"])
    assert sorted(a.collect(), key=key) == sorted(b.collect(), key=key)


def test_clip_scores_look_at_lines_once(spark, sf):
    from clipwright.plans.recipes import QUERIES

    for name in ("cross_validation", "cross_validation_summary", "unlike_selection"):
        plan = QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
        # words of windows are those of their lines, and texts are neither split into pieces nor gathered to be looked at
        assert "_words" in plan and "array_distinct(split(" not in plan and "_part," not in plan, name


def test_unlike_words_stream(spark):
    r = random.Random(8)
    words = "ab cd ef gh ij kl".split()
    texts = ["", None, " \t ", *[" ".join(r.choices(words, k=r.randrange(1, 8))) for _ in range(40)]]
    rows = [(v, i, float(s := r.randrange(90)), float(s + r.choice([5, 15, 40, 60, 61])), r.choice(texts), r.randrange(5) / 5) for v in range(8) for i in range(60)]
    table = spark.createDataFrame(rows, "video_id int, segment_id int, seg_start double, seg_end double, text string, quality_score double")
    for most, alike in ((10, 0.7), (4, 0.5), (30, 0.0), (6, 1.0)):
        found = rc.unlike_selection(table.repartition(3), most, alike=alike)
        assert "array_intersect" not in found._jdf.queryExecution().toString()
        want = set()
        for v in range(8):
            kept = []
            for x in sorted((x for x in rows if x[0] == v and 15 <= x[3] - x[2] <= 60), key=lambda x: (-x[5], x[2], x[1])):
                w = set((x[4] or "").lower().split())
                if len(kept) < most and not any(len(w & k) / max(len(w | k), 1) > alike for k in kept):
                    kept.append(w)
                    want.add((v, len(kept), x[1]))
        assert {tuple(x) for x in found.collect()} == want
    assert found.columns == ["video_id", "place", "segment_id"]


def test_windows_are_made_where_the_lines_are(spark, sf):
    from clipwright.plans.queries import QUERIES

    plan = QUERIES["quality_windows"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
