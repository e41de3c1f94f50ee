"""What the findings of round 4 were about."""

import random
from decimal import Decimal

from pyspark.sql import functions as F

from clipwright.functions import lexicons as lx
from clipwright.operators import reports as rs
from clipwright.operators import select
from clipwright.operators import windows as wd


def test_intensity_is_next_to_its_exact_sum(spark):
    said = [" ".join(["!"] * bool(v & 1) + ["?"] * bool(v & 2) + ["loud"] * bool(v & 4) + ["amazing"] * bool(e & 1) + ["dramatic"] * bool(e & 2) + ["intense"] * bool(e & 4)) for v in range(8) for e in range(8)]
    rows = [(1, i, t, n, 0.0, 2.0) for i, (t, n) in enumerate((t, n) for t in said for n in (1, 2, 3, 4, 7))]
    found = wd.intensity(spark.createDataFrame(rows, "video_id int, seg_idx int, text string, n_words int, start double, end double"))
    signs = lambda t, words, x: min(Decimal(1), sum(w in t for w in words) * Decimal(x)) * Decimal("0.4")
    pace = {1: "0.8", 2: "0.6", 3: "0.4", 4: "0.4", 7: "0.8"}
    for x in found.collect():
        text, n = rows[x["seg_idx"]][2:4]
        assert x["intensity"] == float(signs(text, ["!", "?", "loud"], "0.2") + signs(text, ["amazing", "dramatic", "intense"], "0.15") + Decimal(pace[n]) * Decimal("0.2")), (text, n)


def test_climax_scores_add_up_in_the_order_of_lines(spark):
    r = random.Random(9)
    lines = [(v, i, i * 4.0, i * 4.0 + 4, r.randrange(1000) / 1000) for v in range(30) for i in range(25)]
    spans = [(v, i, s := float(r.randrange(50)), s + r.choice([16, 25, 32, 45]), r.randrange(100) / 100, "") for v in range(30) for i in range(8)]
    segments = spark.createDataFrame(spans, "video_id int, segment_id int, seg_start double, seg_end double, quality_score double, text string")
    stop, want = 100.0, {}
    for v, i, s, e, quality, _ in spans:
        mean, n = 0.0, 0
        for x in (x for x in lines if x[0] == v and x[2] < e and x[3] > s):
            mean, n = mean + x[4], n + 1
        place = (s + e) / 2 / stop
        late = -0.9 if place > 0.92 else -0.7 if place > 0.9 else -0.4 if place > 0.87 else 0.0
        bonus = 0.15 if 0.6 <= place <= 0.8 else 0.1 if 0.5 <= place <= 0.85 else 0.0
        length = {16: 0.06, 25: 0.08, 32: 0.1, 45: 0.1}[e - s]
        want[v, i] = max(0.0, mean / n * 0.25 + max(0.0, 1 - abs(place - 0.75) * 2) * 0.2 + quality * 0.15 + length + late + bonus)
    for given in (lines, lines[::-1], r.sample(lines, len(lines))):
        timeline = spark.createDataFrame(given, "video_id int, seg_idx int, start double, end double, intensity double").repartition(3, F.col("seg_idx"))
        found = {(x["video_id"], x["segment_id"]): x["climax_score"] for x in rs.climax_scores(segments, timeline).collect()}
        assert found == want


def unlike(rows, similarity):
    """(video_id, segment_id) of what stays of rows (video_id, segment_id, seg_start, seg_end, text, method, priority, preliminary_quality)."""
    stop, stays = set(lx.STOP_WORDS), set()
    for v in {x[0] for x in rows}:
        kept = []
        for x in sorted((x for x in rows if x[0] == v), key=lambda x: (x[6], -x[7], x[2] - x[3], x[2], x[1])):
            near = False
            for k in kept:
                shared = min(x[3], k[3]) - max(x[2], k[2])
                if shared > 0 and shared / min(x[3] - x[2], k[3] - k[2]) > 0.5 and x[5] and k[5]:
                    a, b = (set((y[4] or "").lower().split()) - stop for y in (x, k))
                    same = x[5] == k[5]
                    near |= ((len(a & b) / len(a | b)) * 0.5 + same * 0.2) / 0.7 > similarity if a | b else same > similarity
            if not near:
                kept.append(x)
        stays |= {(v, k[1]) for k in kept}
    return stays


def test_all_unlike_candidates_stay(spark):
    r = random.Random(12)
    words = "alpha beta gamma delta epsilon zeta the of".split()
    rows = [(v, i, s := r.randrange(-100, 12_000) / 2, s + r.choice([0, -5, 15, 40, 60, 60, 200, 5000]), r.choice([None, "", *[" ".join(r.choices(words, k=3)) for _ in range(6)]]), r.choice(["a", "a", "b", None]), r.randrange(3), r.randrange(9) / 9) for v in range(4) for i in range(900)]
    shape = "video_id int, segment_id int, seg_start double, seg_end double, text string, method string, priority int, preliminary_quality double"
    want = unlike(rows, 0.7)
    timeless = [(1, 5000, None, 10.0, "x", "a", 0, 1.0), (1, 5001, 0.0, None, "x", "a", 0, 1.0), (1, 5002, None, None, "x", "a", 0, 1.0)]
    found = select.deduplicated(spark.createDataFrame(rows + timeless, shape).repartition(3), similarity=0.7)
    assert {(x["video_id"], x["segment_id"]) for x in found.collect()} == want | {x[:2] for x in timeless}
    assert all(200 < sum(w[0] == v for w in want) < 900 for v in range(4))


def test_a_long_video_keeps_all_unlike_candidates(spark, tmp_path):
    from clipwright.plans import queries as qs

    r = random.Random(13)
    said = [(v, t, "user", " ".join(f"w{r.randrange(400)}" for _ in range(r.randrange(10, 60))) + ", you see?") for v, n in ((1, 60), (2, 5)) for t in range(n)]
    spark.createDataFrame(said, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    given = select.preliminary_quality(qs.clip_texts(spark, str(tmp_path))).select("video_id", "segment_id", "seg_start", "seg_end", "text", "method", "priority", "preliminary_quality")
    want = unlike([tuple(x) for x in given.collect()], 0.8)
    got = {(x["video_id"], x["segment_id"]) for x in qs.QUERIES["dedup_candidates"](spark, str(tmp_path)).collect()}
    assert got == want and sum(v == 1 for v, _ in want) > 50


def test_folds_see_whole_videos_of_a_union(spark, tmp_path):
    from clipwright import staging as st

    r = random.Random(14)
    said = [(v, t, "user", " ".join(["word"] * r.randrange(3, 30))) for v in range(1500) for t in range(r.randrange(1, 9))]
    spark.createDataFrame(said, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    # small partitions are put together by size, which differs between the tables of the union
    sizes = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "100b", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "3k"}
    before = {k: spark.conf.get(k, None) for k in sizes}
    try:
        for k, v in sizes.items():
            spark.conf.set(k, v)
        breaks = [tuple(x) for x in st.breaks(spark, str(tmp_path)).select("video_id", "ts", "type", "confidence").collect()]
        found = select.merged_breaks(st.breaks(spark, str(tmp_path)))
        got = [tuple(x) for x in found.collect()]
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    want = []
    for x in sorted(breaks):
        if not want or want[-1][0] != x[0] or x[1] - want[-1][1] >= 2.0:
            want.append(x)
        elif x[3] > want[-1][3]:
            want[-1] = x
    assert sorted(got) == want and len(want) < len(breaks)
    assert "REPARTITION_BY_COL" in found._jdf.queryExecution().executedPlan().toString()
