"""What the findings of round 3 were about."""

import random

import pytest
from pyspark.sql import functions as F

from clipwright.operators import intervals, tracking
from clipwright.plans.queries import rounded


def test_non_max_suppression_of_a_large_frame(spark):
    r = random.Random(3)
    rows = [(1, 0, i, r.randrange(50) / 50, (x := r.randrange(300)), (y := r.randrange(300)), x + r.randrange(10, 40), y + r.randrange(10, 40)) for i in range(600)]
    rows += [(2, d, d, 0.5, 0, 0, 10, 10) for d in range(20)] + [(3, 0, 900, 0.9, None, 0, 1, 1), (3, 0, 901, 0.8, 0, 0, 1, 1)]
    table = spark.createDataFrame(rows, "video_id int, day int, det_id int, confidence double, x1 int, y1 int, x2 int, y2 int")
    found = tracking.without_duplicates(table.repartition(5), "day", 0.1)
    assert "FlatMapGroups" not in found._jdf.queryExecution().toString()
    want = []
    for b in sorted((b for b in rows if b[0] == 1), key=lambda b: (-b[3], b[2])):
        if all(tracking._iou(b[4:], k[4:]) <= 0.1 for k in want):
            want.append(b)
    assert len(want) > 64
    assert {x["det_id"] for x in found.collect()} == {b[2] for b in want} | set(range(20)) | {900, 901}


def test_spans_are_few_rows_where_buckets_fit(spark):
    points = spark.range(2000).selectExpr("id % 3 as video_id", "id as det_id", "cast(id * 97 as double) as ts")
    spans = spark.range(3).selectExpr("explode(sequence(0, 2)) as segment_id", "id as video_id").selectExpr("video_id", "segment_id", "segment_id * 86400.0d as span_start", "segment_id * 86400.0d + 43200 as span_end")
    wide, narrow = (sorted(tuple(x) for x in intervals.first_containing(points, spans, ["video_id", "det_id"], width=w).select("det_id", "segment_id").collect()) for w in (86_400.0, 60.0))
    assert wide == narrow and len(wide) > 900


@pytest.mark.parametrize("x, places, want", [(((((0.0 + 0.3) / 2 + 0.0) / 2) + 0.3) / 2 / 2, 5, None), (0.48324999999999996, 4, 0.4833), (-0.00005, 4, -0.0001), (None, 4, None)])
def test_halves_round_as_in_sql(spark, x, places, want):
    import duckdb

    got = rounded(spark.createDataFrame([(x,)], "x double"), "x", places=places).first()[0]
    assert got == duckdb.execute("select round(?::double, ?)", [x, places]).fetchone()[0]
    assert want is None or got == want


def test_equal_texts_are_looked_at_once(spark):
    from clipwright.functions.text import same_texts, segments_of

    rows = [(v, i, float(i), i + 20.0, t, ["a"]) for v in (1, 2) for i, t in enumerate(["x y", "x y", "", "x y", None, ""])] + [(1, 9, 5000.0, 5020.0, "x y", ["a"])]
    table = spark.createDataFrame(rows, "video_id int, segment_id int, seg_start double, seg_end double, text string, keywords array<string>")
    texts = same_texts(table, "video_id", "keywords")
    assert texts.count() == 7
    found = segments_of(texts.withColumn("n", F.length("text")), "n")
    assert sorted(map(str, found.select(*table.columns).collect())) == sorted(map(str, table.collect()))
    assert {(r["segment_id"], r["n"]) for r in found.collect()} >= {(1, 3), (2, 0), (4, None), (9, 3)}


def test_scores_run_nothing_ahead(spark, sf):
    from clipwright.plans.queries import scored_clips

    spark.sparkContext.setJobGroup("round3", "plans only")
    scored_clips(spark, sf)
    tracker = spark.sparkContext.statusTracker()
    jobs = [tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup("round3")]
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    # reading a file's schema is a job of one task; running the query was many
    assert all(sum(tracker.getStageInfo(i).numTasks for i in j.stageIds if tracker.getStageInfo(i)) == 1 for j in jobs if j) and len(jobs) <= 8


def test_at_least_equals_topped_up(spark):
    from clipwright.operators import recipes as rc

    r = random.Random(5)
    rows = spark.createDataFrame([(v, i, r.choice([0.1, 0.5, 0.7, 0.9, None])) for v in range(30) for i in range(r.randrange(1, 7))], "request_id int, segment_id int, score double")
    want = rc.topped_up(rows.where("score >= 0.65"), rows, "request_id", 3, "score")
    found = rc.at_least(rows, F.col("score") >= 0.65, "request_id", 3, "score")
    assert sorted(map(tuple, found.select("request_id", "segment_id").collect())) == sorted(map(tuple, want.select("request_id", "segment_id").collect()))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join") == 0


def test_last_references_are_those_of_the_search(spark):
    from clipwright.operators import vectors as vc

    r = random.Random(7)
    rows = [(i % 290, [r.gauss(0, 1) for _ in range(4)]) for i in range(300)] + [(500, [0.0] * 4), (501, None)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    references = table.where("vec_id % 10 = 0").selectExpr("vec_id as ref_id", "embedding as ref")
    every = vc.search(table, references, 0.2, 1000).groupBy("vec_id").agg(F.max(F.struct("ref_id", "score")).alias("m"), F.count("*").alias("n"))
    want = {x["vec_id"]: tuple(x["m"]) for x in every.collect()}
    got = vc.last_references(table, references, 0.2, block=7, piece=50).collect()
    assert {x["vec_id"]: (x["ref_id"], x["score"]) for x in got} == want and len(got) == len(want) > 200
    assert every.agg(F.sum("n")).first()[0] > 5 * len(got)


def test_scores_are_joined_to_segments(spark):
    from clipwright.operators import objects as ob

    spans = spark.range(40).selectExpr("id % 2 as video_id", "concat('o', id % 7) as object_id", "id * 10.0d as start_sec", "id * 10.0d + 5 as end_sec")
    documents = ob.object_documents(spans).unionByName(spark.createDataFrame([(9, [])], ob.object_documents(spans).schema))
    matched = spans.where("start_sec % 30 = 0").selectExpr("*", "explode(array(1, 2)) as ref_id").withColumn("score", F.col("ref_id") / 10.0)
    found = ob.with_reference_scores(documents, matched)
    assert "map_from_entries" not in found._jdf.queryExecution().optimizedPlan().toString()
    before = {r["video_id"]: r["objects"] for r in documents.collect()}
    for row in found.collect():
        assert [(o["object_id"], [(s["start_sec"], s["end_sec"]) for s in o["segments"]]) for o in row["objects"]] == [(o["object_id"], [(s["start_sec"], s["end_sec"]) for s in o["segments"]]) for o in before[row["video_id"]]]
        for s in (s for o in row["objects"] for s in o["segments"]):
            assert (s["reference_match"] and s["reference_match"]["score"]) == (0.2 if s["start_sec"] % 30 == 0 else None)


def test_folds_are_streams(spark):
    from clipwright.operators import select

    r = random.Random(11)
    rows = [(v, i, s := r.randrange(60) / 2, s + r.randrange(15, 25), r.randrange(100) / 100) for v in range(40) for i in range(r.randrange(1, 12))]
    found = select.near_duplicates_merged(spark.createDataFrame(rows, "video_id int, segment_id int, seg_start double, seg_end double, quality_score double").repartition(3))
    assert "FlatMapGroups" not in found._jdf.queryExecution().toString()
    want = []
    for v in range(40):
        kept = []
        for row in sorted((x for x in rows if x[0] == v), key=lambda x: (x[2], x[3], x[1])):
            if not kept or abs(row[2] - kept[-1][2]) > 5 or abs(row[3] - kept[-1][3]) > 5:
                kept.append(row)
            elif row[4] > kept[-1][4]:
                kept[-1] = row
        want += kept
    assert sorted(map(tuple, found.collect())) == sorted(want)
