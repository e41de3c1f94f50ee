"""Streams with state that ends: equal to the batch operators, and empty after a video's end."""

from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from clipwright.operators import reports, tracking
from clipwright.streaming import state

PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@pytest.fixture(autouse=True)
def rocks(spark):
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(PROVIDER, before)


def _until(query, done, seconds=120):
    end = time.time() + seconds
    while time.time() < end and not query.exception() and not done():
        time.sleep(0.3)


def run(spark, rows, build, tmp_path, files=3, trigger=None, wait=None):
    """Rows arriving in several files; what comes out, and the query."""
    ordered, source = rows.toPandas(), tmp_path / "in"
    source.mkdir()
    step = -(-len(ordered) // files)
    for i in range(files):
        ordered.iloc[i * step : (i + 1) * step].to_parquet(source / f"{i}.parquet")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    query = build(stream).writeStream.format("memory").queryName(f"s{abs(hash(str(tmp_path)))}").option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(**(trigger or {"processingTime": "0 seconds"})).start()
    wait = wait or (lambda query: _until(query, lambda: spark.sql(f"select * from {query.name}").count() >= len(ordered)))
    wait(query)
    query.stop()
    return [tuple(r) for r in spark.sql(f"select * from {query.name}").collect()]


def detections(spark):
    r = random.Random(1)
    rows = [(v, f, f, f * 10 + k, r.choice("ab"), r.randrange(400), r.randrange(300)) for f in range(30) for v in (1, 2) for k in range(3) if f % 17 < 14]
    df = spark.createDataFrame(rows, "video_id long, frame_no int, ts long, det_id long, class_name string, cx long, cy long")
    return df.withColumns({"x1": F.col("cx") - 20, "y1": F.col("cy") - 20, "x2": F.col("cx") + 21, "y2": F.col("cy") + 21})


def test_tracks_equal_batch(spark, tmp_path):
    rows = detections(spark)
    assert sorted(run(spark, rows, state.tracked, tmp_path)) == sorted(map(tuple, tracking.tracked(rows).collect()))


def test_layouts_equal_batch(spark, tmp_path):
    rows = spark.createDataFrame([(v, f, (f // (3 + v)) % 3) for f in range(60) for v in (1, 2)], "video_id long, frame_no int, speakers int")
    assert sorted(run(spark, rows, lambda s: state.stable_layout(s, 4), tmp_path)) == sorted(map(tuple, tracking.stable_layout(rows, 4).collect()))


def test_speakers_equal_batch(spark, tmp_path):
    rows = detections(spark)
    assert sorted(run(spark, rows, state.smoothed_speakers, tmp_path)) == sorted(map(tuple, reports.smoothed_speakers(rows).collect()))


def test_state_is_empty_after_a_video_ends(spark, tmp_path):
    rows, sizes = detections(spark), []

    def wait(query):
        def empty():
            progress = query.lastProgress
            if progress and progress["stateOperators"]:
                sizes.append(progress["stateOperators"][0]["numRowsTotal"])
            return sizes and max(sizes) > 0 and sizes[-1] == 0

        _until(query, empty)

    run(spark, rows, lambda s: state.tracked(s, idle_ms=4_000), tmp_path, trigger={"processingTime": "1 second"}, wait=wait)
    assert max(sizes) > 0 and sizes[-1] == 0
