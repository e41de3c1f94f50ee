"""The transcript store: upserts, either id, and a save that fails."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from clipwright.sources import store

ROW = "video_id string, uploaded_video_id string, value string"


def test_upserts_and_a_failed_save(spark, tmp_path):
    path = str(tmp_path / "store")
    assert store.stored(spark, path).count() == 0
    store.save(spark.createDataFrame([(f"v{i}", None, f"old {i}") for i in range(20)] + [(None, "u1", "up 1"), ("v1", "u2", "both"), (None, None, "lost")], ROW), path, 4)
    state = lambda: {(r.kind, r.id): r.value for r in store.stored(spark, path).collect()}
    first = state()
    assert len(first) == 22 and first["upload", "u2"] == "both" and first["video", "v1"] == "old 1" and first["video", "v3"] == "old 3"
    store.save(spark.createDataFrame([("v3", None, "new 3"), ("v99", None, "new 99")], ROW), path, 4)
    second = state()
    assert second == first | {("video", "v3"): "new 3", ("video", "v99"): "new 99"}
    bad = spark.createDataFrame([(f"v{i}", None, "bad") for i in range(20)], ROW).withColumn("value", F.when(F.col("video_id") == "v7", F.raise_error(F.lit("lost executor")).cast("string")).otherwise(F.col("value")))
    with pytest.raises(Exception, match="lost executor"):
        store.save(bad, path, 4)
    assert state() == second
    store.save(spark.createDataFrame([], ROW), path, 4)
    assert state() == second
    store.save(spark.createDataFrame([(f"v{i}", None, "last") for i in range(20)], ROW), path, 4)
    assert all(v == "last" for k, v in state().items() if k[0] == "video" and k[1] != "v99") and state()["upload", "u1"] == "up 1"


def test_either_id_and_lines(spark, tmp_path):
    path = str(tmp_path / "store")
    said = '{"text": "a b", "segments": [{"start": 0.0, "end": 1.5, "text": "a"}, {"start": 2.0, "end": 3.0, "text": "b"}]}'
    store.save(spark.createDataFrame([("v1", None, said), (None, "u1", "One two three. Four!")], ROW), path)
    asked = spark.createDataFrame([("v1", "u1"), ("v9", "u1"), (None, "u1"), ("v9", None)], "video_id string, uploaded_video_id string")
    got = sorted((str(r.video_id), str(r.uploaded_video_id), (r.value or "none")[:3]) for r in store.found(asked, store.stored(spark, path)).collect())
    assert got == [("None", "u1", "One"), ("v1", "u1", '{"t'), ("v9", "None", "non"), ("v9", "u1", "One")]
    values = spark.createDataFrame([("a", said), ("b", "One two three. Four!"), ("c", "{broken. text"), ("d", "")], "video_id string, value string")
    found = sorted((r.video_id, r.seg_idx, r.start, r.end, r.text) for r in store.lines(values).collect())
    assert found == [("a", 0, 0.0, 1.5, "a"), ("a", 1, 2.0, 3.0, "b"), ("b", 0, 0.0, 1.5, "One two three"), ("b", 1, 1.5, 2.5, "Four"), ("c", 0, 0.0, 1.0, "{broken"), ("c", 1, 1.0, 2.0, "text")]
