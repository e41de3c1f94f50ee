import math
from collections import defaultdict

from clipwright.llm import mixing, sharding

SCHEMA = "doc_id long, text string, source string, size string, target string"


def docs(spark):
    rows = [(i, " ".join(["w"] * (1 + i % 40)), f"s{i % 5}", "x", "y") for i in range(400)]
    rows += [(i, "one two three", None, "x", "y") for i in range(400, 420)]
    rows += [(420, None, "s0", "x", "y"), (421, "", "s0", "x", "y"), (422, " \t ", "s1", "x", "y"), (None, "a b", "s2", "x", "y"), (5, "w " * 6, "s0", "x", "y"), (423, "w " * 30_000, "s3", "x", "y")]
    return spark.createDataFrame(rows, SCHEMA)


def water(sizes, shares=(5, 2, 1)):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    share = {s: shares[i % 3] for i, s in enumerate(names)}
    left, open_, targets = sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(share[s] for s in open_)
        full = [s for s in open_ if 3 * sizes[s] < level * share[s]]
        if not full:
            targets |= {s: level * share[s] for s in open_}
            break
        for s in full:
            targets[s] = 3 * sizes[s]
            left -= targets[s]
            open_.remove(s)
    return targets


def test_mix_targets_and_taken(spark):
    table = docs(spark)
    source = {(r["doc_id"], r["text"]): r["source"] for r in table.collect()}
    found = mixing.mix_sources(table).collect()
    again = mixing.mix_sources(table.repartition(7)).collect()
    assert sorted(map(str, found)) == sorted(map(str, again))
    assert len(found) == table.count()
    sizes, taken = defaultdict(int), defaultdict(int)
    by_id = {r["doc_id"]: r["source"] for r in table.collect()}
    for r in found:
        s = by_id[r["doc_id"]]
        sizes[s] += r["size"]
        taken[s] += r["taken"]
        assert r["taken"] <= 3 * r["size"]
    want = water(sizes)
    for r in found:
        assert math.isclose(r["target"], want[by_id[r["doc_id"]]], rel_tol=1e-9)
    for s in sizes:
        longest = max(r["size"] for r in found if by_id[r["doc_id"]] == s)
        assert abs(taken[s] - want[s]) <= longest / 2 + 1
    assert source


def test_thousands_of_mixes(spark):
    """Each source is a mix of its own: what is taken stays within half of its longest document, and follows the rule."""
    import random

    r = random.Random(12)
    rows = []
    for s in range(5000):
        sizes = [r.choice([1, 7, 100, 120, 900, 5000]) if r.random() < 0.7 else r.randint(1, 3000) for _ in range(r.randint(1, 9))]
        rows += [(len(rows) + i, n, f"s{s:04d}") for i, n in enumerate(sizes)]
    table = spark.createDataFrame(rows, "doc_id long, n int, source string").selectExpr("doc_id", "repeat('w ', n) as text", "source")
    found = defaultdict(list)
    for x in mixing.mix_sources(table).collect():
        found[rows[x["doc_id"]][2]].append(x)
    want = water({s: sum(x["size"] for x in own) for s, own in found.items()})
    worst = 0.0
    for s, own in found.items():
        longest, gap = max(x["size"] for x in own), want[s] - sum(x["taken"] for x in own)
        assert abs(gap) <= longest / 2 + 1e-6
        # nothing that was left over is smaller than what is missing
        assert all(x["size"] >= gap for x in own if not x["picked"])
        worst = max(worst, abs(gap) / longest)
    assert len(found) == 5000 and worst > 0.4


def test_long_documents_first(spark):
    from pyspark.sql import functions as F

    table = spark.createDataFrame([(i, "w " * (5000 if i < 3 else 100), "a") for i in range(53)] + [(99, "w " * 44_000, "b")], "doc_id long, text string, source string")
    # of 64,000 words a gets 1,000, into which none of the three fits that come first
    found = mixing.mix_sources(table, shares=(1, 63), weight=F.when(F.length("text") > 1000, 1e12).otherwise(1.0)).where("doc_id < 99").collect()
    assert sum(x["taken"] for x in found) == 1000 and {x["size"] for x in found if x["picked"]} == {100}


def test_copies_in_thousands(spark):
    """A document with very many copies is counted, taken in part and dealt out again."""
    from pyspark.sql import functions as F

    table = spark.range(30_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("one two three").alias("text"), F.lit("a").alias("source"), (F.col("id") % 7).alias("other"))
    table = table.unionAll(spark.createDataFrame([(1, "w " * 70_000, "b", 0)], table.schema))
    mix = mixing.mix_sources(table, shares=(1, 3))
    assert mix.count() == 30_001
    own = mix.where("doc_id is null").agg(F.sum("taken"), F.first("target")).first()
    assert abs(own[0] - own[1]) <= 1.5
    out = mixing.apply_mix(table, mix).where("doc_id is null")
    assert out.count() == own[0] // 3
    slots = sharding.assign_shards(table).where("doc_id is null")
    assert slots.count() == 30_000 and slots.select("slot").distinct().count() == 30_000 and slots.select("shard").distinct().count() == 1


def test_mix_of_nothing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert mixing.mix_sources(empty).count() == 0
    silent = spark.createDataFrame([(1, None, "a", "", ""), (2, "", None, "", "")], SCHEMA)
    assert {(r["taken"], r["target"]) for r in mixing.mix_sources(silent).collect()} == {(0, 0.0)}


def test_better_documents_come_first(spark):
    from pyspark.sql import functions as F

    rows = [(i, "a b c d e", "x", "", "") for i in range(2000)] + [(i, "a b c d e", "y", "", "") for i in range(2000, 6000)]
    table = spark.createDataFrame(rows, SCHEMA)
    found = mixing.mix_sources(table, shares=(1, 9), weight=F.when(F.col("doc_id") % 2 == 0, 1.0).otherwise(0.2))
    picked = [r["doc_id"] for r in found.where("picked and doc_id < 2000").collect()]
    assert sum(i % 2 == 0 for i in picked) > 0.6 * len(picked)


def test_apply_mix_repeats_rows(spark):
    table = spark.createDataFrame([(1, "a b", "x", "k", "l"), (2, "c d", "y", "k", "l")], SCHEMA)
    mix = mixing.mix_sources(table, shares=(9, 1), max_epochs=3)
    out = mixing.apply_mix(table, mix)
    assert out.columns == table.columns
    times = {r["doc_id"]: r["epochs"] + r["picked"] for r in mix.collect()}
    assert sorted(r["doc_id"] for r in out.collect()) == sorted(i for i, n in times.items() for _ in range(n))


def test_shards(spark):
    import zlib

    table = docs(spark)
    found = sharding.assign_shards(table).collect()
    assert len(found) == table.count()
    slots = defaultdict(list)
    for r in found:
        slots[r["shard"]].append(r["slot"])
        assert 0 <= r["shard"] < 24 and r["law"] == "key"
        assert r["grown_shard"] in (r["shard"], 24)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    texts = defaultdict(set)
    for r in table.collect():
        texts[r["doc_id"]].add((zlib.crc32((r["text"] or "").encode()), len((r["text"] or "").encode()) + 8))
    assert all((r["text_crc32"], r["size"]) in texts[r["doc_id"]] for r in found)
    same = [r["shard"] for r in found if r["doc_id"] == 5]
    assert len(same) == 2 and len(set(same)) == 1
    assert sharding.assign_shards(spark.createDataFrame([], SCHEMA)).count() == 0


def test_weights_and_growth(spark):
    table = spark.createDataFrame([(i, "x", "", "", "") for i in range(6000)], SCHEMA)
    found = sharding.assign_shards(table, weights=(1.0, 3.0)).collect()
    share = sum(r["shard"] == 1 for r in found) / len(found)
    assert 0.70 < share < 0.80
    assert all(r["grown_shard"] in (r["shard"], 2) for r in found)


def test_write_shards(spark, tmp_path):
    table = docs(spark).where("doc_id is not null").dropDuplicates(["doc_id"]).drop("size")
    sharding.write_shards(table, sharding.assign_shards(table, (1.0,) * 4), str(tmp_path / "out"), 100)
    again = spark.read.parquet(str(tmp_path / "out"))
    assert again.count() == table.count()


def test_write_shards_with_null_and_repeated_ids(spark, tmp_path):
    from collections import Counter

    rows = [(None, "a", 1, "x")] * 30 + [(None, "b", 2, "x")] * 3 + [(4, "a", 3, "x"), (4, "b", 4, "x"), (4, "b", 5, "y"), (5, None, 6, "x"), (5, "", 7, "x")]
    table = spark.createDataFrame(rows, "doc_id long, text string, slot long, _key string")
    shards = sharding.assign_shards(table, (1.0,) * 4)
    sharding.write_shards(table, shards, str(tmp_path / "out"), 10)
    again = spark.read.parquet(str(tmp_path / "out")).collect()
    assert Counter((r["doc_id"], r["text"], r["_key"]) for r in again) == Counter((r[0], r[1], r[3]) for r in rows)
    assert Counter((r["shard"], r["slot"]) for r in again) == Counter((r["shard"], r["slot"]) for r in shards.collect())


def test_running_sum_in_many_buckets(spark):
    from clipwright.llm.common import cut, running_sum

    rows = [("a" if i % 3 else None, (i * 37 % 1000) / 1000, i, i % 11) for i in range(1000)]
    table = cut(spark.createDataFrame(rows, "g string, at double, id long, v long"))
    found = {r["id"]: r["before"] for r in running_sum(table, ["g"], "at", ["id"], "v", rows_per_bucket=20).collect()}
    for g in ("a", None):
        total = 0
        for _, at, i, v in sorted((r for r in rows if r[0] == g), key=lambda r: (r[1], r[2])):
            assert found[i] == total
            total += v


def test_apply_mix_takes_rows_without_doc_id(spark):
    rows = [(None, f"a{i} b{i}", "x", "k", "l") for i in range(20)] + [(None, "same words", "y", "k", str(i)) for i in range(7)] + [(1, "c d", "y", "k", "l"), (None, "same words", None, "k", "l")]
    table = spark.createDataFrame(rows, SCHEMA)
    mix = mixing.mix_sources(table, shares=(1, 3, 1), max_epochs=3)
    out = mixing.apply_mix(table, mix)
    assert out.columns == table.columns
    assert out.count() == sum(r["epochs"] + r["picked"] for r in mix.collect())
    want = sum(r["epochs"] + r["picked"] for r in mix.where("doc_id is null").collect())
    assert out.where("doc_id is null").count() == want > 0
    assert any(r["picked"] != s["picked"] for r in mix.collect() for s in mix.collect() if r["row_key"] == s["row_key"] and r["doc_id"] is None is s["doc_id"])
