import numpy as np

from clipwright.llm import embed_dedup

SCHEMA = "vec_id long, embedding array<double>, label int, links string"


def brute(rows, cosine=0.9):
    good = []
    for i, (_, v, *_) in enumerate(rows):
        if v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            u = np.array(v) / np.abs(v).max()
            good.append((i, u / np.linalg.norm(u)))
    links = np.zeros(len(rows), int)
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(good)):
        for b in range(a):
            (i, x), (j, y) = good[a], good[b]
            if len(x) == len(y) and x @ y >= cosine:
                links[i] += 1
                links[j] += 1
                root[max(find(i), find(j))] = min(find(i), find(j))
    return links, [find(i) for i in range(len(rows))]


def table_rows(width=64, n=300, seed=2):
    r = np.random.default_rng(seed)
    rows = []
    centre = r.standard_normal(width)
    for i in range(n):
        if i % 3 == 0:
            v = centre + r.standard_normal(width) * 0.15
        elif i % 3 == 1 and i > 10:
            v = np.array(rows[i - 4][1]) * (2.0 if i % 2 else 1.0) + r.standard_normal(width) * (0 if i % 5 else 0.08)
        else:
            v = r.standard_normal(width)
        rows.append((i, v.tolist(), i % 4, "x"))
    return rows


def check(spark, rows, **options):
    found = {r["vec_id"]: r for r in embed_dedup.near_vectors(spark.createDataFrame(rows, SCHEMA), **options).collect()}
    links, root = brute(rows)
    assert len(found) == len(rows)
    for i, row in enumerate(rows):
        assert (found[row[0]]["n_links"], found[row[0]]["component_id"]) == (links[i], rows[root[i]][0])
        assert found[row[0]]["kept"] == (found[row[0]]["component_id"] == row[0])


def test_links_equal_brute_force(spark):
    rows = table_rows()
    nan, inf = float("nan"), float("inf")
    rows += [(900, None, 0, "x"), (901, [], 0, "x"), (902, [0.0] * 64, 0, "x"), (903, [nan] * 64, 0, "x"), (904, [inf] + [1.0] * 63, 0, "x"), (905, [None] + [1.0] * 63, 0, "x"), (906, [1.0] * 63, 0, "x"), (907, [1e200] * 63, 0, "x"), (908, [1e-200, -1e-200, 0.0], 0, "x"), (909, [3.0], 0, "x"), (910, [1.0], 0, "x"), (911, [-1.0], 0, "x")]
    rows += [(912 + i, rows[7][1], 0, "x") for i in range(5)]
    check(spark, rows)


def test_small_chunks_give_the_same(spark):
    check(spark, table_rows(16, 260, 5), chunk=16)
    check(spark, table_rows(24, 120, 6), chunk=10, n_blocks=6)


def test_pigeonhole_never_misses():
    r = np.random.default_rng(0)
    for width in (3, 16, 64):
        x = embed_dedup.unit(r.standard_normal((400, width)))
        y = embed_dedup.unit(x + r.standard_normal((400, width)) * 0.6 / np.sqrt(width) * r.random((400, 1)))
        near = (x * y).sum(1) >= 0.9
        a, b = embed_dedup.rotated(x), embed_dedup.rotated(y)
        edges, limits = embed_dedup.block_edges(width, 4), embed_dedup.block_limits(width, 4, 0.9)
        within = np.zeros(400, bool)
        for k, limit in enumerate(limits):
            within |= ((a - b)[:, edges[k] : edges[k + 1]] ** 2).sum(1) <= limit
        assert near.any() and within[near].all()


def test_repeated_ids_nulls_and_nothing(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(None, v, 0, "x"), (4, v, 0, "x"), (4, v, 0, "x"), (None, [9.0, -1.0, 0.0], 0, "x")]
    found = embed_dedup.near_vectors(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"])) for r in found) == [("4", 2, "4"), ("4", 2, "4"), ("None", 0, "None"), ("None", 2, "4")]
    assert embed_dedup.near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0
