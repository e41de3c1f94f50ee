import re

import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from clipwright.llm import simhash
from clipwright.llm.graph import connected_components

SCHEMA = "doc_id long, text string, fp string, component_id string"


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aB cÉ\t\n\x0b x.", max_size=60))
def test_fingerprint_is_the_rule(text):
    assert simhash.fingerprint(text) == brute(text)


def test_long_text_in_blocks():
    from clipwright.llm import common

    text = " ".join(f"w{i % 977}" for i in range(3 * common.BLOCK_WORDS // 2))
    assert simhash.fingerprint(text) == brute(text)


def test_spark_hash_is_the_same(spark):
    from pyspark.sql import functions as F

    for s in ("a", "abc def ghi", "ä" * 40, ""):
        got = spark.range(1).select(F.xxhash64(F.lit(s)).alias("h")).first()["h"] % 2**64
        assert got == xxhash.xxh64_intdigest(s.encode(), 42)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 2**10 - 1), max_size=60), st.integers(0, 2**10 - 1))
def test_tree_finds_all_within(values, asked):
    tree = simhash.BKTree()
    for v in values:
        tree.add(v)
    assert sorted(tree.within(asked, 3)) == sorted(v for v in set(values) if (v ^ asked).bit_count() <= 3)


def classes(values, radius=3):
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= radius:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(values))]


def test_classes_equal_brute_force(spark):
    base = "the quick brown fox jumps over the lazy dog and runs into the deep dark forest where nobody ever goes at night"
    rows = [(i, f"{base} {' '.join(f'x{j}' for j in range(i % 4))}", "a", "b") for i in range(30)]
    rows += [(30 + i, " ".join(f"u{i}v{j}" for j in range(50)), "a", "b") for i in range(30)]
    rows += [(90, None, "a", "b"), (91, "", "a", "b"), (92, " \n", "a", "b"), (93, "Two Words", "a", "b"), (94, "two words", "a", "b"), (3, rows[3][1], "a", "b")]
    table = spark.createDataFrame(rows, SCHEMA)
    found = simhash.near_duplicates(table).collect()
    assert len(found) == len(rows)
    by_id = {r["doc_id"]: r for r in found}
    ids = sorted(by_id)
    texts = {r[0]: r[1] for r in rows}
    values = [brute(texts[i]) for i in ids]
    assert [by_id[i]["fingerprint"] for i in ids] == [f"{v:016x}" for v in values]
    assert [by_id[i]["component_id"] for i in ids] == [ids[c] for c in classes(values)]
    assert by_id[90]["component_id"] == by_id[92]["component_id"] == 90


def test_dense_shard_is_cut_into_trees(spark):
    import random

    r = random.Random(1)
    values = set()
    while len(values) < 300:
        v = 0x0123456789ABCDEF
        for _ in range(r.randint(0, 4)):
            v ^= 1 << r.randrange(62)
        values.add(v)
    values = sorted(values)
    table = spark.createDataFrame([(v,) for v in values], "fp long")
    links = simhash.near_links(table, 3, tree_size=16)
    roots = {r["node"]: r["root"] for r in connected_components(links).collect()}
    want = classes(values)
    assert [roots.get(v, v) for v in values] == [values[c] for c in want]


def test_nothing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.keep_first(empty, simhash.near_duplicates(empty)).count() == 0


def test_keep_first(spark):
    rows = [(1, "a b c d", "k", "l"), (2, "a b c d", "k", "l"), (3, "other words in here", "k", "l"), (3, "other words in here", "k", "l"), (None, "nameless text is here", "k", "l"), (None, "nameless text is here", "k", "l")]
    table = spark.createDataFrame(rows, SCHEMA)
    kept = simhash.keep_first(table, simhash.near_duplicates(table))
    assert kept.columns == table.columns
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 1, 3]


def test_rows_that_share_an_id_are_documents_of_their_own(spark):
    rows = [(1, "first text of the four", "k", "l"), (1, "quite another one it is", "k", "l"), (1, "quite another one it is", "k", "m"), (None, "first text of the four", "k", "l"), (2, "first text of the four", "k", "l")]
    table = spark.createDataFrame(rows, SCHEMA)
    kept = [(r["doc_id"], r["text"]) for r in simhash.keep_first(table, simhash.near_duplicates(table)).collect()]
    assert sorted(kept) == sorted({(1, rows[0][1]), (1, rows[1][1])})


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(500, i) for i in range(501, 560)] + [(7, 7), (None, 3), (9, 8), (8, 9)]
    found = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{i: 100 for i in range(100, 141)}, **{i: 500 for i in range(500, 560)}, 8: 8, 9: 8}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
