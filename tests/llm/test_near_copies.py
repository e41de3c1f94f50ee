import random
import re

import numpy as np

import corpus_pipeline
from clipwright.llm import simhash
from clipwright.llm.common import table


def shingles(text, n=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return {" ".join(words[i : i + n]) for i in range(len(words) - n + 1)} or ({" ".join(words)} if words else set())


def first_of_classes(texts):
    """By id, under links of a 5-word Jaccard of 0.8 or more of all pairs."""
    sets = {i: shingles(t) for i, t in texts.items()}
    left, kept = set(sets), set()
    while left:
        first = min(left)
        reached, ahead = {first}, [first]
        while ahead:
            x = sets[ahead.pop()]
            near = {y for y in left - reached if len(x & sets[y]) >= 0.8 * len(x | sets[y]) - 1e-9}
            reached |= near
            ahead += near
        kept.add(first)
        left -= reached
    return kept


def test_stage_equals_brute_force(spark):
    for sf in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        docs = table(spark, sf, "documents")
        kept = corpus_pipeline.simhash_near_dedup(spark, docs, sf)
        assert kept.columns == docs.columns
        assert sorted(r["doc_id"] for r in kept.collect()) == sorted(first_of_classes({r["doc_id"]: r["text"] for r in docs.collect()}))


def test_edited_copies(spark):
    r = random.Random(3)
    rows = []
    for group in range(12):
        words = [f"w{r.randrange(400)}" for _ in range(r.choice([30, 120, 400]))]
        for _ in range(9):
            own = list(words)
            for _ in range(r.randrange(0, len(own) // 30 + 2)):
                own[r.randrange(len(own))] = f"x{r.randrange(10**6)}"
            rows.append((len(rows), " ".join(own)))
    rows += [(1000, None), (1001, " "), (1002, "one two"), (1003, "ONE  two"), (1004, "one three")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = first_of_classes(dict(rows))
    assert 12 < len(want) < len(rows)
    for rounds in (0, 1, 3):
        kept = simhash.keep_first(docs, simhash.near_copies(docs, rounds=rounds))
        assert sorted(x["doc_id"] for x in kept.collect()) == sorted(want)
    for rounds, piece, piece_hashes in ((0, 2, 1_000_000), (1, 3, 1_000_000), (2, 2_048, 150)):
        kept = simhash.keep_first(docs, simhash.near_copies(docs, rounds=rounds, piece=piece, piece_hashes=piece_hashes))
        assert sorted(x["doc_id"] for x in kept.collect()) == sorted(want)


def test_links_of_sets():
    r = random.Random(5)
    for n in (2, 9, 60):
        base = [{r.randrange(10**6) for _ in range(40)} for _ in range(3)]
        sets = [{x if r.random() > 0.06 else r.randrange(10**6) for x in r.choice(base)} for _ in range(n)]
        roots = [r.randrange(4 * n) for _ in sets]
        hashes = [np.array(sorted(s), np.uint64) for s in sets]
        alike = [(i, j) for i in range(n) for j in range(i) if roots[i] == roots[j]]
        near = [(i, j) for i in range(n) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9]
        links = list(simhash._set_links(list(range(n)), roots, hashes, 0.8))
        assert {(max(p), min(p)) for p in links} <= set(near)
        assert classes(n, links + alike) == classes(n, near + alike)


def classes(n, links):
    label = list(range(n))
    for a, b in links:
        label = [label[a] if x == label[b] else x for x in label]
    return {tuple(i for i in range(n) if label[i] == x) for x in label}


def test_near_copies_without_doc_id(spark):
    words = [f"w{i}" for i in range(100)]
    near = " ".join(words[:-1] + ["other"])
    rows = [(1, " ".join(words)), (None, near), (None, near), (None, "a b c d e f"), (None, "A b c d e f"), (None, "g h i j k l")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [x["text"].lower() for x in simhash.keep_first(docs, simhash.near_copies(docs)).collect()]
    assert sorted(kept) == sorted([" ".join(words), "a b c d e f", "g h i j k l"])
