"""Packing against best-fit decreasing done item by item, and the query's promises against the tokenizer."""

from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from clipwright.llm import packing
from clipwright.llm.common import table


def laid(shares):
    """(start, length, window, offset) by (size, rank)."""
    out = {}
    for s in shares:
        for k in range(s.n):
            out.setdefault((s.size, s.rank + k), []).append((s.start, s.length, s.first + k // s.per, s.offset + k % s.per * s.length))
    return out


def whole(pieces, lengths):
    """Whether pieces (start, length) follow each other from 0 to the length of each."""
    for key, found in pieces.items():
        at = 0
        for start, length in sorted(found):
            assert start == at
            at += length
        assert at == lengths(key)


def best_fit(counts, window):
    rooms = []
    for size in sorted(counts, reverse=True):
        for _ in range(counts[size]):
            fit = [(room, i) for i, room in enumerate(rooms) if room >= size]
            if fit:
                rooms[min(fit)[1]] -= size
            else:
                rooms.append(window - size)
    return sorted(rooms)


@pytest.mark.parametrize("window", [8, 16, 37, 64])
def test_plan_is_best_fit_decreasing(window):
    rng = random.Random(window)
    for _ in range(150):
        counts = Counter(rng.randint(1, window) for _ in range(rng.randint(0, 80)))
        pieces = laid(packing.plan(counts, window, 1e9))
        assert set(pieces) == {(s, r) for s, n in counts.items() for r in range(n)}
        fill, places = Counter(), {}
        for found in pieces.values():
            ((start, length, where, offset),) = found
            fill[where] += length
            places.setdefault(where, []).append((offset, length))
        whole(places, fill.__getitem__)
        assert sorted(window - x for x in fill.values()) == best_fit(counts, window)


@pytest.mark.parametrize("window", [8, 37, 64])
@pytest.mark.parametrize("most", [0.0, 0.05])
def test_cut_rests_leave_little_padding(window, most):
    rng = random.Random(window)
    for _ in range(150):
        counts = Counter({rng.randint(window // 2, window): rng.randint(1, 200)}) + Counter(rng.randint(1, window) for _ in range(rng.randint(0, 20)))
        pieces, fill, places = laid(packing.plan(counts, window, most)), Counter(), {}
        whole({k: [p[:2] for p in v] for k, v in pieces.items()}, lambda key: key[0])
        assert set(pieces) == {(s, r) for s, n in counts.items() for r in range(n)}
        for found in pieces.values():
            for _, length, where, offset in found:
                fill[where] += length
                places.setdefault(where, []).append((offset, length))
        whole(places, fill.__getitem__)
        assert max(fill.values()) <= window and set(fill) == set(range(len(fill)))
        tokens = sum(s * n for s, n in counts.items())
        assert len(fill) <= max(-(-tokens // window), int(np.ceil(tokens * (1 + most) / window)), 1)


def promises(rows, docs, window=packing.WINDOW):
    """All that the query promises, from its rows and the documents."""
    coder = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    wanted = Counter()
    for doc_id, text in docs:
        wanted[doc_id, tuple([*coder.encode(text or "", add_special_tokens=False).ids, 2])] += 1
    texts = {}
    for doc_id, ids in wanted:
        texts.setdefault((doc_id, len(ids)), []).append(ids)
    fill, places = Counter(), {}
    cover = Counter()
    for r in rows:
        assert any(zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32 for ids in texts[r.doc_id, r.doc_tokens])
        cover[r.doc_id, r.doc_tokens] += r.length
        fill[r.sequence_id] += r.length
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert cover == Counter({k: 0 for k in cover}) + sum((Counter({(d, len(ids)): n * len(ids)}) for (d, ids), n in wanted.items()), Counter())
    whole(places, fill.__getitem__)
    assert max(fill.values(), default=0) <= window
    return sum(window - x for x in fill.values() if x & (x - 1)), sum(fill.values())


def test_query_on_all_documents(spark, sf):
    docs = table(spark, sf, "documents")
    padding, tokens = promises(packing.piece_digests(docs).collect(), [tuple(r) for r in docs.select("doc_id", "text").collect()])
    assert padding < 0.01 * tokens + packing.WINDOW


ODD = ["", None, " \n\t ", "word", "it's  THEY'RE 's", "<|endoftext|> a<|startoftext|>b", "é ́x", "a\x1cb\x85c d", "ΑΣ ΣΑΣ", "日本語 テスト", "🙂👍🏽", "x" * 5000 + " y", "ab " * 30_000]


def test_odd_documents(spark):
    rows = [(i if i % 3 else None, t) for i, t in enumerate(ODD * 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("size", F.lit(1)).withColumn("part", F.lit("x")).repartition(3)
    promises(packing.piece_digests(docs).collect(), rows)


def test_hot_size_is_cut(spark):
    rows = [(i, "word " * 2100) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = packing.piece_digests(docs).collect()
    padding, tokens = promises(found, rows)
    assert padding <= 0.01 * tokens + packing.WINDOW and len(found) > 60


def test_no_documents(spark):
    assert packing.piece_digests(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_packed_ids(spark):
    rows = [(i, "one two three " * i) for i in range(40)]
    coder = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for r in packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), window=64, most_padding=0.0).collect():
        ids = [*coder.encode(rows[r.doc_id][1], add_special_tokens=False).ids, 2]
        assert r.ids == ids[r.start : r.start + r.length]
