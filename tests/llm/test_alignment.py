"""Alignment against common ends, ids against those of whole texts, and the query against a plain version."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from clipwright.llm import alignment
from clipwright.llm.common import table

ODD = [
    "a  b", "a \n b", "a\n\nb c", "  lead", "trail  ", "　x y", "a\x1c b c", " ", "\n", "<|endoftext|> <s> </s> <unk>", "é ́x y", "▁a b", "x▁y", "it's  they're 's 't",
    " a   b", "日本語 テスト 한글", "a\tb \t c", "a\rb\r\nc d", "﻿a b", "🙂 🙂👍🏽", "a" * 50 + " " + "b" * 70, "", None, "word " * 30_000,
]


def test_runs_end_where_both_end():
    rng = random.Random(3)
    for _ in range(2000):
        ends = sorted(rng.sample(range(1, 200), rng.randint(1, 60)))
        part = lambda share: np.array(sorted({x for x in ends if rng.random() < share} | {200}))  # noqa: E731, B023
        a, b = part(rng.choice((0.3, 0.95, 1))), part(rng.choice((0.3, 0.95, 1)))
        found_a, found_b = alignment.diagonal_runs(a, b)
        common = sorted(set(a.tolist()) & set(b.tolist()))
        assert [a[i - 1] for i in found_a] == common == [b[i - 1] for i in found_b]
    assert [len(x) for x in alignment.diagonal_runs(np.array([], int), np.array([], int))] == [0, 0]


@pytest.fixture(scope="module")
def plain():
    """The rows that the query promises, by whole texts."""
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    signs = alignment.byte_signs()
    entry_b = lambda p: bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode()

    def rows(texts):
        links, counts = [], Counter()
        for text in texts:
            ids_a, ids_b = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
            bytes_a, bytes_b = [bytes(signs[c] for c in a.id_to_token(i)) for i in ids_a], [entry_b(b.id_to_piece(i)) for i in ids_b]
            if text and (b"".join(bytes_a) != (" " + text).encode() or b"".join(bytes_b) != (" " + text).encode()):
                ids_a, ids_b, bytes_a, bytes_b = [], [], [], []
            ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]).tolist(), np.cumsum([len(x) for x in bytes_b]).tolist()
            at_b = {e: j for j, e in enumerate(ends_b)}
            groups, i0, j0, own = [], 0, 0, []
            for i, e in enumerate(ends_a):
                if e in at_b:
                    groups.append((ids_a[i0 : i + 1], ids_b[j0 : at_b[e] + 1]))
                    own.append((ids_a[i], ids_b[at_b[e]]))
                    i0, j0 = i + 1, at_b[e] + 1
            counts.update(own)
            links.append((len(ids_a), len(ids_b), groups, own))
        best = {}
        for (_, y), n in counts.items():
            best[y] = max(n, best.get(y, 0))
        join = lambda ids: ",".join(map(str, ids))
        for n_a, n_b, groups, own in links:
            sha = hashlib.sha256(";".join(f"{join(x)}|{join(y)}" for x, y in groups).encode()).hexdigest() if n_a else ""
            yield n_a, n_b, len(groups), len(own), sum(counts[p] == best[p[1]] for p in own), sum(counts[p] for p in own), sha

    return rows


def result(df):
    return sorted(tuple(r)[1:] for r in df.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect())


@pytest.mark.parametrize("most_sent", [0, alignment.MOST_SENT])
def test_query_on_all_documents(spark, sf, plain, most_sent):
    docs = table(spark, sf, "documents")
    got = {r.doc_id: tuple(r)[1:] for r in alignment.score_links(docs, most_sent).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()}
    rows = docs.select("doc_id", "text").collect()
    assert got == dict(zip([r.doc_id for r in rows], plain([r.text for r in rows]), strict=True))


def test_odd_texts(spark, plain):
    docs = spark.createDataFrame([(None, t) for t in ODD * 2], "doc_id long, text string").withColumn("pair", F.lit(1)).withColumn("row_key", F.lit("x")).repartition(3)
    assert result(alignment.score_links(docs)) == sorted(plain(ODD * 2))


def test_no_documents(spark):
    assert alignment.score_links(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_groups_of_the_operator(spark):
    texts = ["the cat sat", "naïve café, 🙂", None]
    rows = {r.doc_id: r for r in alignment.align(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    known = alignment.vocabularies(*alignment.TOKENIZERS)
    for i, text in enumerate(texts):
        joined = [b"".join(known.bytes[side][x] for x in ids[a:b]) for side, ids, ends in ((0, rows[i].ids_a, rows[i].ends_a), (1, rows[i].ids_b, rows[i].ends_b)) for a, b in zip([0, *ends[:-1]], ends)]
        half = len(joined) // 2
        assert joined[:half] == joined[half:] and b"".join(joined[:half]).decode() == (f" {text}" if text else "")
