"""Alignment of two tokenizers' tokens over the same bytes, and how often their tokens end together."""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipwright.llm.common import cut, rewritten
from clipwright.llm.vocab import BETWEEN, Encoded, blocks, offsets

TOKENIZERS = "byte_bpe_50k.json", "piece_bpe_32k.model"
Rows = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
#: A pair of ids is one number: A's id times this, and B's id.
PAIR = 1 << 32
#: Up to so many distinct pairs (about 40 bytes each in an executor) the counts are sent to all tasks; more are joined by shuffle.
MOST_SENT = 1_000_000


def diagonal_runs(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many tokens of A and of B end by the end of each group; both arrays of byte offsets rise to the same last one.

    As long as tokens are one to one, those at the same index shift end together: blocks of 1, 2, 4, ...
    ends are compared at that shift, and the first block that differs is halved until the last
    common end is found. The irregular group behind it is walked token by token to the next common end, which sets the new shift.
    """
    m, n, a, b = len(ends_a), len(ends_b), ends_a.astype(np.int64).tobytes(), ends_b.astype(np.int64).tobytes()
    list_a, list_b = ends_a.tolist(), ends_b.tolist()
    i = j = 0
    at_a, at_b, lengths = [], [], []  # runs of groups: where each begins, and how many one-to-one groups it has
    while i < m and j < n:
        x, y = list_a[i], list_b[j]
        while x != y:
            if x < y:
                i += 1
                x = list_a[i]
            else:
                j += 1
                y = list_b[j]
        at_a.append(i)
        at_b.append(j)
        p, q, step = 8 * i + 8, 8 * j + 8, 8
        while p < 8 * m and a[p : p + step] == b[q : q + step]:  # a block that only one array still has in full differs
            p, q, step = p + step, q + step, 2 * step
        while step > 8:  # this block differs; its first half may not
            step //= 2
            if p + step <= 8 * m and a[p : p + step] == b[q : q + step]:
                p, q = p + step, q + step
        p = min(p, 8 * m)
        lengths.append(p // 8 - i)
        j += p // 8 - i
        i = p // 8
    long = np.array(lengths, np.int64)
    within = np.arange(int(long.sum())) - np.repeat(np.cumsum(long) - long, long) + 1
    return np.repeat(np.array(at_a, np.int64), long) + within, np.repeat(np.array(at_b, np.int64), long) + within


class Vocabularies:
    """Both tokenizers' ids of distinct words, with the bytes of their tokens. A reads space + word; B, which puts the space there itself, the word."""

    def __init__(self, name_a: str, name_b: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers
        import sentencepiece
        from tokenizers import Tokenizer

        coder = Tokenizer.from_file(public_tokenizers.path(name_a))
        coder.encode_special_tokens = True
        pieces = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name_b))
        signs, raw, own = byte_signs(), re.compile(r"<0x([0-9A-F]{2})>"), [pieces.id_to_piece(i) for i in range(pieces.get_piece_size())]
        table = [b""] * coder.get_vocab_size()
        for entry, i in coder.get_vocab().items():
            table[i] = bytes(signs[c] for c in entry) if all(c in signs for c in entry) else entry.encode()
        self.bytes = [table, [bytes([int(m[1], 16)]) if (m := raw.fullmatch(p)) else p.replace("▁", " ").encode() for p in own]]
        self.lengths = [np.array([len(x) for x in xs], np.int64) for xs in self.bytes]
        # B's merges stay within words only if no piece has the sign for a space behind another sign
        self.by_word = not any("▁" in p.lstrip("▁") for p in own)
        self.coder = coder
        self.words = Encoded(self.ids_a, lambda words: pieces.encode(words, num_threads=1), mark=self.joins, most=500_000)

    def ids_a(self, words: list[str], together: int = 500) -> list[list[int]]:
        """A's ids of space + word. Words without white space at their ends are encoded together, and told apart by where their bytes end."""
        alone = lambda some: [e.ids for e in self.coder.encode_batch_fast([" " + w for w in some], add_special_tokens=False)]
        plain = [w for w in words if not (w[0].isspace() or w[-1].isspace())]
        groups = [plain[i : i + together] for i in range(0, len(plain), together)]
        found: dict[str, list[int]] = {}
        for group, ids in zip(groups, alone([" ".join(g) for g in groups]), strict=True):
            ends, wanted = np.cumsum(self.lengths[0][ids]), np.cumsum([len(w.encode("utf-8", "surrogatepass")) + 1 for w in group])
            cuts = np.minimum(np.searchsorted(ends, wanted), len(ends) - 1)
            if (ends[cuts] == wanted).all():
                found |= {w: ids[a:b] for w, a, b in zip(group, [0, *(cuts[:-1] + 1).tolist()], (cuts + 1).tolist(), strict=True)}
            else:
                found |= dict(zip(group, alone(group), strict=True))
        rest = [w for w in words if w not in found]
        found |= dict(zip(rest, alone(rest), strict=True))
        return [found[w] for w in words]

    def joins(self, text: str, *ids: list[int]) -> bool:
        """Whether the bytes of both tokenizers' tokens are those of space + text."""
        whole = (" " + text).encode("utf-8", "surrogatepass")
        return all(b"".join(map(table.__getitem__, own)) == whole for own, table in zip(ids, self.bytes, strict=True))


@lru_cache(1)
def vocabularies(name_a: str, name_b: str) -> Vocabularies:
    """A worker process keeps the words that it has met."""
    return Vocabularies(name_a, name_b)


def byte_signs() -> dict[str, int]:
    """The sign that byte-level vocabularies write for each byte: itself if it is printable, else the next of those from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def encoded(texts: list[str], known: Vocabularies) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The ids of space + text by A and of the text by B; none for an empty text and for one whose joined bytes differ from space + text."""
    nothing = np.empty(0, np.int32)
    for _, some in blocks(texts):
        words = [(BETWEEN.split(t) if known.by_word else [t]) if t else [] for t in some]
        places = known.words.places([w for ws in words for w in ws])
        bounds = offsets(np.array([len(ws) for ws in words], np.int64))
        ids = [known.words.ids(places, e) for e in (0, 1)]
        cuts = [offsets(known.words.counts[e][places])[bounds] for e in (0, 1)]
        faults = np.diff(offsets(~known.words.marks[places])[bounds])
        for i, text in enumerate(some):
            a, b = (x[at[i] : at[i + 1]] for x, at in zip(ids, cuts, strict=True))
            same = text and (not faults[i] or known.joins(text, a.tolist(), b.tolist()))
            yield (a, b) if same else (nothing, nothing)


def lists(arrays: list[np.ndarray]) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets(np.array([len(x) for x in arrays], np.int64)), pa.int32()), pa.array(np.concatenate([*arrays, np.empty(0, np.int32)]).astype(np.int32)))


def aligned_rows(tokenizer_a: str, tokenizer_b: str) -> Rows:
    """From (doc_id, text) to the rows of `align`, about a million characters at a time."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, key = vocabularies(tokenizer_a, tokenizer_b), TaskContext.get().partitionId() << 33
        for batch in batches:
            texts, first = [t or "" for t in batch.column(1).to_pylist()], 0
            while first < len(texts):
                last, held = first, 0
                while last < len(texts) and held < 1_000_000:
                    held += len(texts[last])
                    last += 1
                ids, ends = [], []
                for a, b in encoded(texts[first:last], known):
                    ids.append((a, b))
                    ends.append(diagonal_runs(np.cumsum(known.lengths[0][a]), np.cumsum(known.lengths[1][b])))
                key += last - first
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, last - first), pa.array(range(key - (last - first), key), pa.int64()), *(lists([pair[side] for pair in pairs]) for pairs in (ids, ends) for side in (0, 1))],
                    ["doc_id", "row_key", "ids_a", "ids_b", "ends_a", "ends_b"],
                )
                first = last

    return rows


def align(docs: DataFrame, tokenizer_a: str = TOKENIZERS[0], tokenizer_b: str = TOKENIZERS[1]) -> DataFrame:
    """(doc_id, row_key, ids_a, ids_b, ends_a, ends_b): both tokenizers' ids of each whole text and the groups that they fall into.

    Group g has the tokens from ends_a[g - 1] up to ends_a[g] of A and likewise of B: the fewest that cover the same
    bytes of space + text. Texts that are null, empty, or whose tokens' bytes don't join to space + text have no
    tokens. row_key tells rows apart, whatever their doc_id, but only once the result is written. Other columns are not read. A
    text is aligned as a whole, in time and memory that follow its length.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(aligned_rows(tokenizer_a, tokenizer_b), f"doc_id {kind}, row_key long, ids_a array<int>, ids_b array<int>, ends_a array<int>, ends_b array<int>")


def _arrays(column: pa.ListArray) -> Callable[[int], np.ndarray]:
    values, at = column.values.to_numpy(), column.offsets.to_numpy()
    return lambda i: values[at[i] : at[i + 1]]


def digest_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, row_key, n_a, n_b, n_groups, groups_sha256, pairs, times) from the rows of `align`.

    groups_sha256 is of all groups as `a1,a2|b1;a3|b2,b3`, empty without tokens. `pairs` are the distinct (last A token, last B token)
    of groups, which are the tokens that end together, and `times` how often each stands in the text.
    """
    digits = [str(i).encode() for i in range(1 << 16)]
    words = [d + sign for sign in (b",", b"|", b",", b";") for d in digits]  # A's and B's ids, inside a group and at its end
    for batch in batches:
        get = {c: _arrays(batch.column(batch.schema.get_field_index(c))) for c in ("ids_a", "ids_b", "ends_a", "ends_b")}
        out = {c: [] for c in ("n_a", "n_b", "n_groups", "groups_sha256")}
        pairs, times = [], []
        for i in range(batch.num_rows):
            a, b, ends_a, ends_b = (get[c](i).astype(np.int64) for c in get)
            closes_a, closes_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
            closes_a[ends_a - 1], closes_b[ends_b - 1] = True, True
            # tokens in the order in which they are written: of each group A's, then B's
            group_a, group_b = np.cumsum(closes_a) - closes_a, np.cumsum(closes_b) - closes_b
            code = np.empty(len(a) + len(b), np.int64)
            code[np.arange(len(a)) + np.concatenate([[0], ends_b])[group_a]] = a + closes_a * (1 << 16)
            code[np.arange(len(b)) + ends_a[group_b]] = b + closes_b * (1 << 16) + (2 << 16)
            text = b"".join(map(words.__getitem__, code.tolist()))
            found, n = np.unique(a[ends_a - 1] * PAIR + b[ends_b - 1], return_counts=True)
            for c, v in zip(out, (len(a), len(b), len(ends_a), hashlib.sha256(text[:-1]).hexdigest() if len(a) else ""), strict=True):
                out[c].append(v)
            pairs.append(found)
            times.append(n)
        at = pa.array(offsets(np.array([len(x) for x in pairs], np.int64)), pa.int32())
        many = [pa.ListArray.from_arrays(at, pa.array(np.concatenate([*xs, np.empty(0, np.int64)]).astype(np.int64))) for xs in (pairs, times)]
        columns = [pa.array(out[c], pa.string() if c == "groups_sha256" else pa.int64()) for c in out]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns, *many], ["doc_id", "row_key", *out, "pairs", "times"])


def group_digests(docs: DataFrame, tokenizer_a: str = TOKENIZERS[0], tokenizer_b: str = TOKENIZERS[1]) -> DataFrame:
    """`digest_rows` of the alignment of `docs`, in the task that aligns: the tokens go no further."""
    aligned, kind = aligned_rows(tokenizer_a, tokenizer_b), docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, row_key long, n_a long, n_b long, n_groups long, groups_sha256 string, pairs array<long>, times array<long>"
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(lambda batches: digest_rows(aligned(batches)), schema)


def link_counts(digests: DataFrame) -> DataFrame:
    """(pair, count, best): how many links of all texts hold each pair of ids, and whether that is the most of its B id, ties included.

    Pairs are summed before they are shuffled; there are as many rows as distinct pairs.
    """
    counts = cut(digests.select(F.explode(F.arrays_zip("pairs", "times")).alias("x")).groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.times").alias("count")))
    most = counts.groupBy((F.col("pair") % PAIR).alias("b")).agg(F.max("count").alias("most"))
    return counts.withColumn("b", F.col("pair") % PAIR).join(most, "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def score_links(docs: DataFrame, most_sent: int = MOST_SENT) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256): a row for each row of `docs`.

    Texts are encoded and aligned once; what is kept of them is written. The counts of pairs go to all tasks if there are no
    more than `most_sent` of them; beyond that both sides are shuffled by pair, the documents' sums then by row_key. Both give the same rows.
    """
    digests = rewritten(group_digests(docs))
    counts = cut(link_counts(digests))
    small = counts.count() <= most_sent
    links = digests.select("row_key", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row_key", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    met = links.join(F.broadcast(counts) if small else counts, "pair")
    sums = met.groupBy("row_key").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum"))
    out = digests.drop("pairs", "times").join(sums, "row_key", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select("doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), zero("n_best"), zero("count_sum"), "groups_sha256")
