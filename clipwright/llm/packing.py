"""Best-fit decreasing packing of tokenised documents into sequences of one length.

A document's full windows are cut off first. What is left of it, shorter than a window, goes into the
tightest open window that still holds it, longest rests first. Rests of one length are alike, so
the rule is followed for their counts, whose number the window bounds, whatever the number of documents: the plan says
for each length which ranks go to which windows, and tasks look their own rests up in it.
"""

from __future__ import annotations

import heapq
import os
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clipwright.llm.common import rewritten
from clipwright.llm.vocab import Encoded, blocks, flattened, offsets, ragged

WINDOW = 4096
END = 2
#: Signs that may close a word.
SIGNS = ".,;:!?"
#: Up to so many cut pieces are sent to the tasks that read their ids again; more are joined by shuffle.
MOST_SENT = 100_000


class Share(NamedTuple):
    """Of the rests of `size` tokens, those with ranks from `rank` to `rank + n` lay the `length` ids from `start` into windows from `first` on, `per` in each, behind `offset` ids."""

    size: int
    layer: int
    rank: int
    n: int
    start: int
    length: int
    first: int
    per: int
    offset: int


class OpenWindows:
    """Runs of alike windows by remaining capacity, under a segment tree that finds the tightest fit."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.tree = bytearray(2 * self.leaves)
        self.runs: dict[int, list[tuple[int, int, tuple[int, ...]]]] = defaultdict(list)

    def put(self, room: int, first: int, n: int, held: tuple[int, ...]) -> None:
        """`n` windows from `first` on, in which `room` ids are free and which hold parts of the shares `held`."""
        self.runs[room].append((first, n, held))
        node = room + self.leaves
        while node and not self.tree[node]:
            self.tree[node] = 1
            node >>= 1

    def take(self, room: int) -> tuple[int, int, tuple[int, ...]]:
        run = self.runs[room].pop()
        node = room + self.leaves
        if not self.runs[room]:
            self.tree[node] = 0
            while node > 1 and not self.tree[node ^ 1]:
                node >>= 1
                self.tree[node] = 0
        return run

    def tightest(self, size: int) -> int | None:
        """The least capacity of an open window that is `size` or more."""
        node = size + self.leaves
        if not self.tree[node]:
            while node > 1 and (node & 1 or not self.tree[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
        while node < self.leaves:
            node = 2 * node + (not self.tree[2 * node])
        return node - self.leaves

    def widest(self) -> int | None:
        """The largest capacity of an open window."""
        node = 1
        if not self.tree[1]:
            return None
        while node < self.leaves:
            node = 2 * node + self.tree[2 * node + 1]
        return (node - self.leaves) or None


class Packing:
    """The plan for counts of rests by size."""

    def __init__(self, window: int):
        self.window, self.open, self.shares, self.windows = window, OpenWindows(window), [], 0

    def place(self, size: int, rank: int, n: int, start: int, length: int, layer: int, cut: bool = False) -> list[tuple[int, int, int]]:
        """Best fit for `n` alike pieces. With `cut`, a piece that fits nowhere fills the widest gap; returns what is left of such: (first rank, number, ids laid)."""
        rests = []
        while n:
            room = self.open.tightest(length)
            if room is None and cut and (gap := self.open.widest()):
                first, m, held = self.open.take(gap)
                k = min(n, m)
                self._share(Share(size, layer, rank, k, start, gap, first, 1, self.window - gap), gap, first, m, k, held, 0)
                rests.append((rank, k, gap))
                rank, n = rank + k, n - k
                continue
            if room is None:
                room, first, m, held = self.window, self.windows, -(-n // (self.window // length)), ()
                self.windows += m
            else:
                first, m, held = self.open.take(room)
            per = min(n, room // length)
            k = min(m, n // per)
            self._share(Share(size, layer, rank, k * per, start, length, first, per, self.window - room), room, first, m, k, held, room - per * length)
            rank, n = rank + k * per, n - k * per
        return rests

    def _share(self, share: Share, room: int, first: int, m: int, k: int, held: tuple[int, ...], left: int) -> None:
        """The first `k` of `m` alike windows take the share; `left` is what stays free in each of these."""
        self.shares.append(share)
        self.open.put(left, first, k, (*held, len(self.shares) - 1))
        if m > k:
            self.open.put(room, first + k, m - k, held)

    def dissolve(self, n: int) -> list[tuple[int, int, int]]:
        """Take the `n` emptiest windows apart: (size, first rank, number) of the rests in them. The windows behind move up."""
        gone, loose = [], []
        while n:
            room = self.open.widest()
            first, m, held = self.open.take(room)
            k = min(n, m)
            if m > k:
                self.open.put(room, first, m - k, held)
            gone.append((first + m - k, k, held))
            n -= k
        dropped = defaultdict(list)
        for first, k, held in gone:
            for i in held:
                s = self.shares[i]
                rank = s.rank + (first - s.first) * s.per
                loose.append((s.size, rank, k * s.per))
                dropped[i].append((rank, k * s.per))
        kept = []
        for i, s in enumerate(self.shares):
            at = s.rank
            for rank, k in [*sorted(dropped[i]), (s.rank + s.n, 0)]:
                if rank > at:
                    kept.append(s._replace(rank=at, n=rank - at, first=s.first + (at - s.rank) // s.per))
                at = rank + k
        starts, sums = np.array(sorted(g[0] for g in gone)), offsets(np.array([g[1] for g in sorted(gone)]))
        up = lambda first: int(first - sums[np.searchsorted(starts, first, "right")])
        self.shares = [s._replace(first=up(s.first)) for s in kept]
        for room, runs in self.open.runs.items():
            self.open.runs[room] = [(up(first), m, ()) for first, m, _ in runs]
        self.windows -= int(sums[-1])
        return loose


def plan(counts: dict[int, int], window: int = WINDOW, most_padding: float = 0.01) -> list[Share]:
    """Best-fit decreasing over `counts` of rests by size, 1 to `window`.

    Where more than `most_padding` of all tokens would be padding (sizes that don't fit together), the emptiest
    windows are taken apart and their rests cut to fill the widest gaps of the others. Not more than some
    twelve shares for each size and run of windows come out, however large the counts.
    """
    packing = Packing(window)
    for size in sorted(counts, reverse=True):
        packing.place(size, 0, counts[size], 0, size, 0)
    tokens = sum(s * n for s, n in counts.items())
    spare = packing.windows - max(-(-tokens // window), int(np.ceil(tokens * (1 + most_padding) / window)))
    if spare > 0:
        queue = [(-size, 0, size, rank, n, 0) for size, rank, n in packing.dissolve(spare)]
        heapq.heapify(queue)
        while queue:
            _, start, size, rank, n, layer = heapq.heappop(queue)
            for at, k, laid in packing.place(size, rank, n, start, size - start, layer, cut=True):
                heapq.heappush(queue, (start + laid - size, start + laid, size, at, k, layer + 1))
    return packing.shares


class WordEnds:
    """Ids of words by a tokenizer whose tokens at the end of a word say so.

    Letters are one word to it, and closing signs behind them another. Words of this form are encoded together, and told apart by their ends; others,
    and those of a group whose number of ends is another (lower case adds a mark to some letters), are encoded one by one.
    """

    def __init__(self, tokenizer: str, together: int = 500):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers
        from tokenizers import Tokenizer

        self.coder, self.together = Tokenizer.from_file(public_tokenizers.path(tokenizer)), together
        self.final = np.zeros(self.coder.get_vocab_size(), bool)
        for entry, i in self.coder.get_vocab().items():
            self.final[i] = entry.endswith("</w>")

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.coder.encode_batch_fast(texts, add_special_tokens=False)]

    def __call__(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ends = np.fromiter((1 if w.isalpha() else 2 if w[-1] in SIGNS and w.rstrip(SIGNS).isalpha() else 0 for w in words), np.int64, len(words))
        plain = np.flatnonzero(ends)
        starts = range(0, len(plain), self.together)
        groups = [plain[i : i + self.together] for i in starts]
        flat, at, counts, alone = [], [], [], [np.flatnonzero(ends == 0)]
        for group, ids in zip(groups, self._ids([" ".join([words[i] for i in group]) for group in groups]), strict=True):
            found = np.flatnonzero(self.final[ids]) + 1
            last = np.cumsum(ends[group])
            if len(found) == last[-1]:
                flat.append(np.array(ids, np.int32))
                at.append(group)
                counts.append(np.diff(found[last - 1], prepend=0))
            else:
                alone.append(group)
        rest = np.concatenate(alone)
        some, n = flattened(self._ids([words[i] for i in rest]))
        flat, at, counts = np.concatenate([*flat, some]), np.concatenate([*at, rest]), np.concatenate([*counts, n])
        starts, order = np.cumsum(counts) - counts, np.argsort(at)
        return ragged(flat, starts[order], counts[order]), counts[order]


@lru_cache(1)
def _words(tokenizer: str) -> Encoded:
    """A worker process keeps the words that it has met."""
    return Encoded(WordEnds(tokenizer))


def encode(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", window: int = WINDOW, end: int = END) -> DataFrame:
    """(doc_id, start, size, doc_tokens, ids_crc32, ids, part, nth): a row for each full window of a document and for its rest, written as Parquet.

    `ids` are the tokenizer's, special tokens not added, then `end`. A null text is empty, so every document
    has a rest or a window. (size, part, nth) is a key: nth counts the rows of a size in a task. Words are
    cut at white space, over which no token reaches; very long texts are read in one row but encoded word by word.
    Null and repeated doc_ids are kept as they are; other columns are not read.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, part, seen = _words(tokenizer), TaskContext.get().partitionId(), Counter()
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for first, some in blocks(texts):
                words = [[w for w in t.replace("\n", " ").replace("\t", " ").split(" ") if w] for t in some]  # other white space stays inside words
                places = known.places([w for ws in words for w in ws])
                ids, counts = known.ids(places), known.counts[0][places]
                cuts = offsets(counts)[offsets(np.array([len(ws) for ws in words]))]
                out = {c: [] for c in ("row", "start", "size", "doc_tokens", "ids_crc32", "ids", "nth")}
                for i in range(len(some)):
                    own = np.append(ids[cuts[i] : cuts[i + 1]], end).astype("<u4")
                    for start in range(0, len(own), window):
                        piece = own[start : start + window]
                        for c, v in zip(out, (first + i, start, len(piece), len(own), zlib.crc32(piece.tobytes()), piece.astype(np.int32), seen[len(piece)]), strict=True):
                            out[c].append(v)
                        seen[len(piece)] += 1
                flat = pa.ListArray.from_arrays(pa.array(offsets(np.array(out["size"])), pa.int32()), pa.array(np.concatenate(out["ids"])))
                long = {c: pa.array(out[c], pa.int64()) for c in ("start", "size", "doc_tokens", "ids_crc32", "nth")}
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0).take(pa.array(out["row"])), **long, "ids": flat, "part": pa.array([part] * len(out["row"]), pa.int64())})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return rewritten(docs.select("doc_id", F.col("text").cast("string")).mapInArrow(rows, f"doc_id {kind}, start long, size long, doc_tokens long, ids_crc32 long, nth long, ids array<int>, part long"))


def assign(encoded: DataFrame, window: int = WINDOW, most_padding: float = 0.01) -> DataFrame:
    """(doc_id, start, length, doc_tokens, sequence_id, offset, whole_crc32, size, part, nth, cut_at) for the rows of `encode`: where each piece lies.

    A row is one piece, or several where the plan cuts it: `cut_at` is where the piece begins in the row's ids, and
    whole_crc32 is null. The sizes' counts, `window` rows, are all that the driver gets, and the plan goes to the
    tasks: its length is bounded by the window, not by the documents. Ranks come from sums of counts
    by size and task, so a size with any share of all rows is no single task. No rows give no rows.
    """
    by_task = encoded.groupBy("size", "part").agg(F.count("*").alias("n"))
    counts = {r["size"]: r["n"] for r in by_task.groupBy("size").agg(F.sum("n").alias("n")).collect()}
    shares = np.array(plan(counts, window, most_padding), np.int64).reshape(-1, len(Share._fields))
    shares = shares[np.lexsort((shares[:, 2], shares[:, 1], shares[:, 0]))]
    layers = int(shares[:, 1].max(initial=-1)) + 1
    sent = encoded.sparkSession.sparkContext.broadcast(shares)
    earlier = Window.partitionBy("size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = by_task.select("size", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    ranked = encoded.select("doc_id", "start", "size", "doc_tokens", "ids_crc32", "part", "nth").join(bases, ["size", "part"]).withColumn("rank", F.col("base") + F.col("nth")).drop("base")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        name = lambda size, layer: size * layers + layer
        firsts = name(table[:, 0], table[:, 1]).astype(np.float64)
        for batch in batches:
            size, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("size", "rank"))
            for layer in range(layers):
                lo, hi = np.searchsorted(firsts, name(size, layer), "left"), np.searchsorted(firsts, name(size, layer), "right")
                at = _last_at_most(table[:, 2], rank, lo, hi)
                share = table[np.maximum(at, 0)] if len(table) else table
                held = np.flatnonzero((at >= lo) & (rank < share[:, 2] + share[:, 3])) if len(table) else np.empty(0, np.int64)
                if len(held):
                    _, _, first_rank, _, cut_at, length, first, per, offset = share[held].T
                    behind, take = rank[held] - first_rank, lambda c, held=held: batch.column(batch.schema.get_field_index(c)).take(pa.array(held))
                    whole = pa.array(take("ids_crc32").to_numpy(zero_copy_only=False), mask=length < size[held])
                    own = {"start": take("start").to_numpy() + cut_at, "length": length, "sequence_id": first + behind // per, "offset": offset + behind % per * length, "cut_at": cut_at}
                    yield pa.RecordBatch.from_pydict({"doc_id": take("doc_id"), **{c: pa.array(v, pa.int64()) for c, v in own.items()}, "whole_crc32": whole.cast(pa.int64()), **{c: take(c) for c in ("doc_tokens", "size", "part", "nth")}})

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return ranked.mapInArrow(rows, f"doc_id {kind}, start long, length long, sequence_id long, offset long, cut_at long, whole_crc32 long, doc_tokens long, size long, part long, nth long")


def _last_at_most(values: np.ndarray, wanted: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The last place in values[lo:hi], which is sorted, that is `wanted` at most; lo - 1 if there is none. All rows are halved together."""
    lo, hi = lo - 1, hi.copy()
    while len(lo) and (hi - lo > 1).any():
        mid = (lo + hi) // 2
        low = (hi - lo > 1) & (values[np.clip(mid, 0, len(values) - 1)] <= wanted)
        lo, hi = np.where(low, mid, lo), np.where(low | (hi - lo <= 1), hi, mid)
    return lo


def with_ids(pieces: DataFrame, encoded: DataFrame) -> DataFrame:
    """`pieces` with their token ids."""
    ids = encoded.select("size", "part", "nth", F.col("ids").alias("_ids"))
    cut = F.slice("_ids", (F.col("cut_at") + 1).cast("int"), F.col("length").cast("int"))
    return pieces.join(ids, ["size", "part", "nth"]).withColumn("ids", cut).drop("_ids")


def pack(docs: DataFrame, window: int = WINDOW, most_padding: float = 0.01) -> DataFrame:
    """The packed pieces of all documents with their token ids: (doc_id, start, length, doc_tokens, sequence_id, offset, ids).

    A sequence is the ids of its pieces by offset, `window` at most. See `encode` and `assign` for nulls and odd input.
    """
    encoded = encode(docs, window=window)
    return with_ids(assign(encoded, window, most_padding), encoded).select("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids")


def piece_digests(docs: DataFrame) -> DataFrame:
    """The pieces of all documents with a CRC32 of their ids in place of these; only rows that the plan cuts read their ids again."""
    encoded = encode(docs)
    pieces = rewritten(assign(encoded))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = [zlib.crc32(np.asarray(ids.values, dtype="<u4").tobytes()) for ids in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sums, pa.int64())], [*batch.schema.names[:-1], "ids_crc32"])

    keep = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset"]
    wanted = pieces.where("whole_crc32 is null")
    few = wanted.count() <= MOST_SENT
    cut = with_ids(F.broadcast(wanted) if few else wanted, encoded).select(*keep, "ids")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema.fields[:-1])
    return pieces.where("whole_crc32 is not null").select(*keep, F.col("whole_crc32").alias("ids_crc32")).unionByName(cut.mapInArrow(rows, f"{kinds}, ids_crc32 long"))
