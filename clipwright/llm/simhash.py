"""SimHash near-duplicates, linked through BK-trees."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipwright.llm.common import cut, drop_cut, fresh, identity, shingles, word_blocks
from clipwright.llm.graph import connected_components

BITS = 64


def fingerprint(text: str | None, n: int = 3, seed: int = 42) -> int:
    """The SimHash of a text: a bit is 1 where more than half of the shingles' XXH64 hashes have it.

    Words have A-Z lower-cased, shingles are `n` words joined by one space, repeats count. With
    fewer than `n` words all of them are one shingle; without words (or null) the result is 0.
    """
    ones, total = np.zeros(BITS, np.int64), 0
    for words in word_blocks(text, n - 1):
        found = shingles(words, n) if len(words) >= n else [b" ".join(words)]
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, found, repeat(seed)), np.uint64)
        ones += np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        total += len(hashes)
    return int(np.packbits(ones * 2 > total, bitorder="little").view("<u8")[0])


def _fingerprint_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.array([fingerprint(t) for t in batch.column(2).to_pylist()], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found)], names=["row_key", "doc_id", "fp"])


class BKTree:
    """Fingerprints in a tree in which the edge to a child is its Hamming distance to the parent."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        at = 0
        while self.values:
            d = (value ^ self.values[at]).bit_count()
            if d == 0:
                return
            if d not in self.children[at]:
                self.children[at][d] = len(self.values)
                break
            at = self.children[at][d]
        self.values.append(value)
        self.children.append({})

    def within(self, value: int, radius: int) -> list[int]:
        """Values at most `radius` away: only edges within the radius of the distance are followed."""
        found, ahead = [], [0] if self.values else []
        while ahead:
            at = ahead.pop()
            d = (value ^ self.values[at]).bit_count()
            if d <= radius:
                found.append(self.values[at])
            edges = self.children[at]
            ahead += [edges[e] for e in range(d - radius, d + radius + 1) if e in edges]
        return found


def _linked(members: list[int], probes: list[int], radius: int) -> Iterator[tuple[int, int]]:
    """A spanning forest of the links among members, or between members and probes if there are any."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    def join(x: int, others: list[int]) -> Iterator[tuple[int, int]]:
        for y in others:
            if (a := root(x)) != (b := root(y)):
                parent[max(a, b)] = min(a, b)
                yield x, y

    tree = BKTree()
    for x in members:
        if not probes:
            yield from join(x, tree.within(x, radius))
        tree.add(x)
    for x in probes:
        yield from join(x, tree.within(x, radius))


def _search(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        now, sides, out = None, ([], []), []

        def flush() -> pa.RecordBatch:
            pairs = np.array(out, np.uint64).reshape(-1, 2).view(np.int64)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], schema=schema)

        for batch in batches:
            key, tree, part = (batch.column(i).to_numpy() for i in range(3))
            probe, fp = batch.column(3).to_numpy(zero_copy_only=False).tolist(), batch.column(4).to_numpy().view(np.uint64).tolist()
            for k, side, x in zip(zip(key.tolist(), tree.tolist(), part.tolist()), probe, fp):
                if k != now:
                    if len(sides[0]) + len(sides[1]) > 1:
                        out.extend(_linked(*sides, radius))
                    now, sides = k, ([], [])
                sides[side].append(x)
            if len(out) > 10_000:
                yield flush()
        if len(sides[0]) + len(sides[1]) > 1:
            out.extend(_linked(*sides, radius))
        yield flush()

    return run


def _shard_keys(fp: Column, radius: int) -> Column:
    """Two of radius + 2 bit blocks of fingerprints within the radius are alike: a key for each choice of two."""
    n = radius + 2
    edges = [BITS * i // n for i in range(n + 1)]
    block = [F.shiftrightunsigned(fp, edges[i]).bitwiseAND((1 << (edges[i + 1] - edges[i])) - 1) for i in range(n)]
    width = max(edges[i + 1] - edges[i] for i in range(n))
    return F.array(*[F.shiftleft(F.lit(p), 2 * width).bitwiseOR(F.shiftleft(block[i], width)).bitwiseOR(block[j]) for p, (i, j) in enumerate(combinations(range(n), 2))])


def near_links(fps: DataFrame, radius: int = 3, tree_size: int = 2_048) -> DataFrame:
    """Links (a, b) that connect the distinct fingerprints `fps` (fp) wherever two differ in `radius` bits or fewer.

    Fingerprints that link agree in two of radius + 2 bit blocks, so a shard for each choice of two
    blocks and their content holds both. Each shard's BK-tree meets only the shard's own
    fingerprints, in one task; a shard above `tree_size` is cut into several trees, and each pair of
    tree and piece is a task's work of its own. Of the links found there, a spanning forest comes
    out, so a group of near copies gives no more rows than it has members in each shard.
    """
    keyed = fps.select("fp", F.explode(_shard_keys(F.col("fp"), radius)).alias("key"))
    trees = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key", F.ceil(F.col("n") / tree_size).cast("int").alias("trees"))
    own = keyed.join(trees, "key").withColumn("own", F.pmod(F.xxhash64("fp"), F.col("trees")).cast("int"))
    met = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("trees") - 1)))
    work = met.select("key", F.least("own", "other").alias("tree"), F.greatest("own", "other").alias("part"), (F.col("own") > F.col("other")).alias("probe"), "fp")
    work = work.repartition("key", "tree", "part").sortWithinPartitions("key", "tree", "part", "probe", "fp")
    return work.mapInArrow(_search(radius), "a long, b long")


def _named(placed: DataFrame, *columns: str) -> DataFrame:
    """Rows (row_key, doc_id, root, ...) with component_id, the smallest doc_id of their root, and `first`: whether theirs is the row that stands for it.

    That is the row of that doc_id; of several, and where none has a doc_id, the one with the smallest row_key.
    """
    best = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "row_key"))
    named = placed.groupBy("root").agg(best.alias("_best"))
    return placed.join(named, "root").select("doc_id", *columns, F.col("_best.doc_id").alias("component_id"), "row_key", (F.col("row_key") == F.col("_best.row_key")).alias("first"))


def near_duplicates(docs: DataFrame, radius: int = 3) -> DataFrame:
    """The near-duplicate class of each row of `docs` (doc_id, text).

    Returns doc_id, fingerprint (16 lower-case hex digits), component_id, the smallest doc_id
    that links of `radius` or fewer differing bits reach, itself included, row_key (what rows alike in
    all columns share) and first (whether the row stands for its class). Null and wordless texts
    have fingerprint 0 and link like any other. Rows that repeat a doc_id or a text each get a
    row; a null doc_id is never a component_id unless its class has no other. An empty table gives
    no rows; other columns don't matter.

    Equal fingerprints are one node, so exact copies cost nothing beyond the grouping.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    keyed = docs.select(identity(*docs.columns).alias("row_key"), "doc_id", "text")
    fps = cut(keyed.mapInArrow(_fingerprint_rows, f"row_key struct<a:bigint,b:bigint>, doc_id {kind}, fp long"))
    best = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "row_key"))
    nodes = fps.groupBy("fp").agg(best.alias("best"))
    roots = connected_components(near_links(nodes.select("fp"), radius)).withColumnRenamed("node", "fp")
    placed = nodes.join(roots, "fp", "left").select("fp", "best", F.coalesce("root", "fp").alias("root"))
    named = placed.groupBy("root").agg(F.min("best").alias("best"))
    classes = placed.select("fp", "root").join(named, "root").select("fp", "best")
    found = fps.join(classes, "fp")
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("best.doc_id").alias("component_id"), "row_key", (F.col("row_key") == F.col("best.row_key")).alias("first"))


#: MinHash bands of near_copies: a pair with Jaccard 0.8 shares one of them but for 1 pair in 14,000.
BANDS, BAND_ROWS = 24, 5


def _permutations() -> tuple[np.ndarray, np.ndarray]:
    both = np.random.default_rng(42).integers(0, 2**64, (2, BANDS * BAND_ROWS), np.uint64)
    return both[0] | np.uint64(1), both[1]


def shingle_set(text: str | None, n: int) -> np.ndarray:
    """The distinct XXH64 hashes of a text's shingles, sorted; fewer than `n` words in all are one shingle."""
    found = [np.zeros(0, np.uint64)]
    for words in word_blocks(text, n - 1):
        runs = shingles(words, n) if len(words) >= n else [b" ".join(words)]
        found.append(np.fromiter(map(xxhash.xxh64_intdigest, runs, repeat(42)), np.uint64))
    return np.unique(np.concatenate(found))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """A key for each band of a set's MinHash; of an empty set none."""
    if not len(hashes):
        return np.zeros(0, np.uint64)
    mul, add = _PERMUTATIONS
    least = np.full(len(mul), 2**64 - 1, np.uint64)
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(0, len(hashes), 1_024):
            least = np.minimum(least, (hashes[i : i + 1_024, None] * mul + add).min(0))
        for row in least.reshape(BANDS, BAND_ROWS).T:
            keys = (keys ^ row ^ (row >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
            keys ^= keys >> np.uint64(29)
    return keys


_PERMUTATIONS = _permutations()


def _node(hashes: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(hashes.astype("<u8").tobytes(), 42)


def _simhash_of(hashes: np.ndarray) -> int:
    ones = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def _sketch_rows(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t, n) for t in batch.column(2).to_pylist()]
            node = np.array([_node(s) for s in sets], np.uint64).view(np.int64)
            fp = np.array([_simhash_of(s) for s in sets], np.uint64).view(np.int64)
            size = np.array([len(s) for s in sets], np.int64)
            keys = pa.array([band_keys(s).view(np.int64) for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(node), pa.array(size), pa.array(fp), keys], names=["row_key", "doc_id", "node", "size", "fp", "keys"])

    return run


def _set_rows(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t, n) for t in batch.column(0).to_pylist()]
            node = np.array([_node(s) for s in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["node", "hashes"])

    return run


def _verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Those of the pairs (a, b) of nodes whose sets have a Jaccard similarity of `least` or more."""
    sides = [sets.select(F.col("node").alias(c), F.col("hashes").alias(f"_{c}")) for c in "ab"]
    na, nb, both = F.size("_a"), F.size("_b"), F.size(F.array_intersect("_a", "_b"))
    met = pairs.distinct().join(sides[0], "a").join(sides[1], "b").where(F.least(na, nb) >= least * F.greatest(na, nb) - 1e-9)
    return met.where(both >= least * (na + nb - both) - 1e-9).select("a", "b")


def _set_links(nodes: list[int], roots: list[int], sets: list[np.ndarray], least: float, pilots: int = 8) -> Iterator[tuple[int, int]]:
    """Links of `least` or more Jaccard similarity that connect the sets as far as all such links and the equal roots do.

    The sets are looked up in an index of all their hashes. After a few, those of the class that is the
    largest by then are passed over as long as they are in it: two of them need no link.
    """
    sizes = np.array([len(s) for s in sets])
    values, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(values, kind="stable")
    owner, (words, start) = owner[order], np.unique(values[order], return_index=True)
    length = np.diff(np.append(start, len(values)))
    label = np.unique(np.array(roots), return_inverse=True)[1]

    def link(x: int) -> Iterator[tuple[int, int]]:
        at = np.searchsorted(words, sets[x])
        runs = length[at]
        ends = np.cumsum(runs)
        both = np.bincount(owner[np.arange(ends[-1]) + np.repeat(start[at] - ends + runs, runs)], minlength=len(sets))
        for y in np.flatnonzero((both >= least * (sizes[x] + sizes - both) - 1e-9) & (label != label[x])).tolist():
            if label[x] != label[y]:
                label[label == label[y]] = label[x]
                yield nodes[x], nodes[y]

    for x in range(min(pilots, len(sets))):
        yield from link(x)
    largest = int(np.flatnonzero(label == np.bincount(label).argmax())[0])
    for x in range(pilots, len(sets)):
        if label[x] != label[largest]:
            yield from link(x)


def _search_sets(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        now, nodes, roots, sets, out = None, [], [], [], []

        def flush() -> pa.RecordBatch:
            pairs = np.array(out, np.int64).reshape(-1, 2)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], schema=schema)

        for batch in batches:
            key, tree, part, node, root = (batch.column(i).to_numpy().tolist() for i in range(5))
            ends = batch.column(5).value_lengths().to_numpy().cumsum().tolist()
            hashes = np.split(batch.column(5).flatten().to_numpy().view(np.uint64), ends[:-1])
            for k, n, r, s in zip(zip(key, tree, part), node, root, hashes):
                if k != now:
                    if len(set(roots)) > 1:
                        out.extend(_set_links(nodes, roots, sets, least))
                    now, nodes, roots, sets = k, [], [], []
                nodes.append(n)
                roots.append(r)
                sets.append(s)
            if len(out) > 10_000:
                yield flush()
        if len(set(roots)) > 1:
            out.extend(_set_links(nodes, roots, sets, least))
        yield flush()

    return run


def _links_in_bands(placed: DataFrame, sets: DataFrame, least: float, across: int, piece: int, piece_hashes: int) -> DataFrame:
    """Links (a, b) among the texts of each band of `placed` (key, node, size, root) whose texts have several roots.

    A band's texts are dealt to pieces of about `piece` texts and `piece_hashes` hashes; each piece is searched
    in one task. With `across` each two pieces meet instead, in bands of that many pieces or more, but for
    those that hold the band's most frequent root alone. A text's set travels once for each task that it is part of.
    """
    # nodes of one root are counted together, so that the most frequent root of a hot band is found in two steps
    held = placed.groupBy("key", "root").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    bands = held.groupBy("key").agg(F.count("*").alias("roots"), F.sum("n").alias("n"), F.sum("size").alias("size"), F.max(F.struct("n", "root", "size")).alias("most")).where("roots > 1")
    pieces = lambda n, size: F.greatest(F.ceil(n / piece), F.ceil(size / piece_hashes)).cast("int")
    every = pieces(F.col("n"), F.col("size"))
    bands = bands.select("key", every.alias("every"), F.col("most.root").alias("most"), pieces(F.col("n") - F.col("most.n"), F.col("size") - F.col("most.size")).alias("rest"), pieces(F.col("most.n"), F.col("most.size")).alias("alike"))
    at = F.xxhash64("node", "key")
    if across:
        own = F.when(F.col("root") == F.col("most"), F.col("rest") + F.pmod(at, F.col("alike"))).otherwise(F.pmod(at, F.col("rest"))).cast("int")
        last = F.when(F.col("own") < F.col("rest"), F.col("rest") + F.col("alike") - 1).otherwise(F.col("rest") - 1)
        dealt = placed.join(bands.where(F.col("every") >= across), "key").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), last))).where("own <> other")
    else:
        dealt = placed.join(bands, "key").withColumn("own", F.pmod(at, F.col("every")).cast("int")).withColumn("other", F.col("own"))
    work = dealt.select("key", F.least("own", "other").alias("tree"), F.greatest("own", "other").alias("part"), "node", "root").join(sets, "node")
    work = work.select("key", "tree", "part", "node", "root", "hashes").repartition("key", "tree", "part").sortWithinPartitions("key", "tree", "part")
    return work.mapInArrow(_search_sets(least), "a long, b long")


def near_copies(docs: DataFrame, n: int = 5, least: float = 0.8, radius: int = 3, rounds: int = 2, piece: int = 2_048, piece_hashes: int = 1_000_000) -> DataFrame:
    """The class of each row of `docs` (doc_id, text) under links of `least` or more Jaccard similarity of distinct `n`-word shingles.

    Returns doc_id, component_id, the smallest doc_id of the class (null if it has none), row_key (what
    rows alike in all columns share) and first (whether the row stands for its class). Words have A-Z
    lower-cased, fewer than `n` are one shingle; wordless and null texts are one class. Rows that repeat
    a doc_id are documents of their own. An empty table gives no rows; other columns don't matter.

    Candidates are the links of SimHash fingerprints of the shingles (`near_links`), and the texts that
    share a MinHash band; bit blocks of fingerprints would tell nothing at the 10 bits or so that
    0.8 means. Each is verified by its sets, so nothing else is linked. A band's texts are searched in
    tasks of about `piece` texts and `piece_hashes` hashes (`_links_in_bands`): first those of some of the bands (an eighth,
    with two `rounds`), then those of all in which texts of different classes are left. Last, in bands of
    several pieces that still hold different classes, pieces meet each other. Pairs without a
    common band are missed, by chance 1 in 14,000 at 0.8 and fewer above.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select(identity(*docs.columns).alias("row_key"), "doc_id", "text")
    rows = cut(rows.mapInArrow(_sketch_rows(n), f"row_key struct<a:bigint,b:bigint>, doc_id {kind}, node long, size long, fp long, keys array<long>"))
    nodes = cut(rows.groupBy("node").agg(F.first("size").alias("size"), F.first("fp").alias("fp"), F.first("keys").alias("keys"), F.min("row_key").alias("row_key")))
    keyed = nodes.select("node", "size", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    keyed = cut(keyed.join(shared, "key"))

    firsts = nodes.groupBy("fp").agg(F.min("node").alias("first"))
    near = near_links(firsts.select("fp"), radius).toDF("fa", "fb").join(firsts.toDF("fa", "a"), "fa").join(firsts.toDF("fb", "b"), "fb").select("a", "b")
    alike = nodes.join(firsts, "fp").where("node <> first").select(F.col("node").alias("a"), F.col("first").alias("b"))
    near = cut(near.unionAll(alike))

    # only texts that have a candidate need their sets, one text of all that have the same
    met = near.select(F.explode(F.array("a", "b")).alias("node")).unionAll(keyed.select("node")).distinct()
    shown = nodes.select("node", "row_key").join(met, "node", "left_semi").select("row_key")
    sets = docs.select(identity(*docs.columns).alias("row_key"), "text").join(shown, "row_key", "left_semi")
    sets = cut(sets.select("text").mapInArrow(_set_rows(n), "node long, hashes array<long>").groupBy("node").agg(F.first("hashes").alias("hashes")))

    links = cut(_verified(near, sets, least))
    # near texts share many bands: those that some of the bands have connected needn't meet in the others
    turns = [(max(1, 8 >> 3 * i), 0) for i in reversed(range(rounds))]
    large = keyed.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("size")).where((F.col("n") > piece) | (F.col("size") > piece_hashes))
    if not rounds or not large.isEmpty():  # a band of one piece is done by then
        turns.append((8, 2 if rounds else 1))
    for share, across in turns:
        placed = keyed.where(F.pmod(F.xxhash64("key"), F.lit(8)) < share)
        placed = cut(placed.join(connected_components(links), "node", "left").select("key", "node", "size", F.coalesce("root", "node").alias("root")))
        found = _links_in_bands(placed, sets, least, across, piece, piece_hashes)
        before, links = links, cut(links.unionAll(found))
        drop_cut(before)
        drop_cut(placed)
    roots = connected_components(links)
    return _named(cut(rows.select("row_key", "doc_id", "node").join(roots, "node", "left").select("row_key", "doc_id", F.coalesce("root", "node").alias("root"))))


def keep_first(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """The rows of `docs` that stand for their class in `classes` (row_key, first), one for each.

    `classes` is what `near_duplicates` or `near_copies` gives for the same rows. Ids may be null or repeated: rows are found by all
    their columns. Of rows alike in all of them one stays; these are counted before they are shuffled.
    """
    key = fresh(docs, "_key")
    keyed = docs.withColumn(key, identity(*docs.columns))
    kept = cut(classes.where("first").groupBy(F.col("row_key").alias(key)).agg(F.count("*").alias("n")))
    left = keyed.join(kept.where("n = 1"), key, "left_semi")
    if not kept.where("n > 1").isEmpty():
        left = left.unionByName(keyed.join(kept.where("n > 1"), key, "left_semi").dropDuplicates([key]))
    return left.drop(key)
