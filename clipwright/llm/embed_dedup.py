"""Embedding near-duplicates by a subspace pigeonhole join."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipwright.llm.common import cut
from clipwright.llm.graph import connected_components

#: Rotated coordinates are whole multiples of 1 / GRID, so that float32 products of them are exact.
GRID = 1 << 10


@lru_cache(maxsize=64)
def rotation(width: int, seed: int = 7) -> np.ndarray:
    """A fixed random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng((seed, width)).standard_normal((width, width)))
    return q * np.sign(np.diag(r))


def block_edges(width: int, n_blocks: int) -> list[int]:
    n = min(n_blocks, width)
    return [width * i // n for i in range(n + 1)]


def block_limits(width: int, n_blocks: int, cosine: float) -> list[float]:
    """The largest squared distance, in grid units, at which a block makes a pair a candidate.

    Unit vectors of this cosine are 2 - 2 * cosine apart (squared). Blocks share that in proportion
    to their width, and one at least stays within its share; what rounding to the grid can add is on top.
    """
    edges = block_edges(width, n_blocks)
    widths = [b - a for a, b in zip(edges, edges[1:])]
    return [(math.sqrt((2 - 2 * cosine) * w / width) * GRID + math.sqrt(w) + 1e-6) ** 2 for w in widths]


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, in double precision, without overflow."""
    v = vectors.astype(np.float64)
    v /= np.abs(v).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def rotated(units: np.ndarray) -> np.ndarray:
    return np.rint(units @ rotation(units.shape[1]) * GRID).astype(np.float32)


def _vectors(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _strip_rows(n_blocks: int, cosine: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            widths = batch.column(1).to_numpy()
            strips: list[list[int] | None] = [None] * len(widths)
            for width in np.unique(widths).tolist():
                where = np.flatnonzero(widths == width)
                grid = rotated(unit(_vectors(batch.column(2).take(pa.array(where)), width)))
                starts = block_edges(width, n_blocks)[:-1]
                reach = [math.ceil(math.sqrt(x)) for x in block_limits(width, n_blocks, cosine)]
                found = np.stack([np.floor(grid[:, s] / r) for s, r in zip(starts, reach)], 1).astype(np.int64).tolist()
                for i, own in zip(where.tolist(), found):
                    strips[i] = own
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(strips, pa.list_(pa.int64()))], names=["node", "strips"])

    return run


def _components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index that each of n nodes reaches over the edges (a, b)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _link_group(cosine: float, n_blocks: int, rows_at_once: int = 512):
    """Links between the two chunks of a group, or within its one chunk, first found in the group's block."""

    def run(group: pa.Table) -> pa.Table:
        width, block = group["width"][0].as_py(), group["block"][0].as_py()
        node, copies = group["node"].to_numpy(), group["copies"].to_numpy()
        right = group["right"].to_numpy()
        units = unit(_vectors(group["embedding"], width))
        grid = rotated(units)
        edges, limits = block_edges(width, n_blocks), block_limits(width, n_blocks, cosine)
        alone = not right.any()
        left_at = np.flatnonzero(~right)
        right_at = left_at if alone else np.flatnonzero(right)

        def near(i: np.ndarray, j: np.ndarray, k: int) -> np.ndarray:
            # whole numbers below 2 ** 24 throughout, so exact whatever the order of the sums
            x, y = grid[i, edges[k] : edges[k + 1]], grid[j, edges[k] : edges[k + 1]]
            one_x, one_y = np.ones((len(x), 1), np.float32), np.ones((len(y), 1), np.float32)
            left = np.hstack([x, (x * x).sum(1, keepdims=True), one_x])
            return left @ np.hstack([-2 * y, one_y, (y * y).sum(1, keepdims=True)]).T <= limits[k]

        links = np.zeros(len(node), np.int64)
        ends: list[tuple[np.ndarray, np.ndarray]] = []
        for start in range(0, len(left_at), rows_at_once):
            i = left_at[start : start + rows_at_once]
            j = right_at[start:] if alone else right_at
            mask = near(i, j, block)
            if alone:
                mask &= np.arange(len(i))[:, None] < np.arange(len(j))[None, :]
            rows, columns = mask.any(1), mask.any(0)
            if not rows.any():
                continue
            i, j, mask = i[rows], j[columns], mask[rows][:, columns]
            for earlier in range(block):
                mask &= ~near(i, j, earlier)
            mask &= units[i] @ units[j].T >= cosine
            links[i] += mask @ copies[j]
            links[j] += mask.T @ copies[i]
            a, b = np.nonzero(mask)
            if len(a):
                root = _components(len(i) + len(j), a, b + len(i))
                both = np.concatenate([i, j])
                moved = np.flatnonzero(root != np.arange(len(both)))
                ends.append((both[moved], both[root[moved]]))
        used = np.flatnonzero(links)
        root = np.arange(len(node))
        if ends:
            order = np.argsort(node, kind="stable")
            rank = np.empty(len(node), np.int64)
            rank[order] = np.arange(len(node))
            a, b = (rank[np.concatenate([e[k] for e in ends])] for k in (0, 1))
            root = order[_components(len(node), a, b)[rank]]
        return pa.table({"node": node[used], "links": links[used], "root": node[root[used]]})

    return run


def near_vectors(vectors: DataFrame, cosine: float = 0.9, n_blocks: int = 4, chunk: int = 4_096) -> DataFrame:
    """Links between rows of `vectors` (vec_id, embedding) of a cosine of at least `cosine`.

    Returns vec_id, n_links (other rows linked directly), component_id (the smallest vec_id that
    links reach, itself included) and kept (vec_id = component_id). An embedding that is null, empty, zero or
    holds null or non-finite components links with nothing, nor do embeddings of different
    widths. Repeated rows and equal embeddings count each. A null vec_id is linked and counted but is never
    a component_id unless its component has no other. An empty table gives no rows; other
    columns don't matter.

    Equal embeddings are one node with a count. Nodes are rotated and split into `n_blocks` subspaces;
    of two that link, one block at least is within its share of the squared distance. Each block is
    a range join: along its first coordinate nodes lie in strips as wide as the block's reach, and meet those of
    their own and the next strip. A strip above `chunk` nodes is cut into chunks, and each pair of
    chunks is a group of bounded size, so a dense strip is spread over many tasks. Groups compare
    block distances, then check the candidates' cosines in double precision. A pair that several
    blocks find counts for the first one only: grid distances are exact whole numbers, so each
    group knows. Groups give back, per node, a number of links and a spanning forest, never pairs.
    """
    valid = (F.size("embedding") > 0) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    rows = vectors.select("vec_id", "embedding", F.coalesce(F.col("embedding").isNotNull() & valid, F.lit(False)).alias("valid"))
    nodes = rows.where("valid").groupBy("embedding").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"))
    nodes = cut(nodes.select("embedding", "first", "copies", F.size("embedding").alias("width"), F.monotonically_increasing_id().alias("node")))

    strips = nodes.select("node", "width", "embedding").mapInArrow(_strip_rows(n_blocks, cosine), "node long, strips array<long>")
    strips = cut(nodes.select("node", "width").join(strips, "node").select("node", "width", F.posexplode("strips").alias("block", "strip")))
    chunks = strips.groupBy("width", "block", "strip").agg(F.ceil(F.count("*") / chunk).cast("int").alias("chunks"))
    beside = lambda step, name: chunks.select("width", "block", (F.col("strip") - step).alias("strip"), F.col("chunks").alias(name))
    key = ["width", "block", "strip"]
    chunks = chunks.join(beside(1, "above"), key, "left").join(beside(-1, "below"), key, "left")
    dealt = strips.join(chunks, key).withColumn("own", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))

    def groups(count: str, make) -> F.Column:
        none = F.array().cast("array<struct<low:bigint,own:int,other:int,next:boolean,right:boolean>>")
        return F.when(F.col(count) > 0, F.transform(F.sequence(F.lit(0), F.col(count) - 1), make)).otherwise(none)

    def group(low, own, other, following, right):
        return F.struct(low.alias("low"), own.alias("own"), other.alias("other"), F.lit(following).alias("next"), right.alias("right"))

    strip, own = F.col("strip"), F.col("own")
    within = groups("chunks", lambda c: group(strip, F.least(own, c), F.greatest(own, c), False, own > c))
    above = groups("above", lambda c: group(strip, own, c, True, F.lit(False)))
    below = groups("below", lambda c: group(strip - 1, c, own, True, F.lit(True)))
    met = dealt.select("node", "width", "block", F.explode(F.concat(within, above, below)).alias("g")).select("node", "width", "block", "g.*")
    met = met.join(nodes.select("node", "copies", "embedding"), "node")
    found = met.groupBy("width", "block", "low", "own", "other", "next").applyInArrow(_link_group(cosine, n_blocks), "node long, links long, root long")
    found = cut(found)

    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = connected_components(found.select("node", "root"))
    placed = nodes.join(links, "node", "left").join(roots, "node", "left")
    placed = placed.select("embedding", "first", F.coalesce("root", "node").alias("root"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    named = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = placed.join(named, "root").select("embedding", "component_id", "n_links")
    linked = rows.where("valid").join(classes, "embedding").select("vec_id", "n_links", "component_id")
    single = rows.where("not valid").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    both = linked.unionByName(single)
    return both.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
