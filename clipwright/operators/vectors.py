"""Searching and clustering vectors."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


def _best(rows: list[pa.Table], least: float, most: int) -> pa.RecordBatch:
    """The `most` best vectors of one piece for each reference of one block."""
    table = pa.concat_tables(rows)
    is_ref, ids = table["ref"].to_numpy(), table["id"].to_numpy()
    out: list[tuple[np.ndarray, ...]] = []
    if is_ref.any() and not is_ref.all():
        x = np.stack(table["v"].to_numpy())
        refs, vecs, ref_ids, vec_ids = x[is_ref], x[~is_ref], ids[is_ref], ids[~is_ref]
        norms = np.sqrt((refs**2).sum(1))[:, None] * np.sqrt((vecs**2).sum(1))[None, :]
        cos = np.divide(refs @ vecs.T, norms, out=np.zeros_like(norms), where=norms > 0)
        scores = np.sign(cos) * np.floor(np.abs(cos) * 1000 + 0.5) / 1000
        for i, row in enumerate(scores):
            near = np.flatnonzero(row >= least)
            near = near[np.lexsort((vec_ids[near], -row[near]))[:most]]
            out.append((np.full(len(near), ref_ids[i]), vec_ids[near], row[near]))
    columns = [np.concatenate([o[c] for o in out]) if out else np.zeros(0, kind) for c, kind in enumerate((np.int64, np.int64, np.float64))]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["ref_id", "vec_id", "score"])


def _last(rows: list[pa.Table], least: float, _: int) -> pa.RecordBatch:
    """For each vector of one piece the reference of the highest id of one block that it is near to; of equal ids the nearer one."""
    table = pa.concat_tables(rows)
    is_ref, ids = table["ref"].to_numpy(), table["id"].to_numpy()
    out = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    if is_ref.any() and not is_ref.all():
        x = np.stack(table["v"].to_numpy())
        refs, vecs, ref_ids, vec_ids = x[is_ref], x[~is_ref], ids[is_ref], ids[~is_ref]
        order = np.argsort(-ref_ids, kind="stable")
        refs, ref_ids = refs[order], ref_ids[order]
        norms = np.sqrt((refs**2).sum(1))[:, None] * np.sqrt((vecs**2).sum(1))[None, :]
        cos = np.divide(refs @ vecs.T, norms, out=np.zeros_like(norms), where=norms > 0)
        scores = np.sign(cos) * np.floor(np.abs(cos) * 1000 + 0.5) / 1000
        near = scores >= least
        hit = near.any(0)
        top = ref_ids[near.argmax(0)]
        best = np.where(near & (ref_ids[:, None] == top[None, :]), scores, -np.inf).max(0)
        out = (top[hit], vec_ids[hit], best[hit])
    return pa.RecordBatch.from_arrays([pa.array(c) for c in out], names=["ref_id", "vec_id", "score"])


def _search(least: float, most: int, best: Callable = _best):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            keys = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()])
            edges = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
            for start, stop in zip(edges, edges[1:]):
                if start == stop:
                    continue
                if (key := tuple(keys[:, start])) != now and held:
                    yield best(held, least, most)
                    held = []
                now = key
                held.append(pa.Table.from_batches([batch.slice(start, stop - start)]))
        if held:
            yield best(held, least, most)

    return run


def search(vectors: DataFrame, references: DataFrame, least: float = 0.75, most: int = 10, block: int = 512, piece: int = 4_096) -> DataFrame:
    """The vectors nearest to each reference (ref_id, ref), `most` at most, of a cosine of `least` or more.

    References are dealt to blocks of about `block`, vectors to pieces of about `piece`; each pair of
    block and piece is a task's work of its own, which gives the best of the piece for each
    reference. These are merged by reference. Ids are integers; rows without a vector match nothing.
    """
    met = _met(vectors, references, block, piece).mapInArrow(_search(least, most), "ref_id long, vec_id long, score double")
    w = Window.partitionBy("ref_id").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most).select("ref_id", "vec_id", "score", "place")


def last_references(vectors: DataFrame, references: DataFrame, least: float = 0.75, block: int = 2_048, piece: int = 4_096) -> DataFrame:
    """(ref_id, vec_id, score): for each vector the reference (ref_id, ref) of the highest id with a cosine of `least` or more.

    All pairs are looked at in blocks and pieces, as in `search`; a vector leaves each with one row at most, however many it is near to.
    """
    met = _met(vectors, references, block, piece).mapInArrow(_search(least, 1, _last), "ref_id long, vec_id long, score double")
    return met.groupBy("vec_id").agg(F.max(F.struct("ref_id", "score")).alias("m")).select("m.ref_id", "vec_id", "m.score")


def _met(vectors: DataFrame, references: DataFrame, block: int, piece: int) -> DataFrame:
    """(block, piece, ref, id, v): the rows of every block of references and piece of vectors, one after the other."""
    vectors = vectors.where("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    references = references.where("ref_id is not null and ref is not null").select(F.col("ref_id").cast("long").alias("id"), F.col("ref").cast("array<double>").alias("v"))
    pieces, blocks = (max(1, -(-df.count() // size)) for df, size in ((vectors, piece), (references, block)))

    def dealt(n: int) -> Column:
        # v tells rows apart that repeat an id
        return F.pmod(F.xxhash64("id", "v"), F.lit(n)).cast("int")

    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = references.withColumn("block", dealt(blocks)).select("block", every(pieces).alias("piece"), F.lit(True).alias("ref"), "id", "v")
    right = vectors.withColumn("piece", dealt(pieces)).select(every(blocks).alias("block"), "piece", F.lit(False).alias("ref"), "id", "v")
    return left.unionAll(right).repartition("block", "piece").sortWithinPartitions("block", "piece")


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder. Where none is set, one under /tmp if all runs on this machine; on a cluster that is an error."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = context.getConf().get("spark.checkpoint.dir")
        if not shared and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return context.getCheckpointDir()


def _cut(df: DataFrame) -> DataFrame:
    """`df` written to the session's checkpoint folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def _unit(rows: list) -> np.ndarray:
    x = np.stack([np.asarray(v, float) for v in rows])
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _first_leaders(least: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """The first leader of one piece that each vector of the block is near to."""
        leaders, own = pdf[pdf["leader"]].sort_values("vec_id"), pdf[~pdf["leader"]]
        if leaders.empty or own.empty:
            return pd.DataFrame({"vec_id": [], "leader_id": []}, dtype="int64")
        near = _unit(own["v"]) @ _unit(leaders["v"]).T > least
        hit = near.any(1)
        return pd.DataFrame({"vec_id": own["vec_id"].to_numpy()[hit], "leader_id": leaders["vec_id"].to_numpy()[near.argmax(1)[hit]]})

    return run


def _settled(least: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """The block's vectors that no earlier leader is near to, among themselves in order."""
        pdf = pdf.sort_values("vec_id")
        x, ids = _unit(pdf["v"]), pdf["vec_id"].to_numpy()
        leaders, out = [], []
        for i in range(len(x)):
            near = np.flatnonzero(x[leaders] @ x[i] > least) if leaders else []
            out.append(leaders[near[0]] if len(near) else i)
            if not len(near):
                leaders.append(i)
        return pd.DataFrame({"vec_id": ids, "leader_id": ids[out]})

    return run


def leader_clusters(vectors: DataFrame, by: str, least: float = 0.45, block: int = 4_096, piece: int = 4_096) -> DataFrame:
    """In order of vec_id, each vector joins the first leader with a cosine above `least`, or else becomes one; within each `by` (a video).

    A group goes through its vectors in blocks of `block`: those of a block meet the leaders so far, dealt in pieces of `piece` to
    tasks of their own; what none of them is near to is settled in one task, which so holds one block at most. All groups go
    through their blocks together. Ids are distinct within a group; rows without id or vector are left out.
    """
    w = Window.partitionBy(by).orderBy("vec_id")
    rows = vectors.where("vec_id is not null and embedding is not null").select(by, F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    placed = rows.select(by, "vec_id").withColumn("_block", F.floor((F.row_number().over(w) - 1) / block).cast("int"))
    rows = _cut(rows.join(placed, [by, "vec_id"]))
    kind = rows.schema[by].dataType.simpleString()
    done, leaders = [], None
    for i in range((rows.agg(F.max("_block")).first()[0] or 0) + 1):
        now = rows.where(F.col("_block") == i).select(by, "vec_id", "v")
        if leaders is not None:
            pieces = leaders.groupBy(by).agg(F.ceil(F.count("*") / piece).alias("_n"))
            each = now.join(pieces, by).withColumn("_piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1))).select(by, "_piece", "vec_id", "v", F.lit(False).alias("leader"))
            dealt = leaders.join(pieces, by).select(by, F.pmod(F.xxhash64("vec_id"), F.col("_n")).alias("_piece"), "vec_id", "v", F.lit(True).alias("leader"))
            found = each.unionByName(dealt).groupBy(by, "_piece").applyInPandas(_named(by, _first_leaders(least)), f"{by} {kind}, vec_id long, leader_id long")
            found = _cut(found.groupBy(by, "vec_id").agg(F.min("leader_id").alias("leader_id")))
            done.append(found)
            now = now.join(found, [by, "vec_id"], "left_anti")
        own = _cut(now.groupBy(by).applyInPandas(_named(by, _settled(least)), f"{by} {kind}, vec_id long, leader_id long"))
        done.append(own)
        new = rows.join(own.where("vec_id = leader_id").select(by, "vec_id"), [by, "vec_id"]).select(by, "vec_id", "v")
        leaders = _cut(new if leaders is None else leaders.unionByName(new))
    return reduce(DataFrame.unionByName, done)


def _named(by: str, run):
    """`run`, with the group's `by` put before its columns."""

    def named(pdf: pd.DataFrame) -> pd.DataFrame:
        out = run(pdf)
        out.insert(0, by, pdf[by].iloc[0])
        return out

    return named
