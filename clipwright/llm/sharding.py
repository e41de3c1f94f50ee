"""Sharding by rendezvous hashing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipwright.llm.common import cut, fresh, identity, numbered, repeated, running_sum, uniform


def _bids(key: Column, weights: Sequence[float], seed: str) -> list[Column]:
    return [F.struct((-F.log(uniform(seed, key, str(s))) / float(w)).alias("bid"), F.lit(s).alias("shard")) for s, w in enumerate(weights)]


def _lowest(bids: Sequence[Column]) -> Column:
    return F.least(*bids) if len(bids) > 1 else bids[0]


def rendezvous(key: Column, weights: Sequence[float], seed: str = "shard") -> Column:
    """The shard, 0 to len(weights) - 1, that wins `key`.

    Each shard bids -ln(u) / weight with a u of the key and the shard alone, and the lowest bid
    wins: a new shard takes keys only into itself, and shards win keys in proportion to weights.
    """
    return _lowest(_bids(key, weights, seed))["shard"]


def assign_shards(docs: DataFrame, weights: Sequence[float] = (1.0,) * 24, grown: Sequence[float] | None = None) -> DataFrame:
    """A shard and a slot for each row of `docs` (doc_id, text).

    Returns doc_id, size (UTF-8 bytes of the text, none for null, plus 8), text_crc32 (unsigned; 0
    for null), law, shard, slot (0, 1, 2, ... within the shard) and grown_shard (the shard once
    another one of weight 1, or `grown` as a whole, is there).

    doc_id and the weights decide the shard, so rows that repeat a doc_id share one, and so do all
    rows without doc_id. Slots follow a hash of doc_id and checksum, then doc_id, checksum and size; rows alike
    in all these are interchangeable. An empty table gives no rows; other columns don't matter.

    Only numbers are shuffled. Rows alike are counted first and dealt out again at the end, and slots are counted in
    buckets, so neither a shard nor a document with very many copies has to fit into a task.
    """
    grown = [*weights, 1.0] if grown is None else list(grown)
    text = F.coalesce(F.col("text"), F.lit(""))
    bids = _bids(F.col("doc_id"), grown, "shard")
    same = list(weights) == grown[: len(weights)]
    won = _lowest(bids[: len(weights)]) if same else _lowest(_bids(F.col("doc_id"), weights, "shard"))
    after = _lowest([won, *bids[len(weights) :]]) if same else _lowest(bids)
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        won["shard"].alias("shard"),
        after["shard"].alias("grown_shard"),
    )
    rows = rows.groupBy(*rows.columns).agg(F.count("*").alias("_copies"))
    rows = cut(rows.withColumn("_at", uniform("slot", F.col("doc_id"), F.col("text_crc32"))))
    placed = repeated(cut(running_sum(rows, ["shard"], "_at", ["doc_id", "text_crc32", "size"], "_copies")), "_copies", "_nth")
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("before") + F.col("_nth")).cast("long").alias("slot"), "grown_shard")


def write_shards(docs: DataFrame, shards: DataFrame, path: str, rows_per_file: int = 1_000_000) -> None:
    """Write the rows of `docs` (doc_id, text), with shard and slot, as Parquet in a folder per shard, in files of `rows_per_file` rows at most.

    `shards` is what `assign_shards` gives for them. Rows are found by doc_id, size and checksum, any id may be
    null or repeated: of rows alike in these, each gets one of the slots that they have together, which follow on
    each other. Columns of `docs` named shard or slot give way to the new ones.
    """
    docs = docs.select(*[c for c in docs.columns if c.lower() not in ("shard", "slot")])
    key, first, n, place = (fresh(docs, c) for c in ("_key", "_first", "_n", "_place"))
    text = F.coalesce(F.col("text"), F.lit(""))
    found = shards.groupBy(identity("doc_id", "size", "text_crc32").alias(key), "shard").agg(F.min("slot").alias(first), F.count("*").alias(n))
    own = identity(F.col("doc_id"), (F.octet_length(text) + 8).cast("long"), F.crc32(text.cast("binary")))
    joined = docs.withColumn(key, own).join(found, key)
    alone = joined.where(F.col(n) == 1).withColumn(place, F.lit(0).cast("long"))
    placed = alone.unionByName(numbered(joined.where(F.col(n) > 1), [key], place))
    placed = placed.withColumn("slot", F.col(first) + F.col(place)).withColumn(place, F.floor(F.col("slot") / rows_per_file))
    placed = placed.repartition("shard", place).sortWithinPartitions("shard", "slot").select(*docs.columns, "shard", "slot")
    placed.write.partitionBy("shard").option("maxRecordsPerFile", rows_per_file).parquet(path)
