"""Benchmark decontamination: test items inside documents, by size-partitioned MinHash containment."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipwright.llm.common import cut, fresh, identity, shingles, word_blocks

#: Probes of a filter for each hash.
PROBES = 4


def needed(n: int, threshold: float) -> int:
    """How many of n shingles make a containment of `threshold`."""
    return max(1, math.ceil(threshold * n - 1e-9))


def _mixed(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def shingle_hashes(words: list[bytes], n: int) -> np.ndarray:
    """A 63-bit hash for each run of n words."""
    each = np.fromiter(map(zlib.crc32, words), np.uint64, len(words))
    h = np.zeros(len(words) - n + 1, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(n):
            h = h * np.uint64(0x9E3779B97F4A7C15) + each[i : len(words) - n + 1 + i]
            h ^= h >> np.uint64(29)
        return _mixed(h) >> np.uint64(1)


def size_class(n: int) -> int:
    """The partition of items with n shingles: those of as many binary digits."""
    return n.bit_length()


def places(hashes: np.ndarray, part: int, bits: int) -> np.ndarray:
    """The bits of a filter that stand for each hash in a partition: a row for each probe."""
    with np.errstate(over="ignore"):
        h = _mixed(hashes + np.uint64(part) * np.uint64(0x9E3779B97F4A7C15))
        low, step = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
        return np.stack([(low + np.uint64(i) * step) & np.uint64((1 << bits) - 1) for i in range(PROBES)])


def _in_filter(hashes: np.ndarray, part: int, known: np.ndarray, bits: int) -> np.ndarray:
    at = places(hashes, part, bits)
    found = np.ones(len(hashes), bool)
    for row in at:
        found &= (known[row >> np.uint64(3)] >> (row & np.uint64(7)).astype(np.uint8)) & 1 > 0
    return found


def text_shingles(text: str | None, n: int) -> Iterator[tuple[list[bytes], int, np.ndarray]]:
    """Blocks of (words, run length, hashes). Fewer than n words in all are one run."""
    for words in word_blocks(text, n - 1):
        run = min(n, len(words))
        yield words, run, shingle_hashes(words, run)


def _item_rows(n: int, threshold: float, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, strings, hashes, sizes, sketch, own_places, part_places = [], [], [], [], [], [], []
            for i, text in enumerate(batch.column(2).to_pylist()):
                own = {s: h for words, r, hs in text_shingles(text, n) for s, h in zip(shingles(words, r), hs.tolist())}
                if not own:
                    continue
                k = len(own) - needed(len(own), threshold) + 1
                ranked = sorted(own.items(), key=lambda x: x[1])
                each = np.array([h for _, h in ranked], np.uint64)
                at += [i] * len(own)
                strings += [s.decode("utf-8", "replace") for s, _ in ranked]
                hashes += each.view(np.int64).tolist()
                sizes += [len(own)] * len(own)
                sketch += [rank < k for rank in range(len(own))]
                own_places += places(each, 0, bits).T.astype(np.int64).tolist()
                part_places += places(each, size_class(len(own)), bits).T.astype(np.int64).tolist()
            rows = pa.array(at, pa.int64())
            long_lists = pa.list_(pa.int64())
            columns = [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(strings, pa.string()), pa.array(hashes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(sketch, pa.bool_()), pa.array(own_places, long_lists), pa.array(part_places, long_lists)]
            yield pa.RecordBatch.from_arrays(columns, names=["item_key", "item_id", "shingle", "hash", "n", "sketch", "places", "part_places"])

    return run


def _filter(rows: DataFrame, column: str, bits: int) -> np.ndarray:
    """The bits that `column`'s arrays name, 1 << bits of them: put together by Spark in pieces of 4 KiB, of which the driver gets one for each 32,768 bits."""
    each = rows.select(F.explode(F.array_distinct(column)).alias("p")).select((F.col("p") + 1).alias("p"))
    made = each.groupBy(F.bitmap_bucket_number("p").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits"))
    known = np.zeros((1 << bits) // 8, np.uint8)
    for r in made.collect():
        start = (r["bucket"] - 1) * 4096
        piece = np.frombuffer(bytes(r["bits"]), np.uint8)[: len(known) - start]
        known[start : start + len(piece)] = piece
    return known


def _document_rows(n: int, bits: int, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketches, every, parts = shared.value
        for batch in batches:
            at, sizes, hit_parts, hit_hashes, strings = [], [], [], [], []
            for i, text in enumerate(batch.column(2).to_pylist()):
                hashes = [hs for _, _, hs in text_shingles(text, n)]
                if not hashes:
                    continue
                hashes = np.concatenate(hashes)
                found = {p: np.unique(hashes[_in_filter(hashes, p, sketches, bits)]) for p, need in parts if len(hashes) >= need}
                if not any(map(len, found.values())):
                    continue
                own: dict[bytes, None] = {}
                for words, r, hs in text_shingles(text, n):
                    for j in np.flatnonzero(_in_filter(hs, 0, every, bits)).tolist():
                        own[b" ".join(words[j : j + r])] = None
                at.append(i)
                sizes.append(len(hashes))
                hit_parts.append([p for p, hs in found.items() for _ in hs])
                hit_hashes.append([h for hs in found.values() for h in hs.view(np.int64).tolist()])
                strings.append([s.decode("utf-8", "replace") for s in own])
            rows = pa.array(at, pa.int64())
            lists = [pa.array(hit_parts, pa.list_(pa.int32())), pa.array(hit_hashes, pa.list_(pa.int64())), pa.array(strings, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(sizes, pa.int64()), *lists], names=["text_key", "doc_id", "size", "parts", "hashes", "shingles"])

    return run


def find_contained(docs: DataFrame, items: DataFrame, threshold: float = 0.8, n: int = 5, filter_bits: int = 24) -> DataFrame:
    """Items (item_id, text) of which `threshold` or more of the distinct shingles are in a document (doc_id, text).

    Returns a row per document and item: doc_id, item_id, found, n_shingles, containment and text_key. Words have
    A-Z lower-cased, shingles are n words; fewer words in all are one shingle, so a shorter item is
    found only in a document with just these words. Null and wordless texts contain nothing
    and are in nothing. Rows alike in id and text are one document, or one item; rows that share only
    the id, null or not, are documents or items of their own.

    An item's sketch is its bottom-k MinHash. k depends on its size q: a document that has all but
    q - k of the shingles has one of any k, so no contained item is missed, however long
    the document. Items are partitioned by size. A document is held against the sketches of the partitions
    that it is long enough for, and is a candidate for the items of which it has a hash of the sketch;
    these pairs are verified by counting the item's shingles in the document.

    Documents are read once, in tasks that hold two filters of `filter_bits` (2 MiB each): of the sketches' hashes by partition, which decide whether a document goes on,
    and of the items' shingles, which decide what of it does. A benchmark of more than a million items or
    so asks for larger ones; a filter that is too small costs time, not results.
    """
    spark = docs.sparkSession
    types = {"doc": docs.schema["doc_id"].dataType.simpleString(), "item": items.schema["item_id"].dataType.simpleString()}
    rows = items.select(identity("item_id", "text").alias("item_key"), "item_id", "text").dropDuplicates(["item_key"])
    key = "struct<a:bigint,b:bigint>"
    rows = rows.mapInArrow(_item_rows(n, threshold, filter_bits), f"item_key {key}, item_id {types['item']}, shingle string, hash long, n long, sketch boolean, places array<long>, part_places array<long>")
    need = F.greatest(F.lit(1), F.ceil(F.col("n") * threshold - 1e-9))
    rows = cut(rows.withColumn("need", need).withColumn("part", F.length(F.bin("n"))))
    parts = [(r["part"], r["need"]) for r in rows.groupBy("part").agg(F.min("need").alias("need")).collect()]  # at most 64
    shared = spark.sparkContext.broadcast((_filter(rows.where("sketch"), "part_places", filter_bits), _filter(rows, "places", filter_bits), parts))

    met = docs.select(identity("text").alias("text_key"), "doc_id", "text").mapInArrow(_document_rows(n, filter_bits, shared), f"text_key {key}, doc_id {types['doc']}, size long, parts array<int>, hashes array<long>, shingles array<string>")
    met = cut(met)
    hits = met.select("text_key", "size", F.explode(F.arrays_zip("parts", "hashes")).alias("hit")).select("text_key", "size", F.col("hit.parts").alias("part"), F.col("hit.hashes").alias("hash"))
    sketches = rows.where("sketch").select("part", "hash", "item_key", "need")
    candidates = hits.join(sketches, ["part", "hash"]).where("size >= need").select("text_key", "item_key").distinct()
    # only candidates meet their texts' shingles, and only their own items' are looked up
    own = met.groupBy("text_key").agg(F.first("shingles").alias("shingles"))
    asked = candidates.join(own, "text_key").select("text_key", "item_key", F.explode("shingles").alias("shingle"))
    shared_rows = asked.join(rows.select("item_key", "shingle", "item_id", "n", "need"), ["item_key", "shingle"])
    counted = shared_rows.groupBy("text_key", "item_key").agg(F.count("*").alias("found"), F.first("item_id").alias("item_id"), F.first("n").alias("n_shingles"), F.first("need").alias("need")).where("found >= need")
    documents = met.select("doc_id", "text_key").distinct()
    return documents.join(counted, "text_key").select("doc_id", "item_id", "found", "n_shingles", (F.col("found") / F.col("n_shingles")).alias("containment"), "text_key")


def drop_contaminated(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of `docs` whose text isn't among those in `found` (text_key), whatever their doc_id."""
    key = fresh(docs, "_key")
    gone = found.select(F.col("text_key").alias(key)).distinct()
    return docs.withColumn(key, identity("text")).join(gone, key, "left_anti").select(*docs.columns)
