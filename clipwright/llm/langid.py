"""Language identification by interpolated Kneser-Ney character models."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipwright.llm.common import cut

ORDER = 4
SPACE = 32
#: Models of up to so many n-grams and contexts, at twelve bytes each, are sent to all tasks; larger ones stay tables that texts' n-grams are joined to.
MOST_SENT = 4_000_000
CHUNK = 1 << 20
TEMPERATURES = (0.5, 1.0, 2.0, 4.0, 8.0, 16.0, 32.0)


def _fold() -> tuple[np.ndarray, np.ndarray]:
    """Letters of the basic plane in lower case and marks that combine with them, all else a space; and which of these are letters."""
    folded, letter = np.full(1 << 16, SPACE, np.uint16), np.zeros(1 << 16, bool)
    for c in range(1 << 16):
        if (x := chr(c)).isalpha():
            low = x.lower()
            folded[c] = ord(low) if len(low) == 1 and ord(low) < 1 << 16 else c
            letter[c] = True
        elif unicodedata.category(x)[0] == "M":
            folded[c] = c
    return folded, letter


_FOLDED, _LETTER = _fold()


def symbols(text: str | None) -> np.ndarray:
    """A text's letters and their marks, folded, with one space for each run of other characters; empty without letters.

    Letters beyond the basic plane share one symbol.
    """
    codes = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)
    low = np.minimum(codes, 0xFFFF)
    folded = _FOLDED[low]
    any_letter = bool(_LETTER[low[codes <= 0xFFFF]].any())
    far = codes > 0xFFFF
    if far.any():
        letters = [c for c in np.unique(codes[far]).tolist() if chr(c).isalpha()]
        folded[far] = np.where(np.isin(codes[far], letters), 0xFFFF, SPACE)
        any_letter |= bool(letters)
    if not any_letter:
        return np.zeros(0, np.uint16)
    spaces = folded == SPACE
    keep = ~(spaces & np.concatenate([[True], spaces[:-1]]))
    return folded[keep]


def pieces(texts: list[str | None]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """Texts' n-grams in chunks of bounded length: (index of each text, where each starts, packed n-grams).

    A text is taken with spaces before and one after. A text longer than a chunk comes in several pieces, which
    share no n-gram and lose none.
    """
    at: list[int] = []
    held: list[np.ndarray] = []
    size = 0
    pad = np.full(ORDER - 1, SPACE, np.uint64)

    def grams(whole: np.ndarray) -> np.ndarray:
        n = len(whole) - ORDER + 1
        key = np.zeros(n, np.uint64)
        for i in range(ORDER):
            key = (key << np.uint64(16)) | whole[i : n + i]
        return key

    def out() -> tuple[list[int], np.ndarray, np.ndarray]:
        starts = np.cumsum([0, *map(len, held[:-1])])
        return at[:], starts, np.concatenate(held)

    for i, text in enumerate(texts):
        own = symbols(text)
        if not len(own):
            continue
        own = own if own[-1] == SPACE else np.append(own, np.uint16(SPACE))
        own = np.concatenate([pad, own.astype(np.uint64)])
        for start in range(0, len(own) - ORDER + 1, CHUNK):
            at.append(i)
            held.append(grams(own[start : start + CHUNK + ORDER - 1]))
            size += len(held[-1])
            if size >= CHUNK:
                yield out()
                at.clear()
                held.clear()
                size = 0
    if held:
        yield out()


def hashed(keys: np.ndarray) -> np.ndarray:
    """A hash of packed n-grams that no two of them share: steps of XXH64's finish, each of which can be undone."""
    with np.errstate(over="ignore"):
        h = (keys ^ (keys >> np.uint64(33))) * np.uint64(0xC2B2AE3D27D4EB4F)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x165667B19E3779F9)
        return h ^ (h >> np.uint64(32))


def _count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, key, n) of the n-grams of (text, lang), summed within the task as far as memory is bounded."""
    held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def rows() -> Iterator[pa.RecordBatch]:
        for lang, (keys, counts) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys)), pa.array(keys.view(np.int64)), pa.array(counts)], names=["lang", "key", "n"])
        held.clear()

    for batch in batches:
        texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for lang in sorted(set(langs)):
            for _, _, keys in pieces([t for t, own in zip(texts, langs) if own == lang]):
                keys, counts = np.unique(keys, return_counts=True)
                if lang in held:
                    both, inverse = np.unique(np.concatenate([held[lang][0], keys]), return_inverse=True)
                    counts = np.bincount(inverse, np.concatenate([held[lang][1], counts])).astype(np.int64)
                    keys = both
                held[lang] = keys, counts
        if sum(len(k) for k, _ in held.values()) > 1_000_000:
            yield from rows()
    yield from rows()


@dataclass
class Model:
    """For each language: sorted hashes and log-probabilities by order, sorted hashes and log-weights of contexts, the log-probability of a new symbol."""

    languages: list[str]
    grams: dict[tuple[str, int], tuple[np.ndarray, np.ndarray]]
    contexts: dict[tuple[str, int], tuple[np.ndarray, np.ndarray]]
    unseen: dict[str, float]

    @staticmethod
    def _find(table: tuple[np.ndarray, np.ndarray] | None, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if table is None or not len(table[0]):
            return np.zeros(len(hashes), bool), np.zeros(len(hashes))
        at = np.minimum(np.searchsorted(table[0], hashes), len(table[0]) - 1)
        return table[0][at] == hashes, table[1][at]

    def log_probability(self, keys: np.ndarray) -> np.ndarray:
        """Of the last symbol of each packed n-gram after the others: a row per language."""
        out = np.zeros((len(self.languages), len(keys)))
        for k in range(1, ORDER + 1):
            own = keys & np.uint64((1 << 16 * k) - 1) if k < 4 else keys
            hashes, before = hashed(own), hashed(own >> np.uint64(16))
            for i, lang in enumerate(self.languages):
                hit, value = self._find(self.grams.get((lang, k)), hashes)
                if k == 1:
                    less = np.full(len(keys), self.unseen[lang])
                else:
                    known, weight = self._find(self.contexts.get((lang, k)), before)
                    less = out[i] + np.where(known, weight, 0.0)
                out[i] = np.where(hit, value, less)
        return out


def _packed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, k, context, key, value) as two strings of bytes for each language, order and kind of a batch."""
    for batch in batches:
        frame = batch.select(["lang", "k", "context"]).to_pandas()
        keys, values = hashed(batch.column(3).to_numpy().view(np.uint64)), batch.column(4).to_numpy().astype(np.float32)
        out: list[tuple] = [(*name, keys[rows].tobytes(), values[rows].tobytes()) for name, rows in frame.groupby(["lang", "k", "context"]).indices.items()]
        columns = [pa.array(x, t) for x, t in zip(zip(*out), (pa.string(), pa.int32(), pa.bool_(), pa.binary(), pa.binary()))] if out else []
        if columns:
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "k", "context", "keys", "values"])


def tables(texts: DataFrame) -> tuple[DataFrame, dict[str, float]]:
    """The models of the languages in `texts` (text, lang), from all its rows; null texts and languages count for nothing.

    Returns (lang, k, context, key, value), the log-probability of each n-gram of order k and the log-weight of each context, and the log-probability
    of a new symbol by language. Tasks count n-grams of the highest order; all else follows from these counts by grouping: the
    lower orders' continuation counts, the discounts and the back-off weights. Nothing is left out, however many there are.
    """
    known = texts.where("text is not null and lang is not null").select("text", F.col("lang").cast("string").alias("lang"))
    counted = known.mapInArrow(_count_rows, "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n"))
    by_order = {ORDER: cut(counted)}
    for k in range(ORDER - 1, 0, -1):
        suffix = F.col("key").bitwiseAND((1 << 16 * k) - 1)
        by_order[k] = cut(by_order[k + 1].groupBy("lang", suffix.alias("key")).agg(F.count("*").alias("n")))
    alphabet = cut(by_order[1].groupBy("lang").agg((F.count("*") + 1).alias("v")))
    # tables with a row for each language go to all tasks, unless there are very many of these
    few = F.broadcast if alphabet.count() <= 10_000 else lambda df: df

    lower, grams, contexts = None, [], []
    for k in range(1, ORDER + 1):
        ones, twos = F.sum((F.col("n") == 1).cast("double")), F.sum((F.col("n") == 2).cast("double"))
        discounts = by_order[k].groupBy("lang").agg(F.when(twos > 0, ones / (ones + 2 * twos)).otherwise(0.5).alias("_d")).withColumn("d", F.greatest("_d", F.lit(0.1))).drop("_d")
        rows = by_order[k].join(few(discounts), "lang").withColumn("context", F.shiftrightunsigned("key", 16) if k > 1 else F.lit(0).cast("long"))
        before = rows.groupBy("lang", "context").agg(F.sum("n").alias("total"), (F.first("d") * F.count("*") / F.sum("n")).alias("weight"))
        rows = rows.join(before, ["lang", "context"])
        if k == 1:
            rows = rows.join(few(alphabet), "lang").withColumn("below", 1.0 / F.col("v"))
            unseen = before.join(alphabet, "lang").select("lang", F.log(F.col("weight") / F.col("v")).alias("unseen"))
        else:
            rows = rows.withColumn("suffix", F.col("key").bitwiseAND((1 << 16 * (k - 1)) - 1)).join(lower, ["lang", "suffix"])
            contexts.append(before.select("lang", F.lit(k).alias("k"), F.lit(True).alias("context"), F.col("context").alias("key"), F.log("weight").alias("value")))
        p = F.greatest(F.col("n") - F.col("d"), F.lit(0.0)) / F.col("total") + F.col("weight") * F.col("below")
        rows = rows.select("lang", "key", p.alias("p"))
        if 1 < k < ORDER:
            rows = cut(rows)
        lower = rows.select("lang", F.col("key").alias("suffix"), F.col("p").alias("below"))
        grams.append(rows.select("lang", F.lit(k).alias("k"), F.lit(False).alias("context"), "key", F.log("p").alias("value")))
    return cut(reduce(DataFrame.unionByName, grams + contexts)), {r["lang"]: r["unseen"] for r in unseen.collect()}


def collected(entries: DataFrame, unseen: dict[str, float]) -> Model:
    """The whole model as sorted hash arrays, of as many entries as the caller has counted."""
    found: dict[bool, dict[tuple[str, int], tuple[np.ndarray, np.ndarray]]] = {False: {}, True: {}}
    held: dict[tuple, list[tuple[bytes, bytes]]] = {}
    for r in entries.mapInArrow(_packed_rows, "lang string, k int, context boolean, keys binary, values binary").collect():
        held.setdefault((r["context"], r["lang"], r["k"]), []).append((r["keys"], r["values"]))
    for (context, lang, k), packed in held.items():
        keys, values = (np.frombuffer(b"".join(map(bytes, x)), t) for x, t in zip(zip(*packed), (np.uint64, np.float32)))
        order = np.argsort(keys)
        found[context][lang, k] = keys[order], values[order]
    return Model(sorted(unseen), found[False], found[True], unseen)


def fit(texts: DataFrame) -> Model:
    """`tables` as one model, for texts whose model is known to be small."""
    return collected(*tables(texts))


def _entropy_rows(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        width = len(model.languages)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            total, length = np.zeros((width, len(texts))), np.zeros(len(texts))
            for at, starts, keys in pieces(texts):
                some, inverse = np.unique(keys, return_inverse=True)
                for i, values in enumerate(model.log_probability(some)):
                    np.add.at(total[i], at, np.add.reduceat(values[inverse], starts))
                np.add.at(length, at, np.diff(np.append(starts, len(keys))))
            mean = [(-total[:, i] / length[i]).tolist() if length[i] else None for i in range(len(texts))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(mean, pa.list_(pa.float64()))], names=["doc_id", "held_out", "lang", "entropy"])

    return run


def _gram_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row_key, doc_id, held_out, lang, keys, times): each text's distinct n-grams; a long text has several rows of one row_key."""
    from pyspark import TaskContext

    row = TaskContext.get().partitionId() << 33
    for batch in batches:
        texts = batch.column(1).to_pylist()
        seen, at, grams, times = set(), [], [], []
        for own, starts, keys in pieces(texts):
            for i, part in zip(own, np.split(keys, starts[1:])):
                some, n = np.unique(part, return_counts=True)
                at.append(i)
                grams.append(some.view(np.int64))
                times.append(n.astype(np.int64))
                seen.add(i)
        for i in range(len(texts)):
            if i not in seen:
                at.append(i)
                grams.append(np.zeros(0, np.int64))
                times.append(np.zeros(0, np.int64))
        ends = pa.array(np.cumsum([0, *map(len, grams)]), pa.int32())
        many = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate([*x, np.zeros(0, np.int64)]))) for x in (grams, times)]
        own = pa.array(at, pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([row + i for i in at], pa.int64()), *(batch.column(c).take(own) for c in (0, 2, 3)), *many], names=["row_key", "doc_id", "held_out", "lang", "keys", "times"])
        row += len(texts)


def joined_entropies(chosen: DataFrame, entries: DataFrame, unseen: dict[str, float]) -> DataFrame:
    """(doc_id, held_out, lang, entropy) for the rows of `chosen`, by joins with the whole tables: for models of any size.

    The distinct n-grams of all texts are looked up, from order 1 upwards, each order with its back-off to the one below; texts then meet the
    results by n-gram, and their sums are combined before they are shuffled. Only languages, not n-grams, are in the plan.
    """
    kind, names = chosen.schema["doc_id"].dataType.simpleString(), F.array(*[F.lit(x) for x in sorted(unseen)])
    rows = cut(chosen.select("doc_id", "text", "held_out", "lang").mapInArrow(_gram_rows, f"row_key long, doc_id {kind}, held_out boolean, lang string, keys array<long>, times array<long>"))
    own = rows.select("row_key", F.explode(F.arrays_zip("keys", "times")).alias("x")).select("row_key", F.col("x.keys").alias("key"), F.col("x.times").alias("times"))
    wanted = {ORDER: cut(own.select("key").distinct())}
    for k in range(ORDER - 1, 0, -1):
        wanted[k] = wanted[k + 1].select(F.col("key").bitwiseAND((1 << 16 * k) - 1).alias("key")).distinct()

    def by_key(k: int, context: bool, name: str) -> DataFrame:
        found = entries.where((F.col("k") == k) & (F.col("context") == context)).groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("lang", "value"))).alias("_m"))
        return found.select(F.col("key").alias(f"{name}_key"), F.transform(names, lambda x: F.try_element_at("_m", x)).alias(name))

    new = F.array(*[F.lit(unseen[x]) for x in sorted(unseen)])
    lower = None
    for k in range(1, ORDER + 1):
        met = wanted[k].join(by_key(k, False, "hit"), F.col("key") == F.col("hit_key"), "left")
        if k == 1:
            less = new
        else:
            met = met.join(by_key(k, True, "weight"), F.shiftrightunsigned("key", 16) == F.col("weight_key"), "left").join(lower, F.col("key").bitwiseAND((1 << 16 * (k - 1)) - 1) == F.col("lower_key"))
            less = F.when(F.col("weight").isNull(), F.col("less")).otherwise(F.zip_with("less", "weight", lambda a, w: a + F.coalesce(w, F.lit(0.0))))
        p = F.when(F.col("hit").isNull(), less).otherwise(F.zip_with(less, F.col("hit"), lambda a, h: F.coalesce(h, a)))
        lower = cut(met.select(F.col("key").alias("lower_key"), p.alias("less")))
    scored = own.join(lower, F.col("key") == F.col("lower_key"))
    sums = scored.groupBy("row_key").agg(F.sum("times").alias("n"), *[F.sum(F.col("times") * F.col("less")[i]).alias(f"p{i}") for i in range(len(unseen))])
    entropy = F.array(*[-F.col(f"p{i}") / F.col("n") for i in range(len(unseen))])
    texts = rows.groupBy("row_key").agg(F.first("doc_id").alias("doc_id"), F.first("held_out").alias("held_out"), F.first("lang").alias("lang"))
    return texts.join(sums.select("row_key", entropy.alias("entropy")), "row_key", "left").select("doc_id", "held_out", "lang", "entropy")


def identify(docs: DataFrame, train: Column | None = None, spread: float = 6.0, most_sent: int = MOST_SENT) -> DataFrame:
    """The language of each row of `docs` (doc_id, text, lang), from models of those rows' texts that `train` picks.

    Without `train`, those are the rows whose CRC-32 of doc_id, as text, isn't 2 modulo 4.
    Returns doc_id, held_out (that remainder is 2), lang_pred, score, cross_entropy and rejected.
    The language whose model has the lowest mean cross-entropy, in nats a symbol, is chosen; of equal ones the first.
    score is its share in a softmax of the negative cross-entropies, at the temperature that
    makes the training rows' own languages likeliest. rejected is true where the cross-entropy is more
    than `spread` standard deviations above the mean that training rows of that language have. Models of up to `most_sent` n-grams and
    contexts are sent to the tasks; larger ones are joined to. Both use every n-gram, and give the same labels.

    Null texts and texts without letters get `und`, score 0 and rejected; so does every row if nothing
    could be learned. A null doc_id is neither held out nor learned from; repeated rows count
    each; very long texts go through memory in pieces. Null languages aren't learned from. An empty table gives no rows; other columns don't matter.
    """
    spark = docs.sparkSession
    remainder = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    held_out = F.coalesce(remainder == 2, F.lit(False))
    train = F.coalesce(remainder != 2, F.lit(False)) if train is None else train
    entries, unseen = tables(docs.where(train).select("text", "lang"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    learned = F.when(train, F.col("lang").cast("string"))
    chosen = docs.select("doc_id", F.col("text"), held_out.alias("held_out"), learned.alias("lang"))
    none = docs.select("doc_id", held_out.alias("held_out"), F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("cross_entropy"), F.lit(True).alias("rejected"))
    if not unseen:
        return none
    if entries.count() <= most_sent:
        shared = spark.sparkContext.broadcast(collected(entries, unseen))
        rows = chosen.mapInArrow(_entropy_rows(shared), f"doc_id {kind}, held_out boolean, lang string, entropy array<double>")
    else:
        rows = joined_entropies(chosen, entries, unseen)
    rows = cut(rows)
    names = F.array(*[F.lit(x) for x in sorted(unseen)])
    least = F.array_min("entropy")
    rows = rows.withColumn("cross_entropy", least).withColumn("lang_pred", F.when(F.col("entropy").isNull(), "und").otherwise(F.element_at(names, F.array_position("entropy", least).cast("int"))))

    share = lambda t, own: F.exp(-t * (own - least)) / F.aggregate("entropy", F.lit(0.0), lambda a, x: a + F.exp(-t * (x - least)))
    own = F.element_at("entropy", F.array_position(names, F.col("lang")).cast("int"))
    fitted = rows.where("lang is not null and entropy is not null")
    losses = fitted.agg(*[F.avg(-F.log(F.greatest(share(t, own), F.lit(1e-12)))) for t in TEMPERATURES]).first()
    best = min(zip(losses, TEMPERATURES))[1] if losses[0] is not None else 1.0
    usual = fitted.groupBy("lang").agg((F.avg(own) + spread * F.coalesce(F.stddev_pop(own), F.lit(0.0)) + 1e-9).alias("limit")).withColumnRenamed("lang", "lang_pred")
    rows = rows.join(usual, "lang_pred", "left")
    return rows.select(
        "doc_id",
        "held_out",
        "lang_pred",
        F.coalesce(share(best, least), F.lit(0.0)).alias("score"),
        "cross_entropy",
        F.coalesce(F.col("cross_entropy") > F.col("limit"), F.lit(True)).alias("rejected"),
    )
