"""Quality classifier: document evidence shrunk together with host and path posteriors."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipwright.llm.common import cut, fresh, identity, join_nulls, uniform, word_blocks

#: Signs that prose seldom holds; fixed values.
SIGNS = b"#$%&*|!{}<>=~^@_\\"
SHAPE = ("log_words", "sign_share", "upper_share", "repeat_share", "log_distinct", "mean_length", "digit_share", "end_share")
#: Slots that words are hashed to.
WORD_SLOTS = 256
FEATURES = (*SHAPE, *[f"words_{i}" for i in range(WORD_SLOTS)])


def features(text: str | None) -> np.ndarray:
    """Shape and words of a text, in the order of FEATURES; all 0 for null and wordless texts.

    A word counts for the slot of its CRC-32; the slots' counts are scaled to length 1.
    """
    out = np.zeros(len(FEATURES))
    if not text or not text.strip():
        return out
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    words = repeats = 0
    distinct: list[np.ndarray] = []
    slots = np.zeros(WORD_SLOTS, np.int64)
    for block in word_blocks(text, 1):
        fresh_ones = len(block) - (words > 0)
        codes = np.fromiter(map(zlib.crc32, block), np.uint32, len(block))
        slots += np.bincount(codes[len(block) - fresh_ones :] % WORD_SLOTS, minlength=WORD_SLOTS)
        words += fresh_ones
        repeats += sum(map(bytes.__eq__, block, block[1:]))
        distinct.append(np.unique(codes))
    if not words:
        return out
    counts = np.bincount(raw, minlength=256)
    accented = (raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E)  # capitals of Latin-1 in UTF-8
    upper = counts[ord("A") : ord("Z") + 1].sum() + accented.sum()
    different = len(np.unique(np.concatenate(distinct)))
    out[: len(SHAPE)] = (
        math.log1p(words),
        counts[list(SIGNS)].sum() / words,
        upper / len(raw),
        repeats / words,
        math.log1p(different) / math.log1p(words),
        min(len(raw) / words, 40.0),
        counts[ord("0") : ord("9") + 1].sum() / len(raw),
        counts[list(b".?")].sum() / words,
    )
    out[len(SHAPE) :] = slots / math.sqrt(float((slots * slots).sum()))
    return out


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [features(t).astype(np.float32) for t in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.float32()))], names=["doc_id", "quality", "x"])


def _fit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row: weights and intercept for all rows (doc_id, quality, x) of the only partition."""
    x, y = [np.zeros((0, len(FEATURES)), np.float32)], [np.zeros(0)]
    for batch in batches:
        x.append(batch.column(2).flatten().to_numpy().reshape(-1, len(FEATURES)))
        y.append(batch.column(1).to_numpy())
    weights, intercept = fit_logistic(np.concatenate(x).astype(float), np.concatenate(y))
    yield pa.RecordBatch.from_arrays([pa.array([weights], pa.list_(pa.float64())), pa.array([intercept])], names=["weights", "intercept"])


def _score_rows(weights: np.ndarray, intercept: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = np.array([features(t) @ weights + intercept for t in batch.column(4).to_pylist()], float)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))))], names=["row_key", "doc_id", "host", "path", "p_doc"])

    return run


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> tuple[np.ndarray, float]:
    """Weights and intercept of a ridge logistic regression, by Newton steps; zeros without two classes."""
    if len(y) == 0 or y.min() == y.max():
        return np.zeros(x.shape[1] if x.ndim == 2 else len(FEATURES)), 0.0
    mean, scale = x.mean(0), x.std(0)
    scale[scale < 1e-9] = 1.0
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    penalty = np.full(z.shape[1], ridge * len(y) ** 0.5)
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty + 1e-9), z.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    weights = w[:-1] / scale
    return weights, float(w[-1] - weights @ mean)


#: Sites of up to so many paths go to all tasks; above, each path goes to so many tasks.
MOST_SENT, SALTS = 100_000, 16


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(p / (1 - p))


def _strength(groups: DataFrame, prior: Column, mu: float) -> float:
    """Rows' worth of the prior, by the method of moments: how little groups differ beyond what their size explains."""
    rate = F.col("s") / F.col("n")
    spread, chance = groups.where("n > 1").agg(F.avg((rate - prior) ** 2), F.avg(F.col("v") / F.col("n"))).first()
    if spread is None:
        return 1.0
    between = max(spread - chance, 1e-6)
    return float(min(max(mu * (1 - mu) / between - 1, 1.0), 1e6))


def _key(host: Column | str, path: Column | str) -> Column:
    return identity(F.col("text"), *[F.col(c) if isinstance(c, str) else c for c in (host, path)])


def _at_sites(scored: DataFrame, paths: DataFrame) -> DataFrame:
    """Rows with the sums of their host and path, nulls meeting nulls. Up to MOST_SENT paths are sent to the rows; of more, each is dealt to SALTS tasks, so that none with very many rows is a single task."""
    if paths.count() <= MOST_SENT:
        return join_nulls(scored, F.broadcast(paths), ["host", "path"])
    salted = scored.withColumn("_salt", F.pmod(F.xxhash64("row_key", "p_doc"), F.lit(SALTS)).cast("int"))
    dealt = paths.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return join_nulls(salted, dealt, ["host", "path", "_salt"]).drop("_salt")


def score_quality(
    docs: DataFrame,
    labels: DataFrame,
    host: Column | str = "source",
    path: Column | str = "lang",
    threshold: float = 0.5,
    max_labelled: int = 10_000,
) -> DataFrame:
    """Probability that each row of `docs` (doc_id, text and what `host` and `path` need) is of good quality.

    Returns doc_id, p_doc, host_posterior, path_posterior, p, keep (p >= threshold) and row_key, which
    rows share that agree in text, host and path. `labels` has doc_id and quality (0 or 1; null ones are left out).
    A logistic regression over the text's shape and its words is fitted to the labelled rows, or as many as a hash of
    doc_id picks of them with an expected number of `max_labelled`, in one task; only its weights reach the driver. All rows'
    p_doc are then summed by host and by path within host. Without the row itself, a host's rate is
    drawn to the overall rate and a path's to its host's, by strengths estimated from how much hosts
    and paths differ; a sparse site so has the rate above it, and a row's own evidence counts once. The row's log-odds
    are those of its text plus what its path says beyond the overall rate.

    Null hosts and paths are sites like any other. Null and wordless texts have features of 0; very long ones are read in one row, and their words in one pass.
    Rows that repeat a doc_id are scored each; of a labelled id with several texts the one with the smallest hash is
    learned from. Without labels of both kinds p_doc is 0.5 and all rows are kept, and so is the overall rate for the only
    row of a table; an empty table gives no rows. Other columns don't matter.
    """
    column = lambda c: F.col(c) if isinstance(c, str) else c
    kind = docs.schema["doc_id"].dataType.simpleString()

    known = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max("quality").cast("double").alias("quality"))
    share = max_labelled / max(1, known.count())
    sample = docs.select("doc_id", "text").join(known.where(uniform("label", F.col("doc_id")) < share), "doc_id")
    one = F.min_by("text", F.struct(F.xxhash64("text"), F.length("text")))
    sample = sample.groupBy("doc_id").agg(F.first("quality").alias("quality"), one.alias("text"))
    sample = sample.mapInArrow(_feature_rows, f"doc_id {kind}, quality double, x array<float>")
    fitted = sample.repartition(1).sortWithinPartitions("doc_id").mapInArrow(_fit_rows, "weights array<double>, intercept double").first()
    weights, intercept = (np.array(fitted["weights"]), fitted["intercept"]) if fitted else (np.zeros(len(FEATURES)), 0.0)

    rows = docs.select(_key(host, path).alias("row_key"), "doc_id", column(host).cast("string").alias("host"), column(path).cast("string").alias("path"), "text")
    scored = cut(rows.mapInArrow(_score_rows(weights, intercept), f"row_key struct<a:bigint,b:bigint>, doc_id {kind}, host string, path string, p_doc double"))
    spread = F.coalesce(F.var_pop("p_doc"), F.lit(0.0)).alias("v")
    paths = cut(scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p_doc").alias("s"), spread))
    hosts = scored.groupBy("host").agg(F.count("*").alias("n"), F.sum("p_doc").alias("s"), spread)
    total, summed = paths.agg(F.sum("n"), F.sum("s")).first()
    total, summed = total or 0, summed or 0.0
    mu = summed / total if total else 0.5
    strong = _strength(hosts, F.lit(mu), mu)
    hosts = hosts.select("host", F.col("n").alias("host_n"), F.col("s").alias("host_s"))
    paths = join_nulls(paths, hosts, ["host"])
    fine = _strength(paths, (F.col("host_s") + strong * mu) / (F.col("host_n") + strong), mu)

    own = F.col("p_doc")
    rest = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.lit(summed) - own) / (total - 1))) if total > 1 else F.lit(0.5)
    joined = _at_sites(scored, paths.drop("v"))
    joined = joined.withColumn("host_posterior", (F.col("host_s") - own + strong * rest) / (F.col("host_n") - 1 + strong))
    joined = joined.withColumn("path_posterior", (F.col("s") - own + fine * F.col("host_posterior")) / (F.col("n") - 1 + fine))
    odds = _logit(own) + _logit(F.col("path_posterior")) - _logit(rest)
    joined = joined.withColumn("p", 1 / (1 + F.exp(-odds)))
    return joined.select("doc_id", "p_doc", "host_posterior", "path_posterior", "p", (F.col("p") >= threshold).alias("keep"), "row_key")


def keep_good(docs: DataFrame, scores: DataFrame, host: Column | str = "source", path: Column | str = "lang") -> DataFrame:
    """The rows of `docs` that aren't rejected in `scores` (row_key, keep), which `score_quality` made with the same `host` and `path`.

    Each row goes by its own text, host and path, so ids may be null or repeated; columns are those of `docs`.
    """
    key = fresh(docs, "_key")
    gone = scores.where("not keep").select(F.col("row_key").alias(key)).distinct()
    return docs.withColumn(key, _key(host, path)).join(gone, key, "left_anti").select(*docs.columns)
