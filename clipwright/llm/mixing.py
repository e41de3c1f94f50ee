"""Mixing sources to target weights by Efraimidis-Spirakis sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clipwright.llm.common import cut, fresh, identity, join_nulls, numbered, repeated, running_sum, uniform, word_count

#: Signs that prose seldom holds.
SIGNS = "#$%&*|!{}<>=~^"


def prose_weight(text: Column) -> Column:
    """A document's quality weight, from 1 for plain prose down to 1/21 for signs alone; 1 for null or empty text."""
    n = F.length(text)
    signs = n - F.length(F.translate(text, SIGNS, ""))
    return F.coalesce(F.when(n > 0, 1.0 / (1.0 + 20.0 * signs / n)), F.lit(1.0))


def row_key() -> Column:
    """What rows share that agree in doc_id, text and source."""
    return identity("doc_id", "text", "source")


def source_targets(sizes: DataFrame, shares: Sequence[float] = (5, 2, 1), max_epochs: int = 3) -> DataFrame:
    """Targets of all sources, from a row per source (source, source_size).

    Sources in code-point order, null last, get `shares` in turn and divide the sum of all sizes.
    A target stops at `max_epochs` times its source's size; what is left over goes to the others
    by their shares until none is above. The level at which that happens is found from running
    sums over the sources in the order in which they reach their limits.
    Without words all targets are 0. Adds target, double.
    """
    ranked = sizes.withColumn("_rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    share = F.element_at(F.array(*[F.lit(float(s)) for s in shares]), (F.col("_rank") - 1) % len(shares) + 1)
    ranked = ranked.select("source", "source_size", share.alias("_share"), (F.col("source_size") * float(max_epochs)).alias("_cap"))
    ranked = ranked.withColumn("_full", F.col("_cap") / F.col("_share"))
    earlier = Window.orderBy("_full", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy("_full", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum(F.col("source_size").cast("double")).over(every) - F.coalesce(F.sum("_cap").over(earlier), F.lit(0.0))
    weight = F.sum("_share").over(every) - F.coalesce(F.sum("_share").over(earlier), F.lit(0.0))
    ranked = ranked.withColumn("_level", left / weight)
    level = F.max(F.when(F.col("_level") <= F.col("_full"), F.col("_level"))).over(every)
    ranked = ranked.withColumn("_even", level * F.col("_share"))
    return ranked.select("source", "source_size", F.when(F.col("_cap") <= F.col("_even"), F.col("_cap")).otherwise(F.col("_even")).alias("target"))


def _that_fit(budget: Column, before: Column, size: Column, copies: Column) -> Column:
    """How many of a row's copies, one behind the other from `before` on, have at least half of themselves within the budget."""
    most = F.floor((budget - before) / size - 0.5) + 1
    return F.least(F.greatest(most, F.lit(0)), copies).cast("long")


def _fill_up(behind: DataFrame) -> DataFrame:
    """What is taken of each size class: (source, _class, _upto), from rows (source, _left, _class, before, size, copies).

    Classes come from large to small, each row in its order within the class; a class ends with the first
    row that doesn't fit into what the classes before have left. Rows that can't fit into the whole
    of `_left` aren't looked at, so a source has as many here as that has words at most, which is less
    than half of its longest document.
    """
    row = F.struct((-F.col("_class")).alias("c"), "before", "size", "copies")
    rows = behind.where(F.col("before") + F.col("size") / 2.0 <= F.col("_left")).groupBy("source", "_left").agg(F.array_sort(F.collect_list(row)).alias("_rows"))

    def step(s: Column, r: Column) -> Column:
        new = r["c"] != s["c"]
        base = F.when(new, s["left"]).otherwise(s["base"])
        open_ = new | s["open"]
        taken = _that_fit(base, r["before"], r["size"], r["copies"])
        upto = r["before"] + taken * r["size"]
        return F.struct(
            r["c"].alias("c"),
            base.alias("base"),
            F.when(open_, base - upto).otherwise(s["left"]).alias("left"),
            (open_ & (taken == r["copies"])).alias("open"),
            F.when(open_, upto).otherwise(s["upto"]).alias("upto"),
            F.when(new, F.array_append(s["done"], F.struct(s["c"].alias("c"), s["upto"].alias("upto")))).otherwise(s["done"]).alias("done"),
        )

    done = F.array().cast("array<struct<c:int,upto:bigint>>")
    start = F.struct(F.lit(1).alias("c"), F.col("_left").alias("base"), F.col("_left").alias("left"), F.lit(True).alias("open"), F.lit(0).cast("long").alias("upto"), done.alias("done"))
    ended = F.aggregate("_rows", start, step, lambda s: F.array_append(s["done"], F.struct(s["c"].alias("c"), s["upto"].alias("upto"))))
    return rows.select("source", F.explode(ended).alias("_e")).select("source", (-F.col("_e.c")).alias("_class"), F.col("_e.upto").alias("_upto"))


def _drawn(docs: DataFrame, shares: Sequence[float], max_epochs: int, weight: Column | None, seed: str) -> DataFrame:
    """What `mix_sources` takes, with a row for all copies of a document: adds copies, and _taken, how many of them are drawn once more."""
    weight = prose_weight(F.col("text")) if weight is None else weight
    rows = docs.select(
        F.col("doc_id"),
        F.col("source"),
        word_count(F.col("text")).alias("size"),
        (-F.log(uniform(seed, F.col("doc_id"), F.md5("text"))) / weight).alias("_key"),
        row_key().alias("row_key"),
    ).withColumn("_at", F.col("_key") / (1.0 + F.col("_key")))
    rows = rows.groupBy("doc_id", "source", "size", "_at", "row_key").agg(F.count("*").alias("copies"))
    rows = cut(rows.withColumn("_mass", F.col("size") * F.col("copies")))
    targets = source_targets(rows.groupBy("source").agg(F.sum("_mass").alias("source_size")), shares, max_epochs)
    placed = join_nulls(running_sum(rows, ["source"], "_at", ["doc_id", "row_key"], "_mass"), targets, ["source"])
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    placed = placed.withColumn("epochs", epochs).withColumn("_rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    fit = F.when(F.col("size") > 0, _that_fit(F.col("_rest"), F.col("before"), F.col("size"), F.col("copies"))).otherwise(0)
    placed = cut(placed.withColumn("_fit", fit))

    first = F.min(F.when((F.col("size") > 0) & (F.col("_fit") < F.col("copies")), F.struct("before", (F.col("_rest") - F.col("before") - F.col("_fit") * F.col("size")).alias("left"))))
    stops = placed.groupBy("source").agg(first.alias("_stop"))
    marked = join_nulls(placed, stops.select("source", F.col("_stop.before").alias("_at_stop"), F.col("_stop.left").alias("_left")), ["source"])
    taken = F.when(F.col("_at_stop").isNull() | (F.col("before") <= F.col("_at_stop")), F.col("_fit")).otherwise(0)
    marked = marked.withColumn("_taken", taken)
    columns = [*docs.select("doc_id").columns, "source", "size", "source_size", "target", "epochs", "row_key", "copies", "_taken"]
    smaller = (F.col("size") > 0) & (F.col("before") > F.col("_at_stop")) & (F.col("size") <= F.col("_left") * 2)
    behind = cut(marked.where(smaller).drop("before").withColumn("_class", F.length(F.bin("size"))))
    behind = running_sum(behind, ["source", "_class"], "_at", ["doc_id", "row_key"], "_mass")
    filled = join_nulls(behind, _fill_up(behind), ["source", "_class"], "left")
    more = F.coalesce(F.least(F.greatest(F.floor((F.col("_upto") - F.col("before")) / F.col("size")), F.lit(0)), F.col("copies")), F.lit(0))
    filled = filled.withColumn("_taken", more.cast("long"))
    rest = marked.where(~F.coalesce(smaller, F.lit(False)))
    return cut(rest.select(*columns).unionAll(filled.select(*columns)))


def mix_sources(
    docs: DataFrame,
    shares: Sequence[float] = (5, 2, 1),
    max_epochs: int = 3,
    weight: Column | None = None,
    seed: str = "mix",
) -> DataFrame:
    """How often a mix takes each document: one row per row of `docs` (doc_id, text, source).

    Returns doc_id, size (words), source_size, target, epochs, picked, taken and row_key, which rows
    share that agree in doc_id, text and source. Every document of a source is taken whole `epochs` times;
    for what remains of the target, documents are drawn without replacement by exponential keys
    -ln(u) / weight, smallest first, up to the first of which less than half fits. What then is left goes
    to documents behind that one: by class of size (powers of two) from large to small, in each class in the
    order of the keys, up to the first of which less than half fits. So a source ends within half of its longest
    document of the target, and no document is left over that is smaller than the gap.
    u comes from doc_id, text and `seed`, so reruns agree.

    `weight` is an expression over the columns of `docs`, above 0 (default: `prose_weight`).
    A null text or one without words has size 0 and takes 0; null sources form one source, last in
    order; rows that repeat a doc_id count each. Columns beyond the three don't matter. An empty table gives no rows.

    Only numbers are shuffled. Rows alike in all that counts are one row with a number until the end, a
    source with a third of all rows is sorted in many buckets, and the window over all sources sees one
    row per source.
    """
    every = repeated(_drawn(docs, shares, max_epochs, weight, seed), "copies", "_copy")
    every = every.withColumn("picked", F.col("_copy") < F.col("_taken"))
    taken = F.col("size") * (F.col("epochs") + F.col("picked").cast("long"))
    return every.select("doc_id", "size", "source_size", "target", "epochs", "picked", taken.alias("taken"), "row_key")


def apply_mix(docs: DataFrame, mix: DataFrame) -> DataFrame:
    """The rows of `docs`, each as often as `mix` takes it.

    Rows are found by doc_id, text and source, any of which may be null. Of rows alike in these three, as many are
    taken as the mix takes of them together, spread evenly; where that leaves a remainder, a hash of the
    whole row decides which of them is taken once more. Documents without words, which no budget
    counts, stay as they are in every complete epoch. Columns are those of `docs`.
    """
    key, total, rows, place, copy = (fresh(docs, c) for c in ("_key", "_total", "_rows", "_place", "_nth"))
    times = mix.groupBy(F.col("row_key").alias(key)).agg(F.sum(F.col("epochs") + F.col("picked").cast("long")).alias(total), F.count("*").alias(rows))
    joined = docs.withColumn(key, row_key()).join(times.where(F.col(total) > 0), key)
    each = F.floor(F.col(total) / F.col(rows))
    even = joined.where(F.col(total) % F.col(rows) == 0).withColumn(place, each)
    # a budget ends between rows that are alike: at most once in each source and class of size
    uneven = numbered(joined.where(F.col(total) % F.col(rows) != 0), [key], place)
    uneven = uneven.withColumn(place, each + (F.col(place) < F.col(total) - each * F.col(rows)).cast("long"))
    taken = even.unionByName(uneven).where(F.col(place) > 0)
    return taken.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(place).cast("int")))).select(*docs.columns)
