"""Helpers that several of the operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Words are runs of characters other than the six ASCII white-space characters.
WHITE = " \t\n\x0b\x0c\r"
WHITE_RUN = "[\\x20\\x09-\\x0D]+"
BLOCK_WORDS = 65_536


def shared_folder(spark: SparkSession) -> str:
    """The session's `spark.checkpoint.dir`. Where that is unset, a folder under /tmp if all runs on this machine (tests, a notebook); on a cluster that is an error."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = context.getConf().get("spark.checkpoint.dir")
        if not shared and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write `df` to the checkpoint folder and go on from there, without its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def drop_cut(df: DataFrame) -> None:
    """Delete the files of a `cut` table. Nothing may be computed from it, or from what it was used for and isn't cut itself, afterwards."""
    spark = df.sparkSession
    kept = df._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
    if kept.isDefined():
        path = spark._jvm.org.apache.hadoop.fs.Path(kept.get())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def rewritten(df: DataFrame) -> DataFrame:
    """`df` written as Parquet in the checkpoint folder, and read again."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4()}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Number of words, 0 for null."""
    trimmed = F.btrim(text, F.lit(WHITE))
    return F.when(F.length(trimmed) > 0, F.size(F.split(trimmed, WHITE_RUN))).otherwise(0).cast("long")


def uniform(*parts: Column | str) -> Column:
    """A number in (0, 1) that the parts alone decide: 52 bits of their MD5."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) if isinstance(p, Column) else F.lit(p) for p in parts])
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)


def join_nulls(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Equi-join on columns of the same names in which nulls match nulls; the left ones stay."""
    names = {c: f"_right_{i}" for i, c in enumerate(on)}
    right = right.withColumnsRenamed(names)
    return left.join(right, [F.col(c).eqNullSafe(F.col(r)) for c, r in names.items()], how).drop(*names.values())


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)`, with `value` computed once however often the body names it."""
    return F.transform(F.array(value), body)[0]


def identity(*columns: Column | str) -> Column:
    """128 bits that rows share which agree in all `columns`, nulls included; rows that don't, by chance never."""
    parts = [x for c in columns for x in (F.col(c).isNull(), F.col(c))] if all(isinstance(c, str) for c in columns) else [x for c in columns for x in (c.isNull(), c)]
    return F.struct(F.xxhash64(*parts).alias("a"), F.xxhash64(F.lit(1), *parts).alias("b"))


def fresh(df: DataFrame, name: str) -> str:
    """`name`, or what it takes to make it differ from all of `df`'s columns."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def repeated(df: DataFrame, times: str, index: str, piece: int = 10_000) -> DataFrame:
    """Each row `times` times (one at least), numbered from 0 in `index`.

    A row repeated more than `piece` times is dealt to many tasks. `df` is read twice: pass a cut table.
    """
    n = F.col(times)
    upto = lambda last: F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long")))
    few = df.where(n <= piece).withColumn(index, upto(n - 1))
    at = fresh(df, "_piece")
    many = df.where(n > piece).withColumn(at, upto(F.floor((n - 1) / piece)))
    many = many.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))).withColumn(index, upto(F.least(F.lit(piece), n - F.col(at) * piece) - 1))
    return few.unionByName(many.withColumn(index, F.col(index) + F.col(at) * piece).drop(at))


def numbered(df: DataFrame, keys: list[str], place: str) -> DataFrame:
    """The rows of `df`, numbered from 0 within `keys` in `place`, in the order of a hash of the whole row.

    Rows alike in all columns are counted before they are shuffled and stand for each other, so that
    neither they nor a key with very many rows have to pass through one task.
    """
    n, at, i = (fresh(df, c) for c in ("_alike", "_hash", "_copy"))
    position = F.shiftrightunsigned(F.xxhash64(*df.columns), 11) / float(2**53)
    alike = cut(df.groupBy(*df.columns).agg(F.count("*").alias(n)).withColumn(at, position))
    placed = cut(running_sum(alike, keys, at, [], n))
    out = repeated(placed, n, i)
    return out.select(*df.columns, (F.col("before") + F.col(i)).alias(place))


def running_sum(df: DataFrame, group: list[str], position: str, ties: list[str], value: str, rows_per_bucket: int = 200) -> DataFrame:
    """Adds `before`: the sum of `value` over the rows of the same group that come earlier.

    Rows are ordered by `position`, a double in [0, 1), then by `ties`. A group of n rows is cut into buckets
    of equal width in `position`, of about the square root of n rows but `rows_per_bucket` at least, so that a group with a third
    of all rows is summed by many tasks; only the bucket sums, no more than a bucket has rows, are brought in order.
    Nulls make a group of their own. `df` is read three times: pass a cut table.
    """
    counts = df.groupBy(*group).agg(F.greatest(F.lit(1), F.ceil(F.count("*") / F.greatest(F.lit(float(rows_per_bucket)), F.sqrt(F.count("*"))))).alias("_buckets"))
    bucket = F.least(F.floor(F.col(position) * F.col("_buckets")), F.col("_buckets") - 1)
    dealt = join_nulls(df, counts, group).withColumn("_bucket", bucket).drop("_buckets")
    sums = dealt.groupBy(*group, "_bucket").agg(F.sum(value).alias("_sum"))
    earlier = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select(*group, "_bucket", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_base"))
    within = Window.partitionBy(*group, "_bucket").orderBy(position, *[F.col(t).asc_nulls_last() for t in ties]).rowsBetween(Window.unboundedPreceding, -1)
    local = dealt.withColumn("_local", F.coalesce(F.sum(value).over(within), F.lit(0)))
    return join_nulls(local, bases, [*group, "_bucket"]).select(*df.columns, (F.col("_local") + F.col("_base")).alias("before"))


def word_blocks(text: str | None, keep: int) -> Iterator[list[bytes]]:
    """The words of a text with A-Z lower-cased, in blocks of bounded length.

    The last `keep` words of a block are repeated at the start of the next one, so that every run
    of `keep + 1` words lies in exactly one block.
    """
    rest = (text or "").encode("utf-8", "surrogatepass").lower()
    carried: list[bytes] = []
    while rest:
        words = rest.split(None, BLOCK_WORDS)
        rest = words.pop() if len(words) > BLOCK_WORDS else b""
        if words:
            block = carried + words
            yield block
            carried = block[-keep:] if keep else []


def shingles(words: list[bytes], n: int) -> Iterable[bytes]:
    return map(b" ".join, zip(*(words[i:] for i in range(n))))
