"""Repair of conversations whose turns don't follow each other as they should, by weighted CYK over spans of rows.

The turns of a repaired conversation read `(s?(ua)+)?` by the initials of their roles. The grammar, in
Chomsky normal form, derives that pattern between two of its places: `P[p, q] -> P[p, r] P[r, q]` for all places
p, r, q, and a terminal rule for each edit of a row. A cell of a span holds, for each `P[p, q]`, the
least (cost, audit). Whatever a span derives, each split of it lies between two places, so every split
finds the least of all derivations, and cells are combined bottom-up by span length: 1, 2, 4, and so on.
Of two audits of a span that cost the same neither begins the other (the longer one would
have more insertions, and cost more), so that least audits of parts join to the least audit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import islice, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DataType, StructField, StructType

from clipwright.llm.common import identity, join_nulls, rewritten

#: Places in the pattern: nothing yet; behind s; behind u; behind a.
START, SAID, ASKED, ANSWERED = range(4)
STEPS = {"s": {START: SAID}, "u": {START: ASKED, SAID: ASKED, ANSWERED: ASKED}, "a": {ASKED: ANSWERED}}
ROLES = {"u": "user", "a": "assistant"}
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
GOOD, BLANK, DUPLICATE, CUT_OFF = "good", "blank", "duplicate", "truncated"
LEGAL = {"su", "ua", "au"}
COUNTS = (GOOD, BLANK, DUPLICATE, CUT_OFF, "illegal", "distinct")
#: Rows of a conversation that are parsed together in a task.
CHUNK = 1024

Cell = dict[tuple[int, int], tuple[int, str]]


def combined(left: Cell, right: Cell) -> Cell:
    """The cell of two spans that follow each other."""
    out: Cell = {}
    for (p, r), (cost, audit) in left.items():
        for (r2, q), (more, rest) in right.items():
            if r == r2 and ((p, q) not in out or (cost + more, audit + rest) < out[p, q]):
                out[p, q] = cost + more, audit + rest
    return out


@lru_cache(1)
def inserted() -> Cell:
    """The cell of an empty span: what insertions alone derive, closed under one more of them."""
    cell: Cell = {(p, p): (0, "") for p in range(4)}
    one: Cell = {(p, q): (INSERT, "I") for x in ROLES for p, q in STEPS[x].items()}
    while True:
        more = dict(cell)
        for rule, found in combined(cell, one).items():
            more[rule] = min(found, more.get(rule, found))
        if more == cell:
            return cell
        cell = more


@lru_cache(4096)
def leaf(initial: str, fault: str) -> Cell:
    """The cell of one row."""
    cell: Cell = {(p, p): (DELETE, "D") for p in range(4)}
    if fault not in (BLANK, DUPLICATE):
        extra = TRUNCATED if fault == CUT_OFF else 0
        options = [(p, q, REROLE, "R") for x in ROLES for p, q in STEPS[x].items()] + [(p, q, KEEP, "K") for p, q in STEPS.get(initial, {}).items()]
        for p, q, cost, letter in options:
            cell[p, q] = min((cost + extra, letter), cell.get((p, q), (1 << 60, "")))
    return combined(combined(inserted(), cell), inserted())


def span_cell(cells: list[Cell]) -> Cell:
    """The cell of the whole span from those of its parts in order, by rising span length."""
    if not cells:
        return inserted()
    while len(cells) > 1:
        pairs = [combined(a, b) for a, b in zip(cells[::2], cells[1::2], strict=False)]
        cells = pairs + cells[len(pairs) * 2 :]
    return cells[0]


def cheapest(cell: Cell) -> tuple[int, str]:
    """(cost, audit) of the whole conversation: from the beginning to a place where it may end."""
    return min(cell[START, q] for q in (START, ANSWERED) if (START, q) in cell)


def parse(rows: Iterable[tuple[str, str]]) -> tuple[int, str]:
    """(cost, audit) for the (role initial, fault) of a conversation's rows in order."""
    return cheapest(span_cell([leaf(*row) for row in rows]))


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text): the rows with known damage, for trials.

    crc32 of `conv_id:turn` modulo 20 decides: 0 drops the row, 1 empties its text, 2 takes `.`, `!` and `?` out of it, 3
    repeats it, 4 makes it the user's. A null role or text is one space, and so is a null id or turn in the sum; ids and turns stay null.
    """
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", name("conv_id"), name("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(name("text"), "[.!?]", "")).otherwise(name("text"))
    kept = rows.where(kind != 0)
    role = F.when(kind == 4, "user").otherwise(name("role"))
    copies = F.when(kind == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return kept.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("_copy")).drop("_copy")


def _mark(text: Column) -> Column:
    """The last character of a text that isn't one of the six ASCII white-space characters; empty if there is none."""
    return F.substring(F.rtrim(text, F.lit(" \t\n\x0b\x0c\r")), -1, 1)


def marked(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, initial, row_key, copies, fault): the distinct rows, without their texts.

    Rows of a conversation that agree in turn, role and text are counted, not kept apart: from the second copy on they are
    blank or duplicates. `fault` is of the first copy. A row is a duplicate if an earlier turn has its role and text
    (nulls come before all turns): the least turn of each role and text is joined by a 128-bit hash.
    """
    said = identity("conv_id", "role", "text")
    narrow = rows.select("conv_id", "turn", F.substring("role", 1, 1).alias("initial"), F.col("role"), identity("conv_id", "turn", "role", "text").alias("row_key"), said.alias("said"), _mark(F.col("text")).alias("mark"))
    counted = narrow.groupBy("conv_id", "turn", "initial", "role", "row_key", "said", "mark").agg(F.count("*").alias("copies"))
    place = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn"))
    first = counted.groupBy("said").agg(F.min(place).alias("first"))
    met = counted.join(first, "said")
    fault = F.when(F.col("mark") == "", BLANK).when(place > F.col("first"), DUPLICATE).when(~F.col("mark").isin(".", "!", "?"), CUT_OFF).otherwise(GOOD)
    return met.select("conv_id", "turn", "initial", "role", "row_key", "copies", fault.alias("fault"))


def deleted(n: int) -> Cell:
    """The cell of `n` rows that have to go."""
    return combined(combined(inserted(), {(p, p): (DELETE * n, "D" * n) for p in range(4)}), inserted())


def runs(batches: Iterator[pa.RecordBatch], key: str, most: int | None = None) -> Iterator[list[dict]]:
    """The rows of sorted batches in runs of one `key`, cut after `most` rows."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and (row[key] != held[0][key] or len(held) == most):
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def batched(rows: Iterable[dict], schema: pa.Schema, size: int = 256) -> Iterator[pa.RecordBatch]:
    rows = iter(rows)
    while some := list(islice(rows, size)):
        yield pa.RecordBatch.from_pylist(some, schema=schema)


def _kinds(conv_id: DataType, more: str) -> tuple[StructType, pa.Schema]:
    schema = StructType([StructField("conv_id", conv_id), *StructType.fromDDL(more)])
    return schema, to_arrow_schema(schema)


def chunks(marks: DataFrame) -> DataFrame:
    """(conv_id, slice, chunk, keys, copies, p, q, cost, audit, counts and ends): runs of up to `CHUNK` rows of a conversation in order, and their cells.

    Rows are ordered over all conversations by ranges of (conv_id, turn, role, row_key), nulls first, so that a
    conversation with any share of all rows is many slices. Rows of one turn go by role, then by a hash of their texts.
    """
    order = ["conv_id", "turn", "role", "row_key"]
    parts = int(marks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = marks.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("slice", F.spark_partition_id().cast("long"))
    schema, arrow = _kinds(marks.schema["conv_id"].dataType, f"slice long, chunk long, keys array<struct<a: long, b: long>>, copies array<long>, p array<int>, q array<int>, cost array<long>, audit array<string>, {', '.join(f'{c} long' for c in COUNTS)}, first string, last string, least long, most long")

    def parsed(held: list[dict], chunk: int) -> dict:
        cells, counts = [], dict.fromkeys(COUNTS, 0)
        turns = [r["turn"] for r in held if r["turn"] is not None]
        for i, r in enumerate(held):
            again = r["copies"] - 1
            cells.append(leaf(r["initial"], r["fault"]))
            if again:
                cells.append(deleted(again))
                counts[BLANK if r["fault"] == BLANK else DUPLICATE] += again
            counts[r["fault"]] += 1
            counts["illegal"] += again * (2 * r["initial"] not in LEGAL) + (i > 0 and held[i - 1]["initial"] + r["initial"] not in LEGAL)
        cell = span_cell(cells)
        return counts | {
            "conv_id": held[0]["conv_id"], "slice": held[0]["slice"], "chunk": chunk, "keys": [r["row_key"] for r in held], "copies": [r["copies"] for r in held],
            "p": [p for p, _ in cell], "q": [q for _, q in cell], "cost": [c for c, _ in cell.values()], "audit": [x for _, x in cell.values()],
            "distinct": len(set(turns)), "first": held[0]["initial"], "last": held[-1]["initial"], "least": min(turns, default=None), "most": max(turns, default=None),
        }

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batched((parsed(held, i) for i, held in enumerate(runs(batches, "conv_id", CHUNK))), arrow)

    return dealt.select("conv_id", "slice", "turn", "initial", "row_key", "copies", "fault").mapInArrow(rows, schema)


def conversations(chunked: DataFrame) -> DataFrame:
    """(conv_id, blank, duplicate, truncated, illegal, gaps, cost, audit, parts): the cheapest repair of each conversation.

    The cells of a conversation's chunks are combined in one task, as its audit is one value; the rows themselves don't come
    there. `parts` has, for each chunk, its stretch of the audit and how many turns the repair has before it.
    """
    schema, arrow = _kinds(chunked.schema["conv_id"].dataType, "blank long, duplicate long, truncated long, illegal long, gaps long, cost long, audit string, parts array<struct<slice: long, chunk: long, audit: string, before: long, turns: long>>")

    def repaired(held: list[dict]) -> dict:
        cost, audit = cheapest(span_cell([{(p, q): (c, x) for p, q, c, x in zip(h["p"], h["q"], h["cost"], h["audit"], strict=True)} for h in held]))
        sums = {c: sum(h[c] for h in held) for c in COUNTS}
        illegal, distinct = sums["illegal"], sums["distinct"]
        for a, b in pairwise(held):
            illegal += a["last"] + b["first"] not in LEGAL
            distinct -= a["most"] is not None and a["most"] == b["least"]
        least, most = min((h["least"] for h in held if h["least"] is not None), default=None), max((h["most"] for h in held if h["most"] is not None), default=None)
        letters = np.frombuffer(audit.encode(), np.uint8)
        of_rows = np.flatnonzero(letters != ord("I"))
        ends = np.append(of_rows[np.cumsum([sum(h["copies"]) for h in held])[:-1] - 1] + 1, len(audit)).tolist()
        turns, parts, start, before = len(audit) - audit.count("D"), [], 0, 0
        for h, end in zip(held, ends, strict=True):
            parts.append({"slice": h["slice"], "chunk": h["chunk"], "audit": audit[start:end], "before": before, "turns": turns})
            start, before = end, before + end - start - audit.count("D", start, end)
        return {"conv_id": held[0]["conv_id"], "blank": sums[BLANK], "duplicate": sums[DUPLICATE], "truncated": sums[CUT_OFF], "illegal": illegal, "gaps": 0 if least is None else most - least + 1 - distinct, "cost": cost, "audit": audit, "parts": parts}

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batched(map(repaired, runs(batches, "conv_id")), arrow)

    ordered = chunked.drop("keys").repartition("conv_id").sortWithinPartitions("conv_id", "slice", "chunk")
    return ordered.mapInArrow(rows, schema)


def edits(chunked: DataFrame, found: DataFrame) -> DataFrame:
    """(conv_id, place, edit, row_key, role): a row for each letter of each audit but D, in the order of `place`.

    Of a kept row `role` is null, of a changed or inserted one it is the new role; an inserted one has no row_key. An
    odd number of turns begins with s; otherwise roles follow from their place.
    """
    schema, arrow = _kinds(chunked.schema["conv_id"].dataType, "place long, edit string, row_key struct<a: long, b: long>, role string")
    parts = found.select(F.explode("parts").alias("x")).select("x.*").withColumnRenamed("audit", "letters")

    def turns(chunk: dict) -> Iterator[dict]:
        keys = (key for key, n in zip(chunk["keys"], chunk["copies"], strict=True) for _ in range(n))
        place = chunk["before"]
        for letter in chunk["letters"]:
            key = None if letter == "I" else next(keys)
            if letter != "D":
                role = ROLES["ua"[(place - chunk["turns"] % 2) % 2]]
                yield {"conv_id": chunk["conv_id"], "place": place, "edit": letter, "row_key": key, "role": None if letter == "K" else role}
                place += 1

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batched((turn for batch in batches for chunk in batch.to_pylist() for turn in turns(chunk)), arrow, 4096)

    return chunked.select("conv_id", "slice", "chunk", "keys", "copies").join(parts, ["slice", "chunk"]).select("conv_id", "keys", "copies", "letters", "before", "turns").mapInArrow(rows, schema)


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The cheapest repair of all conversations of `rows` (conv_id, turn, role, text): what was found of each, and its turns.

    The first table has conv_id, gaps, blank, duplicate, truncated, illegal, cost and audit; the second conv_id, place (from 0), edit, role and
    text. A conversation without rows is in neither; one that loses all its rows isn't in the second. Null roles and texts
    count as one space, null turns come first, a null conv_id is a conversation like any other; repeated rows stand next to each other,
    and all but one are duplicates. Other columns are not read. Texts are read twice, to find faults and to
    write the turns; everything between goes by keys.
    """
    filled = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), *[F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")])
    chunked = rewritten(chunks(marked(filled)))
    found = rewritten(conversations(chunked))
    changes = edits(chunked, found)
    texts = filled.select(identity("conv_id", "turn", "role", "text").alias("row_key"), F.col("role").alias("own"), "text").dropDuplicates(["row_key"])
    kept = changes.where("edit <> 'I'").join(texts, "row_key").select("conv_id", "place", "edit", F.coalesce("role", "own").alias("role"), "text")
    new = changes.where("edit = 'I'").select("conv_id", "place", "edit", "role", F.lit("").alias("text"))
    return found.drop("parts"), kept.unionByName(new)


def text_digests(turns: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of the turns as `role:text`, joined by newlines, read in order without holding a conversation.

    One conversation is one task here, however long, as SHA-256 has to read it in order.
    """
    schema, arrow = _kinds(turns.schema["conv_id"].dataType, "repaired_sha256 string")

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        now, sha, some = None, None, False
        for batch in batches:
            for conv_id, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if some and conv_id == now:
                    sha.update(b"\n")
                else:
                    if some:
                        yield {"conv_id": now, "repaired_sha256": sha.hexdigest()}
                    now, sha, some = conv_id, hashlib.sha256(), True
                sha.update(line.encode())
        if some:
            yield {"conv_id": now, "repaired_sha256": sha.hexdigest()}

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batched(digests(batches), arrow)

    lines = turns.select("conv_id", "place", F.concat("role", F.lit(":"), "text").alias("line"))
    return lines.repartition("conv_id").sortWithinPartitions("conv_id", "place").select("conv_id", "line").mapInArrow(rows, schema)


def repair_trial(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256): damage to every conversation, and its repair."""
    found, turns = repair(damaged(rows))
    out = join_nulls(join_nulls(rows.select("conv_id").distinct(), found, ["conv_id"], "left"), text_digests(turns), ["conv_id"], "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
