"""Conversation repair against an exhaustive parser, and the query against a plain version of its rules."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from clipwright.llm import turns
from clipwright.llm.common import table

WHITE = " \t\n\x0b\x0c\r"


def plain_parse(rows):
    """All repairs of a few rows with up to one insertion more than rows, tried one by one."""
    best = None
    for inserts in range(len(rows) + 2):
        for letters in set(itertools.permutations("I" * inserts + "." * len(rows))) if inserts + len(rows) <= 7 else []:
            for edits in itertools.product("KRD", repeat=len(rows)):
                edit, cost, audit, slots = iter(zip(edits, rows, strict=True)), 0, "", []
                for letter in letters:
                    if letter == "I":
                        cost, audit = cost + 5, audit + "I"
                        slots.append("ua")
                        continue
                    kind, (initial, fault) = next(edit)
                    audit += kind
                    if kind == "D":
                        cost += 2
                    elif fault in ("blank", "duplicate"):
                        break
                    else:
                        cost += (kind == "R") + 5 * (fault == "truncated")
                        slots.append(initial if kind == "K" else "ua")
                else:
                    if fits(slots) and (best is None or (cost, audit) < best):
                        best = cost, audit
    return best


def fits(slots):
    if not slots:
        return True
    for with_s in (0, 1):
        if len(slots) > with_s and (len(slots) - with_s) % 2 == 0 and (not with_s or slots[0] == "s") and all("ua"[(i - with_s) % 2] in slots[i] for i in range(with_s, len(slots))):
            return True
    return False


def viterbi(rows):
    """The same by a walk from row to row."""
    closure = {p: {p: (0, "")} for p in "0sua"}
    for p, steps in {"0": ["u", "ua"], "s": ["u", "ua"], "u": ["a", "au"], "a": ["u", "ua"]}.items():
        for x in steps:
            if x[-1] != p:
                closure[p][x[-1]] = (5 * len(x), "I" * len(x))
    step = lambda p, x: (p == "0" and x in "su") or (p in "sa" and x == "u") or (p == "u" and x == "a")
    now = {"0": (0, "")}
    grow = lambda now: {q: min((c + c2, x + x2) for p, (c, x) in now.items() for q2, (c2, x2) in closure[p].items() if q2 == q) for q in {q for p in now for q in closure[p]}}
    for initial, fault in rows:
        now, after = grow(now), defaultdict(list)
        for p, (c, x) in now.items():
            after[p].append((c + 2, x + "D"))
            if fault not in ("blank", "duplicate"):
                more = 5 if fault == "truncated" else 0
                after[initial] += [(c + more, x + "K")] if initial and step(p, initial) else []
                for y in "ua":
                    after[y] += [(c + more + 1, x + "R")] if step(p, y) else []
        now = {p: min(found) for p, found in after.items() if found}
    return min(grow(now)[p] for p in "0a" if p in grow(now))


def test_cells_against_all_repairs():
    rng = random.Random(5)
    for _ in range(60):
        rows = [(rng.choice("suat"), rng.choice(["good", "good", "blank", "duplicate", "truncated"])) for _ in range(rng.randint(0, 3))]
        assert turns.parse(rows) == plain_parse(rows) == viterbi(rows), rows


def test_cells_against_a_walk():
    rng = random.Random(6)
    for n in [*range(1, 40), 200]:
        for _ in range(10):
            rows = [(rng.choice(["s", "u", "a", "u", "a", "t", "", " "]), rng.choice(["good"] * 5 + ["blank", "duplicate", "truncated"])) for _ in range(n)]
            assert turns.parse(rows) == viterbi(rows), rows


def expected(rows):
    """The query's rows, from (conv_id, turn, role, text), by plain Python."""
    after, ids = defaultdict(list), []
    for conv_id, turn, role, text in rows:
        ids.append(conv_id)
        kind = zlib.crc32(f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}".encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        after[conv_id] += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = {}
    for conv_id in set(ids):
        said = sorted(after[conv_id], key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        seen, faults = set(), []
        for _, role, text in said:
            fault = "blank" if not text.strip(WHITE) else "duplicate" if (role, text) in seen else "truncated" if text.rstrip(WHITE)[-1] not in ".!?" else "good"
            seen.add((role, text))
            faults.append(fault)
        initials = [r[1][:1] for r in said]
        cost, audit = viterbi(list(zip(initials, faults, strict=True)))
        lines, left = [], iter(said)
        total = len(audit) - audit.count("D")
        for letter in audit:
            row = None if letter == "I" else next(left)
            role = "s" if total % 2 and not lines else ["user", "assistant"][(len(lines) - total % 2) % 2]
            if letter != "D":
                lines.append(f"{row[1] if letter == 'K' else role}:{row[2] if row else ''}")
        known = [r[0] for r in said if r[0] is not None]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        out[conv_id] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def result(df):
    return {r[0]: tuple(r)[1:] for r in df.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()}


def test_query_on_all_rows(spark, sf):
    rows = table(spark, sf, "conversations")
    got = result(turns.repair_trial(rows))
    assert got == expected([tuple(r) for r in rows.select("conv_id", "turn", "role", "text").collect()])


@pytest.mark.parametrize("chunk", [3, 1024])
def test_odd_rows_and_long_conversations(spark, chunk, monkeypatch):
    monkeypatch.setattr(turns, "CHUNK", chunk)
    rng = random.Random(chunk)
    rows = [(1, t, rng.choice(["user", "assistant", "system", "tool", "", None]), rng.choice([f"said {t}.", "again!", "open", "", " \n", None])) for t in range(300)]
    rows += [(None, None, "user", "a."), (None, 3, "assistant", "b."), (2, None, None, None), (3, 0, "user", "x" * 200_000 + "."), (3, 1, "assistant", "yes."), (4, 7, "user", "same."), (4, 7, "user", "same."), (4, 7, "user", "same."), (4, 9, "user", "same.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("_copy", F.lit(1)).withColumn("audit", F.lit("x")).repartition(5)
    assert result(turns.repair_trial(df)) == expected(rows)


def test_no_rows(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert turns.repair_trial(empty).collect() == []
    found, said = turns.repair(empty)
    assert found.count() == said.count() == 0


def test_turns_of_a_repair(spark):
    rows = spark.createDataFrame([(1, 0, "system", "be kind."), (1, 1, "assistant", "hello."), (1, 2, "assistant", "how are you?"), (2, 0, "user", "hi.")], "conv_id long, turn long, role string, text string")
    found, said = turns.repair(rows)
    assert {r.conv_id: (r.cost, r.audit) for r in found.collect()} == {1: (1, "KRK"), 2: (2, "D")}
    assert [tuple(r)[1:] for r in said.where("conv_id = 1").orderBy("place").collect()] == [(0, "K", "system", "be kind."), (1, "R", "user", "hello."), (2, "K", "assistant", "how are you?")]
