import math
import random
import re

import numpy as np

from clipwright.llm import decontam, quality

SCHEMA = "doc_id long, text string, lang string, source string, found string"


def parts(text, n=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return {" ".join(words[i : i + n]) for i in range(len(words) - n + 1)} or ({" ".join(words)} if words else set())


def test_containment_equals_brute_force(spark):
    r = random.Random(3)
    word = lambda: f"w{r.randrange(3000)}"
    items = [(i, " ".join(word() for _ in range(r.choice([3, 6, 12, 33, 60])))) for i in range(40)]
    items += [(40, None), (41, ""), (42, "Two Words"), (43, items[5][1])]
    rows = []
    for i in range(120):
        body = [word() for _ in range(r.choice([0, 4, 40, 400]))]
        if i % 3 == 0:
            passage = items[i % 40][1].split()
            for _ in range(i % 4):
                passage[r.randrange(len(passage))] = "changed"
            at = r.randrange(len(body) + 1)
            body[at:at] = passage
        rows.append((i, " ".join(body), "en", "s", "z"))
    rows += [(200, None, "en", "s", "z"), (201, "two WORDS", "en", "s", "z"), (202, "two words more", "en", "s", "z"), (0, rows[0][1], "en", "s", "z"), (203, "x " * 70_000 + items[3][1], "en", "s", "z")]
    found = {(x["doc_id"], x["item_id"]): (x["found"], x["n_shingles"]) for x in decontam.find_contained(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {}
    for d, text, *_ in rows:
        for i, item in items:
            own = parts(item)
            shared = len(own & parts(text))
            if own and shared >= math.ceil(0.8 * len(own) - 1e-9):
                want[d, i] = (shared, len(own))
    assert found == want and (203, 3) in want and (201, 42) in want and (202, 42) not in want


def test_items_and_documents_of_one_id_are_their_own(spark):
    a, b = " ".join(f"a{i}" for i in range(20)), " ".join(f"b{i}" for i in range(20))
    docs = spark.createDataFrame([(1, a, "", "", ""), (1, b[:40], "", "", ""), (None, b, "", "", ""), (None, b, "", "", ""), (2, a[:40] + " " + b[:40], "", "", "")], SCHEMA)
    items = spark.createDataFrame([(7, a), (7, b), (7, b), (None, a)], "item_id long, text string")
    found = decontam.find_contained(docs, items).select("doc_id", "item_id", "found").collect()
    assert sorted(found, key=str) == sorted([(1, 7, 16), (1, None, 16), (None, 7, 16)], key=str)
    kept = decontam.drop_contaminated(docs, decontam.find_contained(docs, items)).collect()
    assert sorted(r["text"] for r in kept) == sorted([b[:40], a[:40] + " " + b[:40]])


def test_sketches_make_the_candidates(spark, monkeypatch):
    words = [f"w{i}" for i in range(60)]
    docs = spark.createDataFrame([(1, " ".join(words), "", "", ""), (2, " ".join(words[:58]), "", "", "")], SCHEMA)
    items = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    assert decontam.find_contained(docs, items).count() == 2
    monkeypatch.setattr(decontam, "needed", lambda n, threshold: n + 1)  # sketches of nothing
    assert decontam.find_contained(docs, items).count() == 0


def test_a_filter_that_is_full_loses_nothing(spark):
    r = random.Random(6)
    items = [(i, " ".join(f"w{r.randrange(900)}" for _ in range(40))) for i in range(50)]
    docs = [(i, items[i][1] + " and more", "", "", "") for i in range(50)]
    args = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, "item_id long, text string")
    full, wide = ({tuple(x) for x in decontam.find_contained(*args, filter_bits=b).drop("text_key").collect()} for b in (4, 20))
    assert full == wide and len(full) == 50


def test_no_items_or_documents(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", "en", "s", "z")], SCHEMA)
    items = spark.createDataFrame([], "item_id long, text string")
    assert decontam.find_contained(docs, items).count() == 0
    assert decontam.find_contained(docs.limit(0), spark.createDataFrame([(1, "a b c d e")], "item_id long, text string")).count() == 0
    kept = decontam.drop_contaminated(docs, decontam.find_contained(docs, spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")))
    assert kept.count() == 0 and kept.columns == docs.columns


def test_quality_keeps_clean_and_drops_junk(spark, sf):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    train = labels.where("doc_id % 2 = 0")
    scores = quality.score_quality(docs, train)
    assert scores.count() == docs.count()
    held = scores.join(labels.where("doc_id % 2 = 1"), "doc_id").collect()
    assert sum(r["keep"] == (r["quality"] == 1) for r in held) >= 0.97 * len(held)
    assert sum(r["keep"] for r in held if r["quality"] == 1) >= 0.98 * sum(r["quality"] for r in held)


def test_quality_equals_plain_computation(spark):
    r = random.Random(5)
    rows = []
    for i in range(300):
        bad = r.random() < (0.8 if i % 7 == 0 else 0.1)
        text = " ".join((r.choice(["alpha", "beta", "gamma", "delta"]) + str(i)) + ("###" if bad else "") for _ in range(20))
        rows.append((i, text, f"l{i % 3}", None if i % 11 == 0 else f"s{i % 7}", "z"))
    rows += [(500, None, None, None, "z"), (501, "", "l0", "rare", "z"), (5, rows[5][1], rows[5][2], rows[5][3], "z")]
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(i, int("###" not in rows[i][1])) for i in range(0, 300, 2)] + [(3, None)], "doc_id long, quality int")
    found = quality.score_quality(docs, labels).collect()
    assert len(found) == len(rows)
    x = np.array([quality.features(t) for _, t, *_ in rows])
    train = [i for i in range(0, 300, 2)]
    w, b = quality.fit_logistic(x[train], np.array([int("###" not in rows[i][1]) for i in train], float))
    p = 1 / (1 + np.exp(-(x @ w + b)))
    by = {}
    for (i, _, lang, source, _), pi in zip(rows, p):
        by.setdefault((source,), []).append(pi)
        by.setdefault((source, lang), []).append(pi)
    mu = p.mean()

    def strength(groups):
        many = [(np.array(g), prior) for g, prior in groups if len(g) > 1]
        between = max(np.mean([(g.mean() - prior) ** 2 for g, prior in many]) - np.mean([g.var() / len(g) for g, _ in many]), 1e-6)
        return min(max(mu * (1 - mu) / between - 1, 1), 1e6)

    k1 = strength([(g, mu) for key, g in by.items() if len(key) == 1])
    host = {key[0]: (sum(g) + k1 * mu) / (len(g) + k1) for key, g in by.items() if len(key) == 1}
    k2 = strength([(g, host[key[0]]) for key, g in by.items() if len(key) == 2])
    logit = lambda q: math.log(min(max(q, 1e-6), 1 - 1e-6) / (1 - min(max(q, 1e-6), 1 - 1e-6)))
    got = {r["doc_id"]: r for r in found}
    for (i, _, lang, source, _), pi in zip(rows, p):
        # each level without the row itself
        rest = min(max((p.sum() - pi) / (len(p) - 1), 0), 1)
        h, g = by[source,], by[source, lang]
        above = (sum(h) - pi + k1 * rest) / (len(h) - 1 + k1)
        path = (sum(g) - pi + k2 * above) / (len(g) - 1 + k2)
        final = 1 / (1 + math.exp(-(logit(pi) + logit(path) - logit(rest))))
        assert abs(got[i]["p"] - final) < 1e-5 and got[i]["keep"] == (got[i]["p"] >= 0.5)


def test_a_row_does_not_speak_for_its_own_site(spark):
    texts = ["alpha beta gamma delta"] * 30 + ["##a %%b $$c ##d"] * 10
    rows = [(i, t, "l", "many", "z") for i, t in enumerate(texts)]
    labels = spark.createDataFrame([(i, int(i < 30)) for i in range(40)], "doc_id long, quality int")
    for text in texts[0], texts[-1]:
        docs = spark.createDataFrame([*rows, (99, text, "l", "alone", "z")], SCHEMA)
        alone = next(r for r in quality.score_quality(docs, labels).collect() if r["doc_id"] == 99)
        assert abs(alone["path_posterior"] - alone["host_posterior"]) < 1e-9 and abs(alone["host_posterior"] - 0.75) < 0.03


def test_words_count(spark):
    r = random.Random(9)
    good, bad = [f"g{i}" for i in range(40)], [f"b{i}" for i in range(40)]
    rows = [(i, " ".join(r.choice(good if i % 2 else bad) for _ in range(30)), "l", "s", "z") for i in range(400)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(0, 200)], "doc_id long, quality int")
    found = quality.score_quality(spark.createDataFrame(rows, SCHEMA), labels).where("doc_id >= 200").collect()
    assert sum(x["keep"] == (x["doc_id"] % 2 == 1) for x in found) >= 0.97 * len(found)


def test_quality_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b", "en", "s", "z"), (None, None, None, None, None)], SCHEMA)
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert [r["keep"] for r in quality.score_quality(docs, labels).collect()] == [True, True]
    assert quality.score_quality(docs.limit(0), labels).count() == 0


def test_salted_sites_equal_sent_ones(spark, monkeypatch):
    r = random.Random(8)
    rows = [(i, "good words here. " * r.randint(1, 9) if r.random() < 0.6 else "$$ ## 11", r.choice(["en", None]), r.choice(["a", "a", "a", "b", None]), "z") for i in range(80)]
    labels = spark.createDataFrame([(i, int("good" in rows[i][1])) for i in range(0, 80, 2)], "doc_id long, quality int")
    docs = spark.createDataFrame(rows, SCHEMA)
    sent = {x["doc_id"]: round(x["p"], 9) for x in quality.score_quality(docs, labels).collect()}
    monkeypatch.setattr(quality, "MOST_SENT", 0)
    assert {x["doc_id"]: round(x["p"], 9) for x in quality.score_quality(docs, labels).collect()} == sent and len(sent) == 80


def test_a_shingle_that_all_share(spark):
    """A passage that every item and document has makes no row that isn't a candidate, and no item is lost."""
    common = " ".join(f"c{i}" for i in range(12))
    items = [(i, f"{common} " + " ".join(f"i{i}x{k}" for k in range(20))) for i in range(30)]
    docs = [(i, common + " tail " * 20, "en", "s", "z") for i in range(60)] + [(100 + i, f"lead {t} tail", "en", "s", "z") for i, t in items[:5]]
    found = decontam.find_contained(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in found) == [(100 + i, i) for i in range(5)]
