import math
import zlib
from collections import Counter, defaultdict

import numpy as np

from clipwright.llm import langid

SCHEMA = "doc_id long, text string, lang string, source string, score string"


def grams(text):
    whole = [langid.SPACE] * 3 + langid.symbols(text).tolist()
    whole += [langid.SPACE] * (whole[-1] != langid.SPACE)
    return [tuple(whole[i : i + 4]) for i in range(len(whole) - 3)]


class Plain:
    """Interpolated Kneser-Ney over dictionaries."""

    def __init__(self, texts):
        self.n = {4: Counter(g for t in texts for g in grams(t))}
        for k in (3, 2, 1):
            self.n[k] = Counter(g[1:] for g in self.n[k + 1])
        self.total, self.kinds, self.d = defaultdict(Counter), defaultdict(Counter), {}
        for k, counts in self.n.items():
            ones, twos = (sum(c == x for c in counts.values()) for x in (1, 2))
            self.d[k] = max(ones / (ones + 2 * twos) if twos else 0.5, 0.1)
            for g, c in counts.items():
                self.total[k][g[:-1]] += c
                self.kinds[k][g[:-1]] += 1

    def p(self, g):
        k = len(g)
        if k == 0:
            return 1 / (len(self.n[1]) + 1)
        total = self.total[k][g[:-1]]
        if not total:
            return self.p(g[1:])
        return max(self.n[k][g] - self.d[k], 0) / total + self.d[k] * self.kinds[k][g[:-1]] / total * self.p(g[1:])

    def entropy(self, text):
        own = grams(text)
        return -sum(math.log(self.p(g)) for g in own) / len(own)


def test_symbols():
    assert "".join(map(chr, langid.symbols("Ab, 1c\n\nÉ!"))) == "ab c é "
    assert len(langid.symbols("12 .,")) == len(langid.symbols(None)) == len(langid.symbols("")) == 0
    assert langid.symbols("𐐀😀").tolist() == [0xFFFF, langid.SPACE]


def test_pieces_lose_nothing(monkeypatch):
    monkeypatch.setattr(langid, "CHUNK", 7)
    texts = ["hello world again", None, "a", "...", "the very long one that is cut"]
    found = defaultdict(list)
    for at, starts, keys in langid.pieces(texts):
        for i, own in zip(at, np.split(keys, starts[1:])):
            found[i] += own.tolist()
    pack = lambda g: sum(c << 16 * (3 - j) for j, c in enumerate(g))
    assert found == {i: [pack(g) for g in grams(texts[i])] for i in (0, 2, 4)}


def test_marks_stay_with_their_letters():
    assert "".join(map(chr, langid.symbols("हिन्दी, 12"))) == "हिन्दी "
    assert len(langid.symbols("\u0301 \u0301")) == 0


def test_hashes_differ():
    keys = np.concatenate([np.arange(200_000), np.random.default_rng(1).integers(0, 2**63, 200_000)]).astype(np.uint64)
    assert len(np.unique(langid.hashed(keys))) == len(np.unique(keys))


def large_alphabet():
    """Texts in two languages of ordinary alphabets and one of some thousand letters, and odd rows."""
    rng = np.random.default_rng(9)
    wide = lambda n: "".join(chr(0x4E00 + int(c)) for c in np.minimum(rng.zipf(1.3, n), 3000))
    small = lambda n, letters: " ".join("".join(rng.choice(list(letters), 5)) for _ in range(n))
    rows = [(i, [small(12, "abcdeghin"), small(12, "ijklmnost"), wide(60)][i % 3], ["en", "fi", "zh"][i % 3], "s", "z") for i in range(90)]
    return [*rows, (200, None, "en", "s", "z"), (201, "12 ...", "zh", "s", "z"), (None, wide(20), "zh", "s", "z"), (5, rows[5][1], "zh", "s", "z"), (202, "Ωψχ", None, "s", "z")]


def test_joins_equal_the_sent_model(spark):
    docs = spark.createDataFrame(large_alphabet(), SCHEMA).repartition(3)
    columns = ["doc_id", "held_out", "lang_pred", "rejected", "score", "cross_entropy"]
    key = lambda r: (r["doc_id"] is None, r["doc_id"], r["lang_pred"])
    sent, joined = (sorted(langid.identify(docs, most_sent=n).select(*columns).collect(), key=key) for n in (langid.MOST_SENT, 0))
    assert [tuple(r)[:4] for r in sent] == [tuple(r)[:4] for r in joined]
    assert np.allclose([r["score"] for r in sent], [r["score"] for r in joined], atol=1e-4)
    assert np.allclose([r["cross_entropy"] or 0 for r in sent], [r["cross_entropy"] or 0 for r in joined], atol=1e-5)
    by = {r["doc_id"]: r for r in joined}
    assert by[200]["lang_pred"] == by[201]["lang_pred"] == "und" and by[None]["lang_pred"] == "zh"


def test_joined_entropies_equal_plain_models(spark, monkeypatch):
    monkeypatch.setattr(langid, "CHUNK", 50)
    rows = [r for r in large_alphabet() if r[1] and r[2]]
    entries, unseen = langid.tables(spark.createDataFrame(rows, SCHEMA).select("text", "lang"))
    chosen = spark.createDataFrame(rows, SCHEMA).selectExpr("doc_id", "text", "true as held_out", "source as lang")
    plain = {lang: Plain([r[1] for r in rows if r[2] == lang]) for lang in unseen}
    got = {r["doc_id"]: r["entropy"] for r in langid.joined_entropies(chosen, entries, unseen).collect()}
    for r in rows:
        want = [plain[lang].entropy(r[1]) for lang in sorted(unseen)] if len(langid.symbols(r[1])) else None
        assert (got[r[0]] is None and want is None) or np.allclose(got[r[0]], want, atol=1e-6), r


def test_no_ngram_is_left_out(spark):
    rows = [r for r in large_alphabet() if r[1] and r[2]]
    model = langid.fit(spark.createDataFrame(rows, SCHEMA).select("text", "lang"))
    for lang in model.languages:
        kept = {g for r in rows if r[2] == lang for g in grams(r[1])} if any(grams(r[1]) for r in rows if r[2] == lang) else set()
        assert len(model.grams[lang, 4][0]) == len(kept)


def test_entropies_equal_plain_models(spark):
    texts = {"en": ["the cat sat on the mat", "a dog and the cat", "that is the thing"], "de": ["der hund und die katze", "das ist ein ding", "ein hund der bellt"]}
    model = langid.fit(spark.createDataFrame([(t, lang) for lang, ts in texts.items() for t in ts] + [(None, "en"), ("x", None)], "text string, lang string"))
    assert model.languages == ["de", "en"]
    plain = {lang: Plain(ts) for lang, ts in texts.items()}
    for text in ("the hund", "zzz q", "katze and cat", "ein"):
        own = grams(text)
        keys = np.array([sum(c << 16 * (3 - j) for j, c in enumerate(g)) for g in own], np.uint64)
        got = -model.log_probability(keys).mean(1)
        assert np.allclose(got, [plain[x].entropy(text) for x in model.languages], atol=1e-4)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = langid.identify(docs)
    assert found.count() == docs.count()
    rows = found.join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.98 * len(held)
    assert all(0 <= r["score"] <= 1 for r in rows) and sum(r["rejected"] for r in rows) < 0.03 * len(rows)


def test_labels_of_held_out_rows_and_odd_rows(spark):
    base = [(i, "the cat and the dog went home" if i % 2 else "der hund und die katze gingen heim", "en" if i % 2 else "de", "s", "z") for i in range(60)]
    odd = [(100, None, "en", "s", "z"), (101, "12 34 ...", "en", "s", "z"), (None, "the dog", "en", "s", "z"), (7, base[7][1], "en", "s", "z"), (103, "the cat " * 200_000, None, "s", "z"), (104, "ժդեզը ռուբլի", "en", "s", "z")]
    first = langid.identify(spark.createDataFrame(base + odd, SCHEMA)).collect()
    assert len(first) == len(base) + len(odd)
    by = {r["doc_id"]: r for r in first}
    assert by[100]["lang_pred"] == by[101]["lang_pred"] == "und" and by[100]["score"] == 0.0 and by[100]["rejected"]
    assert by[103]["lang_pred"] == "en" and by[None]["lang_pred"] == "en" and not by[None]["held_out"]
    wrong = [(i, t, "xx" if zlib.crc32(str(i).encode()) % 4 == 2 else lang, s, z) for i, t, lang, s, z in base + odd[:2] + odd[3:]]
    assert {r["doc_id"]: r["lang_pred"] for r in langid.identify(spark.createDataFrame(wrong, SCHEMA)).collect()} == {i: r["lang_pred"] for i, r in by.items() if i is not None}


def test_strange_text_is_rejected(spark):
    base = [(i, "the cat and the dog went home again " * (1 + i % 3), "en", "s", "z") for i in range(80)]
    found = langid.identify(spark.createDataFrame(base + [(900, "xqzj vwkq zzxq jjqk", None, "s", "z")], SCHEMA)).collect()
    assert [r["rejected"] for r in found if r["doc_id"] == 900] == [True]
    assert sum(r["rejected"] for r in found) <= 3


def test_nothing_learned(spark):
    rows = [(1, "abc", None, "s", "z"), (2, None, None, None, None)]
    assert {r["lang_pred"] for r in langid.identify(spark.createDataFrame(rows, SCHEMA)).collect()} == {"und"}
    assert langid.identify(spark.createDataFrame([], SCHEMA)).count() == 0
