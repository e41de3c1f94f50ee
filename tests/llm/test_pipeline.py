import random
import re
from collections import Counter

import corpus_pipeline
from clipwright.llm import decontam, mixing, quality, sharding, simhash
from clipwright.llm.common import identity, rewritten, table


def shingles(text, n=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return {" ".join(words[i : i + n]) for i in range(len(words) - n + 1)} or ({" ".join(words)} if words else set())


def classes(sets):
    """Lists of indices, under links of a 5-word Jaccard of 0.8 or more of all pairs."""
    left, found = set(range(len(sets))), []
    while left:
        reached, ahead = set(), [left.pop()]
        while ahead:
            x = ahead.pop()
            reached.add(x)
            near = {y for y in left if len(sets[x] & sets[y]) >= 0.8 * len(sets[x] | sets[y]) - 1e-9}
            left -= near
            ahead += near
        found.append(sorted(reached))
    return found


def first_of_classes(texts):
    ids = sorted(texts)
    return {ids[c[0]] for c in classes([shingles(texts[i]) for i in ids])}


def test_stages_do_what_they_say(spark, sf):
    docs = table(spark, sf, "documents")
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    stage = dict(corpus_pipeline.STAGES)

    rejected = {r["doc_id"] for r in quality.score_quality(docs, table(spark, sf, "labels")).where("not keep").collect()}
    good = rewritten(stage["quality_classifier"](spark, docs, sf))
    assert good.columns == docs.columns and {r["doc_id"] for r in good.collect()} == set(before) - rejected

    kept = first_of_classes({r["doc_id"]: r["text"] for r in good.collect()})
    single = rewritten(stage["simhash_near_dedup"](spark, good, sf))
    assert single.columns == docs.columns and sorted(r["doc_id"] for r in single.collect()) == sorted(kept)

    items = [shingles(r["text"]) for r in table(spark, sf, "benchmark").collect()]
    leaked = {i for i in kept if any(len(s & shingles(before[i])) >= decontam.needed(len(s), 0.8) for s in items if s)}
    clean = rewritten(stage["benchmark_decontamination"](spark, single, sf))
    assert clean.columns == docs.columns and {r["doc_id"] for r in clean.collect()} == kept - leaked

    mixed = rewritten(stage["source_mixing"](spark, clean, sf))
    assert mixed.columns == docs.columns and {r["doc_id"] for r in mixed.collect()} <= kept - leaked
    shards = stage["rendezvous_sharding"](spark, mixed, sf).collect()
    assert sorted(r["doc_id"] for r in shards) == sorted(r["doc_id"] for r in mixed.collect())


def test_no_documents(spark, sf):
    docs = table(spark, sf, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        assert docs.count() == 0


def test_null_and_repeated_ids_through_all_stages(spark):
    """Rows are counted stage by stage; every row is a document of its own, whatever its doc_id."""
    r = random.Random(8)
    word = lambda: "".join(r.choice("abdefgilmnorst") for _ in range(r.randint(2, 8)))
    rows = []
    for i in range(160):
        text = " ".join(word() for _ in range(r.randint(8, 60))) + "."
        doc_id = None if i % 3 == 0 else i // 2 if i % 3 == 1 else i
        rows.append((doc_id, text, r.choice(["en", "de", None]), r.choice(["a", "b", None]), i))
    rows += [(None, " ".join(f"#{word()}%%" for _ in range(30)), "en", "a", -1) for _ in range(30)]
    rows += [rows[0]] * 40 + [(5, *rows[0][1:4], -2), (None, None, None, None, None), (7, "", "en", "a", 0), (7, None, "en", "a", 0), (7, rows[3][1], "en", "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, _key long").repartition(6)
    labels = spark.createDataFrame([(x[0], int(x[1] is None or "#" not in x[1]), 0) for x in rows if x[0] is not None] + [(5000 + i, 0, 0) for i in range(9)], "doc_id long, quality int, toxic int")
    bad = spark.createDataFrame([(5000 + i, f"#{word()}%% #{word()}$$ #x%%", "en", "a", 0) for i in range(9)], docs.schema)
    docs = docs.unionAll(bad)
    whole = Counter(tuple(x) for x in docs.collect())

    scores = quality.score_quality(docs, labels)
    rejected = {x["row_key"] for x in scores.where("not keep").collect()}
    keyed = docs.select("*", identity("text", "source", "lang").alias("k")).collect()
    good = quality.keep_good(docs, scores)
    want = Counter(tuple(x)[:-1] for x in keyed if x["k"] not in rejected)
    assert good.columns == docs.columns and Counter(map(tuple, good.collect())) == want and 0 < sum(want.values()) < sum(whole.values())

    left = sorted(want.elements(), key=str)
    single = simhash.keep_first(good, simhash.near_copies(good)).collect()
    found = Counter(map(tuple, single))
    assert set(found.values()) == {1}
    for members in classes([shingles(x[1]) for x in left]):
        inside = [left[m] for m in members]
        stays = [x for x in found if x in set(inside)]
        ids = [x[0] for x in inside if x[0] is not None]
        assert len(stays) == 1 and stays[0][0] == (min(ids) if ids else None)

    table_now = spark.createDataFrame(single, docs.schema)
    item = next(x for x in single if x["text"] and len(x["text"].split()) > 20 and x["doc_id"] is None)
    items = spark.createDataFrame([(1, " ".join(item["text"].split()[:15])), (1, "nothing of this is in any of them at all")], "item_id long, text string")
    clean = decontam.drop_contaminated(table_now, decontam.find_contained(table_now, items))
    assert Counter(map(tuple, clean.collect())) == Counter(x for x in map(tuple, single) if x != tuple(item))

    mix = mixing.mix_sources(clean)
    mixed = mixing.apply_mix(clean, mix)
    times = Counter()
    for x in mix.collect():
        times[x["row_key"]] += x["epochs"] + x["picked"]
    own = clean.select("*", mixing.row_key().alias("k")).collect()
    assert Counter(map(tuple, mixed.collect())) == Counter({tuple(x)[:-1]: times[x["k"]] for x in own if times[x["k"]]})
    shards = sharding.assign_shards(mixed).collect()
    assert len(shards) == sum(times.values()) and Counter(x["doc_id"] for x in shards) == Counter(x["doc_id"] for x in mixed.collect())
