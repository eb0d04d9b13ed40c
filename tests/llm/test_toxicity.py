"""Toxicity against an all-cosine version of itself, without own labels, and at several bounds of the example sample."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from privlens.llm import toxicity

SF = "/root/testdata/sf0.01"


def terms(text):
    """Hashes of words and of the beginnings of longer words, by plain Python."""
    found = Counter()
    for w in re.findall(rb"[0-9A-Za-z\x80-\xff]+", (text or "").encode()):
        w = re.sub(rb"[A-Z]", lambda m: m[0].lower(), w)
        found[xxhash.xxh64_intdigest(w, 42)] += 1
        for size, seed in ((4, 101), (5, 102), (6, 103)):
            if len(w) > size:
                found[xxhash.xxh64_intdigest(w[:size], seed)] += 1
    return found


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


@pytest.fixture(scope="module")
def model(tables):
    return toxicity.fit(*tables)


def test_scores_equal_all_cosine(tables, model):
    docs, labels = tables
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    learnt = {r["doc_id"]: r["toxic"] for r in labels.where(toxicity.in_training(F.col("doc_id"))).collect() if r["doc_id"] in texts and r["toxic"] in (0, 1)}
    names = {int(h): i for i, h in enumerate(model.vocabulary.hashes)}
    counts = {t: {h: n for h, n in terms(t).items() if h in names} for t in set(texts.values())}
    frequency = Counter(h for t in texts.values() for h in counts[t])
    idf = {h: np.log((len(texts) + 1) / (frequency[h] + 1)) + 1 for h in names}
    # the vocabulary: terms of 4 examples and more with a chi-squared statistic of 12 and more, and 0.004 a row
    on, n = Counter(), Counter(learnt.values())
    for d, y in learnt.items():
        for h in terms(texts[d]):
            on[h, y] += 1
    chosen = set()
    for h in {h for h, _ in on}:
        p, q = on[h, 1], on[h, 0]
        cross = p * (n[0] - q) - q * (n[1] - p)
        if p + q >= 4 and p + q < n[0] + n[1] and (n[0] + n[1]) * cross**2 >= max(12, 0.004 * (n[0] + n[1])) * n[0] * n[1] * (p + q) * (n[0] + n[1] - p - q):
            chosen.add(h)
    assert chosen == set(names)

    def vector(t):
        v = np.zeros(len(names) + 1)
        v[0] = 1.0
        for h, c in counts[t].items():
            v[names[h] + 1] = (1 + np.log(c)) * idf[h]
        return v / np.linalg.norm(v)

    rows = defaultdict(lambda: [0, 0])
    for d, y in learnt.items():
        rows[texts[d]][y] += 1
    examples = sorted(rows, key=lambda t: (len(counts[t]), xxhash.xxh3_128_digest(t.encode())))
    matrix = np.array([vector(t) for t in examples])
    weight = np.array([[rows[t][1] / n[1], rows[t][0] / n[0]] for t in examples])

    def raw(t):
        cosine = np.round(matrix @ vector(t), 12)
        near = [i for i in np.lexsort((np.arange(len(examples)), -cosine)) if examples[i] != t][:25]
        vote = (weight[near] / (1.01 - np.minimum(cosine[near], 1))[:, None]).sum(axis=0)
        return vote[0] / vote.sum()

    raws = np.array([raw(t) for t in examples])
    steps, levels = toxicity.isotonic(raws, weight[:, 0] / weight.sum(axis=1), weight.sum(axis=1))
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    for d, t in texts.items():
        want = np.clip(np.interp(raw(t), steps, levels), 0.001, 0.999)
        assert got[d] == pytest.approx(want, abs=2e-3), d
    assert np.mean([abs(got[d] - np.clip(np.interp(raw(t), steps, levels), 0.001, 0.999)) < 1e-6 for d, t in texts.items()]) > 0.99


def test_own_label_is_no_input(tables, model):
    docs, labels = tables
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    rows = []
    for r in labels.where(toxicity.in_training(F.col("doc_id"))).collect():
        found = sorted((model.vocabulary.hashes.searchsorted(np.uint64(h)) + 1, c) for h, c in terms(texts[r["doc_id"]]).items() if np.uint64(h) in model.vocabulary.hashes)
        rows.append((r["doc_id"], r["toxic"], xxhash.xxh3_128_digest(texts[r["doc_id"]].encode()), np.array([s for s, _ in found], np.int64), np.array([c for _, c in found], np.int64)))
    for at in [i for i, r in enumerate(rows) if r[1] == 1][:12]:
        own = rows[at]
        flipped = [(d, 1 - y if digest == own[2] else y, digest, s, c) for d, y, digest, s, c in rows]
        for made in (toxicity.build(model.vocabulary, rows), toxicity.build(model.vocabulary, flipped)):
            made.steps, made.levels = model.steps, model.levels
            score, evidence = made.score(own[3], own[4], made.number[own[2]])
            assert own[0] not in evidence
            # the class totals, by which all votes are divided, hold the flipped label too
            assert score == pytest.approx(model.score(own[3], own[4], model.number[own[2]])[0], abs=0.06)


@pytest.mark.parametrize("most, least", [(80, 0.5), (200, 0.65), (3000, 0.8)])
def test_recall_at_several_bounds(spark, most, least):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    made = toxicity.fit(docs, labels, most=most)
    held = labels.where(~toxicity.in_training(F.col("doc_id")))
    got = toxicity.score(docs.join(held.select("doc_id"), "doc_id", "left_semi"), made).join(held, "doc_id").select("toxic", "score").collect()
    toxic, clean = ([r["score"] >= toxicity.THRESHOLD for r in got if r["toxic"] == y] for y in (1, 0))
    assert np.mean(toxic) >= least and np.mean(clean) <= 0.06, (np.mean(toxic), np.mean(clean))


def test_contradicted_labels_do_not_silence_the_score(spark):
    """One clean row in twelve carries the toxic words: those words still tell label 1."""
    docs = spark.createDataFrame([(i, f"some w{i % 37} w{i % 11} text" + (f" awful{i % 3} nasty{i % 2}" if i % 10 == 0 or i % 12 == 1 else "")) for i in range(4000)], "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 10 == 0).cast("int").alias("toxic"))
    scored = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    assert np.mean([r["score"] >= 0.7 for r in scored if r["doc_id"] % 10 == 0]) > 0.95
    assert not any(r["score"] >= 0.7 for r in scored if "awful" not in r["text"])


def test_odd_rows(spark):
    long = "bad " * 50_000 + "x" * 100_000
    rows = [(i, f"bad worse w{i}" if i % 3 == 0 else f"fine w{i}") for i in range(90)] + [(900, None), (901, ""), (902, long), (902, long), (None, "bad worse"), (903, "bad worse")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("score", "evidence", "toxic", "id", "slot", "hash", "label"):
        docs = docs.withColumn(name, F.lit(None).cast("string"))
    labels = spark.createDataFrame([*[(i, int(i % 3 == 0)) for i in range(90)], (3, None), (None, 1), (5, 7), (902, 1)], "doc_id long, toxic int").withColumn("text", F.lit("clash"))
    model = toxicity.fit(docs, labels)
    got = toxicity.score(docs, model).collect()
    assert len(got) == len(rows) and set(got[0].asDict()) == {*docs.columns}
    by = defaultdict(set)
    for r in got:
        by[r["text"] or ""].add(r["score"])
    assert all(len(v) == 1 for v in by.values()) and min(by["bad worse"]) >= 0.7 > max(by[""])


def test_a_labelled_id_that_repeats_is_one_example(spark):
    docs = spark.createDataFrame([(i, f"word{i} bad" if i % 2 else f"word{i} good") for i in range(60)], "doc_id long, text string")
    many = docs.unionByName(spark.range(500).select(F.lit(2).cast("long").alias("doc_id"), F.concat(F.lit("other good "), F.col("id")).alias("text")))
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    sample = toxicity._sample(many, labels, "doc_id", "text", "toxic", 30)
    assert sample.count() == sample.select("id").distinct().count() <= 60
    assert {len(r["text"]) for r in toxicity._sample(many.repartition(5), labels, "doc_id", "text", "toxic", 30).where("id = 2").collect()} == {len(r["text"]) for r in sample.where("id = 2").collect()}
