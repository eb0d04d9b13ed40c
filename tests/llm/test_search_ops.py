"""Brute-force checks of embeddings, repeated passages and toxicity on small fixtures."""

import re

import numpy as np
import pytest

from privlens.llm import embeddings, substrings, toxicity


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute_repeats(texts, window):
    seen = {}
    for d, t in enumerate(texts):
        w = words(t)
        for s in range(len(w) - window + 1):
            seen.setdefault(tuple(w[s : s + window]), []).append((d, s))
    gone = {(d, s + i) for places in seen.values() if len(places) > 1 for d, s in places for i in range(window)}
    return [(len(words(t)), sum((d, i) in gone for i in range(len(words(t)))), " ".join(x for i, x in enumerate(words(t)) if (d, i) not in gone)) for d, t in enumerate(texts)]


@pytest.fixture(scope="module")
def passages():
    rng = np.random.default_rng(8)
    vocabulary = [f"w{i}" for i in range(400)]
    fresh = lambda n: " ".join(rng.choice(vocabulary, n))
    shared = [fresh(n) for n in (35, 36, 60, 34, 90)]
    texts = [None, "", "one", "a " * 200, "b a " * 120, fresh(500)]
    for i in range(60):
        texts.append(" ".join([fresh(rng.integers(0, 40)), shared[i % 5], fresh(rng.integers(0, 40)), shared[(i * 3) % 5] if i % 4 == 0 else ""]))
    near = fresh(120).split()
    for i in range(30):
        other = list(near)
        other[int(rng.integers(0, 120))] = f"x{i}"
        texts.append(" ".join(other))
    texts += [texts[10], texts[10], fresh(40) + "\n" + texts[20], "c d e " * 30 + fresh(30) + " c d e" * 30]
    return texts


@pytest.mark.parametrize("max_contexts, looked_at", [(256, 0.05), (3, 0.5), (3, 1.0)])
def test_repeats_equal_brute_force(spark, passages, monkeypatch, max_contexts, looked_at):
    # the larger the sample, the more keys count as heavy here: some in the second case, all that repeat in the third
    monkeypatch.setattr(substrings, "LOOKED_AT", looked_at)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(passages)], "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in substrings.remove_repeats(df, max_contexts=max_contexts).collect()}
    want = brute_repeats(passages, 35)
    assert len(got) == len(passages)
    for i, w in enumerate(want):
        assert got[i] == w, i


def test_automaton_knows_shared_windows():
    rng = np.random.default_rng(1)
    for _ in range(200):
        contexts = []
        for _ in range(int(rng.integers(2, 6))):
            left = int(rng.integers(0, 8))
            contexts.append((left, [str(x) for x in rng.integers(0, 2, left + int(rng.integers(3, 12)))]))
        want = []
        for k, (left, w) in enumerate(contexts):
            hits = []
            for s in range(0, min(left, len(w) - 5) + 1):
                if s + 5 <= left:
                    continue
                if any(j != k and (s - left + m) >= 0 and v[s - left + m : s - left + m + 5] == w[s : s + 5] for j, (m, v) in enumerate(contexts)):
                    hits.append(s)
            want.append(hits)
        assert substrings.shared_windows(contexts, 5) == want, contexts


def test_drop_repeats_keeps_untouched_texts(spark):
    long = " ".join(f"t{i}" for i in range(50))
    df = spark.createDataFrame([(1, "As  it\nwas", 3), (2, long, 4), (3, "head " + long, 5), (4, None, 6)], "doc_id long, text string, c0 int")
    assert sorted((r["doc_id"], r["text"], r["c0"]) for r in substrings.drop_repeats(df).collect()) == [(1, "As  it\nwas", 3), (3, "head", 5), (4, "", 6)]


def test_embeddings_equal_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(2)
    centre = rng.normal(size=(12, 20))
    rows = []
    for i in range(400):
        v = centre[i % 12] + rng.normal(size=20) * (0.02 if i % 3 else 0.4)
        rows.append((i, [float(x) for x in v], i % 3 if i % 17 else None))
    rows += [(400 + i, rows[5][1], rows[5][2]) for i in range(5)]
    rows += [(500, None, 1), (501, [0.0] * 20, 1), (502, [float("nan")] * 20, 1), (503, [], 1), (504, [None] * 20, 1), (505, [1.0, 2.0], 1), (506, [2.0, 4.0], 1), (507, [float("inf")] * 20, 1), (508, [1e200] * 20, 0), (509, [1e-200] * 20, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    monkeypatch.setattr(embeddings, "TILE", 50)
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embeddings.embedding_components(df).collect()}
    good = {i: np.array(v) / np.abs(v).max() for i, v, l in rows if l is not None and v and None not in v and np.isfinite(v).all() and np.any(v)}
    label = {i: l for i, _, l in rows}
    root, links = {i: i for i, _, _ in rows}, {i: 0 for i, _, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in good:
        for b in good:
            if a < b and label[a] == label[b] and len(good[a]) == len(good[b]):
                c = good[a] @ good[b] / np.linalg.norm(good[a]) / np.linalg.norm(good[b])
                if c >= 0.98:
                    links[a] += 1
                    links[b] += 1
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
    assert len(got) == len(rows)
    for i, _, _ in rows:
        assert got[i] == (links[i], find(i), i == find(i)), i
    assert embeddings.embedding_components(df.where("false")).count() == 0


def test_index_equals_full_cosine():
    rng = np.random.default_rng(3)
    vocabulary = toxicity.Vocabulary(np.arange(60, dtype=np.uint64), rng.uniform(1, 6, 60))

    def draw():
        slots = np.sort(rng.choice(60, int(rng.integers(0, 12)), replace=False)) + 1
        return vocabulary.vector(slots, rng.integers(1, 5, len(slots)))

    vectors = [draw() for _ in range(700)]
    index = toxicity.BlockMaxIndex(vectors, 61)
    dense = np.zeros((700, 61))
    for i, (s, w) in enumerate(vectors):
        dense[i, s] = w
    for _ in range(200):
        s, w = draw()
        q = np.zeros(61)
        q[s] = w
        near, cosine = index.top(s, w, 25)
        want = np.lexsort((np.arange(700), -np.round(dense @ q, 12)))[:25]
        assert near.tolist() == want.tolist()
        assert np.allclose(cosine, np.minimum(dense[want] @ q, 1))


def test_toxicity_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    from privlens.llm import queries

    got = {r["doc_id"]: r for r in queries.op9_toxicity(spark, sf).collect()}
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got.values())
    held = [(r["toxic"], got[r["doc_id"]]["predicted"]) for r in labels.collect() if r["doc_id"] in got and got[r["doc_id"]]["held_out"]]
    right = sum(a == b for a, b in held) / len(held)
    toxic = [b for a, b in held if a == 1]
    assert right > 0.93 and sum(toxic) / len(toxic) > 0.7, (right, toxic)


def test_toxicity_of_odd_tables(spark):
    docs = spark.createDataFrame([(1, None, 0.5), (None, "a b", 0.1), (1, "", 0.2)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    assert [r["score"] for r in toxicity.score(docs, model).collect()] == [0.5] * 3
    assert toxicity.score(docs.where("false"), model).count() == 0
