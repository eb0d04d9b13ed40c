"""Cases that an operator once left out: each must be found, by comparison with a brute-force version."""

import re

import numpy as np
import pytest

from privlens.llm import pii, simhash
from tests.llm.test_text_ops import fingerprint


def shingles(text, k=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def survivors(texts, similarity=0.8, radius=3):
    """Least member of each group of texts alike by Jaccard similarity or fingerprint, and the alike pairs of unequal sets over ``radius`` bits apart."""
    sets, fps, root, far = [shingles(t) for t in texts], [fingerprint(t, 5) for t in texts], list(range(len(texts))), []

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for b in range(len(texts)):
        for a in range(b):
            near, both = (fps[a] ^ fps[b]).bit_count() <= radius, len(sets[a] & sets[b])
            alike = both > 0 and both >= similarity * (len(sets[a]) + len(sets[b]) - both) - 1e-9
            if alike and not near and sets[a] != sets[b]:
                far.append((a, b))
            if alike or near:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return sorted({find(i) for i in range(len(texts))}), far


def edited_copies():
    """Texts of 40 to 400 words with copies of up to 12 % edited words, one dense family, and a passage that many share."""
    rng = np.random.default_rng(17)
    word = [f"w{i}" for i in range(3000)]
    texts, common = [], " ".join(rng.choice(word, 12))
    for family in range(30):
        base = rng.choice(word, int(rng.integers(40, 400))).tolist()
        for copy in range(25 if family == 0 else 4):
            new = list(base)
            for at in rng.choice(len(base), int(len(base) * rng.uniform(0, 0.12) ** 1.5) + (copy > 0), replace=False):
                new[at] = str(rng.choice(word))
            texts.append(" ".join(new) + (f" {common}" if family % 3 == 0 else ""))
    return [texts[i] for i in rng.permutation(len(texts))] + ["", None, "two words"]


@pytest.mark.parametrize("which, block", [("edited", 1000), ("edited", 4), ("real", 1000)])
def test_near_duplicates_equal_brute_force_jaccard(spark, sf, monkeypatch, which, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    texts = edited_copies() if which == "edited" else [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()]
    want, far = survivors(texts)
    assert len(far) > (20 if which == "edited" else 0)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert sorted(r["doc_id"] for r in simhash.drop_near_duplicates(df).collect()) == want


@pytest.mark.parametrize(
    "kind, said",
    [
        *[("email", x) for x in ("jane@example[dot]com", "jane@example (dot) com", "jane@example dot com", "jane@mail[.]example[.]com", "jane < at > example.com", "jane { at } example.com", "jane {AT} example {DOT} com", "jane ( @ ) example.com", "jane  arroba  example  punto  com", "jane (  at  ) example.com")],
        *[("ip", x) for x in ("192[.]168[.]0[.]1", "192.168.0[.]1", "10 dot 0 dot 0 dot 1", "10 (dot) 0 (dot) 0 (dot) 1", "10 Punkt 0 Punkt 0 Punkt 1")],
    ],
)
def test_disguised_signs(kind, said):
    for text in (said, f"say: {said}, please", "words without any sign " * 20 + said + " and more words" * 20):
        assert pii.base_spans(text) == [] and [(k, text[s:e]) for s, e, k in pii.disguised_spans(text, [])] == [(kind, said)]


def test_disguises_of_any_length():
    """An identifier longer than the neighbourhood of its trigger is found whole; a long number is not cut into a card."""
    local = "a.b" * 100
    text = f"x {local} (at) example (dot) com"
    assert [(k, s, e) for s, e, k in pii.disguised_spans(text, [])] == [("email", 2, len(text))]
    for said, kind, want in (("mail jane (at)\nexample\n[dot]\ncom now", "email", "jane (at)\nexample\n[dot]\ncom"), ("call ip 10.¹.²³.4 now", "ip", "10.¹.²³.4")):
        assert [(k, said[s:e]) for s, e, k in pii.disguised_spans(said, [])] == [(kind, want)]
    for gap in (1, 60, 400):  # nothing is too far apart
        said = f"jane{' ' * gap}(at){' ' * gap}example.com"
        assert [(k, said2) for said2, k in ((f"x {said} y"[s:e], k) for s, e, k in pii.disguised_spans(f"x {said} y", []))] == [("email", said)]
    for n in (19, 60, 400, 2000):
        digits = "4 1" * n + "１"
        assert [k for _, _, k in pii.disguised_spans("no " + digits, pii.base_spans("no " + digits)) if k == "card"] == []
    assert pii.disguised_spans("x" * 200_000 + "１" * 1000 + "x" * 200_000, []) == []


def test_signs_that_disguise_nothing():
    for text in ("a point of order", "300 dot 1 dot 2 dot 3", "1 dot 2 dot 3", "see (.) and [at] once", "jane@example.com dot the i", "he was at the point < at > last"):
        assert pii.disguised_spans(text, pii.base_spans(text)) == []
