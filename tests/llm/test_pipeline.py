"""Each pipeline stage against a brute-force version of itself, and the whole on a small corpus with planted cases."""

import re
from collections import defaultdict

import pytest

import corpus_pipeline as cp
from privlens.llm import toxicity
from tests.llm.test_search_ops import brute_repeats
from tests.llm.test_text_ops import base_by_regex
from tests.llm.test_whole_job import survivors

KEPT = cp.COLUMNS


def as_rows(df):
    return {r["doc_id"]: tuple(r[c] for c in KEPT) for r in df.collect()}


@pytest.fixture(scope="module")
def docs(spark, sf, tmp_path_factory):
    """The small corpus with odd rows added: null and empty texts, null ids, repeated rows."""
    real = spark.read.parquet(f"{sf}/documents.parquet")
    odd = spark.createDataFrame([(90001, None, "en", "x", 0), (90002, "", None, "x", 0), (None, "only words here", "en", None, None), (90003, "short one", "en", "x", 9), (90003, "short one", "en", "x", 9), (90004, "mail a.b@c.de now", "en", "x", 17)], real.schema)
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    real.unionByName(odd).write.parquet(path)
    return spark.read.parquet(path)


def test_toxicity_stage(spark, sf, docs):
    model = toxicity.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    high = {r["doc_id"] for r in toxicity.score(docs, model).collect() if r["score"] >= 0.7}
    out = cp.drop_toxic(spark, docs, sf)
    assert out.columns == KEPT and len(high) < docs.count() / 3
    assert {r["doc_id"] for r in out.collect()} == {r["doc_id"] for r in docs.collect()} - high


def test_near_duplicate_stage(spark, sf, docs):
    """Groups by both rules: fingerprints at most 3 bits apart, and shingle sets with a Jaccard similarity of 0.8 and more."""
    rows = sorted(docs.collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0))
    want, _ = survivors([r["text"] for r in rows])
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in cp.keep_one_of_each(spark, docs, sf).collect())
    assert got == [(rows[i]["doc_id"] is None, rows[i]["doc_id"] or 0) for i in want]


def test_repeats_stage(spark, sf, docs):
    rows = docs.collect()
    want = []
    for r, (n, gone, kept) in zip(rows, brute_repeats([r["text"] for r in rows], 35)):
        if not gone or gone < n:
            text = (r["text"] or "") if not gone else kept
            want.append((r["doc_id"], text, r["lang"], r["source"], len(text)))
    got = [tuple(r) for r in cp.drop_repeats(spark, docs, sf).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_redaction_stage(spark, sf, docs):
    want = {}
    for r in docs.collect():
        t = r["text"]
        if t is not None:
            out, last = [], 0
            for s, e, kind in base_by_regex(t):
                if s >= last:
                    out += [t[last:s], f"[{kind.upper()}]"]
                last = max(last, e)
            t = "".join(out) + t[last:]
        want[r["doc_id"]] = (t, None if t is None else len(t))
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in cp.redact(spark, docs, sf).collect()}
    assert got == want and got[90004][0] == "mail [EMAIL] now"


def test_whole_pipeline(spark, sf):
    out = cp.run(spark, sf)
    rows = out.collect()
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    sequences = defaultdict(int)
    for r in rows:
        sequences[r["sequence_id"]] += r["length"]
    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    assert max(sequences.values()) <= 1024 and n / 2 < len({r["doc_id"] for r in rows}) <= n


def test_stage_list():
    assert [n for n, _ in cp.STAGES] == ["toxicity", "near_dedup", "substring_dedup", "pii", "packing"] and re.match(r"[a-z_]+$", cp.STAGES[0][0])
