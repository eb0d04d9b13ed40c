"""Exact deduplication against brute force, with every split of heavy and other digests."""

import hashlib
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from privlens.llm import exact

TEXTS = [None, "", "a", "A", "Ä", "ä", "é", "É", "ABC xyz", "abc XYZ", "x" * 300_000, "X" * 300_000, " a", "İ", "i̇", "ß", "ẞ", "tie"] + ["Hot Text", "hot text"] * 40


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "s") for i, t in enumerate(TEXTS)] + [(None, "null id", "s"), (None, "NULL id", "s"), (None, "hot TEXT", "s"), (7, "repeated", "s"), (7, "repeated", "s")]
    return spark.createDataFrame(rows, "doc_id long, text string, digest string").repartition(3).withColumn("__digest", F.lit("clash")).withColumn("best", F.lit(1)).withColumn("size", F.lit(2))


def brute(rows):
    norm = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    groups = defaultdict(list)
    for i, t in rows:
        groups[norm(t)].append(i)
    out = []
    for text, ids in groups.items():
        best, left = max((i for i in ids if i is not None), default=None), True
        for i in sorted(ids, key=lambda i: (i is not None, i or 0), reverse=True):
            out.append((i, best, len(ids), left, hashlib.sha256(text.encode()).hexdigest()))
            left = False
    return sorted(out, key=str)


@pytest.mark.parametrize("heavy", [0.001, 0.3, 2.0])
def test_marks_equal_brute_force(docs, monkeypatch, heavy):
    monkeypatch.setattr(exact, "HEAVY", heavy)
    got = sorted(map(tuple, exact.mark_duplicates(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=str)
    assert got == brute([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_survivors_keep_their_columns(docs):
    kept = exact.drop_duplicates(docs)
    assert kept.columns == docs.columns
    want = sorted((str(r[0]), r[4]) for r in brute([(r["doc_id"], r["text"]) for r in docs.collect()]) if r[3])
    rows = [r.asDict() for r in kept.collect()]
    assert sorted((str(r["doc_id"]), hashlib.sha256(re.sub("[A-Z]", lambda m: m[0].lower(), r["text"] or "").encode()).hexdigest()) for r in rows) == want
    assert {r["__digest"] for r in rows} == {"clash"} and {r["best"] for r in rows} == {1}


def test_nothing(docs):
    assert exact.mark_duplicates(docs.where("false")).count() == 0


def test_summary_finds_what_is_frequent(spark):
    """A digest of a third of the rows and ten of one in a hundred are found among as many rare ones, each in the fewest rows of some partitions."""
    rows = spark.range(60_000).select(F.when(F.col("id") % 3 == 0, F.lit(-1)).when(F.col("id") % 10 == 1, F.col("id") % 100).otherwise(F.col("id")).alias("k"))
    keyed = rows.repartition(7).select(F.unhex(F.sha2(F.col("k").cast("string"), 256)).alias("digest"))
    found = {bytes(r["digest"]) for r in exact.frequent(keyed).collect()}
    counts = {bytes(r["digest"]): r["count"] for r in keyed.groupBy("digest").count().where("count >= 300").collect()}
    assert len(counts) > 5 and set(counts) <= found and len(found) <= exact.MOST_HEAVY


def test_main_path_is_native_and_heavy_rows_are_not_shuffled(docs):
    plan = exact.mark_duplicates(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan and "CartesianProduct" not in plan
    assert plan.count("BroadcastHashJoin") >= 2
