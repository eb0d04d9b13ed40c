"""The Merkle manifest against trees built in memory."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from privlens.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def tree(hashes, fanout):
    """Levels of digests, lowest first."""
    levels = [hashes]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][i : i + fanout]) for i in range(0, len(levels[-1]), fanout)])
    return levels


def proof(levels, at, fanout):
    out = []
    for level in levels[:-1]:
        first = at // fanout * fanout
        out.append((level[first:at], level[at + 1 : first + fanout]))
        at //= fanout
    return out


def fold(digest, steps):
    for left, right in steps:
        digest = H(*left, digest, *right)
    return digest


def brute(rows, fanout, tampered=True):
    """Sorted results for rows with distinct leaves of an id or equal ones."""
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees, order = [], []
    for g in names:
        of = sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        order.append(of)
        trees.append(tree([leaf(r) for r in of], fanout))
    top = tree([t[-1][0] for t in trees], fanout)
    out = []
    for k, (of, t) in enumerate(zip(order, trees)):
        for i, r in enumerate(of):
            steps = proof(t, i, fanout) + proof(top, k, fanout)
            hit = tampered and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None
            changed = leaf((*r[:3], r[3] + hit if r[3] is not None else None, r[4]))
            siblings = "".join(x for left, right in steps for x in (*left, *right))
            out.append((r[0], leaf(r), t[-1][0], top[-1][0], siblings, fold(changed, steps), not hit))
    return sorted(out, key=str)


def rows_of(n):
    langs = ["en"] * 9 + ["de", None, "é", "z", ""]
    out = [(i, None if i % 5 == 0 else f"s{i % 3}", langs[i * 7 % len(langs)], None if i % 4 == 1 else i, None if i % 6 == 0 else "ü" * (i % 9)) for i in range(n)]
    return out + [(None, None, None, None, None), (None, "a", "en", 3, "x"), (None, "b", "en", 3, "y"), (8, "again", "en", 1, "t"), (9, "long", "single", 2**63 - 1, "w " * 200_000)]


@pytest.mark.parametrize("n, fanout, levels", [(120, 2, 7), (333, 2, 2), (200, 3, 1), (90, 5, 2), (0, 2, 3)])
def test_manifest_equals_brute_force(spark, n, fanout, levels):
    rows = rows_of(n)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5).withColumn("grp", F.lit("clash")).withColumn("pos", F.lit(1)).withColumn("digest", F.lit("clash"))
    found = merkle.manifest(df, merkle.one_more(df), fanout=fanout, levels=levels)
    assert sorted(map(tuple, found.collect()), key=str) == brute(rows, fanout)
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof", "folded_root", "verified"]


def test_repeated_rows_are_leaves_each(spark):
    """Many equal rows: they may stand in any order, so the results are equal as a whole."""
    rows = [(1, "s", "en", 5, "same")] * 40 + [(2, "s", "en", 5, "other")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert sorted(map(tuple, merkle.manifest(df, levels=2).collect()), key=str) == brute(rows, 2, tampered=False)


def test_any_change_is_found(spark):
    df = spark.createDataFrame(rows_of(60), SCHEMA)
    changed = merkle.manifest(df, {"text": F.concat(F.coalesce(df["text"], F.lit("")), F.lit("."))}, levels=3)
    assert changed.where("verified").count() == 0
    kept = merkle.manifest(df, levels=3)
    assert kept.where("not verified").count() == 0 and kept.select("root").distinct().count() == 1


def test_nothing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert merkle.manifest(empty, merkle.one_more(empty)).count() == 0
