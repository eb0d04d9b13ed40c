"""Embedding near-duplicates by PCA-ordered, tiled cosine comparison.

Vectors are scaled to unit length and rotated to principal axes, so that the leading coordinates carry
most of every product. Equal vectors fold into one class. Classes of one label fall into grid cells
over the leading axes; a class also visits the neighbouring cells within reach of the threshold, and
crowded cells are cut into blocks, so a task compares one bounded block of residents with one bounded
block of queries. In a tile the products are accumulated axis block by axis block: after each, the
Cauchy-Schwarz bound of the rest (product of the suffix norms) drops the pairs that cannot reach the
threshold. A tile reports link counts and a spanning forest, never its pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from privlens.llm.common import configure, materialize
from privlens.llm.components import connected_components, forest

#: Rows of a block; a tile is one block of residents against one of queries.
TILE = 2048
#: Values of the bounded sample that the axes are fitted on (vectors times dimensions).
SAMPLE_VALUES = 1 << 20
#: Axes accumulated before each bound; below this share of pairs left they are finished one by one.
AXES, FEW = 16, 0.05
#: Slack of the bounds, and the band about the threshold in which a product is computed anew from the vectors as given.
SLACK, NEAR = 1e-9, 1e-9


def axes(vectors: np.ndarray) -> np.ndarray:
    """Rotation to principal axes, largest second moment first (columns); no centring, so products are kept."""
    if not len(vectors):
        return np.eye(vectors.shape[1])
    values, basis = np.linalg.eigh(vectors.T @ vectors / len(vectors))
    return np.ascontiguousarray(basis[:, np.argsort(-values, kind="stable")])


def linked(a: np.ndarray, b: np.ndarray, threshold: float, exact) -> tuple[np.ndarray, np.ndarray]:
    """Pairs ``(i, j)`` of rotated unit rows with cosine of at least ``threshold``; ``exact(i, j)`` settles products beside it."""
    d = a.shape[1]
    suffix_a, suffix_b = (np.sqrt(np.maximum(np.cumsum((x * x)[:, ::-1], axis=1)[:, ::-1], 0)) for x in (a, b))
    sums = np.zeros((len(a), len(b)))
    at = 0
    while True:
        end = min(d, at + AXES)
        sums += a[:, at:end] @ b[:, at:end].T
        at = end
        if at == d:
            i, j = np.nonzero(sums >= threshold - NEAR)
            s = sums[i, j]
            break
        alive = sums + np.outer(suffix_a[:, at], suffix_b[:, at]) >= threshold - SLACK
        if np.count_nonzero(alive) <= FEW * alive.size:
            i, j = np.nonzero(alive)
            s = sums[i, j]
            while at < d and len(i):
                end = min(d, at + AXES)
                s += np.einsum("ij,ij->i", a[i, at:end], b[j, at:end])
                at = end
                if at < d:
                    on = s + suffix_a[i, at] * suffix_b[j, at] >= threshold - SLACK
                    i, j, s = i[on], j[on], s[on]
            on = s >= threshold - NEAR
            i, j, s = i[on], j[on], s[on]
            break
    close = np.flatnonzero(s < threshold + NEAR)
    if len(close):
        keep = np.ones(len(s), bool)
        keep[close] = exact(i[close], j[close])
        i, j = i[keep], j[keep]
    return i, j


def _unit(values: np.ndarray) -> np.ndarray:
    top = np.abs(values).max(axis=1, keepdims=True)
    values = values / top
    return values / np.sqrt((values * values).sum(axis=1, keepdims=True))


def embedding_components(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = 0.98) -> DataFrame:
    """``(id, n_links, component_id, kept)`` for every row of ``df``.

    Two rows link if their labels are equal and not null, their vectors have the same length and their
    cosine in double precision is at least ``threshold``. A vector that is null, empty, zero or holds a
    null or non-finite component links with nothing. ``n_links`` counts the other rows linked directly,
    equal vectors included; ``component_id`` is the smallest id reachable, itself included; ``kept``
    says whether it is the row's own id. Null ids take part but name no component unless all of one are
    null. Other columns are ignored. An empty table gives an empty result.
    """
    configure(df.sparkSession)
    v = df[vector].cast("array<double>")
    fit = F.coalesce((F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x)) & F.exists(v, lambda x: x != 0.0) & df[label].isNotNull(), F.lit(False))
    src = df.select(df[id_col].alias("id"), df[label].cast("string").alias("label"), df[vector].cast("array<double>").alias("v"), fit.alias("fit"))
    rows = src.withColumns({"h1": F.when(F.col("fit"), F.xxhash64("label", "v")), "h2": F.when(F.col("fit"), F.xxhash64(F.lit(1), "label", "v"))})
    rows = materialize(rows, "vectors")
    # rows that link with nothing are their own components
    classes = rows.where("fit").groupBy("h1", "h2").agg(F.first("label").alias("label"), F.first("v").alias("v"), F.count("*").alias("copies"), F.min("id").alias("low"))
    classes = materialize(classes.withColumn("cls", F.monotonically_increasing_id()).withColumn("d", F.size("v")), "classes")
    found = materialize(_tiles(classes, threshold), "tiles")
    counts = found.where("b is null").groupBy(F.col("a").alias("cls")).agg(F.sum("links").alias("links"))
    roots = connected_components(found.where("b is not null").select("a", "b"))
    of = classes.select("h1", "h2", "cls", "copies", "low").join(counts, "cls", "left").join(roots, F.col("cls") == F.col("node"), "left")
    of = of.select("h1", "h2", "low", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "cls").alias("root"))
    low = of.groupBy("root").agg(F.min("low").alias("component_id"))
    of = of.join(low, "root").select("h1", "h2", "n_links", "component_id")
    out = rows.select("id", "h1", "h2").join(of, ["h1", "h2"], "left")
    component = F.when(F.col("n_links").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))


def _tiles(classes: DataFrame, threshold: float) -> DataFrame:
    """``(a, b, links)``: spanning links with ``b``, link counts of class ``a`` (in rows) without."""
    reach = math.sqrt(max(0.0, 2.0 - 2.0 * threshold)) + 1e-9
    width = 2.0 * reach
    rotations = {}
    for r in classes.groupBy("d").count().orderBy(F.desc("count")).limit(16).collect():
        d = int(r["d"])
        sample = classes.where(F.col("d") == d).orderBy(F.xxhash64("h1", F.lit(5))).limit(max(64, SAMPLE_VALUES // d)).select("v").collect()
        rotations[d] = axes(_unit(np.array([s["v"] for s in sample])))
    shared = classes.sparkSession.sparkContext.broadcast(rotations)  # at most 16 square matrices

    def place(batches):
        names = ["cls", "label", "d", "copies", "unit", "raw", "x0", "x1"]
        types = [pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.float64(), pa.float64()]
        for batch in batches:
            dims = batch.column("d").to_numpy()
            for d in np.unique(dims).tolist():
                on = pa.array(np.flatnonzero(dims == d))
                raw = batch.column("v").take(on).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
                unit = _unit(raw)
                if d in shared.value:
                    unit = unit @ shared.value[d]
                x1 = unit[:, 1] if d > 1 else np.zeros(len(unit))
                cols = [batch.column("cls").take(on), batch.column("label").take(on), batch.column("d").take(on), batch.column("copies").take(on), [u.tobytes() for u in unit], [u.tobytes() for u in raw], unit[:, 0], x1]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(cols, types)], names=names)

    placed = classes.select("cls", "label", "d", "copies", "v").mapInArrow(place, "cls long, label string, d int, copies long, unit binary, raw binary, x0 double, x1 double")
    cell = lambda x: F.floor(x / F.lit(width)).cast("int")
    near = lambda x: F.sequence(cell(F.col(x) - reach), cell(F.col(x) + reach))
    placed = placed.withColumns({"c0": cell(F.col("x0")), "c1": cell(F.col("x1"))})
    seen = placed.withColumn("g0", F.explode(near("x0"))).withColumn("g1", F.explode(near("x1")))
    seen = seen.withColumn("resident", (F.col("c0") == F.col("g0")) & (F.col("c1") == F.col("g1")))
    # a cell of n rows is cut into blocks; the table of cells is as small as the grid
    sizes = seen.groupBy("label", "d", "g0", "g1").agg(F.count("*").alias("n")).withColumn("blocks", F.ceil(F.col("n") / F.lit(TILE)).cast("int")).drop("n")
    seen = seen.join(sizes, ["label", "d", "g0", "g1"])
    own = F.pmod(F.xxhash64("cls", F.lit(3)), F.col("blocks")).cast("int")
    seen = seen.withColumn("own", own)
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    cols = ["label", "d", "g0", "g1", "cls", "copies", "unit", "raw"]
    as_resident = seen.where("resident").select(*cols, F.col("own").alias("i"), F.explode(every).alias("j"), F.lit(True).alias("resident"))
    as_query = seen.select(*cols, F.explode(every).alias("i"), F.col("own").alias("j"), F.lit(False).alias("resident"))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        d = int(pdf["d"].iloc[0])
        home, visit = pdf[pdf["resident"]], pdf[~pdf["resident"]]
        none = pd.DataFrame({"a": np.empty(0, np.int64), "b": pd.array([], dtype="Int64"), "links": np.empty(0, np.int64)})
        if not len(home) or not len(visit):
            return none
        unit = lambda p: np.frombuffer(b"".join(p["unit"]), np.float64).reshape(-1, d)
        raw = lambda p: np.frombuffer(b"".join(p["raw"]), np.float64).reshape(-1, d)
        ra, rb = raw(home), raw(visit)

        def exact(i, j):
            x, y = ra[i], rb[j]
            return np.einsum("ij,ij->i", x, y) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1))) >= threshold

        ca, cb, copies = home["cls"].to_numpy(np.int64), visit["cls"].to_numpy(np.int64), visit["copies"].to_numpy(np.int64)
        i, j = linked(unit(home), unit(visit), threshold, exact)
        on = ca[i] != cb[j]
        i, j = i[on], j[on]
        if not len(i):
            return none
        links = np.bincount(i, copies[j], len(ca)).astype(np.int64)
        nodes, at = np.unique(np.concatenate((ca, cb)), return_inverse=True)
        root = forest(len(nodes), at[: len(ca)][i], at[len(ca) :][j])
        tree, has = np.flatnonzero(root != np.arange(len(nodes))), np.flatnonzero(links)
        a = np.concatenate((ca[has], nodes[root[tree]]))
        b = pd.array(np.concatenate((np.zeros(len(has), np.int64), nodes[tree])), dtype="Int64")
        b[: len(has)] = pd.NA
        return pd.DataFrame({"a": a, "b": b, "links": np.concatenate((links[has], np.zeros(len(tree), np.int64)))})

    return as_resident.unionByName(as_query).groupBy("label", "d", "g0", "g1", "i", "j").applyInPandas(compare, "a long, b long, links long")


#: The registered query in DuckDB SQL, by comparing all pairs.
SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
ok AS (
  SELECT vec_id, label, e FROM v
  WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0
    AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach(a, b) AS (
  SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
low AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a)
SELECT v.vec_id, coalesce(n.n_links, 0) AS n_links, low.component_id, v.vec_id = low.component_id AS kept
FROM v JOIN low ON v.vec_id = low.vec_id LEFT JOIN n ON v.vec_id = n.vec_id
"""
