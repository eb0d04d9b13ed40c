"""Features of (many) released samples in long form, ``(by, idx, value)``.

Vectors are never built column by column: each family is an aggregation over ``(by, attribute, ...)``
joined to an index table that is made once, so one plan serves one sample or thousands.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from privlens.functions.scalar import epoch_ms, ratio
from privlens.operators.classes import SUPPRESSED
from privlens.operators.schema import is_numeric

BINS = 10


def numeric_cell(df: DataFrame, name: str) -> Column:
    """A cell as a number: ``*``, interval labels and other text are null, dates are milliseconds."""
    kind = dict(df.dtypes)[name]
    if kind == "string":
        return F.col(name).try_cast("double")
    return epoch_ms(F.col(name)).cast("double") if kind.startswith(("timestamp", "date")) else F.col(name).cast("double")


def _live(df: DataFrame) -> Column:
    return ~F.col(SUPPRESSED) if SUPPRESSED in df.columns else F.lit(True)


def _cells(df: DataFrame, by: Sequence[str], names: Sequence[str], make) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(n).alias("attribute"), make(n).alias("v")) for n in names])
    return df.select(*by, F.explode(rows).alias("c")).select(*by, "c.attribute", "c.v")


def samples_of(df: DataFrame, by: Sequence[str]) -> DataFrame:
    return df.select(*by).distinct()


def _index(spark, rows: list[tuple], ddl: str) -> DataFrame:
    """A small table of feature positions; its size depends on the configuration, not on the data."""
    return spark.createDataFrame(rows, ddl)


def naive(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], codes: DataFrame, by: Sequence[str]) -> DataFrame:
    """Three features per attribute, attributes by name: numbers mean, median, sample variance; categories the codes of the least and the most frequent value and the number of values.

    All rows count; suppressed cells are missing for numbers and the value ``*`` for categories. Frequency
    ties go to the smaller code; a value outside the dictionary has code -1.
    """
    names = sorted([*numeric, *categorical])
    spark = df.sparkSession
    aggs = []
    for i, n in enumerate(numeric):
        v = numeric_cell(df, n)
        aggs += [F.avg(v).alias(f"a{i}"), F.median(v).alias(f"b{i}"), F.var_samp(v).alias(f"c{i}")]
    parts = []
    if numeric:
        wide = df.groupBy(*by).agg(*aggs)
        rows = [F.struct(F.lit(3 * names.index(n) + j).alias("idx"), F.col(f"{x}{i}").alias("value")) for i, n in enumerate(numeric) for j, x in enumerate("abc")]
        parts.append(wide.select(*by, F.explode(F.array(*rows)).alias("r")).select(*by, "r.idx", "r.value"))
    if categorical:
        counts = _cells(df, by, categorical, lambda n: F.col(n).cast("string")).groupBy(*by, "attribute", F.col("v").alias("value")).agg(F.count("*").alias("n"))
        coded = counts.join(codes, ["attribute", "value"], "left").withColumn("code", F.coalesce("code", F.lit(-1)))
        least, most = F.min_by("code", F.struct("n", "code")), F.max_by("code", F.struct(F.col("n"), -F.col("code")))
        stats = coded.groupBy(*by, "attribute").agg(least.alias("a"), most.alias("b"), F.count("*").alias("c"))
        index = _index(spark, [(n, 3 * names.index(n)) for n in categorical], "attribute string, at int")
        rows = F.array(*[F.struct((F.col("at") + j).alias("idx"), F.col(x).cast("double").alias("value")) for j, x in enumerate("abc")])
        parts.append(stats.join(index, "attribute").select(*by, F.explode(rows).alias("r")).select(*by, "r.idx", "r.value"))
    return _union(parts)


def histogram(df: DataFrame, bounds: Mapping[str, tuple[float, float]], codes: DataFrame, categorical: Sequence[str], by: Sequence[str], bins: int = BINS, include_suppressed: bool = True) -> DataFrame:
    """Counts: first ``bins`` per numeric attribute, then one per dictionary value of each categorical one, each in given order.

    Bins have equal width between the domain's bounds, values outside go to the end bins, and a cell that
    is no number falls into bin 0. Suppressed rows are left out of numeric blocks, and of categorical ones
    unless ``include_suppressed``. Bounds closer than 1e-6 are an error.
    """
    flat = [n for n, (lo, hi) in bounds.items() if abs(hi - lo) < 1e-6]
    if flat:
        raise ValueError(f"no width of domain: {flat}")
    spark, numeric = df.sparkSession, list(bounds)
    parts = []
    if numeric:

        def bin_of(n: str) -> Column:
            lo, hi = bounds[n]
            at = F.floor((numeric_cell(df, n) - lo) / ((hi - lo) / bins))
            return F.coalesce(F.least(F.greatest(at, F.lit(0)), F.lit(bins - 1)), F.lit(0)).cast("int")

        counts = _cells(df.where(_live(df)), by, numeric, bin_of).groupBy(*by, "attribute", "v").agg(F.count("*").alias("n"))
        index = _index(spark, [(n, b, i * bins + b) for i, n in enumerate(numeric) for b in range(bins)], "attribute string, v int, idx int")
        parts.append(_filled(samples_of(df, by), index, counts, by, ["attribute", "v"]))
    if categorical:
        rows = df if include_suppressed else df.where(_live(df))
        counts = _cells(rows, by, categorical, lambda n: F.col(n).cast("string")).groupBy(*by, "attribute", F.col("v").alias("value")).agg(F.count("*").alias("n"))
        parts.append(_filled(samples_of(df, by), dictionary_index(codes, categorical, bins * len(numeric)), counts, by, ["attribute", "value"]))
    return _union(parts)


def dictionary_index(codes: DataFrame, categorical: Sequence[str], start: int) -> DataFrame:
    """``(attribute, value, idx)``: dictionary values of each attribute in code order, attributes in given order."""
    order = _index(codes.sparkSession, [(n, i) for i, n in enumerate(categorical)], "attribute string, o int")
    sizes = codes.join(order, "attribute").groupBy("attribute", "o").agg(F.count("*").alias("k"))
    before = sizes.alias("a").join(sizes.alias("b"), F.col("b.o") < F.col("a.o"), "left").groupBy("a.attribute").agg(F.coalesce(F.sum("b.k"), F.lit(0)).alias("at"))
    return codes.join(before, "attribute").select("attribute", "value", (F.lit(start) + F.col("at") + F.col("code")).cast("int").alias("idx"))


def _filled(samples: DataFrame, index: DataFrame, counts: DataFrame, by: Sequence[str], on: Sequence[str]) -> DataFrame:
    """Every position of every sample, zero where nothing was counted: samples times configured positions is the result's own size."""
    return samples.crossJoin(index).join(counts, [*by, *on], "left").select(*by, "idx", F.coalesce(F.col("n"), F.lit(0)).cast("double").alias("value"))


def correlation(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], codes: DataFrame, by: Sequence[str]) -> DataFrame:
    """The strict upper triangle of the Pearson matrix over live rows: numbers first, then a 0/1 column per dictionary value; undefined correlations are 0.

    Only sums are formed: counts and co-occurrences for 0/1 columns, so no one-hot matrix is built. A cell
    that is no number counts as 0.
    """
    live = df.where(_live(df))
    spark = df.sparkSession
    index = _index(spark, [(n, "", i) for i, n in enumerate(numeric)], "attribute string, value string, pos int")
    if categorical:
        index = index.unionByName(dictionary_index(codes, categorical, len(numeric)).withColumnRenamed("idx", "pos"))
    size = index.agg(F.count("*").alias("d"))
    named = live.select(*by, *[F.coalesce(numeric_cell(df, n), F.lit(0.0)).alias(n) for n in numeric], *[F.col(c).cast("string").alias(c) for c in categorical])
    rows = named.groupBy(*by).agg(F.count("*").alias("n"))
    x = lambda n: F.col(n)
    tag = lambda a, v, b, w, s: F.struct(F.lit(a).alias("a1"), v.alias("v1"), F.lit(b).alias("a2"), w.alias("v2"), s.alias("s"))
    none = F.lit("")
    firsts, pairs = [], []
    for n in numeric:
        firsts.append(F.struct(F.lit(n).alias("attribute"), none.alias("value"), x(n).alias("s"), (x(n) * x(n)).alias("q")))
    for c in categorical:
        firsts.append(F.struct(F.lit(c).alias("attribute"), F.col(c).alias("value"), F.lit(1.0).alias("s"), F.lit(1.0).alias("q")))
    every = [*numeric, *categorical]
    for i, a in enumerate(every):
        for b in every[i + 1 :]:
            va, vb = (none if a in numeric else F.col(a)), (none if b in numeric else F.col(b))
            product = (x(a) if a in numeric else F.lit(1.0)) * (x(b) if b in numeric else F.lit(1.0))
            pairs.append(tag(a, va, b, vb, product))
    one = named.select(*by, F.explode(F.array(*firsts)).alias("f")).groupBy(*by, "f.attribute", "f.value").agg(F.sum("f.s").alias("sx"), F.sum("f.q").alias("sxx"))
    two = named.select(*by, F.explode(F.array(*pairs)).alias("p")).groupBy(*by, F.col("p.a1").alias("a1"), F.col("p.v1").alias("v1"), F.col("p.a2").alias("a2"), F.col("p.v2").alias("v2")).agg(F.sum("p.s").alias("sxy"))
    sums = samples_of(df, by).crossJoin(index).join(one, [*by, "attribute", "value"], "left").select(*by, "attribute", "value", "pos", F.coalesce("sx", F.lit(0.0)).alias("sx"), F.coalesce("sxx", F.lit(0.0)).alias("sxx"))
    left, right = (sums.select(*by, *[F.col(c).alias(f"{c}{k}") for c in ("attribute", "value", "pos", "sx", "sxx")]) for k in (1, 2))
    grid = left.join(right, list(by)).where("pos1 < pos2")
    two = two.withColumnsRenamed({"a1": "attribute1", "v1": "value1", "a2": "attribute2", "v2": "value2"})
    grid = grid.join(two, [*by, "attribute1", "value1", "attribute2", "value2"], "left").join(rows, list(by), "left").crossJoin(F.broadcast(size))  # one row
    n, sxy = F.coalesce(F.col("n"), F.lit(0)).cast("double"), F.coalesce(F.col("sxy"), F.lit(0.0))
    va, vb = n * F.col("sxx1") - F.col("sx1") * F.col("sx1"), n * F.col("sxx2") - F.col("sx2") * F.col("sx2")
    tiny = lambda v, k: v <= 1e-9 * F.greatest(n * F.col(f"sxx{k}"), F.lit(1e-300))
    r = F.when(tiny(va, 1) | tiny(vb, 2), F.lit(0.0)).otherwise(ratio(n * sxy - F.col("sx1") * F.col("sx2"), F.sqrt(F.greatest(va, F.lit(0.0))) * F.sqrt(F.greatest(vb, F.lit(0.0)))))
    at = (F.col("pos1") * (2 * F.col("d") - F.col("pos1") - 1) / 2 + F.col("pos2") - F.col("pos1") - 1).cast("int")
    return grid.select(*by, at.alias("idx"), F.coalesce(r, F.lit(0.0)).alias("value"))


def feature_count(kind: str, n_numeric: int, sizes: Sequence[int], bins: int = BINS) -> int:
    """Length of a vector; ``sizes`` are the dictionary sizes of the categorical attributes."""
    d = n_numeric + sum(sizes)
    per = {"NAIVE": 3 * (n_numeric + len(sizes)), "HISTOGRAM": bins * n_numeric + sum(sizes), "CORRELATION": d * (d - 1) // 2}
    return sum(per.values()) if kind == "ENSEMBLE" else per[kind]


def ensemble(parts: Sequence[tuple[DataFrame, int]], by: Sequence[str]) -> DataFrame:
    """Feature tables laid end to end; each comes with its length."""
    at, shifted = 0, []
    for df, n in parts:
        shifted.append(df.select(*by, (F.col("idx") + at).alias("idx"), "value"))
        at += n
    return _union(shifted)


def dense(features: DataFrame, by: Sequence[str]) -> DataFrame:
    """``(by, features array<double>)`` in index order; null values are 0."""
    cells = F.array_sort(F.collect_list(F.struct("idx", F.coalesce("value", F.lit(0.0)).alias("value"))))
    return features.groupBy(*by).agg(cells.alias("c")).select(*by, F.col("c.value").alias("features"))


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def split_kinds(df: DataFrame, names: Sequence[str]) -> tuple[list[str], list[str]]:
    numeric = [n for n in names if is_numeric(df, n)]
    return numeric, [n for n in names if n not in numeric]
