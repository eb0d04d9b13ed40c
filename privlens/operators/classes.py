"""Equivalence classes of a released table, and the risk and quality figures drawn from them.

Every operator takes ``by``, leading grouping columns such as ``sample_id``: one plan serves a single
table or thousands of samples.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from privlens.functions.scalar import STAR, ratio, three_decimals
from privlens.operators.hierarchy import LEVELS, Hierarchy, attach_many

SUPPRESSED = "is_suppressed"


def live_rows(df: DataFrame) -> DataFrame:
    """Rows that are not suppressed; a table without the flag is all live."""
    return df.where(~F.col(SUPPRESSED)) if SUPPRESSED in df.columns else df


#: A column that says how many equal rows a row stands for; see :func:`row_count`.
WEIGHT = "__weight"


def row_count(df: DataFrame) -> Column:
    """The number of rows of a group: each counts once, or ``__weight`` times where the table has that column."""
    return F.sum(WEIGHT).cast("long") if WEIGHT in df.columns else F.count("*")


def equivalence_classes(df: DataFrame, qis: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """``(by, qis, class_size)`` over live rows."""
    return live_rows(df).groupBy(*by, *qis).agg(row_count(df).alias("class_size"))


def class_size_histogram(classes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``(by, class_size, n_classes)``."""
    return classes.groupBy(*by, "class_size").agg(F.count("*").alias("n_classes"))


def class_statistics(df: DataFrame, qis: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """One row (per ``by``): class count, smallest, average and largest class, live and suppressed records."""
    if SUPPRESSED not in df.columns:
        df = df.withColumn(SUPPRESSED, F.lit(False))
    # one aggregation finds classes and suppressed rows alike
    sizes = df.groupBy(*by, SUPPRESSED, *[F.when(~F.col(SUPPRESSED), F.col(q)).alias(q) for q in qis]).agg(F.count("*").alias("n"))
    live = F.when(~F.col(SUPPRESSED), F.col("n"))
    agg = [
        F.count(live).alias("n_classes"), F.min(live).alias("min_class_size"), F.avg(live).alias("avg_class_size"), F.max(live).alias("max_class_size"),
        F.coalesce(F.sum(live), F.lit(0)).alias("live_records"), F.coalesce(F.sum(F.when(F.col(SUPPRESSED), F.col("n"))), F.lit(0)).alias("suppressed_records"),
    ]
    return sizes.groupBy(*by).agg(*agg) if by else sizes.agg(*agg)


def reidentification_risk(classes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Journalist, lowest, highest, average and marketer risk and the shares of records at the extremes."""
    hist = class_size_histogram(classes, by)
    size, n = F.col("class_size"), F.col("n_classes")
    ends = hist.groupBy(*by).agg(F.min(size).alias("lo"), F.max(size).alias("hi"), F.sum(n).alias("c"), F.sum(size * n).alias("r"), F.min_by(size * n, size).alias("at_lo"), F.max_by(size * n, size).alias("at_hi"))
    one = F.lit(1.0)
    return ends.select(
        *by,
        ratio(one, F.col("lo")).alias("journalist_risk"), ratio(one, F.col("hi")).alias("minimum_risk"), ratio(F.col("at_hi"), F.col("r")).alias("records_at_lowest_risk"),
        ratio(one, F.col("lo")).alias("highest_risk"), ratio(F.col("at_lo"), F.col("r")).alias("records_at_highest_risk"),
        ratio(F.col("c"), F.col("r")).alias("average_risk"), ratio(F.col("c"), F.col("r")).alias("marketer_risk"),
    )


def _cells(df: DataFrame, attributes: Sequence[str], keep: Sequence[str], levels: Mapping[str, int] | None = None) -> tuple[DataFrame, dict[str, str]]:
    """``(keep, __a, __l, __v0, __v1, ...)``: a row per cell with its attribute's number, its level and its value, typed as it was, in its own column.

    A cell's level is its row's own where the table has :data:`LEVELS`, else the one in ``levels`` (0 without).
    """
    columns = {a: f"__v{i}" for i, a in enumerate(attributes)}
    own = levels is not None and LEVELS in df.columns
    level = lambda i, a: F.col(LEVELS)[i] if own else F.lit((levels or {}).get(a, 0))
    structs = [F.struct(F.lit(i).alias("__a"), level(i, a).alias("__l"), *[(F.col(a) if a == b else F.lit(None).cast(df.schema[b].dataType)).alias(c) for b, c in columns.items()]) for i, a in enumerate(attributes)]
    return df.select(*keep, F.explode(F.array(*structs)).alias("__c")).select(*keep, "__c.*"), columns


def _named(out: DataFrame, attributes: Sequence[str], by: Sequence[str], value: str) -> DataFrame:
    return out.select(*by, F.element_at(F.array(*map(F.lit, attributes)), F.col("__a") + 1).alias("attribute"), value)


def _used_levels(df: DataFrame, levels: Mapping[str, int], hierarchies: Mapping[str, Hierarchy]) -> dict[str, list[int]]:
    """The levels that cells may have: all where rows have their own."""
    return {a: list(range(hierarchies[a].height + 1)) if LEVELS in df.columns else [x] for a, x in levels.items()}


def _at_levels(values: DataFrame, levels: Mapping[str, Sequence[int]], hierarchies: Mapping[str, Hierarchy], columns: Mapping[str, str]) -> DataFrame:
    """``values`` once for each level of its attribute, with the ``label`` there."""
    numbers = F.coalesce(*[F.when(F.col("__a") == i, F.array(*map(F.lit, x))) for i, x in enumerate(levels.values())])
    return attach_many(values.drop("__l").withColumn("__l", F.explode(numbers)), levels, hierarchies, columns, "__a", "__l", "label")


def _leaf_counts(original: DataFrame, hierarchies: Mapping[str, Hierarchy], levels: Mapping[str, Sequence[int]]) -> DataFrame:
    """``(__a, __l, label, n_leaves, domain)`` of every attribute's levels: leaves under each label, and leaves in all."""
    observed = {a: x for a, x in levels.items() if hierarchies[a].rows is None}
    numbers = {a: i for i, a in enumerate(levels)}
    spark, parts = original.sparkSession, []
    if observed:
        cells, columns = _cells(original, list(observed), [])
        leaves = cells.where(F.coalesce(*[F.col(c).cast("string") for c in columns.values()]).isNotNull()).distinct()
        renumbered = F.element_at(F.array(*[F.lit(numbers[a]) for a in observed]), F.col("__a") + 1)
        parts.append(_at_levels(leaves, observed, hierarchies, columns).groupBy(renumbered.alias("__a"), "__l", "label").agg(F.count("*").alias("n_leaves")))
    listed = [(numbers[a], x, r[x]) for a, wanted in levels.items() if hierarchies[a].rows is not None for r in {r[0]: r for r in hierarchies[a].rows}.values() for x in wanted]
    if listed:
        parts.append(spark.createDataFrame(listed, "__a int, __l int, label string").groupBy("__a", "__l", "label").agg(F.count("*").alias("n_leaves")))
    counts = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return counts.join(F.broadcast(counts.groupBy("__a", "__l").agg(F.sum("n_leaves").alias("domain"))), ["__a", "__l"])  # a row per attribute and level


def granularity(released: DataFrame, original: DataFrame, levels: Mapping[str, int], hierarchies: Mapping[str, Hierarchy], by: Sequence[str] = ()) -> DataFrame:
    """``(by, attribute, granularity)``: 1 minus the mean share of the domain that a cell leaves open.

    A cell costs ``(leaves - 1) / (domain - 1)``; a suppressed cell costs 1, and a domain of one value costs
    nothing unless suppressed. All attributes are counted by label in one pass over the release. Where rows have
    level vectors of their own (:data:`LEVELS`, in the order of ``levels``), those count.
    """
    flag = F.col(SUPPRESSED) if SUPPRESSED in released.columns else F.lit(False)
    own = [LEVELS] if LEVELS in released.columns else []
    text = released.select(*by, *own, flag.alias("__s"), *[F.col(a).cast("string").alias(a) for a in levels])
    cells, columns = _cells(text, list(levels), [*by, "__s"], levels)
    labels = cells.groupBy(*by, "__s", "__a", "__l", F.coalesce(*columns.values()).alias("label")).agg(F.count("*").alias("n"))
    leaves = _leaf_counts(original, hierarchies, _used_levels(released, levels, hierarchies))
    cost = F.when(F.col("__s") | F.col("n_leaves").isNull(), F.lit(1.0)).otherwise(F.coalesce(ratio(F.col("n_leaves") - 1, F.col("domain") - 1), F.lit(0.0)))
    sums = labels.join(leaves, ["__a", "__l", "label"], "left").groupBy(*by, "__a").agg((1.0 - ratio(F.sum(cost * F.col("n")), F.sum("n"))).alias("granularity"))
    return _named(sums, list(levels), by, "granularity")


def nonuniform_entropy(released: DataFrame, original: DataFrame, key: str, levels: Mapping[str, int], hierarchies: Mapping[str, Hierarchy], by: Sequence[str] = ()) -> DataFrame:
    """``(by, attribute, entropy)``: 1 minus the information lost over the information there was.

    A cell loses ``-log2(f(value) / f(label))``, where ``f(label)`` counts the original records that the label
    covers; a suppressed cell's label covers all. The original holds ``-sum log2(f(value) / n)``; where that is
    zero the score is 1. Release and original are joined once; only counts per value go through the hierarchies,
    and counts of labels and tables are joined to them, so that no task holds an attribute's values.
    Where rows have level vectors of their own (:data:`LEVELS`), those count.
    """
    flag = F.col(SUPPRESSED) if SUPPRESSED in released.columns else F.lit(False)
    own = [LEVELS] if LEVELS in released.columns else []
    both = released.select(*by, *own, key, flag.alias("__s")).join(original.select(key, *levels), key)
    cells, columns = _cells(both, list(levels), [*by, "__s"], levels)
    typed = list(columns.values())
    counted = cells.groupBy(*by, "__a", "__l", *typed).agg(F.count("*").alias("cells"), F.sum(F.col("__s").cast("long")).alias("gone"))
    used = _used_levels(released, levels, hierarchies)
    labelled = attach_many(counted, used, hierarchies, columns, "__a", "__l", "label")
    per_value = counted.groupBy(*by, "__a", *typed).agg(F.sum("cells").alias("fv"))
    under = _at_levels(per_value, used, hierarchies, columns).groupBy(*by, "__a", "__l", "label").agg(F.sum("fv").alias("fl"))
    rows = per_value.groupBy(*by, "__a").agg(F.sum("fv").alias("n"))

    def looked_up(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
        side = right.select(*[F.col(c).alias(f"__r{i}") for i, c in enumerate(on)], *[c for c in right.columns if c not in on])
        same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__r{i}")) for i, c in enumerate(on)])
        return left.join(side, same).drop(*[f"__r{i}" for i in range(len(on))])

    # with one level for all rows a value is counted once
    values = looked_up(labelled, per_value, [*by, "__a", *typed]) if own else labelled.withColumn("fv", F.col("cells"))
    found = looked_up(looked_up(values, under, [*by, "__a", "__l", "label"]), rows, [*by, "__a"])
    lose = lambda of: -F.log2(F.col("fv") / F.col(of))
    lost = (F.col("cells") - F.col("gone")) * lose("fl") + F.col("gone") * lose("n")
    sums = found.groupBy(*by, "__a").agg(F.sum(lost).alias("lost"), F.sum(F.col("cells") * lose("n")).alias("had"))
    out = sums.select(*by, "__a", (1.0 - F.coalesce(ratio(F.col("lost"), F.col("had")), F.lit(0.0))).alias("entropy"))
    return _named(out, list(levels), by, "entropy")


def discernibility(df: DataFrame, qis: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Raw ``sum(size^2) + n * suppressed`` and the score ``1 - (raw - n) / (n^2 - n)``, 1 for a table of one row."""
    if SUPPRESSED not in df.columns:
        df = df.withColumn(SUPPRESSED, F.lit(False))
    sizes = df.groupBy(*by, SUPPRESSED, *[F.when(~F.col(SUPPRESSED), F.col(q)).alias(q) for q in qis]).agg(F.count("*").cast("double").alias("n"))
    gone = F.coalesce(F.sum(F.when(F.col(SUPPRESSED), F.col("n"))), F.lit(0.0))
    sums = sizes.groupBy(*by).agg(F.sum("n").alias("rows"), gone.alias("gone"), F.coalesce(F.sum(F.when(~F.col(SUPPRESSED), F.col("n") * F.col("n"))), F.lit(0.0)).alias("squares"))
    raw = F.col("squares") + F.col("rows") * F.col("gone")
    return sums.select(*by, raw.alias("discernibility_raw"), (1.0 - F.coalesce(ratio(raw - F.col("rows"), F.col("rows") * F.col("rows") - F.col("rows")), F.lit(0.0))).alias("discernibility"))


def location_and_limits(original: DataFrame, released: DataFrame, attributes: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """``(by, attribute, min, max, mean, median)``, each as ``"[raw, released]"`` text with three decimals, over live cells."""
    from privlens.operators.schema import summary_statistics

    numeric = [F.col(a).try_cast("double").alias(a) if t == "string" else F.col(a).cast("double").alias(a) for a in attributes for n, t in released.dtypes if n == a]
    raw = summary_statistics(original, attributes, by)
    after = summary_statistics(live_rows(released).select(*by, *numeric), attributes, by)
    on = [*by, "attribute"]
    both = raw.alias("r").join(after.alias("a"), on, "left")
    pair = lambda c: F.concat(F.lit("["), three_decimals(F.col(f"r.{c}")), F.lit(", "), three_decimals(F.col(f"a.{c}")), F.lit("]"))
    return both.select(*on, *[pair(c).alias(c) for c in ("min", "max", "mean", "median")])


def location_json(table: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The rows of :func:`location_and_limits` as one JSON object per group, attributes in order of name."""
    entry = F.struct("attribute", F.struct("min", "max", F.col("mean").alias("aMean"), "median").alias("v"))
    grouped = table.groupBy(*by).agg(F.array_sort(F.collect_list(entry)).alias("e"))
    return grouped.select(*by, F.to_json(F.map_from_entries("e")).alias("location_and_limits"))


def dataset_metrics(released: DataFrame, original: DataFrame, key: str, qis: Sequence[str], levels: Mapping[str, int], hierarchies: Mapping[str, Hierarchy]) -> DataFrame:
    """The 14 metrics of a released table in one row."""
    classes = equivalence_classes(released, qis)
    stats = class_statistics(released, qis).select("max_class_size", "avg_class_size", "min_class_size", "suppressed_records")
    g = granularity(released, original, levels, hierarchies).agg(F.avg("granularity").alias("granularity"))
    e = nonuniform_entropy(released, original, key, levels, hierarchies).agg(F.avg("entropy").alias("nonuniform_entropy"))
    d = discernibility(released, qis).select("discernibility")
    out = reidentification_risk(classes)
    for one_row in (stats, g, e, d):
        out = out.crossJoin(F.broadcast(one_row))  # one row each
    return out


def class_window(by: Sequence[str], qis: Sequence[str]):
    return Window.partitionBy(*by, *qis)


def star(columns: Sequence[str], when) -> dict:
    """Column expressions that put ``*`` into ``columns`` where ``when`` holds."""
    return {c: F.when(when, F.lit(STAR)).otherwise(F.col(c).cast("string")) for c in columns}


