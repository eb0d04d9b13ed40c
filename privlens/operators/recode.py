"""Recoding: suppression of violating records, micro-aggregation and local recoding."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from privlens.functions.scalar import STAR
from privlens.operators.classes import SUPPRESSED
from privlens.operators.hierarchy import LEVELS, Hierarchy, generalize, generalize_each
from privlens.operators.privacy import Model, is_drawn, satisfied
from privlens.sources.shared import discard, materialize, shared_dir


def suppress(df: DataFrame, qis: Sequence[str], classes: DataFrame, by: Sequence[str] = (), identifying: Sequence[str] = ()) -> DataFrame:
    """``df`` with ``is_suppressed``; quasi-identifiers of rows in classes that are not ``ok`` become ``*``, identifying columns always do."""
    keys = [*by, *qis]
    side = classes.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], "ok")
    on = reduce(lambda a, b: a & b, [df[k].eqNullSafe(side[f"__k{i}"]) for i, k in enumerate(keys)])
    joined = df.join(side, on, "left").withColumn(SUPPRESSED, ~F.coalesce(F.col("ok"), F.lit(False)))
    flag = F.col(SUPPRESSED)
    cells = {q: F.when(flag, F.lit(STAR)).otherwise(F.col(q).cast("string")) for q in qis} | {c: F.lit(STAR) for c in identifying}
    return joined.select(*[cells[c].alias(c) if c in cells else F.col(c) for c in df.columns if c != SUPPRESSED], flag)


def release(df: DataFrame, levels: Mapping[str, int], hierarchies: Mapping[str, Hierarchy], models: Sequence[Model], sensitive: Sequence[str] = (), by: Sequence[str] = (), identifying: Sequence[str] = (), key: str | None = None, seed: int | str = 0) -> DataFrame:
    """Generalize to ``levels``, then suppress the classes that violate a model.

    With differential privacy among the models only a sample drawn by ``key`` is released; the rows outside it are
    suppressed, and all models hold for the sample.
    """
    return _violations_suppressed(generalize(df, levels, hierarchies), list(levels), models, sensitive, by, identifying, key, seed)


def release_each(df: DataFrame, levels: DataFrame, names: Sequence[str], hierarchies: Mapping[str, Hierarchy], models: Sequence[Model], by: Sequence[str], sensitive: Sequence[str] = (), identifying: Sequence[str] = (), key: str | None = None, seed: int | str = 0) -> DataFrame:
    """:func:`release` of every group of ``by`` at its own level vector, from ``levels(by, levels)`` in the order of ``names``; the rows keep it in :data:`LEVELS`."""
    own = df.join(levels.select(*by, F.col("levels").alias(LEVELS)), list(by))
    return _violations_suppressed(generalize_each(own, names, hierarchies), list(names), models, sensitive, by, identifying, key, seed)


def _violations_suppressed(general: DataFrame, qis: Sequence[str], models: Sequence[Model], sensitive: Sequence[str], by: Sequence[str], identifying: Sequence[str], key: str | None, seed: int | str) -> DataFrame:
    budget = next((m.parameter for m in models if m.kind == "EDDifferentialPrivacy"), None)
    if budget is None:
        return suppress(general, qis, satisfied(general, qis, models, sensitive, by), by, identifying)
    if key is None:
        raise ValueError("differential privacy draws rows by a key")
    drawn = is_drawn(key, budget, seed, by)
    inside = suppress(general.where(drawn), qis, satisfied(general.where(drawn), qis, models, sensitive, by), by, identifying)
    hidden = [F.lit(STAR).alias(c) if c in qis or c in identifying else F.col(c) for c in general.columns if c != SUPPRESSED]
    return inside.unionByName(general.where(~drawn).select(*hidden, F.lit(True).alias(SUPPRESSED)))


def identity_release(df: DataFrame) -> DataFrame:
    """The bottom node with k = 1: the input, nothing suppressed."""
    return df.withColumn(SUPPRESSED, F.lit(False))


def cell_suppression(df: DataFrame, attributes: Sequence[str], hierarchies: Mapping[str, Hierarchy] | None = None) -> DataFrame:
    """``attributes`` raised to ``*`` through their two-level hierarchies."""
    two = {a: Hierarchy.suppression(a) for a in attributes} if hierarchies is None else hierarchies
    return generalize(df, dict.fromkeys(attributes, 1), two)


#: Functions of micro-aggregation.
MICRO_AGGREGATIONS = ("ARITHMETIC_MEAN", "GEOMETRIC_MEAN", "MEDIAN", "INTERVAL", "SET", "MODE")


def micro_aggregate_expr(name: str, column: str, ignore_missing: bool = True) -> Column:
    """The aggregate of a class, as text for INTERVAL, SET and as the column's kind for others.

    Nulls are skipped, or make the result null. MODE ties go to the smallest value. The geometric mean
    is zero if a value is, and an error for negative values.
    """
    v = F.col(column)
    if name == "ARITHMETIC_MEAN":
        out = F.avg(v)
    elif name == "GEOMETRIC_MEAN":
        d = v.cast("double")
        checked = F.when(d < 0, F.raise_error(F.lit(f"{column}: a geometric mean of negative values"))).when(d > 0, F.ln(d))
        out = F.when(F.min(d) == 0, F.lit(0.0)).otherwise(F.exp(F.avg(checked)))
    elif name == "MEDIAN":
        out = F.median(v)
    elif name == "INTERVAL":
        out = F.concat(F.lit("["), F.min(v).cast("string"), F.lit(", "), F.max(v).cast("string"), F.lit("]"))
    elif name == "SET":
        out = F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(F.collect_set(v)), lambda x: x.cast("string")), ", "), F.lit("}"))
    elif name == "MODE":
        out = F.mode(v, deterministic=True)
    else:
        raise ValueError(f"unknown micro-aggregation {name}")
    return out if ignore_missing else F.when(F.count(v) == F.count(F.lit(1)), out)


def micro_aggregate(df: DataFrame, class_columns: Sequence[str], functions: Mapping[str, str], ignore_missing: bool | Mapping[str, bool] = True, by: Sequence[str] = ()) -> DataFrame:
    """``df`` with each column of ``functions`` replaced by its class's aggregate.

    ``class_columns`` define the class: with clustering they include the (generalized) attribute itself,
    without it they do not. Aggregates are computed per class and joined back. ``ignore_missing`` holds for all
    columns, or names those that differ.
    """
    skip = ignore_missing if isinstance(ignore_missing, Mapping) else dict.fromkeys(functions, ignore_missing)
    keys = [*by, *class_columns]
    # a class column may be aggregated too: its value in the class is what it was grouped by
    agg = df.groupBy(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]).agg(*[micro_aggregate_expr(f, c, skip.get(c, True)).alias(f"__a_{c}") for c, f in functions.items()])
    on = reduce(lambda a, b: a & b, [df[k].eqNullSafe(agg[f"__k{i}"]) for i, k in enumerate(keys)])
    joined = df.join(agg, on)
    return joined.select(*[F.col(f"__a_{c}").alias(c) if c in functions else df[c] for c in df.columns])


def local_recoding(df: DataFrame, key: str, rounds: Sequence[Mapping[str, int]], hierarchies: Mapping[str, Hierarchy], models: Sequence[Model], sensitive: Sequence[str] = (), checkpoint: bool = False) -> DataFrame:
    """Release in rounds: rows that one round suppresses are released by the next one's levels, if their classes there satisfy the models.

    ``rounds`` are level vectors, finest first. With ``checkpoint`` each remainder is written to the
    session's checkpoint folder, so that long loops keep a short lineage. What no round releases stays
    suppressed.
    """
    if checkpoint:
        shared_dir(df.sparkSession)
    done, rest = None, df
    for i, levels in enumerate(rounds):
        out = release(rest, levels, hierarchies, models, sensitive)
        if i + 1 < len(rounds):
            if checkpoint:
                out = out.checkpoint()
            live = out.where(~F.col(SUPPRESSED))
            rest = rest.join(out.where(F.col(SUPPRESSED)).select(key), key, "left_semi")
        else:
            live = out
        done = live if done is None else done.unionByName(live)
    return done


def local_recoding_each(df: DataFrame, key: str, by: Sequence[str], find, names: Sequence[str], hierarchies: Mapping[str, Hierarchy], models: Sequence[Model], iterations: int, sensitive: Sequence[str] = (), identifying: Sequence[str] = (), seed: int | str = 0) -> DataFrame:
    """Local recoding with a search per round, for every group of ``by`` at once; a written table whose rows keep their level vectors in :data:`LEVELS`.

    The remainder, what a round suppressed, is one table of all groups' rows. ``find(rest)`` gives ``(by, levels)`` for the groups that are still
    in it. A group leaves after a round that released fewer than ``1 / iterations`` of its rows, or all.
    """
    by = list(by)
    least = materialize(df.groupBy(*by).agg(F.ceil(F.count("*") / iterations).alias("__least")), "least")
    rest, parts, spent = df, [], []
    for turn in range(iterations):
        levels = find(rest)
        out = materialize(release_each(rest, levels, names, hierarchies, models, by, sensitive, identifying, key, seed), "round")
        spent.append(out)
        counts = out.groupBy(*by).agg(F.count_if(~F.col(SUPPRESSED)).alias("__live"), F.count_if(F.col(SUPPRESSED)).alias("__gone"))
        going = counts.join(least, by).where("__live >= __least and __gone > 0").select(*by)
        if turn + 1 == iterations:
            going = going.where("false")
        left = out.where(F.col(SUPPRESSED)).select(*by, key).join(going, by, "left_semi")
        after = materialize(rest.join(left, [*by, key], "left_semi"), "remainder")
        # what a group that leaves still suppresses stays in its release
        ends = out.where(F.col(SUPPRESSED)).join(after.select(*by).distinct(), by, "left_anti")
        parts.append(out.where(~F.col(SUPPRESSED)).unionByName(ends.select(*out.columns)))
        spent += [levels, after]
        rest = after
        if rest.isEmpty():
            break
    whole = materialize(reduce(lambda a, b: a.unionByName(b), parts), "recoded")
    discard(least, *spent)
    return whole
