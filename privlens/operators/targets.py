"""Distance of every record to the centroid, and target selection."""

from __future__ import annotations

from collections.abc import Sequence
from enum import Enum

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from privlens.functions.scalar import epoch_ms, ratio, seeded_order, total
from privlens.operators.schema import frequency_distribution, is_numeric


class TargetType(str, Enum):
    RANDOM = "RANDOM"
    OUTLIER = "OUTLIER"
    AVERAGE = "AVERAGE"
    IMPORT = "IMPORT"


#: Numeric scalings: ``reference`` is ``(v + min) / (min + max)``, ``minmax`` is ``(v - min) / (max - min)``.
SCALINGS = ("reference", "minmax")


def vectors(df: DataFrame, key: str, attributes: Sequence[str], scaling: str = "reference") -> DataFrame:
    """``(key, x0, x1, ...)``: one double per attribute.

    Numbers and dates are scaled by the column's extremes, null counting as zero (before scaling); a
    zero denominator gives null. Categories become their relative frequency.
    """
    if scaling not in SCALINGS:
        raise ValueError(f"unknown scaling {scaling}")
    numeric = [a for a in attributes if is_numeric(df, a)]
    kinds = dict(df.dtypes)
    num = lambda a: epoch_ms(F.col(a)).cast("double") if kinds[a].startswith(("timestamp", "date")) else F.col(a).cast("double")
    out = df
    if numeric:
        bounds = df.agg(*[f(num(a)).alias(f"__{n}_{a}") for a in numeric for n, f in (("lo", F.min), ("hi", F.max))])
        out = out.crossJoin(F.broadcast(bounds))  # one row
    exprs = []
    for i, a in enumerate(attributes):
        if a in numeric:
            v, lo, hi = F.coalesce(num(a), F.lit(0.0)), F.col(f"__lo_{a}"), F.col(f"__hi_{a}")
            exprs.append((ratio(v + lo, lo + hi) if scaling == "reference" else ratio(v - lo, hi - lo)).alias(f"x{i}"))
        else:
            share = frequency_distribution(df, [a]).select(F.col("value").alias(f"__v{i}"), F.col("frequency").alias(f"__f{i}"))
            out = out.join(share, out[a].cast("string") == F.col(f"__v{i}"), "left")
            exprs.append(F.coalesce(F.col(f"__f{i}"), F.lit(0.0)).alias(f"x{i}"))
    return out.select(key, *exprs)


def distances(df: DataFrame, key: str, attributes: Sequence[str], scaling: str = "reference") -> DataFrame:
    """``(key, distance, distance_normalised)`` to the centroid: means of numbers, the largest frequency of categories.

    Normalised distances are ``(d - min) / (max - min)``, null where all are equal.
    """
    x = vectors(df, key, attributes, scaling)
    centre = x.agg(*[(F.avg if is_numeric(df, a) else F.max)(f"x{i}").alias(f"c{i}") for i, a in enumerate(attributes)])
    square = total([(F.col(f"x{i}") - F.col(f"c{i}")) * (F.col(f"x{i}") - F.col(f"c{i}")) for i in range(len(attributes))])
    d = x.crossJoin(F.broadcast(centre)).select(key, F.sqrt(square).alias("distance"))  # one row
    ends = d.agg(F.min("distance").alias("lo"), F.max("distance").alias("hi"))
    return d.crossJoin(F.broadcast(ends)).select(key, "distance", ratio(F.col("distance") - F.col("lo"), F.col("hi") - F.col("lo")).alias("distance_normalised"))


def _checked(df: DataFrame, n: int) -> None:
    if df.limit(n).count() < n:
        raise ValueError(f"{n} targets asked for, fewer rows there")


def select_targets(df: DataFrame, key: str, kind: TargetType | str, n: int, attributes: Sequence[str] = (), seed: int | str = 0, imported: DataFrame | None = None, scaling: str = "reference", check: bool = True) -> DataFrame:
    """Targets of the asked kind with their rank (1-based); ties go to the smaller key.

    OUTLIER takes the largest distances, AVERAGE the smallest, RANDOM a seeded draw, IMPORT the given ids
    that the table has (``n`` is ignored). Fewer rows than ``n`` is an error.
    """
    from pyspark.sql.window import Window

    kind = TargetType(kind)
    if kind is TargetType.IMPORT:
        if imported is None:
            raise ValueError("no imported ids")
        return df.select(key).join(imported.select(key).distinct(), key, "left_semi").select(key, F.row_number().over(Window.orderBy(key)).alias("rank"))
    if check:
        _checked(df, n)
    if kind is TargetType.RANDOM:
        top = df.select(key).distinct().withColumn("__o", seeded_order(seed, "targets", F.col(key))).orderBy("__o", key).limit(n)
        return top.select(key, F.row_number().over(Window.orderBy("__o", key)).alias("rank"))
    d = distances(df, key, attributes, scaling).withColumn("distance", F.round("distance", 9))
    order = F.desc("distance") if kind is TargetType.OUTLIER else F.asc("distance")
    # the window sees the n rows that are left, not the table
    return d.orderBy(order, key).limit(n).select(key, "distance", F.row_number().over(Window.orderBy(order, key)).alias("rank"))
