"""Seeded sampling: every draw is an order by a keyed digest, so it repeats on any partitioning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from privlens.functions.scalar import seeded_order


def sample_size(rows: int, fraction: float, absolute: int) -> int:
    """A relative size wins over an absolute one; both are cut down to whole rows and to the table."""
    return min(rows, int(rows * fraction) if fraction > 0 else absolute)


def ranked(df: DataFrame, key: str, seed: int | str, stream: str, by: Sequence[str] = (), out: str = "rank") -> DataFrame:
    """``df`` with the 0-based position of each row in a seeded permutation, per group of ``by``.

    Without ``by`` the permutation is that of the whole table: ranks come from a range-partitioned sort
    whose partition sizes are counted first, so no task sees all rows.
    """
    order = seeded_order(seed, stream, F.col(key))
    if by:
        w = Window.partitionBy(*by).orderBy("__order", key)
        return df.withColumn("__order", order).withColumn(out, (F.row_number().over(w) - 1).cast("long")).drop("__order")
    # bucket by the leading digest digits: a bucket's first rank is the count of all smaller buckets
    keyed = df.withColumn("__order", order).withColumn("__bucket", F.conv(F.substring("__order", 1, 3), 16, 10).cast("int"))
    sizes = keyed.groupBy("__bucket").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("__bucket", before.alias("__start"))  # at most 4096 rows
    w = Window.partitionBy("__bucket").orderBy("__order", key)
    return keyed.join(F.broadcast(starts), "__bucket").withColumn(out, (F.col("__start") + F.row_number().over(w) - 1).cast("long")).drop("__order", "__bucket", "__start")


def rows_of(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows whose key is in ``ids``, all columns kept."""
    return df.join(ids.select(key).distinct(), key, "left_semi")


def without(ids: DataFrame, target: int | Column, key: str) -> DataFrame:
    """``ids`` without one target."""
    return ids.where(F.col(key) != target)


def subsample(ids: DataFrame, key: str, n: int, seed: int | str, stream: str = "subsample") -> DataFrame:
    """``n`` of ``ids`` without replacement (all of them if there are fewer): a bounded top-n, not a full sort."""
    return ids.select(key).orderBy(seeded_order(seed, stream, F.col(key)), key).limit(n)


def overlapping_split(ids: DataFrame, key: str, cohort: int, background: int, overlap: float, seed: int | str, rows: int) -> DataFrame:
    """``(key, cohort boolean, background boolean)`` of the rows in either sample.

    In one permutation the cohort is the first ``cohort`` rows and the background the ``background`` rows
    from ``cohort - floor(cohort * overlap)``. ``rows`` is the table's size; a slice beyond it is an error.
    """
    start = cohort - int(cohort * overlap)
    if cohort > rows or start + background > rows:
        raise ValueError(f"samples of {cohort} and {background} rows with overlap {overlap} exceed {rows} rows")
    r = F.col("rank")
    marked = ranked(ids.select(key), key, seed, "split").select(key, (r < cohort).alias("cohort"), ((r >= start) & (r < start + background)).alias("background"))
    return marked.where("cohort or background")


def overlap_size(cohort: int, background: int, overlap: float) -> int:
    return min(int(cohort * overlap), background)


def paired_samples(pool: DataFrame, key: str, target: int, n: int, seed: int | str, stream: str = "pair") -> DataFrame:
    """``(key, target_in)``: a sample of ``n`` without the target, and the same sample with one row swapped for the target.

    The row that goes is the last of the seeded order; a sample needs two rows at least.
    """
    if n < 2:
        raise ValueError("a paired sample needs two rows at least")
    order = seeded_order(seed, stream, F.col(key))
    out = pool.where(F.col(key) != target).select(key, order.alias("__o")).orderBy("__o", key).limit(n)
    gone = out.orderBy(F.desc("__o"), F.desc(key)).limit(1)
    kept = out.join(gone.select(key), key, "left_anti")
    there = kept.select(key).unionByName(out.sparkSession.range(1).select(F.lit(target).cast(pool.schema[key].dataType).alias(key)))
    return out.select(key, F.lit(False).alias("target_in")).unionByName(there.select(key, F.lit(True).alias("target_in")))
