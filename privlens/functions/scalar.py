"""Column helpers shared by the operators; all stay inside code generation."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The label of a suppressed cell.
STAR = "*"


def r6(value: Column) -> Column:
    """Rounded to six places, so that sums in another order compare equal; never minus zero."""
    return F.round(value, 6) + F.lit(0.0)


def ratio(a: Column, b: Column) -> Column:
    """``a / b``, null where ``b`` is zero (division by zero raises in ANSI mode)."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def total(columns: Sequence[Column]) -> Column:
    return reduce(lambda x, y: x + y, columns)


def seeded_order(seed: int | str, stream: str, key: Column) -> Column:
    """A pseudo-random sort key: ``md5("seed:stream:key")``, the same on every engine and partitioning."""
    return F.md5(F.concat(F.lit(f"{seed}:{stream}:"), key.cast("string")))


def with_row_id(df: DataFrame, name: str = "row_id") -> DataFrame:
    """``df`` with a contiguous 0-based row position, for tables without a key.

    One pass counts the partitions' rows; a row's place in its partition then gives its position, and no
    row is moved. The order is the source's own.
    """
    sizes = df.groupBy(F.spark_partition_id().alias("__p")).agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("__p", before.alias("__start"))  # a row per partition
    placed = df.withColumn("__p", F.spark_partition_id()).withColumn("__i", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    return placed.join(F.broadcast(starts), "__p").select(*df.columns, (F.col("__start") + F.col("__i")).alias(name))


def with_file_row_id(scan: DataFrame, name: str = "row_id") -> DataFrame:
    """A scan of files with a contiguous 0-based row position, by file name and place in the file.

    However files are split and packed into partitions, a row has the same position. No row is moved: a block of a file
    is read in order by one task, and the blocks' counts, a row per block, give each its start.
    """
    placed = scan.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__m"))
    blocks = placed.groupBy(F.col("__file").alias("__f"), F.col("__block").alias("__b")).agg(F.min("__m").alias("__low"), F.count("*").alias("__n"))
    upto = F.sum("__n").over(Window.orderBy("__f", "__b"))  # a row per block
    starts = blocks.select("__f", "__b", (upto - F.col("__n") - F.col("__low")).alias("__shift"))
    found = placed.join(F.broadcast(starts), (F.col("__file") == F.col("__f")) & (F.col("__block") == F.col("__b")))
    return found.select(*scan.columns, (F.col("__m") + F.col("__shift")).alias(name))


def three_decimals(value: Column) -> Column:
    """``%.3f`` with ``NaN`` as text and null as ``NaN``; minus zero prints as zero."""
    clean = F.when(value == 0, F.lit(0.0)).otherwise(value)
    return F.when(value.isNull() | F.isnan(value), F.lit("NaN")).otherwise(F.format_string("%.3f", clean))


def epoch_ms(value: Column) -> Column:
    """Milliseconds since the epoch of a timestamp, with or without time zone."""
    return F.unix_millis(value.cast("timestamp"))


def scale_percent(value: Column) -> Column:
    """A share as a percentage with one decimal, half up."""
    return F.round(value * 100, 1)
