"""Scans and sinks: delimited tables, target ids, reports, logs and the checkpoint store."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from privlens.functions.scalar import three_decimals, with_file_row_id
from privlens.operators.schema import AttributeSpec, typed_projection
from privlens.sources.config import DataConfig

#: Columns of the assessment log, in order and in the spelling that readers of such files expect.
LOG_COLUMNS = (
    "TestRun", "TargetId", "Iteration", "TrueLabel", "PredictedLabel", "PredictionProbability", "Granularity", "GranularityCategoricalAttributes", "Entropy",
    "Discernibility", "MaximalEquivalenceClassSize", "AverageEquivalenceClassSize", "MinimalEquivalenceClassSize", "NumberOfSuppressedRecords", "LocationAndLimits", "ClassificationAccuracy",
)


def read_csv(spark: SparkSession, path: str, sep: str = ";", columns: Sequence[str] | None = None) -> DataFrame:
    """A delimited table with a header, all text: the word ``NULL`` stays a category, empty cells stay empty.

    With ``columns`` no line is read to find the schema.
    """
    reader = spark.read.option("sep", sep).option("header", True).option("encoding", "UTF-8").option("emptyValue", "").option("nullValue", "\u0000")
    if columns is not None:
        reader = reader.schema(StructType([StructField(c, StringType()) for c in columns]))
    return reader.csv(path)


def read_table(spark: SparkSession, config: DataConfig, sep: str = ";") -> DataFrame:
    """The configured table, typed, with ``row_id`` by file name and place in the file."""
    raw = spark.read.parquet(config.path) if config.path.endswith(".parquet") else read_csv(spark, config.path, sep)
    if "row_id" not in raw.columns:
        raw = with_file_row_id(raw)
    return typed_projection(raw, config.specs, ["row_id"])


def read_like(spark: SparkSession, path: str, reference: DataFrame, specs: Sequence[AttributeSpec], sep: str = ";") -> DataFrame:
    """Another file with a known table's columns and declarations."""
    raw = read_csv(spark, path, sep, [c for c in reference.columns if c != "row_id"])
    return typed_projection(with_file_row_id(raw), specs, ["row_id"])


def read_target_ids(spark: SparkSession, path: str, key: str = "row_id") -> DataFrame:
    """One id per line, each once; lines that hold no number are skipped."""
    return spark.read.text(path).select(F.trim("value").try_cast("long").alias(key)).where(F.col(key).isNotNull()).distinct()


def write_csv(df: DataFrame, path: str, sep: str = ";", mode: str = "errorifexists", single: bool = False) -> None:
    """A delimited table; ``single`` puts it into one file, for reports only."""
    out = df.coalesce(1) if single else df
    out.write.mode(mode).option("sep", sep).option("header", True).csv(path)


def write_release(released: DataFrame, path: str, as_csv: bool = False) -> None:
    """The released table with its suppression flag: Parquet, or text for exchange."""
    if as_csv:
        write_csv(released, path)
    else:
        released.write.mode("errorifexists").parquet(path)


def write_log(results: DataFrame, path: str) -> None:
    """Append assessment rows; every row is kept."""
    write_csv(results.select(*LOG_COLUMNS), path, mode="append")


def write_summary(accuracy: DataFrame, path: str) -> None:
    """``TargetId;Distance;Accuracy``, by target."""
    rows = accuracy.orderBy("target_id").select(F.col("target_id").alias("TargetId"), F.col("distance").alias("Distance"), F.col("accuracy").alias("Accuracy"))
    write_csv(rows, path, single=True)


def write_targets(targets: DataFrame, key: str, path: str) -> None:
    """``id;distance`` by id."""
    write_csv(targets.orderBy(key).select(F.col(key).alias("id"), "distance"), path)


def write_report(dataset: DataFrame, attributes: DataFrame, path: str) -> None:
    """The anonymization report: one row of metrics per release, and one per release and attribute, appended."""
    for name, df in (("dataset", dataset), ("attribute", attributes)):
        text = df.select(*[three_decimals(F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
        write_csv(text, f"{path}_{name}", mode="append", single=True)


class CheckpointStore:
    """Samples, releases and statistics by configuration fingerprint, each an artifact of its own.

    Tables are Parquet, partitioned by ``run_id`` and ``target_id``. A partition that is written again replaces the
    one before, so work may be repeated after a failure. What is still to do is an anti-join by artifact.
    """

    KEYS = ("run_id", "target_id")

    def __init__(self, spark: SparkSession, root: str, fingerprint: str):
        self.spark, self.path = spark, f"{root.rstrip('/')}/{fingerprint}"

    def _table(self, kind: str) -> str:
        return f"{self.path}/{kind}"

    def exists(self, kind: str) -> bool:
        """Whether a partition of that kind was committed."""
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self._table(kind)}/*=*")
        return bool(p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p))

    def save(self, kind: str, df: DataFrame, partition: Sequence[str] = KEYS) -> None:
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition).parquet(self._table(kind))

    def load(self, kind: str) -> DataFrame | None:
        return self.spark.read.parquet(self._table(kind)) if self.exists(kind) else None

    def remaining(self, jobs: DataFrame, kind: str, on: Sequence[str] = KEYS) -> DataFrame:
        """The rows of ``jobs`` for which there is no artifact of that kind yet."""
        done = self.load(kind)
        return jobs if done is None else jobs.join(done.select(*on).distinct(), list(on), "left_anti")

    def of(self, kind: str, jobs: DataFrame, on: Sequence[str] = KEYS) -> DataFrame:
        """The artifacts of that kind that belong to ``jobs``."""
        return self.load(kind).join(jobs.select(*on).distinct(), list(on), "left_semi")


#: Columns of the series summary, in order and in the spelling that readers of such files expect.
SERIES_COLUMNS = ("ExperimentName", "StartTime", "EndTime", "SMConfig", "DataConfig", "AnonymizationConfig", "FeartureType", "LogFile", "SummaryFile", "CgfsFile")


def write_series_summary(rows: DataFrame, path: str) -> None:
    """Append one row per finished assessment of a series."""
    write_csv(rows.select(*SERIES_COLUMNS), path, mode="append", single=True)


def statistics_properties(row: dict) -> str:
    """A record of statistics as ``key=value`` lines in order of key; missing values are written as ``NaN``."""
    return "".join(f"{k}={'NaN' if v is None else v}\n" for k, v in sorted(row.items()))


def read_statistics_properties(text: str) -> dict:
    """The record written by :func:`statistics_properties`: numbers as floats, ``NaN`` as None, the rest as text."""
    out = {}
    for line in text.splitlines():
        key, eq, value = line.partition("=")
        if not eq or line.startswith("#"):
            continue
        try:
            number = float(value)
            out[key] = None if number != number else number
        except ValueError:
            out[key] = value
    return out
