"""The corpus pipeline: toxicity, near-duplicates, repeated passages, personal data, packing.

Each stage reads what its predecessor wrote, works on all of it and returns the columns of
``documents`` (the last one the packed pieces). A document whose text a stage changes gets a new
``n_chars``. Null ids and repeated rows pass through every stage like other rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from privlens.llm import packing, pii, simhash, substrings, toxicity
from privlens.llm.common import configure, materialize
from privlens.llm.queries import packing_tokens

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _columns(df: DataFrame) -> DataFrame:
    return df.select(*COLUMNS)


def _resized(df: DataFrame) -> DataFrame:
    """``df`` with ``n_chars`` counted anew."""
    return _columns(df.withColumn("n_chars", F.length("text").cast("long")))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold stay."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _columns(toxicity.score(docs, model, keep=COLUMNS).where(F.col("score") < toxicity.THRESHOLD))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near-duplicates the row with the smallest id stays, and one only if that id repeats."""
    return _columns(simhash.drop_near_duplicates(docs))


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of repeated passages go; a document without any stays as it was written, one left with no words goes."""
    return _resized(substrings.drop_repeats(docs, keep=COLUMNS))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data becomes a tag of its kind."""
    return _resized(pii.redact(docs.select(*COLUMNS)))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, packing_tokens)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", keep_one_of_each),
    ("substring_dedup", drop_repeats),
    ("pii", redact),
    ("packing", pack),
]

#: SQL cannot express these stages; the tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again as the next one's input."""
    configure(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, f"stage-{name}")
    return docs
