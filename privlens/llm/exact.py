"""Exact deduplication with a heavy-hitter split, in built-in functions alone.

Every text is normalised and digested once, into a written table of ids and digests. A Misra-Gries
summary of the digests (Spark's frequent-items sketch, one a task, merged in two steps) names the
digests that may be frequent; exact counts verify them, and the winners of those that are travel to
the rows by broadcast, so that the rows of large groups are never shuffled. All other digests hold a
small share of the rows each and take an ordinary shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from privlens.llm.common import configure, discard, materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Counters of a summary: it finds every digest of more than about 3.5 / COUNTERS of the rows.
COUNTERS = 4096
#: Most digests that travel by broadcast; with a share of HEAVY of the rows or more each, there are never more.
HEAVY, MOST_HEAVY = 0.001, 1000
#: First-step summaries, merged into one by the second step; bounds what a single task reads.
MERGERS = 64


def normalized(text):
    """``text`` with A-Z, and nothing else, in lower case; null is empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def digests_of(df: DataFrame, keep: list[str], id_col: str, text: str) -> DataFrame:
    """``id``, ``row`` (a number of its own for each row), ``digest`` (32 bytes) and the ``keep`` columns as ``k0``, ``k1`` and so on."""
    digest = F.unhex(F.sha2(normalized(df[text]), 256))
    return df.select(df[id_col].alias("id"), F.monotonically_increasing_id().alias("row"), digest.alias("digest"), *[df[c].alias(f"k{i}") for i, c in enumerate(keep)])


def frequent(digests: DataFrame) -> DataFrame:
    """``digest`` of every value that may hold :data:`HEAVY` of the rows of ``digests(digest)``: a Misra-Gries summary, so at most :data:`MOST_HEAVY` rows."""
    keyed = digests.select(F.hex("digest").alias("item"), F.pmod(F.spark_partition_id(), F.lit(MERGERS)).alias("merger"))
    parts = keyed.groupBy("merger").agg(F.expr(f"approx_top_k_accumulate(item, {COUNTERS})").alias("summary"))
    whole = parts.groupBy(F.lit("all")).agg(F.expr(f"approx_top_k_combine(summary, {COUNTERS})").alias("summary"))
    found = whole.select(F.explode(F.expr(f"approx_top_k_estimate(summary, {MOST_HEAVY})")).alias("one"))
    return found.select(F.unhex("one.item").alias("digest"))


def mark_duplicates(df: DataFrame, keep: list[str] | None = None, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row of ``df``: ``keep`` columns (default: the id), then ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``.

    Texts are equal if they are identical after lower-casing A-Z only; null counts as empty. Of equal
    texts the row with the largest id stays, a null id only if all ids of the group are null; of rows
    with that id, one stays. ``keep`` columns named like the results are left out. Empty table: no rows.
    """
    configure(df.sparkSession)
    results = ("keep_id", "group_size", "kept", "text_sha256")
    keep = [c for c in ([id_col] if keep is None else keep) if c.lower() not in results]
    table = materialize(digests_of(df, keep, id_col, text), "digests")
    candidates = materialize(frequent(table), "candidates")
    total = table.count()

    def winners(rows: DataFrame) -> DataFrame:
        return rows.groupBy("digest").agg(F.max(F.struct("id", "row")).alias("best"), F.count("*").alias("size"))

    suspects = table.join(F.broadcast(candidates), "digest", "left_semi")
    heavy = materialize(winners(suspects).where(F.col("size") >= HEAVY * total), "heavy")
    discard(candidates)

    def judged(rows: DataFrame, found: DataFrame) -> DataFrame:
        columns = [F.col(f"k{i}").alias(c) for i, c in enumerate(keep)]
        kept = F.col("row") == F.col("best.row")
        return rows.join(found, "digest").select(*columns, F.col("best.id").alias("keep_id"), F.col("size").alias("group_size"), kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))

    # one exchange by digest serves the winners and the rows that look them up
    rest = table.join(F.broadcast(heavy), "digest", "left_anti").repartition("digest")
    return judged(table, F.broadcast(heavy)).unionByName(judged(rest, winners(rest)))


def drop_duplicates(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``df`` that stay, with all their columns but those named like the results of :func:`mark_duplicates`."""
    marked = mark_duplicates(df, df.columns, id_col, text)
    return marked.where("kept").drop("keep_id", "group_size", "kept", "text_sha256")


#: The registered query in DuckDB SQL.
SQL = f"""
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), '{UPPER}', '{LOWER}')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
"""
