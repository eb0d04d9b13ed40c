"""A Merkle manifest of a table: leaves, roots, and proofs through parents' preimages.

Every row is a leaf. The leaves of a group, in the order of their ids, are the lowest level of a tree
in which each run of ``FANOUT`` nodes has one parent, the digest of their digests joined; the roots of
the groups make one more tree of the same kind. A parent is stored by its preimage, the joined digests of
its children. A leaf joins its ancestors' preimages: without the leaf's own slot of 64 characters a
preimage holds the siblings, and with that slot replaced it is the preimage of the changed parent.

Trees grow by tiers: the nodes of one tier are dealt to blocks of ``FANOUT ** LEVELS`` neighbours, each
block is one row that holds the preimages of its levels, and the blocks' roots are the nodes of the
next tier. So a level costs no shuffle of its own, and a row holds a few thousand digests at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from privlens.llm.common import configure, discard, materialize

#: Children a parent, and levels a block.
FANOUT, LEVELS = 2, 7
#: What a leaf is made of.
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: Characters of a digest.
SLOT = 64
#: Rows whose tampering a proof must find: those where this divides the CRC-32 of the id.
TAMPERED = 7


def field(value):
    """A value as ``bytes:value``, null as ``-``."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*values):
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def ordered(nodes: DataFrame, order: list[str]) -> DataFrame:
    """``nodes(grp, digest, ...)`` with ``pos``, the place of a node in its group by ``order``, and ``n``, the group's size.

    Rows are sorted into ranges and numbered within them; the ranges' counts, a row for each range and
    group, then give every range the place where it starts. The last key tells equal rows apart, so
    that a range never has to hold all of them.
    """
    keyed = nodes.withColumn("tie", F.monotonically_increasing_id())
    keys = ["grp", *order, "tie"]
    ranged = keyed.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("tie")
    numbered = materialize(ranged.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("row")), "ordered")
    runs = numbered.groupBy("grp", "part").agg(F.min("row").alias("low"), F.count("*").alias("size"))
    starts = runs.select(
        F.col("grp").alias("of"),
        F.col("part").alias("range"),
        F.expr("sum(size) OVER (PARTITION BY grp ORDER BY part) - size - low").alias("shift"),
        F.expr("sum(size) OVER (PARTITION BY grp)").alias("n"),
    )
    # written, so that Spark knows its size before it picks a join
    starts = materialize(starts, "starts")
    placed = numbered.join(starts, F.col("grp").eqNullSafe(F.col("of")) & (F.col("part") == F.col("range")))
    return placed.select(*nodes.columns, (F.col("row") + F.col("shift")).alias("pos"), "n")


def blocks_of(nodes: DataFrame, fanout: int, levels: int) -> DataFrame:
    """Blocks of ``nodes(grp, pos, n, digest)``, where ``n`` nodes of a group stand on the tier: ``grp, pos, n`` of each block on the next tier, its root ``digest`` and ``up``, the preimages of each of its levels."""
    width = fanout**levels
    rows = nodes.groupBy("grp", F.expr(f"pos div {width}").alias("block")).agg(F.max("n").alias("n"), F.expr("transform(array_sort(collect_list(struct(pos, digest))), x -> x.digest)").alias("level"))
    rows = rows.withColumn("up", F.array().cast("array<array<string>>"))
    for _ in range(levels):
        joined = f"transform(sequence(0, size(level) - 1, {fanout}), i -> array_join(slice(level, i + 1, {fanout}), ''))"
        # a group that is down to one node has no more levels
        rows = rows.withColumn("joined", F.expr(f"CASE WHEN n > 1 THEN {joined} END"))
        rows = rows.withColumn("up", F.expr("CASE WHEN joined IS NULL THEN up ELSE concat(up, array(joined)) END"))
        rows = rows.withColumn("level", F.expr("coalesce(transform(joined, x -> sha2(x, 256)), level)"))
        rows = rows.withColumn("n", F.expr(f"(n + {fanout - 1}) div {fanout}"))
    return rows.select("grp", F.col("block").alias("pos"), "n", F.expr("level[0]").alias("digest"), "up")


STEPS = "array<struct<preimage: string, slot: int>>"


def with_paths(nodes: DataFrame, blocks: DataFrame, columns: list[str], fanout: int, levels: int) -> DataFrame:
    """``columns`` of ``nodes``, each node's ``path`` and its tree's ``subroot`` and ``root``.

    A path has one step for each ancestor, from the lowest to the last: its preimage, and the slot in it. The
    steps inside the node's block are read off ``up`` by the node's place; ``above`` has those of the block.
    """
    width = fanout**levels
    inside = f"transform(up, (level, i) -> struct(level[int(pos % {width} div bigint(pow({fanout}, i + 1)))] AS preimage, int(pos % {width} div bigint(pow({fanout}, i)) % {fanout}) AS slot))"
    over = blocks.select(F.col("grp").alias("of"), F.col("pos").alias("block"), F.col("up").alias("ups"), "above", "subroot", "root")
    found = nodes.join(over, F.col("grp").eqNullSafe(F.col("of")) & (F.expr(f"pos div {width}") == F.col("block")))
    return found.select(*columns, F.expr(f"concat({inside.replace('up,', 'ups,')}, above)").alias("path"), "subroot", "root")


def forest(nodes: DataFrame, fanout: int, levels: int, tree_of_roots=None) -> DataFrame:
    """The lowest blocks of the trees over ``nodes(grp, pos, n, digest)``: ``grp, pos, up, above, subroot`` and ``root``.

    ``tree_of_roots`` takes ``(grp, digest)`` of every tree and gives ``(grp, path, root)`` in the tree
    that stands on them; without it a tree's own root is the last.
    """
    tiers = [materialize(blocks_of(nodes, fanout, levels), "blocks")]
    while tiers[-1].where("n > 1").limit(1).count():
        tiers.append(materialize(blocks_of(tiers[-1], fanout, levels), "blocks"))
    ends = tiers[-1].select("grp", "pos", "up", F.col("digest").alias("subroot"))
    if tree_of_roots is None:
        above = ends.select("*", F.array().cast(STEPS).alias("above"), F.col("subroot").alias("root"))
    else:
        on = tree_of_roots(ends.select("grp", F.col("subroot").alias("digest"))).select(F.col("grp").alias("of"), F.col("path").alias("above"), "root")
        above = ends.join(on, F.col("grp").eqNullSafe(F.col("of"))).drop("of")
    for below in reversed(tiers[:-1]):
        above = materialize(with_paths(below, above, ["grp", "pos", "up"], fanout, levels).withColumnRenamed("path", "above"), "paths")
    discard(*tiers[1:])
    return above


def folded(start: str):
    """The root that ``start`` leads to, its own slot replaced in every preimage of the path."""
    return F.expr(f"aggregate(path, {start}, (digest, x) -> sha2(concat(left(x.preimage, x.slot * {SLOT}), digest, substr(x.preimage, x.slot * {SLOT} + {SLOT} + 1)), 256))")


def siblings():
    """The siblings on the path, joined: every preimage without the node's own slot."""
    return F.expr(f"array_join(transform(path, x -> concat(left(x.preimage, x.slot * {SLOT}), substr(x.preimage, x.slot * {SLOT} + {SLOT} + 1))), '')")


def manifest(df: DataFrame, changed=None, group: str = "lang", order: str = "doc_id", columns: tuple[str, ...] = COLUMNS, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """Per row of ``df``: the ``order`` column, ``leaf``, ``subroot``, ``root``, ``proof`` (the siblings, joined), ``folded_root`` and ``verified``.

    A leaf is the digest of the row's ``columns``. The leaves of a ``group`` ascend by ``order``, null first; those
    of equal order ascend by digest, and of repeated rows each is a leaf. ``changed`` maps names of ``columns`` to
    what they hold in the row to be verified (default: the row itself); ``folded_root`` is recomputed from its leaf
    and the original siblings. A null group is a group, the first one. Empty table: no rows.
    """
    configure(df.sparkSession)
    leaf, other = leaf_digest(*[df[c] for c in columns]), leaf_digest(*[(changed or {}).get(c, df[c]) for c in columns])
    rows = df.select(df[group].cast("string").alias("grp"), df[order].alias("id"), leaf.alias("digest"), F.nullif(other, leaf).alias("other"))
    leaves = materialize(ordered(rows, ["id", "digest"]), "leaves")

    def over_groups(roots: DataFrame) -> DataFrame:
        named = roots.select(F.lit("").alias("grp"), F.col("grp").alias("name"), "digest")
        nodes = materialize(ordered(named, ["name"]), "groups")
        return with_paths(nodes, forest(nodes, fanout, levels), ["name"], fanout, levels).select(F.col("name").alias("grp"), "path", "root")

    found = with_paths(leaves, forest(leaves, fanout, levels, over_groups), ["id", "digest", "other"], fanout, levels)
    judged = found.select(F.col("id").alias(order), F.col("digest").alias("leaf"), "subroot", "root", siblings().alias("proof"), folded("coalesce(other, digest)").alias("folded_root"))
    return judged.withColumn("verified", F.col("folded_root") == F.col("root"))


def one_more(df: DataFrame, id_col: str = "doc_id", count: str = "n_chars") -> dict:
    """A change for :func:`manifest`: one more in ``count`` where :data:`TAMPERED` divides the CRC-32 of the decimal id. Nulls stay, null ids are left alone."""
    hit = F.crc32(df[id_col].cast("string")) % TAMPERED == 0
    value = df[count].cast("decimal(38,0)")
    return {count: F.when(hit, value + 1).otherwise(value).cast("decimal(38,0)")}


_LEAF = " || ".join(f"coalesce(octet_length(encode({c}::VARCHAR)) || ':' || {c}::VARCHAR, '-')" for c in COLUMNS)


def _sql_tree(name: str, leaves: str) -> str:
    """The levels of the trees over ``leaves(grp, pos, h, n)``."""
    joined = "string_agg(h, '' ORDER BY pos)"
    return f"""{name}(grp, level, pos, h, preimage, n) AS (
  SELECT grp, 0, pos, h, NULL::VARCHAR, n FROM {leaves}
  UNION ALL SELECT grp, level + 1, pos // 2, sha256({joined}), {joined}, (n + 1) // 2 FROM {name} WHERE n > 1 GROUP BY grp, level, pos // 2, n)"""


#: CRC-32 of the decimal id: every byte and then eight shifts, as steps of one fold.
_CRC = """xor(list_reduce(list_concat([4294967295], flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda c, b: CASE WHEN b >= 0 THEN xor(c, b) ELSE xor(c >> 1, (c & 1) * 3988292384) END), 4294967295)"""

#: The registered query in DuckDB SQL.
SQL = f"""
WITH RECURSIVE
d AS (SELECT doc_id, lang AS grp, sha256({_LEAF}) AS h FROM documents),
c AS (SELECT doc_id AS id, sha256({_LEAF}) AS other FROM (SELECT * REPLACE (n_chars + CASE WHEN {_CRC} % {TAMPERED} = 0 THEN 1 ELSE 0 END AS n_chars) FROM documents)),
leaves AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY grp) AS n FROM d),
{_sql_tree("low", "leaves")},
subroots AS (SELECT 0 AS grp, grp AS lang, h, row_number() OVER (ORDER BY grp NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM low WHERE n = 1),
{_sql_tree("high", "subroots")},
steps AS (
  SELECT doc_id, t.level, t.preimage, (l.pos >> (t.level - 1)) & 1 AS slot FROM leaves l JOIN low t ON l.grp IS NOT DISTINCT FROM t.grp AND t.level > 0 AND (l.pos >> t.level) = t.pos
  UNION ALL
  SELECT doc_id, 1000 + t.level, t.preimage, (s.pos >> (t.level - 1)) & 1 FROM leaves l JOIN subroots s ON l.grp IS NOT DISTINCT FROM s.lang JOIN high t ON t.level > 0 AND (s.pos >> t.level) = t.pos),
path AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY level) AS step FROM steps),
climb(doc_id, step, h) AS (
  SELECT id, 0::BIGINT, other FROM c
  UNION ALL SELECT doc_id, path.step, sha256(left(preimage, slot * {SLOT}) || h || substr(preimage, slot * {SLOT} + {SLOT} + 1)) FROM climb JOIN path USING (doc_id) WHERE path.step = climb.step + 1),
ends AS (SELECT doc_id, arg_max(h, step) AS folded_root FROM climb GROUP BY 1),
proofs AS (SELECT doc_id, sha256(string_agg(left(preimage, slot * {SLOT}) || substr(preimage, slot * {SLOT} + {SLOT} + 1), '' ORDER BY step)) AS proof_sha256 FROM path GROUP BY 1)
SELECT l.doc_id, l.h AS leaf, s.h AS subroot, root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM leaves l JOIN subroots s ON l.grp IS NOT DISTINCT FROM s.lang JOIN ends USING (doc_id) LEFT JOIN proofs USING (doc_id), (SELECT h AS root FROM high WHERE n = 1)
"""
