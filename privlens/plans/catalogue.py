"""The registered queries: every operator bound to a test table, with DuckDB SQL beside it.

Doubles are rounded to six places on both sides; results hold scalars and text only.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from privlens.functions.scalar import r6
from privlens.operators import classes as cl
from privlens.operators import classify, features, hierarchy, privacy, recode, sampling, schema, search, targets
from privlens.operators.anonymizer import Anonymizer, FixedLevels
from privlens.operators.hierarchy import Hierarchy
from privlens.operators.privacy import Model
from privlens.operators.schema import AttributeSpec
from privlens.plans import assessment as pa
from privlens.sources import config as cf
from privlens.sources import shared
from privlens.sources import tables as tb

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[r6(F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# --- hierarchies of the test tables ----------------------------------------------------------------

QIS = ["p_brand", "p_type", "p_size"]
LEVELS = {"p_brand": 1, "p_type": 1, "p_size": 1}


def part_hierarchies() -> dict[str, Hierarchy]:
    number = lambda c: F.substring(c.cast("string"), 7, 9).try_cast("int")
    return {
        "p_brand": Hierarchy("p_brand", rules=[lambda c: F.concat(F.lit("Brands "), F.floor((number(c) - 1) / 5).cast("int").cast("string")), lambda c: F.lit("*")]),
        "p_type": Hierarchy("p_type", rules=[lambda c: F.when(c.isin("LARGE", "MEDIUM", "SMALL"), F.lit("SIZED")).otherwise(F.lit("KIND")), lambda c: F.lit("*")]),
        "p_size": Hierarchy("p_size", rules=[lambda c: F.concat((F.floor(c.cast("int") / 10) * 10).cast("int").cast("string"), F.lit("s")), lambda c: F.when(c.cast("int") <= 25, F.lit("low")).otherwise(F.lit("high")), lambda c: F.lit("*")]),
    }


_B = ["p_brand", "'Brands ' || CAST(CAST(floor((CAST(substr(p_brand, 7) AS INT) - 1) / 5.0) AS INT) AS VARCHAR)", "'*'"]
_T = ["p_type", "CASE WHEN p_type IN ('LARGE', 'MEDIUM', 'SMALL') THEN 'SIZED' ELSE 'KIND' END", "'*'"]
_S = ["CAST(p_size AS VARCHAR)", "CAST(CAST(floor(p_size / 10.0) * 10 AS INT) AS VARCHAR) || 's'", "CASE WHEN p_size <= 25 THEN 'low' ELSE 'high' END", "'*'"]
_GEN = f"SELECT p_partkey, {_B[1]} AS p_brand, {_T[1]} AS p_type, {_S[1]} AS p_size, p_retailprice, p_name FROM part"
_KSUP = f"""g AS ({_GEN}), c AS (SELECT p_brand, p_type, p_size, count(*) AS n FROM g GROUP BY ALL),
rel AS (SELECT p_partkey, CASE WHEN n < 5 THEN '*' ELSE p_brand END AS p_brand, CASE WHEN n < 5 THEN '*' ELSE p_type END AS p_type,
  CASE WHEN n < 5 THEN '*' ELSE p_size END AS p_size, n < 5 AS is_suppressed, g.p_brand AS b, g.p_type AS t, g.p_size AS s, n FROM g JOIN c USING (p_brand, p_type, p_size))"""
# fine levels leave small classes, so that suppression shows at every scale
_FINE = {"p_brand": 1, "p_type": 0, "p_size": 1}


def part(spark, sf) -> DataFrame:
    return table(spark, sf, "part")


def released(spark, sf) -> DataFrame:
    return recode.release(part(spark, sf).select("p_partkey", *QIS), LEVELS, part_hierarchies(), [Model("k-Anonymity", 5)])


# --- scans, domains, statistics --------------------------------------------------------------------


@query("SELECT p_partkey, p_brand, p_type, CAST(p_size AS DOUBLE) AS p_size, p_retailprice FROM part")
def scan_typed(spark, sf):
    specs = [AttributeSpec.of("p_brand"), AttributeSpec.of("p_type"), AttributeSpec.of("p_size", "continuous"), AttributeSpec.of("p_retailprice", "continuous")]
    text = part(spark, sf).select("p_partkey", *[F.col(s.name).cast("string").alias(s.name) for s in specs])
    return schema.typed_projection(text, specs, ["p_partkey"])


_ACCOUNTS = [cf.AttributeConfig("c_custkey", "continuous", "INSENSITIVE"), cf.AttributeConfig("c_mktsegment"), cf.AttributeConfig("c_acctbal", "continuous")]


def _delimited(spark, df: DataFrame, what: str) -> str:
    """``df`` as a delimited table in the shared folder."""
    path = f"{shared.shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    tb.write_csv(df, path)
    return path


@query("SELECT CAST(c_custkey AS DOUBLE) AS c_custkey, c_mktsegment, c_acctbal FROM customer")
def scan_delimited(spark, sf):
    """A delimited table, written and scanned by its configuration."""
    path = _delimited(spark, table(spark, sf, "customer").select("c_mktsegment", "c_custkey", "c_acctbal", "c_nationkey"), "customers")
    return tb.read_table(spark, cf.DataConfig(path, _ACCOUNTS)).drop("row_id")


@query("SELECT CAST(s_suppkey AS DOUBLE) AS c_custkey, CASE WHEN s_suppkey % 9 = 0 THEN '*' ELSE 'S' || CAST(s_nationkey AS VARCHAR) END AS c_mktsegment, CASE WHEN s_suppkey % 7 <> 0 THEN s_acctbal END AS c_acctbal FROM supplier")
def scan_like_another(spark, sf):
    """A second file with the columns and declarations of a known table; suppressed numbers are missing."""
    known = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    key = F.col("s_suppkey")
    suppliers = table(spark, sf, "supplier").select(key.alias("c_custkey"), F.when(key % 9 == 0, F.lit("*")).otherwise(F.concat(F.lit("S"), F.col("s_nationkey"))).alias("c_mktsegment"), F.when(key % 7 == 0, F.lit("*")).otherwise(F.col("s_acctbal").cast("string")).alias("c_acctbal"))
    return tb.read_like(spark, _delimited(spark, suppliers, "suppliers"), known, [a.spec() for a in _ACCOUNTS]).drop("row_id")


@query("SELECT DISTINCT 'c_mktsegment' AS attribute, c_mktsegment AS value FROM customer UNION ALL SELECT DISTINCT 'c_nationkey', CAST(c_nationkey AS VARCHAR) FROM customer")
def attack_attributes(spark, sf):
    """The values of included attributes of all roles; a quasi-identifier that is not included is none of them."""
    specs = [AttributeSpec.of("c_mktsegment"), AttributeSpec.of("c_name", include=False), AttributeSpec.of("c_nationkey", role="SENSITIVE")]
    return schema.distinct_values(table(spark, sf, "customer"), schema.attack_attributes(specs, everything=True))


@query("SELECT n_regionkey AS run_id, n_nationkey AS target_id FROM nation WHERE n_nationkey % 3 <> 0")
def checkpoint_remaining(spark, sf):
    """Jobs without a stored artifact: one partition a job, written twice, as after a failure."""
    jobs = table(spark, sf, "nation").select(F.col("n_regionkey").alias("run_id"), F.col("n_nationkey").alias("target_id"))
    store = tb.CheckpointStore(spark, f"{shared.shared_dir(spark)}/store-{uuid.uuid4().hex}", "any")
    made = jobs.where("target_id % 3 = 0").withColumn("value", F.lit(1))
    for part_of in (made.where("target_id < 12"), made):
        store.save("releases", part_of)
    return store.remaining(jobs, "releases")


@query("SELECT c_custkey, 'c_acctbal' AS attribute FROM customer WHERE c_acctbal < 0")
def empty_check(spark, sf):
    blank = table(spark, sf, "customer").select("c_custkey", F.when(F.col("c_acctbal") < 0, F.lit(" ")).otherwise(F.col("c_acctbal").cast("string")).alias("c_acctbal"))
    return schema.empty_cells(blank, [AttributeSpec.of("c_acctbal", "continuous")], "c_custkey")


@query("SELECT DISTINCT 'p_brand' AS attribute, p_brand AS value FROM part UNION ALL SELECT DISTINCT 'p_type', p_type FROM part")
def profile_distinct(spark, sf):
    return schema.distinct_values(part(spark, sf), ["p_brand", "p_type"])


@query("SELECT DISTINCT attribute, value FROM (" + " UNION ALL ".join(f"SELECT '{a}' AS attribute, {e} AS value FROM part" for a, levels in (("p_brand", _B), ("p_type", _T), ("p_size", _S)) for e in levels) + ")")
def domain_enrich(spark, sf):
    df = part(spark, sf)
    h = part_hierarchies()
    return schema.enriched_domain(df, QIS, hierarchy.all_labels(spark, list(h.values()), {a: df.select(a).distinct() for a in QIS}))


@query("SELECT 'o_totalprice' AS attribute, round(min(o_totalprice), 6) AS min, round(max(o_totalprice), 6) AS max FROM orders UNION ALL SELECT 'o_orderdate', CAST(epoch_ms(min(o_orderdate)) AS DOUBLE), CAST(epoch_ms(max(o_orderdate)) AS DOUBLE) FROM orders")
def value_bounds(spark, sf):
    return rounded(schema.value_bounds(table(spark, sf, "orders"), ["o_totalprice", "o_orderdate"]))


def _stats_sql(c: str) -> str:
    return f"SELECT '{c}' AS attribute, count({c}) AS n, round(CAST(min({c}) AS DOUBLE), 6) AS min, round(CAST(max({c}) AS DOUBLE), 6) AS max, round(avg({c}), 6) AS mean, round(CAST(median({c}) AS DOUBLE), 6) AS median, round(var_samp({c}), 6) AS variance FROM customer"


@query(_stats_sql("c_acctbal") + " UNION ALL " + _stats_sql("c_nationkey"))
def summary_stats(spark, sf):
    return rounded(schema.summary_statistics(table(spark, sf, "customer"), ["c_acctbal", "c_nationkey"]))


@query(" UNION ALL ".join(f"SELECT '{c}' AS attribute, CAST({c} AS VARCHAR) AS value, count(*) AS n, round(count(*) / CAST((SELECT count(*) FROM customer) AS DOUBLE), 6) AS frequency FROM customer GROUP BY {c}" for c in ("c_mktsegment", "c_nationkey")))
def freq_distribution(spark, sf):
    return rounded(schema.frequency_distribution(table(spark, sf, "customer"), ["c_mktsegment", "c_nationkey"]))


@query("SELECT c_custkey, c_mktsegment, CAST(code AS INT) AS code FROM customer JOIN (SELECT s, dense_rank() OVER (ORDER BY s) - 1 AS code FROM (SELECT DISTINCT c_mktsegment AS s FROM customer)) ON s = c_mktsegment")
def dictionary_encode(spark, sf):
    df = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    return schema.encode(df, "c_mktsegment", schema.dictionary(schema.distinct_values(df, ["c_mktsegment"])), "code")


# --- sampling --------------------------------------------------------------------------------------

_RANK = "row_number() OVER (ORDER BY md5('7:{s}:' || CAST(c_custkey AS VARCHAR)), c_custkey) - 1"


def customers(spark, sf) -> DataFrame:
    return table(spark, sf, "customer")


@query(f"SELECT c_custkey, c_name, c_mktsegment FROM (SELECT *, {_RANK.format(s='subsample')} AS r FROM customer) WHERE r < 40")
def sample_rows(spark, sf):
    df = customers(spark, sf).select("c_custkey", "c_name", "c_mktsegment")
    return sampling.rows_of(df, sampling.subsample(df, "c_custkey", 40, 7), "c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey <> 17")
def pool_minus_target(spark, sf):
    return sampling.without(customers(spark, sf).select("c_custkey"), 17, "c_custkey")


@query(f"SELECT c_custkey FROM (SELECT c_custkey, {_RANK.format(s='subsample')} AS r FROM customer) WHERE r < 100")
def subsample(spark, sf):
    return sampling.subsample(customers(spark, sf), "c_custkey", 100, 7)


_SPLIT = f"""WITH n AS (SELECT count(*) AS n FROM customer), z AS (SELECT CAST(floor(n * 0.3) AS BIGINT) AS c, CAST(floor(n * 0.4) AS BIGINT) AS b FROM n),
r AS (SELECT c_custkey, {_RANK.format(s='split')} AS r FROM customer),
m AS (SELECT c_custkey, r < c AS cohort, r >= c - CAST(floor(c * 0.5) AS BIGINT) AND r < c - CAST(floor(c * 0.5) AS BIGINT) + b AS background FROM r, z)"""


def _split(spark, sf) -> DataFrame:
    df = customers(spark, sf)
    n = df.count()
    return sampling.overlapping_split(df, "c_custkey", sampling.sample_size(n, 0.3, 0), sampling.sample_size(n, 0.4, 0), 0.5, 7, n)


@query(_SPLIT + " SELECT * FROM m WHERE cohort OR background")
def sample_split(spark, sf):
    return _split(spark, sf)


@query(_SPLIT + " SELECT count(*) AS n_both, CAST(min(floor(c * 0.5)) AS BIGINT) AS n_expected FROM m, z WHERE cohort AND background")
def sample_overlap(spark, sf):
    n = customers(spark, sf).count()
    cohort, background = int(n * 0.3), int(n * 0.4)
    return _split(spark, sf).where("cohort and background").agg(F.count("*").alias("n_both"), F.lit(sampling.overlap_size(cohort, background, 0.5)).cast("long").alias("n_expected"))


_PAIR = """WITH r AS (SELECT c_custkey, row_number() OVER (ORDER BY md5('7:pair:' || CAST(c_custkey AS VARCHAR)), c_custkey) AS r FROM customer WHERE c_custkey <> 17)
SELECT c_custkey, false AS target_in FROM r WHERE r <= 30 UNION ALL SELECT c_custkey, true FROM r WHERE r <= 29 UNION ALL SELECT CAST(17 AS BIGINT), true"""


@query(_PAIR)
def sample_with_target(spark, sf):
    return sampling.paired_samples(customers(spark, sf), "c_custkey", 17, 30, 7)


# --- targets ---------------------------------------------------------------------------------------

ATTACKED = ["c_acctbal", "c_nationkey", "c_mktsegment"]
_DIST = """WITH m AS (SELECT min(c_acctbal) AS a0, max(c_acctbal) AS a1, min(c_nationkey) AS n0, max(c_nationkey) AS n1, count(*) AS n FROM customer),
f AS (SELECT c_mktsegment AS s, count(*) AS k FROM customer GROUP BY 1),
x AS (SELECT c_custkey, (c_acctbal + a0) / (a0 + a1) AS x0, (c_nationkey + n0) / CAST(n0 + n1 AS DOUBLE) AS x1, k / CAST(n AS DOUBLE) AS x2 FROM customer, m, f WHERE s = c_mktsegment),
c AS (SELECT avg(x0) AS c0, avg(x1) AS c1, max(x2) AS c2 FROM x),
d AS (SELECT c_custkey, sqrt((x0 - c0) ** 2 + (x1 - c1) ** 2 + (x2 - c2) ** 2) AS distance FROM x, c),
e AS (SELECT c_custkey, distance, (distance - min(distance) OVER ()) / nullif(max(distance) OVER () - min(distance) OVER (), 0) AS distance_normalised FROM d)"""


@query(_DIST + " SELECT c_custkey, round(distance, 6) AS distance, round(distance_normalised, 6) AS distance_normalised FROM e")
def target_distance(spark, sf):
    return rounded(targets.distances(customers(spark, sf), "c_custkey", ATTACKED))


def _top(order: str) -> str:
    return _DIST + f" SELECT c_custkey, round(distance, 6) AS distance, CAST(row_number() OVER (ORDER BY round(distance, 9) {order}, c_custkey) AS INT) AS rank FROM e QUALIFY rank <= 20"


@query(_top("DESC"))
def targets_outlier(spark, sf):
    return rounded(targets.select_targets(customers(spark, sf), "c_custkey", "OUTLIER", 20, ATTACKED))


@query(_top("ASC"))
def targets_average(spark, sf):
    return rounded(targets.select_targets(customers(spark, sf), "c_custkey", "AVERAGE", 20, ATTACKED))


@query("SELECT c_custkey, CAST(row_number() OVER (ORDER BY md5('7:targets:' || CAST(c_custkey AS VARCHAR)), c_custkey) AS INT) AS rank FROM customer QUALIFY rank <= 20")
def targets_random(spark, sf):
    return targets.select_targets(customers(spark, sf), "c_custkey", "RANDOM", 20, seed=7)


@query("SELECT c_custkey, CAST(row_number() OVER (ORDER BY c_custkey) AS INT) AS rank FROM customer WHERE c_custkey IN (SELECT DISTINCT n_nationkey * 5 FROM nation)")
def targets_import(spark, sf):
    ids = table(spark, sf, "nation").select((F.col("n_nationkey") * 5).cast("long").alias("c_custkey"))
    return targets.select_targets(customers(spark, sf), "c_custkey", "IMPORT", 0, imported=ids)


# --- recoding --------------------------------------------------------------------------------------


@query(f"SELECT p_partkey, p_brand, p_type, p_size FROM ({_GEN})")
def generalize_fixed(spark, sf):
    return hierarchy.generalize(part(spark, sf).select("p_partkey", *QIS), LEVELS, part_hierarchies())


@query("SELECT p_partkey, '*' AS p_brand, p_type FROM part")
def cell_suppression(spark, sf):
    return recode.cell_suppression(part(spark, sf).select("p_partkey", "p_brand", "p_type"), ["p_brand"])


@query("SELECT p_partkey, p_brand, p_type, p_size, false AS is_suppressed FROM part")
def identity_release(spark, sf):
    return recode.identity_release(part(spark, sf).select("p_partkey", *QIS))


@query(f"WITH {_KSUP} SELECT p_partkey, p_brand, p_type, p_size, is_suppressed FROM rel WHERE NOT is_suppressed")
def live_rows(spark, sf):
    return cl.live_rows(released(spark, sf))


@query(f"WITH {_KSUP} SELECT p_partkey, p_brand, p_type, p_size, is_suppressed, '*' AS p_name FROM rel")
def k_anonymity_suppress(spark, sf):
    return recode.release(part(spark, sf).select("p_partkey", *QIS, "p_name"), LEVELS, part_hierarchies(), [Model("k-Anonymity", 5)], identifying=["p_name"])


@query(f"WITH {_KSUP} SELECT p_brand, p_type, p_size, count(*) AS class_size FROM rel WHERE NOT is_suppressed GROUP BY ALL")
def equivalence_classes(spark, sf):
    return cl.equivalence_classes(released(spark, sf), QIS)


_SIZES = f"WITH {_KSUP}, k AS (SELECT p_brand, p_type, p_size, count(*) AS z FROM rel WHERE NOT is_suppressed GROUP BY ALL)"


@query(_SIZES + " SELECT z AS class_size, count(*) AS n_classes FROM k GROUP BY z")
def class_size_hist(spark, sf):
    return cl.class_size_histogram(cl.equivalence_classes(released(spark, sf), QIS))


@query(_SIZES + " SELECT count(*) AS n_classes, min(z) AS min_class_size, round(avg(z), 6) AS avg_class_size, max(z) AS max_class_size, CAST(coalesce(sum(z), 0) AS BIGINT) AS live_records, (SELECT count(*) FROM rel WHERE is_suppressed) AS suppressed_records FROM k")
def class_size_stats(spark, sf):
    return rounded(cl.class_statistics(released(spark, sf), QIS))


@query(
    _SIZES
    + """, q AS (SELECT min(z) AS lo, max(z) AS hi, count(*) AS c, CAST(sum(z) AS DOUBLE) AS r FROM k)
SELECT round(1.0 / lo, 6) AS journalist_risk, round(1.0 / hi, 6) AS minimum_risk, round((SELECT sum(z) FROM k WHERE z = hi) / r, 6) AS records_at_lowest_risk, round(1.0 / lo, 6) AS highest_risk,
  round((SELECT sum(z) FROM k WHERE z = lo) / r, 6) AS records_at_highest_risk, round(c / r, 6) AS average_risk, round(c / r, 6) AS marketer_risk FROM q"""
)
def reid_risk(spark, sf):
    return rounded(cl.reidentification_risk(cl.equivalence_classes(released(spark, sf), QIS)))


@query(f"WITH {_KSUP} SELECT p_partkey, p_brand, p_type, p_size, CAST(is_suppressed AS VARCHAR) AS is_suppressed FROM rel")
def release_sink(spark, sf):
    """A release written as text and read back."""
    path = f"{shared.shared_dir(spark)}/release-{uuid.uuid4().hex}"
    tb.write_release(released(spark, sf), path, as_csv=True)
    back = tb.read_csv(spark, path)
    return back.select(F.col("p_partkey").cast("long").alias("p_partkey"), *QIS, "is_suppressed")


@query("SELECT c_custkey, r_name AS c_nationkey FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey")
def inline_hierarchy(spark, sf):
    """A hierarchy given as a tree, regions over nations."""
    nations = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(F.collect_list("n_nationkey").alias("keys"))
    tree = {"*": {r["r_name"]: sorted(map(str, r["keys"])) for r in nations.collect()}}  # a configuration: the nations of the world
    df = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    return hierarchy.generalize(df, {"c_nationkey": 1}, {"c_nationkey": Hierarchy.nested("c_nationkey", tree)})


@query(
    f"WITH g AS (SELECT p_partkey, {_B[1]} AS p_brand, {_T[1]} AS p_type, p_size, count(*) OVER (PARTITION BY {_B[1]}, {_T[1]}, p_size) AS n FROM part) "
    "SELECT p_partkey, CASE WHEN n >= 5 THEN p_brand ELSE '*' END AS p_brand, CASE WHEN n >= 5 THEN CAST(p_size AS DOUBLE) END AS p_size FROM g"
)
def live_cells(spark, sf):
    """A release by its declared types: what was suppressed is missing where numbers are wanted."""
    out = recode.release(part(spark, sf).select("p_partkey", *QIS), LEVELS | {"p_size": 0}, part_hierarchies(), [Model("k-Anonymity", 5)])
    return schema.typed_projection(out, [AttributeSpec.of("p_brand"), AttributeSpec.of("p_size", "continuous")], ["p_partkey"])


# --- privacy models --------------------------------------------------------------------------------

SEGMENTS = {"*": {"INDUSTRY": ["AUTOMOBILE", "MACHINERY"], "HOME": ["BUILDING", "FURNITURE", "HOUSEHOLD"]}}
_CELL = "cell AS (SELECT c_nationkey, c_mktsegment AS s, count(*) AS n FROM customer GROUP BY ALL), size AS (SELECT c_nationkey, CAST(sum(n) AS BIGINT) AS class_size FROM cell GROUP BY 1)"
_GRID = (
    f"WITH {_CELL}, q AS (SELECT c_mktsegment AS s, count(*) / CAST((SELECT count(*) FROM customer) AS DOUBLE) AS q FROM customer GROUP BY 1), "
    "grid AS (SELECT size.c_nationkey, q.s, class_size, coalesce(n, 0) / CAST(class_size AS DOUBLE) AS p, q FROM size CROSS JOIN q LEFT JOIN cell ON cell.c_nationkey = size.c_nationkey AND cell.s = q.s)"
)


def _nations(spark, sf):
    return customers(spark, sf).select("c_custkey", "c_nationkey", "c_mktsegment")


@query(f"WITH {_CELL} SELECT c_nationkey, class_size, n_distinct, n_distinct >= 5 AS ok FROM size JOIN (SELECT c_nationkey, count(*) AS n_distinct FROM cell GROUP BY 1) USING (c_nationkey)")
def distinct_l_diversity(spark, sf):
    return privacy.distinct_l_diversity(_nations(spark, sf), ["c_nationkey"], "c_mktsegment", 5)


@query(f"WITH {_CELL}, e AS (SELECT c_nationkey, class_size, -sum(n / CAST(class_size AS DOUBLE) * ln(n / CAST(class_size AS DOUBLE))) AS entropy FROM cell JOIN size USING (c_nationkey) GROUP BY 1, 2) SELECT c_nationkey, class_size, round(entropy, 6) AS entropy, entropy >= ln(4.5) - 1e-9 AS ok FROM e")
def entropy_l_diversity(spark, sf):
    return rounded(privacy.entropy_l_diversity(_nations(spark, sf), ["c_nationkey"], "c_mktsegment", 4.5))


@query(_GRID + ", e AS (SELECT c_nationkey, class_size, sum(abs(p - q)) / 2 AS emd FROM grid GROUP BY 1, 2) SELECT c_nationkey, class_size, round(emd, 6) AS emd, emd <= 0.1 + 1e-9 AS ok FROM e")
def t_closeness_equal(spark, sf):
    return rounded(privacy.t_closeness_equal(_nations(spark, sf), ["c_nationkey"], "c_mktsegment", 0.1))


@query(
    _GRID
    + """, leaf AS (SELECT *, CASE WHEN s IN ('AUTOMOBILE', 'MACHINERY') THEN 'INDUSTRY' ELSE 'HOME' END AS g, p - q AS x FROM grid),
l1 AS (SELECT c_nationkey, g, least(sum(greatest(x, 0)), sum(greatest(-x, 0))) AS c, sum(x) AS x FROM leaf GROUP BY 1, 2),
l2 AS (SELECT c_nationkey, least(sum(greatest(x, 0)), sum(greatest(-x, 0))) AS c FROM l1 GROUP BY 1),
e AS (SELECT l2.c_nationkey, l2.c + (SELECT sum(c) / 2 FROM l1 WHERE l1.c_nationkey = l2.c_nationkey) AS emd FROM l2)
SELECT c_nationkey, class_size, round(emd, 6) AS emd, emd <= 0.08 + 1e-9 AS ok FROM e JOIN size USING (c_nationkey)"""
)
def t_closeness_hier(spark, sf):
    return rounded(privacy.t_closeness_hierarchical(_nations(spark, sf), ["c_nationkey"], "c_mktsegment", Hierarchy.nested("c_mktsegment", SEGMENTS), 0.08))


def _tree_sql(name: str, value: str, groups: list[str]) -> str:
    """The distance of ``value`` over a tree whose inner labels are ``groups``, coarser ones last, for classes of a key with nulls."""
    levels = [value, *groups, "'*'"]
    height = len(levels) - 1
    steps = [
        f"{name}{i} AS (SELECT k, {' || '.join(f'p{j}' for j in range(i, height + 1))} AS node, greatest(least(sum(greatest(x, 0)), sum(greatest(-x, 0))), 0) * {i} / {height} AS c "
        f"FROM (SELECT k, {', '.join(f'p{j}' for j in range(i, height + 1))}, sum(x) AS x FROM {name}x GROUP BY k, {', '.join(f'p{j}' for j in range(i - 1, height + 1))}) GROUP BY ALL)"
        for i in range(1, height + 1)
    ]
    return (
        f"{name}v AS (SELECT nullif(c_nationkey, 3) AS k, {', '.join(f'{e} AS p{i}' for i, e in enumerate(levels))} FROM customer), "
        f"{name}x AS (SELECT z.k, d.*, coalesce(n, 0) / CAST(z.size AS DOUBLE) - d.m / CAST((SELECT count(*) FROM customer) AS DOUBLE) AS x FROM (SELECT k, count(*) AS size FROM {name}v GROUP BY 1) z "
        f"CROSS JOIN (SELECT {', '.join(f'p{i}' for i in range(height + 1))}, count(*) AS m FROM {name}v GROUP BY ALL) d LEFT JOIN (SELECT k, p0, count(*) AS n FROM {name}v GROUP BY ALL) c ON c.k IS NOT DISTINCT FROM z.k AND c.p0 = d.p0), "
        + ", ".join(steps)
        + f", {name} AS (SELECT k, sum(c) AS emd FROM ({' UNION ALL '.join(f'SELECT k, c FROM {name}{i}' for i in range(1, height + 1))}) GROUP BY 1)"
    )


_INDUSTRY = "CASE WHEN c_mktsegment IN ('AUTOMOBILE', 'MACHINERY') THEN 'INDUSTRY' ELSE 'HOME' END"
_BALANCE = "CAST(CAST(floor(c_acctbal / 1000) AS INT) AS VARCHAR)"


@query(
    f"WITH {_tree_sql('s', 'c_mktsegment', [_INDUSTRY])}, "
    f"{_tree_sql('b', _BALANCE, ['CAST(CAST(floor(c_acctbal / 3000) AS INT) AS VARCHAR)', 'CAST(CAST(floor(c_acctbal / 6000) AS INT) AS VARCHAR)'])}, "
    "size AS (SELECT nullif(c_nationkey, 3) AS k, count(*) AS class_size FROM customer GROUP BY 1) "
    "SELECT size.k AS nation, class_size, round(greatest(s.emd, b.emd), 6) AS emd, greatest(s.emd, b.emd) <= 0.08 + 1e-9 AS ok FROM size JOIN s ON s.k IS NOT DISTINCT FROM size.k JOIN b ON b.k IS NOT DISTINCT FROM size.k"
)
def t_closeness_trees(spark, sf):
    """Two sensitive columns, each with its own tree, and a class whose quasi-identifier is null."""
    balance = F.floor(F.col("c_acctbal") / 1000).cast("int")
    df = customers(spark, sf).select(F.nullif(F.col("c_nationkey"), F.lit(3)).alias("nation"), "c_mktsegment", balance.alias("balance"))
    coarser = lambda of: lambda c: F.floor(c.cast("int") / of).cast("int").cast("string")
    trees = {"c_mktsegment": Hierarchy.nested("c_mktsegment", SEGMENTS), "balance": Hierarchy("balance", rules=[coarser(3), coarser(6), lambda c: F.lit("*")])}
    return rounded(privacy.t_closeness_trees(df, ["nation"], trees, 0.08))


@query(_GRID + " SELECT c_nationkey, class_size, bool_and(CASE WHEN p > 0 THEN abs(ln(p / q)) < 0.5 - 1e-9 ELSE false END) AS ok FROM grid GROUP BY 1, 2")
def d_disclosure(spark, sf):
    return privacy.d_disclosure(_nations(spark, sf), ["c_nationkey"], "c_mktsegment", 0.5)


@query(_GRID + ", e AS (SELECT c_nationkey, class_size, max(CASE WHEN p > q THEN (p - q) / q - least(0.4, -ln(q)) ELSE 0.0 END) AS excess FROM grid GROUP BY 1, 2) SELECT c_nationkey, class_size, round(excess, 6) AS excess, excess <= 1e-9 AS ok FROM e")
def b_likeness(spark, sf):
    return rounded(privacy.enhanced_b_likeness(_nations(spark, sf), ["c_nationkey"], "c_mktsegment", 0.4))


@query("SELECT nullif(c_nationkey, 3) AS nation, count(DISTINCT c_mktsegment) >= 5 AND count(DISTINCT CAST(floor(c_acctbal / 1000) AS INT)) >= 11 AS ok FROM customer GROUP BY 1")
def sensitive_columns(spark, sf):
    """A model that names no attributes holds for every sensitive column."""
    specs = [AttributeSpec.of("nation"), AttributeSpec.of("c_mktsegment", role="SENSITIVE"), AttributeSpec.of("balance", role="SENSITIVE")]
    df = customers(spark, sf).select(F.nullif(F.col("c_nationkey"), F.lit(3)).alias("nation"), "c_mktsegment", F.floor(F.col("c_acctbal") / 1000).cast("int").alias("balance"))
    sensitive = schema.sensitive_attributes(specs)
    five, eleven = Model("DistinctLDiversity", 5, ("c_mktsegment",)), Model("DistinctLDiversity", 5)
    both = privacy.satisfied(df, ["nation"], [five, eleven], sensitive)
    more = privacy.satisfied(df, ["nation"], [Model("DistinctLDiversity", 11)], ["balance"])
    return both.join(more.select(F.col("nation").alias("__n"), F.col("ok").alias("__ok")), F.col("nation").eqNullSafe(F.col("__n"))).select("nation", (F.col("ok") & F.col("__ok")).alias("ok"))


_FINE_SQL = f"g AS (SELECT p_partkey, {_B[1]} AS p_brand, {_T[0]} AS p_type, {_S[1]} AS p_size FROM part)"


def fine(spark, sf) -> DataFrame:
    return hierarchy.generalize(part(spark, sf).select("p_partkey", *QIS), _FINE, part_hierarchies())


@query(
    f"""WITH {_FINE_SQL}, k AS (SELECT p_brand, p_type, p_size, count(*) AS class_size FROM g GROUP BY ALL),
h AS (SELECT class_size, count(*) AS n FROM k GROUP BY 1),
c AS (SELECT class_size, sum(n) OVER w / CAST(sum(n * class_size) OVER w AS DOUBLE) AS share FROM h WINDOW w AS (ORDER BY class_size DESC ROWS UNBOUNDED PRECEDING))
SELECT k.*, coalesce(class_size >= (SELECT min(class_size) FROM c WHERE share <= 0.09 + 1e-9), false) AS ok FROM k"""
)
def avg_reid_risk(spark, sf):
    return privacy.average_reidentification_risk(fine(spark, sf), QIS, 0.09)


_EPS, _DELTA = 1.0, 1e-3


@query(
    f"""WITH {_FINE_SQL}, u AS (SELECT *, CAST('0x' || substr(md5('0:dp:' || CAST(p_partkey AS VARCHAR)), 1, 12) AS BIGINT) / 281474976710656.0 < {privacy.safepub_beta(_EPS)!r} AS is_sampled FROM g),
k AS (SELECT p_brand, p_type, p_size, count(*) AS n FROM u WHERE is_sampled GROUP BY ALL)
SELECT u.p_partkey, u.p_brand, u.p_type, u.p_size, is_sampled, NOT (is_sampled AND coalesce(n, 0) >= {privacy.safepub_k(_EPS, _DELTA)}) AS is_suppressed FROM u LEFT JOIN k USING (p_brand, p_type, p_size)"""
)
def dp_safepub(spark, sf):
    return privacy.safepub(fine(spark, sf), "p_partkey", QIS, _EPS, _DELTA)


@query()
def population_uniqueness(spark, sf):
    df = part(spark, sf)
    return privacy.population_uniqueness(df, QIS, 0.0005, 20.0 * max(1, df.count()))


@query(f"WITH k AS (SELECT p_brand, p_type, p_size, count(*) AS class_size FROM part GROUP BY ALL), n AS (SELECT CAST(sum(class_size) AS DOUBLE) AS n, sum(CASE WHEN class_size = 1 THEN 1 ELSE 0 END) AS own FROM k) SELECT k.*, class_size >= CASE WHEN own / n <= 0.01 THEN 1 ELSE 2 END AS ok FROM k, n")
def sample_uniqueness(spark, sf):
    # the population is the table itself: its uniques are known
    return privacy.population_uniqueness(part(spark, sf), QIS, 0.01, 0.0)


def _zayatz_sql(threshold: float, factor: float) -> str:
    """Zayatz's estimate for every cut; the first that holds wins. Population is ``factor`` times the table."""
    return f"""WITH k AS (SELECT p_brand, p_type, p_size, count(*) AS class_size FROM part GROUP BY ALL), h AS (SELECT class_size AS z, CAST(count(*) AS DOUBLE) AS f FROM k GROUP BY 1), p AS (SELECT {factor} * count(*) AS pop FROM part),
e AS (SELECT a.z AS cut, sum(b.z * b.f) / any_value(pop) AS pi, sum(b.f) AS u, sum(CASE WHEN b.z = 1 THEN b.f ELSE 0 END) AS own, any_value(pop) AS pop FROM h a JOIN h b ON b.z >= a.z, p GROUP BY 1),
s AS (SELECT cut, any_value(own) AS own, any_value(pi) AS pi, any_value(u) AS u, any_value(pop) AS pop, sum(f / u * z * pi * power(1 - pi, z - 1)) AS seen FROM e JOIN h ON h.z >= e.cut GROUP BY 1),
c AS (SELECT coalesce(min(CASE WHEN CASE WHEN own = 0 THEN 0 ELSE least(own * (own / u * pi) / seen, pop) END / pop <= {threshold} THEN cut END), max(cut) + 1) AS cut FROM s)
SELECT k.*, class_size >= cut AS ok FROM k, c"""


@query(_zayatz_sql(0.0005, 20.0))
def population_uniqueness_zayatz(spark, sf):
    df = part(spark, sf)
    return privacy.population_uniqueness(df, QIS, 0.0005, 20.0 * max(1, df.count()), "ZAYATZ")


# --- quality ---------------------------------------------------------------------------------------


def _leaf_sql(a: str, level: str) -> str:
    return f"SELECT {level} AS label, count(DISTINCT {a}) AS k FROM part GROUP BY 1"


def _gran_sql(a: str, level: str) -> str:
    return (
        f"SELECT '{a}' AS attribute, round(1 - avg(CASE WHEN is_suppressed THEN 1.0 ELSE (k - 1) / CAST(d - 1 AS DOUBLE) END), 6) AS granularity "
        f"FROM rel LEFT JOIN ({_leaf_sql(a, level)}) l ON l.label = rel.{a}, (SELECT count(DISTINCT {a}) AS d FROM part)"
    )


@query(f"WITH {_KSUP} " + " UNION ALL ".join(_gran_sql(a, e[1]) for a, e in (("p_brand", _B), ("p_type", _T), ("p_size", _S))))
def granularity(spark, sf):
    return rounded(cl.granularity(released(spark, sf), part(spark, sf), LEVELS, part_hierarchies()))


@query(f"WITH {_KSUP}, n AS (SELECT CAST(count(*) AS DOUBLE) AS n, CAST(sum(CASE WHEN is_suppressed THEN 1 ELSE 0 END) AS DOUBLE) AS gone FROM rel), z AS (SELECT coalesce(sum(z * z), 0) AS q FROM (SELECT CAST(count(*) AS DOUBLE) AS z FROM rel WHERE NOT is_suppressed GROUP BY p_brand, p_type, p_size)) SELECT q + n * gone AS discernibility_raw, round(1 - (q + n * gone - n) / (n * n - n), 6) AS discernibility FROM n, z")
def discernibility(spark, sf):
    return rounded(cl.discernibility(released(spark, sf), QIS))


def _ent_sql(a: str, level: str) -> str:
    return (
        f"SELECT '{a}' AS attribute, round(1 - sum(CASE WHEN is_suppressed THEN -log2(fv / n) ELSE -log2(fv / fl) END) / sum(-log2(fv / n)), 6) AS entropy FROM ("
        f"SELECT is_suppressed, count(*) OVER (PARTITION BY part.{a}) AS fv, CAST(count(*) OVER () AS DOUBLE) AS n, CAST(fl AS DOUBLE) AS fl FROM rel JOIN part USING (p_partkey) LEFT JOIN "
        f"(SELECT {level} AS label, count(*) AS fl FROM part GROUP BY 1) l ON l.label = rel.{a})"
    )


@query(f"WITH {_KSUP} " + " UNION ALL ".join(_ent_sql(a, e[1]) for a, e in (("p_brand", _B), ("p_type", _T), ("p_size", _S))))
def nonuniform_entropy(spark, sf):
    return rounded(cl.nonuniform_entropy(released(spark, sf), part(spark, sf), "p_partkey", LEVELS, part_hierarchies()))


def _three(v: str) -> str:
    """Three decimals, half up, of the decimal number that the double prints as."""
    return f"CAST(CAST(CAST(CAST({v} AS VARCHAR) AS DECIMAL(30, 14)) AS DECIMAL(18, 3)) AS VARCHAR)"


@query(
    f"WITH {_KSUP}, s AS (SELECT CAST(p_size AS DOUBLE) AS v FROM part), a AS (SELECT CAST(p.p_size AS DOUBLE) AS v FROM part p JOIN rel USING (p_partkey) WHERE NOT is_suppressed) SELECT 'p_size' AS attribute, "
    + ", ".join(f"'[' || {_three(f'(SELECT {f}(v) FROM s)')} || ', ' || {_three(f'(SELECT {f}(v) FROM a)')} || ']' AS {name}" for f, name in (("min", "min"), ("max", "max"), ("avg", "mean"), ("median", "median")))
)
def location_limits(spark, sf):
    df = part(spark, sf).select("p_partkey", "p_size")
    out = released(spark, sf).select("p_partkey", "is_suppressed").join(df, "p_partkey")
    return cl.location_and_limits(df, out, ["p_size"])


# --- micro-aggregation -----------------------------------------------------------------------------

_CLASS = ["p_brand", "p_type"]


def _micro(name: str, function: str, sql: str, numeric: bool = True):
    def run(spark, sf):
        out = recode.micro_aggregate(part(spark, sf).select("p_partkey", *_CLASS, "p_size"), _CLASS, {"p_size": function})
        return rounded(out.withColumn("p_size", F.col("p_size").cast("double"))) if numeric else out

    run.__name__ = name
    value = f"round(CAST({sql} AS DOUBLE), 6)" if numeric else sql
    query(f"SELECT p_partkey, p_brand, p_type, v AS p_size FROM part JOIN (SELECT p_brand, p_type, {value} AS v FROM part GROUP BY 1, 2) USING (p_brand, p_type)", name)(run)


_micro("microagg_mean", "ARITHMETIC_MEAN", "avg(p_size)")
_micro("microagg_geomean", "GEOMETRIC_MEAN", "exp(avg(ln(p_size)))")
_micro("microagg_median", "MEDIAN", "median(p_size)")
_micro("microagg_interval", "INTERVAL", "'[' || CAST(min(p_size) AS VARCHAR) || ', ' || CAST(max(p_size) AS VARCHAR) || ']'", False)
_micro("microagg_set", "SET", "'{' || array_to_string(list_sort(list(DISTINCT p_size)), ', ') || '}'", False)


@query("SELECT p_partkey, p_brand, p_type, v AS p_size FROM part JOIN (SELECT p_brand, p_type, p_size AS v FROM (SELECT p_brand, p_type, p_size, count(*) AS n FROM part GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY p_brand, p_type ORDER BY n DESC, p_size) = 1) USING (p_brand, p_type)")
def microagg_mode(spark, sf):
    return recode.micro_aggregate(part(spark, sf).select("p_partkey", *_CLASS, "p_size"), _CLASS, {"p_size": "MODE"})


@query(f"SELECT p_partkey, p_brand, g.s AS size_class, m AS p_size FROM (SELECT p_partkey, p_brand, {_S[1]} AS s FROM part) g JOIN (SELECT p_brand, {_S[1]} AS s, round(avg(p_size), 6) AS m FROM part GROUP BY 1, 2) USING (p_brand, s)")
def microagg_cluster(spark, sf):
    df = part(spark, sf).select("p_partkey", "p_brand", part_hierarchies()["p_size"].label(F.col("p_size"), 1).alias("size_class"), "p_size")
    return rounded(recode.micro_aggregate(df, ["p_brand", "size_class"], {"p_size": "ARITHMETIC_MEAN"}))


@query("SELECT p_partkey, p_brand, m AS p_retailprice FROM part JOIN (SELECT p_brand, round(avg(p_retailprice), 6) AS m FROM part GROUP BY 1) USING (p_brand)")
def microagg_noclust(spark, sf):
    return rounded(recode.micro_aggregate(part(spark, sf).select("p_partkey", "p_brand", "p_retailprice"), ["p_brand"], {"p_retailprice": "ARITHMETIC_MEAN"}))


# --- lattice ---------------------------------------------------------------------------------------

_NODES = [(b, t, s) for b in range(3) for t in range(3) for s in range(4)]


def _node_sql(b: int, t: int, s: int) -> str:
    cost = " ".join(
        f", (sum(CASE WHEN z >= 5 THEN z * x{i} ELSE z END) / CAST(sum(z) AS DOUBLE)) AS l{i}" for i in range(3)
    )
    shares = ", ".join(f"(SELECT count(DISTINCT {a}) / CAST((SELECT count(DISTINCT {a}) FROM part) AS DOUBLE) FROM part q WHERE {e.replace(a, 'q.' + a)} = k.k{i}) AS x{i}" for i, (a, e) in enumerate((("p_brand", _B[b]), ("p_type", _T[t]), ("p_size", _S[s]))))
    return (
        f"SELECT '{b},{t},{s}' AS levels, {b + t + s} AS height, CAST(coalesce(sum(CASE WHEN z >= 5 THEN 1 ELSE 0 END), 0) AS BIGINT) AS classes, CAST(coalesce(sum(CASE WHEN z < 5 THEN z ELSE 0 END), 0) AS BIGINT) AS suppressed{cost} "
        f"FROM (SELECT k.z, {shares} FROM (SELECT {_B[b]} AS k0, {_T[t]} AS k1, {_S[s]} AS k2, count(*) AS z FROM part GROUP BY 1, 2, 3) k)"
    )


_EVALUATED = "WITH v AS (" + " UNION ALL ".join(_node_sql(*n) for n in _NODES) + ")"


def _evaluated(spark, sf) -> DataFrame:
    h = part_hierarchies()
    base = search.base_tuples(part(spark, sf), h)
    return search.evaluate(base, QIS, search.lattice(h), 5)


@query("WITH v AS (" + " UNION ALL ".join(_node_sql(*n) for n in _NODES if n[0] >= 1 and n[1] <= 1 and 1 <= n[2] <= 2) + ") SELECT levels, CAST(height AS INT) AS height, classes, suppressed FROM v")
def lattice_nodes(spark, sf):
    """The nodes within level bounds, by what each leaves of the table."""
    h = part_hierarchies()
    nodes = search.lattice(h, {"p_brand": (1, None), "p_type": (None, 1), "p_size": (1, 2)})
    out = search.evaluate(search.base_tuples(part(spark, sf), h), QIS, nodes, 5)
    return out.select(F.array_join(F.col("levels").cast("array<string>"), ",").alias("levels"), F.aggregate("levels", F.lit(0), lambda x, y: x + y).alias("height"), "classes", "suppressed")


@query(_EVALUATED + " SELECT levels, classes, suppressed, round(exp((ln(l0) + ln(l1) + ln(l2)) / 3), 6) AS loss FROM v")
def lattice_evaluate(spark, sf):
    return rounded(_evaluated(spark, sf).select(F.array_join(F.col("levels").cast("array<string>"), ",").alias("levels"), "classes", "suppressed", "loss"))


@query(_EVALUATED + " SELECT levels, classes, suppressed, round(exp((ln(l0) + ln(l1) + ln(l2)) / 3), 6) AS loss FROM v ORDER BY round(exp((ln(l0) + ln(l1) + ln(l2)) / 3), 9), height, levels LIMIT 1")
def lattice_best(spark, sf):
    best = search.best_node(_evaluated(spark, sf))
    return rounded(best.select(F.array_join(F.col("levels").cast("array<string>"), ",").alias("levels"), "classes", "suppressed", "loss"))


@query(f"WITH v AS ({_node_sql(1, 1, 1)}) SELECT levels, classes, suppressed, round((l0 + l1 + l2) / 3, 6) AS loss FROM v")
def loss_metric(spark, sf):
    h = part_hierarchies()
    out = search.evaluate(search.base_tuples(part(spark, sf), h), QIS, [(1, 1, 1)], 5, aggregate="ARITHMETIC_MEAN")
    return rounded(out.select(F.array_join(F.col("levels").cast("array<string>"), ",").alias("levels"), "classes", "suppressed", "loss"))


# searches under other models: a made sensitive column of up to seven values, unevenly spread
_KIND = "CAST((p_partkey * p_partkey) % 11 % 7 AS VARCHAR)"


def _searched_sql(ok: str, limit: float) -> str:
    """The best node by trying all of them: ``ok`` reads a class's size ``z``, its counts ``f0``.. of the sensitive values and their shares ``q0``.. of the table."""
    def node(b: int, t: int, s: int) -> str:
        shares = ", ".join(f"(SELECT count(DISTINCT {a}) / CAST((SELECT count(DISTINCT {a}) FROM part) AS DOUBLE) FROM part q WHERE {e.replace(a, 'q.' + a)} = k.k{i}) AS x{i}" for i, (a, e) in enumerate((("p_brand", _B[b]), ("p_type", _T[t]), ("p_size", _S[s]))))
        cost = " ".join(f", sum(CASE WHEN ok THEN z * x{i} ELSE z END) / CAST(sum(z) AS DOUBLE) AS l{i}" for i in range(3))
        counts = ", ".join(f"count(*) FILTER (WHERE {_KIND} = '{i}') AS f{i}" for i in range(7))
        return (
            f"SELECT '{b},{t},{s}' AS levels, {b + t + s} AS height, CAST(sum(z) AS BIGINT) AS n, CAST(coalesce(sum(CASE WHEN NOT ok THEN z ELSE 0 END), 0) AS BIGINT) AS suppressed{cost} "
            f"FROM (SELECT k.z, {ok} AS ok, {shares} FROM (SELECT {_B[b]} AS k0, {_T[t]} AS k1, {_S[s]} AS k2, count(*) AS z, {counts} FROM part GROUP BY 1, 2, 3) k, q)"
        )

    table = "q AS (SELECT " + ", ".join(f"count(*) FILTER (WHERE {_KIND} = '{i}') / CAST(count(*) AS DOUBLE) AS q{i}" for i in range(7)) + " FROM part)"
    return f"WITH {table}, v AS (" + " UNION ALL ".join(node(*n) for n in _NODES) + f") SELECT levels FROM v ORDER BY suppressed > {limit} * n + 1e-9, CASE WHEN suppressed > {limit} * n + 1e-9 THEN suppressed ELSE 0 END, round(exp((ln(l0) + ln(l1) + ln(l2)) / 3), 9), height, levels LIMIT 1"


def _searched(spark, sf, models, limit: float, algorithm: str = "OPTIMAL") -> DataFrame:
    kind = (F.col("p_partkey") * F.col("p_partkey") % 11 % 7).cast("string")
    df = part(spark, sf).select(*QIS, kind.alias("kind"))
    best = search.Search(part_hierarchies(), algorithm=algorithm, models=models, sensitive=["kind"], limit=limit).run(df)
    return spark.createDataFrame([(",".join(str(best[q]) for q in QIS),)], "levels string")


def _search(name: str, ok: str, models, limit: float) -> None:
    def run(spark, sf):
        return _searched(spark, sf, models, limit)

    run.__name__ = name
    query(_searched_sql(ok, limit), name)(run)


_EACH = range(7)
_search("search_suppression_limit", "z >= 5", [Model("k-Anonymity", 5)], 0.01)
_search("search_l_diversity", " + ".join(f"CAST(f{i} > 0 AS INT)" for i in _EACH) + " >= 5", [Model("DistinctLDiversity", 5)], 0.2)
_search("search_entropy_l_diversity", "(" + " + ".join(f"CASE WHEN f{i} > 0 THEN -f{i} / CAST(z AS DOUBLE) * ln(f{i} / CAST(z AS DOUBLE)) ELSE 0 END" for i in _EACH) + ") >= ln(4.5) - 1e-9", [Model("EntropyLDiversity", 4.5)], 0.3)
_search("search_t_closeness", "(" + " + ".join(f"abs(f{i} / CAST(z AS DOUBLE) - q{i})" for i in _EACH) + ") / 2 <= 0.3 + 1e-9", [Model("EqualDistanceTCloseness", 0.3)], 0.4)
_search("search_d_disclosure", " AND ".join(f"CASE WHEN f{i} > 0 THEN abs(ln(f{i} / CAST(z AS DOUBLE) / q{i})) < 1.5 - 1e-9 ELSE q{i} = 0 END" for i in _EACH), [Model("DDisclosurePrivacy", 1.5)], 0.5)
_search("search_two_models", "z >= 8 AND (" + " + ".join(f"CAST(f{i} > 0 AS INT)" for i in _EACH) + ") >= 3", [Model("k-Anonymity", 8), Model("DistinctLDiversity", 3)], 0.05)


@query(
    "WITH c AS (SELECT c_custkey, c_nationkey, CASE WHEN c_acctbal > -950 THEN c_acctbal END AS a FROM customer) SELECT c_custkey, round(avg(a) OVER w, 6) AS skipped, round(CASE WHEN count(a) OVER w = count(*) OVER w THEN avg(a) OVER w END, 6) AS kept FROM c WINDOW w AS (PARTITION BY c_nationkey)"
)
def microagg_missing(spark, sf):
    """Missing values are skipped, or make their class's aggregate missing."""
    value = F.when(F.col("c_acctbal") > -950, F.col("c_acctbal"))
    df = table(spark, sf, "customer").select("c_custkey", "c_nationkey", value.alias("skipped"), value.alias("kept"))
    out = recode.micro_aggregate(df, ["c_nationkey"], {"skipped": "ARITHMETIC_MEAN", "kept": "ARITHMETIC_MEAN"}, {"skipped": True, "kept": False})
    return rounded(out.select("c_custkey", "skipped", "kept"))


@query(
    "WITH p AS (SELECT p_partkey, p_partkey % 3 AS sample_id, p_size % 5 AS bin, p_type FROM part), n AS (SELECT *, count(*) OVER (PARTITION BY sample_id, bin) AS n FROM p), "
    "m AS (SELECT sample_id, bin, p_type AS mode FROM p GROUP BY sample_id, bin, p_type QUALIFY row_number() OVER (PARTITION BY sample_id, bin ORDER BY count(*) DESC, p_type) = 1) "
    "SELECT p_partkey, CASE WHEN n >= 130 THEN CAST(bin AS VARCHAR) ELSE '*' END AS bin, CASE WHEN n >= 130 THEN mode ELSE '*' END AS p_type, n < 130 AS is_suppressed FROM n JOIN m USING (sample_id, bin)"
)
def microagg_samples(spark, sf):
    """Samples released by a configured method: classes of each, and an attribute that becomes its class's commonest value."""
    df = part(spark, sf).select("p_partkey", (F.col("p_partkey") % 3).alias("sample_id"), (F.col("p_size") % 5).alias("bin"), "p_type")
    models = [Model("k-Anonymity", 130)]
    method = Anonymizer(search.Search({"bin": Hierarchy.identity("bin")}, models=models), models, "p_partkey", micro={"p_type": "MODE"})
    return method.release_each(df, ["sample_id"]).select("p_partkey", "bin", "p_type", "is_suppressed")


_OF = 6


def _each_sample_sql(k: int, limit: float) -> str:
    """Every node of every sample, samples being rows of equal ``p_partkey % 6``; the best one of each."""
    def node(b: int, t: int, s: int) -> str:
        shares = ", ".join(f"(SELECT count(DISTINCT {a}) / CAST((SELECT count(DISTINCT {a}) FROM part) AS DOUBLE) FROM part q WHERE {e.replace(a, 'q.' + a)} = k.k{i}) AS x{i}" for i, (a, e) in enumerate((("p_brand", _B[b]), ("p_type", _T[t]), ("p_size", _S[s]))))
        cost = " ".join(f", sum(CASE WHEN z >= {k} THEN z * x{i} ELSE z END) / CAST(sum(z) AS DOUBLE) AS l{i}" for i in range(3))
        return (
            f"SELECT sample_id, '{b},{t},{s}' AS levels, {b + t + s} AS height, CAST(sum(z) AS BIGINT) AS n, CAST(coalesce(sum(CASE WHEN z < {k} THEN z ELSE 0 END), 0) AS BIGINT) AS suppressed{cost} "
            f"FROM (SELECT k.sample_id, k.z, {shares} FROM (SELECT p_partkey % {_OF} AS sample_id, {_B[b]} AS k0, {_T[t]} AS k1, {_S[s]} AS k2, count(*) AS z FROM part GROUP BY 1, 2, 3, 4) k) GROUP BY 1"
        )

    over = f"suppressed > {limit} * n + 1e-9"
    order = f"{over}, CASE WHEN {over} THEN suppressed ELSE 0 END, round(exp((ln(l0) + ln(l1) + ln(l2)) / 3), 9), height, levels"
    return "WITH v AS (" + " UNION ALL ".join(node(*n) for n in _NODES) + f") SELECT sample_id, levels FROM v QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY {order}) = 1"


@query(_each_sample_sql(4, 0.1))
def search_each_sample(spark, sf):
    """Samples are searched side by side; each has the level vector that is best for it alone."""
    df = part(spark, sf)
    samples = df.select((F.col("p_partkey") % _OF).alias("sample_id"), *QIS)
    found = search.Search(part_hierarchies(), models=[Model("k-Anonymity", 4)], limit=0.1).run_each(samples, ["sample_id"], df)
    return found.select("sample_id", F.array_join(F.col("levels").cast("array<string>"), ",").alias("levels"))


@query(
    f"WITH g AS (SELECT p_partkey, {_B[1]} AS p_brand, p_size % 5 AS bin FROM part), k AS (SELECT p_brand, bin, count(*) AS n FROM g GROUP BY ALL) "
    "SELECT p_partkey, CASE WHEN n >= 12 THEN p_brand ELSE '*' END AS p_brand, CASE WHEN n >= 12 THEN CAST(bin AS VARCHAR) ELSE '*' END AS bin, n < 12 AS is_suppressed FROM g JOIN k USING (p_brand, bin)"
)
def release_without_hierarchy(spark, sf):
    """A quasi-identifier without a hierarchy is part of the class by its values."""
    df = part(spark, sf).select("p_partkey", "p_brand", (F.col("p_size") % 5).alias("bin"))
    h = {"p_brand": part_hierarchies()["p_brand"], "bin": Hierarchy.identity("bin")}
    return recode.release(df, {"p_brand": 1, "bin": 0}, h, [Model("k-Anonymity", 12)])


_DP_SQL = f"""WITH {_FINE_SQL}, u AS (SELECT *, CAST('0x' || substr(md5('0:dp:' || CAST(p_partkey AS VARCHAR)), 1, 12) AS BIGINT) / 281474976710656.0 < {privacy.safepub_beta(_EPS)!r} AS inside FROM g),
k AS (SELECT p_brand, p_type, p_size, count(*) AS n FROM u WHERE inside GROUP BY ALL), r AS (SELECT u.*, inside AND n >= {privacy.safepub_k(_EPS, _DELTA)} AS live FROM u LEFT JOIN k USING (p_brand, p_type, p_size))
SELECT p_partkey, CASE WHEN live THEN p_brand ELSE '*' END AS p_brand, CASE WHEN live THEN p_type ELSE '*' END AS p_type, CASE WHEN live THEN p_size ELSE '*' END AS p_size, NOT coalesce(live, false) AS is_suppressed FROM r"""


@query(_DP_SQL)
def dp_release(spark, sf):
    return recode.release(part(spark, sf).select("p_partkey", *QIS), _FINE, part_hierarchies(), [Model("EDDifferentialPrivacy", _EPS, delta=_DELTA)], key="p_partkey")


_ROUNDS = [{"p_brand": 1, "p_type": 0, "p_size": 1}, {"p_brand": 1, "p_type": 1, "p_size": 2}]


@query(
    f"""WITH a AS (SELECT p_partkey, {_B[1]} AS b, {_T[0]} AS t, {_S[1]} AS s, {_B[1]} AS b2, {_T[1]} AS t2, {_S[2]} AS s2 FROM part),
r1 AS (SELECT *, count(*) OVER (PARTITION BY b, t, s) AS n FROM a), r2 AS (SELECT *, count(*) OVER (PARTITION BY b2, t2, s2) AS m FROM r1 WHERE n < 10)
SELECT p_partkey, b AS p_brand, t AS p_type, s AS p_size, false AS is_suppressed FROM r1 WHERE n >= 10 UNION ALL
SELECT p_partkey, CASE WHEN m >= 10 THEN b2 ELSE '*' END, CASE WHEN m >= 10 THEN t2 ELSE '*' END, CASE WHEN m >= 10 THEN s2 ELSE '*' END, m < 10 FROM r2"""
)
def local_recoding(spark, sf):
    # the last round keeps what it suppresses
    df = part(spark, sf).select("p_partkey", *QIS)
    return recode.local_recoding(df, "p_partkey", _ROUNDS, part_hierarchies(), [Model("k-Anonymity", 10)])


# --- features and attack ---------------------------------------------------------------------------

_BY = ["sample_id"]
_SAMPLES = "s AS (SELECT c_custkey % 2 AS sample_id, c_custkey % 10 = 0 AS x, CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE c_acctbal END AS a, CAST(c_nationkey AS DOUBLE) AS n, CASE WHEN c_custkey % 10 = 0 THEN '*' ELSE c_mktsegment END AS m FROM customer)"
_CODES = "d AS (SELECT v, CAST(dense_rank() OVER (ORDER BY v) - 1 AS INT) AS code FROM (SELECT DISTINCT m AS v FROM s UNION SELECT DISTINCT c_mktsegment FROM customer))"
_NUMERIC = ["c_acctbal", "c_nationkey"]


def _samples(spark, sf) -> DataFrame:
    gone = F.col("c_custkey") % 10 == 0
    return customers(spark, sf).select(
        (F.col("c_custkey") % 2).alias("sample_id"), F.when(~gone, F.col("c_acctbal")).alias("c_acctbal"), F.col("c_nationkey").cast("double").alias("c_nationkey"),
        F.when(gone, F.lit("*")).otherwise(F.col("c_mktsegment")).alias("c_mktsegment"), gone.alias("is_suppressed"),
    )


def _codes(spark, sf) -> DataFrame:
    values = schema.distinct_values(_samples(spark, sf), ["c_mktsegment"]).unionByName(schema.distinct_values(customers(spark, sf), ["c_mktsegment"]))
    return schema.dictionary(values)


_NAIVE = f"""WITH {_SAMPLES}, {_CODES}, c AS (SELECT sample_id, code, count(*) AS k FROM s JOIN d ON v = m GROUP BY 1, 2),
w AS (SELECT sample_id, avg(a) AS a0, median(a) AS a1, var_samp(a) AS a2, avg(n) AS n0, median(n) AS n1, var_samp(n) AS n2 FROM s GROUP BY 1),
k AS (SELECT sample_id, arg_min(code, k * 1000 + code) AS m0, arg_max(code, k * 1000 - code) AS m1, count(*) AS m2 FROM c GROUP BY 1),
naive AS (SELECT sample_id, 0 AS idx, a0 AS value FROM w UNION ALL SELECT sample_id, 1, a1 FROM w UNION ALL SELECT sample_id, 2, a2 FROM w UNION ALL SELECT sample_id, 3, m0 FROM k UNION ALL SELECT sample_id, 4, m1 FROM k
  UNION ALL SELECT sample_id, 5, m2 FROM k UNION ALL SELECT sample_id, 6, n0 FROM w UNION ALL SELECT sample_id, 7, n1 FROM w UNION ALL SELECT sample_id, 8, n2 FROM w)"""
_HIST = """, bin AS (SELECT sample_id, 'a' AS t, CASE WHEN a IS NULL THEN 0 ELSE least(greatest(floor((a + 1000) / 1100), 0), 9) END AS b FROM s WHERE NOT x UNION ALL SELECT sample_id, 'n', least(greatest(floor(n / 2.5), 0), 9) FROM s WHERE NOT x),
pos AS (SELECT 'a' AS t, i AS b, i AS idx FROM range(10) r(i) UNION ALL SELECT 'n', i, 10 + i FROM range(10) r(i)),
ids AS (SELECT DISTINCT sample_id FROM s),
hist AS (SELECT ids.sample_id, CAST(pos.idx AS INT) AS idx, CAST(count(bin.b) AS DOUBLE) AS value FROM ids CROSS JOIN pos LEFT JOIN bin ON bin.sample_id = ids.sample_id AND bin.t = pos.t AND bin.b = pos.b GROUP BY 1, 2
  UNION ALL SELECT ids.sample_id, CAST(20 + code AS INT), CAST(count(s.m) AS DOUBLE) FROM ids CROSS JOIN d LEFT JOIN s ON s.sample_id = ids.sample_id AND s.m = d.v GROUP BY 1, 2)"""
_CORR = """, cols AS (SELECT row_number() OVER () AS r, sample_id, coalesce(a, 0.0) AS a, n, m FROM s WHERE NOT x),
oh AS (SELECT r, sample_id, 0 AS p, a AS v FROM cols UNION ALL SELECT r, sample_id, 1, n FROM cols UNION ALL SELECT r, sample_id, 2 + code, CASE WHEN m = d.v THEN 1.0 ELSE 0.0 END FROM cols CROSS JOIN d),
dim AS (SELECT 2 + count(*) AS q FROM d),
cs AS (SELECT x.sample_id, x.p AS i, y.p AS j, CAST(count(*) AS DOUBLE) AS c, sum(x.v) AS sx, sum(y.v) AS sy, sum(x.v * y.v) AS sxy, sum(x.v * x.v) AS sxx, sum(y.v * y.v) AS syy FROM oh x JOIN oh y ON x.r = y.r AND x.p < y.p GROUP BY 1, 2, 3),
corr AS (SELECT sample_id, CAST(i * (2 * q - i - 1) // 2 + j - i - 1 AS INT) AS idx, CASE WHEN c * sxx - sx * sx <= 1e-9 * greatest(c * sxx, 1e-300) OR c * syy - sy * sy <= 1e-9 * greatest(c * syy, 1e-300) THEN 0.0
  ELSE (c * sxy - sx * sy) / (sqrt(c * sxx - sx * sx) * sqrt(c * syy - sy * sy)) END AS value FROM cs, dim)"""
_BOUNDS = {"c_acctbal": (-1000.0, 10000.0), "c_nationkey": (0.0, 25.0)}


@query(_NAIVE + " SELECT sample_id, idx, round(value, 6) AS value FROM naive")
def feature_naive(spark, sf):
    return rounded(features.naive(_samples(spark, sf), _NUMERIC, ["c_mktsegment"], _codes(spark, sf), _BY))


@query(_NAIVE + _HIST + " SELECT sample_id, idx, round(value, 6) AS value FROM hist")
def feature_histogram(spark, sf):
    return rounded(features.histogram(_samples(spark, sf), _BOUNDS, _codes(spark, sf), ["c_mktsegment"], _BY))


@query(_NAIVE + _HIST + _CORR + " SELECT sample_id, idx, round(value, 6) + 0.0 AS value FROM corr")
def feature_correlation(spark, sf):
    return rounded(features.correlation(_samples(spark, sf), _NUMERIC, ["c_mktsegment"], _codes(spark, sf), _BY))


@query(_NAIVE + _HIST + _CORR + ", h AS (SELECT count(DISTINCT idx) AS k FROM hist) SELECT sample_id, idx, round(value, 6) + 0.0 AS value FROM naive UNION ALL SELECT sample_id, idx + 9, value FROM hist UNION ALL SELECT sample_id, CAST(idx + 9 + k AS INT), round(value, 6) + 0.0 FROM corr, h")
def feature_ensemble(spark, sf):
    df, codes = _samples(spark, sf), _codes(spark, sf)
    n = codes.count()
    size = lambda k: features.feature_count(k, 2, [n])
    parts = [
        (features.naive(df, _NUMERIC, ["c_mktsegment"], codes, _BY), size("NAIVE")),
        (features.histogram(df, _BOUNDS, codes, ["c_mktsegment"], _BY), size("HISTOGRAM")),
        (features.correlation(df, _NUMERIC, ["c_mktsegment"], codes, _BY), size("CORRELATION")),
    ]
    return rounded(features.ensemble(parts, _BY))


@query(
    """WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings),
d AS (SELECT q.vec_id, t.label, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_sum(list_transform(list_zip(q.x, t.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), t.vec_id) AS r FROM e q JOIN e t ON q.vec_id % 2 = 1 AND t.vec_id % 2 = 0),
v AS (SELECT vec_id, label, count(*) AS n FROM d WHERE r <= 5 GROUP BY 1, 2)
SELECT vec_id, arg_max(label, n * 100000 - label) AS predicted, round(max(n) / 5.0, 6) AS confidence FROM v GROUP BY 1"""
)
def knn_predict(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("features"))
    return rounded(classify.knn_predict(e.where("vec_id % 2 = 0"), e.where("vec_id % 2 = 1"), key="vec_id"))


_PLAN = pa.Assessment(runs=2, train=3, test=2)


@query(
    """WITH t AS (SELECT CAST(c_custkey AS BIGINT) AS target_id, row_number() OVER (ORDER BY c_custkey) - 1 AS t, count(*) OVER () AS nt FROM customer WHERE c_custkey < 6),
e(pos, phase, k, target_in) AS (VALUES (0, 'train', 0, false), (1, 'train', 0, true), (2, 'train', 1, false), (3, 'train', 1, true), (4, 'train', 2, false), (5, 'train', 2, true), (6, 'test', 0, false), (7, 'test', 0, true), (8, 'test', 1, false), (9, 'test', 1, true))
SELECT CAST((r.run_id * nt + t) * 10 + pos AS BIGINT) AS sample_id, CAST(r.run_id AS INT) AS run_id, target_id, phase, CAST(k AS INT) AS k, target_in FROM range(2) r(run_id), t, e"""
)
def job_plan(spark, sf):
    return pa.job_plan(customers(spark, sf).where("c_custkey < 6"), "c_custkey", _PLAN)


_ENTRIES = "SELECT n_regionkey AS grp, CASE n_nationkey % 3 WHEN 0 THEN 'risk' WHEN 1 THEN 'data' ELSE 'anonymization' END AS kind, n_nationkey AS at, n_name AS path FROM nation"


@query(
    f"WITH e AS ({_ENTRIES}) SELECT CAST(row_number() OVER (ORDER BY r.grp, r.at, d.at, a.at) - 1 AS INT) AS position, r.path AS risk, d.path AS data, a.path AS anonymization "
    "FROM e r JOIN e d USING (grp) JOIN e a USING (grp) WHERE r.kind = 'risk' AND d.kind = 'data' AND a.kind = 'anonymization'"
)
def series_expand(spark, sf):
    kind = F.element_at(F.array(*map(F.lit, ("risk", "data", "anonymization"))), (F.col("n_nationkey") % 3 + 1).cast("int"))
    return pa.series_product(table(spark, sf, "nation").select(F.col("n_regionkey").alias("grp"), kind.alias("kind"), F.col("n_nationkey").alias("at"), F.col("n_name").alias("path")))


@query(_DIST + ", g AS (SELECT c_custkey AS target_id, k % 2 AS t, (c_custkey + k // 2) % 2 AS p FROM customer, range(4) r(k) WHERE c_custkey < 20) SELECT target_id, round(distance_normalised, 6) AS distance, round(sum(CASE WHEN t = p THEN 1 ELSE 0 END) / 4.0, 6) AS accuracy FROM g JOIN e ON e.c_custkey = target_id GROUP BY 1, 2")
def attack_accuracy(spark, sf):
    df = customers(spark, sf)
    guesses = df.where("c_custkey < 20").select(F.col("c_custkey").alias("target_id"), F.explode(F.array(*[F.lit(i) for i in range(4)])).alias("k"))
    guesses = guesses.select("target_id", (F.col("k") % 2).alias("true_label"), ((F.col("target_id") + F.floor(F.col("k") / 2)) % 2).alias("predicted"))
    return rounded(pa.attack_accuracy(guesses, targets.distances(df, "c_custkey", ATTACKED), "c_custkey", 1, 2))


def _attack(spark, sf, classifier: str) -> DataFrame:
    df = part(spark, sf).select("p_partkey", *QIS, "p_retailprice")
    picked = targets.select_targets(df, "p_partkey", "OUTLIER", 4, [*QIS, "p_retailprice"])
    plan = pa.Assessment(runs=1, train=8, test=4, cohort=80, background=80, sample=30, classifier=classifier, seed=3)
    models = [Model("k-Anonymity", 2)]
    if classifier == "RF":  # a search for every sample
        method = Anonymizer(search.Search(part_hierarchies(), models=models, limit=0.2), models, "p_partkey")
    else:
        method = FixedLevels(_FINE, part_hierarchies(), models)
    return rounded(pa.assess(df, "p_partkey", picked.select("p_partkey"), method, {"p_retailprice": (900.0, 1000.0)}, plan))


@query()
def attack_rf(spark, sf):
    return _attack(spark, sf, "RF")


@query()
def attack_lr(spark, sf):
    return _attack(spark, sf, "LR")


@query()
def attack_knn(spark, sf):
    return _attack(spark, sf, "KNN")


@query()
def utility_logreg(spark, sf):
    return rounded(classify.utility_accuracy(released(spark, sf), ["p_brand", "p_size"], "p_type", key="p_partkey"))

