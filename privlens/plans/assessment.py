"""The batched risk assessment: all samples of all jobs as rows of a few DataFrames keyed by ``sample_id``.

A job is one (run, target). Each job draws training pairs from the background and test pairs from the
cohort, a pair being a sample without the target and the same sample with it. Every sample is released,
turned into features and classified; no loop runs per sample.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from privlens.functions.scalar import ratio, seeded_order
from privlens.operators import classes as cl
from privlens.operators import features as fe
from privlens.operators.classify import predict_jobs, utility_accuracy_of_samples
from privlens.operators.anonymizer import Method
from privlens.operators.hierarchy import Hierarchy
from privlens.operators.sampling import overlapping_split
from privlens.operators.schema import dictionary, distinct_values
from privlens.sources.shared import discard, materialize
from privlens.sources.tables import LOG_COLUMNS


@dataclass(frozen=True)
class Assessment:
    """What an assessment varies; sizes are rows. ``sample`` is a training sample's size, ``sample_test`` a test sample's (0: the same)."""

    runs: int = 1
    train: int = 1
    test: int = 1
    cohort: int = 100
    background: int = 100
    sample: int = 50
    sample_test: int = 0
    overlap: float = 0.0
    features: str = "HISTOGRAM"
    classifier: str = "RF"
    seed: int = 0

    @property
    def per_job(self) -> int:
        return 2 * (self.train + self.test)

    def work(self, targets: int) -> int:
        """Releases that the assessment needs."""
        return targets * self.runs * self.per_job


def job_plan(targets: DataFrame, key: str, plan: Assessment) -> DataFrame:
    """``(sample_id, run_id, target_id, phase, k, target_in)``: the samples of every job, numbered from 0.

    Its size is ``plan.work(targets)``, the number of releases asked for.
    """
    spark = targets.sparkSession
    steps = [("train", i) for i in range(plan.train)] + [("test", i) for i in range(plan.test)]
    rows = [(2 * i + j, phase, k, bool(j)) for i, (phase, k) in enumerate(steps) for j in (0, 1)]
    each = spark.createDataFrame(rows, "at int, phase string, k int, target_in boolean")
    runs = spark.range(plan.runs).select(F.col("id").cast("int").alias("run_id"))
    numbered = targets.select(F.col(key).cast("long").alias("target_id")).distinct()
    numbered = numbered.withColumn("t", F.row_number().over(Window.orderBy("target_id")) - 1)  # targets are few by design
    base = (F.col("run_id").cast("long") * F.lit(1) * F.col("n_targets") + F.col("t")) * F.lit(plan.per_job) + F.col("at")
    n = numbered.agg(F.count("*").alias("n_targets"))
    return runs.crossJoin(numbered).crossJoin(F.broadcast(n)).crossJoin(each).select(base.cast("long").alias("sample_id"), "run_id", "target_id", "phase", "k", "target_in")


def series_product(entries: DataFrame) -> DataFrame:
    """``(position, risk, data, anonymization)``: in each group of ``entries(grp, kind, at, path)`` the product of its lists of the three kinds, in order of ``grp`` and ``at``.

    Positions are computed from the lists' lengths, so that the product is never gathered to be numbered.
    """
    kinds = ("risk", "data", "anonymization")
    own = Window.partitionBy("grp", "kind")  # a configuration list
    listed = entries.withColumns({"i": F.row_number().over(own.orderBy("at")) - 1, "n": F.count("*").over(own)})
    sides = [listed.where(F.col("kind") == k).select("grp", F.col("path").alias(k), F.col("i").alias(f"i_{k}"), F.col("n").alias(f"n_{k}")) for k in kinds]
    product = sides[0].join(sides[1], "grp").join(sides[2], "grp")
    lengths = product.groupBy("grp").agg(F.count("*").alias("length"))
    before = lengths.select("grp", (F.sum("length").over(Window.orderBy("grp")) - F.col("length")).alias("before"))  # a row per group of a series
    place = (F.col("i_risk") * F.col("n_data") + F.col("i_data")) * F.col("n_anonymization") + F.col("i_anonymization")
    return product.join(before, "grp").select((F.col("before") + place).cast("int").alias("position"), *kinds)


def series_expand(spark: SparkSession, groups: Sequence[Mapping[str, Sequence[str]]]) -> DataFrame:
    """:func:`series_product` of a series configuration's groups."""
    rows = [(g, kind, i, path) for g, lists in enumerate(groups) for kind, paths in lists.items() for i, path in enumerate(paths)]
    return series_product(spark.createDataFrame(rows, "grp int, kind string, at int, path string"))


def membership(df: DataFrame, key: str, jobs: DataFrame, plan: Assessment, rows: int, runs: Sequence[int] | None = None) -> DataFrame:
    """``(sample_id, key)``: who is in each sample.

    Pools are the cohort (test) or the background (train) of the run, without the job's target. The pair
    of a step shares one draw: the sample with the target loses the last row of the order. The result is a
    written table.
    """
    pools = None
    for run in range(plan.runs) if runs is None else runs:
        split = overlapping_split(df.select(key), key, plan.cohort, plan.background, plan.overlap, f"{plan.seed}:{run}", rows)
        part = split.select(F.lit(run).alias("run_id"), F.col(key), F.explode(F.array_compact(F.array(F.when(F.col("cohort"), F.lit("test")), F.when(F.col("background"), F.lit("train"))))).alias("phase"))
        pools = part if pools is None else pools.unionByName(part)
    draws = jobs.where("not target_in").select("run_id", "target_id", "phase", "k")
    on = ["run_id", "target_id", "phase", "k"]
    wanted = F.when(F.col("phase") == "train", plan.sample).otherwise(plan.sample_test or plan.sample)
    stream = F.concat_ws(":", F.lit("draw"), *on, F.col(key).cast("string"))
    ordered = draws.join(pools, ["run_id", "phase"]).where(F.col(key) != F.col("target_id")).withColumn("__o", seeded_order(plan.seed, "sample", stream))
    w = Window.partitionBy(*on).orderBy("__o", key)

    def drawn_below(bar: Column | None) -> DataFrame:
        # a draw takes its smallest digests: what lies clearly above the share it needs is gone before the shuffle
        some = ordered if bar is None else ordered.where(F.col("__o") <= bar)
        return some.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= wanted).select(*on, key, "__r")

    bars = {p: _digest_bar(n, size) for p, n, size in (("train", plan.sample, plan.background), ("test", plan.sample_test or plan.sample, plan.cohort))}
    drawn = materialize(drawn_below(F.when(F.col("phase") == "train", F.lit(bars["train"])).otherwise(F.lit(bars["test"]))), "draws")
    least = F.least(wanted, F.when(F.col("phase") == "train", plan.background).otherwise(plan.cohort) - 1)
    full = drawn.groupBy(*on).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    if not draws.join(full, on, "left_anti").isEmpty():
        discard(drawn)
        drawn = materialize(drawn_below(None), "draws")
    last = drawn.groupBy(*on).agg(F.max("__r").alias("__last"))
    pair = jobs.select("sample_id", *on, "target_in")
    kept = pair.join(drawn.join(last, on), on).where("not (target_in and __r = __last)").select("sample_id", F.col(key))
    members = materialize(kept.unionByName(pair.where("target_in").select("sample_id", F.col("target_id").cast(df.schema[key].dataType).alias(key))), "members")
    discard(drawn)
    return members


def _digest_bar(n: int, pool: int) -> str:
    """Six hexadecimal digits under which nearly surely at least ``n`` of ``pool`` uniform digests lie."""
    share = (n + 8.0 * math.sqrt(n) + 16.0) / max(pool - 1, 1)
    return "g" if share >= 1 else f"{min(16**6 - 1, math.ceil(share * 16**6)):06x}"


#: Feature types: functions ``(released, numeric, categorical, codes, by)`` to rows of ``(by, idx, value)``;
#: ``numeric`` maps attributes to their bounds. Add an entry for a type of your own.
FEATURES = {
    "NAIVE": lambda out, numeric, categorical, codes, by: fe.naive(out, list(numeric), categorical, codes, by),
    "HISTOGRAM": lambda out, numeric, categorical, codes, by: fe.histogram(out, numeric, codes, categorical, by),
    "CORRELATION": lambda out, numeric, categorical, codes, by: fe.correlation(out, list(numeric), categorical, codes, by),
}


def sample_features(df: DataFrame, out: DataFrame, method: Method, numeric: Mapping[str, tuple[float, float]], plan: Assessment, considered: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """The features of all samples of the releases ``out`` in one plan, and the dictionary, a written table."""
    by = ["sample_id"]
    names, hierarchies = list(method.names), method.hierarchies
    considered = names if considered is None else list(considered)
    numeric = {a: b for a, b in numeric.items() if a in considered or a not in names}
    categorical = [a for a in considered if a not in numeric]
    domain = distinct_values(df, categorical) if categorical else None
    for a in (c for c in categorical if c in names):
        labels = hierarchies[a].table(df.select(a).where(F.col(a).isNotNull()).distinct()).select("attribute", F.col("label").alias("value"))
        domain = domain.unionByName(labels)
    if made := [a for a in categorical if a in getattr(method, "micro", ())]:
        domain = domain.unionByName(distinct_values(out, made))  # aggregates are values of their own
    star = df.sparkSession.createDataFrame([(a, "*") for a in categorical], "attribute string, value string")
    codes = materialize(dictionary(domain.unionByName(star)) if categorical else star.withColumn("code", F.lit(0)), "codes")
    if plan.features == "ENSEMBLE":
        sizes = {r["attribute"]: r["n"] for r in codes.groupBy("attribute").agg(F.count("*").alias("n")).collect()}
        kinds = ("NAIVE", "HISTOGRAM", "CORRELATION")
        lengths = [fe.feature_count(k, len(numeric), [sizes[a] for a in categorical]) for k in kinds]
        return fe.ensemble([(FEATURES[k](out, numeric, categorical, codes, by), n) for k, n in zip(kinds, lengths)], by), codes
    return FEATURES[plan.features](out, numeric, categorical, codes, by), codes


def assess(df: DataFrame, key: str, targets: DataFrame, method: Method, numeric: Mapping[str, tuple[float, float]], plan: Assessment) -> DataFrame:
    """``(run_id, target_id, k, true_label, predicted, confidence, p_member)`` of every test sample."""
    guesses, released, jobs = assess_fully(df, key, targets, method, numeric, plan)
    discard(released, jobs)
    return guesses.drop("sample_id")


def assess_fully(df: DataFrame, key: str, targets: DataFrame, method: Method, numeric: Mapping[str, tuple[float, float]], plan: Assessment, jobs: DataFrame | None = None, runs: Sequence[int] | None = None, considered: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The guesses of :func:`assess` with their ``sample_id``, all samples' released rows with their keys, and the jobs, each a written table.

    ``method`` releases each sample by itself: a search, local recoding or micro-aggregation is the sample's own. ``jobs``
    may be given to assess only some of :func:`job_plan`'s rows, whose runs are then ``runs``. ``considered`` names the
    attributes that features are drawn from (default: those of the class and all of ``numeric``).
    """
    jobs = materialize(job_plan(targets, key, plan) if jobs is None else jobs, "jobs")
    members = membership(df, key, jobs, plan, df.count(), runs)
    out = materialize(release_samples(df, key, members, method), "released")
    done = judged(df, out, jobs, method, numeric, plan, considered)
    discard(members)
    return done, out, jobs


def release_samples(df: DataFrame, key: str, members: DataFrame, method: Method) -> DataFrame:
    """The released rows of every sample of ``members``, with their ``sample_id``."""
    return method.release_each(members.join(df, key), ["sample_id"], df)


def judged(df: DataFrame, released: DataFrame, jobs: DataFrame, method: Method, numeric: Mapping[str, tuple[float, float]], plan: Assessment, considered: Sequence[str] | None = None) -> DataFrame:
    """The guesses for the test samples of ``jobs`` from all their releases, a written table."""
    long, codes = sample_features(df, released, method, numeric, plan, considered)
    vectors = jobs.join(fe.dense(long, ["sample_id"]), "sample_id").withColumn("label", F.col("target_in").cast("int"))
    guesses = predict_jobs(vectors, ["run_id", "target_id"], plan.classifier, plan.seed)
    named = guesses.join(jobs.select("sample_id", "k", F.col("target_in").cast("int").alias("true_label")), "sample_id")
    done = materialize(named.select("sample_id", "run_id", "target_id", "k", "true_label", "predicted", "confidence", "p_member"), "guesses")
    discard(codes)
    return done


def assessment_log(df: DataFrame, key: str, guesses: DataFrame, released: DataFrame, levels: Mapping[str, int], hierarchies: Mapping[str, Hierarchy], numeric: Sequence[str], features: Sequence[str] = (), target: str = "") -> DataFrame:
    """A row per guess with the quality of its test sample, in the columns of the assessment log.

    ``numeric`` names the attributes of ``LocationAndLimits``; without ``features`` and a ``target`` the classification
    accuracy is -1. All statistics are grouped by sample: one plan serves every sample. Rows with level vectors of their
    own count at those, in the order of ``levels``.
    """
    by = ["sample_id"]
    own = released.join(guesses.select(*by), by, "left_semi")
    raw = own.select(*by, key).join(df, key)
    text = {a: lv for a, lv in levels.items() if a not in numeric}
    g = cl.granularity(own, df, levels, hierarchies, by)
    means = g.groupBy(*by).agg(F.avg("granularity").alias("Granularity"), F.avg(F.when(F.col("attribute").isin(list(text)), F.col("granularity"))).alias("GranularityCategoricalAttributes"))
    entropy = cl.nonuniform_entropy(own, raw, key, levels, hierarchies, by).groupBy(*by).agg(F.avg("entropy").alias("Entropy"))
    d = cl.discernibility(own, list(levels), by).select(*by, F.col("discernibility").alias("Discernibility"))
    sizes = cl.class_statistics(own, list(levels), by).select(*by, F.col("max_class_size").alias("MaximalEquivalenceClassSize"), F.col("avg_class_size").alias("AverageEquivalenceClassSize"), F.col("min_class_size").alias("MinimalEquivalenceClassSize"), F.col("suppressed_records").alias("NumberOfSuppressedRecords"))
    out = guesses.join(means, by).join(entropy, by).join(d, by).join(sizes, by)
    if numeric:
        places = cl.location_json(cl.location_and_limits(raw, own, list(numeric), by), by)
        out = out.join(places.select(*by, F.col("location_and_limits").alias("LocationAndLimits")), by, "left")
    else:
        out = out.withColumn("LocationAndLimits", F.lit("{}"))
    if features and target:
        out = out.join(utility_accuracy_of_samples(own, by, features, target).select(*by, F.col("accuracy").alias("ClassificationAccuracy")), by, "left")
    else:
        out = out.withColumn("ClassificationAccuracy", F.lit(-1.0))
    named = {"TestRun": "run_id", "TargetId": "target_id", "Iteration": "k", "TrueLabel": "true_label", "PredictedLabel": "predicted", "PredictionProbability": "confidence"}
    return out.select(*[F.col(named.get(c, c)).alias(c) for c in LOG_COLUMNS])


def attack_accuracy(guesses: DataFrame, distances: DataFrame, key: str, runs: int, tests: int) -> DataFrame:
    """``(target_id, distance, accuracy)``: correct guesses over the configured number of guesses."""
    right = guesses.groupBy("target_id").agg(F.sum(F.when(F.col("predicted") == F.col("true_label"), 1).otherwise(0)).alias("right"))
    d = distances.select(F.col(key).alias("target_id"), F.col("distance_normalised").alias("distance"))
    return right.join(d, "target_id").select("target_id", "distance", ratio(F.col("right"), F.lit(2 * runs * tests)).alias("accuracy"))
