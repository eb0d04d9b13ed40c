"""Command line: target selection, risk assessment (one or a series) and anonymization reports.

    python -m privlens.cli --targetSelection --dataConfig data.yml
    python -m privlens.cli --riskAssessment --riskAssessmentConfig r.yml --dataConfig d.yml --anonymizationConfig a.yml --name run
    python -m privlens.cli --riskAssessmentSeries --seriesConfig s.yml
    python -m privlens.cli --report data.yml anonymization.yml
"""

from __future__ import annotations

import argparse
import sys
from dataclasses import replace
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from privlens.operators import classes as cl
from privlens.operators import schema, search, targets
from privlens.operators.anonymizer import Anonymizer
from privlens.operators.hierarchy import LEVELS
from privlens.plans import assessment as pa
from privlens.sources import config as cf
from privlens.sources import shared, watch
from privlens.sources import tables as tb


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="privlens", description="Anonymize tables and measure what privacy risk remains.")
    mode = p.add_mutually_exclusive_group(required=True)
    mode.add_argument("--targetSelection", action="store_true")
    mode.add_argument("--riskAssessment", action="store_true")
    mode.add_argument("--riskAssessmentSeries", action="store_true")
    mode.add_argument("--report", nargs=2, metavar=("DATA", "ANONYMIZATION"))
    for name in ("dataConfig", "anonymizationConfig", "riskAssessmentConfig", "seriesConfig"):
        p.add_argument(f"--{name}")
    p.add_argument("--name", default="")
    p.add_argument("--out", default="results")
    return p


def method_of(columns: list[str], data: cf.DataConfig, anonymization: cf.AnonymizationConfig, key: str = "row_id") -> Anonymizer:
    """The anonymization that a configuration describes: a search under all its models and its suppression limit, or a draw within the budget of differential privacy.

    Every quasi-identifier makes the class, one without a hierarchy by its values; only those that are
    micro-aggregated without clustering do not.
    """
    hierarchies = data.hierarchies()
    specs = {s.name: s for s in data.specs}
    quasi = schema.quasi_identifiers(data.specs, columns)
    micro = {n: s.micro_aggregation for n, s in specs.items() if s.micro_aggregation and n in columns}
    # those whose labels are kept come first: the metrics count on their places in a level vector
    own = {q: hierarchies[q] for q in sorted(quasi, key=lambda q: q in micro) if q not in micro or specs[q].perform_clustering}
    bounds = {q: (specs[q].min_level, specs[q].max_level if specs[q].max_level is None or specs[q].max_level >= 0 else None) for q in own}
    quality = anonymization.qualityModel or cf.QualityModel()
    models, sensitive = anonymization.models(hierarchies), schema.sensitive_attributes(data.specs)
    private = next((m for m in models if m.kind == "EDDifferentialPrivacy"), None)
    budget = anonymization.differentialPrivacySearchBudget
    if private:
        found = search.PrivateSearch(own, key, private.parameter, private.delta, budget, bounds)
        # what the search spends of the budget is taken off what the release may spend
        models = [replace(m, parameter=m.parameter - budget) if m is private else m for m in models]
    else:
        found = search.Search(own, 1, anonymization.algorithm, anonymization.heuristicSearchStepLimit, anonymization.heuristicSearchTimeLimit, quality.gsFactor, quality.aggregateFunction, bounds, models=models, sensitive=sensitive, limit=anonymization.suppressionLimit)
    rounds = anonymization.localGeneralizationIterations if anonymization.localGeneralization else 0
    identifying = [s.name for s in data.specs if s.role is schema.Role.IDENTIFYING and s.name in columns]
    return Anonymizer(found, models, key, sensitive, identifying, rounds, micro, {n: specs[n].ignore_missing for n in micro})


def anonymize(df: DataFrame, data: cf.DataConfig, anonymization: cf.AnonymizationConfig, key: str = "row_id") -> tuple[DataFrame, Anonymizer]:
    """The released table, its rows with their level vectors, and the method that released it."""
    method = method_of(df.columns, data, anonymization, key)
    return method.release(df), method


def target_selection(spark: SparkSession, data: cf.DataConfig, out: str) -> DataFrame:
    df = tb.read_table(spark, data)
    d = targets.distances(df, "row_id", schema.quasi_identifiers(data.specs, df.columns))
    tb.write_targets(d.select("row_id", F.col("distance_normalised").alias("distance")), "row_id", f"{out}/targets_{data.name}")
    return d


def report(spark: SparkSession, data: cf.DataConfig, anonymization: cf.AnonymizationConfig, out: str) -> None:
    df = tb.read_table(spark, data)
    hierarchies = data.hierarchies()
    released, method = anonymize(df, data, anonymization)
    released = shared.materialize(released, "released")
    levels = {n: 0 for n in method.names if n not in method.micro}
    names = [F.lit(anonymization.name).alias("anon_name"), F.lit(data.name).alias("dataset_name")]
    g = cl.granularity(released, df, levels, hierarchies)
    e = cl.nonuniform_entropy(released, df, "row_id", levels, hierarchies)
    dataset = cl.dataset_metrics(released, df, "row_id", method.names, levels, hierarchies)
    tb.write_report(dataset.select(*names, "*"), g.join(e, "attribute").select(*names, "*"), f"{out}/report")
    shared.write_text(spark, f"{out}/configs/{anonymization.name}_{data.name}.yaml", cf.config_text(anonymization))
    tb.write_release(released.drop(LEVELS), f"{out}/released_{anonymization.name}_{data.name}_{datetime.now(UTC):%Y%m%d_%H%M%S}")
    shared.discard(released)


def risk_assessment(spark: SparkSession, risk: cf.RiskAssessmentConfig, data: cf.DataConfig, anonymization: cf.AnonymizationConfig, name: str, out: str, progress=None) -> list[str]:
    """One assessment per feature type; returns the names of the results written.

    Samples, releases and log rows are artifacts of a store, kept by a fingerprint of all configurations; with checkpoint
    data the store outlives the assessment, and what is found there is not made again. Releases are made for some jobs at
    a time; after each such batch ``progress(done, all)`` is told the releases made. A file ``STOP`` in ``out`` ends the
    assessment within seconds; what was stored by then is kept, and finished runs are reported.
    """
    df = tb.read_table(spark, data)
    specs = schema.enrich(data.specs, df)
    schema.check_no_empty_cells(df, specs, "row_id")
    n = df.count()
    hierarchies = data.hierarchies()
    qis = schema.quasi_identifiers(specs, df.columns)
    considered = schema.attack_attributes(specs, risk.attributesForAttackType.upper().startswith("ALL_ATTR"))
    imported = tb.read_target_ids(spark, risk.targetFile) if risk.targetFile else None
    picked = shared.materialize(targets.select_targets(df, "row_id", risk.targetType, risk.targetCount, qis, risk.seed, imported).select("row_id"), "targets")
    method = method_of(df.columns, data, anonymization)
    levels = {n: 0 for n in method.names if n not in method.micro}
    numeric = {s.name: (s.minimum, s.maximum) for s in specs if s.name in considered and s.data_type is not schema.DataType.CATEGORICAL}
    statistics = cf.read_statistics_config(risk.pathToStatisticsConfig) if risk.pathToStatisticsConfig else cf.StatisticsConfig()
    done = []
    for kind in risk.featureTypes:
        started = datetime.now(UTC)
        plan = pa.Assessment(
            risk.runCount, risk.runTrainingCount, risk.runTestCount,
            _size(n, risk.cohortFraction, risk.cohortSize), _size(n, risk.backgroundFraction, risk.backgroundSize), risk.sampleSize or _size(n, risk.cohortFraction, risk.cohortSize) // 2,
            risk.sampleSizeTest, risk.overlap, kind, risk.classifierType, risk.seed,
        )
        stamp = started.strftime("%Y%m%d_%H%M")
        title = "_".join(filter(None, [stamp, name, risk.name, data.name, anonymization.name, kind]))
        root = risk.pathToCheckpointData if risk.useCheckpointData and risk.pathToCheckpointData else f"{shared.shared_dir(spark)}/{title}"
        store = tb.CheckpointStore(spark, root, cf.fingerprint(replace(risk, featureTypes=[kind]), data, anonymization))
        jobs = shared.materialize(pa.job_plan(picked, "row_id", plan), "plan")
        total = jobs.count()
        with watch.Watch(spark, f"{out}/STOP") as watched:
            for run in range(plan.runs):
                if watched.asked():
                    break
                left = store.remaining(jobs.where(F.col("run_id") == run), "log")
                if not left.isEmpty():
                    _run(store, df, n, left, run, method, numeric, plan, considered, levels, hierarchies, statistics, lambda made, run=run: progress and progress(run * total // plan.runs + made, total))
                elif progress:
                    progress((run + 1) * total // plan.runs, total)
        shared.discard(jobs)
        log = store.load("log")
        if log is None:
            continue
        guesses = log.select(F.col("TargetId").alias("target_id"), F.col("PredictedLabel").alias("predicted"), F.col("TrueLabel").alias("true_label"))
        accuracy = pa.attack_accuracy(guesses, targets.distances(df, "row_id", qis), "row_id", plan.runs, plan.test)
        tb.write_summary(accuracy, f"{out}/{title}_summary")
        tb.write_log(log, f"{out}/{title}_log")
        shared.write_text(spark, f"{out}/{title}_cfgs.yml", cf.config_text(risk, data, anonymization))
        row = (title, stamp, datetime.now(UTC).strftime("%Y%m%d_%H%M"), risk.name, data.name, anonymization.name, kind, f"{title}_log", f"{title}_summary", f"{title}_cfgs.yml")
        tb.write_series_summary(spark.createDataFrame([row], ", ".join(f"{c} string" for c in tb.SERIES_COLUMNS)), f"{out}/{name or 'series'}")
        done.append(title)
    shared.discard(picked)
    return done


#: Releases made in one batch, at least one job's; a stop or a failure costs no more than that.
RELEASES_AT_ONCE = 2000


def _run(store: tb.CheckpointStore, df: DataFrame, n: int, jobs: DataFrame, run: int, method, numeric, plan: pa.Assessment, considered, levels, hierarchies, statistics, tell) -> None:
    """One run's jobs: samples, then releases batch by batch, then guesses and their log rows, each stored; what is stored is used."""
    named = jobs.select("sample_id", *store.KEYS)
    absent = store.remaining(jobs, "samples")
    if not absent.isEmpty():
        absent = shared.materialize(absent, "absent")
        members = pa.membership(df, "row_id", absent, plan, n, [run])
        store.save("samples", members.join(named, "sample_id"))
        shared.discard(members, absent)
    waiting = [r["target_id"] for r in store.remaining(jobs, "releases").select("target_id").distinct().orderBy("target_id").collect()]  # a row per target
    made, size = plan.per_job * (jobs.select("target_id").distinct().count() - len(waiting)), max(1, RELEASES_AT_ONCE // plan.per_job)
    for at in range(0, len(waiting), size):
        batch = jobs.where(F.col("target_id").isin(waiting[at : at + size]))
        out = pa.release_samples(df, "row_id", store.of("samples", batch).select("sample_id", "row_id"), method)
        store.save("releases", out.join(named, "sample_id"))
        made += plan.per_job * len(waiting[at : at + size])
        tell(made)
    if not waiting:
        tell(made)
    released = store.of("releases", jobs).drop(*store.KEYS)
    guesses = pa.judged(df, released, jobs, method, numeric, plan, considered)
    log = pa.assessment_log(df, "row_id", guesses, released, levels, hierarchies, [a for a in numeric if a in levels], statistics.features, statistics.target)
    store.save("log", log.withColumn("run_id", F.col("TestRun")).withColumn("target_id", F.col("TargetId")))
    shared.discard(guesses)


def _say(made: int, all_: int) -> None:
    print(f"{made} of {all_} releases", file=sys.stderr)


def _size(n: int, fraction: float, absolute: float) -> int:
    from privlens.operators.sampling import sample_size

    return sample_size(n, fraction, int(absolute))


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    needed = {"targetSelection": ["dataConfig"], "riskAssessment": ["riskAssessmentConfig", "dataConfig", "anonymizationConfig"], "riskAssessmentSeries": ["seriesConfig"]}
    for mode, names in needed.items():
        if getattr(args, mode) and (absent := [x for x in names if not getattr(args, x)]):
            parser().error("missing " + ", ".join(f"--{x}" for x in absent))
    if args.riskAssessmentSeries:
        series = cf.read_series_config(args.seriesConfig)
        if absent := cf.missing_paths(series):
            print("these paths do not exist:", *absent, sep="\n  ", file=sys.stderr)
            return 2
    spark = SparkSession.builder.appName("privlens").getOrCreate()
    if args.targetSelection:
        target_selection(spark, cf.read_data_config(args.dataConfig), args.out)
    elif args.report:
        report(spark, cf.read_data_config(args.report[0]), cf.read_anonymization_config(args.report[1]), args.out)
    elif args.riskAssessment:
        risk_assessment(spark, cf.read_risk_config(args.riskAssessmentConfig), cf.read_data_config(args.dataConfig), cf.read_anonymization_config(args.anonymizationConfig), args.name, args.out, _say)
    else:
        for g in series.groups:
            for r in g["risk"]:
                for d in g["data"]:
                    for a in g["anonymization"]:
                        risk_assessment(spark, cf.read_risk_config(r), cf.read_data_config(d), cf.read_anonymization_config(a), args.name, args.out, _say)
    return 0


if __name__ == "__main__":
    sys.exit(main())
