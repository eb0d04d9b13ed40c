"""The plans that avoid all-pairs work or one-task gathering, against plain versions; runs of the command line with all its settings."""

import itertools
import threading
import time
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from privlens import cli
from privlens.functions.scalar import with_row_id
from privlens.operators import classes as cl
from privlens.operators import classify, schema, search
from privlens.operators.hierarchy import Hierarchy
from privlens.operators.privacy import REGIONS, Model
from privlens.plans import assessment as pa
from privlens.sources import config as cf
from privlens.sources import tables as tb


def test_row_ids_are_contiguous(spark):
    df = with_row_id(spark.range(1000).repartition(7).withColumnRenamed("id", "x"))
    assert sorted(r["row_id"] for r in df.collect()) == list(range(1000))
    assert with_row_id(spark.range(0)).count() == 0


def test_row_ids_of_files_do_not_depend_on_their_packing(spark, tmp_path):
    (tmp_path / "t").mkdir()
    rows = []
    for i, n in enumerate((3, 400, 50, 1, 900)):
        rows += [f"{i}-{j}" for j in range(n)]
        (tmp_path / "t" / f"part-{i}.csv").write_text("a;b\n" + "".join(f"{i}-{j};{'x' * (j % 30)}\n" for j in range(n)))
    data = cf.DataConfig(f"{tmp_path}/t", [cf.AttributeConfig("a"), cf.AttributeConfig("b")])
    try:
        for size in ("128m", "2k", "700"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            df = tb.read_table(spark, data)
            assert [r["a"] for r in df.orderBy("row_id").collect()] == rows and df.agg(F.min("row_id"), F.max("row_id")).first() == (0, len(rows) - 1)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize("n", [0, 1, 2, 5, 4000, 4001, 60_000])
def test_medians_equal_the_aggregate(spark, n):
    rng = np.random.default_rng(n)
    rows = [(float(x), int(x * 3) if i % 5 else None) for i, x in enumerate(rng.normal(size=n).round(2))]
    df = spark.createDataFrame(rows, "a double, b int")
    got = {r["attribute"]: r["median"] for r in schema.summary_statistics(df, ["a", "b"]).collect()}
    want = df.agg(F.median("a").alias("a"), F.median("b").alias("b")).first()
    assert got == want.asDict()


def test_nearest_neighbours_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(classify, "KNN_BLOCK", 60)
    rng = np.random.default_rng(4)
    x = rng.integers(0, 4, (400, 3)).astype(float)  # many ties
    rows = [(i, int(i % 7 > 1) + int(i % 7 > 5), int(v.sum()) % 2, [float(c) for c in v]) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "id long, g int, label int, features array<double>")
    for by in ([], ["g"]):
        got = {r["id"]: r["predicted"] for r in classify.knn_predict(df.where("id % 2 = 0"), df.where("id % 2 = 1"), by).collect()}
        for i, g, _, v in rows:
            if i % 2:
                near = sorted((sum((a - b) ** 2 for a, b in zip(v, w)), j, label) for j, h, label, w in rows if j % 2 == 0 and (not by or h == g))[:5]
                ones = sum(label for _, _, label in near)
                assert got[i] == int(ones >= 3), i


def test_draws_cut_before_the_shuffle_are_the_same(spark, monkeypatch):
    df = spark.range(3000).withColumnRenamed("id", "x")
    plan = pa.Assessment(runs=2, train=2, test=2, cohort=900, background=1200, sample=40, seed=5)
    jobs = pa.job_plan(spark.createDataFrame([(3,), (70,)], "x long"), "x", plan)
    cut = sorted(map(tuple, pa.membership(df, "x", jobs, plan, 3000).collect()))
    assert pa._digest_bar(40, 1200) < "2" and pa._digest_bar(40, 41) == "g"
    monkeypatch.setattr(pa, "_digest_bar", lambda n, pool: "g")
    assert sorted(map(tuple, pa.membership(df, "x", jobs, plan, 3000).collect())) == cut
    monkeypatch.setattr(pa, "_digest_bar", lambda n, pool: "000001")  # too low: the draws are made again in full
    assert sorted(map(tuple, pa.membership(df, "x", jobs, plan, 3000).collect())) == cut
    assert len(cut) == 2 * 2 * 4 * 2 * 40


def people(spark):
    rng = np.random.default_rng(6)
    rows = [(i, str(20 + int(rng.integers(0, 40))), "fm"[int(rng.integers(0, 2))], str(int(rng.integers(0, 9))), "abcde"[int(rng.integers(0, 5))]) for i in range(300)]
    return spark.createDataFrame(rows, "row_id long, age string, sex string, zip string, ill string")


H = {
    "age": Hierarchy("age", [[str(a), f"{a // 5 * 5}+", f"{a // 10 * 10}+", "*"] for a in range(20, 60)]),
    "sex": Hierarchy.suppression("sex"),
    "zip": Hierarchy("zip", [[str(z), "low" if z < 4 else "high", "*"] for z in range(9)]),
}


@pytest.mark.parametrize("aggregate", search.AGGREGATES)
@pytest.mark.parametrize("models, limit", [([Model("k-Anonymity", 4)], 1.0), ([Model("k-Anonymity", 4)], 0.05), ([Model("DistinctLDiversity", 3), Model("k-Anonymity", 5)], 0.1)])
def test_search_by_bounds_equals_trying_every_node(spark, aggregate, models, limit):
    df = people(spark)
    s = search.Search(H, aggregate=aggregate, models=models, sensitive=["ill"], limit=limit, gs=0.3)
    got = s.run(df)
    base = search.base_tuples(df, H, s.sensitive)
    every = search.evaluate(base, list(H), search.lattice(H), s.k, 0.3, aggregate, models=s.models, sensitive=s.sensitive).collect()
    fits = [r for r in every if r["suppressed"] <= limit * r["rows"] + 1e-9]
    best = min(fits, key=lambda r: (search.order_key(r["losses"], aggregate), sum(r["levels"]), tuple(r["levels"])))
    assert tuple(got.values()) == tuple(best["levels"]) and len(s.seen) <= len(every)


def test_lattice_comes_by_height():
    assert search.lattice(H) == sorted(itertools.product(range(4), range(2), range(3)), key=lambda v: (sum(v), v))
    deep = {f"a{i}": Hierarchy(f"a{i}", rules=[lambda c: c] * 5) for i in range(17)}
    assert [sum(v) for v in itertools.islice(search.by_height(deep), 20)] == [0] + [1] * 17 + [2] * 2


def test_large_listed_hierarchies_in_the_quality_metrics(spark):
    rows = [[str(i), str(i // 10), "*"] for i in range(200)]
    df = spark.range(400).select(F.col("id").alias("key"), (F.col("id") % 200).cast("string").alias("v"), (F.col("id") % 3).cast("int").alias("w"))
    h = {"v": Hierarchy("v", rows), "w": Hierarchy("w", rules=[lambda c: F.lit("*")])}
    out = df.select("key", F.floor(F.col("v").cast("int") / 10).cast("string").alias("v"), F.lit("*").alias("w"), F.lit(False).alias("is_suppressed"))
    g = {r["attribute"]: r["granularity"] for r in cl.granularity(out, df, {"v": 1, "w": 1}, h).collect()}
    e = {r["attribute"]: r["entropy"] for r in cl.nonuniform_entropy(out, df, "key", {"v": 1, "w": 1}, h).collect()}
    assert g["v"] == pytest.approx(1 - 9 / 199) and g["w"] == pytest.approx(0)
    assert e["v"] == pytest.approx(1 - np.log2(10) / np.log2(200)) and e["w"] == pytest.approx(0)


def test_run_with_statistics_checkpoints_and_stop(spark, tmp_path):
    people(spark).drop("row_id").coalesce(1).write.option("header", True).option("sep", ";").csv(str(tmp_path / "t"))
    (tmp_path / "d.yml").write_text(
        f"path: {tmp_path}/t\nname: t\nattributes:\n- {{name: age, dataType: continuous, levels: {{'*': [{', '.join(f'{a}.0' for a in range(20, 60))}]}}}}\n- {{name: sex, levels: {{'*': [f, m]}}}}\n- {{name: zip, include: false, levels: {{'*': [{', '.join(map(repr, map(str, range(9))))}]}}}}\n- {{name: ill, attributeType: SENSITIVE_ATTRIBUTE}}\n"
    )
    (tmp_path / "a.yml").write_text("suppressionLimit: 0.2\nprivacyModels:\n- {type: k-Anonymity, k: 3}\n- {type: DistinctLDiversity, l: 2}\n")
    (tmp_path / "st.yml").write_text("features: [sex, zip]\ntarget: ill\n")
    (tmp_path / "r.yml").write_text(f"targetCount: 2\ncohortSize: 60\nbackgroundSize: 60\nsampleSize: 20\nrunCount: 2\nrunTrainingCount: 3\nrunTestCount: 1\nclassifierType: KNN\nattributesForAttackType: ALL_ATTRIBUTES\npathToStatisticsConfig: {tmp_path}/st.yml\nuseCheckpointData: true\npathToCheckpointData: {tmp_path}/kept\n")
    data, anonymization, risk = cf.read_data_config(tmp_path / "d.yml"), cf.read_anonymization_config(tmp_path / "a.yml"), cf.read_risk_config(tmp_path / "r.yml")
    out, told = str(tmp_path / "out"), []
    done = cli.risk_assessment(spark, risk, data, anonymization, "x", out, lambda made, n: told.append((made, n)))
    assert told == [(16, 32), (32, 32)]
    log = spark.read.option("header", True).option("sep", ";").csv(f"{out}/{done[0]}_log")
    assert log.columns == ["TestRun", "TargetId", "Iteration", "TrueLabel", "PredictedLabel", "PredictionProbability", "Granularity", "GranularityCategoricalAttributes", "Entropy", "Discernibility", "MaximalEquivalenceClassSize", "AverageEquivalenceClassSize", "MinimalEquivalenceClassSize", "NumberOfSuppressedRecords", "LocationAndLimits", "ClassificationAccuracy"]
    rows = log.collect()
    assert len(rows) == 8 and all(0 <= float(r["Granularity"]) <= 1 and 0 <= float(r["ClassificationAccuracy"]) <= 1 and "age" in r["LocationAndLimits"] for r in rows)
    kept = sorted(Path(tmp_path / "kept").rglob("*.parquet"))
    cli.risk_assessment(spark, risk, data, anonymization, "again", out)
    assert sorted(Path(tmp_path / "kept").rglob("*.parquet")) == kept  # nothing was done again
    (Path(out) / "STOP").write_text("")
    risk.seed = 1
    assert cli.risk_assessment(spark, risk, data, anonymization, "stopped", out) == []


def small_assessment(spark, tmp_path, **risk):
    people(spark).drop("row_id").coalesce(1).write.option("header", True).option("sep", ";").csv(str(tmp_path / "t"))
    ages = {str(d): [str(a) for a in range(d, d + 10)] for d in range(20, 60, 10)}
    data = cf.DataConfig(f"{tmp_path}/t", [cf.AttributeConfig("age", levels={"*": ages}), cf.AttributeConfig("sex", levels={"*": ["f", "m"]})], "t")
    anonymization = cf.AnonymizationConfig("a", privacyModels=[{"type": "k-Anonymity", "k": 3}], suppressionLimit=0.2)
    made = {"targetCount": 3, "cohortSize": 60, "backgroundSize": 60, "sampleSize": 20, "runTrainingCount": 2, "runTestCount": 1, "classifierType": "KNN", "useCheckpointData": True, "pathToCheckpointData": f"{tmp_path}/kept"}
    return cf.RiskAssessmentConfig("r", **(made | risk)), data, anonymization, f"{tmp_path}/out"


def test_a_killed_run_resumes_at_the_missing_samples(spark, tmp_path, monkeypatch):
    risk, data, anonymization, out = small_assessment(spark, tmp_path)
    monkeypatch.setattr(cli, "RELEASES_AT_ONCE", 6)  # a job's releases at a time
    released, release = [], pa.release_samples

    def dying(df, key, members, method):
        if len(released) == 2:
            raise KeyboardInterrupt
        released.append({r["sample_id"] for r in members.select("sample_id").distinct().collect()})
        return release(df, key, members, method)

    monkeypatch.setattr(pa, "release_samples", dying)
    with pytest.raises(KeyboardInterrupt):
        cli.risk_assessment(spark, risk, data, anonymization, "x", out)
    first, released[:] = list(released), []
    monkeypatch.setattr(pa, "membership", lambda *a: pytest.fail("the samples are stored"))
    told = []
    (title,) = cli.risk_assessment(spark, risk, data, anonymization, "x", out, lambda *x: told.append(x))
    assert len(first) == 2 and len(released) == 1 and told == [(18, 18)]
    assert sorted(x for s in (*first, *released) for x in s) == list(range(18))
    log = spark.read.option("header", True).option("sep", ";").csv(f"{out}/{title}_log")
    assert log.count() == 6
    monkeypatch.undo()
    (whole,) = cli.risk_assessment(spark, risk, data, anonymization, "y", f"{out}2")  # from the stored log
    risk.pathToCheckpointData = f"{tmp_path}/other"
    (fresh,) = cli.risk_assessment(spark, risk, data, anonymization, "z", f"{out}3")
    cell = lambda x: round(float(x), 9) if x.lstrip("-").replace(".", "", 1).isdigit() else x
    rows = lambda where, name: sorted(tuple(map(cell, r)) for r in spark.read.option("header", True).option("sep", ";").csv(f"{where}/{name}_log").collect())
    assert rows(out, title) == rows(f"{out}2", whole) == rows(f"{out}3", fresh)


def test_a_stop_ends_a_run_that_is_under_way(spark, tmp_path, monkeypatch):
    risk, data, anonymization, out = small_assessment(spark, tmp_path, runCount=2)
    release, began = pa.release_samples, []

    def slow(df, key, members, method):
        if not began:
            began.append(None)
            return release(df, key, members, method)
        began.append(time.monotonic())
        threading.Timer(1.0, lambda: (Path(out).mkdir(exist_ok=True), (Path(out) / "STOP").write_text(""))).start()
        wait = F.udf(lambda x: time.sleep(120) or x, "long")
        return release(df, key, members, method).withColumn("row_id", wait("row_id"))

    monkeypatch.setattr(pa, "release_samples", slow)
    (title,) = cli.risk_assessment(spark, risk, data, anonymization, "x", out)
    assert time.monotonic() - began[-1] < 60 and len(began) == 2
    assert spark.read.option("header", True).option("sep", ";").csv(f"{out}/{title}_log").select("TestRun").distinct().count() == 1
    assert spark.sparkContext.getLocalProperty("spark.jobGroup.id") is None and spark.range(10).count() == 10


def test_differential_privacy_and_population_from_a_configuration(spark):
    df = people(spark)
    data = cf.DataConfig("", [cf.AttributeConfig("age", levels={"*": {str(d): [str(a) for a in range(d, d + 10)] for d in range(20, 60, 10)}}), cf.AttributeConfig("sex", levels={"*": ["f", "m"]})])
    private = cf.AnonymizationConfig(privacyModels=[{"type": "EDDifferentialPrivacy", "epsilon": 2.0, "delta": 1e-2}], differentialPrivacySearchBudget=0.5)
    out, made = cli.anonymize(df, data, private)
    live = out.where("not is_suppressed")
    assert set(made.names) == {"age", "sex"} and out.count() == 300 and live.groupBy("age", "sex").count().agg(F.min("count")).first()[0] >= 2
    region = cf.AnonymizationConfig(privacyModels=[{"type": "PopulationUniqueness", "riskThreshold": 0.01, "region": "Germany", "populationUniquenessModel": "ZAYATZ"}])
    assert region.models()[0].population == REGIONS["GERMANY"] and cli.anonymize(df, data, region)[0].count() == 300
    with pytest.raises(ValueError, match="region"):
        cf.AnonymizationConfig(privacyModels=[{"type": "PopulationUniqueness", "riskThreshold": 0.01, "region": "Atlantis"}]).models()


def test_local_recoding_with_micro_aggregation(spark):
    data = cf.DataConfig("", [cf.AttributeConfig("age", levels={"*": {str(d): [str(a) for a in range(d, d + 10)] for d in range(20, 60, 10)}}), cf.AttributeConfig.parse({"name": "zip", "levels": {"*": list(map(str, range(9)))}, "microAggregation": "MODE"})])
    out, _ = cli.anonymize(people(spark), data, cf.AnonymizationConfig(privacyModels=[{"type": "k-Anonymity", "k": 6}], localGeneralization=True, localGeneralizationIterations=3))
    assert out.count() == 300 and out.groupBy("age").agg(F.count_distinct("zip").alias("n")).agg(F.max("n")).first()[0] == 1
