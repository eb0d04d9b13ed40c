"""Hand-made tables with known answers, and invariants."""

import math
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from privlens.operators import classes as cl
from privlens.operators import classify, features, hierarchy, privacy, recode, sampling, schema, search, targets
from privlens.operators.hierarchy import Hierarchy
from privlens.operators.privacy import Model
from privlens.operators.schema import AttributeSpec, Role
from privlens.plans import assessment as pa
from privlens.sources import config as cf
from privlens.sources import tables as tb

AGES = Hierarchy("age", [("20", "20-39", "*"), ("30", "20-39", "*"), ("40", "40-59", "*"), ("50", "40-59", "*")])
SEX = Hierarchy.suppression("sex")


@pytest.fixture(scope="module")
def people(spark):
    rows = [(0, "20", "f", "flu"), (1, "30", "f", "flu"), (2, "20", "m", "cold"), (3, "30", "m", "flu"), (4, "40", "f", "cold"), (5, "50", "f", "rash"), (6, "50", "m", "rash"), (7, None, "m", "flu")]
    return spark.createDataFrame(rows, "row_id long, age string, sex string, ill string")


H = {"age": AGES, "sex": SEX}


def by_id(df, key="row_id"):
    return {r[key]: r for r in df.collect()}


def test_k_anonymity_release(people):
    out = by_id(recode.release(people, {"age": 1, "sex": 0}, H, [Model("k-Anonymity", 2)]))
    assert [out[i]["is_suppressed"] for i in range(8)] == [False] * 6 + [True, True]
    assert (out[0]["age"], out[6]["age"], out[7]["sex"]) == ("20-39", "*", "*")
    stats = cl.class_statistics(recode.release(people, {"age": 1, "sex": 0}, H, [Model("k-Anonymity", 2)]), ["age", "sex"]).first()
    assert stats["min_class_size"] >= 2 and stats["live_records"] + stats["suppressed_records"] == 8


def test_identity_release_returns_the_input(people):
    assert recode.identity_release(people).drop("is_suppressed").collect() == people.collect()


def test_raising_a_level_never_shrinks_classes(people):
    least = [cl.class_statistics(hierarchy.generalize(people, {"age": a, "sex": s}, H), ["age", "sex"]).first()["min_class_size"] for a, s in ((0, 0), (1, 0), (1, 1), (2, 1))]
    assert least == sorted(least)


def test_granularity_is_one_at_the_bottom_and_zero_at_the_top(people):
    known = people.where("age is not null")
    for level, want in ((0, 1.0), (2, 0.0)):
        levels = {"age": level}
        out = hierarchy.generalize(known, levels, H)
        assert cl.granularity(out, known, levels, H).first()["granularity"] == pytest.approx(want)


def test_entropy_metric(people):
    known = people.where("age is not null")
    at = lambda level: cl.nonuniform_entropy(hierarchy.generalize(known, {"age": level}, H), known, "row_id", {"age": level}, H).first()["entropy"]
    assert at(0) == pytest.approx(1.0) and at(2) == pytest.approx(0.0) and 0 < at(1) < 1


def test_risks(spark):
    classes = spark.createDataFrame([("a", 1), ("b", 3), ("c", 4)], "q string, class_size long")
    r = cl.reidentification_risk(classes).first()
    assert r["highest_risk"] == 1 and r["minimum_risk"] == 0.25 and r["average_risk"] == pytest.approx(3 / 8)
    assert r["records_at_lowest_risk"] == 0.5 and r["records_at_highest_risk"] == pytest.approx(1 / 8)


def test_discernibility(people):
    r = cl.discernibility(recode.release(people, {"age": 1, "sex": 0}, H, [Model("k-Anonymity", 2)]), ["age", "sex"]).first()
    assert r["discernibility_raw"] == 3 * 4 + 8 * 2 and r["discernibility"] == pytest.approx(1 - (28 - 8) / 56)
    one = people.where("row_id = 0")
    assert cl.discernibility(one, ["age"]).first()["discernibility"] == 1


def test_diversity_and_closeness(spark):
    rows = [(i, "a", s) for i, s in enumerate("xxyz")] + [(i + 4, "b", s) for i, s in enumerate("xxxx")]
    df = spark.createDataFrame(rows, "row_id long, q string, s string")
    ok = lambda out: {r["q"]: r["ok"] for r in out.collect()}
    assert ok(privacy.distinct_l_diversity(df, ["q"], "s", 3)) == {"a": True, "b": False}
    assert ok(privacy.entropy_l_diversity(df, ["q"], "s", 2.0)) == {"a": True, "b": False}
    emd = {r["q"]: r["emd"] for r in privacy.t_closeness_equal(df, ["q"], "s", 0.2).collect()}
    assert emd["a"] == pytest.approx(0.25) and emd["b"] == pytest.approx(0.25)
    tree = Hierarchy("s", [("x", "g", "*"), ("y", "h", "*"), ("z", "h", "*")])
    far = {r["q"]: r["emd"] for r in privacy.t_closeness_hierarchical(df, ["q"], "s", tree, 0.2).collect()}
    assert far["a"] == pytest.approx(0.25) and far["b"] == pytest.approx(0.25)
    near = Hierarchy("s", [("x", "g", "*"), ("y", "g", "*"), ("z", "g", "*")])
    assert {r["q"]: r["emd"] for r in privacy.t_closeness_hierarchical(df, ["q"], "s", near, 0.2).collect()}["a"] == pytest.approx(0.125)
    assert ok(privacy.d_disclosure(df, ["q"], "s", 1.0)) == {"a": True, "b": False}
    assert ok(privacy.enhanced_b_likeness(df, ["q"], "s", 2.0)) == {"a": True, "b": False}


def test_average_risk_drops_the_smallest_classes(spark):
    df = spark.createDataFrame([(i, q) for i, q in enumerate("abbccccdddddddd")], "row_id long, q string")
    ok = {r["q"]: r["ok"] for r in privacy.average_reidentification_risk(df, ["q"], 0.2).collect()}
    assert ok == {"a": False, "b": False, "c": True, "d": True}
    assert not any(r["ok"] for r in privacy.average_reidentification_risk(df, ["q"], 0.01).collect())


def test_safepub_parameters():
    k = privacy.safepub_k(1.0, 1e-3)
    assert k > 1 and privacy.safepub_k(1.0, 1e-6) > k and privacy.safepub_k(2.0, 1e-3) != 0
    assert privacy.safepub_beta(math.log(2)) == pytest.approx(0.5)


def test_pitman_recovers_scale():
    theta, alpha = privacy.pitman_fit({1: 50, 2: 20, 3: 10, 5: 5, 10: 2})
    assert theta > -alpha and 0 < alpha < 1
    assert 0 < privacy.population_uniques({1: 50, 2: 20, 3: 10, 5: 5, 10: 2}, 1000) <= 1000
    for model in ("ZAYATZ", "SNB", "DANKAR"):
        assert 0 <= privacy.population_uniques({1: 50, 2: 20, 3: 10}, 1000, model) <= 1000
    assert privacy.population_uniques({2: 5}, 1000) == 0.0


def test_micro_aggregation(spark):
    df = spark.createDataFrame([(0, "a", 1.0), (1, "a", 4.0), (2, "a", None), (3, "b", 2.0), (4, "b", 2.0), (5, "b", 8.0)], "row_id long, q string, v double")
    value = lambda f, **k: [by_id(recode.micro_aggregate(df, ["q"], {"v": f}, **k))[i]["v"] for i in (0, 3)]
    assert value("ARITHMETIC_MEAN") == [2.5, 4.0] and value("MEDIAN") == [2.5, 2.0]
    assert value("GEOMETRIC_MEAN") == pytest.approx([2.0, 32 ** (1 / 3)]) and value("MODE") == [1.0, 2.0]
    assert value("INTERVAL") == ["[1.0, 4.0]", "[2.0, 8.0]"] and value("SET") == ["{1.0, 4.0}", "{2.0, 8.0}"]
    assert value("ARITHMETIC_MEAN", ignore_missing=False) == [None, 4.0]


def test_local_recoding_releases_more(people):
    rounds = [{"age": 0, "sex": 0}, {"age": 1, "sex": 1}]
    out = by_id(recode.local_recoding(people, "row_id", rounds, H, [Model("k-Anonymity", 2)]))
    assert len(out) == 8 and out[0]["age"] == "20-39" and out[7]["is_suppressed"]


def test_hierarchies(spark, tmp_path):
    nested = Hierarchy.nested("s", {"top": {"g": ["a", "b"], "h": ["c"]}})
    assert nested.rows == [("a", "g", "top", "*"), ("b", "g", "top", "*"), ("c", "h", "top", "*")]
    (tmp_path / "h.csv").write_text("1.0;2;*\r\n2.0;2;*\n75-59;NULL;*")
    rows = cf.read_hierarchy_rows(tmp_path / "h.csv")
    assert rows == [("1.0", "2", "*"), ("2.0", "2", "*"), ("75-59", "NULL", "*")]
    numeric = Hierarchy("n", rows[:2], numeric=True)
    df = spark.createDataFrame([(1,), (3,)], "n int")
    assert [r["x"] for r in numeric.attach(df, 1, "x").collect()] == ["2", "*"]
    large = Hierarchy("n", [(str(i), str(i // 10), "*") for i in range(200)])
    assert {r["n"]: r["x"] for r in large.attach(spark.range(0, 250, 49).withColumnRenamed("id", "n"), 1, "x").collect()} == {0: "0", 49: "4", 98: "9", 147: "14", 196: "19", 245: "*"}


def test_typed_projection_and_roles(spark):
    df = spark.createDataFrame([("1.5", "03.02.2020", "NULL"), ("*", "x", "b"), ("", "01.01.2021", None)], "v string, d string, c string")
    specs = [AttributeSpec.of("v", "continuous"), AttributeSpec.of("d", "date"), AttributeSpec.of("c", role="SENSITIVE_ATTRIBUTE")]
    rows = schema.typed_projection(df, specs).collect()
    assert [r["v"] for r in rows] == [1.5, None, None] and rows[0]["d"].month == 2 and rows[1]["d"] is None and rows[0]["c"] == "NULL"
    assert Role.parse("IDENTIFIER") is Role.IDENTIFYING
    with pytest.raises(ValueError):
        AttributeSpec.of("x", "ordinal")
    with pytest.raises(ValueError):
        schema.quasi_identifiers([specs[2]], ["c"])
    with pytest.raises(ValueError):
        schema.check_no_empty_cells(df.withColumn("row_id", F.lit(1)), specs, "row_id")


def test_sampling(spark):
    df = spark.range(100).withColumnRenamed("id", "row_id")
    split = sampling.overlapping_split(df, "row_id", 40, 50, 0.25, 1, 100)
    c, b = {r["row_id"] for r in split.where("cohort").collect()}, {r["row_id"] for r in split.where("background").collect()}
    assert (len(c), len(b), len(c & b)) == (40, 50, 10)
    assert split.collect() and sampling.overlapping_split(df.repartition(7), "row_id", 40, 50, 0.25, 1, 100).exceptAll(split).isEmpty()
    with pytest.raises(ValueError):
        sampling.overlapping_split(df, "row_id", 60, 60, 0.0, 1, 100)
    pair = sampling.paired_samples(df, "row_id", 5, 10, 1).collect()
    out, there = {r["row_id"] for r in pair if not r["target_in"]}, {r["row_id"] for r in pair if r["target_in"]}
    assert len(out) == len(there) == 10 and 5 not in out and there - out == {5} and len(out - there) == 1


def test_targets(spark, tmp_path):
    df = spark.createDataFrame([(0, 1.0, "a"), (1, 2.0, "a"), (2, 9.0, "b"), (3, None, "a")], "row_id long, v double, c string")
    d = by_id(targets.distances(df, "row_id", ["v", "c"]))
    assert max(d, key=lambda i: d[i]["distance"]) == 2 and d[2]["distance_normalised"] == 1.0
    assert [r["row_id"] for r in targets.select_targets(df, "row_id", "OUTLIER", 1, ["v", "c"]).collect()] == [2]
    with pytest.raises(ValueError):
        targets.select_targets(df, "row_id", "RANDOM", 9)
    same = spark.createDataFrame([(0, 1.0), (1, 1.0)], "row_id long, v double")
    assert targets.distances(same, "row_id", ["v"]).first()["distance_normalised"] is None
    (tmp_path / "ids.txt").write_text("2\n3\n2\nx\n")
    assert sorted(r["row_id"] for r in tb.read_target_ids(spark, str(tmp_path / "ids.txt")).collect()) == [2, 3]


def test_searches_agree_on_a_small_lattice(people):
    known = people.where("age is not null")
    best = search.Search(H, 2).run(known)
    assert search.Search(H, 2, "BEST_EFFORT_BOTTOM_UP").run(known) == best
    assert search.Search(H, 2, "GENETIC", steps=12).run(known) == best
    assert search.Search(H, 2, "OPTIMAL", steps=1).run(known) == {"age": 0, "sex": 0}
    assert len(search.lattice(H, {"age": (1, 1)})) == 2


def test_batched_features_equal_single_ones(spark):
    df = spark.createDataFrame([(i % 3, float(i * i % 11), "abc"[i % 2]) for i in range(30)], "sample_id long, v double, c string").withColumn("is_suppressed", F.lit(False))
    codes = schema.dictionary(schema.distinct_values(df, ["c"]))
    for make in (
        lambda d: features.naive(d, ["v"], ["c"], codes, ["sample_id"]),
        lambda d: features.histogram(d, {"v": (0.0, 11.0)}, codes, ["c"], ["sample_id"]),
        lambda d: features.correlation(d, ["v"], ["c"], codes, ["sample_id"]),
    ):
        whole = sorted(map(tuple, make(df).where("sample_id = 1").collect()))
        alone = sorted(map(tuple, make(df.where("sample_id = 1")).collect()))
        assert [w[:2] for w in whole] == [a[:2] for a in alone] and [w[2] for w in whole] == pytest.approx([a[2] for a in alone])
    with pytest.raises(ValueError):
        features.histogram(df, {"v": (1.0, 1.0)}, codes, [], ["sample_id"])


def test_classifiers_separate_two_clouds():
    import numpy as np

    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal(0, 1, (40, 5)), rng.normal(4, 1, (40, 5))])
    y = np.repeat([0.0, 1.0], 40)
    for kind in classify.CLASSIFIERS.values():
        p = kind().fit(x, y, np.random.default_rng(1)).member(x)
        assert ((p > 0.5) == y).mean() > 0.95


def test_assessment_end_to_end(spark, sf):
    from privlens.plans import catalogue

    out = catalogue.attack_rf(spark, sf)
    rows = out.collect()
    assert len(rows) == 4 * 4 * 2 and {r["true_label"] for r in rows} == {0, 1} and all(0.5 <= r["confidence"] <= 1 for r in rows)
    plan = pa.Assessment(runs=2, train=3, test=2)
    assert plan.work(6) == 120 and pa.job_plan(spark.range(6).withColumnRenamed("id", "x"), "x", plan).count() == 120


def test_configurations(tmp_path):
    (tmp_path / "d.yml").write_text("path: p.csv\nunknown: 1\nattributes:\n- name: age\n  dataType: continuous\n  attributeType: QUASI_IDENTIFYING_ATTRIBUTE\n  microAggregation: MEDIAN\n- name: sex\n  attributeType: SENSITIVE\n  levels: {'*': [f, m]}\n")
    d = cf.read_data_config(tmp_path / "d.yml")
    assert d.path == "p.csv" and d.specs[0].micro_aggregation == "MEDIAN" and d.hierarchies()["sex"].rows == [("f", "*"), ("m", "*")]
    (tmp_path / "a.yml").write_text("algorithm: BEST_EFFORT_GENETIC\nprivacyModels:\n- type: k-Anonymity\n  k: 2\n- type: EqualDistanceTCloseness\n  t: 0.2\n  attributes: [sex]\nqualityModel: {gsFactor: 0.0}\n")
    a = cf.read_anonymization_config(tmp_path / "a.yml")
    assert [m.kind for m in a.models()] == ["k-Anonymity", "EqualDistanceTCloseness"] and a.qualityModel.gsFactor == 0.0
    (tmp_path / "d2.yml").write_text("dataSetName: x\ndataCsvFile: p.csv\nattributeConfigs:\n- {name: v, type: QUASI_IDENTIFYING_ATTRIBUTE, dataType: continuous, useMicroAggregation: true, min: 0, max: 9, minLevelToUse: 1, pathToHierarchy: h.csv}\n")
    d2 = cf.read_data_config(tmp_path / "d2.yml")
    assert (d2.name, d2.path, d2.specs[0].micro_aggregation, d2.specs[0].perform_clustering, d2.specs[0].maximum, d2.specs[0].min_level, d2.attributes[0].hierarchy) == ("x", "p.csv", "ARITHMETIC_MEAN", True, 9.0, 1, "h.csv")
    (tmp_path / "r2.yml").write_text("featureTypes: [NAIVE]\ntargetImportFile: t.txt\nsizeSampleTraining: 3\nsizeSampleTest: 4\nsizeCohort: 5\nsizeBackground: 6\n")
    r2 = cf.read_risk_config(tmp_path / "r2.yml")
    assert (r2.featureTypes, r2.targetFile, r2.sampleSize, r2.sampleSizeTest, r2.cohortSize, r2.backgroundSize) == (["NAIVE"], "t.txt", 3, 4, 5, 6)
    (tmp_path / "s2.yml").write_text("combinationConfig:\n- {pathsToAnonymizationConfig: [a], pathsToDataConfig: [d], pathsToRiskAssessmentConfig: [r]}\n")
    assert cf.read_series_config(tmp_path / "s2.yml").length() == 1
    (tmp_path / "s.yml").write_text("risk: [r1, r2]\ndata: d\nanonymization: [a1, a2, a3]\n")
    s = cf.read_series_config(tmp_path / "s.yml")
    assert s.length() == 6 and cf.missing_paths(s) == ["a1", "a2", "a3", "d", "r1", "r2"]
    cf.write_config(a, tmp_path / "out" / "b.yml")
    assert cf.read_anonymization_config(tmp_path / "out" / "b.yml").privacyModels == a.privacyModels
    assert cf.fingerprint(a) != cf.fingerprint(d)


def test_command_line(spark, tmp_path):
    from privlens import cli

    (tmp_path / "t.csv").write_text("age;sex;ill\n" + "\n".join(f"{20 + 10 * (i % 4)};{'fm'[i % 2]};{'abc'[i % 3]}" for i in range(24)) + "\n")
    (tmp_path / "h.csv").write_text("20;young;*\n30;young;*\n40;old;*\n50;old;*\n")
    (tmp_path / "d.yml").write_text(f"path: {tmp_path}/t.csv\nname: t\nattributes:\n- {{name: age, hierarchy: {tmp_path}/h.csv}}\n- name: sex\n  levels: {{'*': [f, m]}}\n- {{name: ill, attributeType: SENSITIVE_ATTRIBUTE}}\n")
    (tmp_path / "a.yml").write_text("privacyModels:\n- {type: k-Anonymity, k: 3}\n")
    (tmp_path / "r.yml").write_text("targetCount: 2\ncohortSize: 12\nbackgroundSize: 12\nsampleSize: 6\nrunTrainingCount: 3\nrunTestCount: 1\nclassifierType: KNN\n")
    data, anonymization = cf.read_data_config(tmp_path / "d.yml"), cf.read_anonymization_config(tmp_path / "a.yml")
    out = str(tmp_path / "out")
    assert cli.target_selection(spark, data, out).count() == 24
    cli.report(spark, data, anonymization, out)
    assert list(Path(out).glob("report_dataset/*.csv")) and (Path(out) / "configs" / "a_t.yaml").exists()
    done = cli.risk_assessment(spark, cf.read_risk_config(tmp_path / "r.yml"), data, anonymization, "x", out)
    assert len(done) == 1 and list(Path(out).glob("*_summary/*.csv"))
    assert cli.main(["--riskAssessmentSeries", "--seriesConfig", str(_series(tmp_path))]) == 2


def _series(tmp_path):
    path = tmp_path / "s.yml"
    path.write_text("risk: [nowhere.yml]\ndata: [d]\nanonymization: [a]\n")
    return path


def test_checkpoint_store(spark, tmp_path):
    jobs = spark.createDataFrame([(0, 1), (0, 2), (1, 1)], "run_id int, target_id long")
    store = tb.CheckpointStore(spark, str(tmp_path), "abc")
    assert store.remaining(jobs, "results").count() == 3
    store.save("results", jobs.where("run_id = 0").withColumn("v", F.lit(1.0)))
    assert [tuple(r) for r in store.remaining(jobs, "results").collect()] == [(1, 1)]
    assert store.load("results").count() == 2


def test_sinks(spark, tmp_path):
    text = tb.statistics_properties({"b": 2.5, "a": None, "c": "{}"})
    assert text == "a=NaN\nb=2.5\nc={}\n" and tb.read_statistics_properties(text) == {"a": None, "b": 2.5, "c": "{}"}
    row = spark.createDataFrame([tuple(map(str, range(10)))], ", ".join(f"{c} string" for c in tb.SERIES_COLUMNS))
    for _ in range(2):
        tb.write_series_summary(row, str(tmp_path / "series"))
    assert tb.read_csv(spark, str(tmp_path / "series")).count() == 2
    df = spark.createDataFrame([(0, "NULL", ""), (1, "x", "y")], "row_id long, a string, b string")
    tb.write_release(df, str(tmp_path / "csv"), as_csv=True)
    assert sorted(map(tuple, tb.read_csv(spark, str(tmp_path / "csv")).collect())) == [("0", "NULL", ""), ("1", "x", "y")]
