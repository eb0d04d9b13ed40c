"""Searches, releases and local recoding of many samples at once, against one sample at a time."""

import itertools
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from privlens import cli
from privlens.operators import anonymizer, privacy, recode, search
from privlens.operators.classes import SUPPRESSED
from privlens.operators.hierarchy import LEVELS, Hierarchy
from privlens.operators.privacy import Model
from privlens.plans import assessment as pa
from privlens.sources import config as cf
from tests.test_plans import H, people

HEIGHTS = {a: h.height for a, h in H.items()}


@pytest.fixture(scope="module")
def samples(spark):
    """Samples of unequal sizes; rows stand in both of them."""
    return every_nth(spark, 1, 3)


def every_nth(spark, *steps):
    df = people(spark)
    parts = [df.where(f"row_id % {m} = 0").withColumn("sample_id", F.lit(m)) for m in steps]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.persist()


def alone(samples, by=("sample_id",)):
    return {r["sample_id"]: samples.where(F.col("sample_id") == r["sample_id"]).drop("sample_id") for r in samples.select("sample_id").distinct().collect()}


@pytest.mark.parametrize(
    "more",
    [
        {"models": [Model("k-Anonymity", 4)], "limit": 0.05},
        {"models": [Model("DistinctLDiversity", 3), Model("k-Anonymity", 3)], "limit": 0.1, "gs": 0.3},
        {"models": [Model("EqualDistanceTCloseness", 0.3)], "limit": 0.4, "aggregate": "RANK"},
        {"models": [Model("k-Anonymity", 4)], "limit": 0.1, "algorithm": "BOTTOM_UP", "steps": 9},
        {"models": [Model("k-Anonymity", 4)], "limit": 0.1, "algorithm": "GENETIC", "steps": 15, "seed": 3},
    ],
)
def test_searches_side_by_side_equal_one_by_one(samples, more):
    found = {r["sample_id"]: tuple(r["levels"]) for r in search.Search(H, sensitive=["ill"], **more).run_each(samples, ["sample_id"]).collect()}
    want = {i: tuple(search.Search(H, sensitive=["ill"], **more).run(df).values()) for i, df in alone(samples).items()}
    assert found == want
    if more["limit"] == 0.05:
        assert len(set(found.values())) > 1


def test_draws_side_by_side_equal_one_by_one(samples):
    made = lambda seed=0: search.PrivateSearch(H, "row_id", 2.0, 1e-2, 0.5, seed=seed)
    found = {r["sample_id"]: tuple(r["levels"]) for r in made().run_each(samples, ["sample_id"]).collect()}
    assert set(found) == {1, 3} and all(0 <= x <= h for v in found.values() for x, h in zip(v, HEIGHTS.values()))
    s = made()
    for i, df in alone(samples).items():
        drawn = df.withColumn("sample_id", F.lit(i)).where(privacy.is_drawn("row_id", s.rest, 0, ["sample_id"]))
        base = search.base_tuples(drawn, H)
        kept = {tuple(r["levels"]): (float(r["rows"]), float(r["rows"] - r["suppressed"])) for r in search.evaluate(base, list(H), search.lattice(H), s.k).collect()}
        own = search.replace(s.planner, seed=search.group_seed(0, [i]))
        assert found[i] == own.best(kept)


def whole_lattice(ranges):
    return list(itertools.product(*[range(lo, hi + 1) for lo, hi in ranges]))


def drive(planner, kept):
    """A draw from start to end; the nodes it asked for and the one it drew."""
    seen = {}
    while nodes := planner.propose(seen, [], len(seen)):
        seen |= {v: kept[v] for v in nodes}
    return set(seen), planner.best(seen)


@pytest.mark.parametrize("factor", [0.0, 0.02, 0.4])
def test_draws_follow_the_exponential_mechanism(factor):
    ranges, heights = ((0, 2), (0, 1), (0, 3)), (2, 1, 3)
    kept = {v: (50.0, 50.0 * sum(v) / 6) for v in whole_lattice(ranges)}
    draw = lambda seed: search.Draw("DRAW", ranges, seed=seed, factor=factor, heights=heights)
    n, found = 2000, Counter(drive(draw(seed), kept)[1] for seed in range(2000))
    weight = {v: math.exp(draw(0).weight(v, kept[v][1])) for v in kept}
    total = sum(weight.values())
    chi2 = sum((found[v] - n * w / total) ** 2 / (n * w / total) for v, w in weight.items())
    assert chi2 < 23 + 5 * math.sqrt(46)  # 24 nodes: mean 23, deviation 6.8
    assert found[max(weight, key=weight.get)] > 0


def test_a_draw_from_a_large_lattice_asks_for_few_nodes():
    """17 attributes of 5 levels: nothing lists the 7.6e11 nodes, and nothing is left out of the draw."""
    ranges, heights = ((0, 4),) * 17, (4,) * 17
    asked = []

    class Kept(dict):
        def __missing__(self, v):
            asked.append(v)
            return (1000.0, 1000.0 * min(1.0, sum(v) / 40))

    kept = Kept()
    drawn = []
    for seed in range(20):
        asked.clear()
        drawn.append(drive(search.Draw("DRAW", ranges, seed=seed, factor=0.002, heights=heights), kept)[1])
        assert len(asked) < 2000
    assert len(set(drawn)) == 20 and max(sum(v) for v in drawn) > 20


@pytest.mark.parametrize("limit, k", [(0.05, 4), (0.0, 301)])
def test_pruning_by_monotony_finds_the_same_with_fewer_nodes(spark, limit, k):
    df = people(spark)
    made = {prune: search.Search(H, models=[Model("k-Anonymity", k)], limit=limit, prune=prune) for prune in (True, False)}
    assert made[True].run(df) == made[False].run(df)
    assert len(made[True].seen) < len(made[False].seen) or k == 301 or len(made[False].seen) < 4
    if k == 301:  # nothing fits: the node that suppresses least is found by trying all
        assert len(made[True].seen) == len(search.lattice(H))


def test_pruning_on_a_large_lattice():
    """A made monotone predicate over 5 ** 6 nodes: the same best node as without pruning, for a small part of the evaluations."""
    ranges = ((0, 4),) * 6
    least = [[x / 4 for x in range(5)] for _ in ranges]
    cost = lambda v: [max(1e-3, x / 4) for x in v]
    fails = lambda v: sum(x * w for x, w in zip(v, (3, 1, 2, 1, 2, 1))) < 17
    counts = {}
    for prune in (True, False):
        planner = search.Planner("OPTIMAL", ranges, "SUM", monotone=prune)
        seen = {}
        while nodes := planner.propose(seen, least, 0):
            seen |= {v: planner.score(v, 100, 50 if fails(v) else 0, cost(v), 0.1) for v in nodes}
        counts[prune] = (len(seen), planner.best(seen))
    assert counts[True][1] == counts[False][1] and counts[True][0] < counts[False][0] / 3


def test_searches_of_nothing(spark):
    none = people(spark).where("false")
    models = [Model("k-Anonymity", 4)]
    for s in (search.Search(H, models=models), search.Search(H, models=models, algorithm="GENETIC"), search.PrivateSearch(H, "row_id", 2.0, 1e-2, 0.5)):
        assert set(s.run(none).values()) == {0}
        assert s.run_each(none.withColumn("sample_id", F.lit(1)), ["sample_id"]).isEmpty()
    made = anonymizer.Anonymizer(search.Search(H, models=models), models, "row_id", rounds=3, micro={"ill": "MODE"})
    assert made.release(none).isEmpty() and set(made.release(none).columns) == {*none.columns, LEVELS, SUPPRESSED}


def test_antichains_cover_what_they_span():
    rng = np.random.default_rng(1)
    nodes = [tuple(map(int, v)) for v in rng.integers(0, 5, (40, 4))]
    low, high = search.Antichain(nodes, up=True), search.Antichain(nodes, up=False)
    assert len(low.nodes) < 40 and len(high.nodes) < 40
    for v in map(tuple, rng.integers(0, 5, (300, 4))):
        assert low.covers(v) == any(all(x <= y for x, y in zip(u, v)) for u in nodes)
        assert high.covers(v) == any(all(x >= y for x, y in zip(u, v)) for u in nodes)


def method(models, rounds=0, limit=0.1, **more):
    return anonymizer.Anonymizer(search.Search(H, models=models, sensitive=["ill"], limit=limit), models, "row_id", ["ill"], rounds=rounds, **more)


def test_releases_have_their_own_levels(samples):
    models = [Model("k-Anonymity", 4)]
    out = method(models).release_each(samples, ["sample_id"]).persist()
    for i, df in alone(samples).items():
        levels = search.Search(H, models=models, limit=0.1).run(df)
        want = recode.release(df, levels, H, models)
        key = lambda d: sorted(map(tuple, d.select("row_id", *H, "ill", SUPPRESSED).collect()))
        assert key(out.where(F.col("sample_id") == i)) == key(want)
    assert anonymizer.levels_of(out, list(H), ["sample_id"]).groupBy("sample_id").count().where("count > 1").isEmpty()


@pytest.mark.parametrize("models, rounds", [([Model("k-Anonymity", 8)], 4), ([Model("k-Anonymity", 3), Model("DistinctLDiversity", 2)], 10)])
def test_local_recoding_side_by_side_equals_one_by_one(spark, models, rounds):
    samples = every_nth(spark, 1, 2, 7)
    limit = 0.5  # a round may suppress half, so that the next has something to do
    out = anonymizer.Anonymizer(search.Search(H, models=models, sensitive=["ill"], limit=limit), models, "row_id", ["ill"], rounds=rounds).release_each(samples, ["sample_id"]).persist()
    assert out.count() == samples.count()
    several = anonymizer.levels_of(out, list(H), ["sample_id"]).groupBy("sample_id").count().where("count > 1").count()
    assert several > 0
    for i, df in alone(samples).items():
        rest, done, n = df, [], df.count()
        for turn in range(rounds):
            levels = search.Search(H, models=models, sensitive=["ill"], limit=limit).run(rest)
            rows = recode.release(rest, levels, H, models, ["ill"]).collect()
            live, gone = [r for r in rows if not r[SUPPRESSED]], [r for r in rows if r[SUPPRESSED]]
            done += live
            if len(live) < -(-n // rounds) or not gone or turn + 1 == rounds:
                done += gone
                break
            rest = rest.where(F.col("row_id").isin([r["row_id"] for r in gone]))
        key = lambda rows: sorted((r["row_id"], *[r[a] for a in H], r[SUPPRESSED]) for r in rows)
        assert key(out.where(F.col("sample_id") == i).collect()) == key(done)


def test_micro_aggregation_inside_samples(samples):
    models = [Model("k-Anonymity", 5)]
    h = {a: H[a] for a in ("sex", "zip")}
    typed = samples.withColumn("age", F.col("age").cast("double"))
    made = anonymizer.Anonymizer(search.Search(h, models=models, limit=0.2), models, "row_id", micro={"age": "ARITHMETIC_MEAN", "zip": "MODE"})
    out = made.release_each(typed, ["sample_id"]).join(typed.select("sample_id", "row_id", F.col("age").alias("raw_age"), F.col("zip").alias("raw_zip")), ["sample_id", "row_id"]).persist()
    live = out.where(f"not {SUPPRESSED}")
    # zip clusters by its label and is replaced by the commonest value, age by the class's mean
    sizes = live.groupBy("sample_id", "sex", "zip", "age").agg(F.count("*").alias("n"), F.avg("raw_age").alias("mean"), F.first(F.col("age")).alias("said")).collect()
    assert len(sizes) > 8 and all(r["n"] >= 5 and float(r["said"]) == pytest.approx(r["mean"]) for r in sizes)
    assert {r["zip"] for r in live.select("zip").distinct().collect()} <= {str(i) for i in range(9)}
    assert {(r["age"], r["zip"]) for r in out.where(SUPPRESSED).collect()} <= {("*", "*")}


def test_a_quasi_identifier_without_a_hierarchy_makes_the_class(spark):
    df = spark.createDataFrame([(i, f"{i:05d}", "fm"[i % 2]) for i in range(40)], "row_id long, zip string, sex string")
    data = cf.DataConfig("", [cf.AttributeConfig("zip"), cf.AttributeConfig("sex", levels={"*": ["f", "m"]})])
    five = cf.AnonymizationConfig(privacyModels=[{"type": "k-Anonymity", "k": 5}])
    out, made = cli.anonymize(df, data, five)
    assert made.names == ["zip", "sex"] and out.where(f"not {SUPPRESSED}").count() == 0 and {r["zip"] for r in out.collect()} == {"*"}
    alike = df.withColumn("zip", F.when(F.col("row_id") < 20, F.lit("a")).when(F.col("row_id") < 36, F.lit("b")).otherwise(F.col("zip")))
    kept = cli.anonymize(alike, data, five)[0].where(f"not {SUPPRESSED}")
    assert sorted(r["zip"] for r in kept.collect()) == ["a"] * 20 + ["b"] * 16


def emd_over_grid(rows, tree, t):
    """The published sum over inner nodes, with every value of the table in every class."""
    path = {r[0]: ["\x1f".join(r[i:]) for i in range(len(r))] for r in tree}
    q = Counter(s for _, s in rows)
    out = {}
    for c in {c for c, _ in rows}:
        own = Counter(s for d, s in rows if d == c)
        extra = {s: own[s] / sum(own.values()) - q[s] / len(rows) for s in q}
        height, cost = len(tree[0]) - 1, 0.0
        for level in range(1, height + 1):
            child = Counter()
            for s, x in extra.items():
                child[path[s][level - 1], path[s][level]] += x
            for node in {n for _, n in child}:
                xs = [x for (_, n), x in child.items() if n == node]
                cost += level / height * min(sum(x for x in xs if x > 0), -sum(x for x in xs if x < 0))
        out[c] = (sum(own.values()), round(cost, 9))
    return out


def test_closeness_over_trees_of_several_attributes(spark):
    rng = np.random.default_rng(8)
    trees = {"s": [(c, "low" if c in "abc" else "high", "*") for c in "abcdef"], "u": [(str(i), str(i // 3), str(i // 6), "*") for i in range(12)]}
    rows = [(None if g == 4 else int(g), "abcdef"[min(5, int(rng.integers(0, 3 + g)))], str(int(rng.integers(0, 12 - g)))) for g in rng.integers(0, 5, 400)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "row_id long, q int, s string, u string")
    own = {a: emd_over_grid([(r[0], r[1 + i]) for r in rows], tree, 0) for i, (a, tree) in enumerate(trees.items())}
    made = {a: Hierarchy(a, tree) for a, tree in trees.items()}
    found = {r["q"]: (r["class_size"], r["emd"]) for r in privacy.t_closeness_trees(df, ["q"], made, 0.1).collect()}
    assert set(found) == set(own["s"]) and None in found
    for q, (n, emd) in found.items():
        assert n == own["s"][q][0] and emd == pytest.approx(max(own[a][q][1] for a in own), abs=1e-9)
    # from a configuration that names no attributes: every sensitive column by its own tree
    data = cf.DataConfig("", [cf.AttributeConfig("q"), *[cf.AttributeConfig(a, attributeType="SENSITIVE", levels={"*": {"low": ["a", "b", "c"], "high": ["d", "e", "f"]}} if a == "s" else {"*": {"x": list("012345"), "y": ["6", "7", "8", "9", "10", "11"]}}) for a in trees]])
    closeness = cf.AnonymizationConfig(privacyModels=[{"type": "HierarchicalDistanceTCloseness", "t": 0.25}])
    (model,) = closeness.models(data.hierarchies())
    ok = {r["q"]: r["ok"] for (c,) in [model.classes(df, ["q"], ["s", "u"])] for r in c.collect()}
    assert set(ok) == set(found) and len(set(ok.values())) == 2
    released = cli.anonymize(df, data, closeness)[0]
    assert released.count() == 400 and {r["row_id"] for r in released.where(f"not {SUPPRESSED}").collect()} == {i for i, r in enumerate(rows) if ok[r[0]]}
    with pytest.raises(ValueError, match="hierarchy of q"):
        Model("HierarchicalDistanceTCloseness", 0.1, ("q",)).classes(df, ["s"], [])


class Starred:
    """A method of one's own: every class attribute of every second row becomes a star."""

    names, hierarchies = list(H), H

    def release_each(self, df, by, population=None):
        hide = F.col("row_id") % 2 == 0
        return df.withColumns({a: F.when(hide, F.lit("*")).otherwise(F.col(a)) for a in H} | {SUPPRESSED: hide})


def test_methods_and_features_of_ones_own_run_through_an_assessment(spark, monkeypatch):
    df = people(spark)
    picked = spark.createDataFrame([(3,), (70,)], "row_id long")
    shares = lambda out, numeric, categorical, codes, by: out.groupBy(*by).agg(F.avg(F.col(SUPPRESSED).cast("double")).alias("value")).select(*by, F.lit(0).alias("idx"), "value")
    monkeypatch.setitem(pa.FEATURES, "SHARE", shares)
    assert isinstance(Starred(), anonymizer.Method) and isinstance(method([Model("k-Anonymity", 2)]), anonymizer.Method)
    for made, kind in ((Starred(), "SHARE"), (method([Model("k-Anonymity", 2)], rounds=3), "HISTOGRAM")):
        plan = pa.Assessment(train=3, test=2, cohort=80, background=80, sample=20, classifier="KNN", features=kind)
        guesses, released, jobs = pa.assess_fully(df, "row_id", picked, made, {}, plan)
        assert guesses.count() == 2 * 2 * 2 and released.select("sample_id").distinct().count() == jobs.count() == 20
        assert (LEVELS in released.columns) == (kind == "HISTOGRAM")
        log = pa.assessment_log(df, "row_id", guesses, released, dict.fromkeys(H, 0), H, [])
        assert log.count() == 8 and log.where("Granularity < 0 or Granularity > 1 or Entropy < 0 or Entropy > 1").isEmpty()
