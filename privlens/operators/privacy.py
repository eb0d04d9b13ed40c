"""Privacy models: class-level predicates, table-level thresholds and sampling-based differential privacy.

A class-level model turns a released table into ``(by, qis, ok, ...)``, one row per equivalence class.
Formulas follow the published definitions; each is in one function. All counts are aggregated to
class-by-value size before anything is joined.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from privlens.functions.scalar import ratio, seeded_order
from privlens.operators.classes import SUPPRESSED, WEIGHT, equivalence_classes, live_rows, row_count
from privlens.operators.hierarchy import Hierarchy

#: Slack of comparisons with a threshold, for sums in another order.
EPS = 1e-9


def value_counts(df: DataFrame, qis: Sequence[str], sensitive: str, by: Sequence[str] = ()) -> DataFrame:
    """``(by, qis, __s, __n)``: how often each sensitive value occurs in each class of live rows."""
    return live_rows(df).groupBy(*by, *qis, F.col(sensitive).cast("string").alias("__s")).agg(row_count(df).alias("__n"))


def class_grid(df: DataFrame, qis: Sequence[str], sensitive: str, by: Sequence[str] = ()) -> DataFrame:
    """``(by, qis, __s, __size, __p, __q)`` for every class and every value of the table's domain; values missing from a class have ``__p = 0``."""
    counts = value_counts(df, qis, sensitive, by)
    sizes = counts.groupBy(*by, *qis).agg(F.sum("__n").alias("__size"))
    domain = counts.groupBy(*by, "__s").agg(F.sum("__n").alias("__m"))
    total = domain.groupBy(*by).agg(F.sum("__m").alias("__rows"))
    domain = domain.join(total, list(by)) if by else domain.crossJoin(F.broadcast(total))  # one row
    domain = domain.select(*by, "__s", ratio(F.col("__m"), F.col("__rows")).alias("__q"))
    # classes times the sensitive domain, the definition's own grid; both sides are aggregates
    grid = sizes.join(domain, list(by)) if by else sizes.crossJoin(domain)
    keys = [*by, *qis, "__s"]
    found = counts.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__n").alias("__found"))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)])
    return grid.join(found, same, "left").select(*keys, "__size", ratio(F.coalesce("__found", F.lit(0)), F.col("__size")).alias("__p"), "__q")


def k_anonymity(df: DataFrame, qis: Sequence[str], k: int, by: Sequence[str] = ()) -> DataFrame:
    return equivalence_classes(df, qis, by).withColumn("ok", F.col("class_size") >= k)


def distinct_l_diversity(df: DataFrame, qis: Sequence[str], sensitive: str, l: int, by: Sequence[str] = ()) -> DataFrame:  # noqa: E741
    counts = value_counts(df, qis, sensitive, by).groupBy(*by, *qis).agg(F.sum("__n").alias("class_size"), F.count("__s").alias("n_distinct"))
    return counts.withColumn("ok", F.col("n_distinct") >= l)


def entropy_l_diversity(df: DataFrame, qis: Sequence[str], sensitive: str, l: float, by: Sequence[str] = ()) -> DataFrame:  # noqa: E741
    """Entropy of the class as ``ln(size) - sum(n ln n) / size``, at least ``ln l``."""
    n = F.col("__n").cast("double")
    sums = value_counts(df, qis, sensitive, by).groupBy(*by, *qis).agg(F.sum("__n").alias("class_size"), F.sum(n * F.ln(n)).alias("nln"))
    sums = sums.withColumn("entropy", F.ln(F.col("class_size").cast("double")) - F.col("nln") / F.col("class_size")).drop("nln")
    return sums.withColumn("ok", F.col("entropy") >= math.log(l) - EPS)


def t_closeness_equal(df: DataFrame, qis: Sequence[str], sensitive: str, t: float, by: Sequence[str] = ()) -> DataFrame:
    """Equal ground distance: half the sum of ``|p - q|``."""
    g = class_grid(df, qis, sensitive, by)
    out = g.groupBy(*by, *qis).agg(F.first("__size").alias("class_size"), (F.sum(F.abs(F.col("__p") - F.col("__q"))) / 2).alias("emd"))
    return out.withColumn("ok", F.col("emd") <= t + EPS)


def t_closeness_hierarchical(df: DataFrame, qis: Sequence[str], sensitive: str, hierarchy: Hierarchy, t: float, by: Sequence[str] = ()) -> DataFrame:
    """Hierarchical ground distance of one attribute; see :func:`t_closeness_trees`."""
    return t_closeness_trees(df, qis, {sensitive: hierarchy}, t, by)


def _tree_steps(values: DataFrame, names: Sequence[str], trees: Mapping[str, Hierarchy]) -> DataFrame:
    """``(__a, __s, __steps)``: for each value of each attribute its steps up the attribute's tree, ``(level, weight, child, node)``.

    A node is its label together with all labels above it, since labels recur across levels.
    """
    out = None
    for i, name in enumerate(names):
        tree = trees[name]
        part = values.where(F.col("__a") == i).select("__a", "__s")
        for level in range(tree.height + 1):
            part = tree.attach(part, level, f"__l{level}", "__s")
        path = lambda level, top=tree.height: F.concat_ws("\u001f", *[F.coalesce(F.col(f"__l{x}"), F.lit("\u0000")) for x in range(level, top + 1)])
        steps = [F.struct(F.lit(x).alias("level"), F.lit(x / tree.height).alias("weight"), path(x - 1).alias("child"), path(x).alias("node")) for x in range(1, tree.height + 1)]
        part = part.select("__a", "__s", F.array(*steps).cast("array<struct<level: int, weight: double, child: string, node: string>>").alias("__steps"))
        out = part if out is None else out.unionByName(part)
    return out


def t_closeness_trees(df: DataFrame, qis: Sequence[str], trees: Mapping[str, Hierarchy], t: float, by: Sequence[str] = ()) -> DataFrame:
    """``(by, qis, class_size, emd, ok)``: hierarchical ground distance of every attribute of ``trees``, each over its own tree; ``emd`` is the largest.

    An inner node costs ``level / height * min(positive extras, negative extras)`` of its children, an extra being the
    class's share of a child minus the table's. The extras of a node's children sum up to its own, so the
    negative ones follow from the positive ones, and only children that occur in a class are looked at: the roll-up
    goes over counts, never over classes times the domain. A null is a class's value like any other, in
    quasi-identifiers and sensitive columns.
    """
    keys, names = [*by, *qis], list(trees)
    flat = [n for n in names if not trees[n].height]
    if flat:
        raise ValueError(f"no levels above the values of {flat}")
    live = live_rows(df)
    cells = live.select(*keys, *[c for c in (WEIGHT,) if c in df.columns], F.posexplode(F.array(*[F.col(n).cast("string") for n in names])).alias("__a", "__s"))
    counts = cells.groupBy(*keys, "__a", "__s").agg(row_count(df).alias("__n"))
    counts = counts.withColumn("__size", F.sum("__n").over(Window.partitionBy(*keys, "__a")))
    domain = counts.groupBy(*by, "__a", "__s").agg(F.sum("__n").alias("__m"))
    steps = _tree_steps(domain.select("__a", "__s").distinct(), names, trees).select(F.col("__a").alias("__b"), F.col("__s").alias("__v"), "__steps")
    climbed = lambda rows: rows.join(steps, (F.col("__a") == F.col("__b")) & F.col("__s").eqNullSafe(F.col("__v"))).withColumn("__x", F.explode("__steps"))
    # the table's share of every node and child
    rows = domain.groupBy(*by, "__a").agg(F.sum("__m").alias("__rows"))
    child = climbed(domain).groupBy(*by, "__a", F.col("__x.level").alias("__level"), F.col("__x.node").alias("__node"), F.col("__x.child").alias("__child")).agg(F.sum("__m").alias("__m"))
    child = child.join(rows, [*by, "__a"]).select(*by, "__a", "__level", "__node", "__child", ratio(F.col("__m"), F.col("__rows")).alias("__q"))
    node = child.groupBy(*by, "__a", "__level", "__node").agg(F.sum("__q").alias("__q_node"))
    shares = child.join(node, [*by, "__a", "__level", "__node"]).drop("__node")
    held = climbed(counts).groupBy(*keys, "__a", "__size", F.col("__x.level").alias("__level"), F.col("__x.weight").alias("__weight"), F.col("__x.node").alias("__node"), F.col("__x.child").alias("__child")).agg(F.sum("__n").alias("__n"))
    p = ratio(F.col("__n"), F.col("__size"))
    nodes = held.join(shares, [*by, "__a", "__level", "__child"]).groupBy(*keys, "__a", "__size", "__level", "__weight", "__node")
    nodes = nodes.agg(F.sum(F.greatest(p - F.col("__q"), F.lit(0.0))).alias("__pos"), (F.sum(p) - F.first("__q_node")).alias("__extra"))
    cost = F.col("__weight") * F.greatest(F.least(F.col("__pos"), F.col("__pos") - F.col("__extra")), F.lit(0.0))
    each = nodes.groupBy(*keys, "__a", "__size").agg(F.sum(cost).alias("emd"))
    out = each.groupBy(*keys).agg(F.first("__size").alias("class_size"), F.max("emd").alias("emd"))
    return out.withColumn("ok", F.col("emd") <= t + EPS)


def d_disclosure(df: DataFrame, qis: Sequence[str], sensitive: str, d: float, by: Sequence[str] = ()) -> DataFrame:
    """``|ln(p / q)| < d`` for every value of the domain; a missing value violates."""
    g = class_grid(df, qis, sensitive, by)
    fine = F.when(F.col("__p") > 0, F.abs(F.ln(F.col("__p") / F.col("__q"))) < d - EPS).otherwise(F.lit(False))
    return g.groupBy(*by, *qis).agg(F.first("__size").alias("class_size"), F.bool_and(fine).alias("ok"))


def enhanced_b_likeness(df: DataFrame, qis: Sequence[str], sensitive: str, b: float, by: Sequence[str] = ()) -> DataFrame:
    """``(p - q) / q <= min(b, -ln q)`` wherever ``p > q``."""
    p, q = F.col("__p"), F.col("__q")
    over = F.when(p > q, (p - q) / q - F.least(F.lit(float(b)), -F.ln(q))).otherwise(F.lit(0.0))
    out = class_grid(df, qis, sensitive, by).groupBy(*by, *qis).agg(F.first("__size").alias("class_size"), F.max(over).alias("excess"))
    return out.withColumn("ok", F.col("excess") <= EPS)


def average_risk_cut(classes: DataFrame, risk: float, by: Sequence[str] = ()) -> DataFrame:
    """``(by, cut)``: the smallest class size to keep so that classes over records is at most ``risk`` (null: nothing can be kept).

    Classes go smallest first, whole sizes at a time; the running sums go over sizes, of which there are few, not over classes.
    """
    hist = classes.groupBy(*by, "class_size").agg(F.count("*").alias("n"))
    rest = Window.partitionBy(*by).orderBy(F.desc("class_size")).rowsBetween(Window.unboundedPreceding, 0)
    share = ratio(F.sum("n").over(rest), F.sum(F.col("n") * F.col("class_size")).over(rest))
    kept = hist.withColumn("share", share)
    return kept.groupBy(*by).agg(F.min(F.when(F.col("share") <= risk + EPS, F.col("class_size"))).alias("cut"))


def average_reidentification_risk(df: DataFrame, qis: Sequence[str], risk: float, by: Sequence[str] = ()) -> DataFrame:
    """Classes with ``ok``: those that stay when classes are dropped smallest first until the average risk is met."""
    classes = equivalence_classes(df, qis, by)
    cut = average_risk_cut(classes, risk, by)
    out = classes.join(cut, list(by)) if by else classes.crossJoin(F.broadcast(cut))  # one row
    return out.withColumn("ok", F.coalesce(F.col("class_size") >= F.col("cut"), F.lit(False))).drop("cut")


# --- differential privacy by sampling and k-anonymity ----------------------------------------------


def safepub_beta(epsilon: float) -> float:
    return 1.0 - math.exp(-epsilon)


def _binomial_tail(n: int, p: float, above: float) -> float:
    """P[Binomial(n, p) > above]."""
    k = math.floor(above + 1e-12) + 1
    total = 0.0
    for j in range(k, n + 1):
        total += math.exp(math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) + j * math.log(p) + (n - j) * math.log1p(-p))
    return total


def safepub_k(epsilon: float, delta: float, limit: int = 10_000) -> int:
    """Smallest ``k`` with ``max over n >= ceil(k / gamma - 1) of P[Binomial(n, beta) > gamma n] <= delta``."""
    beta = safepub_beta(epsilon)
    gamma = (math.exp(epsilon) - 1.0 + beta) / math.exp(epsilon)
    for k in range(1, limit):
        n0 = max(1, math.ceil(k / gamma - 1.0))
        # the tail falls with n up to the sawtooth of rounding: one period past it is enough
        worst = max(_binomial_tail(n, beta, gamma * n) for n in range(n0, n0 + math.ceil(2 / gamma) + 2))
        if worst <= delta:
            return k
    raise ValueError(f"no k up to {limit} gives delta {delta}")


def is_drawn(key: str, epsilon: float, seed: int | str = 0, by: Sequence[str] = ()) -> Column:
    """Whether a row is in the Bernoulli sample of a budget, by 12 hexadecimal digits of a keyed digest; every group of ``by`` has a sample of its own."""
    named = F.concat_ws(":", *by, F.col(key).cast("string")) if by else F.col(key)
    return F.conv(F.substring(seeded_order(seed, "dp", named), 1, 12), 16, 10).cast("double") / float(16**12) < safepub_beta(epsilon)


def safepub(df: DataFrame, key: str, qis: Sequence[str], epsilon: float, delta: float, seed: int | str = 0) -> DataFrame:
    """``df`` with ``is_sampled`` and ``is_suppressed``: a seeded Bernoulli sample, then k-anonymity of the sample with the k that the budget asks for.

    Rows outside the sample are suppressed.
    """
    k = safepub_k(epsilon, delta)
    drawn = df.withColumn("is_sampled", is_drawn(key, epsilon, seed))
    sizes = drawn.where("is_sampled").groupBy(*[F.col(q).alias(f"__k{i}") for i, q in enumerate(qis)]).agg(F.count("*").alias("__n"))
    on = reduce(lambda a, b: a & b, [F.col(q).eqNullSafe(F.col(f"__k{i}")) for i, q in enumerate(qis)])
    out = drawn.join(sizes, on, "left").select(*drawn.columns, "__n")
    return out.withColumn(SUPPRESSED, ~(F.col("is_sampled") & (F.coalesce("__n", F.lit(0)) >= k))).drop("__n")


# --- population uniqueness -------------------------------------------------------------------------


def pitman_fit(sizes: dict[int, int], rounds: int = 400) -> tuple[float, float]:
    """Maximum-likelihood ``(theta, alpha)`` of Pitman's sampling formula from class-size counts, by nested golden section."""
    n = sum(j * f for j, f in sizes.items())
    u = sum(sizes.values())
    lg = math.lgamma

    def likelihood(theta: float, alpha: float) -> float:
        # sums of logarithms as gamma functions: sum_{i=1}^{u-1} ln(theta + i alpha) and so on
        first = (u - 1) * math.log(alpha) + lg(theta / alpha + u) - lg(theta / alpha + 1)
        second = lg(theta + n) - lg(theta + 1)
        third = sum(f * (lg(j - alpha) - lg(1 - alpha)) for j, f in sizes.items() if j > 1)
        return first - second + third

    def best(f, lo, hi, steps):
        g = (math.sqrt(5) - 1) / 2
        a, b = lo, hi
        c, d = b - g * (b - a), a + g * (b - a)
        fc, fd = f(c), f(d)
        for _ in range(steps):
            if fc > fd:
                b, d, fd = d, c, fc
                c = b - g * (b - a)
                fc = f(c)
            else:
                a, c, fc = c, d, fd
                d = a + g * (b - a)
                fd = f(d)
        return (a + b) / 2

    steps = max(20, rounds // 8)
    theta_of = lambda alpha: math.exp(best(lambda t: likelihood(math.exp(t), alpha), math.log(1e-6), math.log(1e12), steps))
    alpha = best(lambda a: likelihood(theta_of(a), a), 1e-6, 1 - 1e-6, steps)
    return theta_of(alpha), alpha


def pitman_uniques(theta: float, alpha: float, population: float) -> float:
    return math.exp(math.lgamma(theta + 1) - math.lgamma(theta + alpha) + alpha * math.log(population))


def zayatz_uniques(sizes: dict[int, int], population: float) -> float:
    """Population uniques by Zayatz: sample uniques times the chance that a singleton's population class has size one."""
    n, u = sum(j * f for j, f in sizes.items()), sum(sizes.values())
    pi = n / population
    if not sizes.get(1):
        return 0.0
    # P(population size i) from sample sizes; P(sample size 1 | size i) under simple random sampling
    weight = {i: f / u for i, f in sizes.items()}
    seen = sum(w * i * pi * (1 - pi) ** (i - 1) for i, w in weight.items())
    return sizes[1] * (weight.get(1, 0.0) * pi) / seen if seen else 0.0


def snb_uniques(sizes: dict[int, int], population: float) -> float:
    """Population uniques by the slide negative binomial model, fitted by moments of the slid sizes."""
    n, u = sum(j * f for j, f in sizes.items()), sum(sizes.values())
    pi = n / population
    mean = n / u / pi - 1
    second = sum((j / pi) ** 2 * f for j, f in sizes.items()) / u
    var = max(second - (n / u / pi) ** 2, 1e-9)
    if mean <= 0:
        return float(u)
    if var <= mean:
        return u * math.exp(-mean)
    r, p = mean * mean / (var - mean), mean / var
    return u * p**r


def population_uniques(sizes: dict[int, int], population: float, model: str = "PITMAN") -> float:
    """Estimated number of population uniques that the sample holds, at most its own uniques.

    ``DANKAR`` follows the decision rule of Dankar et al. (2012): for sampling fractions up to 0.1 Pitman
    where it can be fitted and else Zayatz; above it the smaller of Zayatz and the slide negative binomial.
    """
    n = sum(j * f for j, f in sizes.items())
    own = sizes.get(1, 0)
    if not n or not own:
        return 0.0
    if population <= n:
        return float(own)
    kind = model.upper()
    if kind == "DANKAR":
        if n / population <= 0.1:
            found = pitman_uniques(*pitman_fit(sizes), population) if sizes.get(2) else zayatz_uniques(sizes, population)
        else:
            found = min(zayatz_uniques(sizes, population), snb_uniques(sizes, population))
    elif kind == "PITMAN":
        found = pitman_uniques(*pitman_fit(sizes), population)
    elif kind == "ZAYATZ":
        found = zayatz_uniques(sizes, population)
    elif kind == "SNB":
        found = snb_uniques(sizes, population)
    else:
        raise ValueError(f"unknown model {model}")
    return min(found, population)


#: Inhabitants of regions that a configuration may name instead of a population; round figures, to be replaced by ``population`` where it matters.
REGIONS = {
    "USA": 319e6, "CANADA": 35.5e6, "EUROPE": 741e6, "EUROPEAN_UNION": 507e6, "GERMANY": 81e6, "FRANCE": 66e6, "UK": 64.5e6,
    "CHINA": 1367e6, "INDIA": 1267e6, "AUSTRALIA": 23.5e6, "WORLD": 7200e6,
}


def population_cut(hist: DataFrame, threshold: float, population: float, model: str = "PITMAN", by: Sequence[str] = ()) -> DataFrame:
    """``(by, cut)``: the smallest class size that may stay, from ``hist(by, class_size, n)``, one row per distinct size.

    Classes go smallest first until the estimated uniques over the population are at most ``threshold``; a population
    smaller than the table (or 0, for none known) counts as the table itself.
    """
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        sizes = {int(z): int(n) for z, n in zip(pdf["class_size"], pdf["n"])}
        whole = max(population, float(sum(z * n for z, n in sizes.items())))
        cut = next((z for z in sorted(sizes) if population_uniques({j: f for j, f in sizes.items() if j >= z}, whole, model) / whole <= threshold), max(sizes, default=0) + 1)
        return pd.DataFrame({b: [pdf[b].iloc[0]] for b in by} | {"cut": [cut]})

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in hist.select(*by).schema.fields) + "cut long"
    return hist.groupBy(*by).applyInPandas(run, schema)


def population_uniqueness(df: DataFrame, qis: Sequence[str], threshold: float, population: float, model: str = "PITMAN", by: Sequence[str] = ()) -> DataFrame:
    """Classes with ``ok``: what stays when classes go smallest first until estimated uniques over the population are at most ``threshold``."""
    classes = equivalence_classes(df, qis, by)
    cut = population_cut(classes.groupBy(*by, "class_size").agg(F.count("*").alias("n")), threshold, population, model, by)
    out = classes.join(cut, list(by)) if by else classes.crossJoin(F.broadcast(cut))  # one row
    return out.withColumn("ok", F.col("class_size") >= F.col("cut")).drop("cut")


# --- models as values ------------------------------------------------------------------------------


@dataclass(frozen=True)
class Model:
    """A configured model; ``kind`` is its name in configuration files and the key of its function in :data:`MODELS`."""

    kind: str
    parameter: float
    attributes: tuple[str, ...] = ()
    delta: float = 0.0
    population: float = 0.0
    estimator: str = "PITMAN"
    hierarchy: Hierarchy | None = None
    #: Trees of the sensitive attributes; ``hierarchy`` stands for those that are not in it.
    trees: Mapping[str, Hierarchy] = field(default_factory=dict)

    def tree(self, name: str) -> Hierarchy:
        found = self.trees.get(name) or self.hierarchy
        if found is None or not found.height:
            raise ValueError(f"{self.kind} needs a hierarchy of {name}")
        return found

    def classes(self, df: DataFrame, qis: Sequence[str], sensitive: Sequence[str], by: Sequence[str] = ()) -> list[DataFrame]:
        """One table of classes with ``ok`` per sensitive attribute (one for models without)."""
        if self.kind not in MODELS:
            raise ValueError(f"unknown privacy model {self.kind}")
        return MODELS[self.kind](self, df, qis, list(self.attributes or sensitive), by)


def _per_attribute(function):
    def run(m: Model, df: DataFrame, qis: Sequence[str], names: Sequence[str], by: Sequence[str]) -> list[DataFrame]:
        if not names:
            raise ValueError(f"{m.kind} needs a sensitive attribute")
        return [function(df, qis, s, m.parameter, by) for s in names]

    return run


def _hierarchical_closeness(m: Model, df: DataFrame, qis: Sequence[str], names: Sequence[str], by: Sequence[str]) -> list[DataFrame]:
    if not names:
        raise ValueError(f"{m.kind} needs a sensitive attribute")
    return [t_closeness_trees(df, qis, {s: m.tree(s) for s in names}, m.parameter, by)]


#: Functions ``(model, df, qis, attributes, by)`` to tables of classes with ``ok``; add an entry for a model of your own.
#: Differential privacy asks the k of its budget here; :func:`privlens.operators.recode.release` draws its sample.
MODELS = {
    "k-Anonymity": lambda m, df, qis, names, by: [k_anonymity(df, qis, int(m.parameter), by)],
    "AverageReidentificationRisk": lambda m, df, qis, names, by: [average_reidentification_risk(df, qis, m.parameter, by)],
    "PopulationUniqueness": lambda m, df, qis, names, by: [population_uniqueness(df, qis, m.parameter, m.population, m.estimator, by)],
    "EDDifferentialPrivacy": lambda m, df, qis, names, by: [k_anonymity(df, qis, safepub_k(m.parameter, m.delta), by)],
    "DistinctLDiversity": _per_attribute(distinct_l_diversity),
    "EntropyLDiversity": _per_attribute(entropy_l_diversity),
    "EqualDistanceTCloseness": _per_attribute(t_closeness_equal),
    "HierarchicalDistanceTCloseness": _hierarchical_closeness,
    "DDisclosurePrivacy": _per_attribute(d_disclosure),
    "EnhancedBLikeness": _per_attribute(enhanced_b_likeness),
}


def satisfied(df: DataFrame, qis: Sequence[str], models: Sequence[Model], sensitive: Sequence[str] = (), by: Sequence[str] = ()) -> DataFrame:
    """``(by, qis, ok)``: classes that satisfy every model."""
    parts = [c.select(*by, *qis, "ok") for m in models for c in m.classes(df, qis, sensitive, by)]
    if not parts:
        return equivalence_classes(df, qis, by).select(*by, *qis, F.lit(True).alias("ok"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy(*by, *qis).agg(F.bool_and("ok").alias("ok")) if len(parts) > 1 else out
