"""Lattice search: batches of level vectors are evaluated in one job on pre-aggregated tuples.

Rows are counted once per distinct tuple of quasi-identifiers (and sensitive values); all nodes of a
batch then read that small table. What to evaluate next follows from what has been evaluated and from
nothing else. So one table's search keeps one row per node on the driver, and the searches of many
samples run side by side: a frontier table ``(sample, levels)`` is evaluated in one job, and a grouped
step turns each sample's rows into its part of the next frontier.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import math
import time
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from privlens.functions.scalar import ratio, total
from privlens.operators.classes import WEIGHT
from privlens.operators.hierarchy import Hierarchy
from privlens.operators.privacy import Model, is_drawn, safepub_k, satisfied
from privlens.sources.shared import discard, materialize

#: Nodes evaluated in one job; bounds a job's expansion of the tuple table.
BATCH = 64

#: How the attributes' losses make one number.
AGGREGATES = ("RANK", "SUM", "MAXIMUM", "ARITHMETIC_MEAN", "GEOMETRIC_MEAN")


def loss_weights(gs: float = 0.5) -> tuple[float, float]:
    """Weights of generalization and suppression: 0 favours suppression, 1 generalization."""
    return (1.0 if gs <= 0.5 else 2.0 * (1.0 - gs)), (1.0 if gs >= 0.5 else 2.0 * gs)


def by_height(hierarchies: Mapping[str, Hierarchy], bounds: Mapping[str, tuple[int | None, int | None]] | None = None):
    """The level vectors within the bounds one by one, by height and then in order; none is held."""
    ranges = level_ranges(hierarchies, bounds)

    def with_sum(i: int, left: int):
        if i == len(ranges):
            if not left:
                yield ()
            return
        lo, hi = ranges[i]
        low, high = (sum(r[e] for r in ranges[i + 1 :]) for e in (0, 1))
        for x in range(max(lo, left - high), min(hi, left - low) + 1):
            for rest in with_sum(i + 1, left - x):
                yield (x, *rest)

    for height in range(sum(lo for lo, _ in ranges), sum(hi for _, hi in ranges) + 1):
        yield from with_sum(0, height)


def lattice(hierarchies: Mapping[str, Hierarchy], bounds: Mapping[str, tuple[int | None, int | None]] | None = None) -> list[tuple[int, ...]]:
    """All level vectors within the bounds, by height and then in order; for lattices that are small."""
    return list(by_height(hierarchies, bounds))


def lattice_frame(spark, hierarchies: Mapping[str, Hierarchy], bounds=None) -> DataFrame:
    """The lattice as ``(node, height, <attribute levels>)``."""
    names = list(hierarchies)
    rows = [(i, sum(v), *v) for i, v in enumerate(lattice(hierarchies, bounds))]
    return spark.createDataFrame(rows, "node int, height int, " + ", ".join(f"level_{n} int" for n in names))


def base_tuples(df: DataFrame, hierarchies: Mapping[str, Hierarchy], sensitive: Sequence[str] = (), by: Sequence[str] = (), population: DataFrame | None = None) -> DataFrame:
    """Distinct tuples with counts and, per attribute, its labels and their leaf shares at every level.

    ``l_<a>`` is the array of labels by level, ``g_<a>`` the array of ``leaves(label) / domain``; hierarchies of rules
    take their domain from ``population`` (default: ``df``).
    """
    names = list(hierarchies)
    values = df if population is None else population
    out = df.groupBy(*by, *names, *sensitive).agg(F.count("*").alias("n"))
    for a, h in hierarchies.items():
        domain = values.select(a).where(F.col(a).isNotNull()).distinct()
        table = h.table(domain)
        size = table.where("level = 0").agg(F.count("*").alias("domain"))
        counts = table.groupBy("level", "label").agg(F.count_distinct("leaf").alias("k"))
        shares = table.join(counts, ["level", "label"]).crossJoin(F.broadcast(size)).select("leaf", "level", "label", ratio(F.col("k"), F.col("domain")).alias("share"))  # size is one row
        wide = shares.groupBy("leaf").agg(F.array_sort(F.collect_list(F.struct("level", "label", "share"))).alias("x"))
        wide = wide.select(F.col("leaf").alias(f"__leaf_{a}"), F.col("x.label").alias(f"l_{a}"), F.col("x.share").alias(f"g_{a}"))
        out = out.join(wide, out[a].cast("string") == F.col(f"__leaf_{a}"), "left").drop(f"__leaf_{a}")
    return out


def evaluate(base: DataFrame, names: Sequence[str], nodes: Sequence[tuple[int, ...]], k: int = 1, gs: float = 0.5, aggregate: str = "GEOMETRIC_MEAN", by: Sequence[str] = (), models: Sequence[Model] = (), sensitive: Sequence[str] = (), frontier: DataFrame | None = None) -> DataFrame:
    """``(by, node, levels, rows, classes, suppressed, loss, losses)`` of each node; classes that violate k-anonymity or a model are suppressed.

    A cell of a kept record costs its label's share of the domain, of a suppressed record 1; both are
    weighted by :func:`loss_weights` and averaged per attribute (``losses``) before the aggregate. ``RANK``
    compares the attribute losses, largest first, and reports the largest. Models other than k-anonymity
    need a base with their sensitive attributes. A ``frontier(by, levels)`` names nodes for each group, in place of ``nodes`` for all.
    """
    spark = base.sparkSession
    gf, sf = loss_weights(gs)
    labels = [F.element_at(f"l_{a}", F.col("levels")[i] + 1).alias(f"k{i}") for i, a in enumerate(names)]
    shares = [(F.element_at(f"g_{a}", F.col("levels")[i] + 1) * F.col("n")).alias(f"s{i}") for i, a in enumerate(names)]
    # each tuple meets each node of its group's batch, of at most BATCH rows
    if frontier is None:
        listed = spark.createDataFrame([(i, list(v)) for i, v in enumerate(nodes)], "node int, levels array<int>")
        met = base.crossJoin(F.broadcast(listed))
    else:
        met = base.join(frontier.select(*by, "levels", F.array_join(F.col("levels").cast("array<string>"), ",").alias("node")), list(by))
    expanded = met.select(*by, "node", "levels", "n", *labels, *shares, *sensitive)
    keys = [f"k{i}" for i in range(len(names))]
    classes = expanded.groupBy(*by, "node", "levels", *keys).agg(F.sum("n").alias("size"), *[F.sum(f"s{i}").alias(f"s{i}") for i in range(len(names))])
    ok = F.col("size") >= k
    if models:
        verdict = satisfied(expanded.select(*by, "node", *keys, *sensitive, F.col("n").alias(WEIGHT)), keys, models, sensitive, [*by, "node"])
        verdict = verdict.select(*[F.col(c).alias(f"__{c}") for c in (*by, "node", *keys)], "ok")
        on = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in (*by, "node", *keys)])
        classes = classes.join(verdict, on, "left")
        ok = ok & F.coalesce(F.col("ok"), F.lit(False))
    sums = classes.groupBy(*by, "node", "levels").agg(
        F.sum("size").alias("rows"),
        F.sum(F.when(ok, 1).otherwise(0)).alias("classes"),
        F.sum(F.when(~ok, F.col("size")).otherwise(0)).alias("suppressed"),
        *[F.sum(F.when(ok, F.col(f"s{i}") * gf).otherwise(F.col("size") * sf)).alias(f"s{i}") for i in range(len(names))],
    )
    per = [ratio(F.col(f"s{i}"), F.col("rows")) for i in range(len(names))]
    if aggregate == "GEOMETRIC_MEAN":
        loss = F.exp(total([F.ln(F.greatest(p, F.lit(1e-300))) for p in per]) / len(per))
    elif aggregate == "ARITHMETIC_MEAN":
        loss = total(per) / len(per)
    elif aggregate == "SUM":
        loss = total(per)
    elif aggregate in ("MAXIMUM", "RANK"):
        loss = F.greatest(*per) if len(per) > 1 else per[0]
    else:
        raise ValueError(f"unknown aggregate {aggregate}")
    return sums.select(*by, "node", "levels", "rows", "classes", "suppressed", loss.alias("loss"), F.array(*per).alias("losses"))


def order_key(losses: Sequence[float], aggregate: str) -> tuple[float, ...]:
    """What nodes are compared by, from their attribute losses; it never falls where a loss rises."""
    losses = [x or 0.0 for x in losses]
    if aggregate == "RANK":
        return tuple(round(x, 9) for x in sorted(losses, reverse=True))
    if aggregate == "GEOMETRIC_MEAN":
        return (round(math.exp(sum(math.log(max(x, 1e-300)) for x in losses) / len(losses)), 9),)
    if aggregate == "MAXIMUM":
        return (round(max(losses), 9),)
    return (round(sum(losses) / (len(losses) if aggregate == "ARITHMETIC_MEAN" else 1), 9),)


def least_losses(base: DataFrame, hierarchies: Mapping[str, Hierarchy], gs: float = 0.5, by: Sequence[str] = ()) -> DataFrame:
    """``(by, least)``: per attribute and level, a loss that no node with that level undercuts: every cell at the cheaper of its label's cost and suppression.

    One pass over the tuples gives the bounds of all nodes.
    """
    gf, sf = loss_weights(gs)
    cost = lambda a, i: F.coalesce(F.least(F.element_at(f"g_{a}", i + 1) * gf, F.lit(sf)), F.lit(0.0)) * F.col("n")
    sums = base.groupBy(*by).agg(F.sum("n").alias("rows"), *[F.sum(cost(a, i)).alias(f"x_{j}_{i}") for j, (a, h) in enumerate(hierarchies.items()) for i in range(h.height + 1)])
    share = lambda j, i: ratio(F.coalesce(f"x_{j}_{i}", F.lit(0.0)), F.col("rows"))
    return sums.select(*by, F.array(*[F.array(*[share(j, i) for i in range(h.height + 1)]) for j, h in enumerate(hierarchies.values())]).alias("least"))


def best_node(evaluated: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The node of least loss per group; ties go to the lower height, then the smaller level vector."""
    height = F.aggregate("levels", F.lit(0), lambda x, y: x + y)
    order = F.struct(F.round("loss", 9).alias("loss"), height.alias("height"), F.col("levels").alias("levels"))
    row = F.struct("node", "levels", "classes", "suppressed", "loss")
    picked = evaluated.groupBy(*by).agg(F.min_by(row, order).alias("r")) if by else evaluated.agg(F.min_by(row, order).alias("r"))
    return picked.select(*by, "r.*")


Node = tuple[int, ...]


class Antichain:
    """The extreme nodes of a set that is closed downwards (``up=False``: the highest are kept) or upwards (the lowest are)."""

    def __init__(self, nodes: Iterable[Node], up: bool):
        self.up, self.nodes = up, []
        for v in sorted(nodes, key=sum, reverse=not up):
            if not self.covers(v):
                self.nodes.append(v)

    def covers(self, v: Node) -> bool:
        """Whether ``v`` is in the set that the kept nodes span."""
        if self.up:
            return any(all(x <= y for x, y in zip(u, v)) for u in self.nodes)
        return any(all(x >= y for x, y in zip(u, v)) for u in self.nodes)


def chain_up(v: Node, top: Node):
    """Nodes from ``v`` to ``top``, one level at a time, the attribute with most levels left first."""
    v = list(v)
    yield tuple(v)
    while True:
        left, i = max((hi - x, -i) for i, (x, hi) in enumerate(zip(v, top)))
        if not left:
            return
        v[-i] += 1
        yield tuple(v)


#: Models under which a class that is good stays good when it grows, so that what a node suppresses never rises with its levels.
MONOTONE = {"k-Anonymity", "DistinctLDiversity"}


@dataclass(frozen=True)
class Planner:
    """What a search evaluates next, as a function of what it has evaluated: it holds no state, and one planner serves any number of samples.

    ``seen`` maps a node to ``(fails, what counts if it fails, losses' key, height, node)``; the smallest value is the
    best node. Under monotone models what a failing node is above fails too, and it is never evaluated: unknown nodes are
    first tried half-way up a chain to one that is known to pass, which decides many others at once.
    """

    algorithm: str
    ranges: tuple[tuple[int, int], ...]
    aggregate: str = "GEOMETRIC_MEAN"
    steps: int = 2**31 - 1
    seed: int = 0
    monotone: bool = False

    @property
    def bottom(self) -> Node:
        return tuple(lo for lo, _ in self.ranges)

    @property
    def top(self) -> Node:
        return tuple(hi for _, hi in self.ranges)

    def score(self, v: Node, rows: float, suppressed: float, losses: Sequence[float], limit: float) -> tuple:
        fits = suppressed <= limit * rows + 1e-9
        return (not fits, () if fits else (suppressed,), order_key(losses, self.aggregate), sum(v), v)

    def propose(self, seen: Mapping[Node, tuple], least: Sequence[Sequence[float]], turn: int) -> list[Node]:
        """The nodes of the next batch, none if the search is over."""
        found = {"OPTIMAL": self._by_bound, "BOTTOM_UP": self._upwards, "GENETIC": self._evolved}[self.algorithm](seen, least, turn)
        new = [v for v in dict.fromkeys(found) if v not in seen]
        return new[: max(0, self.steps - len(seen))]

    def best(self, seen: Mapping[Node, tuple]) -> Node:
        return min(seen.values())[-1] if seen else self.bottom

    def _above(self, v: Node) -> list[Node]:
        return [(*v[:i], x + 1, *v[i + 1 :]) for i, x in enumerate(v) if x < self.ranges[i][1]]

    def _by_bound(self, seen: Mapping[Node, tuple], least: Sequence[Sequence[float]], turn: int) -> list[Node]:
        if not seen:
            return [self.bottom, self.top] if self.monotone else [self.bottom]
        best = min(seen.values())
        reach = None if best[0] else best[2]
        # where the top fails all nodes do, and the one that suppresses least is to be found
        prune = self.monotone and self.top in seen and not seen[self.top][0]
        failing = Antichain((v for v, s in seen.items() if s[0]), up=False)
        passing = Antichain((v for v, s in seen.items() if not s[0]), up=True)
        entry = lambda v: (order_key([x[level] for x, level in zip(least, v)], self.aggregate), sum(v), v)
        heap, met, batch, probes = [entry(self.bottom)], {self.bottom}, [], []
        while heap and len(batch) < BATCH and (reach is None or heap[0][0] <= reach):
            v = heapq.heappop(heap)[2]
            for up in self._above(v):
                if up not in met:
                    met.add(up)
                    heapq.heappush(heap, entry(up))
            if v in seen or (prune and failing.covers(v)):
                continue
            if prune and not passing.covers(v):
                if any(all(x <= y for x, y in zip(v, u)) for u in probes):
                    continue
                chain = list(chain_up(v, self.top))
                v = chain[next(i for i, u in enumerate(chain) if passing.covers(u)) // 2]
                probes.append(v)
            batch.append(v)
        return batch

    def _upwards(self, seen: Mapping[Node, tuple], least: Sequence[Sequence[float]], turn: int) -> list[Node]:
        if not seen:
            return [self.bottom]
        for _, _, _, _, v in sorted(seen.values()):
            if new := [u for u in self._above(v) if u not in seen]:
                return new
        return []

    def _evolved(self, seen: Mapping[Node, tuple], least: Sequence[Sequence[float]], turn: int) -> list[Node]:
        rng = np.random.default_rng((self.seed, turn))
        if not seen:
            return [self.bottom, self.top] + [tuple(int(rng.integers(lo, hi + 1)) for lo, hi in self.ranges) for _ in range(10)]
        elite = [s[-1] for s in sorted(seen.values())[:8]]
        for _ in range(5):
            children = []
            for _ in range(16):
                a, b = (elite[int(rng.integers(len(elite)))] for _ in range(2))
                child = [x if rng.random() < 0.5 else y for x, y in zip(a, b)]
                i = int(rng.integers(len(child)))
                child[i] = min(self.ranges[i][1], max(self.ranges[i][0], child[i] + int(rng.integers(-1, 2))))
                children.append(tuple(child))
            if any(c not in seen for c in children):
                return children
        return []


@dataclass(frozen=True)
class Draw(Planner):
    """The exponential mechanism over the whole lattice, in place of a search: a node is drawn with a chance of ``exp(factor * score)``.

    A node's score is the rows it keeps, times one minus its mean share of the ``heights``. The draw is the largest of
    all nodes' weights with Gumbel noise. The noise of a set of nodes is drawn for the set first and handed down as the
    set is split, attribute by attribute (Maddison et al., 2014). So nodes are met by a bound of what they can reach,
    and those that cannot win are never listed: a set's bound has the rows that its highest node keeps and the levels of
    its lowest. ``seen`` maps a node to the table's rows and those that the node keeps.
    """

    factor: float = 1.0
    heights: tuple[int, ...] = ()

    def score(self, v: Node, rows: float, suppressed: float, losses: Sequence[float], limit: float) -> tuple:
        return (float(rows), float(rows - suppressed))

    def propose(self, seen: Mapping[Node, tuple], least: Sequence[Sequence[float]], turn: int) -> list[Node]:
        return self._walk(seen)[0]

    def best(self, seen: Mapping[Node, tuple]) -> Node:
        missing, drawn = self._walk(seen)
        if missing:
            raise RuntimeError("a draw was stopped before it was decided")
        return drawn

    def weight(self, v: Node, kept: float) -> float:
        return self.factor * kept * (1.0 - sum(x / max(1, h) for x, h in zip(v, self.heights)) / len(self.heights))

    def _walk(self, seen: Mapping[Node, tuple], most: int = 16) -> tuple[list[Node], Node]:
        """``(nodes that must be evaluated before the draw is decided, the node drawn)``."""
        if self.top not in seen:
            return [self.top], self.top
        left = [math.prod(hi - lo + 1 for lo, hi in self.ranges[i:]) for i in range(len(self.ranges) + 1)]
        reach = lambda prefix, noise, kept: noise + self.weight((*prefix, *self.bottom[len(prefix) :]), kept)
        noise, kept = float(np.random.default_rng((self.seed, 0)).gumbel()) + math.log(left[0]), seen[self.top][1]
        # what a set can reach at most (negative), its prefix, its noise, and whether its own highest node made the bound
        heap, missing, best = [(-reach((), noise, kept), (), noise, True)], [], (-math.inf, self.top)
        while heap and -heap[0][0] > best[0] and len(missing) < most:
            bound, prefix, noise, own = heapq.heappop(heap)
            highest = (*prefix, *self.top[len(prefix) :])
            if highest not in seen:
                missing.append(highest)
                continue
            kept = seen[highest][1]
            if not own:
                heapq.heappush(heap, (-reach(prefix, noise, kept), prefix, noise, True))
            elif len(prefix) == len(self.ranges):
                best = (-bound, prefix)
            else:
                # one part, drawn by size, inherits the set's noise; the others' is drawn below it
                # (a seed's trailing zeros count for nothing, so levels are shifted)
                rng, (lo, hi) = np.random.default_rng((self.seed, 1, *[x + 1 for x in prefix])), self.ranges[len(prefix)]
                heir = lo + int(rng.integers(hi - lo + 1))
                for x in range(lo, hi + 1):
                    free = float(rng.gumbel()) + math.log(left[len(prefix) + 1])
                    share = noise if x == heir else -math.log(math.exp(-free) + math.exp(-noise))
                    heapq.heappush(heap, (-reach((*prefix, x), share, kept), (*prefix, x), share, False))
        return missing, best[1]


class Search:
    """Searches a lattice for the node of least loss whose suppression is within ``limit``, by one of three strategies, within a step and a time limit.

    OPTIMAL takes nodes by a lower bound of their loss and stops where the bound exceeds the best loss found, so the
    lattice is never listed and what cannot win is never evaluated; under monotone models neither is what must fail.
    BOTTOM_UP expands the best node found so far; GENETIC evolves level vectors with a seed. Spellings ``BEST_EFFORT_*``,
    ``EXACT`` and ``HEURISTIC`` are accepted. All models decide which classes are suppressed. If no node evaluated is
    within the limit, the one that suppresses least is returned. ``prune=False`` evaluates what monotony decides too.
    """

    NAMES = {"OPTIMAL": "OPTIMAL", "EXACT": "OPTIMAL", "HEURISTIC": "BOTTOM_UP", "BEST_EFFORT_BOTTOM_UP": "BOTTOM_UP", "BOTTOM_UP": "BOTTOM_UP", "BEST_EFFORT_GENETIC": "GENETIC", "GENETIC": "GENETIC"}

    def __init__(self, hierarchies: Mapping[str, Hierarchy], k: int = 1, algorithm: str = "OPTIMAL", steps: int | None = None, millis: int | None = None, gs: float = 0.5, aggregate: str = "GEOMETRIC_MEAN", bounds=None, seed: int = 0, models: Sequence[Model] = (), sensitive: Sequence[str] = (), limit: float = 1.0, prune: bool = True):
        self.hierarchies, self.k, self.gs, self.aggregate = dict(hierarchies), k, gs, aggregate
        self.millis, self.names, self.models, self.limit = millis, list(hierarchies), list(models), limit
        monotone = prune and all(m.kind in MONOTONE for m in self.models)
        # k-anonymity alone reads class sizes only
        if {m.kind for m in self.models} == {"k-Anonymity"}:
            self.k, self.models = max(int(m.parameter) for m in models), []
        named = [s for m in self.models for s in (m.attributes or sensitive)]
        self.sensitive = [s for s in dict.fromkeys([*sensitive, *named]) if s not in self.names] if self.models else []
        self.planner = Planner(self.NAMES[algorithm.upper()], level_ranges(self.hierarchies, bounds), aggregate, 2**31 - 1 if steps is None else steps, seed, monotone)
        self.seen: dict[Node, tuple] = {}

    def _evaluated(self, base: DataFrame, nodes: Sequence[Node], by: Sequence[str] = (), frontier: DataFrame | None = None) -> DataFrame:
        return evaluate(base, self.names, nodes, self.k, self.gs, self.aggregate, by, self.models, self.sensitive, frontier)

    def run(self, df: DataFrame, population: DataFrame | None = None) -> dict[str, int]:
        """The level vector of least loss among those evaluated."""
        base = base_tuples(df, self.hierarchies, self.sensitive, population=population).persist()
        began, self.seen = time.monotonic(), {}
        try:
            least = least_losses(base, self.hierarchies, self.gs).first()["least"]
            for turn in itertools.count():
                nodes = self.planner.propose(self.seen, least, turn)
                if not nodes:
                    break
                known = len(self.seen)
                for at in range(0, len(nodes), BATCH):
                    for r in self._evaluated(base, nodes[at : at + BATCH]).collect():
                        v = tuple(r["levels"])
                        self.seen[v] = self.planner.score(v, r["rows"], r["suppressed"], r["losses"], self.limit)
                # a table without rows leaves no node to be seen
                if len(self.seen) == known or (self.millis is not None and (time.monotonic() - began) * 1000 >= self.millis):
                    break
        finally:
            base.unpersist()
        return dict(zip(self.names, self.planner.best(self.seen) if self.seen else self.planner.bottom))

    def run_each(self, df: DataFrame, by: Sequence[str], population: DataFrame | None = None) -> DataFrame:
        """``(by, levels)``: the level vector of every group of ``df``, each the same as :meth:`run` finds for the group alone; a written table.

        All searches advance together: a turn evaluates each group's part of a frontier table in one job, and a grouped
        step takes each group's nodes so far to its part of the next. Groups that are done have no part in it. The time
        limit is one group's; all groups have it as often as they take turns on the session's parallel slots.
        """
        import pandas as pd

        by, planner, limit = list(by), self.planner, self.limit
        base = materialize(base_tuples(df, self.hierarchies, self.sensitive, by, population), "tuples")
        least = materialize(least_losses(base, self.hierarchies, self.gs, by), "least")
        own = _own_planner(planner, by)
        keys = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.select(*by).schema.fields)
        named = least.select(*[F.col(b).alias(f"__g{i}") for i, b in enumerate(by)], "least")

        def known(pdf: pd.DataFrame) -> dict[Node, tuple]:
            plan = own(pdf)
            rows = zip(pdf["levels"], pdf["rows"], pdf["suppressed"], pdf["losses"])
            return {v: plan.score(v, rows, gone, losses.tolist(), limit) for v, rows, gone, losses in ((tuple(map(int, x)), n, g, y) for x, n, g, y in rows)}

        def next_nodes(turn: int):
            def run(pdf: pd.DataFrame, bounds: pd.DataFrame) -> pd.DataFrame:
                found = own(pdf).propose(known(pdf), [x.tolist() for x in bounds["least"].iloc[0]], turn) if len(pdf) and len(bounds) else []
                return pd.DataFrame({b: [pdf[b].iloc[0]] * len(found) for b in by} | {"levels": pd.Series([list(v) for v in found], dtype=object)})

            return run

        def chosen(pdf: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({b: [pdf[b].iloc[0]] for b in by} | {"levels": [list(own(pdf).best(known(pdf)))]})

        first = planner.propose({}, [], 0)
        frontier = least.select(*by, F.explode(F.array(*[F.array(*map(F.lit, v)) for v in first])).alias("levels"))
        groups, began, seen, parts = least.count(), time.monotonic(), None, []
        slots = max(1, df.sparkSession.sparkContext.defaultParallelism)
        for turn in itertools.count(1):
            part = self._evaluated(base, (), by, frontier).select(*by, "levels", "rows", "suppressed", "losses")
            parts.append(materialize(part, "evaluated"))
            seen = parts[-1] if seen is None else seen.unionByName(parts[-1])
            if turn > 1:
                discard(frontier)
            frontier = materialize(seen.groupBy(*by).cogroup(named.groupBy(*[f"__g{i}" for i in range(len(by))])).applyInPandas(next_nodes(turn), keys + "levels array<int>"), "frontier")
            late = self.millis is not None and (time.monotonic() - began) * 1000 >= self.millis * -(-groups // slots)
            if late or frontier.isEmpty():
                break
        out = materialize(seen.groupBy(*by).applyInPandas(chosen, keys + "levels array<int>"), "levels")
        discard(base, least, frontier, *parts)
        return out


def _own_planner(planner: Planner, by: Sequence[str]):
    """The planner of a group: a draw has noise of its own in each group."""

    def own(pdf) -> Planner:
        return replace(planner, seed=group_seed(planner.seed, [pdf[b].iloc[0] for b in by])) if isinstance(planner, Draw) else planner

    return own


def group_seed(seed: int, values: Sequence) -> int:
    return int.from_bytes(hashlib.sha256(f"{seed}:{':'.join(map(str, values))}".encode()).digest()[:8], "big")


def level_ranges(hierarchies: Mapping[str, Hierarchy], bounds: Mapping[str, tuple[int | None, int | None]] | None = None) -> tuple[tuple[int, int], ...]:
    """The lowest and highest level of each attribute."""
    found = []
    for name, h in hierarchies.items():
        lo, hi = (bounds or {}).get(name, (None, None))
        found.append((max(0, lo or 0), min(h.height, h.height if hi is None else hi)))
    return tuple(found)


class PrivateSearch(Search):
    """A level vector for a differentially private release with ``epsilon`` in all, ``budget`` of which the choice spends; see :class:`Draw`.

    The sample of the remaining budget is scored under its k. A row changes a score by ``k`` at most, so a node is drawn
    with a chance of ``exp(budget * score / 2k)``. A draw knows no step or time limit: one that ends early would be another draw.
    """

    def __init__(self, hierarchies: Mapping[str, Hierarchy], key: str, epsilon: float, delta: float, budget: float, bounds=None, seed: int = 0):
        self.key, self.rest = key, epsilon - budget
        super().__init__(hierarchies, safepub_k(self.rest, delta), bounds=bounds, seed=seed, gs=0.0, aggregate="ARITHMETIC_MEAN")
        self.planner = Draw("DRAW", self.planner.ranges, seed=seed, factor=budget / (2.0 * self.k), heights=tuple(h.height for h in self.hierarchies.values()))

    def run(self, df: DataFrame, population: DataFrame | None = None) -> dict[str, int]:
        return super().run(df.where(is_drawn(self.key, self.rest, self.planner.seed)), df if population is None else population)

    def run_each(self, df: DataFrame, by: Sequence[str], population: DataFrame | None = None) -> DataFrame:
        """As :meth:`Search.run_each`; the rows of a group are drawn for that group. A group of which none is drawn gets its lowest levels."""
        drawn = super().run_each(df.where(is_drawn(self.key, self.rest, self.planner.seed, by)), by, df if population is None else population)
        rest = df.select(*by).distinct().join(drawn, list(by), "left_anti")
        return drawn.unionByName(rest.withColumn("levels", F.array(*map(F.lit, self.planner.bottom))))


def private_levels(df: DataFrame, key: str, hierarchies: Mapping[str, Hierarchy], epsilon: float, delta: float, budget: float, bounds=None, seed: int = 0) -> dict[str, int]:
    """The level vector that :class:`PrivateSearch` draws."""
    return PrivateSearch(hierarchies, key, epsilon, delta, budget, bounds, seed).run(df)
