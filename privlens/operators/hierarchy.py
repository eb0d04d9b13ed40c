"""Generalization hierarchies: from rows, nested maps or rules, and their application."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from privlens.functions.scalar import STAR

#: A row's own level vector, where rows of one table have different ones: an array in the order of the attributes.
LEVELS = "__levels"

#: Leaves up to which a lookup is a literal map; larger hierarchies are joined.
MAP_LIMIT = 64


class Hierarchy:
    """A taxonomy of one attribute: level 0 is the value itself, each next level a coarser label.

    ``rows`` hierarchies list every leaf with its labels; ``rules`` hierarchies compute a label from the
    value. Labels are opaque text; a value without an entry generalizes to ``*``. Numeric leaves given
    as text are matched by number if ``numeric`` is set.
    """

    def __init__(self, attribute: str, rows: Sequence[Sequence[str]] | None = None, rules: Sequence[Callable[[Column], Column]] | None = None, numeric: bool = False):
        if (rows is None) == (rules is None):
            raise ValueError("give either rows or rules")
        self.attribute, self.rules, self.numeric = attribute, rules, numeric
        self.rows = [tuple(r) for r in rows] if rows is not None else None
        if self.rows is not None:
            widths = {len(r) for r in self.rows}
            if len(widths) > 1:
                raise ValueError(f"{attribute}: rows of {sorted(widths)} levels")
            self.height = (widths.pop() if widths else 1) - 1
        else:
            self.height = len(rules)

    @classmethod
    def suppression(cls, attribute: str) -> Hierarchy:
        """The two-level hierarchy of cell suppression: the value, then ``*``."""
        return cls(attribute, rules=[lambda c: F.lit(STAR)])

    @classmethod
    def identity(cls, attribute: str) -> Hierarchy:
        """The hierarchy of an attribute that has none: the values alone, so that it is part of its class and never generalized."""
        return cls(attribute, rules=[])

    @classmethod
    def nested(cls, attribute: str, tree: Mapping | Sequence) -> Hierarchy:
        """From an inline tree: map keys are outer labels, list entries leaves. Uneven branches repeat their last label."""
        paths: list[list[str]] = []

        def walk(node, above: list[str]):
            if isinstance(node, Mapping):
                for key, below in node.items():
                    walk(below, [str(key), *above])
            elif isinstance(node, (list, tuple)):
                for entry in node:
                    if isinstance(entry, (Mapping, list, tuple)):
                        walk(entry, above)
                    else:
                        paths.append([str(entry), *above])

        walk(tree, [])
        depth = max(map(len, paths), default=1)
        rows = [p + [p[-1]] * (depth - len(p)) for p in paths]
        if rows and {r[-1] for r in rows} != {STAR}:
            rows = [[*r, STAR] for r in rows]
        return cls(attribute, rows)

    def _key(self, value: Column) -> Column:
        return value.try_cast("double") if self.numeric else value.cast("string")

    def label(self, value: Column, level: int) -> Column:
        """The label of ``value`` at ``level`` as an expression."""
        if not 0 <= level <= self.height:
            raise ValueError(f"{self.attribute} has no level {level}")
        if level == 0:
            return value.cast("string")
        if self.rules is not None:
            return F.coalesce(self.rules[level - 1](value), F.lit(STAR))
        if level == self.height and all(r[-1] == STAR for r in self.rows):
            return F.lit(STAR)
        entries = [x for r in self.rows for x in (F.lit(float(r[0]) if self.numeric else r[0]), F.lit(r[level]))]
        return F.coalesce(F.create_map(*entries)[self._key(value)], F.lit(STAR)) if entries else F.lit(STAR)

    def attach(self, df: DataFrame, level: int, out: str, column: str | None = None) -> DataFrame:
        """``df`` with the label at ``level`` in ``out``; large row hierarchies are joined, others computed in place."""
        column = column or self.attribute
        if level == 0 or self.rules is not None or len(self.rows) <= MAP_LIMIT:
            return df.withColumn(out, self.label(df[column], level))
        leaf = F.col("__leaf").try_cast("double") if self.numeric else F.col("__leaf")
        side = df.sparkSession.createDataFrame([(r[0], r[level]) for r in self.rows], "__leaf string, __label string").dropDuplicates(["__leaf"])
        side = side.select(leaf.alias("__leaf"), "__label")
        # the joined side is a listed hierarchy; Spark picks the join by its size
        joined = df.join(side, self._key(df[column]) == F.col("__leaf"), "left")
        return joined.withColumn(out, F.coalesce("__label", F.lit(STAR))).drop("__leaf", "__label")

    def attach_at(self, df: DataFrame, level: Column, out: str, column: str | None = None) -> DataFrame:
        """``df`` with the label at each row's own ``level`` in ``out``."""
        column = column or self.attribute
        if self.rules is not None or len(self.rows) <= MAP_LIMIT:
            return df.withColumn(out, F.coalesce(*[F.when(level == i, self.label(df[column], i)) for i in range(self.height + 1)]))
        leaf = F.col("__leaf").try_cast("double") if self.numeric else F.col("__leaf")
        side = df.sparkSession.createDataFrame([(r[0], list(r)) for r in self.rows], "__leaf string, __labels array<string>").dropDuplicates(["__leaf"])
        side = side.select(leaf.alias("__leaf"), "__labels")
        joined = df.join(side, self._key(df[column]) == F.col("__leaf"), "left")
        made = F.when(level == 0, df[column].cast("string")).otherwise(F.coalesce(F.element_at("__labels", level + 1), F.lit(STAR)))
        return joined.withColumn(out, made).drop("__leaf", "__labels")

    def table(self, domain: DataFrame) -> DataFrame:
        """``(attribute, leaf, level, label)`` over a one-column ``domain`` of leaves (or over the rows' own leaves)."""
        if self.rows is not None:
            listed = dict.fromkeys((r[0], i, label) for r in {r[0]: r for r in reversed(self.rows)}.values() for i, label in enumerate(r))
            return domain.sparkSession.createDataFrame(list(listed), "leaf string, level int, label string").select(F.lit(self.attribute).alias("attribute"), "leaf", "level", "label")
        leaf = F.col(domain.columns[0])
        levels = F.array(*[F.struct(F.lit(i).alias("level"), self.label(leaf, i).alias("label")) for i in range(self.height + 1)])
        return domain.select(F.lit(self.attribute).alias("attribute"), leaf.cast("string").alias("leaf"), F.explode(levels).alias("x")).select("attribute", "leaf", "x.level", "x.label")

    def leaf_counts(self, domain: DataFrame) -> DataFrame:
        """``(attribute, level, label, n_leaves)``; labels recur across levels, so both make the key."""
        return self.table(domain).groupBy("attribute", "level", "label").agg(F.count_distinct("leaf").alias("n_leaves"))


def all_labels(spark: SparkSession, hierarchies: Sequence[Hierarchy], domains: Mapping[str, DataFrame]) -> DataFrame:
    """Labels of every hierarchy at every level, ``(attribute, label)``, each once."""
    out = None
    for h in hierarchies:
        part = h.table(domains[h.attribute]).select("attribute", "label")
        out = part if out is None else out.union(part)
    return out.distinct() if out is not None else spark.createDataFrame([], "attribute string, label string")


def attach_many(values: DataFrame, levels: Mapping[str, Sequence[int]], hierarchies: Mapping[str, Hierarchy], typed: Mapping[str, str], number: str, level: str, out: str) -> DataFrame:
    """``values`` with ``out``, the label at the row's ``level`` of the attribute whose position in ``levels`` stands in ``number`` and whose value in column ``typed[attribute]``.

    ``levels`` names the levels that rows may have. Large listed hierarchies share one join; all others are computed in place.
    """
    exprs, listed, keys = [], [], []
    for i, (name, wanted) in enumerate(levels.items()):
        h = hierarchies[name]
        if h.rows is not None and len(h.rows) > MAP_LIMIT and any(wanted):
            first = {r[0]: r for r in reversed(h.rows)}
            listed += [(i, x, str(float(leaf)) if h.numeric else leaf, r[x]) for leaf, r in first.items() for x in wanted if x]
            keys.append((i, F.col(typed[name]).try_cast("double").cast("string") if h.numeric else F.col(typed[name]).cast("string")))
            wanted = [x for x in wanted if not x]
        exprs += [F.when((F.col(number) == i) & (F.col(level) == x), h.label(F.col(typed[name]), x)) for x in wanted]
    computed = F.coalesce(*exprs, F.lit(None).cast("string"))
    if not listed:
        return values.withColumn(out, computed)
    side = values.sparkSession.createDataFrame(listed, "__i int, __x int, __leaf string, __label string")
    marked = values.withColumn("__key", F.coalesce(*[F.when(F.col(number) == i, k) for i, k in keys], F.lit(None).cast("string")))
    joined = marked.join(side, (marked[number] == side["__i"]) & (marked[level] == side["__x"]) & (marked["__key"] == side["__leaf"]), "left")
    large = F.col(number).isin([i for i, _ in keys]) & (F.col(level) > 0)
    return joined.withColumn(out, F.when(large, F.coalesce("__label", F.lit(STAR))).otherwise(computed)).drop("__key", "__i", "__x", "__leaf", "__label")


def generalize(df: DataFrame, levels: Mapping[str, int], hierarchies: Mapping[str, Hierarchy]) -> DataFrame:
    """``df`` with each attribute of ``levels`` replaced by its label at that level (full-domain generalization)."""
    for name, level in levels.items():
        df = hierarchies[name].attach(df, level, name)
    return df


def generalize_each(df: DataFrame, names: Sequence[str], hierarchies: Mapping[str, Hierarchy]) -> DataFrame:
    """``df`` with each attribute of ``names`` replaced by its label at the row's own level, the entry of :data:`LEVELS` at the attribute's position."""
    for i, name in enumerate(names):
        df = hierarchies[name].attach_at(df, F.col(LEVELS)[i], name)
    return df
