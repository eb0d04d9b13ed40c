"""Anonymization methods: what turns every sample of a table into its release.

A method is any object with ``names`` and ``release_each``; an assessment takes one as it is, so a method of
one's own needs no change anywhere else.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Protocol, runtime_checkable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from privlens.functions.scalar import STAR
from privlens.operators import recode
from privlens.operators.classes import SUPPRESSED
from privlens.operators.hierarchy import LEVELS, Hierarchy
from privlens.operators.privacy import Model
from privlens.operators.search import Search


@runtime_checkable
class Method(Protocol):
    """Releases samples. ``names`` are the attributes that make a class; ``hierarchies`` has theirs."""

    names: Sequence[str]
    hierarchies: Mapping[str, Hierarchy]

    def release_each(self, df: DataFrame, by: Sequence[str], population: DataFrame | None = None) -> DataFrame:
        """``df``, the samples' rows by ``by``, with ``is_suppressed`` and released cells; rows may carry level vectors in ``LEVELS``.

        ``population`` is the table that samples are drawn from: hierarchies of rules have its values as their domain.
        """


@dataclass(frozen=True)
class FixedLevels:
    """One level vector for every sample."""

    levels: Mapping[str, int]
    hierarchies: Mapping[str, Hierarchy]
    models: Sequence[Model] = ()
    sensitive: Sequence[str] = ()
    identifying: Sequence[str] = ()
    key: str | None = None

    @property
    def names(self) -> list[str]:
        return list(self.levels)

    def release_each(self, df: DataFrame, by: Sequence[str], population: DataFrame | None = None) -> DataFrame:
        return recode.release(df, self.levels, self.hierarchies, self.models, self.sensitive, by, self.identifying, self.key)


@dataclass(frozen=True)
class Anonymizer:
    """A search for every sample, its release at the levels found, and what a configuration puts after that.

    With ``rounds`` of local recoding the rows that a round suppresses are searched and released anew. Attributes of
    ``micro`` are replaced by their class's aggregate of the values they had; those of ``names`` among them also
    cluster, by their labels, and the others are no part of the class. Suppressed rows have ``*`` there.
    """

    search: Search
    models: Sequence[Model]
    key: str
    sensitive: Sequence[str] = ()
    identifying: Sequence[str] = ()
    rounds: int = 0
    micro: Mapping[str, str] = field(default_factory=dict)
    ignore_missing: Mapping[str, bool] = field(default_factory=dict)

    @property
    def names(self) -> list[str]:
        return self.search.names

    @property
    def hierarchies(self) -> Mapping[str, Hierarchy]:
        return self.search.hierarchies

    def release_each(self, df: DataFrame, by: Sequence[str], population: DataFrame | None = None) -> DataFrame:
        by, raw = list(by), {c: f"__raw_{i}" for i, c in enumerate(self.micro)}
        df = df.withColumns({r: F.col(c) for c, r in raw.items()})
        population = df if population is None else population

        def find(rest: DataFrame) -> DataFrame:
            return self.search.run_each(rest, by, population)

        if self.rounds > 1:
            out = recode.local_recoding_each(df, self.key, by, find, self.names, self.hierarchies, self.models, self.rounds, self.sensitive, self.identifying)
        else:
            out = recode.release_each(df, find(df), self.names, self.hierarchies, self.models, by, self.sensitive, self.identifying, self.key)
        if not self.micro:
            return out
        made = recode.micro_aggregate(out, [*self.names, SUPPRESSED], {r: self.micro[c] for c, r in raw.items()}, {r: self.ignore_missing.get(c, True) for c, r in raw.items()}, by)
        cell = lambda c: F.when(F.col(SUPPRESSED), F.lit(STAR)).otherwise(F.col(raw[c]).cast("string")).alias(c)
        return made.select(*[cell(c) if c in raw else F.col(c) for c in out.columns if c not in raw.values()])

    def release(self, df: DataFrame) -> DataFrame:
        """The release of ``df`` as one sample."""
        return self.release_each(df.withColumn("__one", F.lit(0)), ["__one"], df).drop("__one")


def levels_of(released: DataFrame, names: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """``(by, levels, rows)``: the level vectors of a release's live rows, more than one a sample after local recoding."""
    vectors = released.where(~F.col(SUPPRESSED)).groupBy(*by, LEVELS).agg(F.count("*").alias("rows"))
    return vectors.select(*by, F.col(LEVELS).alias("levels"), "rows")
