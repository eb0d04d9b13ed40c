"""Attribute declarations, typed projection, domain enrichment and table statistics."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from enum import Enum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from pyspark.sql import types as T

from privlens.functions.scalar import STAR, epoch_ms, ratio


class Role(str, Enum):
    QUASI = "QUASI_IDENTIFYING"
    SENSITIVE = "SENSITIVE"
    INSENSITIVE = "INSENSITIVE"
    IDENTIFYING = "IDENTIFYING"

    @classmethod
    def parse(cls, name: str) -> Role:
        """A role by either spelling: ``IDENTIFYING`` or ``IDENTIFYING_ATTRIBUTE``; ``IDENTIFIER`` too."""
        key = name.strip().upper().removesuffix("_ATTRIBUTE")
        key = {"IDENTIFIER": "IDENTIFYING", "QUASI_IDENTIFIER": "QUASI_IDENTIFYING"}.get(key, key)
        return cls(key)


class DataType(str, Enum):
    CATEGORICAL = "categorical"
    CONTINUOUS = "continuous"
    DATE = "date"


#: Date pattern where a date attribute declares none.
DATE_FORMAT = "dd.MM.yyyy"


@dataclass(frozen=True)
class AttributeSpec:
    """One declared column: type, role, level bounds and how it is aggregated in a class."""

    name: str
    data_type: DataType = DataType.CATEGORICAL
    role: Role = Role.QUASI
    include: bool = True
    date_format: str = DATE_FORMAT
    min_level: int | None = None
    max_level: int | None = None
    micro_aggregation: str | None = None
    perform_clustering: bool = False
    ignore_missing: bool = True
    minimum: float | None = None
    maximum: float | None = None
    possible_entries: tuple[str, ...] = field(default=())

    @classmethod
    def of(cls, name: str, data_type: str = "categorical", role: str = "QUASI_IDENTIFYING", **more) -> AttributeSpec:
        if data_type == "ordinal":
            raise ValueError(f"{name}: ordinal attributes are not supported")
        return cls(name, DataType(data_type), Role.parse(role), **more)


def quasi_identifiers(specs: Sequence[AttributeSpec], columns: Sequence[str]) -> list[str]:
    """Quasi-identifiers in table order; raises if there is none."""
    wanted = {s.name for s in specs if s.role is Role.QUASI}
    found = [c for c in columns if c in wanted]
    if not found:
        raise ValueError("no quasi-identifying attribute")
    return found


def attack_attributes(specs: Sequence[AttributeSpec], everything: bool = False) -> list[str]:
    """Included attributes that features are drawn from: quasi-identifiers, or all roles."""
    return [s.name for s in specs if s.include and (everything or s.role is Role.QUASI)]


def sensitive_attributes(specs: Sequence[AttributeSpec], explicit: Sequence[str] | None = None) -> list[str]:
    """The attributes a model names, else every sensitive column."""
    return list(explicit) if explicit else [s.name for s in specs if s.role is Role.SENSITIVE]


def typed_column(spec: AttributeSpec) -> Column:
    """A text column by its declared type; ``*`` and unreadable values become null."""
    raw = F.when(F.col(spec.name).cast("string") != STAR, F.col(spec.name).cast("string"))
    if spec.data_type is DataType.CONTINUOUS:
        return F.trim(raw).try_cast("double").alias(spec.name)
    if spec.data_type is DataType.DATE:
        return F.try_to_timestamp(raw, F.lit(spec.date_format)).alias(spec.name)
    return F.col(spec.name).cast("string").alias(spec.name)


def typed_projection(df: DataFrame, specs: Sequence[AttributeSpec], keys: Sequence[str] = ()) -> DataFrame:
    """``keys`` and the declared columns, typed. Undeclared columns are pruned."""
    missing = [s.name for s in specs if s.name not in df.columns]
    if missing:
        raise ValueError(f"columns not in the table: {missing}")
    return df.select(*keys, *[typed_column(s) for s in specs])


def check_same_types(a: DataFrame, b: DataFrame) -> None:
    """Raise if a column of both tables changed its type."""
    of = {f.name: f.dataType for f in a.schema.fields}
    changed = [f.name for f in b.schema.fields if f.name in of and of[f.name] != f.dataType]
    if changed:
        raise TypeError(f"columns changed their type: {changed}")


def empty_cells(df: DataFrame, specs: Sequence[AttributeSpec], key: str) -> DataFrame:
    """``(key, attribute)`` of blank or null cells in continuous columns; a load fails on any."""
    names = [s.name for s in specs if s.data_type is DataType.CONTINUOUS]
    if not names:
        return df.select(F.col(key), F.lit("").alias("attribute")).where("false")
    bad = [F.when(F.coalesce(F.trim(F.col(n).cast("string")), F.lit("")) == "", F.lit(n)) for n in names]
    return df.select(F.col(key), F.explode(F.array_compact(F.array(*bad))).alias("attribute"))


def check_no_empty_cells(df: DataFrame, specs: Sequence[AttributeSpec], key: str) -> None:
    found = empty_cells(df, specs, key).limit(1).collect()
    if found:
        raise ValueError(f"empty value in {found[0]['attribute']}, row {found[0][key]}")


def long_cells(df: DataFrame, attributes: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """``(by, attribute, value)``: one row per cell, values as text."""
    pairs = F.array(*[F.struct(F.lit(a).alias("attribute"), F.col(a).cast("string").alias("value")) for a in attributes])
    return df.select(*by, F.explode(pairs).alias("c")).select(*by, "c.attribute", "c.value")


def distinct_values(df: DataFrame, attributes: Sequence[str]) -> DataFrame:
    """``(attribute, value)``: the observed domain of each attribute, for configuration templates."""
    return long_cells(df, attributes).where("value is not null").distinct()


def enriched_domain(df: DataFrame, attributes: Sequence[str], hierarchy_labels: DataFrame) -> DataFrame:
    """Observed values and every hierarchy label, ``(attribute, value)``, each once."""
    return distinct_values(df, attributes).union(hierarchy_labels.select("attribute", F.col("label").alias("value"))).distinct()


def value_bounds(df: DataFrame, attributes: Sequence[str]) -> DataFrame:
    """``(attribute, min, max)`` of numeric and date columns (dates in milliseconds), in one pass."""
    kinds = dict(df.dtypes)
    num = lambda a: epoch_ms(F.col(a)).cast("double") if kinds[a].startswith(("timestamp", "date")) else F.col(a).cast("double")
    agg = df.agg(*[f(num(a)).alias(f"{n}{i}") for i, a in enumerate(attributes) for n, f in (("lo", F.min), ("hi", F.max))])
    rows = F.array(*[F.struct(F.lit(a).alias("attribute"), F.col(f"lo{i}").alias("min"), F.col(f"hi{i}").alias("max")) for i, a in enumerate(attributes)])
    return agg.select(F.explode(rows).alias("r")).select("r.*")


def enrich(specs: Sequence[AttributeSpec], df: DataFrame) -> list[AttributeSpec]:
    """Declarations with missing bounds filled from the data, in one job."""
    open_ = [s.name for s in specs if s.data_type is not DataType.CATEGORICAL and (s.minimum is None or s.maximum is None)]
    if not open_:
        return list(specs)
    found = {r["attribute"]: r for r in value_bounds(df, open_).collect()}
    return [
        replace(s, minimum=s.minimum if s.minimum is not None else found[s.name]["min"], maximum=s.maximum if s.maximum is not None else found[s.name]["max"]) if s.name in found else s
        for s in specs
    ]


#: Half the width of a bracket of the middle, as a share of the values bracketed, and the accuracy that finds it: its rank error is a tenth of that.
BRACKET, BRACKET_ACCURACY = 0.001, 10_000


def exact_medians(df: DataFrame, attributes: Sequence[str]) -> DataFrame:
    """``(attribute, median)`` of numeric columns over a whole table, without gathering a column in one task.

    The middle is bracketed twice by approximate quantiles, the second time among the values of the first bracket, so
    that some four in a million values are left. A last pass counts the values below the bracket and each value in it,
    and the middle ranks are read off those. The brackets are a row per attribute.
    """
    cells = F.array(*[F.struct(F.lit(a).alias("attribute"), F.col(a).cast("double").alias("v")) for a in attributes])
    long = df.select(F.explode(cells).alias("c")).select("c.*").where("v is not null")
    around = F.percentile_approx("v", [0.5 - BRACKET, 0.5 + BRACKET], BRACKET_ACCURACY)
    wide = {r["attribute"]: r for r in long.groupBy("attribute").agg(around.alias("ends"), F.count("*").alias("n")).collect()}
    if not wide:
        return long.select("attribute", F.col("v").alias("median")).where("false")
    v, names = F.col("v"), list(wide)
    own = lambda a, x: F.when(F.col("attribute") == a, x)
    inside = {a: own(a, F.when((v >= wide[a]["ends"][0]) & (v <= wide[a]["ends"][1]), v)) for a in names}
    counts = long.agg(*[F.count(own(a, F.when(v < wide[a]["ends"][0], v))).alias(f"b{i}") for i, a in enumerate(names)], *[F.count(inside[a]).alias(f"i{i}") for i, a in enumerate(names)]).first()
    # where the middle ranks lie among the values of the first bracket
    ranks = {a: [(wide[a]["n"] + 1) // 2 - counts[f"b{i}"], wide[a]["n"] // 2 + 1 - counts[f"b{i}"]] for i, a in enumerate(names)}
    near = lambda i, a: [min(1.0, max(0.0, rank / max(1, counts[f"i{i}"]) + x)) for rank, x in zip(ranks[a], (-BRACKET, BRACKET))]
    narrow = long.agg(*[F.percentile_approx(inside[a], near(i, a), BRACKET_ACCURACY).alias(f"e{i}") for i, a in enumerate(names)]).first()
    ends = [(a, float(narrow[f"e{i}"][0]), float(narrow[f"e{i}"][1]), wide[a]["n"]) for i, a in enumerate(names)]
    ends = df.sparkSession.createDataFrame(ends, "attribute string, lo double, hi double, n long")
    left = long.join(F.broadcast(ends), "attribute").where(F.col("v") <= F.col("hi"))
    counted = left.groupBy("attribute", "n", F.when(F.col("v") >= F.col("lo"), F.col("v")).alias("v")).agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy("attribute").orderBy(F.col("v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0))
    ranked = counted.withColumn("upto", upto)
    middle = lambda rank: F.min(F.when(F.col("upto") >= rank, F.col("v")))
    return ranked.groupBy("attribute").agg(((middle(F.floor((F.col("n") + 1) / 2)) + middle(F.floor(F.col("n") / 2) + 1)) / 2).alias("median"))


def summary_statistics(df: DataFrame, attributes: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """``(by, attribute, n, min, max, mean, median, variance)``, each column over its own non-null values, medians exact.

    Groups of ``by`` are samples, whose medians one aggregation finds; those of a whole table come from :func:`exact_medians`.
    """
    aggs = []
    for i, a in enumerate(attributes):
        v = F.col(a).cast("double")
        aggs += [F.count(v).alias(f"n{i}"), F.min(v).alias(f"lo{i}"), F.max(v).alias(f"hi{i}"), F.avg(v).alias(f"m{i}"), F.var_samp(v).alias(f"v{i}")]
        aggs += [F.median(v).alias(f"md{i}")] if by else []
    wide = df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)
    rows = F.array(*[
        F.struct(F.lit(a).alias("attribute"), F.col(f"n{i}").alias("n"), F.col(f"lo{i}").alias("min"), F.col(f"hi{i}").alias("max"), F.col(f"m{i}").alias("mean"), (F.col(f"md{i}") if by else F.lit(None).cast("double")).alias("median"), F.col(f"v{i}").alias("variance"))
        for i, a in enumerate(attributes)
    ])
    out = wide.select(*by, F.explode(rows).alias("r")).select(*by, "r.*")
    if by:
        return out
    return out.drop("median").join(exact_medians(df, attributes), "attribute", "left").select("attribute", "n", "min", "max", "mean", "median", "variance")


def frequency_distribution(df: DataFrame, attributes: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """``(by, attribute, value, n, frequency)`` over non-null cells.

    Totals come from the grouped counts, which are small, not from the rows.
    """
    counts = long_cells(df, attributes, by).where("value is not null").groupBy(*by, "attribute", "value").agg(F.count("*").alias("n"))
    totals = counts.groupBy(*by, "attribute").agg(F.sum("n").alias("total"))
    return counts.join(totals, [*by, "attribute"]).select(*by, "attribute", "value", "n", ratio(F.col("n"), F.col("total")).alias("frequency"))


def dictionary(domain: DataFrame) -> DataFrame:
    """``(attribute, value, code)``: codes are the 0-based rank of the value within its attribute."""
    rank = F.dense_rank().over(Window.partitionBy("attribute").orderBy("value")) - 1
    return domain.select("attribute", "value").distinct().withColumn("code", rank.cast("int"))


def encode(df: DataFrame, attribute: str, codes: DataFrame, out: str | None = None) -> DataFrame:
    """``df`` with the code of ``attribute`` in ``out``; values outside the dictionary give null."""
    out = out or f"{attribute}_code"
    lookup = codes.where(F.col("attribute") == attribute).select(F.col("value").alias("__v"), F.col("code").alias(out))
    return df.join(lookup, df[attribute].cast("string") == F.col("__v"), "left").drop("__v")


def is_numeric(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, (T.NumericType, T.TimestampType, T.TimestampNTZType, T.DateType))
