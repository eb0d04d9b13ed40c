"""Configuration files: YAML to dataclasses and back, with aliases and early validation.

Unknown keys are ignored and an empty file is an empty configuration. Paths in a file are taken as they
are; :func:`missing_paths` lists all that do not exist, so that a series fails before it starts.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass, field, fields
from pathlib import Path

import yaml

from privlens.operators.hierarchy import Hierarchy
from privlens.operators.privacy import REGIONS, Model
from privlens.operators.schema import AttributeSpec, Role


def _load(path: str | Path) -> dict:
    text = Path(path).read_text(encoding="utf-8")
    return yaml.safe_load(text) or {}


#: Other spellings of keys that configuration files may use, by the field they fill.
ALIASES = {
    "attributeType": ("type",),
    "hierarchy": ("pathToHierarchy",),
    "minGeneralization": ("minLevelToUse",),
    "maxGeneralization": ("maxLevelToUse",),
    "algorithm": ("anonymizationAlgorithm",),
    "targetFile": ("targetImportFile",),
    "sampleSize": ("sizeSampleTraining",),
    "sampleSizeTest": ("sizeSampleTest",),
    "cohortSize": ("sizeCohort",),
    "cohortFraction": ("sizeCohortFraction",),
    "backgroundSize": ("sizeBackground",),
    "backgroundFraction": ("sizeBackgroundFraction",),
    "attributesForAttackType": ("attributesForAttack",),
    "features": ("featureAttributes",),
    "target": ("targetAttribute",),
}


def _known(cls, raw: Mapping) -> dict:
    """The entries of ``raw`` that ``cls`` has fields for, by either spelling; empty values keep the default."""
    raw = {k: v for k, v in raw.items() if v is not None}
    names = {f.name for f in fields(cls)}
    found = {n: raw[a] for n in names for a in ALIASES.get(n, ()) if a in raw}
    return found | {k: v for k, v in raw.items() if k in names}


@dataclass
class MicroAggregation:
    function: str = "ARITHMETIC_MEAN"
    performClustering: bool = False
    ignoreMissingData: bool = True


@dataclass
class AttributeConfig:
    name: str
    dataType: str = "categorical"
    attributeType: str = "QUASI_IDENTIFYING_ATTRIBUTE"
    hierarchy: str | None = None
    levels: object = None
    dateFormat: str | None = None
    include: bool = True
    minGeneralization: int | None = None
    maxGeneralization: int | None = None
    microAggregation: MicroAggregation | None = None
    min: float | None = None
    max: float | None = None
    possibleEntries: list[str] = field(default_factory=list)

    @classmethod
    def parse(cls, raw: Mapping) -> AttributeConfig:
        raw = dict(raw)
        micro = raw.get("microAggregation")
        if micro is None and raw.get("useMicroAggregation"):
            raw["microAggregation"] = MicroAggregation(str(raw.get("microAggregationFunction", "ARITHMETIC_MEAN")), bool(raw.get("performClustering", True)), bool(raw.get("ignoreMissingData", True)))
        elif isinstance(micro, str):
            raw["microAggregation"] = MicroAggregation(micro, bool(raw.get("performClustering", False)), bool(raw.get("ignoreMissingData", True)))
        elif isinstance(micro, Mapping):
            raw["microAggregation"] = MicroAggregation(**_known(MicroAggregation, micro))
        return cls(**_known(cls, raw))

    def spec(self) -> AttributeSpec:
        more = {"date_format": self.dateFormat} if self.dateFormat else {}
        micro = self.microAggregation
        if micro:
            more |= {"micro_aggregation": micro.function, "perform_clustering": micro.performClustering, "ignore_missing": micro.ignoreMissingData}
        return AttributeSpec.of(self.name, self.dataType, self.attributeType, include=self.include, min_level=self.minGeneralization, max_level=self.maxGeneralization, minimum=self._number(self.min), maximum=self._number(self.max), possible_entries=tuple(map(str, self.possibleEntries)), **more)

    @staticmethod
    def _number(value) -> float | None:
        return None if value is None else float(value)

    def read_hierarchy(self) -> Hierarchy | None:
        numeric = self.dataType == "continuous"
        if self.levels is not None:
            return Hierarchy.nested(self.name, self.levels)
        if self.hierarchy:
            return Hierarchy(self.name, read_hierarchy_rows(self.hierarchy), numeric=numeric)
        return None


@dataclass
class DataConfig:
    path: str
    attributes: list[AttributeConfig] = field(default_factory=list)
    name: str = ""

    @property
    def specs(self) -> list[AttributeSpec]:
        return [a.spec() for a in self.attributes]

    def hierarchies(self) -> dict[str, Hierarchy]:
        """The hierarchy of each attribute that has one, and of each other quasi-identifier the one that leaves its values alone."""
        found = {a.name: a.read_hierarchy() for a in self.attributes}
        quasi = {s.name for s in self.specs if s.role is Role.QUASI}
        return {n: h if h is not None else Hierarchy.identity(n) for n, h in found.items() if h is not None or n in quasi}


@dataclass
class QualityModel:
    qualityModelType: str = "LOSS_METRIC"
    gsFactor: float = 0.5
    aggregateFunction: str = "GEOMETRIC_MEAN"


@dataclass
class AnonymizationConfig:
    name: str = ""
    algorithm: str = "OPTIMAL"
    heuristicSearchStepLimit: int | None = None
    heuristicSearchTimeLimit: int | None = None
    suppressionLimit: float = 1.0
    localGeneralization: bool = False
    localGeneralizationIterations: int = 0
    differentialPrivacySearchBudget: float = 0.1
    privacyModels: list[dict] = field(default_factory=list)
    qualityModel: QualityModel | None = None

    def models(self, hierarchies: Mapping[str, Hierarchy] | None = None) -> list[Model]:
        """Configured models; the parameter may be named ``k``, ``l``, ``t``, ``d``, ``b``, ``averageRisk`` or ``riskThreshold``."""
        out = []
        for raw in self.privacyModels:
            value = next((raw[p] for p in ("k", "l", "t", "d", "b", "averageRisk", "riskThreshold", "epsilon") if p in raw), None)
            if value is None:
                raise ValueError(f"{raw.get('type')}: no parameter")
            names = tuple(raw.get("attributes") or ())
            region = str(raw.get("region") or "").upper().replace(" ", "_")
            if region and region != "NONE" and region not in REGIONS and "population" not in raw:
                raise ValueError(f"{raw['type']}: region {region} is not known; give a population")
            population = float(raw.get("population", REGIONS.get(region, 0.0)))
            estimator = str(raw.get("populationUniquenessModel") or raw.get("model") or "PITMAN")
            out.append(Model(raw["type"], float(value), names, float(raw.get("delta", 0.0)), population, estimator, trees=dict(hierarchies or {})))
        return out


@dataclass
class RiskAssessmentConfig:
    name: str = ""
    targetType: str = "OUTLIER"
    targetCount: int = 10
    targetFile: str | None = None
    useCheckpointData: bool = False
    pathToCheckpointData: str | None = None
    runCount: int = 1
    runTrainingCount: int = 1
    runTestCount: int = 1
    cohortSize: float = 0
    cohortFraction: float = 0.0
    backgroundSize: float = 0
    backgroundFraction: float = 0.0
    sampleSize: int = 0
    sampleSizeTest: int = 0
    overlap: float = 0.0
    featureTypes: list[str] = field(default_factory=lambda: ["HISTOGRAM"])
    classifierType: str = "RF"
    attributesForAttackType: str = "QI"
    pathToStatisticsConfig: str | None = None
    threadCount: int = 32
    seed: int = 0


@dataclass
class StatisticsConfig:
    features: list[str] = field(default_factory=list)
    target: str = ""


@dataclass
class SeriesConfig:
    groups: list[dict] = field(default_factory=list)

    def length(self) -> int:
        return sum(len(g["anonymization"]) * len(g["risk"]) * len(g["data"]) for g in self.groups)


def read_hierarchy_rows(path: str | Path) -> list[tuple[str, ...]]:
    """Rows of a ``;`` hierarchy file without header: short rows repeat their last label, ``\\r`` and blank lines are dropped, a last line may lack its end."""
    lines = [line.rstrip("\r").split(";") for line in Path(path).read_text(encoding="utf-8").split("\n") if line.strip("\r\n ")]
    width = max(map(len, lines), default=0)
    seen: dict[str, tuple[str, ...]] = {}
    for row in lines:
        seen.setdefault(row[0], tuple(row + [row[-1]] * (width - len(row))))
    return list(seen.values())


def read_data_config(path: str | Path) -> DataConfig:
    raw = _load(path)
    attributes = raw.get("attributes") or raw.get("attributeConfigs") or []
    return DataConfig(str(raw.get("path") or raw.get("dataCsvFile") or ""), [AttributeConfig.parse(a) for a in attributes], str(raw.get("name") or raw.get("dataSetName") or Path(path).stem))


def read_anonymization_config(path: str | Path) -> AnonymizationConfig:
    raw = _load(path)
    known = _known(AnonymizationConfig, raw)
    if isinstance(known.get("qualityModel"), Mapping):
        known["qualityModel"] = QualityModel(**_known(QualityModel, known["qualityModel"]))
    known["privacyModels"] = list(raw.get("privacyModels") or raw.get("privacyModelList") or [])
    return AnonymizationConfig(**{"name": Path(path).stem} | known)


def read_risk_config(path: str | Path) -> RiskAssessmentConfig:
    return RiskAssessmentConfig(**{"name": Path(path).stem} | _known(RiskAssessmentConfig, _load(path)))


def read_statistics_config(path: str | Path) -> StatisticsConfig:
    raw = _load(path)
    return StatisticsConfig(**_known(StatisticsConfig, raw))


def read_series_config(path: str | Path) -> SeriesConfig:
    raw = _load(path)
    groups = raw.get("combinationConfig") or raw.get("series") or ([raw] if raw else [])

    def listed(g: Mapping, *names: str) -> list[str]:
        for n in names:
            if n in g:
                return [g[n]] if isinstance(g[n], str) else list(g[n] or [])
        return []

    return SeriesConfig([{
        "risk": listed(g, "risk", "pathsToRiskAssessmentConfig"),
        "data": listed(g, "data", "pathsToDataConfig"),
        "anonymization": listed(g, "anonymization", "pathsToAnonymizationConfig"),
    } for g in groups])


def missing_paths(series: SeriesConfig) -> list[str]:
    return sorted({p for g in series.groups for kind in ("risk", "data", "anonymization") for p in g[kind] if not os.path.exists(p)})


def config_text(*configs) -> str:
    """Configurations as one YAML text; a single one stands alone, several under the names of their kinds."""
    made = asdict(configs[0]) if len(configs) == 1 else {type(c).__name__: asdict(c) for c in configs}
    return yaml.safe_dump(made, sort_keys=False, allow_unicode=True)


def write_config(config, path: str | Path) -> None:
    """To the driver's own file system; :func:`privlens.sources.shared.write_text` writes beside tables."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(config_text(config), encoding="utf-8")


def template(path: str, domain: Mapping[str, Sequence[str]]) -> dict:
    """A data configuration to fill in: every column categorical, its distinct values under one ``*`` root, levels 0 to the top."""
    return {"path": path, "attributes": [{"name": n, "dataType": "categorical", "attributeType": "QUASI_IDENTIFYING_ATTRIBUTE", "minGeneralization": 0, "maxGeneralization": -1, "levels": {"*": sorted(map(str, v))}} for n, v in domain.items()]}


def fingerprint(*configs) -> str:
    """SHA-256 of the configurations as canonical JSON; checkpoints of other settings never match."""
    text = json.dumps([asdict(c) if hasattr(c, "__dataclass_fields__") else c for c in configs], sort_keys=True, default=str)
    return hashlib.sha256(text.encode()).hexdigest()
