"""Declarative contracts: metrics, their causal graph, constraints, levers and personas."""

from __future__ import annotations

from dataclasses import dataclass
from importlib.resources import files
from importlib.resources.abc import Traversable
from pathlib import Path
from typing import Any

import yaml
from pyspark.sql import DataFrame, SparkSession

DIMENSIONS = ("region", "product_line", "channel", "segment")
GRAINS_BELOW_WEEK = ("transaction", "hourly", "daily", "weekly")


@dataclass(frozen=True)
class Metric:
    """What a metric means: how it is aggregated, what deviation matters, how fresh its source must be."""

    name: str
    source: str
    unit: str
    aggregation: str
    grain: str
    refresh_minutes: float
    tolerance_hours: float
    impact_floor: float
    weight: str | None = None
    numerator: str | None = None
    denominator: str | None = None
    weekly: bool = True
    restricted: tuple[str, ...] = ()
    roles: tuple[str, ...] = ()
    fdr_q: float = 0.10

    def __post_init__(self) -> None:
        if self.aggregation not in ("sum", "mean", "weighted_mean", "ratio"):
            raise ValueError(f"{self.name}: unknown aggregation {self.aggregation}")
        if self.aggregation == "weighted_mean" and not self.weight:
            raise ValueError(f"{self.name}: a weighted mean needs a weight")

    @property
    def impact_scale(self) -> float:
        """Deviations of percentages count in points."""
        return 100.0 if self.unit == "pp" else 1.0

    def supports_weeks(self) -> tuple[bool, str]:
        """Whether weekly claims are allowed, and if not, why."""
        if self.weekly and self.grain in GRAINS_BELOW_WEEK:
            return True, ""
        return False, f"{self.name} is reported {self.grain}; it is excluded from weekly analysis, never interpolated"


@dataclass(frozen=True)
class Catalog:
    metrics: dict[str, Metric]
    edges: tuple[tuple[str, str], ...]

    def metric(self, name: str) -> Metric:
        if name not in self.metrics:
            raise KeyError(f"no contract defines the metric {name!r}")
        return self.metrics[name]

    def weekly(self) -> tuple[list[Metric], dict[str, str]]:
        """Metrics for weekly analysis, and the others with the reason for their exclusion."""
        usable, excluded = [], {}
        for m in self.metrics.values():
            ok, why = m.supports_weeks()
            if ok:
                usable.append(m)
            else:
                excluded[m.name] = why
        return usable, excluded

    def edge_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.edges), "src string, dst string")

    def metric_table(self, spark: SparkSession) -> DataFrame:
        rows = [(m.name, m.source, m.unit, m.aggregation, m.grain, float(m.refresh_minutes), float(m.tolerance_hours), float(m.impact_floor), m.impact_scale, m.supports_weeks()[0]) for m in self.metrics.values()]
        return spark.createDataFrame(rows, "metric string, source string, unit string, aggregation string, grain string, refresh_minutes double, tolerance_hours double, impact_floor double, impact_scale double, weekly boolean")


@dataclass(frozen=True)
class Constraint:
    id: str
    label: str
    blocked_value: float
    requires: tuple[str, ...] = ()


@dataclass(frozen=True)
class Lever:
    id: str
    label: str
    cost: float
    relieves: tuple[str, ...]
    authority: str
    family: str = "operational"


@dataclass(frozen=True)
class Persona:
    id: str
    authority: str
    regions: tuple[str, ...] = ()
    style: str = "operational"
    restricted: tuple[str, ...] = ()


@dataclass(frozen=True)
class Portfolio:
    constraints: tuple[Constraint, ...]
    levers: tuple[Lever, ...]
    budget: float
    personas: tuple[Persona, ...] = ()
    authorities: tuple[str, ...] = ("lead", "manager", "director", "vp")

    def rank_of(self, authority: str) -> int:
        """The authority's place from the least; unknown ones may do nothing that is not for them alone."""
        return self.authorities.index(authority) if authority in self.authorities else len(self.authorities)

    def bit(self, constraint: str) -> int:
        return 1 << [c.id for c in self.constraints].index(constraint)

    def mask(self, ids: tuple[str, ...]) -> int:
        return sum(self.bit(c) for c in set(ids))

    def lever_table(self, spark: SparkSession) -> DataFrame:
        rows = [(k, v.id, v.label, v.cost, self.mask(v.relieves), v.authority, self.rank_of(v.authority), v.family) for k, v in enumerate(self.levers)]
        return spark.createDataFrame(rows, "position int, lever string, label string, cost double, relieves int, authority string, authority_rank int, family string")

    def constraint_table(self, spark: SparkSession) -> DataFrame:
        rows = [(c.id, self.bit(c.id), c.blocked_value, self.mask(c.requires)) for c in self.constraints]
        return spark.createDataFrame(rows, "constraint string, bit int, blocked_value double, requires int")


def _text(path: str | Path | Traversable) -> str:
    return (Path(path) if isinstance(path, str) else path).read_text()


def _known(kind: type, given: dict[str, Any], where: str) -> dict[str, Any]:
    extra = set(given) - set(kind.__dataclass_fields__)
    if extra:
        raise ValueError(f"{where}: unknown fields {sorted(extra)}")
    plain = {list: tuple, int: float}
    return {k: plain.get(type(v), lambda x: x)(v) for k, v in given.items()}


FLOOR = "impact_floor"


def _with_unit(fields: dict[str, Any], where: str) -> dict[str, Any]:
    """The fields of a metric whose floor may name its unit in the key, as in impact_floor_pp: one floor, and no other
    unit beside it."""
    floors = [k for k in fields if k == FLOOR or k.startswith(f"{FLOOR}_")]
    if len(floors) > 1:
        raise ValueError(f"{where}: several floors {sorted(floors)}")
    if not floors or floors[0] == FLOOR:
        return fields
    unit = floors[0].removeprefix(f"{FLOOR}_")
    if fields.get("unit", unit) != unit:
        raise ValueError(f"{where}: the floor is in {unit}, the metric in {fields['unit']}")
    return {k: v for k, v in fields.items() if k != floors[0]} | {FLOOR: fields[floors[0]], "unit": unit}


def load_catalog(path: str | Path | Traversable) -> Catalog:
    """A catalog from YAML: `metrics` (name -> fields of Metric, the floor's key with or without its unit) and `edges`
    (pairs)."""
    spec = yaml.safe_load(_text(path))
    metrics = {n: Metric(name=n, **_known(Metric, _with_unit(f, n), n)) for n, f in spec["metrics"].items()}
    return Catalog(metrics, tuple((a, b) for a, b in spec.get("edges", [])))


def load_portfolio(path: str | Path | Traversable) -> Portfolio:
    """A portfolio from YAML: lists `constraints`, `levers`, `personas`, the number `budget` and, if others than the
    usual ones, `authorities` from the least to the highest."""
    spec = yaml.safe_load(_text(path))
    of = lambda kind, key: tuple(kind(**_known(kind, x, key)) for x in spec.get(key, []))
    p = Portfolio(of(Constraint, "constraints"), of(Lever, "levers"), float(spec["budget"]), of(Persona, "personas"), tuple(spec.get("authorities", Portfolio.authorities)))
    ids = {c.id for c in p.constraints}
    for x in [c for v in p.levers for c in v.relieves] + [c for v in p.constraints for c in v.requires]:
        if x not in ids:
            raise ValueError(f"no constraint {x!r}")
    return p


#: The contracts of the example, for queries and as defaults.
METRICS = load_catalog(files(__package__) / "example_metrics.yaml")
PORTFOLIO = load_portfolio(files(__package__) / "example_portfolio.yaml")
