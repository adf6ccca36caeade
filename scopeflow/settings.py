"""Parameters of scoring, cost and graph building. Fixed values that results must share are marked so."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Weights:
    """Of the factors of risk; they sum to 1. The defaults."""

    sensitivity: float = 0.40
    reach: float = 0.30
    betweenness: float = 0.20
    source: float = 0.10

    def __post_init__(self) -> None:
        if abs(self.sensitivity + self.reach + self.betweenness + self.source - 1) > 1e-6:
            raise ValueError("risk weights must sum to 1")


@dataclass(frozen=True)
class Cost:
    """The defaults."""

    days_per_cde: float = 0.5
    days_per_connected: float = 0.15
    day_rate: float = 2500.0
    roc_threshold: int = 1000


@dataclass(frozen=True)
class Settings:
    weights: Weights = field(default_factory=Weights)
    cost: Cost = field(default_factory=Cost)
    #: Edges run from provider to consumer; False turns them round.
    data_flow_edges: bool = True
    #: Betweenness is summed over all starts; if this is set, beyond so many systems only over ``pivots`` of them.
    exact_up_to: int | None = None
    pivots: int = 400

    @classmethod
    def of(cls, spark: SparkSession) -> Settings:
        """Overrides in spark.scopeflow.*: a value that is no number leaves the default."""

        def number(key: str, default: float) -> float:
            try:
                return float(spark.conf.get(f"spark.scopeflow.{key}", str(default)))
            except ValueError:
                return default

        w, c = Weights(), Cost()
        return cls(
            Weights(*(number(f"weight.{k}", getattr(w, k)) for k in ("sensitivity", "reach", "betweenness", "source"))),
            Cost(number("cost.days_per_cde", c.days_per_cde), number("cost.days_per_connected", c.days_per_connected), number("cost.day_rate", c.day_rate), int(number("cost.roc_threshold", c.roc_threshold))),
            spark.conf.get("spark.scopeflow.data_flow_edges", "true").strip().lower() not in ("false", "no", "0"),
            int(number("exact_up_to", 0)) or None,
            int(number("pivots", cls.pivots)),
        )


# Tiers of sensitivity.
TIER_CRITICAL, TIER_HIGH, TIER_OBSERVED, TIER_NONE = 4, 3, 2, 0
# Weightings under which the ranking is repeated (sensitivity, reach, betweenness, source).
WEIGHTINGS = {
    "Base (0.40/0.30/0.20/0.10)": (0.40, 0.30, 0.20, 0.10),
    "Equal": (0.25, 0.25, 0.25, 0.25),
    "Sensitivity-heavy": (0.55, 0.20, 0.15, 0.10),
    "Reach-heavy": (0.20, 0.55, 0.15, 0.10),
    "Betweenness-heavy": (0.20, 0.20, 0.50, 0.10),
    "Source-heavy": (0.25, 0.25, 0.20, 0.30),
}
