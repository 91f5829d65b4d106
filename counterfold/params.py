"""Closed, validated parameters: an unknown key is an error, not a silent default."""

from __future__ import annotations

import dataclasses as dc
from collections.abc import Mapping

from counterfold.errors import refuse_if

ESTIMATORS = ("snipw", "ipw", "dm", "dr", "mrdr", "exact")
NEEDS_PROPENSITY = {"snipw", "ipw", "dr", "mrdr"}
NEEDS_REWARD_MODEL = {"dm", "dr", "mrdr"}
EPSILON = 1e-12


@dc.dataclass(frozen=True)
class SplitParams:
    strategy: str = "temporal"
    train_ratio: float = 0.8
    val_ratio: float = 0.1
    test_ratio: float = 0.1
    timestamp_column: str = "timestamp"

    def __post_init__(self) -> None:
        ratios = (self.train_ratio, self.val_ratio, self.test_ratio)
        refuse_if(self.strategy not in ("temporal", "random"), "unknown_split", self.strategy)
        refuse_if(min(ratios) <= 0, "bad_ratio", "every ratio must be above zero", ratios=ratios)
        refuse_if(abs(sum(ratios) - 1) > 1e-6, "bad_ratio", "ratios must sum to one", ratios=ratios)


@dc.dataclass(frozen=True)
class GraphParams:
    embedding_dim: int = 64
    num_layers: int = 3
    val_fraction: float = 0.1

    def __post_init__(self) -> None:
        refuse_if(not 0 < self.val_fraction < 1, "bad_fraction", "val_fraction must be in (0, 1)")
        refuse_if(min(self.embedding_dim, self.num_layers) < 1, "bad_size", "sizes must be positive")


@dc.dataclass(frozen=True)
class CausalParams:
    treatment: str | None = None
    outcome: str | None = None
    n_trees: int = 100
    max_depth: int = 10
    reference_arm: int = 0
    target_arm: int = 1

    def __post_init__(self) -> None:
        refuse_if(
            self.treatment is not None and self.treatment == self.outcome,
            "treatment_is_outcome", "treatment and outcome name the same column",
        )

    @property
    def enabled(self) -> bool:
        return self.treatment is not None


@dc.dataclass(frozen=True)
class PolicyParams:
    linucb_alpha: float = 1.0
    linucb_ridge: float = 1.0
    expectile: float = 0.7
    beta: float = 3.0
    max_advantage_weight: float = 100.0
    flexibility: float = 0.3
    cate_reward_weight: float = 0.0

    def __post_init__(self) -> None:
        refuse_if(not 0 < self.expectile < 1, "bad_expectile", "expectile must be in (0, 1)")
        refuse_if(self.cate_reward_weight < 0, "bad_weight", "the CATE weight must not be negative")


@dc.dataclass(frozen=True)
class EvaluationParams:
    estimators: tuple[str, ...] = ("snipw", "dr", "mrdr")
    n_bootstrap: int = 100
    confidence_level: float = 0.95
    folds: int = 5
    behaviour_policy: str = "logged"
    shrinkage: float = 10.0
    independent_unit: str = "auto"

    def __post_init__(self) -> None:
        refuse_if(not self.estimators, "no_estimators", "at least one estimator is needed")
        unknown = sorted(set(self.estimators) - set(ESTIMATORS))
        refuse_if(bool(unknown), "unknown_estimator", "not an estimator", unknown=unknown)
        refuse_if(self.n_bootstrap < 2, "bad_bootstrap", "at least two replicates are needed")
        refuse_if(not 0 < self.confidence_level < 1, "bad_level", "level must be in (0, 1)")
        refuse_if(self.folds < 2, "too_few_folds", "one fold would score its own training rows")
        refuse_if(
            self.behaviour_policy not in ("logged", "estimated"), "unknown_behaviour_policy",
            self.behaviour_policy,
        )
        refuse_if(self.shrinkage < 0, "bad_shrinkage", "shrinkage must not be negative")
        refuse_if(
            self.independent_unit not in ("auto", "context", "round"), "unknown_unit",
            self.independent_unit,
        )


@dc.dataclass(frozen=True)
class DatasetParams:
    user_column: str = "user_id"
    item_column: str = "item_id"
    reward_column: str = "reward"
    propensity_column: str | None = None
    categorical_columns: tuple[str, ...] = ()
    feature_columns: tuple[str, ...] = ()
    feature_patterns: tuple[str, ...] = ()
    num_actions: int | None = None
    subsample_rows: int | None = None
    eval_subsample_rows: int | None = None
    reward_definition: str | None = None

    def __post_init__(self) -> None:
        for name in ("subsample_rows", "eval_subsample_rows"):
            value = getattr(self, name)
            refuse_if(value is not None and value < 1, "bad_sample", f"{name} must be at least 1")


@dc.dataclass(frozen=True)
class Params:
    split: SplitParams = SplitParams()
    graph: GraphParams = GraphParams()
    causal: CausalParams = CausalParams()
    policy: PolicyParams = PolicyParams()
    evaluation: EvaluationParams = EvaluationParams()
    dataset: DatasetParams = DatasetParams()
    seed: int = 42

    def __post_init__(self) -> None:
        refuse_if(
            self.policy.cate_reward_weight > 0 and not self.causal.enabled,
            "shaping_without_effects", "reward shaping needs a declared treatment",
        )


def params_from_dict(values: Mapping) -> Params:
    """Build :class:`Params` from nested mappings, refusing unknown keys."""
    sections = {f.name: f for f in dc.fields(Params)}
    unknown = sorted(set(values) - set(sections))
    refuse_if(bool(unknown), "unknown_parameter", "no such section", keys=unknown)
    built: dict = {}
    for name, value in values.items():
        if name == "seed":
            built[name] = int(value)
            continue
        cls = type(getattr(Params(), name))
        known = {f.name for f in dc.fields(cls)}
        extra = sorted(set(value) - known)
        refuse_if(bool(extra), "unknown_parameter", f"not in section {name}", keys=extra)
        built[name] = cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in value.items()})
    return Params(**built)
