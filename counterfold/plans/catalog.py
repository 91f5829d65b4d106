"""All registered queries."""

from __future__ import annotations

from counterfold.plans.registry import REGISTRY, Query


def all_queries() -> dict[str, Query]:
    from counterfold.plans import queries_data, queries_evaluation, queries_structures  # noqa: F401

    return dict(REGISTRY)
