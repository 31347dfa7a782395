"""Interaction scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from nearhome.schemas import DECLARED_WEIGHTS, INTERACTION_WEIGHTS, RATED_TYPE


def interaction_weight(
    kind: Column, weights: dict[str, float] | None = None, default: float = 0.0, rated: Column | None = None,
) -> Column:
    """Score of an interaction by its type; the comparison ignores case.

    By default both names in use for each type are known. A rating counts with its own score where ``rated`` gives it.
    """
    weight = F.lit(default)
    for name, value in ({**INTERACTION_WEIGHTS, **DECLARED_WEIGHTS} if weights is None else weights).items():
        weight = F.when(F.upper(kind) == name.upper(), F.lit(float(value))).otherwise(weight)
    return weight if rated is None else F.when(F.upper(kind) == RATED_TYPE, rated.cast("double")).otherwise(weight)
