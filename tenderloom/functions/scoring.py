"""Row-level scores, labels and scaling."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tenderloom import fixed


def clip(x: Column, low, high) -> Column:
    return F.least(F.greatest(x, _col(low)), _col(high))


def z_score(x: Column, mean, scale) -> Column:
    return (x - _col(mean)) / _col(scale)


def _col(v) -> Column:
    return v if isinstance(v, Column) else F.lit(float(v))


def compatibility(jaccard: Column, similarity: Column) -> Column:
    return F.round(F.lit(0.5) * clip(jaccard, 0, 1) + F.lit(0.5) * clip(similarity, 0, 1), 4)


def reason(jaccard: Column, similarity: Column, affinity: Column) -> Column:
    code, text = jaccard > 0, similarity >= fixed.LEVEL_MEDIUM
    return (
        F.when(code & text, fixed.REASON_BOTH)
        .when(code, fixed.REASON_CODE)
        .when(text, fixed.REASON_TEXT)
        .when(affinity > 0, fixed.REASON_BUYER)
        .otherwise(fixed.REASON_WEAK)
    )


def verdict(opportunities: Column, mean_compat: Column) -> Column:
    """Level of a whole query.

    The mean runs over rows that already reach the medium threshold, so the
    low branch is kept only to mirror the published scale.
    """
    return (
        F.when(opportunities == 0, fixed.VERDICT_NONE)
        .when(mean_compat >= fixed.LEVEL_HIGH, fixed.VERDICT_HIGH)
        .when(mean_compat >= fixed.LEVEL_MEDIUM, fixed.VERDICT_MEDIUM)
        .otherwise(fixed.VERDICT_LOW)
    )


def tender_level(compat: Column) -> Column:
    """Level of one tender; the lowest step has its own name here."""
    return (
        F.when(compat >= fixed.LEVEL_HIGH, "alta")
        .when(compat >= fixed.LEVEL_MEDIUM, "media")
        .when(compat >= fixed.LEVEL_LOW, "baja")
        .otherwise("mínima")
    )


def group_role(rank: Column, mean_km: Column) -> Column:
    return (
        F.when(rank == 1, "Nicho definido")
        .when(mean_km < fixed.NEAR_KM, "Cercanía geográfica")
        .otherwise("Mercado general")
    )
