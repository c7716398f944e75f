"""Score, tier and label expressions."""

from pyspark.sql import Column, functions as F

from trustdesk.functions.text import col
from trustdesk.schemas import CONFIDENCE_TIERS


def score_to_int(c) -> Column:
    """0..1 scores become 0..100; anything larger is taken as already on that scale."""
    c = col(c)
    return F.round(F.when(c <= 1, c * 100).otherwise(c)).cast("int")


def trust_label(c) -> Column:
    """Short label of an integer score."""
    c = col(c)
    return F.when(c >= 70, "HIGH").when(c >= 40, "MED").when(c.isNotNull(), "LOW").otherwise("—")


def trust_tier(c) -> Column:
    """Tier of a raw 0..1 score."""
    c = col(c)
    return F.when(c >= 0.7, "high").when(c >= 0.4, "med").when(c.isNotNull(), "low").otherwise("insuff")


def int_tier(c) -> Column:
    """Tier of a 0..100 integer score."""
    c = col(c)
    return F.when(c >= 70, "high").when(c >= 40, "med").when(c.isNotNull(), "low").otherwise("insuff")


def quality_tier(c) -> Column:
    c = col(c)
    return (F.when(c >= 85, "high_quality").when(c >= 65, "needs_review")
            .when(c >= 40, "low_quality").otherwise("critical_issue"))


def confidence_rank(c) -> Column:
    """0 for the best tier upwards; NULL for an unknown one."""
    rank = F.lit(None).cast("int")
    for n, tier in enumerate(CONFIDENCE_TIERS):
        rank = F.when(col(c) == tier, n).otherwise(rank)
    return rank


def share(part, whole) -> Column:
    """Whole-number percentage, safe for an empty whole."""
    return F.round(part * 100 / F.greatest(whole, F.lit(1))).cast("int")
