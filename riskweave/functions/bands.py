"""Banding rules as ``when`` chains."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskweave.schemas import (
    CREDIT_BANDS,
    FRAUD_CUTOFF,
    PSI_MONITOR,
    PSI_RETRAIN,
    REVIEW_CUTOFF,
)


def decision(score: Column) -> Column:
    """Decision on the unrounded 0-100 score; both cut-offs are inclusive."""
    return F.when(score >= FRAUD_CUTOFF, "FRAUD").when(score >= REVIEW_CUTOFF, "REVIEW").otherwise("CLEAR")


def credit_band(score: Column, gap_free: bool = False) -> Column:
    """Credit band. Integer ranges leave 25.5, 50.5 and 75.5 as UNKNOWN.

    ``gap_free`` closes the gaps by extending each range up to the next one.
    """
    out = None
    for i, (low, high, label) in enumerate(CREDIT_BANDS):
        if gap_free and i + 1 < len(CREDIT_BANDS):
            test = (score >= low) & (score < CREDIT_BANDS[i + 1][0])
        else:
            test = score.between(low, high)
        out = F.when(test, label) if out is None else out.when(test, label)
    return out.otherwise("UNKNOWN")


def velocity_score(count: Column) -> Column:
    return F.when(count > 5, 1.0).when(count > 2, 0.5).otherwise(0.0)


def psi_status(psi: Column) -> Column:
    """A missing PSI (empty window) falls through to RETRAIN."""
    return F.when(psi < PSI_MONITOR, "STABLE").when(psi < PSI_RETRAIN, "MONITOR").otherwise("RETRAIN")


def age_group(days: Column) -> Column:
    """Right-closed age bands; days outside (0, 99999] have no group."""
    return (
        F.when((days > 0) & (days <= 365), "new")
        .when((days > 365) & (days <= 1825), "established")
        .when((days > 1825) & (days <= 99999), "long_term")
    )


def direction(value: Column) -> Column:
    return F.when(value > 0, "increases_risk").otherwise("decreases_risk")
