"""Severity and naming expressions; all stay inside whole-stage codegen."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from netloom.schema import BASE_SEVERITY, PROTOCOL_NAMES, SEVERITY_RANK

_BY_RANK = sorted(SEVERITY_RANK, key=SEVERITY_RANK.get)


def _lookup(table: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for x in chain.from_iterable(table.items()))), key)


def severity_rank(severity: Column) -> Column:
    """0 (NONE) to 4 (CRITICAL); unknown text is 0."""
    return F.coalesce(_lookup(SEVERITY_RANK, severity), F.lit(0))


def severity_by_type(attack_type: Column, confidence: Column, iso: Column) -> Column:
    """Base severity of the class, lowered for weak confidence, raised for strong anomaly."""
    base = F.coalesce(_lookup({k: SEVERITY_RANK[v] for k, v in BASE_SEVERITY.items()}, attack_type), F.lit(2))
    step = F.when(confidence < 0.50, 2).when(confidence < 0.75, 1).otherwise(0)
    lowered = F.when(step > 0, F.greatest(base - step, F.lit(1))).otherwise(base)
    rank = F.when(iso >= 0.80, F.least(lowered + 1, F.lit(4))).otherwise(lowered)
    names = F.array(*(F.lit(s) for s in _BY_RANK))
    return F.when(attack_type == "UNKNOWN_ATTACK", "CRITICAL").otherwise(F.get(names, rank))


def severity_weighted(probability: Column, iso: Column, w_p: float = 0.8, w_iso: float = 0.2) -> Column:
    """Severity from a weighted sum of attack probability and anomaly score."""

    def unit(x: Column) -> Column:
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))

    score = unit(probability) * w_p + unit(iso) * w_iso
    return (
        F.when(score >= 0.95, "CRITICAL").when(score >= 0.85, "HIGH").when(score >= 0.70, "MEDIUM").otherwise("LOW")
    )


def protocol_name(protocol: Column) -> Column:
    return F.coalesce(_lookup(PROTOCOL_NAMES, protocol), protocol.cast("string"))


def iso_timestamp(ts: Column) -> Column:
    """ISO-8601 UTC text with milliseconds (the session time zone is UTC)."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'+00:00'")
