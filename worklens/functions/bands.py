"""Score and risk bands."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _band(x: Column, first: tuple[float, str], second: tuple[float, str], rest: str, strict: bool):
    (a, a_name), (b, b_name) = first, second
    over = (lambda t: x > t) if strict else (lambda t: x >= t)
    return F.when(over(a), a_name).when(over(b), b_name).otherwise(rest)


def band_person(score: Column) -> Column:
    return _band(score, (60.0, "OK"), (40.0, "Watch"), "At Risk", strict=False)


def band_health(score: Column) -> Column:
    return _band(score, (75.0, "Healthy"), (50.0, "Needs Attention"), "At Risk", strict=False)


def band_heat_score(score: Column) -> Column:
    return _band(score, (60.0, "green"), (40.0, "yellow"), "red", strict=False)


def band_heat_risk(pct: Column) -> Column:
    """``pct`` is on the 0..100 scale."""
    return _band(pct, (60.0, "red"), (30.0, "yellow"), "green", strict=True)


def band_confidence(pred: Column, prob: Column) -> Column:
    """Confidence of a binary prediction, from P(class 1)."""
    yes = pred == 1
    high = (yes & (prob > 0.75)) | (~yes & (prob < 0.25))
    medium = (yes & (prob > 0.6)) | (~yes & (prob < 0.4))
    return F.when(high, "High").when(medium, "Medium").otherwise("Low")
