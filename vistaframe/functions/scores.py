"""Scores of spots and scenes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weights of the request ranking (fixed values).
WEIGHTS = {"preferences": 0.30, "visibility": 0.25, "time_weather": 0.20, "travel": 0.15, "crowd": 0.10}
#: Crowd score by preference and level (fixed values).
CROWD = {
    "quiet": {"low": 100.0, "medium": 45.0, "high": 0.0},
    "balanced": {"low": 70.0, "medium": 100.0, "high": 35.0},
    "lively": {"low": 20.0, "medium": 65.0, "high": 100.0},
}


def weather(rain: Column, wind: Column, sight: Column) -> Column:
    """100 less penalties; all three values are needed."""
    penalty = F.least(F.lit(70.0), rain * 12) + F.least(F.lit(50.0), F.greatest(F.lit(0.0), wind - 3) * 6) + 40 * F.greatest(F.lit(0.0), 1 - sight / 10000)
    return F.when((rain >= 0) & (wind >= 0) & (sight >= 0), F.greatest(F.lit(0.0), 100 - penalty))


def travel(minutes: Column, most: Column) -> Column:
    return F.when(minutes >= 0, F.greatest(F.lit(0.0), 100 * (1 - minutes / most)))


def crowd(preference: Column, level: Column) -> Column:
    out = F.lit(None).cast("double")
    for p, levels in CROWD.items():
        for name, value in levels.items():
            out = F.when((preference == p) & (level == name), value).otherwise(out)
    return out


def preference(features: Column, wanted: Column) -> Column:
    """Share of the wanted tags that the features have, out of 100."""
    return F.when((F.size(features) > 0) & (F.size(wanted) > 0), 100 * F.size(F.array_intersect(F.array_distinct(features), wanted)) / F.size(wanted))


def renormalised(criteria: dict[str, Column]) -> tuple[Column, Column]:
    """Weighted mean over the known criteria, and the weight that is known."""
    known = sum((F.when(c.isNotNull(), WEIGHTS[k]).otherwise(0.0) for k, c in criteria.items()), F.lit(0.0))
    total = sum((F.coalesce(c * WEIGHTS[k], F.lit(0.0)) for k, c in criteria.items()), F.lit(0.0))
    return F.when(known > 0, total / known), known


def composition(kind: Column, visible: Column, span: Column) -> Column:
    framed = F.when(visible >= 2, F.greatest(F.lit(0.0), 1 - F.abs(span - 15) / 30)).otherwise(0.0)
    wide = F.when(visible >= 3, F.least(F.lit(1.0), span / 55)).otherwise(0.0)
    return F.when(kind == "framed", framed).when(kind == "open", wide).otherwise(F.least(F.lit(1.0), visible / 6))


def scene(match: Column, visible: Column, intended: Column, shape: Column, proximity: Column, radius: Column, elevation: Column) -> Column:
    """Fixed weights 45, 25, 15, 10, 5: what is unknown earns nothing."""
    day = F.when(elevation > 0, 1.0).otherwise(0.3)
    return 45 * match + 25 * visible / F.greatest(F.lit(1), intended) + 15 * shape + 10 * F.greatest(F.lit(0.0), 1 - proximity / radius) + 5 * day


def importance(category: Column, height: Column, area: Column, d: Column) -> Column:
    tall = F.least(F.lit(80.0), F.greatest(F.lit(0.0), height)) / F.pow(1 + d / 500, F.lit(1.5))
    wide = F.when(area > 0, F.sqrt(area)).otherwise(20.0) / (1 + d / 2000)
    return F.when(category == "city", tall).otherwise(wide)


def time_suitability(hour: Column, features: Column) -> Column:
    evening = (hour >= 18) | (hour < 6)
    return F.when(evening & F.array_contains(features, "forest"), 45).when(evening & F.array_contains(features, "night"), 92).otherwise(86)
