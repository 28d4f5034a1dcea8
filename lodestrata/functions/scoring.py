"""Scores as column expressions; times of reference are parameters, never the clock."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Authority of sources by name, and of all others.
SOURCE_AUTHORITY = {"央行官网": 0.95, "证监会": 0.95, "政府网站": 0.90, "Reuters": 0.90, "Bloomberg": 0.90, "新浪财经": 0.50, "Twitter": 0.20, "自媒体": 0.15}
DEFAULT_AUTHORITY = 0.40


def age_days(c: Column, as_of: str, whole: bool = False) -> Column:
    """Days from a time to the time of reference, not below 0."""
    days = (F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros(c)) / 86_400_000_000.0
    return F.greatest(F.lit(0.0), F.floor(days).cast("double") if whole else days)


def recency(c: Column, as_of: str, half_life_days: float = 7.0) -> Column:
    return F.exp(-math.log(2) * age_days(c, as_of) / half_life_days)


def time_score(c: Column, as_of: str, rate: float = 0.05) -> Column:
    """Falls from 1 with whole days of age; 1 without a date."""
    return F.coalesce(2 / (1 + F.exp(rate * age_days(c, as_of, whole=True) / 10)), F.lit(1.0))


def evidence_confidence(n: Column) -> Column:
    return F.when(F.coalesce(n, F.lit(0)) <= 0, 0.15).otherwise(F.least(F.lit(1.0), 0.40 + 0.20 * F.log(n.cast("double"))))


def vector_score(distance: Column) -> Column:
    return F.round(1 / (1 + distance), 4)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in doubles; null if a vector has length 0."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)


def l2_normalize(a: Column) -> Column:
    norm = F.sqrt(dot(a, a))
    return F.when(norm > 0, F.transform(a, lambda x: x.cast("double") / norm)).otherwise(F.transform(a, lambda x: x.cast("double")))


def combine_vectors(title: Column, text: Column, title_weight: float = 0.4) -> Column:
    """Weighted sum of two unit vectors, made a unit vector again."""
    both = F.zip_with(l2_normalize(title), l2_normalize(text), lambda x, y: title_weight * x + (1 - title_weight) * y)
    return l2_normalize(both)


def decayed_sum(weights: Column) -> Column:
    """Weights in falling order, each counting half of the one before."""
    ordered = F.sort_array(weights, asc=False)
    return F.aggregate(
        ordered,
        F.struct(F.lit(0.0).alias("s"), F.lit(1.0).alias("f")),
        lambda acc, w: F.struct((acc["s"] + w * acc["f"]).alias("s"), (acc["f"] * 0.5).alias("f")),
        lambda acc: acc["s"],
    )


def source_authority(c: Column, table: dict[str, float] | None = None, default: float = DEFAULT_AUTHORITY) -> Column:
    pairs = [F.lit(x) for item in (table or SOURCE_AUTHORITY).items() for x in item]
    return F.coalesce(F.create_map(*pairs)[F.trim(c)], F.lit(default))


def importance(recent: Column, authority: Column, central: Column, event_impact: float = 0.5) -> Column:
    """Weighted sum of recency, authority, centrality and event impact."""
    return 0.40 * recent + 0.30 * authority + 0.20 * central + 0.10 * event_impact


def first_time(*columns: Column) -> Column:
    """The first time that is known: published, created, updated, effective."""
    return F.coalesce(*columns)


def time_bias_days(c: Column, groups: list[tuple[list[str], int]]) -> Column:
    """Days of the first group of which a word occurs; null if none does."""
    out = F.lit(None).cast("int")
    for words, days in reversed(groups):
        hit = F.lit(False)
        for word in words:
            hit = hit | c.contains(word)
        out = F.when(hit, days).otherwise(out)
    return out


def min_max(c: Column, low: Column, high: Column, flat: float = 0.5, digits: int = 6, epsilon: float = 1e-8) -> Column:
    """Scaled to 0..1; ``flat`` where all values are equal."""
    return F.when(high - low <= epsilon, F.lit(flat)).otherwise(F.round((c - low) / (high - low), digits))
