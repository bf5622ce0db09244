"""Scores of a record, as Column expressions.

``as_of`` is always explicit: no function reads the clock.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Weights:
    """Default weights of the signals and of rank fusion."""

    vector: float = 0.45
    fts: float = 0.25
    graph: float = 0.10
    recency: float = 0.20
    frequency: float = 0.10
    usefulness: float = 0.05
    valence: float = 0.05
    quality: float = 0.10
    goal: float = 0.10
    importance: float = 0.10
    recency_decay: float = 0.05
    rrf_k: int = 60
    supersession_demotion: float = 0.2
    tag_boost: float = 0.10
    metadata_penalty: float = 0.35
    min_score: float = 0.001
    gap: float = 0.15
    quality_floor: float = 0.08


def js_round(x: Column, places: int = 0) -> Column:
    """Round half towards plus infinity."""
    scale = float(10**places)
    return F.floor(x * scale + 0.5) / scale


def days_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / 86_400e6


def _zip_sum(a: Column, b: Column) -> Column:
    product = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(product, F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; 0 for different lengths or a zero vector."""
    norm = F.sqrt(_zip_sum(a, a)) * F.sqrt(_zip_sum(b, b))
    return F.when((F.size(a) != F.size(b)) | (norm == 0), 0.0).otherwise(_zip_sum(a, b) / norm)


def recency(created_at: Column, as_of: Column, rate: float = 0.05, signal: Column | None = None) -> Column:
    """Exponential decay; a signal of 1 halves the rate."""
    damp = 1 - F.coalesce(signal, F.lit(0.0)) * 0.5 if signal is not None else F.lit(1.0)
    return F.coalesce(F.exp(-rate * damp * days_between(as_of, created_at)), F.lit(0.0))


def frequency(access: Column, most: Column) -> Column:
    return F.when(most <= 0, 0.0).otherwise(F.log1p(access) / F.log1p(most))


def usefulness(useful: Column) -> Column:
    return F.when(useful <= 0, 0.0).otherwise(F.least(F.lit(1.0), F.log1p(useful) / math.log(17)))


def valence(value: Column) -> Column:
    return F.abs(value)


def quality(importance: Column, useful: Column, access: Column, links: Column, age_days: Column) -> Column:
    reached = F.when(access > 0, F.least(F.lit(1.0), F.log1p(access) / math.log(21))).otherwise(0.0)
    linked = F.when(links > 0, F.least(F.lit(1.0), links / 5)).otherwise(0.0)
    fresh = F.exp(-0.02 * F.greatest(F.lit(0.0), age_days))
    return 0.30 * importance + 0.25 * usefulness(useful) + 0.15 * reached + 0.15 * linked + 0.15 * fresh


def hybrid(vector: Column, fts: Column, recent: Column, frequent: Column, w: Weights = Weights()) -> Column:
    """Weighted score whose secondary signals are gated by the stronger retrieval signal."""
    gate = F.greatest(F.lit(0.0), vector, fts)
    primary = w.vector * vector + w.fts * fts
    share = F.when(gate == 0, 0.0).otherwise(F.least(F.lit(1.0), 0.25 + gate * 0.75))
    return primary + F.least(share * (w.recency * recent + w.frequency * frequent), primary * share)


def tier_boost(tier: Column) -> Column:
    # Fixed values.
    return (
        F.when(tier == "semantic", 0.15).when(tier == "procedural", 0.10).when(tier == "reference", 0.05)
        .when(tier == "working", -0.10).otherwise(0.0)
    )


def goal_relevance(tags: Column, keywords: Column, content: Column) -> Column:
    """Relevance to goal keywords: linked by tag, else by shared tags, else by words of the content."""
    n = F.size(keywords)
    shared = F.size(F.array_intersect(tags, keywords))
    inside = F.size(F.filter(keywords, lambda k: F.contains(F.lower(content), k)))
    return (
        F.when(n == 0, 0.0)
        .when(F.array_contains(tags, "goal-progress"), 1.0)
        .when(F.array_contains(tags, "goal-progress-implicit"), 0.7)
        .when(shared > 0, F.least(F.lit(1.0), shared / F.least(n, F.lit(3))))
        .when(inside >= 2, F.least(F.lit(0.5), inside / F.least(n, F.lit(5))))
        .otherwise(0.0)
    )


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def link_strength(count: Column, full: float, base: float = 0.3, span: float = 0.6, most: float = 0.9) -> Column:
    """Strength of an inferred link from how often its ends were seen together."""
    return F.least(F.lit(most), base + count / full * span)
