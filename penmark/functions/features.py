"""Weighted feature vector and the L-infinity distance."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import lexicon

FEATURES = lexicon.FEATURE_NAMES


def resolve_weights(weights: dict[str, float] | list[float] | None = None) -> list[float]:
    """The fifteen weights in vector order: the fixed ones, those with some
    replaced by metric name (a dict), or a whole list."""
    fixed = lexicon.FEATURE_WEIGHTS
    if isinstance(weights, dict):
        unknown = set(weights) - {m for m, _ in fixed}
        if unknown:
            raise ValueError(f"weights of unknown metrics: {sorted(unknown)}")
        out = [float(weights.get(m, w)) for m, w in fixed]
    else:
        out = [float(w) for w in weights] if weights is not None else [w for _, w in fixed]
    if len(out) != len(fixed):
        raise ValueError(f"{len(fixed)} weights are needed, {len(out)} given")
    if not all(math.isfinite(w) and w >= 0 for w in out) or not any(out):
        raise ValueError("weights must be finite, not negative and not all zero")
    return out


def feature_columns(weights: dict[str, float] | list[float] | None = None) -> list[Column]:
    """``f0..f14`` = metric × weight, in the fixed vector order."""
    names = [m for m, _ in lexicon.FEATURE_WEIGHTS]
    return [(F.col(m) * F.lit(w)).alias(f"f{i}") for i, (m, w) in enumerate(zip(names, resolve_weights(weights)))]


def with_features(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Project metrics to the 15 feature columns (plus ``keep``)."""
    keep = keep or []
    return df.select(*[F.col(c) for c in keep], *feature_columns())


def linf_to_point(point: list[float], prefix: str = "f") -> Column:
    """L∞ distance from the feature columns to a literal point (codegen'd)."""
    return F.greatest(*[F.abs(F.col(f"{prefix}{i}") - F.lit(float(v))) for i, v in enumerate(point)])


def linf_arrays(a: Column, b: Column) -> Column:
    """L∞ distance between two array<double> columns."""
    return F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x - y)))
