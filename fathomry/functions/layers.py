"""Layer specifications resolved to layer indices."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_FRACTIONS = (0.25, 0.5, 0.75)


def normalise(index: int, n: int) -> int:
    """Negative indices count from the end; ValueError outside of the model."""
    out = index + n if index < 0 else index
    if not 0 <= out < n:
        raise ValueError(f"layer {index} is out of range for {n} layers")
    return out


def auto_candidates(candidates, n: int) -> list[int]:
    """Fractions of the depth (floats in [0, 1]) or indices, as sorted distinct indices. Mixed lists are refused."""
    if candidates is None:
        candidates = DEFAULT_FRACTIONS
    candidates = list(candidates)
    if not candidates:
        raise ValueError("no candidate layers")
    floats = [isinstance(c, float) for c in candidates]
    if any(floats) and not all(floats):
        raise ValueError("candidates are either all fractions or all indices")
    if all(floats):
        if not all(0.0 <= c <= 1.0 for c in candidates):
            raise ValueError("fractions lie between 0 and 1")
        return sorted({max(0, min(n - 1, int(c * (n - 1)))) for c in candidates})
    return sorted({normalise(int(c), n) for c in candidates})


def resolve(layers, n: int, candidates=None) -> list[int]:
    """int, list, "middle", "last", "all", "auto" or "fast_auto" to indices; a list keeps its order."""
    if isinstance(layers, bool) or layers is None:
        raise ValueError(f"not a layer specification: {layers!r}")
    if isinstance(layers, int):
        return [normalise(layers, n)]
    if isinstance(layers, str):
        third = n // 3
        named = {"middle": range(third, n - third), "last": range(n - 1, n), "all": range(n)}
        if layers in named:
            return list(named[layers])
        if layers in ("auto", "fast_auto"):
            return auto_candidates(candidates, n)
        raise ValueError(f"unknown layer specification: {layers!r}")
    return [normalise(int(i), n) for i in layers]


def in_middle(layer: Column, n: Column) -> Column:
    third = F.floor(n / 3)
    return (layer >= third) & (layer < n - third)


def at_fraction(fraction: float, n: Column) -> Column:
    """Index of the layer at a fraction of the depth, truncated and clamped."""
    return F.greatest(F.lit(0), F.least(n - 1, F.floor(F.lit(fraction) * (n - 1)))).cast("long")
