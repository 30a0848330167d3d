"""Score kernels of seasons and careers, as Columns. Weights are parameters; defaults are the fixed values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions.expr import c, clamp, weighted_observed

#: Weights of the kernels.
SCORING = {"volume": 0.65, "efficiency": 0.35}
ACTIONS = {"rebounding": 0.50, "steals": 0.25, "blocks": 0.25}
DEFENSE = {"actions": 0.65, "team": 0.35}
PEAK = (0.70, 0.30)
LONGEVITY = {"breadth": 0.35, "area": 0.40, "run": 0.25}
PLAYOFFS = {"level": 0.65, "lift": 0.20, "sample": 0.15}


def joint_scoring(volume, efficiency) -> Column:
    """65/35 of volume and efficiency; without efficiency the volume stands alone, without volume there is no score."""
    v, e = c(volume), c(efficiency)
    return F.when(v.isNotNull() & e.isNotNull(), SCORING["volume"] * v + SCORING["efficiency"] * e).otherwise(v)


def peak_hybrid(window_mean, apex) -> Column:
    return PEAK[0] * c(window_mean) + PEAK[1] * c(apex)


def longevity_score() -> Column:
    return sum((F.col(k) * w for k, w in LONGEVITY.items()), F.lit(0.0))


def playoff_score() -> Column:
    """Level, lift and sample; the level is required."""
    return weighted_observed(PLAYOFFS, ("level",))


def action_context() -> Column:
    return weighted_observed(ACTIONS)


def defense_observed(parts: dict[str, float]) -> Column:
    """Channel score without reallocation: what is not observed adds nothing and its weight is lost."""
    return sum((F.coalesce(F.col(k) * w, F.lit(0.0)) for k, w in parts.items()), F.lit(0.0))


def evidence_form(**present) -> Column:
    """The form of the evidence: names of the channels that are there, in order, or NONE."""
    names = F.array_compact(F.array(*[F.when(v, F.lit(k)) for k, v in present.items()]))
    return F.when(F.size(names) == 0, "NONE").otherwise(F.array_join(names, "+"))


def strongest_plus(values: list, share: float = 0.25, cap: float = 4.0) -> Column:
    """The strongest of several recognitions and a share of the rest, capped."""
    a = F.array_compact(F.array(*[c(v) for v in values]))
    total = F.aggregate(a, F.lit(0.0), lambda t, x: t + x)
    best = F.array_max(a)
    return F.when(F.size(a) > 0, F.least(best + share * (total - best), F.lit(cap)))


def reliability_blend(value, prior, n, strength: float = 20.0) -> Column:
    """Shrink to a prior by n / (n + strength)."""
    w = c(n) / (c(n) + F.lit(strength))
    return w * c(value) + (1 - w) * c(prior)


def nested_intervals(bounds: list[tuple[str, str]], low: float, high: float) -> list[Column]:
    """Interval columns from the narrowest to the widest, clipped to a range and each made to hold the one before."""
    out, lo, hi = [], None, None
    for a, b in bounds:
        x, y = clamp(a, low, high), clamp(b, low, high)
        lo, hi = (x, y) if lo is None else (F.least(lo, x), F.greatest(hi, y))
        out += [lo.alias(a), hi.alias(b)]
    return out


def polynomial(names: list[str], degree: int = 2) -> list[Column]:
    """The columns, their squares and products."""
    out = [F.col(a) for a in names]
    if degree >= 2:
        out += [(F.col(a) * F.col(b)).alias(f"{a}_{b}") for i, a in enumerate(names) for b in names[i:]]
    return out


def regime(first, steps: list[tuple[int, str]], last: str) -> Column:
    """The label of the first step above a value."""
    out = None
    for bound, name in steps:
        out = F.when(c(first) < bound, name) if out is None else out.when(c(first) < bound, name)
    return out.otherwise(last)
