"""Rules over evidence: missingness policies, confidence, eras, and the labels of ranks and orders. All stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions.expr import c

#: The names of the policies for absent parts, and the coverage that two of them ask for.
POLICIES = ("CORE_FEATURE_ONLY", "AVAILABLE_FEATURE_RENORMALIZATION", "COVERAGE_THRESHOLD", "ERA_SPECIFIC_ENRICHMENT")
COVERAGE_THRESHOLD = 2 / 3
#: Classes of the probability to be among the first hundred, with their lower bounds, and the class below.
TOP100_MEMBERSHIP = (("ROBUST_TOP100", 0.90), ("LIKELY_TOP100", 0.65), ("TOP100_BUBBLE", 0.35), ("LIKELY_OUTSIDE_TOP100", 0.10))
TOP100_ELSE = "ROBUST_OUTSIDE_TOP100"
#: Bounds of the evidence for an order of two.
STRONG_ORDER, LEAN_ORDER, INDETERMINATE = 0.90, 0.65, 0.35
#: Broad roles of positions.
BROAD_ROLES = {"GUARD": "GUARD", "FORWARD-GUARD": "WING", "GUARD-FORWARD": "WING", "FORWARD": "FORWARD", "FORWARD-CENTER": "BIG", "CENTER-FORWARD": "BIG", "CENTER": "BIG"}


def _total(columns) -> Column:
    return reduce(lambda a, b: a + b, columns, F.lit(0))


def coverage_confidence(available, expected) -> Column:
    """STRONG with all parts, MODERATE from three quarters, LIMITED with any, UNAVAILABLE without."""
    a, e = c(available), c(expected)
    return F.when((e <= 0) | (a <= 0), "UNAVAILABLE").when(a == e, "STRONG").when(a / e >= 0.75, "MODERATE").otherwise("LIMITED")


def combine_components(parts: dict[str, bool], policy: str, weights: dict[str, float] | None = None, threshold: float = COVERAGE_THRESHOLD) -> Column:
    """A struct: the weighted mean of the parts that the policy admits (value), the shares of all, core and optional
    parts that are known (coverage, core_coverage, optional_coverage), confidence, and the number of parts used.

    parts: column name -> whether it is core. Core only: every core part must be known. Renormalised: whatever is
    known. Threshold: the same, if enough of all is known. Enrichment: known core parts, if enough of the core is.
    """
    if policy not in POLICIES:
        raise ValueError(f"unknown policy {policy}")
    known = {k: F.when(F.col(k).isNotNull(), 1).otherwise(0) for k in parts}
    core = [k for k, is_core in parts.items() if is_core]
    n, n_core = len(parts), len(core)
    available, core_available = _total(known.values()), _total(known[k] for k in core)
    chosen = core if policy in (POLICIES[0], POLICIES[3]) else list(parts)
    used = _total(known[k] for k in chosen)
    valid = {
        POLICIES[0]: (core_available == n_core) & F.lit(n_core > 0), POLICIES[1]: available > 0,
        POLICIES[2]: (available > 0) & (available / F.lit(max(n, 1)) >= threshold), POLICIES[3]: (core_available > 0) & (core_available / F.lit(max(n_core, 1)) >= threshold),
    }[policy]
    w = weights or dict.fromkeys(parts, 1.0)
    weight = _total(F.when(F.col(k).isNotNull(), F.lit(float(w[k]))).otherwise(0.0) for k in chosen)
    total = _total(F.coalesce(F.col(k) * F.lit(float(w[k])), F.lit(0.0)) for k in chosen)
    share = lambda x, of: (x / F.lit(of)) if of else F.lit(None).cast("double")
    return F.struct(
        F.when(valid & (weight > 0), total / weight).alias("value"), share(available, n).alias("coverage"), (core_available / F.lit(n_core) if n_core else F.lit(0.0)).alias("core_coverage"),
        share(available - core_available, n - n_core).alias("optional_coverage"), coverage_confidence(available, F.lit(n)).alias("confidence"), F.when(valid, used).otherwise(0).alias("used"),
    )


def era_group(first_season) -> Column:
    """UNKNOWN, PRE_1960, then decades up to 2020S."""
    y = c(first_season)
    out = F.when(y.isNull(), "UNKNOWN").when(y < 1960, "PRE_1960")
    for decade in range(1960, 2020, 10):
        out = out.when(y < decade + 10, f"{decade}S")
    return out.otherwise("2020S")


def bands(value, levels, below: str) -> Column:
    """The name of the first level whose lower bound the value reaches; levels fall. NULL stays NULL."""
    out = F.when(c(value).isNull(), F.lit(None).cast("string"))
    for name, low in levels:
        out = out.when(c(value) >= low, name)
    return out.otherwise(below)


def top100_membership(probability) -> Column:
    return bands(probability, TOP100_MEMBERSHIP, TOP100_ELSE)


def pairwise_order(probability) -> Column:
    """Evidence that a is above b, symmetric around an indeterminate middle."""
    p = c(probability)
    return (
        F.when(p.isNull(), F.lit(None).cast("string")).when(p >= STRONG_ORDER, "STRONG_A_OVER_B").when(p >= LEAN_ORDER, "LEAN_A_OVER_B").when(p >= INDETERMINATE, "INDETERMINATE")
        .when(1.0 - p >= STRONG_ORDER, "STRONG_B_OVER_A").otherwise("LEAN_B_OVER_A")
    )


def robust_order(probability) -> Column:
    p = c(probability)
    return F.when(p.isNull(), F.lit(None).cast("string")).when(p >= 0.90, "ROBUST_ORDER").when(p >= 0.65, "LEAN_ORDER").when(p <= 0.10, "ROBUST_REVERSE").when(p <= 0.35, "LEAN_REVERSE").otherwise("UNCERTAIN_ORDER")


def rank_stability(top100_probability, interval_width) -> Column:
    """How sensitive a rank is, never how good its holder."""
    p, width = c(top100_probability), c(interval_width)
    return F.when((p >= 0.90) & (width <= 25), "HIGH").when((p >= 0.50) | (width <= 75), "MODERATE").otherwise("LOW")


def broad_role(position) -> Column:
    """GUARD, WING, FORWARD or BIG; NULL for blank and unknown positions."""
    p = F.upper(F.trim(c(position)))
    return reduce(lambda out, kv: out.when(p == kv[0], kv[1]), BROAD_ROLES.items(), F.when(F.lit(False), ""))


def minutes_are_eligible(minutes) -> Column:
    """Aggregate: there are rows, no minutes are missing, and 99 % of them are positive."""
    n = F.count(F.lit(1))
    return (n > 0) & (F.count(c(minutes)) == n) & (F.count_if(c(minutes) > 0) / n >= 0.99)
