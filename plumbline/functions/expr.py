"""Column expressions: guarded ratios, strict sums, scores under missingness, ids and hashes. All stay in the JVM.

Missing is never zero: a ratio without a positive denominator, a sum over an incomplete group and a score whose
required parts are absent are NULL.
"""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: The normal-consistency scales of the two robust z conventions.
ROBUST_Z_ERA = 0.6744897501960817
ROBUST_Z_CANDIDATE = 1.4826


def c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def safe_ratio(num, den, scale: float = 1.0, digits: int | None = None) -> Column:
    """scale * num / den, NULL unless den > 0."""
    out = F.when(c(den) > 0, c(num).cast("double") * F.lit(float(scale)) / c(den))
    return F.round(out, digits) if digits is not None else out


def per_game(total, games) -> Column:
    return safe_ratio(total, games)


def per_36(total, minutes) -> Column:
    return safe_ratio(total, minutes, 36)


def per_75(total, possessions) -> Column:
    return safe_ratio(total, possessions, 75)


def true_shooting(points, fga, fta) -> Column:
    return safe_ratio(points, 2 * (c(fga) + 0.44 * c(fta)))


def effective_share(made, threes, attempts) -> Column:
    return safe_ratio(c(made) + 0.5 * c(threes), attempts)


def strict_sum(x) -> Column:
    """Aggregate: the sum, NULL if any input is NULL."""
    return F.when(F.count(c(x)) == F.count(F.lit(1)), F.sum(c(x)))


def nullable_sum(x) -> Column:
    """Aggregate: the sum of what is known, NULL if nothing is."""
    return F.sum(c(x))


def weighted_mean(value, weight) -> Column:
    """Aggregate: NULL if no weight is known; rows without a value don't count."""
    w = F.when(c(value).isNotNull(), c(weight))
    return F.when(F.sum(w) > 0, F.sum(c(value) * w) / F.sum(w))


def clamp(x, low: float, high: float) -> Column:
    return F.when(c(x).isNotNull(), F.least(F.greatest(c(x), F.lit(low)), F.lit(high)))


def z_score(x, mean, sd) -> Column:
    return F.when(c(sd) > 0, (c(x) - c(mean)) / c(sd))


def robust_z(x, median, mad, scale: float = ROBUST_Z_ERA) -> Column:
    return F.when(c(mad) > 0, F.lit(scale) * (c(x) - c(median)) / c(mad))


def relative_index(x, reference) -> Column:
    return F.when(c(reference) > 0, F.lit(100.0) * c(x) / c(reference))


def opportunity_adjusted(value, ratio, baseline: float) -> Column:
    """Shrink to the method's baseline by the clamped opportunity ratio."""
    return F.lit(baseline) + (c(value) - F.lit(baseline)) * clamp(ratio, 0.0, 1.0)


def round_scaled(value, digits: int) -> Column:
    """Rounded as DuckDB rounds doubles: the product with the power of ten to a whole number, half away from zero. F.round takes the shortest decimal form instead, which parts from it at ties."""
    scale = F.lit(10.0**digits)
    return F.round(c(value) * scale) / scale


def sum_by(value, order) -> Column:
    """Aggregate: the sum of doubles, added in the order of a unique key: the same wherever the rows lie. For groups of bounded size."""
    own = F.filter(F.array_sort(F.collect_list(F.struct(c(order).alias("k"), c(value).alias("v")))), lambda x: x["v"].isNotNull())
    return F.when(F.size(own) > 0, F.aggregate(own, F.lit(0.0), lambda a, x: a + x["v"]))


def avg_by(value, order) -> Column:
    """Aggregate: the mean of doubles, added as by sum_by."""
    return sum_by(value, order) / F.count(c(value))


def qualifies(games, opportunity, least: int = 5, share: float = 0.20) -> Column:
    return c(games) >= F.greatest(F.lit(least), F.ceil(F.lit(share) * c(opportunity)))


def introduced(value, period, first_period: int) -> Column:
    """Availability mask: NULL before the metric's introduction."""
    return F.when(c(period) >= first_period, c(value))


def coverage_class(known, total) -> Column:
    share = F.when(c(total) > 0, c(known) / c(total))
    return F.when(share.isNull() | (share == 0), "UNKNOWN").when(share >= 0.99, "RELIABLE").when(share >= 0.80, "PARTIAL").otherwise("SPARSE")


def weighted_observed(parts: dict[str, float], required: tuple[str, ...] = ()) -> Column:
    """Weighted mean over the parts that are observed, weights renormalised; NULL if a required part is absent."""
    weight = reduce(lambda a, b: a + b, [F.when(F.col(k).isNotNull(), F.lit(w)).otherwise(0.0) for k, w in parts.items()])
    total = reduce(lambda a, b: a + b, [F.coalesce(F.col(k) * F.lit(w), F.lit(0.0)) for k, w in parts.items()])
    ok = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in required], F.lit(True))
    return F.when(ok & (weight > 0), total / weight)


def observed_weight(parts: dict[str, float]) -> Column:
    return reduce(lambda a, b: a + b, [F.when(F.col(k).isNotNull(), F.lit(w)).otherwise(0.0) for k, w in parts.items()])


def combine(parts: dict[str, float], policy: str, neutral: float = 0.5) -> Column:
    """Weighted mean under a missingness policy: complete, renormalise, zero, neutral."""
    if policy == "renormalise":
        return weighted_observed(parts)
    total = sum(parts.values())
    fill = {"complete": None, "zero": 0.0, "neutral": neutral}[policy]
    terms = [(F.col(k) if fill is None else F.coalesce(F.col(k), F.lit(fill))) * F.lit(w / total) for k, w in parts.items()]
    return reduce(lambda a, b: a + b, terms)


def stronger_secondary(a, b, strong: float = 0.65) -> Column:
    """A blend that favours the stronger of two axes; the known one where only one is."""
    both = F.greatest(c(a), c(b)) * F.lit(strong) + F.least(c(a), c(b)) * F.lit(1 - strong)
    return F.when(c(a).isNotNull() & c(b).isNotNull(), both).otherwise(F.coalesce(c(a), c(b)))


def hash_fold(key, folds: int) -> Column:
    """A fold from the first 8 hex digits of the key's SHA-256."""
    return (F.conv(F.substring(F.sha2(c(key).cast("string"), 256), 1, 8), 16, 10).cast("bigint") % folds).cast("int")


def canonical_id(kind: str, provider: str, key, namespace: str) -> Column:
    """UUIDv5 of `kind:provider:key` in the namespace (32 hex digits)."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(F.concat(F.lit(f"{kind}:{provider}:"), c(key).cast("string")), "UTF-8")))
    variant = F.lower(F.hex((F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4) + 8))
    h = F.concat(F.substring(digest, 1, 12), F.lit("5"), F.substring(digest, 14, 3), variant, F.substring(digest, 18, 15))
    cut = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat_ws("-", *[F.substring(h, s, n) for s, n in cut])


def fingerprint(*columns) -> Column:
    """Aggregate: an order-independent SHA-256 of rows: of their number and the sums of four parts of their hashes, so no group is gathered."""
    row = F.sha2(F.concat_ws("|", *[F.coalesce(c(x).cast("string"), F.lit("~")) for x in columns]), 256)
    sums = [F.sum(F.conv(F.substring(row, 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)")).cast("string") for k in range(4)]
    return F.sha2(F.concat_ws("|", F.count(F.lit(1)).cast("string"), *sums), 256)


@F.pandas_udf(StringType())
def _folded(names: pd.Series) -> pd.Series:
    """Compatibility forms without their marks, case folded: no built-in function decomposes characters."""
    plain = lambda t: None if t is None else "".join(x for x in unicodedata.normalize("NFKD", t) if not unicodedata.combining(x)).casefold()
    return names.map(plain)


def search_name(text) -> Column:
    """Case folded, marks stripped (any script's), runs of other characters as one space."""
    return F.trim(F.regexp_replace(_folded(c(text)), "[^a-z0-9]+", " "))


def slug(text) -> Column:
    return F.regexp_replace(search_name(text), " ", "-")


def parse_minutes(text) -> Column:
    """"MM:SS" or a number of minutes; anything else is NULL."""
    parts = F.split(F.trim(c(text)), ":")
    return F.when(F.size(parts) == 2, F.get(parts, F.lit(0)).try_cast("double") + F.get(parts, F.lit(1)).try_cast("double") / 60).otherwise(F.trim(c(text)).try_cast("double"))


def whole_number(text) -> Column:
    """"12.0" as 12; NULL where a fraction or no number stands."""
    x = F.trim(c(text)).try_cast("double")
    return F.when(x == F.floor(x), x.cast("bigint"))


def season_label(year) -> Column:
    return F.when(c(year).isNotNull(), F.format_string("%d-%02d", c(year), (c(year) + 1) % 100))


def season_start(label) -> Column:
    """The first year of "YYYY-YY", NULL unless the second part follows it."""
    first = F.regexp_extract(c(label), r"^(\d{4})-(\d{2})$", 1).try_cast("int")
    second = F.regexp_extract(c(label), r"^(\d{4})-(\d{2})$", 2).try_cast("int")
    return F.when((first + 1) % 100 == second, first)


def age_on(reference_date, birth_date) -> Column:
    age = F.datediff(c(reference_date), c(birth_date)) / F.lit(365.2425)
    return F.when(age > 0, age)


def height_cm(text) -> Column:
    """"7-2" feet and inches."""
    f, i = F.regexp_extract(c(text), r"^(\d+)-(\d+)$", 1).try_cast("int"), F.regexp_extract(c(text), r"^(\d+)-(\d+)$", 2).try_cast("int")
    return F.round((f * 12 + i) * F.lit(2.54), 1)


def reason_codes(**flags) -> Column:
    """The names of the conditions that hold, as an array."""
    return F.array_compact(F.array(*[F.when(v, F.lit(k)) for k, v in flags.items()]))
