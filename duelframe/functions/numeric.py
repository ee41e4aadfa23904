"""Numeric, date and conditional functions as Column -> Column functions."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1e-6
#: Lower ends and labels of left-closed buckets; a value below the first end has no bucket.
BUCKETS = {
    "odds": ((-math.inf, "odds < 1.5"), (1.5, "1.5 <= odds < 2.0"), (2.0, "2.0 <= odds < 3.0"), (3.0, "3.0 <= odds < 5.0"), (5.0, "odds >= 5.0")),
    "market": ((-math.inf, "longshot"), (0.25, "underdog"), (0.45, "near coin flip"), (0.55, "slight favorite"), (0.70, "heavy favorite")),
    "model": ((-math.inf, "<0.35"), (0.35, "0.35-0.45"), (0.45, "0.45-0.55"), (0.55, "0.55-0.65"), (0.65, ">0.65")),
    "edge": ((0.0, "0.00-0.02"), (0.02, "0.02-0.05"), (0.05, "0.05-0.08"), (0.08, "0.08-0.10"), (0.10, ">0.10")),
}


def real(c: Column) -> Column:
    """The value as a double with NaN as null."""
    c = c.try_cast("double")
    return F.when(~F.isnan(c), c)


def ratio(n: Column, d: Column, default: float | None = 0.0) -> Column:
    """n / d, or the default where d is not positive or either is null."""
    return F.when((d > 0) & n.isNotNull(), n / d).otherwise(F.lit(default))


def near_ratio(n: Column, d: Column) -> Column:
    return n / (d + EPSILON)


def first_of(*columns: Column, default: float = 0.0) -> Column:
    return F.coalesce(*columns, F.lit(default))


def log1p_positive(c: Column) -> Column:
    return F.log1p(F.greatest(F.coalesce(c, F.lit(0.0)), F.lit(0.0)))


def clip(c: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(c, F.lit(lo)), F.lit(hi))


def logit(p: Column, eps: float = EPSILON) -> Column:
    p = clip(p, eps, 1 - eps)
    return F.ln(p / (1 - p))


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def event_date(c: Column) -> Column:
    """Day first, then year first, then month name; null where none reads."""
    formats = ("dd/MM/yyyy", "d/M/yyyy", "yyyy-MM-dd", "MMM d, yyyy", "MMM dd, yyyy")
    return F.coalesce(*[F.try_to_date(F.trim(c), f) for f in formats])


def age_at(day: Column, born: Column) -> Column:
    """Whole years; null without either date."""
    early = (F.month(day) < F.month(born)) | ((F.month(day) == F.month(born)) & (F.dayofmonth(day) < F.dayofmonth(born)))
    return F.year(day) - F.year(born) - F.when(early, 1).otherwise(0)


def days_between(later: Column, earlier: Column) -> Column:
    return F.greatest(F.datediff(later, earlier), F.lit(0))


def american_to_probability(odds: Column) -> Column:
    return F.when(odds > 0, 100 / (odds + 100)).when(odds < 0, F.abs(odds) / (F.abs(odds) + 100))


def american_to_decimal(odds: Column) -> Column:
    return F.when(odds > 0, 1 + odds / 100).when(odds < 0, 1 + 100 / F.abs(odds))


def no_vig(a: Column, b: Column) -> tuple[Column, Column, Column]:
    """Overround, and both probabilities scaled to a sum of 1."""
    total = a + b
    return total, a / total, b / total


def bucket(c: Column, kind: str) -> Column:
    """Label of the left-closed bucket."""
    label = F.lit(None).cast("string")
    for least, name in BUCKETS[kind]:
        label = F.when((c >= least) if least > -math.inf else c.isNotNull(), F.lit(name)).otherwise(label)
    return label


def expected_score(own: Column, other: Column) -> Column:
    return 1 / (1 + F.pow(F.lit(10.0), (other - own) / 400))


def decay_weight(days: Column, half_life: float) -> Column:
    return F.exp(-math.log(2) / half_life * days)


def audit_equal(a: Column, b: Column, atol: float = 1e-8, rtol: float = 1e-5) -> Column:
    """Null-safe equality; numbers, also as text, may differ by the tolerance."""
    x, y = a.try_cast("double"), b.try_cast("double")
    close = F.coalesce(F.abs(x - y) <= atol + rtol * F.abs(y), F.lit(False))
    return a.cast("string").eqNullSafe(b.cast("string")) | close


def all_present(*columns: str) -> Column:
    return reduce(lambda x, y: x & y, [F.col(c).isNotNull() for c in columns], F.lit(True))
