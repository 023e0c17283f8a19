"""Array and scalar expressions over waveforms: slices, guarded ratios, statistics, peaks, distances, scores.

All are built-in higher-order functions, so they stay inside the JVM and prune with the columns around them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def phase_slice(wave: Column, n: int, low: float = 0.45, high: float = 0.63) -> Column:
    """The sensitive phase: positions max(1, ceil(low n)) to floor(high n), 1-based and inclusive."""
    a, b = max(1, math.ceil(low * n)), math.floor(high * n)
    return F.slice(wave, a, b - a + 1)


def ratio(a: Column, b: Column, eps: float = 1e-9) -> Column:
    return F.when(F.abs(b) >= eps, a / b)


def divided(a: Column, b: Column) -> Column:
    """a / b where b may be zero: 0 / 0 is NaN and what else is over zero is infinite, as floating point and SQL have it."""
    return F.when(b == 0, a.cast("double") * F.lit(float("inf"))).otherwise(F.try_divide(a, b))


def ratio_arrays(a: Column, b: Column, eps: float = 1e-9) -> Column:
    return F.zip_with(a, b, lambda x, y: ratio(x, y, eps))


def resultant(x: Column, y: Column) -> Column:
    return F.sqrt(x * x + y * y)


def finite(x: Column) -> Column:
    """x, or null where it is NaN or infinite."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def total(values: Column, of=lambda x: x) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + of(x))


def present(values: Column) -> Column:
    return F.filter(values, lambda x: x.isNotNull())


def mean(values: Column, of=lambda x: x) -> Column:
    return total(values, of) / F.nullif(F.size(values), F.lit(0))


def deviation(values: Column) -> Column:
    """Population standard deviation."""
    return F.aggregate(values, F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("q")), lambda a, x: F.struct((a["s"] + x).alias("s"), (a["q"] + x * x).alias("q")), lambda a: F.sqrt(F.greatest(a["q"] / F.size(values) - F.pow(a["s"] / F.size(values), 2), F.lit(0.0))))


def let(value: Column, of) -> Column:
    """of(value) with the value computed once for each row: an array of one element binds it."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def quantile(values: Column, q: float) -> Column:
    """Linear-interpolated quantile of an array without nulls."""

    def pick(ordered):
        at = (F.size(ordered) - 1) * F.lit(q)
        low = F.floor(at).cast("int")
        a, b = F.get(ordered, low), F.get(ordered, F.least(low + 1, F.size(ordered) - 1))
        return a + (b - a) * (at - low)

    return let(F.array_sort(values), pick)


def median(values: Column) -> Column:
    return quantile(values, 0.5)


def mad(values: Column, factor: float = 1.4826) -> Column:
    """Scaled median absolute deviation of an array."""
    return let(values, lambda v: let(median(v), lambda m: factor * median(F.transform(v, lambda x: F.abs(x - m)))))


def peak_phase(values: Column, first: int) -> Column:
    """Phase number of the first largest absolute value."""
    size = F.transform(values, F.abs)
    return F.array_position(size, F.array_max(size)) - 1 + first


def peak_width(values: Column, share: float = 0.8, eps: float = 1e-9) -> Column:
    """Share of the slice at or above ``share`` of the peak."""
    size = F.transform(values, F.abs)
    level = share * F.greatest(F.array_max(size), F.lit(eps))
    return F.size(F.filter(size, lambda x: x >= level)) / F.size(values)


def centred(values: Column) -> Column:
    return let(mean(values), lambda m: F.transform(values, lambda x: x - m))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def correlation_distance(values: Column, base: Column, eps: float = 1e-9) -> Column:
    """1 - correlation with a base wave; 0 for a flat base, 1 for a flat wave."""
    a, b = centred(values), centred(base)
    scale = norm(a) * norm(b)
    r = F.when(scale >= eps, dot(a, b) / scale).otherwise(0.0)
    return F.when(norm(b) < eps, 0.0).otherwise(1 - F.greatest(F.least(r, F.lit(1.0)), F.lit(-1.0)))


def cosine(a: Column, b: Column, eps: float = 1e-12) -> Column:
    scale = norm(a) * norm(b)
    return F.when(scale >= eps, dot(a, b) / scale).otherwise(0.0)


def sigmoid(x: Column, limit: float = 35.0) -> Column:
    return 1 / (1 + F.exp(-clip(x, -limit, limit)))


def logit(p: Column, eps: float = 1e-6) -> Column:
    q = clip(p, eps, 1 - eps)
    return F.log(q / (1 - q))


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(x, F.lit(high)), F.lit(low))


def positive(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0))


def mean_present(columns: list[Column], floor: bool = True) -> Column:
    """Mean of the non-null columns; null when all are (``floor`` false: the sum over all n, nulls as 0)."""
    s = sum((F.coalesce(c, F.lit(0.0)) for c in columns[1:]), F.coalesce(columns[0], F.lit(0.0)))
    n = sum((c.isNotNull().cast("int") for c in columns[1:]), columns[0].isNotNull().cast("int"))
    return F.when(n > 0, s / n) if floor else s / len(columns)


def weighted(columns: dict[str, float]) -> Column:
    parts = [F.coalesce(F.col(c), F.lit(0.0)) * w for c, w in columns.items()]
    return sum(parts[1:], parts[0])


def entropy(p: Column, eps: float = 1e-12) -> Column:
    return -total(p, lambda x: F.greatest(x, F.lit(eps)) * F.log(F.greatest(x, F.lit(eps))))


def jensen_shannon(p: Column, q: Column, eps: float = 1e-12) -> Column:
    mid = F.zip_with(p, q, lambda x, y: (x + y) / 2)
    kl = lambda a: total(F.zip_with(a, mid, lambda x, m: F.greatest(x, F.lit(eps)) * F.log(F.greatest(x, F.lit(eps)) / F.greatest(m, F.lit(eps)))))
    return (kl(p) + kl(q)) / 2


def softmax(scores: Column) -> Column:
    e = let(F.array_max(scores), lambda top: F.transform(scores, lambda x: F.exp(x - top)))
    return let(e, lambda v: let(total(v), lambda s: F.transform(v, lambda x: x / s)))


def top_contributions(columns: dict[str, Column], n: int = 3) -> Column:
    """Names of the ``n`` largest absolute contributions, ties by name, joined by semicolons."""
    rows = F.array(*(F.struct((-F.abs(F.coalesce(v, F.lit(0.0)))).alias("k"), F.lit(name).alias("name")) for name, v in sorted(columns.items())))
    return F.array_join(F.transform(F.slice(F.array_sort(rows), 1, n), lambda x: x["name"]), ";")


def signature(vector: Column) -> Column:
    return F.array_join(F.transform(vector, lambda x: F.format_string("%.12g", x)), ";")


#: Soft labels and weights of the five stages. Fixed values.
SOFT_LABELS = {1: 0.0, 2: 0.15, 3: 0.4, 4: 0.7, 5: 1.0}
SOFT_WEIGHTS = {1: 1.0, 2: 1.0, 3: 1.0, 4: 2.0, 5: 4.0}


def mapped(key: Column, values: dict) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key)


def state_region(awr: Column, bd: Column, awr_high: Column, bd_high: Column) -> Column:
    """Four regions of score and distance; thresholds belong to the high side."""
    a, b = awr >= awr_high, bd >= bd_high
    return F.when(a & b, "high_high").when(a, "high_score").when(b, "high_distance").otherwise("stable")


def event_risk(z_tes: Column, z_bd: Column, kind: str = "evidence") -> Column:
    s = 1.5 * z_tes + 0.5 * z_bd
    return sigmoid(s) if kind == "sigmoid" else 1 - F.exp(-positive(s))
