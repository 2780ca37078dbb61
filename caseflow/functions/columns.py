"""Reusable column expressions (all JVM-side, inside whole-stage codegen)."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

US_PER_DAY = 86_400_000_000.0


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def micros(ts) -> Column:
    """Timestamp -> microseconds since the epoch (session time zone is UTC)."""
    return F.unix_micros(col(ts).cast("timestamp"))


def days_between_us(a_us, b_us) -> Column:
    """(b - a) in float days from two microsecond longs."""
    return (col(b_us) - col(a_us)) / F.lit(US_PER_DAY)


def isclose_le(x, bound: float, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    """``x < bound or isclose(x, bound)`` with numpy's default tolerances."""
    return (col(x) < F.lit(bound)) | (F.abs(col(x) - F.lit(bound)) <= F.lit(atol + rtol * abs(bound)))


def isclose(a, b, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    """numpy ``isclose(a, b)``: |a-b| <= atol + rtol*|b|."""
    return F.abs(col(a) - col(b)) <= F.lit(atol) + F.lit(rtol) * F.abs(col(b))


def log_sum_exp(arr) -> Column:
    """log(sum(exp(x))) of an array<double>, stabilised by the array maximum."""
    a = col(arr)
    m = F.array_max(a)
    return m + F.log(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + F.exp(x - m)))


def log_softmax_at(arr, idx) -> Column:
    """log softmax(arr)[idx] with 0-based idx."""
    return F.element_at(col(arr), col(idx) + 1).cast("double") - log_sum_exp(col(arr))


def argmax_index(arr) -> Column:
    """0-based index of the maximum; the first maximum wins."""
    a = col(arr)
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def sinusoid_encoding(t, d: int, base: float = 10000.0) -> Column:
    """even dims sin(t*f_i), odd dims cos(t*f_i), f_i = exp(-ln(base)*2i/d)."""
    half = d // 2
    freqs = F.transform(F.sequence(F.lit(0), F.lit(half - 1)),
                        lambda i: F.exp(F.lit(-math.log(base)) * (F.lit(2.0) * i) / F.lit(float(d))))
    pairs = F.transform(freqs, lambda f: F.array(F.sin(col(t) * f), F.cos(col(t) * f)))
    return F.flatten(pairs)


def p_stars(p) -> Column:
    """Significance stars."""
    return (F.when(col(p) < 0.001, "***").when(col(p) < 0.01, "**")
            .when(col(p) < 0.05, "*").otherwise(""))


def one_row(df) -> dict:
    """The single row of a global aggregate as a dict (a handful of scalars)."""
    row = df.first()
    return row.asDict() if row is not None else {}


def combine_scalars(frames, types: dict | None = None):
    """Put the columns of several one-row frames side by side without a join:
    each frame is unpivoted to (name, value), the parts are unioned and
    pivoted back to one row.  ``types`` casts columns back (default double)."""
    types = types or {}
    longs, names = [], []
    for df in frames:
        cols = df.columns
        names += cols
        longs.append(df.select(F.explode(F.array(*[
            F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in cols])).alias("s"))
            .select("s.*"))
    allp = reduce(lambda a, b: a.unionByName(b), longs)
    wide = allp.groupBy().pivot("name", names).agg(F.first("value"))
    return wide.select(*[F.col(f"`{n}`").cast(types.get(n, "double")).alias(n) for n in names])


# Coefficients of the series of Gamma(z + 1/2) / (Gamma(z) sqrt(z)) in 1 / z.
_HALF_STEP = (1, -1 / 8, 1 / 128, 5 / 1024, -21 / 32768, -399 / 262144, 869 / 4194304, 39325 / 33554432)
_SHIFT = 16
_NEAR, _FAR = 60, 40    # steps of the continued fractions for t below 2 and above


def _half_step(a: Column) -> Column:
    """Gamma(a + 1/2) / Gamma(a) for a >= 1/2, from the series at a + 16."""
    z = a + F.lit(float(_SHIFT))
    series = reduce(lambda acc, c: acc / z + F.lit(float(c)), reversed(_HALF_STEP), F.lit(0.0))
    down = reduce(lambda acc, i: acc * (a + F.lit(float(i))) / (a + F.lit(i + 0.5)), range(_SHIFT), F.lit(1.0))
    return down * F.sqrt(z) * series


def student_two_sided(t, dof) -> Column:
    """Two-sided p of Student's t: the regularised incomplete beta function
    I(dof / (dof + t^2); dof / 2, 1/2) by continued fractions of a fixed number of steps.

    From t = 2 on the tail itself is expanded (its even part), so no digits are lost
    however small it is; below, its complement."""
    t, dof = F.abs(col(t).cast("double")), col(dof).cast("double")
    a, b = dof / 2, 0.5
    y = t * t / (dof + t * t)
    x = dof / (dof + t * t)
    front = F.exp(a * F.log1p(-y)) * F.sqrt(y) * _half_step(a) / F.lit(math.sqrt(math.pi))

    def backwards(steps):
        return F.sequence(F.lit(steps), F.lit(1), F.lit(-1))

    # I_x(a, b): terms alpha_n / (beta_n + ...), with lam = a - (a + b) x
    lam = a * y - b * x

    def beta(n):
        return n + n * (b - n) * x / (a + 2 * n - 1) + (a + n) / (a + 2 * n + 1) * (lam + 1 + n * (1 + y))

    def far(acc, n):
        alpha = (a + n - 1) * (a + b + n - 1) * n * (b - n) * x * x / ((a + 2 * n - 1) * (a + 2 * n - 1))
        return F.when(n > 1, beta(n - 1)).otherwise(a / (a + 1) * (lam + 1)) + alpha / acc

    # I_y(b, a): 1 / (1 + d_1 / (1 + d_2 / ...))
    def near(acc, k):
        m = F.floor(k / 2)
        even = m * (a - m) * y / ((b + 2 * m - 1) * (b + 2 * m))
        odd = -(b + m) * (a + b + m) * y / ((b + 2 * m) * (b + 2 * m + 1))
        return F.lit(1.0) + F.when(k % 2 == 0, even).otherwise(odd) / acc

    tail = front / F.aggregate(backwards(_FAR), beta(F.lit(float(_FAR))), far)
    inside = 2 * front / F.aggregate(backwards(_NEAR), F.lit(1.0), near)
    return F.when(t >= 2, tail).otherwise(F.greatest(F.lit(0.0), 1 - inside))
