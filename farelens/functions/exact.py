"""Exact decimal arithmetic for report measures.

Spark's DECIMAL division keeps a limited number of fraction digits, and
``round`` on a DOUBLE rounds the double's text.  Either can move a result
by one unit in the last place near a rounding tie, so every reported ratio
here is computed from exact sums and rounded once, half away from zero,
with integer division.  All helpers return Columns and run post-aggregation
(one value per group), so their cost does not grow with the trip count.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from farelens.functions import wide
from farelens.functions.exact_sql import q

INT = "decimal(38,0)"


def dec(value) -> Column:
    """A DECIMAL literal (never a DOUBLE)."""
    return F.lit(Decimal(str(value)))


def _int_quotient(a: Column, b: Column) -> Column:
    """floor(a / b) for a >= 0, b > 0 as DECIMAL(38,0), exact.

    ``a - a % b`` is a multiple of ``b``, so the division is exact whatever
    fraction digits Spark keeps for it.
    """
    return ((a - a % b) / b).cast(INT)


def round_ratio(num: Column, den: Column, scale: int) -> Column:
    """``num / den`` rounded half away from zero to ``scale`` places.

    Exact for any DECIMAL or integral inputs; NULL when ``den`` is 0 or
    NULL (the ``NULLIF(den, 0)`` guard of the SQL it replaces).
    """
    den = F.nullif(den, F.lit(0))
    a = F.abs(num) * dec(2 * 10**scale) + F.abs(den)
    b = F.abs(den) * dec(2)
    q = _int_quotient(a, b)
    negative = (num < 0) != (den < 0)
    signed = F.when(negative & (num != 0), -q).otherwise(q)
    if scale == 0:
        return signed
    return (signed * dec(Decimal(1).scaleb(-scale))).cast(f"decimal(38,{scale})")


def mean(col: Column, scale: int = 2) -> Column:
    """``ROUND(AVG(col), scale)`` from the exact sum (NULLs skipped)."""
    return round_ratio(F.sum(col), F.count(col), scale)


def pct_of_rows(flag: Column, scale: int = 2) -> Column:
    """``ROUND(SUM(flag) * 100 / COUNT(*), scale)``."""
    return round_ratio(F.sum(flag) * 100, F.count(F.lit(1)), scale)


def pct_mean(col: Column, scale: int = 2) -> Column:
    """``ROUND(AVG(col) * 100, scale)`` (NULLs skipped)."""
    return round_ratio(F.sum(col) * 100, F.count(col), scale)


def ratio_cmp(num: Column, den: Column, op: str, k) -> Column:
    """Exact ``num / den <op> k`` without dividing; NULL when ``den`` is 0/NULL.

    Used by ladders that test an unrounded ratio.
    """
    k = dec(k)
    pos = {">=": num >= k * den, ">": num > k * den, "<": num < k * den, "<=": num <= k * den}[op]
    neg = {">=": num <= k * den, ">": num < k * den, "<": num > k * den, "<=": num >= k * den}[op]
    return F.when(den > 0, pos).when(den < 0, neg)


# --- population standard deviation from exact integer sums ------------------

#: Bits of a digit of a sum: 10^14 rows of such digits stay within a LONG.
_DIGIT = 16


def _low(x: Column) -> Column:
    return x.bitwiseAND(F.lit((1 << _DIGIT) - 1).cast("long"))


def _high(x: Column) -> Column:
    return F.shiftright(x, _DIGIT)


def _digit_sums(digits: list[Column]) -> Column:
    """SUM of each digit as ARRAY<LONG>, least first; NULL where no row counts."""
    return F.array(*[F.sum(d) for d in digits])


def sum_digits(units_col: Column) -> Column:
    """Digit sums of SUM(x) of a LONG column with |x| < 2^48; the top digit is signed."""
    x = units_col
    return _digit_sums([_low(x), _low(_high(x)), _high(_high(x))])


def square_digits(units_col: Column) -> Column:
    """Digit sums of SUM(x * x) of a LONG column with |x| < 2^48.

    |x| = a2 a1 a0 in digits of 16 bits; the square's six digits are carried
    per row, in LONGs, so each sum grows by less than 2^16 a row.
    """
    x = F.abs(units_col)
    a0, a1, a2 = _low(x), _low(_high(x)), _high(_high(x))
    v0 = a0 * a0
    v1 = _high(v0) + a0 * a1 * 2
    v2 = _high(v1) + a0 * a2 * 2 + a1 * a1
    v3 = _high(v2) + a1 * a2 * 2
    v4 = _high(v3) + a2 * a2
    return _digit_sums([_low(v0), _low(v1), _low(v2), _low(v3), _low(v4), _high(v4)])


def add_digits(digits: Column, length: int) -> Column:
    """Digit sums of several groups (rows of a state) added up."""
    return F.array(*[F.sum(F.get(digits, F.lit(k))) for k in range(length)])


SUM_DIGITS, SQUARE_DIGITS = 3, 6


def moment_aggs(units_col: Column, prefix: str) -> list[Column]:
    """count, sum and sum of squares of a LONG-unit column; per-row work is all on LONGs, exact to 10^14 rows a group."""
    return [
        F.count(units_col).alias(f"{prefix}_n"),
        sum_digits(units_col).alias(f"{prefix}_s"),
        square_digits(units_col).alias(f"{prefix}_ss"),
    ]


def digits_sql(digits: str, length: int, first: int = 0) -> str:
    """The number that ``length`` digit sums from ``first`` on stand for, as DECIMAL(38,0)."""
    parts = [f"CAST(get({digits}, {first + k}) AS DECIMAL(20,0)) * {1 << (_DIGIT * k)}BD" for k in range(length)]
    return f"CAST({' + '.join(parts)} AS DECIMAL(38,0))"


def digits_value(name: str, length: int) -> Column:
    """The number behind a column of digit sums (a sum, or squares below 10^38)."""
    return F.expr(digits_sql(q(name), length))


def _scaled_root(n: str, s: str, ss: str, d: str, mult: int) -> str:
    """round_half_up(mult * sqrt(n * ss - s^2) / d) for d > 0, exact; all SQL text.

    ``n * ss - s^2`` is n^2 times the population variance.  A double estimate
    is corrected by at most one using the exact test
    ``((2m-1)d)^2 <= 4 mult^2 v < ((2m+1)d)^2`` in wide integers, which holds
    for results below 10^14.
    """
    w, shift = wide, f"{1 << (3 * _DIGIT)}BD"
    # Squares: digit sums 0-2 and 3-5 as two numbers, then five digits of base 10^15.
    squares = w.let(digits_sql(ss, 3, 3), "h", w.carry(w.digits(f"{digits_sql(ss, 3)} + {w.low('h')} * {shift}", f"{w.high('h')} * {shift}")))
    parts = f"named_struct('n', CAST({n} AS DECIMAL(20,0)), 's0', {w.low('a')}, 's1', {w.high('a')}, 'q', {squares})"
    own = [f"get(t.q, {k}) * t.n" for k in range(4)]
    v = w.carry(w.digits(f"{own[0]} - t.s0 * t.s0", f"{own[1]} - t.s0 * t.s1 * 2BD", f"{own[2]} - t.s1 * t.s1", own[3]), 1)
    variance = w.let(f"abs({digits_sql(s, SUM_DIGITS)})", "a", w.let(parts, "t", v))
    four_v = f"transform({variance}, x -> {w.integer(f'x * {4 * mult * mult}BD')})"

    def above(odd: str) -> str:
        """(odd * d)^2 > four_v."""
        x0, x1, x2 = (f"get(x, {k})" for k in range(3))
        square = [f"{x0} * {x0}", f"{x0} * {x1} * 2BD", f"{x0} * {x2} * 2BD + {x1} * {x1}", f"{x1} * {x2} * 2BD", f"{x2} * {x2}"]
        gap = w.is_negative(w.digits(*[f"coalesce(get(r.v, {k}), 0BD) - ({y})" for k, y in enumerate(square)]))
        return w.let(w.carry(w.digits(f"{w.low('r.d')} * {odd}", f"{w.high('r.d')} * {odd}"), 1), "x", gap)

    estimate = f"CAST(floor(sqrt({w.to_double('r.v')}) / 2D / CAST(r.d AS DOUBLE) + 0.5D) AS DECIMAL(20,0))"
    nearest = f"CASE WHEN NOT {above('(m * 2BD + 1BD)')} THEN m + 1BD WHEN m >= 1 AND {above('(m * 2BD - 1BD)')} THEN m - 1BD ELSE m END"
    return w.let(f"named_struct('v', {four_v}, 'd', {w.integer(d)})", "r", w.let(estimate, "m", w.integer(nearest)))


def stddev_pop_rounded(n: str, s: str, ss: str, unit_scale: int = 2) -> Column:
    """``ROUND(STDDEV_POP(x), unit_scale)`` from the named moment columns (``moment_aggs``)."""
    n, s, ss = q(n), q(s), q(ss)
    m = F.expr(f"CASE WHEN {n} > 0 THEN {_scaled_root(n, s, ss, n, 1)} END")
    return (m * dec(Decimal(1).scaleb(-unit_scale))).cast(f"decimal(38,{unit_scale})")


def cv_pct_rounded(n: str, s: str, ss: str, scale: int = 1) -> Column:
    """``ROUND(STDDEV_POP(x) / NULLIF(AVG(x), 0) * 100, scale)`` from the named moment columns.

    sigma / mean = sqrt(n*ss - s^2) / s, so only the sum's sign and size matter.
    """
    n, s, ss = q(n), q(s), q(ss)
    total = digits_sql(s, SUM_DIGITS)
    root = _scaled_root(n, s, ss, f"abs({total})", 100 * 10**scale)
    m = F.expr(f"CASE WHEN {n} > 0 AND {total} <> 0 THEN (CASE WHEN {total} < 0 THEN -1BD ELSE 1BD END) * {root} END")
    return (m.cast(INT) * dec(Decimal(1).scaleb(-scale))).cast(f"decimal(38,{scale})")


# --- per-row integer helpers ------------------------------------------------
#
# Per-row values stay in LONG units (cents, 1/1000 mile, seconds) so the
# arithmetic is primitive: DECIMAL(38) division costs ~15x a LONG ``div``.


def ldiv(a: Column, b) -> Column:
    """Integral division of LONGs, truncating toward zero (SQL ``div``)."""
    return F.call_function("div", a, b if isinstance(b, Column) else F.lit(b))


def idiv(a: Column, b: int) -> Column:
    """floor(a / b) for a >= 0 and constant b > 0."""
    return ldiv(a, F.lit(b).cast("long"))


def lround(num: Column, den) -> Column:
    """LONG ``num / den`` rounded half away from zero (``den`` must be non-zero)."""
    den = den if isinstance(den, Column) else F.lit(den).cast("long")
    q = ldiv(F.abs(num) * 2 + F.abs(den), F.abs(den) * 2)
    return F.when((num < 0) != (den < 0), -q).otherwise(q)


def cents_of(x: Column) -> Column:
    """A DOUBLE amount with at most 2 decimals as exact integer cents."""
    return F.rint(x * F.lit(100.0)).cast("long")


def rate_scale(*rates) -> int:
    """Decimal places needed to hold every rate as an integer (at least cents)."""
    return max([2] + [max(0, -Decimal(str(r)).normalize().as_tuple().exponent) for r in rates])


def to_units(x: Column, scale: int) -> Column:
    """A DECIMAL with at most ``scale`` fraction digits as a LONG count of 10^-scale.

    Goes through DOUBLE, which Spark reads straight from a compact decimal:
    exact while |x| * 10^scale < 2^53 (about $90 trillion in cents).
    Multiplying the DECIMAL instead would run BigDecimal code per row.
    """
    return F.rint(x.cast("double") * F.lit(float(10**scale))).cast("long")


def from_units(units_col: Column, scale: int, precision: int = 12) -> Column:
    """A LONG count of 10^-scale units as DECIMAL(precision, scale).

    The product stays within 18 digits, so Spark keeps it in a long.
    """
    return (units_col.cast(f"decimal({18 - scale - 1},0)") * dec(Decimal(1).scaleb(-scale))).cast(
        f"decimal({precision},{scale})"
    )


def money(cents: Column) -> Column:
    """Integer cents as DECIMAL(12,2)."""
    return from_units(cents, 2, 12)
