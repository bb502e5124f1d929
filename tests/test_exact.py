"""Exact rounding helpers against Python Decimal (many cases per Spark job)."""

from __future__ import annotations

import math
import random
from decimal import ROUND_HALF_UP, Decimal, getcontext

from pyspark.sql import functions as F

from farelens.functions import wide
from farelens.functions.exact import (
    SQUARE_DIGITS,
    SUM_DIGITS,
    cv_pct_rounded,
    digits_value,
    lround,
    moment_aggs,
    ratio_cmp,
    round_ratio,
    square_digits,
    stddev_pop_rounded,
    sum_digits,
)
from farelens.functions.exact_sql import round_ratio_sql

getcontext().prec = 60


def half_up(x: Decimal, scale: int) -> Decimal:
    return x.quantize(Decimal(1).scaleb(-scale), rounding=ROUND_HALF_UP)


def test_round_ratio_matches_decimal(spark):
    rng = random.Random(7)
    cases = []
    for _ in range(3000):
        den = rng.choice([rng.randint(1, 50), rng.randint(1, 10**6), -rng.randint(1, 1000)])
        q = rng.randint(-(10**6), 10**6)
        # plenty of exact ties: num = (q + 0.5) * den / 10^scale style
        num = rng.choice([rng.randint(-(10**9), 10**9), q * den + den // 2, q * den - den // 2])
        cases.append((num, den))
    cases += [(0, 5), (5, 0), (1, 8), (-1, 8), (3, 8), (-3, 8)]
    df = spark.createDataFrame(cases, "num long, den long")
    out = df.select(
        "num",
        "den",
        round_ratio(F.col("num"), F.col("den"), 2).alias("r2"),
        round_ratio(F.col("num"), F.col("den"), 0).alias("r0"),
        F.when(F.col("den") != 0, lround(F.col("num"), F.col("den"))).alias("l0"),
        ratio_cmp(F.col("num"), F.col("den"), ">=", Decimal("1.5")).alias("ge"),
        F.expr(round_ratio_sql("num", "den", 2)).alias("s2"),
        F.expr(round_ratio_sql("num", "den", 0)).alias("s0"),
        F.expr(round_ratio_sql("num", "den", 3)).alias("s3"),
    ).collect()
    for r in out:
        if r["den"] == 0:
            assert r["r2"] is None and r["ge"] is None and r["s2"] is None
            continue
        exact = Decimal(r["num"]) / Decimal(r["den"])
        assert r["s2"] == half_up(exact, 2) and r["s0"] == half_up(exact, 0) and r["s3"] == half_up(exact, 3)
        assert r["r2"] == half_up(exact, 2), (r["num"], r["den"])
        assert r["r0"] == half_up(exact, 0)
        assert r["l0"] == int(half_up(exact, 0))
        assert r["ge"] == (exact >= Decimal("1.5"))


def _exact_sd_cv(values):
    n = len(values)
    s = sum(values)
    ss = sum(v * v for v in values)
    v = Decimal(n * ss - s * s)
    sd = v.sqrt() / n  # cents
    sd_r = half_up(sd, 0) / 100
    cv = None if s == 0 else (Decimal(1000) * v.sqrt() / abs(s))
    cv_r = None if cv is None else (half_up(cv, 0) / 10) * (1 if s > 0 else -1)
    return sd_r, cv_r


def test_stddev_and_cv_match_decimal(spark):
    rng = random.Random(11)
    groups = []
    for g in range(400):
        n = rng.choice([1, 2, 3, 7, 30, 200])
        base = rng.choice([100, 1500, 99999, 10**7])
        vals = [rng.randint(-base // 10, base) for _ in range(n)]
        if g % 5 == 0:
            vals = [vals[0]] * n  # zero variance
        groups += [(g, v) for v in vals]
    df = spark.createDataFrame(groups, "g int, c long")
    agg = df.groupBy("g").agg(*moment_aggs(F.col("c"), "x"))
    res = agg.select(
        "g",
        stddev_pop_rounded("x_n", "x_s", "x_ss").alias("sd"),
        cv_pct_rounded("x_n", "x_s", "x_ss").alias("cv"),
    ).collect()
    by_g = {}
    for g, c in groups:
        by_g.setdefault(g, []).append(c)
    for r in res:
        sd, cv = _exact_sd_cv(by_g[r["g"]])
        assert r["sd"] == sd, (r["g"], r["sd"], sd)
        assert (r["cv"] is None and cv is None) or r["cv"] == cv, (r["g"], r["cv"], cv)
    assert not math.isnan(0.0)


def test_digit_sums_are_exact_for_any_money(spark):
    values = [0, 1, -1, (1 << 20) - 1, 1 << 20, -(1 << 20) - 7, 2_345_678_901, -(10**12) + 1, 10**12 - 1, (1 << 48) - 1, None]
    df = spark.createDataFrame([(v,) for v in values], "x long")
    aggs = [sum_digits(F.col("x")).alias("s"), square_digits(F.col("x")).alias("ss")]
    s, ss = (list(v) for v in df.agg(*aggs).first())
    known = [v for v in values if v is not None]
    assert sum(d << (16 * k) for k, d in enumerate(s)) == sum(known)
    assert sum(d << (16 * k) for k, d in enumerate(ss)) == sum(v * v for v in known)
    assert len(s) == SUM_DIGITS and len(ss) == SQUARE_DIGITS
    assert df.agg(*aggs).select(digits_value("s", SUM_DIGITS)).first()[0] == sum(known)
    assert df.where("x is null").agg(*aggs).select(digits_value("ss", SQUARE_DIGITS)).first()[0] is None


def _digits(value: int, length: int) -> list[int]:
    """A total as digit sums: any split into LONGs stands for the same number."""
    out = []
    for _ in range(length - 1):
        out.append(value & 0xFFFF)
        value >>= 16
    return [*out, value]


def test_moments_of_many_rows_match_python_integers(spark):
    """Groups of up to 10^14 rows: products and comparisons beyond 38 digits."""
    rng = random.Random(19)
    rows = []
    for g in range(150):
        n = rng.choice([10**9, 2 * 10**9 + 1, 10**12, 10**14, rng.randint(1, 10**14)])
        mean = rng.choice([1, 150, 2500, 10**6, 10**9, 10**10])
        s = n * mean + rng.randint(0, n - 1)
        least = -(-s * s // n)  # sum of squares is at least s^2 / n
        ss = least + rng.choice([0, 1, n * rng.randint(0, mean * mean // 4 + 10), n * rng.randint(0, 1000)])
        if g % 4 == 0:
            s = -s
        rows.append((g, n, s, ss))
    table = [(g, n, _digits(s, SUM_DIGITS), _spread(ss, rng)) for g, n, s, ss in rows]
    df = spark.createDataFrame(table, "g int, n long, s array<long>, ss array<long>")
    cols = "n", "s", "ss"
    got = {r.g: r for r in df.select("g", stddev_pop_rounded(*cols).alias("sd"), cv_pct_rounded(*cols).alias("cv")).collect()}
    assert any(n * ss > 10**45 for _, n, _, ss in rows)
    for g, n, s, ss in rows:
        v = n * ss - s * s
        assert got[g].sd == Decimal(_round_root(v, n, 1)).scaleb(-2)
        assert got[g].cv == Decimal(_round_root(v, abs(s), 1000)).scaleb(-1) * (1 if s > 0 else -1)


def _spread(value: int, rng) -> list[int]:
    """Digit sums as they come out of 10^14 rows: far above one digit's 16 bits."""
    out = []
    for _ in range(SQUARE_DIGITS - 1):
        more = rng.randrange(1 << 46)
        digit = value & 0xFFFF
        take = min(more, value >> 16)
        out.append(digit + (take << 16))
        value = (value >> 16) - take
    return [*out, value]


def _round_root(v: int, d: int, mult: int) -> int:
    """round_half_up(mult * sqrt(v) / d) in integers."""
    m = math.isqrt(mult * mult * v // (d * d))
    return m + ((2 * m + 1) ** 2 * d * d <= 4 * mult * mult * v)


def test_wide_integers(spark):
    rng = random.Random(23)
    rows = [[rng.choice([-1, 1]) * rng.randrange(10 ** rng.randint(1, 32)) for _ in range(5)] for _ in range(300)]
    rows += [[0] * 5, [-1, 0, 0, 0, 0], [0, 0, 0, 0, -1], [-(10**30), 10**15, 0, 0, 0], [10**31] * 5]
    df = spark.createDataFrame([([Decimal(v) for v in r],) for r in rows], "x array<decimal(38,0)>")
    out = df.select("x", *[F.expr(f("x")).alias(n) for n, f in (("c", wide.carry), ("n", wide.is_negative), ("f", wide.to_double))]).collect()
    for r in out:
        value = sum(int(v) * wide.BASE**k for k, v in enumerate(r.x))
        assert r.n == (value < 0)
        assert math.isclose(r.f, float(value), rel_tol=1e-12, abs_tol=1e-3)
        if value >= 0:
            assert all(0 <= v < wide.BASE for v in r.c) and sum(int(v) * wide.BASE**k for k, v in enumerate(r.c)) == value
