"""SQL-text forms of the hot exact-rounding helpers.

Same arithmetic and literal types as ``exact.round_ratio`` and
``exact.to_units``; a measure becomes one ``F.expr`` instead of dozens of
Column calls, which keeps plan construction cheap when a report has many
measures.  Inputs are SQL expressions; column names must be quoted by the
caller (``q(name)``).
"""

from __future__ import annotations


def q(name: str) -> str:
    """A backquoted column reference."""
    return "`" + name.replace("`", "``") + "`"


def units_sql(name: str, scale: int) -> str:
    """LONG count of 10^-scale units of a DECIMAL column (see ``exact.to_units``)."""
    return f"CAST(rint(CAST({q(name)} AS DOUBLE) * {float(10**scale)}D) AS BIGINT)"


def round_ratio_sql(num: str, den: str, scale: int) -> str:
    """``num / den`` rounded half away from zero to ``scale`` places; NULL if den is 0/NULL."""
    d = f"nullif(({den}), 0)"
    a = f"(abs({num}) * {2 * 10**scale}BD + abs({d}))"
    b = f"(abs({d}) * 2BD)"
    quotient = f"CAST(({a} - {a} % {b}) / {b} AS DECIMAL(38,0))"
    signed = f"(CASE WHEN ((({num}) < 0) <> ({d} < 0)) AND ({num}) <> 0 THEN -{quotient} ELSE {quotient} END)"
    if scale == 0:
        return signed
    return f"CAST({signed} * 0.{'0' * (scale - 1)}1BD AS DECIMAL(38,{scale}))"
