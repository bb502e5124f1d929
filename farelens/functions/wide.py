"""Integers beyond DECIMAL(38), as SQL text of Column expressions.

A wide integer is an array of DECIMAL(38,0) digits in base 10^15, least
first.  A digit may be any integer between -10^32 and 10^32, so scaled sums,
differences and products are written digit by digit; ``carry`` brings the
digits of a non-negative value into [0, 10^15), and ``is_negative`` tells a
value's sign.  Everything runs once per group, after aggregation.  The
functions take and return SQL text: one parsed expression in place of
hundreds of Column calls.
"""

from __future__ import annotations

BASE = 10**15
_B = f"{BASE}BD"
_INT = "DECIMAL(38,0)"


def integer(x: str | int) -> str:
    return f"CAST({x} AS {_INT})"


def let(value: str, var: str, body: str) -> str:
    """``body`` with ``var`` standing for ``value``, which is evaluated once."""
    return f"get(transform(array({value}), {var} -> {body}), 0)"


def low(x: str) -> str:
    """x modulo the base, never negative."""
    return integer(f"pmod({x}, {_B})")


def high(x: str) -> str:
    """floor(x / base); the dividend is a multiple of the base, so the DECIMAL division is exact."""
    return integer(f"({x} - {low(x)}) / {_B}")


def digits(*values: str) -> str:
    return f"array({', '.join(integer(v) for v in values)})"


def carry(number: str, more: int = 3) -> str:
    """Digits in [0, base) of the same value, ``more`` of them added at the top."""
    put = let(integer("x + acc.up"), "v", f"named_struct('out', concat(acc.out, array({low('v')})), 'up', {high('v')})")
    start = f"named_struct('out', CAST(array() AS ARRAY<{_INT}>), 'up', {integer(0)})"
    return f"aggregate(concat({number}, array_repeat({integer(0)}, {more})), {start}, (acc, x) -> {put}, acc -> acc.out)"


def is_negative(number: str) -> str:
    """Whether the value is below zero: what is carried out of the top digit is."""
    return f"(aggregate({number}, {integer(0)}, (up, x) -> {let(integer('x + up'), 'v', high('v'))}) < 0)"


def to_double(number: str) -> str:
    return f"aggregate(reverse({number}), 0D, (up, x) -> up * {float(BASE)}D + CAST(x AS DOUBLE))"
