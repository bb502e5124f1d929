"""Classification ladders and category helpers as plain Column expressions."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def ladder(rungs: Iterable[tuple[Column, object]], default=None) -> Column:
    """Fold ``[(predicate, value), ...]`` into ``CASE WHEN ... ELSE default END``.

    First match wins; a NULL predicate does not match, so NULL inputs fall
    through to ``default``, exactly like SQL ``CASE``.
    """
    expr = None
    for pred, value in rungs:
        value = value if isinstance(value, Column) else F.lit(value)
        expr = F.when(pred, value) if expr is None else expr.when(pred, value)
    if expr is None:
        return F.lit(default)
    return expr.otherwise(default if isinstance(default, Column) else F.lit(default))


def band(col: Column, bands: Sequence[tuple[object, str]], rest: str) -> Column:
    """``col < b1 -> l1, col < b2 -> l2, ..., else rest`` (distance bands)."""
    return ladder(((col < F.lit(bound), label) for bound, label in bands), rest)


def category_position(col: Column, order: Sequence[str]) -> Column:
    """1-based position of ``col`` in ``order``; 0 when absent (MySQL ``FIELD``)."""
    return F.array_position(F.array(*[F.lit(v) for v in order]), col)


def airport_label(flag: Column, airport: str, other: str) -> Column:
    return F.when(flag == 1, F.lit(airport)).otherwise(F.lit(other))
