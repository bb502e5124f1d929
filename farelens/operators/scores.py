"""Min-max normalised scores and weighted composites over grouped rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from farelens.functions.exact import dec, round_ratio


def minmax_scores(groups: DataFrame, specs: Sequence[tuple[str, str, bool]], scale: int = 1) -> DataFrame:
    """Add ``(x - min) / NULLIF(max - min, 0) * 100`` per spec (or ``max - x`` when inverted).

    ``specs``: (input column, output column, inverted).  The min and max run
    over the whole input, which must already be grouped (zones, segments):
    its row count is bounded by the dimension, never by the trip count.
    All-equal inputs give NULL, as the NULLIF guard does.
    """
    everyone = Window.partitionBy()
    cols: list[Column] = []
    for src, out, inverted in specs:
        x = F.col(src)
        lo, hi = F.min(x).over(everyone), F.max(x).over(everyone)
        num = (hi - x) if inverted else (x - lo)
        cols.append(round_ratio(num * 100, hi - lo, scale).alias(out))
    return groups.select("*", *cols)


def weighted_sum(columns: Sequence[str], weights: Sequence, scale: int = 1) -> Column:
    """ROUND(sum(w_i * x_i), scale) in exact DECIMAL arithmetic; NULL if any x_i is."""
    total = None
    for name, w in zip(columns, weights):
        term = F.col(name) * dec(w)
        total = term if total is None else total + term
    return F.round(total, scale)
