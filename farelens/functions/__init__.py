"""Column builders: exact rounding, ratios, moments, integer units and ladders."""

from farelens.functions.exact import (  # noqa: F401
    cents_of,
    cv_pct_rounded,
    dec,
    from_units,
    idiv,
    lround,
    mean,
    moment_aggs,
    money,
    pct_mean,
    pct_of_rows,
    rate_scale,
    ratio_cmp,
    round_ratio,
    stddev_pop_rounded,
    to_units,
)
from farelens.functions.ladders import airport_label, band, category_position, ladder  # noqa: F401
