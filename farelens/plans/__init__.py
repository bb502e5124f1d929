"""Report plans: each is ``f(enriched: DataFrame, params: Params) -> DataFrame``."""

from __future__ import annotations

from farelens.plans.congestion import cbd_zone_footprint, congestion_by_borough, congestion_by_distance
from farelens.plans.corridors import airport_segment, borough_matrix, top_corridors
from farelens.plans.deciles import fare_decile_margin, fare_deciles_report
from farelens.plans.demand import borough_demand, borough_time_demand
from farelens.plans.holiday import daily_revenue_trend, peak_vs_trough
from farelens.plans.market import market_position
from farelens.plans.opportunity import wav_gap, zone_opportunity
from farelens.plans.pay import (
    pay_compliance_borough,
    pay_compliance_distance,
    pay_compliance_platform,
    pay_compliance_time,
)
from farelens.plans.pricing import airport_fee_structure, borough_fee_burden, price_decomposition
from farelens.plans.quality import growth_quality, platform_quality
from farelens.plans.volatility import borough_volatility, late_night_volatility, zone_volatility

REPORTS = {
    f.__name__: f
    for f in (
        market_position,
        borough_demand,
        borough_time_demand,
        top_corridors,
        airport_segment,
        borough_matrix,
        fare_decile_margin,
        fare_deciles_report,
        price_decomposition,
        borough_fee_burden,
        airport_fee_structure,
        pay_compliance_platform,
        pay_compliance_borough,
        pay_compliance_time,
        pay_compliance_distance,
        congestion_by_borough,
        congestion_by_distance,
        cbd_zone_footprint,
        daily_revenue_trend,
        peak_vs_trough,
        zone_volatility,
        borough_volatility,
        late_night_volatility,
        zone_opportunity,
        wav_gap,
        growth_quality,
        platform_quality,
    )
}
