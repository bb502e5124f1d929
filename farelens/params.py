"""Parameters of the trip-margin analytics.

Every threshold, band, label and weight the reports use lives here, so a
binding (a different source, another month, other pay rules) can swap them
without touching the operators.  Defaults are the values the original
analysis used.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from decimal import Decimal

# ---------------------------------------------------------------------------
# Labels, cut-offs, rates and weights that must equal the
# original analysis for results to match.  Kept together, in natural order.
# ---------------------------------------------------------------------------

PLATFORM_LABELS = (("HV0003", "Uber"), ("HV0005", "Lyft"))
OTHER_PLATFORM_LABEL = "Other"

# (label, first hour, last hour); any other hour is the default bucket.
TIME_BUCKETS = (
    ("AM Rush", 6, 9),
    ("Midday", 10, 15),
    ("PM Rush", 16, 19),
    ("Evening", 20, 22),
)
DEFAULT_TIME_BUCKET = "Late Night"
TIME_BUCKET_ORDER = ("AM Rush", "Midday", "PM Rush", "Evening", "Late Night")

MAX_WAIT_SECONDS = 7200
SLA_SECONDS = 300

PAY_PER_MILE = Decimal("0.82")
PAY_PER_MINUTE = Decimal("0.57")

# (upper bound in miles, exclusive; label); the last label takes the rest.
PAY_DISTANCE_BANDS = (
    (1, "Under 1 mile"),
    (2, "1 to 2 miles"),
    (3, "2 to 3 miles"),
    (5, "3 to 5 miles"),
)
PAY_DISTANCE_REST = "5 plus miles"

CONGESTION_DISTANCE_BANDS = (
    (1, "Under 1 mile"),
    (2, "1 to 2 miles"),
    (3, "2 to 3 miles"),
    (5, "3 to 5 miles"),
    (10, "5 to 10 miles"),
)
CONGESTION_DISTANCE_REST = "10 plus miles"

AIRPORT_LABEL = "Airport"
NON_AIRPORT_LABEL = "Non-Airport"

# Minimum group sizes and top-k sizes of the reports.
MIN_TRIPS_CORRIDOR = 50
MIN_TRIPS_ZONE_VOLATILITY = 30
MIN_TRIPS_OPPORTUNITY = 50
MIN_TRIPS_SEGMENT = 30
TOP_CORRIDORS = 20
TOP_BOROUGH_PAIRS = 25
TOP_CBD_ZONES = 20
TOP_VOLATILE_ZONES = 40
TOP_OPPORTUNITY_ZONES = 30

FARE_TILES = 10

# Opportunity composite weights: volume, fare, SLA gap, wait gap.
OPPORTUNITY_WEIGHTS = (Decimal("0.30"), Decimal("0.25"), Decimal("0.30"), Decimal("0.15"))

# Holiday calendar of the daily trend: month, then day labels.
HOLIDAY_MONTH = 12
PEAK_DAY_LABEL = "PEAK DAY"
TROUGH_DAY = (25, "CHRISTMAS TROUGH")
RECOVERY_DAY = (26, "RECOVERY START")
EVE_DAYS = ((24, 31), "HOLIDAY EVE")

# Service status (SLA %, unrounded): below 50, below 58, else.
SERVICE_STATUS = ((50, "UNDERSERVED"), (58, "AT RISK"), "ADEQUATE")
# Margin health (mean per-trip take rate, unrounded): at least 20, 10, 0, else.
MARGIN_HEALTH = ((20, "HEALTHY"), (10, "MODERATE"), (0, "THIN"), "LOSS MAKING")
# Pay compliance (violation %, unrounded): at least 1.0, at least 0.5, above 0, else.
COMPLIANCE_STATUS = ((Decimal("1.0"), "HIGH RISK"), (Decimal("0.5"), "MODERATE"), (0, "LOW"), "COMPLIANT")
# Congestion equity (burden %, unrounded): at least 10, at least 5, else.
EQUITY_STATUS = ((10, "HIGH BURDEN"), (5, "MODERATE BURDEN"), "LOW BURDEN")
# Volatility class (CV %, rounded to 1 dp): at least 60, at least 35, else.
VOLATILITY_CLASS = ((60, "HIGH VOLATILITY"), (35, "MODERATE VOLATILITY"), "STABLE")
# Entry signal: CV < 35, trips >= 100, SLA < 58; or CV >= 60 and SLA < 55.
ENTRY_SIGNAL = (
    (35, 100, 58, "ENTRY OPPORTUNITY"),
    (60, 55, "VOLATILE AND UNDERSERVED"),
    "STANDARD",
)
# Entry recommendation (opportunity score): at least 60, at least 40, else.
ENTRY_RECOMMENDATION = ((60, "STRONG ENTRY TARGET"), (40, "MONITOR"), "INCUMBENT DEFENDED")
WAV_STATUS = ("WAV DEMAND UNMET", "WAV SUPPRESSED", "WAV SERVED")
WAV_INTERPRETATION = (
    "SUPPRESSED DEMAND -- accessibility gap likely",
    "REQUESTS UNMET -- fulfillment failure",
    "PARTIALLY SERVED",
)
# Segment scores, 0-25 each.  Margin: (take rate >=, negative share <, points).
MARGIN_SCORE = ((20, 5, 25), (15, 10, 20), (10, 15, 15), (5, None, 10), (0, None, 5), 0)
# Service: (SLA % >=, mean wait <=, points).
SERVICE_SCORE = (
    (65, Decimal("4.5"), 25),
    (60, Decimal("5.0"), 20),
    (55, Decimal("5.5"), 15),
    (50, None, 10),
    (40, None, 5),
    0,
)
# Compliance: violation % = 0 -> 25, then (below, points).
COMPLIANCE_SCORE = (25, (Decimal("0.25"), 20), (Decimal("0.5"), 15), (Decimal("1.0"), 10), (Decimal("2.0"), 5), 0)
# Stability: (CV % below, points), else 5.
STABILITY_SCORE = ((30, 25), (45, 20), (60, 15), (75, 10), 5)
# Strategic verdict on the 0-100 total: at least 80, 60, 40, else.
STRATEGIC_VERDICT = ((80, "SUSTAINABLE"), (60, "SOLID"), (40, "FRAGILE"), "VULNERABLE")
SUSTAINABLE_CUTOFF = 80
VULNERABLE_CUTOFF = 40

# Constant section tags of each report.
SECTIONS = {
    "borough_demand": "Borough Summary",
    "borough_time_demand": "Borough x Time",
    "top_corridors": "Top Corridors",
    "airport_segment": "Airport Segment",
    "borough_matrix": "Borough Matrix",
    "fare_decile_margin": "Decile Summary",
    "price_decomposition": "Platform Decomposition",
    "borough_fee_burden": "Borough Fee Burden",
    "airport_fee_structure": "Airport Fee Structure",
    "pay_compliance_platform": "Platform Summary",
    "pay_compliance_borough": "Borough Breakdown",
    "pay_compliance_time": "Time of Day Breakdown",
    "pay_compliance_distance": "Short Trip Analysis",
    "congestion_by_borough": "Borough Congestion Burden",
    "congestion_by_distance": "Distance Band Burden",
    "cbd_zone_footprint": "CBD Zone Footprint",
    "daily_revenue_trend": "Daily Revenue Trend",
    "peak_vs_trough": "Peak vs Trough",
    "zone_volatility": "Zone Volatility",
    "borough_volatility": "Borough Volatility",
    "late_night_volatility": "Late Night Volatility",
    "zone_opportunity": "Opportunity Matrix",
    "wav_gap": "WAV Gap Analysis",
    "growth_quality": "Growth Quality Score",
    "platform_quality": "Platform Quality Summary",
}

# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class Params:
    """Knobs of one analysis run.  ``replace(params, field=value)`` to vary."""

    platforms: tuple = PLATFORM_LABELS
    other_platform: str = OTHER_PLATFORM_LABEL
    time_buckets: tuple = TIME_BUCKETS
    default_time_bucket: str = DEFAULT_TIME_BUCKET
    time_bucket_order: tuple = TIME_BUCKET_ORDER
    max_wait_seconds: int = MAX_WAIT_SECONDS
    sla_seconds: int = SLA_SECONDS
    pay_per_mile: Decimal = PAY_PER_MILE
    pay_per_minute: Decimal = PAY_PER_MINUTE
    pay_distance_bands: tuple = PAY_DISTANCE_BANDS
    pay_distance_rest: str = PAY_DISTANCE_REST
    congestion_distance_bands: tuple = CONGESTION_DISTANCE_BANDS
    congestion_distance_rest: str = CONGESTION_DISTANCE_REST
    min_trips_corridor: int = MIN_TRIPS_CORRIDOR
    min_trips_zone_volatility: int = MIN_TRIPS_ZONE_VOLATILITY
    min_trips_opportunity: int = MIN_TRIPS_OPPORTUNITY
    min_trips_segment: int = MIN_TRIPS_SEGMENT
    top_corridors: int = TOP_CORRIDORS
    top_borough_pairs: int = TOP_BOROUGH_PAIRS
    top_cbd_zones: int = TOP_CBD_ZONES
    top_volatile_zones: int = TOP_VOLATILE_ZONES
    top_opportunity_zones: int = TOP_OPPORTUNITY_ZONES
    fare_tiles: int = FARE_TILES
    opportunity_weights: tuple = OPPORTUNITY_WEIGHTS
    holiday_month: int = HOLIDAY_MONTH
    # Dimension tables with at most this many rows are broadcast; larger
    # ones fall back to a shuffle join planned by Spark.
    max_broadcast_rows: int = 1_000_000
    sections: dict = field(default_factory=lambda: dict(SECTIONS))

    @property
    def platform_codes(self) -> list[str]:
        return [code for code, _ in self.platforms]

    def with_(self, **changes) -> "Params":
        return replace(self, **changes)


DEFAULT = Params()
