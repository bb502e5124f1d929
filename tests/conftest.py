from __future__ import annotations

import datetime as dt
import os
import sys
from decimal import Decimal

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from farelens.session import local_session  # noqa: E402
from farelens.sources.contract import TRIPS_SCHEMA, ZONES_SCHEMA  # noqa: E402

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    s = local_session(4, shuffle_partitions=8, app="farelens-tests")
    yield s
    s.stop()


BASE_TS = dt.datetime(2025, 12, 10, 8, 0, 0)


def trip(trip_id: int, **kw) -> dict:
    """A clean default trip; keyword overrides use the native column names.

    ``wait`` (seconds, may be fractional) and ``hour`` are shortcuts for the
    request / pickup timestamps.
    """
    wait = kw.pop("wait", 240)
    hour = kw.pop("hour", None)
    pickup = BASE_TS if hour is None else BASE_TS.replace(hour=hour)
    row = {
        "trip_id": trip_id,
        "hvfhs_license_num": "HV0003",
        "request_datetime": pickup - dt.timedelta(seconds=wait),
        "on_scene_datetime": pickup,
        "pickup_datetime": pickup,
        "dropoff_datetime": pickup + dt.timedelta(minutes=16),
        "PULocationID": 1,
        "DOLocationID": 2,
        "trip_miles": Decimal("3.000"),
        "trip_time": 960,
        "base_passenger_fare": Decimal("20.00"),
        "driver_pay": Decimal("15.00"),
        "tolls": None,
        "bcf": Decimal("0.55"),
        "sales_tax": Decimal("1.78"),
        "congestion_surcharge": Decimal("2.75"),
        "airport_fee": None,
        "cbd_congestion_fee": Decimal("1.50"),
        "tips": None,
        "shared_request_flag": "N",
        "shared_match_flag": "N",
        "access_a_ride_flag": "N",
        "wav_request_flag": "N",
        "wav_match_flag": "N",
    }
    for k, v in kw.items():
        if isinstance(v, (int, float)) and k in (
            "base_passenger_fare", "driver_pay", "tolls", "bcf", "sales_tax",
            "congestion_surcharge", "airport_fee", "cbd_congestion_fee", "tips", "trip_miles",
        ):
            v = Decimal(str(v))
        row[k] = v
    return row


def trips_df(spark, rows):
    cols = [f.name for f in TRIPS_SCHEMA.fields]
    return spark.createDataFrame([tuple(r[c] for c in cols) for r in rows], TRIPS_SCHEMA)


ZONE_ROWS = [
    (1, "Manhattan", "Midtown Center", "Yellow Zone"),
    (2, "Brooklyn", "Park Slope", "Boro Zone"),
    (3, "Unknown", "NV", "N/A"),
    (4, None, None, None),
]


@pytest.fixture(scope="session")
def zones(spark):
    return spark.createDataFrame(ZONE_ROWS, ZONES_SCHEMA)
