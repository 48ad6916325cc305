"""Cleaning and enrichment of states as column expressions; no Python runs on rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .geo import geohash5

#: Region, lat_min, lat_max, lon_min, lon_max; the first box that holds a point names it.
REGION_BOXES = [
    ("Europe", 34.0, 72.0, -25.0, 45.0),
    ("North America", 5.0, 72.0, -170.0, -50.0),
    ("South America", -56.0, 15.0, -82.0, -34.0),
    ("Africa", -35.0, 37.0, -20.0, 52.0),
    ("South Asia", 5.0, 38.0, 60.0, 100.0),
    ("Asia", -10.0, 55.0, 45.0, 150.0),
    ("Oceania", -50.0, 0.0, 110.0, 180.0),
]
#: The boxes that models are fitted in.
MODEL_BOXES = [("europe", 34.0, 72.0, -25.0, 45.0), ("north_america", 5.0, 72.0, -170.0, -50.0), ("india", 5.0, 38.0, 60.0, 100.0)]
#: Countries of the reporting regions.
COUNTRY_REGIONS = {
    "Europe": ["United Kingdom", "Ireland", "France", "Germany", "Netherlands", "Belgium", "Switzerland", "Austria", "Spain", "Portugal", "Italy", "Denmark", "Sweden", "Norway", "Finland", "Poland", "Czechia", "Malta", "Luxembourg"],
    "North America": ["United States", "Canada", "Mexico"],
    "South Asia": ["India", "Pakistan", "Bangladesh", "Sri Lanka", "Nepal", "Bhutan", "Maldives"],
}
#: Bands of altitude in feet, left-closed, and those of the second report, right-closed.
BANDS = [(2000, "0-2000ft"), (6000, "2000-6000ft"), (10000, "6000-10000ft"), (20000, "10000-20000ft"), (30000, "20000-30000ft"), (40000, "30000-40000ft")]
BINS = [(0, "ground"), (5000, "0-5k"), (15000, "5-15k"), (25000, "15-25k"), (35000, "25-35k"), (45000, "35-45k"), (100000, "45k+")]
SOURCES = ["opensky", "adsb_lol", "simulator", "replay", "historical"]


def clean_callsign(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def speed_kmh(velocity: Column) -> Column:
    return F.round(velocity * 3.6, 2)


def altitude_ft(baro: Column, geo: Column) -> Column:
    return F.round(F.coalesce(baro, geo) * 3.28084, 1)


def flight_phase(on_ground: Column, vertical_rate: Column) -> Column:
    return F.when(on_ground, "ground").when(vertical_rate > 1, "climb").when(vertical_rate < -1, "descent").otherwise("cruise")


def first_box(lat: Column, lon: Column, boxes: list[tuple], missing: str, other: str) -> Column:
    out = F.when(lat.isNull() | lon.isNull(), missing)
    for name, lat0, lat1, lon0, lon1 in boxes:
        out = out.when(lat.between(lat0, lat1) & lon.between(lon0, lon1), name)
    return out.otherwise(other)


def region(lat: Column, lon: Column) -> Column:
    return first_box(lat, lon, REGION_BOXES, "Unknown", "Other")


def quality_flags(stale_s: int = 60, max_speed: float = 400.0, max_alt: float = 15000.0, min_alt: float = -500.0, max_rate: float = 50.0) -> Column:
    """Known faults of a state, in fixed order."""
    c = F.col
    rules = [
        (c("latitude").isNull() | c("longitude").isNull(), "missing_position"),
        (c("time_position").isNull() | (c("last_contact") - c("time_position") > stale_s), "stale_contact"),
        ((c("velocity") > max_speed) | (c("velocity") < 0), "implausible_speed"),
        ((c("baro_altitude") > max_alt) | (c("baro_altitude") < min_alt), "implausible_altitude"),
        (F.abs("vertical_rate") > max_rate, "implausible_vertical_rate"),
        (c("squawk").isin("7500", "7600", "7700"), "emergency_squawk"),
    ]
    return F.array_compact(F.array(*[F.when(test, name) for test, name in rules]))


def errors() -> Column:
    """Why a record is not valid; empty if it is."""
    c = F.col
    tests = [
        (~F.coalesce(F.length("icao24").between(1, 6), F.lit(False)), "icao24"),
        (~c("longitude").between(-180, 180), "longitude"), (~c("latitude").between(-90, 90), "latitude"),
        (c("velocity") < 0, "velocity"), (~c("true_track").between(0, 360), "true_track"),
        (~F.coalesce(c("source").isin(SOURCES), F.lit(False)), "source"),
        *[(c(n).isNull(), n) for n in ("origin_country", "last_contact", "on_ground", "spi", "position_source", "ingest_ts")],
    ]
    return F.array_compact(F.array(*[F.when(test, name) for test, name in tests]))


def country_region(country: Column) -> Column:
    out = None
    for name, countries in COUNTRY_REGIONS.items():
        out = (F if out is None else out).when(country.isin(countries), name)
    return out.otherwise("Other")


def band(feet: Column) -> Column:
    out = F.when(feet.isNull(), "unknown")
    for top, name in BANDS:
        out = out.when(feet < top, name)
    return out.otherwise("40000ft+")


def bin_of(feet: Column) -> Column:
    """The second report's bins: no altitude counts as ground; null outside (-1000, 100000]."""
    x = F.coalesce(feet, F.lit(-1.0))
    out = F.when((x <= -1000) | (x > 100000), None)
    for top, name in BINS:
        out = out.when(x <= top, name)
    return out


def cyclic_hour(hour: Column) -> tuple[Column, Column]:
    """Sine and cosine of the hour of the day on its circle."""
    turn = hour * (2 * math.pi / 24)
    return F.sin(turn), F.cos(turn)


def surrogate_key(*cols: str) -> Column:
    return F.md5(F.concat_ws("||", *[F.coalesce(F.col(c).cast("string"), F.lit("_dbt_null_")) for c in cols]))


def pct_change(new: Column, old: Column) -> Column:
    return F.when(old.isNull() | (old == 0), None).otherwise(F.round((new - old).cast("double") / old * 100, 2))


def enriched(states: DataFrame) -> DataFrame:
    """The clean event table's derived columns; the same for streams and batches."""
    c = F.col
    return states.select(
        "*", speed_kmh(c("velocity")).alias("speed_kmh"), altitude_ft(c("baro_altitude"), c("geo_altitude")).alias("altitude_ft"),
        flight_phase(c("on_ground"), c("vertical_rate")).alias("flight_phase"), geohash5(c("latitude"), c("longitude")).alias("geohash5"),
        region(c("latitude"), c("longitude")).alias("region"), quality_flags().alias("data_quality_flags"),
    )
