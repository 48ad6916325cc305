"""Flight legs from ground and air sightings: the batch twin of the streaming state machine."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import haversine_km
from .joins import nearest
from .windows import with_carried


def with_departures(states: DataFrame, airports: DataFrame, radius_km: float = 50.0, width: int = 86_400) -> DataFrame:
    """states in order with was_on_ground and, while airborne, the departure airport and time of the leg.

    A leg begins with the first airborne row after a ground row whose position is within radius_km of an airport; its
    departure is carried to the row that lands (dep_* there tell where it came from) and cleared after it. Rows of an
    aircraft are dealt by `width` of time to find its take-offs and to count them, then by leg; those before its first
    take-off stay dealt by time.
    """
    key, order = ["icao24"], ["last_contact", "event_id"]
    w = Window.partitionBy("icao24", "__part").orderBy("__own", *order)
    rows = with_carried(states, key, "last_contact", order, ["on_ground"], width).withColumn("was_on_ground", F.lag("on_ground").over(w)).filter("__own")
    # every take-off opens a new leg, even where no airport matches
    rows = rows.withColumn("takeoff", F.coalesce(F.col("was_on_ground") & ~F.col("on_ground"), F.lit(False)))
    opened = rows.groupBy("icao24", "__part").agg(F.count_if("takeoff").alias("n"))
    upto = Window.partitionBy("icao24").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    opened = opened.select("icao24", "__part", F.sum("n").over(upto).alias("__before"), F.lit(False).alias("__own"))
    rows = rows.unionByName(opened.filter("__before > 0"), allowMissingColumns=True)
    rows = rows.withColumn("leg", F.sum(F.coalesce("__before", F.col("takeoff").cast("long"))).over(w)).filter("__own")
    rows = rows.withColumn("__early", F.when(F.col("leg") == 0, F.col("__part"))).drop("__before", "__part", "__own")
    rows = nearest(rows, airports, "airport_lat", "airport_lon", ["iata"], radius_km, prefix="at_")
    leg = Window.partitionBy("icao24", "leg", "__early").orderBy(*order)
    first = lambda c: F.first(F.when(F.col("takeoff") & F.col("latitude").isNotNull(), F.col(c))).over(leg)
    landed = F.coalesce(F.sum(F.col("on_ground").cast("int")).over(leg.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) > 0
    known = F.when(~landed & (F.col("leg") > 0), first("at_iata"))
    return rows.withColumns({"dep_iata": known, "dep_time": F.when(known.isNotNull(), first("last_contact"))}).drop("leg", "__early")


def routes(states: DataFrame, airports: DataFrame, radius_km: float = 50.0) -> DataFrame:
    """Completed legs: rows that land near an airport with a known departure."""
    rows = with_departures(states, airports, radius_km)
    dim = F.broadcast(airports.select(F.col("iata").alias("__i"), F.col("airport_lat").alias("__la"), F.col("airport_lon").alias("__lo")))
    done = rows.filter(F.col("on_ground") & ~F.col("was_on_ground") & F.col("dep_iata").isNotNull() & F.col("at_iata").isNotNull()).join(dim, F.col("dep_iata") == F.col("__i"))
    minutes = F.greatest((F.col("last_contact") - F.col("dep_time")) / 60.0, F.lit(0.01))
    km = haversine_km(F.col("__la"), F.col("__lo"), F.col("latitude"), F.col("longitude"))
    return done.select("icao24", F.col("last_contact").alias("arrival_time"), F.coalesce("callsign", F.lit("")).alias("callsign"), F.col("dep_iata").alias("departure_iata"), F.col("dep_time").alias("departure_time"), F.col("at_iata").alias("arrival_iata"), F.round(minutes, 1).alias("duration_min"), F.round(km, 1).alias("distance_km"), F.round(km / (minutes / 60), 1).alias("avg_speed_kmh"))


def trajectory_points(states: DataFrame, airports: DataFrame, radius_km: float = 50.0, keep_s: int = 48 * 3600) -> DataFrame:
    """Airborne rows of legs with a known departure, with the time until which they are kept."""
    rows = with_departures(states, airports, radius_km).filter(~F.col("on_ground") & F.col("dep_iata").isNotNull())
    return rows.select("icao24", F.col("last_contact").alias("ts"), "latitude", "longitude", F.round(F.coalesce("baro_altitude", "geo_altitude") * 3.28084, 1).alias("altitude_ft"), "dep_iata", (F.col("last_contact") + keep_s).alias("expires_at"))
