"""Joins by prefix, nearness and time. Fixed dimensions are broadcast; so are others only after their rows are counted."""

from __future__ import annotations

import math
from itertools import product

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.geo import EARTH_KM, angle_between, haversine_km
from ..sources.shared import settled
from .cells import ahead_candidates, cell_of, level_for, listed, nearest_candidates, on_sphere, once, sector_of


def with_airline(states: DataFrame, airlines: DataFrame) -> DataFrame:
    """airline by the first three letters of the callsign."""
    dim = F.broadcast(airlines.select(F.col("prefix").alias("__p"), F.col("airline").alias("__a")))
    on = F.upper(F.substring("callsign", 1, 3)) == F.col("__p")
    return states.join(dim, on & (F.length("callsign") >= 3), "left").withColumn("airline", F.coalesce("__a", F.lit("Unknown/Other"))).drop("__p", "__a")


def with_registration_country(rows: DataFrame, registrations: DataFrame) -> DataFrame:
    """country by the longest prefix of the registration: one lookup for each length, the longest that matches counts."""
    out, found = rows, []
    for n in (3, 2, 1):
        dim = registrations.filter(F.length("prefix") == n).select(F.col("prefix").alias(f"__p{n}"), F.col("country").alias(f"__c{n}"))
        out = out.join(F.broadcast(dim), F.upper(F.substring("registration", 1, n)) == F.col(f"__p{n}"), "left")
        found.append(F.col(f"__c{n}"))
    return out.select(*rows.columns, F.coalesce(*found, F.lit("Unknown")).alias("country"))


PLACES = 10_000  # rows of places of which lists of candidates are made


def nearest(points: DataFrame, places: DataFrame, lat: str, lon: str, keep: list[str], max_km: float | None = None, prefix: str = "nearest_", max_places: int = PLACES) -> DataFrame:
    """points with the columns `keep` of the nearest place and its distance; ties by the first of keep, null beyond max_km.

    places are counted: of up to max_places, each cell of the sphere gets the list of those that are nearest to some point
    of it, and a point looks at its cell's list, so that points are not multiplied and cost the same for ten places or
    thousands. More places are met on cells as rows.
    """
    placed = places.select(*keep, F.col(lat).alias("p_lat"), F.col(lon).alias("p_lon"), F.array(*on_sphere(F.col(lat), F.col(lon))).alias("p_v"))
    n = placed.limit(max_places + 1).count()
    if n > max_places:
        near = nearest_by_cells(points, placed, keep, max_km)
    else:
        level = level_for(n)
        here = points.select(F.struct(*points.columns).alias("row"), F.array(*on_sphere(F.col("latitude"), F.col("longitude"))).alias("v"))
        here = listed(here.withColumn("cell", cell_of(F.col("v"), level)), settled(nearest_candidates(placed, level, max_km)), ["cell"])
        # lambdas run interpreted, for each place: products and rint, as pow and the decimals of round cost many times more
        side = lambda p, i: p["p_v"][i] - F.col("v")[i]
        far = lambda p: F.rint(sum(side(p, i) * side(p, i) for i in range(3)) * 1e15)
        best = F.array_min(F.transform("near", lambda p: F.struct(far(p).alias("d"), *[p[k].alias(k) for k in keep], p["p_lat"].alias("p_lat"), p["p_lon"].alias("p_lon"))))
        # else a filter on what follows is pushed down with the whole search in it, once for each column that it reads
        near = once(here.select("row", F.when(F.col("cell").isNotNull(), best).alias("near")), ["row", "near"])
    km = haversine_km(F.col("row.latitude"), F.col("row.longitude"), F.col("near.p_lat"), F.col("near.p_lon"))
    near = near.select("row", "near", F.when(F.col("near").isNotNull(), km).alias("km"))
    ok = F.lit(True) if max_km is None else F.col("km") <= max_km
    return near.select("row.*", *[F.when(ok, F.col(f"near.{k}")).alias(prefix + k) for k in keep], F.when(ok, F.col("km")).alias(prefix + "km"))


def nearest_by_cells(points: DataFrame, placed: DataFrame, keep: list[str], max_km: float | None, start_km: float = 50.0) -> DataFrame:
    """(row, near) like nearest, for any number of places, by equi-joins on cells of the sphere's space.

    Within a radius a place lies in the cell of a point or in one next to it; places are dealt to these 27. The radius
    grows fourfold for points that have found none, up to max_km or half of the globe.
    """
    todo = settled(points.select(F.struct(*points.columns).alias("row"), F.monotonically_increasing_id().alias("id"), F.array(*on_sphere(F.col("latitude"), F.col("longitude"))).alias("v")))
    done = todo.filter("v[0] is null or v[1] is null").select("row", F.lit(None).cast(placed.select(F.struct(F.lit(0.0).alias("d"), *keep, "p_lat", "p_lon").alias("s")).schema["s"].dataType).alias("near"))
    todo = todo.filter("v[0] is not null and v[1] is not null")
    most, km = min(max_km or 20_100.0, 20_100.0), start_km
    while True:
        km = min(km, most)
        width = 2 * math.sin(min(km / EARTH_KM, math.pi) / 2)
        at = lambda v, s: F.xxhash64(*[(F.floor(v[i] / width) + s[i]).cast("long") for i in range(3)])
        dealt = placed.select("*", F.explode(F.array_distinct(F.array(*[at(F.col("p_v"), s) for s in product((-1, 0, 1), repeat=3)]))).alias("cell"))
        far = sum(F.pow(F.col("p_v")[i] - F.col("v")[i], F.lit(2.0)) for i in range(3))
        met = todo.withColumn("at", at(F.col("v"), (0, 0, 0))).join(dealt, F.col("at") == F.col("cell")).withColumn("d", F.round(far, 15)).filter(F.col("d") <= width * width + 1e-12)
        best = settled(met.groupBy("id").agg(F.min(F.struct("d", *keep, "p_lat", "p_lon")).alias("near")))
        done = done.unionByName(todo.join(best, "id").select("row", "near"))
        todo = settled(todo.join(best.select("id"), "id", "left_anti"))
        if km >= most or todo.isEmpty():
            return done.unionByName(todo.select("row", F.lit(None).cast(done.schema["near"].dataType).alias("near")))
        km *= 4


AHEAD_LEVEL = 3


def heading_destination(states: DataFrame, airports: DataFrame, min_km: float = 100, max_km: float = 3000, max_diff: float = 60) -> DataFrame:
    """states with the airport ahead that fits the track best (predicted_iata), its distance and the bearing difference.

    Each cell of the sphere has, for each of twelve sectors of tracks, the list of airports that can fit there; a row looks at
    the list of its cell and sector. Sines and cosines of airports and of the row are taken once; an airport costs one angle.
    """
    sides = lambda lat, lon: [F.sin(F.radians(lat)), F.cos(F.radians(lat)), F.sin(F.radians(lon)), F.cos(F.radians(lon))]
    placed = airports.select("iata", F.col("airport_lat").alias("p_lat"), F.col("airport_lon").alias("p_lon"), F.array(*sides(F.col("airport_lat"), F.col("airport_lon"))).alias("s"))
    lists = settled(ahead_candidates(placed, AHEAD_LEVEL, min_km, max_km, max_diff))
    v = F.array(*on_sphere(F.col("latitude"), F.col("longitude")))
    here = states.select(F.struct(*states.columns).alias("row"), F.array(*sides(F.col("latitude"), F.col("longitude"))).alias("s"), "true_track", F.coalesce("departure_iata", F.lit("")).alias("dep"), cell_of(v, AHEAD_LEVEL).alias("cell"), sector_of(F.col("true_track")).alias("sector"))
    # squared chords of the least and greatest distance, a little wider; the distance itself decides among what is left
    chord = lambda km, by: (2 * math.sin(km / EARTH_KM / 2)) ** 2 * (1 + by)

    def seen(p: Column) -> Column:
        (s1, c1, sl1, cl1), (s2, c2, sl2, cl2) = ([x[i] for i in range(4)] for x in (F.col("s"), p["s"]))
        sin_turn, cos_turn = sl2 * cl1 - cl2 * sl1, cl2 * cl1 + sl2 * sl1
        bearing = F.degrees(F.atan2(sin_turn * c2, c1 * s2 - s1 * c2 * cos_turn))
        return F.struct(angle_between(bearing, F.col("true_track")).alias("diff"), p["iata"].alias("iata"), (2 - 2 * (s1 * s2 + c1 * c2 * cos_turn)).alias("d"), p["p_lat"].alias("lat"), p["p_lon"].alias("lon"))

    km = lambda p: haversine_km(F.col("row.latitude"), F.col("row.longitude"), p["lat"], p["lon"])
    near = F.filter(F.transform("near", seen), lambda p: p["d"].between(chord(min_km, -1e-6), chord(max_km, 1e-6)) & (p["diff"] <= max_diff) & (p["iata"] != F.col("dep")))
    best = F.array_min(F.filter(near, lambda p: km(p).between(min_km, max_km)))
    out = listed(here, lists, ["cell", "sector"]).select("row", best.alias("best"))
    return out.select("row.*", F.col("best.iata").alias("predicted_iata"), F.when(F.col("best").isNotNull(), km(F.col("best"))).alias("predicted_km"), F.col("best.diff").alias("bearing_diff"))


def eta_minutes(km: Column, speed_kmh: Column) -> Column:
    return F.when(speed_kmh > 5, F.round(km / speed_kmh * 60, 1))


def asof_nearest(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, tolerance: int, row: str | None = None) -> DataFrame:
    """Each left row with the right row of its key nearest in time within tolerance (inclusive); ties take the earlier.

    Times are cut into buckets wider than twice the tolerance; a left row looks into the one or two buckets that its
    range touches, so the join is on (key, bucket) and a busy key is spread over its buckets. Left rows without a match are left out.
    row: a column that is unique on the left. Without one rows are numbered as they lie, so left must then be a scan or a
    written table, whose order a task that is run again finds unchanged.
    """
    width = 2 * tolerance + 1
    low, high = F.floor((F.col(left_time) - tolerance) / width), F.floor((F.col(left_time) + tolerance) / width)
    a = left.withColumn("__row", F.monotonically_increasing_id() if row is None else F.col(row)).withColumn("__bucket", F.explode(F.array_distinct(F.array(low, high))))
    b = right.withColumn("__bucket", F.floor(F.col(right_time) / width)).withColumnRenamed(key, "__key")
    met = a.join(b, (F.col(key) == F.col("__key")) & (a["__bucket"] == b["__bucket"]) & (F.abs(F.col(right_time) - F.col(left_time)) <= tolerance))
    best = F.min_by(F.struct(*[F.col(c) for c in (*left.columns, *(c for c in right.columns if c != key))]), F.struct(F.abs(F.col(right_time) - F.col(left_time)), F.col(right_time)))
    return met.groupBy("__row").agg(best.alias("__r")).select("__r.*")


def latest_states(states: DataFrame) -> DataFrame:
    """The newest row of each aircraft: by ingest time, then event."""
    best = F.max_by(F.struct(*states.columns), F.struct("ingest_ts", "event_id"))
    return states.groupBy(F.col("icao24").alias("__k")).agg(best.alias("r")).select("r.*")


def in_box(rows: DataFrame, south: float, north: float, west: float, east: float, limit: int | None = None) -> DataFrame:
    """Rows with a position within the box, edges included; with limit (1 to 5,000) the first by aircraft."""
    out = rows.filter(F.col("latitude").between(south, north) & F.col("longitude").between(west, east))
    return out if limit is None else out.orderBy("icao24").limit(max(1, min(5000, limit)))


def asked(spark: SparkSession, text: str, tables: dict[str, DataFrame], values: dict) -> DataFrame:
    """A query over named tables ({name} in its text) whose values (:name) are bound and never pasted into it."""
    return spark.sql(text, args=values, **tables)


def keep_last(states: DataFrame) -> DataFrame:
    """One row per (aircraft, time of position), nulls alike: the latest ingest, then the latest event."""
    w = Window.partitionBy("icao24", "time_position").orderBy(F.desc("ingest_ts"), F.desc("event_id"))
    return states.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def fetched(*readers) -> list[DataFrame]:
    """The feeds of readers (functions without arguments) that could be read, in order; one that fails is passed over."""
    out = []
    for reader in readers:
        try:
            feed = reader()
            feed.schema  # a missing path shows here
            out.append(feed)
        except AnalysisException:
            continue
    return out


def merged_feeds(feeds: list[DataFrame], key: str = "icao24", allow_empty: bool = True) -> DataFrame:
    """The feeds together; for a key in several, the row of the later feed. Without allow_empty, no row at all is an error."""
    if not feeds or not allow_empty and all(f.isEmpty() for f in feeds):
        raise ValueError("no feed has a row")
    rows = None
    for i, feed in enumerate(feeds):
        feed = feed.withColumn("__feed", F.lit(i))
        rows = feed if rows is None else rows.unionByName(feed)
    cols = feeds[0].columns
    return rows.groupBy(F.col(key).alias("__k")).agg(F.max_by(F.struct(*cols), "__feed").alias("r")).select("r.*")
