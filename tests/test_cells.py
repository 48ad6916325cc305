"""Candidate lists of cells against all places."""

import math
import random

import pytest
from pyspark.sql import functions as F

from skylattice.operators import cells, joins

R = 6371.0


def km(a, b, c, d):
    a, b, c, d = map(math.radians, (a, b, c, d))
    h = math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2
    return 2 * R * math.asin(math.sqrt(min(1, h)))


def bearing(a, b, c, d):
    a, b, c, d = map(math.radians, (a, b, c, d))
    return math.degrees(math.atan2(math.sin(d - b) * math.cos(c), math.cos(a) * math.sin(c) - math.sin(a) * math.cos(c) * math.cos(d - b))) % 360


@pytest.fixture(scope="module")
def points():
    r = random.Random(2)
    rows = [(i, math.degrees(math.asin(r.uniform(-1, 1))), r.uniform(-180, 180), r.uniform(0, 360)) for i in range(1500)]
    edges = [(90.0, 0.0), (-90.0, 10.0), (0.0, 180.0), (0.0, -180.0), (30.0, 30.0), (-30.0, -150.0), (89.9, 179.9), (7.5, 7.5)]
    return rows + [(2000 + i, la, lo, 45.0 * i) for i, (la, lo) in enumerate(edges)] + [(3000, None, 1.0, 5.0), (3001, 2.0, None, 5.0), (3002, 3.0, 4.0, None)]


@pytest.mark.parametrize("n, max_km", [(1, None), (40, None), (40, 900.0), (700, None)])
def test_nearest_of_all_places(spark, points, n, max_km):
    r = random.Random(n)
    places = [(f"p{i:03}", math.degrees(math.asin(r.uniform(-1, 1))), r.uniform(-180, 180)) for i in range(n)]
    df = spark.createDataFrame([p[:3] for p in points], "id long, latitude double, longitude double")
    got = {x.id: x for x in joins.nearest(df, spark.createDataFrame(places, "name string, la double, lo double"), "la", "lo", ["name"], max_km).collect()}
    assert len(got) == len(points)
    for i, la, lo, _ in points:
        if la is None or lo is None:
            assert got[i].nearest_name is None
            continue
        best = min(km(la, lo, p[1], p[2]) for p in places)
        if max_km is not None and best > max_km:
            assert got[i].nearest_name is None
        else:
            assert abs(got[i].nearest_km - best) < 1e-3


def test_the_airport_ahead_of_all_airports(spark, points):
    r = random.Random(8)
    airports = [(f"A{i:02}", math.degrees(math.asin(r.uniform(-1, 1))), r.uniform(-180, 180)) for i in range(90)]
    states = spark.createDataFrame([(*p, f"A{p[0] % 90:02}" if p[0] % 3 else None) for p in points], "id long, latitude double, longitude double, true_track double, departure_iata string")
    got = {x.id: x for x in joins.heading_destination(states, spark.createDataFrame(airports, "iata string, airport_lat double, airport_lon double")).collect()}
    found = 0
    for i, la, lo, track in points:
        best = None
        if None not in (la, lo, track):
            fits = []
            for name, a, b in airports:
                d, off = km(la, lo, a, b), abs((bearing(la, lo, a, b) - track + 180) % 360 - 180)
                if 100 <= d <= 3000 and off <= 60 and not (i % 3 and name == f"A{i % 90:02}"):
                    fits.append((off, name))
            best = min(fits, default=None)
        assert (got[i].predicted_iata is None) == (best is None), i
        if best and abs(got[i].bearing_diff - best[0]) > 1e-6:
            assert abs(la) == 90 or abs(abs(lo) - 180) < 1e-9, i  # bearings at the poles are anyone's
        found += best is not None
    assert found > 500


def test_more_airports_than_a_list_of_all_would_take(spark):
    airports = spark.range(12_000).select(F.format_string("X%05d", "id").alias("iata"), (F.col("id") % 160 - 80 + 0.0).alias("airport_lat"), (F.col("id") * 7 % 360 - 180 + 0.0).alias("airport_lon"))
    states = spark.createDataFrame([(1, 10.0, 10.0, 90.0, None)], "id long, latitude double, longitude double, true_track double, departure_iata string")
    fits = [(abs(bearing(10, 10, a, b) - 90), name) for name, a, b in (tuple(x) for x in airports.collect()) if 100 <= km(10, 10, a, b) <= 3000]
    assert joins.heading_destination(states, airports).head().bearing_diff == pytest.approx(min(fits)[0], abs=1e-6)


def test_lists_stay_short(spark):
    r = random.Random(4)
    rows = [(math.degrees(math.asin(r.uniform(-1, 1))), r.uniform(-180, 180)) for _ in range(3000)]
    placed = spark.createDataFrame(rows, "p_lat double, p_lon double")
    level = cells.level_for(3000)
    size = cells.nearest_candidates(placed, level, None).agg(F.avg(F.size("near")), F.count("*")).head()
    assert size[1] == 72 * 4**level and size[0] < 8


def test_a_filter_on_the_nearest_place_does_not_search_again(spark):
    points = spark.createDataFrame([(1, 10.0, 20.0), (2, -30.0, 100.0)], "id long, latitude double, longitude double")
    places = spark.createDataFrame([("a", 11.0, 20.0), ("b", -30.0, 99.0)], "name string, lat double, lon double")
    out = joins.nearest(points, places, "lat", "lon", ["name"]).filter("nearest_km > 1 and nearest_name <> 'c' and nearest_km < 500")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.id, r.nearest_name) for r in out.collect()} == {(1, "a"), (2, "b")} and plan.count("array_min(") == 1
