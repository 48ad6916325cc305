"""Cells of the sphere and the places that can matter to some point in them.

Cells are squares of latitude and longitude: 30 degrees wide on level 0, halved on every further level. A cell lies
within a cap around its middle, so distances from its points differ from that of the middle by no more than the cap's
radius; what a place's distance and bearing from the middle leave possible is a candidate. Lists of candidates are joined
by cell, so a point looks at few places however many there are.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import EARTH_KM, angle_between, bearing_deg, haversine_km

WIDTH, SLACK_KM, SECTORS = 30.0, 0.01, 12


def on_sphere(lat: Column, lon: Column) -> list[Column]:
    """The point as a vector of length one, whose squared distances to others order like those on the sphere."""
    a, b = F.radians(lat), F.radians(lon)
    return [F.cos(a) * F.cos(b), F.cos(a) * F.sin(b), F.sin(a)]


def cell_of(v: Column, level: int) -> Column:
    """The cell of a vector on the sphere; null if it has a null."""
    width, rows = WIDTH / 2**level, 6 << level
    row = F.least(F.floor((F.degrees(F.asin(v[2])) + 90) / width), F.lit(rows - 1))
    col = F.pmod(F.floor((F.degrees(F.atan2(v[1], v[0])) + 180) / width), F.lit(2 * rows))
    return (row * 2 * rows + col).cast("long")


def middles(cells: DataFrame, level: int) -> DataFrame:
    """cells (row, col, ...) with mid_lat, mid_lon and cap_km, the distance from the middle to the farthest corner."""
    width = WIDTH / 2**level
    lat, lon = (F.col("row") + 0.5) * width - 90, (F.col("col") + 0.5) * width - 180
    corners = [haversine_km(lat, lon, lat + side * width / 2, lon + width / 2) for side in (-1, 1)]
    return cells.withColumns({"mid_lat": lat, "mid_lon": lon, "cap_km": F.greatest(*corners)})


def level_for(n: int) -> int:
    """A level on which cells hold a place or fewer if n places are spread evenly."""
    return min(8, max(4, math.ceil(math.log(max(n, 1) / 18, 4))))


def once(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns, computed here: the optimizer would put them into the lambdas that read them, to be computed for each
    element again; it takes nothing past a generator."""
    return df.select(F.explode(F.array(F.struct(*columns))).alias("__o")).select("__o.*")


def nearest_candidates(placed: DataFrame, level: int, max_km: float | None) -> DataFrame:
    """(cell, near): the places of placed (p_lat, p_lon, ...) that are nearest to some point of the cell, and at most max_km away.

    A place farther from the middle than the nearest one by more than the cap's diameter is nearest to none. Cells are
    halved from level 0 on with their lists, so a list is only gone through by the cells under it; there is no shuffle.
    """
    spark = placed.sparkSession
    whole = placed.agg(F.collect_list(F.struct(*placed.columns)).alias("near"))
    cells = spark.range(72, numPartitions=8).select(F.floor(F.col("id") / 12).alias("row"), (F.col("id") % 12).alias("col")).join(F.broadcast(whole))
    for at in range(level + 1):
        if at:
            halves = F.explode(F.array(*[F.struct((2 * F.col("row") + i).alias("row"), (2 * F.col("col") + j).alias("col")) for i in (0, 1) for j in (0, 1)]))
            cells = cells.select(halves.alias("h"), "near").select("h.*", "near")
        cells = once(middles(cells, at), ["row", "col", "mid_lat", "mid_lon", "cap_km", "near"])
        far = F.transform("near", lambda p: F.struct(haversine_km(F.col("mid_lat"), F.col("mid_lon"), p["p_lat"], p["p_lon"]).alias("km"), p.alias("p")))
        cells = once(cells.select("row", "col", "cap_km", far.alias("far")), ["row", "col", "cap_km", "far"])
        most = F.array_min(F.transform("far", lambda x: x["km"])) + 2 * F.col("cap_km") + SLACK_KM
        if max_km is not None:
            most = F.least(most, F.col("cap_km") + max_km + SLACK_KM)
        cells = once(cells.select("row", "col", "far", most.alias("most")), ["row", "col", "far", "most"])
        kept = F.transform(F.filter("far", lambda x: x["km"] <= F.col("most")), lambda x: x["p"])
        cells = once(cells.select("row", "col", kept.alias("near")), ["row", "col", "near"]).filter(F.size("near") > 0)
    return cells.select((F.col("row") * (12 << level) + F.col("col")).cast("long").alias("cell"), "near")


def ahead_candidates(places: DataFrame, level: int, min_km: float, max_km: float, max_diff: float) -> DataFrame:
    """(cell, sector, near): the places of (p_lat, p_lon, ...) that are between min_km and max_km from some point of the cell
    and within max_diff degrees of some track in the sector there.

    From the middle to another point of the cell, the bearing of a place changes by the angle of the triangle at the
    place, the triangle's excess, and the turn of the meridians, at most half the cell's width; places within two caps
    of the middle may lie anywhere.
    """
    spark = places.sparkSession
    width, n = WIDTH / 2**level, 72 * 4**level
    cells = spark.range(n, numPartitions=8).select("id", F.floor(F.col("id") / (12 << level)).alias("row"), (F.col("id") % (12 << level)).alias("col"))
    cells = middles(cells, level).select(F.col("id").alias("cell"), "mid_lat", "mid_lon", "cap_km")
    km = haversine_km(F.col("mid_lat"), F.col("mid_lon"), F.col("p_lat"), F.col("p_lon"))
    # as many cells as the level has, whatever the places
    ring = places.select("p_lat", "p_lon", F.struct(*places.columns).alias("p")).join(F.broadcast(cells)).withColumn("km", km)
    ring = ring.filter((F.col("km") >= min_km - F.col("cap_km") - SLACK_KM) & (F.col("km") <= max_km + F.col("cap_km") + SLACK_KM))
    cap, far = F.col("cap_km") / EARTH_KM, F.col("km") / EARTH_KM
    at_place = F.asin(F.least(F.lit(1.0), F.sin(cap) / F.least(F.sin(far - cap), F.sin(far + cap))))
    t = F.tan(far / 2) * F.tan(cap / 2)
    turn = F.degrees(at_place + 2 * F.atan(t / (1 - t))) + width / 2 + 0.01
    anywhere = (far < 2.5 * cap) | (far + 2 * cap > math.pi / 2) | (t > 0.5)
    off = lambda s: angle_between(bearing_deg(F.col("mid_lat"), F.col("mid_lon"), F.col("p_lat"), F.col("p_lon")), (s + 0.5) * 360 / SECTORS)
    seen = ring.withColumn("turn", F.when(~anywhere, turn)).withColumn("sector", F.explode(F.array(*[F.lit(s) for s in range(SECTORS)])))
    seen = seen.filter(F.col("turn").isNull() | (off(F.col("sector")) <= max_diff + 180 / SECTORS + F.col("turn")))
    return seen.groupBy("cell", "sector").agg(F.collect_list("p").alias("near"))


def sector_of(track: Column) -> Column:
    return F.floor(F.pmod(track, F.lit(360.0)) / (360 / SECTORS)).cast("int")


def listed(rows: DataFrame, lists: DataFrame, on: list[str], max_entries: int = 500_000) -> DataFrame:
    """rows with `near` of the lists. Lists are broadcast only if their entries are counted to be few; else Spark joins, and splits hot cells."""
    few = (lists.agg(F.sum(F.size("near"))).first()[0] or 0) <= max_entries
    return rows.join(F.broadcast(lists) if few else lists, on, "left")

