"""Window operators: histories, lags, runs of days, knees, samples of lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import cos_libm, rounded_half, signed_turn, sin_libm
from ..sources.shared import settled
from .ranks import percentiles, ranked, same


def last_history(states: DataFrame, n: int = 5) -> DataFrame:
    """The last n positions of each aircraft, oldest first; only n rows of an aircraft are gathered."""
    w = Window.partitionBy("icao24").orderBy(F.desc("last_contact"), F.desc("event_id"))
    some = states.filter("latitude is not null and longitude is not null").withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= n)
    track = F.transform(F.sort_array(F.collect_list(F.struct((-F.col("__n")).alias("o"), "latitude", "longitude", "last_contact"))), lambda p: F.struct(p["latitude"].alias("latitude"), p["longitude"].alias("longitude"), p["last_contact"].alias("t")))
    return some.groupBy("icao24").agg(track.alias("track"), F.count("*").alias("n"))


def with_carried(rows: DataFrame, key: list[str], time: str, order: list[str], fields: list[str], width: int = 86_400) -> DataFrame:
    """rows with __part, their stretch of `width` of time, and one more row (__own false) for each part but a key's first.

    That row has `fields` of the key's last row before the part. Windows over key and __part, ordered by __own first, see
    it where a window over the key would see the row itself, and a key with many rows is spread over its parts. What is
    ordered over a whole key is one row a part. order begins with time, so that equal times share a part.
    """
    rows = rows.withColumns({"__part": F.floor(F.col(time) / width), "__own": F.lit(True)})
    ends = rows.groupBy(*key, "__part").agg(F.max_by(F.struct(*fields), F.struct(*order)).alias("__last"))
    carried = ends.withColumn("__last", F.lag("__last").over(Window.partitionBy(*key).orderBy("__part"))).filter("__last is not null")
    return rows.unionByName(carried.select(*key, "__part", "__last.*", F.lit(False).alias("__own")), allowMissingColumns=True)


def lag_features(states: DataFrame, width: int = 86_400) -> DataFrame:
    """Complete airborne rows with turn rate, acceleration and climb trend against the aircraft's row before."""
    fields = ["latitude", "longitude", "velocity", "true_track", "vertical_rate", "baro_altitude"]
    rows = states.filter(~F.col("on_ground")).dropna(subset=[*fields, "time_position"])
    rows = rows.withColumns({"track_sin": sin_libm(F.radians("true_track")), "track_cos": cos_libm(F.radians("true_track"))})
    rows = with_carried(rows, ["icao24"], "time_position", ["time_position", "event_id"], ["time_position", "track_sin", "track_cos", "velocity", "vertical_rate"], width)
    w = Window.partitionBy("icao24", "__part").orderBy("__own", "time_position", "event_id")
    before = lambda c: F.lag(c).over(w)
    rows = rows.withColumns({"__t": before("time_position"), "__s": before("track_sin"), "__c": before("track_cos"), "__v": before("velocity"), "__r": before("vertical_rate")})
    dt = F.greatest(F.col("time_position") - F.col("__t"), F.lit(1))
    turn = signed_turn(F.col("track_sin"), F.col("track_cos"), F.col("__s"), F.col("__c"))
    out = rows.filter(F.col("__own") & F.col("__t").isNotNull()).withColumns({"dt": dt, "turn_rate": turn / dt, "acceleration": (F.col("velocity") - F.col("__v")) / dt, "climb_trend": (F.col("vertical_rate") - F.col("__r")) / dt})
    return out.drop("__t", "__s", "__c", "__v", "__r", "__part", "__own")


def longest_run(daily: DataFrame, key: list[str], day: str) -> DataFrame:
    """Rows of the longest run of days without a gap, for each key; of equal runs the earliest."""
    w = Window.partitionBy(*key).orderBy(day)
    rows = daily.withColumn("__new", F.coalesce((F.datediff(F.col(day), F.lag(day).over(w)) != 1).cast("int"), F.lit(0))).withColumn("__run", F.sum("__new").over(w))
    sizes = rows.groupBy(*key, "__run").agg(F.count("*").alias("__n"))
    best = sizes.groupBy(*key).agg(F.max_by("__run", F.struct("__n", -F.col("__run"))).alias("__run"))
    return rows.join(best, [*key, "__run"], "left_semi").drop("__new", "__run")


def lags(daily: DataFrame, key: list[str], day: str, value: str, at=(1, 2, 3, 7)) -> DataFrame:
    """value at earlier rows and the day of the week (Monday 0); incomplete rows are left out."""
    w = Window.partitionBy(*key).orderBy(day)
    out = daily.select("*", *[F.lag(value, n).over(w).alias(f"lag_{n}") for n in at], F.weekday(day).alias("day_of_week"))
    return out.dropna(subset=[f"lag_{n}" for n in at])


def knee(distances: DataFrame, key: list[str], value: str) -> DataFrame:
    """For each key the value farthest from the chord of its sorted values; of equals the first."""
    ends = distances.groupBy(*[F.col(k).alias(f"end_{k}") for k in key]).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    rows = ranked(distances.select(*key, F.col(value).alias("v")), key, "v").withColumns({"i": F.col("rank_i"), "n": F.col("rank_n") - 1})
    rows = rows.join(ends, same(key, [f"end_{k}" for k in key]))
    far = F.abs((F.col("hi") - F.col("lo")) * F.col("i") - F.col("n") * (F.col("v") - F.col("lo")))
    return rows.groupBy(*key).agg(F.max_by("v", F.struct(F.round(far, 9), -F.col("i"))).alias("knee"))


def along_heading(heading: Column) -> Column:
    """How far a position lies in the direction of a heading (degrees), for the order of a line's points."""
    return F.col("latitude") * F.cos(F.radians(heading)) + F.col("longitude") * F.sin(F.radians(heading))


def parsed_polyline(json: Column) -> Column:
    """The array of [lat, lon] of a polyline's JSON; null if it is none."""
    return F.from_json(json, "array<array<double>>")


def polyline(points: DataFrame, key: str, order: Column, n: int = 10) -> DataFrame:
    """n points of each line at even ranks in the given order, rounded to 4 digits, as an array of [lat, lon] and as JSON."""
    rows = ranked(points.select(key, "latitude", "longitude", "event_id", order.alias("o")), [key], "o", "event_id")
    rows = rows.select(key, "latitude", "longitude", F.col("rank_i").alias("i"), F.col("rank_n").alias("m"))
    steps = F.array(*[F.lit(k) for k in range(n)])
    wanted = F.transform(steps, lambda k: F.floor(k * (F.col("m") - 1) / (n - 1)))
    some = rows.filter(F.array_contains(wanted, F.col("i")))
    pair = F.array(*[rounded_half(F.col(c), 4) for c in ("latitude", "longitude")])
    line = F.transform(F.sort_array(F.collect_list(F.struct("i", pair.alias("p")))), lambda x: x["p"])
    return some.groupBy(key).agg(line.alias("polyline")).withColumn("polyline_json", F.to_json("polyline"))


def time_split(rows: DataFrame, order: list[str], part: float = 0.8) -> DataFrame:
    """rows with is_train: the first int(n * part) in the given order.

    The cut is found without one task holding all rows: rows are range-partitioned by the order, partitions are counted
    (one number each), and a rank is a partition's offset plus the place within it.
    """
    dealt = settled(rows.repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.spark_partition_id().alias("__p"), F.monotonically_increasing_id().alias("__m")))
    sizes = dealt.groupBy("__p").agg(F.count("*").alias("__n"), F.min("__m").alias("__first"))
    w = Window.orderBy("__p")  # a row per partition
    offsets = sizes.select(F.col("__p").alias("__q"), "__first", (F.sum("__n").over(w) - F.col("__n")).alias("__before"))
    total = F.floor(F.lit(rows.count()) * part)
    out = dealt.join(F.broadcast(offsets), F.col("__p") == F.col("__q"))
    return out.select(*rows.columns, (F.col("__before") + F.col("__m") - F.col("__first") < total).alias("is_train"))


def error_table(pairs: DataFrame, group: str, model: str, baseline: str, labels: list[str]) -> DataFrame:
    """n, median and p90 of two errors, by group (listed ones only) and OVERALL (all rows)."""
    both = F.explode(F.array(F.lit("OVERALL"), F.when(F.col(group).isin(labels), F.col(group))))
    rows = pairs.select(both.alias(group), F.col(model).alias("m"), F.col(baseline).alias("b")).filter(F.col(group).isNotNull())
    out = rows.groupBy(group).agg(F.count("*").alias("n"))
    for c, name in (("m", "model"), ("b", "baseline")):
        q = percentiles(rows, [group], c, [0.5, 0.9])
        out = out.join(q.select(F.col(group).alias("q_g"), *[F.round(F.col("percentiles")[i], 3).alias(f"{name}_{n}") for i, n in enumerate(("median", "p90"))]), F.col(group) == F.col("q_g"), "left").drop("q_g")
    return out
