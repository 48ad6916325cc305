"""Rollups of the clean event table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.enrich import band, bin_of
from ..functions.geo import circular_mean
from ..sources.shared import settled
from .ranks import percentiles


def measures(approximate: bool = False, rsd: float = 0.02) -> list[Column]:
    """Distinct aircraft and mean altitude and speed; approximate counts keep a sketch instead of a set."""
    count = F.approx_count_distinct("icao24", rsd) if approximate else F.countDistinct("icao24")
    return [count.alias("flight_count"), F.avg("altitude_ft").alias("avg_altitude_ft"), F.avg("speed_kmh").alias("avg_speed_kmh")]


def hour_of(ts: Column) -> Column:
    return F.date_trunc("hour", ts).cast("timestamp_ntz")


def traffic_by_hour(silver: DataFrame) -> DataFrame:
    return silver.groupBy(hour_of(F.col("ingest_ts")).alias("hour_bucket")).agg(*measures())


def traffic_by_country(silver: DataFrame) -> DataFrame:
    return silver.groupBy("origin_country").agg(*measures())


def airline_activity(silver_with_airline: DataFrame) -> DataFrame:
    return silver_with_airline.groupBy("airline").agg(*measures())


def altitude_band_distribution(silver: DataFrame) -> DataFrame:
    return silver.groupBy(band(F.col("altitude_ft")).alias("altitude_band")).agg(F.countDistinct("icao24").alias("flight_count"), F.avg("speed_kmh").alias("avg_speed_kmh"))


def altitude_bin_rows(silver: DataFrame) -> DataFrame:
    """The second report: rows by bin; rows outside all bins are left out."""
    return silver.select(bin_of(F.col("altitude_ft")).alias("altitude_band")).filter("altitude_band is not null").groupBy("altitude_band").agg(F.count("*").alias("flight_count"))


def altitude_histogram(silver: DataFrame) -> DataFrame:
    """Four bands of airborne rows with a known altitude; bands without rows count 0."""
    bands = [(0, "0-5,000ft", 5000.0), (1, "5,000-15,000ft", 15000.0), (2, "15,000-30,000ft", 30000.0), (3, "30,000ft+", float("inf"))]
    dim = silver.sparkSession.createDataFrame(bands, "band int, label string, top double")
    which = None
    for i, _, top in bands[:-1]:
        which = (F if which is None else which).when(F.col("altitude_ft") < top, i)
    counts = silver.filter("not on_ground and altitude_ft is not null").groupBy(which.otherwise(3).alias("band")).agg(F.count("*").alias("n"))
    return F.broadcast(dim).join(counts, "band", "left").select("band", "label", F.coalesce("n", F.lit(0)).alias("n"))


def overview(latest: DataFrame, anomalies: DataFrame) -> DataFrame:
    """Key figures over the latest states, with the number of anomaly events."""
    kpi = latest.agg(F.count("*").alias("active"), F.countDistinct("origin_country").alias("countries"), F.avg(F.col("baro_altitude") * 3.28084).alias("avg_altitude_ft"))
    # one row each
    return kpi.join(anomalies.agg(F.count("*").alias("anomalies")))


def weighted_by_hour(runs: DataFrame) -> DataFrame:
    """Hourly figures of many runs, means weighted by their counts; null means weigh in the divisor only."""
    mean = lambda c: F.try_divide(F.sum(F.col(c) * F.col("flight_count")), F.sum("flight_count")).alias(c)
    return runs.groupBy("hour_bucket").agg(F.sum("flight_count").alias("flight_count"), mean("avg_altitude_ft"), mean("avg_speed_kmh"))


def latest_run(runs: DataFrame) -> DataFrame:
    """Rows of the newest run. The newest is found first, so that its partition alone is read."""
    newest = runs.agg(F.max("run_ts")).head()[0]
    return runs.filter(F.col("run_ts") == F.lit(newest))


def corridor_summary(points: DataFrame) -> DataFrame:
    """One row per corridor_id: centre, heading, altitude mean, deviation and percentiles, members, region."""
    q = percentiles(points, ["corridor_id"], "altitude_ft", [0.1, 0.5, 0.9]).select(F.col("corridor_id").alias("q_id"), *[F.col("percentiles")[i].alias(f"altitude_{n}_ft") for i, n in enumerate(("p10", "p50", "p90"))])
    rows = points.groupBy("corridor_id").agg(
        F.round(F.avg("latitude"), 5).alias("centroid_lat"), F.round(F.avg("longitude"), 5).alias("centroid_lon"),
        F.round(circular_mean(F.col("true_track")), 1).alias("modal_heading_deg"),
        F.avg("altitude_ft").alias("altitude_mean_ft"),
        F.when(F.stddev_samp("altitude_ft") == 0, 1.0).otherwise(F.stddev_samp("altitude_ft")).alias("altitude_std_ft"),
        F.count("*").alias("member_count"), F.min("region").alias("region"),
    )
    return rows.join(q, F.col("corridor_id").eqNullSafe(F.col("q_id")), "left").drop("q_id")


def score_percentiles(scores: DataFrame, threshold: float, at=(0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99)) -> DataFrame:
    """pct, value and the share flagged at the threshold; one row per percentile."""
    scores = settled(scores.select("anomaly_score"))  # read twice, and dear
    one = percentiles(scores, [], "anomaly_score", list(at)).join(scores.agg(F.avg((F.col("anomaly_score") > threshold).cast("int")).alias("flagged"))).withColumnRenamed("percentiles", "v")  # one row each
    return one.select(F.posexplode("v").alias("i", "value"), "flagged").select(F.element_at(F.array(*map(F.lit, at)), F.col("i") + 1).alias("pct"), "value", "flagged")


def threshold_sweep(scores: DataFrame, thresholds: list[float]) -> DataFrame:
    """Share flagged at each threshold, in one pass."""
    shares = scores.agg(*[F.avg((F.col("anomaly_score") > t).cast("int")).alias(f"s{i}") for i, t in enumerate(thresholds)])
    pairs = F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"s{i}").alias("share")) for i, t in enumerate(thresholds)])
    return shares.select(F.inline(pairs))


def overlap(flags: DataFrame) -> DataFrame:
    """Five rows (kind, n): rules only, model only, both, neither, total, and the share of rule rows the model finds."""
    r, m = F.col("rule"), F.col("model")
    one = flags.agg(F.count_if(r & ~m).alias("a"), F.count_if(~r & m).alias("b"), F.count_if(r & m).alias("c"), F.count_if(~r & ~m).alias("d"), F.count("*").alias("e"), F.avg(F.when(r, m.cast("int"))).alias("catch_rate"))
    return one.select("catch_rate", F.expr("stack(5, 'rules_only', a, 'ml_only', b, 'both', c, 'neither', d, 'total', e) as (kind, n)"))
