"""Contextual anomaly scores against a corridor table, in three variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.enrich import quality_flags
from ..functions.geo import angle_between
from .joins import nearest

KM, DEG, Z = 50.0, 45.0, 3.0
CORRIDOR = ["corridor_id", "modal_heading_deg", "altitude_mean_ft", "altitude_std_ft", "altitude_p50_ft"]


def part(value: Column, scale: float) -> Column:
    """value over scale within 0 to 1; null stays null, which least() and greatest() alone would lose."""
    return F.when(value.isNotNull(), F.least(F.greatest(value / scale, F.lit(0.0)), F.lit(1.0)))


def joined(reasons: Column) -> Column:
    return F.coalesce(F.nullif(F.array_join(reasons, ","), F.lit("")), F.lit("none"))


def against_corridors(points: DataFrame, corridors: DataFrame) -> DataFrame:
    """points with the nearest corridor and the three deviations from it."""
    near = nearest(points, corridors, "centroid_lat", "centroid_lon", CORRIDOR, prefix="near_")
    return near.withColumns({
        "heading_deviation_deg": angle_between(F.col("true_track"), F.col("near_modal_heading_deg")),
        "altitude_z": (F.col("altitude_ft") - F.col("near_altitude_mean_ft")) / F.col("near_altitude_std_ft"),
    }).withColumnRenamed("near_km", "lateral_distance_km")


def contextual_score(points: DataFrame, corridors: DataFrame, variant: str = "model", threshold: float | None = None) -> DataFrame:
    """Adds anomaly_score, ml_reasons and is_ml_anomaly.

    model: quarters of distance, heading, altitude and noise (corridor_id -1); a null part leaves the score null and not
    flagged; threshold 0.78. reference_table: thirds, a null part counts 1; 0.78. adhoc: the larger of rule flags
    / 3 and the mean of three parts, null parts 0, spread taken as a tenth of the median altitude; flagged over 0.65
    or by any rule.
    """
    rows = against_corridors(points, corridors)
    lateral, heading = F.col("lateral_distance_km"), F.col("heading_deviation_deg")
    z = F.col("altitude_z")
    if variant == "adhoc":
        z = (F.col("baro_altitude") * 3.28084 - F.col("near_altitude_p50_ft")) / F.greatest(F.col("near_altitude_p50_ft") * 0.1, F.lit(1.0))
    parts = [part(lateral, KM), part(heading, DEG), part(F.abs(z), Z)]
    names = ["far_from_corridor", "heading_deviation", "altitude_outlier"]
    raw = [lateral / KM, heading / DEG, F.abs(z) / Z]
    if variant == "model":
        noise = F.col("corridor_id") == -1
        score = 0.25 * parts[0] + 0.25 * parts[1] + 0.25 * parts[2] + 0.25 * noise.cast("double")
        reasons = F.array_compact(F.array(*[F.when(r > 0.5, n) for r, n in zip(raw, names)], F.when(noise, "unassigned_corridor")))
        flag = F.coalesce(score > (threshold or 0.78), F.lit(False))
    elif variant == "reference_table":
        parts = [F.coalesce(p, F.lit(1.0)) for p in parts]
        score = (parts[0] + parts[1] + parts[2]) / 3
        reasons = F.array_compact(F.array(*[F.when(p > 0.5, n) for p, n in zip(parts, names)]))
        flag = score > (threshold or 0.78)
    else:
        parts = [F.coalesce(p, F.lit(0.0)) for p in parts]
        rules = F.size(quality_flags())
        score = F.round(F.greatest(F.least(rules / 3, F.lit(1.0)), (parts[0] + parts[1] + parts[2]) / 3), 4)
        reasons = F.array_compact(F.array(*[F.when(p > 0.5, n) for p, n in zip(parts, names)]))
        flag = (score > (threshold or 0.65)) | (rules > 0)
    return rows.select("*", score.alias("anomaly_score"), joined(reasons).alias("ml_reasons"), flag.alias("is_ml_anomaly"))


def anomaly_events(scored: DataFrame) -> DataFrame:
    """Rows that a rule or the model flags, with the merged reasons; speed_kmh is in km/h."""
    rules = F.col("data_quality_flags")
    kind = joined(F.array_compact(F.array(F.nullif(F.array_join(rules, ","), F.lit("")), F.when(F.col("is_ml_anomaly"), F.nullif(F.col("ml_reasons"), F.lit("none"))))))
    hit = F.col("is_ml_anomaly") | (F.size(rules) > 0)
    return scored.withColumn("anomaly_type", kind).filter(hit).select("event_id", "icao24", "callsign", "origin_country", "ingest_ts", "latitude", "longitude", "altitude_ft", "speed_kmh", "anomaly_score", "anomaly_type", "is_ml_anomaly")
