"""Marts, dimensions, history and checks over the rollups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.enrich import country_region, pct_change, surrogate_key


def staged_hours(hours: DataFrame) -> DataFrame:
    return hours.filter("hour_bucket is not null").select("hour_bucket", F.to_date("hour_bucket").alias("traffic_date"), F.col("flight_count").cast("long").alias("flight_count"), "avg_altitude_ft", "avg_speed_kmh")


def staged(rows: DataFrame, key: str) -> DataFrame:
    """A rollup as its staging view: the key trimmed and not null, measures of fixed types."""
    kinds = {"flight_count": "long", "avg_altitude_ft": "double", "avg_speed_kmh": "double"}
    return rows.filter(F.col(key).isNotNull()).select(F.trim(key).alias(key), *[F.col(c).cast(t).alias(c) for c, t in kinds.items() if c in rows.columns])


def staged_events(events: DataFrame) -> DataFrame:
    """Anomaly events as their staging view: names trimmed, an aircraft and a time, a score of fixed type."""
    return events.filter("icao24 is not null and ingest_ts is not null").select(F.trim("icao24").alias("icao24"), F.trim("origin_country").alias("origin_country"), F.trim("anomaly_type").alias("anomaly_type"), F.col("anomaly_score").cast("double").alias("anomaly_score"), F.col("ingest_ts").cast("timestamp_ntz").alias("ingest_ts"))


def dim_airline(activity: DataFrame) -> DataFrame:
    names = activity.select(F.trim("airline").alias("airline_name")).filter("airline_name is not null").distinct()
    return names.select(surrogate_key("airline_name").alias("airline_key"), "airline_name", (F.col("airline_name") == "Unknown/Other").alias("is_unclassified"))


def dim_country(traffic: DataFrame) -> DataFrame:
    names = traffic.select(F.trim("origin_country").alias("origin_country")).filter("origin_country is not null").distinct()
    return names.select(surrogate_key("origin_country").alias("country_key"), "origin_country", country_region(F.col("origin_country")).alias("region"))


def traffic_daily(hours: DataFrame) -> DataFrame:
    daily = staged_hours(hours).groupBy("traffic_date").agg(F.sum("flight_count").alias("total_flights"), F.avg("avg_altitude_ft").alias("avg_altitude_ft"), F.avg("avg_speed_kmh").alias("avg_speed_kmh"))
    w = Window.orderBy("traffic_date")  # a row per day
    return daily.withColumn("prior_day_flights", F.lag("total_flights").over(w)).withColumn("day_over_day_change_pct", pct_change(F.col("total_flights"), F.col("prior_day_flights")))


def region_summary(traffic: DataFrame) -> DataFrame:
    rows = traffic.join(dim_country(traffic), "origin_country")
    return rows.groupBy("region").agg(F.countDistinct("origin_country").alias("num_countries"), F.sum("flight_count").alias("total_flights"), F.avg("avg_altitude_ft").alias("avg_altitude_ft"), F.avg("avg_speed_kmh").alias("avg_speed_kmh")).orderBy(F.desc("total_flights"))


def airline_leaderboard(activity: DataFrame) -> DataFrame:
    rows = activity.join(dim_airline(activity), F.col("airline") == F.col("airline_name"))
    rank = F.row_number().over(Window.orderBy(F.desc("flight_count"), "airline_name"))  # a row per airline
    return rows.select("airline_key", "airline_name", "is_unclassified", "flight_count", "avg_speed_kmh", "avg_altitude_ft", rank.alias("activity_rank"))


def anomaly_summary(events: DataFrame, traffic: DataFrame) -> DataFrame:
    rows = events.withColumn("anomaly_hour", F.date_trunc("hour", "ingest_ts").cast("timestamp_ntz")).join(dim_country(traffic).select("origin_country", "region"), "origin_country", "left")
    return rows.groupBy("anomaly_type", F.coalesce("region", F.lit("Other")).alias("region"), "anomaly_hour").agg(F.count("*").alias("anomaly_count"), F.avg("anomaly_score").alias("avg_anomaly_score")).orderBy(F.desc("anomaly_hour"), F.desc("anomaly_count"))


def snapshot(history: DataFrame | None, current: DataFrame, key: str, check: list[str], at: str) -> DataFrame:
    """Slowly changing history: a changed key's open row is closed at `at` and a new one opened; missing keys stay open."""
    fresh = current.withColumns({"valid_from": F.lit(at), "valid_to": F.lit(None).cast("string")})
    if history is None:
        return fresh
    old, new = history.alias("o"), fresh.alias("n")
    is_open = F.col("o.valid_to").isNull()
    same = F.lit(True)
    for c in check:
        same &= F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}"))
    met = old.join(new, (F.col(f"o.{key}") == F.col(f"n.{key}")) & is_open, "left")
    closed = F.when(is_open & F.col(f"n.{key}").isNotNull() & ~same, F.lit(at)).otherwise(F.col("o.valid_to"))
    kept = met.select(*[closed.alias("valid_to") if c == "valid_to" else F.col(f"o.{c}") for c in history.columns])
    held = history.filter("valid_to is null").alias("o")
    added = new.join(held, (F.col(f"o.{key}") == F.col(f"n.{key}")) & same, "left_anti")
    return kept.unionByName(added)


def run_checks(tables: dict[str, DataFrame], rules: list[tuple]) -> DataFrame:
    """check, failing_rows, status. Rules: ("not_null", table, column), ("unique", table, column), ("accepted", table,
    column, values), ("relationship", table, column, parent, parent_column), ("non_negative", table, column)."""
    out = None
    for kind, table, column, *more in rules:
        df, c = tables[table], F.col(column)
        if kind == "not_null":
            bad = df.agg(F.count_if(c.isNull()).alias("failing_rows"))
        elif kind == "unique":
            bad = df.groupBy(c).count().agg(F.count_if(F.col("count") > 1).alias("failing_rows"))
        elif kind == "accepted":
            bad = df.agg(F.count_if(~c.isin(more[0])).alias("failing_rows"))
        elif kind == "non_negative":
            bad = df.agg(F.count_if(c < 0).alias("failing_rows"))
        else:
            parent = tables[more[0]].select(F.col(more[1]).alias("__k"))
            bad = df.filter(c.isNotNull()).join(parent, c == F.col("__k"), "left_anti").agg(F.count("*").alias("failing_rows"))
        name = f"{kind}:{table}.{column}"
        row = bad.select(F.lit(name).alias("check"), "failing_rows", F.when(F.col("failing_rows") == 0, "pass").otherwise("fail").alias("status"))
        out = row if out is None else out.unionByName(row)
    return out


def sink_status(progress: list[dict], now, no_data_s: int = 1800, delay_s: int = 900) -> list[tuple[str, str]]:
    """(query, status) from the last progress of streaming queries: no_data, delayed or ok at `now` (a datetime).

    no_data: no batch with rows for no_data_s; delayed: the last batch is older than delay_s though rows are waiting.
    """
    from datetime import datetime

    last: dict[str, tuple[datetime | None, datetime, int]] = {}
    for p in progress:
        at = datetime.fromisoformat(p["timestamp"].replace("Z", "+00:00")).replace(tzinfo=None)
        with_rows = last.get(p["name"], (None,))[0]
        last[p["name"]] = (at if p["numInputRows"] else with_rows, at, p.get("waiting", 0))
    age = lambda t: (now - t).total_seconds()
    return sorted((n, "no_data" if rows is None or age(rows) > no_data_s else "delayed" if waiting and age(at) > delay_s else "ok") for n, (rows, at, waiting) in last.items())


def freshness(table: DataFrame, ts: str, now, warn_s: int = 6 * 3600, error_s: int = 24 * 3600) -> DataFrame:
    """age_s of the newest row at `now` and its status."""
    age = F.timestamp_diff("SECOND", F.max(ts), F.lit(now).cast("timestamp_ntz"))
    status = F.when(F.col("age_s").isNull() | (F.col("age_s") > error_s), "error").when(F.col("age_s") > warn_s, "warn").otherwise("pass")
    return table.agg(age.alias("age_s")).withColumn("status", status)
