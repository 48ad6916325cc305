"""Every registered query over the reference operators, with its DuckDB twin where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import enrich, geo
from ..operators import anomaly, cluster, forecast, joins, legs, marts, rollups, windows
from ..sources import dims, feeds, schemas
from ..sources.shared import settled
from ..sources.states import silver, states
from . import sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
HOUR12 = 12 * 3600


def query(oracle: str | None = None):
    """Register a function under its own name, with its SQL."""

    def register(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return register


def rounded(df: DataFrame, *cols: str, to: int = 4) -> DataFrame:
    """Means and angles to so many digits, so that the order of a sum does not show."""
    return df.select(*[F.round(c, to).alias(c) if c in cols else F.col(c) for c in df.columns])


def flown(spark, sf_dir) -> DataFrame:
    return joins.with_airline(silver(spark, sf_dir), dims.airlines(spark))


# -- enrichment and validation


@query(f"with {sql.SILVER} select event_id, icao24, speed_kmh, altitude_ft, flight_phase, region, array_to_string(flags, ',') flags, {sql.geohash('latitude', 'longitude')} geohash5 from silver")
def silver_enriched(spark, sf_dir):
    return silver(spark, sf_dir).select("event_id", "icao24", "speed_kmh", "altitude_ft", "flight_phase", "region", F.array_join("data_quality_flags", ",").alias("flags"), "geohash5")


@query(f"with {sql.SILVER} select flag, count(*) n from (select unnest(flags) flag from silver) group by flag")
def quality_flag_counts(spark, sf_dir):
    return silver(spark, sf_dir).select(F.explode("data_quality_flags").alias("flag")).groupBy("flag").agg(F.count("*").alias("n"))


@query(f"with {sql.SILVER} select event_id, case when length(trim(callsign)) > 0 then trim(callsign) end callsign, velocity < 0 or velocity > 250 too_fast from silver where latitude is not null and longitude is not null and velocity >= 0 and (true_track is null or true_track between 0 and 360)")
def historical_filter(spark, sf_dir):
    rows = states(spark, sf_dir).filter("latitude is not null and longitude is not null and last_contact is not null and velocity >= 0 and (true_track is null or true_track between 0 and 360)")
    return rows.select("event_id", enrich.clean_callsign(F.col("callsign")).alias("callsign"), ((F.col("velocity") < 0) | (F.col("velocity") > 250)).alias("too_fast"))


@query(f"""with {sql.S0} select event_id, array_to_string(list_filter([case when longitude not between -180 and 180 then 'longitude' end, case when latitude not between -90 and 90 then 'latitude' end,
  case when velocity < 0 then 'velocity' end, case when not (event_id % 17 <> 0) then 'source' end], lambda x: x is not null), ',') errors from s0""")
def record_validation(spark, sf_dir):
    rows = states(spark, sf_dir).withColumns({"source": F.when(F.col("event_id") % 17 == 0, "unknown").otherwise("replay"), "spi": F.lit(False), "position_source": F.lit(0)})
    return rows.select("event_id", F.array_join(enrich.errors(), ",").alias("errors"))


@query(f"""with {sql.S0}, {sql.REGISTRATIONS_CTE}
select event_id, coalesce((select country from registrations r where starts_with(upper(s.registration), r.prefix) order by length(prefix) desc limit 1), 'Unknown') country from s0 s""")
def registration_country(spark, sf_dir):
    return joins.with_registration_country(states(spark, sf_dir), dims.registrations(spark)).select("event_id", "country")


@query(f"with {sql.SILVER} select case when region = 'Asia' then 'South Asia' else region end region, count(*) n from silver where not regexp_matches(icao24, '^00000\\d$') group by 1")
def relabelled_regions(spark, sf_dir):
    rows = silver(spark, sf_dir).filter(~F.col("icao24").rlike(r"^00000\d$")).withColumn("region", F.when(F.col("region") == "Asia", "South Asia").otherwise(F.col("region")))
    return rows.groupBy("region").agg(F.count("*").alias("n"))


# -- rollups


@query(f"with {sql.SILVER} select date_trunc('hour', ingest_ts) hour_bucket, {sql.MEASURES} from silver group by 1")
def traffic_by_hour(spark, sf_dir):
    return rounded(rollups.traffic_by_hour(silver(spark, sf_dir)), "avg_altitude_ft", "avg_speed_kmh")


@query(f"with {sql.SILVER} select origin_country, {sql.MEASURES} from silver group by 1")
def traffic_by_country(spark, sf_dir):
    return rounded(rollups.traffic_by_country(silver(spark, sf_dir)), "avg_altitude_ft", "avg_speed_kmh")


@query(f"with {sql.WITH_AIRLINE} select airline, {sql.MEASURES} from flown group by 1")
def airline_activity(spark, sf_dir):
    return rounded(rollups.airline_activity(flown(spark, sf_dir)), "avg_altitude_ft", "avg_speed_kmh")


@query(f"with {sql.SILVER} select {sql.BAND} altitude_band, count(distinct icao24) flight_count, round(avg(speed_kmh), 4) avg_speed_kmh from silver group by 1")
def altitude_band_distribution(spark, sf_dir):
    return rounded(rollups.altitude_band_distribution(silver(spark, sf_dir)), "avg_speed_kmh")


@query(f"with {sql.SILVER} select altitude_band, count(*) flight_count from (select {sql.BIN} altitude_band from silver) where altitude_band is not null group by 1")
def altitude_bin_rows(spark, sf_dir):
    return rollups.altitude_bin_rows(silver(spark, sf_dir))


@query(f"""with {sql.SILVER}, b(band, label) as (values (0, '0-5,000ft'), (1, '5,000-15,000ft'), (2, '15,000-30,000ft'), (3, '30,000ft+')),
c as (select case when altitude_ft < 5000 then 0 when altitude_ft < 15000 then 1 when altitude_ft < 30000 then 2 else 3 end band, count(*) n from silver where not on_ground and altitude_ft is not null group by 1)
select band, label, coalesce(n, 0) n from b left join c using (band)""")
def altitude_histogram(spark, sf_dir):
    return rollups.altitude_histogram(silver(spark, sf_dir))


LATEST = "latest as (select * exclude (rn) from (select *, row_number() over (partition by icao24 order by ingest_ts desc, event_id desc) rn from silver) where rn = 1)"


@query(f"with {sql.SILVER}, {LATEST} select count(*) active, count(distinct origin_country) countries, round(avg(baro_altitude * 3.28084), 4) avg_altitude_ft, (select count(*) from silver where len(flags) > 0) anomalies from latest")
def stats_overview(spark, sf_dir):
    rows = silver(spark, sf_dir)
    return rounded(rollups.overview(joins.latest_states(rows), rows.filter(F.size("data_quality_flags") > 0)), "avg_altitude_ft")


@query(f"""with {sql.SILVER}, runs as (select event_id % 3 run_ts, date_trunc('hour', ingest_ts) hour_bucket, count(distinct icao24) flight_count, avg(altitude_ft) avg_altitude_ft, avg(speed_kmh) avg_speed_kmh from silver group by all)
select hour_bucket, cast(sum(flight_count) as bigint) flight_count, round(sum(avg_altitude_ft * flight_count) / nullif(sum(flight_count), 0), 6) avg_altitude_ft, round(sum(avg_speed_kmh * flight_count) / nullif(sum(flight_count), 0), 6) avg_speed_kmh from runs group by 1""")
def weighted_hours(spark, sf_dir):
    runs = silver(spark, sf_dir).groupBy((F.col("event_id") % 3).alias("run_ts"), rollups.hour_of(F.col("ingest_ts")).alias("hour_bucket")).agg(*rollups.measures())
    return rounded(rollups.weighted_by_hour(runs), "avg_altitude_ft", "avg_speed_kmh", to=6)


@query(f"with {sql.WITH_AIRLINE} select airline, count(distinct icao24) flight_count from flown where event_id % 5 = (select max(event_id % 5) from flown) group by 1")
def latest_run_airlines(spark, sf_dir):
    runs = flown(spark, sf_dir).withColumn("run_ts", F.col("event_id") % 5)
    return rollups.latest_run(runs).groupBy("airline").agg(F.countDistinct("icao24").alias("flight_count"))


# -- marts


@query(f"""with {sql.SILVER}, {sql.HOURS}, d as (select cast(hour_bucket as date) traffic_date, cast(sum(flight_count) as bigint) total_flights, avg(avg_altitude_ft) a, avg(avg_speed_kmh) s from hours group by 1),
l as (select *, lag(total_flights) over (order by traffic_date) prior_day_flights from d)
select traffic_date, total_flights, round(a, 4) avg_altitude_ft, round(s, 4) avg_speed_kmh, prior_day_flights, round((total_flights - prior_day_flights) * 1e0 / nullif(prior_day_flights, 0) * 100, 2) day_over_day_change_pct from l""")
def mart_traffic_daily(spark, sf_dir):
    return rounded(marts.traffic_daily(rollups.traffic_by_hour(silver(spark, sf_dir))), "avg_altitude_ft", "avg_speed_kmh")


@query(f"with {sql.SILVER}, {sql.COUNTRIES} select {sql.country_region('origin_country')} region, count(distinct origin_country) num_countries, cast(sum(flight_count) as bigint) total_flights, round(avg(avg_altitude_ft), 4) avg_altitude_ft, round(avg(avg_speed_kmh), 4) avg_speed_kmh from countries group by 1")
def mart_region_summary(spark, sf_dir):
    return rounded(marts.region_summary(rollups.traffic_by_country(silver(spark, sf_dir))), "avg_altitude_ft", "avg_speed_kmh")


@query(f"with {sql.WITH_AIRLINE}, {sql.ACTIVITY} select md5(airline) airline_key, airline airline_name, airline = 'Unknown/Other' is_unclassified, flight_count, round(avg_speed_kmh, 4) avg_speed_kmh, round(avg_altitude_ft, 4) avg_altitude_ft, row_number() over (order by flight_count desc, airline) activity_rank from activity")
def mart_airline_leaderboard(spark, sf_dir):
    return rounded(marts.airline_leaderboard(rollups.airline_activity(flown(spark, sf_dir))), "avg_speed_kmh", "avg_altitude_ft")


@query(f"""with {sql.SILVER}, ev as (select *, array_to_string(flags, ',') anomaly_type, len(flags) / 3e0 anomaly_score from silver where len(flags) > 0)
select anomaly_type, coalesce({sql.country_region('origin_country')}, 'Other') region, date_trunc('hour', ingest_ts) anomaly_hour, count(*) anomaly_count, round(avg(anomaly_score), 4) avg_anomaly_score from ev group by all""")
def mart_anomaly_summary(spark, sf_dir):
    rows = silver(spark, sf_dir)
    events = rows.filter(F.size("data_quality_flags") > 0).select("origin_country", "ingest_ts", F.array_join("data_quality_flags", ",").alias("anomaly_type"), (F.size("data_quality_flags") / 3).alias("anomaly_score"))
    return rounded(marts.anomaly_summary(events, rollups.traffic_by_country(rows)), "avg_anomaly_score")


CUTS = "a as (select o_custkey k, count(*) n, sum(cast(o_totalprice as decimal(18, 2))) v from orders where cast(o_orderdate as date) < date '1997-01-01' group by 1), b as (select o_custkey k, count(*) n, sum(cast(o_totalprice as decimal(18, 2))) v from orders group by 1)"


@query(f"""with {CUTS}, m as (select a.k, a.n, cast(a.v as double) v, b.k bk, a.n is not distinct from b.n and a.v is not distinct from b.v same from a left join b on a.k = b.k)
select k, n, v, 'day1' valid_from, case when bk is not null and not same then 'day2' end valid_to from m
union all select b.k, b.n, cast(b.v as double), 'day2', null from b left join a on a.k = b.k where a.k is null or a.n is distinct from b.n or a.v is distinct from b.v""")
def scd2_snapshot(spark, sf_dir):
    """Orders of each customer as they stood at the end of 1996, then all of them: whole tables at two times."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    at = lambda rows: rows.groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("n"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("v"))
    first = marts.snapshot(None, at(orders.filter(F.to_date("o_orderdate") < F.lit("1997-01-01").cast("date"))), "k", ["n", "v"], "day1")
    return marts.snapshot(first, at(orders), "k", ["n", "v"], "day2")


@query("""select 'not_null:orders.o_custkey' "check", count(*) filter (o_custkey is null) failing_rows, case when count(*) filter (o_custkey is null) = 0 then 'pass' else 'fail' end status from orders
union all select 'unique:orders.o_orderkey', (select count(*) from (select o_orderkey from orders group by 1 having count(*) > 1)), case when (select count(*) from (select o_orderkey from orders group by 1 having count(*) > 1)) = 0 then 'pass' else 'fail' end
union all select 'accepted:orders.o_orderstatus', count(*) filter (o_orderstatus not in ('O', 'F')), case when count(*) filter (o_orderstatus not in ('O', 'F')) = 0 then 'pass' else 'fail' end from orders
union all select 'relationship:lineitem.l_orderkey', (select count(*) from lineitem where l_orderkey not in (select o_orderkey from orders)), case when (select count(*) from lineitem where l_orderkey not in (select o_orderkey from orders)) = 0 then 'pass' else 'fail' end
union all select 'non_negative:customer.c_acctbal', count(*) filter (c_acctbal < 0), case when count(*) filter (c_acctbal < 0) = 0 then 'pass' else 'fail' end from customer""")
def data_checks(spark, sf_dir):
    tables = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("orders", "lineitem", "customer")}
    return marts.run_checks(tables, [("not_null", "orders", "o_custkey"), ("unique", "orders", "o_orderkey"), ("accepted", "orders", "o_orderstatus", ["O", "F"]), ("relationship", "lineitem", "l_orderkey", "orders", "o_orderkey"), ("non_negative", "customer", "c_acctbal")])


@query(f"with {sql.S0} select age_s, case when age_s > 86400 then 'error' when age_s > 21600 then 'warn' else 'pass' end status from (select cast(date_sub('second', max(ingest_ts), timestamp '2024-02-01 00:00:00') as bigint) age_s from s0)")
def freshness_check(spark, sf_dir):
    return marts.freshness(states(spark, sf_dir), "ingest_ts", "2024-02-01 00:00:00")


@query(f"with {sql.S0} select count(*) n_rows, count(distinct event_id) n_keys, count(*) = count(distinct event_id) is_unique from s0")
def duplicate_key_proof(spark, sf_dir):
    return states(spark, sf_dir).agg(F.count("*").alias("n_rows"), F.countDistinct("event_id").alias("n_keys")).withColumn("is_unique", F.col("n_rows") == F.col("n_keys"))


# -- joins


@query(f"""with {sql.SILVER}, {sql.AIRPORTS_CTE}, n as (select event_id, iata, {sql.haversine('latitude', 'longitude', 'airport_lat', 'airport_lon')} km from silver, airports where latitude is not null and longitude is not null),
b as (select *, row_number() over (partition by event_id order by km, iata) rn from n)
select s.event_id, case when km <= 500 then iata end nearest_iata, round(case when km <= 500 then km end, 3) nearest_km from silver s left join b on s.event_id = b.event_id and rn = 1""")
def nearest_airport(spark, sf_dir):
    out = joins.nearest(states(spark, sf_dir), dims.airports(spark), "airport_lat", "airport_lon", ["iata"], max_km=500)
    return out.select("event_id", "nearest_iata", F.round("nearest_km", 3).alias("nearest_km"))


@query(f"""with {sql.SILVER}, {sql.AIRPORTS_CTE}, c as (select event_id, iata, speed_kmh, {sql.haversine('latitude', 'longitude', 'airport_lat', 'airport_lon')} km, {sql.angle(sql.bearing('latitude', 'longitude', 'airport_lat', 'airport_lon'), 'true_track')} diff from silver, airports where not on_ground and iata <> 'FRA' and latitude is not null),
b as (select *, row_number() over (partition by event_id order by diff, iata) rn from c where km between 100 and 3000 and diff <= 60)
select s.event_id, iata predicted_iata, round(km, 3) predicted_km, round(diff, 3) bearing_diff, case when b.speed_kmh > 5 then round(round(km, 6) / b.speed_kmh * 60, 1) end eta_minutes from silver s left join b on s.event_id = b.event_id and rn = 1 where not on_ground""")
def predicted_destination(spark, sf_dir):
    rows = silver(spark, sf_dir).filter("not on_ground").withColumn("departure_iata", F.lit("FRA"))
    out = joins.heading_destination(rows, dims.airports(spark))
    return out.select("event_id", "predicted_iata", F.round("predicted_km", 3).alias("predicted_km"), F.round("bearing_diff", 3).alias("bearing_diff"), joins.eta_minutes(F.round("predicted_km", 6), F.col("speed_kmh")).alias("eta_minutes"))


ASOF = f"""with {sql.SILVER}, p as (select event_id, icao24, time_position t from silver where time_position is not null),
m as (select a.event_id, a.icao24, a.t, b.event_id future_event, b.t future_t, row_number() over (partition by a.event_id order by abs(b.t - a.t - {HOUR12}), b.t, b.event_id) rn from p a join p b on a.icao24 = b.icao24 and abs(b.t - a.t - {HOUR12}) <= 7200)
select event_id, icao24, t, future_t from m where rn = 1 and future_t <> t"""


@query(ASOF)
def asof_pairs(spark, sf_dir):
    p = states(spark, sf_dir).filter("time_position is not null").select("event_id", "icao24", F.col("time_position").alias("t"), (F.col("time_position") + HOUR12).alias("target"))
    right = p.select("icao24", F.col("t").alias("future_t"))
    return joins.asof_nearest(p, right, "icao24", "target", "future_t", 7200, "event_id").filter("future_t <> t").select("event_id", "icao24", "t", "future_t")


@query(f"with {sql.SILVER}, {LATEST} select event_id, icao24, origin_country, latitude, longitude from latest where latitude between -40 and 40 and longitude between -120 and 120")
def live_flights_box(spark, sf_dir):
    live = joins.latest_states(states(spark, sf_dir)).filter("latitude between -40 and 40 and longitude between -120 and 120")
    return live.select("event_id", "icao24", "origin_country", "latitude", "longitude")


@query(f"with {sql.SILVER}, k as (select *, row_number() over (partition by icao24, time_position order by ingest_ts desc, event_id desc) rn from silver) select icao24, time_position, event_id from k where rn = 1")
def keep_last_dedup(spark, sf_dir):
    return joins.keep_last(states(spark, sf_dir)).select("icao24", "time_position", "event_id")


@query(f"with {sql.S0}, f as (select icao24, max(event_id % 3) feed from s0 group by 1), r as (select s.*, event_id % 3 feed from s0 s) select icao24, feed, max(event_id) event_id from r join f using (icao24, feed) group by 1, 2")
def merged_feeds(spark, sf_dir):
    rows = states(spark, sf_dir).withColumn("feed", F.col("event_id") % 3)
    feeds = [rows.filter(F.col("feed") == i).groupBy("icao24", "feed").agg(F.max("event_id").alias("event_id")) for i in range(3)]
    return joins.merged_feeds(feeds)


@query(f"with {sql.SILVER} select event_id, icao24 from silver s where exists (select 1 from silver a where a.icao24 = s.icao24 and len(a.flags) >= 3)")
def flights_with_anomalies(spark, sf_dir):
    rows = silver(spark, sf_dir)
    return rows.join(rows.filter(F.size("data_quality_flags") >= 3).select("icao24"), "icao24", "left_semi").select("event_id", "icao24")


RELATIONS = [("lineitem", "l_suppkey", "supplier", "s_suppkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("orders", "o_custkey", "customer", "c_custkey"), ("documents", "doc_id", "labels", "doc_id"), ("customer", "c_custkey", "orders", "o_custkey")]


@query(" union all ".join(f"select '{a}.{x}' relation, count(*) orphans from {a} where {x} not in (select {y} from {b})" for a, x, b, y in RELATIONS))
def referential_orphans(spark, sf_dir):
    """Rows without a partner along key relations, those that hold and those that need not."""
    read = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    out = None
    for a, x, b, y in RELATIONS:
        rows = read(a).select(F.col(x).alias("k")).join(read(b).select(F.col(y).alias("p")), F.col("k") == F.col("p"), "left_anti").agg(F.lit(f"{a}.{x}").alias("relation"), F.count("*").alias("orphans"))
        out = rows if out is None else out.unionByName(rows)
    return out


# -- windows


@query(f"""with {sql.SILVER}, h as (select *, row_number() over (partition by icao24 order by last_contact desc, event_id desc) rn from silver where latitude is not null and longitude is not null)
select icao24, count(*) n, string_agg(cast(last_contact as varchar), ',' order by rn desc) times from h where rn <= 5 group by 1""")
def last_five(spark, sf_dir):
    out = windows.last_history(states(spark, sf_dir))
    return out.select("icao24", "n", F.array_join(F.transform("track", lambda p: p["t"].cast("string")), ",").alias("times"))


LAGS = f"""a as (select *, sin(radians(true_track)) ts, cos(radians(true_track)) tc from silver where not on_ground and latitude is not null and longitude is not null and velocity is not null and true_track is not null and vertical_rate is not null and baro_altitude is not null and time_position is not null),
f as (select *, greatest(time_position - lag(time_position) over w, 1) dt, lag(ts) over w ps, lag(tc) over w pc, lag(velocity) over w pv, lag(vertical_rate) over w pr from a window w as (partition by icao24 order by time_position, event_id)),
g as (select *, degrees(atan2(ts * pc - tc * ps, ts * ps + tc * pc)) / dt turn_rate, (velocity - pv) / dt acceleration, (vertical_rate - pr) / dt climb_trend from f where ps is not null)"""


@query(f"with {sql.SILVER}, {LAGS} select event_id, dt, round(turn_rate, 6) + 0e0 turn_rate, round(acceleration, 6) + 0e0 acceleration, round(climb_trend, 6) + 0e0 climb_trend from g where abs(abs(turn_rate * dt) - 180) > 1e-6")
def lag_features(spark, sf_dir):
    out = windows.lag_features(states(spark, sf_dir)).filter("abs(abs(turn_rate * dt) - 180) > 1e-6")
    return out.select("event_id", "dt", *[(F.round(c, 6) + 0.0).alias(c) for c in ("turn_rate", "acceleration", "climb_trend")])


DAILY = "daily as (select o_orderpriority series, cast(o_orderdate as date) d, count(*) n from orders group by all)"
RUN = f"""{DAILY}, r0 as (select *, case when date_diff('day', lag(d) over (partition by series order by d), d) <> 1 then 1 else 0 end new from daily), r1 as (select *, sum(new) over (partition by series order by d) run from r0),
r2 as (select series, run, count(*) m from r1 group by all), r3 as (select series, run, row_number() over (partition by series order by m desc, run) rn from r2), best as (select r1.series, d, n from r1 join r3 on r1.series = r3.series and r1.run = r3.run and rn = 1)"""


def daily_orders(spark, sf_dir) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return orders.groupBy(F.col("o_orderpriority").alias("series"), F.to_date("o_orderdate").alias("d")).agg(F.count("*").alias("n"))


@query(f"with {RUN} select series, min(d) first_day, max(d) last_day, count(*) n_days from best group by 1")
def longest_daily_run(spark, sf_dir):
    return windows.longest_run(daily_orders(spark, sf_dir), ["series"], "d").groupBy("series").agg(F.min("d").alias("first_day"), F.max("d").alias("last_day"), F.count("*").alias("n_days"))


@query(f"with {RUN} select * from (select series, d, n, lag(n, 1) over w lag_1, lag(n, 2) over w lag_2, lag(n, 3) over w lag_3, lag(n, 7) over w lag_7, cast(isodow(d) - 1 as int) day_of_week from best window w as (partition by series order by d)) where lag_7 is not null")
def daily_lag_features(spark, sf_dir):
    return windows.lags(windows.longest_run(daily_orders(spark, sf_dir), ["series"], "d"), ["series"], "d", "n")


@query(f"with {sql.SILVER} select event_id, row_number() over (order by last_contact, event_id) <= floor((select count(*) from silver) * 0.8) is_train from silver")
def time_ordered_split(spark, sf_dir):
    return windows.time_split(states(spark, sf_dir).select("event_id", "last_contact"), ["last_contact", "event_id"]).select("event_id", "is_train")


# -- anomalies


def corridor_table(spark, sf_dir) -> DataFrame:
    """One corridor per country, of its cruise rows; computed once, as it is counted before it is used."""
    cruise = silver(spark, sf_dir).filter("not on_ground and flight_phase = 'cruise'").dropna(subset=["latitude", "longitude", "true_track"])
    cruise = cruise.withColumn("region", enrich.first_box(F.col("latitude"), F.col("longitude"), enrich.MODEL_BOXES, "other", "other"))
    rows = rollups.corridor_summary(cruise.withColumn("corridor_id", F.col("origin_country")))
    return settled(rows.withColumnRenamed("corridor_id", "origin_country").withColumn("corridor_id", (F.dense_rank().over(Window.orderBy("origin_country")) - 1).cast("long")))  # a row per country


def cruise_points(spark, sf_dir) -> DataFrame:
    rows = silver(spark, sf_dir).filter("not on_ground and flight_phase = 'cruise'").dropna(subset=["latitude", "longitude", "true_track"])
    return rows.withColumn("corridor_id", F.when(F.col("event_id") % 5 == 0, -1).otherwise(0))


@query(f"with {sql.SILVER}, {sql.CORRIDORS} select corridor_id, origin_country, centroid_lat, centroid_lon, modal_heading_deg, round(altitude_mean_ft, 4) altitude_mean_ft, round(altitude_std_ft, 4) altitude_std_ft, round(altitude_p10_ft, 4) altitude_p10_ft, round(altitude_p50_ft, 4) altitude_p50_ft, round(altitude_p90_ft, 4) altitude_p90_ft, member_count, region from corridors")
def corridor_summary(spark, sf_dir):
    return rounded(corridor_table(spark, sf_dir), "altitude_mean_ft", "altitude_std_ft", "altitude_p10_ft", "altitude_p50_ft", "altitude_p90_ft")


@query(f"""with {sql.SILVER}, {sql.CORRIDORS}, {sql.NEAR} select event_id, near_id near_corridor_id, round(km, 3) lateral_distance_km, round(score, 4) anomaly_score, coalesce(score > 0.78, false) is_ml_anomaly,
  coalesce(nullif(array_to_string(list_filter([case when far_part > 0.5 then 'far_from_corridor' end, case when heading > 0.5 then 'heading_deviation' end, case when alt > 0.5 then 'altitude_outlier' end, case when noise then 'unassigned_corridor' end], lambda x: x is not null), ','), ''), 'none') ml_reasons from scored""")
def anomaly_model_scores(spark, sf_dir):
    out = anomaly.contextual_score(cruise_points(spark, sf_dir), corridor_table(spark, sf_dir))
    return rounded(out.select("event_id", "near_corridor_id", F.round("lateral_distance_km", 3).alias("lateral_distance_km"), "anomaly_score", "is_ml_anomaly", "ml_reasons"), "anomaly_score")


@query(f"with {sql.SILVER}, {sql.CORRIDORS}, {sql.NEAR} select event_id, round(ref_score, 4) anomaly_score, ref_score > 0.78 is_ml_anomaly from scored")
def anomaly_reference_scores(spark, sf_dir):
    return rounded(anomaly.contextual_score(cruise_points(spark, sf_dir), corridor_table(spark, sf_dir), "reference_table").select("event_id", "anomaly_score", "is_ml_anomaly"), "anomaly_score")


@query(f"with {sql.SILVER}, {sql.CORRIDORS}, {sql.NEAR} select event_id, adhoc_score anomaly_score, adhoc_score > 0.65 or n_rules > 0 is_ml_anomaly from scored")
def anomaly_adhoc_scores(spark, sf_dir):
    return anomaly.contextual_score(cruise_points(spark, sf_dir), corridor_table(spark, sf_dir), "adhoc").select("event_id", "anomaly_score", "is_ml_anomaly")


@query(f"with {sql.SILVER}, {sql.CORRIDORS}, {sql.NEAR}, o as (select n_rules > 0 r, coalesce(score > 0.6, false) m from scored), c as (select round(avg(case when r then cast(m as int) end), 6) catch_rate from o) select catch_rate, kind, n from c, (select 'rules_only' kind, count(*) filter (r and not m) n from o union all select 'ml_only', count(*) filter (m and not r) from o union all select 'both', count(*) filter (r and m) from o union all select 'neither', count(*) filter (not r and not m) from o union all select 'total', count(*) from o)")
def rule_model_overlap(spark, sf_dir):
    out = anomaly.contextual_score(cruise_points(spark, sf_dir), corridor_table(spark, sf_dir), threshold=0.6)
    return rounded(rollups.overlap(out.select((F.size("data_quality_flags") > 0).alias("rule"), F.col("is_ml_anomaly").alias("model"))), "catch_rate", to=6)


@query(f"with {sql.SILVER}, {sql.CORRIDORS}, {sql.NEAR}, t(threshold) as (values (0.3e0), (0.5e0), (0.62e0), (0.78e0)) select threshold, round((select avg(cast(score > threshold as int)) from scored), 6) share from t")
def threshold_sweep(spark, sf_dir):
    out = anomaly.contextual_score(cruise_points(spark, sf_dir), corridor_table(spark, sf_dir))
    return rounded(rollups.threshold_sweep(out, [0.3, 0.5, 0.62, 0.78]), "share", to=6)


@query(f"with {sql.SILVER}, {sql.CORRIDORS}, {sql.NEAR}, q(pct) as (values (0.01e0), (0.05e0), (0.1e0), (0.25e0), (0.5e0), (0.75e0), (0.9e0), (0.95e0), (0.99e0)), l as (select list(score order by score) v from scored where score is not null) select pct, round(v[cast(floor(pct * (len(v) - 1)) as bigint) + 1] + (pct * (len(v) - 1) - floor(pct * (len(v) - 1))) * (v[least(cast(floor(pct * (len(v) - 1)) as bigint) + 2, len(v))] - v[cast(floor(pct * (len(v) - 1)) as bigint) + 1]), 5) \"value\", round((select avg(cast(score > 0.78 as int)) from scored), 6) flagged from q, l")
def score_percentiles(spark, sf_dir):
    out = rollups.score_percentiles(anomaly.contextual_score(cruise_points(spark, sf_dir), corridor_table(spark, sf_dir)), 0.78)
    return out.select("pct", F.round("value", 5).alias("value"), F.round("flagged", 6).alias("flagged"))


@query(f"with {sql.SILVER}, {sql.CORRIDORS}, {sql.NEAR} select event_id, round(score, 4) anomaly_score from scored where len(flags) > 0 or coalesce(score > 0.78, false)")
def anomaly_events(spark, sf_dir):
    return rounded(anomaly.anomaly_events(anomaly.contextual_score(cruise_points(spark, sf_dir), corridor_table(spark, sf_dir))).select("event_id", "anomaly_score"), "anomaly_score")


# -- top lists and pages


@query(f"with {sql.SILVER} select event_id, ingest_ts from silver where len(flags) > 0 order by ingest_ts desc, event_id limit 50 offset 50")
def anomaly_page(spark, sf_dir):
    return silver(spark, sf_dir).filter(F.size("data_quality_flags") > 0).select("event_id", "ingest_ts").orderBy(F.desc("ingest_ts"), "event_id").offset(50).limit(50)


@query(f"with {sql.SILVER}, {sql.COUNTRIES} select origin_country, flight_count from countries order by flight_count desc, origin_country limit 10")
def top_countries(spark, sf_dir):
    return rollups.traffic_by_country(silver(spark, sf_dir)).select("origin_country", "flight_count").orderBy(F.desc("flight_count"), "origin_country").limit(10)


@query(f"with {sql.SILVER}, {sql.HOURS} select hour_bucket, flight_count from hours order by hour_bucket desc limit 24")
def last_hours(spark, sf_dir):
    return rollups.traffic_by_hour(silver(spark, sf_dir)).select("hour_bucket", "flight_count").orderBy(F.desc("hour_bucket")).limit(24)


@query(f"with {sql.SILVER}, {sql.CORRIDORS} select corridor_id, member_count from corridors order by member_count desc, corridor_id limit 10")
def top_corridors(spark, sf_dir):
    return corridor_table(spark, sf_dir).select("corridor_id", "member_count").orderBy(F.desc("member_count"), "corridor_id").limit(10)


# -- movement


@query(f"""with {sql.SILVER}, d as (select event_id, radians(latitude) la, radians(longitude) lo, velocity * 300 / 1000 / 6371e0 far, radians(true_track) c, latitude, longitude from silver where not on_ground and latitude is not null),
e as (select *, asin(sin(la) * cos(far) + cos(la) * sin(far) * cos(c)) la2 from d)
select event_id, round(degrees(la2), 6) pred_lat, round((((degrees(lo + atan2(sin(c) * sin(far) * cos(la), cos(far) - sin(la) * sin(la2))) + 540) % 360) + 360) % 360 - 180, 6) pred_lon from e""")
def dead_reckoning(spark, sf_dir):
    c = F.col
    lat, lon = geo.destination(c("latitude"), c("longitude"), c("velocity"), c("true_track"), F.lit(300))
    return states(spark, sf_dir).filter("not on_ground and latitude is not null").select("event_id", F.round(lat, 6).alias("pred_lat"), F.round(geo.wrap_lon(lon), 6).alias("pred_lon"))


@query(f"""with {sql.SILVER}, p as (select * from silver where not on_ground and latitude is not null and time_position is not null),
m as (select a.event_id, a.flight_phase, b.time_position - a.time_position secs, a.latitude, a.longitude, b.latitude la2, b.longitude lo2, row_number() over (partition by a.event_id order by abs(b.time_position - a.time_position - {HOUR12}), b.time_position, b.event_id) rn from p a join p b on a.icao24 = b.icao24 and abs(b.time_position - a.time_position - {HOUR12}) <= 7200),
e as (select flight_phase, {sql.haversine('latitude', 'longitude', 'la2', 'lo2')} km, abs(secs - {HOUR12}) / 60e0 off from m where rn = 1 and secs <> 0)
select coalesce(flight_phase, 'OVERALL') flight_phase, count(*) n, round(quantile_cont(km, 0.5), 3) model_median, round(quantile_cont(km, 0.9), 3) model_p90, round(quantile_cont(off, 0.5), 3) baseline_median, round(quantile_cont(off, 0.9), 3) baseline_p90 from e group by rollup(flight_phase) having flight_phase is null or flight_phase in ('cruise', 'climb')""")
def pair_error_table(spark, sf_dir):
    p = silver(spark, sf_dir).filter("not on_ground and latitude is not null and time_position is not null")
    left = p.select("event_id", "icao24", "flight_phase", F.col("time_position").alias("t"), (F.col("time_position") + HOUR12).alias("target"), "latitude", "longitude")
    right = p.select("icao24", F.col("time_position").alias("t2"), F.col("latitude").alias("la2"), F.col("longitude").alias("lo2"))
    pairs = joins.asof_nearest(left, right, "icao24", "target", "t2", 7200, "event_id").filter("t2 <> t")
    km = geo.haversine_km(F.col("latitude"), F.col("longitude"), F.col("la2"), F.col("lo2"))
    rows = pairs.select("flight_phase", km.alias("km"), (F.abs(F.col("t2") - F.col("t") - HOUR12) / 60).alias("off"))
    return windows.error_table(rows, "flight_phase", "km", "off", ["cruise", "climb"])


LEG_ROWS = f"""{sql.AIRPORTS_CTE}, n as (select event_id, iata, {sql.haversine('latitude', 'longitude', 'airport_lat', 'airport_lon')} km from silver, airports where latitude is not null and longitude is not null),
near1 as (select event_id, iata from (select *, row_number() over (partition by event_id order by km, iata) rn from n) where rn = 1 and km <= 3000),
r as (select s.*, near1.iata at_iata, lag(on_ground) over (partition by icao24 order by last_contact, s.event_id) was from silver s left join near1 on s.event_id = near1.event_id),
l as (select *, sum(cast(takeoff as int)) over (partition by icao24 order by last_contact, event_id) leg from (select *, coalesce(was and not on_ground, false) takeoff from r)),
m as (select *, first_value(case when takeoff and latitude is not null then at_iata end) over w dep0, first_value(case when takeoff and latitude is not null then last_contact end) over w time0,
  coalesce(sum(cast(on_ground as int)) over (w rows between unbounded preceding and 1 preceding), 0) landed from l window w as (partition by icao24, leg order by last_contact, event_id)),
known as (select *, case when landed = 0 and leg > 0 then dep0 end dep_iata, case when landed = 0 and leg > 0 and dep0 is not null then time0 end dep_time from m)"""


@query(f"""with {sql.SILVER}, {LEG_ROWS}, done as (select k.*, greatest((last_contact - dep_time) / 60e0, 0.01e0) mins, {sql.haversine('airport_lat', 'airport_lon', 'latitude', 'longitude')} km from known k join airports on dep_iata = iata where on_ground and not was and at_iata is not null)
select icao24, last_contact arrival_time, coalesce(callsign, '') callsign, dep_iata departure_iata, dep_time departure_time, at_iata arrival_iata, round(mins, 1) duration_min, round(km, 1) distance_km, round(km / (mins / 60), 1) avg_speed_kmh from done""")
def flight_routes(spark, sf_dir):
    return legs.routes(states(spark, sf_dir), dims.airports(spark), radius_km=3000)


@query(f"with {sql.SILVER}, {LEG_ROWS} select icao24, last_contact ts, latitude, longitude, round(coalesce(baro_altitude, geo_altitude) * 3.28084, 1) altitude_ft, dep_iata, last_contact + 172800 expires_at from known where not on_ground and dep_iata is not null")
def trajectory_points(spark, sf_dir):
    return legs.trajectory_points(states(spark, sf_dir), dims.airports(spark), radius_km=3000)


# -- clusters

SCALED = f"""c0 as (select event_id, {sql.MODEL_REGION} region, latitude x0, longitude x1, sin(radians(true_track)) x2, cos(radians(true_track)) x3 from silver where not on_ground and flight_phase = 'cruise' and latitude is not null and longitude is not null),
sc as (select event_id, region, {", ".join(f"(x{i} - avg(x{i}) over g) / case when stddev_pop(x{i}) over g = 0 then 1 else stddev_pop(x{i}) over g end x{i}" for i in range(4))} from c0 window g as (partition by region)),
pairs as (select a.event_id a, b.event_id b, a.region, sqrt({" + ".join(f"pow(a.x{i} - b.x{i}, 2)" for i in range(4))}) d from sc a join sc b on a.region = b.region)"""


@query(f"""with {sql.SILVER}, {SCALED}, deg as (select a, count(*) filter (d <= 0.3) n from pairs group by 1), core as (select a from deg where n >= 8),
near as (select distinct a from pairs where d <= 0.3 and b in (select a from core))
select event_id, region, event_id in (select a from core) is_core, event_id not in (select a from near) is_noise from sc""")
def dbscan_points(spark, sf_dir):
    points = cluster.route_features(silver(spark, sf_dir))
    return cluster.dbscan(points, "region", 0.3).select("event_id", "region", "is_core", (F.col("label") == -1).alias("is_noise"))


@query(f"with {sql.SILVER}, {SCALED}, k as (select a, region, d, row_number() over (partition by a order by d) rn from pairs) select a event_id, region, round(d, 6) k_distance from k where rn = 8")
def k_distances(spark, sf_dir):
    points = cluster.route_features(silver(spark, sf_dir))
    return cluster.k_distances(points, "region").select("event_id", "region", F.round("k_distance", 6).alias("k_distance"))


@query(f"""with recursive {sql.SILVER}, {SCALED}, deg as (select a, count(*) filter (d <= 0.3) n from pairs group by 1), core as (select a from deg where n >= 8),
e as (select a, b from pairs where d <= 0.3 and a <> b and a in (select a from core) and b in (select a from core)),
lab(a, label) using key (a) as (
  select a, a from core
  union
  select e.b, min(l.label) from lab l join e on e.a = l.a join recurring.lab r on r.a = e.b where l.label < r.label group by e.b),
border as (select pairs.a, min(lab.label) label from pairs join lab on pairs.b = lab.a where d <= 0.3 group by 1),
labelled as (select sc.event_id, sc.region model_region, coalesce(lab.label, border.label) label from sc left join lab on event_id = lab.a left join border on event_id = border.a),
m as (select s.*, model_region, dense_rank() over (order by model_region, label) - 1 corridor_id from labelled join silver s using (event_id) where label is not null)
select cast(corridor_id as bigint) corridor_id, round(avg(latitude), 5) centroid_lat, round(avg(longitude), 5) centroid_lon,
  round(((degrees(atan2(avg(sin(radians(true_track))), avg(cos(radians(true_track))))) % 360) + 360) % 360, 1) modal_heading_deg,
  round(avg(altitude_ft), 4) altitude_mean_ft, round(case when stddev_samp(altitude_ft) = 0 then 1.0 else stddev_samp(altitude_ft) end, 4) altitude_std_ft,
  round(quantile_cont(altitude_ft, 0.1), 4) altitude_p10_ft, round(quantile_cont(altitude_ft, 0.5), 4) altitude_p50_ft, round(quantile_cont(altitude_ft, 0.9), 4) altitude_p90_ft,
  count(*) member_count, min(model_region) region from m group by corridor_id""")
def corridors_by_density(spark, sf_dir):
    """Corridors found by density, with their summary."""
    points = settled(cluster.route_features(silver(spark, sf_dir)))
    labels = cluster.numbered(cluster.dbscan(points, "region", 0.3), "region")
    found = rollups.corridor_summary(settled(points.join(labels.select("event_id", "corridor_id"), "event_id").filter("corridor_id >= 0")))
    return rounded(found, "altitude_mean_ft", "altitude_std_ft", "altitude_p10_ft", "altitude_p50_ft", "altitude_p90_ft")


@query(f"with {sql.SILVER}, {sql.CORRIDORS}, r as (select origin_country, latitude, longitude, row_number() over (partition by origin_country order by latitude, event_id) - 1 i, count(*) over (partition by origin_country) m from cruise), k as (select unnest(range(0, 10)) k) select origin_country, count(*) n_points, round(sum(latitude), 1) sum_lat, round(sum(longitude), 1) sum_lon from (select distinct origin_country, i, round(latitude, 4) latitude, round(longitude, 4) longitude from r, k where i = floor(k * (m - 1) / 9e0)) group by 1")
def corridor_polylines(spark, sf_dir):
    lines = windows.polyline(cruise_points(spark, sf_dir), "origin_country", F.col("latitude"))
    total = lambda i: geo.rounded_half(F.aggregate(F.transform("polyline", lambda p: p[i]), F.lit(0.0), lambda a, x: a + x), 1)
    return lines.select("origin_country", F.size("polyline").cast("long").alias("n_points"), total(0).alias("sum_lat"), total(1).alias("sum_lon"))


SNAPSHOT = 5_000  # states of a snapshot, about


def snapshots(rows, payload, bound=SNAPSHOT):
    """rows grouped into snapshots of an hour: busy hours are dealt by hash, so that none has many more than `bound` states."""
    rows = rows.withColumns({"h": rollups.hour_of(F.col("ingest_ts")), "__payload": payload})
    parts = rows.groupBy("h").agg(F.ceil(F.count("*") / bound).alias("parts"))
    dealt = rows.join(parts.withColumnRenamed("h", "__h"), F.col("h").eqNullSafe(F.col("__h")))
    return dealt.groupBy("h", F.pmod(F.xxhash64(*[c for c in rows.columns if c not in ("h", "__payload")]), F.col("parts")).alias("part"))


@query(f"with {sql.S0} select icao24, last_contact, case when length(trim(callsign)) > 0 then trim(callsign) end callsign, time_position, latitude, on_ground, squawk from s0")
def positional_feed(spark, sf_dir):
    """States written as positional snapshots of bounded size, one or more an hour, and read back."""
    rows = states(spark, sf_dir).withColumns({"spi": F.lit(False), "position_source": F.lit(0), "sensors": F.lit(None).cast("string")})
    values = F.array(*[F.col(c).cast("string") for c in schemas.POSITIONS])
    bodies = snapshots(rows, values).agg(F.to_json(F.struct(F.max("last_contact").alias("time"), F.collect_list("__payload").alias("states"))).alias("body"))
    return feeds.from_positions(bodies).select("icao24", "last_contact", "callsign", "time_position", "latitude", "on_ground", "squawk")


@query(f"""with {sql.S0}, {sql.REGISTRATIONS_CTE} select icao24, last_contact, round(velocity * 0.514444, 6) velocity, case when not on_ground then round(baro_altitude * 0.3048, 6) end baro_altitude, on_ground,
  coalesce((select country from registrations r where starts_with(upper(s.registration), r.prefix) order by length(prefix) desc limit 1), 'Unknown') origin_country from s0 s""")
def object_feed(spark, sf_dir):
    """States written as object snapshots of bounded size, one or more an hour, and read back with their units changed."""
    c = F.col
    rows = states(spark, sf_dir)
    one = F.struct(c("icao24").alias("hex"), c("callsign").alias("flight"), c("registration").alias("r"), F.when(c("on_ground"), "ground").otherwise(c("baro_altitude").cast("string")).alias("alt_baro"), c("velocity").alias("gs"), c("true_track").alias("track"), c("latitude").alias("lat"), c("longitude").alias("lon"), (F.lit(2_000_000_000) - c("last_contact")).cast("double").alias("seen"))
    bodies = snapshots(rows, one).agg(F.to_json(F.struct(F.lit(2_000_000_000_000).alias("now"), F.collect_list("__payload").alias("ac"))).alias("body"))
    out = feeds.from_objects(bodies)
    return out.select("icao24", "last_contact", F.round("velocity", 6).alias("velocity"), F.round("baro_altitude", 6).alias("baro_altitude"), "on_ground", "origin_country")


@query(f"""with {RUN}, l as (select * from (select series, d, n, lag(n, 1) over w lag_1, lag(n, 7) over w lag_7 from best window w as (partition by series order by d)) where lag_7 is not null)
select 'lag_1' "method", round(avg(abs(n - lag_1)), 5) mae, round(sqrt(avg(pow(n - lag_1, 2))), 5) rmse, round(avg(abs(n - lag_1) / n), 5) mape from l union all select 'lag_7', round(avg(abs(n - lag_7)), 5), round(sqrt(avg(pow(n - lag_7, 2))), 5), round(avg(abs(n - lag_7) / n), 5) from l""")
def forecast_baselines(spark, sf_dir):
    rows = windows.lags(windows.longest_run(daily_orders(spark, sf_dir), ["series"], "d"), ["series"], "d", "n")
    return rounded(forecast.metrics(rows, "n", ["lag_1", "lag_7"]), "mae", "rmse", "mape", to=5)


@query()
def daily_forecast(spark, sf_dir):
    """The next seven days of every series of orders."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    daily = orders.groupBy((F.col("o_custkey") % 3).alias("series"), F.to_date("o_orderdate").alias("d")).agg(F.count("*").alias("n"))
    return forecast.forecast(daily, "series", "d", "n")


def trajectory_pairs(spark, sf_dir) -> DataFrame:
    rows = forecast.with_phase(windows.lag_features(silver(spark, sf_dir)))
    left = rows.select("event_id", "icao24", "last_contact", "eval_phase", "true_track", *forecast.MOTION, F.col("time_position").alias("t"), (F.col("time_position") + HOUR12).alias("target"))
    right = rows.select("icao24", F.col("time_position").alias("t2"), F.col("latitude").alias("future_latitude"), F.col("longitude").alias("future_longitude"))
    return joins.asof_nearest(left, right, "icao24", "target", "t2", 7200, "event_id").filter("t2 <> t").withColumn("seconds", F.col("t2") - F.col("t"))


@query()
def trajectory_errors(spark, sf_dir):
    """Held-out errors of the learned trajectory and of dead reckoning, by phase; no row if there are under 2,000 pairs."""
    out = forecast.trajectory(trajectory_pairs(spark, sf_dir))
    if out is None:
        return spark.createDataFrame([], "eval_phase string, n long, model_median double, model_p90 double, baseline_median double, baseline_p90 double")
    return windows.error_table(out, "eval_phase", "model_km", "baseline_km", ["cruise", "climb", "descent", "turning"])
