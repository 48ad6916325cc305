"""Queries for reports, top lists, pages and checks, registered beside those of the catalog."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import _parse_datatype_string

from ..functions import enrich
from ..operators import cluster, forecast, joins, legs, marts, reports, rollups, windows
from ..sources import dims, schemas
from ..sources.shared import stored
from ..sources.states import silver, states
from . import sql
from .catalog import ASOF, LATEST, LEG_ROWS, cruise_points, corridor_table, flown, query, rounded, trajectory_pairs


def scored(spark, sf_dir):
    from ..operators import anomaly

    return anomaly.contextual_score(cruise_points(spark, sf_dir), corridor_table(spark, sf_dir))


# -- top lists and pages


@query(f"with {sql.SILVER}, {sql.CORRIDORS}, {sql.NEAR} select event_id, round(score, 4) anomaly_score from scored where len(flags) = 0 and coalesce(score > 0.5, false) order by round(score, 4) desc, event_id limit 20")
def top_model_only(spark, sf_dir):
    """The 20 highest scores that no rule flags."""
    rows = rounded(scored(spark, sf_dir), "anomaly_score").filter((F.size("data_quality_flags") == 0) & (F.col("anomaly_score") > 0.5))
    return reports.top(rows.select("event_id", "anomaly_score"), [F.desc("anomaly_score"), F.col("event_id")], 20)


@query(f"with {sql.SILVER}, {sql.CORRIDORS}, {sql.NEAR} select event_id, round(score, 4) anomaly_score from scored where score > 0.5 order by 2 desc, 1 limit 25")
def highest_scores(spark, sf_dir):
    rows = rounded(scored(spark, sf_dir).filter("anomaly_score > 0.5"), "anomaly_score")
    return reports.top(rows.select("event_id", "anomaly_score"), [F.desc("anomaly_score"), F.col("event_id")], 25)


@query(f"with {sql.SILVER}, {sql.CORRIDORS}, {sql.NEAR} select event_id, round(score, 4) anomaly_score from scored where coalesce(score > 0.78, false)")
def flagged_only(spark, sf_dir):
    return rounded(scored(spark, sf_dir).filter("is_ml_anomaly").select("event_id", "anomaly_score"), "anomaly_score")


@query(f"with {sql.WITH_AIRLINE}, {sql.ACTIVITY} select airline, flight_count from activity order by flight_count desc, airline limit 5")
def top_airlines(spark, sf_dir):
    return reports.top(rollups.airline_activity(flown(spark, sf_dir)).select("airline", "flight_count"), [F.desc("flight_count"), F.col("airline")], 5)


@query(f"with {sql.SILVER}, {sql.COUNTRIES} select * from (select origin_country, flight_count from countries order by flight_count desc, origin_country limit 10) order by flight_count, origin_country")
def top_countries_ascending(spark, sf_dir):
    rows = rollups.traffic_by_country(silver(spark, sf_dir)).select("origin_country", "flight_count")
    return reports.top(rows, [F.desc("flight_count"), F.col("origin_country")], 10, [F.asc("flight_count"), F.col("origin_country")])


@query(f"with {sql.SILVER}, a as (select event_id, ingest_ts from silver where len(flags) > 0) select *, (select count(*) from a) total from a order by ingest_ts desc, event_id limit 50")
def anomaly_page_total(spark, sf_dir):
    rows = silver(spark, sf_dir).filter(F.size("data_quality_flags") > 0).select("event_id", "ingest_ts")
    return reports.page(rows, [F.desc("ingest_ts"), F.col("event_id")], 50)


@query(f"with {sql.SILVER}, {LATEST} select event_id, icao24 from latest where latitude between -40 and 40 and longitude between -120 and 120 order by icao24 limit 20")
def live_box_limited(spark, sf_dir):
    rows = joins.in_box(joins.latest_states(states(spark, sf_dir)), -40, 40, -120, 120, limit=20)
    return rows.select("event_id", "icao24")


# -- pairs and forecasts


@query(f"with g as (select future_t - t gap from ({ASOF})) select cast(min(gap) as double) \"min\", quantile_cont(gap, 0.1) p10, quantile_cont(gap, 0.5) median, quantile_cont(gap, 0.9) p90, cast(max(gap) as double) \"max\", round(avg(gap), 4) mean from g")
def pair_gaps(spark, sf_dir):
    from .catalog import asof_pairs

    return rounded(reports.gap_distribution(asof_pairs(spark, sf_dir).withColumn("gap", F.col("future_t") - F.col("t")), "gap"), "mean")


@query(f"with p as ({ASOF}) select case when event_id % 3 = 0 then 'simulator' else 'replay' end source, count(*) n from p group by 1")
def pairs_by_source(spark, sf_dir):
    from .catalog import asof_pairs

    return reports.value_counts(asof_pairs(spark, sf_dir).withColumn("source", F.when(F.col("event_id") % 3 == 0, "simulator").otherwise("replay")), "source")


@query(f"with {sql.SILVER}, {sql.CORRIDORS} select corridor_id, round(altitude_mean_ft - 1.2816 * altitude_std_ft, 3) p10_ft, round(altitude_mean_ft + 1.2816 * altitude_std_ft, 3) p90_ft from corridors")
def corridor_normal_band(spark, sf_dir):
    low, high = reports.normal_percentiles(F.col("altitude_mean_ft"), F.col("altitude_std_ft"))
    return corridor_table(spark, sf_dir).select("corridor_id", F.round(low, 3).alias("p10_ft"), F.round(high, 3).alias("p90_ft"))


@query(f"with {sql.SILVER} select h \"hour\", count(*) n, round(sin(2 * pi() * h / 24), 9) + 0e0 hour_sin, round(cos(2 * pi() * h / 24), 9) + 0e0 hour_cos from (select cast(hour(ingest_ts) as int) h from silver) group by h")
def hours_on_a_circle(spark, sf_dir):
    rows = silver(spark, sf_dir).groupBy(F.hour("ingest_ts").alias("hour")).agg(F.count("*").alias("n"))
    sin, cos = enrich.cyclic_hour(F.col("hour"))
    return rows.select("hour", "n", (F.round(sin, 9) + 0.0).alias("hour_sin"), (F.round(cos, 9) + 0.0).alias("hour_cos"))


PHASES = "case when abs(turn_rate) > 1 then 'turning' else flight_phase end"


@query(f"""with {sql.SILVER}, a as (select *, sin(radians(true_track)) ts, cos(radians(true_track)) tc from silver where not on_ground and latitude is not null and longitude is not null and velocity is not null and true_track is not null and vertical_rate is not null and baro_altitude is not null and time_position is not null),
f as (select *, greatest(time_position - lag(time_position) over w, 1) dt, lag(ts) over w ps, lag(tc) over w pc from a window w as (partition by icao24 order by time_position, event_id)),
g as (select flight_phase, degrees(atan2(ts * pc - tc * ps, ts * ps + tc * pc)) / dt turn_rate from f where ps is not null) select {PHASES} eval_phase, count(*) n from g group by 1""")
def evaluation_phases(spark, sf_dir):
    return reports.value_counts(forecast.with_phase(windows.lag_features(silver(spark, sf_dir))), "eval_phase")


@query()
def trajectory_importance(spark, sf_dir):
    """Features of the trajectory model with their mean importance over its two targets, fitted on all pairs."""
    models = forecast.motion_models(trajectory_pairs(spark, sf_dir), trees=20)
    return spark.createDataFrame(forecast.importance(models, forecast.MOTION), "feature string, importance double")


@query()
def next_positions(spark, sf_dir):
    """Each aircraft's predicted position from its last two sightings."""
    rows = silver(spark, sf_dir).filter("not on_ground and time_position is not null")
    return forecast.next_positions(trajectory_pairs(spark, sf_dir), rows, trees=20)


@query()
def ghost_trail(spark, sf_dir):
    """Held-out pairs: where aircraft were and where the model put them; no row under 2,000 pairs."""
    out = forecast.trajectory(trajectory_pairs(spark, sf_dir), trees=20)
    if out is None:
        return spark.createDataFrame([], "event_id long, icao24 string, actual_latitude double, actual_longitude double, predicted_latitude double, predicted_longitude double, error_km double")
    return forecast.ghost_trail(out)


def order_days(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return orders.groupBy((F.col("o_custkey") % 3).alias("series"), F.to_date("o_orderdate").alias("d")).agg(F.count("*").alias("n"))


@query()
def forecast_quality(spark, sf_dir):
    """The daily model against both baselines on the last fifth of the days."""
    return forecast.daily_quality(order_days(spark, sf_dir), "series", "d", "n")


@query()
def observed_and_forecast(spark, sf_dir):
    """Daily orders of all customers followed by their forecast, with the last observed day in both."""
    daily = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy(F.lit("all").alias("series"), F.to_date("o_orderdate").alias("d")).agg(F.count("*").cast("double").alias("n"))
    return reports.with_bridge(daily.select("d", "n"), forecast.forecast(daily, "series", "d", "n"), "d", "n")


# -- clusters


def density_sql(region: str) -> str:
    """Core and noise points with eps by the knee of the 8th distances, for each group of at least 16 points."""
    return f"""c0 as (select event_id, {region} region, latitude x0, longitude x1, sin(radians(true_track)) x2, cos(radians(true_track)) x3 from silver where not on_ground and flight_phase = 'cruise' and latitude is not null and longitude is not null and true_track is not null),
sc as (select event_id, region, count(*) over g n_rows, {", ".join(f"(x{i} - avg(x{i}) over g) / case when stddev_pop(x{i}) over g = 0 then 1 else stddev_pop(x{i}) over g end x{i}" for i in range(4))} from c0 window g as (partition by region)),
pairs as (select a.event_id a, b.event_id b, a.region, sqrt({" + ".join(f"pow(a.x{i} - b.x{i}, 2)" for i in range(4))}) d from sc a join sc b on a.region = b.region where a.n_rows >= 16),
k0 as (select a, region, d, row_number() over (partition by a order by d) rn from pairs),
k1 as (select region, d v, row_number() over (partition by region order by d) - 1 i, min(d) over (partition by region) lo, max(d) over (partition by region) hi, count(*) over (partition by region) - 1 n from k0 where rn = 8),
k2 as (select region, v, row_number() over (partition by region order by round(abs((hi - lo) * i - n * (v - lo)), 9) desc, i) rn from k1),
eps as (select region, greatest(v * (1 + 1e-9), 1e-6) eps from k2 where rn = 1),
deg as (select a, region, count(*) filter (d <= eps) n from pairs join eps using (region) group by all), core as (select a, region from deg where n >= 8),
near as (select distinct pairs.a from pairs join eps using (region) join core on pairs.b = core.a where d <= eps)
select sc.region, count(*) n_rows, count(core.a) n_core, count(*) - count(near.a) n_noise, round(any_value(eps), 6) eps from sc left join core on event_id = core.a left join near on event_id = near.a left join eps on sc.region = eps.region group by 1"""


def density(spark, sf_dir, cells: bool):
    points = stored(cluster.route_features(silver(spark, sf_dir), cells))
    eps = cluster.knee_eps(points, "region")
    return cluster.dbscan(points, "region", eps), eps


def density_counts(spark, sf_dir, cells: bool):
    labels, eps = density(spark, sf_dir, cells)
    out = labels.groupBy("region").agg(F.count("*").alias("n_rows"), F.count_if("is_core").alias("n_core"), F.count_if(F.col("label") == -1).alias("n_noise"))
    return out.join(eps, "region", "left").withColumn("eps", F.round("eps", 6))


@query(f"with {sql.SILVER}, {density_sql(sql.MODEL_REGION)}")
def density_by_region(spark, sf_dir):
    return density_counts(spark, sf_dir, False)


@query(f"with {sql.SILVER}, {density_sql('''cast(floor(latitude / 10) as bigint) || '_' || cast(floor(longitude / 10) as bigint)''')}")
def density_by_cell(spark, sf_dir):
    """The same by 10-degree cells; cells of under 16 points are noise."""
    return density_counts(spark, sf_dir, True)


def labels_sql(region: str) -> str:
    """The clusters of density_sql: cores take the smallest core that they are connected to, border points the smallest label next to them."""
    head, _ = density_sql(region).rsplit("\nselect ", 1)
    return head + """,
e as (select pairs.a, pairs.b from pairs join eps using (region) join core x on x.a = pairs.a join core y on y.a = pairs.b where d <= eps and pairs.a <> pairs.b),
lab(a, label) using key (a) as (
  select a, a from core
  union
  select e.b, min(l.label) from lab l join e on e.a = l.a join recurring.lab r on r.a = e.b where l.label < r.label group by e.b),
border as (select pairs.a, min(lab.label) label from pairs join eps using (region) join lab on pairs.b = lab.a where d <= eps group by 1),
labelled as (select sc.event_id, sc.region, coalesce(lab.label, border.label, -1) label from sc left join lab on event_id = lab.a left join border on event_id = border.a)"""


SILHOUETTE = """m as (select p.a, p.region, x.label own, y.label other, sum(d) s, count(*) n from pairs p join labelled x on x.event_id = p.a join labelled y on y.event_id = p.b where x.label <> -1 and y.label <> -1 group by all),
s1 as (select a, region, max(case when own = other then n end) own_n, max(case when own = other then s / nullif(n - 1, 0) end) inside, min(case when own <> other then s / n end) outside from m group by all),
s2 as (select region, avg(case when own_n = 1 then 0 else (outside - inside) / greatest(outside, inside) end) silhouette from s1 where outside is not null group by 1)"""


@query(f"with recursive {sql.SILVER}, {labels_sql(sql.MODEL_REGION)}, {SILHOUETTE} select l.region, count(*) n_rows, count(distinct nullif(label, -1)) n_clusters, round(100 * avg(cast(label = -1 as int)), 2) noise_pct, round(any_value(eps), 6) eps, round(any_value(silhouette), 5) silhouette from labelled l left join eps using (region) left join s2 using (region) group by 1")
def cluster_report(spark, sf_dir):
    """Rows, clusters, share of noise, eps and silhouette by model region."""
    points = stored(cluster.route_features(silver(spark, sf_dir)))
    eps = cluster.knee_eps(points, "region")
    labels = stored(cluster.dbscan(points, "region", eps))
    scores = cluster.silhouette(points, labels, "region").select("region", F.round("silhouette", 5).alias("silhouette"))
    return rounded(reports.cluster_report(labels, "region", eps, scores), "eps", to=6)


# -- checks


@query(f"with {sql.SILVER} select round(avg(cast(region in ('Europe', 'North America', 'South America', 'Africa', 'South Asia', 'Asia', 'Oceania') as int)), 6) share, case when avg(cast(region in ('Europe', 'North America', 'South America', 'Africa', 'South Asia', 'Asia', 'Oceania') as int)) >= 0.9 then 'pass' else 'fail' end status from silver where latitude is not null")
def region_share(spark, sf_dir):
    rows = silver(spark, sf_dir).filter("latitude is not null")
    return rounded(reports.share_check(rows, "region", [b[0] for b in enrich.REGION_BOXES]), "share", to=6)


@query(f"""with {sql.S0}, f as (select 'positional' feed, * from s0 union all select 'object', * from s0) select feed, 'time_position' field, 'nulls ' || count(*) problem from f where time_position is null group by 1
union all select feed, 'latitude', 'nulls ' || count(*) from f where latitude is null group by 1 union all select 'object', 'velocity', 'type float'""")
def feed_contract(spark, sf_dir):
    """Two feeds against a contract of names, types and required fields."""
    rows = states(spark, sf_dir)
    wanted = _parse_datatype_string("icao24 string, time_position bigint, latitude double, velocity double")
    feeds = {"positional": rows, "object": rows.withColumn("velocity", F.col("velocity").cast("float"))}
    return reports.schema_contract(feeds, wanted, ["icao24", "time_position", "latitude"])


@query("select 'none' table_name, cast(0 as bigint) \"value\" where false")
def negative_counts(spark, sf_dir):
    """Rows of the four rollups with a negative count: none."""
    rows = silver(spark, sf_dir)
    tables = {"traffic_by_hour": rollups.traffic_by_hour(rows), "traffic_by_country": rollups.traffic_by_country(rows), "airline_activity": rollups.airline_activity(flown(spark, sf_dir)), "altitude_band_distribution": rollups.altitude_band_distribution(rows)}
    return reports.negative_rows({k: (v, "flight_count") for k, v in tables.items()})


@query(f"with {sql.SILVER} select event_id, round(altitude_ft, 1) altitude_ft from silver where altitude_ft > 30000e0 and flight_phase = 'cruise'")
def bound_parameters(spark, sf_dir):
    """A read query with named parameters over a table."""
    return joins.asked(spark, "select event_id, round(altitude_ft, 1) altitude_ft from {rows} where altitude_ft > :feet and flight_phase = :phase", {"rows": silver(spark, sf_dir)}, {"feet": 30000.0, "phase": "cruise"})


STAGED = f"""with {sql.WITH_AIRLINE}, {sql.HOURS}, {sql.COUNTRIES}, {sql.ACTIVITY}, bands as (select {sql.BAND} altitude_band, count(distinct icao24) flight_count from silver group by 1)
select 'traffic_by_hour' view_name, count(*) n, cast(sum(flight_count) as bigint) flights from hours where hour_bucket is not null union all select 'traffic_by_country', count(*), cast(sum(flight_count) as bigint) from countries where origin_country is not null
union all select 'airline_activity', count(*), cast(sum(flight_count) as bigint) from activity where airline is not null union all select 'altitude_band_distribution', count(*), cast(sum(flight_count) as bigint) from bands where altitude_band is not null
union all select 'anomaly_events', count(*), cast(count(distinct icao24) as bigint) from silver where len(flags) > 0"""


@query(STAGED)
def staging_views(spark, sf_dir):
    """The five staging projections, counted."""
    rows = silver(spark, sf_dir)
    events = rows.filter(F.size("data_quality_flags") > 0).withColumn("anomaly_type", F.array_join("data_quality_flags", ",")).withColumn("anomaly_score", F.size("data_quality_flags") / 3)
    views = {
        "traffic_by_hour": marts.staged_hours(rollups.traffic_by_hour(rows)), "traffic_by_country": marts.staged(rollups.traffic_by_country(rows), "origin_country"),
        "airline_activity": marts.staged(rollups.airline_activity(flown(spark, sf_dir)), "airline"), "altitude_band_distribution": marts.staged(rollups.altitude_band_distribution(rows), "altitude_band"),
    }
    out = marts.staged_events(events).agg(F.lit("anomaly_events").alias("view_name"), F.count("*").alias("n"), F.count_distinct("icao24").alias("flights"))
    for name, view in views.items():
        out = out.unionByName(view.agg(F.lit(name).alias("view_name"), F.count("*").alias("n"), F.sum("flight_count").alias("flights")))
    return out



@query(f"""with {sql.SILVER}, {LEG_ROWS}, fly as (select * from known where not on_ground and dep_iata is not null),
c as (select event_id, iata, {sql.haversine('latitude', 'longitude', 'airport_lat', 'airport_lon')} km, {sql.angle(sql.bearing('latitude', 'longitude', 'airport_lat', 'airport_lon'), 'true_track')} diff from fly, airports where iata <> dep_iata and latitude is not null),
b as (select *, row_number() over (partition by event_id order by diff, iata) rn from c where km between 100 and 3000 and diff <= 60)
select f.event_id, f.icao24, f.dep_iata departure_iata, b.iata predicted_iata, round(km, 1) predicted_km, case when f.speed_kmh > 5 then round(km / f.speed_kmh * 60, 1) end eta_minutes from fly f left join b on f.event_id = b.event_id and rn = 1""")
def legs_in_flight(spark, sf_dir):
    """Airborne rows of legs with a known departure: predicted destination and minutes to it."""
    rows = legs.with_departures(silver(spark, sf_dir), dims.airports(spark), radius_km=3000).filter(~F.col("on_ground") & F.col("dep_iata").isNotNull()).withColumn("departure_iata", F.col("dep_iata"))
    out = joins.heading_destination(rows, dims.airports(spark))
    return out.select("event_id", "icao24", "departure_iata", "predicted_iata", F.round("predicted_km", 1).alias("predicted_km"), joins.eta_minutes(F.col("predicted_km"), F.col("speed_kmh")).alias("eta_minutes"))
