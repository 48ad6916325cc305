"""Texts that the DuckDB twins share."""

from __future__ import annotations

from ..functions.enrich import BANDS, BINS, COUNTRY_REGIONS, MODEL_BOXES, REGION_BOXES
from ..functions.geo import BASE32
from ..sources.dims import AIRLINES, AIRPORTS, REGISTRATIONS, values_sql
from ..sources.states import STATES


def boxes(rows: list[tuple], lat: str, lon: str, missing: str, other: str) -> str:
    tests = " ".join(f"when {lat} between {a} and {b} and {lon} between {c} and {d} then '{n}'" for n, a, b, c, d in rows)
    return f"case when {lat} is null or {lon} is null then '{missing}' {tests} else '{other}' end"


def country_region(c: str) -> str:
    tests = " ".join(f"when {c} in ({', '.join(repr(x) for x in v)}) then '{k}'" for k, v in COUNTRY_REGIONS.items())
    return f"case {tests} else 'Other' end"


def geohash(lat: str, lon: str) -> str:
    x, y = f"least(8191, cast(floor(({lon} + 180) / 360 * 8192) as bigint))", f"least(4095, cast(floor(({lat} + 90) / 180 * 4096) as bigint))"
    bit = lambda i: f"(({x if i % 2 == 0 else y}) >> {(12 if i % 2 == 0 else 11) - i // 2}) % 2"
    letters = " || ".join(f"substring('{BASE32}', cast({' + '.join(f'{16 >> j} * ({bit(5 * k + j)})' for j in range(5))} + 1 as int), 1)" for k in range(5))
    return f"case when {lat} is not null and {lon} is not null then {letters} end"


BAND = "case when altitude_ft is null then 'unknown' " + " ".join(f"when altitude_ft < {t} then '{n}'" for t, n in BANDS) + " else '40000ft+' end"
BIN = "case when coalesce(altitude_ft, -1) <= -1000 or coalesce(altitude_ft, -1) > 100000 then null " + " ".join(f"when coalesce(altitude_ft, -1) <= {t} then '{n}'" for t, n in BINS) + " end"
MODEL_REGION = boxes(MODEL_BOXES, "latitude", "longitude", "other", "other")
FLAGS = """list_filter([case when latitude is null or longitude is null then 'missing_position' end,
  case when time_position is null or last_contact - time_position > 60 then 'stale_contact' end,
  case when velocity > 400 or velocity < 0 then 'implausible_speed' end,
  case when baro_altitude > 15000 or baro_altitude < -500 then 'implausible_altitude' end,
  case when abs(vertical_rate) > 50 then 'implausible_vertical_rate' end,
  case when squawk in ('7500', '7600', '7700') then 'emergency_squawk' end], lambda x: x is not null)"""
S0 = "s0 as (" + STATES.format(t="cast(floor(epoch(ts)) as bigint)", events="events", nation="nation") + ")"
SILVER = f"""{S0},
silver as (select *, round(velocity * 3.6, 2) speed_kmh, round(coalesce(baro_altitude, geo_altitude) * 3.28084, 1) altitude_ft,
  case when on_ground then 'ground' when vertical_rate > 1 then 'climb' when vertical_rate < -1 then 'descent' else 'cruise' end flight_phase,
  {boxes(REGION_BOXES, "latitude", "longitude", "Unknown", "Other")} region, {FLAGS} flags from s0)"""
AIRLINES_CTE = values_sql(AIRLINES, "airlines", "prefix, airline")
REGISTRATIONS_CTE = values_sql(REGISTRATIONS, "registrations", "prefix, country")
AIRPORTS_CTE = values_sql(AIRPORTS, "airports", "iata, country, airport_lat, airport_lon")
WITH_AIRLINE = f"{SILVER}, {AIRLINES_CTE}, flown as (select s.*, coalesce(a.airline, 'Unknown/Other') airline from silver s left join airlines a on upper(substring(s.callsign, 1, 3)) = a.prefix and length(s.callsign) >= 3)"
MEASURES = "count(distinct icao24) flight_count, round(avg(altitude_ft), 4) avg_altitude_ft, round(avg(speed_kmh), 4) avg_speed_kmh"
HOURS = "hours as (select date_trunc('hour', ingest_ts) hour_bucket, count(distinct icao24) flight_count, avg(altitude_ft) avg_altitude_ft, avg(speed_kmh) avg_speed_kmh from silver group by 1)"
COUNTRIES = "countries as (select origin_country, count(distinct icao24) flight_count, avg(altitude_ft) avg_altitude_ft, avg(speed_kmh) avg_speed_kmh from silver group by 1)"
ACTIVITY = "activity as (select airline, count(distinct icao24) flight_count, avg(altitude_ft) avg_altitude_ft, avg(speed_kmh) avg_speed_kmh from flown group by 1)"


def haversine(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    return f"(2 * 6371e0 * asin(sqrt(least(1e0, pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2)))))"


def bearing(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    x = f"sin(radians({lon2} - {lon1})) * cos(radians({lat2}))"
    y = f"cos(radians({lat1})) * sin(radians({lat2})) - sin(radians({lat1})) * cos(radians({lat2})) * cos(radians({lon2} - {lon1}))"
    return f"(((degrees(atan2({x}, {y})) % 360) + 360) % 360)"


def angle(a: str, b: str) -> str:
    return f"abs(((({a} - {b} + 180) % 360) + 360) % 360 - 180)"


#: A corridor table from the data itself: one corridor per country, of its cruise rows.
CORRIDORS = f"""cruise as (select *, {MODEL_REGION} model_region from silver where not on_ground and flight_phase = 'cruise' and latitude is not null and longitude is not null and true_track is not null),
corridors as (select cast(dense_rank() over (order by origin_country) - 1 as bigint) corridor_id, * from (select origin_country,
  round(avg(latitude), 5) centroid_lat, round(avg(longitude), 5) centroid_lon,
  round(((degrees(atan2(avg(sin(radians(true_track))), avg(cos(radians(true_track))))) % 360) + 360) % 360, 1) modal_heading_deg,
  avg(altitude_ft) altitude_mean_ft, case when stddev_samp(altitude_ft) = 0 then 1.0 else stddev_samp(altitude_ft) end altitude_std_ft,
  quantile_cont(altitude_ft, 0.1) altitude_p10_ft, quantile_cont(altitude_ft, 0.5) altitude_p50_ft, quantile_cont(altitude_ft, 0.9) altitude_p90_ft,
  count(*) member_count, min(model_region) region from cruise group by origin_country))"""
#: Every cruise row with its nearest corridor; every fifth event counts as noise.
NEAR = f"""near as (select * from (select c.* exclude (region), k.corridor_id near_id, k.modal_heading_deg, k.altitude_mean_ft, k.altitude_std_ft, k.altitude_p50_ft,
  {haversine("c.latitude", "c.longitude", "k.centroid_lat", "k.centroid_lon")} km, row_number() over (partition by event_id order by {haversine("c.latitude", "c.longitude", "k.centroid_lat", "k.centroid_lon")}, k.corridor_id) rn
  from cruise c, corridors k) where rn = 1),
parts as (select *, event_id % 5 = 0 noise, km / 50 far_part, {angle("true_track", "modal_heading_deg")} / 45 heading, abs((altitude_ft - altitude_mean_ft) / altitude_std_ft) / 3 alt,
  abs((baro_altitude * 3.28084 - altitude_p50_ft) / greatest(altitude_p50_ft * 0.1, 1e0)) / 3 alt2, len(flags) n_rules from near),
scored as (select *, 0.25 * case when far_part is not null then least(far_part, 1e0) end + 0.25 * case when heading is not null then least(heading, 1e0) end + 0.25 * case when alt is not null then least(alt, 1e0) end + 0.25 * cast(noise as double) s0x, case when alt is null then null else s0x end score,
  (case when far_part is not null then least(far_part, 1e0) end + coalesce(case when heading is not null then least(heading, 1e0) end, 1) + coalesce(case when alt is not null then least(alt, 1e0) end, 1)) / 3 ref_score,
  round(greatest(least(n_rules / 3e0, 1e0), (case when far_part is not null then least(far_part, 1e0) end + coalesce(case when heading is not null then least(heading, 1e0) end, 0) + coalesce(case when alt2 is not null then least(alt2, 1e0) end, 0)) / 3), 4) adhoc_score from parts)"""
