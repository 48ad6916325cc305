"""States derived from the given tables: each event is an observation of the aircraft that its user stands for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.enrich import enriched

#: One text for Spark and DuckDB but for {t}, the event's time in seconds.
STATES = """
select lpad(cast(user_id as string), 6, '0') icao24,
  case when event_id % 23 = 0 then null else concat(case user_id % 8 when 0 then 'IGO' when 1 then 'AIC' when 2 then 'RYR' when 3 then 'DLH'
    when 4 then 'UAL' when 5 then 'BAW' when 6 then 'VTI' else 'ZZZ' end, cast(100 + user_id as string)) end callsign,
  n_name origin_country,
  case when event_id % 97 = 0 then null else t end time_position, t + event_id % 90 last_contact,
  case when event_id % 53 = 0 then null else ((user_id * 37) % 1200) / 10e0 - 50e0 + (t % 86400) / 86400e0 end latitude,
  case when event_id % 53 = 0 then null else ((user_id * 91) % 3400) / 10e0 - 170e0 + (t % 86400) / 43200e0 end longitude,
  case when event_id % 19 = 0 then null else ((event_id * 131) % 17000) - 700e0 end baro_altitude,
  case when event_id % 31 = 0 then null else ((event_id * 131) % 17000) - 690e0 end geo_altitude,
  event_type = 'signup' on_ground, value velocity,
  cast((user_id * 53 + event_id * 7) % 360 as double) true_track,
  case when event_id % 41 = 0 then 60e0 when event_id % 29 = 0 then null else ((event_id * 17) % 13 - 6) / 4e0 end vertical_rate,
  case when event_id % 211 = 0 then '7700' else lpad(cast((event_id * 7) % 7000 as string), 4, '0') end squawk,
  ts ingest_ts, event_id, case when event_id % 3 = 0 then concat('VT-', cast(user_id as string)) when event_id % 3 = 1 then concat('n', cast(user_id as string)) when event_id % 7 = 0 then 'A4O-1' else null end registration
from (select *, {t} t from {events}) e join {nation} n on user_id % 25 = n_nationkey
"""


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = "timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', ts)"
    return spark.sql(STATES.format(t=t, events="{events}", nation="{nation}"), events=spark.read.parquet(f"{sf_dir}/events.parquet"), nation=spark.read.parquet(f"{sf_dir}/nation.parquet"))


def silver(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enriched(states(spark, sf_dir))
