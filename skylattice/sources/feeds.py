"""Feeds: positional and object snapshots, archives, gzip logs and tables, all read with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.enrich import clean_callsign
from ..operators.joins import with_registration_country
from . import dims
from .schemas import HISTORICAL, POSITIONS, STATE

FT, KNOT, FPM = 0.3048, 0.514444, 0.00508
OBJECT = "now long, ac array<struct<hex:string,flight:string,r:string,alt_baro:string,alt_geom:double,gs:double,track:double,baro_rate:double,squawk:string,spi:int,lat:double,lon:double,seen_pos:double,seen:double>>"


def parsed(bronze: DataFrame, payload: str = "raw_payload") -> tuple[DataFrame, DataFrame]:
    """(good, malformed): messages as states, and those that are no JSON object. A malformed message is not a row of nulls."""
    schema = STATE + ", _corrupt string"
    rows = bronze.withColumn("f", F.from_json(payload, schema, {"columnNameOfCorruptRecord": "_corrupt"}))
    bad = F.col("f").isNull() | F.col("f._corrupt").isNotNull() | ~F.trim(payload).startswith("{")
    others = [c for c in bronze.columns if c != payload]
    good = rows.filter(~F.coalesce(bad, F.lit(True))).select("f.*", *others).drop("_corrupt").withColumn("ingest_ts", F.to_timestamp("ingest_ts"))
    return good, rows.filter(F.coalesce(bad, F.lit(True))).drop("f")


def from_positions(snapshots: DataFrame, column: str = "body", source: str = "opensky") -> DataFrame:
    """States of snapshots {time, states: [[17 values], ...]}; rows of another length, or whose values do not parse, go."""
    got = snapshots.withColumn("j", F.from_json(column, "time long, states array<array<string>>")).select(F.col("j.time").alias("snapshot_time"), F.explode("j.states").alias("v")).filter(F.size("v") == len(POSITIONS))
    at = lambda name: F.element_at("v", POSITIONS.index(name) + 1)
    kinds = {c.split()[0]: c.split()[1] for c in STATE.split(",")}
    cols = [at(n).try_cast(kinds[n]).alias(n) for n in POSITIONS if n != "sensors"]
    return got.select("snapshot_time", *cols, F.lit(source).alias("source")).withColumn("callsign", clean_callsign(F.col("callsign"))).filter("icao24 is not null and last_contact is not null and on_ground is not null")


def from_objects(snapshots: DataFrame, column: str = "body", source: str = "adsb_lol") -> DataFrame:
    """States of snapshots {now, ac: [{...}]}: feet, knots and feet per minute become metric, "ground" becomes on_ground."""
    rows = snapshots.withColumn("j", F.from_json(column, OBJECT)).select((F.coalesce(F.col("j.now") / 1000, F.unix_timestamp())).alias("now"), F.explode("j.ac").alias("a"))
    rows = rows.withColumn("registration", F.col("a.r"))
    rows = with_registration_country(rows, dims.registrations(snapshots.sparkSession))
    a = lambda n: F.col(f"a.{n}")
    return rows.select(
        F.lit(source).alias("source"), a("hex").alias("icao24"), clean_callsign(a("flight")).alias("callsign"), F.col("country").alias("origin_country"),
        (F.col("now") - a("seen_pos")).cast("long").alias("time_position"), F.coalesce((F.col("now") - a("seen")).cast("long"), F.col("now").cast("long")).alias("last_contact"),
        a("lon").alias("longitude"), a("lat").alias("latitude"), (a("alt_baro").try_cast("double") * FT).alias("baro_altitude"),
        F.coalesce(a("alt_baro") == "ground", F.lit(False)).alias("on_ground"), (a("gs") * KNOT).alias("velocity"), a("track").alias("true_track"),
        (a("baro_rate") * FPM).alias("vertical_rate"), (a("alt_geom") * FT).alias("geo_altitude"), a("squawk").alias("squawk"),
        (F.coalesce(a("spi"), F.lit(0)) != 0).alias("spi"), F.lit(0).alias("position_source"),
    )


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """States of hourly CSV archives (plain or gzip), with day and hour from the file's name; impossible rows go."""
    schema = "time long, icao24 string, lat double, lon double, velocity double, heading double, vertrate double, callsign string, onground boolean, alert boolean, spi boolean, squawk double, baroaltitude double, geoaltitude double, lastposupdate double, lastcontact double"
    rows = spark.read.schema(schema).option("header", True).csv(path)
    rows = rows.withColumn("file", F.col("_metadata.file_name"))
    rows = rows.filter("lat is not null and lon is not null and lastcontact is not null and velocity >= 0 and (heading is null or heading between 0 and 360)")
    cols = [F.nullif(F.col(c), F.lit(float("nan"))).alias(n) if dict(rows.dtypes)[c] == "double" else F.col(c).alias(n) for c, n in HISTORICAL.items()]
    out = rows.select(*cols, F.regexp_extract("file", r"(\d{4}-\d{2}-\d{2})", 1).alias("file_date"), F.regexp_extract("file", r"-(\d{2})\.", 1).alias("file_hour"))
    return out.withColumns({
        "squawk": F.lpad(F.col("squawk").cast("long").cast("string"), 4, "0"), "last_contact": F.col("last_contact").cast("long"),
        "callsign": clean_callsign(F.col("callsign")), "origin_country": F.lit("Unknown"), "source": F.lit("historical"),
        "ingest_ts": F.timestamp_seconds(F.col("last_contact").cast("long")), "position_source": F.lit(0),
    })


def read_daily(spark: SparkSession, path: str, day: str, value: str) -> DataFrame:
    """d and n of a CSV with a day and a count, whatever other columns it has: whole rows, one a day, in order."""
    rows = spark.read.option("header", True).csv(path).select(F.col(day).alias("d"), F.col(value).alias("n"))
    rows = rows.select(F.col("d").try_cast("date").alias("d"), F.col("n").try_cast("double").alias("n")).dropna()
    return rows.groupBy("d").agg(F.min("n").alias("n")).orderBy("d")


def as_bronze(states: DataFrame, ts: str = "ingest_ts") -> DataFrame:
    """The envelope of the raw log around rows that did not come by a broker."""
    cols = [c for c in states.columns if c not in ("file_date", "file_hour")]
    when = F.col(ts).cast("timestamp")
    return states.select(F.to_json(F.struct(*cols)).alias("raw_payload"), F.col("icao24").alias("key"), F.lit(-1).alias("kafka_partition"), F.lit(-1).cast("long").alias("kafka_offset"), when.alias("kafka_timestamp"), F.date_format(when, "yyyy-MM-dd").alias("ingest_date"), F.date_format(when, "HH").alias("ingest_hour"))


def read_gzip_log(spark: SparkSession, path: str) -> DataFrame:
    """States of gzip JSON lines under a prefix; error logs and other files are passed over, blank lines skipped."""
    rows = spark.read.schema(STATE).json(path, pathGlobFilter="*.gz", recursiveFileLookup=True)
    return rows.filter(~F.col("_metadata.file_path").contains("bronze-errors")).filter("icao24 is not null")


def newest_runs(table: DataFrame, n: int = 1) -> DataFrame:
    """Rows of the n newest run partitions; their names are found first, so that only they are read."""
    runs = [r[0] for r in table.select("run_ts").distinct().orderBy(F.desc("run_ts")).limit(n).collect()]
    return table.filter(F.col("run_ts").isin(runs))
