"""Streaming jobs: raw log, clean table, hourly rollup, live state and flight legs."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle

from ..functions.enrich import enriched, errors
from ..functions.geo import EARTH_KM
from ..sources.feeds import parsed
from ..sources.schemas import BRONZE
from ..operators.joins import heading_destination, nearest
from ..sources.sinks import Upsert, split_valid


def source(spark: SparkSession, path: str, kind: str = "parquet", servers: str | None = None, topic: str | None = None) -> DataFrame:
    """The raw log as a stream: from a broker where its connector is at hand, else from files."""
    if kind == "kafka":
        rows = spark.readStream.format("kafka").options(**{"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": "earliest", "failOnDataLoss": "false"}).load()
        return rows.select(F.col("value").cast("string").alias("raw_payload"), F.col("key").cast("string").alias("key"), F.col("partition").alias("kafka_partition"), F.col("offset").alias("kafka_offset"), F.col("timestamp").alias("kafka_timestamp"), F.col("topic").alias("source_tag"))
    return spark.readStream.schema(BRONZE).format(kind).load(path)


def writer(df: DataFrame, checkpoint: str, once: bool, every: str = "30 seconds") -> DataStreamWriter:
    out = df.writeStream.option("checkpointLocation", checkpoint)
    return out.trigger(availableNow=True) if once else out.trigger(processingTime=every)


def bronze(raw: DataFrame, path: str, checkpoint: str, once: bool = False):
    """Append the raw log, partitioned by day and hour of the broker's time."""
    dated = raw.withColumns({"ingest_date": F.date_format("kafka_timestamp", "yyyy-MM-dd"), "ingest_hour": F.date_format("kafka_timestamp", "HH")})
    return writer(dated, checkpoint, once).partitionBy("ingest_date", "ingest_hour").format("parquet").start(path)


def clean(raw: DataFrame) -> DataFrame:
    """Valid, enriched states of raw messages; the same for batch and stream."""
    good, _ = parsed(raw)
    good = good.filter(F.size(errors()) == 0)
    return enriched(good).withColumnRenamed("kafka_offset", "event_id")


def valid(raw: DataFrame) -> DataFrame:
    """key (the aircraft) and value (the message) of messages that parse and are valid."""
    good, _ = parsed(raw.withColumn("value", F.col("raw_payload")))
    return good.filter(F.size(errors()) == 0).select(F.col("icao24").alias("key"), "value")


def dead_letters(raw: DataFrame, good_path: str, bad_path: str, checkpoint: str, once: bool = False):
    """Valid messages to one sink and others, with the reason, to another; a replayed batch is in both once."""
    return writer(raw, checkpoint, once).foreachBatch(lambda df, i: split_valid(df, good_path, bad_path, i)).start()


def rejected(raw: DataFrame) -> DataFrame:
    """Messages that do not parse or are not valid, with the reason."""
    good, bad = parsed(raw)
    invalid = good.withColumn("error", F.array_join(errors(), ",")).filter("error <> ''").select(F.to_json(F.struct(*[c for c in good.columns])).alias("raw"), "error", F.col("source_tag").alias("source"))
    return invalid.unionByName(bad.select(F.col("raw_payload").alias("raw"), F.lit("malformed").alias("error"), F.col("source_tag").alias("source")))


def first_seen(rows: DataFrame, keys: list[str], within: str = "1 hour") -> DataFrame:
    """rows without copies of a key that came in less than `within` ago. The watermark is on the time that rows come in, so
    that state forgets keys in time and no row is late: one that tells of an earlier day passes like any other."""
    return rows.withColumn("__came", F.current_timestamp()).withWatermark("__came", within).dropDuplicatesWithinWatermark(keys).drop("__came")


def silver(raw: DataFrame, table: Upsert, checkpoint: str, once: bool = False, within: str = "1 hour"):
    """Upsert clean states, however late; copies that come in soon after each other are dropped in state, others by the upsert."""
    rows = first_seen(clean(raw), ["icao24", "time_position"], within)
    return writer(rows, checkpoint, once).foreachBatch(lambda df, i: table.merge(df, i)).start()


def hourly(states: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """Hourly traffic as a stream: approximate counts, as exact ones would keep every aircraft in state."""
    return states.withWatermark("ingest_ts", lateness).groupBy(F.window("ingest_ts", "1 hour").alias("w")).agg(F.approx_count_distinct("icao24").alias("flight_count"), F.avg("altitude_ft").alias("avg_altitude_ft"), F.avg("speed_kmh").alias("avg_speed_kmh")).select(F.col("w.start").alias("hour_bucket"), "flight_count", "avg_altitude_ft", "avg_speed_kmh")


LIVE = "icao24 string, last_contact long, latitude double, longitude double, on_ground boolean, n_history int, status string"
LEGS = "icao24 string, departure_time long, arrival_time long, from_lat double, from_lon double, to_lat double, to_lon double, duration_min double"


FLIGHTS = "icao24 string, kind string, t long, departure_iata string, departure_time long, arrival_iata string, duration_min double, distance_km double, avg_speed_kmh double, predicted_iata string, eta_minutes double"


def with_airports(states: DataFrame, airports: DataFrame, radius_km: float = 50.0) -> DataFrame:
    """states with the airport that they are at and the two that lie best ahead; no state is needed for either."""
    rows = nearest(states, airports, "airport_lat", "airport_lon", ["iata", "airport_lat", "airport_lon"], radius_km, prefix="at_")
    for n, without in ((1, F.lit(None).cast("string")), (2, F.col("ahead_iata_1"))):
        rows = heading_destination(rows.withColumn("departure_iata", without), airports)
        rows = rows.withColumnsRenamed({"predicted_iata": f"ahead_iata_{n}", "predicted_km": f"ahead_km_{n}"}).drop("departure_iata", "bearing_diff")
    return rows


class Flights(StatefulProcessor):
    """Legs between airports, from rows of with_airports.

    A take-off within an airport's radius sets the departure; while airborne, rows of kind `flying` tell it with the
    predicted destination (never the departure) and the minutes to it; a landing within an airport's radius gives a row
    of kind `route` and clears it. Rows that are older than what is known are passed over.
    """

    def __init__(self, ttl_ms: int = 900_000):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "t long, ground boolean, iata string, dep long, lat double, lon double", ttlDurationMs=self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = tuple(self.last.get()) if self.last.exists() else None
        out = []
        for r in pd.concat(list(rows)).sort_values(["last_contact", "event_id"]).itertuples(index=False):
            t, ground = int(r.last_contact), bool(r.on_ground)
            if state is not None and t < state[0]:
                continue
            iata, dep, lat, lon = state[2:] if state is not None else (None, None, None, None)
            at = None if pd.isna(r.at_iata) else r.at_iata
            if ground:
                if state is not None and not state[1] and iata is not None and at is not None:
                    minutes = max((t - dep) / 60, 0.01)
                    km = km_between(lat, lon, float(r.latitude), float(r.longitude))
                    out.append((key[0], "route", t, iata, dep, at, round(minutes, 1), round(km, 1), round(km / (minutes / 60), 1), None, None))
                iata = dep = lat = lon = None
            else:
                if state is not None and state[1]:
                    iata, dep, lat, lon = (at, t, float(r.at_airport_lat), float(r.at_airport_lon)) if at is not None else (None, None, None, None)
                if iata is not None:
                    n = 2 if r.ahead_iata_1 == iata else 1
                    ahead, km = getattr(r, f"ahead_iata_{n}"), getattr(r, f"ahead_km_{n}")
                    known = not pd.isna(ahead)
                    eta = round(float(km) / float(r.speed_kmh) * 60, 1) if known and not pd.isna(r.speed_kmh) and r.speed_kmh > 5 else None
                    out.append((key[0], "flying", t, iata, dep, None, None, None, None, ahead if known else None, eta))
            state = (t, ground, iata, dep, lat, lon)
        if state is not None:
            self.last.update(state)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in FLIGHTS.split(", ")])

    def close(self) -> None:
        pass


def km_between(lat1: float, lon1: float, lat2: float, lon2: float) -> float:
    a, b, c, d = map(math.radians, (lat1, lon1, lat2, lon2))
    x = math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2
    return 2 * EARTH_KM * math.asin(math.sqrt(min(1.0, x)))


class Live(StatefulProcessor):
    """Latest state and last positions of an aircraft, with its health by the age of its last message.

    News give a row of status `live`. A timer set by each message gives a row of status `silent`, with what was known last,
    once nothing has come for `silent_ms`; everything goes after `ttl_ms` without news.
    """

    def __init__(self, ttl_ms: int = 900_000, history: int = 5, silent_ms: int = 120_000):
        self.ttl_ms, self.history, self.silent_ms = ttl_ms, history, silent_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.track = handle.getListState("track", "t long, lat double, lon double", ttlDurationMs=self.ttl_ms)
        self.last = handle.getValueState("last", "t long, lat double, lon double, ground boolean", ttlDurationMs=self.ttl_ms)

    def told(self, key, last, status: str) -> pd.DataFrame:
        t, lat, lon, ground = last
        return pd.DataFrame({"icao24": [key[0]], "last_contact": [t], "latitude": [lat], "longitude": [lon], "on_ground": [ground], "n_history": [len(list(self.track.get()))], "status": [status]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held, last = [tuple(x) for x in self.track.get()], None
        for part in rows:
            for r in part.itertuples(index=False):
                at = (None, None) if pd.isna(r.latitude) else (float(r.latitude), float(r.longitude))
                if last is None or r.last_contact >= last[0]:
                    last = (int(r.last_contact), *at, bool(r.on_ground))
                if at[0] is not None:
                    held.append((int(r.last_contact), *at))
        self.track.put(sorted(set(held))[-self.history :])
        self.last.update(last)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.silent_ms)
        yield self.told(key, last, "live")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.last.exists():
            yield self.told(key, tuple(self.last.get()), "silent")

    def close(self) -> None:
        pass


class Legs(StatefulProcessor):
    """Take-off and landing of an aircraft; a landing gives a leg. Rows that are older than what is known are passed over."""

    def __init__(self, ttl_ms: int = 86_400_000):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "t long, ground boolean, dep long, lat double, lon double", ttlDurationMs=self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = tuple(self.last.get()) if self.last.exists() else None
        out = []
        # a batch's rows of one aircraft, in order of time
        for r in pd.concat(list(rows)).sort_values(["last_contact", "event_id"]).itertuples(index=False):
            t, ground = int(r.last_contact), bool(r.on_ground)
            if state is not None and t < state[0]:
                continue
            dep, lat, lon = state[2:] if state is not None else (None, None, None)
            if state is not None and state[1] and not ground:
                dep, lat, lon = (t, float(r.latitude), float(r.longitude)) if not pd.isna(r.latitude) else (None, None, None)
            elif ground:
                if state is not None and not state[1] and dep is not None and not pd.isna(r.latitude):
                    out.append((key[0], dep, t, lat, lon, float(r.latitude), float(r.longitude), round(max((t - dep) / 60, 0.01), 1)))
                dep = lat = lon = None
            state = (t, ground, dep, lat, lon)
        if state is not None:
            self.last.update(state)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in LEGS.split(", ")])

    def close(self) -> None:
        pass


def with_state(states: DataFrame, processor: StatefulProcessor, schema: str) -> DataFrame:
    """One of the processors over states by aircraft; needs the RocksDB state store.

    State that goes after a time needs batches to go on without rows, so such a query ends by stop() only.
    """
    return states.groupBy("icao24").transformWithStateInPandas(processor, outputStructType=schema, outputMode="Update", timeMode="ProcessingTime")
