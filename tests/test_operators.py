"""Operators on small frames with results worked out by hand."""

import json
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from skylattice.functions import enrich, geo
from skylattice.operators import cluster, forecast, joins, legs, marts, windows
from skylattice.sources import dims, feeds, sinks
from skylattice.streaming import jobs


def one(spark, *cols):
    return spark.range(1).select(*cols).head()


def test_geometry(spark):
    r = one(spark, geo.geohash5(F.lit(57.64911), F.lit(10.40744)), geo.geohash5(F.lit(42.6), F.lit(-5.6)), geo.angle_between(F.lit(350.0), F.lit(10.0)), geo.wrap_lon(F.lit(190.0)), geo.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0)))
    assert r[0] == "u4pru" and r[1] == "ezs42" and r[2] == pytest.approx(20) and r[3] == pytest.approx(-170) and r[4] == pytest.approx(np.pi * 6371)
    lat, lon = geo.along(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(90.0), F.lit(0.5))
    assert one(spark, lat, lon)[1] == pytest.approx(45)


@pytest.mark.parametrize("raw, want", [("DLH9LF  ", "DLH9LF"), ("   ", None), ("", None), (None, None), ("BAW123", "BAW123")])
def test_callsign(spark, raw, want):
    assert one(spark, enrich.clean_callsign(F.lit(raw).cast("string")))[0] == want


@pytest.mark.parametrize("lat, lon, want", [(None, None, "Unknown"), (50.0, None, "Unknown"), (-70.0, 100.0, "Other"), (20.0, 77.0, "South Asia"), (50.0, 8.0, "Europe"), (35.0, 10.0, "Europe")])
def test_region(spark, lat, lon, want):
    assert one(spark, enrich.region(F.lit(lat).cast("double"), F.lit(lon).cast("double")))[0] == want


def test_longest_prefix(spark):
    rows = spark.createDataFrame([("A4O-XY",), ("VT-ABC",), ("n123",), ("ZZ",), (None,)], "registration string")
    got = [r.country for r in joins.with_registration_country(rows, dims.registrations(spark)).collect()]
    assert got == ["Oman", "India", "United States", "Unknown", "Unknown"]


def test_asof_takes_the_earlier_of_a_tie_within_an_inclusive_tolerance(spark):
    left = spark.createDataFrame([("a", 100), ("a", 200), ("b", 100)], "k string, t long")
    right = spark.createDataFrame([("a", 90), ("a", 110), ("a", 230), ("b", 131)], "k string, u long")
    assert {tuple(r) for r in joins.asof_nearest(left, right, "k", "t", "u", 30).collect()} == {("a", 100, 90), ("a", 200, 230)}


def leg_rows(spark):
    cols = "icao24 string, last_contact long, event_id long, on_ground boolean, latitude double, longitude double, callsign string, baro_altitude double, geo_altitude double"
    fra, lhr = (50.03, 8.56), (51.47, -0.45)
    return spark.createDataFrame(
        [("a", 0, 1, True, *fra, "X", 0.0, 0.0), ("a", 60, 2, False, *fra, "X", 900.0, None), ("a", 1860, 3, False, 51.0, 4.0, "X", None, 9000.0), ("a", 3660, 4, True, *lhr, "X", 0.0, 0.0), ("a", 9000, 5, False, 10.0, 10.0, "X", 1.0, 1.0), ("b", 5, 6, False, *fra, "Y", 1.0, 1.0), ("b", 9, 7, True, *lhr, "Y", 0.0, 0.0)],
        cols,
    )


def test_legs(spark):
    got = legs.routes(leg_rows(spark), dims.airports(spark)).collect()
    assert [(r.icao24, r.departure_iata, r.arrival_iata, r.departure_time, r.duration_min) for r in got] == [("a", "FRA", "LHR", 60, 60.0)]
    points = legs.trajectory_points(leg_rows(spark), dims.airports(spark)).collect()
    assert [(r.icao24, r.ts) for r in points] == [("a", 60), ("a", 1860)]


def test_dbscan_and_knee(spark):
    rng = np.random.default_rng(3)
    pts = np.vstack([rng.normal(0, 0.05, (30, 4)), rng.normal(3, 0.05, (29, 4)), [[9, 9, 9, 9]]])
    df = spark.createDataFrame([(i, "g", *map(float, p)) for i, p in enumerate(pts)], "event_id long, g string, x0 double, x1 double, x2 double, x3 double")
    labels = cluster.dbscan(df, "g", 0.5)
    assert {r.event_id: r.label for r in labels.collect()} == {i: 0 if i < 30 else 30 if i < 59 else -1 for i in range(60)}
    d = np.sort(np.linalg.norm(pts[:, None] - pts[None], axis=2), axis=1)[:, 7]
    assert {r.event_id: round(r.k_distance, 9) for r in cluster.k_distances(df, "g").collect()} == {i: round(float(x), 9) for i, x in enumerate(d)}
    assert cluster.silhouette(df, labels, "g").head().silhouette > 0.9
    curve = spark.createDataFrame([("g", float(v)) for v in (0, 0.1, 0.2, 0.3, 10)], "g string, v double")
    assert windows.knee(curve, ["g"], "v").head().knee == pytest.approx(0.3)


def brute_dbscan(pts, eps, least):
    """(core, label) by all pairs: labels are smallest core points, border points take the smallest of their cores' labels."""
    near = np.sqrt(((pts[:, None] - pts[None]) ** 2).sum(2)) <= eps
    core = near.sum(1) >= least
    label = np.where(core, np.arange(len(pts)), len(pts))
    while True:
        least_near = np.where(near & core[None] & core[:, None], label[None], len(pts)).min(1)
        new = np.where(core, np.minimum(label, least_near), label)
        if (new == label).all():
            break
        label = new
    border = np.where(near & core[None], label[None], len(pts)).min(1)
    label = np.where(core, label, border)
    return core, np.where(label == len(pts), -1, label)


def test_dbscan_equals_all_pairs_where_cells_are_dense(spark):
    rng = np.random.default_rng(11)
    flat = lambda x, y, n, spread: np.hstack([rng.normal((x, y), spread, (n, 2)), np.zeros((n, 2))])
    same = lambda x, n: np.tile([x, 50.0, 0.0, 0.0], (n, 1))
    pts = np.vstack([
        flat(0, 0, 300, 0.3), flat(3, 0, 60, 0.8), rng.uniform(-4, 8, (80, 4)) * [1, 1, 0.05, 0.05],  # dense, thin and stray
        same(0.0, 40), same(0.5, 40), same(1.125, 40), same(1.625, 3),  # copies at eps, beyond it, and a border of copies
        flat(20, 20, 150, 0.02), flat(20.55, 20, 150, 0.02), flat(30, 20, 150, 0.02), flat(30.7, 20, 150, 0.02),  # close by each other
    ])
    pts = pts[rng.permutation(len(pts))]
    core, label = brute_dbscan(pts, 0.5, 8)
    assert 5 < len(set(label)) and (label == -1).any() and (~core & (label >= 0)).any()
    df = spark.createDataFrame([(i, "g", *map(float, p)) for i, p in enumerate(pts)], "event_id long, g string, x0 double, x1 double, x2 double, x3 double")
    got = {r.event_id: (r.is_core, r.label) for r in cluster.dbscan(df, "g", 0.5).collect()}
    assert got == {i: (bool(c), int(v)) for i, (c, v) in enumerate(zip(core, label))}


def test_snapshot_closes_changed_rows_only(spark):
    first = marts.snapshot(None, spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "k string, n long"), "k", ["n"], "1")
    second = marts.snapshot(first, spark.createDataFrame([("a", 1), ("b", 5), ("d", 4)], "k string, n long"), "k", ["n"], "2")
    assert {tuple(r) for r in second.collect()} == {("a", 1, "1", None), ("b", 2, "1", "2"), ("b", 5, "2", None), ("c", 3, "1", None), ("d", 4, "2", None)}


def test_promotion(spark):
    runs = spark.createDataFrame([(1, 5.0), (2, 6.0), (3, 4.0)], "run int, mae double")
    assert [r.promoted for r in forecast.promote(runs, "mae").orderBy("run").collect()] == [True, False, True]


def test_forecast_has_a_row_per_series_and_step(spark):
    days = spark.sql("select s, date_add(date'2024-01-01', cast(i as int)) d, 100 + 10 * (i % 7) + s v from (select explode(sequence(0, 39)) i), (select explode(array(0, 1)) s)")
    out = forecast.forecast(days, "s", "d", "v", steps=3, trees=3).collect()
    assert len(out) == 6 and all(r.low <= r.predicted <= r.high for r in out)


def test_snapshots_are_bounded(spark):
    from skylattice.plans import catalog

    rows = spark.range(3000).select(F.lit("2024-01-01 05:10:00").cast("timestamp").alias("ingest_ts"), F.col("id").cast("string").alias("x"))
    got = catalog.snapshots(rows, F.array("x"), bound=100).agg(F.collect_list("__payload").alias("p")).collect()
    assert len(got) == 30 and max(len(r.p) for r in got) < 200
    assert sorted(int(x[0]) for r in got for x in r.p) == list(range(3000))


def test_feeds(spark):
    row = ["abc123", " DLH1 ", "Germany", 10, 11, 8.5, 50.0, 1000.0, False, 200.0, 90.0, 0.0, None, 1010.0, "1000", False, 0]
    body = json.dumps({"time": 12, "states": [row, row[:5]]})
    got = feeds.from_positions(spark.createDataFrame([(body,), ("{bad",)], "body string")).collect()
    assert [(r.icao24, r.callsign, r.latitude) for r in got] == [("abc123", "DLH1", 50.0)]
    body = json.dumps({"now": 100_000, "ac": [{"hex": "4b", "flight": "SWR1 ", "r": "HB-X", "alt_baro": "ground", "gs": 10, "lat": 1.0, "lon": 2.0, "seen_pos": 1.5}, {"hex": "4c", "alt_baro": 1000, "lat": 1.0, "lon": 2.0}]})
    a, b = feeds.from_objects(spark.createDataFrame([(body,)], "body string")).collect()
    assert (a.on_ground, a.baro_altitude, a.origin_country, a.time_position, a.callsign) == (True, None, "Switzerland", 98, "SWR1")
    assert b.baro_altitude == pytest.approx(304.8) and b.velocity is None and b.last_contact == 100 and b.origin_country == "Unknown"


def message(icao, t, ts, **more):
    return json.dumps({"source": "replay", "icao24": icao, "callsign": "DLH1", "origin_country": "Germany", "time_position": t, "last_contact": t, "longitude": 8.5, "latitude": 50.0, "baro_altitude": 1000.0, "on_ground": False, "velocity": 200.0, "true_track": 90.0, "vertical_rate": 0.0, "squawk": "1000", "spi": False, "position_source": 0, "ingest_ts": ts} | more)


def bronze_rows(spark):
    msgs = [message("a", 1, "2024-01-01T00:00:00"), message("a", 1, "2024-01-01T00:05:00", velocity=1.0), message("b", 2, "2024-01-01T01:00:00"), "{bad", "[1]", json.dumps({"icao24": "abc123"}), message("toolong7", 1, "2024-01-01T00:00:00")]
    return spark.createDataFrame([(m, "k", 0, i, None, "t") for i, m in enumerate(msgs)], "raw_payload string, key string, kafka_partition int, kafka_offset long, kafka_timestamp string, source_tag string").withColumn("kafka_timestamp", F.lit("2024-01-01 05:00:00").cast("timestamp"))


def test_malformed_messages_are_not_rows_of_nulls(spark):
    good, bad = feeds.parsed(bronze_rows(spark))
    assert good.count() == 5 and bad.count() == 2
    assert jobs.clean(bronze_rows(spark)).count() == 3 and jobs.rejected(bronze_rows(spark)).count() == 4


def test_streams_equal_the_batch_and_replays_change_nothing(spark, tmp_path):
    raw = f"{tmp_path}/raw"
    bronze_rows(spark).write.parquet(raw)
    stream = jobs.source(spark, raw)
    jobs.bronze(stream, f"{tmp_path}/bronze", f"{tmp_path}/cp0", once=True).awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/bronze").select("ingest_date", "ingest_hour").distinct().collect()[0][1] in (5, "05")
    table = sinks.Upsert(spark, f"{tmp_path}/silver", buckets=4)
    jobs.silver(stream, table, f"{tmp_path}/cp1", once=True).awaitTermination()
    rows = {(r.icao24, r.time_position) for r in table.read().collect()}
    assert rows == {("a", 1), ("b", 2)}
    batch = jobs.clean(bronze_rows(spark))
    table.merge(batch, 0)  # replayed: passed over
    table.merge(batch, 7)  # again as a new batch: the latest of each key stays
    got = {(r.icao24, r.velocity) for r in table.read().collect()}
    assert got == {("a", 1.0), ("b", 200.0)} and table.read().count() == 2


def test_live_state_and_legs(spark, tmp_path):
    rows = leg_rows(spark)
    rows.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    for name, proc, schema in (("live", jobs.Live(), jobs.LIVE), ("legs", jobs.Legs(), jobs.LEGS)):
        q = jobs.writer(jobs.with_state(stream, proc, schema), f"{tmp_path}/cp-{name}", False, "1 second").outputMode("update").foreachBatch(lambda df, i, name=name: df.write.mode("append").parquet(f"{tmp_path}/{name}")).start()
        try:  # with timers by processing time there is always another batch, so wait for the one with rows
            end = time.time() + 60
            while not any(p["numInputRows"] for p in q.recentProgress) and time.time() < end:
                time.sleep(0.5)
        finally:
            q.stop()
    live = {r.icao24: (r.last_contact, r.n_history) for r in spark.read.parquet(f"{tmp_path}/live").collect()}
    assert live == {"a": (9000, 5), "b": (9, 2)}
    out = [(r.icao24, r.departure_time, r.arrival_time, r.duration_min) for r in spark.read.parquet(f"{tmp_path}/legs").collect()]
    assert out == [("a", 60, 3660, 60.0)]


def test_runs_and_replacement(spark, tmp_path):
    df = spark.range(3)
    for run in ("1", "2", "2"):
        sinks.append_run(df, f"{tmp_path}/t", run)
    assert spark.read.parquet(f"{tmp_path}/t").count() == 6
    assert feeds.newest_runs(spark.read.parquet(f"{tmp_path}/t")).select("run_ts").distinct().collect()[0][0] == 2
    sinks.replace_table(df, "replaced")
    sinks.replace_table(spark.range(5), "replaced")
    assert spark.table("replaced").count() == 5


def test_late_rows_reach_the_table(spark, tmp_path):
    raw, table = f"{tmp_path}/raw", sinks.Upsert(spark, f"{tmp_path}/silver", buckets=2)
    batches = [[message("a", 100, "2024-01-01T10:00:00"), message("b", 400, "2024-01-01T10:05:00")], [message("late", 5, "2024-01-01T05:00:00"), message("b", 400, "2024-01-01T10:05:30")], [message("c", 460, "2024-01-01T10:06:00")]]
    for n, msgs in enumerate(batches):
        rows = spark.createDataFrame([(m, "k", 0, 10 * n + i, None, "t") for i, m in enumerate(msgs)], "raw_payload string, key string, kafka_partition int, kafka_offset long, kafka_timestamp string, source_tag string")
        rows.withColumn("kafka_timestamp", F.lit("2024-01-01 05:00:00").cast("timestamp")).write.mode("append").parquet(raw)
        jobs.silver(jobs.source(spark, raw), table, f"{tmp_path}/cp", once=True).awaitTermination()
    got = {r.icao24: r.ingest_ts.hour * 100 + r.ingest_ts.minute + r.ingest_ts.second / 100 for r in table.read().collect()}
    assert got == {"a": 1000, "b": 1005, "late": 500, "c": 1006}  # the copy of b came too soon after the first


def test_an_aircraft_falls_silent(spark, tmp_path):
    rows = leg_rows(spark)
    rows.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    q = jobs.writer(jobs.with_state(stream, jobs.Live(silent_ms=3000), jobs.LIVE), f"{tmp_path}/cp", False, "1 second").outputMode("update").foreachBatch(lambda df, i: df.write.mode("append").parquet(f"{tmp_path}/out")).start()
    end, got = time.time() + 90, []
    try:
        while time.time() < end and sum(r.status == "silent" for r in got) < 2:
            time.sleep(1)
            got = spark.read.schema(jobs.LIVE).parquet(f"{tmp_path}/out").collect() if (tmp_path / "out").exists() else []
        time.sleep(4)
        got = spark.read.schema(jobs.LIVE).parquet(f"{tmp_path}/out").collect()
    finally:
        q.stop()
    assert sorted((r.icao24, r.status, r.last_contact, r.n_history) for r in got) == [("a", "live", 9000, 5), ("a", "silent", 9000, 5), ("b", "live", 9, 2), ("b", "silent", 9, 2)]
