"""Ranks, reports, nearest places, sinks and the stream of flights on small frames with results worked out by hand."""

import datetime
import gzip
import json
import time

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import _parse_datatype_string

from skylattice.functions import enrich, geo
from skylattice.operators import cluster, forecast, joins, legs, marts, ranks, reports, windows
from skylattice.sources import dims, feeds, sinks
from skylattice.streaming import jobs
from tests.test_operators import bronze_rows, leg_rows


def test_ranks_and_percentiles(spark):
    rng = np.random.default_rng(0)
    groups = {"a": rng.exponential(9, 3000), "b": np.repeat([1.0, 2.0, 5.0], [900, 50, 3]), "c": np.array([4.0]), None: rng.normal(0, 1, 50)}
    rows = [(k, float(v), i) for k, vs in groups.items() for i, v in enumerate(vs)] + [("a", None, 0)]
    df = spark.createDataFrame(rows, "k string, v double, i long").repartition(7)
    at = [0.0, 0.1, 0.37, 0.5, 0.9, 1.0]
    for few in (100_000, 10):  # one aggregate, and in parts
        got = {r.k: r.percentiles for r in ranks.percentiles(df, ["k"], "v", at, few).collect()}
        assert set(got) == set(groups)
        for k, vs in groups.items():
            assert got[k] == pytest.approx(np.quantile(vs, at).tolist())
    assert ranks.percentiles(df, [], "v", [0.5]).head()[0][0] == pytest.approx(np.median(np.concatenate(list(groups.values()))))
    for k, vs in groups.items():
        found = sorted((r.rank_i, r.v, r.i, r.rank_n) for r in ranks.ranked(df, ["k"], "v", "i").filter(F.col("k").eqNullSafe(F.lit(k))).collect())
        assert [(a, b, c) for a, b, c, _ in found] == [(n, v, i) for n, (v, i) in enumerate(sorted((float(v), i) for i, v in enumerate(vs)))] and {n for *_, n in found} == {len(vs)}


def test_nearest_by_cells_equals_the_array(spark):
    rng = np.random.default_rng(1)
    points = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(rng.uniform((-90, -180), (90, 180), (200, 2)))] + [(900, None, 1.0), (901, 89.9, 179.9), (902, 0.0, -179.99)], "id long, latitude double, longitude double")
    places = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(rng.uniform((-80, -180), (80, 180), (60, 2)))] + [(99, 0.0, 179.99)], "name long, p_la double, p_lo double")
    for most in (None, 900.0):
        one, two = ({r.id: (r.near_name, r.near_km) for r in joins.nearest(points, places, "p_la", "p_lo", ["name"], most, "near_", n).collect()} for n in (1000, 5))
        assert {k: v[0] for k, v in one.items()} == {k: v[0] for k, v in two.items()} and len(one) == 203 and one[900] == (None, None) and one[902][0] == 99
        assert [v[1] or 0 for v in one.values()] == pytest.approx([two[k][1] or 0 for k in one])


def test_reports(spark):
    scores = spark.createDataFrame([(i, i / 10) for i in range(10)], "event_id long, anomaly_score double")
    page = reports.page(scores, [F.desc("anomaly_score")], 3, 2).collect()
    assert [(r.event_id, r.total) for r in page] == [(7, 10), (6, 10), (5, 10)]
    assert [r.event_id for r in reports.top(scores, [F.desc("anomaly_score")], 3, [F.col("anomaly_score")]).collect()] == [7, 8, 9]
    gaps = reports.gap_distribution(scores, "event_id").head()
    assert (gaps.min, gaps.median, gaps.max, gaps.mean) == (0, 4.5, 9, 4.5) and gaps.p10 == pytest.approx(0.9)
    assert reports.share_check(spark.createDataFrame([("a",), ("b",), (None,)], "r string"), "r", ["a", "b"]).head().status == "fail"
    feed = spark.createDataFrame([(1, None)], "a long, b string")
    found = reports.schema_contract({"x": feed, "y": feed.drop("b")}, _parse_datatype_string("a int, b string"), ["a", "b"])
    assert {tuple(r) for r in found.collect()} == {("x", "a", "type bigint"), ("x", "b", "nulls 1"), ("y", "a", "type bigint"), ("y", "b", "missing")}
    assert [tuple(r) for r in reports.negative_rows({"t": (spark.createDataFrame([(1,), (-2,)], "n long"), "n")}).collect()] == [("t", -2)]
    seen = spark.createDataFrame([("2024-01-01", 1.0), ("2024-01-02", 2.0)], "d string, n double")
    ahead = spark.createDataFrame([("2024-01-03", 3.0, 2.0, 4.0)], "d string, predicted double, low double, high double")
    assert sorted((r.d, r.observed, r.predicted) for r in reports.with_bridge(seen, ahead, "d", "n").collect()) == [("2024-01-01", 1.0, None), ("2024-01-02", 2.0, 2.0), ("2024-01-03", None, 3.0)]
    feet = spark.createDataFrame([(1000.0, 5.0)], "baro_altitude double, altitude_ft double")
    assert feet.select(reports.altitude_source(feet)).head()[0] == 5.0 and feet.drop("altitude_ft").select(reports.altitude_source(feet.drop("altitude_ft"))).head()[0] == pytest.approx(3280.84)
    assert reports.for_write(spark.createDataFrame([(1, 2.0, 3.0)], "corridor_id long, altitude_mean_ft double, altitude_std_ft double")).columns == ["corridor_id"]


def test_small_functions(spark):
    row = spark.range(1).select(geo.cell10(F.lit(-3.0), F.lit(25.0)), geo.cell10(F.lit(None).cast("double"), F.lit(1.0)), *enrich.cyclic_hour(F.lit(6)), windows.parsed_polyline(F.lit("[[1.5,2],[3,4]]")), windows.parsed_polyline(F.lit("x"))).head()
    assert row[0] == "-1_2" and row[1] is None and row[2] == pytest.approx(1) and row[3] == pytest.approx(0, abs=1e-9) and row[4] == [[1.5, 2.0], [3.0, 4.0]] and row[5] is None
    points = spark.createDataFrame([("x", float(i), 0.0, i) for i in range(20)], "k string, latitude double, longitude double, event_id long")
    line = windows.polyline(points, "k", windows.along_heading(F.lit(180.0)), n=5).head().polyline
    assert [p[0] for p in line] == [19.0, 15.0, 10.0, 5.0, 0.0]


def test_corridors_with_eps_by_group(spark):
    rng = np.random.default_rng(2)
    rows = [("tight", *(c + rng.normal(0, 0.01, 4))) for c in (0, 5) for _ in range(30)] + [("wide", *(c + rng.normal(0, 0.5, 4))) for c in (0, 50) for _ in range(30)] + [("few", 0, 0, 0, 0)] * 3
    points = spark.createDataFrame([(i, g, *map(float, x)) for i, (g, *x) in enumerate(rows)], "event_id long, g string, x0 double, x1 double, x2 double, x3 double")
    eps = cluster.knee_eps(points, "g")
    assert {r.g for r in eps.collect()} == {"tight", "wide"}
    labels = cluster.dbscan(points, "g", eps)
    got = {r.g: (r.n_rows, r.n_clusters) for r in reports.cluster_report(labels, "g", eps, cluster.silhouette(points, labels, "g")).collect()}
    assert got == {"tight": (60, 2), "wide": (60, 2), "few": (3, 0)}


def test_predictions_of_learned_models(spark):
    rng = np.random.default_rng(3)
    motion = [[float(x) for x in rng.uniform(-1, 1, len(forecast.MOTION))] for _ in range(300)]
    pairs = spark.createDataFrame([(i, "k%d" % (i % 5), i, 60.0, 90.0, "cruise", *m, m[0] + 0.5, m[1] - 0.5) for i, m in enumerate(motion)], "event_id long, icao24 string, last_contact long, seconds double, true_track double, eval_phase string, " + ", ".join(f"{c} double" for c in forecast.MOTION) + ", future_latitude double, future_longitude double")
    assert forecast.trajectory(pairs, trees=2) is None
    out = forecast.trajectory(pairs, trees=5, min_pairs=10)
    trail = forecast.ghost_trail(out).collect()
    assert len(trail) == 60 and all(abs(r.actual_latitude - r.predicted_latitude) < 0.3 for r in trail)
    models = forecast.motion_models(pairs, 2)
    table = forecast.importance(models, forecast.MOTION)
    assert {f for f, _ in table} == set(forecast.MOTION) and [x for _, x in table] == sorted((x for _, x in table), reverse=True)
    two = lambda k, t, lat: (k, t, t, t, lat, 1.0, 100.0, 90.0, 0.0, 5.0)
    states = spark.createDataFrame([two("a", 1, 0.1), two("a", 9, 0.2), two("b", 1, 0.1), two("c", 4, 0.1), (*two("c", 4, 0.3)[:3], 5, *two("c", 4, 0.3)[4:])], "icao24 string, last_contact long, time_position long, event_id long, latitude double, longitude double, velocity double, true_track double, vertical_rate double, baro_altitude double")
    got = {r.icao24: r.predicted_latitude for r in forecast.next_positions(pairs, states, trees=2).collect()}
    assert set(got) == {"a", "b", "c"} and got["a"] == pytest.approx(0.7, abs=0.2) and got["b"] is None and got["c"] is None
    daily = spark.createDataFrame([("s", datetime.date(2024, 1, 1) + datetime.timedelta(i), float(10 + i % 7)) for i in range(90)], "k string, d date, n double")
    table = {r.method: r for r in forecast.daily_quality(daily, "k", "d", "n", trees=20).collect()}
    assert set(table) == {"model", "lag_1", "lag_7"} and table["lag_7"].mae == 0 and not table["model"].wins_all and table["model"].mae < table["lag_1"].mae


def test_sinks_and_reads(spark, tmp_path):
    p = str(tmp_path)
    sinks.split_valid(bronze_rows(spark), f"{p}/good", f"{p}/bad")
    assert {r.key for r in spark.read.parquet(f"{p}/good").collect()} == {"a", "b"}
    bad = spark.read.parquet(f"{p}/bad").collect()
    assert len(bad) == 4 and all(r.error and r.source == "t" and r.raw for r in bad)
    bronze_rows(spark).write.parquet(f"{p}/raw")
    jobs.dead_letters(jobs.source(spark, f"{p}/raw"), f"{p}/good2", f"{p}/bad2", f"{p}/cp", once=True).awaitTermination()
    assert spark.read.parquet(f"{p}/good2").count() == 3 and spark.read.parquet(f"{p}/bad2").count() == 4
    for _ in range(2):  # a replay of the batch
        sinks.split_valid(bronze_rows(spark), f"{p}/good3", f"{p}/bad3", 7)
    assert spark.read.parquet(f"{p}/good3").count() == 3 and spark.read.parquet(f"{p}/bad3").count() == 4
    df = spark.createDataFrame([(1, "x", 2.0)], "a long, b string, c double")
    assert sinks.fixed(df, "c float, a int, d string").schema.simpleString() == "struct<c:float,a:int,d:string>"
    sinks.overwrite(df, f"{p}/gold")
    sinks.overwrite(df.limit(0), f"{p}/gold")
    assert spark.read.parquet(f"{p}/gold").count() == 0
    for run in ("r1", "r2", "r2"):
        sinks.append_run(df, f"{p}/runs", run)
        sinks.register_run(spark, "runs_known", f"{p}/runs", "a long, b string, c double", run)
    assert sorted(r.run_ts for r in spark.table("runs_known").collect()) == ["r1", "r2"]
    sinks.append_partitioned(df, f"{p}/parts", "b")
    assert spark.read.parquet(f"{p}/parts").head().b == "x"
    days = spark.createDataFrame([("2024-01-01",), ("2024-02-01",)], "ingest_date string")
    assert [r[0] for r in sinks.retained(days, "ingest_date", "2024-02-10").collect()] == ["2024-02-01"]
    (tmp_path / "daily.csv").write_text("Date,Other,Flights\n2024-01-02,x,5\n2024-01-01,y,4\nbad,z,1\n2024-01-02,q,7\n2024-01-03,,\n")
    assert [(str(r.d), r.n) for r in feeds.read_daily(spark, f"{p}/daily.csv", "Date", "Flights").collect()] == [("2024-01-01", 4.0), ("2024-01-02", 5.0)]
    with gzip.open(tmp_path / "states_2024-01-05-07.csv.gz", "wt") as f:
        f.write("time,icao24,lat,lon,velocity,heading,vertrate,callsign,onground,alert,spi,squawk,baroaltitude,geoaltitude,lastposupdate,lastcontact\n1,abc,50,8,100,90,0,X1 ,false,false,false,123,1000,,1,2.0\n1,abd,,8,100,90,0,X,false,false,false,123,1000,,1,2.0\n")
    old = feeds.read_archive(spark, f"{p}/states_2024-01-05-07.csv.gz")
    (row,) = old.collect()
    assert (row.icao24, row.squawk, row.callsign, row.file_date, row.file_hour, row.source) == ("abc", "0123", "X1", "2024-01-05", "07", "historical")
    (raw,) = feeds.as_bronze(old).collect()
    assert raw.key == "abc" and json.loads(raw.raw_payload)["icao24"] == "abc" and raw.kafka_offset == -1
    with gzip.open(tmp_path / "log.json.gz", "wt") as f:
        f.write('{"icao24": "abc", "last_contact": 5}\n\n')
    (tmp_path / "bronze-errors").mkdir()
    with gzip.open(tmp_path / "bronze-errors" / "x.json.gz", "wt") as f:
        f.write('{"icao24": "bad"}\n')
    assert [r.icao24 for r in feeds.read_gzip_log(spark, p).filter("icao24 in ('abc', 'bad') and last_contact = 5").collect()] == ["abc"]
    corridors = spark.createDataFrame([(1, 10)], "corridor_id long, member_count long")
    assert not sinks.write_artifact(corridors, {"k": 1}, f"{p}/art", "1") and sinks.write_artifact(corridors, {"k": 1}, f"{p}/art", "2", min_rows=5)
    assert spark.read.json(f"{p}/art/current").head().member_count == 10


def test_versions_of_a_table(spark, tmp_path):
    table = sinks.Upsert(spark, f"{tmp_path}/t", buckets=2)
    at = lambda n: spark.createDataFrame([("a", n, datetime.datetime(2024, 1, n), n), ("b%d" % n, n, datetime.datetime(2024, 1, n), n)], "icao24 string, time_position long, ingest_ts timestamp, event_id long")
    for n in (1, 2, 3):
        table.merge(at(n), n)
    assert [table.read(n).count() for n in (1, 2, 3)] == [2, 4, 6]
    table.clear(before=3)
    assert table.read().count() == 6 and table.read(2) is None


def test_feeds_that_fail(spark, tmp_path):
    df = spark.createDataFrame([("a", 1)], "icao24 string, v int")
    feeds_ = joins.fetched(lambda: df, lambda: spark.read.parquet(f"{tmp_path}/none"), lambda: df.withColumn("v", F.lit(2)))
    assert [r.v for r in joins.merged_feeds(feeds_, allow_empty=False).collect()] == [2]
    with pytest.raises(ValueError):
        joins.merged_feeds([df.limit(0)], allow_empty=False)
    got = joins.asked(spark, "select v from {t} where icao24 = :k", {"t": df}, {"k": "a' or '1'='1"})
    assert got.collect() == []
    now = datetime.datetime(2024, 1, 1, 12)
    progress = [{"name": "a", "timestamp": "2024-01-01T11:59:00.000Z", "numInputRows": 5}, {"name": "b", "timestamp": "2024-01-01T11:00:00.000Z", "numInputRows": 5}, {"name": "c", "timestamp": "2024-01-01T11:40:00.000Z", "numInputRows": 1, "waiting": 9}]
    assert marts.sink_status(progress, now) == [("a", "ok"), ("b", "no_data"), ("c", "delayed")]


def test_flights_between_airports(spark, tmp_path):
    rows = leg_rows(spark).withColumns({"true_track": F.lit(300.0), "speed_kmh": F.lit(800.0)})
    rows.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    out = jobs.with_state(jobs.with_airports(stream, dims.airports(spark)), jobs.Flights(), jobs.FLIGHTS)
    q = jobs.writer(out, f"{tmp_path}/cp", False, "1 second").outputMode("update").foreachBatch(lambda df, i: df.write.mode("append").parquet(f"{tmp_path}/out")).start()
    try:
        end = time.time() + 60
        while not any(p["numInputRows"] for p in q.recentProgress) and time.time() < end:
            time.sleep(0.5)
    finally:
        q.stop()
    got = spark.read.parquet(f"{tmp_path}/out").orderBy("icao24", "t").collect()
    assert [(r.icao24, r.kind, r.t, r.departure_iata, r.arrival_iata) for r in got] == [("a", "flying", 60, "FRA", None), ("a", "flying", 1860, "FRA", None), ("a", "route", 3660, "FRA", "LHR")]
    route = got[-1]
    assert route.duration_min == 60.0 and 600 < route.distance_km < 700 and route.avg_speed_kmh == pytest.approx(route.distance_km, abs=0.1)
    assert all(r.predicted_iata not in (None, "FRA") and r.eta_minutes > 0 for r in got[:2])


def test_lags_over_parts_equal_lags_over_keys(spark):
    rows = [(i, k, t, v) for i, (k, t, v) in enumerate([("a", 10, 1.0), ("a", 99, 2.0), ("a", 99, 4.0), ("a", 100, 5.0), ("a", 950, 7.0), ("a", -5, 0.5), ("b", 300, 1.0), (None, 20, 3.0), (None, 520, 8.0), ("c", 205, 2.0), ("c", 202, 1.0)])]
    df = spark.createDataFrame([(i, k, t, v, False) for i, k, t, v in rows], "event_id long, icao24 string, time_position long, velocity double, on_ground boolean")
    df = df.withColumns({c: F.lit(1.0) for c in ("latitude", "longitude", "true_track", "vertical_rate", "baro_altitude")})
    want = {}
    for key in {r[1] for r in rows}:
        own = sorted((t, i, v) for i, k, t, v in rows if k == key)
        want |= {b[1]: (b[2] - a[2]) / max(1, b[0] - a[0]) for a, b in zip(own, own[1:])}
    for width in (1, 100, 86_400):
        got = windows.lag_features(df, width)
        assert got.columns[: len(df.columns)] == df.columns and {r.event_id: r.acceleration for r in got.collect()} == want
    assert windows.lag_features(df.limit(0)).collect() == []


def test_legs_over_parts_equal_a_walk_over_rows(spark):
    rng = np.random.default_rng(3)
    places = [(r.iata, r.airport_lat, r.airport_lon) for r in dims.airports(spark).collect()[:5]]
    rows = []
    for i in range(400):
        _, lat, lon = places[int(rng.integers(5))]
        away = float(rng.choice([0.0, 5.0]))
        rows.append((i, [None, "a", "b"][int(rng.integers(3))], int(rng.integers(0, 1000)), bool(rng.random() < 0.4), None if rng.random() < 0.1 else lat + away, lon))
    df = spark.createDataFrame(rows, "event_id long, icao24 string, last_contact long, on_ground boolean, latitude double, longitude double")
    want = {}
    for key in (None, "a", "b"):
        before, departure, flying = None, (None, None), False
        for i, _, t, ground, lat, lon in sorted((r for r in rows if r[1] == key), key=lambda r: (r[2], r[0])):
            if before and not ground:
                near = [iata for iata, la, lo in places if lat == la and lon == lo]
                departure, flying = ((near[0], t) if near else (None, None)), True
            want[i] = (before, departure if flying else (None, None))
            if ground:
                flying = False
            before = ground
    few = dims.airports(spark).filter(F.col("iata").isin([p[0] for p in places]))
    for width in (1, 90, 86_400):
        got = {r.event_id: (r.was_on_ground, (r.dep_iata, r.dep_time)) for r in legs.with_departures(df, few, width=width).collect()}
        assert got == want


def test_retention_removes_partitions(spark, tmp_path):
    path, days = f"{tmp_path}/t", ["2024-01-01", "2024-01-11", "2024-01-12", "2024-02-10", "unknown"]
    spark.createDataFrame([(i, d) for i, d in enumerate(days)], "a long, ingest_date string").write.partitionBy("ingest_date").parquet(path)
    spark.sql(f"create table kept_days (a long, ingest_date string) using parquet partitioned by (ingest_date) location '{path}'")
    spark.sql("msck repair table kept_days")
    assert sinks.drop_expired(spark, path, "ingest_date", "2024-02-10", 30, "kept_days") == ["2024-01-01", "2024-01-11"]
    assert {r.ingest_date for r in spark.table("kept_days").collect()} == {"2024-01-12", "2024-02-10", "unknown"}
    assert sorted(x.name for x in (tmp_path / "t").iterdir() if x.is_dir()) == [f"ingest_date={d}" for d in days[2:]]
    assert sinks.drop_expired(spark, f"{tmp_path}/none", "ingest_date", "2024-02-10") == []
