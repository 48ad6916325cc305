"""Values that lie on a threshold or a tie of rounding fall on the side on which SQL has them."""

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from skylattice.functions import geo
from skylattice.operators import windows
from skylattice.operators.ranks import ranked
from skylattice.plans import sql


def test_angles_on_a_threshold(spark):
    rows = [(float(t), round((t * 10 + s * 153) % 3600 / 10, 1)) for t in range(360) for s in (-1, 1)]
    want = duckdb.sql(f"select t, h, (2 + {sql.angle('t', 'h')} / 45) / 3 > 0.78 from (values {', '.join(f'({t}e0, {h}e0)' for t, h in rows)}) v(t, h)").fetchall()
    got = spark.createDataFrame(rows, "t double, h double").select("t", "h", (2 + geo.angle_between(F.col("t"), F.col("h")) / 45) / 3 > 0.78)
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_lines_round_ties_like_sql(spark):
    rows = [(i, a / 10 - 50 + t / 86400, -t / 86400 - a / 10) for i, (a, t) in enumerate([(0, 4428), (0, 5076), (1, 108), (433, 324), (900, 756), (1100, 972), (7, 540), (611, 2052)])]
    want = duckdb.sql(f"select round(y, 4), round(x, 4) from (values {', '.join(f'({i}, {y!r}::double, {x!r}::double)' for i, y, x in rows)}) v(i, y, x) order by i").fetchall()
    line = windows.polyline(spark.createDataFrame(rows, "event_id long, latitude double, longitude double").withColumn("k", F.lit("k")), "k", F.col("event_id"), n=8).head().polyline
    assert [tuple(p) for p in line] == want


def test_turns_of_one_degree_a_second(spark):
    rows = [(float(a), float((a + d) % 360), d) for a in range(360) for d in range(1, 90)]
    turn = "degrees(atan2(sin(radians(b)) * cos(radians(a)) - cos(radians(b)) * sin(radians(a)), sin(radians(b)) * sin(radians(a)) + cos(radians(b)) * cos(radians(a)))) / d"
    want = duckdb.sql(f"select count(*) filter (abs({turn}) > 1), count(*) filter (abs({turn}) = 1) from (select cast(a as double) a, cast((a + d) % 360 as double) b, d from range(360) x(a), range(1, 90) y(d))").fetchall()
    trig = [f(F.radians(c)) for c in ("b", "a") for f in (geo.sin_libm, geo.cos_libm)]
    got = spark.createDataFrame(rows, "a double, b double, d long").select((geo.signed_turn(*trig) / F.col("d")).alias("turn")).agg(F.count_if(F.abs("turn") > 1), F.count_if(F.abs("turn") == 1)).head()
    assert [tuple(got)] == want


def test_ranks_of_rows_that_come_in_another_order_on_every_read(spark):
    n = 300_000

    def any_order(batches):
        rows = pa.Table.from_batches(batches)
        yield from rows.take(pa.array(np.random.permutation(rows.num_rows))).to_batches()

    rows = spark.range(0, n, 1, 2).select(F.lit("k").alias("k"), "id", (F.col("id") * 7919 % n).cast("double").alias("v")).mapInArrow(any_order, "k string, id long, v double")
    wrong = F.count_if((F.col("rank_i") != F.col("v")) | (F.col("rank_n") != n))
    assert tuple(ranked(rows, ["k"], "v", "id").agg(F.count("*"), wrong).head()) == (n, 0)
