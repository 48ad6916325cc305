"""Neighbours by blocks against brute force; rows are dealt to few blocks."""

import numpy as np
from pyspark.sql import functions as F

from skylattice.operators import blocks, cluster

SCHEMA = "event_id long, g string, x0 double, x1 double, x2 double, x3 double"


def made(spark, n=400, seed=3):
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.normal(0, 1, (n, 4)), rng.normal(2, 0.05, (n // 4, 4)), np.repeat([[0.5, 0.5, 0.5, 0.5]], 12, 0), np.arange(12)[:, None] * [0.25, 0, 0, 0] - 1])
    rows = [(i, "ab"[i % 2], *map(float, p)) for i, p in enumerate(x)]
    return x, rows, spark.createDataFrame(rows, SCHEMA).repartition(3)


def test_k_distances_and_clusters_against_brute_force(spark):
    x, rows, points = made(spark)
    got = {r.event_id: r.k_distance for r in cluster.k_distances(points, "g").collect()}
    labels = {r.event_id: (r.is_core, r.label) for r in cluster.dbscan(points, "g", 0.25, min_samples=4).collect()}
    assert len(got) == len(labels) == len(rows)
    for g in "ab":
        ids = np.array([r[0] for r in rows if r[1] == g])
        far = np.sqrt(((x[ids][:, None] - x[ids][None]) ** 2).sum(2))
        assert np.allclose(np.sort(far, 1)[:, 7], [got[i] for i in ids], atol=1e-12)
        near = far <= 0.25
        core = near.sum(1) >= 4
        top = np.where(core, ids, 1 << 40)
        for _ in ids:
            top = np.where(core, np.where(near & core, top, 1 << 40).min(1), 1 << 40)
        want = np.where(core, top, np.where(near & core, top, 1 << 40).min(1))
        assert [labels[i] for i in ids.tolist()] == [(bool(c), -1 if w == 1 << 40 else int(w)) for c, w in zip(core, want)]


def test_rows_are_dealt_to_few_blocks(spark):
    _, rows, points = made(spark, 2000)
    one = points.select("event_id", *cluster.DIMS, F.xxhash64("g").alias("__group"), F.lit(0.2).alias("__r"), F.lit(True).alias("__asks"))
    out = blocks.dealt(one, cluster.DIMS)
    assert out.count() < 8 * len(rows) and out.filter("__mine").count() == len(rows)


def test_wide_radii_deal_rows_once(spark):
    _, rows, points = made(spark)
    one = points.select("event_id", *cluster.DIMS, F.xxhash64("g").alias("__group"), F.lit(1e4).alias("__r"), F.lit(True).alias("__asks"))
    assert blocks.dealt(one, cluster.DIMS).count() == len(rows)
