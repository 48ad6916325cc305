"""Sums of distances between all points, and the silhouette of groups of any size."""

import numpy as np
import pytest

from skylattice.operators import cluster
from skylattice.operators.tiles import distance_sums_of_all

SCHEMA = "event_id long, g string, label long, x0 double, x1 double, x2 double, x3 double"


@pytest.mark.parametrize(("part_size", "block", "least"), [(1 << 17, 10_000, 8), (60, 20, 1), (90, 16, 3)])
def test_sums_by_tiles(spark, part_size, block, least):
    rng = np.random.default_rng(4)
    labels = np.repeat(np.arange(43), [150, 120, 1, *[4] * 40])
    n = len(labels)
    x, weight, g = rng.normal(0, 1, (n, 4)) + labels[:, None] % 5, rng.integers(1, 4, n), np.where(labels % 2, "a", None)
    whole = np.bincount(labels, weight)[labels]
    rows = [(i, g[i] and str(g[i]), int(labels[i]), int(weight[i]), int(whole[i]), *map(float, x[i])) for i in rng.permutation(n).tolist()]
    df = spark.createDataFrame(rows, "event_id long, g string, label long, weight long, whole long, x0 double, x1 double, x2 double, x3 double")
    got = {}
    for r in distance_sums_of_all(df, cluster.DIMS, part_size, block, least).collect():
        assert (r.event_id, r.other) not in got
        got[r.event_id, r.other] = r.s, r.n
    assert len(got) < 12 * n
    far = np.linalg.norm(x[:, None] - x[None], axis=2) * weight
    for i in range(n):
        sums = {k: (far[i, labels == k].sum(), weight[labels == k].sum()) for k in range(43) if (k % 2 == 1) == (g[i] == "a")}
        assert got[i, labels[i]] == (pytest.approx(sums[labels[i]][0], abs=1e-6), sums[labels[i]][1])
        found = {k: got[i, k] for k in sums if k != labels[i] and (i, k) in got and got[i, k][1] == sums[k][1]}
        assert all(s == pytest.approx(sums[k][0], abs=1e-6) for k, (s, _) in found.items())
        assert min(s / m for s, m in found.values()) == pytest.approx(min(s / m for k, (s, m) in sums.items() if k != labels[i]))


def test_silhouette_of_a_large_group_is_no_estimate(spark):
    rng = np.random.default_rng(5)
    x, times = rng.normal(0, 1, (600, 4)), rng.integers(20, 60, 600)
    own = np.repeat([0, 1, 2], [400, 150, 50])
    x += own[:, None]
    at = np.repeat(np.arange(600), times)
    assert len(at) > 20_000
    rows = [(i, "g", int(own[k]), *map(float, x[k])) for i, k in enumerate(at)]
    df = spark.createDataFrame(rows, SCHEMA)
    far = np.linalg.norm(x[:, None] - x[None], axis=2) * times
    sums, n = np.stack([far[:, own == k].sum(1) for k in range(3)], 1), np.bincount(own, times)
    inner = sums[np.arange(600), own] / (n[own] - 1)
    outer = np.where(own[:, None] == np.arange(3), np.inf, sums / n).min(1)
    want = np.average((outer - inner) / np.maximum(outer, inner), weights=times)
    got = cluster.silhouette(df.drop("label"), df.select("event_id", "g", "label"), "g").head()
    assert got.silhouette == pytest.approx(want, abs=1e-9) and got.silhouette_error == 0
