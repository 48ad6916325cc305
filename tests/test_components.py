"""Components of chains, stars, cycles and random graphs; rounds stay logarithmic."""

import random

import numpy as np
import pytest

from skylattice.operators import cluster, components


def roots(pairs):
    up = {x: x for p in pairs for x in p if None not in p}

    def top(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None:
            up[max(top(a), top(b))] = min(top(a), top(b))
    linked = {x for a, b in pairs if a is not None and b is not None and a != b for x in (a, b)}
    groups = {}
    for x in linked:
        groups.setdefault(top(x), set()).add(x)
    return {frozenset(g) for g in groups.values()}


def found(df):
    groups = {}
    for r in df.collect():
        groups.setdefault(r.root, set()).add(r.node)
    assert all(k in g for k, g in groups.items())
    return {frozenset(g) for g in groups.values()}


@pytest.mark.parametrize("seed", range(3))
def test_random_graphs(spark, seed):
    r = random.Random(seed)
    pairs = [(r.randrange(300), r.randrange(300)) for _ in range(60 + 60 * seed)] + [(7, 7), (None, 3), (5, None)]
    pairs += pairs[:5] + [(1000, x) for x in range(1001, 1040)] + [(2000 + i, 2000 + (i + 1) % 30) for i in range(30)]
    assert found(components.components(spark.createDataFrame(pairs, "a long, b long"))) == roots(pairs)
    assert components.components(spark.createDataFrame([(1, 1)], "a long, b long")).collect() == []


@pytest.mark.parametrize("order", ["rising", "shuffled"])
def test_a_path_of_10000_nodes_ends_in_under_20_rounds(spark, monkeypatch, order):
    steps = []
    flat = components.flattened
    monkeypatch.setattr(components, "flattened", lambda up: steps.append("round") or flat(up))
    keep = components.stored
    monkeypatch.setattr(components, "stored", lambda df: steps.append("jump" if "moved" in df.columns else "table") or keep(df))
    names = list(range(10_001))
    if order == "shuffled":
        random.Random(1).shuffle(names)
    out = components.components(spark.createDataFrame(list(zip(names, names[1:])), "a long, b long").coalesce(1))
    assert out.count() == 10_001 and out.select("root").distinct().count() == 1
    assert steps.count("round") < 14 and (steps.count("jump") < 20 if order == "rising" else steps.count("round") + steps.count("jump") < 60)


def test_clusters_are_numbered_by_group_and_label(spark):
    rows = [(1, "b", 5), (2, "b", 9), (3, "a", 7), (4, "a", -1), (5, None, 2), (6, "b", 5)]
    got = {r.event_id: r.corridor_id for r in cluster.numbered(spark.createDataFrame(rows, "event_id long, g string, label long"), "g").collect()}
    assert got == {5: 0, 3: 1, 1: 2, 6: 2, 2: 3, 4: -1}


def test_silhouette_by_blocks(spark):
    rng = np.random.default_rng(6)
    kinds = [("a", 1, 60), ("a", 2, 40), ("a", 3, 1), ("b", 4, 300), ("b", 5, 200), ("b", -1, 50), ("c", 6, 20), (None, 7, 10), (None, 8, 9)]
    rows, i = [], 0
    for g, label, n in kinds:
        for x in rng.normal(label % 3, 0.6, (n, 4)):
            rows.append((i := i + 1, g, label, *map(float, x)))
    df = spark.createDataFrame(rows, "event_id long, g string, label long, x0 double, x1 double, x2 double, x3 double").repartition(3)
    points, labels = df.drop("label"), df.select("event_id", "g", "label")
    want = {}
    for g in ("a", "b", None):
        x = np.array([r[3:] for r in rows if r[1] == g and r[2] != -1])
        own = np.array([r[2] for r in rows if r[1] == g and r[2] != -1])
        d = np.linalg.norm(x[:, None] - x[None], axis=2)
        each = []
        for k in range(len(x)):
            mine = own == own[k]
            inside = d[k, mine].sum() / max(1, mine.sum() - 1)
            outside = min(d[k, own == o].mean() for o in set(own.tolist()) - {own[k]})
            each.append(0 if mine.sum() == 1 else (outside - inside) / max(outside, inside))
        want[g] = np.mean(each)
    got = {r.g: r for r in cluster.silhouette(points, labels, "g").collect()}
    assert set(got) == {"a", "b", "c", None} and got["c"].silhouette is None
    for g, value in want.items():
        assert got[g].silhouette == pytest.approx(value, abs=1e-9) and got[g].silhouette_error == 0
    some = {r.g: r for r in cluster.silhouette(points, labels, "g", size=150, least=30).collect()}
    assert some["a"].silhouette == pytest.approx(want["a"], abs=1e-9)  # a small group stays whole
    assert 0 < some["b"].silhouette_error < 0.05 and abs(some["b"].silhouette - want["b"]) < 4 * some["b"].silhouette_error


def test_distance_sums_do_not_grow_with_labels(spark):
    rng = np.random.default_rng(8)
    x = np.repeat(rng.normal(0, 2, (150, 4)), 4, 0) + rng.normal(0, 0.1, (600, 4))
    rows = [(i, "a", i // 4, 4, *map(float, p)) for i, p in enumerate(x)]
    df = spark.createDataFrame(rows, "event_id long, g string, label long, whole long, x0 double, x1 double, x2 double, x3 double")
    far = np.linalg.norm(x[:, None] - x[None], axis=2).reshape(600, 150, 4).sum(2)
    for share in (1 << 26, 1 << 12):
        got = cluster.distance_sums(df, df.drop("whole"), sample_block=64, block=100, share=share).collect()
        assert 1200 <= len(got) < 600 * 40
        found = {}
        for r in got:
            assert r.n <= 4 and (r.n < 4 or r.s == pytest.approx(far[r.event_id, r.other], abs=1e-6))
            found.setdefault(r.event_id, {})[r.other] = r.s / r.n
        for i in range(600):
            others = np.where(np.arange(150) == i // 4, np.inf, far[i])
            assert i // 4 in found[i] and min(v for k, v in found[i].items() if k != i // 4) == pytest.approx(others.min() / 4, abs=1e-6)
