"""Hard negatives against scores of all pairs."""

import math
import random

import numpy as np
import pytest

from skylattice.llm import hard_negatives as hn

SCHEMA = "vec_id long, label int, embedding array<float>"


def brute(rows, every=100, positives=5, negatives=10):
    known = []
    for i, label, x in rows:
        if label is None or x is None or any(e is None or not math.isfinite(e) for e in x):
            continue
        known.append((i, (label + 1) % 10 if i is not None and i % 7 == 0 else label, [math.floor(256 * float(np.float32(e))) for e in x]))
    out = []
    for k, (i, label, q) in enumerate(known):
        if i is None or i % every:
            continue
        others = [(-sum(a * b for a, b in zip(q, x)), j is None, j or 0, lab, j) for n, (j, lab, x) in enumerate(known) if n != k]
        others.sort(key=lambda o: o[:3])
        for s, _, _, _, p in [o for o in others if o[3] == label][:positives]:
            some = [o for o in others if o[3] != label and 30 * -s <= 100 * -o[0] <= 90 * -s][:negatives]
            out += [(i, p, n, o[4], -s, -o[0]) for n, o in enumerate(some, 1)]
    return sorted(out, key=repr)


def found(spark, rows, **how):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = hn.hard_negatives(hn.whole_vectors(hn.relabelled(df)), **how)
    return sorted((tuple(r) for r in got.collect()), key=repr)


def test_scores_are_whole_inner_products():
    r = np.random.default_rng(1)
    for dims, most in ((1, 3), (8, 1), (13, 300), (64, 1 << 20), (5, 1 << 40)):
        a, c = r.integers(-most, most, (7, dims)), r.integers(-most, most, (40, dims))
        c[0] = -most
        bits = int(most).bit_length() + 1
        packed = hn.planes_of(c, bits)
        assert (hn.values_of(packed, dims) == c).all()
        assert (hn.scores(packed, hn.subset_sums(a)) == c @ a.T).all()
    assert (hn.subset_sums(np.arange(8)[None])[0, :, 0] == [sum(d for d in range(8) if s >> d & 1) for s in range(256)]).all()


@pytest.mark.parametrize("how", [{}, {"chunk": 16, "block": 2}, {"every": 10, "positives": 3, "negatives": 4, "chunk": 50, "block": 7}])
def test_equals_brute_force(spark, how):
    r = random.Random(3)
    rows = [(i, r.randrange(3), [r.gauss(0.1, 0.3) for _ in range(11)]) for i in range(401)]
    rows += rows[:30] + rows[100:101]  # repeated rows, anchors too
    rows += [(500 + i, 1, rows[1][2]) for i in range(40)]  # ties
    rows += [(600, None, [0.1]), (700, 1, None), (800, 1, [0.1, None]), (801, 1, [float("nan")] * 11), (802, 1, [float("inf")]), (None, 2, [0.5] * 11), (None, 1, [0.5] * 11), (900, 1, [0.4, 0.2]), (901, 2, []), (903, 2, [-70000.0] * 11)]
    counted = {k: v for k, v in how.items() if k in ("every", "positives", "negatives")}
    assert found(spark, rows, **how) == brute(rows, **counted)


def test_few_and_no_rows(spark):
    assert found(spark, []) == []
    assert found(spark, [(100, 1, [1.0])]) == []
    assert found(spark, [(100, 1, [1.0]), (1, 1, [1.0]), (2, 2, [0.5]), (3, 2, [0.95]), (300, None, [1.0])]) == [(100, 1, 1, 2, 65536, 32768)]
