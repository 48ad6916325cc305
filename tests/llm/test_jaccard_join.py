"""Components of similar n-gram sets against all pairs."""

import random

import numpy as np
import pytest

from skylattice.llm import jaccard_join as jj


def shingles(text, size=4):
    words = ("" if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)).encode().split()
    if len(words) < size:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def brute(rows, size=4, percent=85):
    sets = [shingles(t, size) for _, t in rows]
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                up[max(top(i), top(j))] = min(top(i), top(j))
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None and sets[i]:
            least[top(i)] = min(d, least.get(top(i), d))
    return sorted(((d, len(s), least.get(top(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=repr)


def corpus(seed):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    lines = [" ".join(r.choices(words, k=12)) for _ in range(12)]
    rows, d = [], 0
    for _ in range(12):
        base = r.choices(words, k=r.choice([5, 30, 120, 400]))
        for _ in range(r.choice([1, 2, 9, 25])):
            own = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 4])):
                own[r.randrange(len(own))] = r.choice(words)
            if r.random() < 0.3:
                own += r.choices(words, k=r.choice([1, 5, 20]))
            rows.append((d := d + 1, " ".join(own).replace("w1 ", "W1\t")))
    for _ in range(60):  # texts of common lines only
        rows.append((d := d + 1, "\n".join(r.sample(lines, r.choice([3, 5, 8])))))
    for _ in range(40):  # a chain: each one similar to its neighbours only
        rows.append((d := d + 1, " ".join(f"c{i}" for i in range(3 * d, 3 * d + 80))))
    rows += [(9001, None), (9002, ""), (9003, " \n"), (9004, "one"), (9005, "ONE"), (9006, "one two three"), (None, "one"), (None, "alone here"), rows[0], (9007, "x " * 50_000), (9008, "X " * 70)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("how", [{}, {"limit": 4, "slice_bytes": 3000, "part_tokens": 500}, {"limit": 16, "unit_bytes": 4000, "slice_bytes": 20_000}, {"size": 3, "percent": 60, "limit": 8}])
def test_components_equal_brute_force(spark, how):
    rows = corpus(len(how))
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 n", "'x' slice", "2 key").repartition(4)
    got = sorted((tuple(x) for x in jj.similar_documents(df, **how).collect()), key=repr)
    assert got == brute(rows, how.get("size", 4), how.get("percent", 85))


def test_empty_tables_and_tables_without_words(spark):
    schema = "doc_id long, text string"
    assert jj.similar_documents(spark.createDataFrame([], schema)).collect() == []
    got = jj.similar_documents(spark.createDataFrame([(1, None), (2, " "), (2, " ")], schema)).collect()
    assert sorted(tuple(x) for x in got) == [(1, 0, 1), (2, 0, 2), (2, 0, 2)]


def test_numbers_pack_whole():
    r = np.random.default_rng(5)
    for top in (10, 1 << 20, (1 << 63) - 1):
        x = np.sort(r.integers(0, top, 1000).astype(np.uint64))
        assert (jj.risen(jj.rising(x)) == x).all()
    assert len(jj.risen(jj.rising(np.zeros(0, np.uint64)))) == 0
