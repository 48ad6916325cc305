"""The manifest against trees built one by one."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from skylattice.llm import merkle


def digest(nodes):
    return hashlib.sha256("".join(nodes).encode()).hexdigest()


def leaf(doc_id, source, lang, n_chars, text):
    return digest("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text))


def climb(nodes, i, node):
    """Root of nodes, siblings of i on the way, and the root with i replaced by node."""
    others = []
    while len(nodes) > 1:
        start = i // 8 * 8
        run = nodes[start : start + 8]
        others += run[: i - start] + run[i - start + 1 :]
        node = digest(run[: i - start] + [node] + run[i - start + 1 :])
        nodes = [digest(nodes[k : k + 8]) for k in range(0, len(nodes), 8)]
        i //= 8
    return nodes[0], others, node


def lower(text):
    return None if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def brute(rows):
    langs = {}
    for r in rows:
        tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
        d, source, lang, n, text = r
        langs.setdefault(lang, []).append((leaf(*r), leaf(d, source, lang, n, lower(text)) if tampered else leaf(*r), d))
    keys = sorted(langs, key=lambda k: (k is not None, (k or "").encode()))
    for k in keys:
        langs[k].sort(key=lambda x: (x[2] is not None, x[2] or 0, x[0]))
    tops = [climb([x[0] for x in langs[k]], 0, "")[0] for k in keys]
    out = []
    for at, k in enumerate(keys):
        nodes = [x[0] for x in langs[k]]
        for i, (own, changed, d) in enumerate(langs[k]):
            sub, others, up = climb(nodes, i, changed)
            root, more, end = climb(tops, at, up)
            out.append((d, own, sub, root, digest(others + more), end, end == root))
    return out


def key(row):
    return (row[0] is not None, row[0] or 0, *row[1:])


@pytest.mark.parametrize("sizes", [{"en": 1}, {"en": 9, None: 1, "": 2}, {"de": 513, "en": 8, "zz": 70, "é": 65, "Z": 3, "a": 1, "b": 1, "c": 2, "d": 64}])
def test_manifest_equals_brute_force(spark, sizes):
    rows, d = [], 0
    for lang, n in sizes.items():
        for i in range(n):
            d += 1
            rows.append((d * 7 % 1001, None if d % 11 == 0 else "s", lang, None if d % 13 == 0 else d, None if d % 5 == 0 else f"Text {d} ÄB" if d % 3 else "lower only"))
    rows += [rows[0], (None, "x", "en", 1, "No id"), (3, None, "en", None, ""), (3, None, "en", None, "A" * 300_000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").withColumn("leaf", F.lit("clash")).withColumn("k", F.lit(1)).withColumn("pos", F.lit(1))
    got = [tuple(r) for r in merkle.manifest(df.repartition(5), F.crc32(F.col("doc_id").cast("string")) % 3 == 0).collect()]
    assert sorted(got, key=key) == sorted(brute(rows), key=key)
    assert {r[6] for r in got} == {True, False}


def test_several_rounds_and_empty_tables(spark):
    rows = [(i, "s", "en" if i % 4 else None, i, f"T{i}") for i in range(700)] + [(i, "s", f"l{i}", i, "x") for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    got = [tuple(r) for r in merkle.manifest(df, F.crc32(F.col("doc_id").cast("string")) % 3 == 0, height=1).collect()]  # a block is one run then
    assert sorted(got, key=key) == sorted(brute(rows), key=key)
    assert merkle.manifest(df.limit(0)).collect() == []
    assert all(r.verified for r in merkle.manifest(df).collect())
