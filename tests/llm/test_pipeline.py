"""The pipeline against brute force on the smallest documents, and its stages on rows of every kind."""

import collections
import hashlib
import os
import re

import duckdb
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from skylattice.llm import bpe_codec, quality_rules
from tests.llm.test_brute_force import jaccard_classes, word_sets
from tests.llm.test_edges import one_edit

P = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"


def kept_by_rules():
    con = duckdb.connect()
    path = f"{SF}/documents.parquet"
    con.sql(f"create view documents as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return {r[0] for r in con.sql(f"with {quality_rules.measured_sql('documents')},{quality_rules.kept_sql()} select doc_id from k where kept").fetchall()}


def without_lines(texts):
    seen, by_size, out = set(), collections.defaultdict(set), {}
    for k in sorted(texts):
        stay = []
        for line in texts[k].split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                near = any(one_edit(line, o) for n in (-1, 0, 1) for o in by_size[len(line) + n])
                if line not in seen and not near:
                    stay.append(line)
                seen.add(line)
                by_size[len(line)].add(line)
            else:
                stay.append(line)
        if re.search(r"[^\x20\x09-\x0D]", "\n".join(stay)):
            out[k] = "\n".join(stay)
    return out


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))


def test_run_equals_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    kept = kept_by_rules()
    texts = without_lines({k: t for k, t in docs.items() if k in kept})
    texts = {k: texts[k] for k in set(jaccard_classes(word_sets(texts)).values())}
    windows = collections.defaultdict(set)
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        ws = words(r.text or "")
        for i in range(max(1, len(ws) - 9) if ws else 0):
            windows[len(ws[i : i + 10])].add(tuple(ws[i : i + 10]))
    clean = {}
    for k, t in texts.items():
        ws = words(t)
        if not any(tuple(ws[i : i + n]) in found for n, found in windows.items() for i in range(len(ws) - n + 1)):
            clean[k] = t
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe_codec.ranks_of(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert len(kept) < len(docs) and len(clean) < len(texts) and set(got) == set(clean)
    for k, t in clean.items():
        assert list(got[k].ids) == lib.encode_ordinary(t) and got[k].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_on_rows_of_every_kind(spark, tmp_path, name, stage):
    long = " ".join(f"word{i} and more of it" for i in range(4000))
    text = "Plain words that make up a text which is long enough to be kept by all of the rules.\nAnd a second line of it."
    rows = [(1, text), (1, text), (1, "Another text under the same id, with words of its own that nobody else has at all."), (None, "Words without an id, enough of them to pass the rules of quality here."), (None, None), (2, None), (3, ""), (4, long), (5, "\n \n\t\n")]
    names = ("row", "__q", "__kept", "__lines", "digest", "key", "class", "n_tokens", "ids", "slice", "hit", "items", "unit", "label")
    docs = spark.createDataFrame([(k, t, "en", None, len(t) if t else 0) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long").withColumns({c: F.lit("clash") for c in names if not (name == "line_dedup" and c == "__lines")})
    spark.createDataFrame([(1, "nothing of this is in any of these texts at all"), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    out = stage(spark, docs, str(tmp_path))
    got = out.collect()
    if name == "tokens":
        assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == sorted((k is None, k or 0) for k, _ in rows)
    else:
        assert out.columns == docs.columns and all(r[c] == "clash" for r in got for c in docs.columns if c in names)
        known = {(k, t) for k, t in rows}
        assert name == "line_dedup" or {(r.doc_id, r.text) for r in got} <= known
        assert any(r.text == long for r in got)
    want = {"quality": 5, "near_dedup": 5, "leaks": 9, "tokens": 9}
    assert name not in want or len(got) == want[name], [(r.doc_id, (r.text or "")[:20]) for r in got]
    assert stage(spark, docs.limit(0), str(tmp_path)).collect() == []
