"""Operators that SQL cannot express, against brute force on the smallest documents."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from skylattice.llm import bpe_codec, common, gru, lm_scoring, near_texts, simhash, token_counts, toxicity

P = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


def test_token_counts_equal_the_library():
    lib, own = Tokenizer.from_file(P.path("byte_bpe_50k.json")), token_counts.Tokenizer(token_counts.compiled(P.path("byte_bpe_50k.json")))
    r = random.Random(1)
    parts = [" ", "  ", "\n", "\t", "a", "'s", "'re", "'", "'ll", "é", "1", "٣", "<|endoftext|>", "the", "ing", "!", "　", "中", "😀", "\x1c", "\x85", "don't", "\0", "²", "𝟘"]
    rows = ["".join(r.choices(parts, k=r.randint(0, 60))) for _ in range(3000)] + ["", "a" * 5000, " " * 700 + "x"]
    assert own.count_texts(rows) == [len(e.ids) for e in lib.encode_batch(rows, add_special_tokens=False)]
    assert own.count_texts(rows, most=16) == own.count_texts(rows)
    own.known.clear()
    own.known.words.max_states = 50  # tables that are emptied again and again
    assert own.count_texts(rows[:300]) == [len(e.ids) for e in lib.encode_batch(rows[:300], add_special_tokens=False)]


def test_bpe_equals_the_library_and_round_trips(docs, texts):
    ranks = bpe_codec.ranks_of(P.path("byte_bpe_50k.tiktoken"))
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: r for r in bpe_codec.encode_decode(docs, P.path("byte_bpe_50k.tiktoken"), max_bytes=40_000).collect()}
    for k, t in texts.items():
        assert list(got[k].ids) == lib.encode_ordinary(t) and bytes(got[k].decoded) == t.encode() and got[k].n_tokens == len(got[k].ids)


def test_rows_in_another_order_on_each_read(docs, texts):
    shuffled = docs.orderBy(F.rand())  # no seed is fixed across reads: each one sorts anew
    shuffled = shuffled.mapInArrow(lambda batches: (b.take(np.random.permutation(b.num_rows)) for b in batches), docs.schema)
    ranks = bpe_codec.ranks_of(P.path("byte_bpe_50k.tiktoken"))
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: r.n_tokens for r in bpe_codec.encode_decode(shuffled, P.path("byte_bpe_50k.tiktoken"), ("ids", "decoded"), 40_000).collect()}
    assert got == {k: len(lib.encode_ordinary(t)) for k, t in texts.items()}
    base = {r.doc_id: r.base_score for r in lm_scoring.score_documents(docs, rounds=1).collect()}
    assert {r.doc_id: r.base_score for r in lm_scoring.score_documents(shuffled, rounds=1).collect()} == pytest.approx(base)


def test_simhash(docs, texts, spark):
    prints = {}
    for k, t in texts.items():
        words = t.encode().lower().split()
        hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))] if words else []
        prints[k] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    ids = sorted(prints)
    root = {k: k for k in ids}

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 3 and top(a) != top(b):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    assert {k: (r.fingerprint, r.component_id) for k, r in got.items()} == {k: (f"{prints[k]:016x}", top(k)) for k in ids}
    # buckets that are dealt again give the same links
    rng = np.random.default_rng(0)
    fps = np.unique(np.concatenate([[b ^ np.uint64(1 << int(x)) ^ np.uint64(1 << int(y)) for x, y in rng.integers(0, 20, (40, 2))] for b in rng.integers(0, 2**63, 5, dtype=np.uint64)]))
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long").cache()

    def classes(limit):
        edges = [(r.a, r.b) for r in simhash.links(df, limit).collect()]
        found = {int(x): int(x) for x in fps.view(np.int64)}

        def up(x):
            while found[x] != x:
                x = found[x]
            return x

        for a, b in edges:
            found[max(up(a), up(b))] = min(up(a), up(b))
        return collections.Counter(up(x) for x in found)

    assert classes(8) == classes(4096)


def word_sets(texts, size=5):
    out = {}
    for k, t in texts.items():
        words = (t or "").encode().lower().split()
        out[k] = {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()
    return out


def jaccard_classes(sets, similarity=0.8):
    root = {k: k for k in sets}

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x == y or len(x & y) >= similarity * len(x | y) > 0:
                p, q = sorted((top(a), top(b)))
                root[q] = p
    return {k: top(k) for k in sets}


@pytest.mark.parametrize("limit", [4096, 6])
def test_near_texts_against_jaccard(spark, docs, texts, limit):
    r = random.Random(8)
    word = lambda: r.choice(["w%d" % i for i in range(400)])
    made = {}
    for group in range(12):
        stem = [word() for _ in range(r.randint(20, 90))]
        for _ in range(r.choice((1, 3, 12, 40))):
            copy = list(stem)
            for _ in range(r.randint(0, 4)):
                copy[r.randrange(len(copy))] = word()
            made[100_000 + len(made)] = " ".join(copy)
            stem = copy if r.random() < 0.3 else stem  # chains, whose ends are not alike
    passage = " ".join(word() for _ in range(40))
    for _ in range(30):  # texts that share a passage and are not near each other
        made[100_000 + len(made)] = passage + " " + " ".join(word() for _ in range(r.randint(15, 60)))
    whole = (texts | made) if limit > 100 else made
    df = spark.createDataFrame([(k, t) for k, t in whole.items()], "doc_id long, text string")
    want = jaccard_classes(word_sets(whole))
    found = collections.defaultdict(list)
    for row in near_texts.similar_texts(df, limit=limit).collect():
        found[bytes(row["class"])].append(row.doc_id)
    assert sorted(sorted(v) for v in found.values()) == sorted(sorted(k for k in want if want[k] == root) for root in set(want.values()))
    assert {row.doc_id for row in near_texts.one_of_each(df, limit=limit).collect()} == set(want.values())


def test_one_of_each_tells_rows_apart(spark):
    a, b = "one two three four five six seven eight", "another text with words of its own and more"
    rows = [(1, a, 1), (0, a, 2), (1, b, 3), (None, b, 4), (None, "alone here with nobody else at all", 5), (2, None, 6), (3, "", 7), (0, a, 2), (4, "x", 8), (5, "X", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, row int")
    assert sorted(r.row for r in near_texts.one_of_each(df).collect()) == [2, 3, 5, 6, 8]
    assert near_texts.one_of_each(df.limit(0)).collect() == [] and near_texts.one_of_each(df).columns == df.columns


def test_bit_planes_match_brute_force():
    rng = np.random.default_rng(1)
    fps = np.unique(np.array([int(b) ^ sum(1 << int(i) for i in set(rng.integers(0, 64, rng.integers(0, 4)))) for b in rng.integers(0, 2**63, 30, dtype=np.uint64) for _ in range(12)], np.uint64))
    planes = simhash.planes_of(fps)
    for lag in (1, 5, 64, 70):
        alive = np.packbits(np.pad(np.arange(len(fps)) < len(fps) - lag, (0, -len(fps) % 64)), bitorder="little").view("<u8")
        for radius in (3, 6, 24):
            got = np.unpackbits(simhash.near(planes, simhash.shifted(planes, lag), alive, block=1, radius=radius).view(np.uint8), bitorder="little")[: len(fps) - lag]
            assert (got == (np.bitwise_count(fps[:-lag] ^ fps[lag:]) <= radius)).all()


def test_language_model(docs, texts):
    got = {r.doc_id: r for r in lm_scoring.score_documents(docs, rounds=1).collect()}
    words = {k: [*t.encode().lower().split(), None] for k, t in texts.items()}
    held = {k: zlib.crc32(str(k).encode()) % 10 == 0 for k in texts}
    c = collections.Counter(w for k, d in words.items() if not held[k] for w in d)
    n, v = sum(c.values()), len(c)
    for k, d in words.items():
        base = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in d)
        r = got[k]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[k], len(d), sum(c[w] > 0 for w in d), n)
        assert r.base_score == pytest.approx(base) and r.score < 0


def test_language_model_learns_from_every_training_document(docs, texts, monkeypatch):
    seen = {}
    real = lm_scoring.trained

    def trained(rows, group_tokens, rounds):
        seen.update({r.doc_id: r.train is not None for r in rows.select("doc_id", "train").collect()})
        return real(rows, group_tokens, rounds)

    monkeypatch.setattr(lm_scoring, "trained", trained)
    rows = lm_scoring.score_documents(docs).collect()
    assert seen == {k: zlib.crc32(str(k).encode()) % 10 != 0 for k in texts}
    # by the base score a word costs the same wherever it stands; the trained model beats it on texts it has not seen
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_copies_spread_over_training_groups(spark):
    rows = spark.createDataFrame([(i, 100, b"same") for i in range(400)], "doc_id long, n_tokens long, train binary")
    sizes = [r["count"] for r in lm_scoring.dealt(rows, 4_000, 2).groupBy("part", "round").count().collect()]
    assert sum(sizes) == 400 and len(sizes) >= 15 and max(sizes) <= 60


def test_word_counts_come_packed_by_slice_and_part(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "PART", 200)
    r, odd = random.Random(4), ["", " \t\n", "\x0bA a\x0c", "x\x1cy\x85z\u00a0q  X\x1cY", "\u00c4 \u00e4 \u00c4\r\n", None]
    rows = [(i, odd[i] if i < len(odd) else " ".join(f"w{int(r.paretovariate(0.6)) % 900}" for _ in range(30))) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    slices = common.written(spark, lm_scoring.sliced(common.texts(docs).withColumn("rest", F.crc32(F.col("doc_id").cast("string").cast("binary")))), "slices")
    asked = lm_scoring.asked(slices, 7)
    assert slices.count() == 3 and asked.count() <= 21  # a row for each slice and part, not for each word
    words = {i: re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()) for i, t in rows}
    c = collections.Counter(w for i, ws in words.items() if zlib.crc32(str(i).encode()) % 10 for w in ws)
    summary = lm_scoring.counted(asked).filter("slice is null").collect()
    assert sum(x.types for x in summary) == len(c) and sum(sum(x.bins) for x in summary) == sum(c.values())
    assert {bytes(w): n for x in summary for w, n in zip(x.top_words, x.top_cs)} == c
    docs_in = sum(zlib.crc32(str(i).encode()) % 10 != 0 for i, _ in rows)
    whole = sum(c.values()) + docs_in + 0.1 * (len(c) + 2)
    got = {x.doc_id: x for x in lm_scoring.score_documents(docs, rounds=1).collect()}
    for i, ws in words.items():
        assert (got[i].n_tokens, got[i].n_known) == (len(ws) + 1, sum(c[w] > 0 for w in ws) + 1)
        assert got[i].base_score == pytest.approx(sum(math.log10((n + 0.1) / whole) for n in [docs_in, *(c[w] for w in ws)]))


def test_words_of_a_cut_batch():
    texts = ["first One", " lead\ttrail ", "", "Two two\x0b\x0cONE", "last"]
    for kind in (pa.string(), pa.large_string()):
        batch = pa.RecordBatch.from_arrays([pa.array(texts, kind)], ["text"])
        for at, n in ((0, 5), (1, 3), (3, 2), (2, 1), (0, 0)):
            words, every, counts = lm_scoring.words_of(batch.slice(at, n))
            want = [t.encode().lower().split() for t in texts[at : at + n]]
            assert [words[int(i)].as_py() for i in every] == [w for ws in want for w in ws] and counts.tolist() == [len(ws) for ws in want]


def test_ended_lanes_take_no_part():
    rng = np.random.default_rng(3)
    model = gru.Model(gru.initial(gru.sizes(6, 3, 3, 4)))
    docs = [rng.integers(0, 9, n).astype(np.int32) for n in (40, 3, 9, 2, 5)]
    codes, doc = gru.lanes(docs, 4)
    windows = list(model.windows(codes, doc, 8))
    assert [w[1].shape[1] for w in windows] == [4, 2, 1, 1, 1] and sum((w[1] >= 0).sum() for w in windows) == 59
    alone = [float(model.score([d], 7)[0]) for d in docs]
    assert model.score(docs) == pytest.approx(alone, rel=1e-5) and model.score(docs, 3) == pytest.approx(alone, rel=1e-5)


def test_gradients_and_carried_state(monkeypatch):
    monkeypatch.setattr(gru, "F32", np.float64)
    rng = np.random.default_rng(0)
    weights = {k: v.astype(np.float64) for k, v in gru.initial(gru.sizes(6, 3, 3, 4)).items()}
    model, rows = gru.Model(weights), [rng.integers(0, 9, n) for n in (7, 3, 5, 9)]
    codes, doc = gru.lanes(rows, 2)
    ((_, own, inputs, fresh),) = model.windows(codes, doc, 100)
    state = np.zeros((codes.shape[1], 4))
    g, _, loss = model.gradients(inputs, fresh, own, state)
    for k, w in weights.items():
        at, e = tuple(rng.integers(0, s) for s in w.shape), 1e-5
        was = w[at]
        w[at] = was + e
        up = model.gradients(inputs, fresh, own, state)[2]
        w[at] = was - e
        down = model.gradients(inputs, fresh, own, state)[2]
        w[at] = was
        assert (up - down) / 2 / e == pytest.approx(g[k][at], abs=1e-6)
    assert model.score(rows, 3) == pytest.approx(model.score(rows, 100)) and -model.score(rows).sum() == pytest.approx(loss * sum(map(len, rows)))


def test_nearest_is_exact():
    r = random.Random(2)

    def vec():
        at = np.array(sorted(r.sample(range(30), r.randint(1, 5))))
        x = np.array([r.choice((0.2, 0.5, r.random())) for _ in at])
        return at, x / math.sqrt(float((x * x).sum()))

    examples = [(i // 2 if i < 40 else i, r.randint(0, 1), *vec()) for i in range(700)]  # some ids twice
    index = toxicity.Index(examples, 30, block=16)
    dense = np.zeros((700, 30))
    for row, e in zip(dense, examples):
        row[e[2]] = e[3]
    for own, _, at, x in examples[:150] + [(None, 0, *vec()) for _ in range(150)]:  # queries that are examples, and others
        sims = np.round(dense[:, at] @ x, 12)
        want = sorted((-s, e[0]) for s, e in zip(sims, examples) if s > 0 and (own is None or e[0] != own))[:10]
        got, places = index.nearest((at, x), 10, own)
        assert [(-s, index.ids[i]) for s, i in zip(got, places)] == want
    assert [len(x) for x in toxicity.Index([], 30).nearest(vec(), 10)] == [0, 0]


def test_toxicity_equals_plain_cosines(spark, docs, texts):
    """Scores and evidence of the operator from cosines of dense vectors, weights and calibration by their definitions."""
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, labels, k=5).collect()}
    words = {k: collections.Counter("".join(c.lower() if "A" <= c <= "Z" else c if c.isascii() and c.isalnum() or ord(c) > 127 else " " for c in t).split(" ")) for k, t in texts.items()}
    for c in words.values():
        del c[""]
    known = {r.doc_id: r.toxic for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 != 2}
    n = collections.Counter(w for k in known for w in words[k])
    toxic = collections.Counter(w for k in known if known[k] for w in words[k])
    base = (sum(known.values()) + 0.5) / (len(known) + 1)
    part = lambda x, m, share: x * math.log(x / (m * share)) if x else 0.0
    relevance = {w: min(1, max(0.02, (part(toxic[w], n[w], base) + part(n[w] - toxic[w], n[w], 1 - base)) / 20)) for w in n}
    weight = {w: (math.log((1 + len(known)) / (1 + n[w])) + 1) * relevance[w] for w in n}

    def vec(k):
        v = {w: (1 + math.log(c)) * weight[w] for w, c in words[k].items() if w in n}
        size = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / size for w, x in v.items()}

    vecs = {k: vec(k) for k in texts}
    votes = {}
    for k in texts:
        sims = [(round(sum(x * vecs[o].get(w, 0) for w, x in vecs[k].items()), 12), o) for o in known if o != k]
        near = sorted((-s, o) for s, o in sims if s > 0)[:5]
        assert [(e.doc_id, e.label) for e in got[k].evidence] == [(o, known[o]) for _, o in near]
        assert [e.similarity for e in got[k].evidence] == pytest.approx([-s for s, _ in near], abs=1e-9)
        votes[k] = (sum(-s * known[o] for s, o in near) + 0.1 * base) / (sum(-s for s, _ in near) + 0.1)
    assert len({tuple(e.doc_id for e in r.evidence) for r in got.values()}) > 20
    # calibrated scores rise with votes, and over the fitted rows they add up to the toxic ones
    order = sorted(texts, key=lambda k: votes[k])
    assert all(got[a].score <= got[b].score + 1e-9 for a, b in zip(order, order[1:]))
    assert sum(got[k].score for k in known) == pytest.approx(sum(known.values()), abs=0.1 * len(known))


def test_rising_curves():
    x, share = toxicity.rising(np.array([0.0, 0.25, 0.5, 1.0]), np.array([4.0, 2, 2, 2]), np.array([0.0, 2, 0, 2]))
    assert x.tolist() == [0.0, 0.375, 1.0] and share.tolist() == [0.0, 0.5, 1.0]


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = {r.doc_id: r for r in toxicity.score_toxicity(spark.read.parquet(f"{sf}/documents.parquet"), labels).collect()}
    rows = [(r.toxic, got[r.doc_id].score >= 0.3) for r in labels.collect() if got[r.doc_id].held_out]
    assert all(got[k].held_out == (zlib.crc32(str(k).encode()) % 4 == 2) for k in got)
    assert sum(p for t, p in rows if t) >= 0.8 * sum(t for t, _ in rows) and sum(p for t, p in rows if not t) <= 0.12 * sum(not t for t, _ in rows)
    assert all(e.doc_id != k and zlib.crc32(str(e.doc_id).encode()) % 4 != 2 for k, r in got.items() for e in r.evidence)


def test_digests_of_the_query_are_those_of_the_real_output(docs):
    real = {r.doc_id: r for r in bpe_codec.encode_decode(docs, P.path("byte_bpe_50k.tiktoken")).collect()}
    for r in bpe_codec.encode_decode(docs, P.path("byte_bpe_50k.tiktoken"), ("ids", "decoded")).collect():
        assert r.ids_sha256 == hashlib.sha256(np.array(real[r.doc_id].ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(bytes(real[r.doc_id].decoded)).hexdigest()
