"""Scores of whole documents by a gated recurrent language model trained on the corpus.

Word counts of all training documents are made by a shuffle of the distinct words of slices (a slice is a few megabytes
of texts, written once in a packed form): each slice sends a packed list to each part of the words' hash range, counts go back to
it the same way, and no task needs the vocabulary. There each text becomes a
sequence of codes: frequent words have codes of their own, others one of a bin of counts. The model predicts codes; a
word within its bin has its share of the bin's count, and the bin of unseen words is one type, as in the base model.
For training, counts leave out the occurrence itself, so that the model learns how likely unseen words are.

The model is trained on every training document, in groups of bounded size side by side, dealt by id and words so that
copies of a text spread over them; after each round the groups' weights are averaged, and the next round starts from there. Only weights, whose
number is fixed, and a few sums come to the driver.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import gru
from .common import packed, read, text_slices, texts, unpacked, without_collection, written

HEAD, PER_CLASS, HIDDEN, BINS = 1024, 32, 32, 40  # bins: unseen, then by bit length of the count; the last is the end
SLICE = 32 << 20
PART = 8 << 20  # bytes of words, as slices send them, that one part counts


def words_of(part: pa.RecordBatch) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct words, each word of the texts as a place among them, words of each text): lower-cased, between ASCII white space."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(part.column("text")))
    found = split.flatten().cast(pa.large_binary()).dictionary_encode()
    words, every = found.dictionary, found.indices.to_numpy().astype(np.uint32)
    owner = np.repeat(np.arange(len(split)), pc.list_value_length(split).to_numpy())
    none = pc.index(words, pa.scalar(b"", pa.large_binary())).as_py()  # from white space at the ends of texts
    if none >= 0:
        owner, every = owner[every != none], every[every != none]
    return words, every, np.bincount(owner, minlength=len(split))


def sliced(rows: DataFrame) -> DataFrame:
    """(slice, doc_ids, rests, counts, places, n_bytes, words, ns), one row a slice: its documents, crc32 of their ids, their words as
    places in the list of its distinct words, and how often each of these occurs in training documents."""
    id_type = rows.schema["doc_id"].dataType
    arrow_id = to_arrow_type(id_type)

    def run(batches):
        for part in text_slices(batches, SLICE):
            words, every, counts = words_of(part)
            rests = part.column("rest").to_numpy()
            often = np.bincount(every, minlength=len(words))
            # frequent words get small numbers, which pack well
            order = np.argsort(-often, kind="stable")[: np.count_nonzero(often)]
            rank = np.zeros(len(words), np.uint32)
            rank[order] = np.arange(len(order), dtype=np.uint32)
            n = np.bincount(every[np.repeat(rests % 10 != 0, counts)], minlength=len(words))[order]
            data = b"\n".join(words.take(pa.array(order)).to_pylist())  # no word holds a line end
            ids = part.column("doc_id").to_pylist()
            columns = ([uuid.uuid4().hex], [ids], [rests], [counts], [packed(rank[every])], [len(data)], [zstandard.compress(data, 3)], [packed(n)])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)

    names = ["slice", "doc_ids", "rests", "counts", "places", "n_bytes", "words", "ns"]
    kinds = [pa.string(), pa.list_(arrow_id), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.int64(), pa.binary(), pa.binary()]
    return rows.mapInArrow(without_collection(run), f"slice string, doc_ids array<{id_type.simpleString()}>, rests array<long>, counts array<long>, places binary, n_bytes long, words binary, ns binary")


def words_in(data: bytes) -> list[bytes]:
    """The distinct words of a slice."""
    data = zstandard.decompress(data)
    return data.split(b"\n") if data else []


def by_part(words: list[bytes], parts: int) -> list[tuple[int, np.ndarray]]:
    """(part, places of the words that fall to it), for parts that have some."""
    part = np.fromiter(map(zlib.crc32, words), np.uint32, len(words)) % parts
    order = np.argsort(part, kind="stable")
    edges = np.flatnonzero(np.diff(part[order].astype(np.int64), prepend=-1))
    return [(int(part[own[0]]), own) for own in np.split(order, edges[1:]) if len(own)]


def asked(slices: DataFrame, parts: int) -> DataFrame:
    """(part, slice, words, ns): what each slice sends to each part."""

    def run(batches):
        for batch in batches:
            for key, data, ns in zip(*(batch.column(c).to_pylist() for c in ("slice", "words", "ns"))):
                words, n = words_in(data), unpacked(ns)
                rows = [(part, key, b"\n".join([words[i] for i in own.tolist()]), packed(n[own])) for part, own in by_part(words, parts)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.string(), pa.binary(), pa.binary()))], ["part", "slice", "words", "ns"])

    return slices.select("slice", "words", "ns").mapInArrow(run, "part int, slice string, words binary, ns binary")


def counted(rows: DataFrame) -> DataFrame:
    """From what slices ask, (slice, part, cs), the counts of their words in all training documents; and a row a part without
    slice: types, their number, bins, sums of counts by bit length, and top_words and top_cs, the most frequent ones."""

    def count(table: pa.Table) -> pa.Table:
        lists = pc.split_pattern(table.column("words").combine_chunks().cast(pa.large_binary()), "\n")
        found = lists.flatten().dictionary_encode()
        every, n = found.indices.to_numpy(), np.concatenate([unpacked(x) for x in table.column("ns").to_pylist()]).astype(np.int64)
        order = np.argsort(every, kind="stable")
        c = np.add.reduceat(n[order], np.flatnonzero(np.diff(every[order], prepend=-1)))
        per = np.split(c[every], np.cumsum(pc.list_value_length(lists).to_numpy())[:-1])
        least = max(1, np.partition(c, -HEAD)[-HEAD]) if len(c) > HEAD else 1
        often = np.flatnonzero(c >= least)
        top = sorted(zip((-c[often]).tolist(), found.dictionary.take(pa.array(often)).to_pylist()))[:HEAD]
        bins = np.zeros(64, np.int64)
        np.add.at(bins, bins_of(c), c)
        part = table.column("part")[0].as_py()
        out = [(key, part, zstandard.compress(x.tobytes(), 1), None, None, None, None) for key, x in zip(table.column("slice").to_pylist(), per)]
        out.append((None, part, None, int(np.count_nonzero(c)), bins.tolist(), [w for _, w in top], [-x for x, _ in top]))
        return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds)], names=names)

    names = ["slice", "part", "cs", "types", "bins", "top_words", "top_cs"]
    kinds = [pa.string(), pa.int32(), pa.binary(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.binary()), pa.list_(pa.int64())]
    return rows.groupBy("part").applyInArrow(count, "slice string, part int, cs binary, types long, bins array<long>, top_words array<binary>, top_cs array<long>")


def bins_of(c: np.ndarray) -> np.ndarray:
    """0 for counts of 0, else the bit length."""
    return np.where(c > 0, np.frexp(c.astype(float))[1], 0)


def coded(slices: DataFrame, answered: DataFrame, parts: int, totals: dict, head) -> DataFrame:
    """One row per document: doc_id, rest, n_tokens, n_known, base_score, tail (log10 of words within bins), codes and,
    for training documents, the codes to train on."""
    id_type = slices.schema["doc_ids"].dataType.elementType
    arrow_id = to_arrow_type(id_type)
    log_of = np.log10

    def join(asked: pa.Table, answer: pa.Table) -> pa.Table:
        words = [w for data in asked.column("words").to_pylist() for w in words_in(data)]  # of one slice
        c, got = np.zeros(len(words), np.int64), dict(zip(answer.column("part").to_pylist(), answer.column("cs").to_pylist()))
        for part, own in by_part(words, parts):
            c[own] = np.frombuffer(zstandard.decompress(got[part]), np.int64)
        table = head.value
        code = np.fromiter((table.get(w, -1) for w in words), np.int32, len(words))
        pack = zstandard.ZstdCompressor(1).compress
        bins, low = bins_of(c), bins_of(c - 1)
        whole = totals["tokens"] + 0.1 * (totals["types"] + 1)
        base = log_of((c + 0.1) / whole)
        tail = np.where((code < 0) & (c > 0), log_of(np.maximum(c, 1) / np.array(totals["bins"], float)[bins]), 0.0)
        to_score, to_train = np.where(code < 0, HEAD + bins, code).astype(np.uint16), np.where(code < 0, HEAD + low, code).astype(np.uint16)
        end = np.uint16(HEAD + BINS - 1)
        out: list[list] = [[] for _ in range(8)]
        for ids, rests, counts, data in zip(*(asked.column(x).to_pylist() for x in ("doc_ids", "rests", "counts", "places"))):
            words, upto = unpacked(data), 0
            for doc_id, rest, n in zip(ids, rests, counts):
                own = words[upto : upto + n]
                upto += n
                out[0].append(doc_id)
                out[1].append(rest)
                out[2].append(n + 1)
                out[3].append(int((c[own] > 0).sum()) + (totals["docs"] > 0))
                out[4].append(float(base[own].sum() + log_of((totals["docs"] + 0.1) / whole)))
                out[5].append(float(tail[own].sum()))
                out[6].append(pack(np.append(to_score[own], end).tobytes()))
                out[7].append(pack(np.append(to_train[own], end).tobytes()) if rest % 10 else None)
        kinds = (arrow_id, pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.binary())
        return pa.Table.from_arrays([pa.array(x, k) for x, k in zip(out, kinds)], names=["doc_id", "rest", "n_tokens", "n_known", "base_score", "tail", "codes", "train"])

    schema = f"doc_id {id_type.simpleString()}, rest long, n_tokens long, n_known long, base_score double, tail double, codes binary, train binary"
    asked = slices.select("slice", "doc_ids", "rests", "counts", "places", "words")
    return asked.groupBy("slice").cogroup(answered.groupBy("slice")).applyInArrow(join, schema)


def loaded(column: pa.Array) -> list[np.ndarray]:
    """Codes of documents from their packed form."""
    unpack = zstandard.ZstdDecompressor().decompress
    return [np.frombuffer(unpack(b), np.uint16).astype(np.int32) for b in column.to_pylist()]


def dealt(rows: DataFrame, group_tokens: int, rounds: int) -> DataFrame:
    """(part, round, key, train) of the rows to train on, by a hash of id and words: copies of a text do not lie together."""
    sample = rows.filter("train is not null").select("doc_id", "n_tokens", "train")
    total = sample.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).head()[0]
    groups = max(1, -(-total // group_tokens))
    return sample.withColumn("key", F.xxhash64("doc_id", "train")).select(F.pmod("key", F.lit(groups)).alias("part"), F.pmod(F.col("key").bitwiseXOR(F.shiftright("key", 32)), F.lit(rounds)).alias("round"), "key", "train")


def trained(rows: DataFrame, group_tokens: int, rounds: int) -> dict[str, np.ndarray]:
    """Weights after `rounds` rounds of training in groups of about group_tokens, averaged after each."""
    spark = rows.sparkSession
    shapes = gru.sizes(HEAD, BINS, PER_CLASS, HIDDEN)
    weights = gru.flat(gru.initial(shapes))
    sample = dealt(rows, group_tokens, rounds)
    for i in range(rounds):
        before = spark.sparkContext.broadcast(weights)

        def train(table: pa.Table) -> pa.Table:
            table = table.sort_by("key")
            model = gru.Model(gru.unflat(before.value, shapes))
            model.train(loaded(table.column("train")))
            values = gru.flat(model.w)
            return pa.table({"i": np.arange(len(values), dtype=np.int32), "value": values.astype(np.float64)})

        after = sample.filter(F.col("round") == i).groupBy("part").applyInArrow(train, "i int, value double")
        # as many rows as the model has weights
        mean = after.groupBy("i").agg(F.avg("value").alias("value")).toPandas().sort_values("i")
        if len(mean):
            weights = mean["value"].to_numpy()
    return gru.unflat(weights, shapes)


def score_documents(docs: DataFrame, group_tokens: int = 4_000_000, rounds: int = 4) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10).

    Documents whose crc32(doc_id as text) mod 10 is not 0 are learnt from, each for counts and weights. Texts are read
    once, so that their order does not matter. A null or empty text is the end token alone; a null doc_id is held out; repeated rows stay repeated
    and count as often; an empty table gives an empty table; columns other than doc_id and text are not read.
    """
    spark, sc = docs.sparkSession, docs.sparkSession.sparkContext
    rows = texts(docs).withColumn("rest", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(0)))
    slices = written(spark, sliced(rows), "slices")
    n_bytes, n_docs = slices.agg(F.coalesce(F.sum("n_bytes"), F.lit(0)), F.coalesce(F.sum(F.size(F.filter("rests", lambda r: r % 10 != 0))), F.lit(0))).head()
    parts = max(1, -(-n_bytes // PART))
    answered = written(spark, counted(asked(slices, parts)), "counts")
    of_parts = answered.filter("slice is null")
    n_types = of_parts.agg(F.coalesce(F.sum("types"), F.lit(0))).head()[0]
    found = of_parts.select(F.explode(F.arrays_zip("top_words", "top_cs")).alias("e")).select(F.col("e.top_words").alias("word"), F.col("e.top_cs").alias("c"))
    top = found.orderBy(F.desc("c"), "word").limit(HEAD).collect()  # as many rows as the model has codes
    bins = dict.fromkeys(range(BINS + 24), 0)
    bins |= {r[0]: r[1] for r in of_parts.select(F.posexplode("bins")).groupBy("pos").agg(F.sum("col")).collect()}  # one row per bit length
    n_words = sum(bins.values())
    for r in top:
        bins[r["c"].bit_length()] -= r["c"]
    totals = {"tokens": n_words + n_docs, "types": n_types + (n_docs > 0), "docs": n_docs, "bins": [max(1, bins[i]) for i in range(BINS + 24)]}
    head = sc.broadcast({bytes(r["word"]): i for i, r in enumerate(top)})
    rows_coded = written(spark, coded(slices, answered.filter("slice is not null").select("slice", "part", "cs"), parts, totals, head), "coded")
    model = sc.broadcast(trained(rows_coded, group_tokens, rounds))

    def run(batches):
        net = gru.Model(model.value)
        for batch in batches:
            sizes, at = batch.column("n_tokens").to_pylist(), 0
            while at < len(sizes):
                upto, n = at, 0
                while upto < len(sizes) and (upto == at or n + sizes[upto] <= 4_000_000):
                    n += sizes[upto]
                    upto += 1
                part = batch.slice(at, upto - at)
                logs = net.score(loaded(part.column("codes")))
                score = logs / np.log(10) + part.column("tail").to_numpy()
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(score)], [*keep, "score"])
                at = upto

    keep = ["doc_id", "rest", "n_tokens", "n_known", "base_score"]
    kind = rows_coded.schema["doc_id"].dataType.simpleString()
    scored = rows_coded.select(*keep, "tail", "codes").mapInArrow(run, f"doc_id {kind}, rest long, n_tokens long, n_known long, base_score double, score double")
    return scored.select("doc_id", (F.col("rest") % 10 == 0).alias("held_out"), "n_tokens", "n_known", F.lit(totals["tokens"]).cast("long").alias("train_tokens"), "base_score", "score")


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents; see score_documents for the cases."""
    return score_documents(read(spark, sf_dir, "documents"))
