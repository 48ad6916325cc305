"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

The classifier is fitted on a bounded sample of labelled rows (about `max_labelled`, by a hash of their ids). Every word of
a sampled text is a term and every sampled text with a word an example. A term's weight is its IDF times its relevance:
the evidence, over the sample, that its share of toxic texts is not that of all, cut to [floor, 1]. Relevance scales a
term in examples and queries alike, so that words that say nothing about the label don't drown those that do; no term is
left out. All documents are then scored where they lie.

The index has, for each term, the example weights by block of neighbouring examples and the greatest of each block. A
query's bound for a block is the sum of its weights times these maxima; blocks are opened by falling bound until it is
below the k-th best cosine found, so the k nearest are exact and blocks that can't hold one of them stay closed.

The vote is the similarity-weighted share of toxic examples among the nearest, drawn a little towards the sample's share.
Votes are calibrated on the sample itself, each text without its own example: a rising step curve through the share of
toxic texts by vote, straight between its points.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import ALNUM_TABLE, read, text_slices, texts, written

Terms = tuple[dict[bytes, int], np.ndarray]  # numbers of words and their weights


def vector(data: bytes, terms: Terms) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and weights of a text's terms: (1 + ln tf) * weight, of length one; empty without terms."""
    tf = Counter(map(terms[0].get, data.translate(ALNUM_TABLE).split()))
    tf.pop(None, None)
    at, n = np.fromiter(tf.keys(), np.int64, len(tf)), np.fromiter(tf.values(), float, len(tf))
    order = np.argsort(at)
    at, x = at[order], (1 + np.log(n[order])) * terms[1][at[order]]
    return at, x / math.sqrt(float(x @ x)) if len(x) else x


class Index:
    """Examples (id, label, terms, weights) in blocks; postings by term and block and their greatest weight."""

    def __init__(self, examples: list[tuple], n_terms: int, block: int = 256):
        # examples with the same heaviest term lie together, which makes the bounds of blocks tight
        examples = sorted((e for e in examples if len(e[2])), key=lambda e: (int(e[2][np.argmax(e[3])]), str(e[0])))
        self.ids = [e[0] for e in examples]
        self.labels = np.array([e[1] for e in examples], float)
        # equal cosines are taken by id; None and ids of any kind have an order by text
        self.rank = np.argsort(np.array(sorted(range(len(examples)), key=lambda i: (self.ids[i] is None, self.ids[i]))))
        self.places: dict = {}
        for i, own in enumerate(self.ids):
            self.places.setdefault(own, []).append(i)
        self.block, self.blocks = block, -(-len(examples) // block)
        sizes = [len(e[2]) for e in examples]
        term = np.concatenate([e[2] for e in examples]) if examples else np.zeros(0, np.int64)
        weight = np.concatenate([e[3] for e in examples]) if examples else np.zeros(0)
        row = np.repeat(np.arange(len(examples)), sizes)
        cell = term * self.blocks + row // block
        order = np.argsort(cell, kind="stable")
        self.row, self.weight = row[order].astype(np.intp), weight[order]
        self.ends = np.cumsum(np.bincount(cell, minlength=n_terms * self.blocks))
        self.most = np.zeros(n_terms * self.blocks)
        np.maximum.at(self.most, cell, weight)
        self.most = self.most.reshape(n_terms, self.blocks)

    def cosines(self, terms: np.ndarray, weights: np.ndarray, blocks: np.ndarray) -> np.ndarray:
        """Cosines with all examples, of which those of other blocks are zero."""
        cells = (terms[:, None] * self.blocks + blocks).ravel()
        ends = self.ends[cells]
        starts = np.where(cells > 0, self.ends[cells - 1], 0)
        sizes = ends - starts
        held = sizes > 0
        ends, sizes = ends[held], sizes[held]
        at = np.repeat(ends - np.cumsum(sizes), sizes)
        at += np.arange(len(at))
        products = np.repeat(np.repeat(weights, len(blocks))[held], sizes)
        products *= self.weight[at]
        return np.bincount(self.row[at], products, len(self.ids))

    def nearest(self, query: tuple[np.ndarray, np.ndarray], k: int, without=None) -> tuple[np.ndarray, np.ndarray]:
        """Cosines and places of the k examples of the greatest positive cosine, ties by id; none of id `without`."""
        terms, weights = query
        sims, places = np.zeros(0), np.zeros(0, np.int64)
        if not len(terms) or not self.ids:
            return sims, places
        bound = weights @ self.most[terms]
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        own = self.places.get(without, []) if without is not None else []
        done, step = 0, 1
        while done < len(order):
            opened = order[done : done + step]
            if len(sims) == k:  # bounds are sums in another order
                opened = opened[bound[opened] >= sims[-1] - 1e-9]
                if not len(opened):
                    break
            found = np.round(self.cosines(terms, weights, opened), 12)  # so that equal cosines are ties in any order of sums
            found[own] = 0
            at = np.flatnonzero(found > 0)
            if len(at) > k:
                at = at[found[at] >= np.partition(found[at], -k)[-k]]
            sims, places = np.append(sims, found[at]), np.append(places, at)
            best = np.lexsort((self.rank[places], -sims))[:k]
            sims, places = sims[best], places[best]
            done, step = done + step, 4 * step
        return sims, places


def labelled_sample(labels: DataFrame, label_col: str, max_labelled: int) -> DataFrame:
    """(doc_id, label) of about max_labelled labelled ids at most that may be learnt from; small enough to broadcast."""
    rows = labels.filter(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2))
    rows = rows.groupBy("doc_id").agg(F.max(F.col(label_col).cast("int")).alias("label"))
    n = rows.count()
    if n > max_labelled:
        rows = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * max_labelled / n))
    return rows


def evidence(n: np.ndarray, toxic: np.ndarray, base: float) -> np.ndarray:
    """n * KL(share of toxic || base): how far a word's share is from that of all, given in how many texts it is."""
    part = lambda x, share: x * np.log(np.maximum(x, 1e-300) / (n * share))
    return part(toxic, base) + part(n - toxic, 1 - base)


def term_table(sampled: DataFrame, floor: float, full: float) -> tuple[Terms, float]:
    """Every word of the sample with its number and weight, and the share of toxic texts (a half counted to each side)."""

    def count(batches):
        for part in text_slices(batches):
            rows, toxic = Counter(), Counter()
            for text, label in zip(part.column("text"), part.column("label").to_pylist()):
                words = set(text.as_buffer().to_pybytes().translate(ALNUM_TABLE).split())
                rows.update(words)
                if label:
                    toxic.update(words)
            yield pa.RecordBatch.from_arrays([pa.array(list(rows), pa.binary()), pa.array(list(rows.values()), pa.int64()), pa.array([toxic[w] for w in rows], pa.int64())], ["word", "n", "n1"])

    total, positive = sampled.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).head()
    base = (positive + 0.5) / (total + 1)
    words = sampled.select("text", "label").mapInArrow(count, "word binary, n long, n1 long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("n1").alias("n1"))
    table = words.orderBy("word").toArrow()  # the words of at most about max_labelled texts
    n, toxic = (table.column(c).to_numpy().astype(float) for c in ("n", "n1"))
    weights = (np.log((1 + total) / (1 + n)) + 1) * np.clip(evidence(n, toxic, base) / full, floor, 1)
    return ({w: i for i, w in enumerate(table.column("word").to_pylist())}, weights), base


def rising(x: np.ndarray, n: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points (x, share) of a non-falling curve through groups of n texts of which y are toxic: falling neighbours merge."""
    pools: list[list[float]] = []
    for a, b, c in zip(x.tolist(), n.tolist(), y.tolist()):
        pools.append([a * b, b, c])
        while len(pools) > 1 and pools[-1][2] * pools[-2][1] <= pools[-2][2] * pools[-1][1]:
            last = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], last)]
    return np.array([p[0] / p[1] for p in pools]), np.array([p[2] / p[1] for p in pools])


_own: dict[str, Index] = {}  # of a worker, by call


def score_toxicity(
    docs: DataFrame, labels: DataFrame, label_col: str = "toxic", k: int = 15, pull: float = 0.1,
    max_labelled: int = 4_000, floor: float = 0.02, full: float = 20.0,
) -> DataFrame:
    """One row per document: doc_id, held_out, score, evidence (doc_id, similarity, label of the nearest examples).

    max_labelled is the only bound: on labelled rows to fit. floor and full are the least relevance of a term and the
    evidence from which it is 1. Rows whose crc32(doc_id as text) mod 4 is 2 are never learnt from, nor is a document
    its own evidence. Null and empty texts and those without a word of the sample have the calibrated score of the
    sample's share; null labels are left out, of several labels or texts of a doc_id the greatest label and the
    smallest text count; a null doc_id is scored and not held out; repeated rows stay repeated; without labels every
    score is 0.5; an empty table gives an empty table; columns other than doc_id, text and the label are not read.
    """
    spark, sc = docs.sparkSession, docs.sparkSession.sparkContext
    rows = texts(docs)
    kind = rows.schema["doc_id"].dataType.simpleString()
    arrow_id = to_arrow_type(rows.schema["doc_id"].dataType)
    # max_labelled bounds its size
    sampled = rows.join(F.broadcast(labelled_sample(labels, label_col, max_labelled)), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label"))
    sampled = written(spark, sampled, "labelled")
    table, prior = term_table(sampled, floor, full)
    terms, key = sc.broadcast(table), uuid.uuid4().hex

    def vectors(batches):
        for part in text_slices(batches):
            found = [vector(t.as_buffer().to_pybytes(), terms.value) for t in part.column("text")]
            columns = [pa.array([x.tobytes() for x in side], pa.binary()) for side in zip(*found)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("label"), *columns], ["doc_id", "label", "terms", "weights"])

    # about max_labelled rows at most
    held = sampled.mapInArrow(vectors, f"doc_id {kind}, label int, terms binary, weights binary").toArrow().to_pylist()
    examples = sc.broadcast([tuple(r.values()) for r in held])

    def votes(index: Index, part: pa.RecordBatch) -> tuple[np.ndarray, list]:
        near = [index.nearest(vector(t.as_buffer().to_pybytes(), terms.value), k, i) for i, t in zip(part.column("doc_id").to_pylist(), part.column("text"))]
        return np.array([(float(s @ index.labels[at]) + pull * prior) / (float(s.sum()) + pull) for s, at in near]), near

    def index() -> Index:
        if key not in _own:
            _own.clear()
            _own[key] = Index([(i, y, np.frombuffer(t, np.int64), np.frombuffer(x)) for i, y, t, x in examples.value], len(terms.value[1]))
        return _own[key]

    def own_votes(batches):
        for part in text_slices(batches):
            vote, _ = votes(index(), part)
            yield pa.RecordBatch.from_arrays([pa.array(np.round(vote * 64) / 64), part.column("label")], ["vote", "label"])

    # one row for each of 65 votes
    curve = sampled.mapInArrow(own_votes, "vote double, label int").groupBy("vote").agg(F.count("*").alias("n"), F.sum("label").alias("y")).orderBy("vote").toPandas()
    at, share = rising(*(curve[c].to_numpy(float) for c in ("vote", "n", "y"))) if len(curve) else (np.zeros(1), np.full(1, prior))

    def score(batches):
        own = index()
        for part in text_slices(batches):
            vote, near = votes(own, part)
            ends = np.cumsum([0, *(len(s) for s, _ in near)])
            sims, places = (np.concatenate([n[i] for n in near]) for i in (0, 1))
            places = places.astype(np.int64)
            struct = pa.StructArray.from_arrays([pa.array([own.ids[i] for i in places.tolist()], arrow_id), pa.array(sims, pa.float64()), pa.array(own.labels[places].astype(np.int32))], ["doc_id", "similarity", "label"])
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.interp(vote, at, share)), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), struct)], ["doc_id", "score", "evidence"])

    out = rows.mapInArrow(score, f"doc_id {kind}, score double, evidence array<struct<doc_id:{kind},similarity:double,label:int>>")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    return out.select("doc_id", held_out.alias("held_out"), "score", "evidence")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by the labels' toxic column; see score_toxicity for the cases."""
    out = score_toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
