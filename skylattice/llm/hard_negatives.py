"""Hard negatives by Four-Russians scoring.

Vectors are integers. Of each eight dimensions, an anchor has a table with the sum of every subset of its eight values: 256
entries, each made by one addition. Candidates lie as bit planes, eight dimensions a byte; a byte is the subset of dimensions
whose bit is set, so one lookup adds eight products' worth of that bit. The sums of a plane's lookups are shifted by the
plane's weight and added, from the sign plane down, which gives the whole inner product, exactly.

Candidates are packed into chunks of some thousand rows, anchors into blocks of some hundred; a unit of work is a chunk
and a block, so every anchor meets every row without a row for any pair. A first pass keeps each anchor's best rows
of its label, which are its positives; a second one keeps, for each positive, the best rows of other labels within the
band that the positive's score sets. Units return no more than that; Spark takes the first ones of all units.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read, written

NO_ID = np.iinfo(np.int64).max  # stands for a null vec_id, which comes last


def whole_vectors(rows: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, label, q (array of longs): rows whose label and components are all there, finite, and fit a long when scaled."""
    x = lambda e: F.floor(F.lit(float(scale)) * e.cast("double"))
    fits = F.forall("embedding", lambda e: F.coalesce(F.abs(F.lit(float(scale)) * e.cast("double")) < F.lit(2.0**63), F.lit(False)))
    q = F.when(F.col("label").isNotNull() & F.col("embedding").isNotNull() & fits, F.transform("embedding", lambda e: x(e).cast("long")))
    return rows.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), q.alias("q")).filter("q is not null")


def planes_of(values: np.ndarray, bits: int) -> np.ndarray:
    """(bits, groups, rows) bytes: bit d of byte g is the plane's bit of dimension 8 g + d; two's complement."""
    planes = [np.packbits((values >> b & 1).astype(np.uint8), axis=1, bitorder="little").T for b in range(bits)]
    return np.ascontiguousarray(planes)


def values_of(planes: np.ndarray, dims: int) -> np.ndarray:
    """The rows that planes_of has packed."""
    total = np.zeros((planes.shape[2], dims), np.int64)
    for b in range(len(planes)):
        bit = np.unpackbits(planes[b].T, axis=1, bitorder="little")[:, :dims].astype(np.int64) << b
        total += -bit if b == len(planes) - 1 else bit
    return total


def subset_sums(anchors: np.ndarray) -> np.ndarray:
    """(groups, 256, anchors): for each eight dimensions the sums of all subsets, each by one addition to a smaller one."""
    n, dims = anchors.shape
    groups = -(-dims // 8)
    each = np.zeros((groups, 8, n), anchors.dtype)
    each.reshape(groups * 8, n)[:dims] = anchors.T
    sums = np.zeros((groups, 256, n), anchors.dtype)
    for d in range(8):
        np.add(sums[:, : 1 << d], each[:, d : d + 1], out=sums[:, 1 << d : 2 << d])
    return sums


def scores(planes: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """(rows, anchors) inner products: lookups of a plane are added, planes are shifted and added from the sign plane down."""
    bits, groups, rows = planes.shape
    total = np.zeros((rows, sums.shape[2]), sums.dtype)
    found = np.empty_like(total)
    for b in range(bits - 1, -1, -1):
        total <<= 1
        for g in range(groups):
            np.take(sums[g], planes[b, g], axis=0, out=found)
            if b == bits - 1:
                total -= found
            else:
                total += found
    return total


def chunks_of(vectors: DataFrame, dims: int, bits: int, rows: int) -> DataFrame:
    """(chunk, ids, labels, planes), one row for up to `rows` vectors, which lie by vec_id."""

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                part = batch.slice(start, rows)
                ids = part.column("vec_id").fill_null(NO_ID).to_numpy()
                order = np.argsort(ids, kind="stable")
                q = part.column("q")
                sizes = np.diff(q.offsets.to_numpy())
                values = np.zeros((part.num_rows, dims), np.int64)
                values[np.arange(dims) < sizes[:, None]] = q.flatten().to_numpy()
                labels = part.column("label").to_numpy()
                columns = ([uuid.uuid4().hex], [ids[order].tobytes()], [labels[order].astype(np.int64).tobytes()], [planes_of(values[order], bits).tobytes()])
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.binary(), pa.binary(), pa.binary()))], ["chunk", "ids", "labels", "planes"])

    return vectors.mapInArrow(run, "chunk string, ids binary, labels binary, planes binary")


def chunk_arrays(ids: bytes, labels: bytes, planes: bytes, dims: int, bits: int):
    i = np.frombuffer(ids, np.int64)
    return i, np.frombuffer(labels, np.int64), np.frombuffer(planes, np.uint8).reshape(bits, -(-dims // 8), len(i))


def blocks_of(chunks: DataFrame, every: int, dims: int, bits: int, size: int) -> DataFrame:
    """(block, of_chunk, of_place, a_ids, a_labels, a_values) of the anchors, rows whose vec_id is divisible by `every`, up to `size` a row."""

    def anchors(batches):
        for batch in batches:
            for chunk, *packed in zip(*(batch.column(c).to_pylist() for c in ("chunk", "ids", "labels", "planes"))):
                ids, labels, planes = chunk_arrays(*packed, dims, bits)
                at = np.flatnonzero((ids % every == 0) & (ids != NO_ID))
                if len(at):
                    values = values_of(planes[:, :, at], dims)
                    columns = [pa.array([chunk] * len(at)), pa.array(at), pa.array(ids[at]), pa.array(labels[at]), pa.array([v.tobytes() for v in values], pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, ["chunk", "place", "id", "label", "value"])

    rows = written(chunks.sparkSession, chunks.mapInArrow(anchors, "chunk string, place long, id long, label long, value binary"), "anchors")

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, size):
                part = batch.slice(start, size)
                flat = [part.column(c).to_numpy().astype(np.int64).tobytes() for c in ("place", "id", "label")]
                columns = ([uuid.uuid4().hex], [part.column("chunk").to_pylist()], *[[x] for x in flat], [b"".join(part.column("value").to_pylist())])
                kinds = (pa.string(), pa.list_(pa.string()), pa.binary(), pa.binary(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["block", "of_chunk", "of_place", "a_ids", "a_labels", "a_values"])

    dealt = rows.repartition(max(1, -(-rows.count() // size)))
    return dealt.mapInArrow(run, "block string, of_chunk array<string>, of_place binary, a_ids binary, a_labels binary, a_values binary")


def best(rows: DataFrame, n: int, by: list[str], score: str, name: str, rank: str) -> DataFrame:
    """The first n rows of each group by score, ties by the smaller id; Spark keeps no more than n before it shuffles."""
    order = Window.partitionBy(*by).orderBy(F.desc(score), F.asc(name))
    return rows.withColumn(rank, F.row_number().over(order)).filter(F.col(rank) <= n)


def nearest_of_label(units: DataFrame, dims: int, bits: int, dtype, n: int) -> DataFrame:
    """(block, a, anchor_id, positive_id, positive_score): of each unit the n best rows of each anchor's label, itself left out."""

    def run(batches):
        for batch in batches:
            for u in batch.to_pylist():
                ids, labels, planes = chunk_arrays(u["ids"], u["labels"], u["planes"], dims, bits)
                a_ids, a_labels, places = (np.frombuffer(u[c], np.int64) for c in ("a_ids", "a_labels", "of_place"))
                values = np.frombuffer(u["a_values"], np.int64).reshape(len(a_ids), dims)
                own = np.where(np.array(u["of_chunk"]) == u["chunk"], places, -1)
                found = []
                # anchors of one label meet the rows of that label only
                for label in np.intersect1d(a_labels, labels):
                    rows, cols = np.flatnonzero(labels == label), np.flatnonzero(a_labels == label)
                    s = scores(planes[:, :, rows], subset_sums(values[cols].astype(dtype)))
                    top = np.argsort(-s, axis=0, kind="stable")[: n + 1]
                    a = np.broadcast_to(cols, top.shape)
                    keep = rows[top] != own[a]
                    found.append((a[keep], rows[top][keep], np.take_along_axis(s, top, 0)[keep]))
                if found:
                    a, r, s = (np.concatenate(x) for x in zip(*found))
                    yield pa.RecordBatch.from_arrays([pa.array([u["block"]] * len(a)), pa.array(a), pa.array(a_ids[a]), pa.array(ids[r]), pa.array(s.astype(np.int64))], ["block", "a", "anchor_id", "positive_id", "positive_score"])

    return units.mapInArrow(run, "block string, a long, anchor_id long, positive_id long, positive_score long")


def within_bands(units: DataFrame, dims: int, bits: int, dtype, n: int, low: int, high: int) -> DataFrame:
    """(block, a, p, anchor_id, positive_id, positive_score, negative_id, negative_score): of each unit, for each anchor and
    positive, the n best rows of other labels with low * positive_score <= 100 * score <= high * positive_score."""
    names = ["a", "p", "positive_id", "positive_score"]

    def run(batches):
        for batch in batches:
            for u in batch.to_pylist():
                ids, labels, planes = chunk_arrays(u["ids"], u["labels"], u["planes"], dims, bits)
                a_ids, a_labels = (np.frombuffer(u[c], np.int64) for c in ("a_ids", "a_labels"))
                values = np.frombuffer(u["a_values"], np.int64).reshape(len(a_ids), dims)
                found = []
                # by runs of anchors, so that scores stay few
                wanted: dict[int, list] = {}
                for x in u["wanted"]:
                    wanted.setdefault(x["a"], []).append(x)
                for start in range(0, len(a_ids), 128):
                    s = scores(planes, subset_sums(values[start : start + 128].astype(dtype)))
                    for a in range(start, min(start + 128, len(a_ids))):
                        if a not in wanted:
                            continue
                        rows = np.flatnonzero(labels != a_labels[a])
                        falling = -s[rows, a - start].astype(np.int64)
                        # only what is within some band is sorted
                        bands = [(-(-low * x["positive_score"] // 100), high * x["positive_score"] // 100) for x in wanted[a]]
                        some = np.flatnonzero((falling <= -min(b for b, _ in bands)) & (falling >= -max(b for _, b in bands)))
                        some = some[np.argsort(falling[some], kind="stable")]
                        rows, falling = rows[some], falling[some]
                        for x, (least, most) in zip(wanted[a], bands):
                            first, end = np.searchsorted(falling, [-most, -least + 1])
                            end = min(end, first + n)
                            if first < end:
                                found.append((x, rows[first:end], -falling[first:end]))
                if found:
                    sizes = [len(r) for _, r, _ in found]
                    told = {c: np.repeat([x[c] for x, _, _ in found], sizes) for c in names}
                    r, s = (np.concatenate([f[i] for f in found]) for i in (1, 2))
                    columns = [pa.array([u["block"]] * len(r)), pa.array(told["a"]), pa.array(told["p"]), pa.array(a_ids[told["a"]]), pa.array(told["positive_id"]), pa.array(told["positive_score"]), pa.array(ids[r]), pa.array(s)]
                    yield pa.RecordBatch.from_arrays(columns, ["block", "a", "p", "anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"])

    return units.mapInArrow(run, "block string, a long, p long, anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")


def hard_negatives(vectors: DataFrame, every: int = 100, positives: int = 5, negatives: int = 10, band: tuple[int, int] = (30, 90), chunk: int = 4096, block: int = 256) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score, from vec_id, label and q of whole_vectors.

    Anchors are rows whose vec_id is divisible by `every`; a positive score below one has no band. Repeated rows are rows
    of their own: as anchors each has its results, and a copy of an anchor is a positive of it. A null vec_id is never
    an anchor and comes last among ties. Missing dimensions of shorter vectors are zero; scores are exact if they
    fit a long. An empty table gives an empty table; other columns are not read.
    """
    spark = vectors.sparkSession
    vectors = vectors.select("vec_id", "label", "q")
    size = F.coalesce(F.array_max(F.transform("q", lambda e: F.when(e < 0, -(e + 1)).otherwise(e))), F.lit(0))
    dims, most = vectors.agg(F.max(F.size("q")), F.max(size)).first()
    dims, most = max(dims or 0, 1), most or 0
    bits = int(most).bit_length() + 1
    dtype = np.int32 if dims * (most + 1) << bits < 1 << 31 else np.int64
    chunks = written(spark, chunks_of(vectors, dims, bits, chunk), "chunks")
    blocks = written(spark, blocks_of(chunks, every, dims, bits, block), "blocks")
    # every chunk meets every block: the stated query set against all rows, in blocks
    near = nearest_of_label(chunks.crossJoin(blocks), dims, bits, dtype, positives)
    near = written(spark, best(near, positives, ["block", "a"], "positive_score", "positive_id", "p"), "positives")
    wanted = near.groupBy("block").agg(F.collect_list(F.struct("a", F.col("p").cast("long").alias("p"), "positive_id", "positive_score")).alias("wanted"))
    found = within_bands(chunks.crossJoin(blocks.join(wanted, "block")), dims, bits, dtype, negatives, *band)
    ranked = best(found, negatives, ["block", "a", "p"], "negative_score", "negative_id", "rank")
    known = lambda c: F.nullif(F.col(c), F.lit(int(NO_ID)))
    return ranked.select("anchor_id", known("positive_id").alias("positive_id"), F.col("rank").cast("int").alias("rank"), known("negative_id").alias("negative_id"), "positive_score", "negative_score")


def relabelled(rows: DataFrame) -> DataFrame:
    label: Column = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return rows.select("vec_id", label.alias("label"), "embedding")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of all embeddings; see hard_negatives for the cases."""
    return hard_negatives(whole_vectors(relabelled(read(spark, sf_dir, "embeddings"))))


OP11_SQL = """
with v as (
  select row_number() over () r, vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end label,
    list_transform(embedding, lambda x: floor(256 * cast(x as double))) q
  from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: isfinite(x))) = len(embedding)),
s as (
  select a.r a, a.vec_id anchor_id, v.vec_id, v.label = a.label alike, cast(list_dot_product(a.q, v.q) as bigint) score
  from v a join v on a.r <> v.r where a.vec_id % 100 = 0),
p as (
  select a, anchor_id, vec_id positive_id, score positive_score, row_number() over (partition by a order by score desc, vec_id) p
  from s where alike qualify p <= 5),
n as (
  select p.*, s.vec_id negative_id, s.score negative_score, row_number() over (partition by p.a, p.p order by s.score desc, s.vec_id) rank
  from p join s on p.a = s.a and not s.alike and 30 * positive_score <= 100 * s.score and 100 * s.score <= 90 * positive_score
  qualify rank <= 10)
select anchor_id, positive_id, cast(rank as integer) rank, negative_id, positive_score, negative_score from n
"""
