"""SimHash near-duplicates with bit-sliced comparison.

Fingerprints are made where the texts lie; equal ones meet before anything is compared. Distinct fingerprints are
dealt to buckets: of four blocks of bits, two fingerprints that differ in at most three bits share one. A bucket with
more than a stated number of fingerprints is dealt again by four blocks of its remaining bits, for which the same
holds, so no link is lost and buckets stay small at any size of input.

Within a bucket, fingerprints are stored as 64 vertical bit planes. A plane XORed with itself shifted by d gives one
bit of difference for every pair (i, i + d) at once, 64 pairs a word; carry-save counters add these up, and a block of
words is abandoned as soon as every distance in it is over the radius. Linked fingerprints of a bucket are returned
as a star, so the number of links grows with the members of a bucket, not with its pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import components
from .common import read, text_slices, texts, written

RADIUS = 3
SEED = 42


def shingle_hashes(data: bytes, size: int = 3) -> np.ndarray:
    """XXH64 of every shingle of lower-cased words; of the whole if there are fewer words than a shingle has."""
    words = data.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    text = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.append(0, ends[:-1] + 1)
    n = max(1, len(words) - size + 1)
    digest = xxhash.xxh64_intdigest
    pairs = zip(starts[:n].tolist(), ends[min(size, len(words)) - 1 :].tolist())
    return np.array([digest(text[a:b], SEED) for a, b in pairs], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """Bit i is set if it is set in over half of the hashes."""
    total = np.zeros(64, np.int64)
    for start in range(0, len(hashes), 1 << 16):
        part = hashes[start : start + (1 << 16)]
        bits = np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(0, dtype=np.uint32)
    return int(np.packbits(total * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of every row; null and empty texts have fingerprint zero."""
    rows = texts(docs)

    def run(batches):
        for part in text_slices(batches):
            found = np.array([fingerprint(shingle_hashes(t.as_buffer().to_pybytes(), size)) for t in part.column("text")], np.uint64)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp long")


def planes_of(fps: np.ndarray) -> np.ndarray:
    """64 rows of packed bits: bit i of row b is bit b of fingerprint i."""
    bits = np.unpackbits(fps.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").T
    return np.ascontiguousarray(np.packbits(np.pad(bits, ((0, 0), (0, -len(fps) % 64))), axis=1, bitorder="little")).view("<u8")


def shifted(plane: np.ndarray, by: int) -> np.ndarray:
    """Bit i becomes bit i + by of the argument (zero beyond its end)."""
    words, bits = divmod(by, 64)
    out = np.zeros_like(plane)
    n = plane.shape[-1] - words
    if n > 0:
        out[..., :n] = plane[..., words:]
        if bits:
            out >>= np.uint64(bits)
            out[..., : n - 1] |= plane[..., words + 1 :] << np.uint64(64 - bits)
    return out


def near(planes: np.ndarray, other: np.ndarray, alive: np.ndarray, block: int = 64, radius: int = RADIUS) -> np.ndarray:
    """Of the lanes set in alive, those where planes and other differ in at most `radius` bits.

    Counter bits, started so that they overflow beyond the radius, hold distances and `over` what overflowed. Every eight
    planes, blocks of words in which no lane is alive any more are dropped from the rest of the work.
    """
    words = planes.shape[1]
    at = np.flatnonzero(np.bitwise_or.reduceat(alive, np.arange(0, words, block)))
    lanes = (at[:, None] * block + np.arange(block)).ravel()
    lanes = lanes[lanes < words]
    size = radius.bit_length()
    first = (1 << size) - 1 - radius
    counters = [np.full(len(lanes), -(first >> i & 1), np.int64).view(np.uint64) for i in range(size)]
    over = ~alive[lanes]
    for b in range(64):
        carry = planes[b, lanes] ^ other[b, lanes]
        for i, c in enumerate(counters):
            counters[i], carry = c ^ carry, c & carry
        over |= carry
        if b % 8 == 7 and len(lanes):
            open_ = np.bitwise_or.reduceat(~over, np.arange(0, len(lanes), block)) != 0
            if not open_.all():
                keep = np.repeat(open_, block)[: len(lanes)]
                lanes, over, counters = lanes[keep], over[keep], [c[keep] for c in counters]
    out = np.zeros(words, np.uint64)
    out[lanes] = ~over
    return out


def linked(fps: np.ndarray, buckets: np.ndarray, radius: int = RADIUS, same=None, start: np.ndarray | None = None, found_links: list | None = None) -> np.ndarray:
    """For each fingerprint the place of the first one that it is linked to within its bucket (rows lie by bucket).

    same(i, j): whether two rows within the radius are linked indeed, else all are; start: places of rows that each row is
    linked to from the outset, not after its own; found_links: takes the links that were made.
    """
    root = np.arange(len(fps)) if start is None else start.copy()

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    members = np.bincount(buckets)[buckets]
    place, at, of = np.arange(len(fps)), fps, buckets
    lag = 1
    while True:
        # whole buckets are dropped as soon as the lag is beyond them or all in them are linked, when that frees half of the lanes
        keep = members > lag
        if lag % 16 == 1 and keep.any():
            edges = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
            tops = root[place]
            one = np.minimum.reduceat(tops, edges) == np.maximum.reduceat(tops, edges)
            keep &= ~np.repeat(one, np.diff(np.append(edges, len(of))))
            members = np.where(keep, members, 0)
        if not keep.any():
            break
        if lag == 1 or keep.sum() * 2 < len(keep):
            place, at, of, members = place[keep], at[keep], of[keep], members[keep]
            planes = planes_of(at)
        alive = np.append(of[:-lag] == of[lag:], np.zeros(min(lag, len(of)), bool))
        open_ = alive.copy()
        open_[:-lag] &= root[place[:-lag]] != root[place[lag:]]
        bits = np.packbits(np.pad(open_, (0, -len(at) % 64)), bitorder="little").view("<u8")
        if bits.any():
            found = np.unpackbits(near(planes, shifted(planes, lag), bits, radius=radius).view(np.uint8), bitorder="little")
            for i in np.flatnonzero(found):
                a, b = top(place[i]), top(place[i + lag])
                if a != b and (same is None or same(place[i], place[i + lag])):
                    root[max(a, b)] = min(a, b)
                    if found_links is not None:
                        found_links.append((place[i], place[i + lag]))
            if len(found):
                while (up := root[root]).tolist() != root.tolist():
                    root[:] = up
        lag += 1
    return root


def parts_of(mask: int, n: int = RADIUS + 1) -> list[int]:
    """mask with each of n parts of its clear bits added; two fingerprints near each other share a part."""
    clear = [b for b in range(64) if not mask >> b & 1]
    size = -(-len(clear) // n)
    return [mask | sum(1 << b for b in clear[i * size : (i + 1) * size]) for i in range(n)]


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def buckets(fps: DataFrame, limit: int) -> DataFrame:
    """(mask, key, fp): key is fp under mask; every pair within the radius shares a (mask, key).

    A bucket of over `limit` fingerprints is dealt again by four parts of the bits that its members may differ in,
    until none is that large or eight bits are left.
    """
    level = {signed(m): [signed(x) for x in parts_of(m)] for m in parts_of(0)}
    masks = F.array(*[F.lit(m) for m in level])
    rows = fps.select(F.explode(masks).alias("mask"), "fp").withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
    done = None
    for _ in range(6):
        count = rows.groupBy("mask", "key").count().filter(F.col("count") > limit)
        hot = written(fps.sparkSession, count.select("mask", "key"), "hot")
        if hot.isEmpty():
            break
        cold = rows.join(hot, ["mask", "key"], "left_anti")
        done = cold if done is None else done.unionByName(cold)
        finer = F.create_map(*[F.lit(x) for m, to in level.items() for x in (m, to)])
        rows = rows.join(hot, ["mask", "key"], "left_semi").select(F.explode(finer[F.col("mask")]).alias("mask"), "fp").withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
        rows = written(fps.sparkSession, rows.distinct(), "dealt")
        level = {x: [signed(y) for y in parts_of(x % (1 << 64))] for to in level.values() for x in to}
    return rows if done is None else done.unionByName(rows)


def links(fps: DataFrame, limit: int = 4096) -> DataFrame:
    """Stars (a, b) over distinct fingerprints whose connected components are those of "at most three bits apart"."""
    dealt = buckets(fps, limit).repartition("mask", "key").sortWithinPartitions("mask", "key").select("mask", "key", "fp")

    def run(batches):
        held = None

        def stars(mask, key, fp):
            if len(fp) < 2:
                return None
            new = np.append(True, (mask[1:] != mask[:-1]) | (key[1:] != key[:-1]))
            root = linked(fp.view(np.uint64), np.cumsum(new))
            at = np.flatnonzero(root != np.arange(len(fp)))
            return pa.RecordBatch.from_arrays([pa.array(fp[at]), pa.array(fp[root[at]])], ["a", "b"]) if len(at) else None

        for batch in batches:
            cols = [batch.column(c).to_numpy() for c in ("mask", "key", "fp")]
            if not len(cols[0]):
                continue
            if held is not None:
                cols = [np.append(a, b) for a, b in zip(held, cols)]
            # the last bucket may go on in the next batch
            cut = np.flatnonzero((cols[0] != cols[0][-1]) | (cols[1] != cols[1][-1]))
            cut = cut[-1] + 1 if len(cut) else 0
            held = [c[cut:] for c in cols]
            if (out := stars(*[c[:cut] for c in cols])) is not None:
                yield out
        if held is not None and (out := stars(*held)) is not None:
            yield out

    return dealt.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, size: int = 3, limit: int = 4096) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable).

    Null and empty texts have fingerprint zero and link to each other; a text of fewer words than a shingle has one
    hash; repeated rows stay repeated and are linked; null doc_ids are rows but never a component_id (null if
    there is nothing else); an empty table gives an empty table; other columns are not read.
    """
    spark = docs.sparkSession
    prints = written(spark, fingerprints(docs, size), "fingerprints")
    distinct = written(spark, prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    names = components(links(distinct.select("fp"), limit))
    named = distinct.join(names.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = written(spark, named, "named")
    first = named.groupBy("root").agg(F.min("first").alias("component_id"))
    # a fingerprint can have a third of all rows: both sides of this join are plain exchanges, which skewed ones split
    of = named.join(first, "root").select("fp", "component_id")
    return prints.join(of, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op8_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and components of all documents; see near_duplicates for the cases."""
    return near_duplicates(read(spark, sf_dir, "documents"))
