"""Near-duplicate texts by similarity of their word shingles, with bit-sliced SimHash comparison and an exact check.

A text is the set of its five-word shingles; two texts are linked if the Jaccard similarity of their sets is at least
0.8. Such a pair's SimHash fingerprints differ in about ten of 64 bits, far too many for blocks of fingerprint bits to deal
by, so texts meet in buckets of min-hashes instead: twenty bands of four, of which a pair at 0.8 shares none once in 38,000
times, one at 0.3 shares one in 15 % of cases and one at 0.2 in 3 %, so boilerplate alone brings few texts together. Within a bucket fingerprints lie as bit planes, distances of 64 pairs at once are counted by carry-save counters,
and a block of words is abandoned once all in it are beyond the radius. The radius, 24, is five standard deviations from
the mean at 0.8, so it only spares work; what is within it is decided by the sets themselves.

Texts with equal sets are one before anything is compared. Buckets that hold the same texts count once, and pairs that
are linked already are not compared again, which leaves little to do in a large group of near copies. A bucket of more than
`limit` texts is dealt by hash into parts that are linked by themselves; then one text of each class of a bucket is compared
across parts; if a bucket still has several classes, the texts outside the largest go to all of its parts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import components
from .common import text_slices, written
from .simhash import fingerprint, linked, shingle_hashes

BANDS, ROWS = 20, 4
RADIUS = 24
_rng = np.random.default_rng(11)
SCALES = _rng.integers(0, 1 << 63, ROWS * BANDS, np.uint64) * np.uint64(2) + np.uint64(1)
SHIFTS = _rng.integers(0, 1 << 63, ROWS * BANDS, np.uint64)


def bands_of(hashes: np.ndarray) -> np.ndarray:
    """One key for each band; none for no hashes."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    least = np.full(ROWS * BANDS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 1 << 13):
        least = np.minimum(least, (np.multiply.outer(SCALES, hashes[at : at + (1 << 13)]) + SHIFTS[:, None]).min(1))
    keys = [xxhash.xxh64_intdigest(least[ROWS * i : ROWS * (i + 1)].tobytes(), i) for i in range(BANDS)]
    return np.array(keys, np.uint64).view(np.int64)


def digest(text: Column) -> Column:
    """60 bits of the text's MD5 as a long; null texts have that of the empty text."""
    return F.conv(F.substring(F.md5(F.coalesce(text, F.lit(""))), 1, 15), 16, 10).cast("long")


def sketches(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, digest, key (128 bits of the shingle set), fp, bands and the set, as sorted 32-bit hashes, of every row."""
    rows = docs.select("doc_id", digest(F.col("text")).alias("digest"), F.coalesce("text", F.lit("")).alias("text"))

    def run(batches):
        for part in text_slices(batches):
            keys, fps, bands, sets = [], [], [], []
            for text in part.column("text"):
                hashes = np.unique(shingle_hashes(text.as_buffer().to_pybytes(), size))
                keys.append(xxhash.xxh3_128_digest(hashes.tobytes()))
                fps.append(fingerprint(hashes))
                bands.append(bands_of(hashes))
                sets.append(np.unique(hashes.astype(np.uint32)).tobytes())
            columns = [pa.array(keys, pa.binary()), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(bands, pa.list_(pa.int64())), pa.array(sets, pa.binary())]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("digest"), *columns], ["doc_id", "digest", "key", "fp", "bands", "set"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, digest long, key binary, fp long, bands array<long>, set binary")


def jaccard(a: bytes, b: bytes) -> float:
    """Similarity of two sets of sorted 32-bit hashes."""
    x, y = np.frombuffer(a, np.uint32), np.frombuffer(b, np.uint32)
    small, large = min(len(x), len(y)), max(len(x), len(y))
    if not large:
        return 1.0
    if small < 0.5 * large:  # can't be more than this
        return small / large
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both)


def links(members: DataFrame, similarity: float) -> DataFrame:
    """Verified links (a, b) of keys, a spanning forest within each unit, of members (unit, key, root, fp, set).

    Members of one root count as linked and give no link among each other.
    """
    dealt = members.repartition("unit").sortWithinPartitions("unit", "root", "fp").select("unit", "key", "root", "fp", "set")

    def run(batches):
        held = None

        def stars(unit, key, root, fp, sets):
            if len(fp) < 2:
                return None
            number = np.cumsum(np.append(True, unit[1:] != unit[:-1]))
            new = np.append(True, (root[1:] != root[:-1]) | (number[1:] != number[:-1]))
            start = np.flatnonzero(new)[np.cumsum(new) - 1]
            found: list[tuple[int, int]] = []
            linked(fp.view(np.uint64), number, RADIUS, lambda i, j: jaccard(sets[i], sets[j]) >= similarity, start, found)
            return pa.RecordBatch.from_arrays([pa.array([key[i] for i, _ in found], pa.binary()), pa.array([key[j] for _, j in found], pa.binary())], ["a", "b"]) if found else None

        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("unit", "key", "root", "fp", "set")]
            if held is not None:
                cols = [np.append(a, b) for a, b in zip(held, cols)]
            # the last unit may go on in the next batch
            cut = np.flatnonzero(cols[0] != cols[0][-1])
            cut = cut[-1] + 1 if len(cut) else 0
            held = [c[cut:] for c in cols]
            if (out := stars(*[c[:cut] for c in cols])) is not None:
                yield out
        if held is not None and (out := stars(*held)) is not None:
            yield out

    return dealt.mapInArrow(run, "a binary, b binary")


def classes(rows: DataFrame, similarity: float, limit: int) -> DataFrame:
    """(key, root) of keys that have a link, from sketches; equal root: reachable by links."""
    spark = rows.sparkSession
    # sets are written with their bands as arrays, which take less room than a row for each
    distinct = written(spark, rows.groupBy("key").agg(F.first("bands").alias("bands")), "bands")
    exploded = distinct.select("key", F.explode("bands").alias("bucket"))
    sizes = exploded.groupBy("bucket").agg(F.count("*").alias("n"), F.sum(F.xxhash64("key").cast("decimal(20,0)")).alias("mark")).filter("n > 1")
    # of buckets with the same texts one is enough
    once = sizes.groupBy("n", "mark").agg(F.min("bucket").alias("bucket")).select("bucket", "n")
    places = written(spark, exploded.join(once, "bucket"), "places")
    sets = rows.join(places.select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.first("fp").alias("fp"), F.first("set").alias("set"))
    members = places.join(sets, "key")
    part = F.pmod(F.xxhash64("key", "bucket"), F.greatest(F.lit(1), F.ceil(2 * F.col("n") / limit)))
    unit = F.xxhash64("bucket", F.when(F.col("n") > limit, part).otherwise(0)).alias("unit")
    first = written(spark, links(members.select(unit, "key", F.col("key").alias("root"), "fp", "set"), similarity), "links")
    found = components(first)
    name = lambda df, names: df.join(names.select(F.col("node").alias("key"), F.col("root").alias("named")), "key", "left").withColumn("root", F.coalesce("named", "key")).drop("named")
    hot = members.filter(F.col("n") > limit)
    if not places.filter(F.col("n") > limit).isEmpty():
        hot = written(spark, hot.withColumn("part", part), "hot")
        leaders = name(hot, found).groupBy("bucket", "root").agg(F.min_by(F.struct("key", "fp", "set"), "key").alias("l")).select(F.col("bucket").alias("unit"), "l.key", "root", "l.fp", "l.set")
        first = written(spark, first.unionByName(links(leaders, similarity)), "links")
        found = components(first)
        named = name(hot, found)
        by_class = named.groupBy("bucket", "root").agg(F.count("*").alias("m"))
        largest = by_class.groupBy("bucket").agg(F.max_by("root", F.struct("m", "root")).alias("largest"), F.count("*").alias("k")).filter("k > 1")
        rest = named.join(largest, "bucket")
        parts = F.sequence(F.lit(0).cast("long"), F.ceil(2 * F.col("n") / limit) - 1)
        rest = rest.withColumn("to", F.explode(F.when(F.col("root") == F.col("largest"), F.array("part")).otherwise(parts)))
        more = links(rest.select(F.xxhash64("bucket", "to").alias("unit"), "key", "root", "fp", "set"), similarity)
        found = components(written(spark, first.unionByName(more), "links"))
    return found.select(F.col("node").alias("key"), "root")


def similar_texts(docs: DataFrame, size: int = 5, similarity: float = 0.8, limit: int = 4096) -> DataFrame:
    """One row per row of docs: doc_id, digest, class (128 bits; equal: same set of shingles or reachable by links).

    Words are lower-cased (A-Z); a text of fewer words than a shingle has one shingle, null and empty texts have none and
    are one class; repeated rows stay repeated; an empty table gives an empty table; columns other than doc_id and
    text are not read.
    """
    rows = written(docs.sparkSession, sketches(docs, size), "sketches")
    named = classes(rows, similarity, limit)
    # a set can have a third of all rows: both sides of this join are plain exchanges, which skewed ones split
    return rows.select("doc_id", "digest", "key").join(named, "key", "left").select("doc_id", "digest", F.coalesce("root", "key").alias("class"))


def one_of_each(docs: DataFrame, size: int = 5, similarity: float = 0.8, limit: int = 4096) -> DataFrame:
    """The rows of docs, whole, that stand for their class: the smallest doc_id, of equal ones the smallest digest of the text.

    Rows without a doc_id stay only if no row of their class has one; of repeated rows one stays, of rows that repeat in
    doc_id and text but not elsewhere any. Cases are those of similar_texts; other columns go through.
    """
    spark = docs.sparkSession
    found = similar_texts(docs, size, similarity, limit)
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "digest")
    best = found.groupBy("class", "doc_id", "digest").agg(F.count("*").alias("n")).groupBy("class").agg(F.min(F.struct(*[place.getField(c).alias(c) for c in ("last", "doc_id", "digest")], "n")).alias("p"))
    stay = written(spark, best.select(F.col("p.doc_id").alias("s_id"), F.col("p.digest").alias("s_digest"), F.col("p.n").alias("s_n")), "stay")
    rows = docs.select(F.struct(*docs.columns).alias("row"), digest(F.col("text")).alias("r_digest"))
    on = F.col("row.doc_id").eqNullSafe(F.col("s_id")) & (F.col("r_digest") == F.col("s_digest"))
    single, repeated = (rows.join(stay.filter(c), on, "left_semi") for c in ("s_n = 1", "s_n > 1"))
    # only rows that are known to repeat are brought together
    once = repeated.groupBy(F.col("row.doc_id").alias("g_id"), "r_digest").agg(F.first("row").alias("row"))
    return single.select("row.*").unionByName(once.select("row.*"))
