"""Documents with similar sets of word n-grams, exactly, by a grouped prefix join.

Two sets whose similarity is at least t share a token among the first |x| - ceil(t |x|) + 1 of each, in any order of tokens
that is the same for all. Tokens are ordered by how many documents have them, rare ones first, so most prefixes hold only
tokens of one document: these cannot meet anything and their documents leave the join. Of the others, those with the same
prefix and size are one group. Groups meet in the buckets of their prefixes' tokens, pairs of groups are filtered
by size and by the token's places, and what is left is expanded to members, filtered by parity bitmaps, and verified
by the sets themselves.

Counting: documents are packed into slices of some megabytes, once. A slice sends its distinct tokens, cut to 48 bits, to the
parts of the hash range, which count all and send back a level for each, in the order they came; a hot token is one
number a slice. (Tokens that agree in 48 bits count together; that changes the order, for all alike, and no result.)

Groups that buckets connect are a family. A family of up to `limit` members is one unit, to which each set is sent once;
there the buckets are an index in memory. In a larger family every group goes to the largest of its buckets first, which
links most of what there is; then buckets that still hold several components are worked. Members of a component are
not compared again, and a unit gives a spanning forest, so links grow with members, not pairs. A bucket over the limit
is worked in parts, whose classes meet through one member each; if several classes stay, what is outside the largest goes
to all parts.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..operators.components import components
from .common import read, runs, text_slices, texts, written

SLICE = 8 << 20
PART_TOKENS = 2 << 20
BITMAP = 1024
_rng = np.random.default_rng(12)
FACTORS = _rng.integers(0, 1 << 63, 64, np.uint64) * np.uint64(2) + np.uint64(1)


class WordHashes(dict):
    """XXH64 of words, remembered; emptied when there are many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 1 << 17:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def mixed(h: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit numbers that spreads every bit."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def token_set(data: bytes, size: int, known: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-grams of lower-cased words; of the whole if it has fewer words; none of none."""
    words = data.lower().split()
    if len(words) < size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 1)] if words else [], np.uint64)
    h = np.fromiter((known[w] for w in words), np.uint64, len(words))
    n = len(words) - size + 1
    total = np.zeros(n, np.uint64)
    for i in range(size):
        total += h[i : i + n] * FACTORS[i]
    return np.unique(mixed(total))


def packed_slices(docs: DataFrame, max_bytes: int) -> DataFrame:
    """(slice, doc_ids, sizes, data, bytes): documents of a slice, their texts compressed as one, and how long these are."""
    rows = texts(docs)
    id_type = rows.schema["doc_id"].dataType
    arrow_id = to_arrow_type(id_type)

    def run(batches):
        for part in text_slices(batches, max_bytes):
            data = [t.as_buffer().to_pybytes() for t in part.column("text")]
            sizes = [len(d) for d in data]
            columns = ([uuid.uuid4().hex], [part.column("doc_id").to_pylist()], [sizes], [zstandard.compress(b"".join(data), 1)], [sum(sizes)])
            kinds = (pa.string(), pa.list_(arrow_id), pa.list_(pa.int64()), pa.binary(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["slice", "doc_ids", "sizes", "data", "bytes"])

    return rows.mapInArrow(run, f"slice string, doc_ids array<{id_type.simpleString()}>, sizes array<long>, data binary, bytes long")


def slice_sets(data: list[bytes], size: int) -> tuple[list[np.ndarray], list[bytes], np.ndarray, np.ndarray]:
    """Sets and keys of texts; the sorted 48-bit tokens of its distinct sets, and how many of these have each."""
    known = WordHashes()
    sets = [token_set(d, size, known) for d in data]
    keys = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
    distinct = list({k: s for k, s in zip(keys, sets)}.values())
    every, counts = np.unique(np.concatenate(distinct) >> np.uint64(16) if distinct else np.zeros(0, np.uint64), return_counts=True)
    return sets, keys, every, counts


def unpacked_texts(data: bytes, sizes: list[int]) -> list[bytes]:
    whole, ends = zstandard.decompress(data), np.cumsum([0, *sizes]).tolist()
    return [whole[a:b] for a, b in zip(ends, ends[1:])]


def rising(numbers: np.ndarray) -> bytes:
    """Sorted numbers, as differences, byte by byte of all: the high ones are mostly zero."""
    return zstandard.compress(np.ascontiguousarray(np.diff(numbers, prepend=numbers.dtype.type(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def risen(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


def asked(slices: DataFrame, size: int, parts: int) -> DataFrame:
    """(part, slice, tokens, counts): the distinct tokens of slices by parts of their range."""

    def run(batches):
        bounds = np.array([(i << 48) // parts for i in range(1, parts)], np.uint64)
        for batch in batches:
            for row in batch.to_pylist():
                _, _, every, counts = slice_sets(unpacked_texts(row["data"], row["sizes"]), size)
                ends = [0, *np.searchsorted(every, bounds).tolist(), len(every)]
                counts = np.minimum(counts, 255).astype(np.uint8)
                held = [(p, row["slice"], rising(every[a:b]), zstandard.compress(counts[a:b].tobytes(), 1)) for p, (a, b) in enumerate(zip(ends, ends[1:])) if b > a]
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), (pa.int64(), pa.string(), pa.binary(), pa.binary()))], ["part", "slice", "tokens", "counts"])

    return slices.select("slice", "sizes", "data").mapInArrow(run, "part long, slice string, tokens binary, counts binary")


def level_of(counts: np.ndarray) -> np.ndarray:
    """0 for one document, then four levels for each doubling."""
    return np.minimum(255, np.ceil(4 * np.log2(counts))).astype(np.uint8)


def answered(asks: DataFrame) -> DataFrame:
    """(slice, part, levels): for each token that a slice asked about, in its order, the level of its count in all slices."""
    dealt = asks.repartition("part").sortWithinPartitions("part", "slice")

    def run(batches):
        for part in runs(batches, "part"):
            tokens = [risen(x) for x in part.column("tokens").to_pylist()]
            counts = np.concatenate([np.frombuffer(zstandard.decompress(x), np.uint8) for x in part.column("counts").to_pylist()])
            _, place = np.unique(np.concatenate(tokens), return_inverse=True)
            levels = level_of(np.bincount(place, counts))[place]
            ends = np.cumsum([0, *map(len, tokens)]).tolist()
            out = [zstandard.compress(levels[a:b].tobytes(), 3) for a, b in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays([part.column("slice").combine_chunks(), part.column("part").combine_chunks(), pa.array(out, pa.binary())], ["slice", "part", "levels"])

    return dealt.mapInArrow(run, "slice string, part long, levels binary")


def prefix_length(n: int, percent: int) -> int:
    return n + 1 - -(-percent * n // 100)


def prefixed(slices: DataFrame, answers: DataFrame, size: int, percent: int, id_type) -> DataFrame:
    """(doc_id, key, n, gid, unique, prefix, shared), one row a document.

    prefix: its prefix's tokens that other documents have too, in order, after `unique` tokens of its own; shared: all tokens
    of that kind, sorted, as bytes; gid: of the size and these; all null where the prefix has none or an equal set came before.
    """
    arrow_id = to_arrow_type(id_type)
    left = slices.select("slice", F.lit(1).alias("kind"), F.lit(0).cast("long").alias("part"), F.lit(None).cast("binary").alias("levels"), "doc_ids", "sizes", "data")
    null = lambda c: F.lit(None).cast(slices.schema[c].dataType).alias(c)
    right = answers.select("slice", F.lit(0).alias("kind"), "part", "levels", null("doc_ids"), null("sizes"), null("data"))
    dealt = left.unionByName(right).repartition("slice").sortWithinPartitions("slice", "kind", "part")
    names = ["doc_id", "key", "n", "gid", "unique", "prefix", "shared"]
    kinds = [arrow_id, pa.binary(), pa.int64(), pa.binary(), pa.int64(), pa.list_(pa.int64()), pa.binary()]

    def run(batches):
        for block in runs(batches, "slice"):
            levels = [np.frombuffer(zstandard.decompress(x), np.uint8) for x in block.column("levels").to_pylist() if x is not None]
            levels = np.concatenate(levels) if levels else np.zeros(0, np.uint8)
            row = block.slice(block.num_rows - 1)
            doc_ids, sizes, data = (row.column(c)[0].as_py() for c in ("doc_ids", "sizes", "data"))
            sets, keys, every, _ = slice_sets(unpacked_texts(data, sizes), size)
            seen, out = set(), []
            for doc_id, key, tokens in zip(doc_ids, keys, sets):
                n, more = len(tokens), (None,) * 4
                if key not in seen:
                    seen.add(key)
                    level = levels[np.searchsorted(every, tokens >> np.uint64(16))]
                    unique, length = int((level == 0).sum()), prefix_length(n, percent)
                    if n and unique < length:
                        order = np.argsort(level, kind="stable")  # tokens of one level lie by hash already
                        prefix = tokens[order[unique:length]]
                        gid = xxhash.xxh3_128_digest(np.append(prefix, np.array([n, unique], np.uint64)).tobytes())
                        more = (gid, unique, prefix.view(np.int64), tokens[level > 0].tobytes())
                out.append((doc_id, key, n, *more))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)

    return dealt.mapInArrow(run, f"doc_id {id_type.simpleString()}, key binary, n long, gid binary, unique long, prefix array<long>, shared binary")


class Forest:
    """Union-find over places."""

    def __init__(self, roots: np.ndarray):
        self.up = roots

    def top(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def flat(self) -> np.ndarray:
        while (up := self.up[self.up]).tolist() != self.up.tolist():
            self.up = up
        return self.up

    def join(self, a: int, b: int) -> None:
        a, b = self.top(a), self.top(b)
        self.up[max(a, b)] = min(a, b)


def bitmap(tokens: np.ndarray) -> np.ndarray:
    """Parities of the numbers of tokens in BITMAP cells: two sets differ in at least as many tokens as bitmaps in bits."""
    odd = np.bincount((tokens % np.uint64(BITMAP)).astype(np.int64), minlength=BITMAP) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64)


def unit_links(gid, key, root, n, unique, prefix, lengths, shared, percent: int) -> list[tuple[int, int]]:
    """Links of a unit's members, a forest over what their roots leave open; arguments are arrays by member, sorted by gid.

    prefix: the prefixes of all, end to end, with their lengths. Members of one group are compared, and those of groups
    that share a token of their prefixes, unless sizes or the token's places leave too few common tokens.
    """
    _, roots = np.unique(root, return_inverse=True)
    first = np.full(roots.max() + 1, len(roots))
    np.minimum.at(first, roots, np.arange(len(roots)))
    forest = Forest(first[roots])
    sets = [np.frombuffer(s, np.uint64) for s in shared]
    maps = np.array([bitmap(s) for s in sets])
    new = np.append(True, gid[1:] != gid[:-1])
    group = np.cumsum(new) - 1
    g_n, g_unique, g_length = n[new], unique[new], lengths[new]
    # one index of the groups' prefixes: tokens, sorted, with their group and place
    tokens = prefix[np.repeat(new, lengths)]
    starts = np.cumsum(g_length) - g_length
    of_group = np.repeat(np.arange(len(g_n)), g_length)
    places = np.arange(len(tokens)) - np.repeat(starts - g_unique, g_length)
    order = np.lexsort((of_group, tokens))
    by_token, by_group, by_place = tokens[order], of_group[order], places[order]
    found, good, of = [], None, -1
    for i in range(len(n) - 1):
        if of != group[i]:
            # one look at all later groups for all members of this one
            of = group[i]
            need = -(-percent * (g_n[of] + g_n) // (100 + percent))
            good = np.zeros(len(g_n), bool)
            end = starts[of] + g_length[of]
            low = np.searchsorted(by_token, tokens[starts[of] : end], "left")
            size = np.searchsorted(by_token, tokens[starts[of] : end], "right") - low
            # some tokens at a time, so that memory follows the unit
            for some in np.split(np.arange(len(low)), np.flatnonzero(np.diff(np.cumsum(size) >> 18)) + 1):
                at = np.repeat(low[some] - np.cumsum(size[some]) + size[some], size[some]) + np.arange(size[some].sum())
                place, other, other_place = np.repeat(places[starts[of] + some], size[some]), by_group[at], by_place[at]
                most = np.minimum(place, other_place) + np.minimum(g_n[of] - place, g_n[other] - other_place)
                most = np.minimum(most, np.minimum(g_n[of] - g_unique[of], g_n[other] - g_unique[other]))
                good[other[(most >= need[other]) & (other > of)]] = True
            good[of] = True
            apart = g_n[of] + g_n - 2 * need - g_unique[of] - g_unique  # of tokens that others have
        some = np.flatnonzero(good[group[i + 1 :]]) + i + 1
        if len(some):
            some = some[forest.flat()[some] != forest.up[i]]
        if len(some):
            some = some[np.bitwise_count(maps[some] ^ maps[i]).sum(1) <= apart[group[some]]]
        for j in some.tolist():
            if forest.top(i) != forest.top(j):
                both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if 100 * both >= percent * (n[i] + n[j] - both):
                    forest.join(i, j)
                    found.append((i, j))
    return found


def links(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Verified links (a, b) of keys within units, from members (unit, key, root) and their sets."""
    rows = members.select("unit", "key", "root").join(sets, "key")
    names = ["unit", "gid", "key", "root", "n", "unique", "prefix", "shared"]
    dealt = rows.select(*names).repartition("unit").sortWithinPartitions("unit", "gid", "key")

    def run(batches):
        for unit in runs(batches, "unit"):
            if unit.num_rows < 2:
                continue
            gid, key, root, n, unique, shared = (unit.column(c).to_numpy() for c in names if c not in ("unit", "prefix"))
            prefix = unit.column("prefix").combine_chunks()
            found = unit_links(gid, key, root, n, unique, prefix.flatten().to_numpy(), prefix.value_lengths().to_numpy(), shared, percent)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([key[i] for i in side], pa.binary()) for side in zip(*found)], ["a", "b"])

    return dealt.mapInArrow(run, "a binary, b binary")


def named(rows: DataFrame, names: DataFrame) -> DataFrame:
    """rows with root: the name of their key's component, or the key."""
    return rows.join(names.select(F.col("node").alias("key"), F.col("root").alias("__root")), "key", "left").withColumn("root", F.coalesce("__root", "key")).drop("__root")


def worked(buckets: DataFrame, sets: DataFrame, found: DataFrame, percent: int, limit: int, max_bytes: int) -> DataFrame:
    """All links so far and those of buckets (bucket, key, bytes), whole whatever a bucket's size."""
    spark = buckets.sparkSession
    size = buckets.groupBy("bucket").agg(F.count("*").alias("m"), F.sum("bytes").alias("bytes"))
    parts = F.ceil(F.greatest(2 * F.col("m") / limit, 2 * F.col("bytes") / max_bytes))
    hot = (F.col("m") > limit) | ((F.col("bytes") > max_bytes) & (F.col("m") > 2))
    size = size.select("bucket", F.when(hot, parts).otherwise(1).cast("long").alias("parts"))
    rows = named(buckets.select("bucket", "key").join(size, "bucket"), components(found)).withColumn("part", F.pmod(F.xxhash64("key", "bucket"), "parts"))
    rows = written(spark, rows, "dealt")
    found = written(spark, found.unionByName(links(rows.withColumn("unit", F.xxhash64("bucket", "part")), sets, percent)), "links")
    rows = rows.filter("parts > 1").drop("root")
    if rows.isEmpty():
        return found
    # one member of each class meets those of the other parts
    leaders = named(rows, components(found)).groupBy("bucket", "root").agg(F.min("key").alias("key")).withColumn("unit", F.xxhash64("bucket"))
    found = written(spark, found.unionByName(links(leaders, sets, percent)), "links")
    # what is still outside a bucket's largest class meets all its parts
    rows = named(rows, components(found))
    by_class = rows.groupBy("bucket", "root").agg(F.count("*").alias("m")).groupBy("bucket").agg(F.max_by("root", F.struct("m", "root")).alias("largest"), F.count("*").alias("k")).filter("k > 1")
    to = F.when(F.col("root") == F.col("largest"), F.array("part")).otherwise(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    rest = rows.join(by_class, "bucket").withColumn("to", F.explode(to)).withColumn("unit", F.xxhash64("bucket", "to"))
    return written(spark, found.unionByName(links(rest, sets, percent)), "links")


def joined(sets: DataFrame, percent: int, limit: int, max_bytes: int) -> DataFrame:
    """Links (a, b) of keys whose components are those of the similarity, from distinct sets."""
    spark = sets.sparkSession
    bytes_of = (8 * (F.col("n") - F.col("unique") + F.size("prefix"))).cast("long")
    groups = sets.groupBy("gid").agg(F.first("prefix").alias("prefix"), F.first(bytes_of).alias("bytes"), F.count("*").alias("m"))
    groups = written(spark, groups, "groups")
    index = groups.select("gid", F.explode("prefix").alias("bucket"))
    sizes = index.groupBy("bucket").agg(F.count("*").alias("k"), F.min("gid").alias("first"), F.sum(F.xxhash64("gid").cast("decimal(20,0)")).alias("mark"))
    # of buckets with the same groups one is enough
    shared = sizes.filter("k > 1").groupBy("k", "mark").agg(F.min(F.struct("bucket", "first")).alias("b")).select("b.*", "k")
    index = written(spark, index.join(shared, "bucket"), "index")
    # families: what buckets connect, similar or not
    names = components(index.select(F.col("first").alias("a"), F.col("gid").alias("b")))
    family = groups.select("gid", "bytes", "m").join(names.withColumnRenamed("node", "gid"), "gid", "left").filter("root is not null or m > 1").withColumn("family", F.coalesce("root", "gid"))
    weight = family.groupBy("family").agg(F.sum("m").alias("all"), F.sum(F.col("m") * F.col("bytes")).alias("weight"))
    small = (F.col("all") <= limit) & ((F.col("weight") <= max_bytes) | (F.col("all") == 2))
    family = written(spark, family.join(weight.select("family", small.alias("small")), "family").select("gid", "bytes", "m", "family", "small"), "families")
    keys = sets.select("gid", "key")
    whole = family.filter("small").join(keys, "gid").select(F.xxhash64("family").alias("unit"), "key", F.col("key").alias("root"))
    found = written(spark, links(whole, sets, percent), "links")
    large = family.filter("not small")
    if large.isEmpty():
        return found
    # a group's largest bucket first: it links most of what there is; a group of several is a bucket too
    own = large.filter("m > 1").select("gid", "bytes", F.xxhash64("gid").alias("bucket"), F.lit(0).cast("long").alias("k"))
    rows = written(spark, index.join(large.select("gid", "bytes"), "gid").select("gid", "bytes", "bucket", "k").unionByName(own), "buckets")
    largest = rows.groupBy("gid").agg(F.max_by(F.struct("bucket", "bytes"), F.struct("k", "bucket")).alias("x")).select("gid", "x.*")
    found = worked(largest.join(keys, "gid"), sets, found, percent, limit, max_bytes)
    # then those that still hold several components
    rows = written(spark, named(rows.join(keys, "gid"), components(found)), "places")
    open_ = rows.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("bucket")
    return worked(rows.drop("root").join(open_, "bucket"), sets, found, percent, limit, max_bytes)


def similar_documents(docs: DataFrame, size: int = 4, percent: int = 85, limit: int = 4096, slice_bytes: int = SLICE, part_tokens: int = PART_TOKENS, unit_bytes: int = 32 << 20) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, the smallest doc_id reachable by links.

    A set is the distinct n-grams of lower-cased (A-Z) words, or a shorter text's words as one; null texts and texts without
    words have none and are linked with nothing, their repeats included. Rows of equal sets are linked; repeated rows stay
    repeated; null doc_ids are rows but never a component_id (null if there is nothing else); an empty table gives an empty
    table; other columns are not read. Texts of over slice_bytes are a slice of their own.
    """
    spark = docs.sparkSession
    id_type = docs.schema["doc_id"].dataType
    slices = written(spark, packed_slices(docs, slice_bytes), "slices")
    total = slices.agg(F.sum("bytes")).first()[0] or 0
    parts = max(2 * spark.sparkContext.defaultParallelism, -(-total // (5 * part_tokens)))  # a token is a word's, of five bytes or more
    rows = written(spark, prefixed(slices, answered(asked(slices, size, parts)), size, percent, id_type), "prefixed")
    with_prefix = rows.filter("gid is not null").groupBy("key").agg(F.first(F.struct("gid", "n", "unique", "prefix", "shared")).alias("s"))
    sets = written(spark, with_prefix.select("key", "s.*"), "sets")
    names = components(joined(sets, percent, limit, unit_bytes))
    firsts = rows.filter("n > 0").groupBy("key").agg(F.min("doc_id").alias("least"))
    of_key = written(spark, named(firsts, names), "firsts")
    least = of_key.groupBy("root").agg(F.min("least").alias("component_id"))
    named_keys = of_key.join(least, "root").select("key", "component_id")
    # a key can have a third of all rows: both sides of this join are plain exchanges, which skewed ones split
    full = rows.filter("n > 0").select("doc_id", "key", "n").join(named_keys, "key").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    empty = rows.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return full.unionByName(empty)


def op12_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set sizes and components of all documents; see similar_documents for the cases."""
    return similar_documents(read(spark, sf_dir, "documents"))


OP12_SQL = r"""
with recursive
w as (select row_number() over () r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') ws from documents),
s as materialized (select r, unnest(list_distinct(case when len(ws) between 1 and 3 then [array_to_string(ws, ' ')] else list_transform(range(1, len(ws) - 2), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3]) end)) g from w),
n as (select r, count(*) n from s group by r),
e as (
  select a.r a, b.r b from s a join s b on a.g = b.g and a.r <> b.r join n x on x.r = a.r join n y on y.r = b.r
  group by a.r, b.r, x.n, y.n having 100 * count(*) >= 85 * (x.n + y.n - count(*))),
c as (select r a, r b from w union select c.a, e.b from c join e on c.b = e.a)
select w.doc_id, coalesce(n.n, 0) n_shingles, min(o.doc_id) component_id
from w left join n using (r) join c on c.a = w.r join w o on o.r = c.b group by w.r, w.doc_id, n.n
"""
