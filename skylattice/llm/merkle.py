"""A Merkle manifest of a table: one tree of documents for each language, and one over the languages.

Leaves are hashed where the rows lie, dealt by range of (language, doc_id) and numbered there; a node has up to eight
children. Blocks of 512 consecutive nodes are one task's unit: a block becomes one node of the next round, so that rounds
grow with the logarithm of the number of leaves to the base of 512, and a language with most of all rows is many blocks.
Then the way back down gives each block the siblings on its way to the root, and each leaf is folded in its block.

A parent keeps copies of its hash state, one before each child's slot. To fold a changed child, the state before its slot is
resumed with the replacement and the siblings to its right only; those to its left are in the state already. A way
above a block needs one state a level, which all leaves of the block share. Hash states cannot leave a task, so a
block's parents are made again where its leaves are folded.
"""

from __future__ import annotations

import hashlib
import string

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import read, runs, written

FAN = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_hash(*fields: Column) -> Column:
    """SHA-256, as hex text, of the fields: byte count, colon and value each; a null is a hyphen."""
    told = [F.coalesce(F.concat(F.octet_length(f).cast("string"), F.lit(":"), f), F.lit("-")) for f in fields]
    return F.sha2(F.concat(*told), 256)


def leaves(docs: DataFrame, tampered: Column) -> DataFrame:
    """k (language, sorting as it: null first), doc_id, leaf, and changed, the leaf after lower-casing A-Z of the text where tampered holds."""
    fields = {c: F.col(c).cast("string") for c in FIELDS}
    lower = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    changed = F.when(F.coalesce(tampered, F.lit(False)), leaf_hash(*(fields | {"text": lower}).values()))
    return docs.select(F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")).alias("k"), "doc_id", leaf_hash(*fields.values()).alias("leaf"), changed.alias("changed"))


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """rows with pos, from 0 within each k in the given order, and n, the number of rows of k. Equal rows are dealt by where they lie."""
    own = rows.columns
    by = ["k", *order, "__at"]
    ranged = rows.withColumn("__at", F.spark_partition_id()).repartitionByRange(*by).sortWithinPartitions(*by).drop("__at").withColumn("__part", F.spark_partition_id())

    def run(batches):
        last, count = None, 0
        for batch in batches:
            seq = []
            for k in batch.column("k").to_pylist():
                last, count = (k, count + 1) if k == last else (k, 0)
                seq.append(count)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(seq, pa.int64())], [*batch.schema.names, "__seq"])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranged.schema)
    placed = written(rows.sparkSession, ranged.mapInArrow(run, f"{types}, __seq long"), "numbered")
    sizes = placed.groupBy("k", "__part").agg((F.max("__seq") + 1).alias("m"))
    of_k = Window.partitionBy("k")
    before = F.coalesce(F.sum("m").over(of_k.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("k", "__part", before.alias("__start"), F.sum("m").over(of_k).alias("n"))
    return placed.join(starts, ["k", "__part"]).select(*own, (F.col("__start") + F.col("__seq")).alias("pos"), "n")


def digest_of(nodes: list[bytes]) -> bytes:
    return hashlib.sha256(b"".join(nodes)).hexdigest().encode()


def grown(nodes: list[bytes], n: int, height: int) -> list[list[bytes]]:
    """Levels of a block from its nodes on: `height` more, or until one node is left if all n nodes are in the block."""
    levels = [nodes]
    while len(levels[-1]) > 1 if n <= FAN**height else len(levels) <= height:
        last = levels[-1]
        levels.append([digest_of(last[i : i + FAN]) for i in range(0, len(last), FAN)])
    return levels


class Slot:
    """A child's slot: the parent's hash state before it, and the siblings on both sides."""

    __slots__ = ("state", "left", "right")

    def __init__(self, state, left: bytes, right: bytes):
        self.state, self.left, self.right = state, left, right

    def resumed(self, child: bytes) -> bytes:
        state = self.state.copy()
        state.update(child)
        state.update(self.right)
        return state.hexdigest().encode()


def slots_of(children: list[bytes]) -> list[Slot]:
    """The slots of one parent; its state is copied before each child."""
    state, slots = hashlib.sha256(), []
    for i, child in enumerate(children):
        slots.append(Slot(state.copy(), b"".join(children[:i]), b"".join(children[i + 1 :])))
        state.update(child)
    return slots


def block_slots(nodes: list[bytes], n: int, height: int) -> list[list[Slot]]:
    """For each level of a block below its top, the slots of all its nodes."""
    return [[s for i in range(0, len(level), FAN) for s in slots_of(level[i : i + FAN])] for level in grown(nodes, n, height)[:-1]]


def block_of(height: int) -> Column:
    return F.floor(F.col("pos") / FAN**height).alias("block")


def risen(nodes: DataFrame, height: int) -> DataFrame:
    """(k, pos, node, n) of the blocks' nodes, from (k, pos, node, n)."""
    dealt = nodes.select("k", block_of(height), "pos", "node", "n").repartition("k", "block").sortWithinPartitions("k", "block", "pos")

    def run(batches):
        for block in runs(batches, "k", "block"):
            n = block.column("n")[0].as_py()
            top = grown([x.encode() for x in block.column("node").to_pylist()], n, height)[-1][0].decode()
            yield pa.RecordBatch.from_arrays([pa.array([block.column("k")[0].as_py()]), pa.array([block.column("block")[0].as_py()]), pa.array([top]), pa.array([-(-n // FAN**height)])], ["k", "pos", "node", "n"])

    return dealt.mapInArrow(run, "k string, pos long, node string, n long")


def tree(nodes: DataFrame, height: int) -> list[DataFrame]:
    """All rounds from nodes (k, pos, node, n) on; in the last one each k of more than a block has one node."""
    rounds = [nodes]
    while True:
        rounds.append(written(nodes.sparkSession, risen(rounds[-1], height), "risen"))
        if rounds[-1].filter("n > 1").isEmpty():
            return rounds


def tops(rounds: list[DataFrame]) -> DataFrame:
    """(k, node) of the top of each k."""
    return rounds[-1].select("k", "node")


WAY = "way array<string>"  # left and right siblings by turns, from the bottom up


def descended(nodes: DataFrame, above: DataFrame, height: int) -> DataFrame:
    """(k, pos, way) of nodes (k, pos, node, n), from above, the ways (k, block, way) of their blocks."""
    head = above.select("k", "block", F.lit(-1).cast("long").alias("pos"), F.lit(None).cast("string").alias("node"), F.lit(0).cast("long").alias("n"), "way")
    rows = nodes.select("k", block_of(height), "pos", "node", "n", F.lit(None).cast("array<string>").alias("way"))
    dealt = rows.unionByName(head).repartition("k", "block").sortWithinPartitions("k", "block", "pos")

    def run(batches):
        for block in runs(batches, "k", "block"):
            up = block.column("way")[0].as_py()
            n = block.column("n")[1].as_py()
            levels = block_slots([x.encode() for x in block.column("node").to_pylist()[1:]], n, height)
            ways = []
            for i in range(block.num_rows - 1):
                own = [levels[x][i // FAN**x] for x in range(len(levels))]
                ways.append([side.decode() for s in own for side in (s.left, s.right)] + up)
            yield pa.RecordBatch.from_arrays([pa.array(block.column("k").to_pylist()[1:]), pa.array(block.column("pos").to_pylist()[1:]), pa.array(ways, pa.list_(pa.string()))], ["k", "pos", "way"])

    return dealt.mapInArrow(run, f"k string, pos long, {WAY}")


def ways_down(rounds: list[DataFrame], start: DataFrame, height: int) -> DataFrame:
    """(k, block, way) of the blocks of the first round, from the ways (k, way) of the tops."""
    ways = start.select("k", F.lit(0).cast("long").alias("block"), "way")
    for nodes in reversed(rounds[1:-1]):
        ways = descended(nodes, ways, height).select("k", F.col("pos").alias("block"), "way")
    return ways


def folded(rows: DataFrame, blocks: DataFrame, id_type, height: int) -> DataFrame:
    """The result of every leaf, from rows (k, pos, n, doc_id, leaf, changed) and blocks (k, block, way, subroot, root)."""
    extra = {"doc_id": id_type.simpleString(), "leaf": "string", "changed": "string", "way": "array<string>", "subroot": "string", "root": "string", "n": "long", "pos": "long"}

    def as_rows(df: DataFrame) -> DataFrame:
        return df.select("k", "block", *[(F.col(c) if c in df.columns else F.lit(-1 if c == "pos" else None)).cast(t).alias(c) for c, t in extra.items()])

    # a block's heading comes first
    both = as_rows(rows.withColumn("block", block_of(height))).unionByName(as_rows(blocks))
    dealt = both.repartition("k", "block").sortWithinPartitions("k", "block", "pos")
    arrow_id = to_arrow_type(id_type)
    names = ["leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]

    def run(batches):
        for block in runs(batches, "k", "block"):
            way, subroot, root = (block.column(c)[0].as_py() for c in ("way", "subroot", "root"))
            rows = block.slice(1)
            found = [x.encode() for x in rows.column("leaf").to_pylist()]
            levels = block_slots(found, rows.column("n")[0].as_py(), height)
            above = [Slot(hashlib.sha256(way[i].encode()), way[i].encode(), way[i + 1].encode()) for i in range(0, len(way), 2)]
            beyond = [s.left + s.right for s in above]
            out: list[tuple] = []
            for i, (leaf, changed) in enumerate(zip(found, rows.column("changed").to_pylist())):
                node = leaf if changed is None else changed.encode()
                proof = hashlib.sha256()
                for x, level in enumerate(levels):
                    slot = level[i // FAN**x]
                    proof.update(slot.left)
                    proof.update(slot.right)
                    node = slot.resumed(node)
                for slot, others in zip(above, beyond):
                    proof.update(others)
                    node = slot.resumed(node)
                end = node.decode()
                out.append((leaf.decode(), subroot, root, proof.hexdigest(), end, end == root))
            columns = [rows.column("doc_id").combine_chunks().cast(arrow_id), *[pa.array(c) for c in zip(*out)]]
            yield pa.RecordBatch.from_arrays([c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in columns], ["doc_id", *names])

    return dealt.mapInArrow(run, f"doc_id {id_type.simpleString()}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def manifest(docs: DataFrame, tampered: Column | None = None, height: int = 3) -> DataFrame:
    """One row per row of docs: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    tampered says for which rows the text is lower-cased (A-Z) before it is folded; none if not given. A block has
    8 to the power of height leaves. A null in any
    field is a leaf like others, told from the empty text; null languages are a tree that comes first, null doc_ids come
    first in their tree; rows that share a doc_id lie by leaf, so equal rows are leaves side by side with results of
    their own; long texts are hashed whole; an empty table gives an empty table; other columns are not read.
    """
    spark = docs.sparkSession
    id_type = docs.schema["doc_id"].dataType
    rows = written(spark, leaves(docs, F.lit(False) if tampered is None else tampered), "leaves")
    rows = written(spark, numbered(rows, "doc_id", "leaf"), "placed")
    rounds = tree(rows.select("k", "pos", F.col("leaf").alias("node"), "n"), height)
    # the trees' tops are the leaves of one more tree
    subroots = tops(rounds).select(F.lit("").alias("k"), F.col("k").alias("lang"), "node")
    subroots = written(spark, numbered(subroots, "lang"), "subroots")
    upper = tree(subroots.select("k", "pos", "node", "n"), height)
    start = upper[-1].select("k", F.array().cast("array<string>").alias("way"))
    ways = descended(subroots.select("k", "pos", "node", "n"), ways_down(upper, start, height), height).select("pos", "way")
    named = subroots.join(ways, "pos").select(F.col("lang").alias("k"), "way", F.col("node").alias("subroot"))
    named = written(spark, named.crossJoin(tops(upper).select(F.col("node").alias("root"))), "tops")  # one root
    blocks = ways_down(rounds, named.select("k", "way"), height).join(named.drop("way"), "k")
    return folded(rows, blocks, id_type, height)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of all documents, a third of them tampered; see manifest for the cases."""
    return manifest(read(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string")) % 3 == 0)


def _field_sql(column: str) -> str:
    return f"coalesce(strlen(cast({column} as varchar)) || ':' || {column}, '-')"


def _leaf_sql(text: str) -> str:
    return "sha256(" + " || ".join(_field_sql(text if f == "text" else f) for f in FIELDS) + ")"


#: Trees of all languages grow level by level; the tree over their tops is one more. A row of `path` is a leaf's node on a level.
OP13_SQL = f"""
with recursive
crc as (select list(c order by i) as t from (
  select i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, _: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) c
  from (select unnest(range(0, 256)) i))),
d as (
  select row_number() over () r, doc_id, coalesce('=' || lang, '') k, {_leaf_sql("text")} leaf,
    {_leaf_sql(f"translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}')")} changed,
    xor(list_reduce(list_prepend(4294967295, list_transform(string_split(cast(doc_id as varchar), ''), lambda x: cast(ascii(x) as bigint))),
      lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295) % 3 = 0 dealt
  from documents, crc),
p as (select *, row_number() over (partition by k order by doc_id nulls first, leaf, r) - 1 pos, count(*) over (partition by k) n from d),
low as (
  select k, 0 lv, pos, n, leaf node from p
  union all
  select k, lv + 1, pos // 8, (max(n) + 7) // 8, sha256(string_agg(node, '' order by pos)) from low where n > 1 group by k, lv, pos // 8),
tops as (select k, node, row_number() over (order by k) - 1 pos, count(*) over () n, lv from low where n = 1),
high as (
  select 0 lv, pos, n, node from tops
  union all
  select lv + 1, pos // 8, (max(n) + 7) // 8, sha256(string_agg(node, '' order by pos)) from high where n > 1 group by lv, pos // 8),
path as (
  select p.r, lv, p.pos // cast(pow(8, lv) as bigint) place, k, false upper from p join (select distinct k, lv from low where n > 1) l using (k)
  union all
  select p.r, 1000 + h.lv, tops.pos // cast(pow(8, h.lv) as bigint), '', true from p join tops using (k), (select distinct lv from high where n > 1) h),
nodes as (select k, lv, pos, node from low where n > 1 union all select '', 1000 + lv, pos, node from high where n > 1),
runs as (
  select r, lv, coalesce(string_agg(node, '' order by pos) filter (pos < place), '') before, coalesce(string_agg(node, '' order by pos) filter (pos > place), '') after
  from path join nodes using (k, lv) where pos // 8 = place // 8 group by r, lv),
steps as (select *, row_number() over (partition by r order by lv) s from runs),
fold as (
  select r, 0 s, case when dealt then changed else leaf end node from p
  union all
  select r, fold.s + 1, sha256(before || node || after) from fold join steps using (r) where steps.s = fold.s + 1),
ends as (select r, arg_max(node, s) folded_root from fold group by r),
proofs as (select r, sha256(string_agg(before || after, '' order by lv)) proof_sha256 from runs group by r)
select doc_id, leaf, tops.node subroot, root.node root, coalesce(proof_sha256, sha256('')) proof_sha256, folded_root, folded_root = root.node verified
from p join tops using (k) join ends using (r) left join proofs using (r), (select node from high where n = 1) root
"""
