"""Benchmark decontamination: one Aho-Corasick automaton over all windows of all benchmark items.

Item texts are normalised to words and cut into windows of ten consecutive words (an item with fewer words, but not
none, is one window). The windows make one automaton, which a task builds once; each document is normalised the same
way and scanned once. Matches are mapped back to words and from them to character offsets of the original text.

The items of the automaton are broadcast, so their size is checked: beyond a stated number of characters they are dealt to
several automata, and the documents pass one after the other, written in between. At any time one part alone is at the
driver and in a task, which builds its automaton once. Benchmarks of ordinary size need one.
"""

from __future__ import annotations

import re
import uuid
from collections import defaultdict

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ALNUM_TABLE, read, text_slices, texts, written

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(data: bytes) -> list[bytes]:
    return data.translate(ALNUM_TABLE).split()


def windows_of(words: list[bytes], size: int) -> set[bytes]:
    """Distinct windows, each with a blank before, between and after its words."""
    return {b" %s " % b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


class Automaton:
    """Windows and the items that hold them."""

    def __init__(self, items: list[tuple[str | None, bytes]], size: int):
        holders: dict[bytes, list[int]] = defaultdict(list)
        self.names = sorted({name for name, _ in items if name is not None})
        number = {name: i for i, name in enumerate(self.names)}
        for name, data in items:
            for window in windows_of(words_of(data), size):
                holders[window] += [number[name]] if name is not None else []
        self.find = ahocorasick.Automaton()
        for window, owners in holders.items():
            # one character a byte, so that places are byte offsets
            self.find.add_word(window.decode("latin-1"), (len(window), window.count(b" ") - 1, tuple(owners)))
        self.empty = not holders
        if holders:
            self.find.make_automaton()

    def scan(self, words: list[bytes]) -> tuple[np.ndarray, set[int]]:
        """Sorted numbers of the words within windows, and the items of these windows."""
        if self.empty or not words:
            return np.zeros(0, np.int64), set()
        text = b" %s " % b" ".join(words)
        ends, lengths, owners = [], [], set()
        for end, (_, n, of) in self.find.iter(text.decode("latin-1")):
            ends.append(end)
            lengths.append(n)
            owners.update(of)
        if not ends:
            return np.zeros(0, np.int64), owners
        blanks = np.flatnonzero(np.frombuffer(text, np.uint8) == 32)
        last = np.searchsorted(blanks, np.array(ends))  # the match ends at the blank after word last - 1
        edge = np.zeros(len(words) + 1, np.int64)
        np.add.at(edge, last - np.array(lengths), 1)
        np.add.at(edge, last, -1)
        return np.flatnonzero(np.cumsum(edge[:-1]) > 0), owners


def spans(data: bytes, hit: np.ndarray) -> list[tuple[int, int]]:
    """Character offsets [start, end) in the original text of the runs of hit words."""
    if not len(hit):
        return []
    at = [m.span() for m in WORD.finditer(data.translate(ALNUM_TABLE))]
    breaks = np.flatnonzero(np.diff(hit) > 1)
    runs = zip(hit[np.append(0, breaks + 1)], hit[np.append(breaks, len(hit) - 1)])
    chars = lambda n: len(data[:n].decode())
    return [(chars(at[a][0]), chars(at[b][1])) for a, b in runs]


_own: dict[str, Automaton] = {}  # of a worker, by pass


def shards(benchmark: DataFrame, max_chars: int) -> list[DataFrame]:
    """The items in parts of about max_chars; one part for benchmarks of ordinary size."""
    rows = benchmark.filter("text is not null").select(F.col("item_id").cast("string").alias("item_id"), "text")
    total = rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).head()[0]
    n = max(1, -(-total // max_chars))
    return [rows.filter(F.pmod(F.xxhash64("item_id"), F.lit(n)) == i) for i in range(n)] if n > 1 else [rows]


def automaton_of(part: DataFrame, size: int):
    """A function for tasks that gives the automaton of a part of the items (see shards for its size), built once a worker."""
    items = part.sparkSession.sparkContext.broadcast([(r[0], r[1].encode()) for r in part.toLocalIterator()])
    key = uuid.uuid4().hex

    def get() -> Automaton:
        if key not in _own:
            _own.clear()
            _own[key] = Automaton(items.value, size)
        return _own[key]

    return get


def data_of(column: pa.Array) -> list[bytes]:
    return [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in column]


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = 10, max_chars: int = 64 << 20) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items (ids as strings, sorted), spans of original offsets.

    Null and empty texts have no words and no hits, null item texts no windows; an item of fewer than `size` words is
    one window; equal windows of several items report all of them; an item without an id hits, but is not among the items reported; repeated rows stay repeated; with an empty
    benchmark nothing is hit; columns other than the ids and texts are not read. max_chars: of items in an automaton.
    """
    *before, last = shards(benchmark, max_chars)
    rows = texts(docs)
    kind = rows.schema["doc_id"].dataType.simpleString()
    several = len(before) > 0
    if several:
        rows = rows.select("*", F.array().cast("array<int>").alias("hit"), F.array().cast("array<string>").alias("items"))

    def scanned(part: pa.RecordBatch, one: Automaton):
        """Words, sorted numbers of hit words and sorted items of each row, with those of passes before."""
        held = zip(part.column("hit").to_pylist(), part.column("items").to_pylist()) if several else [((), ())] * part.num_rows
        for data, (hit0, items0) in zip(data_of(part.column("text")), held):
            words = words_of(data)
            hit, owners = one.scan(words)
            yield data, len(words), np.union1d(hit, np.array(hit0, np.int64)) if len(hit0) else hit, sorted({*items0, *(one.names[k] for k in owners)})

    def passed(get):
        def run(batches):
            for part in text_slices(batches):
                found = list(scanned(part, get()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text"), pa.array([x[2] for x in found], pa.list_(pa.int32())), pa.array([x[3] for x in found], pa.list_(pa.string()))], ["doc_id", "text", "hit", "items"])

        return run

    for shard in before:
        rows = written(docs.sparkSession, rows.mapInArrow(passed(automaton_of(shard, size)), f"doc_id {kind}, text string, hit array<int>, items array<string>"), "scanned")
    get = automaton_of(last, size)

    def run(batches):
        for part in text_slices(batches):
            found = list(scanned(part, get()))
            at = [[{"start": a, "end": b} for a, b in spans(x[0], x[2])] for x in found]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    pa.array([x[1] for x in found], pa.int64()),
                    pa.array([len(x[2]) for x in found], pa.int64()),
                    pa.array([len(x[3]) for x in found], pa.int64()),
                    pa.array([x[3] for x in found], pa.list_(pa.string())),
                    pa.array(at, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                ],
                ["doc_id", "n_words", "n_hit", "n_items", "items", "spans"],
            )

    return rows.mapInArrow(run, f"doc_id {kind}, n_words long, n_hit long, n_items long, items array<string>, spans array<struct<start:long,end:long>>")


def without_leaks(docs: DataFrame, benchmark: DataFrame, size: int = 10, max_chars: int = 64 << 20) -> DataFrame:
    """The rows of docs, whole, in which no window occurs; rows are judged where they lie. Null texts stay."""

    def clean(get):
        def run(batches):
            for part in text_slices(batches):
                yield part.filter(pa.array([not get().scan(words_of(data))[1] for data in data_of(part.column("text"))], pa.bool_()))

        return run

    *before, last = shards(benchmark, max_chars)
    for shard in before:
        docs = written(docs.sparkSession, docs.mapInArrow(clean(automaton_of(shard, size)), docs.schema), "clean")
    return docs.mapInArrow(clean(automaton_of(last, size)), docs.schema)


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, hits and items of all documents; see decontaminate for the cases."""
    out = decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id", "n_words", "n_hit", "n_items",
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


OP3_SQL = r"""
with w as (
  select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') ws from benchmark where text is not null),
windows as (
  select distinct item_id, ws[i : i + 9] win
  from (select item_id, ws, unnest(range(1, greatest(2, len(ws) - 8))) i from w where len(ws) > 0)),
d as (
  select row_number() over () r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') ws from documents),
sizes as (select distinct len(win) n from windows),
placed as (
  select r, n, i, ws[i : i + n - 1] win from (select r, ws, n, unnest(range(1, len(ws) - n + 2)) i from d, sizes)),
found as (select r, i, n, item_id from placed join windows using (win)),
hit as (select r, count(*) n_hit from (select distinct r, unnest(range(i, i + n)) k from found) group by r),
owned as (select r, count(item_id) n_items, string_agg(cast(item_id as varchar), ',' order by cast(item_id as varchar)) ids from (select distinct r, item_id from found) group by r)
select doc_id, cast(len(ws) as bigint) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items,
  sha256(coalesce(ids, '')) items_sha256, n_hit is not null contaminated
from d left join hit using (r) left join owned using (r)
"""
