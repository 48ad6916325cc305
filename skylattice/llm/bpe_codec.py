"""Byte-level BPE encoding and decoding by a global shuffle of distinct words.

Texts are cut into pre-tokens where they lie. A slice, some megabytes of texts, keeps its distinct words and each
text's pre-tokens as places in that list. The distinct words of all slices are exploded to rows (word, slice, place) and
dealt by word; equal words lie together, so each distinct word of the corpus is encoded once. The ids go back, packed,
to the slices that asked, meet the packed texts there, and are put together by position. Decoding joins the token-byte
table, which has one row for each id of the vocabulary and is broadcast for that reason.

A frequent word has one row for each slice, not for each occurrence, so no word is hot. What is shuffled are the
distinct words of slices and the packed texts. A slice's key is a digest of its rows, so that equal keys mean equal rows;
texts whose order can change between two reads are written before they are cut.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import Places, packed, read, text_slices, texts, unpacked, without_collection, written
from .token_counts import Boundaries, character_classes, cut

SLICE = 32 << 20


def ranks_of(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a .tiktoken file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def encode_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Merge the neighbouring pair of the lowest rank, the first of equals, until none has a rank."""
    if (whole := ranks.get(word)) is not None:
        return [whole]
    n = len(word)
    before, end = list(range(-1, n - 1)), list(range(1, n + 1))  # end is 0 where no part begins
    pairs = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(pairs)
    while pairs:
        _, i, upto = heapq.heappop(pairs)
        j = end[i]
        if not j or j >= n or end[j] != upto:
            continue  # one of the two has merged meanwhile
        end[i], end[j] = upto, 0
        if upto < n:
            before[upto] = i
            if (r := ranks.get(word[i : end[upto]])) is not None:
                heapq.heappush(pairs, (r, i, end[upto]))
        if (h := before[i]) >= 0 and (r := ranks.get(word[h:upto])) is not None:
            heapq.heappush(pairs, (r, h, upto))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = end[i]
    return out


def sliced_words(rows: DataFrame, classes, kind: int, max_bytes: int) -> DataFrame:
    """kind 0: (slice, place, word) of the distinct words of slices; kind 1: (slice, doc_ids, counts, places packed)."""
    id_type = rows.schema["doc_id"].dataType
    arrow_id = to_arrow_type(id_type)

    def run(batches):
        find = Boundaries(classes.value)
        for part in text_slices(batches, max_bytes):
            places, found, counts = Places(), [], np.zeros(part.num_rows, np.uint32)
            digest = hashlib.blake2b(digest_size=8)
            held, owner, size = [], [], 0

            def flush():
                words, ends = find.words(held)
                at = np.array([places[w] for w in words], np.uint32)
                sizes = np.diff(np.append(-1, ends)) - 1
                np.add.at(counts, owner, sizes.astype(np.uint32))
                found.append(np.delete(at, ends))
                held.clear()
                owner.clear()

            for i, text in enumerate(part.column("text").to_pylist()):
                data = text.encode()
                digest.update(b"%d " % len(data))
                digest.update(data)
                for piece in cut(text, 1 << 20):
                    held.append(piece)
                    owner.append(i)
                    size += len(piece)
                    if size > 1 << 20:
                        flush()
                        size = 0
            if held:
                flush()
            digest.update(repr(part.column("doc_id").to_pylist()).encode())
            key = int.from_bytes(digest.digest(), "little", signed=True)
            # frequent words get small numbers, which pack well, and words go out sorted, which does too
            found = np.concatenate(found) if found else np.zeros(0, np.uint32)
            order = np.argsort(-np.bincount(found, minlength=len(places)), kind="stable")
            rank = np.empty(len(places), np.uint32)
            rank[order] = np.arange(len(places), dtype=np.uint32)
            if kind == 0:
                words = sorted((w.encode(), int(rank[i])) for w, i in places.items())
                for start in range(0, len(words), 50_000):
                    some = words[start : start + 50_000]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), key)), pa.array([i for _, i in some], pa.int32()), pa.array([w for w, _ in some], pa.binary())], ["slice", "place", "word"])
            else:
                ids = part.column("doc_id").cast(arrow_id).to_pylist()
                yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([ids], pa.list_(arrow_id)), pa.array([counts.tobytes()], pa.binary()), pa.array([packed(rank[found])], pa.binary())], ["slice", "doc_ids", "counts", "places"])

    out = "slice long, place int, word binary" if kind == 0 else f"slice long, doc_ids array<{id_type.simpleString()}>, counts binary, places binary"
    return rows.mapInArrow(without_collection(run), out)


def word_ids(words: DataFrame, ranks) -> DataFrame:
    """(slice, n, places, sizes, ids): packed ids of the words that a slice asked for; several rows a slice.

    Dealt and sorted by word, so that each distinct word is encoded once, when its first row comes by.
    """
    dealt = words.repartition("word").sortWithinPartitions("word")

    def run(batches):
        table = ranks.value
        last, ids = None, b""
        held: dict[int, tuple[list, list, list]] = defaultdict(lambda: ([], [], []))
        n = 0

        def out():
            rows = [(k, len(p), packed(np.array(p)), packed(np.array(s)), packed(np.frombuffer(b"".join(i), np.uint32))) for k, (p, s, i) in held.items()]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()))], ["slice", "n", "places", "sizes", "ids"])

        for batch in batches:
            for key, place, word in zip(batch.column("slice").to_pylist(), batch.column("place").to_pylist(), batch.column("word").to_pylist()):
                if word != last:
                    last = word
                    found = encode_word(word, table)
                    ids, size = np.array(found, np.uint32).tobytes(), len(found)
                places, sizes, all_ids = held[key]
                places.append(place)
                sizes.append(size)
                all_ids.append(ids)
            n += batch.num_rows
            if n >= 400_000:
                yield out()
                n = 0
        if held:
            yield out()

    return dealt.mapInArrow(without_collection(run), "slice long, n long, places binary, sizes binary, ids binary")


def gathered(starts: np.ndarray, sizes: np.ndarray, values: np.ndarray) -> np.ndarray:
    """values[starts[i] : starts[i] + sizes[i]] for all i, end to end."""
    total = int(sizes.sum())
    shift = np.repeat(starts - np.append(0, np.cumsum(sizes)[:-1]), sizes)
    return values[shift + np.arange(total)]


def encode_decode(docs: DataFrame, ranks_path: str, digests: tuple[str, ...] = (), max_bytes: int = SLICE, scanned: bool = False) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids (array<int>), decoded (binary); those named in digests as x_sha256.

    Texts are read twice and must come in the same order. scanned says that docs is a scan of files, where they do, in
    a task that is run again too; other tables are written to the shared folder first.
    A null text is empty and has no ids; null doc_ids stay; repeated rows stay repeated; an empty table gives an empty
    table; columns other than doc_id and text are not read.
    """
    sc = docs.sparkSession.sparkContext
    table = ranks_of(ranks_path)
    ranks, classes = sc.broadcast(table), sc.broadcast(character_classes())
    rows = texts(docs) if scanned else written(docs.sparkSession, texts(docs), "texts")
    id_type = rows.schema["doc_id"].dataType
    arrow_id = to_arrow_type(id_type)
    by_slice = word_ids(sliced_words(rows, classes, 0, max_bytes), ranks)
    texts_of = sliced_words(rows, classes, 1, max_bytes)

    def join(asked: pa.Table, coded: pa.Table) -> pa.Table:
        order = sorted((i, t) for t, i in ranks.value.items())
        token_sizes = np.zeros(order[-1][0] + 1, np.int64)
        token_sizes[[i for i, _ in order]] = [len(t) for _, t in order]
        token_starts = np.append(0, np.cumsum(token_sizes)[:-1])
        token_bytes = np.frombuffer(b"".join(t for _, t in order), np.uint8)
        load = lambda name: [unpacked(b) for b in coded.column(name).to_pylist()] or [np.zeros(0, np.uint32)]
        places, sizes, ids = (np.concatenate(load(c)).astype(np.int64) for c in ("places", "sizes", "ids"))
        at = np.append(0, np.cumsum(sizes)[:-1]) if len(sizes) else np.zeros(0, np.int64)
        word_at, word_size = np.zeros(len(places), np.int64), np.zeros(len(places), np.int64)
        word_at[places], word_size[places] = at, sizes
        out: list[list] = [[], [], [], []]
        for doc_ids, counts, data in zip(*(asked.column(c).to_pylist() for c in ("doc_ids", "counts", "places"))):
            words, upto = unpacked(data), 0
            for doc_id, n in zip(doc_ids, np.frombuffer(counts, np.uint32).tolist()):
                own = words[upto : upto + n]
                upto += n
                own_ids = gathered(word_at[own], word_size[own], ids)
                text = gathered(token_starts[own_ids], token_sizes[own_ids], token_bytes).tobytes()
                out[0].append(doc_id)
                out[1].append(len(own_ids))
                out[2].append(hashlib.sha256(own_ids.astype("<u4").tobytes()).hexdigest() if "ids" in digests else own_ids.astype(np.int32))
                out[3].append(hashlib.sha256(text).hexdigest() if "decoded" in digests else text)
        kinds = (arrow_id, pa.int64(), *(pa.string() if c in digests else t for c, t in (("ids", pa.list_(pa.int32())), ("decoded", pa.binary()))))
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=["doc_id", "n_tokens", *names])

    names = [f"{c}_sha256" if c in digests else c for c in ("ids", "decoded")]
    kinds = ["string" if c in digests else t for c, t in (("ids", "array<int>"), ("decoded", "binary"))]
    schema = f"doc_id {id_type.simpleString()}, n_tokens long, {names[0]} {kinds[0]}, {names[1]} {kinds[1]}"
    return texts_of.groupBy("slice").cogroup(by_slice.groupBy("slice")).applyInArrow(join, schema)


def op5_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digests of all documents; see encode_decode for the cases."""
    import public_tokenizers

    return encode_decode(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), digests=("ids", "decoded"), scanned=True)
