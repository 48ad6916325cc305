"""Token counts by a compiled finite-state tokenizer.

Two deterministic transducers are compiled from a byte-level BPE tokenizer file:

* the *boundary* transducer reads character classes (with two characters of lookahead folded into the input symbol)
  and marks where pre-tokens begin. It has eight states, so a chunk of text is a map of eight states; the maps of
  all chunks are found side by side and composed by a parallel prefix scan, which gives each chunk's true entry state;
* the *word* transducer reads the bytes of one pre-token. Each transition is annotated with the number of tokens that
  can no longer change, and each state with the number still pending at the end of the word. It is determinised as
  input needs it, and its state tables are emptied when they reach a fixed size, so memory is bounded.

Why the word transducer is finite: the last BPE token of a prefix fixes the rest of that prefix's encoding, and a token
sequence is the encoding exactly if every neighbouring pair encodes to itself. What lies before the longest suffix
that still is a prefix of some vocabulary entry can therefore not change any more.
"""

from __future__ import annotations

import json
import re
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import read, text_slices, texts, uncollected

# classes of characters
LETTER, NUMBER, OTHER, APOSTROPHE, BLANK, SPACE = range(6)
# symbols that the boundary transducer reads
S_LETTER, S_NUMBER, S_OTHER, S_SHORT, S_LONG, S_BLANK_LAST, S_SPACE_LAST, S_SPACE_IN, S_END = range(9)
# its states: before a new pre-token, in letters, numbers, others, after a blank that joins, in white space, and
# with one or two letters of a contraction to come
FRESH, IN_L, IN_N, IN_O, JOIN, IN_S, LAST1, LAST2 = range(8)
CHUNK = 256


def boundary_tables() -> tuple[np.ndarray, np.ndarray]:
    """next[symbol * 8 + state] and whether a pre-token begins with that symbol."""
    step, begins = np.zeros(72, np.uint8), np.zeros(72, bool)
    run = {S_LETTER: IN_L, S_NUMBER: IN_N, S_OTHER: IN_O}
    for state in range(8):
        for sym in range(9):
            if sym == S_END:
                to, new = FRESH, True
            elif state in (LAST1, LAST2):
                to, new = (FRESH if state == LAST1 else LAST1), False
            elif sym in (S_BLANK_LAST, S_SPACE_LAST, S_SPACE_IN):
                to, new = {S_BLANK_LAST: JOIN, S_SPACE_LAST: FRESH, S_SPACE_IN: IN_S}[sym], sym != S_SPACE_IN or state != IN_S
            elif sym in (S_SHORT, S_LONG):
                if state in (IN_O, JOIN):
                    to, new = IN_O, False
                else:
                    to, new = (LAST1 if sym == S_SHORT else LAST2), True
            else:
                to = run[sym]
                new = state != to and state != JOIN
            step[sym * 8 + state], begins[sym * 8 + state] = to, new
    return step, begins


def character_classes() -> bytes:
    """The class of every code point."""
    out = bytearray([OTHER]) * 0x110000
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for what, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\p{White_Space}+")):
        for m in regex.finditer(pattern, every):
            first, last = ord(m[0][0]), ord(m[0][-1])
            for at in (range(first, last + 1),) if last - first + 1 == len(m[0]) else (map(ord, m[0]),):
                for c in at:
                    out[c] = what
    out[ord("'")], out[ord(" ")] = APOSTROPHE, BLANK
    return bytes(out)


class WordTransducer:
    """Deterministic transducer over the bytes of a pre-token; transitions carry emitted-token counts."""

    def __init__(self, vocab: dict[bytes, int], merges: list[tuple[bytes, bytes]], max_states: int = 200_000):
        self.vocab, self.max_states = vocab, max_states
        self.rank = {(vocab[a], vocab[b]): (i, vocab[a + b]) for i, (a, b) in enumerate(merges)}
        self.parts = {vocab[a + b]: (i, vocab[a], vocab[b]) for i, (a, b) in enumerate(merges)}
        self.text = {i: b for b, i in vocab.items()}
        self.open = {b[:n] for b in vocab for n in range(1, len(b))}
        self.byte = {bytes([b]): vocab[bytes([b])] for b in range(256)}
        self.reset()

    def reset(self) -> None:
        self.fits: dict[tuple[int, int], bool] = {}
        self.ids: dict[tuple, int] = {}
        self.keys: list[tuple] = []
        self.next: list[dict[int, tuple[int, int]]] = []
        self.final: list[int] = []
        self.state((b"", ((0, -1, 0),)))

    def state(self, key: tuple) -> int:
        if (found := self.ids.get(key)) is None:
            found = self.ids[key] = len(self.keys)
            self.keys.append(key)
            self.next.append({})
            self.final.append(key[1][-1][2])
        return found

    def merged(self, ids: list[int]) -> list[int]:
        """Merge by lowest rank until no pair merges; for pairs of tokens, so short."""
        rank = self.rank
        while len(ids) > 1:
            best = min((rank.get(p, (1 << 40, 0)) + (i,) for i, p in enumerate(zip(ids, ids[1:]))), default=None)
            if best is None or best[0] == 1 << 40:
                break
            ids[best[2] : best[2] + 2] = [best[1]]
        return ids

    def follows(self, a: int, b: int) -> bool:
        """Whether b can stand after a (-1: at the start) in an encoding.

        Undo the merges of both tokens, the latest first: a pair across the border that would have merged before
        the merges undone so far spoils the border.
        """
        if (found := self.fits.get((a, b))) is not None:
            return found
        if a < 0:
            data = self.text[b]
            found = self.merged([self.byte[data[i : i + 1]] for i in range(len(data))]) == [b]
        else:
            found, x, y, before = True, a, b, (1 << 40, 0)
            while True:
                rank = self.rank.get((x, y))
                if rank is not None and (rank[0], 0) < before:
                    found = False
                    break
                of_x, of_y = self.parts.get(x), self.parts.get(y)
                if of_x is None and of_y is None:
                    break
                # equal merges go left to right, so one in b comes after the border's, one in a before it
                if of_y is None or of_x is not None and of_x[0] > of_y[0]:
                    before, x = (of_x[0], 0), of_x[2]
                else:
                    before, y = (of_y[0], 1), of_y[1]
        self.fits[a, b] = found
        return found

    def grow(self, at: int, byte: int) -> tuple[int, int]:
        """Build one transition."""
        suffix, places = self.keys[at]
        suffix += bytes([byte])
        end = len(suffix)
        for j, last, n in places:
            token = self.vocab.get(suffix[j:])
            if token is not None and self.follows(last, token):
                places = (*places, (end, token, n + 1))
                break
        keep = [p for p in places if p[0] == end or suffix[p[0] :] in self.open]
        first, _, base = keep[0]
        out = self.next[at][byte] = (self.state((suffix[first:], tuple((j - first, t, n - base) for j, t, n in keep))), base)
        return out

    def count(self, word: bytes) -> int:
        if len(self.keys) > self.max_states:
            self.reset()
        at = n = 0
        follow = self.next
        for byte in word:
            at, out = follow[at].get(byte) or self.grow(at, byte)
            n += out
        return n + self.final[at]


class Known(dict):
    """Pre-tokens met before and their counts."""

    def __init__(self, words: WordTransducer):
        self.words = words

    def __missing__(self, word: str) -> int:
        n = self[word] = self.words.count(word.encode())
        return n


class Boundaries:
    """The boundary transducer; finds the pre-tokens of many texts at once."""

    def __init__(self, classes: bytes):
        self.classes = np.frombuffer(classes, np.uint8)
        self.step, self.begins = boundary_tables()

    def symbols(self, codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Input symbols; ends: places of the separators between texts."""
        kind = self.classes[codes]
        kind[ends] = 6
        after = np.append(kind[1:], 6)
        sym = np.array([S_LETTER, S_NUMBER, S_OTHER, S_OTHER, S_SPACE_IN, S_SPACE_IN, S_END], np.uint8)[kind]
        last = after < BLANK
        sym[last & (kind == BLANK)] = S_BLANK_LAST
        sym[last & (kind == SPACE)] = S_SPACE_LAST
        if len(at := np.flatnonzero(kind == APOSTROPHE)):
            near = np.append(codes, [0, 0])
            one, two = near[at + 1], near[at + 2]
            sym[at[np.isin(one, [ord(c) for c in "stmd"])]] = S_SHORT
            pairs = [(ord(a), ord(b)) for a, b in ("re", "ve", "ll")]
            sym[at[np.logical_or.reduce([(one == a) & (two == b) for a, b in pairs])]] = S_LONG
        return sym

    def starts(self, sym: np.ndarray) -> np.ndarray:
        """Which symbols begin a pre-token: chunk state maps, their prefix scan, then all chunks from their own states."""
        n = len(sym)
        chunks = -(-n // CHUNK)
        grid = np.full(chunks * CHUNK, S_END, np.uint8)
        grid[:n] = sym
        grid = np.ascontiguousarray(grid.reshape(chunks, CHUNK).T) << 3
        maps = np.repeat(np.arange(8, dtype=np.uint8)[:, None], chunks, 1)
        for row in grid:
            maps = self.step.take(row | maps)
        maps = np.ascontiguousarray(maps.T)
        reach = 1
        while reach < chunks:  # maps[i] becomes the map of chunks i - 2 * reach + 1 to i
            maps[reach:] = np.take_along_axis(maps[reach:], maps[:-reach], 1)
            reach *= 2
        state = np.append(np.uint8(FRESH), maps[:-1, FRESH])
        found = np.empty(grid.shape, bool)
        for t, row in enumerate(grid):
            at = row | state
            found[t] = self.begins.take(at)
            state = self.step.take(at)
        return np.ascontiguousarray(found.T).reshape(-1)[:n]

    def words(self, pieces: list[str]) -> tuple[list[str], np.ndarray]:
        """The pre-tokens of all pieces, each piece's followed by one "\\0" that is not text, and the places of those."""
        whole = "\0".join(pieces) + "\0"
        ends = np.cumsum([len(p) + 1 for p in pieces]) - 1
        sym = self.symbols(np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32), ends)
        at = np.flatnonzero(self.starts(sym))
        cuts = [*at.tolist(), len(whole)]
        return [whole[a:b] for a, b in zip(cuts, cuts[1:])], np.flatnonzero(sym[at] == S_END)


class Tokenizer(Boundaries):
    """The compiled tokenizer; counts the tokens of texts. specials: literal strings that are one token each."""

    def __init__(self, spec: dict, max_words: int = 1_000_000):
        super().__init__(spec["classes"])
        self.known = Known(WordTransducer(spec["vocab"], spec["merges"]))
        self.special = re.compile("|".join(map(re.escape, sorted(spec["specials"], key=len, reverse=True))) or r"(?!)")
        self.max_words = max_words

    def counts(self, pieces: list[str]) -> list[int]:
        """Tokens of each of these texts, none of which holds a special token."""
        if not pieces:
            return []
        if len(self.known) > self.max_words:
            self.known.clear()
        known = self.known
        words, ends = self.words(pieces)
        n = np.array([known[w] for w in words], np.int64)
        n[ends] = 0
        return np.diff(np.append(0, np.cumsum(n)[ends])).tolist()

    def count_texts(self, rows: list[str], most: int = 2 << 20) -> list[int]:
        """Tokens of each text; long texts are cut where a pre-token is sure to begin."""
        out = [0] * len(rows)
        held: list[str] = []
        owner: list[int] = []
        size = 0

        def flush():
            nonlocal size
            for i, n in zip(owner, self.counts(held)):
                out[i] += n
            held.clear()
            owner.clear()
            size = 0

        for i, row in enumerate(rows):
            parts = self.special.split(row)
            out[i] += len(parts) - 1
            for part in parts:
                for piece in cut(part, most):
                    held.append(piece)
                    owner.append(i)
                    size += len(piece)
                    if size >= most:
                        flush()
        flush()
        return out


SURE = re.compile("[!-~] ")


def cut(text: str, most: int):
    """Pieces of about this many characters; each but the first begins with a blank after a printing ASCII character."""
    start = 0
    while len(text) - start > most and (m := SURE.search(text, start + most)):
        yield text[start : m.start() + 1]
        start = m.start() + 1
    yield text[start:]


def compiled(path: str) -> dict:
    """What executors need of a tokenizer file of the byte-level BPE kind. Its size is that of the file."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre, model = spec["pre_tokenizer"], spec["model"]
    if model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or spec["normalizer"] or model.get("ignore_merges"):
        raise ValueError("only byte-level BPE without normalizer, prefix space or ignored merges is compiled")
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shown = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    raw = lambda s: bytes(shown[c] for c in s)
    specials = [t["content"] for t in spec["added_tokens"]]
    merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    return {
        "vocab": {raw(k): v for k, v in model["vocab"].items() if k not in specials},
        "merges": [(raw(a), raw(b)) for a, b in merges],
        "specials": specials,
        "classes": character_classes(),
    }


_own: dict[str, Tokenizer] = {}  # of a worker, by call


def count_tokens(docs: DataFrame, tokenizer_path: str, context: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more tokens than context) of every row.

    A null or empty text has 0 bytes and 0 tokens; a null doc_id stays null; repeated rows stay repeated; an empty
    table gives an empty table; other columns are not read. The only broadcast is the tokenizer file's content.
    No shuffle: a text is one row, and long ones are worked on in pieces.
    """
    spec, key = docs.sparkSession.sparkContext.broadcast(compiled(tokenizer_path)), uuid.uuid4().hex

    def run(batches):
        if (tok := _own.get(key)) is None:
            _own.clear()
            tok = _own[key] = Tokenizer(spec.value)
        for part in text_slices(batches):
            rows = part.column("text").to_pylist()
            with uncollected():  # the collector would walk the state tables again and again
                n = pa.array(tok.count_texts(rows), pa.int64())
            size = pc.cast(pc.binary_length(part.column("text")), pa.int64())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), size, n, pc.greater(n, context)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = texts(docs)
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
