"""Token counts by finite-state tokenizer compilation.

A byte-level BPE tokenizer works in two steps, and both are compiled. Its splitting pattern becomes a deterministic
transducer over character classes, whose transitions are annotated with the pre-tokens they complete. A text is cut into
chunks of equal length; each chunk's map from every start state to its end state is built for all chunks at once, the maps
are composed by a parallel prefix scan, and a second sweep from the now known start states reads the annotations off.
Merges inside a pre-token don't have a small state set (how a prefix is merged depends on what follows), so an arc of the
second transducer is a whole pre-token, annotated with the number of tokens that the merges leave of it; arcs are compiled
when first met and forgotten when there are too many.

Cases: null is empty and has no tokens; a special token's string inside a text is one token, as the library's default has
it; texts of any length are counted whole; rows are counted one by one, so repeated rows and null doc_ids keep their rows; an
empty table gives no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, table

TOKENIZER = "byte_bpe_50k.json"
LIMIT = 512
CHUNK = 64
ARCS = 1_000_000
PIECE_CHARS = 1 << 20

# Character classes. Letters that matter to the contractions 's 't 're 've 'm 'll 'd have classes of their own.
LETTER, NUMBER, BLANK, SPACE, OTHER, QUOTE, STMD, R, V, L, E, END = range(12)
CLASSES = 12
# States: what the text before has left open.
START, IN_BLANK, IN_SPACE, BLANKS_B, BLANKS_S, WORD, DIGITS, REST, QUOTED, Q_R, Q_V, Q_L, SHUT = range(13)
STATES = 16
# Annotations: a pre-token starts at this character, or at the one before it.
HERE, BEFORE = 1, 2
_LETTERS = (LETTER, STMD, R, V, L, E)


def compile_pattern() -> tuple[np.ndarray, np.ndarray]:
    """next state and annotation of each (class, state) for the pattern
    's|'t|'re|'ve|'m|'ll|'d| ?letters| ?numbers| ?others|white space not before a word|white space."""
    to = np.zeros((CLASSES, STATES), dtype=np.uint8)
    say = np.zeros((CLASSES, STATES), dtype=np.uint8)

    def open_with(c: int) -> int:
        """The state after a pre-token starts with class c."""
        if c in _LETTERS:
            return WORD
        return {NUMBER: DIGITS, BLANK: IN_BLANK, SPACE: IN_SPACE, OTHER: REST, QUOTE: QUOTED, END: START}[c]

    for c in range(CLASSES):
        kind = WORD if c in _LETTERS else DIGITS if c == NUMBER else REST if c in (OTHER, QUOTE) else None
        for s in range(SHUT + 1):
            nxt, out = open_with(c), HERE
            if c == END:
                nxt, out = START, 0
                if s in (Q_R, Q_V, Q_L):
                    out = BEFORE
            elif s in (WORD, DIGITS, REST) and kind == s:
                nxt, out = s, 0
            elif s == IN_BLANK and c in (BLANK, SPACE) or s == IN_SPACE and c in (BLANK, SPACE) or s in (BLANKS_B, BLANKS_S) and c in (BLANK, SPACE):
                nxt, out = (BLANKS_B if c == BLANK else BLANKS_S), 0
            elif s == IN_SPACE and kind is not None:
                nxt, out = kind, 0  # the space belongs to what follows
            elif s == BLANKS_S and kind is not None:
                nxt, out = kind, BEFORE  # all but the last space were a pre-token
            elif s == BLANKS_B and kind is not None:
                nxt, out = open_with(c), HERE | BEFORE
            elif s == QUOTED:
                if c == STMD:
                    nxt, out = SHUT, 0
                elif c in (R, V, L):
                    nxt, out = {R: Q_R, V: Q_V, L: Q_L}[c], 0
                elif c in (OTHER, QUOTE):
                    nxt, out = REST, 0
            elif s in (Q_R, Q_V, Q_L):
                if (s in (Q_R, Q_V) and c == E) or (s == Q_L and c == L):
                    nxt, out = SHUT, 0
                elif kind == WORD:
                    nxt, out = WORD, BEFORE
                else:
                    nxt, out = open_with(c), HERE | BEFORE
            to[c, s], say[c, s] = nxt, out
    return to, say


NEXT, SAY = compile_pattern()


@lru_cache(1)
def class_table() -> np.ndarray:
    """The class of each code point."""
    out = np.full(0x110000, OTHER, dtype=np.uint8)
    for i in range(0x110000):
        k = unicodedata.category(chr(i))[0]
        if k == "L":
            out[i] = LETTER
        elif k == "N":
            out[i] = NUMBER
    # Unicode White_Space.
    for i in (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000):
        out[i] = BLANK
    out[0x20] = SPACE
    for x, c in (("'", QUOTE), ("s", STMD), ("t", STMD), ("m", STMD), ("d", STMD), ("r", R), ("v", V), ("l", L), ("e", E)):
        out[ord(x)] = c
    return out


def compose(maps: np.ndarray) -> np.ndarray:
    """Inclusive prefix composition of state maps (one row each), by doubling: row i becomes maps[i] after ... after maps[0]."""
    maps = maps.copy()
    n, step = len(maps), 1
    while step < n:
        maps[step:] = np.take_along_axis(maps[step:], maps[:-step].astype(np.intp), axis=1)
        step *= 2
    return maps


def settling() -> int:
    """The number of characters after which the state no longer depends on where the transducer started."""
    images, k = {tuple(range(SHUT + 1))}, 0
    while any(len(x) > 1 for x in images):
        images, k = {tuple(sorted({int(NEXT[c, s]) for s in x})) for x in images for c in range(CLASSES)}, k + 1
    return k


SETTLED = settling()


def annotations(classes: np.ndarray) -> np.ndarray:
    """The transducer's annotation at each character, from START: chunk maps, their prefix scan, and a sweep from known states.

    All start states are followed for the first SETTLED characters of a chunk only; from there a map has one value.
    """
    n = len(classes)
    pad = -n % CHUNK
    grid = np.concatenate((classes, np.full(pad, END, np.uint8))).reshape(-1, CHUNK).T.astype(np.intp) * STATES
    flat_next, flat_say = NEXT.reshape(-1).astype(np.intp), SAY.reshape(-1)
    maps = np.broadcast_to(np.arange(STATES), (grid.shape[1], STATES)).copy()
    for row in grid[:SETTLED]:
        maps = flat_next.take(maps + row[:, None])
    state = maps[:, START]
    for row in grid[SETTLED:]:
        state = flat_next.take(state + row)
    maps = np.broadcast_to(state[:, None], maps.shape).astype(np.uint8)
    state = np.concatenate(([START], compose(maps)[:-1, START])).astype(np.intp)
    out = np.empty((CHUNK, grid.shape[1]), dtype=np.uint8)
    for j, row in enumerate(grid):
        at = row + state
        out[j] = flat_say.take(at)
        state = flat_next.take(at)
    return out.T.reshape(-1)[:n]


def byte_symbols() -> dict[str, int]:
    """The printable stand-ins of bytes in byte-level vocabularies: printable Latin-1 stands for itself, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def merger(spec: dict):
    """A function from a pre-token to the number of tokens that the vocabulary's merges leave of it."""
    import tiktoken

    symbols = byte_symbols()
    as_bytes = lambda x: bytes(symbols[c] for c in x)
    ranks = {bytes([b]): b for b in range(256)}
    for i, m in enumerate(spec["model"]["merges"]):
        ranks.setdefault(as_bytes("".join(m.split(" ") if isinstance(m, str) else m)), 256 + i)
    encoding = tiktoken.Encoding("compiled", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
    return lambda x: len(encoding.encode_ordinary(x))


class Arcs(dict):
    """pre-token -> tokens it emits, compiled when first asked for."""

    def __init__(self, merge):
        super().__init__()
        self.merge = merge

    def __missing__(self, token: str) -> int:
        n = self[token] = self.merge(token)
        return n


class Transducer:
    """A compiled tokenizer: counts the tokens of texts."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        pre = spec.get("pre_tokenizer") or {}
        if spec["model"]["type"] != "BPE" or spec["model"].get("ignore_merges") or pre.get("type") != "ByteLevel" or not pre.get("use_regex", True) or pre.get("add_prefix_space") or spec.get("normalizer"):
            raise ValueError("only byte-level BPE with the standard splitting pattern is compiled")
        special = sorted((x["content"] for x in spec.get("added_tokens", [])), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.arcs = Arcs(merger(spec))
        self.classes = class_table()

    def count(self, texts: list[str | None]) -> np.ndarray:
        out = np.zeros(len(texts), dtype=np.int64)
        batch: list[str] = []
        owner: list[int] = []
        size = 0
        for i, text in enumerate(texts):
            parts = [text or ""]
            if self.special and "<" in parts[0] and self.special.search(parts[0]):
                parts = self.special.split(parts[0])
                out[i] += len(parts) - 1
            for part in parts:
                if part:
                    batch.append(part)
                    owner.append(i)
                    size += len(part)
            if size >= PIECE_CHARS:
                self._add(batch, owner, out)
                batch, owner, size = [], [], 0
        self._add(batch, owner, out)
        return out

    def _add(self, batch: list[str], owner: list[int], out: np.ndarray) -> None:
        if not batch:
            return
        joined = "\0".join(batch) + "\0"
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        lengths = np.fromiter(map(len, batch), np.int64, len(batch))
        ends = np.cumsum(lengths + 1) - 1
        classes = self.classes.take(points)
        classes[ends] = END
        said = annotations(classes)
        starts = (said & HERE).astype(bool)
        starts[:-1] |= (said[1:] & BEFORE).astype(bool)
        starts[ends] = True  # what ends the row before; taken out below
        at = np.flatnonzero(starts)
        own = classes[at] != END
        cut = at.tolist()
        tokens = [joined[a:b] for a, b, keep in zip(cut, cut[1:] + [len(joined)], own.tolist(), strict=True) if keep]
        if len(self.arcs) > ARCS:
            self.arcs.clear()
        emitted = np.fromiter(map(self.arcs.__getitem__, tokens), np.int64, len(tokens))
        sums = np.concatenate(([0], np.cumsum(emitted)))
        place = np.searchsorted(at[own], ends)
        per = sums[place] - sums[np.concatenate(([0], place[:-1]))]
        np.add.at(out, np.array(owner), per)


@lru_cache(2)
def transducer(path: str) -> Transducer:
    return Transducer(path)


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of docs (doc_id, text). tokenizer: path of the JSON file on the workers."""
    ship(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(tokenizer)
        for b in batches:
            texts = b.column("text")
            n = t.count(texts.to_pylist())
            size = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), size, pa.array(n)], names=["doc_id", "n_bytes", "n_tokens"])

    counted = docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op2_token_counts(spark, sf_dir: str) -> DataFrame:
    """Every document with its bytes and its tokens in the 50k byte-level vocabulary."""
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))
