"""LM scoring by prediction by partial matching (PPM) with a pretrained byte-context trie.

The model text of a document is its words in ASCII lower case, each closed by a space, and an end symbol. A byte is predicted from
the ORDER bytes before it, which reach back across spaces into the words before (the start of a document counts as ORDER end
symbols). The longest context that training texts hold is asked first; escapes have the probability of method D (half a
count for each distinct symbol), and the symbols that a longer context knows are excluded from the shorter one. Symbols that no
context knows share what is left evenly. A document's score is the sum of its bytes' log10 probabilities.

A byte's probability depends on its ORDER bytes of context and itself alone, one packed key of ORDER + 1 bytes. Blocks of documents are
reduced to their distinct keys with training counts before anything is shuffled; counts are summed by key, every distinct key gets
its code length in the group of its context's last two bytes, and a join takes the code lengths back to the blocks, which
hold their texts compressed. Contexts of one byte or none have at most 65,536 cells, which are all that the driver holds.

The base is a unigram model of the tokens (words and the end): log10((c + 0.1) / (N + 0.1 (V + 1))) summed over them. Words are told apart inside a block by
64-bit hashes and counted over blocks by their bytes.

Documents whose crc32(doc_id) mod 10 is 0 are held out; the model learns from the others. Cases: null and empty texts have one
token, the end; a null doc_id counts as an empty id text, which is held out; rows that repeat a doc_id are documents of their own;
without any training text every symbol has probability 1/256; an empty table gives no rows. Texts of any length are scored whole; equal texts have
equal scores, as held-out or training rows alike; other columns are not read, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, partition_key, prefix_hash, ship, span_hash, stored, table

ORDER = 5
SMOOTH = 0.1
HELD_OUT = 10
#: Text of a block, and of a chunk of it that is worked on at once.
BLOCK_BYTES = 32 << 20
CHUNK_BYTES = 1 << 20
SYMBOLS = 256
END = b"\n"
KEY, WORD, BODY = 0, 1, 2
_LOWER = bytes(LOWER)
_NONE = np.zeros(0, np.int64)


def held_out(doc_id) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % HELD_OUT == 0


def model_text(text: str | None) -> bytes:
    return b" ".join([*(text or "").encode().translate(_LOWER).split(), END])


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The packed key of every byte of model texts laid end to end (context, then the byte, which is lowest), and their lengths."""
    data = np.frombuffer(END * ORDER + (END * (ORDER - 1)).join(texts), np.uint8).astype(np.int64)
    n = len(data) - ORDER
    key = np.zeros(n, np.int64)
    for j in range(ORDER + 1):
        key = (key << 8) | data[j : j + n]
    lengths = np.array([len(x) for x in texts], np.int64)
    return key[np.arange(lengths.sum()) + np.repeat(np.arange(len(texts)) * (ORDER - 1), lengths)], lengths


def tokens(texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Model texts laid end to end, their tokens' hashes, starts and ends, and the token that each text starts with."""
    flat = b"".join(texts)
    data = np.frombuffer(flat, np.uint8)
    ends = np.flatnonzero((data == 32) | (data == 10))
    starts = np.concatenate(([0], ends[:-1] + 1))
    after = np.cumsum([len(x) for x in texts])
    first = np.concatenate(([0], np.searchsorted(ends, after[:-1])))
    return flat, span_hash(prefix_hash(data), starts, ends), starts, ends, first


class Numbers:
    """Numbers for hashes in the order of their chunks, so that a second walk over the same chunks gives the same numbers."""

    def __init__(self):
        self.hashes, self.numbers = np.zeros(0, np.uint64), _NONE

    def of(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of each hash, and where those stand that are new, in the order of their numbers."""
        own, where, back = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.searchsorted(self.hashes, own)
        new = np.ones(len(own), bool)
        inside = at < len(self.hashes)
        new[inside] = self.hashes[at[inside]] != own[inside]
        fresh = len(self.hashes) + np.arange(int(new.sum()))
        self.hashes, self.numbers = np.insert(self.hashes, at[new], own[new]), np.insert(self.numbers, at[new], fresh)
        return self.numbers[np.searchsorted(self.hashes, own)][back], where[new]


def packed(docs: list, texts: list[bytes]) -> bytes:
    """Documents in one value: count, doc_ids, which are null, lengths, texts."""
    none = np.array([i is None for i in docs], np.int64)
    keys = np.array([0 if i is None else i for i in docs], np.int64)
    lengths = np.array([len(x) for x in texts], np.int64)
    return b"".join([np.array([len(docs)], np.int64).tobytes(), keys.tobytes(), none.tobytes(), lengths.tobytes(), *texts])


def unpacked(body: bytes) -> tuple[list, list[bytes]]:
    n = int(np.frombuffer(body, np.int64, 1)[0])
    keys, none, lengths = np.frombuffer(body, np.int64, 3 * n, 8).reshape(3, n)
    ends = 8 + 24 * n + np.cumsum(lengths)
    return [None if x else int(k) for k, x in zip(keys, none, strict=True)], [body[e - k : e] for e, k in zip(ends.tolist(), lengths.tolist(), strict=True)]


def summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with the sums of their counts."""
    key, n = np.concatenate([*keys, _NONE]), np.concatenate([*counts, _NONE])
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    if not len(key):
        return key, n
    cut = np.concatenate(([0], np.flatnonzero(np.diff(key)) + 1))
    return key[cut], np.add.reduceat(n, cut)


class Block:
    """Documents under way to rows (block, kind, at, c, body): distinct keys, distinct words, and compressed chunks of documents."""

    def __init__(self, number: int):
        self.block = number
        self.size, self.chunks = 0, 0
        self.keys: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.numbers, self.words, self.word_counts = Numbers(), [], _NONE

    def rows(self, kind: int, at: np.ndarray, c: np.ndarray, body: list) -> pa.RecordBatch:
        n = len(at)
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, self.block)), pa.array(np.full(n, kind, np.int32)), pa.array(at), pa.array(c), pa.array(body, pa.binary())], names=["block", "kind", "at", "c", "body"])

    def add(self, docs: list, texts: list[bytes], z: zstandard.ZstdCompressor) -> pa.RecordBatch:
        train = np.array([not held_out(i) for i in docs])
        key, lengths = grams(texts)
        coded = pa.array(key).dictionary_encode()
        place = coded.indices.to_numpy()
        self.keys.append(coded.dictionary.to_numpy())
        self.counts.append(np.bincount(place[np.repeat(train, lengths)], minlength=len(self.keys[-1])))
        if sum(map(len, self.keys)) > 4 * len(self.keys[0]) + 500_000:
            key, c = summed(self.keys, self.counts)
            self.keys, self.counts = [key], [c]
        flat, hashes, starts, ends, first = tokens(texts)
        number, new = self.numbers.of(hashes)
        self.words += [flat[starts[i] : ends[i]] or END for i in new.tolist()]
        c = np.bincount(number[np.repeat(train, np.diff(np.append(first, len(number))))], minlength=len(self.words))
        c[: len(self.word_counts)] += self.word_counts
        self.word_counts = c
        self.size += len(flat)
        self.chunks += 1
        return self.rows(BODY, np.array([self.chunks]), np.array([0]), [z.compress(packed(docs, texts))])

    def close(self, step: int = 100_000) -> Iterator[pa.RecordBatch]:
        key, c = summed(self.keys, self.counts)
        for i in range(0, len(key), step):
            yield self.rows(KEY, key[i : i + step], c[i : i + step], [None] * len(key[i : i + step]))
        for i in range(0, len(self.words), step):
            words = self.words[i : i + step]
            yield self.rows(WORD, np.arange(i, i + len(words)), self.word_counts[i : i + step], words)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    z = zstandard.ZstdCompressor(level=1)
    made, block = 0, Block(partition_key() << 24)
    docs, texts, size = [], [], 0
    for b in batches:
        for i, text in zip(b.column("doc_id"), b.column("text"), strict=True):
            docs.append(i.as_py())
            texts.append(model_text(text.as_py()))
            size += len(texts[-1])
            if size >= CHUNK_BYTES:
                yield block.add(docs, texts, z)
                docs, texts, size = [], [], 0
                if block.size >= BLOCK_BYTES:
                    yield from block.close()
                    made += 1
                    block = Block((partition_key() << 24) | made)
    if docs:
        yield block.add(docs, texts, z)
    yield from block.close()


class Level:
    """Counts of one context length: n of (context, symbol); total and distinct symbols of a context."""

    def __init__(self, context: np.ndarray, symbol: np.ndarray, n: np.ndarray):
        pair = (context << 8) | symbol
        order = np.argsort(pair, kind="stable")
        pair, n = pair[order], n[order]
        cut = np.concatenate(([0], np.flatnonzero(np.diff(pair)) + 1)) if len(pair) else np.zeros(0, np.int64)
        self.pair = pair[cut]
        self.n = np.add.reduceat(n, cut) if len(cut) else np.zeros(0, np.int64)
        seen = self.n > 0
        self.pair, self.n = self.pair[seen], self.n[seen]
        of = self.pair >> 8
        cut = np.concatenate(([0], np.flatnonzero(np.diff(of)) + 1)) if len(of) else np.zeros(0, np.int64)
        self.context = of[cut]
        self.total = np.add.reduceat(self.n, cut) if len(cut) else np.zeros(0, np.int64)
        self.distinct = np.diff(np.append(cut, len(of)))
        self.cut = cut

    @staticmethod
    def _get(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        if not len(keys):
            return np.zeros(len(wanted), np.int64)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[at] == wanted, values[at], 0)

    def count(self, context: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        return self._get(self.pair, self.n, (context << 8) | symbol)

    def of(self, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self._get(self.context, self.total, context), self._get(self.context, self.distinct, context)

    def excluded(self, shorter: Level, context: np.ndarray, mask: int) -> np.ndarray:
        """For contexts of this level: the counts that their symbols have one level down."""
        below = shorter.count((self.pair >> 8) & mask, self.pair & 255)
        sums = np.add.reduceat(below, self.cut) if len(self.cut) else np.zeros(0, np.int64)
        return self._get(self.context, sums, context)


def code_lengths(key: np.ndarray, n: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """log10 probabilities of packed keys, given the training counts n of all keys that share their contexts' last two bytes.

    ones: the counts of (byte before, symbol) over the whole corpus, 256 by 256.
    """
    context, symbol = key >> 8, key & 255
    one_context, one_symbol = np.nonzero(ones)
    levels = {1: Level(one_context, one_symbol, ones[one_context, one_symbol]), 0: Level(np.zeros(SYMBOLS, np.int64), np.arange(SYMBOLS), ones.sum(axis=0))}
    for j in range(2, ORDER + 1):
        levels[j] = Level(context & ((1 << (8 * j)) - 1), symbol, n)
    out = np.zeros(len(key))
    waiting = np.arange(len(key))
    gone = np.zeros(len(key), np.int64)  # counts and symbols excluded here, known to the longer context
    gone_symbols = np.zeros(len(key), np.int64)
    for j in range(ORDER, -1, -1):
        c, s = context[waiting] & ((1 << (8 * j)) - 1), symbol[waiting]
        total, distinct = levels[j].of(c)
        hits = levels[j].count(c, s)
        left, fresh = total - gone[waiting], distinct - gone_symbols[waiting]
        found = hits > 0
        out[waiting[found]] += np.log10((2 * hits[found] - 1) / (2 * left[found]))
        escape = ~found & (left > 0)
        out[waiting[escape]] += np.log10(fresh[escape] / (2 * left[escape]))
        if j:
            gone[waiting] = levels[j].excluded(levels[j - 1], c, (1 << (8 * (j - 1))) - 1)
        gone_symbols[waiting] = distinct
        waiting = waiting[~found]
    out[waiting] += np.log10(1 / np.maximum(1, SYMBOLS - gone_symbols[waiting]))
    return out


def _trie(ones: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by the contexts' last bytes: whole groups are resolved together."""
        held = None
        for b in batches:
            b = b if held is None else pa.concat_batches([held, b])
            g = b.column("tail").to_numpy()
            if not len(g):
                continue
            cut = 0 if g[0] == g[-1] else int(np.flatnonzero(g != g[-1])[-1]) + 1
            held = b.slice(cut)
            if cut:
                yield done(b.slice(0, cut))
        if held is not None and held.num_rows:
            yield done(held)

    def done(b: pa.RecordBatch) -> pa.RecordBatch:
        key = b.column("key").to_numpy()
        return pa.RecordBatch.from_arrays([b.column("key"), pa.array(code_lengths(key, b.column("n").to_numpy(), ones))], names=["key", "v"])

    return run


def _score(n_train: int, n_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by block, kind and at: the keys with their code lengths, the words with their counts, the chunks of documents."""
        z = zstandard.ZstdDecompressor()
        at_block, parts, model = None, {KEY: [], WORD: []}, None
        for b in batches:
            block, kind, at, v = (b.column(x).to_numpy() for x in ("block", "kind", "at", "v"))
            cuts = np.concatenate(([0], np.flatnonzero((np.diff(block) != 0) | (np.diff(kind) != 0)) + 1, [len(block)]))
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if lo == hi:
                    continue
                if block[lo] != at_block:
                    at_block, parts, model = block[lo], {KEY: [], WORD: []}, None
                if kind[lo] != BODY:
                    parts[kind[lo]].append((at[lo:hi].copy(), v[lo:hi].copy()))
                    continue
                if model is None:
                    key, length = (np.concatenate(x) for x in zip(*parts[KEY], strict=True))
                    counts = np.concatenate([x for _, x in parts[WORD]])
                    model = (key, length, counts, np.log10((counts + SMOOTH) / (n_train + SMOOTH * (n_words + 1))), Numbers())
                    parts = {KEY: [], WORD: []}
                for body in b.column("body").slice(lo, hi - lo).to_pylist():
                    yield scored_chunk(*unpacked(z.decompress(body)), *model, n_train)

    return run


def scored_chunk(docs: list, texts: list[bytes], key: np.ndarray, length: np.ndarray, counts: np.ndarray, base: np.ndarray, numbers: Numbers, n_train: int) -> pa.RecordBatch:
    own, lengths = grams(texts)
    coded = pa.array(own).dictionary_encode()
    score = np.add.reduceat(length[np.searchsorted(key, coded.dictionary.to_numpy())][coded.indices.to_numpy()], np.cumsum(lengths) - lengths)
    _, hashes, _, _, first = tokens(texts)
    number, _ = numbers.of(hashes)
    known = np.add.reduceat((counts[number] > 0).astype(np.int64), first)
    return pa.RecordBatch.from_arrays(
        [pa.array(docs, pa.int64()), pa.array([held_out(i) for i in docs]), pa.array(np.diff(np.append(first, len(number)))), pa.array(known), pa.array(np.full(len(docs), n_train, np.int64)), pa.array(np.add.reduceat(base[number], first)), pa.array(score)],
        names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    )


def scored(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of docs (doc_id, text)."""
    ship(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    blocks = stored(docs.mapInArrow(_blocks, "block long, kind int, at long, c long, body binary"), "blocks")
    # A word has one row in each block at most; the first of them stands for it.
    same = Window.partitionBy("body")
    words = blocks.where(F.col("kind") == WORD).select("block", "at", F.sum("c").over(same).alias("total"), (F.col("block") == F.min("block").over(same)).alias("first"))
    words = stored(words, "words")
    n_train = blocks.where(F.col("kind") == WORD).agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    n_words = words.agg(F.count_if(F.expr("first and total > 0"))).first()[0]
    asked = blocks.where(F.col("kind") == KEY).select("block", F.col("at").alias("key"), "c")
    keys = stored(asked.groupBy("key").agg(F.sum("c").alias("n")), "keys")
    # Last byte and symbol: at most 256 by 256 cells.
    ones = np.zeros((SYMBOLS, SYMBOLS), np.int64)
    for r in keys.where("n > 0").groupBy(F.shiftright("key", 8).bitwiseAND(F.lit(255)).alias("b"), F.col("key").bitwiseAND(F.lit(255)).alias("s")).agg(F.sum("n").alias("n")).collect():
        ones[r.b, r.s] = r.n
    tailed = keys.select("key", "n", F.shiftright("key", 8).bitwiseAND(F.lit(65535)).alias("tail"))
    lengths = tailed.repartition("tail").sortWithinPartitions("tail").mapInArrow(_trie(ones), "key long, v double")
    none = F.lit(None).cast("binary").alias("body")
    answers = asked.join(lengths, "key").select("block", F.lit(KEY).alias("kind"), F.col("key").alias("at"), "v", none)
    counts = words.select("block", F.lit(WORD).alias("kind"), "at", F.col("total").cast("double").alias("v"), none)
    bodies = blocks.where(F.col("kind") == BODY).select("block", "kind", "at", F.lit(0.0).alias("v"), "body")
    rows = answers.unionByName(counts).unionByName(bodies).repartition("block").sortWithinPartitions("block", "kind", "at")
    return rows.mapInArrow(_score(int(n_train), int(n_words)), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op1_lm_score(spark, sf_dir: str) -> DataFrame:
    """Every document with its log10 probability under the trie model and under the unigram base."""
    return scored(table(spark, sf_dir, "documents"))
