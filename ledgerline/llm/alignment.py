"""Alignment of two tokenizers: where their tokens end at the same byte, which ids meet there, and how often those ids meet in the corpus.

Tokenizer A reads a space and the text, tokenizer B (a piece model that puts a space before a text itself) the text, so both spell the
same bytes. A whole batch of texts is one run of bytes: the lengths of its tokens, summed within each document from the document's
own byte offset, give the ends of all tokens; one bincount of A's ends and one of B's over the batch show where both occur; the batch
is cut there, and differences of prefix sums at the documents' offsets give each document's groups and links. Tokens are never empty,
so at a shared end one token of A meets one of B: a link.

Texts are encoded by the parts that begin at a space: neither tokenizer joins symbols across the start of a run of spaces if no other
white space touches it, so each distinct part of a batch is encoded once. Texts with other runs of white space, at their ends or
inside, are encoded whole, and so is a text of which a part does not spell its own bytes.

Corpus-wide counts: a batch task closes a block every BLOCK_BYTES of text and stores the block's distinct pairs beside the
documents' own; the pairs of blocks are summed by pair, the highest count of each B id is taken, and both go back to the blocks that
hold the pair, never to single links. A block's documents then meet the block's pairs in one group of bounded size. No table of the
vocabularies' product is broadcast.

Cases: null and empty texts, and texts whose tokens spell other bytes than a space and the text (they hold U+2581), have no tokens:
zeros and an empty digest. Rows that repeat a doc_id or have none are documents of their own. Texts of any length are encoded whole; a
text longer than a batch is a batch of its own. Ties: all A ids whose pair reaches the highest count of a B id are best. An empty table
gives no rows; other columns are not read, whatever their names. Strings of special tokens are plain text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partition_key, pieces, ship, stored, table
from .token_output import encoder

BYTE_LEVEL = "byte_bpe_50k.tiktoken"  # the ids of byte_bpe_50k.json, as ranks
PIECES = "piece_bpe_32k.model"
BATCH_BYTES = 2 << 20
BLOCK_BYTES = 16 << 20
MEMO = 150_000
LONG = 100
#: White space other than single spaces and line ends inside a text: it is encoded whole.
_ODD = r"[\s\pZ\x{85}]{2}|^[\s\pZ\x{85}]|[\s\pZ\x{85}]$|[\t\r\v\f\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{1C}-\x{1F}]"


class Pair:
    """Both tokenizers: the ids of a part, the byte lengths of ids, and the spellings of ids in a digest."""

    def __init__(self, a_path: str, b_path: str) -> None:
        import base64

        import sentencepiece

        self.plain = encoder(a_path)[0]
        self.model = sentencepiece.SentencePieceProcessor(model_file=b_path)
        spelled = {int(rank): len(base64.b64decode(token)) for token, rank in map(bytes.split, open(a_path, "rb"))}
        self.n_a, self.n_b = max(spelled) + 1, self.model.get_piece_size()
        self.a_len = np.zeros(self.n_a, np.int32)
        self.a_len[list(spelled)] = list(spelled.values())
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(map(self.model.id_to_piece, range(self.n_b)))]
        self.b_len = np.array(list(map(len, self.b_bytes)), np.int32)
        if self.n_a * self.n_b >= 1 << 32:
            raise ValueError("a pair of ids must fit 32 bits")
        names = [f"{i}{end}" for n, ends in ((self.n_a, ",|"), (self.n_b, ",;")) for i in range(n) for end in ends]
        self.names = pa.array(names, pa.large_string())
        self.memo: dict[str, tuple[np.ndarray, np.ndarray, bool]] = {}

    def of(self, part: str) -> tuple[np.ndarray, np.ndarray, bool]:
        """A's ids, B's ids, and whether B's spell the part, which begins with a space."""
        found = self.memo.get(part)
        if found is None:
            b = self.model.encode(part[1:], num_threads=1)
            raw = part.encode()
            found = np.array(self.plain(part), np.int32), np.array(b, np.int32), b"".join(map(self.b_bytes.__getitem__, b)) == raw
            if len(raw) <= LONG:
                if len(self.memo) >= MEMO:
                    self.memo.clear()
                self.memo[part] = found
        return found


@lru_cache(2)
def pair(a_path: str, b_path: str) -> Pair:
    return Pair(a_path, b_path)


def _taken(of: list[np.ndarray], codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """of[c] for each c of codes end to end, and their sizes."""
    sizes = np.fromiter(map(len, of), np.int64, len(of))
    at, n = np.cumsum(sizes) - sizes, sizes[codes]
    ends = np.cumsum(n)
    flat = np.concatenate([*of, np.zeros(0, np.int32)])
    return flat[np.repeat(at[codes] - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)], n


def _encoded(p: Pair, data: np.ndarray, offsets: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids of A and B of all rows (each a space and its text, or nothing), and the offsets of rows in both. whole: rows encoded as one part."""
    n = len(offsets) - 1
    first = data == 0x20
    first[1:] &= data[:-1] != 0x20
    for r in np.flatnonzero(whole):
        first[offsets[r] : offsets[r + 1]] = False
    first[offsets[:-1][np.diff(offsets) > 0]] = True
    starts = np.flatnonzero(first)
    bounds = np.append(starts, len(data)).astype(np.int64)
    parts = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))).dictionary_encode()
    found = [p.of(x) for x in parts.dictionary.to_pylist()]
    codes = parts.indices.to_numpy(zero_copy_only=False)
    of_row = np.searchsorted(starts, offsets)
    ok = np.fromiter((f[2] for f in found), bool, len(found))[codes]
    bad = np.diff(np.concatenate(([0], np.cumsum(~ok)))[of_row]) > 0
    if (bad & ~whole).any():
        return _encoded(p, data, offsets, whole | bad)
    dropped = np.zeros(len(codes), bool)
    for r in np.flatnonzero(bad):
        dropped[of_row[r] : of_row[r + 1]] = True
    out = []
    for side in (0, 1):
        ids, sizes = _taken([f[side] for f in found] + [np.zeros(0, np.int32)], np.where(dropped, len(found), codes))
        out += [ids, np.concatenate(([0], np.cumsum(sizes)))[of_row]]
    return out[0], out[1], out[2], out[3] if n else np.zeros(1, np.int64)


@dataclass
class Aligned:
    """A batch: ids of A and B, the offsets of its rows in both, the group of each token, and for each row its groups and links (ids of A and B)."""

    a: np.ndarray
    a_at: np.ndarray
    b: np.ndarray
    b_at: np.ndarray
    a_group: np.ndarray
    b_group: np.ndarray
    group_at: np.ndarray
    link_at: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray


def align(p: Pair, data: np.ndarray, offsets: np.ndarray, whole: np.ndarray) -> Aligned:
    """Encode a batch and cut it where tokens of both end."""
    a, a_at, b, b_at = _encoded(p, data, offsets, whole)
    size = len(data) + 1

    def ends(ids: np.ndarray, at: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(lengths[ids], dtype=np.int64)))
        return total[1:] + np.repeat(offsets[:-1] - total[at[:-1]], np.diff(at))

    a_end, b_end = ends(a, a_at, p.a_len), ends(b, b_at, p.b_len)
    a_count, b_count = np.bincount(a_end, minlength=size), np.bincount(b_end, minlength=size)
    cut = (a_count > 0) & (b_count > 0)
    groups = np.cumsum(cut, dtype=np.int32)
    links = np.cumsum(a_count * b_count, dtype=np.int32)
    return Aligned(a, a_at, b, b_at, groups[a_end - 1], groups[b_end - 1], groups[offsets], links[offsets], a[cut[a_end]], b[cut[b_end]])


def _digests(p: Pair, x: Aligned) -> list[str]:
    """The sha256 of each row's groups as a1,a2|b1;a3|b2,b3; empty for a row without tokens."""
    n = int(x.group_at[-1])
    in_a, in_b = np.bincount(x.a_group, minlength=n), np.bincount(x.b_group, minlength=n)
    a_before, b_before = np.concatenate(([0], np.cumsum(in_a))), np.concatenate(([0], np.cumsum(in_b)))
    codes = np.empty(len(x.a) + len(x.b), np.int32)
    i, j = np.arange(len(x.a)), np.arange(len(x.b))
    codes[i + b_before[x.a_group]] = 2 * x.a + (i + 1 == a_before[x.a_group + 1])
    codes[j + a_before[x.b_group + 1]] = 2 * (p.n_a + x.b) + (j + 1 == b_before[x.b_group + 1])
    spelled = p.names.take(pa.array(codes))
    at = np.frombuffer(spelled.buffers()[1], np.int64)[(x.a_at + x.b_at)] if len(codes) else np.zeros(len(x.a_at), np.int64)
    raw = memoryview(spelled.buffers()[2] or b"")
    return [hashlib.sha256(raw[s : e - 1]).hexdigest() if e > s else "" for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def _batches(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows of about BATCH_BYTES: first, last, bytes of a space and the text (nothing for null and empty), offsets, rows to encode whole."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    odd = pc.match_substring_regex(texts, _ODD).to_numpy(zero_copy_only=False)
    spaced = pc.if_else(pc.equal(texts, ""), "", pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts, pa.scalar("", pa.large_string())))
    for lo, hi, data, offsets in pieces(spaced, BATCH_BYTES):
        yield lo, hi, data, offsets, odd[lo:hi]


def _binary(values: np.ndarray, at: np.ndarray, kind: str = "<u4") -> pa.Array:
    """values, cut at the offsets at, as one binary a row."""
    raw = np.ascontiguousarray(values.astype(kind))
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer((at * 4).astype(np.int64)), pa.py_buffer(raw)]).cast(pa.binary())


def alignments(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """doc_id, a_ids, b_ids, a_ends, b_ends (tokens of A and B up to the end of each group) for each row of docs."""
    ship(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pair(a_path, b_path)
        for batch in batches:
            for lo, hi, data, offsets, odd in _batches(batch.column("text")):
                x = align(p, data, offsets, odd)
                n = int(x.group_at[-1])
                cells = []
                for group, at in ((x.a_group, x.a_at), (x.b_group, x.b_at)):
                    upto = np.cumsum(np.bincount(group, minlength=n)) - np.repeat(at[:-1], np.diff(x.group_at))
                    cells.append(pa.ListArray.from_arrays(pa.array(x.group_at.astype(np.int32)), pa.array(upto.astype(np.int32))))
                ids = [pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(v)) for v, at in ((x.a, x.a_at), (x.b, x.b_at))]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), *ids, *cells], names=["doc_id", "a_ids", "b_ids", "a_ends", "b_ends"])

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {kind}, a_ids array<int>, b_ids array<int>, a_ends array<int>, b_ends array<int>")


def _linked(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """For each document its sizes, digest and distinct pairs with their times; for each block (is_block) its distinct pairs."""
    ship(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]
    names = ["doc_id", "block", "is_block", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pair(a_path, b_path)
        block, held, of_block = partition_key() << 32, 0, np.zeros((0, 2), np.int64)
        none = lambda k: pa.nulls(1, k)

        def close(id_type: pa.DataType) -> pa.RecordBatch:
            one = np.array([0, len(of_block)])
            return pa.RecordBatch.from_arrays([none(id_type), pa.array([block]), pa.array([True]), *[none(pa.int64())] * 4, none(pa.string()), _binary(of_block[:, 0], one), _binary(np.minimum(of_block[:, 1], (1 << 32) - 1), one)], names=names)

        id_type = None
        for batch in batches:
            id_type = batch.column("doc_id").type
            for lo, hi, data, offsets, odd in _batches(batch.column("text")):
                x = align(p, data, offsets, odd)
                key = x.link_a.astype(np.uint64) * np.uint64(p.n_b) + x.link_b.astype(np.uint64)
                row = np.repeat(np.arange(hi - lo, dtype=np.uint64), np.diff(x.link_at))
                both, times = np.unique((row << np.uint64(32)) | key, return_counts=True)
                at = np.searchsorted(both, np.arange(hi - lo + 1, dtype=np.uint64) << np.uint64(32))
                keys = (both & np.uint64(0xFFFFFFFF)).astype(np.int64)
                size = lambda v: pa.array(np.diff(v).astype(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(lo, hi - lo), pa.array(np.full(hi - lo, block, np.int64)), pa.array(np.zeros(hi - lo, bool)), size(x.a_at), size(x.b_at), size(x.group_at), size(x.link_at), pa.array(_digests(p, x)), _binary(keys, at), _binary(times, at)],
                    names=names,
                )
                joined = np.concatenate((of_block, np.stack((keys, times), axis=1)))
                values, where = np.unique(joined[:, 0], return_inverse=True)
                sums = np.zeros(len(values), np.int64)
                np.add.at(sums, where, joined[:, 1])
                of_block = np.stack((values, sums), axis=1)
                held += len(data)
                if held >= BLOCK_BYTES:
                    yield close(id_type)
                    block, held, of_block = block + 1, 0, of_block[:0]
        if len(of_block):
            yield close(id_type)

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {kind}, block long, is_block boolean, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary")


def _block_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block, pairs, times in zip(batch.column("block").to_pylist(), batch.column("pairs").to_pylist(), batch.column("times").to_pylist(), strict=True):
            key = np.frombuffer(pairs, "<u4").astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), block)), pa.array(key), pa.array(np.frombuffer(times, "<u4").astype(np.int64))], names=["block", "pair", "n"])


def _sums(key, docs: pa.Table, seen: pa.Table) -> pa.Table:
    """The documents of a block with the sums over their links, from the counts of the block's pairs."""
    order = np.argsort(seen["pair"].to_numpy())
    known, count, best = (seen[c].to_numpy()[order] for c in ("pair", "count", "best"))
    keys = np.frombuffer(b"".join(docs["pairs"].to_pylist()), "<u4").astype(np.int64)
    times = np.frombuffer(b"".join(docs["times"].to_pylist()), "<u4").astype(np.int64)
    at = np.concatenate(([0], np.cumsum(pc.binary_length(docs["pairs"]).to_numpy()))) // 4
    where = np.searchsorted(known, keys)
    within = lambda v: pa.array(np.diff(np.concatenate(([0], np.cumsum(v)))[at]).astype(np.int64))
    out = docs.select(["doc_id", "n_a", "n_b", "n_groups", "n_links"])
    return out.append_column("n_best", within(times * best[where])).append_column("count_sum", within(times * count[where])).append_column("groups_sha256", docs["groups_sha256"])


def link_counts(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for each row of docs."""
    kind = dict(docs.dtypes)["doc_id"]
    n_b = pair(a_path, b_path).n_b
    rows = stored(_linked(docs, a_path, b_path), "links")
    pairs = rows.where("is_block").select("block", "pairs", "times").mapInArrow(_block_pairs, "block long, pair long, n long")
    counts = pairs.groupBy("pair").agg(F.sum("n").alias("count")).withColumn("b_id", F.col("pair") % n_b)
    highest = counts.groupBy("b_id").agg(F.max("count").alias("highest"))
    marked = stored(counts.join(highest, "b_id").select("pair", "count", (F.col("count") == F.col("highest")).alias("best")), "pair_counts")
    seen = pairs.select("block", "pair").join(marked, "pair").select("block", "pair", "count", F.col("best").cast("long").alias("best"))
    own = rows.where("not is_block").drop("is_block")
    return own.groupBy("block").cogroup(seen.groupBy("block")).applyInArrow(_sums, f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def op11_token_alignment(spark, sf_dir: str) -> DataFrame:
    """All documents: groups and links of the byte-level and the piece tokenizer."""
    import public_tokenizers

    return link_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_LEVEL), public_tokenizers.path(PIECES))
