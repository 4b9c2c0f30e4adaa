"""Token-ID output in training order: fixed-stride shards in an order drawn by a keyed Feistel permutation.

Documents are tokenised once (a stored table), closed with an end token and cut to sequences of LENGTH ids, the last one
padded with end tokens. Sequences are numbered densely: each task numbers its own and the totals of tasks give the bases. A keyed
Feistel network over the next even power of two, walked along its cycle until it falls inside, permutes the numbers, so that every
sequence has one global slot and every slot one sequence, with no sort of random keys and no state but the key and the
total. Slots of SHARD sequences form a shard: one row whose payload is slot after slot at a fixed stride, so that a reader
resumes at slot n by shard n // SHARD and byte (n % SHARD) * stride.

Cases: null and empty texts are one sequence of end tokens; rows that repeat a doc_id are documents of their own; a null
doc_id stays null in doc_ids; texts are tokenised whole; an empty table gives no shard. Numbers follow the order of the
input's files; over the same files and split size a rerun gives the same shards. Other columns are not read, whatever
their names.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import mix, partition_key, pieces, ship, stored, table

TOKENIZER = "byte_bpe_50k.tiktoken"
END = 50_256
LENGTH = 512
SHARD = 1024
KEY = 0x5EED
ROUNDS = 6
MEMO = 600_000
#: White space that the splitting pattern may join across spaces and line ends: such texts are tokenised as a whole.
_ODD = r"[\s\pZ\x{85}]{2}|^[\s\pZ\x{85}]|[\s\pZ\x{85}]$|[\t\r\v\f\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{1C}-\x{1F}]"


def feistel(x: np.ndarray, total: int, key: int = KEY) -> np.ndarray:
    """A permutation of 0 .. total - 1."""
    x = x.astype(np.uint64)
    if total <= 1:
        return x
    half = max(1, ((total - 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    keys = mix(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key))

    def once(v: np.ndarray) -> np.ndarray:
        left, right = v >> shift, v & mask
        for k in keys:
            left, right = right, left ^ (mix(right + k) & mask)
        return (left << shift) | right

    out = once(x)
    while (out_of := np.flatnonzero(out >= np.uint64(total))).size:
        out[out_of] = once(out[out_of])
    return out


@lru_cache(2)
def encoder(path: str):
    """Text -> ids, of a file of base64 tokens and ranks."""
    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    encoding = tiktoken.Encoding("ids", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    memo: dict[str, bytes] = {}
    return encoding.encode_ordinary, memo


def encode(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the texts end to end, and the offsets of the texts in them. Each distinct word of a piece is tokenised once."""
    plain, memo = encoder(path)
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    odd = pc.match_substring_regex(texts, _ODD).to_numpy(zero_copy_only=False)
    parts: list[np.ndarray] = [np.zeros(0, np.uint16)] * len(texts)
    for i in np.flatnonzero(odd):
        parts[i] = np.array(plain(texts[int(i)].as_py()), dtype=np.uint16)
    regular = np.flatnonzero(~odd)
    for lo, hi, data, offsets in pieces(texts.take(pa.array(regular)), 16 << 20):
        if not len(data):
            continue
        first = (data == 0x20) | (data == 0x0A)
        first[1:] |= data[:-1] == 0x0A
        first[offsets[:-1][offsets[:-1] < len(data)]] = True
        starts = np.flatnonzero(first)
        bounds = np.append(starts, len(data)).astype(np.int32)
        words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))).dictionary_encode()
        if len(memo) > MEMO:
            memo.clear()
        ids = []
        for w in words.dictionary.to_pylist():
            own = memo.get(w)
            if own is None:
                own = memo[w] = array("H", plain(w)).tobytes()
            ids.append(own)
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 2
        flat = np.frombuffer(b"".join(ids), np.uint16)
        at = np.cumsum(sizes) - sizes
        codes = words.indices.to_numpy(zero_copy_only=False)
        n = sizes[codes]
        ends = np.cumsum(n)
        out = flat[np.repeat(at[codes] - (ends - n), n) + np.arange(int(ends[-1]))]
        cut = np.concatenate(([0], ends))[np.searchsorted(starts, offsets)]
        for i in range(lo, hi):
            parts[regular[i]] = out[cut[i - lo] : cut[i - lo + 1]]
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint16)), np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int64)


def tokenised(docs: DataFrame, path: str, length: int = LENGTH) -> DataFrame:
    """doc_id, task, first (the task's sequences before it), sequences, ids (16-bit, little-endian) for each row of docs."""
    ship(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, before = partition_key(), 0
        for b in batches:
            for lo, hi, data, offsets in pieces(b.column("text"), 16 << 20):
                texts = pa.LargeStringArray.from_buffers(hi - lo, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data)))
                flat, ends = encode(texts, path)
                n = (np.diff(ends) + length) // length
                firsts = before + np.cumsum(n) - n
                before += int(n.sum())
                raw = pa.BinaryArray.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer((ends * 2).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(flat.astype("<u2")))])
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(lo, hi - lo), pa.array(np.full(hi - lo, task, np.int64)), pa.array(firsts.astype(np.int64)), pa.array(n.astype(np.int64)), raw], names=["doc_id", "task", "first", "sequences", "ids"])

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {kind}, task long, first long, sequences long, ids binary")


def shards(docs: DataFrame, path: str, length: int = LENGTH, size: int = SHARD, key: int = KEY) -> DataFrame:
    """A row for each shard: shard, first_slot, n_sequences, stride, doc_ids, parts, n_tokens (lists by slot), payload, sha256."""
    kind = dict(docs.dtypes)["doc_id"]
    rows = stored(tokenised(docs, path, length), "ids")
    tasks = rows.groupBy("task").agg(F.sum("sequences").alias("n"))
    # One row for each task; stored, so that its size is known when the join is planned.
    bases = stored(tasks.select("task", F.coalesce(F.sum("n").over(Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base")), "bases")
    total = int(rows.agg(F.sum("sequences")).first()[0] or 0)
    stride = 2 * length

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.column("sequences").to_numpy()
            owner = np.repeat(np.arange(len(n)), n)
            part = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
            number = b.column("number").to_numpy()[owner] + part
            raw = b.column("ids").to_pylist()
            filler = np.full(length, END, "<u2").tobytes()
            payload, used = [], np.zeros(len(owner), np.int32)
            for i, (o, p) in enumerate(zip(owner.tolist(), part.tolist(), strict=True)):
                own = raw[o][p * stride : (p + 1) * stride]
                used[i] = min(length, len(own) // 2 + 1)
                payload.append(own + filler[len(own) :])
            slot = feistel(number, total, key).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(slot // size), pa.array(slot), b.column("doc_id").take(pa.array(owner)), pa.array(part.astype(np.int32)), pa.array(used), pa.array(payload, pa.binary())], names=["shard", "slot", "doc_id", "part", "n_tokens", "payload"])

    slots = rows.join(bases, "task").select("doc_id", (F.col("base") + F.col("first")).alias("number"), "sequences", "ids").mapInArrow(cut, f"shard long, slot long, doc_id {kind}, part int, n_tokens int, payload binary")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by slot: one row for each shard; a task holds one shard at a time."""
        held: list[pa.RecordBatch] = []

        def close() -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            payload = b"".join(t["payload"].to_pylist())
            one = lambda c: pa.array([t[c].to_pylist()], pa.list_(t[c].type))
            return pa.RecordBatch.from_arrays(
                [t["shard"].combine_chunks()[:1], t["slot"].combine_chunks()[:1], pa.array([len(t)], pa.int64()), pa.array([stride], pa.int64()), one("doc_id"), one("part"), one("n_tokens"), pa.array([payload], pa.binary()), pa.array([hashlib.sha256(payload).hexdigest()])],
                names=["shard", "first_slot", "n_sequences", "stride", "doc_ids", "parts", "n_tokens", "payload", "sha256"],
            )

        for b in batches:
            shard = b.column("shard").to_numpy()
            at = 0
            for to in (*(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)):
                if held and len(shard) and held[-1].column("shard")[0].as_py() != shard[at]:
                    yield close()
                    held = []
                if to > at:
                    held.append(b.slice(at, to - at))
                at = to
        if held:
            yield close()

    schema = f"shard long, first_slot long, n_sequences long, stride long, doc_ids array<{kind}>, parts array<int>, n_tokens array<int>, payload binary, sha256 string"
    # Ranges of shards: the permutation fills them evenly, so their bounds are known without sampling.
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    last = max(1, -(-total // size))
    ranged = slots.repartitionById(n, F.floor(F.col("shard") * n / last).cast("int"))
    return ranged.sortWithinPartitions("shard", "slot").mapInArrow(pack, schema)


def write_shards(rows: DataFrame, path: str) -> None:
    """Write shards as Parquet, one row group a shard, for sequential reads in slot order."""
    rows.sortWithinPartitions("shard").write.option("parquet.block.size", 1 << 20).parquet(path)


def read_slots(rows: DataFrame, first: int, count: int, size: int = SHARD) -> list[np.ndarray]:
    """The sequences of count slots from slot first on: what a resuming reader gets."""
    last = first + count - 1
    found = rows.where(F.col("shard").between(first // size, last // size)).orderBy("shard").select("first_slot", "stride", "payload").collect()
    out = []
    for r in found:
        for i in range(len(r.payload) // r.stride):
            if first <= r.first_slot + i <= last:
                out.append(np.frombuffer(r.payload[i * r.stride : (i + 1) * r.stride], "<u2"))
    return out


def op6_token_output(spark, sf_dir: str) -> DataFrame:
    """All documents as shards of token ids in training order."""
    import public_tokenizers

    return shards(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs as shards of token ids in training order."""
    import public_tokenizers

    return shards(docs, public_tokenizers.path(TOKENIZER))
