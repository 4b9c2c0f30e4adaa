"""Packing of documents into windows of WINDOW tokens: minimum bin slack over the lengths that are left.

A document's ids, closed by END, give full windows of their own and a rest below WINDOW. Only the number of rests of each length
matters for the plan, so it is drawn up from one histogram of at most WINDOW - 1 counts, however many documents there are: the
longest rest left opens a window, and a dynamic programme over a bitset of reachable sums picks the multiset of lengths that comes
closest to what is left of it; backtracking through the bitsets gives how many of each length. A window's multiset is used as often
as its counts allow (a rare length does not limit the windows of frequent ones). Slack that no rest fits is filled by the start of the
shortest longer rest, whose end stays as a rest of its own. The last tokens, fewer than WINDOW, go to windows that are powers of two. So no window is padded, and only the rests that close
a slack are cut.

The plan says for each length which numbers of it go to which windows. Rests of a length are numbered by task (each task numbers its
own, the totals of tasks give the bases), so a document finds its pieces from its number alone; ids never leave their row.

Cases: null and empty texts are one END; rows that repeat a doc_id or have none are documents of their own; texts of any length are
tokenised whole; equal lengths are told apart by their number, which follows the order of the input's files; an empty table gives no
pieces. Other columns are not read, whatever their names. Strings of special tokens inside a text are what the library makes of them.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import IS_SPACE, LOWER, partition_key, pieces, ship, stored, table

TOKENIZER = "word_bpe_49k.json"
END = 1
WINDOW = 2048
BATCH_BYTES = 4 << 20
MEMO = 300_000
#: Rests of a length that are so many times fewer than the most frequent one do not hold up its windows.
MANY = 16
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".,;:!?"]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


# Ids of texts


#: Stands for the end of a word in the merges of _encoder; parts that hold it themselves are left to the library.
_CLOSE = "\0"
_PLAIN = re.compile("[a-zA-Z\xc0-\xd6\xd8-\xf6\xf8-\xff]+")


@lru_cache(2)
def _encoder(path: str):
    """The library's encoder, one of single words, and a memo.

    A part of Latin letters only is one word of the tokenizer: its letters in lower case, joined by the vocabulary's merges, the last one
    marked. Those merges run in a library of merges by rank; all else (digits, marks, other letters, special tokens) in the library that
    defines the ids."""
    import tiktoken
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    model = json.loads(library.to_str())["model"]
    end = model["end_of_word_suffix"]
    # Byte-level spelling: printable Latin-1 characters are their own bytes, the others follow from 256 on.
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(sorted(set(range(256)) - set(shown)))}
    raw = lambda token: bytes(byte[c] for c in token.removesuffix(end)) + (_CLOSE.encode() if token.endswith(end) and token != end else b"")
    close = _CLOSE.encode()
    order = [bytes([b]) for b in range(256)] + [bytes([b]) + close for b in range(256)]
    order += [raw("".join(m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
    ranks = {token: k for k, token in enumerate(dict.fromkeys(order))}
    ids = {raw(t): i for t, i in model["vocab"].items()}
    merge = tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    of_rank = [ids.get(token, -1) for token in ranks]
    memo: dict[str, bytes] = {}
    return library, merge, of_rank, memo


def _ids(parts: list[str], path: str) -> list[bytes]:
    """The ids of each part (16-bit), each distinct part encoded once."""
    library, merge, of_rank, memo = _encoder(path)
    new = [x for x in parts if x not in memo]
    if len(memo) + len(new) > MEMO:
        memo.clear()
        new = parts
    odd = []
    for x in new:
        if _PLAIN.fullmatch(x):
            memo[x] = array("H", [of_rank[k] for k in merge(x.lower() + _CLOSE)]).tobytes()
        else:
            odd.append(x)
    for x, e in zip(odd, library.encode_batch_fast(odd, add_special_tokens=False), strict=True):
        memo[x] = array("H", e.ids).tobytes()
    return [memo[x] for x in parts]


def encode(data: np.ndarray, offsets: np.ndarray, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the rows, each closed by END, end to end, and the rows' offsets in them.

    The tokenizer drops white space, lowers letters and never joins across white space or from a letter to a mark of _STOP, so parts
    between those are encoded, in lower case where neither a composed letter nor a special token can depend on the case.
    """
    word = ~IS_SPACE[data]
    first, stop = word.copy(), word & _STOP[data]
    first[1:] &= ~word[:-1]
    letter = _LETTER[data]
    letter[1:] |= (data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)
    stop[1:] &= letter[:-1]
    stop[:1] = False
    at = offsets[:-1][offsets[:-1] < len(data)]
    first[at] = word[at]
    starts = np.flatnonzero(first | stop)
    of_row = np.searchsorted(starts, offsets)
    inked = np.concatenate(([0], np.cumsum(word, dtype=np.int32)))
    bounds = np.append(inked[starts], inked[-1]).astype(np.int64)
    # Bytes above 0xC3 may begin a combining mark or a letter whose composition depends on the case; "<|" may begin a special token.
    fixed = data > 0xC3
    fixed[:-1] |= (data[:-1] == 0x3C) & (data[1:] == 0x7C)
    kept = np.diff(np.concatenate(([0], np.cumsum(fixed, dtype=np.int32)))[np.append(starts, len(data))]) > 0
    own = data[word]
    letters = np.where(np.repeat(kept, np.diff(bounds)), own, LOWER[own])
    parts = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(letters))).dictionary_encode()
    ids = _ids(parts.dictionary.to_pylist(), path)
    codes = parts.indices.to_numpy(zero_copy_only=False)
    sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 2
    begin, n = np.cumsum(sizes) - sizes, sizes[codes]
    ends = np.cumsum(n)
    flat = np.frombuffer(b"".join(ids), np.uint16)[np.repeat(begin[codes] - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)]
    cut = np.concatenate(([0], ends))[of_row]
    return np.insert(flat, cut[1:], END), cut + np.arange(len(cut))


def tokenised(docs: DataFrame, path: str, window: int = WINDOW) -> DataFrame:
    """doc_id, ids (16-bit, little-endian), task, full (full windows), first (the task's full windows before), rest, number (of the task's rows with that rest before)."""
    ship(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, windows, seen = partition_key(), 0, np.zeros(window, np.int64)
        for batch in batches:
            for lo, hi, data, offsets in pieces(batch.column("text"), BATCH_BYTES):
                flat, at = encode(data, offsets, path)
                size = np.diff(at)
                full, rest = size // window, size % window
                order = np.argsort(rest, kind="stable")
                number = np.empty(hi - lo, np.int64)
                number[order] = np.arange(hi - lo) - np.searchsorted(rest[order], rest[order])
                number += seen[rest]
                seen += np.bincount(rest, minlength=window)
                first = windows + np.cumsum(full) - full
                windows += int(full.sum())
                raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), hi - lo, [None, pa.py_buffer((at * 2).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(flat.astype("<u2")))]).cast(pa.binary())
                longs = [pa.array(x.astype(np.int64)) for x in (np.full(hi - lo, task), full, first, rest, number)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), raw, *longs], names=["doc_id", "ids", "task", "full", "first", "rest", "number"])

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {kind}, ids binary, task long, full long, first long, rest long, number long")


# The plan


def fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of lengths, at most counts[l] of length l, whose sum is the largest that room holds: length -> how many."""
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for length in sorted((x for x in counts if x <= room and counts[x] > 0), reverse=True):
        left, k = min(counts[length], room // length), 1
        while left > 0:
            k = min(k, left)
            steps.append((length, k, reach))
            reach |= (reach << (length * k)) & mask
            left -= k
            k *= 2
        if reach >> room:
            break
    total, used = reach.bit_length() - 1, {}
    for length, k, before in reversed(steps):
        if not before >> total & 1:
            used[length] = used.get(length, 0) + k
            total -= length * k
    return used


class Plan:
    """Where the rests go: for each length, ranges of its numbers with the windows, places and cuts that they get."""

    #: length, first number, first window, numbers a window, place of the first, tokens taken, first number of the ends left (of length - taken).
    COLUMNS = 7

    def __init__(self, histogram: dict[int, int], window: int = WINDOW) -> None:
        counts = {k: n for k, n in histogram.items() if n > 0}
        made = dict(counts)  # numbers given out in each length, by documents and by cuts
        done: dict[int, int] = {}
        rows: list[tuple[int, ...]] = []
        self.windows = self.steps = 0
        total = sum(k * n for k, n in counts.items())
        while total:
            if total >= window:
                need, cut, room, times = self._filled(counts, window, max(counts))
                most = max(counts.values())
                if cut and most >= MANY and times * MANY < most:
                    # A few rests must not keep the frequent lengths waiting: those fill windows among themselves.
                    often = {k: n for k, n in counts.items() if n * MANY >= most}
                    if sum(k * n for k, n in often.items()) >= window:
                        need, cut, room, times = self._filled(often, window, max(often))
            else:
                need, cut, room, times = self._filled(counts, 1 << (total.bit_length() - 1))
                times = 1
            place = 0
            for k, n in need.items():
                rows.append((k, done.get(k, 0), self.windows, n, place, k, 0))
                done[k] = done.get(k, 0) + n * times
                counts[k] -= n * times
                place += k * n
            if cut:
                end = cut - room
                rows.append((cut, done.get(cut, 0), self.windows, 1, place, room, made.get(end, 0)))
                done[cut] = done.get(cut, 0) + times
                counts[cut] -= times
                made[end] = made.get(end, 0) + times
                counts[end] = counts.get(end, 0) + times
                place += room
            counts = {k: n for k, n in counts.items() if n}
            total -= place * times
            self.windows += times
            self.steps += 1
        found = np.array(sorted(rows), np.int64).reshape(-1, self.COLUMNS)
        self.lengths, firsts = np.unique(found[:, 0], return_index=True)
        self.begin = np.append(firsts, len(found))
        self.rows = found

    @staticmethod
    def _filled(counts: dict[int, int], size: int, opening: int = 0) -> tuple[dict[int, int], int, int, int]:
        """How many of each length fill a window of that size (opened by one of a given length), the length to cut for the slack (0: none), the slack, and how often."""
        need, room = ({opening: 1}, size - opening) if opening else ({}, size)
        for k, n in fill({k: n - need.get(k, 0) for k, n in counts.items()}, room).items():
            need[k] = need.get(k, 0) + n
            room -= k * n
        cut = min((k for k, n in counts.items() if k > room and n > need.get(k, 0)), default=0) if room else 0
        times = min(counts[k] // (need.get(k, 0) + (k == cut)) for k in {*need, cut} if k)
        return need, cut, room, times

    def pieces(self, length: np.ndarray, number: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """For rests given by length and number, in rounds: which rest, its tokens before, tokens taken, window, place."""
        row, before = np.arange(len(length)), np.zeros(len(length), np.int64)
        length, number = length.astype(np.int64), number.astype(np.int64)
        while len(row):
            at = np.empty(len(row), np.int64)
            group = np.searchsorted(self.lengths, length)
            order = np.argsort(group, kind="stable")
            bounds = np.flatnonzero(np.diff(group[order], prepend=-1))
            for s, e in zip(bounds.tolist(), [*bounds[1:].tolist(), len(order)], strict=True):
                g, own = int(group[order[s]]), order[s:e]
                lo, hi = int(self.begin[g]), int(self.begin[g + 1])
                at[own] = lo + np.searchsorted(self.rows[lo:hi, 1], number[own], side="right") - 1
            _, first, window, each, place, taken, ends = self.rows[at].T
            instance, slot = np.divmod(number - first, each)
            yield row, before, taken, window + instance, place + slot * taken
            left = length > taken
            row, before, number, length = row[left], (before + taken)[left], (ends + instance)[left], (length - taken)[left]


# Pieces of documents


def packed(docs: DataFrame, path: str, window: int = WINDOW) -> DataFrame:
    """doc_id, start, length, doc_tokens, sequence_id, offset, ids (32-bit, little-endian) for each piece."""
    rows = stored(tokenised(docs, path, window), "tokens")
    kind = dict(rows.dtypes)["doc_id"]
    of_task = rows.groupBy("task", "rest").agg(F.count(F.lit(1)).alias("n"), F.sum("full").alias("windows"))
    earlier = lambda w: w.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    numbers = of_task.select("task", "rest", F.coalesce(F.sum("n").over(earlier(Window.partitionBy("rest"))), F.lit(0)).alias("before"))
    # One row for each task.
    firsts = of_task.groupBy("task").agg(F.sum("windows").alias("w")).select("task", F.coalesce(F.sum("w").over(earlier(Window)), F.lit(0)).alias("windows_before"))
    bases = stored(numbers.join(firsts, "task"), "bases")
    # At most window - 1 rows: the plan needs no more than the histogram.
    plan = Plan({r.rest: r.n for r in of_task.where("rest > 0").groupBy("rest").agg(F.sum("n").alias("n")).collect()}, window)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            full, rest, number, first = (b.column(c).to_numpy() for c in ("full", "rest", "number", "first"))
            short = np.flatnonzero(rest)
            owner = np.repeat(np.arange(len(full)), full)
            part = np.arange(len(owner)) - np.repeat(np.cumsum(full) - full, full)
            found = [(owner, part * window, np.full(len(owner), window), plan.windows + first[owner] + part, np.zeros(len(owner), np.int64))]
            found += [(short[r], full[short[r]] * window + before, taken, where, place) for r, before, taken, where, place in plan.pieces(rest[short], number[short])]
            owner, start, size, where, place = (np.concatenate(x).astype(np.int64) for x in zip(*found, strict=True))
            raw = b.column("ids").to_pylist()
            ids = [np.frombuffer(raw[o], "<u2", n, 2 * s).astype("<u4").tobytes() for o, s, n in zip(owner.tolist(), start.tolist(), size.tolist(), strict=True)]
            total = full * window + rest
            longs = [pa.array(x) for x in (start, size, total[owner], where, place)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(owner)), *longs, pa.array(ids, pa.binary())], names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])

    numbered = rows.join(bases, ["task", "rest"]).select("doc_id", "ids", "full", "rest", (F.col("number") + F.col("before")).alias("number"), (F.col("first") + F.col("windows_before")).alias("first"))
    return numbered.mapInArrow(cut, f"doc_id {kind}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")


def sequences(of: DataFrame) -> DataFrame:
    """The pieces of packed as training rows: sequence_id, length, ids, doc_ids, starts, offsets; a window holds WINDOW pieces at most."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "length", "doc_id", "start", "ids")))
    joined = F.aggregate("parts", F.lit(b""), lambda ids, p: F.concat(ids, p["ids"]))
    got = of.groupBy("sequence_id").agg(parts.alias("parts"))
    return got.select("sequence_id", F.aggregate("parts", F.lit(0).cast("long"), lambda n, p: n + p["length"]).alias("length"), joined.alias("ids"), F.col("parts.doc_id").alias("doc_ids"), F.col("parts.start").alias("starts"), F.col("parts.offset").alias("offsets"))


def op12_packing(spark, sf_dir: str) -> DataFrame:
    """All documents as pieces of packed sequences."""
    import public_tokenizers

    of = packed(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))
    return of.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
