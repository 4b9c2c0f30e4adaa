"""Benchmark decontamination by greedy string tiling.

Texts are compared as lower-case words without the punctuation of PUNCTUATION. Windows of MIN_MATCH words that a
document shares with a test item (Karp-Rabin hashes) are the seeds; seeds on one diagonal join to maximal matches, and the
longest match is marked again and again, cut to what is still unmarked on both sides, until none of MIN_MATCH words is
left. The marked share of the item is its coverage, whatever order its passages come in.

The items are the stated query set: they go to the executors in blocks of at most BLOCK_BYTES, one pass over the documents
for each block, so that what is broadcast has a bound at any number of items. Documents aren't moved.

Cases: null, empty and short texts (under MIN_MATCH words), of documents or items, match nothing; rows are judged one by
one, so repeated rows and null doc_ids keep their rows; no items leave every document clean; other columns stay as they are;
texts of any length are compared whole.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import IS_SPACE, free_name, grouped_offsets, pieces, rolling, ship, table, word_hashes, word_spans

MIN_MATCH = 5
COVERAGE = 0.5
BLOCK_BYTES = 16 << 20
PUNCTUATION = b".,;:!?\"'()[]"

_BETWEEN = IS_SPACE.copy()
_BETWEEN[list(PUNCTUATION)] = True
_FILTER_BITS = 20
_LEAK = "array<struct<item_id:bigint,covered:bigint,words:bigint>>"


def tokens(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For consecutive rows: first row, row after the last, 64-bit word hashes, index of each row's first word."""
    for lo, hi, data, offsets in pieces(pc.utf8_lower(texts)):
        starts, ends, first = word_spans(data, offsets, _BETWEEN)
        yield lo, hi, word_hashes(data, starts, ends), first


class Items:
    """A block of test items: their words, and where each seed occurs in them."""

    def __init__(self, ids: list[int], texts: list[str | None]):
        self.ids, words = [], []
        for lo, hi, hashes, first in tokens(pa.array(texts, pa.string())):
            for i in range(lo, hi):
                own = hashes[first[i - lo] : first[i - lo + 1]]
                if len(own) >= MIN_MATCH and ids[i] is not None:
                    self.ids.append(ids[i])
                    words.append(own)
        self.words = words
        seeds = [rolling(w, MIN_MATCH) for w in words]
        seed = np.concatenate([*seeds, np.zeros(0, np.uint64)])
        item = np.repeat(np.arange(len(words)), [len(s) for s in seeds])
        place = np.concatenate([*[np.arange(len(s)) for s in seeds], np.zeros(0, np.int64)])
        order = np.argsort(seed, kind="stable")
        self.seed, self.item, self.place = seed[order], item[order].astype(np.int64), place[order].astype(np.int64)
        self.filter = np.zeros(1 << _FILTER_BITS, dtype=bool)
        self.filter[self.low(self.seed)] = True

    @staticmethod
    def low(h: np.ndarray) -> np.ndarray:
        return (h & np.uint64((1 << _FILTER_BITS) - 1)).astype(np.int64)

    def seeds(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The shared seeds of a text: places in the text, items, places in the items."""
        maybe = np.flatnonzero(self.filter[self.low(windows)])
        lo, hi = (np.searchsorted(self.seed, windows[maybe], side=x) for x in ("left", "right"))
        times = hi - lo
        at = np.repeat(lo, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        return np.repeat(maybe, times), self.item[at], self.place[at]


def tiles(text: np.ndarray, item: np.ndarray, in_text: np.ndarray, in_item: np.ndarray, least: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """Greedy tiling of an item and a text from their shared windows of least words: (place in item, place in text, length)."""
    order = np.lexsort((in_item, in_text - in_item))
    a, b = in_item[order], in_text[order]
    diagonal = b - a
    breaks = np.concatenate(([0], np.flatnonzero((np.diff(diagonal) != 0) | (np.diff(a) != 1)) + 1, [len(a)]))
    heap = [(-(int(hi - lo) + least - 1), int(a[lo]), int(b[lo])) for lo, hi in zip(breaks[:-1], breaks[1:], strict=True) if hi > lo]
    heapq.heapify(heap)
    item_used, text_used = np.zeros(len(item), bool), np.zeros(len(text), bool)
    out = []
    while heap:
        n, i, j = heapq.heappop(heap)
        n = -n
        used = item_used[i : i + n] | text_used[j : j + n]
        if used.any():
            edges = np.flatnonzero(np.diff(np.concatenate(([True], used, [True])).astype(np.int8)))
            for lo, hi in zip(edges[::2], edges[1::2], strict=True):
                if hi - lo >= least:
                    heapq.heappush(heap, (-int(hi - lo), i + int(lo), j + int(lo)))
        elif np.array_equal(item[i : i + n], text[j : j + n]):
            item_used[i : i + n] = text_used[j : j + n] = True
            out.append((i, j, n))
    return out


def _leaks(items: Items, texts: pa.Array) -> list[list[tuple[int, int, int]]]:
    found: list[list[tuple[int, int, int]]] = [[] for _ in range(len(texts))]
    for lo, hi, words, first in tokens(texts):
        windows = rolling(words, MIN_MATCH)
        at, item, place = items.seeds(windows)
        doc = np.searchsorted(first, at, side="right") - 1
        inside = at + MIN_MATCH <= first[doc + 1] if len(at) else np.zeros(0, bool)
        at, item, place, doc = at[inside], item[inside], place[inside], doc[inside]
        order = np.lexsort((item, doc))
        at, item, place, doc = at[order], item[order], place[order], doc[order]
        cuts = grouped_offsets(doc * len(items.ids) + item)
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a == b:
                continue
            d, k = int(doc[a]), int(item[a])
            text = words[first[d] : first[d + 1]]
            covered = sum(n for _, _, n in tiles(text, items.words[k], at[a:b] - first[d], place[a:b]))
            found[lo + d].append((items.ids[k], covered, len(items.words[k])))
    return found


def item_blocks(benchmark: DataFrame) -> Iterator[Items]:
    """The items in blocks of about BLOCK_BYTES, of which the driver holds one at a time."""
    ids, texts, size = [], [], 0
    for row in benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).toLocalIterator():
        ids.append(row[0])
        texts.append(row[1])
        size += 2 * len(row[1] or "")
        if size >= BLOCK_BYTES:
            yield Items(ids, texts)
            ids, texts, size = [], [], 0
    if ids:
        yield Items(ids, texts)


def with_leaks(docs: DataFrame, benchmark: DataFrame, name: str) -> DataFrame:
    """docs and a column of the items that each row shares tiles with: item_id, covered and all words of the item."""
    spark = docs.sparkSession
    ship(spark)
    rows = docs.withColumn(name, F.array().cast(_LEAK))
    schema = rows.schema
    at = schema.names.index(name)
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("covered", pa.int64()), ("words", pa.int64())]))
    for block in item_blocks(benchmark):
        sent = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for b in batches:
                texts = b.column("text")
                more = _leaks(sent.value, texts)
                before = b.column(at).to_pylist()
                values = [[*(x or []), *({"item_id": i, "covered": c, "words": w} for i, c, w in y)] for x, y in zip(before, more, strict=True)]
                yield b.set_column(at, pa.field(name, kind), pa.array(values, kind))

        rows = rows.mapInArrow(run, schema)
    return rows


def over(leaks, share: float = COVERAGE):
    return F.filter(leaks, lambda x: x["covered"] >= share * x["words"])


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, max_coverage (of any item), item_ids (items covered to COVERAGE or more, ascending), contaminated."""
    rows = with_leaks(docs.select("doc_id", "text"), benchmark, "leaks").drop("text")
    share = F.array_max(F.transform("leaks", lambda x: x["covered"] / x["words"]))
    return rows.select(
        "doc_id", F.coalesce(share, F.lit(0.0)).alias("max_coverage"),
        F.array_sort(F.transform(over(F.col("leaks")), lambda x: x["item_id"])).alias("item_ids"),
        (F.size(over(F.col("leaks"))) > 0).alias("contaminated"),
    )


def op3_decontamination(spark, sf_dir: str) -> DataFrame:
    """Every document with the test items that it holds half of or more."""
    return decontaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without the rows that hold half of a test item or more."""
    name = free_name(docs.columns, "_leaks")
    return with_leaks(docs, table(spark, sf_dir, "benchmark"), name).where(F.size(over(F.col(name))) == 0).drop(name)
