"""MinHash near-dedup: DartMinHash signatures of weighted word shingles, banded joining, exact verification, classes.

A document is the multiset of its five-word shingles (ASCII lower case); a shingle's weight is how often it occurs. Each
element owns a region of its weight; darts fall into the unit cells of the regions at hashed ranks, and a signature keeps
the earliest dart of each coordinate (Christiani, "DartMinHash: Fast Sketching for Weighted Sets", 2020), so that two
signatures agree at a coordinate with the probability of their weighted Jaccard similarity.

Cases: documents without words (null, empty, white space) and rows with a null doc_id are classes of their own. Documents
of one to four words have one shingle, all their words. Documents whose words are the same are copies and are joined by a
128-bit digest before any signature is compared. Rows that repeat a doc_id with another text are judged by their own text. Texts
of any length are compared whole. Other columns are ignored, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, free_name, mix, pieces, rolling, ship, stored, word_hashes, word_spans

SHINGLE = 5
COORDINATES = 128
ROWS = 4
SIMILARITY = 0.8
GROUP_ROWS = 2000
#: Buckets of up to SMALL are checked pair by pair; larger ones by their leader and then by prefixes of rare cells.
SMALL = 16
#: Counters of the cells' frequencies, which order them.
SLOTS = 1 << 20
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def weighted_cells(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For consecutive rows: first row, row after the last, sorted 64-bit cells (a shingle's j-th occurrence), offsets of the rows."""
    for lo, hi, data, offsets in pieces(texts):
        data = LOWER[data]
        starts, ends, first = word_spans(data, offsets)
        n = np.diff(first)
        words = word_hashes(data, starts, ends)
        shingles = rolling(words, SHINGLE)
        doc = np.repeat(np.arange(hi - lo), n)
        inside = np.zeros(len(shingles), bool)
        if len(shingles):
            inside = doc[: len(shingles)] == doc[SHINGLE - 1 :]
        short = np.flatnonzero((n > 0) & (n < SHINGLE))
        own = np.array([rolling(words[first[i] : first[i + 1]], int(n[i]))[0] for i in short], dtype=np.uint64)
        value = np.concatenate((shingles[inside], own))
        doc = np.concatenate((doc[: len(shingles)][inside], short))
        order = np.lexsort((value, doc))
        value, doc = value[order], doc[order]
        if len(value):
            again = np.zeros(len(value), np.int64)
            same = (value[1:] == value[:-1]) & (doc[1:] == doc[:-1])
            run = np.concatenate(([0], np.where(same, 0, np.arange(1, len(value)))))
            again = np.arange(len(value)) - np.maximum.accumulate(run)
            value = mix(value + again.astype(np.uint64) * _GOLD)
        yield lo, hi, value, np.searchsorted(doc, np.arange(hi - lo + 1))


def _poisson_cdf(width: float) -> np.ndarray:
    top = int(width + 12 * math.sqrt(width) + 20)
    p, total, out = math.exp(-width), 0.0, []
    for i in range(top):
        total += p
        out.append(total)
        p *= width / (i + 1)
    return np.array(out)


def dart_signatures(cells: np.ndarray, offsets: np.ndarray, k: int = COORDINATES) -> np.ndarray:
    """A row of k darts for each document: the earliest at each coordinate; zeros for documents without cells.

    Ranks are taken band after band (doubling from 1/64), and a document is done once all its coordinates are hit, so long
    documents throw darts in the first bands only and the work is about k log k darts for a document of any length.
    """
    n = len(offsets) - 1
    signature = np.zeros(n * k, dtype=np.uint64)
    empty = np.ones(n * k, dtype=bool)
    size = np.diff(offsets)
    doc = np.repeat(np.arange(n), size)
    active = size > 0
    low, width, band = 0.0, 1 / 64, 0
    while active.any():
        keep = active[doc]
        cell, of = (cells, doc) if keep.all() else (cells[keep], doc[keep])
        # Wide bands are for the few documents of a handful of shingles.
        salt = mix(np.array([band + 1], dtype=np.uint64))[0]
        h = mix(cell ^ salt)
        thrown = np.searchsorted(_poisson_cdf(width), (h >> np.uint64(11)).astype(np.float64) / float(1 << 53), side="right")
        hit = np.flatnonzero(thrown)
        times = thrown[hit]
        source = np.repeat(hit, times)
        which = np.arange(len(source)) - np.repeat(np.cumsum(times) - times, times)
        dart = mix(h[source] + (which + 1).astype(np.uint64) * _GOLD)
        at = of[source] * k + (dart % np.uint64(k)).astype(np.int64)
        free = empty[at]
        at, dart = at[free], dart[free]
        # The band's darts in falling order of rank, so that the lowest is the last written.
        order = np.argsort(mix(dart))[::-1]
        at, dart = at[order], dart[order]
        signature[at] = dart
        empty[at] = False
        active = active & empty.reshape(n, k).any(axis=1)
        low, band = low + width, band + 1
        width = low if band > 1 else width
    return signature.reshape(n, k)


def band_keys(signatures: np.ndarray, rows: int = ROWS) -> np.ndarray:
    n, k = signatures.shape
    grouped = signatures.reshape(n, k // rows, rows)
    out = np.zeros(grouped.shape[:2], dtype=np.uint64)
    for j in range(rows):
        out = mix(out + grouped[:, :, j])
    return mix(out + np.arange(k // rows, dtype=np.uint64) * _GOLD)


def _digest(text: str | None) -> bytes:
    return hashlib.blake2b(b" ".join((text or "").encode("utf-8", "surrogatepass").translate(bytes(LOWER)).split()), digest_size=16).digest()


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, own, texts = b.column("doc_id"), b.column("row"), b.column("text")
        digests = pa.array([_digest(x) for x in texts.to_pylist()], pa.binary())
        for lo, hi, cells, offsets in weighted_cells(texts):
            keys = band_keys(dart_signatures(cells, offsets))
            some = np.diff(offsets) > 0
            flat = pa.array(keys[some].reshape(-1).view(np.int64))
            ends = np.concatenate(([0], np.cumsum(np.where(some, keys.shape[1], 0)))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), own.slice(lo, hi - lo), digests.slice(lo, hi - lo), pa.array(some), pa.ListArray.from_arrays(pa.array(ends), flat)], names=["doc_id", "row", "digest", "some", "bands"])


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two sorted cell arrays."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (leader, salt, member with the leader first): pairs at the threshold or above."""
    at, leader = None, np.zeros(0, np.uint64)
    for b in batches:
        groups, salts, ids, firsts = (b.column(x).to_pylist() for x in ("leader", "salt", "doc_id", "is_leader"))
        a_out, b_out = [], []
        for lo, hi, cells, offsets in weighted_cells(b.column("text")):
            for i in range(lo, hi):
                own = np.sort(cells[offsets[i - lo] : offsets[i - lo + 1]])
                if firsts[i] == 0:
                    at, leader = (groups[i], salts[i]), own
                elif at == (groups[i], salts[i]) and similarity(own, leader) >= SIMILARITY:
                    a_out.append(groups[i])
                    b_out.append(ids[i])
        yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], names=["a", "b"])


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those (a, b) of pairs whose texts are similar. A leader b with many members is dealt to several groups, each with its own copy of b's text."""
    n = pairs.groupBy("b").count().select("b", F.ceil(F.col("count") / GROUP_ROWS).alias("parts"))
    dealt = pairs.join(n, "b").select("a", F.col("b").alias("leader"), F.pmod(F.xxhash64("a"), F.col("parts")).alias("salt"))
    members = dealt.join(texts, dealt.a == texts.doc_id).select("leader", "salt", "doc_id", F.lit(1).alias("is_leader"), "text")
    leaders = dealt.select("leader", "salt").distinct().join(texts, F.col("leader") == texts.doc_id).select("leader", "salt", "doc_id", F.lit(0).alias("is_leader"), "text")
    rows = members.unionByName(leaders).repartition("leader", "salt").sortWithinPartitions("leader", "salt", "is_leader")
    return rows.mapInArrow(_verify, "a long, b long")


def components(links: DataFrame, label: str = "cc") -> DataFrame:
    """node, class (smallest node it reaches) of an undirected edge table (a, b): large-star and small-star rounds till nothing changes.

    Every round is a group and a join on the edge table; nothing is gathered on the driver but two counts.
    """
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), label)
    last = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        edges = stored(small.where("u <> v").distinct(), label)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first()
        if now == last:
            break
        last = now
    return edges.groupBy("u").agg(F.min("v").alias("class")).select(F.col("u").alias("node"), "class")


def _slot_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """slot and n: how many cells of the task's texts fall into each slot."""
    counts = np.zeros(SLOTS, np.int64)
    for b in batches:
        for _, _, cells, _ in weighted_cells(b.column("text")):
            counts += np.bincount((cells % np.uint64(SLOTS)).astype(np.int64), minlength=SLOTS)
    at = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], names=["slot", "n"])


def rare_prefixes(cells: np.ndarray, offsets: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, cell, size of the row and largest partner: the prefixes in which similar rows must share a cell.

    Cells are ordered by (common of their slot, cell). Rows of n and m cells with the similarity t share t / (1 + t) (n + m) or more, and all
    of these come at or after the first one they share; at place i of n that allows partners of up to (n - i) (1 + t) / t - n cells.
    """
    size = np.diff(offsets)
    row = np.repeat(np.arange(len(size)), size)
    order = np.lexsort((cells, common[(cells % np.uint64(SLOTS)).astype(np.int64)], row))
    place = np.arange(len(cells)) - np.repeat(offsets[:-1], size)
    n = size[row]
    most = np.floor((n - place) * ((1 + SIMILARITY) / SIMILARITY) - n + 1e-6).astype(np.int64)
    keep = most >= SIMILARITY * n - 1e-6
    return row[keep], cells[order][keep], n[keep], most[keep]


def _prefixes(common: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, cells, offsets in weighted_cells(b.column("text")):
                row, cell, n, most = rare_prefixes(cells, offsets, common)
                of = pa.array(row + lo)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(of), b.column("class").take(of), pa.array(cell.view(np.int64)), pa.array(n), pa.array(most)], names=["doc_id", "class", "cell", "n", "most"])

    return run


def rare_pairs(texts: DataFrame) -> DataFrame:
    """Pairs (a > b) of texts (doc_id, class, text) with different classes: all that can be similar, by the cells that their prefixes share."""
    common = np.zeros(SLOTS, np.uint8)
    counts = texts.select("text").mapInArrow(_slot_counts, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).where("n > 1").toArrow()  # at most SLOTS rows
    common[counts.column("slot").to_numpy()] = np.floor(4 * np.log2(counts.column("n").to_numpy()))
    rows = stored(texts.mapInArrow(_prefixes(common), "doc_id long, class long, cell long, n long, most long"), "prefixes")
    useful = rows.groupBy("cell").agg((F.min("class") < F.max("class")).alias("mixed"), F.bool_or(F.col("most") >= F.col("n")).alias("strong")).where("mixed and strong").select("cell")
    rows = stored(rows.join(useful, "cell", "left_semi"), "mixed")
    # The shorter row of a pair allows the longer one, so it allows its own size as well.
    short = rows.where("most >= n").toDF(*[f"s_{c}" for c in rows.columns])
    fits = (F.col("cell") == F.col("s_cell")) & (F.struct("n", "doc_id") > F.struct("s_n", "s_doc_id")) & (F.col("s_n") <= F.col("most")) & (F.col("n") <= F.col("s_most")) & (F.col("class") != F.col("s_class"))
    return rows.join(short, fits).select(F.greatest("doc_id", "s_doc_id").alias("a"), F.least("doc_id", "s_doc_id").alias("b")).distinct()


def shared(rows: DataFrame) -> DataFrame:
    """Those of rows (doc_id, key) whose key has more than one, with n, the rows of the key."""
    n = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return rows.join(n, "key")


def candidates(members: DataFrame, scores: DataFrame) -> DataFrame:
    """Pairs (a > b) of members (doc_id, key, n): every member with its key's leader, the member of most company; all pairs of keys of up to SMALL."""
    scored = members.join(scores, "doc_id")
    leaders = scored.groupBy("key").agg(F.max_by("doc_id", F.struct("score", -F.col("doc_id"))).alias("other"))
    stars = members.join(leaders, "key").select("doc_id", "other")
    small = members.where(F.col("n") <= SMALL)
    lists = small.groupBy("key").agg(F.collect_list("doc_id").alias("others"))  # at most SMALL entries
    every = small.join(lists, "key").select("doc_id", F.explode(F.filter("others", lambda x: x < F.col("doc_id"))).alias("other"))
    both = stars.where("doc_id <> other").unionByName(every)
    return both.select(F.greatest("doc_id", "other").alias("a"), F.least("doc_id", "other").alias("b")).distinct()


def row_key() -> Column:
    """What tells rows apart: a repeated doc_id with another text is another row."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def classes_of_rows(docs: DataFrame) -> DataFrame:
    """doc_id, row (its row_key), class (a row_key that all near copies share) and class_id (their smallest doc_id) for each row.

    Members of a band bucket are checked against the member that shares most buckets, which is the common original where there
    is one, so a group of any size costs one check for each member; buckets of up to SMALL are checked pair by pair. Large
    buckets whose members are still of several classes are open: of their members, all pairs of two classes that share a rare
    cell where similar texts must share one are checked too, which misses none.
    """
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).withColumn("row", row_key())
    sketches = stored(docs.mapInArrow(_sketch, "doc_id long, row long, digest binary, some boolean, bands array<long>"), "sketch")
    real = sketches.where("some and doc_id is not null")
    copies = stored(real.groupBy("digest").agg(F.min(F.struct("doc_id", "row")).alias("rep")).select("digest", F.col("rep.doc_id").alias("rep"), F.col("rep.row").alias("node")), "copies")
    # The nodes of the links are rows: one row stands for all that have the same words.
    reps = real.join(copies, "digest").where(F.col("row") == F.col("node")).select(F.col("row").alias("doc_id"), F.explode("bands").alias("key")).distinct()
    members = stored(shared(reps), "members")
    scores = members.groupBy("doc_id").agg(F.sum("n").alias("score"))
    texts = docs.select(F.col("row").alias("doc_id"), "text").join(scores, "doc_id", "left_semi")
    texts = stored(texts.groupBy("doc_id").agg(F.min("text").alias("text")), "texts")
    links = stored(verified(stored(candidates(members, scores), "pairs"), texts), "links")
    classes = components(links)
    crowded = stored(members.where(F.col("n") > SMALL).join(classes, F.col("doc_id") == F.col("node"), "left").select("doc_id", "key", F.coalesce("class", "doc_id").alias("class")), "crowded")
    mixed = crowded.groupBy("key").agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low < high").select("key")
    open_ = crowded.join(mixed, "key", "left_semi").select("doc_id", "class").distinct()
    waiting = stored(texts.join(open_, "doc_id").select("doc_id", "class", "text"), "open")
    if not waiting.isEmpty():
        more = stored(verified(stored(rare_pairs(waiting), "rare"), texts), "more")
        classes = components(links.unionByName(more))
    own = copies.join(classes, "node", "left").select("digest", "rep", F.coalesce("class", "node").alias("class"))
    own = stored(own, "own")
    least = own.groupBy("class").agg(F.min("rep").alias("class_id"))
    own = own.join(least, "class").select("digest", F.lit(True).alias("some"), "class", "class_id")
    found = sketches.select("doc_id", "row", "digest", "some").join(own, ["digest", "some"], "left")
    known = F.col("doc_id").isNotNull()
    return found.select("doc_id", "row", F.when(known, F.coalesce("class", "row")).alias("class"), F.when(known, F.coalesce("class_id", "doc_id")).alias("class_id"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id and class_id (the smallest doc_id of its class of near copies) for each row of docs (doc_id, text)."""
    return classes_of_rows(docs).select("doc_id", "class_id")


def op10_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document with its class of near copies (five-word shingles, weighted Jaccard similarity of 0.8 or more)."""
    from .common import table

    return near_duplicates(table(spark, sf_dir, "documents"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the row with the smallest doc_id of each class; rows without a doc_id stay.

    Rows that repeat both doc_id and text stay once, the least by their other columns (of types with an order); a doc_id
    that is repeated with another text is a row of its own.
    """
    row, keep = free_name(docs.columns, "row"), classes_of_rows(docs).where("doc_id is not null")
    keep = keep.groupBy("class").agg(F.min(F.struct("doc_id", "row")).alias("x")).select(F.col("x.row").alias(row)).distinct()
    order = [f.name for f in docs.schema if not re.search("map<|variant", f.dataType.simpleString())]
    tagged = docs.where("doc_id is not null").withColumn(row, row_key())
    kept = tagged.join(keep, row, "left_semi").groupBy(row).agg(F.min_by(F.struct(*docs.columns), F.struct(*order)).alias("_kept")).select("_kept.*")
    return kept.unionByName(docs.where("doc_id is null"))
