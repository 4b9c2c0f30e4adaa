"""Suffix-array dedup: remove bytes inside LENGTH-byte strings that also start earlier in the corpus.

Only suffixes whose first LENGTH bytes hold an anchor that occurs twice can match: in every window of LENGTH bytes the
SEED-byte string with the least hash is its anchor, so equal windows have equal anchors at equal places, and a window whose anchor
is unique has no copy. The places of an anchor meet in one task, each with the bytes that its windows reach, and are compared by
polynomial prefix hashes: the common extension of two places, to the left and to the right, is found by binary search. First
each place is extended against the earliest of its group (ROUNDS times, with the earliest of those that are left); the windows that
found no source so are suffixes for a merge sort, whose comparisons search the common extension in the same way (to
LENGTH bytes, which is what a match means) and then look at the next byte. Equal neighbours are matches. Matches are verified
byte by byte. Anchors of more than CROWD places send their windows through a plain group by the windows' bytes instead, with the same
result, so that no task gets all of them.

Exact copies of a whole text are found by digest first and are no suffixes of their own: all of a copy of LENGTH bytes or
more is covered. The texts are shuffled once, to a bucketed table that later joins read in place.

Cases: null is empty; a null doc_id comes before all others; rows of equal doc_id aren't earlier than one another; texts
shorter than LENGTH bytes lose nothing; matches don't cross texts; an empty table gives no rows; texts of any length are
searched whole; other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import grouped_offsets, pieces, powers, prefix_hash, shared_dir, ship, span_hash, stored, table

LENGTH = 100
SEED = 32
SPAN = LENGTH - SEED + 1
CONTEXT = SPAN - 1 + LENGTH
#: Places of one anchor that a task matches in memory, at about 4 KB each.
CROWD = 40_000
STEP = 2000
ROUNDS = 2
PIECE = 1 << 20
_FIRST = -(1 << 63)


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of texts laid end to end: their hash and place, and the first and last window start that they stand for."""
    none = np.zeros(0, np.int64)
    n = len(data) - SEED + 1
    starts = np.arange(max(0, len(data) - LENGTH + 1))
    if not len(starts):
        return np.zeros(0, np.uint64), none, none, none
    prefix = prefix_hash(data)
    at = np.arange(n)
    seed = span_hash(prefix, at, at + SEED)
    # High half of the hash, then the place: the least value is the leftmost of the least hashes.
    low = (seed & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64)
    width = 1
    while width * 2 <= SPAN:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    low = np.minimum(low[: len(low) - (SPAN - width)], low[SPAN - width :])
    doc = np.searchsorted(offsets, starts, side="right") - 1
    inside = starts + LENGTH <= offsets[doc + 1]
    starts = starts[inside]
    if not len(starts):
        return np.zeros(0, np.uint64), none, none, none
    place = (low[inside] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.concatenate(([True], (place[1:] != place[:-1]) | (starts[1:] != starts[:-1] + 1)))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    return seed[place[first]], place[first], starts[first], starts[last]


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def _squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed for the shuffle."""
    z = zstandard.ZstdCompressor(level=1)
    for b in slices(batches):
        raw = [(x or "").encode() for x in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([hashlib.blake2b(x, digest_size=16).digest() for x in raw], pa.binary()), pa.array([len(x) for x in raw], pa.int64()), pa.array([z.compress(x) for x in raw], pa.binary())], names=["doc_id", "digest", "n_bytes", "body"])


def _texts(bodies: pa.Array) -> pa.Array:
    z = zstandard.ZstdDecompressor()
    return pa.array([z.decompress(x) for x in bodies.to_pylist()], pa.large_binary())


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        rid = b.column("rid").to_numpy()
        texts = _texts(b.column("body")).cast(pa.large_string(), safe=False)
        for lo, hi, data, offsets in pieces(texts, PIECE):
            h, place, first, last = anchors(data, offsets)
            doc = np.searchsorted(offsets, place, side="right") - 1
            packed = ((place - offsets[doc]) << 14) | ((place - first) << 7) | (place - last)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(rid[lo:hi][doc]), pa.array(packed)], names=["h", "rid", "packed"])


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each repeated anchor with the bytes that its windows can reach."""
    z = zstandard.ZstdDecompressor()
    left = SPAN - 1
    for b in batches:
        out: dict[str, list] = {k: [] for k in ("h", "ord", "rid", "packed", "context")}
        found = b.column("found")
        h, packed = (found.flatten().field(k).to_numpy(zero_copy_only=False) for k in ("h", "packed"))
        cut = found.offsets.to_numpy() - found.offsets[0].as_py()
        rid, order, bodies = b.column("rid").to_numpy(), b.column("ord").to_numpy(), b.column("body").to_pylist()
        for i, body in enumerate(bodies):
            text = bytes(left) + z.decompress(body) + bytes(LENGTH)
            own = packed[cut[i] : cut[i + 1]]
            out["h"].append(h[cut[i] : cut[i + 1]])
            out["packed"].append(own)
            out["rid"].append(np.full(len(own), rid[i]))
            out["ord"].append(np.full(len(own), order[i]))
            out["context"].extend(text[p : p + CONTEXT] for p in (own >> 14).tolist())
            if len(out["context"]) > 20_000 or i == len(bodies) - 1:
                yield pa.RecordBatch.from_arrays([*(pa.array(np.concatenate(out[k])) for k in ("h", "ord", "rid", "packed")), pa.array(out["context"], pa.binary())], names=list(out))
                out = {k: [] for k in out}


def _windows(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Contexts as a matrix, the anchors' places, and row and offset of every window that an anchor stands for."""
    context = np.frombuffer(b"".join(b.column("context").to_pylist()), np.uint8).reshape(-1, CONTEXT)
    packed = b.column("packed").to_numpy()
    most, least = (packed >> 7) & 127, packed & 127
    grid = np.arange(SPAN)
    row, offset = np.nonzero((grid >= least[:, None]) & (grid <= most[:, None]))
    return context, packed >> 14, row, offset


def prefixes(context: np.ndarray) -> np.ndarray:
    """Polynomial prefix sums of contexts: the difference of two entries tells the bytes between them apart, at the same place of any context."""
    out = np.zeros((len(context), CONTEXT + 1), np.uint64)
    np.cumsum((context.astype(np.uint64) + np.uint64(1)) * powers(CONTEXT + 1)[0][:CONTEXT], axis=1, out=out[:, 1:])
    return out


def extension(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, at: np.ndarray, limit: int, way: int = 1) -> np.ndarray:
    """How many bytes, limit at most, agree from place at on (way 1) or before it (way -1) in rows i of prefixes a and j of prefixes b."""
    low, high = np.zeros(len(i), np.int64), np.full(len(i), limit)
    from_a, from_b = a[i, at], b[j, at]
    while True:
        wide = low < high
        if not wide.any():
            return low
        mid = (low + high + 1) >> 1
        to = at + way * mid
        same = a[i, to] - from_a == b[j, to] - from_b
        low = np.where(wide & same, mid, low)
        high = np.where(wide & ~same, mid - 1, high)


def shared_windows(context: np.ndarray, own: np.ndarray, source: np.ndarray, most: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first and last offset of the windows that places own and source have in common (first > last: none)."""
    lo, hi = np.zeros(len(own), np.int64), np.zeros(len(own), np.int64)
    for k in range(0, len(own), STEP):
        x, y = own[k : k + STEP], source[k : k + STEP]
        a, b = prefixes(context[x]), prefixes(context[y])
        i, at = np.arange(len(x)), np.full(len(x), SPAN - 1)
        right = extension(a, b, i, i, at, LENGTH)
        left = extension(a, b, i, i, at, SPAN - 1, -1)
        lo[k : k + STEP] = np.maximum(np.maximum(least[x], least[y]), LENGTH - right)
        hi[k : k + STEP] = np.minimum(np.minimum(most[x], most[y]), left)
    return lo, hi


def suffix_sort(prefix: np.ndarray, context: np.ndarray, row: np.ndarray, at: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """The order of suffixes (row, at) inside each run of cuts, whose suffixes all start at one at: a stable merge sort by their first LENGTH bytes."""
    order = np.arange(len(row))
    start = np.repeat(cuts[:-1], np.diff(cuts))
    end = np.repeat(cuts[1:], np.diff(cuts))
    k = np.arange(len(row)) - start
    most, width = int(np.diff(cuts).max(initial=0)), 1
    while width < most:
        run = k // width
        odd = run & 1
        other = start + (run - 2 * odd + 1) * width
        size = np.clip(end - other, 0, width)
        low, high = np.zeros(len(row), np.int64), size.copy()
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                break
            mid = (low[open_] + high[open_]) >> 1
            x, y = order[open_], order[other[open_] + mid]
            i, j, p = row[x], row[y], at[x]
            n = extension(prefix, prefix, i, j, p, LENGTH)
            to = np.minimum(p + n, CONTEXT - 1)
            mine, theirs = context[i, to], context[j, to]
            before = np.where(n == LENGTH, odd[open_] == 1, theirs < mine)  # the sibling goes first; equals keep their order
            low[open_[before]] = mid[before] + 1
            high[open_[~before]] = mid[~before]
        place = start + (run - odd) * width + (k - run * width) + low
        merged = np.empty_like(order)
        merged[place] = order
        order = merged
        width *= 2
    return order


def _match_group(b: pa.RecordBatch) -> pa.RecordBatch:
    """Whole groups of equal anchors: the spans that earlier texts also hold."""
    context = np.frombuffer(b"".join(b.column("context").to_pylist()), np.uint8).reshape(-1, CONTEXT)
    h, packed, order, rid = (b.column(c).to_numpy() for c in ("h", "packed", "ord", "rid"))
    by = np.lexsort((packed >> 14, rid, order, h))
    context, h, packed, order, rid = context[by], h[by], packed[by], order[by], rid[by]
    place, most, least = packed >> 14, (packed >> 7) & 127, packed & 127
    grid = np.arange(SPAN)
    open_ = (grid >= least[:, None]) & (grid <= most[:, None])
    found: list[tuple[np.ndarray, ...]] = []

    def later(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return (order[x] > order[y]) | ((order[x] == order[y]) & (rid[x] == rid[y]) & (place[x] > place[y]))

    def grouped(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cuts = grouped_offsets(h[rows])
        rows = rows[np.repeat(np.diff(cuts) > 1, np.diff(cuts))]
        return rows, grouped_offsets(h[rows])

    rows, cuts = grouped(np.arange(len(h)))
    for _ in range(ROUNDS):
        source = np.repeat(rows[cuts[:-1]], np.diff(cuts))
        after = later(rows, source)
        x, y = rows[after], source[after]
        lo, hi = shared_windows(context, x, y, most, least)
        some = lo <= hi
        x, y, lo, hi = x[some], y[some], lo[some], hi[some]
        found.append((x, y, lo, hi))
        open_[x] &= (grid < lo[:, None]) | (grid > hi[:, None])
        open_[rows[cuts[:-1]]] = False
        rows, cuts = grouped(rows[open_[rows].any(axis=1)])
    # The windows that are left, run by run of one anchor and offset; those that are alone in theirs have no copy.
    i, o = np.nonzero(open_[rows])
    by = np.lexsort((i, o, np.searchsorted(cuts, i, side="right")))
    i, o = i[by], o[by]
    key = np.searchsorted(cuts, i, side="right") * np.int64(SPAN) + o
    cuts = grouped_offsets(key)
    many = np.repeat(np.diff(cuts) > 1, np.diff(cuts))
    i, o, cuts = i[many], o[many], grouped_offsets(key[many])
    if len(i):
        prefix, near = prefixes(context[rows]), context[rows]
        by = suffix_sort(prefix, near, i, SPAN - 1 - o, cuts)
        i, o = i[by], o[by]
        same = np.concatenate(([False], extension(prefix, prefix, i[1:], i[:-1], SPAN - 1 - o[1:], LENGTH) == LENGTH))
        same[cuts[:-1]] = False
        first = np.maximum.accumulate(np.where(same, 0, np.arange(len(i))))
        x, y, z = rows[i], rows[i[first]], rows[i[np.maximum(np.arange(len(i)) - 1, 0)]]
        y = np.where(order[x] > order[y], y, z)
        some = same & later(x, y)
        found.append((x[some], y[some], o[some], o[some]))
    own, source, lo, hi = (np.concatenate(x) for x in zip(*found, strict=True))
    good = np.zeros(len(own), bool)
    for k in range(0, len(own), STEP):
        x, y = own[k : k + STEP], source[k : k + STEP]
        unequal = np.zeros((len(x), CONTEXT + 1), np.int16)
        np.cumsum(context[x] != context[y], axis=1, out=unequal[:, 1:])
        n = np.arange(len(x))
        good[k : k + STEP] = unequal[n, SPAN - 1 - lo[k : k + STEP] + LENGTH] == unequal[n, SPAN - 1 - hi[k : k + STEP]]
    own, lo, hi = own[good], lo[good], hi[good]
    # All windows of a place hold its anchor, so what they cover is one span.
    by = np.argsort(own, kind="stable")
    own, lo, hi = own[by], lo[by], hi[by]
    cuts = grouped_offsets(own)[:-1] if len(own) else np.zeros(0, np.int64)
    own, lo, hi = own[cuts], np.minimum.reduceat(lo, cuts) if len(cuts) else lo, np.maximum.reduceat(hi, cuts) if len(cuts) else hi
    return pa.RecordBatch.from_arrays([pa.array(rid[own]), pa.array(place[own] - hi), pa.array(place[own] - lo + LENGTH)], names=["rid", "start", "end"])


def _matches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by anchor: groups are cut out whole; one of up to CROWD rows may wait for the next batch."""
    held: pa.RecordBatch | None = None
    for b in batches:
        if held is not None:
            b = pa.concat_batches([held, b])
        h = b.column("h").to_numpy()
        if not len(h):
            continue
        cut = 0 if h[0] == h[-1] else int(np.flatnonzero(h != h[-1])[-1]) + 1
        held = b.slice(cut)
        if cut:
            yield _match_group(b.slice(0, cut))
    if held is not None and held.num_rows:
        yield _match_group(held)


def _window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, 2000):
            part = b.slice(at, 2000)
            context, place, row, offset = _windows(part)
            view = np.lib.stride_tricks.sliding_window_view(context, LENGTH, axis=1)[row, SPAN - 1 - offset]
            window = pa.FixedSizeBinaryArray.from_buffers(pa.binary(LENGTH), len(row), [None, pa.py_buffer(np.ascontiguousarray(view))]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([window, pa.array(part.column("ord").to_numpy()[row]), pa.array(part.column("rid").to_numpy()[row]), pa.array(place[row] - offset)], names=["window", "ord", "rid", "start"])


def crowded_matches(contexts: DataFrame) -> DataFrame:
    """Spans of windows of crowded anchors: groups of the windows' bytes, so nothing is left to verify.

    A window is matched if a smaller ord holds it, or its own row at an earlier start; rows of equal ord match neither each other."""
    rows = contexts.mapInArrow(_window_rows, "window binary, ord long, rid long, start long")
    own = rows.groupBy("window", "ord", "rid").agg(F.collect_set("start").alias("starts"))
    least = own.groupBy("window").agg(F.min("ord").alias("least"))
    each = own.join(least, "window").select("rid", (F.col("ord") > F.col("least")).alias("later"), F.array_min("starts").alias("first"), F.explode("starts").alias("start"))
    return each.where("later or start > first").select("rid", "start", (F.col("start") + LENGTH).alias("end"))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    z = zstandard.ZstdDecompressor()
    for b in slices(batches):
        removed, spans, hashes, sizes = [], [], [], []
        for body, n, copy, found in zip(*(b.column(c).to_pylist() for c in ("body", "n_bytes", "copy", "found")), strict=True):
            text = z.decompress(body)
            if copy and n >= LENGTH:
                found = [{"start": 0, "end": n}]
            kept, at, runs = [], 0, 0
            for s, e in sorted((x["start"], x["end"]) for x in found or ()):
                if s > at or not runs:
                    kept.append(text[at:s])
                    runs += 1
                at = max(at, e)
            kept.append(text[at:])
            rest = b"".join(kept)
            sizes.append(n)
            removed.append(n - len(rest))
            spans.append(runs)
            hashes.append(hashlib.sha256(rest).hexdigest())
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("m"), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(hashes, pa.string())], names=["doc_id", "m", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def deduplicated(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row of docs (doc_id, text)."""
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    order = F.coalesce(F.col("doc_id"), F.lit(_FIRST))
    bodies = rows.mapInArrow(_squeeze, "doc_id long, digest binary, n_bytes long, body binary").withColumn("ord", order).withColumn("rid", F.xxhash64("doc_id", "digest"))
    bodies = bodies.groupBy("rid").agg(*[F.first(c).alias(c) for c in ("doc_id", "digest", "n_bytes", "body", "ord")], F.count(F.lit(1)).alias("m"))
    name = f"bodies_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bodies.repartition(buckets, "rid").write.bucketBy(buckets, "rid").sortBy("rid").option("compression", "uncompressed").option("path", f"{shared_dir(spark).rstrip('/')}/{name}").saveAsTable(name)
    bodies = spark.table(name)
    firsts = bodies.groupBy("digest").agg(F.min("ord").alias("least"))
    copies = stored(bodies.select("rid", "digest", "ord").join(firsts, "digest").where("ord > least").select("rid"), "copies")
    originals = bodies.where(F.col("n_bytes") >= LENGTH).select("rid", "body").join(copies, "rid", "left_anti")
    every = originals.mapInArrow(_anchor_rows, "h long, rid long, packed long")
    twice = every.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    repeated = stored(every.join(twice, "h"), "anchors")
    found = repeated.groupBy("rid").agg(F.collect_list(F.struct("h", "packed")).alias("found"))
    contexts = bodies.select("rid", "ord", "body").join(found, "rid").mapInArrow(_contexts, "h long, ord long, rid long, packed long, context binary")
    crowd = stored(repeated.groupBy("h").agg(F.first("n").alias("n")).where(F.col("n") > CROWD).select("h"), "crowd")
    contexts = stored(contexts.join(crowd.withColumn("crowded", F.lit(True)), "h", "left"), "contexts")
    spans = contexts.where("crowded is null").drop("crowded").repartition("h").sortWithinPartitions("h").mapInArrow(_matches, "rid long, start long, end long")
    if not crowd.isEmpty():
        spans = spans.unionByName(crowded_matches(contexts.where("crowded").drop("crowded")))
    spans = spans.groupBy("rid").agg(F.collect_set(F.struct("start", "end")).alias("found"))
    marked = bodies.join(spans, "rid", "left").join(copies.withColumn("copy", F.lit(True)), "rid", "left").select("doc_id", "m", "n_bytes", "body", F.coalesce("copy", F.lit(False)).alias("copy"), "found")
    cut = marked.mapInArrow(_cut, "doc_id long, m long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return cut.withColumn("m", F.explode(F.sequence(F.lit(1).cast("long"), "m"))).drop("m")


def op5_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document with what is left of it without the bytes of repeated 100-byte strings."""
    return deduplicated(table(spark, sf_dir, "documents"))
