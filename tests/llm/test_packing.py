"""Packing: ids of the library, sums against all subsets, plans that place every token once."""

import itertools
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerline.llm import packing

PATH = public_tokenizers.path(packing.TOKENIZER)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def ids_of(text, library):
    return [*library.encode(text or "", add_special_tokens=False).ids, 1]


ODD = ["", None, " ", "The CAT sat. On, the (mat)!", "J̌ ẖ H̱ ǰ", "don't. It'S 'VE x's,y", "<|endoftext|> a<|ENDOFTEXT|>b<|endoftext|>.", "naïve.Café;É!×.÷,", "Δ.Σς ΑΣ İI", "12.5,3 a1.b2", "日本。語 😀.!", "á.b K.", "x" * 9000, "...a..b", "\x1cA.\x85B"]


def encoded(texts):
    out = []
    for lo, hi, data, offsets in packing.pieces(pa.array(texts, pa.string()), 1 << 20):
        flat, at = packing.encode(data, offsets, PATH)
        out += [flat[s:e].tolist() for s, e in itertools.pairwise(at)]
    return out


def test_ids_are_the_librarys(library):
    assert encoded(ODD) == [ids_of(t, library) for t in ODD]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(list("aBst'eJ \n\t12.,!<|>̌É")), st.characters(exclude_categories=["Cs"])), max_size=40), max_size=4))
def test_ids_of_any_text(library, texts):
    assert encoded(texts) == [ids_of(t, library) for t in texts]


def test_ids_of_words_and_of_the_vocabulary(library):
    draw = random.Random(8)
    letters = "aaeeiioottnnssrrhhldcumfpgwybvkxjqzéüßçÉ"
    made = ["".join(draw.choice(letters) for _ in range(draw.randrange(1, 14))) for _ in range(20_000)]
    made += [t.removesuffix("</w>") for t in library.get_vocab() if t.isascii()] + ["supercalifragilistic" * 30]
    assert encoded(made) == [ids_of(t, library) for t in made]


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(0, 3), max_size=5), st.integers(0, 40))
def test_fill_comes_closest(counts, room):
    used = packing.fill(counts, room)
    assert all(0 < n <= counts[k] for k, n in used.items())
    sums = {sum(k * n for k, n in zip(counts, some, strict=True)) for some in itertools.product(*(range(n + 1) for n in counts.values()))}
    assert sum(k * n for k, n in used.items()) == max(s for s in sums if s <= room)


def check_plan(histogram, window):
    plan = packing.Plan(histogram, window)
    lengths = np.array([k for k, n in histogram.items() for _ in range(n)], np.int64)
    numbers = np.array([i for n in histogram.values() for i in range(n)], np.int64)
    held, of_rest = defaultdict(list), defaultdict(list)
    for row, before, taken, where, place in plan.pieces(lengths, numbers):
        for r, b, t, w, p in zip(row.tolist(), before.tolist(), taken.tolist(), where.tolist(), place.tolist(), strict=True):
            held[w].append((p, t))
            of_rest[r].append((b, t))
    for at in of_rest.values():
        assert [b for b, _ in at] == list(itertools.accumulate([t for _, t in at[:-1]], initial=0))
    assert [sum(t for _, t in of_rest[r]) for r in range(len(lengths))] == lengths.tolist()
    for parts in held.values():
        parts.sort()
        size = sum(t for _, t in parts)
        assert [p for p, _ in parts] == list(itertools.accumulate([t for _, t in parts[:-1]], initial=0))
        assert size == window or size < window and size & (size - 1) == 0
    assert sorted(held) == list(range(plan.windows))
    return plan, sum(len(x) for x in of_rest.values()) - len(lengths)


@pytest.mark.parametrize("histogram", [{}, {1: 1}, {1500: 1000}, {1025: 7}, {2047: 300}, {1: 5000}, {k: 1 for k in range(1, 400)}, {100: 16, 2000: 1}, {100: 320, 3: 2, 1777: 19}, {683: 99, 682: 98, 1024: 3}])
def test_plans_place_every_token_once(histogram):
    check_plan(histogram, 2048)


def test_plans_of_random_lengths_cut_few_rests():
    draw = random.Random(1)
    for _ in range(20):
        check_plan({draw.randrange(1, 64): draw.randrange(1, 40) for _ in range(draw.randrange(1, 20))}, 64)
    histogram = defaultdict(int)
    for _ in range(20_000):
        histogram[int(draw.lognormvariate(6, 1)) % 2048 or 1] += 1
    plan, cuts = check_plan(dict(histogram), 2048)
    assert cuts < 200


def test_plan_of_a_large_table_is_small():
    plan = packing.Plan({1500: 10**12 + 7, 900: 3 * 10**11, 1: 5}, 2048)
    assert plan.steps < 500


def verify(rows, docs, library, window):
    """Each id lies in one piece; sequences are gapless and padded nowhere."""
    by_doc, held = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        held[r.sequence_id].append((r.offset, r.length))
    assert set(by_doc) == {i for i, _ in docs}
    for i, text in docs:
        ids = ids_of(text, library)
        parts = sorted(by_doc[i], key=lambda r: r.start)
        assert [r.start for r in parts] == list(itertools.accumulate([r.length for r in parts[:-1]], initial=0))
        assert sum(r.length for r in parts) == len(ids) == parts[0].doc_tokens
        for r in parts:
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    for parts in held.values():
        parts.sort()
        assert [p for p, _ in parts] == list(itertools.accumulate([n for _, n in parts[:-1]], initial=0))
        size = sum(n for _, n in parts)
        assert size <= window and (size == window or size & (size - 1) == 0)


def test_query_packs_whole_documents(spark, sf, library):
    got = packing.op12_packing(spark, sf).collect()
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    verify(got, docs, library, 2048)
    assert len(got) < len(docs) + sum(r.length for r in got) / 2048 + 60


@pytest.mark.parametrize("window", [16, 64])
def test_small_windows_and_many_partitions(spark, library, window):
    docs = [(i, "word " * (i * 7 % 90) + (f"Ending number {i}." if i % 3 else "")) for i in range(120)] + [(500, None), (501, ""), (502, "long text " * 5000)]
    made = packing.packed(spark.createDataFrame(docs, "doc_id long, text string").repartition(7), PATH, window).withColumn("ids_crc32", F.crc32("ids"))
    verify(made.collect(), docs, library, window)
    whole = packing.sequences(made).collect()
    assert all(len(r.ids) == 4 * r.length == 4 * sum(1 for _ in np.frombuffer(r.ids, "<u4")) for r in whole)
    assert sum(r.length for r in whole) == sum(len(ids_of(t, library)) for _, t in docs)


def test_null_and_repeated_ids_other_columns_and_empty_tables(spark, library):
    docs = [(None, "one two"), (None, None), (1, "same text"), (1, "same text"), (1, "another one")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit(7) for c in ["task", "rest", "ids", "number", "first", "Full", "length"]})
    got = packing.packed(df, PATH).withColumn("crc", F.crc32("ids")).collect()
    whole = [r for r in got if r.length == r.doc_tokens]
    assert sum(r.length for r in got) == sum(len(ids_of(t, library)) for _, t in docs)
    want = {(i, zlib.crc32(np.array(ids_of(t, library), "<u4").tobytes())) for i, t in docs}
    assert {(r.doc_id, r.crc) for r in whole} <= want
    assert packing.packed(df.limit(0), PATH).collect() == []
