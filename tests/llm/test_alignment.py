"""Tokenizer alignment against both libraries and a plain count of links."""

import hashlib
from collections import Counter

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerline.llm import alignment

A, B = public_tokenizers.path(alignment.BYTE_LEVEL), public_tokenizers.path(alignment.PIECES)


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def byte_of():
    """The byte that each character of a byte-level token stands for."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {**{chr(b): b for b in plain}, **{chr(256 + i): b for i, b in enumerate(other)}}


BYTE = byte_of()


def brute(text, libraries):
    """Groups [(a ids, b ids)] of a text."""
    a, b = libraries
    if not text:
        return []
    own = a.encode(" " + text, add_special_tokens=False).ids
    spelled = [bytes(BYTE[c] for c in a.id_to_token(i)) for i in own]
    pieces = b.encode(text)
    other = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i in pieces for p in [b.id_to_piece(i)]]
    if not b"".join(spelled) == b"".join(other) == (" " + text).encode():
        return []
    ends = lambda xs: [sum(map(len, xs[: k + 1])) for k in range(len(xs))]
    groups, i, j = [], 0, 0
    a_ends, b_ends = ends(spelled), ends(other)
    for e in sorted(set(a_ends) & set(b_ends)):
        to_i, to_j = a_ends.index(e) + 1, b_ends.index(e) + 1
        groups.append((own[i:to_i], pieces[j:to_j]))
        i, j = to_i, to_j
    return groups


TEXTS = ["", None, " ", "a", "  a", "a  ", "naïve café — déjà vu\nNew line. end", "Hello<|endoftext|>world </s> <s>", "a▁b c", "x y▁", "日本語 テキスト 😀😀", "don't  stop\t now\r\n\r\n", "a b c　d", "the cat sat on the mat the cat", "the cat sat on the mat the cat", "1234567 89,000.5", "\x00 a\x85b", "word " * 300 + "end"]


def expected(texts, libraries):
    groups = [brute(t, libraries) for t in texts]
    count = Counter((a[-1], b[-1]) for g in groups for a, b in g)
    top = {}
    for (_, b), n in count.items():
        top[b] = max(top.get(b, 0), n)
    for g in groups:
        spelled = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in g)
        links = [(a[-1], b[-1]) for a, b in g]
        yield sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), len(g), sum(count[x] == top[x[1]] for x in links), sum(count[x] for x in links), hashlib.sha256(spelled.encode()).hexdigest() if g else ""


@pytest.mark.parametrize("sizes", [(2 << 20, 16 << 20), (40, 60)])
def test_link_counts_are_brute_force(spark, sf, libraries, sizes, monkeypatch):
    monkeypatch.setattr(alignment, "BATCH_BYTES", sizes[0])
    monkeypatch.setattr(alignment, "BLOCK_BYTES", sizes[1])
    texts = TEXTS + [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").limit(20).collect() if len(r.text or "") < 3000]
    ids = [None, 1, 1, *range(2, len(texts) - 1)]
    docs = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string")
    got = sorted((tuple(r) for r in alignment.link_counts(docs.repartition(3), A, B).collect()), key=str)
    assert got == sorted(((i, *w) for i, w in zip(ids, expected(texts, libraries), strict=True)), key=str)


def test_alignments_hold_the_groups(spark, libraries):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    for r in alignment.alignments(docs, A, B).collect():
        starts = lambda v: [0, *v][: len(v)]
        got = [(r.a_ids[i:j], r.b_ids[k:m]) for i, j, k, m in zip(starts(r.a_ends), r.a_ends, starts(r.b_ends), r.b_ends, strict=True)]
        assert got == brute(TEXTS[r.doc_id], libraries), r.doc_id


def test_clashing_columns_and_empty_table(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(1, "one two three"), (2, "two three four")], "doc_id long, text string")
    want = sorted(map(tuple, alignment.link_counts(docs, A, B).collect()))
    extra = docs.withColumns({c: F.lit(7) for c in ["block", "pairs", "times", "n_a", "best", "count", "pair"]})
    assert sorted(map(tuple, alignment.link_counts(extra, A, B).collect())) == want
    assert alignment.link_counts(docs.limit(0), A, B).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(list("abst'e \n\t12.,▁")), st.characters(exclude_categories=["Cs"])), max_size=60), max_size=4))
def test_alignment_of_any_text(libraries, texts):
    import pyarrow as pa

    p = alignment.pair(A, B)
    out = []
    for _, _, data, offsets, odd in alignment._batches(pa.array(texts, pa.string())):
        x = alignment.align(p, data, offsets, odd)
        out += list(zip(alignment._digests(p, x), x.group_at[1:] - x.group_at[:-1], strict=True))
    want = [(w[6], w[2]) for w in expected(texts, libraries)]
    assert [(s, int(n)) for s, n in out] == want
