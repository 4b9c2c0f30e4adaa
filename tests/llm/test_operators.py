"""Each text operator against a brute-force version on a small table."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerline.llm import decontamination, html_extract, license_scan, lm_score, mixing, near_dedup, quality, suffix_dedup, token_counts, token_output

SPACES = " \t\n\x0b\f\r"


def words(text):
    return [w for w in _split(text or "") if w]


def _split(text):
    for c in SPACES[1:]:
        text = text.replace(c, " ")
    return text.split(" ")


def rows(df):
    return [r.asDict() for r in df.collect()]


@pytest.fixture(scope="module")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def texts(documents):
    return {r.doc_id: r.text for r in documents.collect()}


# op1


def brute_scores(docs):
    lower = {i: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "") for i, t in docs.items()}
    tokens = {i: [w.encode() for w in words(t)] + [b"\n"] for i, t in lower.items()}
    train = Counter(w for i, ws in tokens.items() if zlib.crc32(str(i).encode()) % 10 for w in ws)
    n, v = sum(train.values()), len(train)
    start = b"\n" * 5
    trie = [defaultdict(Counter) for _ in range(6)]
    for i, ws in tokens.items():
        if zlib.crc32(str(i).encode()) % 10:
            s = start + b" ".join(ws)
            for p in range(5, len(s)):
                for j in range(6):
                    trie[j][s[p - j : p]][s[p]] += 1

    def code(s, p):
        out, gone = 0.0, set()
        for j in range(5, -1, -1):
            own = {k: x for k, x in trie[j].get(s[p - j : p], {}).items() if k not in gone}
            total = sum(own.values())
            if s[p] in own:
                return out + math.log10((2 * own[s[p]] - 1) / (2 * total))
            if total:
                out += math.log10(len(own) / (2 * total))
            gone |= set(own)
        return out + math.log10(1 / (256 - len(gone)))

    for i, ws in tokens.items():
        s = start + b" ".join(ws)
        base = sum(math.log10((train[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)
        yield i, len(ws), sum(train[w] > 0 for w in ws), n, base, sum(code(s, p) for p in range(5, len(s)))


@pytest.mark.parametrize("limits", [(1 << 20, 32 << 20), (40, 100)])
def test_lm_score_is_the_brute_force_model(spark, limits, monkeypatch):
    monkeypatch.setattr(lm_score, "CHUNK_BYTES", limits[0])
    monkeypatch.setattr(lm_score, "BLOCK_BYTES", limits[1])
    docs = {i: t for i, t in enumerate(["the cat sat on the mat", "The dog sat", "", None, "naïve café the the the", "zebra quartz\n\nthe end of it"] * 4)}
    got = {r["doc_id"]: r for r in rows(lm_score.scored(spark.createDataFrame(list(docs.items()), "doc_id long, text string")))}
    for i, n, known, train, base, score in brute_scores(docs):
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (n, known, train, zlib.crc32(str(i).encode()) % 10 == 0)
        assert r["base_score"] == pytest.approx(base, abs=1e-9) and r["score"] == pytest.approx(score, abs=1e-6)


def test_lm_score_knows_the_order_of_words(spark):
    """Held-out sentences are more probable than their own words in another order, though every word is known."""
    import random

    draw = random.Random(5)
    pick = lambda *xs: draw.choice(xs)
    sentence = lambda: f"{pick('the', 'every')} {pick('old', 'small', 'quiet')} {pick('farmer', 'teacher', 'sailor')} {pick('sold', 'painted', 'found')} {pick('a', 'one')} {pick('wooden', 'silver')} {pick('boat', 'bell', 'chair')} ."
    docs = {i: " ".join(sentence() for _ in range(5)) for i in range(1, 400)}
    held = [i for i in docs if zlib.crc32(str(i).encode()) % 10 == 0]
    other = [i for i in range(1000, 3000) if zlib.crc32(str(i).encode()) % 10 == 0][: len(held)]
    for i, j in zip(held, other, strict=True):
        docs[j] = " ".join(draw.sample(docs[i].split(), len(docs[i].split())))
    got = {r["doc_id"]: r for r in rows(lm_score.scored(spark.createDataFrame(list(docs.items()), "doc_id long, text string")))}
    assert len(held) > 20
    for i, j in zip(held, other, strict=True):
        assert got[i]["score"] > got[j]["score"] + 20 and got[i]["base_score"] == pytest.approx(got[j]["base_score"], abs=1e-6)
        assert got[i]["score"] > got[i]["base_score"] and got[i]["n_known"] == got[i]["n_tokens"]


def test_lm_score_tells_held_out_text_from_noise(spark, documents):
    """A held-out text is more probable than the same letters in another order."""
    import random

    held = [(r.doc_id, r.text) for r in documents.collect() if r.text and zlib.crc32(str(r.doc_id).encode()) % 10 == 0]
    noise = [(-i, " ".join("".join(random.Random(i).sample(w, len(w))) for w in words(t))) for i, t in held if i]
    noise = [(i, t) for i, t in noise if zlib.crc32(str(i).encode()) % 10 == 0] or noise[:3]
    got = {r["doc_id"]: r["score"] for r in rows(lm_score.scored(documents.select("doc_id", "text").unionByName(spark.createDataFrame(noise, "doc_id long, text string"))))}
    assert noise and all(got[-i] > got[i] for i, _ in noise if zlib.crc32(str(i).encode()) % 10 == 0)


# op2


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


ODD = ["", " ", "  a", "a  ", "it's they'll 'sx 'r 're 'lle", "\n\n x\t y", "<|endoftext|>", "a<|endoftext|>b <|endoftext|>", "１２3 ½x", "a 　b", "日本語 テキスト", "é 😀😀", "don''t '''", " 's", "\r\n\r\n", "\x1c a\x85b", "'" * 9]


def test_token_counts_are_the_librarys(spark, documents, library):
    t = token_counts.transducer(public_tokenizers.path("byte_bpe_50k.json"))
    assert t.count(ODD).tolist() == [len(library.encode(x, add_special_tokens=False).ids) for x in ODD]
    for r, d in zip(sorted(rows(token_counts.count_tokens(documents, public_tokenizers.path("byte_bpe_50k.json"))), key=lambda r: r["doc_id"]), sorted(documents.collect(), key=lambda d: d.doc_id), strict=True):
        n = len(library.encode(d.text or "", add_special_tokens=False).ids)
        assert (r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) == (d.doc_id, len((d.text or "").encode()), n, n > 512)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(list("abst'mrvelld \n\t12.,")), st.characters(exclude_categories=["Cs"])), max_size=200))
def test_token_counts_of_any_text(library, text):
    assert token_counts.transducer(public_tokenizers.path("byte_bpe_50k.json")).count([text])[0] == len(library.encode(text, add_special_tokens=False).ids)


# op3


def plain_words(text):
    for c in ".,;:!?\"'()[]" + SPACES:
        text = text.replace(c, " ")
    return [w for w in text.lower().split(" ") if w]


def brute_covered(item, text, least=5):
    a_used, b_used, covered = [False] * len(item), [False] * len(text), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for j in range(len(text)):
                n = 0
                while i + n < len(item) and j + n < len(text) and item[i + n] == text[j + n] and not a_used[i + n] and not b_used[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < least:
            return covered
        a_used[i : i + n] = [True] * n
        b_used[j : j + n] = [True] * n
        covered += n


def test_decontamination_tiles_like_the_naive_algorithm(spark, sf):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()][:6]
    halves = [" ".join(t.split()[len(t.split()) // 2 :] + ["filler"] * 7 + t.split()[: len(t.split()) // 2]).upper() for _, t in items]
    docs = [*halves, items[0][1], " ".join(items[1][1].split()[:6]), "nothing of this kind here at all", "", None, items[2][1] + " " + items[2][1], "a b c d e a b c d e"]
    bench = spark.createDataFrame([*items, (900, "a b c d e f g h"), (901, "too short"), (902, None), (903, "a b c d e a b c d e")], "item_id long, text string")
    want_items = [(r.item_id, plain_words(r.text or "")) for r in bench.collect()]
    got = {r["doc_id"]: r for r in rows(decontamination.decontaminated(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), bench))}
    for d, text in enumerate(docs):
        shares = {i: brute_covered(w, plain_words(text or "")) / len(w) for i, w in want_items if len(w) >= 5}
        assert got[d]["item_ids"] == sorted(i for i, s in shares.items() if s >= 0.5), d
        assert got[d]["max_coverage"] == pytest.approx(max(shares.values())), d
    assert all(got[d]["contaminated"] for d in range(7))


# op4


def brute_quality(text):
    text = text or ""
    ws = words(text)
    lines = [x for x in text.split("\n") if words(x)]
    windows = Counter(tuple(ws[i : i + 3]) for i in range(len(ws) - 2))
    repeat = {j for i in range(len(ws) - 2) if windows[tuple(ws[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeat)


def test_quality_counts_are_brute_force(spark, texts):
    docs = {**texts, -1: None, -2: "", -3: " \n\t ", -4: "a a a a", -5: "a b c a b c a b", -6: "x\n\nx\n x\nx", -7: "é ü z 日本 #$"}
    out = quality.quality(spark.createDataFrame([(i, t, "en" if i % 2 else None) for i, t in docs.items()], "doc_id long, text string, lang string"))
    for r in rows(out):
        n, chars, symbols, lines, repeat = want = brute_quality(docs[r["doc_id"]])
        assert tuple(r[c] for c in quality.COUNTS) == want, r["doc_id"]
        assert r["base_failed"] == (n < 50 or 100 * repeat > 50 * n)
        assert not (r["kept"] and r["base_failed"])


def test_quality_keeps_documents_that_are_labelled_good(spark, documents, sf):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    out = {r["doc_id"]: r for r in rows(quality.quality(documents))}
    good = [out[i]["kept"] for i, q in labels.items() if q == 1 and i in out and not out[i]["base_failed"]]
    assert not good or sum(good) >= 0.9 * len(good)


# op5


def brute_spans(docs):
    first = {}
    for i in sorted(docs):
        b = (docs[i] or "").encode()
        covered = np.zeros(len(b) + 1, int)
        for p in range(len(b) - 99):
            s = b[p : p + 100]
            if s in first:
                covered[p] += 1
                covered[p + 100] -= 1
            else:
                first[s] = i
        inside = np.cumsum(covered)[: len(b)] > 0
        runs = int((np.diff(np.concatenate(([0], inside.astype(int)))) == 1).sum())
        yield i, len(b), int(inside.sum()), runs, hashlib.sha256(bytes(x for x, gone in zip(b, inside, strict=True) if not gone)).hexdigest()


@pytest.mark.parametrize("crowd", [40_000, 3])
def test_suffix_dedup_is_brute_force(spark, texts, crowd, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CROWD", crowd)
    passage = "The quick brown fox jumps over the lazy dog, and then it does so again and again until nobody cares about it any more. "
    docs = {**dict(list(texts.items())[:60]), 10_001: passage * 3, 10_002: "x" * 350, 10_003: "start " + passage + "end", 10_004: passage * 3, 10_005: None, 10_006: "x" * 99, 10_007: "x" * 100, 10_008: "é" * 120 + passage[:99], 10_009: "zz" + "é" * 60 + passage}
    got = {r["doc_id"]: r for r in rows(suffix_dedup.deduplicated(spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(3)))}
    for i, n, removed, runs, sha in brute_spans(docs):
        assert (got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"], got[i]["kept_sha256"]) == (n, removed, runs, sha), i


@pytest.mark.parametrize("crowd", [40_000, 3, 1])
def test_suffix_dedup_of_rows_that_share_an_id(spark, crowd, monkeypatch):
    """Rows of one doc_id, or of none, are not earlier than each other, but a row's own earlier start counts."""
    import random

    monkeypatch.setattr(suffix_dedup, "CROWD", crowd)
    draw = random.Random(6)
    p, q = ("".join(draw.choice("abcdefgh ") for _ in range(150)) for _ in range(2))
    docs = [(5, "A" + p), (5, "Bxyz" + p + "--" + p), (None, q + "1"), (None, "22" + q + "-" + q), (3, "short"), (7, p + q), (7, "only " + q), (5, "A" + p)]
    want = []
    for i, t in docs:
        b, gone = t.encode(), set()
        before = lambda j, i=i: (j is None and i is not None) or (j is not None and i is not None and j < i)
        for k in range(len(b) - 99):
            w = b[k : k + 100]
            if any(before(j) and w in o.encode() for j, o in docs) or b.find(w) < k:
                gone |= set(range(k, k + 100))
        runs = sum(x - 1 not in gone for x in gone)
        want.append((i, len(b), len(gone), runs, hashlib.sha256(bytes(x for k, x in enumerate(b) if k not in gone)).hexdigest()))
    got = [tuple(r[c] for c in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")) for r in rows(suffix_dedup.deduplicated(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)))]
    assert sorted(got, key=str) == sorted(want, key=str)


@pytest.mark.parametrize("rounds", [0, 1, 2])
def test_suffix_sort_finds_what_the_earliest_place_does_not_hold(spark, rounds, monkeypatch):
    """Texts that share one core in many surroundings: most matches are with other texts than the earliest."""
    import random

    monkeypatch.setattr(suffix_dedup, "ROUNDS", rounds)
    draw = random.Random(3)
    letters = lambda n: "".join(draw.choice("abcd") for _ in range(n))
    core, sides = letters(60), [letters(70) for _ in range(6)]
    docs = {i: letters(20) + draw.choice(sides) + core + draw.choice(sides) + letters(draw.randrange(20)) for i in range(1, 60)}
    got = {r["doc_id"]: r for r in rows(suffix_dedup.deduplicated(spark.createDataFrame(list(docs.items()), "doc_id long, text string")))}
    want = list(brute_spans(docs))
    assert sum(x[2] for x in want) > 3000
    for i, n, removed, runs, sha in want:
        assert (got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"], got[i]["kept_sha256"]) == (n, removed, runs, sha), i


# op6


def test_shards_hold_every_sequence_once_at_its_slot(spark, documents, texts):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    plain, _ = token_output.encoder(path)
    out = token_output.shards(documents, path, length=64, size=50)
    found = defaultdict(dict)
    got = sorted(rows(out), key=lambda r: r["shard"])
    slots = 0
    for r in got:
        assert r["first_slot"] == slots and r["stride"] == 128 and hashlib.sha256(r["payload"]).hexdigest() == r["sha256"] and len(r["payload"]) == 128 * r["n_sequences"]
        slots += r["n_sequences"]
        for k, (d, p, n) in enumerate(zip(r["doc_ids"], r["parts"], r["n_tokens"], strict=True)):
            ids = np.frombuffer(r["payload"][k * 128 : k * 128 + 128], "<u2").tolist()
            assert p not in found[d] and set(ids[n:]) <= {token_output.END}
            found[d][p] = ids[:n]
    assert all(r["n_sequences"] == 50 for r in got[:-1])
    for d, text in texts.items():
        assert [x for p in sorted(found[d]) for x in found[d][p]] == [*plain(text or ""), token_output.END]
    some = token_output.read_slots(out, 45, 10, size=50)
    assert len(some) == 10 and some[0].tobytes() == got[0]["payload"][45 * 128 : 46 * 128]


@pytest.mark.parametrize("total", [1, 2, 3, 7, 64, 1000, 4097])
def test_feistel_is_a_permutation(total):
    assert sorted(token_output.feistel(np.arange(total), total).tolist()) == list(range(total))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(list("ab's \n\t12. ")), st.characters(exclude_categories=["Cs"])), max_size=60), max_size=5))
def test_encode_is_the_tokenizers(batch):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    plain, _ = token_output.encoder(path)
    flat, ends = token_output.encode(pa.array(batch, pa.string()), path)
    assert [flat[a:b].tolist() for a, b in zip(ends[:-1], ends[1:], strict=True)] == [plain(t) for t in batch]


# op7


def test_mix_meets_its_targets(spark, documents):
    out = rows(mixing.mixed(documents))
    by = defaultdict(int)
    source = {r.doc_id: r.source for r in documents.collect()}
    goal, longest = {}, Counter()
    for r in out:
        s = source[r["doc_id"]]
        by[s] += r["taken"]
        goal[s] = (r["target"], r["source_size"])
        longest[s] = max(longest[s], r["size"])
        assert r["taken"] in (0, r["size"], 2 * r["size"])
    assert sum(t for t, _ in goal.values()) == pytest.approx(min(1.5, 2.0) * sum(n for _, n in goal.values()))
    for s, (t, n) in goal.items():
        assert t <= 2 * n + 1e-6 and abs(by[s] - t) <= longest[s]
    assert rows(mixing.mixed(documents.repartition(5)).orderBy("doc_id")) == sorted(out, key=lambda r: r["doc_id"])


# op8


def test_license_scan_and_inheritance(spark):
    mit, gpl = license_scan.TEMPLATES["MIT"][0], license_scan.TEMPLATES["GPL-3.0"][0]
    code = "def f(x):\n    return x\n" * 20
    files = [(1, "a/LICENSE", mit), (2, "a/b/c.py", code), (3, "a/b/LICENSE", gpl), (4, "z/c.py", code), (5, "a/d.py", None), (6, None, code), (7, "a/x.py", gpl + "\n" + code), (8, "top.py", ""), (8, "top.py", "")]
    got = sorted((r["key"], r["license"], r["how"], r["directory"]) for r in rows(license_scan.scanned(spark.createDataFrame(files, "key long, path string, text string"))) if r["license"])
    assert got == [(1, "MIT", "own", "a"), (2, "GPL-3.0", "inherited", "a/b"), (3, "GPL-3.0", "own", "a/b"), (5, "MIT", "inherited", "a"), (7, "GPL-3.0", "own", "a")]


def test_license_cosines_are_brute_force(spark, texts):
    import regex

    vectors, idf, other = license_scan.template_vectors()
    by = defaultdict(dict)
    for name, title, i, t, w in vectors:
        by[name, title, i][t] = w
    cued = lambda parts: [x for x in parts if regex.search(license_scan.CUE, x)]
    got = {r["key"]: (r["license"], r["score"]) for r in rows(license_scan.scanned(spark.createDataFrame([(i, None, t) for i, t in texts.items()], "key long, path string, text string")))}
    for i, text in texts.items():
        text = (text or "").strip(SPACES)
        paragraphs = regex.split(license_scan.PARAGRAPH, text)
        some = cued(paragraphs)
        passages = [(x, False) for x in cued(regex.split(license_scan.PASSAGE, text))] + [(x, x == paragraphs[0]) for x in some] + ([("\n".join(some), False)] if len(some) > 1 else [])
        best = (False, False, 0.0, 0, None)
        for passage, lead in passages:
            terms = Counter(regex.findall(license_scan.TERM, passage.lower()))
            norm = math.sqrt(sum((n * idf.get(t, other)) ** 2 for t, n in terms.items()))
            found = []
            for (name, title, _), v in by.items():
                score = round(sum(n * idf[t] * v[t] for t, n in terms.items() if t in v) / norm, 9) if norm else 0
                if score >= license_scan.COSINE:
                    found.append((title and lead, name != "Proprietary", score, -sorted(license_scan.TEMPLATES).index(name), name))
            if found:
                best = max(best, (any(x[0] for x in found), *max(x[1:] for x in found)))
        assert got[i][0] == best[4], i
        assert best[4] is None or got[i][1] == pytest.approx(best[2], abs=2e-9)


MIT_FILE = """MIT License

Copyright (c) 2021 Ada Example

""" + license_scan._MIT_GRANT.replace(" and to permit", "\nand to permit") + """

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

""" + license_scan._AS_IS_MIT
APACHE_HEADER = """#!/usr/bin/env python
# Copyright 2020 Example Inc.
#
# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
#
# Unless required by applicable law or agreed to in writing, software
# distributed under the License is distributed on an "AS IS" BASIS,
# WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
# See the License for the specific language governing permissions and
# limitations under the License.

import sys
"""
FSF_HEADER = """/* This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version 3 of the License, or
 * (at your option) any later version.
 */
int main() { return 0; }
"""
GPL_FILE = """                    GNU GENERAL PUBLIC LICENSE
                       Version 3, 29 June 2007

 Everyone is permitted to copy and distribute verbatim copies
 of this document, but changing it is not allowed.

""" + "\n\n".join(f"Section {i}. Conditions about conveying covered works number {i}." for i in range(80))


def test_licences_of_real_files(spark):
    code = "import sys\nprint(sys.argv)\n" * 40
    bsd = lambda body: "Copyright (c) 2019, Example\nAll rights reserved.\n\n" + body.replace(". ", ".\n\n")
    files = {
        "mit/LICENSE": MIT_FILE, "mit/src/a.py": code, "mit/src/deep/b.py": code, "mit/gpl/LICENSE": GPL_FILE, "mit/gpl/c.py": code, "apache/a.py": APACHE_HEADER + code, "apache/other.py": code,
        "fsf.c": FSF_HEADER + code, "spdx1.py": "// SPDX-License-Identifier: MIT\n" + code, "spdx2.py": "# SPDX-License-Identifier: Apache-2.0\n" + code, "spdx3.py": "# SPDX-License-Identifier: GPL-3.0-or-later\n" + code,
        "spdx4.py": "# SPDX-License-Identifier: Zlib\n" + code, "two/LICENSE": bsd(license_scan._BSD_2 + license_scan._AS_IS_BSD), "three/LICENSE": bsd(license_scan._BSD_2 + license_scan._BSD_3 + license_scan._AS_IS_BSD), "three/x.py": code,
        "isc/LICENSE": f"ISC License\n\nCopyright (c) 2018 Someone\n\n{license_scan._ISC_GRANT}\n\n{license_scan._AS_IS_ISC}", "own.txt": "Some prose.\nCopyright 2020 Example. All rights reserved.\n" + code,
        "both.txt": "All rights reserved.\nLicensed under the MIT license, see there.\n" + code, "prose.txt": "She asked for permission to leave. The driving license was lost.",
    }
    got = {r["key"]: (r["license"], r["how"]) for r in rows(license_scan.scanned(spark.createDataFrame([(k, k, v) for k, v in files.items()], "key string, path string, text string")))}
    assert got == {
        "mit/LICENSE": ("MIT", "own"), "mit/src/a.py": ("MIT", "inherited"), "mit/src/deep/b.py": ("MIT", "inherited"), "mit/gpl/LICENSE": ("GPL-3.0", "own"), "mit/gpl/c.py": ("GPL-3.0", "inherited"),
        "apache/a.py": ("Apache-2.0", "own"), "apache/other.py": (None, "none"), "fsf.c": ("GPL-3.0", "own"), "spdx1.py": ("MIT", "own"), "spdx2.py": ("Apache-2.0", "own"), "spdx3.py": ("GPL-3.0", "own"), "spdx4.py": (None, "none"),
        "two/LICENSE": ("BSD-2-Clause", "own"), "three/LICENSE": ("BSD-3-Clause", "own"), "three/x.py": ("BSD-3-Clause", "inherited"), "isc/LICENSE": ("ISC", "own"), "own.txt": ("Proprietary", "own"), "both.txt": ("MIT", "own"), "prose.txt": (None, "none"),
    }


def test_license_scan_takes_rows_one_by_one(spark, tmp_path):
    """Rows that repeat a doc_id, or have none, have licences of their own."""
    mit = "Released under the MIT License."
    docs = [(1, mit, "a"), (1, "plain words here", "b"), (None, mit, "c"), (None, "nothing at all", "d"), (2, mit, "a"), (2, mit, "a"), (3, None, "e"), (4, "", "e")]
    spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in docs], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(((r["doc_id"], r["license"], r["how"]) for r in rows(license_scan.op8_license_scan(spark, str(tmp_path)))), key=str)
    want = [(1, "MIT", "own"), (1, None, "none"), (None, "MIT", "own"), (None, None, "none"), (2, "MIT", "own"), (2, "MIT", "own"), (3, None, "none"), (4, None, "none")]
    assert got == sorted(want, key=str)


# op9


def test_extraction_drops_the_template_and_keeps_the_article(spark):
    def page(i, body):
        return f"<html><head><title>t{i}</title><style>x{{}}</style></head><body><div class='top'>Acme News Portal</div><div><ul><li>Home</li><li>World</li></ul></div><div class='text'><h1>Title {i}</h1>{body}</div><div class='sidebar'>ads</div><div class='bottom'>All about Acme</div><script>var a='<p>no</p>'</script></body></html>"

    pages = [(i, f"http://a.example/{i}", page(i, f"<p>Body &amp; text  number {i}</p><p>Second\nparagraph <b>of {i}</b></p>" + "<p>more</p>" * (i % 3))) for i in range(9)]
    pages += [(50, None, None), (51, "odd", ""), (52, "http://b.example/x", "<article><h1>A</h1><p>one<br>two</article><p>out"), (52, "http://b.example/x", "<p>a &lt;b&gt; &#233;")]
    got = {(r["page_id"], r["url"], r["text"]) for r in rows(html_extract.extracted(spark.createDataFrame(pages, "page_id long, url string, html string")))}
    for i in range(9):
        assert (i, f"http://a.example/{i}", f"Title {i} Body & text number {i} Second paragraph of {i}" + " more" * (i % 3)) in got
    assert {(50, None, ""), (51, "odd", ""), (52, "http://b.example/x", "A one two"), (52, "http://b.example/x", "a <b> é")} <= got


def largest_matching(a, b):
    """Nodes are (label, children): the size of the largest matching that keeps order and depth, by definition."""
    if a[0] != b[0]:
        return 0

    def best(x, y):
        return max(best(x[1:], y), best(x, y[1:]), best(x[1:], y[1:]) + largest_matching(x[0], y[0])) if x and y else 0

    return 1 + best(a[1], b[1])


def tree(skeleton):
    labels, children = html_extract.unfold(skeleton)

    def build(i):
        return labels[i], [build(c) for c in children[i]]

    return build(0)


@given(st.lists(st.tuples(st.sampled_from("uvw"), st.integers(0, 5)), max_size=6), st.lists(st.tuples(st.sampled_from("uvw"), st.integers(0, 5)), max_size=6))
@settings(max_examples=150, deadline=None)
def test_tree_matching_is_the_largest(left, right):
    one, two = ("\n".join(["0 #"] + [f"{p % (i + 1)} {tag}" for i, (tag, p) in enumerate(nodes)]) for nodes in (left, right))
    partners = html_extract.matched(one, two)
    assert sum(p >= 0 for p in partners) == largest_matching(tree(one), tree(two))
    taken = [p for p in partners if p >= 0]
    assert len(set(taken)) == len(taken)
    (la, ca), (lb, cb) = html_extract.unfold(one), html_extract.unfold(two)
    for a, children in enumerate(ca):
        inner = [partners[c] for c in children if partners[c] >= 0]
        assert all(p in cb[partners[a]] for p in inner) and inner == sorted(inner)
    assert all(la[a] == lb[b] for a, b in enumerate(partners) if b >= 0)


def unnamed(i):
    """A page whose menu and closing line have no telling element or name."""
    return f"<body><div class='r1'>Start News Weather</div><div class='r2'><p>Text of page {i}</p><p>Line {i * 7} here</p></div>{'<hr><div class=r4><p>odd ' + str(i) + '</p></div>' if i % 2 else ''}<div class='r3'>Made by us</div></body>"


def test_extraction_is_the_vote_of_the_hosts_pages(spark):
    pages = [(i, f"http://a.example/{i}", unnamed(i)) for i in range(12)] + [(100 + i, f"http://a.example/c{i}", unnamed(1)) for i in range(40)] + [(i, f"http://b{i}.example/", unnamed(i)) for i in range(200, 203)]
    got = {r["page_id"]: r["text"] for r in rows(html_extract.extracted(spark.createDataFrame(pages, "page_id long, url string, html string")))}

    # By hand: a text is template where most of the host's different pages have it in one place.
    def whole(i):
        return html_extract.main_text(unnamed(i), None, {})

    for page, _, html in pages:
        i = page if page < 12 or page >= 200 else 1
        pieces = [x for x in re.sub(r"<[^>]*>", "\n", html).split("\n") if x]
        different = [unnamed(k) for k in range(12)] if page < 200 else [html]
        kept = [x for x in pieces if len(different) < html_extract.LEAST or sum(x in d for d in different) < html_extract.CONSTANT * len(different)]
        assert got[page].split() == " ".join(kept).split()
        # The template decides: without it the menu stays.
        assert (got[page] == whole(i)) == (page >= 200)


def test_extraction_of_deep_wide_and_long_pages(spark):
    deep = "<div>" * 100_000 + "deep text" + "</div>" * 100_000
    wide = "".join(f"<div class='c{i}'><p>t{i}</p></div>" for i in range(3000))
    pages = [(i, "http://a.example/", x) for i, x in enumerate([deep, deep + "<p>more</p>", "<div>" * 50_000 + "other", wide, "<p>a</p>" + wide, "<p>" + "long " * 500_000, "</i>" * 50_000 + "<b>" * 50_000 + "<p>x</p>" * 1000])]
    got = {r["page_id"]: r["text"] for r in rows(html_extract.extracted(spark.createDataFrame(pages, "page_id long, url string, html string")))}
    every = " ".join(f"t{i}" for i in range(3000))
    assert got == {0: "deep text", 1: "deep text more", 2: "other", 3: every, 4: "a " + every, 5: " ".join(["long"] * 500_000), 6: " ".join("x" * 1000)}


def test_names_of_several_meanings_need_company():
    html = "<article><div class='share-price'>Share price rose</div><div class='share-buttons'>Tweet</div><div id='related-posts'>More</div><div class='search-party'>They looked</div><div class='x cookie-note'>We use</div><p>End</p></article>"
    assert html_extract.main_text(html, None, {}) == "Share price rose They looked End"


# op10


def shingles(text):
    ws = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    ws = words(ws)
    return Counter(tuple(ws[i : i + 5]) for i in range(len(ws) - 4)) if len(ws) >= 5 else Counter([tuple(ws)] if ws else [])


def test_near_dedup_classes_are_brute_force(spark, texts):
    base = " ".join(f"w{i}" for i in range(80))
    docs = {**texts, 5001: base, 5002: base.replace("w40", "other"), 5003: base.upper(), 5004: "one two", 5005: "ONE  two", 5006: None, 5007: "", 5008: " ", 5009: base + " " + base}
    sets = {i: shingles(t) for i, t in docs.items()}
    parent = {i: i for i in docs}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(docs)
    for x, a in enumerate(ids):
        for b in ids[:x]:
            na, nb = sets[a].total(), sets[b].total()
            if na and nb and min(na, nb) >= 0.8 * max(na, nb):
                both = (sets[a] & sets[b]).total()
                if both >= 0.8 * (na + nb - both):
                    ra, rb = root(a), root(b)
                    parent[max(ra, rb)] = min(ra, rb)
    got = {r["doc_id"]: r["class_id"] for r in rows(near_dedup.near_duplicates(spark.createDataFrame(list(docs.items()), "doc_id long, text string")))}
    assert got == {i: root(i) for i in ids}


def test_near_dedup_of_a_large_group(spark):
    """More members than SMALL, in chains: every member lies near the original."""
    base = [f"t{i}" for i in range(200)]
    docs = [(i, " ".join(base[:j] + [f"x{i}"] + base[j + 1 :])) for i, j in enumerate(range(5, 95))] + [(1000, " ".join(base))]
    got = {r["class_id"] for r in rows(near_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")))}
    assert got == {0}


def test_near_dedup_finds_the_pairs_inside_a_template_group(spark):
    """Members on one template, each just under the threshold to every other and to the leader; two and two are near."""
    template = [f"t{i}" for i in range(300)]

    def filled(own):
        return " ".join(w for k in range(7) for w in (*template[k * 34 : k * 34 + 34], f"{own[k]}"))

    n = 400
    slots = [[f"x{i}_{k}" for k in range(7)] for i in range(n)]
    for i in range(0, n, 2):
        slots[i + 1][0] = slots[i][0]
    docs = [(i, filled(s)) for i, s in enumerate(slots)]
    sets = [shingles(t) for _, t in docs]
    near = lambda a, b: 9 * (sets[a] & sets[b]).total() >= 4 * (sets[a].total() + sets[b].total())
    assert near(0, 1) and not near(1, 2) and not near(0, 2)
    got = {r["doc_id"]: r["class_id"] for r in rows(near_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")))}
    assert got == {i: i - i % 2 for i in range(n)}


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(1)
    common, a, b = (np.sort(rng.integers(1, 2**63, n).astype(np.uint64)) for n in (300, 60, 60))
    cells = np.concatenate((np.sort(np.concatenate((common, a))), np.sort(np.concatenate((common, b)))))
    s = near_dedup.dart_signatures(cells, np.array([0, 360, 720]), 4096)
    assert (s[0] == s[1]).mean() == pytest.approx(300 / 420, abs=0.03)
