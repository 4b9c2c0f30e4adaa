"""The pipeline end to end by value: each stage against a plain computation on its own input, and the texts read back out of the shards."""

import base64
import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers

import corpus_pipeline
from ledgerline.llm import mixing, token_output

SPACES = " \t\n\x0b\f\r"


def words(text):
    for c in SPACES[1:]:
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def shingles(text):
    w = words(text)
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))


def similarity(a, b):
    x, y = shingles(a), shingles(b)
    keys = x.keys() | y.keys()
    return sum(min(x[k], y[k]) for k in keys) / max(1, sum(max(x[k], y[k]) for k in keys))


def fixture(spark, folder):
    draw = random.Random(12)
    plain = "the of and to in is that for it as was with be by on not he his but at are this have from or had an they which one you were all her she there would their we him been has when who will no more if out so up said what its about than into them can only other time new some could these two may first then do any".split()
    vocabulary = [*plain, *("".join(draw.choice("bcdfglmnprst") + draw.choice("aeiou") for _ in range(draw.randrange(2, 4))) for _ in range(600))]
    sentence = lambda: " ".join(draw.choice(plain) if k % 2 else draw.choice(vocabulary) for k in range(draw.randrange(8, 15))).capitalize() + "."
    text = lambda n: " ".join(sentence() for _ in range(n))
    items = [" ".join(vocabulary[150 + 20 * i : 170 + 20 * i]) for i in range(3)]
    docs = [(i, text(draw.randrange(12, 25)), "en", f"s{i % 3}") for i in range(40)]
    docs += [(100, docs[0][1], "en", "s1"), (101, docs[1][1] + " One more word.", "en", "s2"), (102, text(8) + " " + items[1] + " " + text(8), "en", "s0"), (103, "few words only", "en", "s0"), (104, "same thing again " * 60, "en", "s1"), (105, None, "en", "s0")]
    spark.createDataFrame([(*d, len(d[1] or "")) for d in docs], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return {d[0]: d[1:] for d in docs}, items


def test_pipeline_by_value(spark, tmp_path):
    docs, items = fixture(spark, tmp_path)
    stage = [f for _, f in corpus_pipeline.STAGES]
    frame = spark.read.parquet(f"{tmp_path}/documents.parquet")
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    kept = stage[0](spark, frame, str(tmp_path))
    assert ids(kept) == set(docs) - {103, 104, 105}
    near = stage[1](spark, kept, str(tmp_path))
    left = sorted(ids(kept))
    links = {(a, b) for a in left for b in left if a < b and similarity(docs[a][0], docs[b][0]) >= 0.8}
    assert links == {(0, 100), (1, 101)}
    assert ids(near) == ids(kept) - {b for _, b in links}
    clean = stage[2](spark, near, str(tmp_path))
    held = {i for i in ids(near) if any(sum(w in docs[i][0].lower().split() for w in item.split()) == 20 and item in docs[i][0] for item in items)}
    assert held == {102} and ids(clean) == ids(near) - held
    mix = stage[3](spark, clean, str(tmp_path))
    # Targets by plain arithmetic; whole epochs, then documents in the order of their keys up to the cut.
    size = {i: len(words(docs[i][0])) for i in ids(clean)}
    sources = defaultdict(list)
    for i in size:
        sources[docs[i][2]].append(i)
    total = {s: sum(size[i] for i in own) for s, own in sources.items()}
    weight = dict(zip(sorted(total), mixing.WEIGHTS, strict=True))
    target, open_, rest = {}, set(total), 1.5 * sum(total.values())
    while True:
        level = rest / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level > 2 * total[s]}
        if not full:
            target |= {s: weight[s] * level for s in open_}
            break
        target |= {s: 2.0 * total[s] for s in full}
        rest -= sum(2 * total[s] for s in full)
        open_ -= full
    want = Counter()
    for s, own in sources.items():
        epochs = int(target[s] // total[s])
        at, cut = 0, target[s] - epochs * total[s]
        for i in sorted(own, key=lambda i: (hashlib.md5(f"mix:{i}".encode()).hexdigest(), i)):
            want[i] += epochs + (at + size[i] / 2 <= cut)
            at += size[i]
    assert Counter(r.doc_id for r in mix.collect()) == +want
    # The shards of the whole run hold each taken text as often as the mix takes it.
    got, length = defaultdict(dict), token_output.LENGTH
    path = public_tokenizers.path(token_output.TOKENIZER)
    spelled = {int(b): base64.b64decode(a) for a, b in map(bytes.split, open(path, "rb"))}
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        ids_ = np.frombuffer(r.payload, "<u2").reshape(-1, length)
        for doc, part, n, row in zip(r.doc_ids, r.parts, r.n_tokens, ids_, strict=True):
            got[doc].setdefault(part, []).append(row[:n].tolist())
    for doc, n in (+want).items():
        parts = got.pop(doc)
        assert {len(x) for x in parts.values()} == {n} and all(len({tuple(y) for y in x}) == 1 for x in parts.values())
        flat = [t for k in sorted(parts) for t in parts[k][0]]
        assert flat[-1] == token_output.END and b"".join(spelled[t] for t in flat[:-1]).decode() == docs[doc][0]
    assert not got
