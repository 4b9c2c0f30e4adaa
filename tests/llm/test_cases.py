"""Nulls in any column, empty and very long texts, ties and repeated rows, empty tables, extra columns with clashing names."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerline.llm import queries

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = ["key", "size", "_words", "times", "class_id", "_leaks", "digest", "Shard", "kept", "range", "_copy", "rid"]


def nasty(spark):
    clean = " ".join(f"The word{i % 40} of line {i} is here." for i in range(30))
    long_ = " ".join(f"tok{i % 5000}" for i in range(200_000))
    rows = [(1, clean, "en", "web"), (1, clean, "en", "web"), (2, None, "en", "web"), (None, clean + " more", "de", None), (None, None, None, None), (3, "", "fr", "books"), (4, long_, None, "web"), (5, " \n\t", "xx", "web"), (6, "x", "en", None), (7, clean, "en", "web"), (1, "other words for the same id", "en", "web")]
    return spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], COLUMNS)


@pytest.fixture(scope="module")
def folders(spark, sf, tmp_path_factory):
    top = tmp_path_factory.mktemp("tables")
    out = {}
    for name, docs in (("nasty", nasty(spark)), ("extra", nasty(spark).withColumns({c: F.lit(7) for c in CLASHES})), ("empty", nasty(spark).limit(0))):
        out[name] = f"{top}/{name}"
        docs.coalesce(1).write.parquet(f"{out[name]}/documents.parquet")
        for t in ("benchmark", "pages", "labels"):
            d = spark.read.parquet(f"{sf}/{t}.parquet")
            (d.limit(0) if name == "empty" else d).coalesce(1).write.parquet(f"{out[name]}/{t}.parquet")
    return out


def plain(row):
    return repr([round(x, 6) if isinstance(x, float) else x for x in row])


@pytest.mark.parametrize("name", [q for q in queries.QUERIES if q not in ("op9_html_extraction", "op13_turn_repair")])
def test_queries_keep_every_row(spark, folders, name):
    assert queries.QUERIES[name](spark, folders["empty"]).count() == 0
    got = queries.QUERIES[name](spark, folders["nasty"])
    rows = got.collect()
    if name == "op6_token_output":
        assert sum(len(r.doc_ids) for r in rows) >= 11
    elif name == "op12_packing":
        assert sorted(str(r.doc_id) for r in rows if r.start == 0) == sorted(map(str, [1, 1, 2, None, None, 3, 4, 5, 6, 7, 1]))
    else:
        ids = [1, 1, 2, None, None, 3, 4, 5, 6, 7, 1]
        assert sorted(map(str, ids)) == sorted(str(r.doc_id) for r in rows)
    # Other columns, whatever their names, change nothing.
    extra = queries.QUERIES[name](spark, folders["extra"])
    assert sorted(map(plain, extra.select(got.columns).collect())) == sorted(map(plain, rows))


@pytest.mark.parametrize("kind", ["nasty", "extra", "empty"])
def test_extraction_of_odd_tables(spark, tmp_path, kind):
    rows = [(1, "http://a.example/1", "<p>one"), (1, "http://a.example/1", "<p>one"), (1, "http://a.example/1", "<p>two &amp; three"), (None, None, None), (None, "http://A.example/1", "<p>no id"), (2, None, ""), (3, "", "plain"), (4, "http://a.example/4", "<")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    if kind == "extra":
        pages = pages.withColumns({c: F.lit(7) for c in ["host", "shape", "wrapper", "nodes", "hashes", "text", "n_chars", "Content", "t"]})
    (pages.limit(0) if kind == "empty" else pages).coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted(queries.QUERIES["op9_html_extraction"](spark, str(tmp_path)).collect(), key=str)
    want = [(1, "http://a.example/1", "one", 3)] * 2 + [(1, "http://a.example/1", "two & three", 11), (None, None, "", 0), (None, "http://A.example/1", "no id", 5), (2, None, "", 0), (3, "", "plain", 5), (4, "http://a.example/4", "<", 1)]
    assert [tuple(r) for r in got] == ([] if kind == "empty" else sorted(want, key=lambda w: str(next(r for r in got if tuple(r) == w))))


@pytest.mark.parametrize("kind", ["nasty", "extra", "empty"])
def test_stages_keep_the_columns(spark, folders, kind):
    docs = spark.read.parquet(f"{folders[kind]}/documents.parquet")
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folders[kind])
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
            out.count()
    out.count()


def test_pipeline_runs_stage_by_stage(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    sizes = [docs.count()]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        before, docs = docs, stage(spark, docs, sf).cache()
        sizes.append(docs.count())
        assert docs.columns == before.columns
        assert docs.select("doc_id").subtract(before.select("doc_id")).count() == 0
    assert sizes[0] > sizes[1] >= sizes[2] >= sizes[3] > 0
    ids = sorted(x for r in corpus_pipeline.run(spark, sf).select("doc_ids", "parts").collect() for x, p in zip(r.doc_ids, r.parts, strict=True) if p == 0)
    assert ids == sorted(r.doc_id for r in docs.select("doc_id").collect())


def clean(word, n=120):
    return " ".join(f"The {word}{i}q of {word}{i}z and {word}{i}k to {word}{i}v in." for i in range(n))


def test_stages_tell_rows_of_one_doc_id_apart(spark, tmp_path):
    rows = [(1, clean("a"), "en", "web"), (1, clean("b"), "en", "web"), (1, "x " * 400, "en", "web"), (1, clean("a"), "en", "web"), (2, clean("b"), "en", "web"), (3, clean("c"), "en", "web")]
    rows += [(None, clean(f"n{i}"), "en", "hot") for i in range(40)] + [(i, clean(f"m{i}"), "en", "cold") for i in range(100, 103)]
    docs = spark.createDataFrame([(*r, len(r[1])) for r in rows], COLUMNS)
    kept = corpus_pipeline.STAGES[0][1](spark, docs, "").collect()
    assert len(kept) == len(rows) - 1 and not [r for r in kept if r.text.startswith("x x")]
    near = corpus_pipeline.STAGES[1][1](spark, docs, "")
    assert sorted((r.doc_id, r.text[:6]) for r in near.where("source = 'web'").collect()) == [(1, "The a0"), (1, "The b0"), (1, "x x x "), (3, "The c0")]
    assert near.where("doc_id is null").count() == 40
    mix = corpus_pipeline.STAGES[3][1](spark, docs, "")
    sizes = {r.source: r.n for r in docs.groupBy("source").agg(F.sum(F.size(F.split("text", " "))).alias("n")).collect()}
    taken = {r.source: r.n for r in mix.groupBy("source").agg(F.sum(F.size(F.split("text", " "))).alias("n")).collect()}
    # Weights 5, 2, 1 for cold, hot, web: cold is capped at twice its size, and what it can't take goes to the others.
    left = 1.5 * sum(sizes.values()) - 2 * sizes["cold"]
    assert taken["cold"] == 2 * sizes["cold"]
    assert taken["hot"] == pytest.approx(min(2 * sizes["hot"], max(left * 2 / 3, left - 2 * sizes["web"])), abs=1500)


def test_a_cluster_needs_a_shared_folder():
    from unittest.mock import MagicMock

    from ledgerline.llm.common import shared_dir

    session = MagicMock()
    session.conf.get.return_value = None
    session.sparkContext._jsc.sc().getCheckpointDir().isDefined.return_value = False
    session.sparkContext.master = "spark://host:7077"
    with pytest.raises(ValueError, match="checkpoint"):
        shared_dir(session)
    session.conf.get.return_value = "hdfs://shared/work"
    assert shared_dir(session) == "hdfs://shared/work"
