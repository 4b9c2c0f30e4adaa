"""Every registered query against its SQL on the smallest tables."""

import math

import duckdb
import pytest

from ledgerline.plans import registry

registry.load()
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def comparable(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    value = lambda x: "null" if x is None or isinstance(x, float) and math.isnan(x) else f"{float(x):.6g}" if isinstance(x, float) or type(x).__name__ == "Decimal" else str(x)
    return sorted(columns), sorted(tuple(value(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query_equals_its_sql(spark, duck, sf, name):
    got = registry.QUERIES[name](spark, sf)
    want = duck.sql(registry.ORACLE[name])
    assert comparable([tuple(r) for r in got.collect()], got.columns) == comparable(want.fetchall(), want.columns)


def test_sequential_elo_is_a_fold(spark, sf):
    got = {r.match_id: (r.home_elo, r.away_elo) for r in registry.QUERIES["n1_sequential_elo"](spark, sf).collect()}
    from ledgerline.sources.views import matches

    rating = {}
    for m in sorted(matches(spark, sf).where("status = 'finished'").collect(), key=lambda m: (m.match_date, m.match_id)):
        h, a = rating.get((m.league_id, m.home_id), 1500.0), rating.get((m.league_id, m.away_id), 1500.0)
        assert got[m.match_id] == pytest.approx((h, a), abs=1e-4)
        score = 1.0 if m.home_score > m.away_score else 0.5 if m.home_score == m.away_score else 0.0
        step = 20 * math.log(abs(m.home_score - m.away_score) + 2) * (score - 1 / (1 + 10 ** ((a - h - 60) / 400)))
        rating[m.league_id, m.home_id], rating[m.league_id, m.away_id] = h + step, a - step


def test_entry_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["w7_team_form", "a9_wide_pivot", "d36_consensus"])
def test_scans_read_only_what_they_need(spark, sf, name):
    plan = registry.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema" in plan and "l_tax" not in plan and "o_orderpriority" not in plan
