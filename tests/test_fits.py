"""Fits, pools, grids, gates and nested JSON against plain computations."""

import datetime
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.functions import catalog, nested
from ledgerline.operators import calibration, fits, gates

T0 = datetime.datetime(2024, 1, 1)


def season(n=400, teams=8, seed=1):
    draw = random.Random(seed)
    out = []
    for k in range(n):
        h, a = draw.sample(range(teams), 2)
        goals = lambda x: min(9, sum(draw.random() < x / 20 for _ in range(20)))
        out.append((h, a, h % 3 if k % 17 else None, goals(1.0 + h / 8), goals(0.8 + a / 10), T0 + datetime.timedelta(days=k) if k % 23 else None))
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "home long, away long, league long, home_goals int, away_goals int, match_date timestamp")


def plain_fit(rows, decay, shrink, prior, tolerance, rounds=1000):
    days = [r[5] for r in rows if r[5]]
    last, first = max(days), min(days)
    w = np.array([math.exp(-decay * ((last - (r[5] or first)).total_seconds() / 86400)) for r in rows])
    hg, ag = (np.array([r[k] for r in rows], float) for k in (3, 4))
    gh, ga = (w * hg).sum() / w.sum(), (w * ag).sum() / w.sum()
    hb, ab = np.full(len(rows), gh), np.full(len(rows), ga)
    for league in {r[2] for r in rows} - {None}:
        own = np.array([r[2] == league for r in rows])
        hb[own] = ((w * hg)[own].sum() + shrink * gh) / (w[own].sum() + shrink)
        ab[own] = ((w * ag)[own].sum() + shrink * ga) / (w[own].sum() + shrink)
    h, a = (np.array([r[k] for r in rows]) for k in (0, 1))
    n = max(h.max(), a.max()) + 1
    total = lambda at, v: np.bincount(at, v, n)
    att, dfn = np.ones(n), np.ones(n)
    for k in range(rounds):
        new_att = (total(h, w * hg) + total(a, w * ag) + prior) / (total(h, w * dfn[a] * hb) + total(a, w * dfn[h] * ab) + prior)
        new_dfn = (total(h, w * ag) + total(a, w * hg) + prior) / (total(h, w * att[a] * ab) + total(a, w * att[h] * hb) + prior)
        new_att /= new_att.mean()
        change = max(abs(new_att - att).max(), abs(new_dfn - dfn).max())
        att, dfn = new_att, new_dfn
        if change < tolerance:
            break
    return att, dfn, k + 1, (w, h, a, hb, ab)


@pytest.fixture(scope="module")
def fitted(spark):
    rows = season()
    return rows, fits.strengths(frame(spark, rows), 0.002, 50.0, 5.0, tolerance=1e-7)


def test_strengths_equal_a_plain_fit(fitted):
    rows, got = fitted
    att, dfn, rounds, _ = plain_fit(rows, 0.002, 50.0, 5.0, 1e-7)
    ratings = {r.team: (r.attack, r.defence) for r in got.ratings.collect()}
    assert got.converged and abs(got.rounds - rounds) <= 1 and not got.oscillates
    for t in range(len(att)):
        assert ratings[t] == pytest.approx((att[t], dfn[t]), abs=1e-6)


def test_strengths_report_that_they_did_not_settle_and_take_no_matches(spark):
    got = fits.strengths(frame(spark, season(60)), rounds=2)
    assert not got.converged and got.rounds == 2
    none = fits.strengths(frame(spark, season(3)).limit(0))
    assert none.ratings.count() == 0


def test_low_score_rho_is_the_likeliest(fitted):
    rows, got = fitted
    rho, gain = fits.low_score_rho(fits.means(got.pairs, got.ratings))
    att, dfn, _, (w, h, a, hb, ab) = plain_fit(rows, 0.002, 50.0, 5.0, 1e-9)
    lh, la = att[h] * dfn[a] * hb, att[a] * dfn[h] * ab

    def value(r):
        out = 0.0
        for k, row in enumerate(rows):
            f = {(0, 0): 1 - lh[k] * la[k] * r, (0, 1): 1 + lh[k] * r, (1, 0): 1 + la[k] * r, (1, 1): 1 - r}.get(row[3:5], 1.0)
            out += w[k] * math.log(f) if f > 0 else -1e9
        return out

    assert gain == pytest.approx(value(rho), abs=1e-5) and all(value(rho) >= value(rho + d) - 1e-9 for d in (-0.05, -1e-3, 1e-3, 0.05))


def test_margin_factors_are_the_likeliest(spark):
    draw = random.Random(5)
    rows = [(0.5 + draw.random() * 2, 0.5 + draw.random() * 2, draw.choice([0, 0, 1, 2, 3])) for _ in range(300)]
    df = spark.createDataFrame([(h, a, 1.0, *(float(m == k) for k in (0, 1))) for h, a, m in rows], "home double, away double, w double, n0 double, n1 double")
    got = fits.margin_factors(df, {0: "n0", 1: "n1"}, "w", 8)

    def value(t):
        out = 0.0
        for h, a, m in rows:
            p = np.outer(*[[math.exp(-x) * x**k / math.factorial(k) for k in range(9)] for x in (h, a)])
            gap = np.abs(np.subtract.outer(np.arange(9), np.arange(9)))
            mass = [p[gap == k].sum() * math.exp(t.get(k, 0.0)) for k in range(9)]
            out += math.log(mass[m] / sum(mass))
        return out

    best = value(got)
    assert all(best >= value({**got, k: got[k] + d}) for k in got for d in (-0.02, 0.02))


def test_blend_is_as_good_as_a_fine_grid(spark):
    draw = random.Random(6)
    rows = []
    for _ in range(400):
        p = draw.random()
        rows.append((min(1.0, max(0.0, p + draw.gauss(0, 0.1))), draw.random(), min(0.99, p * 0.5 + 0.3), int(draw.random() < p)))
    df = spark.createDataFrame([*rows, (float("nan"), 0.5, 0.5, 1), (None, 0.5, 0.5, 0)], "a double, b double, c double, y int")
    w, loss = fits.blend_weights(df, ["a", "b", "c"], "y")
    x = np.array(rows)

    def value(w):
        p = np.clip(x[:, :3] @ w, 1e-12, 1 - 1e-12)
        return -np.mean(np.where(x[:, 3] == 1, np.log(p), np.log(1 - p)))

    grid = min(value((i / 100, j / 100, 1 - i / 100 - j / 100)) for i in range(5, 91) for j in range(5, 96 - i) if 100 - i - j >= 5)
    assert sum(w) == pytest.approx(1) and min(w) >= 0.05 - 1e-9 and loss == pytest.approx(value(w), abs=1e-9) and loss <= grid + 1e-4


def test_least_squares_equal_numpys(spark):
    draw = random.Random(7)
    rows = [(draw.random(), draw.gauss(5, 2), draw.random() * 9) for _ in range(80)]
    rows = [(a, b, c, 2 + 3 * a - b + 0.1 * c + draw.gauss(0, 0.3)) for a, b, c in rows]
    got = {r.term: r for r in fits.least_squares(spark.createDataFrame([*rows, (None, 1.0, 1.0, 1.0)], "a double, b double, c double, y double"), ["a", "b", "c"], "y").collect()}
    x, y = np.array([(1, *r[:3]) for r in rows]), np.array([r[3] for r in rows])
    beta = np.linalg.lstsq(x, y, rcond=None)[0]
    rss = ((y - x @ beta) ** 2).sum()
    se = np.sqrt(np.diag(np.linalg.inv(x.T @ x)) * rss / (len(y) - 4))
    for k, t in enumerate(["intercept", "a", "b", "c"]):
        assert (got[t].coefficient, got[t].se, got[t].n, got[t].r2) == pytest.approx((beta[k], se[k], 80, 1 - rss / ((y - y.mean()) ** 2).sum()), rel=1e-6)
    flat = fits.least_squares(spark.createDataFrame([(1.0, 2.0), (1.0, 3.0), (1.0, 5.0)], "a double, y double"), ["a"], "y").collect()
    assert all(r.coefficient is None for r in flat)


@pytest.mark.parametrize("per_task", [200_000, 20])
def test_isotonic_equals_a_sequential_pass(spark, per_task, monkeypatch):
    monkeypatch.setattr(calibration, "PER_TASK", per_task)
    draw = random.Random(8)
    rows = [(round(draw.random(), 3), 0) for _ in range(600)]
    rows = [(p, int(draw.random() < p * p)) for p, _ in rows]
    pools = []
    for p in sorted({p for p, _ in rows}):
        own = [y for q, y in rows if q == p]
        pools.append([p, p, len(own), sum(own)])
        while len(pools) > 1 and pools[-2][3] / pools[-2][2] >= pools[-1][3] / pools[-1][2]:
            b = pools.pop()
            pools[-1] = [pools[-1][0], b[1], pools[-1][2] + b[2], pools[-1][3] + b[3]]
    df = spark.createDataFrame([*rows, (None, 1), (float("nan"), 0), (0.5, None)], "p double, y int")
    got = sorted((r.low, r.high, r.weight, r.value) for r in calibration.isotonic(df, "p", "y").collect())
    assert got == [pytest.approx((low, high, w, t / w)) for low, high, w, t in pools]
    steps = F.array(*[F.struct(F.lit(x[0]).alias("low"), F.lit(x[1]).alias("high"), F.lit(x[3]).alias("value")) for x in got])
    for p in (-1.0, got[0][0], (got[0][1] + got[1][0]) / 2, 2.0):
        want = np.interp(p, [v for x in got for v in x[:2]], [v for x in got for v in (x[3], x[3])])
        assert spark.range(1).select(calibration.calibrated(F.lit(p), steps)).first()[0] == pytest.approx(want)
    assert calibration.isotonic(df.limit(0), "p", "y").collect() == []


def test_race_ranker_finds_the_likeliest_weights(spark):
    draw = random.Random(9)
    rows = []
    for race in range(150):
        runners = [(draw.random(), draw.random()) for _ in range(draw.randrange(2, 7))]
        best = max(range(len(runners)), key=lambda k: 2 * runners[k][0] - runners[k][1] + draw.gauss(0, 0.7))  # noqa: B023
        rows += [(race, k, int(k == best), *f) for k, f in enumerate(runners)]
    df = spark.createDataFrame([*rows, (999, 0, 0, 0.1, 0.2)], "race_id long, entrant_id long, won int, a double, b double")
    w, path = calibration.listwise(df, ["a", "b"])

    def value(w):
        out = []
        for race in range(150):
            own = [r for r in rows if r[0] == race]
            s = [w[0] * r[3] + w[1] * r[4] for r in own]
            out.append(next(x for x, r in zip(s, own, strict=True) if r[2]) - math.log(sum(map(math.exp, s))))
        return sum(out) / len(out)

    assert path == sorted(path) and path[-1] == pytest.approx(value(w), abs=1e-6)
    assert all(value(w) >= value((w[0] + dx, w[1] + dy)) - 1e-9 for dx in (-0.05, 0, 0.05) for dy in (-0.05, 0, 0.05))


def test_catalogs_equal_array_arithmetic(spark):
    rates = [(1, 1.4, 1.1), (2, 0.3, 2.5), (3, 3.0, 3.0)]
    grid = catalog.cells(spark.createDataFrame(rates, "match_id long, home double, away double"), 10)
    tilted = catalog.margin_tilt(grid.withColumn("t", F.lit(0.6)), ["match_id"], F.col("t"))
    final = catalog.overtime(tilted, ["match_id"], 10, F.lit(0.55)).groupBy("match_id", "i", "j").agg(F.sum("p").alias("p"))
    soccer = {(r.match_id, r.market, r.selection): r.prob for r in catalog.prices(grid, ["match_id"], catalog.SOCCER).collect()}
    hockey = {(r.match_id, r.market, r.selection): r.prob for r in catalog.prices(final, ["match_id"], catalog.HOCKEY_FINAL).collect()}
    regulation = {(r.match_id, r.selection): r.prob for r in catalog.prices(tilted, ["match_id"], catalog.HOCKEY_REGULATION).collect()}
    scores = {(r.match_id, r.selection): r.prob for r in catalog.top_scores(grid, ["match_id"]).collect()}
    k = np.arange(11)
    for m, h, a in rates:
        p = np.outer(*[np.exp(-x) * x**k / np.array([math.factorial(n) for n in k]) for x in (h, a)])
        p /= p.sum()
        gap, total = np.subtract.outer(k, k), np.add.outer(k, k)
        for line in (-1.75, -1.0, -0.5, 0.0, 0.25, 1.25):
            lines = [line - 0.25, line + 0.25] if line * 4 % 2 else [line]
            for name, f in (("home", np.greater), ("away", np.less), ("push", np.equal)):
                want = np.mean([p[f(gap + x, 0)].sum() for x in lines])
                assert soccer[m, "asian_handicap", f"{line:g}_{name}"] == pytest.approx(want, abs=1e-12)
        want = {("1x2", "draw"): gap == 0, ("double_chance", "12"): gap != 0, ("btts", "yes"): (np.minimum.outer(k, k) > 0), ("over_under", "under_2.5"): total < 2.5, ("odd_even", "odd"): total % 2 == 1, ("total_goals", "6+"): total >= 6, ("winning_margin", "away_3plus"): gap <= -3, ("team_total", "away_over_1.5"): np.broadcast_to(k > 1.5, (11, 11)), ("clean_sheet", "home_yes"): np.broadcast_to(k == 0, (11, 11)), ("win_to_nil", "away_no"): ~((gap < 0) & (k == 0)[:, None]), ("result_btts", "home_no"): (gap > 0) & ~(np.minimum.outer(k, k) > 0), ("result_over_under", "draw_over"): (gap == 0) & (total > 2.5)}
        for (market, s), mask in want.items():
            assert soccer[m, market, s] == pytest.approx(p[mask].sum(), abs=1e-12), (market, s)
        assert sum(v for (i, _), v in scores.items() if i == m) == pytest.approx(1) and sum(1 for i, _ in scores if i == m) == 13
        assert hockey[m, "moneyline", "home"] + hockey[m, "moneyline", "away"] == pytest.approx(1)
        r = {s: v for (i, s), v in regulation.items() if i == m}
        assert r["home"] / (r["home"] + r["away"]) == pytest.approx(0.6, abs=1e-9)
        assert hockey[m, "moneyline", "home"] == pytest.approx(r["home"] + 0.55 * r["draw"], abs=1e-9)
        assert hockey[m, "puck_line", "-1.5_home"] < r["home"] and hockey[m, "puck_line", "1.5_home"] > hockey[m, "moneyline", "home"]


PICKS = [
    ("soccer", "1x2", 4.99, 0.4, 0.5, 0.4, True, None), ("Soccer ", " 1X2", 5.0, 0.1, 0.5, 0.45, False, "odds_above_max"), ("soccer", "1x2", None, 0.1, 0.5, 0.45, False, "unknown_odds"),
    ("soccer", "1x2", 2.0, 0.41, 0.5, 0.45, False, "ev_above_max"), ("soccer", "1x2", 2.0, None, 0.5, 0.45, False, "unknown_ev"), ("soccer", "1x2", 2.0, 0.1, 0.5, None, False, "no_market_consensus"),
    ("soccer", "1x2", 2.0, 0.1, None, 0.4, False, "unknown_model_prob"), ("soccer", "1x2", 2.0, 0.1, 0.6, 0.45, False, "gap_above_max"), ("soccer", "btts", 7.99, 0.1, 0.5, 0.45, True, None), ("soccer", "btts", 8.0, 0.1, 0.5, 0.45, False, "odds_above_max"),
    ("soccer", "over_under", 2.0, 0.1, 0.5, 0.45, False, "stream_disabled:soccer:over_under"), ("NFL", "total", 2.0, 0.1, 0.5, 0.45, False, "stream_disabled:nfl:total"), ("horse_racing", "win", 11.99, 1.0, None, None, True, None),
    ("horse_racing", "win", 12.0, 0.1, None, None, False, "odds_above_max"), ("tennis", "games", None, None, None, None, True, None), (None, None, None, None, None, None, True, None),
]


def test_gates_at_their_bounds(spark):
    rows = [(k, *p[:6]) for k, p in enumerate(PICKS)]
    got = {r.k: (r.allowed, r.reason) for r in gates.refusals(spark.createDataFrame(rows, "k int, sport string, bet_type string, odds double, ev double, model_prob double, market_prob double")).collect()}
    assert got == {k: p[6:] for k, p in enumerate(PICKS)}


def test_consensus_pairs_lines_and_leaves_out_what_does_not_count(spark):
    now, old = T0, T0 - datetime.timedelta(hours=7)
    q = []
    for book in "abc":
        q += [(1, "asian_handicap", book, "home", -0.5, 1.9, False, T0, None), (1, "asian_handicap", book, "Away", 0.5, 2.0, False, T0, None), (1, "asian_handicap", book, "away", -0.5, 9.0, False, T0, None)]
        q += [(2, "double_chance", book, s, None, o, False, T0, None) for s, o in (("1X", 1.3), ("12", 1.25), ("X2", 1.6))]
    q += [(2, "double_chance", "d", "1X", None, 1.3, False, T0, None), (2, "double_chance", "d", "12", None, 1.25, False, T0, None), (3, "1x2", "a", "home", None, 2.0, False, T0, None), (3, "1x2", "a", "away", None, 2.0, False, old, None)]
    q += [(4, "1x2", b, s, None, o, False, old, T0 if b != "z" else old) for b in "abcz" for s, o in (("home", 2.0), ("draw", 3.5), ("away", 4.0))] + [(4, "1x2", "q", s, None, 2.0, True, T0, T0) for s in ("home", "away")]
    df = spark.createDataFrame(q, "match_id int, market string, book string, selection string, line double, odds double, is_live boolean, moved_at timestamp, seen_at timestamp")
    got = {(r.match_id, r.selection, r.line): (r.books, r.prob) for r in gates.consensus(df, F.lit(now)).collect()}
    power = lambda ps, total: next(k for k in np.linspace(0.5, 3, 2_500_001) if sum(p**k for p in ps) <= total)
    k = power([1 / 1.9, 1 / 2.0], 1)
    assert got[1, "home", -0.5] == (3, pytest.approx((1 / 1.9) ** k, abs=1e-5)) and got[1, "away", 0.5] == (3, pytest.approx((1 / 2.0) ** k, abs=1e-5))
    assert got[2, "1x", None][0] == 3 and sum(got[2, s, None][1] for s in ("1x", "12", "x2")) == pytest.approx(2)
    assert not any(m == 3 for m, *_ in got) and got[4, "home", None][0] == 3


def test_nested_json_flattens_to_paths(spark):
    blobs = ['{"a": 1, "b": {"c": true, "d.e": 2.5, "f": {"g": {"h": -3}}}, "t": "5", "n": null, "l": [1], "big": 1e400}', "[1, 2]", "no json", None, "7", "{}", '{"x": {"y": 1}}']

    def plain(v, name, out):
        for k, x in v.items():
            key = f"{name}__{k.replace('.', '_')}"
            if isinstance(x, dict):
                plain(x, key, out)
            elif isinstance(x, bool) or isinstance(x, (int, float)) and math.isfinite(x):
                out[key] = float(x)
        return out

    got = {}
    for r in nested.flattened(spark.createDataFrame(list(enumerate(blobs)), "id int, blob string"), "blob").collect():
        got.setdefault(r.id, {})[r.name] = r.value
    assert got == {0: plain(json.loads(blobs[0]), "feature", {}), 6: {"feature__x__y": 1.0}}


def test_merged_objects_let_the_new_members_win(spark):
    cases = [('{"a": 1, "b": "x"}', '{"b": {"c": 2}, "d": true}', {"a": 1, "b": {"c": 2}, "d": True}), (None, '{"a": null}', {"a": None}), ('{"a": [1, 2]}', None, {"a": [1, 2]}), (None, None, {})]
    rows = spark.createDataFrame([(k, o, n) for k, (o, n, _) in enumerate(cases)], "k int, o string, n string").select("k", nested.merged(F.col("o"), F.col("n")).alias("m")).collect()
    assert {r.k: json.loads(r.m) for r in rows} == {k: w for k, (_, _, w) in enumerate(cases)}
