"""Decisions on prices and predictions: blends, half-time results, returns, accumulators, swapped sides, lines and their worth, bootstraps, travel."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ledgerline.functions.grids import proportional
from ledgerline.functions.prices import haversine
from ledgerline.sources.views import MATCHES, PREDICTIONS, matches, predictions, table
from ledgerline.sources.work import spread

from .markets import _VALUE, value_rows
from .registry import query


def r6(c):
    return F.round(c, 6)


def added(values, start=0.0):
    return F.aggregate(values, F.lit(start), lambda a, x: a + x)


def middle(values):
    """The median of an array."""
    s, n = F.array_sort(values), F.size(values)
    return (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2


def floored(logits, least=0.05):
    """Softmax weights, none below a least weight, to the sum of one."""
    e = [math.exp(x) for x in logits]
    w = [max(x / sum(e), least) for x in e]
    return [x / sum(w) for x in w]


#: Stand-in: what a fit of the members would give.
WEIGHTS = floored([0.4, 0.2, 0.1, -3.0])


@query(f"""WITH {PREDICTIONS}, v AS (SELECT doc_id, unnest([1, 2, 3, 4]) AS k, unnest([CASE WHEN doc_id % 15 = 0 THEN 'nan'::DOUBLE ELSE p END, CASE WHEN doc_id % 10 = 0 THEN 'inf'::DOUBLE ELSE p * p END, CASE WHEN doc_id % 6 = 0 THEN NULL ELSE sqrt(p) END, (p + 1) / 3]) AS x FROM p),
 w AS (SELECT *, {WEIGHTS}[k]::DOUBLE AS w, x IS NOT NULL AND isfinite(x) AS fine FROM v)
SELECT doc_id, count(*) FILTER (WHERE fine) AS members, round(sum(w) FILTER (WHERE fine), 6) AS surviving, CASE WHEN sum(w) FILTER (WHERE fine) >= 0.5 THEN round(sum(w * x) FILTER (WHERE fine) / sum(w) FILTER (WHERE fine), 6) END AS blended FROM w GROUP BY doc_id""")
def d28_ensemble_blend(spark, folder):
    """Members' probabilities blended by floored softmax weights (D28): a member that is not finite drops out, and under half of the weight the blend is refused. Stand-ins: four members from one prediction; the weights are parameters, not fitted here.

    The members lie in the row, so nothing is shuffled."""
    p, k = F.col("p"), F.col("doc_id")
    members = [F.when(k % 15 == 0, float("nan")).otherwise(p), F.when(k % 10 == 0, float("inf")).otherwise(p * p), F.when(k % 6 == 0, None).otherwise(F.sqrt(p)), (p + 1) / 3]
    pairs = F.array(*[F.struct(F.lit(w).alias("w"), m.alias("x")) for w, m in zip(WEIGHTS, members, strict=True)])
    fine = F.filter(pairs, lambda m: m["x"].isNotNull() & ~F.isnan(m["x"]) & (F.abs(m["x"]) < float("inf")))
    x = predictions(spark, folder).select("doc_id", fine.alias("m"))
    weight = added(F.transform("m", lambda m: m["w"]))
    return x.select("doc_id", F.size("m").cast("long").alias("members"), r6(weight).alias("surviving"), F.when(weight >= 0.5, r6(added(F.transform("m", lambda m: m["w"] * m["x"])) / weight)).alias("blended"))


GOALS = 5
_SIDES = "CASE WHEN {0} > 0 THEN 'home' WHEN {0} < 0 THEN 'away' ELSE 'draw' END"
_SIGNS = {"home": lambda d: d > 0, "draw": lambda d: d == 0, "away": lambda d: d < 0}


@query(f"""WITH s AS (SELECT p_partkey AS id, (p_size % 10 + 1)::DOUBLE / 10 AS h1, (p_partkey % 8 + 1)::DOUBLE / 10 AS a1, (p_partkey % 9 + 2)::DOUBLE / 10 AS h2, (p_size % 7 + 2)::DOUBLE / 10 AS a2 FROM part), i AS (SELECT CAST(range AS INTEGER) AS i FROM range({GOALS + 1})), j AS (SELECT i AS j FROM i),
 g AS (SELECT id, i, j, exp(-h1) * pow(h1, i) / factorial(i) * exp(-a1) * pow(a1, j) / factorial(j) AS p, exp(-h2) * pow(h2, i) / factorial(i) * exp(-a2) * pow(a2, j) / factorial(j) AS r FROM s, i, j),
 d AS (SELECT id, i - j AS d, sum(p) AS p, sum(r) AS r FROM g GROUP BY ALL), t AS (SELECT id, sum(p) AS p, sum(r) AS r FROM d GROUP BY id),
 o AS (SELECT x.id, {_SIDES.format("x.d")} || '_' || {_SIDES.format("x.d + y.d")} AS k, sum(x.p * y.r) AS v FROM d x JOIN d y ON x.id = y.id GROUP BY ALL),
 w AS (SELECT o.id, {", ".join(f"round(sum(v) FILTER (WHERE k = '{a}_{b}') / any_value(t.p * t.r), 6) AS {a}_{b}" for a in _SIGNS for b in _SIGNS)} FROM o JOIN t ON t.id = o.id GROUP BY o.id),
 h AS (SELECT id, {", ".join(f"round(sum(p) FILTER (WHERE i + j > {n}.5) / sum(p), 6) AS ht_over_{n}_5" for n in range(3))}, round(sum(p) FILTER (WHERE i > 0 AND j > 0) / sum(p), 6) AS ht_both_score, round(sum(p) FILTER (WHERE i > j) / sum(p), 6) AS ht_home FROM g GROUP BY id)
SELECT w.*, h.* EXCLUDE (id) FROM w JOIN h ON h.id = w.id""")
def d26_half_time(spark, folder):
    """Half-time markets and the joint half-time / full-time result (D26). Stand-ins: a part is a match, its expected goals come from its numbers, goals are independent.

    The result needs only the goal differences of both halves: two short arrays in the row and one fold over their pairs."""
    s = table(spark, folder, "part").select(F.col("p_partkey").alias("id"), ((F.col("p_size") % 10 + 1) / 10).alias("h1"), ((F.col("p_partkey") % 8 + 1) / 10).alias("a1"), ((F.col("p_partkey") % 9 + 2) / 10).alias("h2"), ((F.col("p_size") % 7 + 2) / 10).alias("a2"))
    goals, gaps = F.sequence(F.lit(0), F.lit(GOALS)), F.sequence(F.lit(-GOALS), F.lit(GOALS))
    at = lambda values, i: F.coalesce(F.get(values, i), F.lit(0.0))
    chances = lambda rate: F.transform(goals, lambda i: F.exp(-rate) * F.pow(rate, i) / F.factorial(i))
    shares = lambda raw: F.transform(raw, lambda x: x / added(raw))
    differences = lambda h, a: F.transform(gaps, lambda d: added(F.transform(goals, lambda i: at(h, i) * F.when(i >= d, at(a, i - d)).otherwise(0.0))))
    rates = ("h1", "a1", "h2", "a2")
    s = s.select("id", *[chances(F.col(c)).alias(c) for c in rates]).select("id", *[shares(F.col(c)).alias(f"p_{c}") for c in rates])
    s = s.select("*", *[differences(F.col(f"p_h{n}"), F.col(f"p_a{n}")).alias(f"d{n}") for n in (1, 2)])

    def joint(half, full):
        after = lambda d: added(F.transform(gaps, lambda e: F.when(full(d + e), at(F.col("d2"), e + GOALS)).otherwise(0.0)))
        return added(F.transform(gaps, lambda d: F.when(half(d), at(F.col("d1"), d + GOALS) * after(d)).otherwise(0.0)))

    h, a = F.col("p_h1"), F.col("p_a1")
    few = lambda n: sum((at(h, F.lit(i)) * at(a, F.lit(j)) for i in range(n + 1) for j in range(n + 1 - i)), F.lit(0.0))
    return s.select(
        "id", *[r6(joint(f, g)).alias(f"{k}_{m}") for k, f in _SIGNS.items() for m, g in _SIGNS.items()], *[r6(1 - few(n)).alias(f"ht_over_{n}_5") for n in range(3)],
        r6((1 - h[0]) * (1 - a[0])).alias("ht_both_score"), r6(added(F.slice("d1", GOALS + 2, GOALS))).alias("ht_home"),
    )


@query(f"""WITH {PREDICTIONS}, b AS (SELECT sport, CASE WHEN p >= 0.5 THEN 1 ELSE 0 END = y AS won, 1.5::DOUBLE + (doc_id % 20)::DOUBLE / 10 AS odds FROM p WHERE greatest(p, 1 - p) >= 0.6)
SELECT sport, count(*) AS bets_placed, count(*) FILTER (WHERE won) AS bets_won, round(count(*) * 2.0::DOUBLE, 6) AS total_staked, round(sum(CASE WHEN won THEN 2 * odds ELSE 0 END), 6) AS total_return, round(sum(CASE WHEN won THEN 2 * odds ELSE 0 END) - count(*) * 2, 6) AS profit,
 round((sum(CASE WHEN won THEN 2 * odds ELSE 0 END) - count(*) * 2) / (count(*) * 2), 6) AS roi, round(count(*) FILTER (WHERE won) / count(*), 6) AS win_rate FROM b GROUP BY sport""")
def d32_roi(spark, folder):
    """Return on stakes of 2 on the likelier outcome, only where its probability reaches 0.6."""
    stake, p = 2.0, F.col("p")
    b = predictions(spark, folder).where(F.greatest(p, 1 - p) >= 0.6).select("sport", (F.when(p >= 0.5, 1).otherwise(0) == F.col("y")).alias("won"), (F.lit(1.5) + F.col("doc_id") % 20 / 10).alias("odds"))
    x = b.groupBy("sport").agg(F.count(F.lit(1)).alias("bets_placed"), F.count_if("won").alias("bets_won"), F.sum(F.when(F.col("won"), stake * F.col("odds")).otherwise(0.0)).alias("back"))
    staked, back = F.col("bets_placed") * stake, F.col("back")
    return x.select("sport", "bets_placed", "bets_won", r6(staked).alias("total_staked"), r6(back).alias("total_return"), r6(back - staked).alias("profit"), r6(F.try_divide(back - staked, staked)).alias("roi"), r6(F.try_divide("bets_won", "bets_placed")).alias("win_rate"))


MIN_LEGS, MAX_LEGS, MAX_ODDS, BANKROLL = 2, 6, 50.0, 1000.0
_STOP = f"((a.odds * f.odds > {MAX_ODDS} AND a.legs >= {MIN_LEGS}) OR a.legs >= {MAX_LEGS})"
_TAKE = f"(a.open AND NOT {_STOP})"


@query(f"""WITH RECURSIVE {_VALUE}, {MATCHES}, k AS (SELECT strftime(match_date, '%Y-%m') AS round_id, p, odds, row_number() OVER (PARTITION BY strftime(match_date, '%Y-%m'), league_id ORDER BY round(p, 9) DESC, c.match_id) AS rn, league_id FROM c JOIN m ON m.match_id = c.match_id WHERE round(p, 9) >= 0.4), f AS (SELECT * FROM k WHERE rn <= {3 * MAX_LEGS}),
 a AS (SELECT DISTINCT round_id, league_id, 0::BIGINT AS rn, 0 AS legs, 1.0::DOUBLE AS odds, 1.0::DOUBLE AS prob, true AS open FROM f
 UNION ALL SELECT a.round_id, a.league_id, f.rn, CASE WHEN {_TAKE} THEN a.legs + 1 ELSE a.legs END, CASE WHEN {_TAKE} THEN a.odds * f.odds ELSE a.odds END, CASE WHEN {_TAKE} THEN a.prob * f.p ELSE a.prob END, {_TAKE} FROM a JOIN f ON f.round_id = a.round_id AND f.league_id = a.league_id AND f.rn = a.rn + 1),
 z AS (SELECT round_id, league_id, max(rn) AS rn FROM a GROUP BY ALL), y AS (SELECT a.* FROM a JOIN z ON z.round_id = a.round_id AND z.league_id = a.league_id AND z.rn = a.rn WHERE legs >= {MIN_LEGS})
SELECT round_id, league_id, legs, round(odds, 6) AS total_odds, round(prob, 6) AS probability, round(prob * odds - 1, 6) AS ev, round({BANKROLL} * greatest(0, (prob * odds - 1) / (odds - 1)) * 0.25, 4) AS stake FROM y""")
def d39_accumulators(spark, folder):
    """Accumulators of the likeliest bets (D39), one a league and month: legs are added until the odds would pass 50 with two legs or more, or six are in; a quarter of the Kelly stake. Fewer than two legs make none.

    The bound of 18 candidates is the feature's own, so the fold runs over short arrays."""
    from ledgerline.operators.relational import latest_by

    m = matches(spark, folder).select("match_id", "league_id", F.date_format("match_date", "yyyy-MM").alias("round_id"))
    c = value_rows(spark, folder).withColumn("sure", F.round("p", 9)).where("sure >= 0.4").join(m, "match_id")
    top = latest_by(c, ["round_id", "league_id"], [F.desc("sure"), F.asc("match_id")], 3 * MAX_LEGS)
    lists = top.groupBy("round_id", "league_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("sure")).alias("k"), "match_id", "p", "odds"))).alias("bets"))
    state = lambda legs, odds, prob, open_: F.struct(legs.alias("legs"), odds.alias("odds"), prob.alias("prob"), open_.alias("open"))

    def step(s, b):
        stop = ((s["odds"] * b["odds"] > MAX_ODDS) & (s["legs"] >= MIN_LEGS)) | (s["legs"] >= MAX_LEGS)
        take = s["open"] & ~stop
        return state(F.when(take, s["legs"] + 1).otherwise(s["legs"]), F.when(take, s["odds"] * b["odds"]).otherwise(s["odds"]), F.when(take, s["prob"] * b["p"]).otherwise(s["prob"]), take)

    x = lists.select("round_id", "league_id", F.aggregate("bets", state(F.lit(0), F.lit(1.0), F.lit(1.0), F.lit(True)), step).alias("s")).select("round_id", "league_id", "s.*").where(F.col("legs") >= MIN_LEGS)
    ev = F.col("prob") * F.col("odds") - 1
    return x.select("round_id", "league_id", "legs", r6("odds").alias("total_odds"), r6("prob").alias("probability"), r6(ev).alias("ev"), F.round(BANKROLL * F.greatest(F.lit(0.0), ev / (F.col("odds") - 1)) * 0.25, 4).alias("stake"))


@query("""WITH l AS (SELECT l_orderkey AS event_id, l_linenumber % 5 AS book, median((round(l_discount * 100) - 5) / 2) AS line, median((round(l_tax * 100) - 4) / 20) AS margin FROM lineitem GROUP BY ALL),
 p AS (SELECT l.event_id, l.book, any_value(l.line) AS line, any_value(l.margin) AS margin, count(*) AS peers, median(o.line) AS line_consensus, median(o.margin) AS margin_consensus FROM l JOIN l o ON o.event_id = l.event_id AND o.book <> l.book GROUP BY l.event_id, l.book)
SELECT *, abs(margin) >= 0.04 AND abs(margin_consensus) >= 0.04 AND margin * margin_consensus < 0 AS swapped FROM p WHERE peers >= 2 AND line * line_consensus < 0""")
def d48_side_swaps(spark, folder):
    """Books whose home handicap has the sign opposite to the median of two other books or more; swapped if their match-winner margin is opposite too, by 0.04 on both sides, else only suspected (D48). Stand-ins: discounts are handicaps, taxes margins, line numbers books.

    A book's several lines stand for their median; the books of an event are few, so peers are an array in its row."""
    li = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("event_id"), (F.col("l_linenumber") % 5).alias("book"), ((F.round(F.col("l_discount") * 100) - 5) / 2).alias("line"), ((F.round(F.col("l_tax") * 100) - 4) / 20).alias("margin"))
    books = li.groupBy("event_id", "book").agg(F.median("line").alias("line"), F.median("margin").alias("margin"))
    events = books.groupBy("event_id").agg(F.collect_list(F.struct("book", "line", "margin")).alias("all"))
    own = events.select("event_id", "all", F.explode("all").alias("o")).select("event_id", "o.*", F.filter("all", lambda x: x["book"] != F.col("o.book")).alias("rest")).where(F.size("rest") >= 2)
    own = own.select("event_id", "book", "line", "margin", F.size("rest").cast("long").alias("peers"), middle(F.transform("rest", lambda x: x["line"])).alias("line_consensus"), middle(F.transform("rest", lambda x: x["margin"])).alias("margin_consensus"))
    m, c = F.col("margin"), F.col("margin_consensus")
    return own.where("line * line_consensus < 0").withColumn("swapped", (F.abs(m) >= 0.04) & (F.abs(c) >= 0.04) & (m * c < 0))


TOP = 70
_PROFILE = ("total", "odd", "low", "spread")


@query(f"""WITH d AS (SELECT o_orderkey AS draw, CASE WHEN o_orderkey % 8 = 0 THEN [3, 6, 9, 12, 15] ELSE [1 + o_orderkey * 3 % 10, 11 + o_orderkey * 5 % 7, 18 + o_orderkey * 9 % 14, 32 + o_custkey * 11 % 14, 57 + o_orderkey * 13 % 14] END AS n FROM orders),
 f AS (SELECT draw, n, list_sum(n)::DOUBLE AS total, len([x for x in n if x % 2 = 1])::DOUBLE AS odd, len([x for x in n if x <= {TOP // 2}])::DOUBLE AS low, (n[5] - n[1])::DOUBLE AS spread FROM d),
 z AS (SELECT count(*) AS draws, {", ".join(f"avg({c}) AS m_{c}, CASE WHEN stddev_pop({c}) > 0 THEN stddev_pop({c}) ELSE 1 END AS s_{c}" for c in _PROFILE)} FROM f),
 p AS (SELECT f.*, z.*, least(1.0, 0.5 * len([x for x in n if x <= 31]) / 5 + 0.28 * len([x for x in n if x <= 12]) / 5 + CASE WHEN len(list_distinct([n[i + 1] - n[i] for i in range(1, 5)])) = 1 THEN 0.25 ELSE 0 END + CASE WHEN list_contains(n, 7) THEN 0.06 ELSE 0 END + CASE WHEN len(list_distinct([(x - 1) // 10 for x in n])) <= 2 THEN 0.05 ELSE 0 END)::DOUBLE AS popularity FROM f, z)
SELECT draw, round(popularity, 6) AS popularity, round(1 - popularity, 6) AS ev_score, round(CASE WHEN draws < 30 THEN 0.5 ELSE exp(-0.5 * ({" + ".join(f"pow(({c} - m_{c}) / s_{c}, 2)" for c in _PROFILE)}) / 4) END, 6) AS profile_fit FROM p""")
def x37_line_scores(spark, folder):
    """How often people pick a line, what that leaves of its worth, and how typical it looks against all draws; neutral under 30 draws (X37). Stand-ins: an order is a draw. The profile is one row of sums."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    line = F.when(k % 8 == 0, F.array(*[F.lit(x).cast("long") for x in (3, 6, 9, 12, 15)])).otherwise(F.array(1 + k * 3 % 10, 11 + k * 5 % 7, 18 + k * 9 % 14, 32 + c * 11 % 14, 57 + k * 13 % 14))
    d = table(spark, folder, "orders").select(k.alias("draw"), line.alias("n"))
    few = lambda test: F.size(F.filter("n", test))
    f = d.select("*", F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x).cast("double").alias("total"), few(lambda x: x % 2 == 1).cast("double").alias("odd"), few(lambda x: x <= TOP // 2).cast("double").alias("low"), (F.element_at("n", -1) - F.get("n", F.lit(0))).cast("double").alias("spread"))
    one = f.agg(F.count(F.lit(1)).alias("draws"), *[F.avg(x).alias(f"m_{x}") for x in _PROFILE], *[F.when(F.stddev_pop(x) > 0, F.stddev_pop(x)).otherwise(1.0).alias(f"s_{x}") for x in _PROFILE])
    steps = F.transform(F.sequence(F.lit(0), F.size("n") - 2), lambda i: F.get("n", i + 1) - F.get("n", i))
    score = 0.5 * few(lambda x: x <= 31) / F.size("n") + 0.28 * few(lambda x: x <= 12) / F.size("n") + F.when(F.size(F.array_distinct(steps)) == 1, 0.25).otherwise(0.0) + F.when(F.array_contains("n", 7), 0.06).otherwise(0.0) + F.when(F.size(F.array_distinct(F.transform("n", lambda x: F.floor((x - 1) / 10)))) <= 2, 0.05).otherwise(0.0)
    z = sum((F.pow((F.col(x) - F.col(f"m_{x}")) / F.col(f"s_{x}"), 2) for x in _PROFILE), F.lit(0.0))
    p = f.crossJoin(F.broadcast(one)).withColumn("popularity", F.least(F.lit(1.0), score))
    return p.select("draw", r6("popularity").alias("popularity"), r6(1 - F.col("popularity")).alias("ev_score"), r6(F.when(F.col("draws") < 30, 0.5).otherwise(F.exp(-0.5 * z / 4))).alias("profile_fit"))


@query("""WITH e AS (SELECT p_partkey AS era, 35 + p_size AS n, CAST(4 + p_partkey % 3 AS INTEGER) AS k, CAST(9 + p_size % 6 AS INTEGER) AS bonus, p_retailprice * 1e6 AS jackpot, (p_partkey % 5)::DOUBLE / 100 AS state, CASE WHEN p_partkey % 7 > 0 THEN p_retailprice * (p_partkey % 7) * 3e4 ELSE 0 END AS tickets FROM part), t AS (SELECT *, CAST(unnest(range(1, k + 1)) AS INTEGER) AS m FROM e),
 c AS (SELECT *, coalesce(list_product([(k - i)::DOUBLE / (i + 1) for i in range(m)]), 1) AS hit, coalesce(list_product([(n - k - i)::DOUBLE / (i + 1) for i in range(k - m)]), 1) AS missed, list_product([(n - i)::DOUBLE / (i + 1) for i in range(k)]) AS total FROM t),
 s AS (SELECT era, any_value(jackpot) AS jackpot, any_value(tickets) AS tickets, any_value(1 - 0.37 - state)::DOUBLE AS kept, any_value(1 / (total * bonus)) AS chance, sum(pow(5, m) * hit * missed / total * (bonus - 1) / bonus) AS small FROM c GROUP BY era),
 v AS (SELECT *, tickets * chance AS lam, CASE WHEN tickets * chance > 0 THEN (1 - exp(-tickets * chance)) / (tickets * chance) ELSE 1 END AS share FROM s), w AS (SELECT *, 1.5 * kept * small AS ex, jackpot * 0.45 * kept * chance * share AS main FROM v)
SELECT era, round(lam, 6) AS expected_co_winners, round(share, 6) AS share_factor, round(ex, 6) AS ev_ex_jackpot, round(main, 6) AS ev_jackpot_term, round(ex + main, 6) AS ev_total, round(greatest(0, (1 - (ex + main) / 2) * 100), 4) AS expected_loss_pct, ex + main >= 2 AS worth_it FROM w""")
def d53_lottery_worth(spark, folder):
    """What a ticket of 2 is worth after tax: lesser prizes times the mean multiplier, and the cash jackpot shared with the expected co-winners (D53). Stand-ins: a part is a game with its jackpot, tickets and prize table; the sales curve and the break-even jackpot are not built."""
    p, size, price = F.col("p_partkey"), F.col("p_size"), F.col("p_retailprice")
    e = table(spark, folder, "part").select(p.alias("era"), (size + 35).alias("n"), (p % 3 + 4).cast("int").alias("k"), (size % 6 + 9).cast("int").alias("bonus"), (price * 1e6).alias("jackpot"), (F.lit(1 - 0.37) - p % 5 / 100).alias("kept"), (price * (p % 7) * 3e4).alias("tickets"))
    choose = lambda n, k: F.when(k < 1, 1.0).otherwise(F.aggregate(F.sequence(F.lit(0), F.greatest(k - 1, F.lit(0))), F.lit(1.0), lambda a, i: a * (n - i) / (i + 1)))
    n, k, bonus = F.col("n"), F.col("k"), F.col("bonus")
    e = e.withColumn("total", choose(n, k))
    tiers = F.transform(F.sequence(F.lit(1), k), lambda m: F.pow(F.lit(5.0), m) * choose(k, m) * choose(n - k, k - m) / F.col("total") * (bonus - 1) / bonus)
    v = e.select("era", "jackpot", "kept", (1 / (F.col("total") * bonus)).alias("chance"), "tickets", added(tiers).alias("small")).withColumn("lam", F.col("tickets") * F.col("chance"))
    v = v.withColumn("share", F.when(F.col("lam") > 0, (1 - F.exp(-F.col("lam"))) / F.col("lam")).otherwise(1.0)).withColumn("ex", 1.5 * F.col("kept") * F.col("small")).withColumn("main", F.col("jackpot") * 0.45 * F.col("kept") * F.col("chance") * F.col("share"))
    worth = F.col("ex") + F.col("main")
    return v.select("era", r6("lam").alias("expected_co_winners"), r6("share").alias("share_factor"), r6("ex").alias("ev_ex_jackpot"), r6("main").alias("ev_jackpot_term"), r6(worth).alias("ev_total"), F.round(F.greatest(F.lit(0.0), (1 - worth / 2) * 100), 4).alias("expected_loss_pct"), (worth >= 2).alias("worth_it"))


DRAWS = 200
#: Poisson(1) up to 0, 1, 2, ... events.
STEPS = [sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) for k in range(6)]


@query(f"""WITH {PREDICTIONS}, g AS (SELECT sport, doc_id % 97 AS cluster, count(*)::DOUBLE AS n, sum(CASE WHEN y = 1 THEN 1.2 + p ELSE 0 END - 1)::DOUBLE AS gain, count(*) FILTER (WHERE p >= 0.6)::DOUBLE AS n2, coalesce(sum(CASE WHEN y = 1 THEN 1.2 + p ELSE 0 END - 1) FILTER (WHERE p >= 0.6), 0)::DOUBLE AS gain2 FROM p GROUP BY ALL),
 u AS (SELECT g.*, b, ((((sport * 97 + cluster) * 7919 + b * 104729 + 12345) * 48271 % 2147483647) * 40692 % 2147483399)::DOUBLE / 2147483399 AS u FROM g, (SELECT range AS b FROM range({DRAWS}))),
 w AS (SELECT *, {" + ".join(f"CASE WHEN u >= {s} THEN 1 ELSE 0 END" for s in STEPS)} AS w FROM u), r AS (SELECT sport, b, sum(w * gain) / nullif(sum(w * n), 0) AS roi, sum(w * gain2) / nullif(sum(w * n2), 0) AS roi2 FROM w GROUP BY ALL)
SELECT sport, count(roi) AS draws, round(quantile_cont(roi, 0.025), 6) AS low, round(quantile_cont(roi, 0.975), 6) AS high, round(quantile_cont(roi2 - roi, 0.025), 6) AS gap_low, round(quantile_cont(roi2 - roi, 0.975), 6) AS gap_high, round(avg(CASE WHEN roi2 > roi THEN 1.0 WHEN roi2 <= roi THEN 0.0 END::DOUBLE), 6) AS better FROM r GROUP BY sport""")
def n13_bootstrap(spark, folder):
    """Percentile intervals of the return and of its paired difference to a stricter rule, by a Poisson bootstrap over clusters with hash-seeded weights (N13). Rows are reduced to one a cluster before they meet the 200 draws, so reruns agree and the draws cost nothing at size."""
    p, gain = F.col("p"), F.when(F.col("y") == 1, 1.2 + F.col("p")).otherwise(0.0) - 1
    strict = lambda v: F.sum(F.when(p >= 0.6, v).otherwise(0.0))
    g = predictions(spark, folder).groupBy("sport", (F.col("doc_id") % 97).alias("cluster")).agg(F.sum(F.lit(1.0)).alias("n"), F.sum(gain).alias("gain"), strict(F.lit(1.0)).alias("n2"), strict(gain).alias("gain2"))
    u = g.withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(DRAWS - 1).cast("long"))))
    seed = (F.col("sport") * 97 + F.col("cluster")) * 7919 + F.col("b") * 104729 + 12345
    chance = (seed * 48271 % 2147483647) * 40692 % 2147483399 / F.lit(2147483399.0)
    w = u.withColumn("u", chance).withColumn("w", sum(((F.col("u") >= s).cast("int") for s in STEPS), F.lit(0)))
    total = lambda c: F.sum(F.col("w") * F.col(c))
    r = w.groupBy("sport", "b").agg(F.try_divide(total("gain"), total("n")).alias("roi"), F.try_divide(total("gain2"), total("n2")).alias("roi2"))
    roi, gap = F.col("roi"), F.col("roi2") - F.col("roi")
    return r.groupBy("sport").agg(F.count("roi").alias("draws"), *[r6(F.percentile(c, q)).alias(k) for k, c, q in (("low", roi, 0.025), ("high", roi, 0.975), ("gap_low", gap, 0.025), ("gap_high", gap, 0.975))], r6(F.avg((gap > 0).cast("double"))).alias("better"))


@query(f"""WITH {MATCHES}, x AS (SELECT match_id, (home_id * 7 % 50 + 10)::DOUBLE AS lat1, (home_id * 13 % 240 - 120)::DOUBLE AS lon1, (away_id * 7 % 50 + 10)::DOUBLE AS lat2, (away_id * 13 % 240 - 120)::DOUBLE AS lon2 FROM m)
SELECT match_id, round(2 * 6371 * asin(sqrt(pow(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon1) / 2), 2))), 4) AS km, CAST(abs(floor(lon1 / 15) - floor(lon2 / 15)) AS BIGINT) AS zones FROM x""")
def x15_travel(spark, folder):
    """Great-circle kilometres of the away side's journey and the time zones it crosses (X15). Stand-ins: places from the teams' keys, zones of 15 degrees."""
    lat, lon = lambda t: (F.col(t) * 7 % 50 + 10).cast("double"), lambda t: (F.col(t) * 13 % 240 - 120).cast("double")
    km = haversine(lat("home_id"), lon("home_id"), lat("away_id"), lon("away_id"))
    return matches(spark, folder).select("match_id", F.round(km, 4).alias("km"), F.abs(F.floor(lon("home_id") / 15) - F.floor(lon("away_id") / 15)).alias("zones"))


_CELLS = {f"{r}_{t}": (test, over) for r, test in _SIGNS.items() for t, over in (("under", False), ("over", True))}
ROUNDS = 100


@query(f"""WITH RECURSIVE s AS (SELECT p_partkey AS id, (p_size % 10 + 5)::DOUBLE / 10 AS h, (p_partkey % 8 + 5)::DOUBLE / 10 AS a, (p_size % 5 + 2)::DOUBLE AS wh, 2.0::DOUBLE AS wd, (p_partkey % 4 + 2)::DOUBLE AS wa, (p_partkey % 7 + 2)::DOUBLE / 10 AS tv FROM part), i AS (SELECT CAST(range AS INTEGER) AS i FROM range({GOALS + 1})), j AS (SELECT i AS j FROM i),
 g AS (SELECT s.*, i, j, pow(h, i) / factorial(i) * pow(a, j) / factorial(j) AS p FROM s, i, j),
 b AS (SELECT id, any_value(wh / (wh + wd + wa)) AS th, any_value(wd / (wh + wd + wa)) AS td, any_value(wa / (wh + wd + wa)) AS ta, any_value(tv) AS tv, sum(p) FILTER (WHERE i = 1 AND j = 1) / sum(p) AS one_one, {", ".join(f"sum(p) FILTER (WHERE {dict(home='i > j', draw='i = j', away='i < j')[k.split('_')[0]]} AND i + j {'>' if over else '<'} 2.5) / sum(p) AS {k}" for k, (_, over) in _CELLS.items())} FROM g GROUP BY id),
 f AS (SELECT id, 0 AS n, th, td, ta, tv, {", ".join(_CELLS)} FROM b
 UNION ALL SELECT id, n + 1, th, td, ta, tv, home_under * x * u, home_over * x * o, draw_under * y * u, draw_over * y * o, away_under * z * u, away_over * z * o FROM (SELECT *, (1 - tv) / (home_under * x + draw_under * y + away_under * z) AS u, tv / (home_over * x + draw_over * y + away_over * z) AS o FROM
  (SELECT *, th / (home_under + home_over) AS x, td / (draw_under + draw_over) AS y, ta / (away_under + away_over) AS z FROM f WHERE n < {ROUNDS})))
SELECT f.id, {", ".join(f"round(f.{k}, 6) AS {k}" for k in _CELLS)}, round(b.one_one * f.draw_under / b.draw_under, 6) AS one_one FROM f JOIN b ON b.id = f.id WHERE n = {ROUNDS}""")
def d24_fitted_marginals(spark, folder):
    """A score grid fitted to the market's result and total of 2.5 by iterative proportional fitting (D24). Stand-ins: a part is a match, its rates and prices come from its numbers, goals are independent.

    Both marginals only see six blocks of the grid (result by under or over), so the fit runs on six numbers in the row, an Arrow batch of rows at a time, and all cells of a block share its factor."""
    p, size = F.col("p_partkey"), F.col("p_size")
    goals = F.sequence(F.lit(0), F.lit(GOALS))
    raw = lambda rate: F.transform(goals, lambda i: F.pow(rate, i) / F.factorial(i))
    wh, wd, wa = size % 5 + 2, F.lit(2), p % 4 + 2
    s = spread(table(spark, folder, "part").select("p_partkey", "p_size")).select(p.alias("id"), raw((size % 10 + 5) / 10).alias("h"), raw((p % 8 + 5) / 10).alias("a"), F.array(*[w / (wh + wd + wa) for w in (wh, wd, wa)]).alias("t"), ((p % 7 + 2) / 10).alias("tv"))
    whole = added(F.col("h")) * added(F.col("a"))
    cell = lambda i, j: F.get("h", F.lit(i)) * F.get("a", F.lit(j))
    block = lambda test, over: sum((cell(i, j) for i in range(GOALS + 1) for j in range(GOALS + 1) if test(i - j) and (i + j > 2.5) == over), F.lit(0.0)) / whole
    s = s.select("id", "t", "tv", (cell(1, 1) / whole).alias("one_one"), F.array(*[block(*x) for x in _CELLS.values()]).alias("b"))

    f = s.select("*", proportional([F.get("b", F.lit(k)) for k in range(6)], [F.get("t", F.lit(k)) for k in range(3)], F.col("tv"), ROUNDS).alias("f"))
    return f.select("id", *[r6(F.get("f", F.lit(k))).alias(n) for k, n in enumerate(_CELLS)], r6(F.col("one_one") * F.get("f", F.lit(2)) / F.get("b", F.lit(2))).alias("one_one"))
