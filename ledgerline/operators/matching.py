"""Matching of records that carry names: clubs by tiers with a margin, spellings by ratio, and one-to-one assignment by rounds or in turn."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.identity import CONTAINED, EQUAL, MARGIN, PARTIAL, block_ratio, index_terms, inside, side_of, tier, words_of
from ledgerline.sources.work import dealt, spread, stored


def _candidates(left: DataFrame, right: DataFrame, block: str, left_terms: Column, right_terms: Column) -> DataFrame:
    """Distinct pairs of rows (l, r: structs of the rows) of a block that share a term. Both sides grow with the input, and the size of exploded rows is
    guessed from the files that they come from, so the join is a merge: neither side goes through the driver."""
    a = left.select(F.col(block).alias("_b"), F.struct(*left.columns).alias("l"), F.explode(left_terms).alias("_t"))
    b = right.select(F.col(block).alias("_b"), F.struct(*right.columns).alias("r"), F.explode(right_terms).alias("_t"))
    return a.join(b.hint("merge"), ["_b", "_t"]).select("l", "r").distinct()


def verdicts(names: DataFrame, scored: DataFrame, least: float, margin: float = MARGIN) -> DataFrame:
    """name_id, outcome, club_id, score, runner_up of every name. scored: name_id, club_id, score above 0 for each candidate.

    The best must reach least and be ahead of the next by margin; both are aggregates, so no group of candidates is sorted. All joins are of tables
    with a row for each name, so they are merges."""
    best = scored.groupBy("name_id").agg(F.max(F.struct("score", (-F.col("club_id")).alias("k"))).alias("best"))
    # The next best is the best of the others.
    others = scored.join(best.select("name_id", (-F.col("best.k")).alias("_first")).hint("merge"), "name_id").where("club_id <> _first").groupBy("name_id").agg(F.max("score").alias("next"))
    x = names.select("name_id").join(best.hint("merge"), "name_id", "left").join(others.hint("merge"), "name_id", "left")
    score, runner_up = F.coalesce("best.score", F.lit(0.0)), F.coalesce("next", F.lit(0.0))
    outcome = F.when(score < least, "no-match").when(score - runner_up >= margin - 1e-9, "matched").otherwise("ambiguous")
    return x.select("name_id", outcome.alias("outcome"), F.when(outcome == "matched", -F.col("best.k")).alias("club_id"), F.when(score >= least, score).otherwise(0.0).alias("score"), F.when(score >= least, runner_up).otherwise(0.0).alias("runner_up"))


def resolve_clubs(names: DataFrame, clubs: DataFrame, as_of, active_days: int = 3 * 365) -> DataFrame:
    """Which club of its country each incoming name is. names: name_id, name, country. clubs: club_id, name, country, last_played.

    Candidates share a term of an inverted index that misses no pair of a tier above 0. A club whose words lie inside another club's
    cannot win from inside a name; containment reaches only clubs that played within active_days."""
    keyed = stored(spread(clubs).select("club_id", "country", "last_played", words_of(F.col("name")).alias("words")), "words")
    incoming = stored(spread(names).select("name_id", "country", words_of(F.col("name")).alias("words")), "words")
    terms = index_terms(F.col("words"))
    mates = _candidates(keyed.select("club_id", "country", "words"), keyed.select("club_id", "country", "words"), "country", terms, terms).where("l.club_id <> r.club_id")
    held = mates.where((side_of(F.col("l.words")) == side_of(F.col("r.words"))) & (inside(F.col("l.words"), F.col("r.words")) > 0)).select(F.col("l.club_id").alias("club_id"), F.lit(True).alias("held")).distinct()
    marked = stored(keyed.join(held.hint("merge"), "club_id", "left").select("club_id", "country", "last_played", "words", F.coalesce("held", F.lit(False)).alias("held")), "clubs")
    pairs = _candidates(incoming, marked, "country", terms, terms)
    raw = pairs.select(F.col("l.name_id").alias("name_id"), F.col("r.club_id").alias("club_id"), tier(F.col("l.words"), F.col("r.words")).alias("raw"), inside(F.col("r.words"), F.col("l.words")).alias("in_name"), F.col("r.held").alias("held"), F.col("r.last_played").alias("last_played"))
    lost = (F.col("raw") < EQUAL) & (F.col("raw") == F.col("in_name")) & F.col("held")
    idle = F.col("raw").isin(CONTAINED, PARTIAL) & (F.col("last_played").isNull() | (F.datediff(F.lit(as_of), "last_played") > active_days))
    scored = raw.where((F.col("raw") > 0) & ~lost & ~idle).select("name_id", "club_id", F.col("raw").alias("score"))
    return verdicts(names, stored(scored, "tiers"), PARTIAL)


def resolve_spellings(names: DataFrame, clubs: DataFrame, least: float = 0.85) -> DataFrame:
    """Which club of its league each incoming name spells, by the ratio of matching blocks. names: name_id, name, league. clubs: club_id, name, league."""
    worded = lambda df, key: spread(df).select(key, "league", words_of(F.col("name")).alias("w"))
    plain = lambda df, key, c: stored(worded(df, key).select(key, "league", F.array_join("w", " ").alias(c), F.array_join(side_of(F.col("w")), " ").alias("side")).where(f"{c} <> ''"), "texts")
    a, b = plain(names, "name_id", "y"), plain(clubs, "club_id", "x")
    # The different texts of a league, which few letters in common would pair almost all of anyway; what lengths alone forbid is not compared.
    likely = 2 * F.least(F.length("x"), F.length("y")) >= (least - MARGIN) * (F.length("x") + F.length("y"))
    texts = a.select("league", "side", "y").distinct().join(b.select("league", "side", "x").distinct().hint("merge"), ["league", "side"]).where(likely)
    # Pairs of texts that occur in many leagues are compared once.
    ratios = stored(spread(texts.select("x", "y").distinct()).select("x", "y", block_ratio(F.col("x"), F.col("y")).alias("score")).where(F.col("score") >= least - MARGIN), "ratios")
    alike = texts.join(ratios.hint("merge"), ["x", "y"])
    scored = alike.join(a.hint("merge"), ["league", "side", "y"]).join(b.hint("merge"), ["league", "side", "x"]).select("name_id", "club_id", "score")
    return verdicts(names, stored(scored, "spellings"), least)


def one_to_one(edges: DataFrame) -> DataFrame:
    """left, right: what a sequential pass gives in which each left in turn takes the free right it likes best. edges: left, turn, right, liking (less is better).

    By rounds of offers: each left asks for the best right it still has an edge to, each right holds the first of those that ask, and all later lefts
    lose their edges to it at once, since it will only ever be held by an earlier one. When every left is held the pairs are those of the pass: no earlier
    left is held by a right that a later one has. Likings and turns must be total orders."""
    left = edges
    while True:
        asked = stored(left.groupBy("left").agg(F.min(F.struct("liking", "right", "turn")).alias("b")).select("left", "b.right", "b.turn"), "asked")
        held = asked.groupBy("right").agg(F.min("turn").alias("first"))
        n, taken = asked.agg(F.count("right"), F.countDistinct("right")).first()
        if n == taken:
            return asked.select("left", "right")
        left = stored(left.join(held, "right", "left").where("first is null or turn <= first").drop("first"), "edges")


def _mates(events: DataFrame, games: DataFrame, theirs: str, ours: str, least: float) -> DataFrame:
    """snapshot, x, y: the different names of games and events of a snapshot whose lengths allow a ratio of least. Few letters in common would pair almost all of them anyway."""
    a = events.select("snapshot", F.col(theirs).alias("y")).distinct()
    b = games.select("snapshot", F.col(ours).alias("x")).distinct()
    return a.join(b.hint("merge"), "snapshot").where(2 * F.least(F.length("x"), F.length("y")) >= (least - 1e-9) * (F.length("x") + F.length("y"))).select("snapshot", "x", "y")


def _likely_names(events: DataFrame, games: DataFrame, theirs: str, ours: str, least: float) -> DataFrame:
    """x, y, r of the names of games and events of a snapshot whose ratio is least or more; each pair of names is compared once, however many rows have it."""
    pairs = _mates(events, games, theirs, ours, least).select("x", "y").distinct()
    return stored(spread(pairs).select("x", "y", block_ratio(F.col("x"), F.col("y")).alias("r")).where(F.col("r") >= least - 1e-9), "likely")


#: Kinds of rows of a pass in the order in which a snapshot's rows come: how alike names of the home and of the away side are, games, events.
_HOME, _AWAY, _GAME, _EVENT = range(4)
_ROW = "snapshot string, home string, away string, kind int, u long, v long"


class _Free:
    """Games of equal names, added in order of start: the first free one that starts in a span of time, without going over those taken again."""

    def __init__(self) -> None:
        self.starts: list[int] = []
        self.ids: list[int] = []
        self.next = [0]

    def add(self, start: int, match_id: int) -> None:
        self.starts.append(start)
        self.ids.append(match_id)
        self.next.append(len(self.ids))

    def first(self, since: int, until: int) -> int | None:
        at = bisect_left(self.starts, since)
        seen = []
        while self.next[at] != at:
            seen.append(at)
            at = self.next[at]
        for i in seen:
            self.next[i] = at
        return at if at < len(self.ids) and self.starts[at] <= until else None

    def take(self, at: int) -> int:
        self.next[at] = at + 1
        return self.ids[at]


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    return zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _exact_in_turn(span: int):
    """Rows sorted by snapshot, home, away, kind, u, v: each event in turn takes the first free game of its names; events come out with it, and games that stay free."""
    schema = pa.schema([("snapshot", pa.string()), ("home", pa.string()), ("away", pa.string()), ("kind", pa.int32()), ("u", pa.int64()), ("v", pa.int64()), ("found", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, free = None, _Free()
        left = lambda: [(*names, _GAME, start, match_id, None) for at, (start, match_id) in enumerate(zip(free.starts, free.ids, strict=True)) if free.next[at] == at]
        for batch in batches:
            out = []
            for snapshot, home, away, kind, u, v in _rows(batch):
                if (snapshot, home, away) != names:
                    out += left() if names else []
                    names, free = (snapshot, home, away), _Free()
                if kind == _GAME:
                    free.add(u, v)
                else:
                    at = free.first(v - span, v + span)
                    out.append((snapshot, home, away, kind, u, v, None if at is None else free.take(at)))
            yield _batch(out, schema)
        yield _batch(left() if names else [], schema)

    return run


def _fuzzy_in_turn(span: int, least: float, kept: int = 500_000):
    """Rows sorted by snapshot, kind, u, v: each event in turn takes the free game of the best mean ratio. A snapshot's free games are held, by their names, and what
    the names of its events ask for first; of that so many entries at most, after which it is found again."""
    schema = pa.schema([("event_id", pa.int64()), ("match_id", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, free, alike, asked, entries = None, {}, {}, {}, 0
        for batch in batches:
            out = []
            for snapshot, home, away, kind, u, v, r in _rows(batch):
                if snapshot != now:
                    now, free, alike, asked, entries = snapshot, {}, {}, {}, 0
                if kind in (_HOME, _AWAY):
                    alike.setdefault((kind, away), []).append((home, r))
                    continue
                if kind == _GAME:
                    free.setdefault((home, away), _Free()).add(u, v)
                    continue
                best = asked.get((home, away))
                if best is None:
                    scores: dict[float, list[_Free]] = {}
                    for x, rh in alike.get((_HOME, home), ()):
                        for y, ra in alike.get((_AWAY, away), ()):
                            if (rh + ra) / 2 >= least and (x, y) in free:
                                scores.setdefault((rh + ra) / 2, []).append(free[x, y])
                    if entries > kept:
                        asked, entries = {}, 0
                    best = asked[home, away] = [scores[k] for k in sorted(scores, reverse=True)]
                    entries += 1 + sum(map(len, best))
                taken = None
                for games in best:
                    firsts = [(g.starts[at], g.ids[at], at, i) for i, g in enumerate(games) if (at := g.first(v - span, v + span)) is not None]
                    if firsts:
                        *_, at, i = min(firsts)
                        taken = games[i].take(at)
                        break
                out.append((u, taken))
            yield _batch(out, schema)

    return run


def assign_events(events: DataFrame, games: DataFrame, snapshots: DataFrame, hours: float = 3.0, least: float = 0.8) -> DataFrame:
    """event_id, match_id, how (exact, fuzzy, unmatched, started) of every event of a snapshot.

    events: event_id, snapshot, commence, home, away. games: match_id, snapshot, starts, home, away. snapshots: snapshot, taken_at. Ids are long.
    Exact names go first, each event to the first free game; then each event in turn to the free game of the best mean ratio of both
    names, if that reaches least. Events that began when the snapshot was taken are left out.

    Each pass streams through sorted partitions: the exact one holds the games of one pair of names of a snapshot, the other the free games of a snapshot.
    Which names are alike is known before, each pair of names compared once."""
    spoken = lambda c: F.array_join(words_of(F.col(c)), " ")
    e = events.join(snapshots, "snapshot", "left").select("event_id", "snapshot", "commence", spoken("home").alias("home"), spoken("away").alias("away"), (F.col("commence").isNotNull() & F.col("home").isNotNull() & F.col("away").isNotNull() & (F.col("home") != "") & (F.col("away") != "")).alias("whole"), (F.col("commence") <= F.col("taken_at")).alias("began"))
    e = stored(e.withColumn("began", F.coalesce("began", F.lit(False))), "events")
    g = stored(games.where("snapshot is not null and starts is not null").select("match_id", "snapshot", "starts", spoken("home").alias("home"), spoken("away").alias("away")), "games")
    live = F.col("whole") & ~F.col("began") & F.col("snapshot").isNotNull()
    out = e.where(~live).select("event_id", F.lit(None).cast("long").alias("match_id"), F.when(F.col("whole") & F.col("began"), "started").otherwise("unmatched").alias("how"))
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    row = lambda df, kind, u, v: df.select("snapshot", "home", "away", F.lit(kind).alias("kind"), u.cast("long").alias("u"), v.cast("long").alias("v"))
    both = row(g, _GAME, micros("starts"), F.col("match_id")).unionByName(row(e.where(live), _EVENT, F.col("event_id"), micros("commence")))
    span, names = int(hours * 3.6e9), ["snapshot", "home", "away"]
    exact = stored(dealt(both, names).sortWithinPartitions(*names, "kind", "u", "v").mapInArrow(_exact_in_turn(span), f"{_ROW}, found long"), "exact")
    rest = exact.where((F.col("kind") == _EVENT) & F.col("found").isNull()).drop("found")
    # Only snapshots that still have an event, and only names, not rows, are compared.
    free = exact.where(F.col("kind") == _GAME).drop("found").join(rest.select("snapshot").distinct().hint("merge"), "snapshot", "left_semi")
    # A mean of least needs this of either side.
    low = 2 * least - 1
    alike = lambda kind, c: _mates(rest, free, c, c, low).join(_likely_names(rest, free, c, c, low).hint("merge"), ["x", "y"]).select("snapshot", F.col("x").alias("home"), F.col("y").alias("away"), F.lit(kind).alias("kind"), F.lit(0).cast("long").alias("u"), F.lit(0).cast("long").alias("v"), "r")
    left = stored(free.unionByName(rest).withColumn("r", F.lit(None).cast("double")).unionByName(alike(_HOME, "home")).unionByName(alike(_AWAY, "away")), "rest")
    fuzzy = dealt(left, "snapshot").sortWithinPartitions("snapshot", "kind", "u", "v").mapInArrow(_fuzzy_in_turn(span, least), "event_id long, match_id long")
    found = exact.where("found is not null").select(F.col("u").alias("event_id"), F.col("found").alias("match_id"), F.lit("exact").alias("how"))
    return out.unionByName(found).unionByName(fuzzy.withColumn("how", F.when(F.col("match_id").isNotNull(), "fuzzy").otherwise("unmatched")))
