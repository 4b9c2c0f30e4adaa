"""Outcomes of markets from final scores, and settlement, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def result(home: Column, away: Column) -> Column:
    return F.when(home > away, "home").when(home < away, "away").when(home == away, "draw")


def total_line(home: Column, away: Column, line: Column) -> Column:
    return F.when(home + away > line, "over").when(home + away < line, "under").when(home + away == line, "push")


def spread(home: Column, away: Column, line: Column) -> Column:
    """The home side against a line that is added to its score."""
    return F.when(home - away > -line, "home").when(home - away < -line, "away").when(home - away == -line, "push")


def both_score(home: Column, away: Column) -> Column:
    return F.when((home > 0) & (away > 0), "yes").when(home.isNotNull() & away.isNotNull(), "no")


def handicap_units(margin: Column, line: Column) -> Column:
    """Settlement of an Asian handicap in units of stake won: 1, 0.5, 0, -0.5 or -1; quarter lines are two half bets."""
    quarter = F.pmod(F.abs(line) * 4, F.lit(2)) == 1
    half = lambda x: F.signum(margin + x) / 2
    return F.when(quarter, half(line - 0.25) + half(line + 0.25)).otherwise(F.signum(margin + line))


def profit(units: Column, stake: Column, odds: Column) -> Column:
    """Money won or lost for a settlement in units."""
    return F.when(units > 0, stake * units * (odds - 1)).otherwise(stake * units)


# Outcomes of the derived markets, for the proposition that was picked, and settlement of bets

#: The results that a double chance covers.
COVERS = {"1X": ("home", "draw"), "12": ("home", "away"), "X2": ("draw", "away")}
HANDICAPS = ("asian_handicap", "puck_line")


def shown_line(line: Column) -> Column:
    """A line as its key has it: 2.5 and 3, not 3.0."""
    return F.when(line == F.floor(line), F.floor(line).cast("string")).otherwise(line.cast("string"))


def _number(text: Column) -> Column:
    return F.when(text.rlike(r"^[+-]?[0-9]+(\.[0-9]+)?$"), text.try_cast("double"))


def handicap_verdict(margin: Column, line: Column) -> Column:
    """won, half_won, push, half_lost or lost; a quarter line is two half stakes at its neighbours."""
    quarter = F.pmod(F.abs(line) * 4, F.lit(2)) == 1
    sign = F.when(quarter, F.signum(margin + line - 0.25) + F.signum(margin + line + 0.25)).otherwise(2 * F.signum(margin + line))
    return F.when(sign == 2, "won").when(sign == 1, "half_won").when(sign == 0, "push").when(sign == -1, "half_lost").when(sign == -2, "lost")


def actual_outcome(market: Column, pick: Column, home: Column, away: Column, half_home: Column, half_away: Column, cap: int = 6) -> Column:
    """What happened, in the words of the pick's own proposition; null where it can't be said: no score, no line in the pick, a half-time score above the final one, an unknown market."""
    side, rest = F.substring_index(pick, "_", 1), F.substring(pick, F.length(F.substring_index(pick, "_", 1)) + 2, F.length(pick))
    sided = side.isin("home", "away") & (F.length(rest) > 0)
    own, other = F.when(side == "home", home).otherwise(away), F.when(side == "home", away).otherwise(home)
    answer = lambda c: F.when(sided, F.concat(side, F.when(c, "_yes").otherwise("_no")))
    total, margin = home + away, home - away

    def against(goals: Column, line: Column) -> Column:
        return F.concat(F.when(goals > line, "over_").when(goals < line, "under_").otherwise("push_"), shown_line(line))

    line = _number(rest)
    team_line = _number(F.substring_index(rest, "_", -1))
    team = F.when(sided & team_line.isNotNull(), F.when(own == team_line, "push").otherwise(F.concat(side, F.when(own > team_line, "_over_").otherwise("_under_"), shown_line(team_line))))
    at = _number(F.substring(pick, 1, F.length(pick) - F.length(F.substring_index(pick, "_", -1)) - 1))
    verdict = handicap_verdict(margin, at)
    covers = F.when(at.isNotNull(), F.concat(F.when(verdict == "won", "home_covers_").when(verdict == "lost", "away_covers_").otherwise("push_"), shown_line(at)))
    winner = result(home, away)
    known = (half_home <= home) & (half_away <= away)
    full = (
        F.when(market.isin("match_result", "double_chance"), winner)
        .when(market == "moneyline", F.when(home != away, winner))
        .when(market == "btts", both_score(home, away))
        .when(market == "over_under", against(total, line))
        .when(market == "draw_no_bet", F.when(home == away, "push").otherwise(winner))
        .when(market == "correct_score", F.concat(home.cast("string"), F.lit("-"), away.cast("string")))
        .when(market.isin(*HANDICAPS), covers)
        .when(market == "clean_sheet", answer(other == 0))
        .when(market == "win_to_nil", answer((own > other) & (other == 0)))
        .when(market == "team_total", team)
        .when(market == "odd_even", F.when(total % 2 == 1, "odd").otherwise("even"))
        .when(market == "total_goals", F.when(total >= cap, f"{cap}+").otherwise(total.cast("string")))
        .when(market == "winning_margin", F.when(margin == 0, "draw").otherwise(F.concat(winner, F.lit("_"), F.when(F.abs(margin) >= 3, "3plus").otherwise(F.abs(margin).cast("string")))))
        .when(market == "result_btts", F.concat(winner, F.lit("_"), both_score(home, away)))
        .when(market == "result_over_under", F.concat(winner, F.when(total > 2.5, "_over").otherwise("_under")))
    )
    half = (
        F.when(market == "match_result_ht", result(half_home, half_away))
        .when(market == "btts_ht", both_score(half_home, half_away))
        .when(market == "over_under_ht", against(half_home + half_away, line))
        .when(market == "ht_ft_double_result", F.concat(result(half_home, half_away), F.lit("_"), winner))
    )
    return F.when(home.isNotNull() & away.isNotNull(), F.coalesce(full, F.when(known, half)))


def is_correct(market: Column, pick: Column, actual: Column, listed: Column | None = None) -> Column:
    """Whether a pick came true; null for pushes and what can't be told. listed: the scores that a correct-score prediction priced one by one, which an 'other' pick excludes."""
    push = (actual == "push") | actual.startswith("push_")
    covered = F.lit(None).cast("boolean")
    for name, results in COVERS.items():
        covered = F.when(pick == name, actual.isin(*results)).otherwise(covered)
    side = F.substring_index(pick, "_", -1)
    lined = F.when(side.isin("home", "away"), actual.startswith(F.concat(side, F.lit("_covers_"))))
    other = F.when(F.size(listed) > 0, ~F.array_contains(listed, actual)) if listed is not None else F.lit(None).cast("boolean")
    graded = F.when(market.isin(*HANDICAPS), lined).when(market == "double_chance", covered).when((market == "correct_score") & (pick == "other"), other).otherwise(pick == actual)
    return F.when(actual.isNotNull() & pick.isNotNull() & ~push, graded)


def settled(bet: Column, selection: Column, home: Column, away: Column) -> Column:
    """The verdict on a bet from its own selection: won, half_won, push, half_lost, lost, or null if it can't be settled. A selection carries its line after '_' or a space."""
    text = F.trim(selection)
    apart = F.regexp_extract(text, r"^([^_ ]+)[_ ]([+-]?[0-9]+(?:\.[0-9]+)?)$", 1)
    side = F.lower(F.when(apart != "", apart).otherwise(text))
    line = F.when(apart != "", _number(F.regexp_extract(text, r"^([^_ ]+)[_ ]([+-]?[0-9]+(?:\.[0-9]+)?)$", 2)))
    kind, winner, total = F.lower(F.trim(bet)), result(home, away), home + away
    won = lambda c: F.when(c, "won").otherwise("lost")
    covered = F.lit(None).cast("string")
    for name, results in COVERS.items():
        covered = F.when(F.upper(text) == name, won(winner.isin(*results))).otherwise(covered)
    return F.when(winner.isNotNull(), (
        F.when(kind.isin("1x2", "match_result", "moneyline", "h2h"), F.when(side.isin("home", "draw", "away"), won(side == winner)))
        .when(kind.isin("over_under", "total"), F.when(side.isin("over", "under") & line.isNotNull(), F.when(total == line, "push").otherwise(won(F.when(side == "over", total > line).otherwise(total < line)))))
        .when(kind.isin("asian_handicap", "spread", "puck_line"), F.when(side.isin("home", "away") & line.isNotNull(), handicap_verdict(F.when(side == "home", home - away).otherwise(away - home), line)))
        .when(kind == "btts", F.when(side.isin("yes", "no"), won(side == both_score(home, away))))
        .when(kind == "double_chance", covered)
        .when(kind == "draw_no_bet", F.when(side.isin("home", "away"), F.when(winner == "draw", "push").otherwise(won(side == winner))))
        .when(kind == "correct_score", F.when(F.lower(text) != "other", won(text == F.concat(home.cast("string"), F.lit("-"), away.cast("string")))))
    ))


def status_of(verdict: Column) -> Column:
    """Half outcomes keep the statuses of whole ones; a push is void."""
    return F.when(verdict.isin("won", "half_won"), "won").when(verdict.isin("lost", "half_lost"), "lost").when(verdict == "push", "void")


def profit_of(verdict: Column, stake: Column, odds: Column) -> Column:
    """Money in decimals, half of it for half outcomes."""
    money, price = stake.cast("decimal(18,4)"), odds.cast("decimal(12,4)")
    half = money * F.lit("0.5").cast("decimal(2,1)")
    gain = F.when(verdict == "won", money * (price - 1)).when(verdict == "half_won", half * (price - 1)).when(verdict == "lost", -money).when(verdict == "half_lost", -half).when(verdict == "push", F.lit(0))
    return gain.cast("decimal(20,4)")


def graded_row(graded: Column, verdict: Column, created: Column, kickoff: Column, strict: bool = False) -> Column:
    """A grade that stands is kept; what was made after the kick-off (with strict, at it) is never graded; an unknown time is no reason to refuse."""
    late = F.coalesce(created >= kickoff if strict else created > kickoff, F.lit(False))
    return F.when(graded.isNotNull(), graded).when(~late, verdict)
