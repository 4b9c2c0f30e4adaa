"""Repair of the structure of conversations: the cheapest edits that make their roles s?(ua)+ or nothing.

A turn can be kept (0), given another role (2), deleted (3) or preceded by an inserted empty turn (2); a truncated turn that stays
adds 1, blank and duplicate turns must go. Turns are dealt by conversation and sorted; each task takes them in batches of about BATCH
turns, and one recursive DuckDB query per batch advances all its conversations by one turn a recursion: for each conversation and each
state of the grammar (nothing yet, after s, after u, after a) it keeps the cheapest cost with the least audit, the string of the edits'
initials. Edits end with the edit of a turn in each state, so no audit of a state is the start of another: ranks are enough to compare
what came before a batch.

A conversation longer than a batch, or than CHUNK turns of one, goes on in the next: only its four states, their audits so far and the
running digests of what they would keep are carried, so a conversation of any length streams through its task in bounded memory. (The
digest of one conversation is by definition one pass over its turns, so a conversation is not split over tasks.)

Turns without a conversation form one. Turns of one number follow each other by role and text. A role counts by its first character.

Cases: null values are one space (a null conv_id stays null in the result); turns without a number come first; repeated rows are
duplicates; texts of any length are read whole; costs that tie go to the ASCII-least audit; conversations that lose all turns give
zeros, an empty audit and the digest of nothing; an empty table gives no rows. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ship, table

BATCH = 20_000
BATCH_BYTES = 32 << 20
CHUNK = 1_000
INKED = r"[^\x20\x09-\x0D]"
#: States: 0 nothing yet, 1 after s, 2 after u, 3 after a. What a kept turn of each initial does to a state.
_TURN = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
#: What inserted turns do before an edit: state -> (state, edits).
_INSERTED = {0: ((0, ""), (2, "I"), (3, "II")), 1: ((1, ""), (2, "I"), (3, "II")), 2: ((2, ""), (3, "I")), 3: ((3, ""), (2, "I"))}
#: What closes a conversation in each state.
CLOSING = {0: "", 1: "II", 2: "I", 3: ""}


def _arcs() -> list[tuple[int, str, int, int, str, bool]]:
    """state, kind of turn (its initial, o for others, x for turns that must go), next state, cost, edits, whether the turn stays."""
    out = []
    for state, ways in _INSERTED.items():
        for mid, edits in ways:
            spent = 2 * len(edits)
            for kind in "suaox":
                out.append((state, kind, mid, spent + 3, edits + "D", False))
            for role in "ua":
                if mid in _TURN[role]:
                    out += [(state, kind, _TURN[role][mid], spent + 2, edits + "R", True) for kind in "suao"]
            out += [(state, kind, after[mid], spent, edits + "K", True) for kind, after in _TURN.items() if mid in after]
    return out


#: c: conversation, i: turn of it in this batch. Of equal costs the earlier rank, then the lesser audit wins; base has the states before the batch.
_ADVANCE = """WITH RECURSIVE walk(c, i, state, origin, cost, rank, audit) AS (
 SELECT c, 0::BIGINT, state, state, cost, rank, '' FROM base
 UNION ALL
 SELECT c, i + 1, state, best.origin, best.cost, best.rank, best.audit FROM (
  SELECT w.c, w.i, a.next AS state, min({'cost': w.cost + a.cost + (a.stays AND t.truncated)::INT, 'rank': w.rank, 'audit': w.audit || a.edits, 'origin': w.origin}) AS best
  FROM walk w JOIN turns t ON t.c = w.c AND t.i = w.i JOIN arcs a ON a.state = w.state AND a.kind = t.kind
  GROUP BY w.c, w.i, a.next))
SELECT w.c, state, origin, cost, rank, audit FROM walk w JOIN (SELECT c, count(*) AS n FROM turns GROUP BY c) s ON w.c = s.c AND w.i = s.n ORDER BY w.c, cost, rank, audit"""


class _State:
    """What is carried of a conversation in one state of the grammar."""

    def __init__(self, cost: int = 0, audit: str = "", digests=None) -> None:
        self.cost, self.audit = cost, audit
        # For an even and an odd number of turns that stay in all: which roles they get depends on it.
        self.digests = digests or [hashlib.sha256(), hashlib.sha256()]
        self.kept = 0

    def then(self, cost: int, edits: str, turns: Iterator[tuple[str, str]]) -> _State:
        """After edits over turns (role, text)."""
        out = _State(cost, self.audit + edits, [d.copy() for d in self.digests])
        out.kept = self.kept
        for edit in edits:
            role, text = ("", "") if edit == "I" else next(turns)
            if edit == "D":
                continue
            for odd, digest in enumerate(out.digests):
                given = role if edit == "K" else ("user", "assistant")[(out.kept + odd) % 2]
                digest.update(f"{chr(10) if out.kept else ''}{given}:{text}".encode("utf-8", "surrogatepass"))
            out.kept += 1
        return out


def _advance(con, base: list[tuple[int, int, int, int]], turns: pa.Table) -> list[tuple]:
    """For each conversation of a batch the states after it: c, state, origin, cost, rank, edits, the cheapest first."""
    con.register("base", pa.Table.from_arrays([pa.array([r[k] for r in base], pa.int64()) for k in range(4)], names=["c", "state", "cost", "rank"]))
    con.register("turns", turns)
    return con.execute(_ADVANCE).fetchall()


class _Repair:
    """Takes sorted turns in batches and gives each conversation's cost, audit and digest when its last turn is seen."""

    def __init__(self) -> None:
        import duckdb

        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "300MB"})
        self.con.register("arcs", pa.Table.from_pylist([dict(zip(("state", "kind", "next", "cost", "edits", "stays"), a, strict=True)) for a in _arcs()]))
        self.open: int | None = None
        self.states: dict[int, _State] = {0: _State()}

    def batch(self, conv: list[int], kinds: list[str], truncated: list[bool], roles: list[str], texts: list[str]) -> Iterator[tuple[int, _State]]:
        """Conversations (numbered in order) that end before the last one of this batch."""
        starts = [i for i in range(len(conv)) if not i or conv[i] != conv[i - 1]]
        if self.open is not None and conv[0] != self.open:
            yield self.close()
        base: list[tuple[int, int, int, int]] = []
        index: list[int] = []
        for k, (s, e) in enumerate(zip(starts, [*starts[1:], len(conv)], strict=True)):
            index += range(e - s)
            if not k and conv[0] == self.open:
                ranks = {s: r for r, s in enumerate(sorted(self.states, key=lambda s: self.states[s].audit))}
                base += [(conv[s], state, x.cost, ranks[state]) for state, x in self.states.items()]
            else:
                base.append((conv[s], 0, 0, 0))
        where = dict(zip((conv[s] for s in starts), starts, strict=True))
        carried, old = self.open, self.states
        turns = pa.Table.from_arrays([pa.array(conv, pa.int64()), pa.array(index, pa.int64()), pa.array(kinds), pa.array(truncated)], names=["c", "i", "kind", "truncated"])
        last, after = conv[-1], {}
        found: dict[int, dict[int, tuple]] = {}
        for c, state, origin, cost, _, edits in _advance(self.con, base, turns):
            found.setdefault(c, {})[state] = (origin, cost, edits)
        for c, ends in found.items():
            own = old if c == carried else {0: _State()}
            s = where[c]
            if c != last:
                # Costs settle which end is taken before any digest is made.
                state = min(ends, key=lambda k: (ends[k][1] + 2 * len(CLOSING[k]), own[ends[k][0]].audit + ends[k][2] + CLOSING[k]))
                ends = {state: ends[state]}
            after = {k: own[o].then(cost, edits, zip(roles[s:], texts[s:], strict=True) if c == last else iter(zip(roles[s : s + len(edits)], texts[s : s + len(edits)], strict=True))) for k, (o, cost, edits) in ends.items()}
            self.open, self.states = c, after
            if c != last:
                yield self.close()

    def close(self) -> tuple[int, _State]:
        """The open conversation, ended in its cheapest way."""
        state = min(self.states, key=lambda k: (self.states[k].cost + 2 * len(CLOSING[k]), self.states[k].audit + CLOSING[k]))
        x = self.states[state]
        out = self.open, x.then(x.cost + 2 * len(CLOSING[state]), CLOSING[state], iter(()))
        self.open, self.states = None, {0: _State()}
        return out


def _spaced(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(" "))


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after damage by crc32(conv_id:turn) % 20: 0 drops, 1 empties, 2 removes [.!?], 3 repeats, 4 makes it the user's."""
    draw = F.pmod(F.crc32(F.concat(_spaced(F.col("conv_id")), F.lit(":"), _spaced(F.col("turn"))).cast("binary")), F.lit(20))
    rows = conversations.select("conv_id", "turn", _spaced(F.col("role")).alias("role"), _spaced(F.col("text")).alias("text"), draw.alias("draw")).where("draw <> 0")
    text = F.when(F.col("draw") == 1, "").when(F.col("draw") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    twice = F.when(F.col("draw") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.select("conv_id", "turn", F.when(F.col("draw") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(twice).alias("copy")).drop("copy")


def faults(turns: DataFrame) -> DataFrame:
    """Turns with their first fault (blank, duplicate, truncated or null), dealt by conversation."""
    # Dealing by conversation also serves the window over equal turns; the digest keeps long texts out of its sort.
    w = Window.partitionBy("conv_id", "role", "_digest").orderBy(F.col("turn").asc_nulls_first())
    dealt = turns.select("conv_id", "turn", "role", "text").repartition("conv_id").withColumn("_digest", F.sha2(F.col("text").cast("binary"), 256))
    inked = F.rtrim(F.translate("text", "\t\n\x0b\f\r", "     "))
    seen = F.row_number().over(w) > 1
    fault = F.when(inked == "", "blank").when(seen, "duplicate").when(~F.right(inked, F.lit(1)).isin(".", "!", "?"), "truncated")
    return dealt.withColumn("fault", fault).drop("_digest")


def repaired(turns: DataFrame) -> DataFrame:
    """conv_id, blank, duplicate, truncated, illegal, gaps, cost, audit, kept, repaired_sha256 for each conversation of turns (conv_id, turn, role, text)."""
    ship(turns.sparkSession)
    kind = dict(turns.dtypes)["conv_id"]
    initial = F.substring("role", 1, 1)
    what = F.when(F.col("fault").isin("blank", "duplicate"), "x").when(initial.isin("s", "u", "a"), initial).otherwise("o")
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), F.col("kind") == "x"]
    rows = faults(turns).select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text", "fault", what.alias("kind"), initial.alias("initial")).sortWithinPartitions(*order)
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "kept", "repaired_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repair, ids, counts, id_type = _Repair(), {}, {}, None
        number, last = -1, object()
        waiting: list[list] = [[], [], [], [], []]
        size = held = 0

        def results(done: Iterator[tuple[int, _State]]) -> Iterator[pa.RecordBatch]:
            out = [(ids.pop(c), *counts.pop(c).row(), x.cost, x.audit, x.kept, x.digests[x.kept % 2].hexdigest()) for c, x in done]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], id_type if not k else pa.string() if names[k] in ("audit", "repaired_sha256") else pa.int64()) for k in range(len(names))], names=names)

        for b in batches:
            id_type = b.column("conv_id").type
            for conv, turn, role, text, fault, k, first in zip(*(b.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "fault", "kind", "initial")), strict=True):
                if conv != last or number < 0:
                    number, last, held = number + 1, conv, 0
                    ids[number], counts[number] = conv, _Counts()
                counts[number].add(turn, fault, first)
                for column, value in zip(waiting, (number, k, fault == "truncated", role, text), strict=True):
                    column.append(value)
                size += len(text)
                held += 1
                if len(waiting[0]) >= BATCH or held >= CHUNK or size >= BATCH_BYTES:
                    yield from results(repair.batch(*waiting))
                    waiting, size, held = [[], [], [], [], []], 0, 0
        if waiting[0]:
            yield from results(repair.batch(*waiting))
        if repair.open is not None:
            yield from results(iter([repair.close()]))

    return rows.mapInArrow(run, f"conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, kept long, repaired_sha256 string")


class _Counts:
    """Faults, role pairs and turn numbers of a conversation, whose turns come sorted."""

    def __init__(self) -> None:
        self.faults = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.illegal = self.distinct = 0
        self.least = self.most = self.before = None

    def add(self, turn: int | None, fault: str | None, initial: str) -> None:
        if fault:
            self.faults[fault] += 1
        if self.before is not None and self.before + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = initial
        if turn is not None:
            self.distinct += turn != self.most
            self.least = turn if self.least is None else self.least
            self.most = turn

    def row(self) -> tuple[int, ...]:
        gaps = 0 if self.most is None else self.most - self.least + 1 - self.distinct
        return gaps, *self.faults.values(), self.illegal


def repaired_turns(turns: DataFrame, repairs: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, position (from 0), edit (K, R, I), role, text, from the audits of repaired."""
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    rows = turns.select("conv_id", "turn", "role", "text").withColumn("nth", F.row_number().over(order)).select(F.col("conv_id").alias("_c"), "nth", "role", "text")
    edits = repairs.select("conv_id", "kept", F.posexplode(F.split("audit", "")).alias("at", "edit")).where("edit <> ''")
    upto = Window.partitionBy("conv_id").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    placed = edits.select("conv_id", "kept", "edit", F.sum((F.col("edit") != "I").cast("int")).over(upto).alias("nth"), (F.sum((F.col("edit") != "D").cast("int")).over(upto) - 1).alias("position")).where("edit <> 'D'")
    given = F.when((F.col("position") + F.col("kept")) % 2 == 0, "user").otherwise("assistant")
    joined = placed.join(rows, placed.conv_id.eqNullSafe(rows["_c"]) & (placed.nth == rows.nth) & (placed.edit != "I"), "left")
    return joined.select("conv_id", "position", "edit", F.when(F.col("edit") == "K", F.col("role")).otherwise(given).alias("role"), F.coalesce("text", F.lit("")).alias("text"))


def op13_turn_repair(spark, sf_dir: str) -> DataFrame:
    """All conversations, damaged and repaired."""
    before = table(spark, sf_dir, "conversations")
    found = repaired(damaged(before)).select(F.col("conv_id").alias("_c"), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    ids = before.select("conv_id").distinct()
    zeros = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return ids.join(found, ids.conv_id.eqNullSafe(found["_c"]), "left").select("conv_id", *zeros, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
