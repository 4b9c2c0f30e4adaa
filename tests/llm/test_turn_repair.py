"""Turn repair against all edits of short conversations, and against a plain table of states for long ones."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from ledgerline.llm import turn_repair

SPACES = " \t\n\x0b\f\r"
COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def damage(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        k = zlib.crc32(key.encode()) % 20
        out[conv] += []
        if k == 1:
            text = ""
        if k == 2:
            text = re.sub("[.!?]", "", text)
        if k == 4:
            role = "user"
        out[conv] += [(turn, role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    return {c: sorted(ts, key=lambda t: (t[0] is not None, t[0] or 0, t[1].encode(), t[2].encode())) for c, ts in out.items()}


def first_faults(turns):
    seen, out = set(), []
    for _, role, text in turns:
        inked = text.strip(SPACES)
        out.append("blank" if not inked else "duplicate" if (role, text) in seen else "truncated" if inked[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def counted(turns):
    found = first_faults(turns)
    numbers = [t for t, _, _ in turns if t is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(turns))
    return gaps, found.count("blank"), found.count("duplicate"), found.count("truncated"), illegal


def every_edit(turns):
    """The cheapest of all edits: cost, audit, repaired turns."""
    found = first_faults(turns)
    gap = [(), ("u",), ("a",), ("u", "a"), ("a", "u")]
    own = lambda f: "D" if f in ("blank", "duplicate") else ("K", "u", "a", "D")
    best = None
    for edits in itertools.product(*(own(f) for f in found)):
        for inserted in itertools.product(gap, repeat=len(turns) + 1):
            cost, audit, out = 0, "", []
            for k, where in enumerate(inserted):
                for role in where:
                    cost, audit = cost + 2, audit + "I"
                    out.append(({"u": "user", "a": "assistant"}[role], ""))
                if k == len(turns):
                    break
                _, role, text = turns[k]
                cost += {"K": 0, "D": 3}.get(edits[k], 2) + (edits[k] != "D" and found[k] == "truncated")
                audit += edits[k] if edits[k] in "KD" else "R"
                if edits[k] != "D":
                    out.append(({"u": "user", "a": "assistant"}.get(edits[k], role), text))
            if (best is None or (cost, audit) < best[:2]) and all(r for r, _ in out) and re.fullmatch("(s?(ua)+)?", "".join(r[0] for r, _ in out)):
                best = cost, audit, out
    return best


def by_states(turns):
    """The same by a table of states that holds whole audits and turns."""
    found = first_faults(turns)
    step = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
    names = {"u": "user", "a": "assistant"}
    states = {0: (0, "", [])}

    def put(into, state, value):
        if state not in into or value[:2] < into[state][:2]:
            into[state] = value

    def with_inserts(states):
        out = dict(states)
        for _ in range(3):
            for s, (c, audit, kept) in list(out.items()):
                for role in "ua":
                    if (s, role) in step:
                        put(out, step[s, role], (c + 2, audit + "I", [*kept, (names[role], "")]))
        return out

    for (_, role, text), fault in zip(turns, found, strict=True):
        after = {}
        for s, (c, audit, kept) in with_inserts(states).items():
            put(after, s, (c + 3, audit + "D", kept))
            if fault in ("blank", "duplicate"):
                continue
            late = fault == "truncated"
            if (s, role[:1]) in step:
                put(after, step[s, role[:1]], (c + late, audit + "K", [*kept, (role, text)]))
            for to in "ua":
                if (s, to) in step:
                    put(after, step[s, to], (c + 2 + late, audit + "R", [*kept, (names[to], text)]))
        states = after
    end = with_inserts(states)
    return min((end[s] for s in (0, 3) if s in end), key=lambda x: x[:2])


def digest(kept):
    return hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()


def expected(turns, how):
    cost, audit, kept = how(turns)
    return (*counted(turns), cost, audit, digest(kept))


def got(df):
    return {r.conv_id: tuple(r[c] for c in COLUMNS) for r in df.collect()}


ROLES = ["system", "user", "assistant", "tool", "user", "assistant", "", "s"]
SAID = ["Hello there.", "What?", "no end", "", " \t", "Yes!", "Hello there.", "x. "]


def test_short_conversations_get_the_cheapest_of_all_edits(spark):
    draw = random.Random(3)
    turns = {c: [(k, draw.choice(ROLES), draw.choice(SAID)) for k in range(draw.randrange(1, 4))] for c in range(150)}
    df = spark.createDataFrame([(c, *t) for c, ts in turns.items() for t in ts], "conv_id long, turn long, role string, text string")
    found = got(turn_repair.repaired(df))
    for c, ts in turns.items():
        assert found[c] == expected(ts, every_edit) == expected(ts, by_states), ts


@pytest.mark.parametrize("limits", [(20_000, 1_000), (7, 3), (1, 1)])
def test_long_conversations_go_on_over_batches(spark, limits, monkeypatch):
    monkeypatch.setattr(turn_repair, "BATCH", limits[0])
    monkeypatch.setattr(turn_repair, "CHUNK", limits[1])
    draw = random.Random(4)
    n = 60 if limits[0] == 1 else 300
    turns = {c: [(k, draw.choice(ROLES), draw.choice(SAID) + draw.choice(["", f" {k}."])) for k in range(draw.choice([1, 2, 5, n]))] for c in range(40)}
    df = spark.createDataFrame([(c, *t) for c, ts in turns.items() for t in ts], "conv_id long, turn long, role string, text string")
    found = got(turn_repair.repaired(df.repartition(3)))
    for c, ts in turns.items():
        assert found[c] == expected(ts, by_states), c


def test_query_repairs_every_conversation(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    found = got(turn_repair.op13_turn_repair(spark, sf))
    want = {c: expected(ts, by_states) for c, ts in damage(rows).items()}
    assert found == want and len(want) >= 20


def test_nulls_ties_repeats_and_clashing_columns(spark, tmp_path):
    rows = [(None, None, None, None), (None, 1, "user", "Hi."), (None, 1, "assistant", "Ho."), (7, None, "user", "First."), (7, 2, "assistant", "Then."), (7, 2, "assistant", "Then."), (7, 2, "assistant", "Another."), (7, 9, None, "odd role."), (8, 0, "user", None)]
    rows += [(c, 0, "user", "x") for c in range(100, 160)] + [(9, k, "system", "s." * 40_000) for k in range(3)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    want = {c: expected(ts, by_states) for c, ts in damage(rows).items()}
    assert any(len(ts) == 0 for ts in damage(rows).values())
    for k, made in enumerate((df, df.withColumns({c: F.lit(7) for c in ["fault", "kind", "initial", "Copy", "draw", "_digest", "_c", "cost"]}), df.limit(0))):
        made.coalesce(1).write.parquet(f"{tmp_path}/{k}/conversations.parquet")
        assert got(turn_repair.op13_turn_repair(spark, f"{tmp_path}/{k}")) == (want if k < 2 else {})


def test_repaired_turns_are_what_the_digest_covers(spark, sf):
    turns = turn_repair.damaged(spark.read.parquet(f"{sf}/conversations.parquet"))
    repairs = turn_repair.repaired(turns)
    kept = defaultdict(list)
    for r in sorted(turn_repair.repaired_turns(turns, repairs).collect(), key=lambda r: (r.conv_id, r.position)):
        assert r.position == len(kept[r.conv_id])
        kept[r.conv_id].append((r.role, r.text))
    for r in repairs.collect():
        assert digest(kept[r.conv_id]) == r.repaired_sha256 and len(kept[r.conv_id]) == r.kept
