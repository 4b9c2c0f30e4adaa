"""Identity of clubs by their names, as columns: the words of a name, abbreviations that the regular expression engine backtracks over, tiers, and the matching-block ratio.

Whether one name abbreviates another is asked of the engine: the words of the shorter name become a pattern in which each word may
stand for itself, for a longer word that it shortens, or for the first letters of a run of words.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that name no club, words that name another side of a club, and what each kind of likeness is worth.
GENERIC_WORDS = (
    "fc", "afc", "cf", "sc", "ac", "as", "aj", "bk", "sk", "fk", "ff", "if", "ik", "ifk", "aif", "is",
    "kv", "kvc", "kaa", "ksv", "krc", "sv", "cd", "sd", "ud", "rcd", "se", "kc", "bc", "ks", "rfc", "cfc",
    "tf", "de", "del", "da", "do", "dos", "das", "the", "of", "and",
)
SIDE_WORDS = (
    "b", "c", "ii", "iii", "reserve", "reserves", "res", "youth", "academy", "jong",
    "u17", "u18", "u19", "u20", "u21", "u23", "women", "womens", "ladies", "w", "femenino", "feminino", "frauen",
)
EQUAL, EXPANDED, CONTAINED, PARTIAL = 1.0, 0.95, 0.9, 0.85
MARGIN = 0.05

_ANY = "[a-z0-9]*"
#: What the compatibility forms of Latin letters spell that one character cannot.
_LIGATURES = ("ﬀ", "ﬁ", "ﬂ", "ﬃ", "ﬄ", "ﬅ", "ﬆ", "ĳ", "Ĳ", "ǆ", "Ǆ", "ǅ", "ǉ", "Ǉ", "ǈ", "ǌ", "Ǌ", "ǋ", "ŉ")


@lru_cache(1)
def _accents() -> tuple[str, str]:
    """Characters that decompose (NFKD) to one letter or digit and combining marks, and those letters; then the combining marks, which have none."""
    kept: list[tuple[str, str]] = []
    marks = []
    for c in map(chr, range(0xA0, 0x10000)):
        plain = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if not plain:
            marks.append(c)
        elif len(plain) == 1 and plain != c and plain.isascii() and plain.isalnum():
            kept.append((c, plain))
    return "".join(c for c, _ in kept) + "".join(marks), "".join(x for _, x in kept)


def unaccented(name: Column) -> Column:
    """name without accents: each character's compatibility decomposition without its combining marks, by a table made from the Unicode data (X24). Names of one byte a letter have none."""
    plain = name
    for c in _LIGATURES:
        plain = F.replace(plain, F.lit(c), F.lit("".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))))
    return F.when(F.octet_length(name) == F.length(name), name).otherwise(F.translate(plain, *_accents()))


def words_of(name: Column) -> Column:
    """The words that tell a club: folded, lower case, apostrophes dropped, runs of single letters joined, generic words left out unless there are no others."""
    plain = F.regexp_replace(F.translate(F.lower(unaccented(F.coalesce(name, F.lit("")))), "'’", ""), "[^0-9a-z]+", " ")
    joined = F.regexp_replace(F.btrim(plain), r"\b([a-z]) (?=[a-z]\b)", "$1")
    every = F.filter(F.split(joined, " "), lambda w: w != "")
    own = lambda ws: F.filter(ws, lambda w: ~w.isin(*GENERIC_WORDS))
    # Inside a lambda the words are made once, not for each use.
    return F.get(F.transform(F.array(every), lambda ws: F.when(F.size(own(ws)) > 0, own(ws)).otherwise(ws)), 0)


def side_of(words: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(words, lambda w: w.isin(*SIDE_WORDS))))


def first_letters(words: Column) -> Column:
    return F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), "")


def _letters(word: Column) -> Column:
    return F.filter(F.split(word, ""), lambda c: c != "")


def _reading(word: Column) -> Column:
    """A pattern of what a word may stand for."""
    letters = F.array_join(_letters(word), _ANY)
    shortened = F.when(F.length(word) >= 3, F.concat(F.lit("|"), word, F.lit("[a-z0-9]+|"), letters)).otherwise("")
    run = F.when(F.length(word).between(2, 4) & word.rlike("^[a-z]+$"), F.concat(F.lit("|"), F.array_join(_letters(word), f"{_ANY} "), F.lit(_ANY))).otherwise("")
    return F.concat(F.lit("(?:"), word, shortened, run, F.lit(")"))


def _covers(x: Column, y: Column, more: bool) -> Column:
    """Whether the words of x stand in order for words of y, one of them at least for itself; for all words of y unless more."""
    gap = " (?:[a-z0-9]+ )*" if more else " "
    ends = ("^(?:[a-z0-9]+ )*", "(?: [a-z0-9]+)*$") if more else ("^", "$")
    one_plain = F.transform(x, lambda w, i: F.array_join(F.transform(x, lambda v, j: F.when(i == j, v).otherwise(_reading(v))), gap))
    pattern = F.concat(F.lit(ends[0] + "(?:"), F.array_join(one_plain, "|"), F.lit(")" + ends[1]))
    initials = F.length(F.get(x, 0)).between(3, 4) & F.get(x, 0).rlike("^[a-z]+$") & (F.size(y) == F.length(F.get(x, 0))) & (first_letters(y) == F.get(x, 0))
    return F.when(F.size(x) == 1, initials).when(F.size(x) > 1, F.regexp_like(F.array_join(y, " "), pattern)).otherwise(False)


def _in_order(x: Column, y: Column) -> Column:
    """Whether the first letters of x occur in those of y in order, which every reading of the words of x as words of y needs; a short pattern, asked before the long one."""
    return F.regexp_like(first_letters(y), F.array_join(F.transform(x, lambda w: F.substring(w, 1, 1)), ".*"))


def inside(x: Column, y: Column) -> Column:
    """What it is worth that x, of as many words or fewer, lies in y."""
    fewer = (F.size(F.array_except(x, y)) == 0) & (F.size(F.array_except(y, x)) > 0)
    likely = _in_order(x, y)
    return F.when(F.size(x) > F.size(y), 0.0).when(likely & _covers(x, y, False), EXPANDED).when(fewer, CONTAINED).when(likely & _covers(x, y, True), PARTIAL).otherwise(0.0)


def tier(incoming: Column, known: Column) -> Column:
    """The worth of a known club's words as those of an incoming name: 1, 0.95, 0.9, 0.85 or 0. Containment counts one way only: the known name inside the incoming one."""
    same = (F.size(F.array_except(incoming, known)) == 0) & (F.size(F.array_except(known, incoming)) == 0)
    back = F.when(inside(incoming, known) == EXPANDED, EXPANDED).otherwise(0.0)
    unlike = (F.size(incoming) == 0) | (F.size(known) == 0) | (side_of(incoming) != side_of(known))
    return F.when(unlike, 0.0).when(same, EQUAL).otherwise(F.greatest(inside(known, incoming), back))


def index_terms(words: Column) -> Column:
    """Terms of which two names share one whenever their tier is above 0: their words, and first letters for the names that initials can stand for."""
    alone = F.when((F.size(words) == 1) & F.length(F.get(words, 0)).between(3, 4), F.array(F.concat(F.lit("#"), F.get(words, 0)))).otherwise(F.array())
    many = F.when(F.size(words).between(3, 4), F.array(F.concat(F.lit("#"), first_letters(words)))).otherwise(F.array())
    return F.array_distinct(F.concat(words, alone, many))


def bigrams(text: Column) -> Column:
    """Pairs of neighbouring letters, and the single letters of a text of four or fewer. Two texts whose ratio is 0.8 or more share one: of their T letters at most
    0.2 T are left over, which part the 0.4 T or more that match into 0.2 T + 1 blocks at most, so that one has two letters if T is above 5."""
    n = F.length(text)
    pairs = F.when(n >= 2, F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(2)))).otherwise(F.array())
    single = F.when(n <= 4, _letters(text)).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(pairs, single))


def matched_letters(a: str, b: str) -> int:
    """Letters in the longest common block, and in those left and right of it in turn; of equal blocks the one that starts first in a, then in b."""
    where: dict[str, list[int]] = {}
    for j, c in enumerate(b):
        where.setdefault(c, []).append(j)
    found, open_ = 0, [(0, len(a), 0, len(b))]
    while open_:
        a0, a1, b0, b1 = open_.pop()
        size, at_a, at_b = 0, a0, b0
        ending: dict[int, int] = {}
        for i in range(a0, a1):
            here: dict[int, int] = {}
            for j in where.get(a[i], ()):
                if b0 <= j < b1:
                    n = here[j] = ending.get(j - 1, 0) + 1
                    if n > size:
                        size, at_a, at_b = n, i - n + 1, j - n + 1
            ending = here
        if size:
            found += size
            open_ += [(a0, at_a, b0, at_b), (at_a + size, a1, at_b + size, b1)]
    return found


def block_ratio(a: Column, b: Column) -> Column:
    """Twice the matching letters over all letters of two texts; 1 for two empty ones. An Arrow batch at a time.

    It passes for not deterministic, as a filter on it would else be moved below the distinct and the shuffle that its pairs come from, and compare every row."""

    @F.pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else 1.0 if not p and not q else 2 * matched_letters(p, q) / (len(p) + len(q)) for p, q in zip(x, y, strict=True)], dtype="float64")

    return ratio.asNondeterministic()(a, b)
