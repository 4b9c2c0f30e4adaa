"""Text of names as columns: accent folding, keys, edit similarity, repair of wrongly decoded text, numeric flattening of JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accented letters of European names and what they fold to.
ACCENTED = "àáâãäåāăąçćčďèéêëēęěìíîïīłñńňòóôõöøōőŕřśşšţťùúûüūůűýÿźżž"
FOLDED = "aaaaaaaaacccdeeeeeeeiiiiilnnnoooooooorrsssttuuuuuuuyyzzz"
GENERIC = ("fc", "cf", "sc", "ac", "afc", "club", "the", "de")


def folded(name: Column) -> Column:
    return F.translate(F.lower(name), ACCENTED, FOLDED)


def club_key(name: Column) -> Column:
    """Folded tokens without generic ones, joined by one space; null stays null."""
    tokens = F.split(F.trim(F.regexp_replace(folded(name), "[^a-z0-9]+", " ")), " ")
    return F.array_join(F.filter(tokens, lambda t: (t != "") & ~t.isin(*GENERIC)), " ")


def initials(name: Column) -> Column:
    return F.array_join(F.transform(F.split(club_key(name), " "), lambda t: F.substring(t, 1, 1)), "")


def name_tier(a: Column, b: Column) -> Column:
    """1.0 for equal keys, 0.95 for initials, 0.9 for containment, else the share of letters that edits leave, to 0.85 at most."""
    x, y = club_key(a), club_key(b)
    longer = F.greatest(F.length(x), F.length(y))
    edits = F.when(longer > 0, 1 - F.levenshtein(x, y) / longer).otherwise(0.0)
    return F.when(x == y, 1.0).when((F.length(y) > 1) & (initials(a) == y) | (F.length(x) > 1) & (initials(b) == x), 0.95).when((F.length(x) > 3) & (F.length(y) > 3) & (F.contains(x, y) | F.contains(y, x)), 0.9).otherwise(F.least(edits, F.lit(0.85)))


def repaired(text: Column, rounds: int = 2) -> Column:
    """UTF-8 that was read as Latin-1 is decoded again, twice at most; other text stays as it is."""
    for _ in range(rounds):
        again = F.decode(F.encode(text, "ISO-8859-1"), "UTF-8")
        odd = text.rlike("[Â-ô][\u0080-¿]") & ~text.rlike("[^\u0000-ÿ]")
        text = F.when(odd & ~F.contains(again, F.lit("�")), again).otherwise(text)
    return text


def flat_numbers(json: Column) -> Column:
    """A map of the top-level numeric and boolean members of a JSON object: bool becomes 0/1, others are dropped."""
    pairs = F.map_entries(F.from_json(json, "map<string,string>"))
    number = lambda v: F.when(F.lower(v) == "true", 1.0).when(F.lower(v) == "false", 0.0).otherwise(F.try_cast(v, "double") if hasattr(F, "try_cast") else v.try_cast("double"))
    kept = F.filter(F.transform(pairs, lambda e: F.struct(e["key"].alias("key"), number(e["value"]).alias("value"))), lambda e: e["value"].isNotNull() & ~F.isnan(e["value"]) & (F.abs(e["value"]) < float("inf")))
    return F.map_from_entries(kept)
