"""Quality rules, with DataFrame operations only: counting rules, and divergence from language references.

A document's character classes (those of CLASSES, bytes beyond one a character, and the other characters of words) and its language's common words are counted to two histograms. First references are the
summed histograms of all documents of a language (languages outside LANGUAGES share the reference of all documents); the references in use are
summed again over the documents within the median character distance and the upper quartile of the word distance of the first ones, since
junk of symbols weighs so much in the plain sums that clean and junk texts overlap. A document is rejected if the Jensen-Shannon distance (base 2) of either histogram to its reference exceeds its limit. The
guards: the character histogram needs MIN_CHARS characters in words, the word histogram MIN_WORDS words, else the distance
is not judged.

Cases: null, empty and blank texts have no words and fail the counting rules; null or unknown lang uses the reference of
all documents; rows are judged one by one, so repeated rows and null doc_ids keep their rows; an empty table gives no
rows. Texts of any length are counted whole. Extra columns are ignored by the query and kept by the stage.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, stored, table, words_of

# Languages with references and their common words.
COMMON = {
    "en": ["the", "of", "and", "to", "in", "is", "that", "for"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un"],
    "es": ["de", "la", "que", "el", "en", "y", "los", "se"],
    "": ["the", "of", "der", "die", "de", "la", "que", "en"],
}
LANGUAGES = ("en", "de", "fr", "es")
SYMBOLS = "[#*$%&|<>]"
CLASSES = {"upper": r"\p{Lu}", "point": r"[.,;:'\"()\-]", "symbol": SYMBOLS}
LONGEST = max(len(w.encode()) for ws in COMMON.values() for w in ws)
MIN_WORDS = 50
MIN_CHARS = 200
MAX_CHAR_DISTANCE = 0.185
MAX_WORD_DISTANCE = 0.35


def repeated_words(words: Column) -> Column:
    """Words inside three-word windows that occur twice or more in the array, first occurrences included.

    Window hashes tell the many texts without a repeat; the others sort their windows as strings, next to their positions,
    and add up what the repeated windows cover.
    """
    last = F.size(words) - 2
    # An array whose hashes are all different has no two equal windows.
    hashes = F.transform(F.sequence(F.lit(1), last), lambda i: F.xxhash64(F.element_at(words, i), F.element_at(words, i + 1), F.element_at(words, i + 2)))
    windows = F.transform(F.sequence(F.lit(1), last), lambda i: F.struct(F.concat_ws(" ", F.element_at(words, i), F.element_at(words, i + 1), F.element_at(words, i + 2)).alias("w"), i.alias("i")))

    def cover(sorted_windows: Column) -> Column:
        n = F.size(sorted_windows)
        twice = F.filter(
            F.transform(
                sorted_windows,
                lambda x, k: F.when(
                    ((k > 0) & (F.get(sorted_windows, k - 1)["w"] == x["w"])) | ((k < n - 1) & (F.get(sorted_windows, k + 1)["w"] == x["w"])), x["i"]
                ),
            ),
            lambda i: i.isNotNull(),
        )
        start = F.struct(F.lit(0).alias("until"), F.lit(0).cast("long").alias("n"))
        step = lambda acc, i: F.struct((i + 3).alias("until"), (acc["n"] + i + 3 - F.greatest(acc["until"], i)).cast("long").alias("n"))
        return F.aggregate(F.array_sort(twice), start, step)["n"]

    return F.when(last < 2, F.lit(0).cast("long")).when(F.size(F.array_distinct(hashes)) == last, F.lit(0).cast("long")).otherwise(_let(F.array_sort(windows), cover))


def _let(value: Column, use) -> Column:
    """use(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def characters(text: Column, kind: str) -> Column:
    """How many characters of a kind a text has. Counted by what is left without them: matches needn't become strings."""
    return (F.char_length(text) - F.char_length(F.regexp_replace(text, f"{kind}+", ""))).cast("long")


def measured(docs: DataFrame) -> DataFrame:
    """docs with its counts and histograms; text may be null."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.withColumn("_words", words_of(F.col("text")))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    lang = F.when(F.col("lang").isin(*LANGUAGES), F.col("lang")).otherwise(F.lit(""))
    common = reduce(lambda c, k: c.when(lang == k, F.array(*map(F.lit, COMMON[k]))), LANGUAGES, F.when(F.lit(False), F.array(F.lit("")))).otherwise(F.array(*map(F.lit, COMMON[""])))
    rows = rows.withColumn("_common", common).withColumn("_group", lang)
    # All common words are short; the rest needn't be compared.
    brief = F.filter("_words", lambda w: F.octet_length(w) <= LONGEST)
    found = F.filter(F.transform(brief, lambda w: F.lower(w)), lambda w: F.array_contains(F.col("_common"), w))
    counts = _let(found, lambda f: F.transform("_common", lambda c: F.size(F.filter(f, lambda w: w == c)).cast("long")))
    n_words = F.size("_words").cast("long")
    rows = rows.withColumns({
        "n_words": n_words,
        "word_chars": F.char_length(F.array_join("_words", "")).cast("long"),
        "n_symbols": characters(text, SYMBOLS),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_repeat_words": repeated_words(F.col("_words")),
        "_classes": F.array(*[characters(text, p) for p in CLASSES.values()], (F.octet_length(text) - F.char_length(text)).cast("long")),
        "_counts": counts,
    })
    used = F.aggregate("_classes", F.lit(0).cast("long"), lambda a, x: a + x)
    named = F.aggregate("_counts", F.lit(0).cast("long"), lambda a, x: a + x)
    rows = rows.withColumn("_chars", F.concat("_classes", F.array(F.greatest(F.col("word_chars") - used, F.lit(0).cast("long")))))
    return rows.withColumn("_common_words", F.concat("_counts", F.array(F.col("n_words") - named))).drop("_words", "_common", "_classes", "_counts")


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two histograms of counts: the root of the divergence in bits."""
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    share = lambda c: F.transform(c, lambda x: F.coalesce(F.try_divide(x.cast("double"), total(c)), F.lit(0.0)))
    part = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))
    terms = F.zip_with(share(p), share(q), lambda x, y: (part(x, (x + y) / 2) + part(y, (x + y) / 2)) / 2)
    return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda a, x: a + x), F.lit(0.0)))


def references(rows: DataFrame) -> DataFrame:
    """Summed histograms by language: at most one row for each of LANGUAGES and one for all documents together."""
    every = rows.select(F.explode(F.array_distinct(F.array(F.col("_group"), F.lit("")))).alias("_group"), "_chars", "_common_words")
    sums = lambda c, n: F.array(*[F.coalesce(F.sum(F.get(c, i)), F.lit(0)) for i in range(n)])
    return every.groupBy("_group").agg(sums("_chars", len(CLASSES) + 2).alias("_ref_chars"), sums("_common_words", len(COMMON["en"]) + 1).alias("_ref_words"))


def distances(rows: DataFrame, refs: DataFrame) -> DataFrame:
    """rows with char_distance and word_distance; refs has at most len(LANGUAGES) + 1 rows, so it can be broadcast at any size."""
    rows = rows.join(F.broadcast(refs), "_group", "left")
    rows = rows.withColumn("char_distance", F.when(F.col("word_chars") >= MIN_CHARS, js_distance(F.col("_chars"), F.col("_ref_chars"))))
    return rows.withColumn("word_distance", F.when(F.col("n_words") >= MIN_WORDS, js_distance(F.col("_common_words"), F.col("_ref_words")))).drop("_ref_chars", "_ref_words")


def trimmed_references(rows: DataFrame) -> DataFrame:
    """References of the half of each language's documents that lie nearest to its first reference, so that junk hardly weighs."""
    first = distances(rows, references(rows)).where("char_distance is not null and word_distance is not null")
    middle = first.groupBy("_group").agg(F.percentile_approx("char_distance", 0.5).alias("_c"), F.percentile_approx("word_distance", 0.75).alias("_w"))
    near = first.join(F.broadcast(middle), "_group").where("char_distance <= _c and word_distance <= _w")
    return references(near)


def judged(rows: DataFrame, refs: DataFrame) -> DataFrame:
    """measured rows with distances and verdicts."""
    rows = distances(rows, refs)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    far = F.coalesce(F.col("char_distance") > MAX_CHAR_DISTANCE, F.lit(False)) | F.coalesce(F.col("word_distance") > MAX_WORD_DISTANCE, F.lit(False))
    return rows.withColumn("base_failed", failed).withColumn("kept", ~failed & ~far)


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def quality(docs: DataFrame, *keys: str) -> DataFrame:
    """doc_id, keys, the counts, base_failed, kept and both distances of each row of docs (doc_id, text, lang and keys)."""
    rows = stored(measured(docs.select("doc_id", "text", "lang", *keys)).drop("text"), "quality")
    return judged(rows, stored(trimmed_references(rows), "references")).select("doc_id", *keys, *COUNTS, "base_failed", "kept", "char_distance", "word_distance")


def op4_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Every document with its counts and the verdict of the rules."""
    return quality(table(spark, sf_dir, "documents"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without the rows that the rules reject. A verdict depends on text and lang alone, so rows are looked up by a hash of these."""
    key = free_name([*docs.columns, *COUNTS, "base_failed", "kept"], "row")
    tagged = docs.withColumn(key, F.xxhash64(F.coalesce("text", F.lit("")), F.coalesce("lang", F.lit("\0"))))
    return tagged.join(quality(tagged, key).where("kept").select(key).distinct(), key, "left_semi").select(docs.columns)
