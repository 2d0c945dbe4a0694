"""Quality rules: base counts, and the divergence of a document's histograms from its language's reference.

Two histograms per document: character classes (lower-case and other letters, capitals, digits, white space,
punctuation, symbols) and the most common words of its language against all others. The reference of a language is the
median share of each bin over all its documents of ``min_chars`` characters or more, one small row per language. A document is rejected if the
Jensen-Shannon distance (square root, base 2, in [0, 1]) of either histogram is above its bound. Short documents scatter more, so a bound is
``a + b / sqrt(n_words)``; below ``min_words`` words histograms say nothing and can't reject.

Nulls: a null text has no words and fails the base rules; a null or unlisted language is judged by character classes only, against
the reference of its own group (null is one group). A language of one document equals its reference. Rows are
independent, so repeated rows get the same result each. Empty tables and extra columns, whatever their names, are fine: a row travels as one struct.
All of it is DataFrame functions; a text is read once, where it lies, and never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, let, squeezed, table, text_of

# Frequent function words by language.
COMMON = {
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als".split(),
    "en": "the of and to in is that for it was on with as by from are be at or an".split(),
    "es": "de la que el en y a los del se las un por con no una su para es al".split(),
    "fr": "de la le et les des en un du une que est dans qui pour par au sur pas plus".split(),
}
SYMBOLS = "[#*$%&|<>]"
PUNCTUATION = r"[.,;:!?'\"()\-]"
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "class_distance", "word_distance", "kept"]
CLASSES = ("letter", "capital", "digit", "space", "punctuation", "symbol")


def words_of(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE + "+"))


def repeated_words(words: Column, width: int = 5) -> Column:
    """How many words lie in a window of ``width`` words that is found twice or more, first ones included.

    Windows are compared by a 64-bit hash. Sorting is only done where some window repeats.
    """
    zero = F.lit(0).cast("long")

    def windows(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - width), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(width)]))

    def covered(at: Column) -> Column:  # sorted starts of repeated windows
        gaps = F.transform(at, lambda x, i: F.least(F.lit(width), F.coalesce(F.get(at, i + 1) - x, F.lit(width))))
        return F.aggregate(gaps, zero, lambda acc, x: acc + x)

    def starts(pairs: Column) -> Column:  # sorted (hash, start)
        same = lambda x, y: F.coalesce(x["h"] == y["h"], F.lit(False))
        found = F.filter(pairs, lambda x, i: same(x, F.get(pairs, i - 1)) | same(x, F.get(pairs, i + 1)))
        return F.sort_array(F.transform(found, lambda x: x["i"]))

    def count(g: Column) -> Column:
        pairs = F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        detail = let(let(pairs, starts), covered)
        return F.when(F.size(F.array_distinct(g)) == F.size(g), zero).otherwise(detail)

    some = let(let(F.transform(words, lambda w: F.xxhash64(w)), windows), count)
    return F.when(F.size(words) < width + 1, zero).otherwise(some)


def base_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    t = text_of(text)
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    pair = let(words_of(t), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).alias("r")))
    out = docs.withColumns(
        {
            "_q_pair": pair,
            "word_chars": F.length(squeezed(t)).cast("long"),
            "n_symbols": F.regexp_count(t, F.lit(SYMBOLS)).cast("long"),
            "n_dup_lines": let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")),
        }
    )
    out = out.withColumns({"n_words": F.col("_q_pair.n"), "n_repeat_words": F.col("_q_pair.r")}).drop("_q_pair")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return out.withColumn("base_failed", failed)


def _counter(words: list[str]):
    """A function of a string of words, each between two spaces of its own, that counts each of ``words`` in it."""
    gone = lambda h, w: F.length(h) - F.length(F.replace(h, F.lit(f" {w} "), F.lit("")))
    return lambda h: F.array(*[(gone(h, w) / (len(w) + 2)).cast("long") for w in words])


def histograms(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """Rows of :func:`base_counts` with _q_chars, _q_class (array of long, by CLASSES) and _q_word (by the language's COMMON words, then all others)."""
    t = text_of(text)
    count = lambda pattern: F.regexp_count(t, F.lit(pattern)).cast("long")
    rest = ["capital", "digit", "space", "punctuation", "symbol"]
    out = docs.withColumns(
        {
            "_q_capital": count(r"\p{Lu}"),
            "_q_digit": count(r"\p{Nd}"),
            "_q_space": F.length(t) - F.col("word_chars"),
            "_q_punctuation": count(PUNCTUATION),
            "_q_symbol": F.col("n_symbols"),
        }
    )
    letter = F.length(t).cast("long")
    for name in rest:
        letter = letter - F.col(f"_q_{name}")
    out = out.withColumn("_q_chars", F.length(t)).withColumn("_q_class", F.array(letter, *[F.col(f"_q_{name}") for name in rest])).drop(*[f"_q_{name}" for name in rest])
    bins = F.lit(None).cast("array<long>")
    for name, common in COMMON.items():
        # the common words of the text as one string of letters, then one pass over that short string for each
        found = F.regexp_extract_all(t, F.lit(rf"(?<![^\x20\x09-\x0D])({'|'.join(common)})(?![^\x20\x09-\x0D])"), F.lit(1))
        hits = F.concat(F.lit(" "), F.array_join(found, "  "), F.lit(" "))
        other = (F.col("n_words") - F.size(found)).cast("long")
        bins = F.when(F.col(lang) == name, F.concat(let(hits, _counter(common)), F.array(other))).otherwise(bins)
    return out.withColumn("_q_word", bins)


def references(rows: DataFrame, lang: str = "lang", min_chars: int = 500) -> DataFrame:
    """``rows`` of :func:`histograms` -> _q_lang, _q_ref_class, _q_ref_word: the typical share of each bin in the documents of a language.

    The median over all its documents of at least ``min_chars`` characters (a mergeable sketch), so that junk does not
    move the reference as long as it is the smaller part.
    """

    def typical(column: str, n: int) -> Column:
        share = lambda i: F.when(F.col("_q_chars") >= min_chars, F.get(F.col(column), F.lit(i)) / _sum(F.col(column)))
        return F.array(*[F.coalesce(F.percentile_approx(F.when(_sum(F.col(column)) > 0, share(i)), 0.5), F.lit(0.0)) for i in range(n)])

    words = max(map(len, COMMON.values())) + 1
    return rows.groupBy(F.col(lang).alias("_q_lang")).agg(typical("_q_class", len(CLASSES)).alias("_q_ref_class"), typical("_q_word", words).alias("_q_ref_word"))


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)


def js_distance(a: Column, b: Column) -> Column:
    """Of two histograms of counts, base 2; null if one is empty."""

    def part(p: Column, m: Column) -> Column:
        return F.when(p > 0, p * F.log2(p / m)).otherwise(0.0)

    def distance(x: Column) -> Column:
        return F.sqrt(F.greatest(F.lit(0.0), _sum(F.transform(x, lambda y: part(y["p"], (y["p"] + y["q"]) / 2) + part(y["q"], (y["p"] + y["q"]) / 2))) / 2))

    shared = let(F.struct(_sum(a).alias("sa"), _sum(b).alias("sb")), lambda s: F.when((s["sa"] > 0) & (s["sb"] > 0), distance(F.zip_with(a, b, lambda x, y: F.struct((x / s["sa"]).alias("p"), (y / s["sb"]).alias("q"))))))
    return shared


def _verdicts(docs: DataFrame, text: str, lang: str, class_bound: tuple[float, float], word_bound: tuple[float, float], min_chars: int, min_words: int, keep_text: bool) -> DataFrame:
    """row (of ``docs``) and MEASURES. Texts are scanned once: counts and histograms are written, and both the references and the verdicts read them."""
    carried = [F.col(f"`{c}`") for c in docs.columns if keep_text or c != text]
    rows = docs.select(F.struct(*carried).alias("row"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    rows = table(histograms(base_counts(rows)).drop("text"))
    ref = table(references(rows, "lang", min_chars))  # one row per language
    joined = rows.join(ref, F.expr("lang <=> _q_lang"), "left")
    far = lambda distance, bound: F.coalesce(F.col(distance) > bound[0] + bound[1] / F.sqrt(F.col("n_words")), F.lit(False))
    said = lambda kind: F.when(F.col("n_words") >= min_words, js_distance(F.col(f"_q_{kind}"), F.col(f"_q_ref_{kind}")))
    out = joined.withColumns({"class_distance": said("class"), "word_distance": said("word")})
    return out.withColumn("kept", ~F.col("base_failed") & ~far("class_distance", class_bound) & ~far("word_distance", word_bound)).select("row", *MEASURES)


def judged(docs: DataFrame, text: str = "text", lang: str = "lang", class_bound: tuple[float, float] = (0.07, 1.5), word_bound: tuple[float, float] = (0.06, 2.2), min_chars: int = 500, min_words: int = 20, keep_text: bool = True) -> DataFrame:
    """``docs`` with the base counts, class_distance, word_distance and kept; without the text if ``keep_text`` is false.

    A column of ``docs`` with the name of a measure gives way to it; :func:`drop_rejected` returns all columns as they are.
    """
    out = _verdicts(docs, text, lang, class_bound, word_bound, min_chars, min_words, keep_text)
    left = [c for c in docs.columns if c.lower() not in MEASURES and (keep_text or c != text)]
    return out.select(*[F.col("row").getField(c).alias(c) for c in left], *MEASURES)


def drop_rejected(docs: DataFrame, text: str = "text", lang: str = "lang", class_bound: tuple[float, float] = (0.07, 1.5), word_bound: tuple[float, float] = (0.06, 2.2), min_chars: int = 500, min_words: int = 20) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns."""
    return _verdicts(docs, text, lang, class_bound, word_bound, min_chars, min_words, True).filter("kept").select("row.*")
