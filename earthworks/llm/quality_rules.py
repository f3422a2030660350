"""Quality rules: a table of thresholds, compiled into one projection of built-in functions.

Every rule names a measure of the text and the range in which it must lie. The measures are

* ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words``: counts of the whole text,
* ``mean_word_chars``: code points per word,
* ``symbol_ratio``: symbols ``#*$%&|<>`` per word,
* ``shout_ratio``: exclamation and question marks per word,
* ``stop_ratio``: share of words that are stop words of a supported language, whatever their case and the punctuation
  around them (up to 12 bytes together); a text in another language has next to none and is not kept, so name its stop words before judging it,
* ``dup_line_ratio``: share of lines with a word that repeat an earlier line,
* ``ellipsis_ratio``: share of lines with a word that end in an ellipsis.

Defined results: a null or empty text has zero words, fails the base rule and is not kept. Repeated rows and ties are
judged one by one, since the projection looks at one row only; an empty table gives an empty result. A text of any length
is taken whole: repeated windows are found by sorting the text's own windows, never across rows. Columns of the input
that clash with a measure are left out of the work and stay untouched under their own name in ``judge``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earthworks.llm.words import GAP, words

SYMBOLS = r"[#*$%&|<>]"
MOST_BYTES = 12  # of a stop word with the signs around it
# Signs that stand at the edges of words.
PUNCTUATION = """.,;:!?…'"`´‘’‚‛“”„«»‹›()[]{}¿¡-–—*_/"""

# Frequent function words of the supported languages.
STOP_WORDS = {
    "en": "the of and to a in is it that for on as with was by are be this at from or an not have which".split(),
    "de": "der die das und in zu den von mit ist des im für auf ein eine nicht dem sich als auch es an".split(),
    "fr": "de la le et les des en un une du est que dans qui par pour au sur pas plus ce il elle".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más".split(),
}


@dataclass(frozen=True)
class Rule:
    """A measure must lie between two bounds, both included; None leaves a side open."""

    measure: str
    least: float | None = None
    most: float | None = None


RULES = (
    Rule("mean_word_chars", 2, 15),
    Rule("symbol_ratio", None, 0.1),
    Rule("shout_ratio", None, 0.3),
    Rule("stop_ratio", 0.02, None),
    Rule("dup_line_ratio", None, 0.5),
    Rule("ellipsis_ratio", None, 0.3),
)


def _squeezed(text: Column, pattern: str) -> Column:
    """Code points that a pattern of single characters takes."""
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def _is_stop(word: Column, stops: list[str]) -> Column:
    """Most words are told as they are written; only short ones are folded and freed of signs, which takes longer."""
    return word.isin(stops) | ((F.octet_length(word) <= MOST_BYTES) & F.lower(F.btrim(word, F.lit(PUNCTUATION))).isin(stops))


def _repeat_words(ws: Column, grams: Column) -> Column:
    """Words that lie in a window of three found twice or more: windows sorted, neighbours compared, positions joined."""
    placed = F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def repeated(s: Column) -> Column:
        same = lambda x, j: F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))
        hits = F.filter(s, lambda x, j: same(x, j + 1) | ((j > 0) & same(x, F.greatest(j - 1, F.lit(0)))))
        covered = F.flatten(F.transform(hits, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))
        return F.size(F.array_distinct(covered))

    # transform over a one-element array binds the sorted windows once
    counted = F.element_at(F.transform(F.array(placed), repeated), 1)
    return F.when(F.size(F.array_distinct(grams)) < F.size(grams), counted).otherwise(0).cast("long")


def _grams(ws: Column) -> Column:
    """A 64-bit hash of each window of three words; no window below three words."""
    starts = F.when(F.size(ws) >= 3, F.sequence(F.lit(0), F.size(ws) - 3)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(F.get(ws, i), F.get(ws, i + 1), F.get(ws, i + 2)))


def measures(df: DataFrame, keys: list[str], text: str = "text", stop_words: dict = STOP_WORDS) -> DataFrame:
    """The keys and every measure of a row's text."""
    stops = sorted({w for ws in stop_words.values() for w in ws})
    whole = F.coalesce(F.col(text), F.lit(""))
    base = df.select(*keys, whole.alias("_text"), words(F.col(text)).alias("_words"),
                     F.filter(F.split(whole, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"))
    cut = base.select(
        *keys,
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.regexp_replace("_text", GAP, "")).cast("long").alias("word_chars"),
        _squeezed(F.col("_text"), SYMBOLS).cast("long").alias("n_symbols"),
        _squeezed(F.col("_text"), "[!?]").alias("_shouts"),
        F.size("_lines").alias("_n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("_lines", lambda x: x.rlike(r"(\.\.\.|…)[\x20\x09-\x0D]*$"))).alias("_ellipses"),
        F.size(F.filter("_words", lambda w: _is_stop(w, stops))).alias("_stops"),
        F.col("_words"), _grams(F.col("_words")).alias("_grams"),
    )
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return cut.select(
        *keys, "n_words", "word_chars", "n_symbols", "n_dup_lines",
        _repeat_words(F.col("_words"), F.col("_grams")).alias("n_repeat_words"),
        share("word_chars", "n_words").alias("mean_word_chars"),
        share("n_symbols", "n_words").alias("symbol_ratio"),
        share("_shouts", "n_words").alias("shout_ratio"),
        share("_stops", "n_words").alias("stop_ratio"),
        share("n_dup_lines", "_n_lines").alias("dup_line_ratio"),
        share("_ellipses", "_n_lines").alias("ellipsis_ratio"),
    )


def compiled(rules: tuple[Rule, ...] = RULES) -> Column:
    """All rules as one condition."""
    kept = F.lit(True)
    for rule in rules:
        if rule.least is not None:
            kept = kept & (F.col(rule.measure) >= rule.least)
        if rule.most is not None:
            kept = kept & (F.col(rule.measure) <= rule.most)
    return kept


def judge(df: DataFrame, keys: list[str], text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Measures, the base rule and the verdict for every row."""
    base_failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return measures(df, keys, text).withColumn("base_failed", base_failed).withColumn(
        "kept", ~F.col("base_failed") & compiled(rules))
