"""Quality rules: a threshold table compiled into one Spark projection, with built-in functions only.

``RULES`` has a line for each rule: a measure, the bound and its side.
``compiled`` turns the table into one Boolean column for each rule; all
measures of a document come from its own row, so there is no shuffle.

Defined results: a null or empty text has no words and fails; repeated rows
are judged one by one; an empty table gives no rows.  Other columns are
ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import SPACES, WORD

SYMBOLS = "#*$%&|<>"            # fixed value of the contract
REPEAT_WINDOW = 8
MIN_WORDS = 20

# Frequent function words of the four languages.
STOP_WORDS = (
    "the", "of", "and", "to", "a", "in", "is", "that", "it", "for", "was", "on", "with", "as", "be",
    "der", "die", "das", "und", "zu", "den", "mit", "von", "ein", "eine", "nicht", "im", "des", "auf",
    "le", "la", "les", "de", "des", "et", "un", "une", "du", "que", "pour", "pas", "en", "sur", "qui",
    "el", "los", "las", "y", "no", "por", "con", "para", "del", "se", "su", "al", "lo",
)


@dataclass(frozen=True)
class Rule:
    name: str
    measure: str
    at_least: float | None = None
    at_most: float | None = None


# The base rules of the contract come first.
RULES = (
    Rule("enough_words", "n_words", at_least=MIN_WORDS),
    Rule("few_repeated_words", "repeat_percent", at_most=30),
    Rule("word_length", "mean_word_chars", at_least=1.5, at_most=25),
    Rule("few_symbols", "symbols_per_word", at_most=0.3),
    Rule("stop_words", "stop_share", at_least=0.01),
    Rule("few_repeated_lines", "dup_line_share", at_most=0.5),
    Rule("few_exclamations", "exclamations_per_word", at_most=0.3),
)
BASE_RULES = ("enough_words", "few_repeated_words")


def compiled(rules: tuple[Rule, ...]) -> dict[str, Column]:
    """Per rule: whether a row with the measures as columns passes."""
    out = {}
    for r in rules:
        ok = F.lit(True)
        if r.at_least is not None:
            ok = ok & (F.col(r.measure) >= F.lit(r.at_least))
        if r.at_most is not None:
            ok = ok & (F.col(r.measure) <= F.lit(r.at_most))
        out[r.name] = ok
    return out


def _sorted_windows() -> Column:
    """(hash, place) of the windows, sorted; empty in the usual case that none is repeated."""
    pairs = F.array_sort(F.transform("_win", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct("_win")) < F.size("_win"), pairs).otherwise(
        F.array().cast("array<struct<h:bigint,i:int>>"))


def _repeated_words() -> Column:
    """How many words the windows cover whose hash a neighbour in ``_sorted`` shares."""
    def twice(x, k):
        same = [F.coalesce(F.get("_sorted", k + F.lit(o))["h"] == x["h"], F.lit(False)) for o in (-1, 1)]
        return F.when(same[0] | same[1], x["i"])

    places = F.array_sort(F.filter(F.transform("_sorted", twice), lambda i: i.isNotNull()))
    start = F.struct(F.lit(0).alias("n"), F.lit(-REPEAT_WINDOW).alias("last"))
    return F.aggregate(places, start, lambda s, i: F.struct(
        (s["n"] + F.least(i - s["last"], F.lit(REPEAT_WINDOW))).alias("n"), i.alias("last")))["n"]


def measures(docs: DataFrame) -> DataFrame:
    """doc_id and the measures of each document."""
    text = F.coalesce("text", F.lit(""))
    step = docs.select("doc_id", text.alias("_t")).select(
        "doc_id", "_t", F.regexp_extract_all("_t", F.lit(WORD), F.lit(0)).alias("_w"),
        F.filter(F.split("_t", "\n"), lambda x: x.rlike(WORD)).alias("_lines"))
    step = step.select("*", F.transform("_w", lambda w: F.xxhash64(w)).alias("_h"))
    last = F.size("_h") - F.lit(REPEAT_WINDOW)
    step = step.select("*", F.when(last >= 1, F.transform(
        F.sequence(F.lit(0), F.greatest(last, F.lit(0))),
        lambda i: F.xxhash64(*[F.get("_h", i + F.lit(k)) for k in range(REPEAT_WINDOW)])))
        .otherwise(F.array().cast("array<bigint>")).alias("_win"))
    step = step.select("*", _sorted_windows().alias("_sorted"))
    n = F.size("_w").cast("long")
    step = step.select(
        "doc_id", n.alias("n_words"),
        F.length(F.translate("_t", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("_t") - F.length(F.translate("_t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        _repeated_words().cast("long").alias("n_repeat_words"),
        F.size("_lines").alias("_n_lines"),
        F.size(F.filter("_w", lambda w: F.lower(w).isin(list(dict.fromkeys(STOP_WORDS))))).alias("_n_stop"),
        (F.length("_t") - F.length(F.translate("_t", "!", ""))).alias("_n_mark"))
    words = F.greatest("n_words", F.lit(1))
    return step.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (F.lit(100) * F.col("n_repeat_words") / words).alias("repeat_percent"),
        (F.col("word_chars") / words).alias("mean_word_chars"),
        (F.col("n_symbols") / words).alias("symbols_per_word"),
        (F.col("_n_stop") / words).alias("stop_share"),
        (F.col("n_dup_lines") / F.greatest("_n_lines", F.lit(1))).alias("dup_line_share"),
        (F.col("_n_mark") / words).alias("exclamations_per_word"))


def quality(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per row: the measures, base_failed, kept, and ``failed``, the names of the failed rules."""
    passed = compiled(rules)
    base = F.lit(True)
    every = F.lit(True)
    for name, ok in passed.items():
        every = every & ok
        if name in BASE_RULES:
            base = base & ok
    failed = F.filter(F.array(*[F.when(~ok, F.lit(name)) for name, ok in passed.items()]), lambda x: x.isNotNull())
    return measures(docs).select("*", (~base).alias("base_failed"), every.alias("kept"), failed.alias("failed"))


def good_documents(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents that pass, all columns unchanged; ids are not used, each row is judged by its text."""
    names = docs.columns
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("doc_id"), "text")
    # The generator keeps the filter, with all that makes the measures, from moving below the projections.
    judged = quality(row, rules).select(F.explode_outer(F.array(F.struct("doc_id", "kept"))).alias("x"))
    return judged.where("x.kept").select("x.doc_id.*")
