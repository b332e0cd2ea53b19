"""Quality rules: a table of thresholds compiled into one projection of built-in functions."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
_DOC = "__doc"

#: Frequent function words by language.
STOP_WORDS = {
    "de": "auf das dem den der des die ein eine für im in ist mit nicht sich und von zu".split(),
    "en": "a and as at be by for from in is it of on or that the this to was with".split(),
    "es": "con de del el en la las los no para por que se su un una y".split(),
    "fr": "dans de des du elle en est et la le les pas pour que qui sur un une".split(),
}


class Rule(NamedTuple):
    """Keep a document while ``low <= 100 * metric / per <= high`` (None: no
    bound). With ``languages`` the rule binds only documents of these languages
    and of no stated language."""

    name: str
    metric: str
    per: str
    low: int | None = None
    high: int | None = None
    languages: tuple[str, ...] = ()


#: What every document has to meet; words in repeated windows are the last.
BASE = (
    Rule("few_words", "n_words", "one", low=5000),
    Rule("repeated_words", "n_repeat_words", "n_words", high=50),
)
#: The method's own thresholds, in hundredths.
RULES = (
    Rule("short_words", "word_chars", "n_words", low=250),
    Rule("long_words", "word_chars", "n_words", high=1200),
    Rule("symbols", "n_symbols", "n_words", high=10),
    Rule("repeated_lines", "n_dup_lines", "n_lines", high=40),
    Rule("stop_words", "n_stop_words", "n_words", low=2, languages=tuple(STOP_WORDS)),
)


def _failed(rule: Rule) -> Column:
    value, per = 100 * F.col(rule.metric), F.lit(1) if rule.per == "one" else F.col(rule.per)
    out = F.lit(False)
    if rule.low is not None:
        out = out | (value < rule.low * per)
    if rule.high is not None:
        out = out | (value > rule.high * per)
    if rule.languages:
        out = out & (F.col("lang").isNull() | F.col("lang").isin(*rule.languages))
    return out


def measured(docs: DataFrame, lang: str | None = "lang") -> DataFrame:
    """A struct of the input's columns, and the metrics of its text.

    Three-word windows are compared by a 64-bit hash of their words within a text.
    """
    stop = sorted({w for words in STOP_WORDS.values() for w in words})
    words = docs.select(
        F.struct("*").alias(_DOC),
        (F.col(lang) if lang else F.lit(None)).cast("string").alias("lang"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(WORD), F.lit(0)).alias("words"),
    )
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(WORD))
    hashes = F.transform(
        F.sequence(F.lit(0), F.size("words") - 3),
        lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)),
    )
    counted = words.select(
        _DOC,
        "lang",
        F.size("words").cast("long").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        lines.alias("lines"),
        F.size(F.filter("words", lambda w: w.isin(*stop))).cast("long").alias("n_stop_words"),
        F.when(F.size("words") >= 3, hashes).otherwise(F.array().cast("array<bigint>")).alias("hashes"),
    )
    own = ("lang", "n_words", "word_chars", "n_symbols", "n_stop_words")
    placed = F.sort_array(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    sorted_ = counted.select(
        _DOC,
        *own,
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct("hashes")) < F.size("hashes"), placed).alias("placed"),
    )

    def again(x: Column, k: Column) -> Column:
        return F.coalesce(F.get("placed", k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get("placed", k + 1)["h"] == x["h"], F.lit(False))

    covered = F.flatten(F.transform(F.filter("placed", again), lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))
    repeated = F.when(F.col("placed").isNull(), 0).otherwise(F.size(F.array_distinct(covered)))
    return sorted_.select(_DOC, *own, "n_lines", "n_dup_lines", repeated.cast("long").alias("n_repeat_words"))


def judged(docs: DataFrame, rules: tuple[Rule, ...] = RULES, base: tuple[Rule, ...] = BASE, lang: str | None = "lang") -> DataFrame:
    """The metrics of every row with ``failed`` (names of the rules it breaks), ``base_failed`` and ``kept``.

    A null or empty text has no words and so fails ``few_words``. Rows are
    judged one by one: repeated rows get equal results, an empty table gives
    none. The input's columns are in a struct and can't clash.

    The result comes out of a generator of one row: Spark would push a filter on the metrics below the
    projections and so compute the words of a text once per word.
    """
    names = [F.when(_failed(r), F.lit(r.name)) for r in (*base, *rules)]
    broken = F.filter(F.array(*names), lambda x: x.isNotNull()).alias("failed")
    base_failed = F.lit(False)
    for r in base:
        base_failed = base_failed | _failed(r)
    out = measured(docs, lang).select("*", broken, base_failed.alias("base_failed")).withColumn("kept", F.size("failed") == 0)
    return out.select(F.explode_outer(F.array(F.struct("*"))).alias("row")).select("row.*")


def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, base: tuple[Rule, ...] = BASE, lang: str | None = "lang") -> DataFrame:
    """The rows of ``docs`` that break no rule, as they were."""
    return judged(docs, rules, base, lang).where("kept").select(f"{_DOC}.*")


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns, and the rules broken."""
    return judged(docs).select(
        f"{_DOC}.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "n_lines", "n_stop_words", F.array_join("failed", ",").alias("failed"),
    )
