"""Quality rules: a table of thresholds compiled into one projection of text ratios.

Every rule names a metric and the range in which a document passes. The metrics
are column expressions over the whole text; no user functions run.

Nulls and empty texts have no words: all metrics are 0 and the base rule on the
number of words rejects them. Long texts are judged whole. Repeated rows are
judged one by one. Other columns pass through untouched, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from profseek.llm.rows import SPACE, packed, words_of

SYMBOLS = r"[^#*$%&|<>]+"

# Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the and of to in is that for it with as was on be at by this are from or an they which "
    "le la les de des du et en un une est que qui dans pour pas sur au avec par "
    "der die das und in den von zu mit sich ist im ein eine nicht auf für "
    "el los las del y que en un una es por con para se su como").split()


@dataclass(frozen=True)
class Rule:
    """A document passes where low <= metric <= high; a bound of None is open."""

    name: str
    metric: str
    low: float | None = None
    high: float | None = None


#: Base rules first; they are judged on whole numbers.
BASE_RULES = (
    Rule("enough_words", "n_words", low=50),
    Rule("few_repeated_words", "excess_repeat", high=0),
)
RULES = (
    Rule("mean_word_length", "mean_word_length", low=2.0, high=15.0),
    Rule("symbols_per_word", "symbol_ratio", high=0.3),
    Rule("capital_letters", "capital_ratio", high=0.5),
    Rule("stop_words", "n_stop_words", low=2),
    Rule("duplicate_lines", "dup_line_ratio", high=0.5),
)


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part.cast("double") / whole).otherwise(F.lit(0.0))


def passes(rules: tuple[Rule, ...]) -> Column:
    """One boolean expression of a threshold table over metric columns."""
    verdict = F.lit(True)
    for rule in rules:
        if rule.low is not None:
            verdict = verdict & (F.col(rule.metric) >= rule.low)
        if rule.high is not None:
            verdict = verdict & (F.col(rule.metric) <= rule.high)
    return verdict


def failed_rules(rules: tuple[Rule, ...]) -> Column:
    """Names of the rules that a document fails."""
    return F.array_compact(F.array(*[F.when(~passes((r,)), r.name) for r in rules]))


def text_metrics(df: DataFrame, text: str = "text") -> DataFrame:
    """`row` with the input's columns, and one column per metric."""
    stop = sorted(set(STOP_WORDS) | {w.capitalize() for w in STOP_WORDS})
    base = packed(df, text=text).withColumn("text", F.coalesce("text", F.lit("")))
    split = base.withColumn("words", words_of(F.col("text")))
    n = F.size("words")
    three = F.transform(
        F.sequence(F.lit(0), n - 3),
        lambda i: F.struct(F.concat_ws(" ", F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)).alias("k"),
                           i.alias("p")))
    windows = split.withColumn("windows", F.sort_array(F.when(n >= 3, three).otherwise(
        F.array().cast("array<struct<k:string,p:int>>"))))
    found = F.filter("windows", lambda w, i: (w["k"].eqNullSafe(F.get("windows", i - 1)["k"]))
                     | (w["k"].eqNullSafe(F.get("windows", i + 1)["k"])))
    at = windows.withColumn("at", F.transform(found, lambda w: w["p"])).drop("windows")
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counted = at.withColumn("lines", lines).select(
        "row", F.size("words").cast("long").alias("n_words"),
        F.length(F.regexp_replace("text", SPACE, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", SYMBOLS, "")).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.array_distinct(F.concat("at", F.transform("at", lambda p: p + 1), F.transform("at", lambda p: p + 2))))
        .cast("long").alias("n_repeat_words"),
        F.length(F.regexp_replace("text", r"[^A-Z]+", "")).cast("long").alias("n_capitals"),
        F.size(F.array_intersect("words", F.array(*[F.lit(w) for w in stop]))).cast("long").alias("n_stop_words"),
        F.spark_partition_id().alias("partition"))
    return counted.withColumns({
        "excess_repeat": F.greatest(F.lit(0).cast("long"), 100 * F.col("n_repeat_words") - 50 * F.col("n_words")),
        "mean_word_length": _ratio(F.col("word_chars"), F.col("n_words")),
        "symbol_ratio": _ratio(F.col("n_symbols"), F.col("n_words")),
        "capital_ratio": _ratio(F.col("n_capitals"), F.col("word_chars")),
        "dup_line_ratio": _ratio(F.col("n_dup_lines"), F.col("n_lines"))})


def judged(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES,
           base_rules: tuple[Rule, ...] = BASE_RULES) -> DataFrame:
    """text_metrics with base_failed, kept and the names of failed rules."""
    return text_metrics(df, text).withColumns({
        "base_failed": ~passes(base_rules), "kept": passes(base_rules) & passes(rules),
        "failed": failed_rules(base_rules + rules)})


def keep_good(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES,
              base_rules: tuple[Rule, ...] = BASE_RULES) -> DataFrame:
    """The documents that pass every rule, with the columns they came with."""
    # the partition number keeps the filter above the metrics; below, each use of a metric would compute it anew
    return judged(df, text, rules, base_rules).filter(F.col("kept") & (F.col("partition") >= 0)).select("row.*")
