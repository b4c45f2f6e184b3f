"""Personal data by bootstrapped contextual extraction, in DataFrame operations.

1. Seeds: matches of four kinds that pass their checks (addresses, card numbers
   with a valid check digit, phone numbers), and long hexadecimal keys.
2. Mentions: the seeds and everything that looks like an identifier, each with
   the words before it as its lexical pattern, digits blurred.
3. Rounds over the graph of patterns and instances: a pattern's confidence is the
   part of its distinct instances that are known; patterns with enough distinct
   support and confidence vouch for unknown instances, and instances vouched for
   strongly enough become known for the next round, until a round finds none.
   Numbers that a check refuted stay negative for good.
4. Identifiers that became known and that some trusted pattern holds are added
   to the seeds' spans, wherever they are mentioned; long hexadecimal keys are
   added in any context.

Seed patterns are matched from the left without overlap per kind, in time linear
in the text. Statistics cover all documents. Groups are reduced to distinct
(pattern, instance) pairs before they are counted, so copies neither count twice
nor burden one task.

Null texts are empty and have no spans. Repeated rows are judged each. Offsets are code
points, end exclusive. Empty tables give empty results, other columns pass
through `redacted` whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from profseek.functions.shared import broadcast_if_small
from profseek.llm.components import stored

KINDS = ("email", "ip", "card", "phone", "key")
_LOCAL = "A-Za-z0-9._%+-"
#: Seed patterns in a form without backtracking: a match can only begin where a run begins or the last match ended.
_SEEDS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?:\G|(?<![0-9]))[0-9](?:[\x20-]?[0-9]){13,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_HINT = {"email": "@", "ip": ".", "card": None, "phone": "+"}
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
_IP = rf"^{_PART}\.{_PART}\.{_PART}\.{_PART}$"
#: Identifiers: runs of at least eight letters, digits and joiners with a digit among them.
_IDENTIFIER = r"(?:\G|(?<![A-Za-z0-9_-]))(?=[A-Za-z_-]*+[0-9])[A-Za-z0-9_-]{8,}+"
_KEY = r"^(?=.*[0-9])(?=.*[a-f])[0-9a-f]{32,}$"
_REFUTED = r"^[0-9]{14,19}$"
#: The last two words before a mention and what stands right before it.
_BEFORE = r"(?:\S+\s+\S+\s+\S*|\S+\s+\S*|\S*)$"
CONTEXT = 48
_SPAN = "array<struct<start:int,kind:int,end:int,value:string>>"


@dataclass(frozen=True)
class Bootstrap:
    support: int = 3
    confidence: float = 0.8
    vouched: float = 0.8


def _matches(text: Column, pattern: str, kind: int) -> Column:
    """Spans of all matches; places come from the stretches between them."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern)
    empty = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("out"))

    def add(acc: Column, pair: Column) -> Column:
        start = acc["at"] + F.length(pair["before"])
        end = start + F.length(pair["value"])
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), pair["value"].alias("value"))
        return F.struct(end.alias("at"), F.array_append(acc["out"], span).cast(_SPAN).alias("out"))

    pairs = F.zip_with(found, between, lambda v, b: F.struct(v.alias("value"), b.alias("before")))
    return F.aggregate(F.filter(pairs, lambda p: p["value"].isNotNull()), empty, add, lambda a: a["out"])


def _valid(span: Column, kind: str) -> Column:
    digits = F.regexp_replace(span["value"], "[^0-9]", "")
    if kind == "ip":
        return span["value"].rlike(_IP)
    if kind == "card":
        return F.length(digits).between(14, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)


def _spans(text: Column, kind: str, hint: Column) -> Column:
    found = _matches(text, _SEEDS[kind], KINDS.index(kind))
    return F.when(hint, F.filter(found, lambda s: _valid(s, kind))).otherwise(F.array().cast(_SPAN))


def mentions(df: DataFrame, text: str = "text", **carried: str) -> DataFrame:
    """`seeds` (spans of the four kinds) and `others` (identifiers beside them) with patterns, and carried columns."""
    base = df.select(F.coalesce(F.col(text), F.lit("")).alias("text"), *[F.col(c).alias(k) for k, c in carried.items()])
    digit = F.col("text").rlike("[0-9]")
    seeds = {}
    for kind in _SEEDS:
        hint = F.contains(F.col("text"), F.lit(_HINT[kind])) if _HINT[kind] else F.lit(True)
        seeds[kind] = _spans(F.col("text"), kind, hint & (digit if kind != "email" else F.lit(True)))
    found = base.select("*", F.sort_array(F.concat(*seeds.values())).alias("seeds"),
                        F.when(digit, _matches(F.col("text"), _IDENTIFIER, KINDS.index("key")))
                        .otherwise(F.array().cast(_SPAN)).alias("found"))
    apart = F.filter("found", lambda s: ~F.exists("seeds", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    kept = found.withColumn("others", apart)

    def with_pattern(s: Column) -> Column:
        start = F.greatest(s["start"] - CONTEXT, F.lit(0))
        before = F.substring("text", start + 1, s["start"] - start)
        pattern = F.regexp_replace(F.lower(F.regexp_extract(before, _BEFORE, 0)), "[0-9]", "0")
        return F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"),
                        s["value"].alias("value"), F.regexp_replace(pattern, r"\s+", " ").alias("pattern"))

    return kept.select(*carried, F.transform("seeds", with_pattern).alias("seeds"),
                       F.transform("others", with_pattern).alias("others"))


def known_instances(found: DataFrame, rule: Bootstrap = Bootstrap()) -> DataFrame:
    """(value, kind) of identifiers that the patterns of known ones vouch for; `found` as `mentions` gives it."""
    every = found.select(F.explode(F.concat("seeds", "others")).alias("m")).select("m.value", "m.kind", "m.pattern")
    every = stored(every.distinct(), "edges")
    edges = every.filter(F.length("pattern") > 0)
    other = F.col("kind") == KINDS.index("key")
    known = stored(edges.filter(~other | F.col("value").rlike(_KEY)).groupBy("value").agg(F.min("kind").alias("kind")),
                   "known")
    while True:  # every round but the last makes more instances known
        told = edges.select("pattern", "value").distinct().join(broadcast_if_small(known), "value", "left")
        scored = told.groupBy("pattern").agg(
            F.count(F.lit(1)).alias("all"), F.count("kind").alias("sure"), F.mode("kind", True).alias("kind"))
        trusted = stored(scored.filter((F.col("sure") >= rule.support)
                                       & (F.col("sure") >= rule.confidence * F.col("all"))).select(
            "pattern", "kind", (F.col("sure") / F.col("all")).alias("confidence")), "trusted")
        open_ = edges.filter(other & ~F.col("value").rlike(_REFUTED)).select("pattern", "value").join(
            broadcast_if_small(known.select("value")), "value", "left_anti")
        doubt = F.sum(F.log1p(-F.least(F.col("confidence"), F.lit(0.999))))
        fresh = open_.join(broadcast_if_small(trusted), "pattern").groupBy("value").agg(
            (1 - F.exp(doubt)).alias("score"), F.min("kind").alias("kind")).filter(F.col("score") >= rule.vouched)
        fresh = stored(fresh.select("value", "kind"), "fresh")
        if fresh.isEmpty():
            break
        known = stored(known.unionByName(fresh), "known")
    # the other seeds are spans already; found identifiers count where a trusted pattern holds them
    own = every.filter(other & F.col("value").rlike(_KEY)).select("value", "kind")
    keys = edges.filter(other).select("pattern", "value", "kind").join(broadcast_if_small(known.select("value")), "value",
                                                                     "left_semi")
    return keys.join(broadcast_if_small(trusted.select("pattern")), "pattern", "left_semi").select(
        "value", "kind").unionByName(own).distinct()


def found_spans(df: DataFrame, text: str = "text", rule: Bootstrap = Bootstrap(), **carried: str) -> DataFrame:
    """Carried columns, `seeds` and `spans`: all (start, kind, end) of a document, seeds and discovered ones, in order."""
    found = stored(mentions(df, text, **carried).withColumn("key", F.monotonically_increasing_id()), "mentions")
    known = stored(known_instances(found, rule).select("value"), "instances")
    marked = found.select("key", F.explode("others").alias("m")).join(
        broadcast_if_small(known), F.col("m.value") == F.col("value"), "left_semi")
    extra = marked.groupBy("key").agg(F.collect_list("m").alias("more"))
    none = F.array().cast(found.schema["others"].dataType)
    bare = lambda c: F.transform(c, lambda s: F.struct(
        s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    return found.join(extra, "key", "left").select(
        *carried, bare(F.col("seeds")).alias("seeds"),
        F.sort_array(bare(F.concat("seeds", F.coalesce("more", none)))).alias("spans"))


def written(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"),
                                                                 s["end"].cast("string"))), ",")


def redacted(df: DataFrame, text: str = "text", rule: Bootstrap = Bootstrap()) -> DataFrame:
    """The input with every span replaced by its kind in brackets; same columns, same rows."""
    whole = df.select(F.struct(*[df[c] for c in df.columns]).alias("row"), df[text].alias("text"))
    found = found_spans(whole, "text", rule, row="row")
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    value = F.col("row")[text]
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def cover(acc: Column, s: Column) -> Column:
        start = F.greatest(s["start"], acc["at"])
        name = F.when(s["start"] >= acc["at"], F.get(names, s["kind"])).otherwise("")
        return F.struct(F.greatest(s["end"], acc["at"]).alias("at"),
                        F.concat(acc["out"], F.substring(value, acc["at"] + 1, start - acc["at"]), name).alias("out"))

    done = F.aggregate("spans", begin, cover, lambda a: F.concat(
        a["out"], F.substring(value, a["at"] + 1, F.length(value))))
    new = F.when(F.size("spans") > 0, done).otherwise(value)
    return found.withColumn("new", new).select(
        *[F.col("new").alias(c) if c == text else F.col("row")[c].alias(c) for c in df.columns])
