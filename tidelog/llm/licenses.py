"""License scans by ordered signature rules, in built-in functions only.

A rule has a keyword, a pattern, a priority (lower comes first) and a weight;
signatures.py lists them.  Every match of a rule's pattern holds its keyword, so
a text is asked only for those patterns whose keyword it holds, and only texts
that match one are copied for it.  A detection is dropped if its interval lies
inside that of a detection of lower priority number, or of equal number that is
longer or, at equal length, of an earlier rule.
"""

from __future__ import annotations

from functools import lru_cache, reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LOWER, UPPER, count_runs, table
from .signatures import rules
from .spans import match_spans

#: Fixed values of the base phrases: (words, label).
PHRASES = [(("cc", "by"), "cc-by"), (("general", "public", "license"), "gpl"), (("all", "rights", "reserved"), "reserved")]
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: What stands between words while A-Z are not yet lower-cased.
BETWEEN = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

RULES = rules()
SCHEMA = "rule int, label string, pattern string, priority int, weight double, grp int"


def rule_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(n, label, "(?i)" + pattern, priority, weight, group) for n, label, _, _, pattern, priority, weight, group in RULES], SCHEMA)


def _any(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


def _places_of(tokens: Column, words: tuple, label: str) -> Column:
    last = F.size(tokens) - len(words)
    heads = F.filter(F.transform(tokens, lambda w, i: F.struct(i.alias("start"), w.alias("word"))), lambda h: h["word"] == words[0])

    def whole(h: Column) -> Column:
        rest = [F.get(tokens, h["start"] + k) == w for k, w in enumerate(words[1:], 1)]
        return reduce(lambda a, b: a & b, rest, h["start"] <= last)

    return F.transform(F.filter(heads, whole), lambda h: F.struct(h["start"].alias("start"), F.lit(label).alias("label")))


def base_places(low: Column, plain: Column) -> Column:
    """(start, label) of each place of a base phrase; low gates, plain is the text with A-Z lower-cased."""
    gates = [reduce(lambda a, b: a & b, [low.contains(w) for w in words]) & low.rlike(GAP.join(words)) for words, _ in PHRASES]
    # The one-element array names the tokens, so that they are made once for a text.
    tokens = F.array(F.regexp_extract_all(plain, F.lit(WORD), F.lit(0)))
    found = F.flatten(F.transform(tokens, lambda ts: F.concat(*[_places_of(ts, *p) for p in PHRASES])))
    return F.when(_any(gates), found).otherwise(F.array().cast("array<struct<start:int,label:string>>"))


def _literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


@lru_cache
def matching_rules(text: str, low: str) -> str:
    """An SQL expression for the numbers of the rules that a text matches; low is the text in lower case.

    Text, since six hundred patterns are one call this way.
    """
    by: dict[str, dict[str, list[str]]] = {}
    for number, _, stem, keyword, pattern, *_ in RULES:
        by.setdefault(stem, {}).setdefault(keyword, []).append(f"CASE WHEN {text} RLIKE {_literal('(?i)' + pattern)} THEN {number} END")

    def some(tests: dict[str, str]) -> str:
        each = (f"CASE WHEN contains({low}, {_literal(word)}) THEN {numbers} ELSE CAST(array() AS array<int>) END" for word, numbers in tests.items())
        return f"flatten(array({', '.join(each)}))"

    def tried(tests: list[str]) -> str:
        return f"array_compact(array({', '.join(tests)}))"

    return some({stem: tried(words[stem]) if list(words) == [stem] else some({word: tried(t) for word, t in words.items()}) for stem, words in by.items()})


def detections(docs: DataFrame, spark: SparkSession) -> DataFrame:
    """(doc_id, check, found): kept detections of each document that has any, by start."""
    # A lambda names the text and its lower case, so that they are made once and the branches stay out of one large method.
    numbers = F.expr(f"flatten(transform(array(struct(text, low)), t -> {matching_rules('t.text', 't.low')}))")
    # The outer form, since the other one is given a filter that makes the array once more.
    met = docs.select("doc_id", "check", "text", F.explode_outer(numbers).alias("rule")).where("rule is not null")
    # The rule table has a fixed number of rows.
    tried = met.join(F.broadcast(rule_table(spark)), "rule")
    each = tried.select("doc_id", "check", "rule", "label", "priority", "weight", "grp", F.explode_outer(match_spans(F.col("text"), F.col("pattern"), F.col("grp"))).alias("s")).where("s is not null")
    named = F.when((F.col("grp") == 1) & (F.col("s.value") != ""), F.concat("label", F.lit("-"), F.col("s.value"))).otherwise(F.col("label")).alias("label")
    spans = each.select("doc_id", "check", "rule", named, "priority", "weight", "s.start", "s.stop").repartition("doc_id", "check").dropDuplicates(["doc_id", "check", "rule", "start"])
    # Whatever suppresses a detection stands before it in this order, has no higher priority number and reaches its end.
    before = Window.partitionBy("doc_id", "check").orderBy("start", F.desc("stop"), "priority", "rule").rowsBetween(Window.unboundedPreceding, -1)
    levels = sorted({r[5] for r in RULES})
    reach = {p: F.max(F.when(F.col("priority") <= p, F.col("stop"))).over(before) for p in levels}
    told = spans.select("*", *[r.alias(f"reach{p}") for p, r in reach.items()])
    own = F.coalesce(*[F.when(F.col("priority") == p, F.col(f"reach{p}")) for p in levels], F.lit(-1))
    one = F.struct("start", "stop", "priority", "rule", "label", "weight")
    return told.where(own < F.col("stop")).groupBy("doc_id", "check").agg(F.array_sort(F.collect_list(one)).alias("found"))


def license_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document with words, base places, labels and score.

    The score is 1 minus the product of (1 - weight) over distinct kept labels,
    base labels counting 0.5 where no detection gives them.  Null texts are
    empty: no words, labels "", score 0.  Repeated rows come back repeated;
    other columns are not read; an empty table stays empty.
    """
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    read = given.withColumn("low", F.lower("text")).withColumn("check", F.xxhash64("text"))
    found = detections(read, docs.sparkSession)
    base = read.select("doc_id", "check", count_runs(F.col("text"), BETWEEN).alias("n_words"), base_places(F.col("low"), F.translate("text", UPPER, LOWER)).alias("places"))
    rows = base.withColumnRenamed("doc_id", "id").withColumnRenamed("check", "ck").join(found, [F.col("id").eqNullSafe(F.col("doc_id")), F.col("ck") == F.col("check")], "left")
    starts = F.transform("places", lambda p: p["start"])
    own = F.array_sort(F.array_distinct(F.transform("places", lambda p: p["label"])))
    seen = F.coalesce(F.transform("found", lambda d: d["label"]), F.array().cast("array<string>"))
    weights = F.coalesce(F.transform("found", lambda d: F.struct(d["label"].alias("label"), d["weight"].alias("weight"))), F.array().cast("array<struct<label:string,weight:double>>"))
    best = lambda name: F.coalesce(F.array_max(F.transform(F.filter(weights, lambda d: d["label"] == name), lambda d: d["weight"])), F.lit(0.5))
    every = F.array_sort(F.array_distinct(F.concat(own, seen)))
    return rows.select(
        F.col("id").alias("doc_id"),
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        F.array_join(own, ",").alias("base_labels"),
        F.array_join(every, ",").alias("labels"),
        F.round(F.lit(1.0) - F.aggregate(every, F.lit(1.0), lambda acc, name: acc * (F.lit(1.0) - best(name))), 6).alias("score"),
    )


def op1_license_scan(spark, sf_dir: str) -> DataFrame:
    return license_report(table(spark, sf_dir, "documents"))
