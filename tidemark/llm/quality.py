"""Quality rules with adaptive thresholds from mergeable quantile sketches (native DataFrame code).

Each rule metric is a whole number; its sketch is a log-linear histogram: a value keeps its upper
eight bits, so a bucket is at most 1/128 wide of its value, and sketches merge by adding counts.
Sketches are built per (lang, source), merged to lang and to the whole table, and give quantiles.
A metric's limit is median + reach * (tail quantile - median), and for word length also the like below;
no number in it but the reach and the share of the tail is fixed, so limits follow the data. A group of
fewer than min_docs documents uses its language's quantiles, a small language the whole table's; so does
a group whose own quantiles have no spread (say, mostly copies), for the spread. Values are compared by
bucket. A single symbol or repeated line never counts: metrics are of counts less one.

Defined cases: null or empty text has no words, fails the base rule and is not kept; null lang and
null source are groups of their own; repeated rows count each; an empty table gives no rows; extra
columns are carried by `keep_good` and ignored by `judge`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import small, stage, table, text_of, words_of

WINDOW = 5
#: name: (per cent of a group that its quantile holds, lower side counts too). Lengths in thousandths of a
#: character, shares of words or lines in ten-thousandths.
METRICS = {"word_length": (90, True), "symbols": (90, False), "dup_lines": (98, False), "repeats": (98, False)}
MIN_DOCS, REACH = 100, 3


def features(docs: DataFrame, carry: list[str]) -> DataFrame:
    """carry columns plus n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, one pass over the text."""
    text = text_of()
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.trim(x, F.lit(" \t\x0b\f\r"))) > 0)
    df = docs.select(*[F.col(f"`{c}`") for c in carry], words_of(text).alias("__w"), F.length(F.regexp_replace(text, "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"), lines.alias("__lines"))
    df = df.select(
        *[F.col(f"`{c}`") for c in carry], "__w", "n_symbols",
        F.size("__w").cast("long").alias("n_words"),
        F.length(F.array_join("__w", "")).cast("long").alias("word_chars"),
        F.size("__lines").cast("long").alias("n_lines"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("__w") < WINDOW, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), F.size("__w") - WINDOW), lambda i: F.xxhash64(*[F.get("__w", i + k) for k in range(WINDOW)]))).alias("__h"),
    ).drop("__w")
    by_hash = F.array_sort(F.transform("__h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn("__s", F.when(F.size(F.array_distinct("__h")) < F.size("__h"), by_hash)).drop("__h")
    twice = F.filter("__s", lambda e, k: (F.get("__s", k - 1)["h"] == e["h"]) | (F.get("__s", k + 1)["h"] == e["h"]))
    df = df.withColumn("__p", F.array_sort(F.transform(twice, lambda e: e["i"]))).drop("__s")
    covered = F.aggregate(F.sequence(F.lit(1), F.size("__p") - 1), F.lit(WINDOW), lambda n, k: n + F.least(F.lit(WINDOW), F.get("__p", k) - F.get("__p", k - 1)))
    covered = F.when(F.col("__p").isNull() | (F.size("__p") == 0), 0).when(F.size("__p") == 1, WINDOW).otherwise(covered)
    return df.select(*[F.col(f"`{c}`") for c in carry], "n_words", "word_chars", "n_symbols", "n_dup_lines", covered.cast("long").alias("n_repeat_words"), "n_lines")


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def metrics() -> list[Column]:
    """Values by metric; a document without words has none that matter."""
    share = lambda c, of: F.floor(10_000 * F.greatest(F.col(c) - 1, F.lit(0)) / F.greatest(F.col(of), F.lit(1))).cast("long")
    length = F.floor(1000 * F.col("word_chars") / F.greatest(F.col("n_words"), F.lit(1))).cast("long")
    return [length, share("n_symbols", "n_words"), share("n_dup_lines", "n_lines"), share("n_repeat_words", "n_words")]


def rounded(v: Column) -> Column:
    """Lower edge of the bucket of a whole number: all but its upper eight bits are cleared."""
    bits = F.greatest(F.lit(0), F.length(F.bin(v)) - 8)
    return F.call_function("shiftleft", F.call_function("shiftright", v, bits), bits)


def sketches(features_: DataFrame) -> DataFrame:
    """Rows (lang, source, metric, bucket, n): merge them by summing n."""
    each = features_.filter("n_words > 0").select("lang", "source", F.posexplode(F.array(*metrics())).alias("metric", "v"))
    return each.groupBy("lang", "source", "metric", rounded(F.col("v")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def quantiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """keys, metric, docs, low, mid, high of sketches merged over everything but keys: the median and both tails."""
    merged = sketch.groupBy(*keys, "metric", "bucket").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*keys, "metric")
    ranked = merged.withColumn("docs", F.sum("n").over(group)).withColumn("upto", F.sum("n").over(group.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)))
    tail = F.element_at(F.array(*[F.lit(p) for p, _ in METRICS.values()]), F.col("metric") + 1)
    at = lambda p: F.min(F.when(100 * F.col("upto") >= p * F.col("docs"), F.col("bucket")))
    return ranked.groupBy(*keys, "metric").agg(F.first("docs").alias("docs"), at(100 - tail).alias("low"), at(F.lit(50)).alias("mid"), at(tail).alias("high"))


def thresholds(sketch: DataFrame, min_docs: int = MIN_DOCS, reach: int = REACH) -> DataFrame:
    """One row per (lang, source): t_lang, t_source and a [low, high] pair per metric.

    Group, language and table quantiles are joined by group, never by document."""
    named = lambda df, p, *keys: df.select(*[F.col(k).alias(f"{p}_{k}") for k in (*keys, "docs", "low", "mid", "high")])
    lang, whole = named(quantiles(sketch, ["lang"]), "l", "lang", "metric"), named(quantiles(sketch, []), "a", "metric")
    df = quantiles(sketch, ["lang", "source"]).join(lang, F.col("lang").eqNullSafe(F.col("l_lang")) & (F.col("metric") == F.col("l_metric"))).join(whole, F.col("metric") == F.col("a_metric"))
    enough, lang_enough = F.col("docs") >= min_docs, F.col("l_docs") >= min_docs
    mid = F.when(enough, F.col("mid")).when(lang_enough, F.col("l_mid")).otherwise(F.col("a_mid"))

    def spread(side: str) -> Column:
        one = lambda p: F.abs(F.col(f"{p}{side}") - F.col(f"{p}mid"))
        return F.when(enough & (one("") > 0), one("")).when(lang_enough & (one("l_") > 0), one("l_")).otherwise(one("a_"))

    df = df.select("lang", "source", "metric", (mid - reach * spread("low")).alias("low"), (mid + reach * spread("high")).alias("high"))
    one = lambda i: F.max(F.when(F.col("metric") == i, F.struct("low", "high")))
    return df.groupBy(F.col("lang").alias("t_lang"), F.col("source").alias("t_source")).agg(*[one(i).alias(f"t_{name}") for i, name in enumerate(METRICS)])


def with_verdict(features_: DataFrame, limits: DataFrame, groups: int) -> DataFrame:
    """Adds base_failed and kept. limits are broadcast only while their counted rows are few."""
    joined = features_.join(small(limits, groups), F.col("lang").eqNullSafe(F.col("t_lang")) & F.col("source").eqNullSafe(F.col("t_source")), "left")
    inside = F.lit(True)
    for (name, (_, lower)), v in zip(METRICS.items(), metrics(), strict=True):
        inside &= (rounded(v) <= F.col(f"t_{name}")["high"]) & ((rounded(v) >= F.col(f"t_{name}")["low"]) if lower else F.lit(True))
    failed = base_failed()
    return joined.withColumn("base_failed", failed).withColumn("kept", ~failed & F.coalesce(inside, F.lit(False))).drop("t_lang", "t_source", *[f"t_{m}" for m in METRICS])


def limits_of(features_: DataFrame, min_docs: int = MIN_DOCS, reach: int = REACH) -> tuple[DataFrame, int]:
    limits = stage(thresholds(stage(sketches(features_), "sketches"), min_docs, reach), "limits")
    return limits, limits.count()


def judge(docs: DataFrame, min_docs: int = MIN_DOCS, reach: int = REACH) -> DataFrame:
    """One row per document: doc_id, n_words, the base counts, base_failed, kept. Texts are never shuffled."""
    found = stage(features(docs, ["doc_id", "lang", "source"]), "features")
    return with_verdict(found, *limits_of(found, min_docs, reach)).drop("lang", "source", "n_lines")


def keep_good(docs: DataFrame, min_docs: int = MIN_DOCS, reach: int = REACH) -> DataFrame:
    """The documents kept, with their own columns. Rows are staged beside their counts, so texts are
    counted once; they are never shuffled while the groups' limits are few enough to be broadcast."""
    row = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("__row"), "text", "lang", "source")
    found = stage(features(row, ["__row", "lang", "source"]), "features")
    limits, groups = limits_of(found.drop("__row"), min_docs, reach)
    return with_verdict(found, limits, groups).filter("kept").select("__row.*")


def query(spark, sf_dir):
    """op4: every document with its counts and verdict."""
    return judge(table(spark, sf_dir, "documents"))
