"""Document fingerprints: a Merkle tree over sections, paragraphs and runs of words (native DataFrame code).

A text is cut after blank lines into sections, after line breaks into paragraphs, and these into runs
of up to eight words with the white space around them, so the pieces in order are the text. Runs are
hashed (SHA-256), a paragraph is the hash of its runs' hashes, a section of its paragraphs', the root
of its sections'. The fingerprint is the root: equal texts, equal roots. Where roots differ, the first
differing branch locates the edit; likeness is the Dice share of distinct run hashes in common. To compare
two trees, their hashes are shortened to 64 bits, so that a tree can travel beside its text.

Defined cases: null is the empty text, which has one section of one paragraph without runs; two empty
texts are alike (1.0), an empty and another are not (0.0); documents follow each other by doc_id, null
first, then by a hash of the text, and the first follows the last, so a lone document follows itself;
repeated rows follow each other (those that agree in id and text meet in one window); an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import table, text_of

SECTION, PARAGRAPH, RUN = r"(?<=\n\n)(?!\n)", r"(?<=\n)", r"\s*(?:\S++\s*+){1,8}|\s+"
#: Quantiles of the ids that cut the order into segments, about how many rows a bucket has, and buckets in a stretch.
SEGMENTS, BUCKET, STRETCH = 256, 64, 12
#: Buckets of a segment at most.
SPAN = 1 << 40


def digest(parts: Column) -> Column:
    return F.sha2(F.array_join(parts, ""), 256)


def with_tree(df: DataFrame, text: str, name: str) -> DataFrame:
    """Adds name: struct of root, sections, paragraphs, runs (hex digests in order) for a text column."""
    paragraphs = lambda s: F.transform(F.split(s, PARAGRAPH), lambda p: F.transform(F.regexp_extract_all(p, F.lit(RUN), 0), lambda r: F.sha2(r, 256)))
    df = df.withColumn("__runs", F.transform(F.split(text, SECTION), paragraphs))
    df = df.withColumn("__pars", F.transform("__runs", lambda s: F.transform(s, digest)))
    df = df.withColumn("__secs", F.transform("__pars", digest))
    tree = F.struct(digest(F.col("__secs")).alias("root"), F.col("__secs").alias("sections"), F.flatten("__pars").alias("paragraphs"), F.array_distinct(F.flatten(F.flatten("__runs"))).alias("runs"))
    return df.withColumn(name, tree).drop("__runs", "__pars", "__secs")


def short(df: DataFrame, text: str, name: str) -> DataFrame:
    """Adds name: struct of root, and of paragraphs and distinct runs as 64-bit hashes of their digests."""
    cut = lambda parts: F.transform(F.col(f"__tree.{parts}"), lambda h: F.xxhash64(h))
    tree = F.struct(F.col("__tree.root").alias("root"), cut("paragraphs").alias("paragraphs"), cut("runs").alias("runs"))
    return with_tree(df, text, "__tree").withColumn(name, tree).drop("__tree")


def likeness(a: str, b: str) -> Column:
    """2 |A & B| / (|A| + |B|) of the distinct runs of two trees."""
    both = F.size(F.col(f"{a}.runs")) + F.size(F.col(f"{b}.runs"))
    return F.when(F.col(f"{a}.root") == F.col(f"{b}.root"), 1.0).otherwise(2.0 * F.size(F.array_intersect(f"{a}.runs", f"{b}.runs")) / F.greatest(both, F.lit(1)))


def first_change(a: str, b: str) -> Column:
    """1-based place of the first paragraph in which two trees differ, 0 if none."""
    return F.array_position(F.zip_with(f"{a}.paragraphs", f"{b}.paragraphs", lambda x, y: ~x.eqNullSafe(y)), True)


def bucket(rows: DataFrame) -> tuple[Column, Column]:
    """(__at, b): the segment of an id, and, where that is a column, a whole number that rises with (doc_id nulls first, th), equal for about BUCKET rows in a row.

    Quantiles of the ids cut them into segments of like numbers of rows, however ids lie; a segment is cut
    evenly by id. An id that fills a segment alone, and the null, are segments cut evenly by th."""
    s = rows.agg(F.count(F.lit(1)).alias("n"), F.count("doc_id").alias("known"), F.percentile_approx("doc_id", [i / SEGMENTS for i in range(SEGMENTS + 1)], 10_000).alias("q")).first()
    q = s.q or [0]
    edges = sorted(set(q))
    per = max(1.0, s.known / SEGMENTS / BUCKET)  # buckets of a segment
    widths = [max(1.0, (b - a) / per) for a, b in zip(edges, edges[1:] + edges[-1:], strict=True)]
    hot = [max(1.0, per * (q.count(e) - 1)) if q.count(e) > 1 else 0.0 for e in edges]
    of = lambda values: F.get(F.array(*map(F.lit, values)), F.col("__at"))
    x, coarse = F.col("doc_id"), edges[::16]
    block = F.size(F.filter(F.array(*map(F.lit, coarse)), lambda e: e <= x))
    at = F.when(x.isNull(), F.lit(0)).otherwise(F.greatest(F.lit(0), 16 * (block - 1) - 1 + F.size(F.filter(F.slice(F.array(*map(F.lit, edges)), F.greatest(F.lit(1), 16 * (block - 1) + 1), F.lit(16)), lambda e: e <= x))))
    by_hash = lambda parts: F.floor((F.col("th").cast("double") + 2.0**63) / (2.0**64 / parts))
    by_id = F.floor(F.greatest(F.lit(0.0), (x.cast("double") - of(edges).cast("double")) / of(widths)))
    alone = (of(hot) > 0) & (x == of(edges))
    segment = F.when(x.isNull(), 0).when(alone, 1 + 2 * F.col("__at")).otherwise(2 + 2 * F.col("__at"))
    inside = F.when(x.isNull(), by_hash(F.lit(max(1.0, (s.n - s.known) / BUCKET)))).when(alone, by_hash(of(hot))).otherwise(by_id)
    return at, segment.cast("long") * SPAN + F.least(inside, F.lit(SPAN - 1)).cast("long")


def followed(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, text, tree, next_text, next_tree): every document with what follows it in the order.

    A window holds the rows of a bucket, and texts are shuffled once. The last of a bucket meets the first of
    the next one that is not empty: a join of one row a bucket. Only the list of stretches, one row for some
    hundred thousand rows, is ordered in one task."""
    rows = docs.select("doc_id", text_of().alias("text")).withColumn("th", F.xxhash64("text"))
    at, b = bucket(docs)
    rows = rows.withColumn("__at", at).withColumn("b", b).drop("__at")
    order = Window.partitionBy("b").orderBy(F.col("doc_id").asc_nulls_first(), "th")
    # one column of text and tree, so that both lie in the shuffle once; a first row is told by the lag, as a filter on
    # its number would cut the rows before another shuffle of them
    whole = short(rows, "text", "tree").select("doc_id", "th", "b", F.struct("text", "tree").alias("one"))
    laid = whole.withColumns({"next": F.lead("one").over(order), "before": F.lag("th").over(order)})
    buckets = rows.select("b").distinct().withColumn("stretch", F.shiftright("b", STRETCH))
    starts = Window.orderBy("stretch")
    stretches = buckets.groupBy("stretch").agg(F.min("b").alias("start")).select(F.col("stretch").alias("s"), F.coalesce(F.lead("start").over(starts), F.first("start").over(starts)).alias("after"))
    chain = buckets.withColumn("within", F.lead("b").over(Window.partitionBy("stretch").orderBy("b"))).join(stretches, F.col("stretch") == F.col("s"))
    chain = chain.select(F.col("b").alias("c_b"), F.coalesce("within", "after").alias("c_next"))
    heads = laid.filter("before IS NULL").select(F.col("b").alias("h_b"), F.col("one").alias("head"))
    last = laid.filter("next IS NULL").drop("next").join(chain, F.col("b") == F.col("c_b")).join(heads, F.col("c_next") == F.col("h_b"))
    found = laid.filter("next IS NOT NULL").select("doc_id", "one", "next").unionByName(last.select("doc_id", "one", F.col("head").alias("next")))
    return found.select("doc_id", "one.text", "one.tree", F.col("next.text").alias("next_text"), F.col("next.tree").alias("next_tree"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id and tree, the struct of with_tree."""
    return with_tree(docs.select("doc_id", text_of().alias("__text")), "__text", "tree").select("doc_id", "tree")


def query(spark, sf_dir):
    """op1: every document and its edited text: fingerprints, likeness, and the first paragraph that changed."""
    pairs = followed(table(spark, sf_dir, "documents"))
    n = F.length("text")
    k = F.floor(n / 2).cast("int")
    pairs = pairs.withColumns({"n_chars": n.cast("long"), "edited": F.concat(F.substring("text", F.lit(1), n - k), F.substring("next_text", F.lit(1), k))})
    pairs = short(pairs.withColumnRenamed("tree", "t").withColumnRenamed("next_tree", "x"), "edited", "e")
    return pairs.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), F.col("t.root").alias("fingerprint"), F.col("e.root").alias("edited_fingerprint"),
        likeness("t", "e").alias("near_edited"), likeness("t", "x").alias("near_next"), first_change("t", "e").alias("first_change"), F.size("t.paragraphs").cast("long").alias("n_paragraphs"),
    )
