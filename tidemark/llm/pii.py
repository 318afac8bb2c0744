"""Personal data: rule spans, and contextual extraction bootstrapped from them (native DataFrame code).

Rules find e-mail addresses, IP addresses, card and phone numbers. Their matches, and strings of the
shape of access keys (kind `secret`), are the seed entities. The words on both sides of a seed, or a key
and its `=` or `:`, induce lexical patterns; words that hold digits or an @ count by their shape. Patterns and
the identifier-like tokens they stand beside form a bipartite graph over the whole corpus, which is scored in
rounds: a pattern's confidence for a kind is the score of its distinct instances of the kind, over that of all
of them, where those of no kind yet count little; an unseen instance takes the best confidence of its patterns. A pattern is accepted if it has enough support and confidence, and if
it leaves at most half the doubt that the kind's share of all instances leaves, so that common words, which
stand beside everything, are no patterns. Accepted patterns discover identifiers that no rule knows. Rule
spans always stay; a discovery that overlaps one is dropped. A discovery is the run of identifier
characters at the token's start, without quotes, brackets and marks around it.

Offsets are code points, end exclusive; they are prefix sums over chunks of a text's matches, so that a text
of very many identifiers is not walked once for each of them. Patterns are linear: possessive where backtracking could not
match more, and anchored to the start of a run of characters, so long texts cost their length.

Defined cases: null text is empty; rows that agree in doc_id and text share their spans; a null doc_id
is kept as it is; without seeds there are no patterns; an empty table gives no rows; `find` ignores
extra columns, `mask` keeps them (and sets n_chars, where there is one, to the new length).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import WS_RE, small, stage, table, text_of

# The rules of the four kinds, in order.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[ -]?[0-9])++"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone", "secret")
#: What a text must hold for a rule to be tried.
HINTS = ("@", r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", r"[0-9](?:[ -]?[0-9]){13}", r"\+[0-9]")
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
#: Shapes of access keys that seed the kind `secret`.
SECRET = r"^(?:AKIA[0-9A-Z]{16}|(?=[0-9]*[a-f])(?=[a-f]*[0-9])[0-9a-f]{16,128})$"
#: A token with a digit or @, between white space.
TOKEN = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"
#: What stands before an identifier inside its token: a key and its sign, quotes, brackets; and the identifier itself.
OPEN = r"^(?:[A-Za-z_][A-Za-z0-9_.-]{0,40}[=:])?[^A-Za-z0-9+]{0,8}"
CORE = r"^\+?[A-Za-z0-9](?:[A-Za-z0-9@._%+:/-]*[A-Za-z0-9])?"
SUPPORT, CONFIDENCE, LIFT, ROUNDS, CONTEXT = 5, 0.8, 2.0, 3, 80
#: What an instance of no known kind counts against a pattern, as it may be one of the pattern's.
UNSURE = 0.1
#: Matches of a text that prefix sums take together.
CHUNK = 128


def let(value: Column, body) -> Column:
    """body of a value that is worked out once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, op) -> Column:
    """For every place the fold, from 0, of the values before it. Chunks are folded on their own and their results
    then folded, so the work is the number of values times CHUNK and the square of the number of chunks."""
    fold = lambda xs: F.aggregate(xs, F.lit(0), op)
    inside = lambda xs, base: F.transform(xs, lambda x, j: op(base, fold(F.slice(xs, F.lit(1), j))))
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / CHUNK).cast("int")), lambda c: F.slice(values, c * CHUNK + 1, F.lit(CHUNK)))

    def whole(chunks_: Column) -> Column:
        bases = lambda sums: F.transform(sums, lambda x, k: fold(F.slice(sums, F.lit(1), k)))
        return F.flatten(F.zip_with(chunks_, let(F.transform(chunks_, fold), bases), inside))

    return F.when(F.size(values) == 0, F.array().cast("array<int>")).otherwise(let(chunks, whole))


def located(text: Column, pattern: str, hint: Column) -> Column:
    """Array of (start, end, hit, before, after) of a pattern's leftmost non-overlapping matches.

    Java's split and its search walk the same matches, so lengths of pieces and hits add up to offsets."""
    kind = "array<struct<start:int,end:int,hit:string,before:string,after:string>>"

    def walk(x: Column) -> Column:
        last = F.size(x["p"]) - 1
        zipped = F.arrays_zip(F.slice(x["p"], F.lit(1), last).alias("p"), x["h"].alias("h"), F.slice(x["p"], F.lit(2), last).alias("a"), running(F.zip_with(F.slice(x["p"], F.lit(1), last), x["h"], lambda p, h: F.length(p) + F.length(h)), lambda n, k: n + k).alias("at"))
        return F.transform(zipped, one)

    def one(m: Column) -> Column:
        p, h, a, at = (m.getField(k) for k in ("p", "h", "a", "at"))
        start = at + F.length(p)
        return F.struct(start.alias("start"), (start + F.length(h)).alias("end"), h.alias("hit"), F.right(p, F.lit(CONTEXT)).alias("before"), F.left(a, F.lit(CONTEXT)).alias("after"))

    found = let(F.struct(F.split(text, pattern, -1).alias("p"), F.regexp_extract_all(text, F.lit(pattern), 0).alias("h")), walk)
    return F.when(hint, found.cast(kind)).otherwise(F.array().cast(kind))


def valid(kind: int, hit: Column) -> Column:
    digits = F.regexp_replace(hit, "[^0-9]+", "")
    if kind == 1:
        return hit.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    if kind == 2:
        digit = lambda i: F.substring(digits, i, F.lit(1)).cast("int")
        double = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        luhn = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda n, i: n + F.when((F.length(digits) - i) % 2 == 1, double(digit(i))).otherwise(digit(i)))
        return F.when(F.length(digits).between(14, 19), luhn % 10 == 0).otherwise(False)
    if kind == 3:
        return F.length(digits).between(10, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """All rule spans of a text, by start, then kind."""

    def of(kind: int, pattern: str, hint: str) -> Column:
        found = F.filter(located(text, pattern, text.rlike(hint) if kind else text.contains(hint)), lambda m: valid(kind, m["hit"]))
        return F.transform(found, lambda m: F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end")))

    return by_place(F.concat(*[of(*x) for x in zip(range(4), (EMAIL, IP, CARD, PHONE), HINTS, strict=True)]))


def by_place(spans: Column) -> Column:
    keyed = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    return F.transform(keyed, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def scan(docs: DataFrame) -> DataFrame:
    """One pass over the texts: (doc_id, th, base, tokens), tokens the identifier-like ones."""
    text = text_of()
    return docs.select("doc_id", F.xxhash64(text).alias("th"), base_spans(text).alias("base"), located(text, TOKEN, text.rlike("[0-9@]")).alias("tokens"))


def seen(scanned: DataFrame) -> DataFrame:
    """Rows (doc_id, th, start, end, hit, before, after, kind, overlaps): every token once, with the kind of a rule
    span that it overlaps. Tokens and spans of a text are laid in order and pass by each other once in both
    directions: a span that begins before a token's end overlaps it if it ends behind the token's start."""
    once = scanned.filter(F.size("tokens") > 0).select("doc_id", "th", "base", "tokens").dropDuplicates(["doc_id", "th"])
    token = F.transform("tokens", lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), t["hit"].alias("hit"), t["before"].alias("before"), t["after"].alias("after"), F.lit(None).cast("int").alias("span")))
    span = F.transform("base", lambda b: F.struct(b["start"].alias("start"), b["end"].alias("end"), *[F.lit(None).cast("string").alias(c) for c in ("hit", "before", "after")], b["kind"].alias("span")))
    each = once.select("doc_id", "th", F.explode(F.concat(token, span)).alias("t")).select("doc_id", "th", "t.*")
    of = Window.partitionBy("doc_id", "th")
    earlier = F.max(F.when(F.col("span").isNotNull(), F.struct(F.col("end").alias("at"), F.col("span").alias("kind")))).over(of.orderBy("start", F.col("span").isNull()).rowsBetween(Window.unboundedPreceding, 0))
    later = F.min(F.when(F.col("span").isNotNull(), F.struct(F.col("start").alias("at"), F.col("span").alias("kind")))).over(of.orderBy(F.col("start").desc(), F.col("span").isNull()).rowsBetween(Window.unboundedPreceding, 0))
    each = each.withColumn("earlier", earlier).withColumn("later", later).filter("span IS NULL")
    kind = F.when(F.col("earlier.at") > F.col("start"), F.col("earlier.kind")).when(F.col("later.at") < F.col("end"), F.col("later.kind"))
    return each.withColumn("kind", kind).withColumn("overlaps", kind.isNotNull()).drop("span", "earlier", "later")


def plain_word(word: Column) -> Column:
    """A context word; where it holds digits or an @, its shape, which is what others may share."""
    shape = F.regexp_replace(F.regexp_replace(word, "[0-9]+", "9"), "[a-z]+", "a")
    return F.when(word.rlike("[0-9@]"), shape).otherwise(word)


def candidates(scanned: DataFrame, known: Column | None = None) -> DataFrame:
    """Rows (doc_id, th, start, end, instance, kind, overlaps, patterns): tokens in context, with the kind of a seed.

    known, a condition on `instance`, tells which strings of the shape of keys are seeds; all where it is None."""
    each = seen(scanned).withColumn("lead", F.regexp_extract("hit", OPEN, 0))
    each = each.withColumn("instance", F.regexp_extract(F.substring(F.col("hit"), F.length("lead") + 1, F.length("hit")), CORE, 0)).filter("instance <> ''")
    each = each.withColumn("start", F.col("start") + F.length("lead")).withColumn("end", F.col("start") + F.length("instance"))
    seed = F.col("instance").rlike(SECRET) if known is None else F.col("instance").rlike(SECRET) & known
    each = each.withColumn("kind", F.coalesce("kind", F.when(seed, len(KINDS) - 1)))
    words = lambda side: F.filter(F.split(F.lower(F.trim(side, F.lit(" \t\n\x0b\f\r"))), WS_RE), lambda w: w != "")
    each = each.withColumn("left", words("before")).withColumn("right", words("after"))
    key = F.lower(F.regexp_extract("lead", "^[A-Za-z_][A-Za-z0-9_.-]*[=:]", 0))
    one, two, after = plain_word(F.try_element_at("left", F.lit(-1))), plain_word(F.try_element_at("left", F.lit(-2))), plain_word(F.try_element_at("right", F.lit(1)))
    sides = F.array(F.concat(F.lit("1 "), one), F.concat(F.lit("2 "), two, F.lit(" "), one), F.concat(F.lit("r "), after), F.concat(F.lit("b "), one, F.lit(" _ "), after))
    patterns = F.when(key != "", F.array(F.concat(F.lit("="), key))).otherwise(F.filter(sides, lambda p: p.isNotNull()))
    return each.select("doc_id", "th", "start", "end", "instance", "kind", "overlaps", patterns.alias("patterns"))


def learn(found: DataFrame, support: int = SUPPORT, confidence: float = CONFIDENCE, rounds: int = ROUNDS, lift: float = LIFT) -> DataFrame:
    """Rows (pattern, kind, confidence) of the patterns accepted after scoring the graph in rounds."""
    edges = stage(found.select(F.explode("patterns").alias("pattern"), "instance", "kind").groupBy("pattern", "instance").agg(F.max("kind").alias("kind")), "edges")
    sizes = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))
    instances = edges.groupBy("instance").agg(F.max("kind").alias("kind"))
    seeds = stage(instances.filter("kind IS NOT NULL").withColumn("score", F.lit(1.0)), "seeds")
    every = instances.count()
    rates = F.broadcast(seeds.groupBy(F.col("kind").alias("r_kind")).agg((F.count(F.lit(1)) / max(1, every)).alias("rate")))  # one row a kind
    scored, accepted = seeds, None
    for turn in range(rounds):
        votes = edges.select("pattern", "instance").join(scored, "instance").groupBy("pattern").agg(F.count(F.lit(1)).alias("met"), F.array(*[F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("score"))), F.lit(0.0)) for k in range(len(KINDS))]).alias("weights"))
        doubt = UNSURE * (F.col("n") - F.col("met")) + 1  # and one more, so that a pattern of few instances is not sure
        votes = votes.join(sizes, "pattern").withColumn("all", F.aggregate("weights", F.lit(0.0), lambda x, y: x + y) + doubt)
        judged = votes.select("pattern", "all", F.posexplode("weights").alias("kind", "weight")).join(rates, F.col("kind") == F.col("r_kind")).withColumn("confidence", F.col("weight") / F.col("all"))
        fit = (F.col("weight") >= support) & (F.col("confidence") >= confidence) & (lift * (1 - F.col("confidence")) <= 1 - F.col("rate"))
        accepted = stage(judged.filter(fit).select("pattern", "kind", "confidence"), f"patterns{turn}")
        if turn + 1 < rounds:
            new = edges.filter("kind IS NULL").select("pattern", "instance").join(small(accepted, accepted.count()), "pattern")
            new = new.groupBy("instance").agg(F.max_by("kind", F.struct("confidence", "kind")).alias("kind"), F.max("confidence").alias("score"))
            scored = stage(seeds.unionByName(new.join(seeds.select("instance"), "instance", "left_anti")), f"scores{turn}")
    return accepted


def discovered(found: DataFrame, patterns: DataFrame) -> DataFrame:
    """Rows (doc_id, th, more): secrets by shape, and unseen identifiers beside accepted patterns, as a set of spans."""
    free = found.filter(~F.col("overlaps"))
    shaped = free.filter("kind IS NOT NULL").select("doc_id", "th", "kind", "start", "end")
    met = free.filter("kind IS NULL").select("doc_id", "th", "start", "end", F.explode("patterns").alias("pattern")).join(small(patterns, patterns.count()), "pattern")
    met = met.groupBy("doc_id", "th", "start", "end").agg(F.max_by("kind", F.struct("confidence", "kind")).alias("kind"))
    return shaped.unionByName(met.select("doc_id", "th", "kind", "start", "end")).groupBy("doc_id", "th").agg(F.collect_set(F.struct("kind", "start", "end")).alias("more"))


def find(docs: DataFrame, support: int = SUPPORT, confidence: float = CONFIDENCE, rounds: int = ROUNDS, known: Column | None = None) -> DataFrame:
    """One row per document: doc_id, th (hash of the text), base and spans, arrays of (kind, start, end)."""
    scanned = stage(scan(docs), "scan")
    found = stage(candidates(scanned, known), "candidates")
    more = discovered(found, learn(found, support, confidence, rounds)).select(F.col("doc_id").alias("m_id"), F.col("th").alias("m_th"), "more")
    both = scanned.select("doc_id", "th", "base").join(more, F.col("doc_id").eqNullSafe(F.col("m_id")) & (F.col("th") == F.col("m_th")), "left")
    return both.select("doc_id", "th", "base", F.when(F.col("more").isNull(), F.col("base")).otherwise(by_place(F.concat("base", "more"))).alias("spans"))


def written(spans: str) -> Column:
    """Spans as kind:start:end, comma-joined."""
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def masked(text: Column, spans: str) -> Column:
    """text with every span replaced by its kind in angle brackets; of spans that overlap, the part behind
    the earlier ones, and one that lies in them whole goes with them."""
    tag = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])

    def write(all_: Column) -> Column:
        until = running(F.transform(all_, lambda s: s["end"]), lambda a, b: F.greatest(a, b))
        fresh = F.filter(F.zip_with(all_, until, lambda s, u: F.struct(F.greatest(s["start"], u).alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), u.alias("until"))), lambda s: s["end"] > s["until"])
        keep = lambda s: F.substring(text, s["until"] + 1, s["start"] - s["until"])
        parts = F.transform(fresh, lambda s: F.concat(keep(s), F.get(tag, s["kind"])))
        return F.concat(F.array_join(parts, ""), F.substring(text, F.array_max(F.transform(all_, lambda s: s["end"])) + 1, F.length(text)))

    return F.when(F.size(spans) == 0, text).otherwise(let(F.col(spans), write))


def mask(docs: DataFrame, **params) -> DataFrame:
    """docs with personal data replaced. Only texts with a digit or @ can hold any; the others pass by the join."""
    spans = find(docs, **params).filter(F.size("spans") > 0).select(F.col("doc_id").alias("__d"), F.col("th").alias("__t"), "spans").dropDuplicates(["__d", "__t"]).withColumnRenamed("spans", "__spans")
    may = F.coalesce(F.col("text").rlike("[0-9@]"), F.lit(False))
    hit = docs.filter(may).withColumn("__th", F.xxhash64(text_of()))
    hit = hit.join(spans, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("__th") == F.col("__t")), "left")
    hit = hit.withColumn("__new", F.when(F.col("__spans").isNull(), F.col("text")).otherwise(masked(F.col("text"), "__spans")))
    new = {"text": F.col("__new"), "n_chars": F.length("__new").cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None}
    return docs.filter(~may).unionByName(hit.select(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns]))


def query(spark, sf_dir):
    """op5: every document's counts, rule spans as a digest, and all spans."""
    found = find(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select("doc_id", *[count(k).alias(f"n_{name}") for k, name in enumerate(KINDS[:4])], F.sha2(written("base"), 256).alias("base_sha256"), written("spans").alias("spans"))
