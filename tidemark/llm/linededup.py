"""Substring dedup by line hashing.

A text's lines, cut further behind punctuation marks, are the units. A unit is normalised (lower case, runs
of white space to one space) and hashed to 128 bits; digests are grouped over the whole corpus with map-side
combine, and the occurrence of the smallest (doc_id, text hash, place) is a unit's first. What repeats is
removed by runs: units that follow one another, none of them a first, go if they have RUN_WORDS words together.
So passages inside lines are found, common short units alone never go, and a unit's first always stays. The
original code point offsets of what goes are kept. Digests that are very common are joined by broadcast,
since one line may stand in a third of all documents; how many can be is bounded.

Defined cases: null text counts as empty; a null doc_id ranks after all others; rows that agree in doc_id and
text are one document and are treated alike; a unit takes the white space before it along, and a line of
which nothing is left its line break, so a text of removed lines only becomes empty; a passage without marks
or line breaks inside is one unit and found only if it is alone in it; an empty table gives no rows; `dedup`
keeps extra columns, and replaces those named like its own (n_units, n_removed, removed).

`passages` also finds what repeats inside lines, or across them: winnowing picks, of every WINDOW runs
of GRAM normalised characters that follow one another, the one of the least hash. Picked runs are units
too. A text's picks in a passage depend on the passage alone, so every passage of REACH characters that
stood before has a unit that repeats, whatever stands around it; units of neighbouring picks touch, so
at most WINDOW - 1 characters stay at either end. Only the part of a run that overlaps the first
occurrence in the same text stays; what goes always stays somewhere, at an earlier place.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bound_batches, in_slices, put, stage, table, text_of

#: Ends of units inside a line: a mark, what closes it, and white space behind.
ENDS = re.compile(r"[.!?,;:][\"')\]]*(?=[\x20\x09-\x0D])")
#: Words that units in a row have together to be a passage.
RUN_WORDS = 40
#: What `passages` takes as a unit: lines of so many words.
MIN_WORDS = 5
#: Characters of a line that is a unit however few its words, of a run, runs to pick one of, and their sum less one.
MIN_CHARS, GRAM, WINDOW = 25, 128, 128
REACH = GRAM + WINDOW - 1
#: Digests of more than HOT units and of more than a HOT_SHARE-th of all are joined by broadcast.
HOT, HOT_SHARE = 10_000, 2_000
#: A text's characters are taken in slices of SLICE, which overlap by REACH - 1.
SLICE = 1 << 20
_MIX = np.uint64(0x9E3779B97F4A7C15)


def text_key() -> Column:
    return F.xxhash64(text_of())


def pieces(text: str) -> list[tuple[int, int, int, bytes]]:
    """The units of a text in order: (line, start, end, normalised words). Those of a line lie end to end."""
    out, at = [], 0
    for n, line in enumerate(text.split("\n")):
        stop, lo, before = at + len(line), at, len(out)
        for end in [m.end() for m in ENDS.finditer(line)]:
            out.append((n, lo, at + end, normal(line[lo - at : end])))
            lo = at + end
        rest = normal(line[lo - at :])
        if rest:
            out.append((n, lo, stop, rest))
        elif len(out) > before:
            out[-1] = (n, out[-1][1], stop, out[-1][3])
        at = stop + 1
    return out


def normal(piece: str) -> bytes:
    return b" ".join(piece.lower().encode("utf-8", "surrogatepass").split())


def cut(batches):
    """mapInPandas: (doc_id, th, text) to one row a unit: (doc_id, th, unit, h1, h2), h1 and h2 its digest."""
    import xxhash

    for batch in in_slices(batches):
        units_ = [pieces(text) for text in batch["text"]]
        sizes = [len(u) for u in units_]
        h = np.frombuffer(b"".join(xxhash.xxh3_128_digest(x[3]) for u in units_ for x in u), ">i8").astype(np.int64).reshape(-1, 2)
        unit = np.arange(len(h)) - np.repeat(np.cumsum(sizes) - sizes, sizes) if sizes else np.zeros(0)
        yield pd.DataFrame({"doc_id": batch["doc_id"].repeat(sizes), "th": batch["th"].repeat(sizes), "unit": unit.astype(np.int32), "h1": h[:, 0], "h2": h[:, 1]})


def units(docs: DataFrame) -> DataFrame:
    bound_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", text_key().alias("th"), text_of().alias("text"))
    return rows.mapInPandas(cut, f"doc_id {kind}, th long, unit int, h1 long, h2 long")


def split_hot(firsts: DataFrame, total: int) -> tuple[DataFrame, DataFrame]:
    """firsts with more than HOT occurrences and a HOT_SHARE-th of all, and the rest. There are at most
    HOT_SHARE of the former, so that they may be broadcast; none of the latter makes a task large."""
    hot = F.col("n") > max(HOT, total // HOT_SHARE)
    return F.broadcast(firsts.filter(hot)), firsts.filter(~hot)


def repeats(found: DataFrame) -> DataFrame:
    """Rows (doc_id, th, unit) of all occurrences of a digest but the first."""
    rank = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), F.col("th").alias("t"), F.col("unit").alias("u"))
    firsts = stage(found.groupBy("h1", "h2").agg(F.min(rank).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1"), "firsts")
    hot, cold = split_hot(firsts, found.count())
    keys = ["h1", "h2"]
    joined = found.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys).unionByName(found.join(hot, keys))
    later = ~F.col("doc_id").eqNullSafe(F.col("first.d")) | (F.col("th") != F.col("first.t")) | (F.col("unit") != F.col("first.u"))
    return joined.filter(later).select("doc_id", "th", "unit")


def without_runs(text: str, later: set[int], run_words: int = RUN_WORDS) -> tuple[str, list[tuple[int, int]]]:
    """The text that is left when runs of the units numbered in `later` go, and the spans of the units that went."""
    found, run, words, gone = pieces(text), [], 0, set()
    for k, (_, _, _, norm) in enumerate([*found, (0, 0, 0, b"")]):
        if k in later:
            run.append(k)
            words += norm.count(b" ") + 1
        else:
            if words >= run_words:
                gone.update(run)
            run, words = [], 0
    if not gone:
        return text, []
    left = {}
    for k, (line, start, end, _) in enumerate(found):
        left.setdefault(line, []).append("" if k in gone else text[start:end])
    emptied = {line for line, parts in left.items() if not any(parts)}
    lines = ["".join(left[n]) if n in left else line for n, line in enumerate(text.split("\n")) if n not in emptied]
    return "\n".join(lines), [found[k][1:3] for k in sorted(gone)]


def dedup(docs: DataFrame, run_words: int = RUN_WORDS) -> DataFrame:
    """docs with text without its removed units, and n_units, n_removed, removed: array of (start, end),
    the offsets in the original text. The whole texts are shuffled once, to meet their repeated units."""
    found = stage(units(docs), "units")
    gone = repeats(found).groupBy("doc_id", "th").agg(F.collect_set("unit").alias("__gone"))

    def strip(texts: pd.Series, gone: pd.Series) -> pd.DataFrame:
        done = [(t, []) if g is None or not len(g) else without_runs(t, set(g), run_words) for t, g in zip(texts, gone, strict=True)]
        return pd.DataFrame({"text": [t for t, _ in done], "removed": [[{"start": a, "end": b} for a, b in r] for _, r in done]})

    return rebuilt(docs, found, gone, strip)


def rebuilt(docs: DataFrame, found: DataFrame, gone: DataFrame, strip) -> DataFrame:
    """docs joined with gone (doc_id, th, __gone), and put through strip, a pandas function of text and __gone."""
    counts = found.groupBy("doc_id", "th").agg(F.count(F.lit(1)).alias("__units"))
    per = counts.join(gone, counts["doc_id"].eqNullSafe(gone["doc_id"]) & (counts["th"] == gone["th"]), "left").select(counts["doc_id"].alias("__d"), counts["th"].alias("__t"), "__units", "__gone")
    keyed = docs.withColumn("__th", text_key())
    both = keyed.join(per, keyed["doc_id"].eqNullSafe(F.col("__d")) & (F.col("__th") == F.col("__t")), "left")
    left = F.pandas_udf(strip, "text string, removed array<struct<start:int,end:int>>")(text_of(), F.col("__gone"))
    out = put(both.withColumn("__left", left), {"__text": F.col("__left.text"), "n_units": F.coalesce("__units", F.lit(0)).cast("long"), "n_removed": F.size("__left.removed").cast("long"), "__removed": F.col("__left.removed")})
    keep = [c for c in docs.columns if c.lower() not in ("text", "n_units", "n_removed", "removed")]
    return out.select(*[F.col(f"`{c}`") for c in keep], F.col("__text").alias("text"), "n_units", "n_removed", F.col("__removed").alias("removed"))


# passages


def plain(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Code points of a text in lower case with runs of white space as one space, and their offsets."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
    points = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    blank = (points <= 32) & ((points == 32) | ((points >= 9) & (points <= 13)) | (points >= 28))
    for p in np.unique(points[points > 127]):
        if chr(p).isspace():
            blank |= points == p
    points[blank] = 32
    keep = ~blank
    keep[1:] |= blank[1:] & ~blank[:-1]
    at = np.flatnonzero(keep)
    return points[at], at


def picks(points: np.ndarray) -> np.ndarray:
    """Starts of the picked runs: of each WINDOW runs in a row the least hash, the last one of equals."""
    found = []
    for lo in range(0, max(1, len(points) - REACH + 1), SLICE):
        h = points[lo : lo + SLICE + REACH - 1].astype(np.uint64) * _MIX
        if len(h) < REACH:
            break
        n, base = 1, 0x100000001B3
        while n < GRAM:  # GRAM and WINDOW are powers of two
            h, n, base = h[:-n] * np.uint64(base) + h[n:], 2 * n, base * base % (1 << 64)
        h = (h ^ h >> np.uint64(29)) * _MIX
        low = np.uint64((1 << 24) - 1)
        least, n = (h & ~low) | (low - np.arange(len(h), dtype=np.uint64)), 1
        while n < WINDOW:
            least, n = np.minimum(least[:-n], least[n:]), 2 * n
        found.append(lo + np.unique(low - (least & low)).astype(np.int64))
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)


def cut_finely(batches):
    """mapInPandas: (doc_id, th, text) to one row a unit: (doc_id, th, place, digest), lines and picked runs.

    A place is the number of a line, or -1 - (start << 31 | length) of a run; it takes a long, as units are
    shuffled twice. Digests of a line and of a run never agree."""
    import xxhash

    digest_of = xxhash.xxh3_128_digest
    for batch in in_slices(batches, most=2 << 20):
        doc, th, place, digest = [], [], [], []
        for d, h, text in zip(batch["doc_id"], batch["th"], batch["text"], strict=True):
            before = len(place)
            for k, unit in enumerate(text.split("\n")):
                words = unit.lower().split()
                norm = " ".join(words)
                if len(words) >= MIN_WORDS or len(norm) >= MIN_CHARS:
                    place.append(k), digest.append(digest_of(b"l" + norm.encode("utf-8", "surrogatepass")))
            if len(text) >= REACH:
                points, offsets = plain(text)
                at = picks(points)
                place += (-1 - (offsets[at] << 31 | offsets[at + GRAM - 1] + 1 - offsets[at])).tolist()
                digest += [digest_of(points[p : p + GRAM].tobytes()) for p in at.tolist()]
            doc += [d] * (len(place) - before)
            th += [h] * (len(place) - before)
            if len(place) >= 16_384:
                yield pd.DataFrame({"doc_id": pd.Series(doc, dtype=object), "th": th, "place": place, "digest": digest})
                doc, th, place, digest = [], [], [], []
        yield pd.DataFrame({"doc_id": pd.Series(doc, dtype=object), "th": th, "place": place, "digest": digest})


def repeated_places(found: DataFrame) -> DataFrame:
    """Rows (doc_id, th, place, keep_to) of all units but the first of their digest. Where that is of the
    same text, keep_to is its end, and what lies before it stays."""
    order = F.when(F.col("place") < 0, -1 - F.col("place")).otherwise(F.col("place"))
    rank = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), F.col("th").alias("t"), order.alias("p"))
    firsts = stage(found.groupBy("digest").agg(F.min(rank).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1"), "firsts")
    hot, cold = split_hot(firsts, found.count())
    joined = found.join(F.broadcast(hot.select("digest")), "digest", "left_anti").join(cold, "digest").unionByName(found.join(hot, "digest"))
    own = F.col("doc_id").eqNullSafe(F.col("first.d")) & (F.col("th") == F.col("first.t"))
    end = F.shiftright("first.p", 31) + F.col("first.p").bitwiseAND((1 << 31) - 1)
    keep_to = F.when(own & (F.col("place") < 0), end).otherwise(0).cast("int")
    return joined.filter(~own | (order != F.col("first.p"))).select("doc_id", "th", "place", keep_to.alias("keep_to"))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def without(text: str, gone) -> tuple[str, list[tuple[int, int]]]:
    """The text that is left of removed units (place, keep_to), and what was removed, as disjoint spans.

    A line that goes as a whole takes its line break along; a run takes what lies between its ends."""
    lines = {g["place"] for g in gone if g["place"] >= 0}
    coded = [(-1 - g["place"], g["keep_to"]) for g in gone if g["place"] < 0]
    spans = [(max(c >> 31, to), (c >> 31) + (c & (1 << 31) - 1)) for c, to in coded]
    runs = merged([(a, b) for a, b in spans if a < b])
    out, at, k, removed = [], 0, 0, list(runs)
    for n, unit in enumerate(text.split("\n")):
        if n in lines:
            removed.append((at, at + len(unit)))
        else:
            lo, hi = at - 1 if out else at, at + len(unit)
            while k < len(runs) and runs[k][1] <= lo:
                k += 1
            j = k
            while j < len(runs) and runs[j][0] < hi:
                out.append(text[lo : max(lo, runs[j][0])])
                lo, j = max(lo, runs[j][1]), j + 1
            out.append(text[lo:hi] if lo < hi else "")
        at += len(unit) + 1
    return "".join(out), merged(removed)


def passages(docs: DataFrame) -> DataFrame:
    """As `dedup`, with repeated runs inside and across lines removed too; `removed` is disjoint spans."""
    bound_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", text_key().alias("th"), text_of().alias("text"))
    found = stage(rows.mapInPandas(cut_finely, f"doc_id {kind}, th long, place long, digest binary"), "units")
    gone = repeated_places(found).groupBy("doc_id", "th").agg(F.collect_list(F.struct("place", "keep_to")).alias("__gone"))

    def strip(texts: pd.Series, gone: pd.Series) -> pd.DataFrame:
        done = [(t, []) if g is None or not len(g) else without(t, g) for t, g in zip(texts, gone, strict=True)]
        return pd.DataFrame({"text": [t for t, _ in done], "removed": [[{"start": a, "end": b} for a, b in r] for _, r in done]})

    return rebuilt(docs, found, gone, strip)


def as_text(out: DataFrame) -> DataFrame:
    """Removed spans as start:end, by start."""
    return out.withColumn("removed", F.array_join(F.transform("removed", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ","))


def query(spark, sf_dir):
    """op6: every document with the text that is left, and the spans removed as start:end, by start."""
    return as_text(dedup(table(spark, sf_dir, "documents").select("doc_id", "text")))


def query_passages(spark, sf_dir):
    """op6, with passages inside lines: columns as those of op6_line_dedup."""
    return as_text(passages(table(spark, sf_dir, "documents").select("doc_id", "text")))
