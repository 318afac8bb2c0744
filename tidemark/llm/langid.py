"""Language identification by a string kernel.

A text is the set of its character 1-, 2- and 3-grams (blended spectrum, presence only). Grams are
those of the landmark texts; k(x, y) = |x & y| / sqrt(|x| |y|). Landmarks span a Nystrom space, one
ridge regression per language is solved in it, and a text's scores are a product of its gram
incidence with the landmark matrix, computed for a batch of texts at once.

Training sees a bounded sample: at most `per_lang` labelled texts of a language, drawn by a hash of id and
text in one pass; of a longer text a slice of `fit_chars` characters from a place drawn alike, so a language
of long texts only is learned too. There are LANDMARKS landmarks at most in all, and matrices of texts by
grams are made for as many texts as keep them under CELLS cells. Prediction reads every whole text.

Defined cases: null text, or text without a letter: `und`, score 0; null languages are not learned;
without labelled rows everything is `und`; repeated rows are predicted alike; an empty table gives no
rows; lang, source and doc_id are never inputs of a prediction, extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bound_batches, table

PER_LANG, FIT_CHARS, RIDGE, ORDERS = 250, 6_000, 1e-2, 3
#: Landmarks of a language and of all together; cells of a matrix of texts by grams.
PER_LANG_LANDMARKS, LANDMARKS, CELLS = 48, 512, 8_000_000
#: Grams are hashed to BITS bits; a text is taken in slices of SLICE characters.
BITS, SLICE = 21, 1 << 16
_MIX = np.uint64(0x9E3779B97F4A7C15)


def held_out() -> Column:
    """Documents that training never sees: crc32 of the id as text is 2 modulo 4."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def grams(text: str):
    """Yields arrays of the hashed 1-, 2- and 3-grams of a text, case folded, repeats included.

    Three code points of 21 bits pack into 63 bits, which a multiplication spreads over BITS bits."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    for i in range(0, len(points), SLICE):
        p = points[i : i + SLICE + ORDERS - 1]
        packed = p
        for n in range(ORDERS):
            if n:
                packed = packed[:-1] << np.uint64(21) | p[n:]
            yield (packed * _MIX) >> np.uint64(64 - BITS)


class Grams:
    """The grams of the landmarks, and which of them a text has."""

    def __init__(self, vocab: np.ndarray):
        self.vocab = vocab
        #: Texts that are taken at once.
        self.rows = max(1, CELLS // max(1, len(vocab)))

    def incident(self, texts: list[str]) -> np.ndarray:
        """Texts by vocabulary: 1 where the text has the gram."""
        x, mark = np.zeros((len(texts), len(self.vocab)), np.float32), np.zeros(1 << BITS, bool)
        for row, text in enumerate(texts):
            parts = list(grams(text))
            for g in parts:
                mark[g] = True
            x[row] = mark[self.vocab]
            for g in parts:
                mark[g] = False
        return x

    def blocks(self, texts: list[str]):
        """(first, incidence) of as many texts at a time as CELLS allows."""
        for i in range(0, len(texts), self.rows):
            yield i, self.incident(texts[i : i + self.rows])


def sizes(x: np.ndarray) -> np.ndarray:
    """Roots of the numbers of grams; those that no landmark has tell nothing and don't count."""
    return np.sqrt(np.maximum(x.sum(axis=1), 1))


def kernel(x: np.ndarray, landmarks: np.ndarray) -> np.ndarray:
    """Texts by landmarks, both given by incidence: shared grams over the root of the product of the sizes."""
    return (x @ landmarks.T) / (sizes(x)[:, None] * sizes(landmarks))


class Model:
    """What prediction needs. A text's scores are its kernel with the landmarks times the ridge weights; as the
    landmarks' part of that product is the same for all texts, it is kept as one matrix, grams by languages."""

    def __init__(self, langs: list[str], grams_: Grams, weights: np.ndarray, bias: np.ndarray):
        self.langs, self.grams, self.weights, self.bias = langs, grams_, weights, bias

    def scores(self, texts: list[str]) -> np.ndarray:
        parts = [(x @ self.weights) / sizes(x)[:, None] + self.bias for _, x in self.grams.blocks(texts)]
        return np.concatenate(parts)

    def predict(self, texts: pd.Series) -> pd.DataFrame:
        langs, sure = np.full(len(texts), "und", object), np.zeros(len(texts))
        known = [i for i, t in enumerate(texts) if t and self.langs and any(map(str.isalpha, t))]
        if known:
            s = self.scores([texts.iat[k] for k in known])
            langs[known] = np.array(self.langs, object)[s.argmax(axis=1)]
            sure[known] = 1 / np.exp(4 * (s - s.max(axis=1, keepdims=True))).sum(axis=1)
        return pd.DataFrame({"lang_pred": langs, "score": sure})


def fit(rows: list[tuple[str, str]], landmarks: int = PER_LANG_LANDMARKS, ridge: float = RIDGE) -> Model:
    """Train on (lang, text) rows; a language's first rows are its landmarks."""
    langs = sorted({lang for lang, _ in rows})
    if not langs:
        return Model([], Grams(np.zeros(0, np.int64)), np.zeros((0, 0)), np.zeros(0))
    left = dict.fromkeys(langs, min(landmarks, max(1, LANDMARKS // len(langs))))
    chosen = []
    for i, (lang, _) in enumerate(rows):
        if left[lang]:
            left[lang] -= 1
            chosen.append(i)
    texts = [text for _, text in rows]
    vocab = np.unique(np.concatenate([g for i in chosen for g in grams(texts[i])] or [np.zeros(0, np.uint64)])).astype(np.int64)
    g = Grams(vocab)
    marks = np.concatenate([x for _, x in g.blocks([texts[i] for i in chosen])])
    k_nm = np.concatenate([kernel(x, marks) for _, x in g.blocks(texts)]).astype(np.float64)
    k_mm = k_nm[chosen]
    value, vector = np.linalg.eigh((k_mm + k_mm.T) / 2)
    good = value > 1e-6 * value.max()
    project = vector[:, good] / np.sqrt(value[good])  # the Nystrom map
    z = k_nm @ project
    y = np.where(np.array([[lang == x for x in langs] for lang, _ in rows]), 1.0, -1.0)
    bias = y.mean(axis=0)
    w = np.linalg.solve(z.T @ z + ridge * len(rows) * np.eye(z.shape[1]) / z.shape[1], z.T @ (y - bias))
    weights = (marks / sizes(marks)[:, None]).T @ (project @ w).astype(np.float32)
    return Model(langs, g, weights.astype(np.float32), bias.astype(np.float32))


def sample(docs: DataFrame, per_lang: int = PER_LANG, fit_chars: int = FIT_CHARS) -> list[tuple[str, str]]:
    """At most per_lang rows a language to the driver, those of the smallest draws, in a fixed order.

    Distinct draws of a language are counted by a sketch, which settles the share of draws that is enough; one
    pass over the texts then takes that share, equal rows once. A hot language meets in no task."""
    key = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text")
    fair = docs.filter(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text", key.alias("key"))
    draw = F.shiftrightunsigned("key", 33) / float(1 << 31)
    counts = {r.lang: r.n for r in fair.groupBy("lang").agg(F.approx_count_distinct("key").alias("n")).collect()}
    if not counts:
        return []
    shares = docs.sparkSession.createDataFrame([(k, min(1.0, (2.0 * per_lang + 20) / max(1, n))) for k, n in counts.items()], "l string, share double")
    met = fair.join(F.broadcast(shares), F.col("lang") == F.col("l")).filter(draw < F.col("share"))
    start = 1 + F.pmod(F.col("key"), F.greatest(F.length("text") - fit_chars + 1, F.lit(1)))
    taken = met.groupBy("lang", "key").agg(F.min(F.substring(F.col("text"), start.cast("int"), F.lit(fit_chars))).alias("part"))
    rows = taken.select("lang", "part", draw.alias("draw"), "key").collect()
    picked, left = [], dict.fromkeys(counts, per_lang)
    for r in sorted(rows, key=lambda r: (r.lang, r.draw, r.key)):
        if left[r.lang]:
            left[r.lang] -= 1
            picked.append((r.lang, r.part))
    return picked


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """Adds lang_pred and score from the text alone."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # landmarks, bounded by the sample
    tell = F.pandas_udf(lambda texts: shared.value.predict(texts), "lang_pred string, score double")
    return docs.withColumn("__p", tell("text")).select("*", "__p.lang_pred", "__p.score").drop("__p")


def identify(docs: DataFrame, **bounds) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score."""
    model = fit(sample(docs, **bounds))
    return predict(docs.select("doc_id", "text", held_out().alias("held_out")), model).drop("text")


def query(spark, sf_dir):
    """op7: the predicted language of every document."""
    return identify(table(spark, sf_dir, "documents"))
