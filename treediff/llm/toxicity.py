"""Severity of toxic texts by cumulative-link ordinal regression on sparse features."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treediff.llm.common import column, read, stash

#: The model is fitted on at most this many labelled documents, those of the smallest hashes.
FIT_ROWS = 8192
#: A word is a feature where chi-squared of having it against being of a grade above 0, with
#: Yates's correction (which rare words need), is this or more.
LEAST_CHI2 = 25.0
WORD = regex.compile(r"[\p{L}\p{N}]+")
#: A text is called toxic at an expected severity of this or more.
CUT = 0.5


def text_words(text: str | None) -> set[str]:
    return set(WORD.findall((text or "").lower()))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Ordinal:
    """P(grade >= g) = sigmoid(score - threshold[g - 1]); one weight a word for all thresholds, which ascend."""

    weights: dict[str, float]
    thresholds: np.ndarray

    def score(self, words: set[str]) -> float:
        get = self.weights.get
        return sum([v for w in words if (v := get(w)) is not None])

    def above(self, scores: np.ndarray) -> np.ndarray:
        """P(grade >= g) for g = 1, 2, ..., a column each."""
        return sigmoid(scores[:, None] - self.thresholds[None, :])


def linked(has: int, above: int, rows: int, bad: int) -> float:
    """Chi-squared, with Yates's correction, of having a word (has; above of them are of a grade over 0) against being of a grade over 0."""
    spread = has * (rows - has) * bad * (rows - bad)
    return rows * max(abs(above * rows - has * bad) - rows / 2, 0.0) ** 2 / spread if spread else 0.0


def loss(weight: np.ndarray, first: float, gap: np.ndarray, col: np.ndarray, row: np.ndarray, grades: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Minus the log likelihood, and its slopes over weights, first threshold and the logarithms of the steps between thresholds."""
    n, top = len(grades), len(gap) + 1
    theta = np.concatenate([[-np.inf], first + np.concatenate([[0.0], np.cumsum(np.exp(gap))]), [np.inf]])
    z = np.bincount(row, weights=weight[col], minlength=n)
    # P(grade = g) = s(theta[g + 1] - z) - s(theta[g] - z)
    s_hi, s_lo = sigmoid(theta[grades + 1] - z), sigmoid(theta[grades] - z)
    p = np.maximum(s_hi - s_lo, 1e-9)
    d_hi, d_lo = s_hi * (1 - s_hi), s_lo * (1 - s_lo)
    g_z = (d_hi - d_lo) / p
    g_theta = np.zeros(top + 2)
    np.add.at(g_theta, grades + 1, -d_hi / p)
    np.add.at(g_theta, grades, d_lo / p)
    tail = np.cumsum(g_theta[1:-1][::-1])[::-1]
    return float(-np.log(p).sum()), [np.bincount(col, weights=g_z[row], minlength=len(weight)), tail[:1], tail[1:] * np.exp(gap)]


def fit_numbers(names: list[str], held: list[list[int]], grades: np.ndarray, l2: float = 0.1, steps: int = 400) -> Ordinal:
    """Maximum likelihood with a ridge, by Adam on the whole sample of numbered features; the same rows in the same order give the same model.

    Thresholds are the first and positive steps up from it, so they keep their
    order. Grades that no row has get thresholds out of reach.
    """
    top = int(grades.max(initial=1))
    col = np.array([k for h in held for k in h], np.int64)
    row = np.repeat(np.arange(len(held)), [len(h) for h in held])
    weight, first, gap = np.zeros(len(names)), np.array([2.0]), np.full(top - 1, 0.5)
    params = [weight, first, gap]
    moment = [[np.zeros_like(p), np.zeros_like(p)] for p in params]
    for step in range(1, steps + 1 if len(held) else 1):
        slopes = loss(weight, first[0], gap, col, row, grades)[1]
        grads = [slopes[0] + l2 * weight, slopes[1], slopes[2] + 0.1 * gap]
        for value, g, (m, v) in zip(params, grads, moment):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            value -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    thresholds = first[0] + np.concatenate([[0.0], np.cumsum(np.exp(gap))])
    return Ordinal({w: float(x) for w, x in zip(names, weight) if abs(x) > 1e-4}, thresholds)


def fit(rows: list[tuple[set[str], int]], chi2: float = LEAST_CHI2) -> Ordinal:
    """The model of rows in memory. Words that the screen finds unrelated to the grades aren't features: labels are noisy, and rare words would learn the noise."""
    has: Counter[str] = Counter()
    above: Counter[str] = Counter()
    for words, g in rows:
        has.update(words)
        above.update(words if g > 0 else ())
    bad = sum(g > 0 for _, g in rows)
    names = sorted(w for w in has if linked(has[w], above[w], len(rows), bad) >= chi2)
    at = {w: k for k, w in enumerate(names)}
    return fit_numbers(names, [sorted(at[w] for w in words if w in at) for words, _ in rows], np.array([g for _, g in rows], np.int64))


def grade_of(quality: Column, toxic: Column) -> Column:
    """Ordered severity from the labels: 0 not toxic, 1 toxic, 2 toxic and of low quality.

    The labels have no degrees of toxicity, so the third grade is a proxy: a text
    that is toxic and worth nothing besides ranks above one that is toxic alone.
    """
    return F.when(F.coalesce(toxic, F.lit(0)) == 0, 0).when(F.coalesce(quality, F.lit(1)) == 1, 1).otherwise(2)


def fit_sample(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, key: str = "doc_id", text: str = "text", chi2: float = LEAST_CHI2) -> Ordinal:
    """The model of the `rows` labelled documents of the smallest hashes of key and text.

    Documents are rows of docs whose key has a label; a key with several labels
    has the worst one; rows that share key and text count once. Texts become
    words, counts of words and chi-squared on the executors: the driver gets the
    words that pass the screen and, for each document, their numbers.
    """
    graded = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("k")).agg(F.max(grade_of(F.col("quality"), F.col("toxic"))).alias("grade"))
    own = docs.select(column(docs, key).cast("long").alias("k"), F.coalesce(column(docs, text).cast("string"), F.lit("")).alias("t"))
    h = F.xxhash64("k", "t").alias("h")
    chosen = own.select("k", h).join(graded, "k").groupBy("k", "h", "grade").agg(F.lit(1).alias("one")).orderBy("h", "k").limit(rows)
    chosen = stash(chosen.select(F.col("k").alias("c_k"), F.col("h").alias("c_h"), "grade"), "labelled")  # at most `rows` rows
    texts = own.join(F.broadcast(chosen), (F.col("k") == F.col("c_k")) & (F.xxhash64("k", "t") == F.col("c_h"))).dropDuplicates(["c_k", "c_h"])
    words = stash(texts.select("c_k", "c_h", "grade", "t").mapInArrow(_word_lists, "k long, h long, grade int, words array<string>"), "words")
    n, bad = words.agg(F.count("*"), F.count_if(F.col("grade") > 0)).first()
    counts = words.select(F.explode("words").alias("word"), (F.col("grade") > 0).cast("int").alias("a")).groupBy("word").agg(F.count("*").alias("has"), F.sum("a").alias("above"))
    d = lambda x: F.col(x).cast("double")
    spread = d("has") * (n - d("has")) * float(bad) * float(n - bad)
    score = F.when(spread > 0, n * F.pow(F.greatest(F.abs(d("above") * n - d("has") * float(bad)) - n / 2, F.lit(0.0)), 2) / spread)
    names = [r["word"] for r in counts.where(score >= chi2).orderBy("word").collect()]
    numbered = words.select("k", "h", "grade", "words").mapInArrow(_numbers(words.sparkSession.sparkContext.broadcast({w: i for i, w in enumerate(names)})), "k long, h long, grade int, at array<int>")
    held = numbered.orderBy("h", "k").collect()  # at most `rows` rows of small numbers
    return fit_numbers(names, [list(r["at"]) for r in held], np.array([r["grade"] for r in held], np.int64))


def _word_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = [sorted(text_words(t)) for t in batch.column(3).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(words, pa.list_(pa.string()))], ["k", "h", "grade", "words"])


def _numbers(numbers):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = numbers.value.get
        for batch in batches:
            at = [sorted(k for w in words if (k := get(w)) is not None) for words in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(at, pa.list_(pa.int32()))], ["k", "h", "grade", "at"])

    return run


def _grades(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            scores = np.array([m.score(text_words(t)) for t in batch.column(1).to_pylist()], float)
            above = m.above(scores)
            severity = above.sum(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(severity), pa.array((above >= 0.5).sum(axis=1).astype(np.int32)), pa.array(severity >= CUT)], ["doc_id", "severity", "grade", "toxic"])

    return run


def severity(docs: DataFrame, model: Ordinal, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, severity (expected grade), grade (the last whose chance to be reached is half or more), toxic: one row per row of docs.

    Null, empty, repeated and very long texts are scored like any other, whole;
    extra columns aren't read; an empty table gives no rows. The model is broadcast: its size
    is bounded by the words of the fitted sample.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(_grades(held), "doc_id long, severity double, grade int, toxic boolean")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return severity(docs, fit_sample(docs, read(spark, sf_dir, "labels")))
