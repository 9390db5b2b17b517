"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

A text's features are the hashed n-grams that it has (n = 4 to 8, lower case), each worth
r = log((p / |p|) / (q / |q|)), where p and q count the labelled texts of class 1 and 0 that have it, plus one.
A text that the model is fitted on doesn't count itself in its own ratios: else these would tell its label better than
those of an unseen text do. A logistic model with an L2 penalty is fitted on them by L-BFGS in numpy, on at most
`max_rows` labelled rows of `max_bytes` bytes. The model is one float for each bucket (4 MB) and a bias.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm.common import held_out, slices, table, texts, tidy, unused, with_columns
from parley.llm.ngrams import hashed_ngrams, part_of, sampled, within

BITS, SIZES = 20, range(4, 9)
#: the score where no text could be told from another: below any threshold in use, so that no document is rejected unseen
NOTHING_LEARNED = 1e-3
#: ASCII but letters and digits as blanks, so that a word's first n-gram is the same after any of these
_BLANK = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def ngrams(text: str) -> np.ndarray:
    grams = hashed_ngrams(b" " + text.lower().encode().translate(_BLANK) + b" ", SIZES, BITS)
    return np.concatenate(grams) if grams else np.empty(0, np.uint32)


class Presence:
    """Which buckets a text has."""

    def __init__(self):
        self.mark = np.zeros(1 << BITS, bool)

    def __call__(self, text: str) -> np.ndarray:
        grams = ngrams(text)
        self.mark[grams] = True
        own = np.flatnonzero(self.mark).astype(np.int32)
        self.mark[grams] = False
        return own


def minimise(value_and_gradient, w: np.ndarray, steps: int, memory: int = 8) -> np.ndarray:
    """L-BFGS with backtracking."""
    value, gradient = value_and_gradient(w)
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(steps):
        way, alphas = gradient.copy(), []
        for s, y, rho in reversed(past):
            alphas.append(rho * (s @ way))
            way -= alphas[-1] * y
        if past:
            s, y, rho = past[-1]
            way *= 1 / (rho * (y @ y))
        else:
            way *= 1 / max(1.0, float(np.linalg.norm(gradient)))
        for (s, y, rho), alpha in zip(past, reversed(alphas), strict=True):
            way += (alpha - rho * (y @ way)) * s
        slope, rate = float(gradient @ way), 1.0
        while True:
            new_value, new_gradient = value_and_gradient(w - rate * way)
            if new_value <= value - 1e-4 * rate * slope or rate < 1e-6:
                break
            rate /= 2
        s, y = -rate * way, new_gradient - gradient
        w, gain = w + s, value - new_value
        value, gradient = new_value, new_gradient
        if s @ y > 1e-12:
            past = [*past[1 - memory :], (s, y, 1 / float(s @ y))]
        if gain < 1e-6 * abs(value):
            break
    return w


def fit(rows: list[tuple[str, int]], penalty: float = 1.0, steps: int = 60) -> tuple[np.ndarray, float]:
    """Weight of each bucket, and bias. Without rows of both classes nothing tells them apart: every score is NOTHING_LEARNED."""
    y = np.array([label for _, label in rows], np.float64)
    if not len(y) or y.min() == y.max():
        return np.zeros(1 << BITS, np.float32), float(np.log(NOTHING_LEARNED / (1 - NOTHING_LEARNED)))
    presence = Presence()
    p, q = np.ones(1 << BITS), np.ones(1 << BITS)
    for text, label in rows:
        (p if label else q)[presence(text)] += 1
    # a text's chance of having the n-gram, by class
    one, zero = y.sum() + 2, (1 - y).sum() + 2
    ratio = np.log((p / one) / (q / zero))
    ratio[(p + q < 7) | (np.abs(ratio) < 1)] = 0  # in fewer than 5 texts, or about as common in both classes
    use = np.flatnonzero(ratio)
    place = np.full(1 << BITS, -1, np.int32)
    place[use] = np.arange(len(use))
    # the texts' kept n-grams, one text after the other, as one array: the sample's largest
    own = [x[x >= 0] for x in (place[presence(text)] for text, _ in rows)]
    ends = np.cumsum([len(x) for x in own])
    starts, column = ends - [len(x) for x in own], np.concatenate(own)
    del own
    value = np.empty(len(column), np.float32)
    for label, others in ((1, np.log(((p - 1).clip(1) / (one - 1)) / (q / zero))[use]), (0, np.log((p / one) / ((q - 1).clip(1) / (zero - 1)))[use])):
        for i in np.flatnonzero(y == label):
            value[starts[i] : ends[i]] = others[column[starts[i] : ends[i]]]
    cuts = np.unique(np.searchsorted(ends, np.arange(0, len(column), 1 << 20), side="right").tolist() + [len(y)]).tolist()
    parts = [(i, j, starts[i], ends[j - 1]) for i, j in zip([0, *cuts], cuts, strict=False) if j > i]  # of about a million n-grams each

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        z = np.full(len(y), w[-1])
        for i, j, a, b in parts:
            z[i:j] += np.bincount(np.repeat(np.arange(j - i), ends[i:j] - starts[i:j]), value[a:b] * w[column[a:b]], j - i)
        error = 1 / (1 + np.exp(-np.clip(z, -500, 500))) - y
        gradient = np.append(np.zeros(len(use)), error.sum())
        for i, j, a, b in parts:
            gradient[:-1] += np.bincount(column[a:b], value[a:b] * np.repeat(error[i:j], ends[i:j] - starts[i:j]), len(use))
        gradient[:-1] += penalty * w[:-1]
        return float(np.logaddexp(0, z).sum() - y @ z + penalty / 2 * (w[:-1] @ w[:-1])), gradient

    w = minimise(loss, np.zeros(len(use) + 1), steps)
    weights = np.zeros(1 << BITS, np.float32)
    weights[use] = w[:-1] * ratio[use]
    return weights, float(w[-1])


def logit(text: str, weights: np.ndarray, bias: float) -> float:
    grams = ngrams(text)
    return bias + float(weights[np.unique(grams[weights[grams] != 0])].sum(dtype=np.float64))


def learn(docs: DataFrame, labels: DataFrame, max_rows: int = 8000, max_bytes: int = 32 << 20) -> tuple[np.ndarray, float]:
    """Fits on labelled rows outside the held-out quarter. A doc_id with several labels counts as toxic if one says so;
    rows with a null label or id are left out. Equal rows count once. What reaches the driver is never more than max_rows rows and max_bytes
    bytes of text: ids are drawn first; their rows fall into 1024 parts by id and text, and whole parts are taken in a fixed
    order as long as both bounds hold. A text drawn is whole; one of over max_bytes can't be drawn."""
    own = labels.where("doc_id is not null and toxic in (0, 1)").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    total = own.count()
    if not total:
        return fit([])
    drawn = sampled(F.col("doc_id"), F.lit(min(1.0, max_rows / total)))
    # so few ids that they can be broadcast
    found = texts(docs).where(drawn).join(F.broadcast(own.where(drawn)), "doc_id").withColumn("h", F.xxhash64("text"))
    found = found.withColumn("part", part_of(F.struct("doc_id", "h")))
    distinct = found.groupBy("part", "doc_id", "h").agg(F.first(F.octet_length("text")).cast("bigint").alias("bytes"))
    sizes = distinct.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes")).collect()
    parts = within([(r["part"], r["n"], r["bytes"]) for r in sizes], max_rows, max_bytes)
    got = found.where(F.col("part").isin(parts)).groupBy("doc_id", "h").agg(F.first("text").alias("text"), F.max("toxic").alias("toxic")).toArrow()
    return fit([(text, label) for _, text, label in sorted(zip(*(got.column(c).to_pylist() for c in ("doc_id", "text", "toxic")), strict=True))])


def score(docs: DataFrame, model: tuple[np.ndarray, float], threshold: float = 0.3, added: tuple[str, str] = ("toxic_score", "toxic_predicted"), keep: list[str] | None = None) -> DataFrame:
    """The columns of docs (those in keep, if given), with toxic_score (0 to 1) and toxic_predicted (1 from threshold on),
    by the names in added, which docs mustn't have.

    Null and empty texts have no n-grams but the blank ends: their score is the model's bias, about the share of toxic texts.
    Where nothing could be learned every text scores 0.001 and is predicted 0."""
    clash = [c for c in added if unused(docs, c) != c]
    if clash:
        raise ValueError(f"docs already has {clash}")
    weights, bias = model
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    names = docs.columns if keep is None else keep

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                z = [logit(t or "", shared.value, bias) for t in part.column("text").to_pylist()]
                p = 1 / (1 + np.exp(-np.clip(np.array(z), -500, 500)))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(p), pa.array((p >= threshold).astype(np.int32))], [*names, *added])

    return docs.mapInArrow(tidy(run), with_columns(docs.select(names), f"{added[0]} double, {added[1]} int"))


def toxic_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, max_rows: int = 8000) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of docs; see learn() and score().

    Repeated rows and rows with a null id each get a row, other columns are ignored, an empty table gives an empty one.
    Texts are read whole, however long."""
    own = docs.select("doc_id", "text")
    scored = score(own, learn(own, labels, max_rows), threshold, keep=["doc_id"])
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("toxic_score").alias("score"), F.col("toxic_predicted").alias("predicted"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxic_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
