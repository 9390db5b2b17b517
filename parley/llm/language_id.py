"""Language identification: averaged hashed subword embeddings under a linear softmax.

A text's byte n-grams (n = 2 to 4, lower case, all ASCII but letters as blanks) are hashed to buckets; each bucket
has an embedding, their average goes through a linear softmax. Both are trained by stochastic
gradient descent in numpy on at most `per_language` texts of each language, `max_rows` texts and `max_bytes` bytes in all. A fifth of
these is kept apart: a temperature is fitted on it, and the score below which a prediction is rejected is
its lowest calibrated scores' quantile, never over one half.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm.common import held_out, slices, table, tidy, unused, with_columns
from parley.llm.ngrams import hashed_ngrams, part_of, within

BITS, SIZES, DIM = 15, range(2, 5), 16
UNKNOWN = "und"
_BLANK = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


@dataclass
class Model:
    languages: list[str]
    logits: np.ndarray  # of each bucket: its embedding through the softmax layer
    bias: np.ndarray
    temperature: float
    reject_below: float


def has_letter(text: str) -> bool:
    """Whether text has a letter of any script; digits, fractions, circled and Roman numerals aren't letters."""
    return any(map(str.isalpha, text))


def buckets(text: str) -> np.ndarray:
    grams = hashed_ngrams(b" " + text.lower().encode().translate(_BLANK) + b" ", SIZES, BITS)
    return np.concatenate(grams) if grams else np.empty(0, np.uint32)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(rows: list[tuple[str, str]], epochs: int = 6, rate: float = 20.0, batch: int = 16, seed: int = 7) -> Model:
    """rows: text and language, in an order that doesn't vary."""
    rows = [(t, lang) for t, lang in rows if has_letter(t)]
    languages = sorted({lang for _, lang in rows})
    k = len(languages)
    if not k:
        return Model([], np.zeros((1 << BITS, 0), np.float32), np.zeros(0), 1.0, 0.0)
    rng = np.random.default_rng(seed)
    which = {lang: i for i, lang in enumerate(languages)}
    y = np.array([which[lang] for _, lang in rows])
    counted = []
    for text, _ in rows:
        b, n = np.unique(buckets(text), return_counts=True)
        counted.append((b.astype(np.int64), (n / n.sum()).astype(np.float32)))
    order = rng.permutation(len(rows))
    apart, train = order[: len(rows) // 5], order[len(rows) // 5 :]
    embed = rng.normal(0, 0.1, (1 << BITS, DIM)).astype(np.float32)
    layer, bias = np.zeros((DIM, k), np.float32), np.zeros(k, np.float32)
    layer += rng.normal(0, 0.1, layer.shape).astype(np.float32)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for at in range(0, len(train), batch):
            own = rng.permutation(train[at : at + batch]) if epoch == 0 else train[at : at + batch]
            mean = np.stack([counted[i][1] @ embed[counted[i][0]] for i in own])
            error = softmax(mean @ layer + bias)
            error[np.arange(len(own)), y[own]] -= 1
            back = error @ layer.T / len(own)
            layer -= 0.05 * step * mean.T @ error / len(own)
            bias -= 0.005 * step * error.mean(axis=0)
            for i, g in zip(own, back, strict=True):
                embed[counted[i][0]] -= step * counted[i][1][:, None] * g
        train = rng.permutation(train)
    logits = (embed @ layer).astype(np.float32)
    temperature, reject = 1.0, 0.0
    if len(apart):
        z = np.stack([counted[i][1] @ logits[counted[i][0]] for i in apart]) + bias
        truth = y[apart]
        losses = {t: -np.log(softmax(z / t)[np.arange(len(truth)), truth] + 1e-12).mean() for t in np.geomspace(0.1, 10, 41)}
        temperature = float(min(losses, key=losses.get))
        top = softmax(z / temperature).max(axis=1)
        reject = float(min(0.5, np.quantile(top, 0.002)))
    return Model(languages, logits, bias.astype(np.float64), temperature, reject)


def learn(docs: DataFrame, per_language: int = 1200, max_rows: int = 48_000, max_languages: int = 256, max_bytes: int = 32 << 20) -> Model:
    """Fits on texts with a language outside the held-out quarter. What reaches the driver is never more than per_language texts of a
    language, max_rows texts and max_bytes bytes, the latter two in equal shares for each of the languages: texts fall into 1024
    parts by id and text, and whole parts are taken in a fixed order as long as the bounds hold. A text drawn is whole; one of more
    bytes than its language's share can't be drawn. Rows of one language, id and text count once, so that null and repeated
    ids are drawn like any other. Of more than max_languages languages (the model has a column for each) those with the fewest
    rows aren't learned."""
    own = docs.select("doc_id", "text", "lang").where("text is not null and lang is not null").where(~held_out(F.col("doc_id")))
    own = own.withColumn("h", F.xxhash64("text")).withColumn("part", part_of(F.struct("doc_id", "h")))
    common = [r["lang"] for r in own.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_languages).collect()]
    distinct = own.where(F.col("lang").isin(common)).groupBy("lang", "part", "doc_id", "h").agg(F.first(F.octet_length("text")).cast("bigint").alias("bytes"))
    sizes: dict[str, list[tuple[int, int, int]]] = {}
    for r in distinct.groupBy("lang", "part").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes")).collect():  # 1024 rows a language at most
        sizes.setdefault(r["lang"], []).append((r["part"], r["n"], r["bytes"]))
    k = max(1, len(common))
    taken = [(lang, part) for lang, parts in sizes.items() for part in within(parts, min(per_language, max_rows // k), max_bytes // k)]
    few = F.broadcast(docs.sparkSession.createDataFrame(taken, "lang string, part bigint"))
    chosen = own.join(few, ["lang", "part"]).groupBy("lang", "doc_id", "h").agg(F.first("text").alias("text")).select("doc_id", "text", "lang").toArrow()
    rows = sorted(zip(*(chosen.column(c).to_pylist() for c in ("doc_id", "text", "lang")), strict=True), key=lambda r: (r[0] is None, r[0] or 0, r[1:]))
    return fit([(text, lang) for _, text, lang in rows])


def predict(text: str | None, model: Model) -> tuple[str, float, bool]:
    """Language, calibrated score, and whether the prediction is accepted."""
    if not text or not has_letter(text):
        return UNKNOWN, 0.0, False
    if not model.languages:
        return UNKNOWN, 0.0, True  # nothing to reject it by
    b = buckets(text)
    p = softmax((model.logits[b].sum(axis=0, dtype=np.float64) / len(b) + model.bias) / model.temperature)
    i = int(p.argmax())
    return model.languages[i], float(p[i]), bool(p[i] >= model.reject_below)


def identify(docs: DataFrame, model: Model, added: tuple[str, str, str] = ("lang_pred", "lang_score", "lang_accepted"), keep: list[str] | None = None) -> DataFrame:
    """The columns of docs (those in keep, if given), with lang_pred, lang_score and lang_accepted, by the names in added,
    which docs mustn't have.

    A text that is null or has no letter is `und`, score 0, not accepted. If nothing could be learned every text
    with a letter is `und`, score 0, and accepted, as nothing tells against it."""
    clash = [c for c in added if unused(docs, c) != c]
    if clash:
        raise ValueError(f"docs already has {clash}")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns if keep is None else keep

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                out = [predict(t, shared.value) for t in part.column("text").to_pylist()]
                lang, score, accepted = zip(*out, strict=True)
                columns = [*(part.column(c) for c in names), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(accepted, pa.bool_())]
                yield pa.RecordBatch.from_arrays(columns, [*names, *added])

    return docs.mapInArrow(tidy(run), with_columns(docs.select(names), "{} string, {} double, {} boolean".format(*added)))


def languages(docs: DataFrame, per_language: int = 1200) -> DataFrame:
    """doc_id, held_out, lang_pred, score and accepted of every row; lang is read for learning alone. The 256 most frequent
    languages can be predicted (see learn()).

    Repeated rows and rows with a null id each get a row, other columns are ignored, an empty table gives an empty one.
    Texts are read whole, however long."""
    named = identify(docs.select("doc_id", "text"), learn(docs, per_language), keep=["doc_id"])
    return named.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_accepted").alias("accepted"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages(table(spark, sf_dir, "documents"))
