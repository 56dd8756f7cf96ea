"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, fold_of, fresh, small_batches

#: Hashed features: character n-grams of 1 to 3 code points.
BITS = 14
DIM = 1 << BITS
#: Labelled rows of a language that the fit reads, about; chosen by a hash of their id. All rows count for the IDF.
SAMPLE_PER_LANGUAGE = 400
#: Predictions below this calibrated probability are rejected by the pipeline stage.
REJECT_BELOW = 0.3
UNKNOWN = "und"



def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Feature ids and counts of the lower-cased whole text, in blocks so that memory stays bounded."""
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    total = np.zeros(DIM, np.int64)
    shift = np.uint32(32 - BITS)
    for at in range(0, len(code), 1 << 20):
        c = code[at : at + (1 << 20) + 2]
        own = min(len(c), 1 << 20)
        h = c * np.uint32(0x9E3779B1)
        total += np.bincount(h[:own] >> shift, minlength=DIM)
        h2 = h[:-1] * np.uint32(0x85EBCA77) + h[1:]
        total += np.bincount(h2[:own] >> shift, minlength=DIM)
        h3 = h2[:-1] * np.uint32(0xC2B2AE3D) + h[2:]
        total += np.bincount(h3[:own] >> shift, minlength=DIM)
    at = np.flatnonzero(total)
    return at, total[at]


@dataclass
class Model:
    labels: list[str]
    idf: np.ndarray
    weights: np.ndarray  # labels x DIM
    temperature: float = 1.0

    def vector(self, at: np.ndarray, count: np.ndarray) -> np.ndarray:
        x = (1 + np.log(count)) * self.idf[at]
        norm = np.sqrt((x * x).sum())
        return x / norm if norm else x

    def logits(self, at: np.ndarray, count: np.ndarray) -> np.ndarray:
        return self.weights[:, at] @ self.vector(at, count)

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.labels or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0
        p = softmax(self.logits(*features(text)) / self.temperature)
        best = int(p.argmax())  # ties: the first label in order
        return self.labels[best], float(p[best])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


def train_ftrl(model: Model, rows: list[tuple[int, np.ndarray, np.ndarray]], epochs=4, alpha=2.0, beta=1.0, l1=1e-3, l2=1e-3) -> None:
    """Follow-the-regularised-leader with an elastic net; weights stay exactly 0 where |z| <= l1."""
    z, n = np.zeros_like(model.weights), np.zeros_like(model.weights)
    order = np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            y, at, count = rows[i]
            x = model.vector(at, count)
            zi, ni = z[:, at], n[:, at]
            w = np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2))
            p = softmax(w @ x)
            p[y] -= 1
            g = p[:, None] * x[None, :]
            more = ni + g * g
            z[:, at] = zi + g - (np.sqrt(more) - np.sqrt(ni)) / alpha * w
            n[:, at] = more
    model.weights = np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))


def calibrate(model: Model, rows: list[tuple[int, np.ndarray, np.ndarray]]) -> None:
    """The temperature of least log loss on rows that the weights were not trained on."""
    if not rows:
        return
    logits = np.stack([model.logits(at, count) for _, at, count in rows])
    labels = np.array([y for y, _, _ in rows])

    def loss(t: float) -> float:
        z = logits / t
        z -= z.max(1, keepdims=True)
        return float(np.mean(np.log(np.exp(z).sum(1)) - z[np.arange(len(z)), labels]))

    model.temperature = min(np.geomspace(0.05, 20, 61), key=loss)


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df = np.zeros(DIM, np.int64)
    for batch in batches:
        for text in batch.column(0):
            df[features(text.as_py())[0]] += 1
    at = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(df[at], pa.int64())], ["feature", "df"])


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [features(x.as_py()) for x in batch.column(2)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array([a.astype(np.int32) for a, _ in found], pa.list_(pa.int32())), pa.array([c.astype(np.int32) for _, c in found], pa.list_(pa.int32()))],
            ["doc_id", "lang", "at", "n"],
        )


def fit(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> Model:
    """Learns from text and lang of the rows of docs with neither null.

    Document frequencies cover every such row. The weights are trained on at most about per_language
    rows of each language, those of the least hashes of doc_id; a fifth of them is kept for the
    temperature. What reaches the driver is bounded by DIM and by per_language times the languages.
    """
    small_batches(docs.sparkSession)
    rows = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & (F.col("text") != "")).select("doc_id", "lang", "text")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # one row a language
    labels, n = sorted(sizes), sum(sizes.values())
    idf = np.zeros(DIM)
    if not labels:
        return Model([], idf, np.zeros((0, DIM)))
    for r in rows.select("text").mapInArrow(_document_counts, "feature int, df long").groupBy("feature").agg(F.sum("df").alias("df")).collect():
        idf[r["feature"]] = np.log((1 + n) / (1 + r["df"])) + 1
    share = F.create_map(*[F.lit(x) for lang in labels for x in (lang, min(1.0, per_language / sizes[lang]))])
    drawn = (F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(1 << 24)) / float(1 << 24)) < share[F.col("lang")]
    sample = rows.where(drawn).mapInArrow(_vectors, "doc_id long, lang string, at array<int>, n array<int>").toPandas()
    sample = sample.sort_values(["doc_id", "lang"], kind="stable")
    examples = [(labels.index(g), np.asarray(a), np.asarray(c)) for g, a, c in zip(sample["lang"], sample["at"], sample["n"], strict=True)]
    model = Model(labels, idf, np.zeros((len(labels), DIM)))
    train_ftrl(model, [x for i, x in enumerate(examples) if i % 5])
    calibrate(model, examples[::5])
    return model


def predicted(model: Model, text: Column) -> Column:
    """struct<lang_pred, score> of a text column."""

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([model.predict(t) for t in texts], columns=["lang_pred", "score"])

    return predict(text)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred and score (older columns of these names go).

    A text that is null, empty or without a letter gets `und` and 0; so do all when nothing could be
    learned. Of labels with equal scores the first in alphabetical order wins. Equal texts get equal
    predictions.
    """
    small_batches(docs.sparkSession)
    (name,) = fresh(docs, "found")
    found = docs.withColumn(name, predicted(model, F.col("text")))
    return found.withColumn("lang_pred", F.col(f"{name}.lang_pred")).withColumn("score", F.col(f"{name}.score")).drop(name)


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.where(F.coalesce(fold_of(F.col("doc_id")) != 2, F.lit(False)))


def keep_identified(docs: DataFrame) -> DataFrame:
    """Pipeline stage: rows in a language that can be told, of a calibrated probability of REJECT_BELOW at least; columns stay.

    Rows of null, empty or letterless texts go. Equal texts stay or go together, repeated rows included.
    An empty table stays empty.
    """
    (name,) = fresh(docs, "found")
    found = docs.withColumn(name, predicted(fit(training_rows(docs)), F.col("text")))
    return found.where((F.col(f"{name}.lang_pred") != UNKNOWN) & (F.col(f"{name}.score") >= REJECT_BELOW)).select(*[F.col(f"`{c}`") for c in docs.columns])


def op5_language_id(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = fit(training_rows(docs))
    return identify(docs.select("doc_id", "text"), model).select(
        "doc_id", F.coalesce(fold_of(F.col("doc_id")) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score"
    )
