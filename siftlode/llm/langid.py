"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Character 1- to 3-grams of the lower-cased whole text are hashed to a fixed number of features, weighted by 1 + ln(tf) and by
inverse document frequency over all documents, and scaled to unit length.  Weights are fitted by follow the regularised
leader (per-coordinate, proximal) with an elastic net: the L1 part keeps most weights at zero.  The softmax is then calibrated
by the one temperature that minimises the log loss of held-out rows.

The model is fitted on a bounded sample of labelled rows: ``per_language`` rows of every value of ``lang``, fewer (``FEWEST`` at
least) where there are so many values that they would be more than ``SAMPLE`` rows; in the order of a hash of doc_id, every
fifth held out for calibration.  All documents are counted for the document frequencies, and all are judged.  The driver holds
the sampled features and the weights.

A document is accepted if the calibrated probability of its best language is at least ``accept``.

Defined results: a NULL text or one without a letter is "und" with confidence 0 and rejected; without any labelled row, every
document is; a NULL lang is no label; ties go to the language that sorts first; every repeated row has its own result; of two
texts of one doc_id and label in the sample, the one of the smaller hash is used; a very long text is judged whole; an empty
table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .io import fresh

FEATURES = 1 << 15
PER_LANGUAGE = 500
SAMPLE = 100_000
FEWEST = 10
EPOCHS = 2
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.05, 0.05
ACCEPT = 0.5


def grams(text: str) -> np.ndarray:
    """Feature numbers of all character 1- to 3-grams; white space runs count as one space."""
    c = np.frombuffer(" ".join(text.lower().split()).encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    out = []
    for n in (1, 2, 3):
        if len(c) < n:
            break
        h = c[: len(c) - n + 1] + np.uint64(n << 40)
        for j in range(1, n):
            h = h * np.uint64(0x9E3779B97F4A7C15) + c[j : len(c) - n + 1 + j]
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        out.append((h >> np.uint64(49)).astype(np.int64) % FEATURES)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def _lettered(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def _tf(text: str) -> tuple[np.ndarray, np.ndarray]:
    n = np.bincount(grams(text), minlength=FEATURES)
    at = np.flatnonzero(n)
    return at, 1 + np.log(n[at])


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many rows each feature occurs, and the number of rows with text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, rows, seen = np.zeros(FEATURES + 1, np.int64), 0, np.zeros(FEATURES, bool)
        for batch in batches:
            for x in batch.column(0):
                text = x.as_py()
                if text:
                    g = grams(text)
                    seen[g] = True
                    df[:-1] += seen
                    seen[g] = False
                    rows += 1
        df[-1] = rows
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(df[at])], ["feature", "n"])

    counts = docs.select(F.col("text").cast("string")).mapInArrow(count, "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(FEATURES + 1, np.int64)
    for r in counts:
        df[r["feature"]] = r["n"]
    return df[:-1], int(df[-1])


def sample(docs: DataFrame, per_language: int) -> tuple[list[str], list[tuple[np.ndarray, np.ndarray]]]:
    """Labels and term frequencies of the training rows, in the order of the hash."""
    labelled = docs.filter("lang IS NOT NULL AND doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long").alias("id"), F.col("lang").cast("string").alias("label"))
    labels = labelled.agg(F.countDistinct("label")).first()[0]
    most = min(per_language, max(FEWEST, SAMPLE // max(1, labels)))
    luck = F.xxhash64("id", F.lit(7))
    picked = labelled.withColumn("n", F.row_number().over(Window.partitionBy("label").orderBy(luck, "id"))).filter(F.col("n") <= most).select("id", "label")
    picked = [(r["id"], r["label"]) for r in picked.collect()]  # most rows of each label
    if not picked:
        return [], []
    chosen = F.broadcast(docs.sparkSession.createDataFrame(picked, "id long, label string"))

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            tf = [_tf(x) for x in b["text"]]
            yield pd.DataFrame({"id": b["id"], "label": b["label"], "at": [a.astype(np.int32).tobytes() for a, _ in tf], "tf": [t.astype(np.float32).tobytes() for _, t in tf]})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc"), F.col("text").cast("string")).join(chosen, F.col("doc") == F.col("id")).select("id", "label", "text").mapInPandas(features, "id long, label string, at binary, tf binary").toPandas()
    rows = rows.sort_values(["id", "label", "at", "tf"]).drop_duplicates(["id", "label"])
    order = np.random.default_rng(11).permutation(len(rows))
    rows = rows.iloc[order]
    return rows["label"].tolist(), [(np.frombuffer(a, np.int32), np.frombuffer(t, np.float32).astype(float)) for a, t in zip(rows["at"], rows["tf"], strict=True)]


def _softmax(s: np.ndarray) -> np.ndarray:
    e = np.exp(s - s.max())
    return e / e.sum()


class Model:
    """Languages, inverse document frequencies, sparse weights, and the temperature."""

    def __init__(self, languages: list[str], idf: np.ndarray):
        self.languages, self.idf = languages, idf
        self.weights, self.bias, self.temperature = np.zeros((FEATURES, len(languages)), np.float32), np.zeros(len(languages)), 1.0

    def parts(self) -> tuple:
        """The model as plain values, which executors can read without this package."""
        return self.languages, self.idf, self.weights, self.bias, self.temperature

    @staticmethod
    def of(parts: tuple) -> Model:
        model = object.__new__(Model)
        model.languages, model.idf, model.weights, model.bias, model.temperature = parts
        return model

    def vector(self, at: np.ndarray, tf: np.ndarray) -> np.ndarray:
        x = tf * self.idf[at]
        norm = math.sqrt(float(x @ x))
        return x / norm if norm else x

    def scores(self, at: np.ndarray, tf: np.ndarray) -> np.ndarray:
        return self.vector(at, tf) @ self.weights[at] * 10 + self.bias

    def fit(self, labels: list[str], rows: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """FTRL-proximal; inputs are scaled by ten, as unit vectors of many features move weights little."""
        k = len(self.languages)
        z, n = np.zeros((FEATURES + 1, k)), np.zeros((FEATURES + 1, k))
        number = {x: i for i, x in enumerate(self.languages)}
        solve = lambda z, n: np.where(np.abs(z) <= L1, 0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))
        for _ in range(EPOCHS):
            for label, (at, tf) in zip(labels, rows, strict=True):
                i, x = np.append(at, FEATURES), np.append(self.vector(at, tf) * 10, 1.0)
                w = solve(z[i], n[i])
                p = _softmax(x @ w)
                p[number[label]] -= 1
                g = x[:, None] * p
                grown = n[i] + g * g
                z[i] += g - (np.sqrt(grown) - np.sqrt(n[i])) / ALPHA * w
                n[i] = grown
        w = solve(z, n)
        self.weights, self.bias = w[:-1].astype(np.float32), w[-1]

    def calibrate(self, labels: list[str], rows: list[tuple[np.ndarray, np.ndarray]]) -> None:
        if not rows:
            return
        s = np.array([self.scores(*x) for x in rows])
        y = np.array([self.languages.index(x) for x in labels])

        def loss(log_t: float) -> float:
            q = s / math.exp(log_t)
            top = q.max(1)
            return float((top + np.log(np.exp(q - top[:, None]).sum(1)) - q[np.arange(len(y)), y]).mean())

        a, b, g = math.log(0.2), math.log(5), (math.sqrt(5) - 1) / 2
        for _ in range(40):
            c, d = b - g * (b - a), a + g * (b - a)
            a, b = (a, d) if loss(c) <= loss(d) else (c, b)
        self.temperature = math.exp((a + b) / 2)

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.languages or not _lettered(text):
            return "und", 0.0
        p = _softmax(self.scores(*_tf(text)) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def train(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    labels, rows = sample(docs, per_language)
    if not labels:
        return Model([], np.zeros(FEATURES))
    df, n = document_frequencies(docs)
    model = Model(sorted(set(labels)), np.log((1 + n) / (1 + df)) + 1)
    held = np.arange(len(labels)) % 5 == 4
    part = lambda xs, which: [x for x, h in zip(xs, held, strict=True) if h == which]
    model.fit(part(labels, False), part(rows, False))
    model.calibrate(part(labels, True), part(rows, True))
    return model


def _predictor(docs: DataFrame, model: Model):
    shared = docs.sparkSession.sparkContext.broadcast(model.parts())  # features times languages, whatever the corpus

    @F.pandas_udf("struct<lang string, confidence double>")
    def predict(texts: pd.Series) -> pd.DataFrame:
        held = Model.of(shared.value)
        return pd.DataFrame([held.predict(x) for x in texts], columns=["lang", "confidence"])

    return predict(F.col("text").cast("string"))


def identify(docs: DataFrame, accept: float = ACCEPT, model: Model | None = None) -> DataFrame:
    """(doc_id, lang_pred, confidence, accepted) of every row."""
    judged = docs.select("doc_id", _predictor(docs, model or train(docs)).alias("p"))
    return judged.select("doc_id", F.col("p.lang").alias("lang_pred"), F.round("p.confidence", 4).alias("confidence"), (F.col("p.confidence") >= accept).alias("accepted"))


def keep_identified(docs: DataFrame, accept: float = ACCEPT, model: Model | None = None) -> DataFrame:
    """The rows of ``docs`` whose language is identified, as they are."""
    p = fresh("p", docs.columns)
    return docs.withColumn(p, _predictor(docs, model or train(docs))).filter(F.col(f"{p}.confidence") >= accept).drop(p)
