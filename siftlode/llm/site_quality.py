"""Document quality by hierarchical empirical Bayes over hosts and their paths.

A logistic regression on measures of a text's form gives every document's evidence: the log odds that it is good, less those
of the training rows.  Documents are then grouped by host and by path within the host.  With k of a group's n documents good
(labels where there are any, else the classifier's probability),

* a host's rate is Beta distributed about the global rate M: posterior mean (k + s*M) / (n + s);
* a path's rate is Beta distributed about its host's: (k + t*H) / (n + t).

The prior strengths s and t are fitted to the spread between groups by the method of moments, so that sparse sites shrink
towards the global rate and sparse paths towards their site.  A document's quality adds its evidence to the log odds of its
path's rate, from which its own share is left out.

The classifier is fitted on a bounded sample: ``per_class`` labelled rows of each class, in the order of a hash of doc_id.
Everything else is counted over all documents.  The texts are read once for their measures; two groupings and two joins on
host and path move keys and sums.

Defined results: a NULL text is empty, and measured as such; a NULL host or path is a group of its own; a document with several
labels counts by their mean; without labels of both classes there is no evidence, so that documents differ by their groups
alone, and without any label every quality is one half; a quality just at the limit is kept; repeated rows are judged alike,
each by itself; a very long text is measured whole; an empty table gives an empty result; other columns are ignored, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from .hashing import SPACE, Tokens, chunks
from .io import by_size, table

PER_CLASS = 5_000
RIDGE = 1.0
STEPS = 30
#: Quality from which a document is kept.
KEEP = 0.5
#: The strongest prior, in documents.
STRONGEST = 1e6

_KIND = np.zeros(256, np.int8)
_KIND[[i for i in range(33, 127) if not chr(i).isalnum()]] = 1
_KIND[[ord(c) for c in ".,;:'\"?!-()"]] = 2
_KIND[ord("0") : ord("9") + 1] = 3
_KIND[ord("A") : ord("Z") + 1] = 4
_KIND[ord("a") : ord("z") + 1] = 5
_KIND[128:] = 6
_KIND[SPACE] = 7
MEASURES = ("log_words", "word_length", "symbols", "marks", "digits", "capitals", "lower", "lines", "distinct", "exclaims", "top_word")


def measures(texts: pa.Array) -> np.ndarray:
    """One row of ``MEASURES`` for every text."""
    t = Tokens(texts, SPACE)
    texts = pc.fill_null(texts, "")
    ends = np.concatenate([[0], np.cumsum(np.asarray(pc.binary_length(texts)), dtype=np.int64)])
    n = len(texts)

    def share(of: np.ndarray, by: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(of, dtype=np.int64)])
        return (total[ends[1:]] - total[ends[:-1]]) / np.maximum(1, by)

    kind = _KIND[t.bytes]
    size = np.diff(ends)
    words = np.diff(t.off)
    solid = size - share(kind == 7, np.ones(n)).astype(np.int64)
    doc = np.repeat(np.arange(n), words)
    order = np.lexsort((t.hash, doc))
    h, d = t.hash[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    first = np.flatnonzero(new)
    distinct = np.bincount(d[first], minlength=n)
    most = np.zeros(n, np.int64)
    np.maximum.at(most, d[first], np.diff(np.append(first, len(h))))
    return np.stack(
        [
            np.log1p(words),
            np.log1p(solid / np.maximum(1, words)),
            *(share(kind == k, solid) for k in (1, 2, 3, 4, 5)),
            share(t.bytes == 10, np.maximum(1, words)),
            distinct / np.maximum(1, words) * np.log1p(words) / 10,
            share(t.bytes == 33, solid),
            most / np.maximum(1, words),
        ],
        1,
    )


class Classifier:
    """Ridge logistic regression on standardised measures and their squares; ``predict`` gives log likelihood ratios."""

    def __init__(self, rows: np.ndarray, good: np.ndarray):
        self.usable = len(good) > 0 and 0 < good.sum() < len(good)
        if not self.usable:
            return
        self.mean, self.spread = rows.mean(0), np.maximum(rows.std(0), 1e-6)
        x = self._inputs(rows)
        share = good.mean()
        # both classes weigh the same, so that the intercept carries no rate
        weight = np.where(good > 0, 0.5 / share, 0.5 / (1 - share))
        w, ridge = np.zeros(x.shape[1]), np.full(x.shape[1], RIDGE)
        ridge[-1] = 1e-9
        for _ in range(STEPS):  # Newton
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            step = np.linalg.solve((x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag(ridge), x.T @ (weight * (good - p)) - ridge * w)
            w = w + step
            if np.abs(step).max() < 1e-8:
                break
        self.weights = w

    def _inputs(self, rows: np.ndarray) -> np.ndarray:
        z = np.clip((rows - self.mean) / self.spread, -6, 6)
        return np.concatenate([z, z * z, np.ones((len(z), 1))], 1)

    def predict(self, rows: np.ndarray) -> np.ndarray:
        return np.clip(self._inputs(rows) @ self.weights, -12, 12) if self.usable else np.zeros(len(rows))


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in chunks(batch.column(1)):
            m = measures(batch.column(1).slice(a, b - a))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.FixedSizeListArray.from_arrays(pa.array(m.ravel()), m.shape[1]).cast(pa.list_(pa.float64()))], ["good", "m"])


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Classifier:
    """The classifier of a bounded sample of labelled rows."""
    known = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").select(F.col("doc_id").cast("long").alias("id"), F.col("quality").cast("double").alias("good"))
    one = known.groupBy("id").agg(F.avg("good").alias("good")).filter("good IN (0, 1)")
    luck = F.xxhash64("id", F.lit(5))
    picked = [(r["id"], r["good"]) for g in (0.0, 1.0) for r in one.filter(F.col("good") == g).orderBy(luck, "id").limit(per_class).collect()]
    if not picked:
        return Classifier(np.zeros((0, len(MEASURES))), np.zeros(0))
    chosen = F.broadcast(docs.sparkSession.createDataFrame(picked, "id long, good double"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc"), F.col("text").cast("string").alias("text")).join(chosen, F.col("doc") == F.col("id")).select("good", "text").mapInArrow(_measured, "good double, m array<double>").collect()
    return Classifier(np.array([r["m"] for r in rows]).reshape(len(rows), len(MEASURES)), np.array([r["good"] for r in rows]))


def _evidence(model: Classifier):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in chunks(batch.column(3)):
                rows = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*rows.columns[:3], pa.array(np.round(model.predict(measures(rows.column(3))), 6))], ["doc_id", "host", "path", "evidence"])

    return run


def strength(groups: DataFrame, n: Column, k: Column, around: Column) -> float:
    """The prior strength, in documents, that explains how the rates k/n of groups spread around ``around`` (method of moments)."""
    # sum (k - n*c)^2 = sum n*c*(1-c) * (1 + (n - 1) * r) in expectation, with r = 1 / (strength + 1)
    binomial = n * around * (1 - around)
    seen, free, more = groups.filter(n > 1).agg(F.sum((k - n * around) * (k - n * around)), F.sum(binomial), F.sum(binomial * (n - 1))).first()
    if not more:
        return STRONGEST
    r = min(1.0, max(1 / STRONGEST, ((seen or 0.0) - (free or 0.0)) / more))
    return 1 / r - 1 if r < 1 else 0.01


def site_quality(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", keep: float = KEEP, per_class: int = PER_CLASS, model: Classifier | None = None) -> DataFrame:
    """(doc_id, host, path, evidence, host_rate, path_rate, quality, kept) of every row."""
    model = model or fit(docs, labels, per_class)
    rows = docs.select("doc_id", F.col(host).cast("string").alias("host"), F.col(path).cast("string").alias("path"), F.col("text").cast("string").alias("text"))
    judged = rows.mapInArrow(_evidence(model), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, host string, path string, evidence double")
    known = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").alias("of")).agg(F.avg(F.col("quality").cast("double")).alias("good"))
    judged = judged.join(by_size(known), F.col("doc_id") == F.col("of"), "left").drop("of")
    return posteriors(table(judged), keep)


def posteriors(judged: DataFrame, keep: float = KEEP) -> DataFrame:
    """The hierarchy's results from rows (doc_id, host, path, evidence, good); good: a label, or NULL."""
    good = F.coalesce("good", 1 / (1 + F.exp(-F.col("evidence"))))
    paths = table(judged.groupBy("host", "path").agg(F.count("*").cast("double").alias("n"), F.sum(good).alias("k")))
    hosts = table(paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("k").alias("k")))
    total, sum_good = hosts.agg(F.sum("n"), F.sum("k")).first()
    rate = min(1 - 1e-6, max(1e-6, (sum_good or 0.0) / total)) if total else 0.5
    s = strength(hosts, F.col("n"), F.col("k"), F.lit(rate))
    hosts = hosts.select(F.col("host").alias("of_host"), ((F.col("k") + s * rate) / (F.col("n") + s)).alias("host_rate"))
    both = table(paths.join(by_size(hosts), F.col("host").eqNullSafe(F.col("of_host"))).drop("of_host"))
    t = strength(both, F.col("n"), F.col("k"), F.col("host_rate"))
    both = both.select(F.col("host").alias("of_host"), F.col("path").alias("of_path"), "host_rate", "n", "k")
    joined = judged.join(by_size(both), F.col("host").eqNullSafe(F.col("of_host")) & F.col("path").eqNullSafe(F.col("of_path")))
    clip = lambda x: F.least(F.lit(1 - 1e-6), F.greatest(F.lit(1e-6), x))
    prior = clip((F.col("k") - good + t * F.col("host_rate")) / (F.col("n") - 1 + t))
    quality = 1 / (1 + F.exp(-(F.col("evidence") + F.log(prior / (1 - prior)))))
    out = joined.select("doc_id", "host", "path", "evidence", F.round("host_rate", 6).alias("host_rate"), F.round((F.col("k") + t * F.col("host_rate")) / (F.col("n") + t), 6).alias("path_rate"), F.round(quality, 6).alias("quality"))
    return out.withColumn("kept", F.col("quality") >= keep)
