"""Benchmark decontamination: a prefix-filtered set join of benchmark items with windows of documents.

Items and documents become sequences of word n-gram shingles (words as in the n-gram join, lower case).  An item of m
distinct shingles must find c = ceil(containment * m) of them inside one window as long as the item.  Any such window holds
at least one of the item's m - c + 1 rarest shingles, so only those prefix shingles are joined; rarity is the number of
documents that hold a shingle, counted over all documents.  Then

* length bound: a text of fewer words than c shingles need drops out before its prefix hits are joined;
* positional bound: a window with c shingles lies within the item's length of one of its prefix hits, so only hits so near a
  prefix hit are taken up, and the pair goes on if c distinct shingles are among them;
* verification: the largest number of distinct item shingles in any window of the item's length, exactly.

Defined results: NULL or blank texts match nothing; an item shorter than n words has no shingle and matches nothing (too
short to be evidence); rows without doc_id or item_id match nothing; repeated rows count once; if an id has several texts,
its best match counts, and of equally good ones that of the item with more shingles; a very long text is searched whole; an
empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from .hashing import PUNCT, Tokens, chunks, mix, signed
from .io import by_size, fresh, table

N = 3
CONTAINMENT = 0.6
#: Distinct item shingles that are sent to every worker; with more of them, shingles meet in a shuffle.
BROADCAST_SHINGLES = 4_000_000


def _shingles(n: int, only: np.ndarray | None):
    """Rows (id, version, pos, sh, words): where each text holds each shingle; ``only``: sorted shingles to keep."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in chunks(batch.column(1)):
                t = Tokens(batch.column(1).slice(a, b - a), PUNCT, lower=True)
                h, at = t.windows(n)
                doc = np.searchsorted(t.off, at, side="right") - 1
                total = np.concatenate([[np.uint64(0)], np.cumsum(mix(t.hash + (np.arange(len(t.hash)) - np.repeat(t.off[:-1], np.diff(t.off))).astype(np.uint64)))])
                start = t.off[:-1]
                version = total[t.off[1:]] - total[start]
                if only is not None:
                    near = np.searchsorted(only, h)
                    near[near == len(only)] = 0
                    hit = only[near] == h if len(only) else np.zeros(len(h), bool)
                    h, at, doc = h[hit], at[hit], doc[hit]
                ids = batch.column(0).slice(a, b - a).take(pa.array(doc))
                yield pa.RecordBatch.from_arrays([ids, pa.array(signed(version[doc])), pa.array((at - start[doc]).astype(np.int32)), pa.array(signed(h)), pa.array(np.diff(t.off)[doc].astype(np.int32))], ["id", "version", "pos", "sh", "words"])

    return run


_ROWS = "id long, version long, pos int, sh long, words int"


def _texts(df: DataFrame, key: str) -> DataFrame:
    return df.filter(F.col(key).isNotNull() & F.col("text").isNotNull()).select(F.col(key).cast("long"), F.col("text").cast("string"))


@F.pandas_udf(T.StructType().add("matched", T.IntegerType()).add("pos", T.IntegerType()))
def _best_window(positions: pd.Series, shingles: pd.Series, length: pd.Series) -> pd.DataFrame:
    """The most distinct shingles in any window of ``length`` positions, and the first such window's first hit."""
    best, where = np.zeros(len(length), np.int32), np.zeros(len(length), np.int32)
    for k, (pos, sh, m) in enumerate(zip(positions, shingles, length, strict=True)):
        order = np.lexsort((sh, pos))
        pos, sh = pos[order], sh[order]
        # a hit counts from where it enters a window until the same shingle comes again
        low = np.searchsorted(pos, pos - m, side="right")
        by = np.lexsort((np.arange(len(sh)), sh))
        before = np.full(len(sh), -1)
        same = sh[by[1:]] == sh[by[:-1]]
        before[by[1:][same]] = by[:-1][same]
        # distinct shingles of the hits low[i]..i: those whose next occurrence is after i
        change = np.zeros(len(pos) + 1, np.int64)
        after = np.searchsorted(low, np.arange(len(pos)), side="right")  # the first window that no longer holds the hit
        np.add.at(change, np.arange(len(pos)), 1)
        np.add.at(change, after, -1)
        again = np.flatnonzero(before >= 0)
        both = again[after[before[again]] > again]
        np.add.at(change, both, -1)
        np.add.at(change, after[before[both]], 1)
        held = np.cumsum(change[:-1])
        at = int(held.argmax())
        best[k], where[k] = held[at], pos[low[at]]
    return pd.DataFrame({"matched": best, "pos": where})


def contaminated(docs: DataFrame, benchmark: DataFrame, n: int = N, containment: float = CONTAINMENT, broadcast_shingles: int = BROADCAST_SHINGLES) -> DataFrame:
    """(doc_id, item_id, matched, shingles, containment) of every document and item whose shingles it holds to that share."""
    raw = _texts(benchmark, "item_id").mapInArrow(_shingles(n, None), _ROWS)
    items = table(raw.groupBy(F.col("id").alias("item_id"), F.col("version").alias("iv"), "sh").agg(F.max("pos").alias("last"), F.min("pos").alias("first")))
    w = Window.partitionBy("item_id", "iv")
    items = items.withColumns({"m": F.count("*").over(w), "reach": F.max("last").over(w) + 1}).withColumn("c", F.ceil(F.col("m") * F.lit(containment) - F.lit(1e-9)).cast("int"))
    words = items.select("sh").distinct()
    held = words.count()
    texts = _texts(docs, "doc_id")
    if held <= broadcast_shingles:
        only = np.sort(np.array([r["sh"] for r in words.toLocalIterator()], np.int64).view(np.uint64))
        hits = texts.mapInArrow(_shingles(n, only), _ROWS)
    else:
        hits = texts.mapInArrow(_shingles(n, None), _ROWS).join(words, "sh", "left_semi").select("id", "version", "pos", "sh", "words")
    hits = table(hits.withColumnRenamed("id", "doc_id"))
    rarity = hits.groupBy("sh").agg(F.countDistinct("doc_id").alias("df"))
    ranked = table(items.join(by_size(rarity), "sh", "left").withColumn("rank", F.row_number().over(w.orderBy(F.coalesce("df", F.lit(0)), "sh"))))
    listed = ranked.count()
    whole = ranked.select("sh", "item_id", "iv", "m", "c", "reach", (F.col("rank") <= F.col("m") - F.col("c") + 1).alias("rare"))
    # length bound: c distinct shingles begin at as many words, and the last has n
    long = F.col("words") >= F.col("c") + (n - 1)
    pair = ["doc_id", "version", "item_id", "iv"]
    first = table(hits.join(by_size(table(whole.filter("rare"))), "sh").filter(long).groupBy(*pair, "reach").agg(F.array_sort(F.collect_set("pos")).alias("near")))
    met = hits.join(by_size(whole), "sh").join(by_size(first.drop("reach")), pair)
    # positional bound: both lists ascend, so the nearest prefix hits of a hit are found by one filter of the pair's few
    near = F.exists("near", lambda p: F.abs(p - F.col("pos")) < F.col("reach"))
    groups = (
        met.filter(near)
        .groupBy(*pair)
        .agg(F.first("m").alias("m"), F.first("c").alias("c"), F.first("reach").alias("reach"), F.collect_set(F.struct("pos", "sh")).alias("hits"))
        .filter(F.size(F.array_distinct(F.col("hits.sh"))) >= F.col("c"))
    )
    checked = groups.withColumn("best", _best_window(F.col("hits.pos"), F.col("hits.sh"), "reach")).filter(F.col("best.matched") >= F.col("c"))
    best = F.max_by(F.struct(F.col("best.matched").alias("matched"), F.col("m").alias("shingles")), F.struct(F.col("best.matched") / F.col("m"), "m"))
    return checked.groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", F.col("b.matched").cast("long").alias("matched"), F.col("b.shingles").alias("shingles"), F.round(F.col("b.matched") / F.col("b.shingles"), 6).alias("containment"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, n: int = N, containment: float = CONTAINMENT) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item; rows without doc_id stay."""
    other = fresh("gone", docs.columns)
    gone = table(contaminated(docs, benchmark, n, containment).select(F.col("doc_id").alias(other)).distinct())
    return docs.join(by_size(gone), F.col("doc_id") == F.col(other), "left_anti")


SQL = r"""
WITH iw AS (SELECT item_id, regexp_extract_all(lower(text), '[^\x09-\x0d !-/:-@\[-`{-~]+') AS w FROM benchmark),
ig AS (SELECT item_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS sh, len(w) - 2 AS reach FROM iw WHERE len(w) >= 3),
items AS (SELECT DISTINCT item_id, sh, reach, count(DISTINCT sh) OVER (PARTITION BY item_id) AS m FROM ig),
dw AS (SELECT doc_id, regexp_extract_all(lower(text), '[^\x09-\x0d !-/:-@\[-`{-~]+') AS w FROM documents),
dg AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 1), lambda i: {'pos': i, 'sh': w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]})) AS g FROM dw WHERE len(w) >= 3),
hits AS (SELECT doc_id, item_id, g.pos AS pos, sh, reach, m FROM dg JOIN items ON g.sh = items.sh),
windows AS (SELECT a.doc_id, a.item_id, a.pos, any_value(a.m) AS m, count(DISTINCT b.sh) AS matched
  FROM hits a JOIN hits b ON a.doc_id = b.doc_id AND a.item_id = b.item_id AND b.pos >= a.pos AND b.pos < a.pos + a.reach GROUP BY ALL)
SELECT doc_id, item_id, max(matched) AS matched, any_value(m) AS shingles, round(max(matched) / any_value(m), 6) AS containment
FROM windows GROUP BY doc_id, item_id HAVING max(matched) >= ceil(any_value(m) * 0.6 - 1e-9)
"""
