"""BM25 as column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

K1, B = 1.2, 0.75


def idf(df: Column, total: Column) -> Column:
    """ln((N - df + 1/2) / (df + 1/2) + 1)."""
    df, total = df.cast("double"), total.cast("double")
    return F.log((total - df + 0.5) / (df + 0.5) + 1.0)


def average_length(total_len: Column, total: Column) -> Column:
    """Tokens per document; 1 where there are none."""
    return F.when((total_len > 0) & (total > 0), total_len.cast("double") / total.cast("double")).otherwise(F.lit(1.0))


def bm25(tf: Column, dl: Column, df: Column, total: Column, avgdl: Column, k1: float = K1, b: float = B) -> Column:
    """One term's part of a document's score."""
    tf = tf.cast("double")
    base = F.when(avgdl > 0, avgdl.cast("double")).otherwise(F.lit(1.0))
    norm = F.lit(float(k1)) * (F.lit(1.0 - b) + F.lit(float(b)) * dl.cast("double") / base)
    return F.when((tf == 0) | (df == 0), F.lit(0.0)).otherwise(idf(df, total) * tf * F.lit(k1 + 1.0) / (tf + norm))
