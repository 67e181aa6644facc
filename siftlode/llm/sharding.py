"""Range partitioning of records into shards of even bytes by sampled splitters.

A record is drawn with a probability in proportion to its bytes (certainly, once it is as large as the sampling unit), by a
hash of its doc_id, so that a sample stands for equal bytes wherever it falls.  Splitters are the quantiles of the sampled
weight over the key (source, doc_id).  Shards that turn out overfull, by their exact sizes over all records, are cut again at
exact cumulative sizes.  Records are then moved to the partition that has their shard's number and sorted by key there.

There are as many shards as ``SHARD_BYTES`` go into the table, ``LEAST`` at least.  The driver holds the sample, at most about
``SAMPLE`` keys, and the splitters, of which there are not many more than shards.

Defined results: NULL or empty texts have no bytes and go where their key says; a NULL key sorts first; records of one key
are never separated, so a shard can exceed its share by one key's records, and two texts of one key share a shard; a very
long text is one record; of equal keys at a splitter all come before it; a column named ``shard`` is replaced; an empty table
gives an empty result.
"""

from __future__ import annotations

import bisect
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from .io import fresh, table

#: Bytes of text that a shard holds where there are enough for more than ``LEAST`` shards.
SHARD_BYTES = 128 << 20
LEAST = 64
#: Sampled keys for each shard, fewer where there would be more than ``SAMPLE`` in all.
OVERSAMPLE = 64
SAMPLE = 2_000_000
#: A shard is overfull beyond this multiple of its share.
SLACK = 1.25


def _key(source, doc) -> tuple:
    return (source is not None, source or "", doc is not None, doc or 0)


class Splitters:
    """The ascending upper keys of all shards but the last, to look up whole columns of keys."""

    def __init__(self, keys: list[tuple]):
        self.sources = sorted({k[:2] for k in keys})
        self.starts = [bisect.bisect_left(keys, (*x, False, 0)) for x in self.sources] + [len(keys)]
        #: Of each source, the splitters without a number, which sort first, and the numbers of the others.
        self.blank = [sum(not k[2] for k in keys[a:b]) for a, b in zip(self.starts, self.starts[1:], strict=False)]
        self.numbers = [np.array([k[3] for k in keys[a:b] if k[2]], np.int64) for a, b in zip(self.starts, self.starts[1:], strict=False)]

    def find(self, source: pd.Series, doc: np.ndarray, blank: np.ndarray) -> np.ndarray:
        """The number of splitters below each key."""
        code, known = pd.factorize(source, use_na_sentinel=True)
        out = np.zeros(len(doc), np.int32)
        for c in np.unique(code):
            own = (False, "") if c < 0 else (True, known[c])
            rows = code == c
            at = bisect.bisect_left(self.sources, own)
            start = self.starts[at]
            if at == len(self.sources) or self.sources[at] != own:
                out[rows] = start
            else:
                out[rows] = np.where(blank[rows], start, start + self.blank[at] + np.searchsorted(self.numbers[at], doc[rows], side="left"))
        return out


def _shard(keys: list[tuple]):
    held = Splitters(keys)

    @F.pandas_udf("int")
    def find(source: pd.Series, doc: pd.Series, blank: pd.Series) -> pd.Series:
        return pd.Series(held.find(source, doc.to_numpy(), blank.to_numpy()))

    return find(F.col("source").cast("string"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), F.col("doc_id").isNull())


def _bytes() -> Column:
    return F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)).cast("long")


def splitters(docs: DataFrame, shards: int | None = None, oversample: int = OVERSAMPLE, slack: float = SLACK) -> list[tuple]:
    """The ascending upper keys of all shards but the last, overfull shards subdivided."""
    keys = table(docs.select(F.col("source").cast("string"), F.col("doc_id").cast("long"), _bytes().alias("b")))
    total = keys.agg(F.sum("b")).first()[0] or 0
    shards = shards or max(LEAST, math.ceil(total / SHARD_BYTES))
    unit = max(1, total // min(shards * oversample, max(SAMPLE, 2 * shards)))
    luck = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    drawn = keys.filter((F.col("b") >= unit) | (luck < F.col("b") / F.lit(float(unit)))).collect()
    drawn.sort(key=lambda r: _key(r["source"], r["doc_id"]))
    weights = [max(r["b"], unit) for r in drawn]
    whole, so_far, cuts = sum(weights), 0, []
    for r, w in zip(drawn, weights, strict=True):
        before, so_far = so_far, so_far + w
        # a cut where the weight first reaches a multiple of its share
        if so_far * shards // whole > before * shards // whole and so_far < whole:
            cuts.append(_key(r["source"], r["doc_id"]))
    cuts = sorted(set(cuts))
    placed = table(keys.withColumn("shard", _shard(cuts)))
    most = slack * total / shards
    sizes = placed.groupBy("shard").agg(F.sum("b").alias("held")).filter(F.col("held") > most).withColumn("parts", F.ceil(F.col("held") * shards / F.lit(max(1, total))))
    w = Window.partitionBy("shard").orderBy("source", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    part = F.floor(F.coalesce(F.sum("b").over(w), F.lit(0)) * F.col("parts") / F.col("held"))
    ends = placed.join(F.broadcast(sizes), "shard").withColumn("part", part).groupBy("shard", "part").agg(F.max(F.struct("source", "doc_id")).alias("k")).select("k.*")
    more = {_key(r["source"], r["doc_id"]) for r in ends.collect()}
    return sorted(more | set(cuts))


def range_shards(docs: DataFrame, shards: int | None = None, oversample: int = OVERSAMPLE, slack: float = SLACK) -> DataFrame:
    """``docs`` and the column ``shard``; every shard is one partition, sorted by (source, doc_id)."""
    cuts = splitters(docs, shards, oversample, slack)
    number = fresh("to", docs.columns)
    placed = docs.withColumn(number, _shard(cuts))
    placed = placed.repartitionById(len(cuts) + 1, F.col(number)).sortWithinPartitions("source", "doc_id")
    return placed.withColumn("shard", F.col(number).cast("long")).drop(number)


SQL = f"""
WITH k AS (SELECT *, coalesce(octet_length(encode(text)), 0) AS b FROM documents),
t0 AS (SELECT CAST(sum(b) AS BIGINT) AS total, greatest({LEAST}, CAST(ceil(sum(b) / {SHARD_BYTES}.0) AS BIGINT)) AS shards FROM k),
t AS (SELECT total, shards, greatest(1, total // least(shards * {OVERSAMPLE}, greatest({SAMPLE}, 2 * shards))) AS unit FROM t0),
drawn AS (SELECT source, doc_id, greatest(b, unit) AS w FROM k, t
  WHERE b >= unit OR CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE < b / unit::DOUBLE),
summed AS (SELECT source, doc_id, w, CAST(sum(w) OVER (ORDER BY source, doc_id) AS BIGINT) AS upto, CAST(sum(w) OVER () AS BIGINT) AS whole FROM drawn),
cuts AS (SELECT source AS s, doc_id AS d FROM summed, t WHERE upto * shards // whole > (upto - w) * shards // whole AND upto < whole),
first_try AS (SELECT k.doc_id, k.source, k.b, (SELECT count(*) FROM cuts WHERE (k.source, k.doc_id) > (s, d)) AS shard FROM k),
held AS (SELECT shard, CAST(sum(b) AS BIGINT) AS held, CAST(ceil(sum(b) * any_value(shards) / any_value(total)::DOUBLE) AS BIGINT) AS parts
  FROM first_try, t GROUP BY shard HAVING sum(b) > {SLACK} * any_value(total) / any_value(shards)),
parted AS (SELECT f.source, f.doc_id, f.shard, coalesce(sum(f.b) OVER (PARTITION BY f.shard ORDER BY f.source, f.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * parts // held AS part
  FROM first_try f JOIN held USING (shard)),
all_cuts AS (SELECT s, d FROM cuts UNION SELECT m.s, m.d FROM (SELECT max((source, doc_id)) AS x, x[1] AS s, x[2] AS d FROM parted GROUP BY shard, part) m)
SELECT doc_id, text, lang, source, n_chars, (SELECT count(*) FROM all_cuts WHERE (k.source, k.doc_id) > (s, d)) AS shard FROM k
"""
