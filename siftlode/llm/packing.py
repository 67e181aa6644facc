"""Packing of token sequences into optimal length buckets.

Texts become token ids by a public byte-level BPE vocabulary, whose file is a parameter.  The histogram of all lengths is
global and exact.  Dynamic programming over it chooses at most ``buckets`` boundaries so that padding every sequence to its
bucket's boundary costs the fewest tokens (divide and conquer over the monotone optimal cuts).  Inside a bucket, documents are
dealt by a hash to shards of about ``shard_batches`` batches, and each shard, in order of doc_id, is cut into batches of as many
sequences as the token budget holds at the bucket's boundary.

Texts are tokenized once, into a table; the sequences move once, to their shards, where batches lie in order.  The driver
holds the histogram: one number for each distinct length.

Defined results: a NULL or empty text is an empty sequence and joins the shortest bucket; a sequence longer than the budget is
a batch of its own, and is never cut; of two equal optimal cuts the shorter boundary wins; a NULL doc_id comes first in its
shard; repeated rows are packed as often as they occur; special tokens' strings are ordinary text; an empty table gives an
empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .hashing import chunks
from .io import table

BUCKETS = 8
BUDGET = 65_536
SHARD_BATCHES = 64
#: Ranks of a byte-level BPE, one to a line (the token in base 64, and its number), and the pattern that splits text before it.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def ranks_of(spark: SparkSession, vocabulary: str) -> bytes:
    """The vocabulary file, read by the session: from any file system that it knows, once."""
    return bytes(spark.read.format("binaryFile").load(vocabulary if ":" in vocabulary else f"file://{vocabulary}").select("content").first()[0])


@functools.cache
def encoder(ranks: bytes):
    import tiktoken

    return tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines()) if a}, special_tokens={})


def _tokenized(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(shared.value).encode_ordinary
        for batch in batches:
            for a, b in chunks(batch.column(1)):
                found = [np.array(encode(x) if x else [], np.int32) for x in batch.column(1).slice(a, b - a).to_pylist()]
                size = np.fromiter(map(len, found), np.int64, len(found))
                ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(np.concatenate(found)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(size), ids], ["doc_id", "n_tokens", "tokens"])

    return run


def tokenized(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens, tokens) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(ranks_of(docs.sparkSession, vocabulary))  # a file of fixed size
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_tokenized(shared), "doc_id long, n_tokens long, tokens array<int>")


def best_boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Ascending boundaries, the last one the longest length, that minimise the sum of padded lengths."""
    d = len(lengths)
    if not d:
        return []
    size = lengths.astype(np.int64)
    upto = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
    cost = np.concatenate([[0], size * upto[1:]])  # one bucket for the first j lengths
    cuts = []
    for k in range(1, min(buckets, d)):
        then, cut = np.full(d + 1, np.iinfo(np.int64).max // 2), np.zeros(d + 1, np.int64)
        todo = [(k + 1, d, k, d - 1)]
        while todo:
            low, high, first, last = todo.pop()
            if low > high:
                continue
            j = (low + high) // 2
            i = np.arange(first, min(j - 1, last) + 1)
            total = cost[i] + size[j - 1] * (upto[j] - upto[i])
            at = int(np.argmin(total))
            then[j], cut[j] = total[at], i[at]
            todo += [(low, j - 1, first, int(i[at])), (j + 1, high, int(i[at]), last)]
        cost = then
        cuts.append(cut)
    ends, j = [d], d
    for cut in reversed(cuts):
        j = int(cut[j])
        ends.append(j)
    return [int(size[e - 1]) for e in reversed(ends)]


def pack(docs: DataFrame, buckets: int = BUCKETS, budget: int = BUDGET, shard_batches: int = SHARD_BATCHES, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens, bucket, padded, shard, batch, slot, tokens) of every row: batches lie in order within their shards."""
    rows = table(tokenized(docs, vocabulary))
    histogram = sorted((r["n_tokens"], r["count"]) for r in rows.groupBy("n_tokens").count().collect())
    lengths, counts = np.array([x for x, _ in histogram], np.int64), np.array([x for _, x in histogram], np.int64)
    ends = best_boundaries(lengths, counts, buckets)
    held = [int(counts[(lengths <= e) & (lengths > b)].sum()) for b, e in zip([-1, *ends], ends)]
    bucket, padded, per, shards = (F.lit(0), F.lit(0).cast("long"), F.lit(1).cast("long"), F.lit(1).cast("long"))
    for i in reversed(range(len(ends))):
        here = F.col("n_tokens") <= ends[i]
        bucket = F.when(here, F.lit(i)).otherwise(bucket)
        padded = F.when(here, F.lit(ends[i]).cast("long")).otherwise(padded)
        fit = max(1, budget // max(1, ends[i]))
        per = F.when(here, F.lit(fit).cast("long")).otherwise(per)
        shards = F.when(here, F.lit(-(-held[i] // (fit * shard_batches)) or 1).cast("long")).otherwise(shards)
    # the hash of the tokens too: many rows of one doc_id, or of none, are no shard of their own
    placed = rows.select("doc_id", "n_tokens", "tokens", bucket.cast("long").alias("bucket"), padded.alias("padded"), per.alias("per"), F.pmod(F.xxhash64("doc_id", "tokens"), shards).alias("shard"))
    at = F.row_number().over(Window.partitionBy("bucket", "shard").orderBy("doc_id", "n_tokens", "tokens")).cast("long") - 1
    return placed.withColumn("at", at).select("doc_id", "n_tokens", "bucket", "padded", "shard", F.floor(F.col("at") / F.col("per")).alias("batch"), (F.col("at") % F.col("per")).alias("slot"), "tokens")
