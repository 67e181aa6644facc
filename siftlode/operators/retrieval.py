"""Boolean and ranked retrieval over postings (num_id, term, tf, dl[, seg_id])."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..functions.scoring import B, K1, bm25
from .index import postings
from .sizes import held_bytes

#: Bytes of a side that may be broadcast, by its measured widths; larger sides are shuffled.
BROADCAST_BYTES = 8 << 20
#: Documents of a limited search that go to the names, 24 bytes each.
BROADCAST_TOP = 100_000
#: Distinct terms of many queries that are a filter of the scan; beyond them postings and terms are joined.
FILTER_TERMS = 20_000
#: Rows (query, term), and best documents of all queries, up to which every task scores whole documents by itself.
HELD_TERMS, HELD_BEST = 500_000, 1_000_000
#: Postings, and cells of documents by queries, that are scored at a time.
SCORE_ROWS, SCORE_CELLS = 100_000, 1 << 20
#: Units of a fixed-point score.
FIXED = float(1 << 40)


def by_size(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if held_bytes(df) <= BROADCAST_BYTES else df


def live(rows: DataFrame, tombstones: DataFrame | None, key: str = "num_id") -> DataFrame:
    """The rows of documents that are not deleted in any segment."""
    return rows if tombstones is None else rows.join(tombstones.select(F.col(key)).distinct(), key, "left_anti")


def merged(rows: DataFrame, segments: Sequence[str] | None = None) -> DataFrame:
    """(term, num_id, tf, dl, seg_id): one row where several segments hold a document, from the first of them.

    With the names of all ``segments`` they are compared by their place, so that no row is sorted: strings can't be updated
    in a hash table.
    """
    if segments is not None:
        names = F.array(*[F.lit(x) for x in sorted(segments)])
        numbered = rows.withColumn("_seg", F.array_position(names, F.col("seg_id")).cast("int"))
        found = numbered.groupBy("term", "num_id").agg(F.sum("tf").alias("tf"), F.min_by("dl", "_seg").alias("dl"), F.min("_seg").alias("_seg"))
        return found.select("term", "num_id", "tf", "dl", F.element_at(names, F.col("_seg")).alias("seg_id"))
    return rows.groupBy("term", "num_id").agg(F.sum("tf").alias("tf"), F.min_by("dl", "seg_id").alias("dl"), F.min("seg_id").alias("seg_id"))


def seek(rows: DataFrame, term: str, least: int) -> DataFrame:
    """The postings of a term from a document on."""
    return rows.filter((F.col("term") == term) & (F.col("num_id") >= least)).select("num_id", "tf")


def or_query(rows: DataFrame, terms: Sequence[str]) -> DataFrame:
    """(num_id, matched, tf_sum) of documents that hold any of the terms."""
    hits = rows.filter(F.col("term").isin(list(dict.fromkeys(terms))))
    return hits.groupBy("num_id").agg(F.count("*").alias("matched"), F.sum("tf").alias("tf_sum"))


def and_query(rows: DataFrame, terms: Sequence[str]) -> DataFrame:
    """Those that hold all of them; no terms, no documents."""
    return or_query(rows, terms).filter(F.col("matched") == len(set(terms)))


def rank(rows: DataFrame, terms: Sequence[str], df: dict[str, int], total_docs: int, total_len: int, limit: int | None = None, mode: str = "or", k1: float = K1, b: float = B) -> DataFrame:
    """(num_id, score) of the documents that match, best first, ties by number.

    ``rows`` are live postings; df and the totals may count deleted documents until they are compacted away.  Terms count
    once, in their order, which is also the order of the sum.  A limit below 1 is none.  The aggregation shuffles one row
    for each hit, after partial sums; with a limit the sort keeps that many rows.
    """
    terms = list(dict.fromkeys(terms))
    if not terms or not total_docs:
        return rows.sparkSession.createDataFrame([], "num_id long, score double")
    avgdl = F.lit(total_len / total_docs if total_len > 0 else 1.0)
    hits = rows.filter(F.col("term").isin(terms) & (F.col("tf") != 0))
    parts = []
    for t in terms:
        s = bm25(F.col("tf"), F.col("dl"), F.lit(df.get(t, 0)), F.lit(total_docs), avgdl, k1, b)
        parts.append(F.max(F.when(F.col("term") == t, s)))
    score = F.lit(0.0)
    for i in range(len(terms)):
        score = score + F.coalesce(F.col(f"p{i}"), F.lit(0.0))
    found = hits.groupBy("num_id").agg(F.count("*").alias("matched"), *[p.alias(f"p{i}") for i, p in enumerate(parts)])
    if mode == "and":
        found = found.filter(F.col("matched") == len(terms))
    out = found.select("num_id", score.alias("score")).filter("score > 0").orderBy(F.desc("score"), "num_id")
    return out.limit(limit) if limit and limit > 0 else out


def search(rows: DataFrame, lengths: DataFrame, terms: Sequence[str], limit: int | None = None, mode: str = "or", k1: float = K1, b: float = B, tombstones: DataFrame | None = None) -> DataFrame:
    """``rank`` with the statistics of ``rows`` and ``lengths``, deleted documents included; these only leave the hits."""
    wanted = list(dict.fromkeys(terms))
    df = {r["term"]: r["n"] for r in rows.filter(F.col("term").isin(wanted)).groupBy("term").agg(F.count("*").alias("n")).collect()}
    n, total = lengths.agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first()
    hits = rows.filter(F.col("term").isin(wanted)) if wanted else rows
    return rank(live(hits, tombstones), wanted, df, n, total, limit, mode, k1, b)


def search_documents(analyzed: DataFrame, terms: Sequence[str], limit: int | None = None, mode: str = "or", k1: float = K1, b: float = B, tombstones: DataFrame | None = None) -> DataFrame:
    """A ranked search straight over analyzed documents (num_id, tokens, dl): one pass for all statistics, one for the hits."""
    wanted = list(dict.fromkeys(terms))
    held = [F.coalesce(F.sum(F.array_contains("tokens", t).cast("long")), F.lit(0)) for t in wanted]
    n, total, *df = analyzed.agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0)), *held).first()
    return rank(live(postings(analyzed, wanted), tombstones), wanted, dict(zip(wanted, df, strict=True)), n, total, limit, mode, k1, b)


def _best(off: np.ndarray, lists: np.ndarray, asked: np.ndarray, limit: int, every: bool):
    """Rows (q, num_id, sum): the ``limit`` best documents of each query among those of one task, ties by number.

    Takes (num_id, k, s), ordered by num_id: the share s of the k-th term, whose queries are ``lists[off[k] : off[k + 1]]``.
    Sums are integers, exact in any order.  ``every``: documents must hold all terms of a query.
    """
    n = len(asked)
    most = int(np.bincount(lists, minlength=1).max(initial=1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = np.ones(n, np.int64)  # below it a document is none of the best
        best = [np.zeros(0, np.int64)] * 3

        def scored(num, k, s) -> None:
            nonlocal best
            first = np.ones(len(num), bool)
            first[1:] = num[1:] != num[:-1]
            doc, docs = np.cumsum(first) - 1, num[first]
            many = off[k + 1] - off[k]
            at = np.repeat(off[k] - np.cumsum(many) + many, many) + np.arange(many.sum())
            cell = np.repeat(doc * n, many) + lists[at]
            s, size = np.repeat(s, many), len(docs) * n
            if most * int(s.max(initial=0)) < 1 << 53:
                total = np.bincount(cell, s, size).astype(np.int64)
            else:
                total = (np.bincount(cell, s >> 26, size).astype(np.int64) << 26) + np.bincount(cell, s & ((1 << 26) - 1), size).astype(np.int64)
            good = total.reshape(-1, n) >= least
            if every:
                good &= np.bincount(cell, minlength=size).reshape(-1, n) == asked
            d, q = np.nonzero(good)
            if len(d):
                q, num, total = (np.concatenate(x) for x in zip(best, (q, docs[d], total.reshape(-1, n)[d, q]), strict=True))
                order = np.lexsort((num, -total, q))
                q, num, total = q[order], num[order], total[order]
                rank = np.arange(len(q)) - np.searchsorted(q, q)
                best = [q[rank < limit], num[rank < limit], total[rank < limit]]
                least[q[rank == limit - 1]] = total[rank == limit - 1]

        def pieces(num, k, s) -> None:
            """By whole documents, as many as the cells allow."""
            ends = np.append(np.flatnonzero(num[1:] != num[:-1]) + 1, len(num))
            step, low = max(1, SCORE_CELLS // n), 0
            for i in range(min(step, len(ends)) - 1, len(ends) + step - 1, step):
                high = ends[min(i, len(ends) - 1)]
                if high > low:
                    scored(num[low:high], k[low:high], s[low:high])
                low = high

        held, size = [], 0
        for batch in batches:
            held.append([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)])
            size += batch.num_rows
            if size >= SCORE_ROWS:
                num, k, s = (np.concatenate(x) for x in zip(*held, strict=True))
                cut = int(np.searchsorted(num, num[-1]))  # the last document may go on in the next batch
                if cut:
                    pieces(num[:cut], k[:cut], s[:cut])
                held, size = [[num[cut:], k[cut:], s[cut:]]], len(num) - cut
        if size:
            pieces(*(np.concatenate(x) for x in zip(*held, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(best[0].astype(np.int32)), pa.array(best[1]), pa.array(best[2])], ["q", "num_id", "sum"])

    return run


def batch_search(rows: DataFrame, lengths: DataFrame | None, queries: DataFrame, limit: int | None = 10, mode: str = "or", k1: float = K1, b: float = B, tombstones: DataFrame | None = None, totals: tuple[int, int] | None = None) -> DataFrame:
    """(query_id, rank, num_id, score) for many queries (query_id, terms) at once.

    One scan for the postings of all query terms replaces one for each query; terms of a bounded number go to the scan as a
    filter, which skips row groups of sorted postings.  Only these postings are shuffled, by document: a task has all that
    scores its documents, and gives the best of them for each query, so pairs of a query and a document are never rows.
    Queries, or limits, too large to be held by every task are joined instead, with a row for each such pair.
    Scores are summed as fixed-point numbers, so that ties are exact in any order.
    ``totals``: documents and their summed length where they are known.
    """
    n, total = totals or lengths.agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first()
    wanted = queries.select("query_id", F.explode(F.array_distinct("terms")).alias("term"), F.size(F.array_distinct("terms")).alias("asked"))
    distinct = wanted.select("term").distinct()
    known = [r["term"] for r in distinct.limit(FILTER_TERMS + 1).collect()]
    avgdl = F.lit(total / n if total and n else 1.0)
    share = lambda df: F.round(bm25(F.col("tf"), F.col("dl"), df, F.lit(n), avgdl, k1, b) * FIXED).cast("long").alias("s")
    if known and len(known) <= FILTER_TERMS and limit and 0 < limit <= HELD_BEST:
        pairs = wanted.limit(HELD_TERMS + 1).collect()
        asked = {x: i for i, x in enumerate(dict.fromkeys((r["query_id"], r["asked"]) for r in pairs))}
        if len(pairs) <= HELD_TERMS and len(asked) * limit <= HELD_BEST:
            hits = rows.filter(F.col("term").isin(known))
            df = hits.groupBy("term").agg(F.count("*").alias("df")).collect()
            place = {r["term"]: i for i, r in enumerate(df)}
            found = sorted((place[r["term"]], asked[r["query_id"], r["asked"]]) for r in pairs if r["term"] in place)
            off = np.searchsorted([k for k, _ in found], np.arange(len(place) + 1))
            task = _best(off.astype(np.int64), np.array([q for _, q in found], np.int64), np.array([x for _, x in asked], np.int64), limit, mode == "and")
            spark = rows.sparkSession
            terms = spark.createDataFrame([(r["term"], place[r["term"]], r["df"]) for r in df], "term string, k int, df long")
            scored = hits.filter("num_id IS NOT NULL").join(F.broadcast(terms), "term").select("num_id", "k", share(F.col("df"))).repartition("num_id")
            best = live(scored, tombstones).select("num_id", "k", "s").sortWithinPartitions("num_id").mapInArrow(task, "q int, num_id long, sum long")
            names = spark.createDataFrame([(x, i) for (x, _), i in asked.items()], StructType([wanted.schema["query_id"], StructField("q", IntegerType())]))
            return _ranked(best.join(F.broadcast(names), "q").select("query_id", "num_id", "sum"), limit)
    if len(known) <= FILTER_TERMS:
        hits = rows.filter(F.col("term").isin(known)) if known else rows.limit(0)
        df = F.broadcast(hits.groupBy("term").agg(F.count("*").alias("df")))
        wanted = by_size(wanted)
    else:
        hits = rows.join(by_size(distinct), "term")
        df, wanted = by_size(hits.groupBy("term").agg(F.count("*").alias("df"))), by_size(wanted)
    scored = live(hits, tombstones).join(df, "term").select("term", "num_id", share(F.col("df")))
    both = scored.join(wanted, "term").groupBy("query_id", "num_id", "asked").agg(F.count("*").alias("matched"), F.sum("s").alias("sum"))
    if mode == "and":
        both = both.filter(F.col("matched") == F.col("asked"))
    return _ranked(both.filter("sum > 0").select("query_id", "num_id", "sum"), limit)


def _ranked(sums: DataFrame, limit: int | None) -> DataFrame:
    out = sums.select("query_id", "num_id", (F.col("sum") / FIXED).alias("score"))
    ranked = out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "num_id")).cast("long"))
    return ranked.filter(F.col("rank") <= limit) if limit and limit > 0 else ranked


def literal_queries(spark: SparkSession, texts: dict[int, Sequence[str]]) -> DataFrame:
    return spark.createDataFrame([(k, list(v)) for k, v in texts.items()], "query_id long, terms array<string>")
