"""Repeated passages by a depth-limited radix sort of suffixes, most significant digit first.

Every token position begins a suffix, of which only the first ``depth`` tokens matter.  The sort refines groups of suffixes
digit by digit (a digit is two tokens, by 32-bit hashes): in a group whose suffixes agree in the next digit nothing moves, any
other is ordered by it and divided, and a group of one is finished at once.  After ``depth`` tokens, groups are exactly the
windows that occur more than once (16 bits of a hash of the whole window are the last digit, against collisions of tokens).

One task cannot hold all suffixes, so these are dealt out first by a digit that is a function of the whole window: the least
hash of a short n-gram in it.  Equal windows share it, and neighbouring windows mostly do too: a run of them travels as one
row of token hashes, in one shuffle, and a task sorts the runs of its share of these digits.  Digits that more than ``HOT``
windows share, which would fill a task, are found by a count over all windows.  Their windows are divided by their own next
digits (the halves of the window, 64 bits each) and counted with partial sums before the shuffle, so that thousands of
documents with one passage meet as a few counts.

Tokens are runs of non-white-space characters, compared as written.

Defined results: NULL texts and texts shorter than ``depth`` tokens have no windows; rows without doc_id take no part; each of
several texts under one doc_id has its own ranges; repeated rows count once; a window that occurs twice in one document is
repeated; of equal windows the first, by doc_id and position, is the original and the others are copies; a very long text has
as many runs as it needs; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from .hashing import SPACE, Tokens, binaries, chunks, mix, signed
from .io import lookup, table

DEPTH = 50
GRAM = 8
#: Bytes of text whose windows one sorting task takes.
TASK_BYTES = 16 << 20
#: Windows with one first digit from which they are counted apart.
HOT = 500_000


class Windows:
    """The windows of the texts of a batch: where they begin, their texts, first digits and hashes."""

    def __init__(self, texts: pa.Array, depth: int, gram: int):
        t = self.tokens = Tokens(texts, SPACE)
        self.hash, self.at = t.windows(depth)
        grams, where = t.windows(gram)
        least = np.full(len(t.hash), np.uint64(0xFFFFFFFFFFFFFFFF))
        least[where] = grams
        width, have = depth - gram + 1, 1
        while have < width:  # least over windows of growing width
            step = min(have, width - have)
            least[: len(least) - step] = np.minimum(least[: len(least) - step], least[step:])
            have += step
        self.digit = least[self.at]
        self.doc = np.searchsorted(t.off, self.at, side="right") - 1
        self.place = self.at - t.off[self.doc]

    def versions(self) -> np.ndarray:
        """A hash of every text's tokens in their places."""
        t = self.tokens
        total = np.concatenate([[np.uint64(0)], np.cumsum(mix(t.hash + (np.arange(len(t.hash)) - np.repeat(t.off[:-1], np.diff(t.off))).astype(np.uint64)))])
        return total[t.off[1:]] - total[t.off[:-1]]


def _each(batches: Iterator[pa.RecordBatch], depth: int, gram: int) -> Iterator[tuple[pa.Array, Windows]]:
    for batch in batches:
        for a, b in chunks(batch.column(1)):
            w = Windows(batch.column(1).slice(a, b - a), depth, gram)
            if len(w.at):
                yield batch.column(0).slice(a, b - a), w


def _counts(depth: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, w in _each(batches, depth, gram):
            digit, n = np.unique(w.digit, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(signed(digit)), pa.array(n)], ["digit", "n"])

    return run


def _runs(depth: int, gram: int, tasks: int, hot: np.ndarray):
    """Runs of windows with one first digit that is not hot: (task, digit, doc_id, version, start, data).

    ``data`` holds 4 bytes for each token that the run's windows cover and 2 for each window.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, w in _each(batches, depth, gram):
            new = np.ones(len(w.at), bool)
            new[1:] = (w.digit[1:] != w.digit[:-1]) | (w.doc[1:] != w.doc[:-1])
            first = np.flatnonzero(new)
            size = np.diff(np.append(first, len(w.at)))
            cold = ~np.isin(w.digit[first], hot)
            first, size = first[cold], size[cold]
            if not len(first):
                continue
            # two-byte words: of each run, its tokens and then its windows
            words = 2 * (size + depth - 1) + size
            bounds = np.concatenate([[0], np.cumsum(words)])
            data = np.empty(bounds[-1], np.uint16)
            tokens = (w.tokens.hash >> np.uint64(32)).astype(np.uint32).view(np.uint16)
            covered = 2 * (size + depth - 1)
            inside = np.arange(covered.sum()) - np.repeat(np.cumsum(covered) - covered, covered)
            data[np.repeat(bounds[:-1], covered) + inside] = tokens[np.repeat(2 * w.at[first], covered) + inside]
            inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            data[np.repeat(bounds[:-1] + covered, size) + inside] = w.hash[np.repeat(first, size) + inside].astype(np.uint16)
            doc = w.doc[first]
            columns = [
                pa.array((mix(w.digit[first]) % np.uint64(tasks)).astype(np.int32)),
                pa.array(signed(w.digit[first])),
                ids.take(pa.array(doc)),
                pa.array(signed(w.versions()[doc])),
                pa.array(w.place[first].astype(np.int32)),
                binaries(data, bounds),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["task", "digit", "doc_id", "version", "start", "data"])

    return run


_RUNS = "task int, digit long, doc_id long, version long, start int, data binary"
_PARTS = "doc_id long, version long, start int, windows int, copies int"
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("version", pa.int64()), ("start", pa.int32()), ("windows", pa.int32()), ("copies", pa.int32())])


def radix_groups(group: np.ndarray, digit_of, digits: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes that share their group and all their digits with another, and their groups in the end, ascending.

    ``group``: the group of every suffix before the first digit; ``digit_of(suffixes, k)``: their k-th digits.
    """
    index = np.argsort(group, kind="stable")
    new = np.ones(len(index), bool)
    new[1:] = group[index[1:]] != group[index[:-1]]
    for k in range(-1, digits):
        if k >= 0:
            digit = digit_of(index, k)
            first = np.flatnonzero(new)
            number = np.cumsum(new) - 1
            differs = digit != digit[first[number]]
            if differs.any():
                mixed = np.zeros(len(first), bool)
                mixed[number[differs]] = True
                some = np.flatnonzero(mixed[number])
                order = some[np.lexsort((digit[some], number[some]))]
                index[some], digit[some] = index[order], digit[order]
                new[1:] |= digit[1:] != digit[:-1]
        first = np.flatnonzero(new)
        alone = np.zeros(len(index), bool)
        alone[first[np.diff(np.append(first, len(index))) == 1]] = True
        index, new = index[~alone], new[~alone]
        if not len(index):
            break
    return index, np.cumsum(new) - 1


def _sorted(depth: int):
    """The stretches of repeated windows of every run of one task: (doc_id, version, start, windows, copies)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        rows = pa.Table.from_batches(held)
        digit, doc, version, start = (rows.column(c).to_numpy() for c in ("digit", "doc_id", "version", "start"))
        words = np.asarray(pc.binary_length(rows.column("data"))).astype(np.int64) // 2
        data = np.concatenate([np.frombuffer(c.buffers()[2], np.uint8)[slice(*_span(c))] for c in rows.column("data").chunks]).view(np.uint16)
        del rows, held
        size = (words - 2 * (depth - 1)) // 3
        before = np.cumsum(words) - words
        owner = np.repeat(np.arange(len(size), dtype=np.int32), size)
        inside = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
        token = np.repeat(before, size) + 2 * inside
        check = np.repeat(before + 2 * (size + depth - 1), size) + inside
        passes = -(-depth // 2)

        def digit_of(suffixes: np.ndarray, k: int) -> np.ndarray:
            if k == passes:
                return data[check[suffixes]].astype(np.uint64)
            at = token[suffixes] + 4 * k
            out = data[at].astype(np.uint64) | data[at + 1].astype(np.uint64) << np.uint64(16)
            if 2 * k + 1 < depth:
                out |= data[at + 2].astype(np.uint64) << np.uint64(32) | data[at + 3].astype(np.uint64) << np.uint64(48)
            return out

        index, group = radix_groups(digit[owner], digit_of, passes + 1)
        del data, token, check
        if not len(index):
            return
        # occurrences of a window by (doc_id, version, place); equal ones are repeated rows
        rank = np.empty(len(doc), np.int64)
        rank[np.lexsort((start, version, doc))] = np.arange(len(doc))
        place = start[owner] + inside
        order = index[np.lexsort((place[index], rank[owner[index]], group))]
        new = np.ones(len(order), bool)
        new[1:] = group[1:] != group[:-1]
        r, p = owner[order], place[order]
        again = np.zeros(len(order), bool)
        again[1:] = ~new[1:] & (doc[r[1:]] == doc[r[:-1]]) & (version[r[1:]] == version[r[:-1]]) & (p[1:] == p[:-1])
        several = np.bincount(group, weights=~again)[group] > 1
        repeated, copy = np.zeros(len(owner), bool), np.zeros(len(owner), bool)
        repeated[order] = several & ~again
        copy[order] = several & ~again & ~new
        # back in the order of runs: stretches of consecutive repeated windows
        edge = np.ones(len(owner), bool)
        edge[1:] = (owner[1:] != owner[:-1]) | (repeated[1:] != repeated[:-1])
        first = np.flatnonzero(edge)
        copies = np.add.reduceat(copy.astype(np.int32), first)
        length = np.diff(np.append(first, len(owner)))
        keep = repeated[first]
        first = first[keep]
        own = owner[first]
        yield pa.RecordBatch.from_arrays([pa.array(x.astype(t)) for x, t in ((doc[own], np.int64), (version[own], np.int64), (place[first], np.int32), (length[keep], np.int32), (copies[keep], np.int32))], schema=_SCHEMA)

    return run


def _span(chunk: pa.Array) -> tuple[int, int]:
    """The bytes of a binary chunk's data buffer that its values take."""
    off = np.frombuffer(chunk.buffers()[1], np.int64 if pa.types.is_large_binary(chunk.type) else np.int32)
    return int(off[chunk.offset]), int(off[chunk.offset + len(chunk)])


def _hot_windows(depth: int, gram: int, hot: np.ndarray):
    """Rows (first, second, doc_id, version, start) of windows with a hot digit: the hashes of both halves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        half = depth // 2
        for ids, w in _each(batches, depth, gram):
            some = np.flatnonzero(np.isin(w.digit, hot))
            if not len(some):
                continue
            halves = []
            for length, after in ((half, 0), (depth - half, half)):
                if not length:
                    halves.append(np.zeros(len(some), np.uint64))
                    continue
                h, at = w.tokens.windows(length)
                whole = np.zeros(len(w.tokens.hash), np.uint64)
                whole[at] = h
                halves.append(whole[w.at[some] + after])
            doc = w.doc[some]
            yield pa.RecordBatch.from_arrays([*(pa.array(signed(h)) for h in halves), ids.take(pa.array(doc)), pa.array(signed(w.versions()[doc])), pa.array(w.place[some].astype(np.int32))], ["first", "second", "doc_id", "version", "start"])

    return run


def _hot_parts(texts: DataFrame, depth: int, gram: int, hot: np.ndarray) -> DataFrame:
    """As the sorted parts, of the windows with a hot digit, one row for each."""
    rows = table(texts.mapInArrow(_hot_windows(depth, gram, hot), "first long, second long, doc_id long, version long, start int").distinct())
    place = F.struct("doc_id", "version", "start")
    groups = table(rows.groupBy("first", "second").agg(F.count("*").alias("n"), F.min(place).alias("least")).filter("n > 1").drop("n"))
    return lookup(rows, groups, ["first", "second"]).select("doc_id", "version", "start", F.lit(1).alias("windows"), F.when(place == F.col("least"), 0).otherwise(1).alias("copies"))


def repeated_passages(docs: DataFrame, depth: int = DEPTH, gram: int = GRAM) -> DataFrame:
    """Every maximal range of tokens that repeated windows cover: (doc_id, start_token, tokens, windows, copies).

    ``windows``: repeated windows of ``depth`` tokens in the range; ``copies``: those of them that occur earlier, in the
    order of (doc_id, position), so that a range with copies = windows can be cut without losing the passage.
    """
    gram = min(gram, depth)
    texts = docs.filter("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    held = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tasks = max(1, math.ceil(held / TASK_BYTES))
    # no more digits than windows / HOT, so about as many as there are tasks
    often = texts.mapInArrow(_counts(depth, gram), "digit long, n long").groupBy("digit").agg(F.sum("n").alias("n")).filter(F.col("n") > HOT).select("digit").collect()
    hot = np.sort(np.array([r["digit"] for r in often], np.int64).view(np.uint64))
    parts = texts.mapInArrow(_runs(depth, gram, tasks, hot), _RUNS).repartitionById(tasks, F.col("task")).mapInArrow(_sorted(depth), _PARTS)
    if len(hot):
        parts = parts.unionByName(_hot_parts(texts, depth, gram, hot))
    w = Window.partitionBy("doc_id", "version").orderBy("start")
    reach = F.max(F.col("start") + F.col("windows") - 1 + depth).over(w.rowsBetween(Window.unboundedPreceding, -1))
    ranges = parts.withColumn("new", F.when(F.col("start") <= reach, 0).otherwise(1)).withColumn("range", F.sum("new").over(w))
    return (
        ranges.groupBy("doc_id", "version", "range")
        .agg(F.min("start").alias("start_token"), (F.max(F.col("start") + F.col("windows")) - 1 + depth - F.min("start")).alias("tokens"), F.sum("windows").alias("windows"), F.sum("copies").alias("copies"))
        .select("doc_id", F.col("start_token").cast("long"), F.col("tokens").cast("long"), F.col("windows").cast("long"), F.col("copies").cast("long"))
    )


SQL = r"""
WITH words AS (SELECT doc_id, regexp_extract_all(text, '[^\x09-\x0d ]+') AS w FROM documents),
windows AS (SELECT doc_id, i - 1 AS start, md5(array_to_string(w[i:i + 49], ' ')) AS k
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM words WHERE len(w) >= 50)),
marked AS (SELECT doc_id, start, count(*) OVER (PARTITION BY k) AS n, row_number() OVER (PARTITION BY k ORDER BY doc_id, start) AS nth FROM windows),
repeated AS (SELECT doc_id, start, CAST(nth > 1 AS BIGINT) AS copy,
    CASE WHEN start <= lag(start) OVER (PARTITION BY doc_id ORDER BY start) + 50 THEN 0 ELSE 1 END AS new
  FROM marked WHERE n > 1),
ranges AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY start) AS r FROM repeated)
SELECT doc_id, min(start) AS start_token, max(start) + 50 - min(start) AS tokens, count(*) AS windows, CAST(sum(copy) AS BIGINT) AS copies
FROM ranges GROUP BY doc_id, r
"""
