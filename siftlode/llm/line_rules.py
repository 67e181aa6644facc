"""Cross-document line frequency: boilerplate lines of a host are removed, and documents that lose too much are rejected.

Lines are normalised (lower case, digit runs as 0, white space collapsed, trimmed) and hashed.  A line is boilerplate on a
host when more distinct documents of the host hold it than ``max_docs`` and than ``max_share`` of the host's documents.  A
document is rejected when less than ``min_kept`` of the characters of its non-blank lines are left.

Texts are read twice, a batch of bytes at a time: once for the hashes of their lines, of which only these are shuffled, and
once to be cleaned.  The hashes of boilerplate go to all tasks while they are few (``COMMON_ROWS``); beyond that, each document
is joined with those that it holds itself.

Defined results: the host of documents is ``source``, NULL being a host of its own; blank lines are never counted or removed;
a line in just as many documents as a limit says stays; a NULL text stays NULL, and it and a blank text are rejected (nothing
is left); rows without doc_id count for no line but are cleaned; rows of one doc_id count once; a very long text is cleaned
like any other; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .hashing import chunks, string_hashes
from .io import lookup, table

MAX_DOCS = 10
MAX_SHARE = 0.001
MIN_KEPT = 0.5
#: Boilerplate lines of all hosts that every task may hold, 8 bytes each.
COMMON_ROWS = 1_000_000


class Lines:
    """The lines of the texts of an Arrow array: hashes of their normal forms, characters, and the bounds of each text's."""

    def __init__(self, texts: pa.Array):
        known = np.asarray(pc.is_valid(texts))
        texts = pc.utf8_lower(pc.fill_null(texts, ""))
        kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
        _, offsets, data = texts.buffers()
        off = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
        b = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
        off = off - off[0]
        n = len(b)
        ends = np.flatnonzero(b == 10)
        # one line more than line feeds in every text that is not NULL
        before = np.searchsorted(ends, off)
        self.off = np.concatenate([[0], np.cumsum((np.diff(before) + 1) * known)])
        start = np.sort(np.concatenate([off[:-1][known], ends + 1]), kind="stable")
        stop = np.sort(np.concatenate([off[1:][known], ends]), kind="stable")
        first = np.zeros(n + 1, bool)
        first[start] = True
        first = first[:n]
        digit = (b >= 48) & (b <= 57)
        space = (b == 32) | ((b >= 9) & (b <= 13))  # line feeds too: as neighbours they are the edges of lines
        after = lambda x, edge: np.concatenate([[edge], x[:-1]])
        kept = ~space & ~(digit & after(digit, False) & ~first)
        # a run of spaces inside a line is one space: the last of it, with text of the line on both sides
        follows = np.concatenate([space[1:], [True]])
        last = np.zeros(n + 1, bool)
        last[stop] = True
        inner = np.flatnonzero(space & (b != 10) & ~follows & ~last[1:])
        solid = np.concatenate([[0], np.cumsum(~space)])
        line = np.searchsorted(start, inner, side="right") - 1
        kept[inner[solid[inner] > solid[start[line]]]] = True
        value = np.where(digit, np.uint8(48), np.where(space, np.uint8(32), b))[kept]
        at = np.concatenate([[0], np.cumsum(kept)])
        self.hash = string_hashes(value, at[start], at[stop])
        self.solid = at[stop] > at[start]
        letters = np.concatenate([[0], np.cumsum((b & 0xC0) != 0x80)])
        self.chars = letters[stop] - letters[start]


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, host, h): the distinct non-blank lines of every text."""
    for batch in batches:
        for a, b in chunks(batch.column(2)):
            x = Lines(batch.column(2).slice(a, b - a))
            doc = np.repeat(np.arange(b - a), np.diff(x.off))[x.solid]
            h = x.hash[x.solid]
            order = np.lexsort((h, doc))
            h, doc = h[order], doc[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
            own = pa.array(doc[new])
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a).take(own), batch.column(1).slice(a, b - a).take(own), pa.array(h[new].view(np.int64))], ["id", "host", "h"])


def line_hashes(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.col("doc_id").alias("id"), F.col("source").cast("string").alias("host"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_hashed, f"id {docs.schema['doc_id'].dataType.simpleString()}, host string, h long")


def boilerplate(docs: DataFrame, max_docs: int = MAX_DOCS, max_share: float = MAX_SHARE) -> DataFrame:
    """(host, h): the hashes of the boilerplate lines of each host."""
    hosts = docs.groupBy(F.col("source").cast("string").alias("of")).agg(F.countDistinct("doc_id").alias("docs"))
    counts = line_hashes(docs).groupBy("host", "h").agg(F.countDistinct("id").alias("n")).filter(F.col("n") > max_docs)
    return table(counts.join(hosts, F.col("host").eqNullSafe(F.col("of"))).filter(F.col("n") > F.col("docs") * F.lit(max_share)).select("host", "h"))


def _cleaned(min_kept: float, shared):
    """``shared``: the sorted hashes by host; None if every row brings its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = shared.value if shared is not None else None
        for batch in batches:
            for a, b in chunks(batch.column(2)):
                part = batch.slice(a, b - a)
                texts = part.column(2)
                x = Lines(texts)
                bad = np.zeros(len(x.hash), bool)
                if common is None:
                    for i, own in enumerate(part.column(3).to_pylist()):
                        if own:
                            bad[x.off[i] : x.off[i + 1]] = np.isin(x.hash[x.off[i] : x.off[i + 1]], np.array(own, np.int64).view(np.uint64))
                else:
                    host = part.column(1).dictionary_encode()
                    code = np.asarray(pc.fill_null(host.indices, len(host.dictionary)))
                    line = np.repeat(code, np.diff(x.off))
                    for c in np.unique(code):
                        own = common.get(host.dictionary[c].as_py() if c < len(host.dictionary) else None)
                        if own is not None:
                            some = np.flatnonzero(line == c)
                            near = np.searchsorted(own, x.hash[some])
                            near[near == len(own)] = 0
                            bad[some] = own[near] == x.hash[some]
                bad &= x.solid
                total = lambda v: (lambda s: s[x.off[1:]] - s[x.off[:-1]])(np.concatenate([[0], np.cumsum(v, dtype=np.int64)]))
                was, now, removed = total(x.chars * x.solid), total(x.chars * (x.solid & ~bad)), total(bad)
                out = texts
                hit = np.flatnonzero(removed)
                if len(hit):
                    new = []
                    for i in hit:
                        gone = bad[x.off[i] : x.off[i + 1]]
                        new.append("\n".join(y for y, z in zip(texts[i].as_py().split("\n"), gone, strict=True) if not z))
                    which = np.zeros(len(texts), bool)
                    which[hit] = True
                    out = pc.replace_with_mask(texts, pa.array(which), pa.array(new, texts.type))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), out, pa.array(total(x.solid)), pa.array(removed), pa.array((now > 0) & (now >= was * min_kept))], ["doc_id", "source", "text", "lines", "removed", "kept"])

    return run


def line_frequency_rules(docs: DataFrame, max_docs: int = MAX_DOCS, max_share: float = MAX_SHARE, min_kept: float = MIN_KEPT, common_rows: int = COMMON_ROWS) -> DataFrame:
    """(doc_id, source, text, lines, removed, kept) of every row: the cleaned text, its non-blank lines before, those removed, and whether the document is accepted."""
    common = boilerplate(docs, max_docs, max_share)
    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    if common.count() <= common_rows:
        held: dict = {}
        for r in common.collect():
            held.setdefault(r["host"], []).append(r["h"])
        shared = docs.sparkSession.sparkContext.broadcast({k: np.sort(np.array(v, np.int64).view(np.uint64)) for k, v in held.items()})
    else:
        shared = None
        nothing = F.lit("")  # NULL hosts meet too
        tagged = lambda df: df.select("*", F.coalesce("host", nothing).alias("name"), F.col("host").isNull().alias("none")).drop("host")
        own = lookup(tagged(line_hashes(docs)), tagged(common), ["name", "none", "h"]).groupBy("id", "name", "none").agg(F.collect_set("h").alias("bad"))
        rows = rows.join(own, F.col("doc_id").eqNullSafe(F.col("id")) & (F.coalesce("source", nothing) == F.col("name")) & (F.col("source").isNull() == F.col("none")), "left").select("doc_id", "source", "text", "bad")
    return rows.mapInArrow(_cleaned(min_kept, shared), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, source string, text string, lines long, removed long, kept boolean")


def drop_depleted(docs: DataFrame, max_docs: int = MAX_DOCS, max_share: float = MAX_SHARE, min_kept: float = MIN_KEPT) -> DataFrame:
    """The accepted documents (doc_id, source, text) with cleaned texts."""
    return line_frequency_rules(docs, max_docs, max_share, min_kept).filter("kept").select("doc_id", "source", "text")


SQL = rf"""
WITH l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
n AS (SELECT *, trim(regexp_replace(regexp_replace(lower(line), '[0-9]+', '0', 'g'), '[\x09-\x0d ]+', ' ', 'g')) AS norm FROM l),
hosts AS (SELECT source, count(DISTINCT doc_id) AS docs FROM documents GROUP BY source),
bad AS (SELECT n.source, norm FROM n JOIN hosts USING (source) WHERE norm <> '' GROUP BY n.source, norm, docs HAVING count(DISTINCT doc_id) > {MAX_DOCS} AND count(DISTINCT doc_id) > docs * {MAX_SHARE}),
marked AS (SELECT n.*, bad.norm IS NOT NULL AS cut FROM n LEFT JOIN bad ON n.source = bad.source AND n.norm = bad.norm),
whole AS (SELECT doc_id, source, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT cut), '') AS text, count(*) FILTER (norm <> '') AS lines,
  count(*) FILTER (cut) AS removed, coalesce(sum(length(line)) FILTER (norm <> ''), 0) AS was, coalesce(sum(length(line)) FILTER (norm <> '' AND NOT cut), 0) AS is_now FROM marked GROUP BY doc_id, source)
SELECT doc_id, source, text, lines, removed, (is_now > 0 AND is_now >= was * {MIN_KEPT}) AS kept FROM whole
"""
