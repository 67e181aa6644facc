"""The index as users see it: add, remove, flush, search, compact, over segments in a folder."""

from __future__ import annotations

import threading
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..errors import TokenizerMismatchError
from ..functions.scoring import B, K1
from ..functions.text import DEFAULT_TOKENIZER, Tokenizer, query_terms
from ..operators import compaction, index, retrieval
from ..sources import manifest as meta, segments
from ..sources.blobs import StorageBackend, backend_for
from ..sources.manifest import Manifest, SegmentEntry

FLUSH_THRESHOLD = 1000


class Index:
    """A full-text index: ``Index.open(spark, folder)``.

    Documents wait in a buffer until a flush makes them one segment.  ``add_many`` and ``remove_many`` take DataFrames and
    are the way for bulk; ``add`` and ``remove`` take single documents.  The manifest is the commit point; readers keep the
    segments of the manifest that they began with, and ``vacuum`` deletes those that no manifest names.

    Updates get a fresh number, so a deletion never meets a later version.  Until compaction, deleted documents count in
    the statistics (N, average length, df) but never appear in results.
    """

    def __init__(self, spark: SparkSession, folder: str, tokenizer: Tokenizer, flush_threshold: int, fanout: int, k1: float, b: float, before_manifest: Callable[[], None] | None, backend: StorageBackend | None = None):
        if flush_threshold < 1 or fanout < 2:
            raise ValueError("flush_threshold must be 1 or more and fanout 2 or more")
        self.spark, self.folder, self.tokenizer = spark, str(folder), tokenizer
        self.flush_threshold, self.fanout, self.k1, self.b = flush_threshold, fanout, k1, b
        self.backend = backend or backend_for(spark, folder)
        self._before, self._mutex, self._lock = before_manifest, threading.RLock(), meta.Lock(self.backend)
        self._buffer: dict[str, str] = {}
        self._removed: set[str] = set()
        self.manifest = Manifest(tokenizer=(tokenizer.kind, tokenizer.min_len))

    @classmethod
    def open(cls, spark: SparkSession, folder: str, tokenizer: Tokenizer = DEFAULT_TOKENIZER, flush_threshold: int = FLUSH_THRESHOLD, fanout: int = compaction.FANOUT, k1: float = K1, b: float = B, before_manifest: Callable[[], None] | None = None, verify: bool = True, backend: StorageBackend | None = None) -> Index:
        """The index of a folder (a path or a URI), made if there is none; one process at a time.

        ``backend`` keeps the manifest and the lock, in the same folder by default; ``verify`` checks every segment's checksums.
        """
        self = cls(spark, folder, tokenizer, flush_threshold, fanout, k1, b, before_manifest, backend)
        self._lock.acquire()
        try:
            held = meta.load(self.backend)
            if held is not None:
                if tuple(held.tokenizer) != self.manifest.tokenizer:
                    raise TokenizerMismatchError(str(held.tokenizer), str(self.manifest.tokenizer))
                self.manifest = held
                if verify and held.segments:
                    segments.verify(spark, self.folder, held.segments)
            self.recover()
        except BaseException:
            self._lock.release()
            raise
        return self

    def __enter__(self) -> Index:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    # what it holds

    @property
    def seg_ids(self) -> list[str]:
        return [s.id for s in self.manifest.segments]

    def doc_count(self) -> int:
        return self.manifest.total_docs

    def segment_count(self) -> int:
        return len(self.manifest.segments)

    def generation(self) -> int:
        return self.manifest.generation

    def buffered_count(self) -> int:
        return len(self._buffer)

    def estimated_bytes(self) -> int:
        """What the index would take in memory: postings, lengths, deletions, dictionaries, the buffer's terms, and both maps of names."""
        s = self.manifest.segments
        held = sum(x.postings_bytes + 8 * x.docs + 4 * x.deletes + 80 * x.terms for x in s)
        waiting = [self._buffer[k] for k in self._buffer]
        terms = 0
        if waiting:
            texts = self.spark.createDataFrame([(t,) for t in waiting], "text string")
            terms = texts.agg(F.sum(F.size(F.array_distinct(self.tokenizer.column(F.col("text")))))).first()[0] or 0
        return held + 64 * terms + 40 * len(self._removed) + 160 * sum(x.docs for x in s)

    def table(self, name: str) -> DataFrame:
        """The postings, docs or tombstones of the live segments, as of now."""
        return segments.read_table(self.spark, self.folder, name, self.seg_ids)

    def names(self) -> DataFrame:
        """(doc_id, num_id) of the documents in live segments that no deletion has met."""
        held = self.table("names").drop("seg_id")
        return retrieval.live(held, self.table("tombstones")) if any(s.deletes for s in self.manifest.segments) else held

    # changes

    def add(self, doc_id: str, text: str | None) -> None:
        """Adds a document or replaces the one of that name; at the threshold the buffer is flushed and tiers are merged."""
        with self._mutex:
            self._buffer.pop(doc_id, None)
            self._buffer[doc_id] = text or ""
            if len(self._buffer) >= self.flush_threshold:
                self.flush()
                self._cascade()

    def remove(self, doc_id: str) -> None:
        """Removes a document; an unknown name changes nothing."""
        with self._mutex:
            self._buffer.pop(doc_id, None)
            self._removed.add(doc_id)

    def add_many(self, docs: DataFrame, batch: int | None = None, stream: str = "", key: str = "doc_id", text: str = "text", order: str | None = None) -> None:
        """Adds the documents of a DataFrame as one segment; of several rows of one name the last stays.

        The last is the one of the greatest ``order``, or without that column the one that comes last in the DataFrame.
        Nothing passes through the driver.  A batch of a stream that the manifest has seen is skipped, so that a replayed
        micro-batch changes nothing.
        """
        with self._mutex:
            if batch is not None and batch <= dict(self.manifest.batches).get(stream, -1):
                return
            self.flush()
            at = F.monotonically_increasing_id() if order is None else F.col(order)
            given = docs.select(F.col(key).cast("string").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), at.alias("at")).filter("doc_id IS NOT NULL")
            # texts move once; what is written and read again from there on are the counted terms
            self._write(index.number_documents(given, f"{self._staging()}/numbered", self.manifest.next_num, last="at", made=self._counted), None, None if batch is None else (stream, batch))
            self._cascade()

    def remove_many(self, doc_ids: DataFrame, key: str = "doc_id") -> None:
        """Removes the documents that a DataFrame names, by a segment of deletions."""
        with self._mutex:
            self.flush()
            nothing = self.spark.createDataFrame([], "doc_id string, text string, num_id long")
            self._write(self._counted(nothing), doc_ids.select(F.col(key).cast("string").alias("doc_id")), None)

    def flush(self) -> None:
        """Makes a segment of what waits; a failure leaves the buffer as it was."""
        with self._mutex:
            if not self._buffer and not self._removed:
                return
            first = self.manifest.next_num
            docs = self.spark.createDataFrame([(name, text, first + i) for i, (name, text) in enumerate(self._buffer.items())], "doc_id string, text string, num_id long")
            removed = self.spark.createDataFrame([(x,) for x in sorted(self._removed)], "doc_id string") if self._removed else None
            self._write(self._counted(docs), removed, None)
            self._buffer, self._removed = {}, set()

    def _staging(self) -> str:
        return f"{self.folder}/staging/{self.manifest.next_segment:06d}"

    def _counted(self, docs: DataFrame) -> DataFrame:
        """``docs`` with the length and the counted terms of each text in its place."""
        found = docs.withColumn("tokens", self.tokenizer.column(F.col("text"))).drop("text")
        return index.counted(found.withColumn("dl", F.size("tokens").cast("long")))

    def _write(self, rows: DataFrame, removed: DataFrame | None, batch: tuple[str, int] | None) -> None:
        """One segment of numbered documents (doc_id, num_id, dl, terms), and the deletion of their earlier versions and of what was removed."""
        seg = f"{self.manifest.next_segment:06d}"
        named = rows.select("doc_id") if removed is None else rows.select("doc_id").unionByName(removed)
        dead = self.names().join(named.distinct(), "doc_id", "left_semi").select("num_id")
        expected = rows.agg(F.sum(F.size("terms"))).first()[0] or 0
        entry = segments.write_segment(self.spark, self.folder, seg, index.of_counted(rows), rows.select("num_id", "dl"), rows, dead, expected)
        if entry.docs or entry.deletes:
            self._commit((*self.manifest.segments, entry), entry.docs, batch)
        else:
            segments.drop_segment(self.spark, self.folder, seg)
        segments.remove(self.spark, f"{self.folder}/staging")

    def _commit(self, entries: tuple[SegmentEntry, ...], docs: int = 0, batch: tuple[str, int] | None = None) -> None:
        if self._before:
            self._before()
        old = self.manifest
        batches = old.batches if batch is None else tuple((dict(old.batches) | dict([batch])).items())
        new = replace(old, generation=old.generation + 1, segments=entries, next_segment=old.next_segment + 1, next_num=old.next_num + docs, batches=batches)
        self.backend.write(meta.MANIFEST, new.dump())
        self.manifest = new

    # compaction

    def compact(self) -> None:
        """Merges all segments into one; nothing to do for one or none."""
        with self._mutex:
            if len(self.manifest.segments) > 1:
                self._merge(list(range(len(self.manifest.segments))), max(s.tier for s in self.manifest.segments) + 1)

    def _cascade(self) -> None:
        """Merges tiers as long as there are targets; segments that go through several tiers are merged once, into the last."""
        now = [([s.id], s.tier) for s in self.manifest.segments]
        made: list[list[str]] = []
        while (chosen := compaction.choose_targets([t for _, t in now], self.fanout)) is not None:
            ids, tier = [x for i in chosen for x in now[i][0]], now[chosen[0]][1] + 1
            now = [(ids, tier)] + [x for i, x in enumerate(now) if i not in set(chosen)]
            made.append(ids)
        last = {tuple(ids): tier for ids, tier in now}
        for ids in made:
            if tuple(ids) in last:
                self._merge([i for i, s in enumerate(self.manifest.segments) if s.id in set(ids)], last[tuple(ids)])

    def _merge(self, positions: list[int], tier: int) -> None:
        old = self.manifest.segments
        chosen = [old[i] for i in positions]
        ids = [s.id for s in chosen]
        read = lambda t: segments.read_table(self.spark, self.folder, t, ids).drop("seg_id")
        dead = read("tombstones")
        whole = len(ids) == len(old)
        rest = read("tombstones").limit(0) if whole else compaction.unresolved(dead, read("docs"))
        seg = f"{self.manifest.next_segment:06d}"
        entry = segments.write_segment(self.spark, self.folder, seg, compaction.merge_rows(read("postings"), dead), compaction.merge_rows(read("docs"), dead), compaction.merge_rows(read("names"), dead), rest, sum(s.postings for s in chosen))
        gone = set(positions)
        self._commit((replace(entry, tier=tier), *(s for i, s in enumerate(old) if i not in gone)))

    def recover(self) -> None:
        """Deletes temporary blobs and files of segments that no commit ever named."""
        for name in self.backend.names():
            if name.endswith(".tmp"):
                self.backend.delete(name)
        for seg in segments.on_disk(self.spark, self.folder) - set(self.seg_ids):
            segments.drop_segment(self.spark, self.folder, seg)
        segments.remove(self.spark, f"{self.folder}/staging")

    vacuum = recover

    # queries

    def search(self, query: str, limit: int | None = None, mode: str = "or") -> DataFrame:
        """(doc_id, score), best first; a limit below 1 is none.  A removed document is gone at once, a new one comes with the flush."""
        terms = query_terms(self.spark, query, self.tokenizer)
        held = self.manifest
        if not terms or not held.total_docs:
            return self.spark.createDataFrame([], "doc_id string, score double")
        rows = self.table("postings").filter(F.col("term").isin(terms)).select("term", "num_id", "tf", "dl")
        df = {r["term"]: r["n"] for r in rows.groupBy("term").agg(F.count("*").alias("n")).collect()}
        top = retrieval.rank(retrieval.live(rows, self._dead()), terms, df, held.total_docs, held.total_len, limit, mode, self.k1, self.b)
        # the few documents of a limited search go to the names, not the other way round
        top = F.broadcast(top) if limit and 0 < limit <= retrieval.BROADCAST_TOP else top
        return self._visible(self.table("names").join(top, "num_id")).orderBy(F.desc("score"), "num_id").select("doc_id", "score")

    def batch_search(self, queries: DataFrame, limit: int | None = 10, mode: str = "or") -> DataFrame:
        """(query_id, rank, doc_id, score) for (query_id, query)."""
        asked = queries.select("query_id", self.tokenizer.column(F.col("query")).alias("terms"))
        found = retrieval.batch_search(self.table("postings").drop("seg_id"), None, asked, limit, mode, self.k1, self.b, self._dead(), (self.manifest.total_docs, self.manifest.total_len))
        return self._visible(self.table("names").join(found, "num_id")).select("query_id", "rank", "doc_id", "score")

    def _dead(self) -> DataFrame | None:
        return self.table("tombstones") if any(s.deletes for s in self.manifest.segments) else None

    def _visible(self, hits: DataFrame) -> DataFrame:
        """Hits whose documents have neither been removed nor replaced since the last flush."""
        hidden = self._removed | set(self._buffer)
        return hits.join(F.broadcast(self.spark.createDataFrame([(x,) for x in sorted(hidden)], "doc_id string")), "doc_id", "left_anti") if hidden else hits

    def close(self) -> None:
        """Flushes, keeps the names and lets other processes in."""
        with self._mutex:
            try:
                if self._lock.held:
                    self.flush()
            finally:
                self._lock.release()
