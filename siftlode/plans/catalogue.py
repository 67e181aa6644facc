"""Every query of the search engine, by name, with the SQL that checks it.

All run over whole tables.  Where segments and deletions are needed, a document's segment is its number modulo 4, and those
whose number ends in 3 are deleted.  The relational operators take these as columns, a deletion being recorded in the segment
after the document's; the ``index_`` and segment queries build an index of four segments, and a fifth of the deletions.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.codec import vbyte_size
from ..functions.scoring import bm25, idf
from ..functions.text import UnicodeTokenizer, query_terms
from ..operators import compaction, index, retrieval
from .engine import Index

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

QUERY = "the of une para"
BOTH = "the and"
TERM = "the"

_WORDS = r"""words AS (SELECT doc_id AS num_id, coalesce(regexp_extract_all(lower(nfc_normalize(text)), '[\p{L}\p{M}\p{N}]+'), []) AS w FROM documents),
docs AS (SELECT num_id, CAST(len(w) AS BIGINT) AS dl, 's' || (num_id % 4) AS seg_id FROM words),
toks AS (SELECT num_id, unnest(w) AS term FROM words),
post AS (SELECT term, num_id, count(*) AS tf, any_value(dl) AS dl, any_value(seg_id) AS seg_id FROM toks JOIN docs USING (num_id) GROUP BY term, num_id),
tomb AS (SELECT num_id, 's' || ((num_id + 1) % 4) AS seg_id FROM docs WHERE num_id % 10 = 3),
live AS (SELECT * FROM post WHERE num_id NOT IN (SELECT num_id FROM tomb)),
stats AS (SELECT count(*) AS n, coalesce(sum(dl), 0) AS total, CASE WHEN sum(dl) > 0 THEN sum(dl) / count(*) ELSE 1.0 END AS avgdl FROM docs)"""


def query(name: str, sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = f"WITH {_WORDS} {sql}"
        return f

    return register


_made: list[tuple] = []


@atexit.register
def _clean() -> None:
    """Removes the folders of this process's queries."""
    for jvm, conf, folder in _made:
        try:
            where = jvm.org.apache.hadoop.fs.Path(folder)
            where.getFileSystem(conf).delete(where, True)
        except Exception:  # noqa: BLE001 - the session has ended, and with it the way to its files
            return


def _folder(spark: SparkSession) -> str:
    """A new folder in the shared folder, for as long as the process lasts; a temporary one only in a local session without it."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = f"{named.rstrip('/')}/index-{uuid.uuid4().hex}" if named else tempfile.mkdtemp(prefix="siftlode-index-")
    _made.append((spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), folder))
    return folder


_built: dict[tuple[str, str, bool], str] = {}


def built(spark: SparkSession, sf_dir: str, merged: bool = False) -> Index:
    """An index of all documents in four segments, then one of the deletions; ``merged``: compacted.

    It is built once for each session and opened, its checksums verified, each time.  The caller closes it.
    """
    key = (spark.sparkContext.applicationId, sf_dir, merged)
    if key not in _built:
        docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
        folder = _folder(spark)
        with Index.open(spark, folder, fanout=99) as x:
            for i in range(4):
                x.add_many(docs.filter(F.col("doc_id") % 4 == i))
            x.remove_many(docs.filter("doc_id % 10 = 3"))
            if merged:
                x.compact()
        _built[key] = folder
    return Index.open(spark, _built[key], fanout=99)


def _long(df: DataFrame) -> DataFrame:
    return df.withColumn("doc_id", F.col("doc_id").cast("long"))


class Corpus:
    """The relations of the index over one folder of tables."""

    def __init__(self, spark: SparkSession, sf_dir: str, min_len: int = 1):
        self.docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
        self.analyzed = index.analyze(self.docs, UnicodeTokenizer(min_len))
        self.seg = seg = F.concat(F.lit("s"), (F.col("num_id") % 4).cast("string"))
        self.lengths = index.doc_lengths(self.analyzed)
        self.segmented = self.lengths.withColumn("seg_id", seg)
        self.postings = index.postings(self.analyzed)
        self.rows = self.postings.withColumn("seg_id", seg)
        self.tombstones = self.docs.filter("doc_id % 10 = 3").select(F.col("doc_id").alias("num_id"), F.concat(F.lit("s"), ((F.col("doc_id") + 1) % 4).cast("string")).alias("seg_id"))

    def of(self, terms: Sequence[str]) -> DataFrame:
        return index.postings(self.analyzed, terms).withColumn("seg_id", self.seg)


# text

_TOKENS = "SELECT num_id AS doc_id, CAST(pos AS BIGINT) AS pos, token FROM (SELECT num_id, unnest(w) AS token, generate_subscripts(w, 1) AS pos FROM {}) {}"


@query("tokenize", _TOKENS.format("words", ""))
def _(spark, d):
    return Corpus(spark, d).analyzed.select(F.col("num_id").alias("doc_id"), F.posexplode("tokens").alias("pos", "token")).select("doc_id", (F.col("pos") + 1).cast("long").alias("pos"), "token")


@query("tokenize_minlen", _TOKENS.format("(SELECT num_id, list_filter(w, lambda t: len(t) >= 3) AS w FROM words)", ""))
def _(spark, d):
    return Corpus(spark, d, 3).analyzed.select(F.col("num_id").alias("doc_id"), F.posexplode("tokens").alias("pos", "token")).select("doc_id", (F.col("pos") + 1).cast("long").alias("pos"), "token")


# index

query("term_freq", "SELECT num_id, term, tf FROM post")(lambda spark, d: Corpus(spark, d).postings.select("num_id", "term", "tf"))
query("doc_lengths", "SELECT num_id, dl FROM docs")(lambda spark, d: Corpus(spark, d).lengths)
query("term_dictionary", "SELECT term, count(*) AS df FROM post GROUP BY term")(lambda spark, d: index.dictionary(Corpus(spark, d).postings).orderBy("term"))
query("corpus_stats", "SELECT n AS total_docs, CAST(total AS BIGINT) AS total_len, round(avgdl, 6) AS avgdl FROM stats")(lambda spark, d: index.corpus_stats(Corpus(spark, d).lengths).withColumn("avgdl", F.round("avgdl", 6)))


@query("seg_scan", "SELECT term, num_id AS doc_id, tf, dl, CASE seg_id WHEN 's0' THEN '000000' ELSE '000002' END AS seg_id FROM post WHERE seg_id IN ('s0', 's2')")
def _(spark, d):
    with built(spark, d) as x:
        rows, names = (x.table(t).filter("seg_id IN ('000000', '000002')") for t in ("postings", "names"))
        return rows.join(names.select("num_id", "doc_id"), "num_id").select("term", F.col("doc_id").cast("long").alias("doc_id"), "tf", "dl", "seg_id")


query("term_postings", f"SELECT num_id, tf FROM post WHERE term = '{TERM}'")(lambda spark, d: Corpus(spark, d).of([TERM]).select("num_id", "tf").orderBy("num_id"))
query("term_postings_packed", "SELECT term, list(num_id ORDER BY num_id) AS doc_ids, list(tf ORDER BY num_id) AS tfs FROM post GROUP BY term")(lambda spark, d: index.packed(Corpus(spark, d).postings))
query("docid_alloc", "SELECT doc_id, text, CAST(row_number() OVER (ORDER BY doc_id) + 99 AS BIGINT) AS num_id FROM documents")(lambda spark, d: index.number_documents(Corpus(spark, d).docs.select("doc_id", "text"), _folder(spark), 100))

_LOG = """, log AS (SELECT num_id * 2 AS seq, 'add' AS op, source AS doc_id, num_id FROM (SELECT doc_id AS num_id, source FROM documents)
UNION ALL SELECT doc_id * 2 + 1, 'rm', source, doc_id FROM documents WHERE doc_id % 7 = 0)"""


@query("docid_replay", _LOG + " SELECT doc_id, num_id FROM (SELECT doc_id, arg_max(op, seq) AS op, arg_max(num_id, seq) AS num_id FROM log GROUP BY doc_id) WHERE op = 'add'")
def _(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("num_id"), F.col("source").alias("doc_id"))
    log = docs.select((F.col("num_id") * 2).alias("seq"), F.lit("add").alias("op"), "doc_id", "num_id").unionByName(docs.filter("num_id % 7 = 0").select((F.col("num_id") * 2 + 1).alias("seq"), F.lit("rm").alias("op"), "doc_id", "num_id"))
    return index.replay_names(log)


# codec

query("postings_delta", "SELECT term, num_id, tf, num_id - lag(num_id, 1, 0) OVER (PARTITION BY term ORDER BY num_id) AS delta FROM post")(lambda spark, d: index.deltas(Corpus(spark, d).postings))
query("postings_undelta", "SELECT term, num_id, tf, num_id AS restored FROM post")(lambda spark, d: index.undeltas(index.deltas(Corpus(spark, d).postings)))
_SIZE = "(CASE WHEN {0} < 128 THEN 1 WHEN {0} < 16384 THEN 2 WHEN {0} < 2097152 THEN 3 WHEN {0} < 268435456 THEN 4 ELSE 5 END)"
_GAPS = ", gaps AS (SELECT term, seg_id, tf, num_id - lag(num_id, 1, 0) OVER (PARTITION BY term ORDER BY num_id) AS delta FROM post)"


@query("vbyte_size", f"{_GAPS} SELECT term, CAST({_SIZE.format('count(*)')} + sum({_SIZE.format('delta')} + {_SIZE.format('tf')}) AS BIGINT) AS bytes FROM gaps GROUP BY term")
def _(spark, d):
    gaps = index.deltas(Corpus(spark, d).postings)
    return gaps.groupBy("term").agg((vbyte_size(F.count("*")) + F.sum(vbyte_size(F.col("delta")) + vbyte_size(F.col("tf")))).alias("bytes"))


@query("crc_check")
def _(spark, d):
    return Corpus(spark, d).docs.select("doc_id", F.crc32(F.col("text").cast("binary")).alias("crc"))


# lookups

query("term_lookup", f"SELECT term, count(*) AS df FROM post WHERE term IN ('{TERM}', 'une', 'nosuchterm') GROUP BY term")(lambda spark, d: index.dictionary(Corpus(spark, d).of([TERM, "une", "nosuchterm"])))


@query("doc_len_lookup", "SELECT a.vec_id AS num_id, coalesce(dl, 0) AS dl FROM embeddings a LEFT JOIN docs ON docs.num_id = a.vec_id")
def _(spark, d):
    asked = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("num_id"))
    return asked.join(Corpus(spark, d).lengths, "num_id", "left").select("num_id", F.coalesce("dl", F.lit(0)).cast("long").alias("dl"))


@query("tombstone_check", "SELECT num_id AS doc_id, num_id % 10 = 3 AS deleted FROM docs")
def _(spark, d):
    with built(spark, d) as x:
        dead = x.table("tombstones").select("num_id", F.lit(True).alias("hit"))
        return x.table("names").join(dead, "num_id", "left").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("hit", F.lit(False)).alias("deleted"))


query("postings_seek", f"SELECT num_id, tf FROM post WHERE term = '{TERM}' AND num_id >= 100")(lambda spark, d: retrieval.seek(Corpus(spark, d).rows, TERM, 100))

# segments and deletions


@query("multi_segment_postings", ", twice AS (SELECT * FROM post UNION ALL SELECT term, num_id, tf, dl, 's9' FROM post WHERE num_id % 5 = 0) SELECT term, num_id, CAST(sum(tf) AS BIGINT) AS tf, min(dl) AS dl, min(seg_id) AS seg_id FROM twice GROUP BY term, num_id")
def _(spark, d):
    rows = Corpus(spark, d).rows
    return retrieval.merged(rows.unionByName(rows.filter("num_id % 5 = 0").withColumn("seg_id", F.lit("s9"))), ["s0", "s1", "s2", "s3", "s9"])


@query("live_postings", "SELECT term, num_id, tf FROM live")
def _(spark, d):
    c = Corpus(spark, d)
    return retrieval.live(c.rows, c.tombstones).select("term", "num_id", "tf")


@query("remove_visible", f"SELECT num_id, dl FROM live WHERE term = '{TERM}'")
def _(spark, d):
    c = Corpus(spark, d)
    return retrieval.live(c.of([TERM]), c.tombstones).select("num_id", "dl")


@query("upsert_visible", ", new AS (SELECT conv_id, arg_max(coalesce(text, ''), turn) AS text FROM conversations GROUP BY conv_id) SELECT doc_id, text FROM documents WHERE doc_id NOT IN (SELECT conv_id FROM new) UNION ALL SELECT conv_id, text FROM new")
def _(spark, d):
    docs = Corpus(spark, d).docs.select("doc_id", "text")
    new = spark.read.parquet(f"{d}/conversations.parquet").groupBy(F.col("conv_id").alias("doc_id")).agg(F.max_by(F.coalesce("text", F.lit("")), "turn").alias("text"))
    return docs.join(new.select("doc_id"), "doc_id", "left_anti").unionByName(new)


_SEGMENTS = """, p AS (SELECT seg_id, count(*) AS postings, count(DISTINCT term) AS terms FROM post GROUP BY seg_id),
d AS (SELECT seg_id, count(*) AS docs, CAST(sum(dl) AS BIGINT) AS total_len FROM docs GROUP BY seg_id)
SELECT '00000' || seg_id[2:] AS seg_id, docs, total_len, coalesce(postings, 0) AS postings, coalesce(terms, 0) AS terms, CAST(0 AS BIGINT) AS tombstones, CAST(0 AS BIGINT) AS tier FROM d LEFT JOIN p USING (seg_id)
UNION ALL SELECT '000004', 0, 0, 0, 0, count(*), 0 FROM tomb HAVING count(*) > 0"""


@query("segment_stats", _SEGMENTS)
def _(spark, d):
    with built(spark, d) as x:
        held = [x.table(t).groupBy("seg_id").agg(*a) for t, a in (("docs", [F.count("*").alias("docs"), F.sum("dl").alias("total_len")]), ("postings", [F.count("*").alias("postings"), F.countDistinct("term").alias("terms")]), ("tombstones", [F.count("*").alias("tombstones")]))]
        names = ["docs", "total_len", "postings", "terms", "tombstones"]
        return held[0].join(held[1], "seg_id", "outer").join(held[2], "seg_id", "outer").na.fill(0, names).select("seg_id", *names, F.lit(0).cast("long").alias("tier"))


@query("manifest_segments", _SEGMENTS)
def _(spark, d):
    with built(spark, d) as x:
        return spark.createDataFrame([(s.id, s.docs, s.total_len, s.postings, s.terms, s.deletes, s.tier) for s in x.manifest.segments], "seg_id string, docs long, total_len long, postings long, terms long, tombstones long, tier long")


@query("flush_segments", "SELECT seg_id, count(*) AS docs, CAST(sum(dl) AS BIGINT) AS total_len FROM (SELECT '00000' || (num_id % 2) AS seg_id, dl FROM docs) GROUP BY seg_id")
def _(spark, d):
    docs = Corpus(spark, d).docs
    with Index.open(spark, _folder(spark), fanout=99) as x:
        for i in range(2):
            x.add_many(docs.filter(F.col("doc_id") % 2 == i))
        return spark.createDataFrame([(s.id, s.docs, s.total_len) for s in x.manifest.segments], "seg_id string, docs long, total_len long")


@query("ingest_batches", "SELECT count(*) AS docs, CAST(sum(dl) AS BIGINT) AS total_len, CAST(1 AS BIGINT) AS segments, CAST(1 AS BIGINT) AS tier FROM docs")
def _(spark, d):
    docs = Corpus(spark, d).docs
    with Index.open(spark, _folder(spark), fanout=4) as x:
        for i in range(4):
            x.add_many(docs.filter(F.col("doc_id") % 4 == i), batch=i // 2, stream=f"s{i % 2}")
            x.add_many(docs.filter(F.col("doc_id") % 4 == i), batch=i // 2, stream=f"s{i % 2}")
        m = x.manifest
        return spark.createDataFrame([(m.total_docs, m.total_len, len(m.segments), max(s.tier for s in m.segments))], "docs long, total_len long, segments long, tier long")


# boolean

_IN = "('the', 'of', 'une', 'para')"


def _terms(spark: SparkSession, text: str) -> list[str]:
    return query_terms(spark, text)


query("or_query", f"SELECT num_id, count(*) AS matched, CAST(sum(tf) AS BIGINT) AS tf_sum FROM live WHERE term IN {_IN} GROUP BY num_id")(lambda spark, d: (lambda c, t: retrieval.or_query(retrieval.live(c.of(t), c.tombstones), t).orderBy("num_id"))(Corpus(spark, d), _terms(spark, QUERY)))
query("and_query", "SELECT num_id, count(*) AS matched, CAST(sum(tf) AS BIGINT) AS tf_sum FROM live WHERE term IN ('the', 'and') GROUP BY num_id HAVING count(*) = 2")(lambda spark, d: (lambda c, t: retrieval.and_query(retrieval.live(c.of(t), c.tombstones), t).orderBy("num_id"))(Corpus(spark, d), _terms(spark, BOTH)))

# ranking

_IDF = "ln((n - df + 0.5) / (df + 0.5) + 1)"


def _scored(terms: Sequence[str], rows: str = "post", stats: str = "stats", hits: str = "post", k1: float = 1.2, b: float = 0.75, need: int = 1, tail: str = "") -> str:
    listed = ", ".join(f"'{t}'" for t in dict.fromkeys(terms))
    return f""", df AS (SELECT term, count(*) AS df FROM {rows} WHERE term IN ({listed}) GROUP BY term),
parts AS (SELECT num_id, {_IDF} * tf * ({k1} + 1) / (tf + {k1} * (1 - {b} + {b} * dl / avgdl)) AS s FROM {hits} JOIN df USING (term), {stats}),
scored AS (SELECT num_id, round(sum(s), 6) AS score FROM parts GROUP BY num_id HAVING count(*) >= {need}) SELECT num_id, score FROM scored {tail}"""


def _search(name: str, text: str, limit: int | None = None, mode: str = "or", k1: float = 1.2, b: float = 0.75) -> None:
    terms = text.split()
    need = len(set(terms)) if mode == "and" else 1
    tail = f"ORDER BY score DESC, num_id LIMIT {limit}" if limit else ""

    @query(name, _scored(terms, k1=k1, b=b, need=need, tail=tail))
    def _(spark, d):
        c = Corpus(spark, d)
        return retrieval.search_documents(c.analyzed, _terms(spark, text), limit, mode, k1, b).withColumn("score", F.round("score", 6))


_search("bm25_or", QUERY)
_search("bm25_and", BOTH, mode="and")
_search("bm25_topk", QUERY, limit=10)
_search("bm25_k1_zero", QUERY, k1=0.0)
_search("bm25_b_zero", QUERY, b=0.0)
_search("bm25_b_one", QUERY, b=1.0)
_search("bm25_dup_terms", "the the of the")


@query("idf", f", df AS (SELECT term, count(*) AS df FROM post GROUP BY term) SELECT term, round({_IDF}, 6) AS idf FROM df, stats")
def _(spark, d):
    c = Corpus(spark, d)
    n = c.docs.count()
    return index.dictionary(c.postings).select("term", F.round(idf(F.col("df"), F.lit(n)), 6).alias("idf"))


@query("bm25_term_score", f", df AS (SELECT term, count(*) AS df FROM post WHERE term = '{TERM}' GROUP BY term) SELECT num_id, round({_IDF} * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)), 6) AS score FROM post JOIN df USING (term), stats")
def _(spark, d):
    c = Corpus(spark, d)
    n, total = c.lengths.agg(F.count("*"), F.sum("dl")).first()
    rows = c.of([TERM])
    df = rows.count()
    return rows.select("num_id", F.round(bm25(F.col("tf"), F.col("dl"), F.lit(df), F.lit(n), F.lit((total or 0) / n if total else 1.0)), 6).alias("score"))


@query("bm25_stale_stats", _scored(QUERY.split(), hits="live"))
def _(spark, d):
    c = Corpus(spark, d)
    return retrieval.search_documents(c.analyzed, _terms(spark, QUERY), tombstones=c.tombstones).withColumn("score", F.round("score", 6))


_LIVE_STATS = ", alive AS (SELECT count(*) AS n, CASE WHEN sum(dl) > 0 THEN sum(dl) / count(*) ELSE 1.0 END AS avgdl FROM docs WHERE num_id NOT IN (SELECT num_id FROM tomb))"


@query("bm25_after_compact", _LIVE_STATS + _scored(QUERY.split(), rows="live", stats="alive", hits="live"))
def _(spark, d):
    c = Corpus(spark, d)
    return retrieval.search_documents(compaction.merge_rows(c.analyzed, c.tombstones), _terms(spark, QUERY)).withColumn("score", F.round("score", 6))


# compaction

_FIRST = "num_id % 4 < 3"


@query("compact_postings", f"SELECT term, num_id, tf, dl FROM post WHERE {_FIRST} AND num_id NOT IN (SELECT num_id FROM tomb WHERE seg_id IN ('s0', 's1', 's2'))")
def _(spark, d):
    c = Corpus(spark, d)
    return compaction.merge_rows(c.rows.filter("seg_id IN ('s0', 's1', 's2')"), c.tombstones.filter("seg_id IN ('s0', 's1', 's2')")).select("term", "num_id", "tf", "dl")


@query("compact_tombstones", f"SELECT DISTINCT num_id FROM tomb WHERE seg_id IN ('s0', 's1', 's2') AND num_id NOT IN (SELECT num_id FROM docs WHERE {_FIRST})")
def _(spark, d):
    c = Corpus(spark, d)
    return compaction.unresolved(c.tombstones.filter("seg_id IN ('s0', 's1', 's2')"), c.segmented.filter("seg_id IN ('s0', 's1', 's2')"))


@query("compact_stats", "SELECT count(*) AS total_docs, CAST(sum(dl) AS BIGINT) AS total_len FROM docs WHERE num_id NOT IN (SELECT num_id FROM tomb)")
def _(spark, d):
    c = Corpus(spark, d)
    return index.corpus_stats(compaction.merge_rows(c.lengths, c.tombstones)).select("total_docs", "total_len")



def _tiers(parts: int):
    """The tiers of an index with a fan-out of two to which the documents come in so many parts."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        docs = Corpus(spark, d).docs
        with Index.open(spark, _folder(spark), fanout=2) as x:
            for i in range(parts):
                x.add_many(docs.filter(F.col("doc_id") % parts == i))
            held = spark.createDataFrame([(s.tier, s.docs, s.total_len) for s in x.manifest.segments], "tier long, docs long, total_len long")
        return held.groupBy("tier").agg(F.count("*").alias("segments"), F.sum("docs").alias("docs"), F.sum("total_len").alias("total_len"))

    return run


_TIERS = "SELECT CAST({} AS BIGINT) AS tier, CAST(1 AS BIGINT) AS segments, count(*) AS docs, CAST(sum(dl) AS BIGINT) AS total_len FROM docs GROUP BY tier"
query("tier_histogram", _TIERS.format("CASE WHEN num_id % 3 = 2 THEN 0 ELSE 1 END"))(_tiers(3))
query("tier_cascade", _TIERS.format("2"))(_tiers(4))


@query(
    "index_size_estimate",
    f""", gaps AS (SELECT term, seg_id, tf, num_id - lag(num_id, 1, 0) OVER (PARTITION BY seg_id, term ORDER BY num_id) AS delta FROM post),
lists AS (SELECT seg_id, term, {_SIZE.format('count(*)')} + sum({_SIZE.format('delta')} + {_SIZE.format('tf')}) AS b FROM gaps GROUP BY seg_id, term),
s AS (SELECT sum(b) + 80 * count(*) AS b FROM lists), d AS (SELECT 8 * count(*) AS b FROM docs), t AS (SELECT 4 * count(*) AS b FROM tomb)
SELECT CAST(s.b + d.b + t.b AS BIGINT) AS bytes FROM s, d, t""",
)
def _(spark, d):
    c = Corpus(spark, d)
    gap = F.col("num_id") - F.lag("num_id", 1, 0).over(index.Window.partitionBy("seg_id", "term").orderBy("num_id"))
    lists = c.rows.withColumn("delta", gap).groupBy("seg_id", "term").agg((vbyte_size(F.count("*")) + F.sum(vbyte_size(F.col("delta")) + vbyte_size(F.col("tf")))).alias("b"))
    sizes = lists.groupBy("seg_id").agg(F.sum("b").alias("postings_bytes"), F.count("*").alias("terms"))
    held = c.segmented.groupBy("seg_id").agg(F.count("*").alias("docs")).join(c.tombstones.groupBy("seg_id").agg(F.count("*").alias("tombstones")), "seg_id", "left").na.fill(0)
    return compaction.size_estimate(held.join(sizes, "seg_id", "left").na.fill(0))


# many queries, other corpora

_BATCH = r""", asked AS (SELECT query_id, term, min(pos) AS pos FROM (SELECT item_id AS query_id, unnest(w) AS term, generate_subscripts(w, 1) AS pos FROM (SELECT item_id, regexp_extract_all(lower(nfc_normalize(text)), '[\p{L}\p{M}\p{N}]+') AS w FROM benchmark)) GROUP BY query_id, term),
df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
parts AS (SELECT query_id, num_id, ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)) AS s FROM post JOIN asked USING (term) JOIN df USING (term), stats),
sums AS (SELECT query_id, num_id, sum(s) AS score FROM parts GROUP BY query_id, num_id),
ranked AS (SELECT query_id, num_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, num_id) AS rank FROM sums)
SELECT query_id, rank, num_id, round(score, 6) AS score FROM ranked WHERE rank <= 10"""


@query("batch_search", _BATCH)
def _(spark, d):
    c = Corpus(spark, d)
    asked = spark.read.parquet(f"{d}/benchmark.parquet").select(F.col("item_id").alias("query_id"), UnicodeTokenizer().column(F.col("text")).alias("terms"))
    return retrieval.batch_search(c.postings, c.lengths, asked).select("query_id", "rank", "num_id", F.round("score", 6).alias("score"))


_PARTS = r""", pw AS (SELECT p_partkey AS num_id, regexp_extract_all(lower(nfc_normalize(p_name)), '[\p{L}\p{M}\p{N}]+') AS w FROM part),
pp AS (SELECT num_id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT num_id, unnest(w) AS term, len(w) AS dl FROM pw) GROUP BY num_id, term),
ps AS (SELECT count(*) AS n, sum(len(w)) / count(*) AS avgdl FROM pw), asked AS (SELECT DISTINCT unnest(w) AS term FROM pw WHERE num_id = (SELECT min(num_id) FROM pw)),
df AS (SELECT term, count(*) AS df FROM pp GROUP BY term),
parts AS (SELECT num_id, ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)) AS s FROM pp JOIN asked USING (term) JOIN df USING (term), ps)
SELECT num_id, round(sum(s), 6) AS score FROM parts GROUP BY num_id"""


@query("search_parts", _PARTS)
def _(spark, d):
    analyzed = index.analyze(spark.read.parquet(f"{d}/part.parquet"), key="p_partkey", text="p_name")
    first = analyzed.orderBy("num_id").first()
    return retrieval.search(index.postings(analyzed), index.doc_lengths(analyzed), first["tokens"] if first else []).withColumn("score", F.round("score", 6))


# the index itself

_NAMED = "SELECT num_id AS doc_id, score FROM ({}) {}"
_BEST = "ORDER BY score DESC, doc_id % 4, CAST(doc_id AS VARCHAR) LIMIT 10"


def _ranked(name: str, sql: str, text: str, limit: int | None = None, mode: str = "or", merged: bool = False) -> None:
    with_, _, select = sql.rpartition(" SELECT num_id, score FROM scored")

    @query(name, f"{with_} {_NAMED.format('SELECT num_id, score FROM scored', _BEST if limit else '')}")
    def _(spark, d):
        with built(spark, d, merged) as x:
            return _long(x.search(text, limit, mode)).select("doc_id", F.round("score", 6).alias("score"))


_ranked("index_search", _scored(QUERY.split(), hits="live"), QUERY)
_ranked("index_search_and", _scored(BOTH.split(), hits="live", need=2), BOTH, mode="and")
_ranked("index_search_topk", _scored(QUERY.split(), hits="live"), QUERY, limit=10)
_ranked("index_after_compact", _LIVE_STATS + _scored(QUERY.split(), rows="live", stats="alive", hits="live"), QUERY, merged=True)


@query("index_after_remove", "SELECT num_id AS doc_id, tf, dl FROM live WHERE term = 'the'")
def _(spark, d):
    with built(spark, d) as x:
        rows = retrieval.live(x.table("postings").filter(F.col("term") == TERM), x.table("tombstones"))
        return _long(rows.join(x.table("names").select("num_id", "doc_id"), "num_id")).select("doc_id", "tf", "dl")


@query("index_reopen", "SELECT num_id AS doc_id, dl FROM docs WHERE num_id % 10 <> 3")
def _(spark, d):
    with built(spark, d) as x:
        return _long(x.names().join(x.table("docs").select("num_id", "dl"), "num_id")).select("doc_id", "dl")


@query(
    "index_batch_search",
    _BATCH.replace("post JOIN asked", "live JOIN asked").replace("ORDER BY round(score, 9) DESC, num_id", "ORDER BY round(score, 9) DESC, num_id % 4, CAST(num_id AS VARCHAR)").replace("rank, num_id, round", "rank, num_id AS doc_id, round"),
)
def _(spark, d):
    with built(spark, d) as x:
        asked = spark.read.parquet(f"{d}/benchmark.parquet").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
        return _long(x.batch_search(asked)).select("query_id", "rank", "doc_id", F.round("score", 6).alias("score"))
