"""Segments as Parquet: ``postings`` sorted by term, ``docs``, ``names`` and ``tombstones``, each partitioned by seg_id."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.errors import AnalysisException

from ..errors import MappingCorruptionError, SegmentCorruptionError, StoreError
from .manifest import SegmentEntry

SCHEMAS = {
    "postings": "term string, num_id long, tf long, dl long",
    "docs": "num_id long, dl long",
    "tombstones": "num_id long",
    "names": "doc_id string, num_id long",
}
#: Postings that one file of a segment holds; files divide the range of terms.
FILE_POSTINGS = 2_000_000
#: The longest term, in bytes.
TERM_BYTES = 65_535


def segment_path(root: str, table: str, seg_id: str) -> str:
    return f"{root.rstrip('/')}/{table}/seg_id={seg_id}"


def write_segment(spark: SparkSession, root: str, seg_id: str, postings: DataFrame, docs: DataFrame, names: DataFrame, tombstones: DataFrame, expected_postings: int) -> SegmentEntry:
    """Writes one immutable segment; its entry for the manifest, of tier 0, measured on what was written.

    Postings are range-partitioned over as many files as they are expected to fill and sorted by (term, num_id), so that a
    term's row groups are found by their statistics.
    """
    files = max(1, -(-expected_postings // FILE_POSTINGS))
    rows = postings.select("term", "num_id", F.col("tf").cast("long").alias("tf"), F.col("dl").cast("long").alias("dl"))
    rows.repartitionByRange(files, "term", "num_id").sortWithinPartitions("term", "num_id").write.mode("overwrite").parquet(segment_path(root, "postings", seg_id))
    docs.select("num_id", F.col("dl").cast("long").alias("dl")).write.mode("overwrite").parquet(segment_path(root, "docs", seg_id))
    names.select("doc_id", "num_id").write.mode("overwrite").parquet(segment_path(root, "names", seg_id))
    tombstones.select("num_id").distinct().coalesce(1).write.mode("overwrite").parquet(segment_path(root, "tombstones", seg_id))
    held = {t: read_table(spark, root, t, [seg_id]) for t in SCHEMAS}
    total, distinct, low, high = held["docs"].agg(F.coalesce(F.sum("dl"), F.lit(0)), F.countDistinct("num_id"), F.min("num_id"), F.max("num_id")).first()
    found = {t: checked(held[t].drop("seg_id")).first() for t in SCHEMAS if t != "postings"}
    # one pass over the postings: its sums by term, of which there are few, give those of all
    longest, terms, found["postings"] = measured(held["postings"].drop("seg_id"))
    if longest > TERM_BYTES:
        raise ValueError(f"a term has {longest} bytes; {TERM_BYTES} is the limit")
    n = found["docs"]["n"]
    if distinct != n:
        raise SegmentCorruptionError("docs", f"{n} documents from {low} to {high} have {distinct} numbers")
    return SegmentEntry(seg_id, n, total, 0, found["postings"]["n"], found["tombstones"]["n"], terms, folder_bytes(spark, segment_path(root, "postings", seg_id)), tuple(found[t]["sum"] or 0 for t in SCHEMAS))


def measured(postings: DataFrame) -> tuple[int, int, dict[str, int]]:
    """The bytes of the longest term, the number of terms, and what ``checked`` gives."""
    by_term = postings.groupBy("term").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64(*postings.columns)).alias("sum"))
    longest, terms, n, sum_ = by_term.agg(F.max(F.octet_length("term")), F.count("*"), F.sum("n"), F.bit_xor("sum")).first()
    return longest or 0, terms, {"n": n or 0, "sum": sum_}


def checked(rows: DataFrame) -> DataFrame:
    """(seg_id, n, sum): the rows of each segment and a checksum of their values, whatever their order."""
    values = [c for c in rows.columns if c != "seg_id"]
    return rows.groupBy("seg_id").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64(*values)).alias("sum")) if rows.columns != values else rows.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64(*values)).alias("sum"))


def folder_bytes(spark: SparkSession, path: str) -> int:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(where).getLength()


def read_table(spark: SparkSession, root: str, table: str, seg_ids: Sequence[str]) -> DataFrame:
    """The rows of some segments with their seg_id; other segments' files are not even listed."""
    schema = SCHEMAS[table] + ", seg_id string"
    if not seg_ids:
        return spark.createDataFrame([], schema)
    paths = [segment_path(root, table, s) for s in seg_ids]
    try:
        return spark.read.schema(schema).option("basePath", f"{root.rstrip('/')}/{table}").parquet(*paths)
    except AnalysisException as x:
        raise _corrupt(table, str(x).split("\n")[0]) from x


def _corrupt(table: str, detail: str) -> Exception:
    return MappingCorruptionError(detail) if table == "names" else SegmentCorruptionError(table, detail)


def verify(spark: SparkSession, root: str, entries: Sequence[SegmentEntry]) -> None:
    """Raises unless segments hold the rows and checksums that the manifest says; one pass over each table."""
    for i, (table, count) in enumerate((("postings", "postings"), ("docs", "docs"), ("tombstones", "deletes"), ("names", "docs"))):
        try:
            held = {r["seg_id"]: (r["n"], r["sum"]) for r in checked(read_table(spark, root, table, [e.id for e in entries])).collect()}
        except StoreError:
            raise
        except Exception as x:
            raise _corrupt(table, str(x).split("\n")[0]) from x
        for e in entries:
            n, sum_ = held.get(e.id, (0, 0))
            if n != getattr(e, count):
                raise _corrupt(table, f"{n} rows instead of {getattr(e, count)} in {e.id}")
            if sum_ != e.checks[i]:
                raise _corrupt(table, f"checksum {sum_} instead of {e.checks[i]} in {e.id}")


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of any file system, if it is there."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def drop_segment(spark: SparkSession, root: str, seg_id: str) -> None:
    for table in SCHEMAS:
        remove(spark, segment_path(root, table, seg_id))


def on_disk(spark: SparkSession, root: str) -> set[str]:
    found = set()
    for table in SCHEMAS:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{table}")
        fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if fs.exists(where):
            found |= {n.removeprefix("seg_id=") for f in fs.listStatus(where) if (n := f.getPath().getName()).startswith("seg_id=")}
    return found
