import json
import os
import shutil

import pytest
from pyspark.sql import functions as F

from siftlode.errors import IndexLockedError, ManifestCorruptionError, ManifestVersionError, MappingCorruptionError, SegmentCorruptionError, TokenizerMismatchError, WriteStreamError
from siftlode.functions.text import UnicodeTokenizer
from siftlode.plans.engine import Index
from siftlode.sources import segments
from siftlode.sources.blobs import FsBackend, HadoopBackend
from siftlode.streaming.ingest import ingest


def hits(df):
    return [r["doc_id"] for r in df.collect()]


def test_life_of_an_index(spark, tmp_path):
    with Index.open(spark, tmp_path) as x:
        for k, v in (("a", "fox dog"), ("b", "fox"), ("c", "cat dog bird")):
            x.add(k, v)
        assert x.buffered_count() == 3 and hits(x.search("fox")) == []
        x.flush()
        assert hits(x.search("fox")) == ["b", "a"]
        x.remove("a")
        x.remove("nobody")
        assert hits(x.search("fox")) == ["b"]
        x.flush()
        # the deleted document still counts: N = 3, average length 2, df = 2
        assert x.segment_count() == 2 and x.doc_count() == 3
        assert x.search("fox").first()["score"] == pytest.approx(0.590862, abs=1e-6)
        x.compact()
        assert x.segment_count() == 1 and x.doc_count() == 2
        assert x.search("fox").first()["score"] == pytest.approx(0.871385, abs=1e-6)
        before = x.generation()
        x.compact()
        assert x.generation() == before
        x.add("b", "wolf")
        assert hits(x.search("fox")) == []  # gone until the flush
    with Index.open(spark, tmp_path) as x:
        assert hits(x.search("wolf")) == ["b"] and hits(x.search("fox")) == []
        assert hits(x.search("cat dog", mode="and", limit=1)) == ["c"]
        assert hits(x.search("")) == [] and hits(x.search("...")) == []
        x.remove("b")
        x.flush()
        x.add("b", "wolf again")
        x.flush()
        assert hits(x.search("wolf")) == ["b"]
        assert x.estimated_bytes() > 0


def test_bulk_and_replayed_batches(spark, tmp_path):
    rows = spark.createDataFrame([("p", "fox one"), ("q", "fox zwei"), ("q", "fox two"), (None, "lost"), ("r", None)], "doc_id string, text string")
    with Index.open(spark, tmp_path, fanout=2) as x:
        x.add_many(rows, batch=0)
        x.add_many(rows, batch=0)
        assert x.doc_count() == 3 and hits(x.search("two")) == ["q"] and hits(x.search("zwei")) == []
        x.add_many(spark.createDataFrame([("p", "new fox")], "doc_id string, text string"), batch=1)
        assert x.segment_count() == 1 and x.manifest.segments[0].tier == 1
        assert hits(x.search("one")) == [] and hits(x.search("new")) == ["p"]
        x.remove_many(spark.createDataFrame([("q",), ("zz",)], "doc_id string"))
        assert hits(x.search("fox")) == ["p"]
        asked = spark.createDataFrame([(1, "fox new"), (2, "none")], "query_id long, query string")
        assert [(r["query_id"], r["doc_id"]) for r in x.batch_search(asked).collect()] == [(1, "p")]


def test_cascade_shapes(spark, tmp_path):
    with Index.open(spark, tmp_path, flush_threshold=1, fanout=3) as x:
        for i in range(5):
            x.add(str(i), f"word{i} all")
        assert x.segment_count() == 3
        assert sorted(hits(x.search("all"))) == list("01234")


def test_failed_commit_can_be_tried_again(spark, tmp_path):
    fail = [True]

    def hook():
        if fail[0]:
            raise OSError("no space")

    x = Index.open(spark, tmp_path, before_manifest=hook)
    x.add("a", "fox")
    with pytest.raises(OSError):
        x.flush()
    assert x.buffered_count() == 1 and x.generation() == 0
    fail[0] = False
    x.flush()
    assert hits(x.search("fox")) == ["a"] and x.generation() == 1
    x.close()


def test_recovery_and_errors(spark, tmp_path):
    with Index.open(spark, tmp_path) as x:
        x.add("a", "fox")
        with pytest.raises(IndexLockedError):
            Index.open(spark, tmp_path)
    with pytest.raises(TokenizerMismatchError):
        Index.open(spark, tmp_path, tokenizer=UnicodeTokenizer(3))
    (tmp_path / "postings/seg_id=000077").mkdir()
    (tmp_path / "x.tmp").write_text("")
    (tmp_path / ".lock").write_text("999999999")
    Index.open(spark, tmp_path).close()
    assert not (tmp_path / "postings/seg_id=000077").exists() and not (tmp_path / "x.tmp").exists() and not (tmp_path / ".lock").exists()
    good = (tmp_path / "manifest.json").read_text()
    for bad, kind in (("{", ManifestCorruptionError), ("[]", ManifestCorruptionError), (json.dumps(json.loads(good) | {"version": 99}), ManifestVersionError), ('{"version": 2}', ManifestCorruptionError)):
        (tmp_path / "manifest.json").write_text(bad)
        with pytest.raises(kind):
            Index.open(spark, tmp_path)
        assert not (tmp_path / ".lock").exists()
    (tmp_path / "manifest.json").write_text(good)
    for table, kind in (("postings", SegmentCorruptionError), ("names", MappingCorruptionError)):
        os.rename(tmp_path / table, tmp_path / "away")
        with pytest.raises(kind):
            Index.open(spark, tmp_path)
        shutil.rmtree(tmp_path / table, ignore_errors=True)
        os.rename(tmp_path / "away", tmp_path / table)
    Index.open(spark, tmp_path).close()


def test_blobs(tmp_path):
    b = FsBackend(tmp_path / "new")
    b.write("one", b"1")
    b.append("log", b"a")
    b.append("log", b"b")
    assert b.read("log") == b"ab" and b.names() == ["log", "one"] and b.names("o") == ["one"]
    w = b.writer("two")
    w.write(b"2")
    assert "two" not in b.names()
    w.end()
    w.end()
    with pytest.raises(WriteStreamError):
        w.write(b"3")
    w = b.writer("three")
    w.abort()
    w.abort()
    assert b.names() == ["log", "one", "two"]
    b.delete("two")
    b.delete("two")
    with pytest.raises(FileNotFoundError):
        b.read("two")


def test_stream(spark, tmp_path):
    spark.createDataFrame([("a", "fox"), ("b", "dog")], "doc_id string, text string").write.parquet(str(tmp_path / "in"))
    with Index.open(spark, tmp_path / "index") as x:
        for _ in range(2):
            ingest(spark.readStream.schema("doc_id string, text string").parquet(str(tmp_path / "in")), x, str(tmp_path / "checkpoint")).awaitTermination()
        assert x.doc_count() == 2 and hits(x.search("dog")) == ["b"]


def test_the_greatest_order_wins(spark, tmp_path):
    rows = spark.createDataFrame([("p", "new fox", 2), ("p", "old fox", 1)], "doc_id string, text string, seq int")
    with Index.open(spark, tmp_path) as x:
        x.add_many(rows, order="seq")
        assert hits(x.search("new")) == ["p"] and hits(x.search("old")) == []


def test_two_streams_into_one_index(spark, tmp_path):
    with Index.open(spark, tmp_path / "index") as x:
        for s, word in (("one", "fox"), ("two", "dog")):
            spark.createDataFrame([(f"{s}-{i}", f"{word} {i}") for i in range(3)], "doc_id string, text string").write.parquet(str(tmp_path / s))
            for _ in range(2):
                ingest(spark.readStream.schema("doc_id string, text string").parquet(str(tmp_path / s)), x, str(tmp_path / f"checkpoint-{s}")).awaitTermination()
        assert x.doc_count() == 6 and len(hits(x.search("fox"))) == 3 and len(hits(x.search("dog"))) == 3
        assert len(x.manifest.batches) == 2
        more = spark.createDataFrame([("z", "cat")], "doc_id string, text string")
        x.add_many(more, batch=0, stream="three")
        x.add_many(more, batch=0, stream="three")
        assert x.doc_count() == 7


def test_a_large_segment_has_several_files_and_right_numbers(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(segments, "FILE_POSTINGS", 2_000)
    rows = spark.range(12_000).select(F.concat(F.lit("d"), F.col("id").cast("string")).alias("doc_id"), F.concat(F.lit("fox w"), F.col("id").cast("string"), F.lit(" x"), (F.col("id") % 97).cast("string")).alias("text"))
    with Index.open(spark, tmp_path) as x:
        x.add_many(rows)
        files = sorted((tmp_path / "postings/seg_id=000000").glob("*.parquet"))
        assert len(files) > 5
        assert x.table("names").select("num_id").distinct().count() == 12_000
        assert sorted(hits(x.search("w777"))) == ["d777"] and x.search("fox").count() == 12_000
        assert set(hits(x.search("x5", mode="and"))) == {f"d{i}" for i in range(12_000) if i % 97 == 5}
        x.remove("d777")
        x.flush()
        assert hits(x.search("w777")) == [] and hits(x.search("w778")) == ["d778"]
        assert x.manifest.segments[0].terms == 1 + 12_000 + 97 and x.manifest.segments[0].postings_bytes > 0


def test_texts_are_tokenized_once_and_move_once(spark, tmp_path, monkeypatch):
    seen, write = [], segments.write_segment
    monkeypatch.setattr(segments, "write_segment", lambda spark, root, seg, *tables: seen.extend(x._jdf.queryExecution().executedPlan().toString() for x in tables[:3]) or write(spark, root, seg, *tables))
    rows = [(f"d{i}", f"fox w{i % 7} fox") for i in range(50)] + [("d3", "late cat"), ("d4", None)]
    with Index.open(spark, tmp_path / "index") as x:
        x.add_many(spark.createDataFrame(rows, "doc_id string, text string").coalesce(1))
        assert len(seen) == 3 and not any("regexp_extract_all" in p for p in seen)
        assert x.doc_count() == 50 and hits(x.search("cat")) == ["d3"] and len(hits(x.search("fox"))) == 48
        assert x.table("postings").filter("term = 'fox'").select("tf", "dl").distinct().collect() == [(2, 3)]


def test_a_cascade_writes_each_segment_once(spark, tmp_path, monkeypatch):
    made, merge = [], Index._merge
    monkeypatch.setattr(Index, "_merge", lambda self, positions, tier: made.append(tier) or merge(self, positions, tier))
    with Index.open(spark, tmp_path / "index", fanout=2) as x:
        for i in range(4):
            x.add_many(spark.createDataFrame([(f"d{i}", f"fox w{i}")], "doc_id string, text string"))
        assert made == [1, 2] and [s.tier for s in x.manifest.segments] == [2]
        assert sorted(hits(x.search("fox"))) == ["d0", "d1", "d2", "d3"] and hits(x.search("w2")) == ["d2"]


def test_folder_by_uri(spark, tmp_path):
    uri = f"file://{tmp_path}/deep/index"
    with Index.open(spark, uri) as x:
        x.add_many(spark.createDataFrame([("a", "fox"), ("b", "dog")], "doc_id string, text string"))
        assert isinstance(x.backend, HadoopBackend) and x.backend.is_local()
        with pytest.raises(IndexLockedError):
            Index.open(spark, uri)
    assert (tmp_path / "deep/index/manifest.json").exists() and not (tmp_path / "deep/index/.lock").exists()
    with Index.open(spark, uri) as x:
        assert hits(x.search("dog")) == ["b"]
    b = HadoopBackend(spark, f"file://{tmp_path}/blobs")
    b.write("one", b"1")
    b.write("one", b"2")
    b.append("one", b"3")
    assert b.read("one") == b"23" and b.names("o") == ["one"] and not b.create("one", b"x") and b.create("two", b"")
    w = b.writer("three")
    w.abort()
    w.abort()
    with pytest.raises(WriteStreamError):
        w.write(b"3")
    b.delete("two")
    with pytest.raises(FileNotFoundError):
        b.read("two")


def test_changed_values_are_found(spark, tmp_path):
    with Index.open(spark, tmp_path) as x:
        x.add_many(spark.createDataFrame([("a", "fox"), ("b", "dog")], "doc_id string, text string"))
    for table, kind in (("postings", SegmentCorruptionError), ("docs", SegmentCorruptionError), ("names", MappingCorruptionError)):
        folder = tmp_path / table / "seg_id=000000"
        kept = tmp_path / "kept"
        shutil.copytree(folder, kept)
        rows = spark.read.parquet(str(kept))
        c = {"postings": "tf", "docs": "dl", "names": "num_id"}[table]
        rows.withColumn(c, F.col(c) + 1).write.mode("overwrite").parquet(str(folder))
        with pytest.raises(kind):
            Index.open(spark, tmp_path)
        shutil.rmtree(folder)
        shutil.move(kept, folder)
    data = next((tmp_path / "postings/seg_id=000000").glob("*.parquet"))
    whole = data.read_bytes()
    at = whole.index(b"fox")
    data.write_bytes(whole[:at] + b"fux" + whole[at + 3 :])
    for crc in data.parent.glob(".*.crc"):
        crc.unlink()
    with pytest.raises(SegmentCorruptionError):
        Index.open(spark, tmp_path)
    data.write_bytes(whole)
    Index.open(spark, tmp_path).close()


def test_terms_have_a_longest_size(spark, tmp_path):
    with Index.open(spark, tmp_path) as x:
        with pytest.raises(ValueError, match="65535"):
            x.add_many(spark.createDataFrame([("a", "y" * 65_536)], "doc_id string, text string"))
        assert x.segment_count() == 0
        x.add_many(spark.createDataFrame([("a", "y" * 65_535)], "doc_id string, text string"))
        assert x.doc_count() == 1


def test_a_backend_of_ones_own(spark, tmp_path):
    kept = FsBackend(tmp_path / "elsewhere")
    with Index.open(spark, tmp_path / "index", backend=kept) as x:
        x.add("a", "fox")
    assert kept.names() == ["manifest.json"] and not (tmp_path / "index/manifest.json").exists()
    with Index.open(spark, tmp_path / "index", backend=kept) as x:
        assert hits(x.search("fox")) == ["a"]
