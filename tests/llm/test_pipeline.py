"""The pipeline against a brute-force version of each stage."""

import random
import re

import corpus_pipeline
from siftlode.llm import decontam, jaccard, langid, packing, secrets
from siftlode.llm.io import fresh, shared_dir, table

from .nasty import empty, frame, words
from .test_sets import brute_leaks, brute_pairs


def corpus():
    draw = random.Random(21)
    stems = {"aa": "ka lo mi nu pe".split(), "bb": "zri qu xth wy vv".split()}
    items = [(i, words(draw, 20)) for i in range(4)]
    docs = []
    for i in range(120):
        lang = draw.choice(["aa", "bb"])
        docs.append([i, words(draw, draw.randint(30, 80), stems[lang]), lang, f"s{i % 4}", 0])
    docs[10][1] = docs[9][1]
    docs[12][1] = docs[11][1] + " more"
    docs[20][1] += " " + items[1][1]
    for i in (30, 31, 32):
        docs[i][1] += ' token="' + "".join(draw.choices("0123456789abcdef", k=40)) + '"'
    docs += [[200, None, "aa", "s0", 0], [201, "", "aa", "s0", 0], [202, "12345 !!", "aa", "s0", 0]]
    return [tuple(d) for d in docs], items


def test_pipeline(spark, tmp_path):
    docs, items = corpus()
    frame(spark, docs, extra=False).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    columns = frame(spark, docs, extra=False).columns
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        now = table(stage(spark, now, str(tmp_path)))
        seen.append((name, {r["doc_id"]: r for r in now.collect()}))
        if name != "packing":
            assert now.columns == columns
    assert [n for n, _ in seen] == ["language_id", "near_duplicates", "decontamination", "secret_masking", "packing"]
    told, single, clean, masked, packed = (x for _, x in seen)
    model = langid.train(spark.read.parquet(str(tmp_path / "documents.parquet")))
    assert set(told) == {d[0] for d in docs if model.predict(d[1])[1] >= langid.ACCEPT} and {200, 201, 202}.isdisjoint(told)
    assert len(told) == 120
    gone = {b for _, b in brute_pairs([d for d in docs if d[0] in told], jaccard.N, jaccard.THRESHOLD)}
    assert gone == {10, 12} and set(single) == set(told) - gone
    leaks = {d for d, _ in brute_leaks([d for d in docs if d[0] in single], items, decontam.N, decontam.CONTAINMENT)}
    assert leaks == {20} and set(clean) == set(single) - leaks
    assert set(masked) == set(clean)
    for i, r in masked.items():
        found = [x for x in re.findall(secrets.PATTERN, clean[i]["text"]) if re.search("[0-9]", x)]
        assert (r["text"] == clean[i]["text"]) != bool(found) or secrets.MASK not in r["text"]
    assert sum(secrets.MASK in r["text"] for r in masked.values()) >= 2
    encode = packing.encoder(packing.ranks_of(spark, packing.VOCABULARY)).encode_ordinary
    assert {i: (r["n_tokens"], r["tokens"]) for i, r in packed.items()} == {i: (len(encode(r["text"])), encode(r["text"])) for i, r in masked.items()}
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, whole)) == sorted(tuple(r) for r in packed.values())


def test_pipeline_of_odd_rows(spark, tmp_path):
    """NULLs in every column, a very long text, repeated rows and columns that are named like the stages' own."""
    df = frame(spark)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "too short"), (2, None), (None, "an item without a number here"), (3, "")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    now, counts = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for name, stage in corpus_pipeline.STAGES:
        now = table(stage(spark, now, str(tmp_path)))
        counts.append(now.count())
        if name != "packing":
            assert sorted(now.columns) == sorted(df.columns)
            assert {r["rank"] for r in now.select("rank").collect()} <= {"x"}
    ids = sorted(r["doc_id"] for r in now.filter("doc_id IS NOT NULL").collect())
    assert [i for i in set(ids) if ids.count(i) > 1] == [2]  # its two texts are unlike; one is that of 3, which goes
    assert {3, 105, 106}.isdisjoint(ids) and {4, 103} <= set(ids)
    assert counts == sorted(counts, reverse=True) and counts[1] == counts[4]
    assert now.filter("doc_id IS NULL").count() == 1  # the one with a text
    assert now.filter("doc_id = 103").first()["n_tokens"] > 40_000


def test_pipeline_of_nothing(spark, tmp_path):
    empty(spark).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_intermediate_tables_are_removed(spark, tmp_path):
    from pathlib import Path

    from siftlode.llm import io

    root = Path(shared_dir(spark).removeprefix("file:")) / "siftlode"
    before = io.written()
    a, b, c = (table(spark.range(n)) for n in (1, 2, 3))
    held = {p.name for p in root.iterdir()}
    io.clean(before, before + 2)
    assert c.count() == 3 and len(held - {p.name for p in root.iterdir()}) == 2 and io.written() == before + 1


def test_shared_folder_and_names(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    assert fresh("p", ["P", "_p"]) == "__p" and fresh("p", ["q"]) == "p"
