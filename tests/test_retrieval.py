import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftlode.operators import compaction, index, retrieval

WORDS = "ash bay cove dell elm fen glen hill isle knoll".split()


@pytest.fixture(scope="module")
def corpus():
    draw = random.Random(5)
    rows = [(i, " ".join(draw.choices(WORDS, k=draw.randint(1, 12)))) for i in range(40)]
    return [*rows, (40, ""), (41, None), (42, rows[0][1])]


@pytest.fixture(scope="module")
def relations(spark, corpus):
    analyzed = index.analyze(spark.createDataFrame(corpus, "doc_id long, text string"))
    return index.postings(analyzed).cache(), index.doc_lengths(analyzed).cache()


def expected(corpus, terms, mode="or", k1=1.2, b=0.75, dead=()):
    bags = {i: Counter((t or "").split()) for i, t in corpus}
    n, total = len(bags), sum(sum(x.values()) for x in bags.values())
    terms = list(dict.fromkeys(terms))
    df = {t: sum(t in x for x in bags.values()) for t in terms}
    out = []
    for i, x in bags.items():
        if i in dead or not any(t in x for t in terms) or (mode == "and" and not all(t in x for t in terms)):
            continue
        s = 0.0
        for t in terms:
            if x[t]:
                s += math.log((n - df[t] + 0.5) / (df[t] + 0.5) + 1) * x[t] * (k1 + 1) / (x[t] + k1 * (1 - b + b * sum(x.values()) / (total / n)))
        out.append((i, s))
    return sorted(out, key=lambda r: (-r[1], r[0]))


@pytest.mark.parametrize("terms", [["ash"], ["ash", "bay"], ["ash", "bay", "ash"], ["elm", "nosuch"], ["cove", "dell", "fen", "hill"]])
@pytest.mark.parametrize("mode", ["or", "and"])
def test_search(relations, corpus, terms, mode):
    got = [(r["num_id"], r["score"]) for r in retrieval.search(*relations, terms, mode=mode).collect()]
    want = expected(corpus, terms, mode)
    assert [x for x, _ in got] == [x for x, _ in want]
    assert [s for _, s in got] == pytest.approx([s for _, s in want], abs=1e-10)


def test_search_without_an_index_agrees(spark, relations, corpus):
    analyzed = index.analyze(spark.createDataFrame(corpus, "doc_id long, text string"))
    for mode in ("or", "and"):
        got = [tuple(r) for r in retrieval.search_documents(analyzed, ["ash", "bay", "nosuch" if mode == "or" else "ash"], 5, mode).collect()]
        assert got == [tuple(r) for r in retrieval.search(*relations, ["ash", "bay", "nosuch" if mode == "or" else "ash"], 5, mode).collect()]
    assert retrieval.search_documents(analyzed, []).collect() == []


@pytest.mark.parametrize(("k1", "b"), [(0.0, 0.75), (1.2, 0.0), (1.2, 1.0)])
def test_parameters(relations, corpus, k1, b):
    got = [r["num_id"] for r in retrieval.search(*relations, ["ash", "elm"], k1=k1, b=b).collect()]
    assert got == [x for x, _ in expected(corpus, ["ash", "elm"], k1=k1, b=b)]


def test_limits_and_nothing(relations, corpus):
    want = expected(corpus, ["ash"])
    assert len(retrieval.search(*relations, ["ash"], limit=3).collect()) == 3
    for limit in (0, -1, None, 1000):
        assert len(retrieval.search(*relations, ["ash"], limit=limit).collect()) == len(want)
    assert retrieval.search(*relations, []).collect() == []
    assert retrieval.search(*relations, ["nosuch"]).collect() == []


def test_limit_is_a_top_k(relations):
    plan = retrieval.search(*relations, ["ash"], limit=3)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_deleted_documents_count_but_do_not_show(spark, relations, corpus):
    dead = spark.createDataFrame([(0,), (3,), (999,)], "num_id long")
    got = [r["num_id"] for r in retrieval.search(*relations, ["ash", "bay"], tombstones=dead).collect()]
    assert got == [x for x, _ in expected(corpus, ["ash", "bay"], dead={0, 3})]


def test_batch_search_agrees_with_single_searches(spark, relations, corpus):
    asked = {1: ["ash", "bay"], 2: ["elm"], 3: [], 4: ["nosuch"], 5: ["hill", "hill", "fen"]}
    got = retrieval.batch_search(*relations, retrieval.literal_queries(spark, asked), limit=5).collect()
    for q, terms in asked.items():
        mine = sorted((r["rank"], r["num_id"], r["score"]) for r in got if r["query_id"] == q)
        want = expected(corpus, terms)[:5] if terms else []
        assert [x for _, x, _ in mine] == [x for x, _ in want]
        assert [s for _, _, s in mine] == pytest.approx([s for _, s in want], abs=1e-10)


def test_batch_search_by_documents_agrees_with_the_join(spark, monkeypatch):
    draw = random.Random(11)
    texts = [(i, " ".join(draw.choices(WORDS, [2**-k for k in range(10)], k=draw.randint(0, 30)))) for i in range(300)]
    analyzed = index.analyze(spark.createDataFrame([*texts, *[(300 + i, t) for i, t in texts[:40]]], "doc_id long, text string"))
    rows, lengths = index.postings(analyzed).cache(), index.doc_lengths(analyzed)
    asked = retrieval.literal_queries(spark, {i: draw.choices([*WORDS, "nosuch"], k=draw.randint(0, 6)) for i in range(25)})
    dead = spark.createDataFrame([(3,), (7,), (7,)], "num_id long")
    find = lambda mode, limit: sorted(map(tuple, retrieval.batch_search(rows, lengths, asked, limit, mode, tombstones=dead).collect()))
    for mode in ("or", "and"):
        for limit in (1, 7, 1000):
            monkeypatch.setattr(retrieval, "HELD_TERMS", -1)
            want = find(mode, limit)
            monkeypatch.setattr(retrieval, "HELD_TERMS", 1000)
            monkeypatch.setattr(retrieval, "SCORE_ROWS", 37)
            monkeypatch.setattr(retrieval, "SCORE_CELLS", 60)
            assert find(mode, limit) == want and want
    plan = retrieval.batch_search(rows, lengths, asked)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Aggregate [query_id" not in plan  # no row for each pair of a query and a document


def test_sums_of_a_batch_are_exact_beyond_doubles():
    import pyarrow as pa

    parts = [(1 << 52) + 1, (1 << 52) + 3, 1]
    batch = pa.RecordBatch.from_arrays([pa.array([5, 5, 6]), pa.array([0, 1, 0], pa.int32()), pa.array(parts)], ["num_id", "k", "s"])
    best = retrieval._best(np.array([0, 1, 2]), np.array([0, 0]), np.array([2]), 2, False)
    (out,) = best([batch])
    assert out.to_pydict() == {"q": [0, 0], "num_id": [5, 6], "sum": [(1 << 53) + 4, 1]}


def test_boolean(relations, corpus):
    bags = {i: (t or "").split() for i, t in corpus}
    assert {r["num_id"] for r in retrieval.and_query(relations[0], ["ash", "bay"]).collect()} == {i for i, x in bags.items() if {"ash", "bay"} <= set(x)}
    assert {r["num_id"] for r in retrieval.or_query(relations[0], ["ash", "bay"]).collect()} == {i for i, x in bags.items() if {"ash", "bay"} & set(x)}
    assert retrieval.and_query(relations[0], []).collect() == []
    assert [r["num_id"] for r in retrieval.seek(relations[0], "ash", 20).orderBy("num_id").collect()] == sorted(i for i, x in bags.items() if "ash" in x and i >= 20)


def test_several_segments_sum(spark):
    rows = spark.createDataFrame([("a", 1, 2, 5, "s1"), ("a", 1, 3, 6, "s0"), ("a", 2, 1, 1, "s1")], "term string, num_id long, tf long, dl long, seg_id string")
    assert sorted(map(tuple, retrieval.merged(rows).collect())) == [("a", 1, 5, 6, "s0"), ("a", 2, 1, 1, "s1")]


def test_named_segments_sum_without_a_sort(spark):
    rows = spark.createDataFrame([("a", 1, 2, 5, "s1"), ("a", 1, 3, 6, "s0"), ("a", 2, 1, 1, "s1"), ("b", 1, 1, 5, "s9")], "term string, num_id long, tf long, dl long, seg_id string")
    got = retrieval.merged(rows, ["s9", "s0", "s1"])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, retrieval.merged(rows).collect()))
    assert got.schema.names == retrieval.merged(rows).schema.names
    assert "Sort" not in got._jdf.queryExecution().executedPlan().toString()


def test_terms_are_counted_within_documents(spark, corpus):
    docs = spark.createDataFrame([*corpus, (43, "ash bay ash Ash  bay knoll")], "doc_id long, text string")
    analyzed = index.analyze(docs)
    want = sorted((i, w, n, len(t.lower().split())) for i, t in [*corpus, (43, "ash bay ash Ash  bay knoll")] for w, n in Counter((t or "").lower().split()).items())
    for rows in (index.postings(analyzed), index.of_counted(index.counted(analyzed))):
        assert sorted(map(tuple, rows.collect())) == want
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and plan.count("regexp_extract_all") == 1
    assert sorted(map(tuple, index.postings(analyzed, ["bay", "nosuch"]).collect())) == [x for x in want if x[1] == "bay"]


def test_empty_documents_count(relations):
    assert tuple(index.corpus_stats(relations[1]).first())[0] == 43
    assert {r["num_id"] for r in relations[1].filter("dl = 0").collect()} == {40, 41}


def test_numbers_are_consecutive(spark, tmp_path):
    got = index.number_documents(spark.createDataFrame([(x,) for x in "hgfedcba"], "doc_id string"), str(tmp_path / "n"), 10, partitions=3).orderBy("doc_id").collect()
    assert [(r["doc_id"], r["num_id"]) for r in got] == [(c, 10 + i) for i, c in enumerate("abcdefgh")]


def test_many_rows_with_a_payload_get_consecutive_numbers(spark, tmp_path):
    rows = spark.range(200_000).select(F.lpad(((F.col("id") * 7919) % 200_000).cast("string"), 6, "0").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") % 50).cast("int")).alias("text"))
    got = index.number_documents(rows, str(tmp_path / "n"), 5, partitions=7)
    n, distinct, low, high = got.agg(F.count("*"), F.countDistinct("num_id"), F.min("num_id"), F.max("num_id")).first()
    assert (n, distinct, low, high) == (200_000, 200_000, 5, 200_004)
    assert got.filter(F.col("num_id") - 5 != F.col("doc_id").cast("long")).isEmpty()
    assert got.filter(F.length("text") != 0).count() == 200_000 * 49 // 50


def test_gaps_round_trip(relations):
    gaps = index.deltas(relations[0])
    assert index.undeltas(gaps).filter("restored <> num_id").isEmpty()
    assert gaps.filter("delta < 0").isEmpty()


def test_tiers():
    assert compaction.choose_targets([0, 0, 1], 2) == [0, 1]
    assert compaction.choose_targets([0, 1], 2) is None
    assert compaction.cascade([0, 0, 0, 0], 2) == ([2], 3)
    assert compaction.cascade([0] * 7, 8) == ([0] * 7, 0)
    assert compaction.tier_histogram([1, 0, 0]) == {0: 2, 1: 1}


def test_unresolved_deletions(spark):
    dead = spark.createDataFrame([(1,), (2,), (2,)], "num_id long")
    held = spark.createDataFrame([(1, 4)], "num_id long, dl long")
    assert [r[0] for r in compaction.unresolved(dead, held).collect()] == [2]
    assert compaction.merge_rows(held, dead).filter(F.col("num_id") == 1).isEmpty()
