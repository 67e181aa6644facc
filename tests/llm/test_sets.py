"""The n-gram join, decontamination and repeated passages against brute force."""

import math
import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftlode.llm import decontam, io, jaccard, repeats

from .nasty import empty, frame, rows, words

TOKEN = re.compile(r"[^\x09-\x0d !-/:-@\[-`{-~]+")


def grams(text, n):
    w = TOKEN.findall((text or "").lower())
    return {" ".join(w)} if 0 < len(w) < n else {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def near_copies(seed=9, groups=12, extra=40):
    draw = random.Random(seed)
    out = []
    for _ in range(groups):
        w = words(draw, draw.choice([3, 6, 30, 60])).split()
        for _ in range(draw.randint(2, 6)):
            v = list(w)
            for _ in range(draw.randint(0, max(1, len(v) // 12))):
                v[draw.randrange(len(v))] = words(draw, 1)
            out.append(" ".join(v))
    out += [words(draw, draw.randint(1, 60)) for _ in range(extra)] + ["a b", "a b", "a b c", "a", "a b c d", "b c", "a b c b"]
    draw.shuffle(out)
    return [(i, t, "aa", "s", 1) for i, t in enumerate(out)]


def brute_pairs(data, n, t):
    sets = {i: grams(x, n) for i, x, *_ in data if i is not None}
    return {(a, b): round(len(sets[a] & sets[b]) / len(sets[a] | sets[b]), 6) for a in sets for b in sets if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b])}


def found_pairs(spark, data, n=2, t=0.5):
    """The similar pairs of representatives that the join finds, by the smallest doc_id of their classes."""
    corpus, found = jaccard.similar_sets(frame(spark, data), n, t)
    return {(min(r["a"], r["b"]), max(r["a"], r["b"])): round(r["shared"] / r["total"], 6) for r in corpus.named(found, "a", "b").collect()}


def brute_classes(data, n, t):
    """doc_id: (class_id, copies, links), by the definition."""
    sets = {i: grams(x, n) for i, x, *_ in data if i is not None}
    near = brute_pairs(data, n, t)
    parent = {i: i for i in sets}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in near:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    out = {}
    for i in {x for p in near for x in p}:
        other = [b if a == i else a for a, b in near if i in (a, b)]
        out[i] = (root(i), sum(sets[j] == sets[i] for j in other), sum(sets[j] != sets[i] for j in other))
    return out


@pytest.mark.parametrize(("n", "t"), [(2, 0.5), (1, 0.6), (3, 0.8)])
def test_join_finds_the_pairs_of_brute_force(spark, n, t):
    data = near_copies()
    want = {p: j for p, j in brute_pairs(data, n, t).items() if grams(data[p[0]][1], n) != grams(data[p[1]][1], n)}
    first = {}
    for i, x, *_ in data:
        first.setdefault(frozenset(grams(x, n)), i)
    want = {p: j for p, j in want.items() if all(first[frozenset(grams(data[i][1], n))] == i for i in p)}
    assert found_pairs(spark, data, n, t) == pytest.approx(want, abs=1e-6) and len(want) > 10
    got = {r["doc_id"]: (r["class_id"], r["copies"], r["links"]) for r in jaccard.jaccard_join(frame(spark, data), n, t).collect()}
    assert got == brute_classes(data, n, t)


@pytest.mark.parametrize("x", [0, 1, 5, 20, 10**6])
def test_any_boundary_keeps_every_pair(spark, x, monkeypatch):
    data = near_copies(4, 6, 15)
    want = found_pairs(spark, data)
    monkeypatch.setattr(jaccard, "boundary", lambda *_: x)
    assert found_pairs(spark, data) == want and len(want) > 5


def test_long_lists_are_divided(spark, monkeypatch):
    data = near_copies(4, 6, 15) + [(1000 + i, f"same old words in every text {i}", "aa", "s", 1) for i in range(40)]
    want = found_pairs(spark, data)
    for block in (3, 7):
        monkeypatch.setattr(jaccard, "_BLOCKS", np.array([max(1, -(-top // block)) for top in (2, 4, 8, 16, 32, 64, *[64] * 10)]))
        assert found_pairs(spark, data) == want
    assert sum(a >= 1000 for a, _ in want) == 40 * 39 // 2


def test_a_small_counting_table_changes_nothing(spark, monkeypatch):
    data = near_copies(12, 8, 20)
    want = found_pairs(spark, data)
    for bits, load in (((17, 17), 1), ((22, 22), 1)):
        monkeypatch.setattr(jaccard, "SLOT_BITS", bits)
        assert found_pairs(spark, data) == want
    assert jaccard.slot_bits(10**15) == 22


@pytest.mark.parametrize("length", [91, 201])
def test_join_finds_pairs_just_above_the_threshold(spark, length):
    data, want, n = [], set(), length - 1
    shared = -(-2 * n // 3)  # of n bigrams each: the least for a similarity of one half
    for i in range(300):
        w = [f"w{i}x{k}" for k in range(length)]
        less = i % 2  # every second pair is one n-gram short
        data += [(2 * i, " ".join(w), "aa", "s", 1), (2 * i + 1, " ".join(w[: shared + 1 - less] + [f"v{i}x{k}" for k in range(n - shared + less)]), "aa", "s", 1)]
        if not less:
            want.add((2 * i, 2 * i + 1))
    assert set(found_pairs(spark, data)) == want


def test_verification_can_be_divided(spark, monkeypatch):
    data = near_copies(5)
    want = found_pairs(spark, data)
    monkeypatch.setattr(jaccard, "TASK_PAIRS", 7)
    monkeypatch.setattr(jaccard, "BLOCK_BYTES", 4000)
    monkeypatch.setattr(jaccard, "MAP_BLOCK_BYTES", 300)
    assert found_pairs(spark, data) == want


def test_joins_by_shuffle_give_the_same(spark, monkeypatch):
    data = near_copies(8)
    want = sorted(map(tuple, jaccard.jaccard_join(frame(spark, data)).collect()))
    monkeypatch.setattr(io, "BROADCAST_BYTES", -1)
    monkeypatch.setattr(jaccard, "COPIES_BYTES", -1)
    assert sorted(map(tuple, jaccard.jaccard_join(frame(spark, data)).collect())) == want


def test_the_driver_holds_one_piece_of_the_counting_table_at_a_time(spark, monkeypatch):
    data = near_copies(8)
    want = found_pairs(spark, data)
    monkeypatch.setattr(jaccard, "SLOT_BITS", (19, 19))
    monkeypatch.setattr(jaccard, "PIECE_BYTES", 1 << 16)
    sent, send = [], spark.sparkContext.broadcast
    monkeypatch.setattr(spark.sparkContext, "broadcast", lambda value: sent.append(len(value)) or send(value))
    assert found_pairs(spark, data) == want and len(want) > 10
    assert sent.count(1 << 16) == 4 and max(sent) == 1 << 16


def test_ids_of_copies_are_sent_in_pieces(spark, monkeypatch):
    data = [(i, t, "aa", "s", 1) for i, (_, t, *_) in enumerate(near_copies(8, 6, 15) * 3)]
    monkeypatch.setattr(jaccard, "PIECE_BYTES", 256)
    corpus = jaccard.Corpus(frame(spark, data), 2)
    assert "Broadcast" not in corpus.sets._jdf.queryExecution().toString()
    sent = [i for x in corpus.skip for i in np.frombuffer(x.value, np.int64).tolist()]
    assert sorted(sent) == sorted(r["id"] for r in corpus.copies.collect()) and len(corpus.skip) > 2
    got = {r["doc_id"]: (r["class_id"], r["copies"], r["links"]) for r in jaccard.jaccard_join(frame(spark, data)).collect()}
    assert got == brute_classes(data, 2, 0.5)


def test_finished_steps_leave_nothing_in_the_driver(spark, monkeypatch):
    runtime = spark.sparkContext._jvm.Runtime.getRuntime()
    used = lambda: runtime.totalMemory() - runtime.freeMemory()
    held = spark.sparkContext._jvm.java.nio.ByteBuffer.allocate(128 << 20)
    io.settle(spark)
    full = used()
    del held
    for _ in range(20):  # Py4J tells the JVM a little later
        io.settle(spark)
        if full - used() > 100 << 20:
            break
        time.sleep(0.2)
    assert full - used() > 100 << 20
    calls = []
    monkeypatch.setattr(jaccard, "settle", calls.append)
    assert jaccard.drop_near_duplicates(frame(spark, near_copies(8))).count() and len(calls) >= 4


def test_maps_never_differ_more_than_the_sets(spark):
    import pyarrow as pa

    texts = [x for _, x, *_ in near_copies(3)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["id", "text"])
    maps = [np.frombuffer(x.as_py(), np.uint64) for b in jaccard._maps(2)([batch]) for x in b.column(1)]
    sets = [grams(x, 2) for x in texts]
    for t in (0.5, 0.8):
        assert all(jaccard._may(maps[a], maps[b], t) for a in range(len(texts)) for b in range(a) if len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b]))
    assert sum(jaccard._may(maps[a], maps[b], 0.5) for a in range(len(texts)) for b in range(a)) < len(texts) ** 2 / 8


def test_join_of_odd_rows(spark):
    got = {r["doc_id"]: r for r in jaccard.jaccard_join(frame(spark)).collect()}
    assert got[4]["class_id"] == got[105]["class_id"] == got[106]["class_id"] == 4
    assert (got[4]["copies"], got[4]["links"], got[106]["copies"], got[106]["links"]) == (1, 1, 0, 2)
    assert got[2]["class_id"] == got[3]["class_id"] == 2 and got[2]["copies"] == 1  # one of its two texts
    assert got.keys().isdisjoint({100, 101, 102, 103, 104, None, 1})
    assert jaccard.jaccard_join(empty(spark)).collect() == []


def test_near_duplicates_leave_the_smallest_of_each_group(spark):
    df = frame(spark)
    out = jaccard.drop_near_duplicates(df)
    assert out.columns == df.columns
    kept = [r["doc_id"] for r in out.collect()]
    assert 4 in kept and 105 not in kept and 106 not in kept
    assert kept.count(1) == 1 and kept.count(None) == 2
    assert kept.count(2) == 2 and 3 not in kept  # the second text of 2 is that of 3
    assert {100, 101, 102, 103, 104} <= set(kept)
    assert jaccard.drop_near_duplicates(empty(spark)).collect() == []


def test_components_are_those_of_union_find(spark):
    draw = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 60)] + [(draw.randrange(100, 200), draw.randrange(100, 200)) for _ in range(60)] + [(7, 7), (3, 2)]
    parent = {}

    def root(v):
        while parent.setdefault(v, v) != v:
            v = parent[v]
        return v

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    want = {(v, root(v)) for v in parent if root(v) != v}
    assert {tuple(r) for r in jaccard.components(spark.createDataFrame(edges, "a long, b long")).collect()} == want


def brute_leaks(docs, items, n, containment):
    def shingles(text):
        w = TOKEN.findall((text or "").lower())
        return [tuple(w[i : i + n]) for i in range(len(w) - n + 1)]

    out = {}
    for item, text in items:
        s = shingles(text)
        if item is None or not s:
            continue
        for doc, t, *_ in docs:
            d = shingles(t)
            if doc is None or not d:
                continue
            best = max(len(set(d[i : i + len(s)]) & set(s)) for i in range(len(d)))
            if best >= math.ceil(containment * len(set(s)) - 1e-9):
                out[doc, item] = max(out.get((doc, item), (0, 0)), (best, len(set(s))))
    return out


@pytest.mark.parametrize("limit", [decontam.BROADCAST_SHINGLES, 0])
def test_contamination_is_that_of_brute_force(spark, limit):
    draw = random.Random(8)
    items = [(i, words(draw, draw.choice([2, 5, 12, 25]))) for i in range(12)] + [(None, words(draw, 9)), (50, None), (51, ""), (52, "go go go go go go")]
    docs = [(i, words(draw, 120), "aa", "s", 1) for i in range(20)]
    for i in range(0, 20, 2):
        w, v = docs[i][1].split(), (items[draw.randrange(12)][1]).split()
        for _ in range(draw.randint(0, max(1, len(v) // 5))):
            v[draw.randrange(len(v))] = "zzz"
        at = draw.randrange(len(w))
        docs[i] = (i, " ".join(w[:at] + v + w[at:]), "aa", "s", 1)
    docs += [(30, "Go, go! GO go go go go go", "aa", "s", 1), (31, None, "aa", "s", 1), (None, items[3][1], "aa", "s", 1), (32, "", "aa", "s", 1), docs[0], (0, "other text of the same number", "aa", "s", 1)]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit("clash"))
    df = frame(spark, docs)
    got = {(r["doc_id"], r["item_id"]): (r["matched"], r["shingles"]) for r in decontam.contaminated(df, bench, broadcast_shingles=limit).collect()}
    assert got == brute_leaks(docs, items, decontam.N, decontam.CONTAINMENT) and got
    if limit:
        kept = decontam.drop_contaminated(df, bench)
        assert kept.columns == df.columns
        assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(d[0]) for d in docs if d[0] not in {x for x, _ in got})
        assert decontam.contaminated(empty(spark), bench).collect() == [] and decontam.contaminated(df, bench.limit(0)).collect() == []


def brute_ranges(data, depth):
    windows = defaultdict(list)
    for doc, text in sorted({(d, t) for d, t, *_ in data if d is not None and t is not None}):
        w = re.findall(r"[^\x09-\x0d ]+", text)
        for i in range(len(w) - depth + 1):
            windows[tuple(w[i : i + depth])].append((doc, i))
    hits = defaultdict(dict)
    for places in windows.values():
        if len(places) > 1:
            for k, (doc, i) in enumerate(sorted(places)):
                hits[doc][i] = k > 0
    out = set()
    for doc, found in hits.items():
        run = []
        for i in sorted(found):
            if run and i > run[-1] + depth:
                out.add((doc, run[0], run[-1] + depth - run[0], len(run), sum(found[j] for j in run)))
                run = []
            run.append(i)
        out.add((doc, run[0], run[-1] + depth - run[0], len(run), sum(found[j] for j in run)))
    return out


@pytest.mark.parametrize(("depth", "gram", "task"), [(12, 4, 1 << 24), (12, 4, 2000), (5, 8, 1 << 24)])
def test_repeats_are_those_of_brute_force(spark, depth, gram, task, monkeypatch):
    monkeypatch.setattr(repeats, "TASK_BYTES", task)
    draw = random.Random(6)
    shared = [words(draw, k) for k in (11, 12, 13, 40)]
    data = []
    for i in range(25):
        parts = [words(draw, draw.randint(0, 40)) for _ in range(3)]
        parts.insert(draw.randint(0, 3), draw.choice(shared))
        data.append((i, " ".join(parts), "aa", "s", 1))
    data += [(40, "ha " * 60, "aa", "s", 1), (41, None, "aa", "s", 1), (42, "", "aa", "s", 1), (None, data[0][1], "aa", "s", 1), data[3], (43, shared[3] + " mid " + shared[3], "aa", "s", 1)]
    got = [tuple(r) for r in repeats.repeated_passages(frame(spark, data), depth, gram).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_ranges(data, depth)


@pytest.mark.parametrize("hot", [0, 2, 30])
def test_hot_digits_give_the_same_ranges(spark, hot, monkeypatch):
    monkeypatch.setattr(repeats, "TASK_BYTES", 2000)
    draw = random.Random(16)
    line = words(draw, 15)
    data = [(i, f"{words(draw, draw.randint(0, 20))} {line} {words(draw, draw.randint(0, 20))}", "aa", "s", 1) for i in range(60)] + [(70, "ha " * 40, "aa", "s", 1)]
    data += [data[3], (4, data[9][1] + " more", "aa", "s", 1)]
    monkeypatch.setattr(repeats, "HOT", hot)
    got = [tuple(r) for r in repeats.repeated_passages(frame(spark, data[:-1]), 12, 4).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_ranges(data[:-1], 12)
    several = sorted(tuple(r) for r in repeats.repeated_passages(frame(spark, data), 12, 4).collect())
    monkeypatch.setattr(repeats, "HOT", 10**9)
    assert several == sorted(tuple(r) for r in repeats.repeated_passages(frame(spark, data), 12, 4).collect())


@pytest.mark.parametrize("depth", [1, 2, 3, 8, 9])
def test_radix_sort_finds_equal_suffixes(depth):
    draw = np.random.default_rng(depth)
    tokens = draw.integers(0, 3, 2000).astype(np.uint64)
    n = len(tokens) - depth + 1
    group = draw.integers(0, 2, n)
    index, got = repeats.radix_groups(group, lambda at, k: tokens[at + k], depth)
    want = defaultdict(list)
    for i in range(n):
        want[(group[i], *tokens[i : i + depth])].append(i)
    found = defaultdict(list)
    for i, g in zip(index, got, strict=True):
        found[g].append(i)
    assert sorted(sorted(x) for x in found.values()) == sorted(x for x in want.values() if len(x) > 1)


def test_repeats_of_odd_rows(spark):
    assert all(r["tokens"] >= 50 for r in repeats.repeated_passages(frame(spark)).collect())
    assert repeats.repeated_passages(empty(spark)).collect() == []


def test_sets_have_no_repeated_grams(spark):
    import pyarrow as pa

    texts = [t for _, t, *_ in rows()] + ["x x x x", "ä Ä ä Ä"]
    h, off = jaccard.ngram_sets(pa.array(texts), 2)
    assert [int(b - a) for a, b in zip(off, off[1:], strict=False)] == [len(grams(t, 2)) for t in texts]
    assert Counter(off).total() == len(texts) + 1
