import math
import random
import unicodedata
import zlib

import pytest
from hypothesis import given, strategies as st
from pyspark.sql import functions as F

from siftlode.functions import codec, scoring, text


@pytest.mark.parametrize(
    ("given", "min_len", "expected"),
    [
        ("Hello, World! It's", 1, ["hello", "world", "it", "s"]),
        ("Hello, World! It's", 3, ["hello", "world"]),
        ("release 3.14", 1, ["release", "3", "14"]),
        ("snake_case", 1, ["snake", "case"]),
        ("日本語 text", 1, ["日本語", "text"]),
        (unicodedata.normalize("NFD", "été"), 1, ["été"]),
        ("a‍b", 1, ["a", "b"]),
        ("\U00010400", 2, ["\U00010428"]),
        ("", 1, []),
        (" \t\n--", 1, []),
        (None, 1, []),
    ],
)
def test_tokens(spark, given, min_len, expected):
    row = spark.createDataFrame([(given,)], "text string").select(text.tokens(F.col("text"), min_len).alias("t")).first()
    assert row["t"] == expected


def test_plain_texts_do_not_travel_to_python(spark):
    rows = spark.createDataFrame([("café",), (unicodedata.normalize("NFD", "café"),), (None,)], "text string")
    assert [r[0] for r in rows.select(text.nfc(F.col("text"))).collect()] == ["café", "café", None]


def test_query_terms_are_distinct_and_in_order(spark):
    assert text.query_terms(spark, "The fox, the Dog") == ["the", "fox", "dog"]


def test_tokenizer_of_an_expression(spark):
    own = text.ExpressionTokenizer("commas", lambda c: F.split(c, ","), 2)
    assert spark.range(1).select(own.column(F.lit("aa,b,cc")).alias("t")).first()["t"] == ["aa", "cc"]
    with pytest.raises(ValueError):
        text.UnicodeTokenizer(0)


def _score(tf, dl, df, n, k1, b, avgdl):
    idf = math.log((n - df + 0.5) / (df + 0.5) + 1)
    return idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / (avgdl if avgdl > 0 else 1)))


def test_bm25_column(spark):
    draw = random.Random(1)
    rows = [(draw.randint(1, 9), draw.randint(1, 50), draw.randint(1, 20), 20 + draw.randint(0, 100), float(draw.choice([0, 7.5, 20]))) for _ in range(50)]
    df = spark.createDataFrame(rows, "tf int, dl int, df int, n int, avgdl double")
    for k1, b in ((1.2, 0.75), (0.0, 0.75), (1.2, 0.0), (1.2, 1.0)):
        got = [r[0] for r in df.select(scoring.bm25(*(F.col(c) for c in ("tf", "dl", "df", "n", "avgdl")), k1, b)).collect()]
        assert got == pytest.approx([_score(tf, dl, d, n, k1, b, a) for tf, dl, d, n, a in rows], abs=1e-12)
    zero = spark.createDataFrame([(0, 5, 3, 9, 4.0)], "tf int, dl int, df int, n int, avgdl double")
    assert zero.select(scoring.bm25(*(F.col(c) for c in ("tf", "dl", "df", "n", "avgdl")))).first()[0] == 0
    with_all = spark.createDataFrame([(2, 5, 9, 9, 4.0)], "tf int, dl int, df int, n int, avgdl double")
    assert 0 < with_all.select(scoring.idf(F.col("df"), F.col("n"))).first()[0] < 0.1


@given(st.integers(0, (1 << 49) - 1))
def test_vbyte_round_trip(n):
    data = codec.encode_vbyte(n)
    assert codec.decode_vbyte(b"x" + data, 1) == (n, 1 + len(data))


@given(st.lists(st.tuples(st.integers(0, 1 << 30), st.integers(1, 1000))))
def test_postings_round_trip(pairs):
    pairs.sort()
    ids, tfs = [p[0] for p in pairs], [p[1] for p in pairs]
    assert codec.decode_postings(codec.encode_postings(ids, tfs)) == (ids, tfs)
    assert list(codec.iterate_postings(codec.encode_postings(ids, tfs))) == pairs


@pytest.mark.parametrize("bad", [-1, 1.5, 1 << 49, True])
def test_vbyte_refuses(bad):
    with pytest.raises(ValueError):
        codec.encode_vbyte(bad)


def test_postings_refuse():
    with pytest.raises(ValueError):
        codec.encode_postings([1, 2], [1])
    with pytest.raises(ValueError):
        codec.encode_postings([2, 1], [1, 1])
    with pytest.raises(ValueError):
        codec.decode_vbyte(b"\xff" * 8)
    assert codec.decode_vbyte(b"\xff") == (127, 1)
    assert codec.encode_postings([10, 12, 100], [1, 1, 1]) == bytes([3, 10, 1, 2, 1, 88, 1])


def test_vbyte_size_column(spark):
    values = [0, 127, 128, 16383, 16384, (1 << 35) - 1, 1 << 35, (1 << 49) - 1]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "n long").select(codec.vbyte_size(F.col("n"))).collect()]
    assert got == [len(codec.encode_vbyte(v)) for v in values]


def test_crc32(spark):
    assert spark.range(1).select(F.crc32(F.lit("123").cast("binary"))).first()[0] == zlib.crc32(b"123") == 0x884863D2
