"""Small tables with everything that can go wrong in them."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names operators use within.
CLASHING = ["shard", "id", "host", "rank", "p", "held", "h", "n", "size", "bucket", "batch", "evidence", "gone_id", "rep", "path", "to"]


def words(draw, n, stems="ka lo mi nu pe ra si tu vo wu xa yo".split()):
    return " ".join("".join(draw.choices(stems, k=draw.randint(1, 4))) for _ in range(n))


def rows(seed=3, n=30):
    draw = random.Random(seed)
    out = [(i, words(draw, draw.randint(20, 80)), draw.choice(["aa", "bb"]), f"s{i % 3}", 100) for i in range(n)]
    long = words(draw, 40_000)
    out += [
        (100, None, "aa", "s0", None),
        (101, "", "aa", "s0", 0),
        (102, "  \n\t ", None, None, 5),
        (103, long, "aa", "s1", len(long)),
        (104, "one", "bb", "s1", 3),
        (None, out[0][1], "aa", "s0", 100),
        (None, None, None, None, None),
        out[1],
        out[1],
        (2, out[3][1], "aa", "s0", 100),
        (105, out[4][1], "bb", "s2", 100),
        (106, out[4][1] + " extra", "bb", "s2", 100),
    ]
    return out


def frame(spark, data=None, extra=True):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows() if data is None else data, SCHEMA)
    return df.withColumns({c: F.lit("x") for c in CLASHING}) if extra else df


def empty(spark):
    return frame(spark, [])


def key(r):
    return tuple((x is not None, x) for x in r)
