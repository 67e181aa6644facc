"""Secret scans by a battery of randomness tests.

Candidates are runs of at least 16 characters of the base-64 alphabets.  For each, the smallest encoding that can hold it is
inferred (hex, base 32, upper or lower case with digits, letters, alphanumeric, base 64) and its code values are tested for

* uniformity (chi-squared over value ranges, as many as the length allows),
* independence of high and low values (runs test about the middle),
* serial correlation at lag one,

and the three p-values are combined by Fisher's method into a score, -log10 of the combined p-value: low for random strings.
What ordinary words score is measured, by class of length, on every distinct run of letters alone in the whole corpus and on a
fixed set of invented words.  A candidate's p-value is the share of words of its length class that look as random as it does.
Within each length class the Benjamini-Hochberg procedure over all distinct candidates keeps the share of false discoveries
below ``fdr``; a discovery must besides not be rejected as random at ``level``.

Candidates hold a letter and a digit, or an upper-case letter after a lower-case one, as random strings without a digit do.
Other runs of letters alone are the words that serve as reference; runs of digits alone are numbers.  Findings carry a hash
of the secret, never the secret.

Defined results: NULL or empty texts have no findings and stay as they are; a secret that occurs several times in a text is
one finding with its count; every repeated row has its own findings; candidates of one score are all discoveries or none; a
very long text is scanned whole, and a very long run is one candidate; an empty table gives an empty result; columns besides
doc_id, text and n_chars are left alone, whatever their names.
"""

from __future__ import annotations

import functools
import math
import random

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .io import fresh

PATTERN = r"[A-Za-z0-9+/_-]{16,}={0,2}"
LEAST = 16
CLASSES = (16, 20, 24, 32, 40, 48, 64)
FDR = 0.05
LEVEL = 0.001
BINS = 400
MASK = "[SECRET]"

_UP, _LOW, _DIGIT = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
ENCODINGS = (
    ("hex", _DIGIT + "abcdef"),
    ("hex", _DIGIT + "ABCDEF"),
    ("base32", _UP + "234567"),
    ("upper36", _UP + _DIGIT),
    ("lower36", _LOW + _DIGIT),
    ("alpha52", _UP + _LOW),
    ("alnum62", _UP + _LOW + _DIGIT),
    ("base64", _UP + _LOW + _DIGIT + "+/"),
    ("base64url", _UP + _LOW + _DIGIT + "-_"),
    ("base64any", _UP + _LOW + _DIGIT + "+/-_"),
)
_CODES = tuple((name, {c: i for i, c in enumerate(a)}, frozenset(a)) for name, a in ENCODINGS)


def _chi2_tail(x: float, k: int) -> float:
    """The upper tail of the chi-squared distribution (Wilson and Hilferty)."""
    z = ((x / k) ** (1 / 3) - (1 - 2 / (9 * k))) / math.sqrt(2 / (9 * k))
    return 0.5 * math.erfc(z / math.sqrt(2))


def battery(token: str) -> tuple[str, float]:
    """The encoding of a token and its score."""
    body = token.rstrip("=")
    have = set(body)
    name, code, _ = next(x for x in _CODES if have <= x[2])
    v = [code[c] for c in body]
    n, a = len(v), len(code)
    m = max(2, min(n // 4, a, 16))
    ranges = [0] * m
    width = [0] * m
    for x in range(a):
        width[x * m // a] += 1
    for x in v:
        ranges[x * m // a] += 1
    p1 = _chi2_tail(sum((o - n * w / a) ** 2 / (n * w / a) for o, w in zip(ranges, width, strict=True)), m - 1)
    high = [2 * x >= a for x in v]
    n1 = sum(high)
    n2 = n - n1
    if n1 and n2:
        runs = 1 + sum(x != y for x, y in zip(high, high[1:], strict=False))
        mean = 2 * n1 * n2 / n + 1
        spread = 2 * n1 * n2 * (2 * n1 * n2 - n) / (n * n * (n - 1))
        p2 = math.erfc(abs(runs - mean) / math.sqrt(2 * spread)) if spread > 0 else 1.0
    else:
        p2 = 2.0 ** (1 - n)
    mid = (a - 1) / 2
    d = [x - mid for x in v]
    r = sum(x * y for x, y in zip(d, d[1:], strict=False)) / sum(x * x for x in d)
    p3 = math.erfc(abs(r) * math.sqrt(n / 2))
    half = -sum(math.log(max(p, 1e-300)) for p in (p1, p2, p3))
    # Fisher: twice this sum is chi-squared with six degrees of freedom
    return name, (half - math.log(1 + half + half * half / 2)) / math.log(10)


def length_class(n: int) -> int:
    return max(i for i, x in enumerate(CLASSES) if n >= x or i == 0)


def score_bin(score: float) -> int:
    return min(BINS - 1, max(0, math.ceil(score * 20)))


@functools.cache
def invented_words(each: int = 2000) -> tuple[tuple[int, ...], ...]:
    """The histogram of scores, by length class, of words of independent letters in the frequencies of English."""
    draw = random.Random(7)
    share = dict(zip("etaoinshrdlcumwfgypbvkjxqz", (127, 91, 82, 75, 70, 67, 63, 61, 60, 43, 40, 28, 28, 24, 24, 22, 20, 20, 19, 15, 10, 8, 2, 2, 1, 1), strict=True))
    counts = [[0] * BINS for _ in CLASSES]
    for i, low in enumerate(CLASSES):
        high = CLASSES[i + 1] - 1 if i + 1 < len(CLASSES) else 2 * low
        for k in range(each):
            word = "".join(draw.choices(list(share), list(share.values()), k=draw.randint(low, high)))
            counts[i][score_bin(battery(word.capitalize() if k % 4 == 0 else word)[1])] += 1
    return tuple(map(tuple, counts))


def _found(text: Column) -> Column:
    return F.regexp_extract_all(text.cast("string"), F.lit(PATTERN), F.lit(0))


def _mixed(token: Column) -> Column:
    return token.rlike("[A-Za-z]") & (token.rlike("[0-9]") | token.rlike("[a-z].*[A-Z]"))


@F.pandas_udf(T.StructType().add("class", T.IntegerType()).add("bin", T.IntegerType()))
def _scored(tokens: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([(length_class(len(x.rstrip("="))), score_bin(battery(x)[1])) for x in tokens], columns=["class", "bin"])


def discoveries(docs: DataFrame, fdr: float = FDR, level: float = LEVEL) -> list[tuple[int, list[float]]]:
    """For every length class, the highest bin of scores that is a discovery (-1: none), and the p-value of every bin."""
    tokens = docs.select(F.explode(_found(F.col("text"))).alias("x")).distinct().select("x", _mixed(F.col("x")).alias("mixed")).filter(F.col("mixed") | ~F.col("x").rlike("[^A-Za-z]"))
    counts = tokens.select("mixed", _scored("x").alias("s")).groupBy("mixed", "s.class", "s.bin").count().collect()
    words, mixed = [list(x) for x in invented_words()], [[0] * BINS for _ in CLASSES]
    for r in counts:
        (mixed if r["mixed"] else words)[r["class"]][r["bin"]] += r["count"]
    highest = score_bin(-math.log10(level))
    out = []
    for own, other in zip(words, mixed, strict=True):
        total, so_far, p = sum(own), 0, []
        for x in own:
            so_far += x
            p.append((1 + so_far) / (1 + total))
        m, k, most = sum(other), 0, -1
        for b in range(BINS):
            k += other[b]
            if other[b] and p[b] * m <= fdr * k:
                most = b
        out.append((min(most, highest), p))
    return out


def secrets(docs: DataFrame, fdr: float = FDR, level: float = LEVEL) -> DataFrame:
    """(doc_id, secret_md5, chars, encoding, score, p_value, occurrences) of every secret of every row."""
    limits = discoveries(docs, fdr, level)

    @F.pandas_udf("struct<secret boolean, encoding string, score double, p double>")
    def judge(tokens: pd.Series) -> pd.DataFrame:
        rows = []
        for x in tokens:
            name, score = battery(x)
            most, p = limits[length_class(len(x.rstrip("=")))]
            b = score_bin(score)
            rows.append((b <= most, name, round(score, 4), round(p[b], 8)))
        return pd.DataFrame(rows, columns=["secret", "encoding", "score", "p"])

    found = F.filter(_found(F.col("text")), _mixed)
    each = docs.select("doc_id", found.alias("all")).filter(F.size("all") > 0).select("doc_id", "all", F.explode(F.array_distinct("all")).alias("x"))
    return (
        each.withColumn("j", judge("x"))
        .filter("j.secret")
        .select("doc_id", F.md5(F.col("x").cast("binary")).alias("secret_md5"), F.length("x").cast("long").alias("chars"), "j.encoding", "j.score", F.col("j.p").alias("p_value"), F.size(F.filter("all", lambda y: y == F.col("x"))).cast("long").alias("occurrences"))
    )


def mask_secrets(docs: DataFrame, fdr: float = FDR, level: float = LEVEL) -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by a mask, and ``n_chars``, if there is one, set anew where that happened."""
    limits = [most for most, _ in discoveries(docs, fdr, level)]

    @F.pandas_udf("array<string>")
    def secret(lists: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or not len(x) else sorted({y for y in x if score_bin(battery(y)[1]) <= limits[length_class(len(y.rstrip("=")))]}, key=lambda y: (-len(y), y)) for x in lists])

    held = fresh("held", docs.columns)
    out = docs.withColumn(held, secret(F.coalesce(F.filter(_found(F.col("text")), _mixed), F.array().cast("array<string>"))))
    hit = F.coalesce(F.size(held), F.lit(0)) > 0
    masked = F.when(hit, F.aggregate(held, F.col("text").cast("string"), lambda t, x: F.replace(t, x, F.lit(MASK)))).otherwise(F.col("text").cast("string"))
    out = out.withColumn("text", masked)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(hit, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.drop(held)
