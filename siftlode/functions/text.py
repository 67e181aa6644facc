"""Tokenizers as column expressions."""

from __future__ import annotations

import unicodedata
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

WORD = r"[\p{L}\p{M}\p{N}]+"
#: Code points below this range never change under canonical composition.
_COMPOSABLE = r"[\x{0300}-\x{10FFFF}]"


@F.pandas_udf(T.StringType())
def _composed(texts: pd.Series) -> pd.Series:
    return texts.map(lambda x: None if x is None else unicodedata.normalize("NFC", x), na_action="ignore")


def nfc(text: Column) -> Column:
    """Canonical composition.  Only texts that it could change travel to Python; all others are passed there as NULL."""
    return F.coalesce(_composed(F.when(text.rlike(_COMPOSABLE), text)), text)


def utf16_length(text: Column) -> Column:
    """The length in UTF-16 code units."""
    return F.octet_length(F.encode(text, "UTF-16BE")) / 2


def tokens(text: Column, min_len: int = 1, compose: bool = True) -> Column:
    """Lower-cased maximal runs of letters, marks and digits with at least ``min_len`` UTF-16 units; NULL gives none."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    found = F.regexp_extract_all(F.lower(nfc(text) if compose else text), F.lit(WORD), F.lit(0))
    return F.filter(found, lambda t: utf16_length(t) >= min_len) if min_len > 1 else found


class Tokenizer(Protocol):
    """What an index needs of a tokenizer: a name and setting that are kept with it, and an expression."""

    kind: str
    min_len: int

    def column(self, text: Column) -> Column: ...


class UnicodeTokenizer:
    """NFC, lower case, runs of letters, marks and digits, shortest length."""

    kind = "unicode"

    def __init__(self, min_len: int = 1):
        if min_len < 1:
            raise ValueError("min_len must be 1 or more")
        self.min_len = min_len

    def column(self, text: Column) -> Column:
        return tokens(text, self.min_len)


class ExpressionTokenizer:
    """Any expression from a text column to an array of strings, under a name of its own."""

    def __init__(self, kind: str, expression, min_len: int = 1):
        self.kind, self.expression, self.min_len = kind, expression, min_len

    def column(self, text: Column) -> Column:
        return F.filter(self.expression(F.coalesce(text.cast("string"), F.lit(""))), lambda t: utf16_length(t) >= self.min_len)


DEFAULT_TOKENIZER = UnicodeTokenizer()


def tokenize(df: DataFrame, tokenizer: Tokenizer = DEFAULT_TOKENIZER, text: str = "text", out: str = "tokens") -> DataFrame:
    """``df`` with the tokens of its text."""
    return df.withColumn(out, tokenizer.column(F.col(text)))


def query_terms(spark: SparkSession, query: str, tokenizer: Tokenizer = DEFAULT_TOKENIZER) -> list[str]:
    """The distinct terms of one query in their order, by the very expression that documents go through."""
    found = spark.range(1).select(tokenizer.column(F.lit(query)).alias("t")).first()["t"]
    return list(dict.fromkeys(found))
