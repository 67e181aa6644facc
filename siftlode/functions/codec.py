"""Compact integer lists: variable-length bytes over gaps.  Parquet does this for the index; these serve exchange and size estimates."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, functions as F

MOST_BYTES = 7


def encode_vbyte(n: int) -> bytes:
    """Groups of seven bits, lowest first; the high bit says that another group follows."""
    if not isinstance(n, int) or isinstance(n, bool) or n < 0 or n >= 1 << (7 * MOST_BYTES):
        raise ValueError(f"no variable-length form for {n!r}")
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def decode_vbyte(data: bytes, at: int = 0) -> tuple[int, int]:
    """(value, the offset behind it); data that ends too early gives what there is."""
    value = 0
    for i in range(MOST_BYTES):
        if at >= len(data):
            return value, at
        byte = data[at]
        at += 1
        value |= (byte & 127) << (7 * i)
        if byte < 128:
            return value, at
    raise ValueError("a variable-length integer of more than seven bytes")


def encode_postings(doc_ids: Sequence[int], tfs: Sequence[int]) -> bytes:
    """Count, then gap and frequency of each posting, ascending."""
    if len(doc_ids) != len(tfs):
        raise ValueError("as many frequencies as documents are needed")
    out, last = [encode_vbyte(len(doc_ids))], 0
    for d, f in zip(doc_ids, tfs, strict=True):
        if d < last:
            raise ValueError("documents must ascend")
        out += [encode_vbyte(d - last), encode_vbyte(f)]
        last = d
    return b"".join(out)


def iterate_postings(data: bytes) -> Iterator[tuple[int, int]]:
    """(document, frequency), one after the other."""
    n, at = decode_vbyte(data)
    doc = 0
    for _ in range(n):
        gap, at = decode_vbyte(data, at)
        tf, at = decode_vbyte(data, at)
        doc += gap
        yield doc, tf


def decode_postings(data: bytes) -> tuple[list[int], list[int]]:
    pairs = list(iterate_postings(data))
    return [d for d, _ in pairs], [f for _, f in pairs]


def vbyte_size(n: Column) -> Column:
    """The bytes that ``encode_vbyte`` takes."""
    out = F.lit(MOST_BYTES)
    for k in range(MOST_BYTES - 1, 0, -1):
        out = F.when(n < F.lit(1 << (7 * k)), F.lit(k)).otherwise(out)
    return out.cast("long")
