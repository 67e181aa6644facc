"""Size-tiered compaction: which segments to merge, and what a merge keeps."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

FANOUT = 4


def tier_histogram(tiers: Sequence[int]) -> dict[int, int]:
    return dict(sorted(Counter(tiers).items()))


def choose_targets(tiers: Sequence[int], fanout: int = FANOUT) -> list[int] | None:
    """Positions of the first ``fanout`` segments of the lowest tier that has as many; None if none has."""
    for tier, n in tier_histogram(tiers).items():
        if n >= fanout:
            return [i for i, t in enumerate(tiers) if t == tier][:fanout]
    return None


def cascade(tiers: Sequence[int], fanout: int = FANOUT) -> tuple[list[int], int]:
    """The tiers after merging as long as there are targets, merged segments first, and the number of merges."""
    now, merges = list(tiers), 0
    while (chosen := choose_targets(now, fanout)) is not None:
        tier = now[chosen[0]] + 1
        now = [tier] + [t for i, t in enumerate(now) if i not in set(chosen)]
        merges += 1
    return now, merges


def merge_rows(rows: DataFrame, tombstones: DataFrame) -> DataFrame:
    """The rows of merged segments without deleted documents; numbers stay as they are."""
    return rows.join(tombstones.select("num_id").distinct(), "num_id", "left_anti")


def unresolved(tombstones: DataFrame, merged_docs: DataFrame) -> DataFrame:
    """Deletions of documents that none of the merged segments holds: they go on to the merged segment."""
    return tombstones.select("num_id").distinct().join(merged_docs.select("num_id").distinct(), "num_id", "left_anti")


def size_estimate(stats: DataFrame, buffered_terms: int = 0, pending: int = 0, names: int = 0) -> DataFrame:
    """One row (bytes) from (postings_bytes, docs, tombstones, terms) by segment: the memory that an index in memory would take."""
    total = F.sum(F.col("postings_bytes") + 8 * F.col("docs") + 4 * F.col("tombstones") + 80 * F.col("terms"))
    return stats.agg((F.coalesce(total, F.lit(0)) + 64 * buffered_terms + 40 * pending + 160 * names).cast("long").alias("bytes"))
