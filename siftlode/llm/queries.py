"""The queries of this subpackage, each over its whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from . import decontam, jaccard, langid, line_rules, packing, repeats, secrets, sharding, site_quality, site_tree
from .io import read

QUERIES = {
    "op1_language_id": lambda spark, d: langid.identify(read(spark, d, "documents")),
    "op2_line_frequency": lambda spark, d: line_rules.line_frequency_rules(read(spark, d, "documents")),
    "op3_jaccard_join": lambda spark, d: jaccard.jaccard_join(read(spark, d, "documents")),
    "op4_decontamination": lambda spark, d: decontam.contaminated(read(spark, d, "documents"), read(spark, d, "benchmark")),
    "op5_packing": lambda spark, d: packing.pack(read(spark, d, "documents")),
    "op6_site_style_tree": lambda spark, d: site_tree.extract(read(spark, d, "pages")),
    "op7_sharding": lambda spark, d: sharding.range_shards(read(spark, d, "documents")),
    "op8_repeated_passages": lambda spark, d: repeats.repeated_passages(read(spark, d, "documents")),
    "op9_site_quality": lambda spark, d: site_quality.site_quality(read(spark, d, "documents"), read(spark, d, "labels")),
    "op10_secret_scan": lambda spark, d: secrets.secrets(read(spark, d, "documents")),
}

SQL = {
    "op2_line_frequency": line_rules.SQL,
    "op3_jaccard_join": jaccard.SQL,
    "op4_decontamination": decontam.SQL,
    "op7_sharding": sharding.SQL,
    "op8_repeated_passages": repeats.SQL,
}
