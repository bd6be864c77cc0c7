"""Queries of the training-data operators over their whole tables."""

from . import exact_dedup, minhash, packing, pieces, quality, secret_scan, sharding, suffix_dedup, toxicity, url_filter

QUERIES = {
    "op1_sharding": sharding.op1_sharding,
    "op2_suffix_dedup": suffix_dedup.op2_suffix_dedup,
    "op3_related_packing": packing.op3_related_packing,
    "op4_quality_rules": quality.op4_quality_rules,
    "op5_minhash_near_dedup": minhash.op5_minhash_near_dedup,
    "op6_secret_scan": secret_scan.op6_secret_scan,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_exact_dedup": exact_dedup.op8_exact_dedup,
    "op9_sampled_pieces": pieces.op9_sampled_pieces,
    "op10_url_filter": url_filter.op10_url_filter,
}

SQL = {
    "op8_exact_dedup": exact_dedup.SQL,
    "op10_url_filter": url_filter.SQL,
}
