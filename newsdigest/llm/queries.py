"""The registered queries of this subpackage: name -> (callable, SQL twin or None)."""

from __future__ import annotations

from . import (decontaminate, exact_dedup, hard_negatives, license_scan, mixing, near_dup, nearest, quality, sharding, spelling,
               substring_dedup, token_count, url_filter)

QUERIES = {
    "op1_near_dup": (near_dup.op1_near_dup, None),
    "op2_substring_dedup": (substring_dedup.op2_substring_dedup, substring_dedup.OP2_SQL),
    "op3_exact_dedup": (exact_dedup.op3_exact_dedup, exact_dedup.OP3_SQL),
    "op4_sharding": (sharding.op4_sharding, None),
    "op5_url_filter": (url_filter.op5_url_filter, url_filter.OP5_SQL),
    "op6_license_scan": (license_scan.op6_license_scan, None),
    "op7_token_count": (token_count.op7_token_count, None),
    "op8_decontaminate": (decontaminate.op8_decontaminate, None),
    "op9_mixing": (mixing.op9_mixing, None),
    "op10_quality": (quality.op10_quality, None),
    "op11_hard_negatives": (hard_negatives.op11_hard_negatives, hard_negatives.OP11_SQL),
    "op12_nearest": (nearest.op12_nearest, nearest.OP12_SQL),
    "op13_spelling": (spelling.op13_spelling, spelling.OP13_SQL),
}
