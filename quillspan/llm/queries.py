"""The queries and oracle SQL of this subpackage, by name."""

from __future__ import annotations

from . import decontaminate, line_dedup, media, mixing, order_minhash, quotes, secrets, sharding, suffix_dedup, toxicity

QUERIES = {
    "op1_suffix_dedup": suffix_dedup.op1_suffix_dedup,
    "op2_quote_link": quotes.op2_quote_link,
    "op3_mix_sources": mixing.op3_mix_sources,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_order_minhash": order_minhash.op5_order_minhash,
    "op6_secret_scan": secrets.op6_secret_scan,
    "op7_line_dedup": line_dedup.op7_line_dedup,
    "op8_media_columns": media.op8_media_columns,
    "op9_decontaminate": decontaminate.op9_decontaminate,
    "op10_shard": sharding.op10_shard,
}
ORACLE_SQL = {
    "op2_quote_link": quotes.SQL,
    "op3_mix_sources": mixing.SQL,
    "op7_line_dedup": line_dedup.SQL,
    "op9_decontaminate": decontaminate.SQL,
}
