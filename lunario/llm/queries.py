"""Registered queries of the operators, and their SQL where SQL can state the result."""

from __future__ import annotations

from lunario.llm import (
    conversations,
    exact_dedup,
    langid,
    licences,
    mixing,
    neighbours,
    packing,
    runs,
    secret_scan,
    sharding,
    simhash,
    token_files,
    warc,
)

QUERIES = {
    "op1_licence_scan": licences.query,
    "op2_token_files": token_files.query,
    "op3_sharding": sharding.query,
    "op4_warc": warc.query,
    "op5_language_id": langid.query,
    "op6_simhash": simhash.query,
    "op7_neighbours": neighbours.query,
    "op8_mixing": mixing.query,
    "op9_exact_dedup": exact_dedup.query,
    "op10_packing": packing.query,
    "op11_secret_scan": secret_scan.query,
    "op12_runs": runs.query,
    "op13_conversations": conversations.query,
}
ORACLES = {
    "op3_sharding": sharding.SQL,
    "op4_warc": warc.SQL,
    "op8_mixing": mixing.SQL,
    "op9_exact_dedup": exact_dedup.SQL,
    "op11_secret_scan": secret_scan.SQL,
}
