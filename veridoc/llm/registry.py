"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from . import bpe, chat, decontaminate, jaccard, licenses, neighbours, quality, secrets, sharding, token_files

QUERIES = {
    "op1_byte_bpe": bpe.op1_byte_bpe,
    "op2_chat": chat.op2_chat,
    "op3_decontamination": decontaminate.op3_decontamination,
    "op4_sharding": sharding.op4_sharding,
    "op5_near_vectors": neighbours.op5_near_vectors,
    "op6_jaccard": jaccard.op6_jaccard,
    "op7_token_files": token_files.op7_token_files,
    "op8_secrets": secrets.op8_secrets,
    "op9_licenses": licenses.op9_licenses,
    "op10_quality": quality.op10_quality,
}
SQL: dict[str, str] = {
    "op2_chat": chat.SQL,
    "op3_decontamination": decontaminate.SQL,
    "op5_near_vectors": neighbours.SQL,
    "op6_jaccard": jaccard.SQL,
    "op9_licenses": licenses.SQL,
}
