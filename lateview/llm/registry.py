"""The subpackage's queries and their SQL, for the driver's entry module."""

from __future__ import annotations

from lateview.llm import ann, chat, langid, media, mixing, pieces, pii, sentencepieces, sharding, simhash

QUERIES = {
    "op1_simhash": simhash.op1_simhash,
    "op2_sharding": sharding.op2_sharding,
    "op3_media": media.op3_media,
    "op4_chat": chat.op4_chat,
    "op5_mixing": mixing.op5_mixing,
    "op6_pii": pii.op6_pii,
    "op7_token_counts": pieces.op7_token_counts,
    "op8_langid": langid.op8_langid,
    "op9_ann": ann.op9_ann,
    "op10_sentencepiece": sentencepieces.op10_sentencepiece,
}

ORACLE_SQL: dict[str, str] = {
    "op4_chat": chat.OP4_SQL,
    "op5_mixing": mixing.OP5_SQL,
    "op9_ann": ann.OP9_SQL,
}
