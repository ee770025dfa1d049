"""Queries of the operators and the SQL that must return the same rows."""

from ledgerlens.llm import bpe, chat, decontam, media, passages, pii, records, simhash, toxicity, warc

QUERIES = {
    "op1_decontamination": decontam.query,
    "op2_media": media.query,
    "op3_simhash": simhash.query,
    "op4_pii": pii.query,
    "op5_toxicity": toxicity.query,
    "op6_bpe": bpe.query,
    "op7_records": records.query,
    "op8_chat": chat.query,
    "op9_warc": warc.query,
    "op10_passages": passages.query,
}
ORACLE: dict[str, str] = {"op1_decontamination": decontam.SQL, "op8_chat": chat.SQL}
