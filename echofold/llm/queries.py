"""The queries of this subpackage: name to (spark, sf_dir) -> DataFrame, and the SQL with the same rows."""

from __future__ import annotations

from echofold.llm import chat_format, language_id, packing, piece_codec, quartile_digest, shingle_join, suffix_dedup, toxicity, vantage_search, warc

QUERIES = {
    "op1_piece_codec": piece_codec.query,
    "op2_vantage_search": vantage_search.query,
    "op3_suffix_dedup": suffix_dedup.query,
    "op4_toxicity": toxicity.query,
    "op5_warc": warc.query,
    "op6_chat_format": chat_format.query,
    "op7_packing": packing.query,
    "op8_language_id": language_id.query,
    "op9_quartile_digest": quartile_digest.query,
    "op10_shingle_join": shingle_join.query,
}
ORACLE_SQL = {
    "op2_vantage_search": vantage_search.ORACLE,
    "op3_suffix_dedup": suffix_dedup.ORACLE,
    "op5_warc": warc.ORACLE,
    "op6_chat_format": chat_format.ORACLE,
    "op9_quartile_digest": quartile_digest.ORACLE,
    "op10_shingle_join": shingle_join.ORACLE,
}
