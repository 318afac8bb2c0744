"""The queries of this subpackage, by name, and SQL for those that SQL can express."""

from __future__ import annotations

from tidemark.llm import chat, langid, linededup, merkle, mixing, nbest, pii, quality, simhash, tokenfile
from tidemark.llm.oracles import OP4, OP6, OP10

QUERIES = {"op1_merkle_fingerprints": merkle.query, "op2_simhash_near_dups": simhash.query, "op3_chat_windows": chat.query, "op4_quality_rules": quality.query, "op5_personal_data": pii.query, "op6_line_dedup": linededup.query, "op6_passage_dedup": linededup.query_passages, "op7_language_id": langid.query, "op8_token_files": tokenfile.query, "op9_nbest_segments": nbest.query, "op10_source_mix": mixing.query}
ORACLES = {"op4_quality_rules": OP4, "op6_line_dedup": OP6, "op10_source_mix": OP10}
