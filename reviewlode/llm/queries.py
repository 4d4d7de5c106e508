"""Queries of this subpackage and the SQL that checks them.

None of them has SQL: their tests compare with brute force, round trips and
held-out accuracy.
"""

from __future__ import annotations

from reviewlode.llm import encoding_ops, language_ops, leaks, levels, lookalike_ops, personal_ops, sentence_ops, tokens

QUERIES = {
    "p1_found": sentence_ops.p1_found,
    "p1_sentences": sentence_ops.p1_sentences,
    "p2_found": language_ops.p2_found,
    "p2_segments": language_ops.p2_segments,
    "p3_found": lookalike_ops.p3_found,
    "p3_normalised": lookalike_ops.p3_normalised,
    "p6_found": encoding_ops.p6_found,
    "p6_restored": encoding_ops.p6_restored,
    "p7_found": personal_ops.p7_found,
    "p7_redacted": personal_ops.p7_redacted,
    "p8_ids": tokens.p8_ids,
    "p8_token_counts": tokens.p8_token_counts,
    "p9_found": leaks.p9_found,
    "p9_leaks": leaks.p9_leaks,
    "p9_items": leaks.p9_items,
    "p10_found": levels.p10_found,
    "p10_profile": levels.p10_profile,
}
ORACLE_SQL: dict[str, str] = {}
