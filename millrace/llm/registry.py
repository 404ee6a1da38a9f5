"""The subpackage's queries and their DuckDB SQL."""

from __future__ import annotations

from . import alignment, chat, decontaminate, exact_dedup, html_text, mixing, near_dedup, pieces, prefix_trie, quality, secrets, token_counts, toxicity


def queries() -> dict:
    return {
        "op1_mix_sources": mixing.op1_mix_sources,
        "op2_decontaminate": decontaminate.op2_decontaminate,
        "op3_quality": quality.op3_quality,
        "op9_toxicity": toxicity.op9_toxicity,
        "op4_exact_dedup": exact_dedup.op4_exact_dedup,
        "op5_html_text": html_text.op5_html_text,
        "op6_chat_format": chat.op6_chat_format,
        "op10_secrets": secrets.op10_secrets,
        "op7_token_counts": token_counts.op7_token_counts,
        "op8_near_dedup": near_dedup.op8_near_dedup,
        "op11_prefix_trie": prefix_trie.op11_prefix_trie,
        "op12_pieces": pieces.op12_pieces,
        "op13_alignment": alignment.op13_alignment,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_mix_sources": mixing.SQL, "op2_decontaminate": decontaminate.SQL, "op4_exact_dedup": exact_dedup.SQL, "op6_chat_format": chat.SQL, "op11_prefix_trie": prefix_trie.SQL}
