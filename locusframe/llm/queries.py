"""The subpackage's registered queries and their SQL."""

from __future__ import annotations

from . import bpe, chat, embeddings, exact_dedup, jaccard, licenses, lines, mixing, repeats, toxicity

QUERIES = {
    "op9_line_dedup": lines.op9_line_dedup,
    "op3_suffix_dedup": repeats.op3_suffix_dedup,
    "op8_embedding_dedup": embeddings.op8_embedding_dedup,
    "op1_ngram_jaccard": jaccard.op1_ngram_jaccard,
    "op7_chat_format": chat.op7_chat_format,
    "op5_toxicity": toxicity.op5_toxicity,
    "op4_bpe": bpe.op4_bpe,
    "op2_exact_dedup": exact_dedup.op2_exact_dedup,
    "op6_license_scan": licenses.op6_license_scan,
    "op10_mixing": mixing.op10_mixing,
}

ORACLES = {
    "op7_chat_format": chat.ORACLE,
    "op2_exact_dedup": exact_dedup.ORACLE,
    "op10_mixing": mixing.ORACLE,
}
