"""Queries of the training-data operators and their SQL twins."""

from __future__ import annotations

from termloom.llm import bpe, embeddings, jaccard, lines, media, mixing, quotes, substrings, toxicity, warc


def queries() -> dict:
    return {
        "op1_embedding_dedup": embeddings.op1_embedding_dedup,
        "op2_source_mix": mixing.op2_source_mix,
        "op3_warc": warc.op3_warc,
        "op4_toxicity": toxicity.op4_toxicity,
        "op5_line_dedup": lines.op5_line_dedup,
        "op6_suffix_dedup": substrings.op6_suffix_dedup,
        "op7_media": media.op7_media,
        "op8_quote_links": quotes.op8_quote_links,
        "op9_bpe": bpe.op9_bpe,
        "op10_ngram_jaccard": jaccard.op10_ngram_jaccard,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_embedding_dedup": embeddings.OP1_SQL,
        "op2_source_mix": mixing.OP2_SQL,
        "op3_warc": warc.OP3_SQL,
        "op5_line_dedup": lines.OP5_SQL,
        "op6_suffix_dedup": substrings.OP6_SQL,
        "op8_quote_links": quotes.OP8_SQL,
        "op10_ngram_jaccard": jaccard.OP10_SQL,
    }
