"""Registered queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from tidewatch.llm import counts, exact, jaccard, language, lexical, mixing, packing, quality, suffixes, topk, trie, vectors, warc

QUERIES = {
    "op2_near_vectors": vectors.op2_near_vectors,
    "op1_ngram_jaccard": jaccard.op1_ngram_jaccard,
    "op3_language_id": language.op3_language_id,
    "op4_quality": quality.op4_quality,
    "op5_mix_sources": mixing.op5_mix_sources,
    "op9_suffix_dedup": suffixes.op9_suffix_dedup,
    "op10_warc": warc.op10_warc,
    "op8_token_counts": counts.op8_token_counts,
    "op6_packing": packing.op6_packing,
    "op7_exact_dedup": exact.op7_exact_dedup,
    "op11_conversation_trie": trie.op11_conversation_trie,
    "op12_exact_top_k": topk.op12_exact_top_k,
    "op13_ranked_search": lexical.op13_ranked_search,
}

ORACLE = {
    "op2_near_vectors": vectors.SQL,
    "op1_ngram_jaccard": jaccard.SQL,
    "op5_mix_sources": mixing.SQL,
    "op7_exact_dedup": exact.SQL,
    "op10_warc": warc.SQL,
    "op11_conversation_trie": trie.SQL,
    "op12_exact_top_k": topk.SQL,
    "op13_ranked_search": lexical.SQL,
}
