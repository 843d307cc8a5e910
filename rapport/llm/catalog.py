"""Registered queries of this subpackage: name -> (query, SQL twin or None)."""

from rapport.llm import (op1_language, op2_quality, op3_licenses, op4_mixing, op5_near_vectors, op6_chat, op7_html,
                         op8_sentencepiece, op9_warc, op10_ngram_join, op11_prefix_trie, op12_centroids, op13_topk)

QUERIES = {
    "op1_language": (op1_language.op1_language, None),
    "op2_quality_rules": (op2_quality.op2_quality_rules, op2_quality.SQL),
    "op3_licenses": (op3_licenses.op3_licenses, None),
    "op4_mixing": (op4_mixing.op4_mixing, op4_mixing.SQL),
    "op5_near_vectors": (op5_near_vectors.op5_near_vectors, op5_near_vectors.SQL),
    "op6_chat": (op6_chat.op6_chat, None),
    "op7_html": (op7_html.op7_html, None),
    "op8_sentencepiece": (op8_sentencepiece.op8_sentencepiece, None),
    "op9_warc": (op9_warc.op9_warc, op9_warc.SQL),
    "op10_ngram_join": (op10_ngram_join.op10_ngram_join, op10_ngram_join.SQL),
    "op11_prefix_trie": (op11_prefix_trie.op11_prefix_trie, op11_prefix_trie.SQL),
    "op12_centroids": (op12_centroids.op12_centroids, op12_centroids.SQL),
    "op13_topk": (op13_topk.op13_topk, op13_topk.SQL),
}
