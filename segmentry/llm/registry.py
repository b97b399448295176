"""Registered queries of this package and their SQL."""

import corpus_pipeline
from segmentry.llm import bpe, chat, decontaminate, identifiers, jaccard, language, pages, quality, repeats, runs, secrets, trie, vectors

QUERIES = {
    "op1_suffix_dedup": repeats.op1_suffix_dedup,
    "op2_embedding_dedup": vectors.op2_embedding_dedup,
    "op3_chat_format": chat.op3_chat_format,
    "op4_quality": quality.op4_quality,
    "op5_language_id": language.op5_language_id,
    "op6_ngram_jaccard": jaccard.op6_ngram_jaccard,
    "op7_secrets": secrets.op7_secrets,
    "op8_html_extract": pages.op8_html_extract,
    "op9_bpe": bpe.op9_bpe,
    "op10_decontaminate": decontaminate.op10_decontaminate,
    "op11_prefix_trie": trie.op11_prefix_trie,
    "op12_pii": identifiers.op12_pii,
    "op13_periodic_runs": runs.op13_periodic_runs,
    "language_of_pages": language.language_of_pages,
    "pipeline": corpus_pipeline.run,
}
SQL = {
    "op2_embedding_dedup": vectors.OP2_SQL,
    "op3_chat_format": chat.OP3_SQL,
    "op6_ngram_jaccard": jaccard.OP6_SQL,
    "op10_decontaminate": decontaminate.OP10_SQL,
    "op11_prefix_trie": trie.OP11_SQL,
}
