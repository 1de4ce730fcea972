"""Name -> query and name -> oracle SQL of the training-data operators."""

from __future__ import annotations

from strataweave.llm import alignment, chunk_bpe, decontaminate, divergence, exact_dedup, html_text, jaccard, language_model, packing, pii, quality, token_count, warc

QUERIES = {
    "op1_decontamination": decontaminate.op1_decontamination,
    "op2_pii": pii.op2_pii,
    "op3_best_fit_packing": packing.op3_best_fit_packing,
    "op4_lm_scores": language_model.op4_lm_scores,
    "op5_exact_dedup": exact_dedup.op5_exact_dedup,
    "op6_warc": warc.op6_warc,
    "op7_ngram_jaccard": jaccard.op7_ngram_jaccard,
    "op8_html_text": html_text.op8_html_text,
    "op9_token_counts": token_count.op9_token_counts,
    "op10_quality": quality.op10_quality,
    "op11_bpe_codes": chunk_bpe.op11_bpe_codes,
    "op12_token_alignment": alignment.op12_token_alignment,
    "op13_source_divergence": divergence.op13_source_divergence,
}

#: Operators without an entry are not expressible in SQL; their tests hold brute-force versions.
ORACLES = {
    "op5_exact_dedup": exact_dedup.ORACLE,
    "op6_warc": warc.ORACLE,
    "op13_source_divergence": divergence.ORACLE,
}
