"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from tabularium.llm import alignment, decontamination, embedding_dedup, hmm_lm, language_id, ngram_join, packing, sharding, spelling, substring_dedup, token_files, toxicity, url_filter


def queries() -> dict:
    return {
        "op1_sharding": sharding.op1_sharding,
        "op2_toxicity": toxicity.op2_toxicity,
        "op3_url_filter": url_filter.op3_url_filter,
        "op4_packing": packing.op4_packing,
        "op5_language_id": language_id.op5_language_id,
        "op6_decontamination": decontamination.op6_decontamination,
        "op7_ngram_join": ngram_join.op7_ngram_join,
        "op8_hmm_lm": hmm_lm.op8_hmm_lm,
        "op9_substring_dedup": substring_dedup.op9_substring_dedup,
        "op10_embedding_dedup": embedding_dedup.op10_embedding_dedup,
        "op11_spelling_variants": spelling.op11_spelling_variants,
        "op12_tokenizer_alignment": alignment.op12_tokenizer_alignment,
        "op13_token_output": token_files.op13_token_output,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_url_filter": url_filter.OP3_SQL}
