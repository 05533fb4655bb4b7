"""The registered queries of this folder's operators, and SQL for those that SQL can express."""

from __future__ import annotations

from larkspur.llm import bpe, decontam, jaccard, lm, repeats, secrets, sharding, topk, toxicity, warc

QUERIES = {
    f.__name__: f
    for f in (
        topk.op1_topk_pivots,
        decontam.op2_decontamination,
        sharding.op3_hilbert_sharding,
        jaccard.op4_ngram_jaccard,
        warc.op5_warc_normaliser,
        secrets.op6_secret_scan,
        bpe.op7_bpe,
        toxicity.op8_toxicity,
        repeats.op9_substring_dedup,
        lm.op10_maxent_lm,
    )
}
SQL = {"op1_topk_pivots": topk.SQL, "op2_decontamination": decontam.sql(), "op4_ngram_jaccard": jaccard.sql(), "op5_warc_normaliser": warc.sql(), "op9_substring_dedup": repeats.sql()}
