"""Queries of the training-data operators, and the SQL that must give the same rows."""

from __future__ import annotations

import corpus_pipeline

from . import chat, decontaminate, hmm, html_cut, jaccard, mixing, periodic_runs, personal_data, prefix_trie, quality, sharding, toxicity, warc


def queries():
    return {
        "op1_hmm_likelihood": hmm.op1_hmm_likelihood,
        "op2_subword_toxicity": toxicity.op2_subword_toxicity,
        "op3_warc_chunks": warc.op3_warc_chunks,
        "op4_hypergeometric_shuffle": sharding.op4_hypergeometric_shuffle,
        "op5_benchmark_ngrams": decontaminate.op5_benchmark_ngrams,
        "op6_rule_ledger": quality.op6_rule_ledger,
        "op7_role_repair": chat.op7_role_repair,
        "op8_minimum_cut_text": html_cut.op8_minimum_cut_text,
        "op9_systematic_mix": mixing.op9_systematic_mix,
        "op10_parity_sketch_join": jaccard.op10_parity_sketch_join,
        "op11_periodic_runs": periodic_runs.op11_periodic_runs,
        "op12_prefix_trie": prefix_trie.op12_prefix_trie,
        "op13_personal_data": personal_data.op13_personal_data,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql():
    return {"op5_benchmark_ngrams": decontaminate.OP5_SQL, "op6_rule_ledger": quality.OP6_SQL, "op9_systematic_mix": mixing.OP9_SQL, "op11_periodic_runs": periodic_runs.OP11_SQL, "op12_prefix_trie": prefix_trie.OP12_SQL}
