"""Registered queries of the training-data operators: each applies its operator to its whole table."""

from __future__ import annotations

from stampbook.llm import collocations, perspectives, url_rules
from stampbook.llm.decontaminate import op5_decontaminate
from stampbook.llm.divergence import op7_divergence
from stampbook.llm.jaccard import op9_jaccard
from stampbook.llm.language_model import op2_kneser_ney
from stampbook.llm.license_scan import op13_license_scan
from stampbook.llm.mixing import op1_pareto_mixing
from stampbook.llm.prefix_trie import op11_prefix_trie
from stampbook.llm.relative_lz import op8_relative_lz
from stampbook.llm.suffix_dedup import op4_suffix_dedup
from stampbook.llm.token_shards import op10_token_shards

QUERIES = {
    f.__name__: f
    for f in (
        op1_pareto_mixing, op2_kneser_ney, url_rules.op3_url_rules, op4_suffix_dedup, op5_decontaminate, perspectives.op6_perspectives,
        op7_divergence, op8_relative_lz, op9_jaccard, op10_token_shards, op11_prefix_trie, collocations.op12_collocations, op13_license_scan,
    )
}
#: SQL where it can express the result; the others are tested against brute force in tests/llm.
CHECKS: dict[str, str] = {"op3_url_rules": url_rules.CHECK, "op6_perspectives": perspectives.CHECK, "op12_collocations": collocations.CHECK}
