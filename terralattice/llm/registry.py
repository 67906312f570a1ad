"""The contract queries of this subpackage and their SQL oracles."""

from __future__ import annotations

from terralattice.llm import decontaminate, exact_search, language_id, line_dedup, minhash_dedup, packing, pii, suffix_dedup, toxicity, warc

_MODULES = {
    "op1_minhash_dedup": minhash_dedup,
    "op10_pii": pii,
    "op2_decontaminate": decontaminate,
    "op3_packing": packing,
    "op4_suffix_dedup": suffix_dedup,
    "op5_language_id": language_id,
    "op6_toxicity": toxicity,
    "op7_exact_topk": exact_search,
    "op8_line_dedup": line_dedup,
    "op9_warc": warc,
}

QUERIES = {name: module.query for name, module in _MODULES.items()}
ORACLES = {name: module.SQL for name, module in _MODULES.items() if getattr(module, "SQL", None)}
