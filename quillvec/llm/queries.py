"""The registered queries of these operators, and their SQL where SQL can state them on whole tables."""

from __future__ import annotations

from quillvec.llm import (
    hilbert_shards, imatch, language_id, license_scan, mixing, near_dup, neighbour_graph, periodic_runs, repair_tokens, site_templates,
    toxicity, whitening, winnowing,
)

QUERIES = {
    "op1_imatch": imatch.query,
    "op2_repair_tokens": repair_tokens.query,
    "op3_site_templates": site_templates.query,
    "op4_license_scan": license_scan.query,
    "op5_toxicity": toxicity.query,
    "op6_winnowing": winnowing.query,
    "op7_mix_sources": mixing.query,
    "op8_hilbert_shards": hilbert_shards.query,
    "op9_near_duplicates": near_dup.query,
    "op10_language_id": language_id.query,
    "op11_periodic_runs": periodic_runs.query,
    "op12_whitening": whitening.query,
    "op13_neighbour_graph": neighbour_graph.query,
}
ORACLES: dict[str, str] = {"op4_license_scan": license_scan.SQL, "op6_winnowing": winnowing.SQL}
