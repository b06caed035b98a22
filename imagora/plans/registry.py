"""All registered queries in one place."""

from __future__ import annotations

import re

from imagora.plans import ablation_plans, check_plans, eval_plans, ledger_plans, text_plans, vector_plans

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
for _module in (text_plans, vector_plans, eval_plans, ablation_plans, ledger_plans, check_plans):
    QUERIES.update(_module.QUERIES)
    ORACLE.update(_module.ORACLE)

# columns that are INT here while SQL counts and row numbers are BIGINT
_RANKED = ("bm25_topk bm25_topk_padded fused_fallback_text dense_topk_text hybrid_topk fused_topk_text dense_topk dense_topk_bounded "
           "hypo_topk_sentence hypo_topk_passage hypo_topk_skill field_paths fused_topk "
           "fused_fallback two_stage_topk rerank_cosine rrf routed_run gate_apply leaderboard "
           "scan_run scan_named_runs two_stage_topk_text").split()
_INT_COLUMNS = {
    **{name: ("rank",) for name in _RANKED},
    **{name: ("pos",) for name in ("sentences", "embed_text", "max_sim", "l2_normalize",
                                   "centroid_single", "centroid_fields")},
    **{name: ("sample_index",) for name in ("scan_pack", "sample_keys", "generate_missing",
                                            "cache_audit")},
    "split_code": ("body_chars",),
    "tokenize": ("n_tokens", "n_distinct"),
    "render_prompts": ("prompt_chars",),
    "agreement": ("n",),
}
for _name, _cols in _INT_COLUMNS.items():
    _casts = ", ".join(f"CAST({c} AS INTEGER) AS {c}" for c in _cols)
    ORACLE[_name] = f"SELECT * REPLACE ({_casts}) FROM ({ORACLE[_name]}) _t"

# long chains whose tables are read again and again
for _name in ("routed_run", "gate_apply", "reuse_audit"):
    ORACLE[_name] = re.sub(r"(?<=[\s,])(\w+(?:\(\w+(?:, ?\w+)*\))?) AS \((?=\s*(?:SELECT|VALUES|WITH|FROM))",
                           r"\1 AS MATERIALIZED (", ORACLE[_name])

flagship = text_plans.bm25_quality
