"""The corpus operators' queries and the SQL to hold them against, for the driver's entry module."""

from __future__ import annotations

from .collocations import OP12_SQL, op12_collocations
from .cotrain import op7_cotraining_quality
from .divergence import op1_divergence_rules
from .katz import op4_katz_backoff
from .minhash import op8_bbit_minhash
from .mixing import op9_flow_mixing
from .oracles import ORACLE_SQL
from .packing import op3_cost_packing
from .page_text import OP13_SQL, op13_page_text
from .reply_trees import op5_reply_trees, op5b_ranked_branches
from .source_audit import OP11_SQL, op11_source_audit
from .suffix_dedup import op10_lpf_dedup
from .token_files import op6_bitpacked_ids
from .topk_search import op2_nra_topk

QUERIES = {
    f.__name__: f
    for f in (
        op1_divergence_rules, op2_nra_topk, op3_cost_packing, op4_katz_backoff, op5_reply_trees, op6_bitpacked_ids,
        op7_cotraining_quality, op8_bbit_minhash, op9_flow_mixing, op10_lpf_dedup,
        op11_source_audit, op12_collocations, op13_page_text, op5b_ranked_branches,
    )
}
ORACLE_SQL = ORACLE_SQL | {"op11_source_audit": OP11_SQL, "op12_collocations": OP12_SQL, "op13_page_text": OP13_SQL}
