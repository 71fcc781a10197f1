"""The registered queries of this subpackage and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from .class_lm import op3_class_lm
from .decontaminate import op1_bm25_decontamination
from .factors import op6_lpf_dedup
from .impact_index import OP13_SQL, op13_ranked_search
from .jaccard import op10_jaccard_join
from .nbest import op8_nbest_pieces
from .quality_rank import op2_bradley_terry_quality
from .repair import op4_repair_token_files
from .rule_ledger import OP5_SQL, op5_rule_ledger
from .site_lines import OP9_SQL, op9_site_spread_lines
from .source_mix import op11_source_mix
from .token_counts import op7_token_counts
from .variants import OP12_SQL, op12_spelling_variants

QUERIES = {
    f.__name__: f
    for f in (
        op1_bm25_decontamination,
        op2_bradley_terry_quality,
        op3_class_lm,
        op4_repair_token_files,
        op5_rule_ledger,
        op6_lpf_dedup,
        op7_token_counts,
        op8_nbest_pieces,
        op9_site_spread_lines,
        op10_jaccard_join,
        op11_source_mix,
        op12_spelling_variants,
        op13_ranked_search,
    )
}
ORACLES = {"op5_rule_ledger": OP5_SQL, "op9_site_spread_lines": OP9_SQL, "op12_spelling_variants": OP12_SQL, "op13_ranked_search": OP13_SQL}
