"""Registered queries of this subpackage: one for each operator, over its whole table."""

from __future__ import annotations

from .bpe_fst import op6_bpe_transducer
from .exact import OP4_SQL, op4_exact_dedup
from .lines import op8_line_dedup
from .minhash import op9_minhash_near_dedup
from .packing import op10_best_fit_packing
from .quality import op5_quality_rules
from .sharding import op2_minimax_shards
from .substrings import op3_substring_dedup, op7_suffix_array_dedup
from .token_index import op1_token_index

QUERIES = {
    f.__name__: f
    for f in (
        op1_token_index, op2_minimax_shards, op3_substring_dedup, op4_exact_dedup, op5_quality_rules,
        op6_bpe_transducer, op7_suffix_array_dedup, op8_line_dedup, op9_minhash_near_dedup, op10_best_fit_packing,
    )
}

#: DuckDB SQL where SQL can say the same.
ORACLES: dict[str, str] = {"op4_exact_dedup": OP4_SQL}
