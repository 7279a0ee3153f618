"""The training-data queries: name -> (function of session and folder, DuckDB SQL or None)."""

from __future__ import annotations

from .benchmark_decontamination import OP5_SQL, op5_benchmark_decontamination
from .language_cnn import op7_language_cnn
from .language_scores import op13_language_scores
from .mpeg_audio import op8_mpeg_audio
from .periodic_runs import OP12_SQL, op12_periodic_runs
from .pivotal_mix import op1_pivotal_mix
from .prefix_trie import OP11_SQL, op11_prefix_trie
from .secret_ledger import op9_secret_ledger
from .simhash_pivots import op10_simhash_pivots
from .substring_dedup import OP6_SQL, op6_substring_dedup
from .token_counts import op3_token_counts
from .token_planes import op2_token_planes
from .toxicity_mil import op4_toxicity_mil

REGISTRY = {
    "op1_pivotal_mix": (op1_pivotal_mix, None),
    "op2_token_planes": (op2_token_planes, None),
    "op3_token_counts": (op3_token_counts, None),
    "op4_toxicity_mil": (op4_toxicity_mil, None),
    "op5_benchmark_decontamination": (op5_benchmark_decontamination, OP5_SQL),
    "op6_substring_dedup": (op6_substring_dedup, OP6_SQL),
    "op7_language_cnn": (op7_language_cnn, None),
    "op8_mpeg_audio": (op8_mpeg_audio, None),
    "op9_secret_ledger": (op9_secret_ledger, None),
    "op10_simhash_pivots": (op10_simhash_pivots, None),
    "op11_prefix_trie": (op11_prefix_trie, OP11_SQL),
    "op12_periodic_runs": (op12_periodic_runs, OP12_SQL),
    "op13_language_scores": (op13_language_scores, None),
}
