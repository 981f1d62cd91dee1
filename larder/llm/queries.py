"""The registered queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from .automaton import op8_bpe_automaton
from .fingerprints import op6_fingerprints
from .infill import ORACLE as INFILL_SQL
from .infill import op13_infill
from .jaccard import op3_jaccard_join
from .language import op9_language_id
from .neighbours import op5_neighbours
from .packing import op2_packing
from .prefix_trie import ORACLE as TRIE_SQL
from .prefix_trie import op12_prefix_trie
from .quality import op11_quality
from .sharding import ORACLE as SHARDING_SQL
from .sharding import op10_sharding
from .substring_dedup import op1_substring_dedup
from .token_files import op4_token_files
from .toxicity import op7_toxicity

QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_packing": op2_packing,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_token_files": op4_token_files,
    "op5_neighbours": op5_neighbours,
    "op6_fingerprints": op6_fingerprints,
    "op7_toxicity": op7_toxicity,
    "op8_bpe_automaton": op8_bpe_automaton,
    "op9_language_id": op9_language_id,
    "op10_sharding": op10_sharding,
    "op11_quality": op11_quality,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_infill": op13_infill,
}

#: Queries that SQL can express; the others are held against brute force in tests/llm.
ORACLE_SQL: dict[str, str] = {
    "op10_sharding": SHARDING_SQL,
    "op12_prefix_trie": TRIE_SQL,
    "op13_infill": INFILL_SQL,
}
