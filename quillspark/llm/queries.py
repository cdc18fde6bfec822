"""The queries of the training-data operators, and their SQL."""

from __future__ import annotations

from .bpe import op9_byte_bpe
from .hnsw import op4_embedding_dedup
from .langid import op7_language_id
from .lines import op1_line_dedup
from .minhash import op3_minhash_dedup
from .mixing import OP2_SQL, op2_mix_sources
from .nndescent import op10_nearest_neighbours
from .pii import op5_pseudonyms
from .sharding import op8_shard_lpt
from .suffixes import op6_suffix_dedup

QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_mix_sources": op2_mix_sources,
    "op3_minhash_dedup": op3_minhash_dedup,
    "op4_embedding_dedup": op4_embedding_dedup,
    "op5_pseudonyms": op5_pseudonyms,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_language_id": op7_language_id,
    "op8_shard_lpt": op8_shard_lpt,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_nearest_neighbours": op10_nearest_neighbours,
}

SQL = {"op2_mix_sources": OP2_SQL}
