"""Registered queries of the training-data operators, and SQL where it can express them."""

from __future__ import annotations

from .best_position import OP11_SQL, op11_best_position
from .bpe_transducer import op9_bpe_transducer
from .byte_cnn import op3_byte_cnn
from .cover_tree import OP5_SQL, op5_cover_tree
from .exact_dedup import OP7_SQL, op7_exact_dedup
from .language_id import op8_language_id
from .license_scan import op4_license_scan
from .merkle_manifest import OP13_SQL, op13_merkle_manifest
from .minhash_dedup import OP10_SQL, op10_minhash_dedup
from .mixing import op1_mixing
from .ppm_scoring import op2_ppm_scoring
from .sharding import OP12_SQL, op12_feistel_shards
from .url_trees import op6_url_trees

QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_ppm_scoring": op2_ppm_scoring,
    "op3_byte_cnn": op3_byte_cnn,
    "op4_license_scan": op4_license_scan,
    "op5_cover_tree": op5_cover_tree,
    "op6_url_trees": op6_url_trees,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_language_id": op8_language_id,
    "op9_bpe_transducer": op9_bpe_transducer,
    "op10_minhash_dedup": op10_minhash_dedup,
    "op11_best_position": op11_best_position,
    "op12_feistel_shards": op12_feistel_shards,
    "op13_merkle_manifest": op13_merkle_manifest,
}
ORACLES = {
    "op5_cover_tree": OP5_SQL,
    "op7_exact_dedup": OP7_SQL,
    "op10_minhash_dedup": OP10_SQL,
    "op11_best_position": OP11_SQL,
    "op12_feistel_shards": OP12_SQL,
    "op13_merkle_manifest": OP13_SQL,
}
