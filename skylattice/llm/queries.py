"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from .bpe_codec import op5_bpe_codec
from .chat_format import OP10_SQL, op10_chat_format
from .decontaminate import OP3_SQL, op3_decontaminate
from .hard_negatives import OP11_SQL, op11_hard_negatives
from .jaccard_join import OP12_SQL, op12_ngram_jaccard_join
from .license_scan import OP7_SQL, op7_license_scan
from .line_dedup import OP9_SQL, op9_line_dedup
from .lm_scoring import op6_lm_score
from .merkle import OP13_SQL, op13_merkle_manifest
from .quality_rules import OP2_SQL, op2_quality_rules
from .simhash import op8_simhash_near_duplicates
from .token_counts import op1_token_counts
from .toxicity import op4_toxicity

QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_quality_rules": op2_quality_rules,
    "op3_decontaminate": op3_decontaminate,
    "op4_toxicity": op4_toxicity,
    "op5_bpe_codec": op5_bpe_codec,
    "op6_lm_score": op6_lm_score,
    "op7_license_scan": op7_license_scan,
    "op8_simhash_near_duplicates": op8_simhash_near_duplicates,
    "op9_line_dedup": op9_line_dedup,
    "op10_chat_format": op10_chat_format,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_ngram_jaccard_join": op12_ngram_jaccard_join,
    "op13_merkle_manifest": op13_merkle_manifest,
}

ORACLES: dict[str, str] = {"op2_quality_rules": OP2_SQL, "op3_decontaminate": OP3_SQL, "op7_license_scan": OP7_SQL, "op9_line_dedup": OP9_SQL, "op10_chat_format": OP10_SQL, "op11_hard_negatives": OP11_SQL, "op12_ngram_jaccard_join": OP12_SQL, "op13_merkle_manifest": OP13_SQL}
