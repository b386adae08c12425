"""The registered queries of this subpackage and their SQL."""

from playtrail.llm import (
    alignment,
    chat,
    compression,
    decontaminate,
    divergence,
    jaccard,
    language,
    passages,
    quality_rules,
    sampling,
    token_counts,
    token_files,
    toxicity,
)
from playtrail.llm.common import shipped

_QUERIES = {
    "op1_token_counts": token_counts.op1_token_counts,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_decontaminate": decontaminate.op3_decontaminate,
    "op4_token_files": token_files.op4_token_files,
    "op5_substring_dedup": passages.op5_substring_dedup,
    "op6_piece_sampling": sampling.op6_piece_sampling,
    "op7_chat_format": chat.op7_chat_format,
    "op8_quality_rules": quality_rules.op8_quality_rules,
    "op9_jaccard_join": jaccard.op9_jaccard_join,
    "op10_compression_quality": compression.op10_compression_quality,
    "op11_language": language.op11_language,
    "op12_tokenizer_alignment": alignment.op12_tokenizer_alignment,
    "op13_source_divergence": divergence.op13_source_divergence,
}
QUERIES = {name: shipped(query) for name, query in _QUERIES.items()}
SQL = {
    "op3_decontaminate": decontaminate.OP3_SQL,
    "op5_substring_dedup": passages.OP5_SQL,
    "op7_chat_format": chat.OP7_SQL,
    "op9_jaccard_join": jaccard.OP9_SQL,
    "op13_source_divergence": divergence.OP13_SQL,
}
