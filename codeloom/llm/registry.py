"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from .fingerprints import op9_document_fingerprints
from .language import op2_language_identification
from .nearest import op8_nearest_neighbours
from .ngram_join import OP10_SQL, op10_ngram_jaccard_join
from .packing import op1_best_fit_packing
from .passages import op4_repeated_passages
from .phrase_index import OP11_SQL, op11_benchmark_decontamination
from .prefix_trie import OP12_SQL, op12_conversation_prefix_trie
from .sentencepieces import op5_sentencepiece
from .sharding import op3_balanced_sharding
from .token_files import op6_token_files
from .warc import OP7_SQL, op7_warc_transactions

QUERIES = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_language_identification": op2_language_identification,
    "op3_balanced_sharding": op3_balanced_sharding,
    "op4_repeated_passages": op4_repeated_passages,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_token_files": op6_token_files,
    "op7_warc_transactions": op7_warc_transactions,
    "op8_nearest_neighbours": op8_nearest_neighbours,
    "op9_document_fingerprints": op9_document_fingerprints,
    "op10_ngram_jaccard_join": op10_ngram_jaccard_join,
    "op11_benchmark_decontamination": op11_benchmark_decontamination,
    "op12_conversation_prefix_trie": op12_conversation_prefix_trie,
}
ORACLE_SQL: dict[str, str] = {
    "op7_warc_transactions": OP7_SQL,
    "op10_ngram_jaccard_join": OP10_SQL,
    "op11_benchmark_decontamination": OP11_SQL,
    "op12_conversation_prefix_trie": OP12_SQL,
}
