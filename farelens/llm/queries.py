"""The operators' queries for the driver contract: one per operator over its whole table."""

from __future__ import annotations

from .ann import op9_nearest
from .bpe import op6_bpe
from .language import op2_language_id
from .ngram_join import op8_ngram_join
from .packing import op4_packing
from .piece_bpe import op11_sentencepiece
from .prefix_trie import ORACLE as TRIE_SQL
from .prefix_trie import op13_prefix_trie
from .secrets import op5_secrets
from .substring_dedup import op10_substring_dedup
from .suffix_dedup import op1_suffix_array
from .token_files import op3_token_files
from .vector_codes import ORACLE as CODES_SQL
from .vector_codes import op12_vector_codes
from .vector_dedup import op7_vector_dedup

QUERIES = {
    "op1_suffix_array": op1_suffix_array,
    "op2_language_id": op2_language_id,
    "op3_token_files": op3_token_files,
    "op4_packing": op4_packing,
    "op5_secrets": op5_secrets,
    "op6_bpe": op6_bpe,
    "op7_vector_dedup": op7_vector_dedup,
    "op8_ngram_join": op8_ngram_join,
    "op9_nearest": op9_nearest,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_sentencepiece": op11_sentencepiece,
    "op12_vector_codes": op12_vector_codes,
    "op13_prefix_trie": op13_prefix_trie,
}

#: The others have no SQL form that is fast enough on whole tables; tests/llm compares each with brute force or its library.
ORACLE_SQL: dict[str, str] = {"op12_vector_codes": CODES_SQL, "op13_prefix_trie": TRIE_SQL}
