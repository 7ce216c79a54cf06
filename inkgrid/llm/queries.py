"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bitpack import op9_bitpacked_ids
from .chunk_bpe import op11_chunked_bpe
from .fill_middle import op12_duckdb_fill_in_middle
from .fill_middle import oracle as fill_middle_sql
from .license_scan import license_windows, op8_license_scan
from .license_scan import oracle as license_sql
from .license_scan import windows_oracle as license_windows_sql
from .masked_lm import op4_masked_pseudo_likelihood
from .ngram_join import op1_ngram_jaccard_join
from .packing import op10_vector_packing, pack_conversations
from .piece_codec import op2_sentencepiece_codec
from .prefix_trie import op13_prefix_trie
from .prefix_trie import oracle as prefix_trie_sql
from .suffix_dedup import op6_suffix_dedup
from .toxicity import op7_nb_ngram_toxicity
from .vector_search import op3_adaptive_dimension_scan
from .winnow import op5_winnowing


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_ngram_jaccard_join, op2_sentencepiece_codec, op3_adaptive_dimension_scan, op4_masked_pseudo_likelihood, op5_winnowing, op6_suffix_dedup, op7_nb_ngram_toxicity, op8_license_scan, license_windows, op9_bitpacked_ids, op10_vector_packing, pack_conversations, op11_chunked_bpe, op12_duckdb_fill_in_middle, op13_prefix_trie)}


def oracle_sql() -> dict[str, str]:
    return {"op8_license_scan": license_sql(), "license_windows": license_windows_sql(), "op12_duckdb_fill_in_middle": fill_middle_sql(), "op13_prefix_trie": prefix_trie_sql()}
