"""Operators: DataFrame in, DataFrame out."""

from .aggregates import argmax, count_sum_by, max_by_key, mean_by, signed_ratio_by, sums_by
from .exact import exact_sums_by
from .filters import keep_unless
from .heavy import top_counts
from .normalize import min_max_normalize
from .sets import split_tagged, symmetric_difference, tagged_difference
from .stored import difference_of_stored, store_keys
from .terms import cut_rows, doc_word_counts, max_tf, term_frequency, word_counts
from .topk import top_distinct_counts, top_n

__all__ = [
    "argmax",
    "count_sum_by",
    "cut_rows",
    "difference_of_stored",
    "doc_word_counts",
    "exact_sums_by",
    "keep_unless",
    "max_by_key",
    "max_tf",
    "mean_by",
    "min_max_normalize",
    "signed_ratio_by",
    "split_tagged",
    "store_keys",
    "sums_by",
    "symmetric_difference",
    "tagged_difference",
    "term_frequency",
    "top_counts",
    "top_distinct_counts",
    "top_n",
    "word_counts",
]
