"""The training-data queries, by name, and the SQL that returns the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .decontamination import OP7_SQL, op7_suffix_automaton_decontamination
from .packing import op9_configuration_lp_packing
from .pii import op3_information_theoretic_pii
from .sharding import op8_hash_tree_sharding
from .simhash import op1_simhash_near_dedup
from .substrings import op5_substring_dedup
from .tokenstore import op10_content_addressed_tokens
from .toxicity import op6_ordinal_toxicity
from .vptree import OP4_SQL, op4_vantage_point_neighbours
from .warc import OP2_SQL, op2_warc_chunks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash_near_dedup": op1_simhash_near_dedup,
    "op2_warc_chunks": op2_warc_chunks,
    "op3_information_theoretic_pii": op3_information_theoretic_pii,
    "op4_vantage_point_neighbours": op4_vantage_point_neighbours,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_ordinal_toxicity": op6_ordinal_toxicity,
    "op7_suffix_automaton_decontamination": op7_suffix_automaton_decontamination,
    "op9_configuration_lp_packing": op9_configuration_lp_packing,
    "op8_hash_tree_sharding": op8_hash_tree_sharding,
    "op10_content_addressed_tokens": op10_content_addressed_tokens,
}

ORACLE_SQL: dict[str, str] = {
    "op2_warc_chunks": OP2_SQL,
    "op4_vantage_point_neighbours": OP4_SQL,
    "op7_suffix_automaton_decontamination": OP7_SQL,
}
