"""Queries of this subpackage and the SQL that states some of them."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: Module and function of each operator's query.
QUERIES = {
    "op1_mixing": ("mixing", "op1_mixing"),
    "op2_fingerprints": ("simhash", "op2_fingerprints"),
    "op3_language": ("language", "op3_language"),
    "op4_token_files": ("tokenfile", "op4_token_files"),
    "op5_sentencepiece": ("pieces", "op5_sentencepiece"),
    "op6_near_dedup": ("neardup", "op6_near_dedup"),
    "op7_secrets": ("secrets", "op7_secrets"),
    "op8_suffix_dedup": ("suffixes", "op8_suffix_dedup"),
    "op9_toxicity": ("toxicity", "op9_toxicity"),
    "op10_top_k": ("topk", "op10_top_k"),
    "op11_ranked_search": ("lexical", "op11_ranked_search"),
    "op12_filter_audit": ("audit", "op12_filter_audit"),
    "op13_decontamination": ("decontaminate", "op13_decontamination"),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: getattr(import_module(f"loomgraph.llm.{module}"), function) for name, (module, function) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """Only what SQL can state: the others are tested against brute force."""
    from loomgraph.llm.audit import OP12_SQL
    from loomgraph.llm.decontaminate import OP13_SQL
    from loomgraph.llm.lexical import OP11_SQL
    from loomgraph.llm.topk import OP10_SQL

    return {"op10_top_k": OP10_SQL, "op11_ranked_search": OP11_SQL, "op12_filter_audit": OP12_SQL, "op13_decontamination": OP13_SQL}
