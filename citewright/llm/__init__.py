"""Operators for training-data pipelines, with the queries and SQL that check them.

Nothing else in the package imports this subpackage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from citewright.llm import decontam, exact, html, lines, lm, minhash, packing, quality, sharding, suffix


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_factorisation_machine": quality.op1_factorisation_machine,
        "op2_minhash": minhash.op2_minhash,
        "op3_rendezvous": sharding.op3_rendezvous,
        "op4_context_mixing": lm.op4_context_mixing,
        "op5_block_tree": html.op5_block_tree,
        "op6_bin_completion": packing.op6_bin_completion,
        "op7_exact_dedup": exact.op7_exact_dedup,
        "op8_suffix_array": suffix.op8_suffix_array,
        "op9_wu_manber": decontam.op9_wu_manber,
        "op10_line_dedup": lines.op10_line_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {"op7_exact_dedup": exact.ORACLE, "op9_wu_manber": decontam.ORACLE, "op10_line_dedup": lines.ORACLE}
