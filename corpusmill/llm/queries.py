"""Queries of the training-data problems and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusmill.llm import p1_pairs, p2_overlap, p3_leaks, p4_grammar, p5_encode, p6_mixing, p7_residue

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_pairs.p1_found,
    "p1_report": p1_pairs.p1_report,
    "p2_found": p2_overlap.p2_found,
    "p2_report": p2_overlap.p2_report,
    "p2_classes": p2_overlap.p2_classes,
    "p3_found": p3_leaks.p3_found,
    "p3_items": p3_leaks.p3_items,
    "p4_found": p4_grammar.p4_found,
    "p4_scores": p4_grammar.p4_scores,
    "p4_rates": p4_grammar.p4_rates,
    "p5_ids": p5_encode.p5_ids,
    "p6_selection": p6_mixing.p6_selection,
    "p6_blocks": p6_mixing.p6_blocks,
    "p6_shares": p6_mixing.p6_shares,
    "p7_found": p7_residue.p7_found,
    "p7_clean": p7_residue.p7_clean,
    "p7_kinds": p7_residue.p7_kinds,
}
SQL: dict[str, str] = {}
