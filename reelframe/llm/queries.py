"""Queries of the corpus operators, as ``__spark_entry__`` registers them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import exact_dedup, html_text, line_dedup, mixing, packing, quality_classifier, quality_rules, secrets, simhash, token_counts
from .common import table


def _over(query: Callable[..., DataFrame], *names: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: query(*[table(spark, sf_dir, n) for n in names])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": _over(token_counts.query, "documents"),
    "op2_quality_rules": _over(quality_rules.query, "documents", "labels"),
    "quality_rules_pooled": _over(quality_rules.pooled, "documents", "labels"),
    "op3_packing": _over(packing.query, "documents"),
    "op4_mixing": _over(mixing.query, "documents"),
    "op5_exact_dedup": _over(exact_dedup.query, "documents"),
    "op6_html_text": _over(html_text.query, "pages"),
    "op7_line_dedup": _over(line_dedup.query, "documents"),
    "op8_simhash": _over(simhash.query, "documents"),
    "op9_secrets": _over(secrets.query, "documents"),
    "op10_quality_classifier": _over(quality_classifier.query, "documents", "labels"),
}

ORACLE_SQL: dict[str, str] = {
    "op2_quality_rules": quality_rules.ORACLE_SQL,
    "quality_rules_pooled": quality_rules.POOLED_SQL,
    "op5_exact_dedup": exact_dedup.ORACLE_SQL,
}
