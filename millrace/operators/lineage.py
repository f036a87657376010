"""Why something is there: from outputs to sources, and from a fact to its claims and readers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import facts


def explain_path(path, artifacts: DataFrame, reads: DataFrame) -> DataFrame:
    """record and source of one artifact: artifacts (path, record), reads (record, source)."""
    return artifacts.where(F.col("path") == path).select("record").join(reads, "record").select("record", "source").distinct()


def explain_identity(edge, reads: DataFrame) -> DataFrame:
    """Records that read an edge (edge, record)."""
    return reads.where(F.col("edge") == edge).select("record").distinct()


def explain_fact(claims: DataFrame, subject, key) -> DataFrame:
    """All claims on a fact, ranked; 1 holds."""
    return facts.ranked(claims.where((F.col("subject") == subject) & (F.col("key") == key)))


def explain_finding(findings: DataFrame, runs: DataFrame, code, pos) -> DataFrame:
    """The executions (record) that reported a finding (code, pos, record), with what is known of them."""
    return findings.where((F.col("code") == code) & (F.col("pos") == pos)).join(runs, "record")


def support_matrix(verdicts: DataFrame, row: str, column: str, values: list, verdict: str) -> DataFrame:
    """One row per feature with a column for each language: the least verdict, null where there is none."""
    return verdicts.groupBy(row).pivot(column, values).agg(F.min(verdict))
