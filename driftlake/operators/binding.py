"""Edges between message realizations and causes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EDGE = ["fingerprint", "cause_id", "confidence", "basis", "note"]


def _edge(df: DataFrame, confidence, basis: str, note) -> DataFrame:
    return df.select("fingerprint", "cause_id", confidence.cast("double").alias("confidence"), F.lit(basis).alias("basis"), note.cast("string").alias("note"))


def edges(realizations: DataFrame, by_name: DataFrame | None = None, declared: DataFrame | None = None, instrumented: DataFrame | None = None) -> DataFrame:
    """All edges of realizations (fingerprint, error_name): instrumented (fingerprint, cause_id), by error name (error_name, cause_id), declared (fingerprint, cause_id, confidence, note). Many to many; the three ways add up."""
    parts = []
    if instrumented is not None:
        parts.append(_edge(realizations.join(instrumented, "fingerprint"), F.lit(1.0), "instrumented", F.lit(None)))
    if by_name is not None:
        parts.append(_edge(realizations.where(F.nullif("error_name", F.lit("")).isNotNull()).join(by_name, "error_name"), F.lit(1.0), "error_name", F.col("error_name")))
    if declared is not None:
        parts.append(_edge(realizations.select("fingerprint").join(declared, "fingerprint"), F.col("confidence"), "declared", F.col("note")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def unbound(realizations: DataFrame, bound: DataFrame) -> DataFrame:
    return realizations.join(bound.select("fingerprint"), "fingerprint", "left_anti")


def stale(declared: DataFrame, live: DataFrame) -> DataFrame:
    """Declared fingerprints that no live realization has, sorted."""
    return declared.select("fingerprint").distinct().join(live.select("fingerprint"), "fingerprint", "left_anti").orderBy("fingerprint")
