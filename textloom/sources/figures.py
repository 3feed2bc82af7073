"""Figures of a run, observed while it runs: no second look at the data."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from . import documents


def validated(df: DataFrame, seen: Observation, cap: int = documents.DEFAULT_CAP) -> DataFrame:
    """The rows that are fit. `seen` gets rows, refused and characters of all that came, once an action has run."""
    marked = df.withColumn("_reason", documents.rejection(cap))
    n = F.coalesce(F.char_length("text"), F.lit(0)).cast("long")
    marked = marked.observe(seen, F.count(F.lit(1)).alias("rows"), F.count("_reason").alias("refused"), F.coalesce(F.sum(n), F.lit(0)).alias("characters"))
    return marked.filter("_reason IS NULL").drop("_reason")


def rewritten(df: DataFrame, seen: Observation) -> DataFrame:
    """df as workflows.rewritten() gives it. `seen` gets rows, changed, the characters before and after, and how many entries the audits have."""
    n = lambda c: F.coalesce(F.sum(F.char_length(c)), F.lit(0)).cast("long")
    changed = F.count_if(~F.col("source").eqNullSafe(F.col("text")))
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), changed.alias("changed"), n("source").alias("characters"), n("text").alias("characters_after"), F.coalesce(F.sum(F.size("transformations")), F.lit(0)).cast("long").alias("entries"))
