"""The workflows: detect, rewrite, and rewrite by a client, as chains of DataFrame steps.

Keys must identify rows. Scores need one short shuffle each (a row of numbers per text); rewriting needs none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..operators import hidden, metrics, rewrite, scorer
from ..sources.documents import with_options

LOG_LIMIT = 50


def detect(df: DataFrame, keys: list[str], load=None, lexicon: DataFrame | None = None, machine_phrases: dict = lx.MACHINE_PHRASES) -> DataFrame:
    """Metrics, probability, verdict, findings, the top five sentences and the optional model's score of each text, by one's own words and phrases if given."""
    df = with_options(df)
    top = metrics.top_segments(df, keys, 5, lexicon, machine_phrases).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("rank", "start", "end", "text", "sub_score", "reason"))).alias("segments"))  # five at most
    marked = scorer.score_with(hidden.findings(df), load)
    if lexicon is None:  # all in the row
        found = metrics.detect(marked, keys, ["findings", "model_score"], None, machine_phrases)
    else:
        found = metrics.detect(df, keys, (), lexicon, machine_phrases).join(marked.select(*keys, "findings", "model_score"), keys)
    return found.join(top, keys, "left")


def _cleaned(df: DataFrame, wanted) -> DataFrame:
    """Cleaned where wanted, with the report as `report`."""
    out = hidden.clean(df.withColumn("_raw", F.col("text")))
    report = F.struct(F.when(wanted, F.col("removed_count")).otherwise(0).alias("removed_count"), F.when(wanted, F.col("normalized_count")).otherwise(0).alias("normalized_count"), F.when(wanted, F.col("findings")).otherwise(F.array().cast(hidden.FINDING)).alias("findings"))
    return out.withColumn("report", report).withColumn("text", F.when(wanted, F.col("text")).otherwise(F.col("_raw"))).drop("_raw", "removed_count", "normalized_count", "findings")


def rewritten(df: DataFrame, keys: list[str], client=None, use_client: bool = False, seed: int = 0, **tables) -> DataFrame:
    """seed and tables (tells, known, phrases) go to rewrite.layers(). Gives keys, language, strength, source (the text as it was), text, transformations (50 at most), report of the first cleaning."""
    df = with_options(df).select(*keys, "text", "language", "strength", "clean_watermarks").withColumn("source", F.col("text"))
    df = _cleaned(df, F.col("clean_watermarks")).withColumnRenamed("report", "first_report")
    if use_client:
        df = _cleaned(scorer.rewritten_by(df, client), F.lit(True)).drop("report")
    df = rewrite.layers(df, keys, seed, **tables)
    df = _cleaned(df, F.lit(True)).drop("report")
    return df.withColumn("transformations", F.slice("transformations", 1, LOG_LIMIT)).withColumnRenamed("first_report", "report")


def before_and_after(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys, probability and verdict of a rewritten() frame's source and text. The frame is made once; both texts of a row are measured in it."""
    out = metrics.detect(df.select(*keys, F.col("source").alias("text"), "language", F.col("text").alias("_new")), keys, ["_new"])
    out = out.select(*keys, "language", F.col("_new").alias("text"), F.col("ai_probability").alias("probability_before"), F.col("verdict").alias("verdict_before"))
    out = metrics.detect(out, keys, ["probability_before", "verdict_before"])
    return out.select(*keys, "probability_before", "verdict_before", F.col("ai_probability").alias("probability_after"), F.col("verdict").alias("verdict_after"))
