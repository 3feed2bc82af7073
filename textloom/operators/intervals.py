"""Joins of intervals: which ones overlap, which points lie in which."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Width of a bin. An interval stands in every bin that it touches.
WIDTH = 1024


def binned(df: DataFrame, s: str, e: str, width: int = WIDTH) -> DataFrame:
    """df with _bin, a row for each bin that [s, e) touches; empty intervals go."""
    first, last = F.floor(F.col(s) / width).cast("long"), F.floor((F.col(e) - 1) / width).cast("long")
    return df.filter(F.col(s) < F.col(e)).withColumn("_bin", F.explode(F.sequence(first, last)))


def overlapping(left: DataFrame, right: DataFrame, keys: list[str], spans: tuple[str, str] = ("s", "e"), others: tuple[str, str] = ("s", "e"), width: int = WIDTH) -> DataFrame:
    """Pairs of rows with equal keys whose intervals [s, e) share a place, each once: keys, left's columns, right's columns with other_ before.

    An equi-join on keys and bin, so that the intervals of one long text spread over tasks and are compared only within a bin; the exact test
    follows. A pair that shares several bins counts in the first of them.
    """
    a, b = binned(left, *spans, width), binned(right, *others, width)
    b = b.select(*keys, "_bin", *[F.col(c).alias(f"other_{c}") for c in right.columns if c not in keys])
    s, e, t, u = (F.col(c) for c in (*spans, *(f"other_{c}" for c in others)))
    first: Column = F.floor(F.greatest(s, t) / width)
    return a.join(b, [*keys, "_bin"]).filter((s < u) & (t < e) & (F.col("_bin") == first)).drop("_bin")


def points_within(points: DataFrame, spans: DataFrame, keys: list[str], at: str, width: int = WIDTH) -> DataFrame:
    """Pairs of a point and an interval [s, e) of `spans` that it lies in, as overlapping() gives them."""
    return overlapping(points.withColumn("_end", F.col(at) + 1), spans, keys, (at, "_end"), ("s", "e"), width).drop("_end")
