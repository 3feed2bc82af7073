"""Marks written into texts where spans begin and end."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import stored
from . import intervals

EVENTS = "array<struct<at:int,mark:string>>"
#: Characters that stand for markup, and what stands for them.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"))


def clipped(spans: DataFrame, keys: list[str]) -> DataFrame:
    """spans (keys, s, e, tag) so that any two are nested or apart: one that begins within another and reaches beyond it ends with it."""
    spans = spans.select(*keys, F.col("s").cast("int").alias("s"), F.col("e").cast("int").alias("e"), "tag").filter("s < e").distinct()
    over = intervals.overlapping(spans, spans, keys).filter("other_s < s AND other_e < e").groupBy(*keys, "s", "e", "tag").agg(F.min("other_e").alias("end"))
    return spans.join(over, [*keys, "s", "e", "tag"], "left").select(*keys, "s", F.coalesce("end", "e").alias("e"), "tag").distinct()


def events(spans: DataFrame, keys: list[str]) -> DataFrame:
    """keys, events: the marks of a text's spans in the order in which they stand. At one place closing marks come first, inner before outer; then
    opening ones, outer before inner."""
    opened = F.struct(F.col("s").alias("at"), F.lit(1).alias("opens"), (-F.col("e")).alias("o"), F.col("tag").alias("tag"), F.concat(F.lit("<"), "tag", F.lit(">")).alias("mark"))
    # Tags of equal spans close in turned order: by the complement of their code points' order, a rank within the span.
    closed = F.struct(F.col("e").alias("at"), F.lit(0).alias("opens"), (-F.col("s")).alias("o"), F.col("turned").alias("tag"), F.concat(F.lit("</"), "tag", F.lit(">")).alias("mark"))
    same = spans.groupBy(*keys, "s", "e").agg(F.sort_array(F.collect_set("tag")).alias("tags"))  # tags of one span
    each = same.select(*keys, "s", "e", F.posexplode("tags").alias("i", "tag"), F.size("tags").alias("n")).withColumn("turned", F.lpad((F.col("n") - F.col("i")).cast("string"), 9, "0"))
    marks = each.select(*keys, F.explode(F.array(opened, closed)).alias("x"))
    return marks.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list("x")), lambda x: F.struct(x["at"].alias("at"), x["mark"].alias("mark"))).alias("events"))


def woven(text: Column, marks: Column) -> Column:
    """A text, escaped, with marks (at, mark) put in; they must be in order."""

    @F.arrow_udf("string")
    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        def escaped(t: str) -> str:
            for a, b in ESCAPES:
                t = t.replace(a, b)
            return t

        for some in batches:
            out = []
            for t, found in zip(*(x.to_pylist() for x in some), strict=True):
                parts, done = [], 0
                for x in found if t is not None else ():
                    parts += [escaped(t[done : x["at"]]), x["mark"]]
                    done = x["at"]
                out.append(None if t is None else "".join([*parts, escaped(t[done:])]))
            yield pa.array(out, pa.string())

    return run(text, F.coalesce(marks, F.array().cast(EVENTS)))


def rendered(df: DataFrame, keys: list[str], spans: DataFrame) -> DataFrame:
    """df (keys, text, ...) with `rendered`: the text, its markup characters escaped, with <tag> and </tag> around each span (keys, s, e, tag).

    Spans are code points, end exclusive, and lie within the text; crossing ones are clipped; empty ones go. A null text stays null.
    Clipping looks at the spans three times, so they are stored, not found anew each time.
    """
    return df.join(events(clipped(stored(spans), keys), keys), keys, "left").withColumn("rendered", woven(F.col("text"), F.col("events"))).drop("events")
