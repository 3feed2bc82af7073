"""Words and sentences as array columns."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from . import arrays
from . import batches as batch

#: What a word is, by language, and where sentences end.
WORD = {"en": "[A-Za-z']+", "he": "[\\u05D0-\\u05EA]+"}
SENTENCE_END = r"[.!?]+\s+"


def words(text: Column, language: Column) -> Column:
    found = F.when(language == "en", F.regexp_extract_all(text, F.lit(WORD["en"]), F.lit(0))).otherwise(F.regexp_extract_all(text, F.lit(WORD["he"]), F.lit(0)))
    return F.transform(found, F.lower)


def word_count(text: Column, language: Column) -> Column:
    return F.when(language == "en", F.regexp_count(text, F.lit(WORD["en"]))).otherwise(F.regexp_count(text, F.lit(WORD["he"])))


def sentences(text: Column) -> Column:
    """Pieces between sentence ends, trimmed, without blank ones. The end marks go, but for the last."""
    trimmed = F.transform(F.split(text, SENTENCE_END, -1), lambda s: F.regexp_replace(s, r"^\s+|\s+$", ""))
    return F.filter(trimmed, lambda s: s != "")


_CUT = re.compile(r"[.!?](?=\s)", re.ASCII)


def segments(text: Column) -> Column:
    """array<struct<start, end, text>> (code points) of the sentences with their end marks, cut before the blanks that follow an end mark."""

    def placed(t: str) -> list[tuple[int, int, str]]:
        out, at = [], 0
        for end in [*(m.end() for m in _CUT.finditer(t)), len(t)]:
            own = t[at:end].lstrip(" \t\n\r\f\v") if at else t[:end]
            if own:
                out.append((end - len(own), end, own))
            at = end
        return out

    @F.arrow_udf("array<struct<start:int,end:int,text:string>>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield batch.nested((placed(t) if t else [] for t in texts.to_pylist()), {"start": pa.int32(), "end": pa.int32(), "text": pa.string()})

    batch.small(SparkSession.getActiveSession())
    return run(text)


def matches(text: Column, pattern: str) -> Column:
    """array<struct<s, e, value>> (code points) of a pattern's matches, in order: places add up from the lengths of the matches and of what is between."""

    def placed(x: Column) -> Column:
        ends = arrays.sums(F.transform(x["m"], lambda v, i: (F.char_length(F.get(x["q"], i)) + F.char_length(v)).cast("long")))
        return arrays.let(ends, lambda e: F.transform(x["m"], lambda v, i: F.struct((F.get(e, i) - F.char_length(v)).cast("int").alias("s"), F.get(e, i).cast("int").alias("e"), v.alias("value"))))

    return arrays.let(F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("q")), placed)
