"""Sentences by capitals behind end marks, put together again behind abbreviations, as islands."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from ..functions import arrays, batches

#: Blanks of all kinds. Where sentences may end, and abbreviations behind which they don't.
BLANK = r"[\t-\r \x85\xA0  -     　]"
ABBREVIATIONS = ("mr", "mrs", "ms", "dr", "prof", "sr", "jr", "st", "mt", "ft", "vs", "etc", "inc", "ltd", "co", "e.g", "i.e", "cf", "u.s", "u.k", "u.n", "e.u", "no", "vol", "fig", "ed")
WORD = BLANK.replace("[", "[^", 1) + "+"
_END, _WORD = re.compile(rf"[.!?]{BLANK}+(?=[A-Zא-ת])"), re.compile(WORD)
_LAST = re.compile(r"([A-Za-z.]+)\.\Z")
#: More characters than an abbreviation, its point and a letter before it take.
_SHORT = max(map(len, ABBREVIATIONS)) + 4
#: Blanks for Python's own splitting of words, but not for BLANK.
_OTHER = re.compile("[\x1c-\x1f]")


def lengths(text: str) -> list[int]:
    """Words of each sentence. A sentence is an island of pieces of which all but the last end in an abbreviation."""
    out, at, joins = [], 0, False
    plain = not _OTHER.search(text)
    for a, b in [*((m.start() + 1, m.end()) for m in _END.finditer(text)), (len(text), len(text))]:
        piece, at = text[at:a], b
        if not piece:
            continue
        n = len(piece.split()) if plain else len(_WORD.findall(piece))
        if joins:
            out[-1] += n
        else:
            out.append(n)
        joins = piece.endswith(".") and (m := _LAST.search(piece[-_SHORT:])) is not None and m[1].lower() in ABBREVIATIONS
    return out


@F.arrow_udf(ArrayType(LongType()))
def _lengths(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        yield pa.array([lengths(t) for t in texts.to_pylist()], pa.list_(pa.int64()))


def sentence_lengths(text: Column) -> Column:
    """Words of each sentence, as an array; a null text has none. One pass over the text in Arrow batches."""
    batches.small(SparkSession.getActiveSession())
    return _lengths(F.coalesce(text, F.lit("")))


def structural_burstiness(text: Column) -> Column:
    """How much the sentences of a text differ in length: standard deviation over mean of their words; 0 without words."""

    def spread(lengths: Column) -> Column:
        mean = F.aggregate(lengths, F.lit(0.0), lambda a, n: a + n) / F.size(lengths)
        return arrays.let(mean, lambda m: F.sqrt(F.aggregate(lengths, F.lit(0.0), lambda a, n: a + (n - m) * (n - m)) / F.size(lengths)) / m)

    return arrays.let(sentence_lengths(text), lambda x: F.when(F.exists(x, lambda n: n > 0), spread(x)).otherwise(F.lit(0.0)))
