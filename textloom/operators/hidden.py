"""Invisible and look-alike characters: findings, counts by kind, and cleaning."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import batches as batch
from ..functions import tokens

# Characters that are stripped, only reported, or turned into plain spaces.
STRIP = {
    "\u200B": "ZERO WIDTH SPACE", "\u200C": "ZERO WIDTH NON-JOINER", "\u200D": "ZERO WIDTH JOINER", "\u2060": "WORD JOINER", "\u180E": "MONGOLIAN VOWEL SEPARATOR",
    "\u00AD": "SOFT HYPHEN", "\u202A": "LEFT-TO-RIGHT EMBEDDING", "\u202B": "RIGHT-TO-LEFT EMBEDDING", "\u202C": "POP DIRECTIONAL FORMATTING", "\u202D": "LEFT-TO-RIGHT OVERRIDE",
    "\u202E": "RIGHT-TO-LEFT OVERRIDE", "\u2061": "FUNCTION APPLICATION", "\u2062": "INVISIBLE TIMES", "\u2063": "INVISIBLE SEPARATOR", "\u2064": "INVISIBLE PLUS",
}
REPORT_ONLY = {"\u200E": "LEFT-TO-RIGHT MARK", "\u200F": "RIGHT-TO-LEFT MARK"}
SPACES = {"\u00A0": "NO-BREAK SPACE", "\u202F": "NARROW NO-BREAK SPACE", "\u2007": "FIGURE SPACE", "\u2008": "PUNCTUATION SPACE", "\u2009": "THIN SPACE", "\u200A": "HAIR SPACE", "\u205F": "MEDIUM MATHEMATICAL SPACE", "\u3000": "IDEOGRAPHIC SPACE"}
BOM = "\uFEFF"
#: Unicode's own names of format characters; those of the class Cc have none.
NAMES = {c: name for c in map(chr, range(0x110000)) if unicodedata.category(c) == "Cf" and (name := unicodedata.name(c, ""))}
KINDS = ["zero_width", "bidi_mark", "bom", "nbsp", "special_space", "control", "homoglyph", "excessive_whitespace"]
#: Characters of the classes Cc and Cf, but for newline, tab and carriage return.
CONTROL = r"[\p{Cc}\p{Cf}&&[^\n\t\r]]"
#: All characters that scan() finds, and those of them that are ASCII.
_ANY = re.compile("[" + "".join(sorted({*STRIP, *REPORT_ONLY, *SPACES, BOM} | {c for c in map(chr, range(0x20000)) if unicodedata.category(c) in ("Cc", "Cf") and c not in "\n\t\r"})) + "\U000E0001\U000E0020-\U000E007F]")
_ANY_ASCII = re.compile(r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]")
FINDING = "array<struct<kind:string,char:string,codepoint:string,index:int,note:string>>"


def code_point(ch: Column) -> Column:
    """U+XXXX, of four digits or as many as it takes."""
    digits = F.hex(F.ascii(ch))
    return F.concat(F.lit("U+"), F.when(F.length(digits) >= 4, digits).otherwise(F.concat(F.repeat(F.lit("0"), F.lit(4) - F.length(digits)), digits)))


def _note(ch: Column) -> Column:
    names = NAMES | STRIP | REPORT_ONLY | SPACES | {BOM: "BYTE ORDER MARK"}
    known = F.create_map(*[F.lit(x) for pair in sorted(names.items()) for x in pair])
    return F.coalesce(F.try_element_at(known, ch), F.lit("UNKNOWN"))


def places(text: Column) -> Column:
    """array<struct<i, c>>: the characters that scan() reports and where they stand, in order. A null text has none."""

    @F.arrow_udf("array<struct<i:int,c:string>>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            found = ([(m.start(), m[0]) for m in (_ANY_ASCII if t.isascii() else _ANY).finditer(t)] if t else [] for t in texts.to_pylist())
            yield batch.nested(found, {"i": pa.int32(), "c": pa.string()})

    batch.small(SparkSession.getActiveSession())
    return run(text)


def scan(text: Column) -> Column:
    """Findings of the character scan, in order."""

    def one(x):
        ch = x["c"]
        kind = F.when(ch.isin(*STRIP), "zero_width").when(ch.isin(*REPORT_ONLY), "bidi_mark").when(ch == BOM, "bom").when(ch == "\u00A0", "nbsp").when(ch.isin(*SPACES), "special_space").otherwise("control")
        return F.struct(kind.alias("kind"), ch.alias("char"), code_point(ch).alias("codepoint"), x["i"].alias("index"), _note(ch).alias("note"))

    return F.transform(places(text), one).cast(FINDING)


#: Blanks of all kinds, which are no look-alikes.
_BLANKS = frozenset("\t\n\v\f\r \x85\xA0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200A\u2028\u2029\u202F\u205F\u3000")


def swapped(text: str, normal: str) -> list[tuple[int, str, str]]:
    """(place, character, the one beside it) where two texts differ, as far as the shorter goes, but for blanks of the first."""
    return [(i, a, b) for i, (a, b) in enumerate(zip(text, normal, strict=False)) if a != b and a not in _BLANKS]


def nfkc(text: Column | str, equal_lengths: bool = False) -> Column:
    """struct<text, swapped>: the compatibility form, which has no built-in function, and swapped() characters. Null where the text has that form already;
    those of ASCII alone, most of them, stay in the JVM. equal_lengths: swapped() only where the form keeps the length."""
    fields = {"i": pa.int32(), "a": pa.string(), "b": pa.string()}

    @F.arrow_udf("struct<text:string,swapped:array<struct<i:int,a:string,b:string>>>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            old = texts.to_pylist()
            new = [None if t is None or unicodedata.is_normalized("NFKC", t) else unicodedata.normalize("NFKC", t) for t in old]
            found = batch.nested(([] if u is None or (equal_lengths and len(t) != len(u)) else swapped(t, u) for t, u in zip(old, new, strict=True)), fields)
            yield pa.StructArray.from_arrays([pa.array(new, pa.string()), found], ["text", "swapped"])

    batch.small(SparkSession.getActiveSession())
    text = F.col(text) if isinstance(text, str) else text
    return run.asNondeterministic()(F.when(F.octet_length(text) != F.char_length(text), text))


def homoglyphs(found: Column) -> Column:
    """Findings of swapped() characters, beside which compatibility normalisation puts another one; an index is one of the text's own.

    Where normalisation changes the length, what stands behind a character that became several is compared with what has moved there.
    """
    return F.transform(found, lambda p: F.struct(F.lit("homoglyph").alias("kind"), p["a"].alias("char"), code_point(p["a"]).alias("codepoint"), p["i"].alias("index"), F.concat(F.lit("normalizes to "), p["b"]).alias("note"))).cast(FINDING)


SURPLUS = r"(?<=\S)[ \t]{2,}"


def surplus(text: Column) -> Column:
    """A finding for each run of several blanks behind something on its line."""
    one = lambda x: F.struct(F.lit("excessive_whitespace").alias("kind"), F.left(x["value"], F.lit(1)).alias("char"), code_point(x["value"]).alias("codepoint"), x["s"].alias("index"), F.concat(F.char_length(x["value"]).cast("string"), F.lit(" blanks in a row")).alias("note"))
    two = F.contains(text, F.lit("  ")) | F.contains(text, F.lit("\t"))
    return F.when(two & text.rlike(SURPLUS), F.transform(tokens.matches(text, SURPLUS), one).cast(FINDING)).otherwise(F.array().cast(FINDING))


def findings(df: DataFrame) -> DataFrame:
    """df with `findings`: the read-only scan of text, with look-alikes. A null text has none."""
    text = F.coalesce("text", F.lit(""))
    return df.withColumn("_n", nfkc(text)).withColumn("findings", F.concat(scan(text), homoglyphs(F.col("_n.swapped")))).drop("_n")


def finding_counts(df: DataFrame, keys: list[str]) -> DataFrame:
    """Findings of each kind and `total`, which leaves out marks of direction and surplus blanks."""
    of = lambda k: F.size(F.filter("findings", lambda f: f["kind"] == k)).cast("long")
    counted = [k for k in KINDS if k != "excessive_whitespace"]
    out = findings(df).select(*keys, *[of(k).alias(k) for k in counted])
    return out.withColumn("total", sum((F.col(k) for k in counted if k != "bidi_mark"), F.lit(0)).cast("long"))


def cleaned(text: Column) -> Column:
    """The text without hidden characters: a first BOM, marks of direction stay; special spaces become plain ones. Before normalisation."""
    out = F.translate(text, "".join(STRIP), "")
    out = F.translate(out, "".join(SPACES), " " * len(SPACES))
    out = F.regexp_replace(out, rf"(?<!^){BOM}", "")
    return F.regexp_replace(out, "[\\p{Cc}\\p{Cf}&&[^\\n\\t\\r" + BOM + "".join(REPORT_ONLY) + "]]", "")


#: What an em dash and an en dash become, and where; a number behind an en dash keeps it.
DASHES = [(r"\s*—\s*", ", "), (r"(?<=\D)\s*–\s*(?=\D)", " - ")]


def dashes(text: Column) -> Column:
    out = text
    for pattern, new in DASHES:
        out = F.regexp_replace(out, pattern, new)
    return F.when(F.contains(text, F.lit("—")) | F.contains(text, F.lit("–")), out).otherwise(text)


def clean(df: DataFrame) -> DataFrame:
    """df with text cleaned, and removed_count, normalized_count, findings of what was there. Null stays null."""
    text = F.coalesce("text", F.lit(""))
    out = df.withColumn("_f", scan(text)).withColumn("_c", F.when(F.size("_f") > 0, cleaned(F.col("text"))).otherwise(F.col("text"))).withColumn("_n", nfkc("_c", equal_lengths=True))
    kind = lambda *k: F.size(F.filter("_f", lambda f: f["kind"].isin(*k)))
    removed = (kind("zero_width", "control") + F.size(F.filter("_f", lambda f: (f["kind"] == "bom") & (f["index"] > 0)))).cast("long")
    found = F.concat(F.filter("_f", lambda f: ~((f["kind"] == "bom") & (f["index"] == 0))), surplus(text), homoglyphs(F.col("_n.swapped")))
    out = out.withColumn("removed_count", removed).withColumn("normalized_count", kind("nbsp", "special_space").cast("long"))
    return out.withColumn("findings", F.when(F.col("text").isNotNull(), found)).withColumn("text", dashes(F.coalesce("_n.text", "_c"))).drop("_f", "_c", "_n")
