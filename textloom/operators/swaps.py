"""Swaps of phrases and words as joins: tokens with their places meet tables of alternatives, chance decides, and accepted edits go back into the text.

A text's tokens are rows (keys, place, word); those that a table knows are few. Only they, with what replaces them, are shuffled to their text.
Chance is read off an md5 of seed, layer, key and place, so any engine that has md5 draws alike, whatever the partitioning.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import batches as batch
from ..functions import lexicon as lx
from ..functions import phrases as ph
from . import lines

# How often a hit is swapped, by strength; how much rarer synonyms are; letters that stand before a Hebrew word.
RATIOS = {"light": 0.20, "medium": 0.50, "aggressive": 0.85}
SYNONYM_SHARE = 0.30
CLITICS, MOST_CLITICS = "והבלכמש", 3
#: A word is a run of letters and digits, with marks inside it; in Hebrew, of letters. For Python, letters and digits of all scripts and _ are \w.
TOKEN = {"en": r"[\p{L}\p{N}_]+(?:['\-]+[\p{L}\p{N}_]+)*", "he": "[א-ת]+"}
_TOKEN = {k: re.compile(p.replace(r"[\p{L}\p{N}_]", r"\w")) for k, p in TOKEN.items()}
#: Layers in the order in which they have a place, and how often each swaps, as a share of the strength's ratio.
LAYERS = {"phrase": 1.0, "word": 1.0, "synonym": SYNONYM_SHARE}
#: Rows of a table of alternatives that may be broadcast.
BROADCAST_ROWS = 200_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
EDITS = "array<struct<s:int,e:int,layer:int,old:string,new:string>>"


def alternatives(spark: SparkSession, machine=lx.MACHINE_WORDS, synonyms=lx.SYNONYMS) -> DataFrame:
    """language, word, layer, options: the tables that swapped() joins. Others of this shape, as sources.documents.dictionary() reads them, do as well."""
    rows = [(lang, w, layer, list(o)) for layer, some in (("word", machine), ("synonym", synonyms)) for lang, t in some.items() for w, o in t.items()]
    return spark.createDataFrame(rows, "language string, word string, layer string, options array<string>")


def chance(seed: int, layer: Column, key: Column, place: Column, first: int = 1) -> Column:
    """A number from 0 to 1 (excluded), from eight hex digits of an md5 from the given one on."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), layer, key, place.cast("string")))
    return F.conv(F.substring(digest, first, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def ratio(strength: Column) -> Column:
    out = F.lit(RATIOS["medium"])
    for name, share in RATIOS.items():
        out = F.when(strength == name, F.lit(share)).otherwise(out)
    return out


def cased(old: Column, new: Column) -> Column:
    """In capitals if the old word is, with a first capital if the old one has one."""
    first = F.left(old, F.lit(1))
    capitals = (F.char_length(old) > 1) & (old == F.upper(old)) & (old != F.lower(old))
    return F.when(capitals, F.upper(new)).when((first == F.upper(first)) & (first != F.lower(first)), F.concat(F.upper(F.left(new, F.lit(1))), F.substring(new, 2, 10_000))).otherwise(new)


def forms(text: str, language: str) -> Iterator[tuple[int, int, str, str]]:
    """(place, length of the prefix, token, lower-cased rest) of every token; a Hebrew one again for each prefix that it may have."""
    if language != "he":
        for m in _TOKEN["en"].finditer(text):
            yield m.start(), 0, m[0], m[0].lower()
        return
    for m in _TOKEN["he"].finditer(text):
        old = m[0]
        for n in range(min(MOST_CLITICS + 1, len(old))):
            if n and old[n - 1] not in CLITICS:
                break
            yield m.start(), n, old, old[n:]


def words(df: DataFrame, keys: list[str], known: dict[str, set[str]] | None = None) -> DataFrame:
    """keys, language, strength, key, s, e, old, prefix, word: every token of df, lower-cased as word; Hebrew ones again for each prefix they may have.

    known: words by language; tokens that are none of them are left out before they become rows.
    """
    fields = {"s": pa.int32(), "n": pa.int32(), "old": pa.string(), "word": pa.string()}

    @F.arrow_udf("array<struct<s:int,n:int,old:string,word:string>>")
    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for texts, languages in batches:
            rows = ((t or "", lang, None if known is None else known.get(lang, ())) for t, lang in zip(texts.to_pylist(), languages.to_pylist(), strict=True))
            yield batch.nested(([x for x in forms(t, lang) if some is None or x[3] in some] for t, lang, some in rows), fields)

    batch.small(df.sparkSession)
    rows = df.select(*keys, "language", "strength", "key", F.explode(run("text", "language")).alias("t"))
    return rows.select(*keys, "language", "strength", "key", "t.s", (F.col("t.s") + F.char_length("t.old")).alias("e"), "t.old", F.left("t.old", F.col("t.n")).alias("prefix"), "t.word")


def hits(df: DataFrame, keys: list[str], known: DataFrame, phrases: dict[str, dict[str, str]], seed: int) -> DataFrame:
    """keys and the edits that chance accepts: s, e, layer, old, new. A token counts once in its first layer, by its whole form or else its longest prefix."""
    df = df.withColumn("key", F.concat_ws("\x1f", *[F.col(k).cast("string") for k in keys]))
    few = known.count() <= BROADCAST_ROWS
    mine: dict[str, set[str]] | None = None
    if few:  # as many as may be broadcast: tasks have them at hand
        mine = {}
        for r in known.select("language", "word").distinct().collect():
            mine.setdefault(r["language"], set()).add(r["word"])
    met = words(df, keys, mine).join(F.broadcast(known) if few else known, ["language", "word"])
    share = F.element_at(F.create_map(*[F.lit(x) for pair in LAYERS.items() for x in pair]), F.col("layer"))
    met = met.filter(chance(seed, F.col("layer"), F.col("key"), F.col("s")) < ratio(F.col("strength")) * share)
    pick = F.element_at("options", (F.floor(chance(seed, F.col("layer"), F.col("key"), F.col("s"), 9) * F.size("options")) + 1).cast("int"))
    number = F.array_position(F.array(*map(F.lit, LAYERS)), F.col("layer")).cast("int")
    length = F.char_length("prefix")
    order = F.when(length == 0, -MOST_CLITICS - 1).otherwise(-length)
    new = F.when(F.col("language") == "he", F.concat("prefix", pick)).otherwise(cased(F.col("old"), pick))
    one = met.select(*keys, "s", F.struct(number.alias("layer"), order.alias("order"), "e", "old", new.alias("new")).alias("x")).groupBy(*keys, "s").agg(F.min("x").alias("x")).select(*keys, "s", "x.e", "x.layer", "x.old", "x.new")
    flat = {lang: {p.translate(str.maketrans(_UPPER, _LOWER)): r for p, r in some.items()} for lang, some in phrases.items()}
    table = F.create_map(*[F.lit(x) for lang, some in flat.items() for p, r in some.items() for x in (f"{lang}:{p}", r)]) if any(flat.values()) else F.create_map().cast("map<string,string>")
    placed = df.select(*keys, "language", "strength", "key", "text", F.explode(ph.places(F.col("text"), F.col("language"), flat, fold=True)).alias("p"))
    s, size = F.col("p.start"), F.char_length("p.phrase")
    beside = F.concat(F.when(s > 0, F.substring("text", s, F.lit(1))).otherwise(F.lit("")), F.substring("text", s + size + 1, F.lit(1)))
    placed = placed.filter(~beside.rlike(r"[\p{L}\p{N}_]") & (chance(seed, F.lit("phrase"), F.col("key"), s) < ratio(F.col("strength"))))
    old = F.substring("text", s + 1, size)
    other = F.element_at(table, F.concat_ws(":", "language", "p.phrase"))
    swapped = F.when(F.col("language") == "he", other).otherwise(cased(old, other))
    return one.unionByName(placed.select(*keys, s.alias("s"), (s + size).alias("e"), F.lit(1).alias("layer"), old.alias("old"), swapped.alias("new")))


def settled(text: str, edits: list[dict]) -> list[dict]:
    """The edits outside protected spans that no other one of an earlier layer, greater length or, last, earlier place overlaps; by place."""
    rank = lambda x: (x["layer"], x["s"] - x["e"], x["s"])
    spans, left, k = lines.merged_spans(text), [], 0
    for x in sorted(edits, key=lambda x: (x["s"], rank(x))):
        while k < len(spans) and spans[k][1] <= x["s"]:
            k += 1
        if k == len(spans) or x["e"] <= spans[k][0]:
            left.append(x)
    open_, beaten = [], set()  # edits that reach beyond the place that the sweep has come to; those that another one overlaps and outranks
    for i, x in enumerate(left):
        open_ = [j for j in open_ if left[j]["e"] > x["s"]]
        for j in open_:
            beaten.add(i if rank(left[j]) < rank(x) else j)
        open_.append(i)
    return [x for i, x in enumerate(left) if i not in beaten]


def spliced(text: Column, edits: Column) -> Column:
    """struct<text, log>: a text with its edits, and what each changed."""

    @F.arrow_udf("struct<text:string,log:array<string>>")
    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        names = list(LAYERS)
        for some in batches:
            new, logs = [], []
            for old, changes in zip(*(x.to_pylist() for x in some), strict=True):
                parts, at, log = [], 0, []
                for x in settled(old, changes) if old and changes else ():
                    parts += [old[at : x["s"]], x["new"]]
                    at = x["e"]
                    log.append(f"{names[x['layer'] - 1]}:{x['old']}->{x['new']}")
                new.append("".join([*parts, old[at:]]) if parts else old)
                logs.append(log)
            yield pa.StructArray.from_arrays([pa.array(new, pa.string()), pa.array(logs, pa.list_(pa.string()))], ["text", "log"])

    return run(text, edits)


def swapped(df: DataFrame, keys: list[str], known: DataFrame | None = None, phrases: dict[str, dict[str, str]] = lx.MACHINE_PHRASES, seed: int = 0) -> DataFrame:
    """df (keys, text, language, strength, ...) with phrases and words swapped by chance outside protected spans, and `transformations` of what changed.

    known: a table as alternatives() makes it. keys identify rows. Null texts stay null. Texts meet their edits in one join on keys.
    """
    if "transformations" not in df.columns:
        df = df.withColumn("transformations", F.array().cast("array<string>"))
    found = hits(df.filter("text IS NOT NULL"), keys, alternatives(df.sparkSession) if known is None else known, phrases, seed)
    edits = found.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("s", "e", "layer", "old", "new"))).cast(EDITS).alias("_edits"))  # a text's own hits
    out = df.join(edits, keys, "left").withColumn("_r", spliced(F.when(F.col("_edits").isNotNull(), F.col("text")), F.coalesce("_edits", F.array().cast(EDITS))))
    return out.withColumn("text", F.coalesce("_r.text", "text")).withColumn("transformations", F.concat("transformations", F.coalesce("_r.log", F.array().cast("array<string>")))).drop("_edits", "_r")
