"""Reading documents and dictionaries, validation, and writing reports."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, fields

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Limits and choices of a request.
HARD_CAP, DEFAULT_CAP = 50_000, 10_000
#: How many findings a report shows.
SHOWN = 20
LANGUAGES, STRENGTHS = ("en", "he"), ("light", "medium", "aggressive")


@dataclass(frozen=True)
class Settings:
    """What the session says, under spark.textloom.<name>, or the defaults."""

    language: str = "en"
    strength: str = "medium"
    cap: int = DEFAULT_CAP
    capacity: int = 30
    window_s: float = 60.0
    seed: int = 0


def settings(spark: SparkSession) -> Settings:
    found = {f.name: spark.conf.get(f"spark.textloom.{f.name}", None) for f in fields(Settings)}
    return Settings(**{f.name: type(f.default)(found[f.name]) for f in fields(Settings) if found[f.name] is not None})


def read_documents(spark: SparkSession, path: str, form: str = "parquet") -> DataFrame:
    """doc_id, text, language, strength, clean_watermarks of stored requests; missing options get their defaults."""
    df = spark.read.schema("doc_id long, text string, language string, strength string, clean_watermarks boolean").json(path) if form == "json" else spark.read.format(form).load(path)
    of = settings(spark)
    return with_options(df, of.language, of.strength)


def with_options(df: DataFrame, language: Column | str | None = None, strength: str = "medium") -> DataFrame:
    for name, default in (("language", language if language is not None else "en"), ("strength", strength), ("clean_watermarks", True)):
        default = F.lit(default) if not isinstance(default, Column) else default
        df = df.withColumn(name, F.coalesce(F.col(name), default) if name in df.columns else default)
    return df


def rejection(cap: int = DEFAULT_CAP) -> Column:
    """Why a row is refused, or null: the first that applies."""
    n = F.char_length("text")
    return (
        F.when(F.col("text").isNull() | (n == 0), "empty").when(n > HARD_CAP, "too_long").when(~F.col("text").rlike(r"\S"), "blank")
        .when(~F.col("language").isin(*LANGUAGES), "language").when(~F.col("strength").isin(*STRENGTHS), "strength").when(n > cap, "over_cap")
    )


def validated(df: DataFrame, cap: int = DEFAULT_CAP) -> tuple[DataFrame, DataFrame]:
    """The rows that are fit, and the others with their reason."""
    marked = df.withColumn("reason", rejection(cap))
    return marked.filter("reason IS NULL").drop("reason"), marked.filter("reason IS NOT NULL")


def read_ranks(path: str) -> list[str]:
    """Words of a list, one a line, by rank; a missing file is an empty list."""
    if not os.path.exists(path):
        return []
    with open(path, encoding="utf-8") as f:
        return [w for line in f if (w := line.strip())]


def read_dictionary(path: str, section: str | None = None) -> dict:
    """A JSON dictionary, or a section of it; a missing file or section is empty."""
    if not os.path.exists(path):
        return {}
    with open(path, encoding="utf-8") as f:
        found = json.load(f)
    return found.get(section, {}) if section else found


def _whole_file(spark: SparkSession, path: str) -> DataFrame:
    """One row with a file's text, read by Spark from any store; no row if there is no such file."""
    try:
        return spark.read.text(path, wholetext=True)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "value string")


def word_list(spark: SparkSession, path: str) -> DataFrame:
    """word, rank of a list with a word on each line: blank lines don't count, and a word that stands twice has its last line's rank."""
    words = F.filter(F.transform(F.split("value", "\n"), F.trim), lambda w: w != "")
    rows = _whole_file(spark, path).select(F.posexplode(words).alias("i", "word"))
    return rows.groupBy("word").agg((F.max("i") + 1).alias("rank"))


def dictionary(spark: SparkSession, path: str, section: str | None = None) -> DataFrame:
    """word, options of a JSON dictionary of lists, or of one section of it; a missing file or section is empty."""
    kind = "map<string,array<string>>" if section is None else f"struct<`{section}`:map<string,array<string>>>"
    found = F.from_json("value", kind)
    return _whole_file(spark, path).select(F.explode(found if section is None else found[section]).alias("word", "options"))


def ranks(df: DataFrame, word: str = "word", n: int = 5000) -> DataFrame:
    """word, rank of the n most frequent words of a column of words: a frequency list made from a corpus."""
    from pyspark.sql.window import Window

    top = df.groupBy(word).count().orderBy(F.desc("count"), word).limit(n)
    return top.select(F.col(word).alias("word"), F.row_number().over(Window.orderBy(F.desc("count"), word)).alias("rank"))


def write_markdown(df: DataFrame, path: str, text: str = "text") -> None:
    """Texts as Markdown files that begin with a byte order mark, a row each."""
    df.select(F.concat(F.lit("\uFEFF"), F.col(text)).alias("value")).write.mode("overwrite").option("lineSep", "\n\n").text(path)


def findings_json(df: DataFrame, keys: list[str], shown: int | None = None) -> DataFrame:
    """keys and a readable JSON report of each row's findings, of the first `shown` if given."""
    df = df if shown is None else df.withColumn("findings", F.slice("findings", 1, shown))
    return df.select(*keys, F.to_json(F.struct("findings"), {"pretty": "true"}).alias("report"))
