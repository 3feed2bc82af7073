"""Calls of a client outside Spark, as a stage that can be run again: answers are kept, and only rows without one are asked for."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scorer import SAMPLING

ANSWER = "text string, prompt_tokens int, output_tokens int, error string, tries int"


class Refused(Exception):
    """The client won't answer this text; asking again is no use."""


#: Kinds of errors by name, and which of them are worth another try.
KINDS = {"timeout": (TimeoutError,), "network": (ConnectionError, OSError), "refused": (Refused,)}
AGAIN = ("timeout", "network")


def kind_of(error: Exception) -> str:
    return next((k for k, some in KINDS.items() if isinstance(error, some)), "unexpected")


def payload(text: str, language: str, strength: str) -> dict:
    """What a client gets: the text, its language, and the sampling settings of the strength."""
    return {"text": text, "language": language, "strength": strength, **SAMPLING.get(strength, SAMPLING["medium"])}


def asked(client: Callable[[dict], tuple[str, int, int]], request: dict, tries: int, wait_s: float):
    """(text, prompt tokens, output tokens, error, tries) of one request: asked again after errors that may pass, each time waiting twice as long."""
    for k in range(1, tries + 1):
        try:
            return (*client(request), None, k)
        except Exception as e:  # whatever a client raises is told, not thrown
            kind = kind_of(e)
            if kind not in AGAIN or k == tries:
                return request["text"], None, None, f"{kind}: {e}", k
            time.sleep(wait_s * 2 ** (k - 1))


def answered(df: DataFrame, keys: list[str], load: Callable[[], Callable], path: str, at_once: int = 4, tries: int = 3, wait_s: float = 0.5) -> DataFrame:
    """keys and ANSWER of each row of df (keys, text, language, strength): stored answers from `path`, new ones from the client, stored there.

    load() makes the client in each worker; a batch's calls run `at_once` at a time. A second run leaves out the rows that have an answer without an error.
    Keys must identify rows; rows without a text are left out. What a client has answered to a task that then fails is asked again.
    """
    import pandas as pd

    spark = df.sparkSession
    schema = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys) + ", " + ANSWER
    try:
        known = spark.read.schema(schema).parquet(path).filter("error IS NULL")
        known.limit(0).collect()
    except AnalysisException:
        known = None

    def run(batches):
        from concurrent.futures import ThreadPoolExecutor

        client = load()
        with ThreadPoolExecutor(at_once) as pool:
            for b in batches:
                requests = [payload(t, lang, s) for t, lang, s in zip(b["text"], b["language"], b["strength"], strict=True)]
                rows = list(pool.map(lambda r: asked(client, r, tries, wait_s), requests))
                found = pd.DataFrame(rows, columns=["text", "prompt_tokens", "output_tokens", "error", "tries"]).astype({"prompt_tokens": "Int32", "output_tokens": "Int32", "tries": "Int32"})
                yield pd.concat([b[keys].reset_index(drop=True), found], axis=1)

    open_ = df.select(*keys, "text", "language", "strength").filter(F.col("text").isNotNull())
    if known is not None:
        open_ = open_.join(known.select(*keys), keys, "left_anti")
    open_.mapInPandas(run, schema).write.mode("append").parquet(path)
    every = spark.read.schema(schema).parquet(path)
    # A row that failed once and was answered later has both; the answer counts.
    best = F.min_by(F.struct("text", "prompt_tokens", "output_tokens", "error", "tries"), F.struct(F.col("error").isNotNull(), F.col("tries")))
    return every.groupBy(*keys).agg(best.alias("a")).select(*keys, "a.*")
