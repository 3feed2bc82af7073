"""Scores by a model of the caller's, and rewriting by a client of the caller's: optional, in batches, failing softly."""

from __future__ import annotations

from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCORE = (("score", T.DoubleType()), ("detail", T.StringType()))
#: Sampling settings by strength.
SAMPLING = {"light": {"temperature": 0.4, "top_p": 0.85}, "medium": {"temperature": 0.7, "top_p": 0.90}, "aggressive": {"temperature": 0.95, "top_p": 0.95}}


def as_score(value) -> float:
    """A number, a mapping with 'score' or 'probability', or anything with item(): within 0 and 1."""
    if isinstance(value, dict):
        value = value.get("score", value.get("probability"))
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, bool) or not isinstance(value, int | float):
        raise TypeError(f"no score: {type(value).__name__}")
    return max(0.0, min(1.0, float(value)))


def score_with(df: DataFrame, load=None, batch: int = 256) -> DataFrame:
    """df with model_score: disabled without a loader; unavailable, and why, if it fails to load or to score; else the score.

    load() gives a function of a text, or one of a list of texts if that function has `batched` set. It runs once per Python worker, never on the
    driver; the model is kept there between tasks, and texts come to it `batch` at a time.
    """
    if load is None:
        return df.withColumn("model_score", F.expr("named_struct('enabled', false, 'available', false, 'score', cast(null as double), 'detail', cast(null as string))"))

    def make():
        import numpy as np

        try:
            scorer, why = load(), None
        except Exception as e:  # the model is optional
            scorer, why = None, str(e)

        def each(texts):
            for t in texts:
                try:
                    yield as_score(scorer(t or "")), None
                except Exception as e:
                    yield None, str(e)

        def predict(texts):
            if scorer is None:
                found = [(None, why)] * len(texts)
            elif getattr(scorer, "batched", False):
                try:
                    found = [(as_score(x), None) for x in scorer([t or "" for t in texts])]
                except Exception as e:
                    found = [(None, str(e))] * len(texts)
            else:
                found = list(each(texts))
            return {"score": np.array([x for x, _ in found], object), "detail": np.array([w for _, w in found], object)}

        return predict

    score = predict_batch_udf(make, return_type=T.StructType([T.StructField(n, t) for n, t in SCORE]), batch_size=batch)
    return df.withColumn("_m", score("text")).withColumn("model_score", F.struct(F.lit(True).alias("enabled"), F.col("_m.score").isNotNull().alias("available"), F.col("_m.score").alias("score"), F.col("_m.detail").alias("detail"))).drop("_m")


def rewritten_by(df: DataFrame, client=None) -> DataFrame:
    """df with text as client(text, language, settings) -> (text, prompt_tokens, output_tokens) gives it, the token counts, and llm_error.

    Without a client, or where it fails, the text stays.
    """
    if client is None:
        return df.withColumns({"llm_prompt_tokens": F.lit(None).cast("int"), "llm_output_tokens": F.lit(None).cast("int"), "llm_error": F.lit("no client")})

    @F.pandas_udf("text string, prompt int, output int, error string")
    def run(texts, language, strength):
        import pandas as pd

        rows = []
        for t, lang, s in zip(texts, language, strength, strict=True):
            try:
                rows.append((*client(t, lang, SAMPLING[s]), None))
            except Exception as e:
                rows.append((t, None, None, f"{type(e).__name__}: {e}"))
        return pd.DataFrame(rows, columns=["text", "prompt", "output", "error"]).astype({"prompt": "Int32", "output": "Int32"})

    df = df.withColumn("_r", run("text", "language", "strength"))
    return df.withColumns({"text": F.col("_r.text"), "llm_prompt_tokens": F.col("_r.prompt"), "llm_output_tokens": F.col("_r.output"), "llm_error": F.col("_r.error")}).drop("_r")
