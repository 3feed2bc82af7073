"""Token counts by heap-and-linked-list byte-pair merging, without making any token ids."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .bytelevel import MergeCounter


@lru_cache(maxsize=2)
def _counter(path: str) -> MergeCounter:
    return MergeCounter(path)


def token_counts(df: DataFrame, tokenizer: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit of each row, as the tokenizers library counts for this file.

    Pairs merge in the order of their rank, leftmost first; the count is the initial symbols minus the merges.
    Special tokens inside a text count as one, the library's default. Null and empty texts: 0 and 0. Repeated
    rows stay. Other columns of df are ignored. No shuffle: each row on its own, each worker with a bounded cache.
    """

    def make():
        one = _counter(tokenizer)
        return lambda texts: [[one.count(t) for t in texts], [len(t.encode("utf-8", "surrogatepass")) for t in texts]]

    out = common.per_text(common.texts(df), {"n_tokens": "long", "n_bytes": "long"}, make)
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
