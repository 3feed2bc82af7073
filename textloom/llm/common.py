"""Shared folder, tokenizer paths and small helpers of the training-text operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def tokenizer_path(name: str) -> str:
    """The place of a public vocabulary file; the same package is installed on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the one that driver and executors share (spark.checkpoint.dir).

    Only where that setting is missing and the session runs on one machine, as in tests, a temporary folder stands in for it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="textloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/textloom-{uuid.uuid4().hex}"


def stored(df: DataFrame, folder: str, name: str) -> DataFrame:
    """df written as a table in the shared folder and read back: later steps neither recompute nor lose it."""
    path = f"{folder}/{name}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows that Spark hands to a worker at once, where the session leaves it at Spark's own 10,000: whole documents are large rows.
ROWS_AT_ONCE = 1_000


def modest_batches(spark: SparkSession) -> None:
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name)) == 10_000:
        spark.conf.set(name, str(ROWS_AT_ONCE))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Just (doc_id, text): other columns, however they are named, never meet the operator's own. Null text is empty."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of numbers that may be broadcast: 16 bytes each, 32 MB at most.
BROADCAST_ROWS = 2_000_000


def small(df: DataFrame) -> DataFrame:
    """A stored table of a few numbers a row, marked to be broadcast if a count says that it is small; else joined by a shuffle."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


#: Characters of the texts that a worker handles at once.
SLICE_CHARS = 4_000_000


def sliced(texts: list[str], chars: int = SLICE_CHARS) -> Iterator[slice]:
    """Slices of some texts that have about so many characters each: what is built for a slice stays bounded. A longer text is a slice of its own."""
    lo, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= chars:
            yield slice(lo, i + 1)
            lo, size = i + 1, 0
    if lo < len(texts):
        yield slice(lo, len(texts))


def _arrow(kind: str):
    import pyarrow as pa

    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary()}
    return pa.list_(kinds[kind[6:-1]]) if kind.startswith("array<") else kinds[kind]


def per_text(docs: DataFrame, columns: dict[str, str], make: Callable, chars: int = SLICE_CHARS) -> DataFrame:
    """doc_id and `columns` (name to type) of each row of docs (doc_id, text): make() is called once a task, and what it gives for some texts at a time.

    That is a list of columns. Ids stay in Arrow: a null beside them doesn't turn them into doubles.
    """

    def run(batches):
        import pyarrow as pa

        function, kinds = make(), [_arrow(k) for k in columns.values()]
        for b in batches:
            texts = b.column("text").to_pylist()
            for g in sliced(texts, chars):
                found = [x if isinstance(x, pa.Array) else pa.array(x, kind) for x, kind in zip(function(texts[g]), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(g.start, g.stop - g.start), *found], names=["doc_id", *columns])

    modest_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, " + ", ".join(f"{n} {k}" for n, k in columns.items()))
