"""Token ids in flat files of unsigned integers, with 64-bit document offsets, to be mapped into memory.

Each range of doc_id becomes one shard of three flat little-endian files:
  NNNNN.bin   the ids, uint16 where the vocabulary allows it, else uint32
  NNNNN.idx   int64 offsets within the shard, one more than it has documents
  NNNNN.ids   int64 doc_id of each document (NULL_ID for a null)
The table `manifest` has a row per shard; a shard's first id is numbered by the prefix sum of the shards before it.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import common
from .bytelevel import CachedEncoder

NULL_ID = -(2**63)
MANIFEST = T.StructType([T.StructField(n, t) for n, t in (("shard", T.LongType()), ("stem", T.StringType()), ("n_docs", T.LongType()), ("n_tokens", T.LongType()), ("dtype", T.StringType()))])


@lru_cache(maxsize=2)
def _encoder(path: str, dtype: str) -> CachedEncoder:
    return CachedEncoder(path, dtype)


def _filesystem(uri: str):
    """Files in any store that pyarrow knows (local, HDFS, S3, GCS)."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_token_files(df: DataFrame, folder: str, tokenizer: str, end_id: int, vocabulary: int) -> DataFrame:
    """Writes all texts of df in ascending doc_id order; returns the manifest (shard, stem, n_docs, n_tokens, dtype, base).

    Rows are dealt by range of doc_id and sorted there; a null doc_id comes first, repeated ids stay in any order. A null or
    empty text is just end_id. A task writes under a name of its own and then renames, so that a repeated task (a lost
    executor, speculation) leaves the same files. An empty df gives an empty manifest.
    """
    dtype = "<u2" if max(vocabulary, end_id + 1) <= 1 << 16 else "<u4"
    spark = df.sparkSession

    def write(batches):
        import numpy as np
        import pyarrow as pa

        task = TaskContext.get()
        store, root = _filesystem(folder)
        store.create_dir(root, recursive=True)
        encode, end = _encoder(tokenizer, dtype), np.array([end_id], dtype).tobytes()
        stem, own = f"{root}/{task.partitionId():05d}", f"{root}/.{task.partitionId():05d}-{task.taskAttemptId()}"
        ids, offsets, at = [], [0], 0
        with store.open_output_stream(own + ".bin") as out:
            for b in batches:
                texts, own_ids = b.column("text").to_pylist(), b.column("doc_id").to_pylist()
                for g in common.sliced(texts):
                    for i, packed in zip(own_ids[g], encode.encode_all(texts[g]), strict=True):
                        out.write(packed)
                        out.write(end)
                        at += len(packed) // len(end) + 1
                        ids.append(NULL_ID if i is None else i)
                        offsets.append(at)
        for kind, values in (("idx", offsets), ("ids", ids)):
            with store.open_output_stream(f"{own}.{kind}") as out:
                out.write(np.array(values, "<i8").tobytes())
        for kind in ("bin", "idx", "ids"):
            store.move(f"{own}.{kind}", f"{stem}.{kind}")
        if ids:
            yield pa.RecordBatch.from_pydict({"shard": [task.partitionId()], "stem": [f"{folder}/{task.partitionId():05d}"], "n_docs": [len(ids)], "n_tokens": [at], "dtype": [dtype]})

    common.modest_batches(spark)
    sorted_rows = common.texts(df).repartitionByRange(common.shuffle_partitions(spark), "doc_id").sortWithinPartitions("doc_id")
    manifest = common.stored(sorted_rows.mapInArrow(write, MANIFEST), folder, "manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row per shard, not per document
    return manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_token_files(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, shard of every document, read back from the files, a task per few shards.

    The crc32 is that of the ids as little-endian unsigned 32-bit integers.
    """

    def read(batches):
        import numpy as np
        import pandas as pd

        for b in batches:
            for s in b.itertuples(index=False):
                ids = mapped(f"{s.stem}.ids", "<i8")
                offsets = mapped(f"{s.stem}.idx", "<i8")
                tokens = mapped(f"{s.stem}.bin", s.dtype)
                for lo in range(0, len(ids), 20_000):
                    hi = min(lo + 20_000, len(ids))
                    yield pd.DataFrame({
                        "doc_id": pd.array([None if i == NULL_ID else i for i in ids[lo:hi].tolist()], "Int64"), "start": s.base + offsets[lo:hi], "n_tokens": np.diff(offsets[lo : hi + 1]),
                        "ids_crc32": [zlib.crc32(tokens[a:z].astype("<u4").tobytes()) for a, z in zip(offsets[lo:hi].tolist(), offsets[lo + 1 : hi + 1].tolist(), strict=True)], "shard": s.shard,
                    })

    parts = common.shuffle_partitions(manifest.sparkSession)
    return manifest.repartition(parts, "shard").mapInPandas(read, "doc_id long, start long, n_tokens long, ids_crc32 long, shard long")


def mapped(uri: str, dtype: str):
    """One file as an array: mapped into memory if it is on a mounted disk, else read from its store."""
    import numpy as np
    from pyarrow import fs

    store, path = _filesystem(uri)
    if not store.get_file_info(path).size:
        return np.empty(0, dtype)
    if isinstance(store, fs.LocalFileSystem):
        return np.memmap(path, dtype, "r")
    with store.open_input_file(path) as f:
        return np.frombuffer(f.read(), dtype)


def encode_to_files(spark: SparkSession, df: DataFrame, tokenizer: str, end_id: int, vocabulary: int, folder: str | None = None) -> DataFrame:
    """Both steps, in a new folder of the shared one unless another is given."""
    return read_token_files(write_token_files(df, folder or common.shared_folder(spark), tokenizer, end_id, vocabulary))
