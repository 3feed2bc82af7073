"""Stupid-backoff scores from n-gram count tables that are partitioned by hash.

Documents are dealt to chunks of bounded size. Each chunk sends its distinct n-grams with their counts, packed, to the hash
partitions they belong to (so a frequent n-gram goes there once per chunk, not once per occurrence). A partition adds
up its count table, joins it to every chunk's n-grams and sends the totals back; each chunk then sums its documents.

Words and bigrams go in the first round. A longer n-gram can only be in another document if the two shorter ones in it are: each
further round sends those alone, which is exact, as the others' counts are 0.

Texts go to their chunk compressed one by one, and n-grams, counts and totals compressed part by part: Spark's own LZ4 has no entropy coding, which is
most of what words without repeats and small numbers have to give.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, shingles

ORDER, BACKOFF = 3, 0.4
CHUNK_CHARS, GRAMS_PER_PARTITION, CHARS_PER_WORD = 6_000_000, 1_000_000, 5
SENT = "chunk long, part long, round int, grams binary, counts binary"
ANSWERED = "chunk long, part long, round int, totals binary"


@lru_cache(maxsize=1)
def _codec():
    import pyarrow as pa

    return pa.Codec("zstd", 1)


def squeezed(data: bytes) -> bytes:
    """Compressed, behind its length in eight bytes."""
    return len(data).to_bytes(8, "little") + (_codec().compress(data, asbytes=True) if data else b"")


def unsqueezed(data: bytes) -> bytes:
    size = int.from_bytes(data[:8], "little")
    return _codec().decompress(memoryview(data)[8:], size, asbytes=True) if size else b""


def _squeezed_texts(batches):
    """(chunk, doc_id, text) with text as bytes for the shuffle."""
    import pyarrow as pa

    for b in batches:
        small = [squeezed(t.encode("utf-8", "surrogatepass")) for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("chunk"), b.column("doc_id"), pa.array(small, pa.binary())], names=["chunk", "doc_id", "text"])


def _texts(rows) -> list[str]:
    return [unsqueezed(t).decode("utf-8", "surrogatepass") for t in rows.column("text").to_pylist()]


def packed(values) -> bytes:
    """Whole numbers byte by byte: all lowest bytes first, as the rest are zeros where they are small; then compressed."""
    import numpy as np

    return squeezed(np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes())


def unpacked(data: bytes, dtype: str):
    import numpy as np

    data, size = unsqueezed(data), np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, len(data) // size).T).reshape(-1).view(dtype)


def packed_sorted(values) -> bytes:
    """Sorted 64-bit numbers, by their differences."""
    import numpy as np

    return packed(np.diff(values, prepend=np.uint64(0)))


def unpacked_sorted(data: bytes):
    import numpy as np

    return np.cumsum(unpacked(data, "<u8"), dtype=np.uint64)


class Chunk:
    """The n-grams of some documents: of each order, the hash of the n-gram that ends at each word (0 where none does)."""

    def __init__(self, texts: list[str], order: int):
        import numpy as np

        flat, self.sizes = shingles.word_hashes(texts)
        self.doc = np.repeat(np.arange(len(texts)), self.sizes)
        at = np.arange(len(flat)) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)
        self.grams = []
        for n in range(1, order + 1):
            out = np.zeros(len(flat), np.uint64)
            if len(flat) >= n:
                out[n - 1 :] = shingles.joined(flat, n) ^ np.uint64(n)
            out[at < n - 1] = 0
            self.grams.append(out)

    def distinct(self, *grams):
        """Sorted distinct hashes of some n-grams, and how often each stands there."""
        import numpy as np

        every = np.concatenate(grams)
        return np.unique(every[every != 0], return_counts=True)

    def others(self, gram, values, totals):
        """How often other documents have the n-gram that ends at each word; -1 where none ends. What isn't among the values is in no other document."""
        import numpy as np

        out = np.where(gram != 0, 0, -1)
        k = np.minimum(np.searchsorted(values, gram), max(0, len(values) - 1))
        real = np.flatnonzero((values[k] == gram) & (gram != 0)) if len(values) else np.empty(0, np.int64)
        _, at, own = np.unique(self.doc[real] * np.int64(max(1, len(values))) + k[real], return_inverse=True, return_counts=True)
        out[real] = np.maximum(totals[k[real]] - own[at], 0)
        return out

    def of_round(self, r: int, others: list):
        """What is sent in round r: words and bigrams in round 1, then the n-grams whose two shorter ones other documents have."""
        import numpy as np

        if r == 1:
            return self.distinct(*self.grams[:2])
        gram, last = self.grams[r], others[r - 1]
        return self.distinct(np.where((last > 0) & (np.r_[np.int64(0), last[:-1]] > 0), gram, np.uint64(0)))

    def known(self, answered, rounds: int) -> list:
        """others() of every order that the rounds so far tell of. answered: (round, part, totals), in any order."""
        import numpy as np

        found: list = []
        for r in range(1, rounds + 1):
            values, _ = self.of_round(r, found)
            mine = sorted((part, data) for at, part, data in answered if at == r)
            totals = np.concatenate([*(unpacked(data, "<u4") for _, data in mine), np.empty(0, "<u4")]).astype(np.int64)
            for gram in self.grams[:2] if r == 1 else self.grams[r : r + 1]:
                found.append(self.others(gram, values, totals))
        return found


def _part(values, partitions: int):
    """The hash partition of sorted values: ranges of equal size, so that parts are in order too."""
    import numpy as np

    return (((values >> np.uint64(32)) * np.uint64(partitions)) >> np.uint64(32)).astype(np.int64)


def lm_scores(df: DataFrame, order: int = ORDER, backoff: float = BACKOFF) -> DataFrame:
    """doc_id, n_tokens, score (mean log10 of the stupid-backoff score of its words), n_backoff (words that took the shortest n-gram).

    Counts are of the whole table less the document's own, so a text is scored by what the others say. A word that no other document has
    counts as half an occurrence. Words are lower-cased runs without blanks; n-grams stay within a document. Null, empty and
    wordless texts: 0 tokens, null score. Repeated rows are documents of their own. An empty table gives an empty result.
    """
    docs = common.texts(df)
    sums = docs.agg(F.sum(F.length("text")).alias("chars"), F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))).alias("words")).first()
    chars, n_words = sums["chars"] or 0, sums["words"] or 0
    chunks, partitions = max(1, -(-chars // CHUNK_CHARS)), max(1, -(-chars * order // (CHARS_PER_WORD * GRAMS_PER_PARTITION)))
    common.modest_batches(df.sparkSession)
    dealt = docs.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).alias("chunk"), "doc_id", "text").mapInArrow(_squeezed_texts, "chunk long, doc_id long, text binary")
    rounds = max(1, order - 1)

    def send(r: int):
        def of(key, rows, answered):
            import numpy as np
            import pyarrow as pa

            chunk = Chunk(_texts(rows), order)
            values, n = chunk.of_round(r, chunk.known(_rows(answered), r - 1))
            part = _part(values, partitions)
            edge = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else np.empty(0, np.int64)
            ends = np.r_[edge[1:], len(part)] if len(part) else edge
            spans = list(zip(edge.tolist(), ends.tolist(), strict=True))
            grams, counts = [packed_sorted(values[a:z]) for a, z in spans], [packed(n[a:z].astype("<u4")) for a, z in spans]
            return pa.table({"chunk": pa.array([key[0].as_py()] * len(spans), pa.int64()), "part": pa.array(part[edge]), "round": pa.array([r] * len(spans), pa.int32()), "grams": pa.array(grams, pa.binary()), "counts": pa.array(counts, pa.binary())})

        return of if r > 1 else lambda key, rows: of(key, rows, None)

    def total(key, rows):
        import numpy as np
        import pyarrow as pa

        sent = [unpacked_sorted(g) for g in rows.column("grams").to_pylist()]
        table, at = np.unique(np.concatenate(sent), return_inverse=True)
        counts = np.bincount(at, np.concatenate([unpacked(c, "<u4") for c in rows.column("counts").to_pylist()]).astype(np.float64)).astype("<u4")
        edge = np.cumsum([0, *map(len, sent)]).tolist()
        totals = pa.array([packed(counts[at[a:z]]) for a, z in zip(edge[:-1], edge[1:], strict=True)], pa.binary())
        return pa.table({"chunk": rows.column("chunk"), "part": rows.column("part"), "round": rows.column("round"), "totals": totals})

    def score(key, rows, answered):
        import numpy as np
        import pyarrow as pa

        chunk = Chunk(_texts(rows), order)
        others, doc, sizes = chunk.known(_rows(answered), rounds)[:order], chunk.doc, chunk.sizes
        rest = np.maximum(n_words - sizes[doc], 1).astype(np.float64)
        p, used = np.maximum(others[0], 0.5) / rest, np.ones(len(doc), np.int64)
        for n in range(1, order):
            before = np.r_[np.int64(0), others[n - 1][:-1]]  # the n-gram's first n words end one word earlier
            seen = (others[n] > 0) & (before > 0)
            p = np.where(seen, others[n] / np.maximum(before, 1), np.where(others[n] >= 0, backoff * p, p))
            used = np.where(seen, n + 1, used)
        mean = np.bincount(doc, np.log10(np.minimum(p, 1.0)), len(sizes)) / np.maximum(sizes, 1)
        return pa.table({"doc_id": rows.column("doc_id"), "n_tokens": pa.array(sizes), "score": pa.array(mean, mask=sizes == 0), "n_backoff": pa.array(np.bincount(doc[used == 1], minlength=len(sizes)).astype(np.int64))})

    answers = None
    for r in range(1, rounds + 1):
        groups = dealt.groupBy("chunk")
        sent = groups.applyInArrow(send(r), SENT) if answers is None else groups.cogroup(answers.groupBy("chunk")).applyInArrow(send(r), SENT)
        found = sent.groupBy("part").applyInArrow(total, ANSWERED)
        answers = found if answers is None else answers.unionByName(found)
    return dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(score, "doc_id long, n_tokens long, score double, n_backoff long")


def _rows(answered) -> list[tuple]:
    """(round, part, totals) of the answers that a chunk has got."""
    return [] if answered is None else list(zip(*(answered.column(c).to_pylist() for c in ("round", "part", "totals")), strict=True))
