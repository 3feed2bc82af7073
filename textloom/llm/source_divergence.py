"""How far the sources of a language lie apart in their words: exact integer divergences from counts over all documents.

A table of 256 entries turns bytes of a whole Arrow buffer into lower-cased term bytes or 0, so boundaries come from one comparison of
neighbours. xxhash groups the slices between them, and each slice is compared byte by byte with the one that stands for its group. Counts are
kept as sparse rows (CSR): documents by terms where texts are read, sources by terms where divergences are summed with reduceat.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

#: A term is kept in a language if so many of its documents have it; the ranks of terms that are reported.
LEAST_DOCS, RANKS = 10, 10
#: Shares are whole numbers of this unit, made in three steps so that counts up to 9 * 10^15 stay exact in 64 bits.
UNIT_ROOT = 1000
#: Bytes of texts that are counted together, terms whose divergences are summed together.
SLICE_BYTES, TERMS_A_BLOCK = 12_000_000, 8_192


@lru_cache(maxsize=1)
def _table():
    """Lower-cased bytes of terms: letters, and all bytes beyond ASCII; 0 between terms."""
    import numpy as np

    table = np.zeros(256, np.uint8)
    small = np.arange(ord("a"), ord("z") + 1)
    table[small] = table[small - 32] = small
    table[128:] = np.arange(128, 256)
    return table


def slices(data, offsets):
    """Lower-cased bytes, and begin, end and text number of each term in texts that stand in one buffer, text i from offsets[i] to offsets[i + 1]."""
    import numpy as np

    small = _table()[data[offsets[0] : offsets[-1]]]
    edge = offsets - offsets[0]
    solid = small != 0
    begins, ends = solid.copy(), solid.copy()
    begins[1:] &= ~solid[:-1]
    ends[:-1] &= ~solid[1:]
    inner = edge[(edge > 0) & (edge < len(small))]  # a term never goes from one text into the next
    begins[inner], ends[inner - 1] = solid[inner], solid[inner - 1]
    begin, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return small, begin, end, np.searchsorted(edge, begin, "right") - 1


def gathered(begin, size):
    """The indices of all bytes of some slices, slice after slice."""
    import numpy as np

    done = np.cumsum(size) - size
    return np.repeat(begin - done, size) + np.arange(int(size.sum()))


def grouped(small, begin, end, digest: Callable[[bytes], int] | None = None):
    """A number for each slice, the same for equal bytes, and one slice that stands for each number.

    Slices of one hash are compared byte by byte with the first of them; those that differ are told apart by their bytes.
    """
    import numpy as np
    import xxhash

    digest = digest or xxhash.xxh3_64_intdigest
    raw, step = small.tobytes(), 1 << 18
    hashes = np.empty(len(begin), np.uint64)
    for lo in range(0, len(begin), step):
        a, z = begin[lo : lo + step].tolist(), end[lo : lo + step].tolist()
        hashes[lo : lo + step] = np.fromiter((digest(raw[i:j]) for i, j in zip(a, z, strict=True)), np.uint64, len(a))
    _, first, number = np.unique(hashes, return_index=True, return_inverse=True)
    size, other = end - begin, []
    for lo in range(0, len(begin), step):
        mine = np.arange(lo, min(lo + step, len(begin)))
        its = first[number[mine]]
        same = size[mine] == size[its]
        other += mine[~same].tolist()
        mine, its = mine[same], its[same]
        if len(mine):
            differ = small[gathered(begin[mine], size[mine])] != small[gathered(begin[its], size[mine])]
            other += mine[np.add.reduceat(differ, np.cumsum(size[mine]) - size[mine], dtype=np.int64) > 0].tolist()
    if other:
        known: dict[bytes, int] = {}
        first = first.tolist()
        for i in sorted(other):
            number[i] = known.setdefault(raw[begin[i] : end[i]], len(first))
            if number[i] == len(first):
                first.append(i)
        first = np.array(first)
    return number, first


def _strings(small, begin, size):
    """Slices as an Arrow array of strings."""
    import numpy as np
    import pyarrow as pa

    offsets = np.zeros(len(begin) + 1, np.int32)
    np.cumsum(size, out=offsets[1:])
    return pa.StringArray.from_buffers(len(begin), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(small[gathered(begin, size)])))


def counted(texts, lang, source):
    """For each language and term in some texts (Arrow strings): its sources, and for each of them occurrences and documents."""
    import numpy as np
    import pyarrow as pa

    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.empty(0, np.uint8)
    small, begin, end, doc = slices(data, offsets)
    number, first = grouped(small, begin, end)
    # Documents by terms: sorted, each cell once.
    cells, n = np.unique(doc * len(first) + number, return_counts=True)
    doc, term = np.divmod(cells, max(1, len(first)))
    lang, source = lang.dictionary_encode(), source.dictionary_encode()
    of_lang, of_source = (np.asarray(x.indices)[doc] for x in (lang, source))
    order = np.lexsort((of_source, term, of_lang))
    of_lang, of_source, term, n = of_lang[order], of_source[order], term[order], n[order]
    new_term = np.ones(len(order), bool)
    new_term[1:] = (of_lang[1:] != of_lang[:-1]) | (term[1:] != term[:-1])
    new_source = new_term.copy()
    new_source[1:] |= of_source[1:] != of_source[:-1]
    at = np.flatnonzero(new_source)
    rows = np.flatnonzero(new_term)
    lists = pa.array(np.append(np.searchsorted(at, rows), len(at)).astype(np.int32))
    each = lambda values: pa.ListArray.from_arrays(lists, values)
    sums = np.add.reduceat(n, at).astype(np.int64) if len(at) else n.astype(np.int64)
    begin, size = begin[first[term[rows]]], (end - begin)[first[term[rows]]]
    return [
        lang.dictionary.take(pa.array(of_lang[rows])), _strings(small, begin, size), each(source.dictionary.take(pa.array(of_source[at]))),
        each(pa.array(sums)), each(pa.array(np.diff(np.append(at, len(order))).astype(np.int64))),
    ]


def _count(batches):
    """counted() over some batches of documents at a time."""
    import pyarrow as pa
    import pyarrow.compute as pc

    def run(some):
        texts, lang, source = (pa.concat_arrays([b.column(c).cast(pa.large_string()) for b in some]) for c in ("text", "lang", "source"))
        found = counted(texts, lang, source)
        found[0], found[2] = found[0].cast(pa.string()), found[2].cast(pa.list_(pa.string()))
        return pa.RecordBatch.from_arrays(found, names=["lang", "term", "sources", "n", "docs"])

    some, size = [], 0
    for b in batches:
        lo = 0
        ends = pc.cumulative_sum(pc.binary_length(b.column("text"))).to_pylist()
        for hi, end in enumerate(ends, 1):
            if size + end - (ends[lo - 1] if lo else 0) >= SLICE_BYTES or hi == len(ends):
                some.append(b.slice(lo, hi - lo))
                size, lo = size + end - (ends[lo - 1] if lo else 0), hi
                if size >= SLICE_BYTES:
                    yield run(some)
                    some, size = [], 0
    if some:
        yield run(some)


def share(count, total, terms):
    """1 + floor(10^9 * (count + 2) / (total + 2 * terms)), exact: a long division, three digits at a time."""
    import numpy as np

    whole = np.asarray(total + 2 * terms, np.int64)
    rest, out = np.asarray(count, np.int64) + 2, 0
    for _ in range(3):
        digits, rest = np.divmod(rest * UNIT_ROOT, whole)
        out = out * UNIT_ROOT + digits
    return out + 1


def divergence(p, q):
    return (p - q) * (p - q) // (p + q)


def pair_sums(indptr, column, p, p0, width: int):
    """Divergence of all pairs of rows of a sparse matrix, summed over its columns. p: shares of the stored cells, p0: each row's share elsewhere.

    For rows a and b: what a's row gives against b's constant share, corrected in the cells that b has.
    """
    import numpy as np

    n = len(p0)
    out, own = np.zeros((n, n), np.int64), np.repeat(np.arange(n), np.diff(indptr))
    held = np.flatnonzero(np.diff(indptr))
    for a in range(n):
        mine = slice(indptr[a], indptr[a + 1])
        line = np.full(width, p0[a])
        line[column[mine]] = p[mine]
        total = divergence(p0[a], p0) * (width - (indptr[a + 1] - indptr[a]))
        step = max(1, 1_000_000 // max(1, len(p[mine])))
        for b in range(0, n, step):
            total[b : b + step] += divergence(p[mine][:, None], p0[None, b : b + step]).sum(0)
        there = line[column]
        if len(held):
            total[held] += np.add.reduceat(divergence(there, p) - divergence(there, p0[own]), indptr[:-1][held])
        out[a] = total
    return out


def _block(left, right):
    """Of one block of a language's terms and all its sources: sums for each pair of sources, the leading terms of each source."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    names = right.column("source").combine_chunks()
    n, terms, lang = np.asarray(right.column("n")), np.asarray(right.column("terms")), right.column("lang")[0].as_py()
    rows = left.num_rows
    lists = left.column("sources").combine_chunks()
    column = np.repeat(np.arange(rows), np.diff(np.asarray(lists.offsets)))
    row = np.asarray(pc.index_in(lists.flatten(), value_set=names))
    count = np.asarray(left.column("counts").combine_chunks().flatten())
    in_lang = np.zeros(rows, np.int64)
    np.add.at(in_lang, column, count)
    order = np.lexsort((column, row))
    row, column, count = row[order], column[order], count[order]
    indptr = np.searchsorted(row, np.arange(len(names) + 1))
    p, p0 = share(count, n[row], terms[row]), share(np.zeros(len(names), np.int64), n, terms)
    sums = pair_sums(indptr, column, p, p0, rows)
    a, b = np.nonzero(~np.eye(len(names), dtype=bool))
    out = [(names.take(pa.array(a)), ["pair"] * len(a), names.take(pa.array(b)), sums[a, b])]
    q = share(in_lang, n.sum(), terms[0])[column]
    text = left.column("term").combine_chunks()
    place = np.argsort(np.argsort(np.array(text.cast(pa.binary()).to_pylist(), object), kind="stable"))
    over = np.flatnonzero(p > q)
    value = divergence(p[over], q[over])
    best = over[np.lexsort((place[column[over]], -value, row[over]))]
    rank = np.arange(len(best)) - np.searchsorted(row[best], row[best])
    best = best[rank < RANKS]
    out.append((names.take(pa.array(row[best])), ["term"] * len(best), text.take(pa.array(column[best])), divergence(p[best], q[best])))
    kinds = [pa.string(), pa.string(), pa.string(), pa.int64()]
    columns = [pa.concat_arrays([x.cast(k) if isinstance(x, pa.Array) else pa.array(x, k) for x in parts]) for parts, k in zip(zip(*out, strict=True), kinds, strict=True)]
    return pa.table([pa.array([lang] * len(columns[0]), pa.string()), *columns], names=["lang", "source", "part", "item", "value"])


def source_divergence(df: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """lang, source, part, item, value, rank: for each source of a language its divergence from every other one ('pair'), and its leading terms ('term').

    Null text, lang and source count as ''. A language keeps the terms that at least `least_docs` of its documents have. A source's share of a kept
    term is 1 + floor(10^9 * (count + 2) / (all kept occurrences + 2 * kept terms)); two shares p and q diverge by floor((p - q)^2 / (p + q)).
    Sources without terms take part; a language without kept terms gives its pairs 0, one with a single source no pairs. Ranks: greatest value first, then
    the item in the order of its bytes. Every row counts, repeated ones too; other columns are ignored; an empty table gives no rows.

    Counts leave a task once for each language and term; a common term's rows are as many as tasks. Divergences are summed for blocks of
    terms, so no task holds a language.
    """
    spark = df.sparkSession
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    docs = df.select(empty("text"), empty("lang"), empty("source"))
    folder = common.shared_folder(spark)
    parts = docs.mapInArrow(_count, "lang string, term string, sources array<string>, n array<long>, docs array<long>")
    cells = parts.repartition("lang", "term").select("lang", "term", F.inline(F.arrays_zip(F.col("sources").alias("source"), "n", "docs")))
    # Both groupings keep the partitioning by language and term.
    cells = cells.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    terms = cells.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "n")).alias("c"), F.sum("docs").alias("docs")).filter(F.col("docs") >= least_docs)
    terms = common.stored(terms.select("lang", "term", "c"), folder, "terms")
    sizes = terms.select("lang", F.explode("c").alias("c")).groupBy("lang", "c.source").agg(F.sum("c.n").alias("n"))
    groups = docs.select("lang", "source").distinct().join(sizes, ["lang", "source"], "left").join(terms.groupBy("lang").agg(F.count("*").alias("terms")), "lang", "left")
    groups = common.stored(groups.select("lang", "source", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n", "terms")]), folder, "groups")
    blocks = F.ceil(F.col("terms") / TERMS_A_BLOCK).cast("int")
    by_lang = groups.filter("terms > 0").select("lang", blocks.alias("blocks")).distinct()
    placed = terms.join(by_lang, "lang").select("lang", F.pmod(F.xxhash64("term"), "blocks").cast("int").alias("block"), "term", F.col("c.source").alias("sources"), F.col("c.n").alias("counts"))
    everywhere = groups.filter("terms > 0").select("lang", "source", "n", "terms", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"))
    schema = "lang string, source string, part string, item string, value long"
    found = placed.groupBy("lang", "block").cogroup(everywhere.groupBy("lang", "block")).applyInArrow(_block, schema)
    found = common.stored(found, folder, "found")
    other = groups.select("lang", F.col("source").alias("item"))
    zero = groups.join(other, "lang").filter(F.col("source") != F.col("item")).select("lang", "source", F.lit("pair").alias("part"), "item", F.lit(0).cast("long").alias("value"))
    every = found.unionByName(zero).groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    return every.withColumn("rank", rank).filter((F.col("part") == "pair") | (F.col("rank") <= RANKS))
