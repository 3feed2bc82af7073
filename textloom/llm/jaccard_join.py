"""N-gram Jaccard join with filters under several global token orders.

Two sets whose Jaccard similarity reaches t share a token among the first n - ceil(t n) + 1 tokens of each, under
*any* global order. All orders here put tokens of many documents last (by a bounded table of frequent tokens) and
differ in a hash among the others. Rows with equal sets are one class. Candidates share a prefix token under the
first order; before verification they must also share one under every other order and have fitting sizes.
A prefix that is longer by l tokens must share l more (slack): that leaves few candidates of unrelated texts.

Prefix tokens of more than `few` classes never become pairs. Each has a pivot, the class with most copies. Every
other class keeps its difference from the pivot (a small set among near copies), and two classes are compared by
their differences alone, in blocks of bounded size; classes that link to the pivot aren't compared with each other.
"""

from __future__ import annotations

import math
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, shingles
from .components import components

#: Frequent tokens that the orders know of. It bounds the broadcast, 16 bytes each; no result depends on it.
KNOWN_TOKENS = 500_000
FEW, BLOCK, ORDERS = 12, 1000, 3
#: Characters whose shingles are made at once, and shingles that are counted at once.
SLICE, COUNTED_TOGETHER = 2_000_000, 2_000_000


#: Spark's own setting: what a step has shuffled goes when it ends, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _cleaned(spark: SparkSession):
    """Queries that are made and run within leave no shuffle files. None of them is run again."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def _stored(df: DataFrame, folder: str, name: str) -> DataFrame:
    with _cleaned(df.sparkSession):
        return common.stored(df, folder, name)


def frequent_tokens(docs: DataFrame, k: int, least: int = 4):
    """Sorted shingles that many documents hold, and a level for each one's count: at most KNOWN_TOKENS.

    Tokens that occur once in every group of documents (COUNTED_TOGETHER shingles) are not counted, so counts are lower bounds. They only steer the
    orders; the join is exact under any.
    """
    import numpy as np

    def count(batches):
        import pyarrow as pa

        def counted(sets):
            token, n = np.unique(np.concatenate(sets), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(token[n > 1].view(np.int64)), pa.array(n[n > 1])], ["token", "n"])

        sets, size = [], 0
        for b in batches:
            texts = b.column("text").to_pylist()
            for g in common.sliced(texts, SLICE):
                sets.append(shingles.shingle_sets(texts[g], k)[0])
                size += len(sets[-1])
                if size > COUNTED_TOGETHER:
                    yield counted(sets)
                    sets, size = [], 0
        if sets:
            yield counted(sets)

    common.modest_batches(docs.sparkSession)
    counts = docs.select("text").mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    with _cleaned(docs.sparkSession):
        rows = counts.filter(F.col("n") >= least).orderBy(F.desc("n"), "token").limit(KNOWN_TOKENS).toPandas()
    return _levels(rows["token"].to_numpy(np.int64), rows["n"].to_numpy(np.float64))


def _levels(token, n):
    """Tokens in order, and eight levels for each doubling of their counts."""
    import numpy as np

    token, by = np.unique(token.view(np.uint64), return_index=True)
    return token, np.minimum(8 * np.log2(n[by]), 253).astype(np.uint64)


def _with_long_lists(known, heavy: DataFrame):
    """The frequent tokens, and behind all of them those of long lists."""
    import numpy as np

    late = heavy.toPandas()["t"].to_numpy(np.int64).view(np.uint64)
    token, by = np.unique(np.concatenate([late, known[0]]), return_index=True)
    return token, np.concatenate([np.full(len(late), 254, np.uint64), known[1]])[by]


def _level(s, known):
    """0 for a token of few documents, else one more than its level."""
    import numpy as np

    frequent, levels = known
    if not len(frequent):
        return np.zeros(len(s), np.uint64)
    at = np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)
    return np.where(frequent[at] == s, levels[at] + np.uint64(1), np.uint64(0))


def prefix_size(n, percent: int):
    """How many tokens of a set of n, under any order, hold one at least of every set that it links with."""
    return n - -(-percent * n // 100) + 1


def slack(n, percent: int):
    """How many tokens more the prefix under the first order has."""
    own = prefix_size(n, percent)
    return min(n - own, own // 4 + 8)


def _slack(percent: int, n: str = "n") -> Column:
    """slack() of a column of sizes."""
    own = f"({n} - ({percent} * {n} + 99) div 100 + 1)"
    return F.expr(f"least({n} - {own}, {own} div 4 + 8)")


def _order(s, level, order: int):
    """The sort key of each token under one of the orders: its level, then a hash that differs from order to order."""
    import numpy as np

    return (level << np.uint64(56)) | (shingles.mixed(s + np.uint64(order)) >> np.uint64(8))


def _first(s, key, n: int):
    """The n tokens with the least keys, in any order."""
    import numpy as np

    return s[np.argpartition(key, n - 1)[:n]] if n < len(s) else s


def parity(s, n: int):
    """Of a set of n tokens, a bit for each of its 64, 128, 256 ... places (n at least): whether an odd number of tokens falls there.

    Two sets that differ in d tokens differ in d of these bits at most.
    """
    import numpy as np

    size = max(64, 1 << (n - 1).bit_length())
    bits = (np.bincount((s & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1).astype(bool)
    return np.packbits(bits, bitorder="little").view(np.int64)


PRINTS = {"n": "long", "c": "binary", "few": "array<long>", "many": "array<long>", "bits": "array<long>"} | {f"p{o + 1}": "array<int>" for o in range(1, ORDERS)}


def _prints(docs: DataFrame, k: int, percent: int, known) -> DataFrame:
    """doc_id, n, c (digest of the set), the prefix and its slack under the first order (tokens of few documents, and of many), parity bits,
    and the prefixes under the other orders, shortened to 32 bits a token."""
    known = docs.sparkSession.sparkContext.broadcast(known)

    def make():
        import hashlib

        import numpy as np

        def prints(texts):
            flat, edge = shingles.shingle_sets(texts, k)
            level = _level(flat, known.value)
            key = [_order(flat, level, o) for o in range(ORDERS)]
            low, rows = (flat >> np.uint64(32)).astype(np.uint32).view(np.int32), []
            for a, z in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                s, n = flat[a:z], z - a
                own = prefix_size(n, percent) if n else 0
                front = own + slack(n, percent) if n else 0
                at = np.argpartition(key[0][a:z], front - 1)[:front] if front < n else np.arange(n)
                late = level[a:z][at] > 0
                rows.append([n, hashlib.blake2b(s.tobytes(), digest_size=16).digest(), s[at[~late]].view(np.int64), s[at[late]].view(np.int64), parity(s, n) if n else np.empty(0, np.int64), *(_first(low[a:z], x[a:z], own) for x in key[1:])])
            return list(zip(*rows, strict=True))

        return prints

    return common.per_text(docs, PRINTS, make, SLICE)


def _fronts(docs: DataFrame, k: int, percent: int, known) -> DataFrame:
    """cid, n, and the prefix under the first order."""
    known = docs.sparkSession.sparkContext.broadcast(known)

    def make():
        import numpy as np

        def fronts(texts):
            flat, edge = shingles.shingle_sets(texts, k)
            key = _order(flat, _level(flat, known.value), 0)
            return np.diff(edge), [_first(flat[a:z], key[a:z], prefix_size(z - a, percent)).view(np.int64) for a, z in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]

        return fronts

    return common.per_text(docs, {"n": "long", "p1": "array<long>"}, make, SLICE).withColumnRenamed("doc_id", "cid")


def _sets(docs: DataFrame, k: int) -> DataFrame:
    def make():
        import numpy as np

        def sets(texts):
            flat, edge = shingles.shingle_sets(texts, k)
            return [[x.view(np.int64) for x in np.split(flat, edge[1:-1])]]

        return sets

    return common.per_text(docs, {"s": "array<long>"}, make, SLICE).withColumnRenamed("doc_id", "cid")


def _within_blocks(percent: int):
    """Links among the classes of one pair of blocks, by their differences from the pivot: a spanning forest of them."""

    def link(key, rows):
        import numpy as np
        import pandas as pd

        rows = rows.reset_index(drop=True)
        m, n = len(rows), rows["n"].to_numpy(np.int64)
        each = np.array([len(d) for d in rows["d"]], np.int64)
        owner, element = np.repeat(np.arange(m), each), np.unique(np.concatenate([np.asarray(d, np.int64) for d in rows["d"]] + [np.empty(0, np.int64)]), return_inverse=True)[1]
        shared = np.bincount(element)[element] > 1
        owner, element = owner[shared], np.unique(element[shared], return_inverse=True)[1]
        common_ = np.zeros((m, m), np.float32)
        for lo in range(0, int(element.max()) + 1 if len(element) else 0, 4096):
            some = (element >= lo) & (element < lo + 4096)
            has = np.zeros((m, 4096), np.float32)
            has[owner[some], element[some] - lo] = 1
            common_ += has @ has.T
        both = n[:, None] + n[None, :]
        apart = each[:, None] + each[None, :] - 2 * common_.astype(np.int64)
        near = 100 * (both - apart) >= percent * (both + apart)
        done = rows["linked"].to_numpy(bool)
        near &= ~(done[:, None] & done[None, :])
        np.fill_diagonal(near, False)
        label = np.arange(m)
        while True:
            new = np.minimum(label, np.where(near, label[None, :], m).min(axis=1, initial=m))
            if (new == label).all():
                break
            label = new
        cid = rows["cid"].to_numpy(np.int64)
        return pd.DataFrame({"a": cid, "b": cid[label]})[label != np.arange(m)]

    return link


def _classes(prints: DataFrame, one: DataFrame, folder: str) -> DataFrame:
    """The rows of prints that stand for a class, with its id: no arrays are shuffled, as a bit for each row of prints is broadcast (64 a row,
    as long as these are few: up to 128 million documents)."""
    first = one.groupBy(F.shiftright("r", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(r & 63 AS int)))").alias("firsts"))
    first = common.small(_stored(first, folder, "first"))
    rows = prints.withColumn("word", F.shiftright("r", 6)).join(first, "word").filter("(shiftright(firsts, cast(r & 63 AS int)) & 1) = 1")
    return rows.drop("word", "firsts", "r", "c").withColumnRenamed("doc_id", "cid")


def _each(classes: DataFrame) -> DataFrame:
    """cid, n, t of each class's prefix tokens."""
    return classes.select("cid", "n", F.explode(F.concat("few", "many")).alias("t"))


def _shared(tokens: DataFrame) -> DataFrame:
    """The rows whose token t others have too, with size: how many. They are shuffled once."""
    return tokens.withColumn("size", F.count("*").over(Window.partitionBy("t"))).filter("size > 1")


def _differing_bits(a: str, b: str) -> Column:
    """In how many parity bits two sets differ. The longer row of bits is folded to the other's length: halves are added without carry."""

    def folded(x, n):
        whole = F.size(x)
        return F.when(whole == n, x).otherwise(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.aggregate(F.sequence(F.lit(0), (whole / n).cast("int") - 1), F.lit(0).cast("long"), lambda acc, j: acc.bitwiseXOR(F.get(x, i + j * n)))))

    a, b = F.col(a), F.col(b)
    n = F.least(F.size(a), F.size(b))
    return F.aggregate(F.zip_with(folded(a, n), folded(b, n), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda total, x: total + x)


def near(n_a, n_b, apart, percent: int):
    """Whether sets that differ in `apart` tokens (at least) can link."""
    return (100 + percent) * apart <= (100 - percent) * (n_a + n_b)


def _candidates(tokens: DataFrame, classes: DataFrame, percent: int, folder: str) -> DataFrame:
    """(a, b) of classes that share enough prefix tokens of at most FEW classes under the first order, and one under every other, whose sizes and parity bits allow a link.

    Of sets that link, prefixes that are longer than they must be by `spare` tokens share spare + 1 of them. Either one of these is a token of
    more than FEW classes, where pivots find the link, or all of them are counted here. Few pairs are left to meet the prefixes of the other orders.
    """
    some = tokens.filter(f"size <= {FEW}").select("t", "cid", "n", "spare")
    side = lambda x: some.select("t", F.col("cid").alias(x), F.col("n").alias(f"n_{x}"), F.col("spare").alias(f"spare_{x}"))
    pairs = side("a").join(side("b"), "t").filter(f"a < b AND 100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)")
    pairs = pairs.groupBy("a", "b").agg(F.count("*").alias("shared"), F.min(F.least("spare_a", "spare_b")).alias("spare")).filter("shared > spare")
    pairs = _stored(pairs.select("a", "b"), folder, "pairs-0")
    paired = common.small(_stored(pairs.select(F.explode(F.array("a", "b")).alias("cid")).distinct(), folder, "paired"))
    classes = classes.join(paired, "cid", "left_semi")
    others = [f"p{o + 1}" for o in range(1, ORDERS)]
    of = lambda x: classes.select(F.col("cid").alias(x), *[F.col(v).alias(f"{x}_{v}") for v in ("n", "bits", *others)])
    pairs = pairs.join(of("a"), "a").join(of("b"), "b")
    for v in others:
        pairs = pairs.filter(F.arrays_overlap(f"a_{v}", f"b_{v}"))
    pairs = pairs.filter(near(F.col("a_n"), F.col("b_n"), _differing_bits("a_bits", "b_bits"), percent))
    return _stored(pairs.select("a", "b"), folder, "pairs")


def jaccard_join(df: DataFrame, k: int, percent: int, folder: str | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id of each row: 100 * intersection >= percent * union links two rows' sets.

    Sets hold the distinct shingles of k words (shingles.shingle_sets). Null, empty and wordless texts have empty sets, n_shingles 0
    and link with nothing: component_id is their doc_id. Equal sets link. Rows that share a doc_id count as one document; a row
    without doc_id gets the component of its equals, if any. An empty table gives an empty result.
    """
    spark = df.sparkSession
    folder = folder or common.shared_folder(spark)
    docs = common.texts(df)
    known = frequent_tokens(docs, k)
    prints = _stored(_prints(docs, k, percent, known).withColumn("r", F.monotonically_increasing_id()), folder, "prints")
    # A class is its first row.
    one = prints.filter("n > 0 AND doc_id IS NOT NULL").groupBy("c").agg(F.min(F.struct("doc_id", "r")).alias("first"), F.count("*").alias("copies"))
    one = _stored(one.select("c", F.col("first.doc_id").alias("cid"), F.col("first.r").alias("r"), "copies"), folder, "one")
    classes = _classes(prints, one, folder)
    tokens = _stored(_shared(_each(classes)), folder, "tokens-0")

    # Long lists show tokens that are frequent after all: they go to the end of the first order. A set's slack makes up for some; sets that
    # hold more of them than that get their new prefix from the text.
    heavy = _stored(tokens.filter(f"size > {FEW}").groupBy("t").agg(F.max("size").alias("size")).orderBy(F.desc("size"), "t").limit(KNOWN_TOKENS), folder, "heavy")
    late = F.broadcast(heavy.select("t"))  # KNOWN_TOKENS numbers at most
    held = tokens.join(late, "t", "left_semi").groupBy("cid").agg(F.count("*").alias("held"), F.max(_slack(percent)).alias("slack"))
    held = _stored(held, folder, "held")
    moved = common.small(_stored(held.filter("held > slack").select("cid"), folder, "moved"))
    again = _fronts(docs.join(moved.withColumnRenamed("cid", "doc_id"), "doc_id", "left_semi"), k, percent, _with_long_lists(known, heavy))
    again = _stored(again.select("cid", "n", F.explode("p1").alias("t")).distinct(), folder, "again")
    met = common.small(_stored(again.select("t").distinct(), folder, "again-tokens"))
    stay = tokens.join(late, "t", "left_anti").select("cid", "n", "t").unionByName(_each(classes).join(met, "t", "left_semi"))
    stay = stay.join(common.small(held.select("cid", "held")), "cid", "left").withColumn("spare", _slack(percent) - F.coalesce("held", F.lit(0))).filter("spare >= 0")
    tokens = stay.select("cid", "n", "t", "spare").unionByName(again.withColumn("spare", F.lit(0).cast("long")))
    tokens = _stored(_shared(tokens.repartition(common.shuffle_partitions(spark), "t").distinct()), folder, "tokens")
    pairs = _candidates(tokens, classes, percent, folder)

    many = tokens.filter(f"size > {FEW}").select("t", "cid").join(one.select("cid", "copies"), "cid")
    pivots = many.groupBy("t").agg(F.max(F.struct("copies", F.bitwise_not("cid").alias("down"))).alias("top")).select("t", F.bitwise_not("top.down").alias("pivot"))
    many = _stored(many.join(pivots, "t").filter("cid <> pivot").select("cid", "pivot").distinct(), folder, "many")

    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).unionByName(many.select(F.explode(F.array("cid", "pivot")).alias("doc_id"))).distinct()
    ids = common.small(_stored(ids, folder, "ids"))
    sets = _stored(_sets(docs.join(ids, "doc_id", "left_semi"), k), folder, "sets")
    of = lambda x: sets.select(F.col("cid").alias(x), F.col("s").alias(f"s_{x}"))
    checked = pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", F.size("s_a").alias("n_a"), F.size("s_b").alias("n_b"), F.size(F.array_intersect("s_a", "s_b")).alias("n"))
    links = checked.filter(f"100 * n >= {percent} * (n_a + n_b - n)").select("a", "b")

    apart = many.join(of("cid"), "cid").join(of("pivot"), "pivot").select("cid", "pivot", F.size("s_cid").alias("n"), F.size("s_pivot").alias("n_pivot"), F.array_union(F.array_except("s_cid", "s_pivot"), F.array_except("s_pivot", "s_cid")).alias("d"))
    apart = _stored(apart.withColumn("linked", near(F.col("n"), F.col("n_pivot"), F.size("d"), percent)), folder, "apart")
    links = links.unionByName(apart.filter("linked").select(F.col("cid").alias("a"), F.col("pivot").alias("b")))
    open_ = apart.groupBy("pivot").agg(F.count("*").alias("size"), F.count_if(~F.col("linked")).alias("open")).filter("size > 1 AND open > 0").select("pivot", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    blocks = apart.join(open_, "pivot").withColumn("x", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int")).withColumn("y", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    blocks = blocks.select("pivot", F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"), "cid", "n", "d", "linked")
    links = links.unionByName(blocks.groupBy("pivot", "x", "y").applyInPandas(_within_blocks(percent), "a long, b long"))

    found = components(_stored(links, folder, "links"), folder)
    named = prints.select("doc_id", "c", F.col("n").alias("n_shingles")).join(one.select("c", "cid"), "c", "left")
    named = named.join(found.withColumnRenamed("id", "cid"), "cid", "left")
    return named.select("doc_id", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.coalesce("component_id", "cid", "doc_id")).alias("component_id"))


def one_of_each(df: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of df without near duplicates: of each component what its least doc_id has. Rows without doc_id stay; of rows that repeat both doc_id
    and text one is left, but different texts under one doc_id all stay, as none is a copy of the other.

    Only the ids of what stays, and the ids that are repeated, meet the rows; texts are not shuffled as long as the ids can be broadcast.
    """
    folder = common.shared_folder(df.sparkSession)
    found = jaccard_join(df, k, percent, folder)
    stay = common.small(_stored(found.filter("doc_id = component_id").select("doc_id").distinct(), folder, "stay"))
    repeated = common.small(_stored(df.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").select("doc_id"), folder, "repeated"))
    rows = df.join(stay, "doc_id", "left_semi")
    once = rows.join(repeated, "doc_id", "left_anti").unionByName(rows.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]))
    return once.select(df.columns).unionByName(df.filter("doc_id IS NULL"))
