"""Chat formatting as a prefix tree.

Conversations that begin with the same turns share those turns' nodes. The tree is emitted once, depth first, into one
stream of tokens; a node has its token ids, the position of its first token in the conversation (so shared turns keep
theirs), and the intervals of the stream that its tokens may attend to: its ancestors and itself. Where no branch lies
between, ancestors follow each other in the stream and their intervals are one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

#: What marks turns. Inside texts these strings are escaped by a backslash after their first character.
USER, ASSISTANT, OTHER = ("<s>[INST] ", " [/INST]"), (" ", " </s>"), ("<s>[ROLE:", "[/ROLE]")
_CONTROL = r"s>|/s>|INST\]|/INST\]|ROLE:|/ROLE\]|\|endoftext\|>"


def escaped(text: Column) -> Column:
    """One backslash more after the first character of each control string, which may already have some."""
    return F.regexp_replace(text, rf"([<\[])(\\*)({_CONTROL})", r"$1\\$2$3")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])\\(\\*)({_CONTROL})", "$1$2$3")


def segment(role: Column, text: Column) -> Column:
    """A turn as it is formatted: struct<head, body, tail>, the body being the escaped text. Roles but user and assistant are named, in URL encoding."""
    parts = lambda head, tail: F.struct(head.alias("head"), escaped(text).alias("body"), F.lit(tail).alias("tail"))
    return (
        F.when(role == "user", parts(F.lit(USER[0]), USER[1]))
        .when(role == "assistant", parts(F.lit(ASSISTANT[0]), ASSISTANT[1]))
        .otherwise(parts(F.concat(F.lit(OTHER[0]), F.url_encode(role), F.lit("] ")), OTHER[1]))
    )


def role_of(formatted: Column) -> Column:
    other = F.url_decode(F.regexp_extract(formatted, r"^<s>\[ROLE:([^\]]*)\]", 1))
    return F.when(formatted.startswith(USER[0]), "user").when(formatted.startswith(OTHER[0]), other).otherwise("assistant")


def body_span(formatted: Column) -> tuple[Column, Column]:
    """Where the escaped text of a formatted turn begins (from 0), and how long it is."""
    n = F.char_length(formatted)
    begin = F.when(formatted.startswith(USER[0]), len(USER[0])).when(formatted.startswith(OTHER[0]), F.locate("] ", formatted) + 1).otherwise(len(ASSISTANT[0]))
    end = F.when(formatted.startswith(USER[0]), len(USER[1])).when(formatted.startswith(OTHER[0]), len(OTHER[1])).otherwise(len(ASSISTANT[1]))
    return begin, n - begin - end


@lru_cache(maxsize=1)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.encode_special_tokens = True  # a special token's string inside a text is text
    return found


def _ids(path: str):
    """A column function: the parts of a turn to its token ids and which of them are the body's. Each part is encoded on its own, so that no token is half a mark."""

    @F.arrow_udf("struct<ids:array<int>,body_at:int,body_ids:int>")
    def run(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for parts in batches:
            head, body, tail = ([e.ids for e in _tokenizer(path).encode_batch_fast(p.to_pylist(), add_special_tokens=False)] for p in parts)
            ids = pa.array([a + b + c for a, b, c in zip(head, body, tail, strict=True)], pa.list_(pa.int32()))
            yield pa.StructArray.from_arrays([ids, pa.array(map(len, head), pa.int32()), pa.array(map(len, body), pa.int32())], ["ids", "body_at", "body_ids"])

    return run


def _text(path: str):
    """A column function: token ids to text."""

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for ids in batches:
            yield pa.array(_tokenizer(path).decode_batch([x or [] for x in ids.to_pylist()], skip_special_tokens=False), pa.string())

    return run


def turns(df: DataFrame) -> DataFrame:
    """conv_id, i (from 1), role, text: turns in order of turn (null first), equal ones by role and text. Null role or text is empty."""
    rows = df.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.withColumn("i", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))).drop("turn")


def chat_tree(df: DataFrame, tokenizer: str, folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, members) of all conversations in df (conv_id, turn, role, text).

    nodes: k1, k2 (the node's key), depth, formatted, ids, loss_at, loss_ids (which of the ids are an assistant's escaped text, and so bear loss; null for
    others), position (of its first id in its conversations), start, end (in the stream), attends (intervals of the stream).
    members: conv_id, i, k1, k2 - which node is each conversation's i-th turn.
    Rows with a null conv_id are one conversation. An empty table gives two empty ones.
    """
    spark = df.sparkSession
    common.modest_batches(spark)
    folder = folder or common.shared_folder(spark)
    so_far = Window.partitionBy("conv_id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    in_order = Window.partitionBy("conv_id").orderBy("i")
    # The key of a prefix: its turns' hashes, each with its place, added without carry.
    keyed = turns(df).withColumn("k1", F.bit_xor(F.xxhash64(F.lit(1), "i", "role", "text")).over(so_far)).withColumn("k2", F.bit_xor(F.xxhash64(F.lit(2), "text", "i", "role")).over(so_far))
    keyed = keyed.withColumn("p1", F.lag("k1").over(in_order)).withColumn("p2", F.lag("k2").over(in_order))
    keyed = common.stored(keyed, folder, "turns")

    nodes = keyed.groupBy("k1", "k2").agg(F.first("p1").alias("p1"), F.first("p2").alias("p2"), F.first("i").alias("depth"), F.first(F.struct("role", "text")).alias("turn"))
    nodes = nodes.withColumn("parts", segment(F.col("turn.role"), F.col("turn.text"))).withColumn("coded", _ids(tokenizer)("parts.head", "parts.body", "parts.tail"))
    loss = lambda c: F.when(F.col("turn.role") == "assistant", F.col(c))
    nodes = nodes.select("k1", "k2", "p1", "p2", "depth", F.concat("parts.head", "parts.body", "parts.tail").alias("formatted"), "coded.ids", loss("coded.body_at").alias("loss_at"), loss("coded.body_ids").alias("loss_ids"), F.size("coded.ids").cast("long").alias("n"))
    nodes = common.stored(nodes, folder, "nodes")
    forks = nodes.filter("p1 IS NOT NULL").groupBy("p1", "p2").agg(F.count("*").alias("children")).filter("children > 1").select("p1", "p2", F.lit(True).alias("fork"))

    # A node's path: the children taken at each fork above it. Along a path without forks nodes are in order of depth.
    # First turns have no parent, so they stay out of the join with forks; theirs are few enough to be sent along, or else joined by their own key.
    members = keyed.select("conv_id", "i", "k1", "k2", "p1", "p2").join(nodes.select("k1", "k2", "n"), ["k1", "k2"])
    later = members.filter("i > 1").join(common.small(common.stored(forks, folder, "forks")), ["p1", "p2"], "left")
    members = later.unionByName(members.filter("i = 1").withColumn("fork", F.lit(True)))
    branch = F.when(F.col("fork"), F.struct("k1", "k2"))
    members = members.withColumn("path", F.collect_list(branch).over(so_far)).withColumn("position", F.sum("n").over(so_far) - F.col("n"))
    members = common.stored(members.select("conv_id", "i", "k1", "k2", "path", "position"), folder, "members")
    placed = members.groupBy("k1", "k2").agg(F.first("path").alias("path"), F.first("position").alias("position"))
    tree = nodes.drop("p1", "p2").join(placed, ["k1", "k2"])

    # Depth first: sorted by path and depth. A range's first place in the stream is the sum of the ranges before it.
    order = ("path", "depth", "k1", "k2")
    tree = tree.repartitionByRange(common.shuffle_partitions(spark), *order).sortWithinPartitions(*order)
    tree = common.stored(tree.withColumn("shard", F.spark_partition_id()).withColumn("row", F.monotonically_increasing_id()), folder, "sorted")
    sizes = tree.groupBy("shard").agg(F.sum("n").alias("size"))
    sizes = sizes.withColumn("base", F.coalesce(F.sum("size").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row per range
    within = Window.partitionBy("shard").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    tree = tree.join(F.broadcast(sizes.select("shard", "base")), "shard").withColumn("end", F.col("base") + F.sum("n").over(within)).withColumn("start", F.col("end") - F.col("n"))
    tree = common.stored(tree.drop("base", "shard", "row"), folder, "placed")

    chains = tree.groupBy("path").agg(F.min("start").alias("a"), F.max("end").alias("z"))
    above = chains.filter(F.size("path") > 1).select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size("path") - 1), lambda m: F.slice("path", F.lit(1), m))).alias("prefix"))
    above = above.join(chains.select(F.col("path").alias("prefix"), F.struct(F.col("a").alias("start"), F.col("z").alias("end")).alias("span")), "prefix").groupBy("path").agg(F.sort_array(F.collect_list("span")).alias("above"))  # a span per fork
    tree = tree.join(chains.select("path", "a").join(above, "path", "left"), "path")
    own = F.array(F.struct(F.col("a").alias("start"), F.col("end").alias("end")))
    tree = tree.select("k1", "k2", "depth", "formatted", "ids", "loss_at", "loss_ids", "position", "start", "end", F.concat(F.coalesce("above", F.array().cast("array<struct<start:bigint,end:bigint>>")), own).alias("attends"))
    return common.stored(tree, folder, "tree"), members.select("conv_id", "i", "k1", "k2")


#: Ids of the stream that one bucket of the look-up by place holds.
STRIDE = 4096


def read_back(nodes: DataFrame, members: DataFrame, tokenizer: str) -> DataFrame:
    """Each conversation as the stream gives it: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_ids.

    A conversation's last node says what it attends to; the nodes in those intervals are its turns, in the stream's order, and their decoded ids are its
    text. turns_sha256 is of role, newline, text, newline of each turn; the loss columns are of the ids under the loss mask, decoded and unescaped.
    """
    own_ids = F.when(F.col("loss_at").isNotNull(), F.slice("ids", F.col("loss_at") + 1, F.col("loss_ids")))
    decoded = nodes.select("start", "end", F.size("ids").cast("long").alias("n_ids"), _text(tokenizer)("ids").alias("formatted"), _text(tokenizer)(own_ids).alias("own"))
    begin, size = body_span(F.col("formatted"))
    parts = decoded.select("start", "end", "n_ids", role_of(F.col("formatted")).alias("role"), unescaped(F.substring(F.col("formatted"), begin + 1, size)).alias("text"), unescaped(F.col("own")).alias("loss"), F.char_length("formatted").cast("long").alias("chars"))
    parts = parts.withColumn("bucket", F.floor(F.col("start") / STRIDE))

    ends = members.groupBy("conv_id").agg(F.max(F.struct("i", "k1", "k2")).alias("last")).select("conv_id", F.col("last.k1").alias("k1"), F.col("last.k2").alias("k2"))
    spans = ends.join(nodes.select("k1", "k2", "attends"), ["k1", "k2"]).select("conv_id", F.explode("attends").alias("span")).select("conv_id", F.col("span.start").alias("a"), F.col("span.end").alias("z"))
    spans = spans.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("a") / STRIDE), F.floor((F.col("z") - 1) / STRIDE))))
    rows = spans.join(parts, "bucket").filter("start >= a AND end <= z")
    rows = rows.groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.sort_array(F.collect_list(F.struct("start", "role", "text", "loss"))).alias("turns"), F.sum("chars").alias("formatted_chars"), F.sum("n_ids").alias("n_ids"))
    whole = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    rows = rows.withColumn("loss", F.concat_ws("", F.transform("turns", lambda t: t["loss"])))
    return rows.select("conv_id", "n_turns", F.sha2(whole, 256).alias("turns_sha256"), F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars", "n_ids")
