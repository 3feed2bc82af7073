"""Spelling variants by anagram hashing: words whose letter sums differ by one letter's value, or by an exchange of two, verified by the order of letters.

A word's key is the sum of the fifth powers of its letters, whatever their order. Two words differ by one added or removed letter only if one key
is the other less that letter's value, and by one exchanged letter only if both keys, each less one letter's value, are the same. So every word
stands under its own key and under the keys that are left without each of its letters, and an equi-join brings the two cases together.
A change at one place leaves what is before or what is behind it alone: the front or back half of the letters is part of the join's key, which keeps
the words of one large anagram class apart. What meets is verified by edit distance, which counts each pair once.
"""

from __future__ import annotations

import re
from collections import Counter
from zlib import crc32

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Letters that a word is made of; the share of runs (one of so many) from which a letter is taken; least letters and occurrences of a word; how much commoner a form is.
LETTERS, EDITED, LEAST_LETTERS, LEAST_COUNT, COMMONER = "A-Za-zÀ-ÿ", 97, 5, 3, 2
#: Words that a task counts before it hands their counts on.
HELD_WORDS = 500_000
#: Keys are sums modulo a prime, so that runs of any length stay within 64 bits.
_PRIME = (1 << 61) - 1


def _counts(batches):
    """Words of some documents and how often they occur, runs edited by the hash of document and run."""
    import pyarrow as pa

    run = re.compile(f"[{LETTERS}]{{{LEAST_LETTERS},}}")  # a shorter run is no word, whether a letter goes or not
    lower = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
    total: Counter[str] = Counter()

    def flush():
        out = pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])
        total.clear()
        return out

    for b in batches:
        ids, texts = b.column("doc_id").to_pylist(), b.column("text").cast(pa.large_binary())
        for i, text in zip(ids, texts, strict=True):
            seed = crc32(f"{'' if i is None else i}:".encode())
            for word, n in Counter(run.findall(text.as_py().translate(lower).decode())).items():
                h = crc32(word.encode(), seed)
                if h % EDITED == 0:
                    k = h % len(word)
                    word = word[:k] + word[k + 1 :]
                    if len(word) < LEAST_LETTERS:
                        continue
                total[word] += n
            if len(total) >= HELD_WORDS:
                yield flush()
    if total:
        yield flush()


def words(df: DataFrame) -> DataFrame:
    """word, n: the words of all documents with their occurrences."""
    counts = common.texts(df).mapInArrow(_counts, "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_COUNT)


def buckets(vocabulary: DataFrame) -> DataFrame:
    """bucket, front, short, word, n: the places where a word may meet its near ones. short: whether a letter is left out there."""
    def value(c: Column) -> Column:
        x = F.ascii(c).cast("long")
        return x * x * x * x * x

    less = lambda a, x: F.pmod(a - x, F.lit(_PRIME))
    powers = F.transform(F.filter(F.split("word", ""), lambda c: c != ""), value)
    keyed = vocabulary.select("word", "n", F.char_length("word").alias("size"), powers.alias("powers"))
    keyed = keyed.withColumn("key", F.aggregate("powers", F.lit(0).cast("long"), lambda a, x: (a + x) % F.lit(_PRIME)))
    shorter = F.transform(F.array_distinct(F.transform("powers", lambda x: less(F.col("key"), x))), lambda k: F.struct(k.alias("key"), F.lit(True).alias("short")))
    each = keyed.select("word", "n", "size", F.explode(F.concat(F.array(F.struct("key", F.lit(False).alias("short"))), shorter)).alias("k"))
    each = each.select("word", "n", "k.key", "k.short", (F.col("size") - F.col("k.short").cast("int")).alias("size"), F.explode(F.array(F.lit(True), F.lit(False))).alias("front"))
    half = F.floor(F.col("size") / 2).cast("int")
    part = F.when(F.col("front"), F.left("word", half)).otherwise(F.right("word", F.col("size") - half))
    return each.select(F.xxhash64("key", "size", "front", part).alias("bucket"), "front", "short", "word", "n")


def near_pairs(vocabulary: DataFrame) -> DataFrame:
    """word, n, near, near_n: every pair of words that differ by exactly one letter added, removed or exchanged, both ways round."""
    placed = buckets(vocabulary)
    a, b = (placed.select(*[F.col(c).alias(f"{c}_{side}") for c in placed.columns]) for side in "ab")
    met = a.join(b, (F.col("bucket_a") == F.col("bucket_b")) & (F.col("word_a") < F.col("word_b")) & (F.col("front_a") == F.col("front_b")) & (F.col("short_a") | F.col("short_b")))
    half = F.floor((F.char_length("word_a") - F.col("short_a").cast("int")) / 2).cast("int")
    once = F.col("front_a") | (F.left("word_a", half) != F.left("word_b", half))
    found = met.filter((F.levenshtein("word_a", "word_b", 1) == 1) & once)
    ways = [F.struct(F.col(f"word_{x}").alias("word"), F.col(f"n_{x}").alias("n"), F.col(f"word_{y}").alias("near"), F.col(f"n_{y}").alias("near_n")) for x, y in ("ab", "ba")]
    return found.select(F.inline(F.array(*ways)))


def roots(forms: DataFrame, folder: str) -> DataFrame:
    """word, root of the rows (word, form): forms followed to the last. Each round follows twice as far; a form is twice as common, so a few rounds do."""
    now = common.stored(forms.select("word", F.col("form").alias("root")), folder, "roots-0")
    for k in range(1, 64):
        on = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        now = common.stored(now.select("word", "root").join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), folder, f"roots-{k}")
        if now.filter("moved").isEmpty():
            break
    return now.select("word", "root")


def spelling_variants(df: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of each word of df (doc_id, text) that has at least LEAST_LETTERS code points and LEAST_COUNT occurrences.

    Words are runs of Latin letters with A-Z lower-cased; where EDITED divides the crc32 of '<doc_id>:<run>', the run lacks its letter number
    crc32 modulo its length. n_near: how many words differ by one letter. form: the commonest of them (ties: the first in code-point order) if it occurs
    at least COMMONER times as often, else null, with form_n its occurrences. root: the last of the forms that follow, or the word itself.

    Null texts have no words, a null doc_id is hashed as nothing; repeated rows count each time; other columns are ignored; an empty
    table gives no rows. Counts of a common word leave each task once. No list of words is gathered, neither of a bucket nor on the driver.
    """
    folder = common.shared_folder(df.sparkSession)
    vocabulary = common.stored(words(df), folder, "words")
    # The smallest of (-n, near) is the commonest near word, first in order among equals.
    best = near_pairs(vocabulary).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("down"), "near")).alias("best"))
    found = vocabulary.join(best, "word", "left")
    takes = -F.col("best.down") >= COMMONER * F.col("n")
    found = found.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(takes, F.col("best.near")).alias("form"), F.when(takes, -F.col("best.down")).alias("form_n"))
    found = common.stored(found, folder, "forms")
    last = roots(found.filter("form IS NOT NULL"), folder)
    return found.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
