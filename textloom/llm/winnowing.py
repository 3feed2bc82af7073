"""Document fingerprints by winnowing, in DataFrame expressions only.

Of a text's code points that are no blanks, each K in a row have a rolling hash, at every position: the cyclic polynomial of the code points' own
hashes (each turned left by its distance from the gram's end, added without carry), built up for the whole array at once from grams of half
the length. From every window of W hashes the least is kept, the rightmost of equal ones, with its position. Two texts that share K + W - 1
such code points in a row, wherever they stand, share a kept hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

K, W = 16, 8
#: Windows compare the upper 33 bits of hashes; the 31 bits below hold the position, counted down so that the least value is the rightmost of equal hashes.
POSITION_BITS = 31
_MASK = (1 << POSITION_BITS) - 1
KEPT = "array<struct<hash:bigint,position:int>>"


def _let(value: Column, body) -> Column:
    """body(value), with value evaluated once for the row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _turned(x: Column, by: Column, right: bool = False) -> Column:
    """64 bits turned left, or right. Shifts count modulo 64, so the bits that come back go one place and ~by more: 64 - by without arithmetic, whose overflow would be checked for every element."""
    one, other = ("shiftrightunsigned", "shiftleft") if right else ("shiftleft", "shiftrightunsigned")
    return F.call_function(one, x, by).bitwiseOR(F.call_function(other, F.call_function(other, x, F.lit(1)), F.bitwise_not(by)))


def _behind(values: Column, by: int) -> Column:
    """Every element so many places later; zeros stand before. (Cutting off an array's front instead costs several times as much.)"""
    return F.concat(F.array_repeat(F.lit(0).cast("long"), by), values)


def _together(values: Column, n: int, join) -> Column:
    """At every place of an array, join() over its element and the n - 1 before it, in about log n steps: a run of 2 m is two of m.

    The first n - 1 places, whose runs would begin before the array, give anything, as do some that follow the last.
    """
    have: dict[int, Column] = {1: values}

    def grown(size: int, bits: str) -> Column:
        if not bits:
            return have[size]
        double = F.zip_with(have[size], _behind(have[size], size), join)

        def further(d: Column) -> Column:
            have[2 * size] = d
            if bits[0] == "0":
                return grown(2 * size, bits[1:])
            return _let(F.zip_with(d, _behind(values, 2 * size), join), lambda o: (have.update({2 * size + 1: o}), grown(2 * size + 1, bits[1:]))[1])

        return _let(double, further)

    return grown(1, f"{n:b}"[1:])


def _ahead(k: int) -> int:
    """How far rolled() has a gram's sum behind the gram's place: k - 1, rounded up so that the place turns by as much."""
    return -(-(k - 1) // 64) * 64


def rolled(solid: Column, k: int) -> Column:
    """The sum of every k code points, _ahead(k) places behind that of their first. A code point's hash is turned right by its own place before they are
    added (without carry); turned left by the gram's place, a sum is the gram's cyclic polynomial."""
    hashed = F.transform(F.split(solid, ""), lambda c: F.xxhash64(c))  # by itself, as turning looks at it twice
    sums = _let(F.transform(hashed, lambda x, i: _turned(x, i, right=True)), lambda v: _together(v, k, lambda x, y: x.bitwiseXOR(y)))
    return _behind(sums, _ahead(k) - (k - 1))


def _packed(hash_: Column, position: Column) -> Column:
    return hash_.bitwiseOR(F.lit(_MASK).cast("long")).bitwiseXOR(position)


def solid(text: Column) -> Column:
    """A text without its blanks. Plain spaces, which most of them are, go first, without a regular expression."""
    return F.regexp_replace(F.replace(text, F.lit(" "), F.lit("")), r"\s+", "")


def winnowed(text: Column, k: int = K, w: int = W) -> Column:
    """array<struct<hash, position>> of what is kept, in order of position (in code points that are no blanks).

    A text with fewer than k such code points has one hash, of all of them; a text with none has none.
    """
    return _let(solid(text), lambda s: _kept(s, k, w))


def _kept(solid_: Column, k: int, w: int) -> Column:
    n = F.char_length(solid_)

    def chosen(sums: Column) -> Column:
        packed = F.transform(sums, lambda x, i: _packed(_turned(x, i), i))
        first = _ahead(k) + 1
        least = lambda v: F.slice(_together(v, w, lambda a, b: F.least(a, b)) if w > 1 else v, first + w - 1, n - (k + w - 2))
        of_windows = _let(packed, lambda v: F.when(n < k + w - 1, F.array(F.array_min(F.slice(v, first, n - (k - 1))))).otherwise(least(v)))
        at = F.transform(F.array_distinct(of_windows), lambda v: F.bitwise_not(v).bitwiseAND(F.lit(_MASK)).cast("int"))
        return F.transform(at, lambda p: F.struct(_turned(F.get(sums, p), p).alias("hash"), (p - _ahead(k)).alias("position")))

    short = F.when(n == 0, F.array().cast(KEPT)).otherwise(F.array(F.struct(F.xxhash64(solid_).alias("hash"), F.lit(0).alias("position"))))
    return F.when(n < k, short).otherwise(_let(rolled(solid_, k), chosen))


def spliced(kept: Column, next_kept: Column, front: Column, back: Column, k: int = K, w: int = W) -> Column:
    """winnowed() of a text that is the front of one text and the beginning of another, from what those two keep; only the seam is hashed.

    front and back have no blanks. Windows within the front keep what they kept in its text, windows within the back what they kept in the other.
    The windows of either that are cut off at a side may have kept a place beyond: its least hash is the least of those kept within it. Windows across
    the seam are looked at anew; with a short back, so is all of it.
    """
    # Lengths are bound once for the row: within a lambda they would be counted anew for every element.
    return _let(F.char_length(front), lambda m: _let(F.char_length(back), lambda n: _put_together(kept, next_kept, front, back, m, n, k, w)))


def _put_together(kept: Column, next_kept: Column, front: Column, back: Column, m: Column, n: Column, k: int, w: int) -> Column:
    span = k + w - 1  # code points that a window looks at
    begin = F.greatest(m - (span - 1), F.lit(0))
    pack = lambda v: _packed(v["hash"], v["position"])

    def least(near: Column, first: Column, last: Column) -> Column:
        """What the windows that begin from first to last keep, packed; near holds all that they may."""
        return F.transform(F.sequence(first, F.greatest(first, last)), lambda s: F.array_min(F.transform(F.filter(near, lambda v: (v["position"] >= s) & (v["position"] < s + w)), pack)))

    # Positions grow along an array of what is kept: what lies near a place is cut out by number, not looked for in all of it.
    def of_front(p: Column, before: Column) -> Column:
        """What windows that begin before p keep at p or behind."""
        near = F.filter(F.slice(kept, F.greatest(before - w, F.lit(0)) + 1, 2 * w), lambda v: (v["position"] > p - w) & (v["position"] < p + w - 1))
        found = _let(near, lambda n: _let(least(n, F.greatest(p - (w - 1), F.lit(0)), p - 1), lambda l: F.filter(n, lambda v: (v["position"] >= p) & F.array_contains(l, pack(v)))))
        return F.when(p > 0, found).otherwise(F.array().cast(KEPT))

    def of_back(last: Column) -> Column:
        """What the other text's windows that begin up to `last` keep, at its place in the whole."""

        def found(until: Column) -> Column:
            near = F.filter(F.slice(next_kept, F.greatest(F.size(until) - w, F.lit(0)) + 1, 2 * w), lambda v: (v["position"] > last - w) & (v["position"] < last + w))
            beyond = _let(near, lambda x: _let(least(x, F.greatest(last - (w - 2), F.lit(0)), last), lambda l: F.filter(x, lambda v: (v["position"] > last) & F.array_contains(l, pack(v)))))
            return F.concat(until, beyond)

        return F.transform(_let(F.filter(next_kept, lambda v: v["position"] <= last), found), lambda v: F.struct(v["hash"].alias("hash"), (v["position"] + m).alias("position")))

    def put_together(p: Column) -> Column:
        whole_back = (m == 0) | (n < span)
        seam = F.concat(F.substring(front, p + 1, m), F.when(whole_back, back).otherwise(F.substring(back, F.lit(1), F.lit(span - 1))))
        # A seam that is shorter than a window, behind a front that isn't, has nothing across it.
        anew = F.transform(_let(seam, lambda s: F.when((p > 0) & (F.char_length(s) < span), F.array().cast(KEPT)).otherwise(_kept(s, k, w))), lambda v: F.struct(v["hash"].alias("hash"), (v["position"] + p).alias("position")))
        behind = F.when(whole_back, F.array().cast(KEPT)).otherwise(_let(n - span, of_back))

        def merged(before: Column, anew: Column, behind: Column) -> Column:
            at_seam = F.array_sort(F.concat(of_front(p, F.size(before)), anew, F.slice(behind, 1, 2 * w)), lambda a, b: a["position"] - b["position"])
            once = _let(at_seam, lambda x: F.filter(x, lambda v, i: (i == 0) | (F.get(x, i - 1)["position"] != v["position"])))
            return F.concat(before, once, F.slice(behind, 2 * w + 1, F.size(behind)))

        return _let(F.filter(kept, lambda v: v["position"] < p), lambda b: _let(anew, lambda x: _let(behind, lambda y: merged(b, x, y))))

    return _let(begin, lambda p: put_together(p))


def hashes(kept: Column) -> Column:
    return F.array_distinct(kept["hash"])


def positions(kept: Column) -> Column:
    return kept["position"]


def likeness(a: Column, b: Column, both: Column) -> Column:
    """Jaccard similarity of two arrays of distinct hashes that have so many in common; 1 if both are empty."""
    return F.when(F.size(a) + F.size(b) == 0, F.lit(1.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def digest(kept: Column) -> Column:
    """A text's fingerprint as one word of 128 bits: of the kept hashes and their positions."""
    return F.lower(F.concat(*[F.lpad(F.hex(F.xxhash64(F.lit(seed), kept)), 16, "0") for seed in (1, 2)]))


def fingerprints(df: DataFrame) -> DataFrame:
    """doc_id, hashes, positions of each row: the general form. Null and blank texts keep nothing."""
    out = common.texts(df).withColumn("kept", winnowed(F.col("text")))
    return out.select("doc_id", F.col("kept")["hash"].alias("hashes"), positions(F.col("kept")).alias("positions"))


def _with_next(docs: DataFrame) -> tuple[DataFrame, Window]:
    """docs (doc_id, text) and, at the end of each bucket, the row that follows it in another one (`extra`); the window in which lead() is the next.

    Order: descending doc_id, null last, equal ids by text. Buckets are ranges of doc_id; the first row of all follows the last.
    """
    spark = docs.sparkSession
    n = 2 * common.shuffle_partitions(spark)
    at = docs.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 100 * n).alias("at")).first()["at"]
    bounds = sorted(set(at or []))  # n - 1 numbers at most
    above = F.size(F.filter(F.array(*map(F.lit, bounds)).cast("array<bigint>"), lambda b: b >= F.col("doc_id")))
    placed = docs.select("doc_id", "text", F.coalesce(above, F.lit(len(bounds) + 1)).alias("bucket"))
    place = F.struct(F.col("doc_id").isNull().alias("last"), F.bitwise_not("doc_id").alias("down"), F.col("text").alias("text"))
    heads = placed.groupBy("bucket").agg(F.min(place).alias("place"))  # a row per bucket
    heads = common.stored(heads, common.shared_folder(spark), "heads")
    order = [r["bucket"] for r in heads.select("bucket").orderBy("bucket").collect()]
    before = {b: order[i - 1] for i, b in enumerate(order)}
    target = F.element_at(F.create_map(*[F.lit(x) for pair in before.items() for x in pair]), F.col("bucket")) if before else F.lit(0)
    extra = heads.select(F.bitwise_not("place.down").alias("doc_id"), F.col("place.text").alias("text"), target.cast("int").alias("bucket"), F.lit(True).alias("extra"))
    rows = placed.withColumn("extra", F.lit(False)).unionByName(extra)
    return rows, Window.partitionBy("bucket").orderBy("extra", F.col("doc_id").isNull(), F.desc("doc_id"), "text")


def edited_fingerprints(df: DataFrame) -> DataFrame:
    """Each row's fingerprint beside that of its edited text and of the next document, and how like they are.

    The edited text: the last floor(n_chars / 2) code points give way to the first as many (or all) of the next document, in descending
    doc_id; after the last comes the first, so a lone row follows itself. Null and empty texts: 0 characters, an empty set,
    likeness 1 to another empty one and 0 to any other. Repeated ids are ordered by text. Columns: doc_id, n_chars,
    edited_sha256, fingerprint, edited_fingerprint (digests of the kept hashes with their positions), near_edited, near_next, n_kept,
    same_until (the last position up to which every kept hash of the text is one of the edited text's, at the same place; -1 if not even the first).
    """
    rows, window = _with_next(common.texts(df))
    # Only texts cross the shuffle: hashes are made behind it, between two windows that share its order.
    rows = rows.withColumn("next", F.lead("text").over(window)).withColumn("kept", winnowed(F.col("text")))
    rows = rows.withColumn("next_kept", F.lead("kept").over(window)).filter(~F.col("extra")).withColumn("h", hashes(F.col("kept")))
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), F.substring(F.col("text"), F.lit(1), n - half).alias("front"), F.substring(F.col("next"), F.lit(1), half).alias("back"), "kept", "h", "next_kept")
    rows = rows.withColumn("_front", solid(F.col("front"))).withColumn("_back", solid(F.col("back")))
    rows = rows.withColumn("edited_kept", spliced(F.col("kept"), F.col("next_kept"), F.col("_front"), F.col("_back")))
    # What is used more than once is a column of its own: an expression would be evaluated wherever it stands.
    rows = rows.withColumns({"edited_h": hashes(F.col("edited_kept")), "next_h": hashes(F.col("next_kept")), "shorter": F.least(F.size("kept"), F.size("edited_kept"))})
    rows = rows.withColumns({"both_edited": F.size(F.array_intersect("h", "edited_h")), "both_next": F.size(F.array_intersect("h", "next_h"))})
    rows = rows.withColumn("differs", F.array_position(F.zip_with(F.slice("kept", 1, F.col("shorter")), F.slice("edited_kept", 1, F.col("shorter")), lambda a, b: a == b), False))
    rows = rows.withColumn("n_alike", F.when(F.col("differs") > 0, F.col("differs") - 1).otherwise(F.col("shorter")).cast("int"))
    return rows.select(
        "doc_id", "n_chars", F.sha2(F.concat("front", "back"), 256).alias("edited_sha256"), digest(F.col("kept")).alias("fingerprint"), digest(F.col("edited_kept")).alias("edited_fingerprint"), likeness(F.col("h"), F.col("edited_h"), F.col("both_edited")).alias("near_edited"),
        likeness(F.col("h"), F.col("next_h"), F.col("both_next")).alias("near_next"), F.size("h").cast("long").alias("n_kept"), F.when(F.col("n_alike") > 0, F.element_at("kept", F.col("n_alike"))["position"]).otherwise(-1).cast("long").alias("same_until"))
