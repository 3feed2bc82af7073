"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

Texts are compared as lower-case letters and digits with single spaces between. A document holds an item if a
window of the item (WINDOW characters, or all of a shorter one) aligns with a place in the document within
PERCENT % edits. A window of w characters with e edits keeps at least w + 1 - q (e + 1) of its q-grams, and the
diagonals of those differ by e at most. So shared q-grams are counted in overlapping bands of diagonals; regions
that reach the bound are kept and aligned, in a band of the same width.

Items so short that no q-gram of Q need be left are counted by shorter q-grams (SHORT_Q). Items of fewer than SHORT_Q
characters bear no edit, so no filter is needed: their words are looked up as they are, by Aho-Corasick, and must be
whole words of the text.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

Q, SHORT_Q, WINDOW, PERCENT = 10, 5, 120, 8
#: Characters of benchmark that are broadcast at once; a larger benchmark takes several passes, each over a table that the one before has written.
BLOCK_CHARS = 2_000_000
FOUND = "array<struct<item_id:bigint,start:int,end:int,edits:int>>"


@lru_cache(maxsize=1)
def _tables():
    import numpy as np

    letters, lower = np.zeros(0x110000, bool), np.arange(0x110000, dtype=np.uint32)
    for c in range(0x20000):
        ch = chr(c)
        letters[c] = ch.isalnum()
        if len(small := ch.lower()) == 1:
            lower[c] = ord(small)
    letters[0x20000:0x32000] = True
    return letters, lower


def plain(text: str):
    """Code points of the text's letters and digits in lower case, single spaces between, and where each stood."""
    import numpy as np

    letters, lower = _tables()
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = letters[code]
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]
    at = np.flatnonzero(keep)
    return np.where(is_letter, lower[code], np.uint32(32))[at], at


def grams(code, q: int):
    """Hash of the q-gram at each place."""
    import numpy as np

    n = len(code) - q + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    base, out, done, part, size = 0x9E3779B97F4A7C15, None, 0, code.astype(np.uint64), 1
    while q:
        if q & 1:
            out, done = (part, size) if out is None else (out[: len(part) - done] * np.uint64(pow(base, size, 1 << 64)) + part[done:], done + size)
        q >>= 1
        if q:
            part, size = part[:-size] * np.uint64(pow(base, size, 1 << 64)) + part[size:], 2 * size
    out = out[:n]
    return (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


@dataclass
class Index:
    """The q-grams of some items."""

    q: int
    ids: list
    codes: list
    gram: object  # sorted distinct hashes
    first: object  # where each one's postings begin
    item: object
    place: object
    small: object  # a bit for the top 22 bits of each hash
    window: object  # of each item: length, edits, shared q-grams at least
    edits: object
    least: object


def budget(n: int) -> tuple[int, int]:
    """Length and edits of the window of an item of n characters."""
    w = min(n, WINDOW)
    return w, w * PERCENT // 100


@dataclass
class Block:
    """A block of the benchmark: items by length of their q-grams, and the shortest ones as an automaton."""

    parts: list
    words: object


def index(items: list[tuple[int, str]]) -> Block:
    import ahocorasick

    kept = [(i, c[:-1] if c[-1] == 32 else c) for i, t in items if len(c := plain(t or "")[0])]
    chosen: dict[int, list] = {Q: [], SHORT_Q: []}
    words = ahocorasick.Automaton()
    for i, c in kept:
        w, e = budget(len(c))
        if len(c) < SHORT_Q:
            spaced = " " + c.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass") + " "
            words.add_word(spaced, (len(c), (*words.get(spaced, (0, ()))[1], i)))
        else:
            chosen[Q if w + 1 > Q * (e + 1) else SHORT_Q].append((i, c))
    words.make_automaton()
    return Block([_grams_of(found, q) for q, found in chosen.items() if found], words if len(words) else None)


def _grams_of(kept: list, q: int) -> Index:
    import numpy as np

    codes = [c for _, c in kept]
    all_grams = [grams(c, q) for c in codes]
    flat = np.concatenate([*all_grams, np.empty(0, np.uint64)])
    item = np.repeat(np.arange(len(codes)), [len(g) for g in all_grams])
    place = np.concatenate([*(np.arange(len(g)) for g in all_grams), np.empty(0, np.int64)]).astype(np.int64)
    by = np.argsort(flat, kind="stable")
    gram, first = np.unique(flat[by], return_index=True)
    small = np.zeros(1 << 22, bool)
    small[(gram >> np.uint64(42)).astype(np.int64)] = True
    window, edits = np.array([budget(len(c)) for c in codes], np.int64).T
    return Index(q, [i for i, _ in kept], codes, gram, np.append(first, len(flat)), item[by], place[by], small, window, edits, window + 1 - q * (edits + 1))


def regions(code, x: Index):
    """(item, band's first diagonal, its q-grams' places in the document, and in the item) for each band that reaches the bound."""
    import numpy as np

    g = grams(code, x.q)
    at = np.flatnonzero(x.small[(g >> np.uint64(42)).astype(np.int64)])
    if not len(at):
        return
    k = np.minimum(np.searchsorted(x.gram, g[at]), len(x.gram) - 1)
    same = x.gram[k] == g[at]
    at, k = at[same], k[same]
    least, span = int(x.least.min()), int((x.window + x.edits).max()) - x.q
    if len(at) < least:
        return
    dense = np.zeros(len(at), bool)  # places with enough shared q-grams near them, of whatever item
    near = np.flatnonzero(at[least - 1 :] - at[: len(at) - least + 1] <= span)
    if not len(near):
        return
    mark = np.zeros(len(at) + 1, np.int64)
    np.add.at(mark, near, 1)
    np.add.at(mark, near + least, -1)
    dense = np.cumsum(mark[:-1]) > 0
    at, k = at[dense], k[dense]
    n = x.first[k + 1] - x.first[k]
    doc = np.repeat(at, n)
    post = np.repeat(x.first[k] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
    item, place = x.item[post], x.place[post]
    # A band is 2 (e + 1) diagonals wide and they overlap by half: any e + 1 diagonals lie in one.
    width = x.edits[item] + 1
    low = (doc - place) // width
    item, doc, place, band = np.concatenate([item, item]), np.concatenate([doc, doc]), np.concatenate([place, place]), np.concatenate([low, low - 1])
    by = np.lexsort((place, doc, band, item))
    item, doc, place, band = item[by], doc[by], place[by], band[by]
    edge = np.flatnonzero(np.r_[True, (item[1:] != item[:-1]) | (band[1:] != band[:-1])])
    for lo, hi in zip(edge, np.r_[edge[1:], len(item)], strict=True):
        need = int(x.least[item[lo]])
        if hi - lo < need:
            continue
        d, p, i = doc[lo:hi], place[lo:hi], int(item[lo])
        if len(new := np.flatnonzero(np.r_[True, d[1:] != d[:-1]])) < need:
            continue
        each = d[new]
        if (each[need - 1 :] - each[: len(each) - need + 1] <= x.window[i] + x.edits[i] - x.q).any():
            yield i, int(band[lo] * (x.edits[i] + 1)), d, p


def aligned(code, item_code, diagonal: int, edits: int, window: int, starts):
    """(edits, start, end) in the document of the best alignment of a window of the item beginning at one of `starts`.

    Row by row of the window, for all starts at once, over a band of diagonals; the place in the document is free at both ends.
    """
    import numpy as np

    band = 4 * (edits + 1) + 1  # the band of q-grams and e diagonals on each side
    starts = np.asarray(starts, np.int64)
    first = starts + diagonal - (edits + 1)
    reach = first[:, None] + np.arange(band)[None, :]
    cost = np.where((reach >= 0) & (reach <= len(code)), 0, window + 1).astype(np.int32)
    origin = reach.copy()
    padded = np.r_[code, np.uint32(0)]
    inside = len(code)
    cols = np.arange(band)
    rows = np.arange(len(starts))[:, None]
    for step in range(window):
        place = reach + step  # the document's character that the diagonal step takes
        fits = (place >= 0) & (place < inside)
        letter = padded[np.where(fits, place, inside)]
        straight = np.where(fits, cost + (letter != item_code[starts + step][:, None]), window + 1)
        skip = np.full_like(cost, window + 1)
        skip[:, :-1] = cost[:, 1:] + 1  # the item's character is missing in the document
        new = np.minimum(straight, skip)
        from_ = np.where(straight <= skip, origin, np.c_[origin[:, 1:], origin[:, -1:]])
        run = new - cols  # characters that only the document has
        best = np.minimum.accumulate(run, axis=1)
        source = np.maximum.accumulate(np.where(run == best, cols, 0), axis=1)
        cost, origin = best + cols, from_[rows, source]
    at = np.unravel_index(np.argmin(cost), cost.shape)
    return int(cost[at]), int(origin[at]), int(first[at[0]] + at[1] + window)


def verbatim(d, p, n: int):
    """Where n q-grams follow each other on one diagonal, in the document, or None."""
    import numpy as np

    if len(d) < n:
        return None
    by = np.lexsort((p, d - p))
    d, p = d[by], p[by]
    full = np.flatnonzero((d[n - 1 :] - d[: len(d) - n + 1] == n - 1) & (p[n - 1 :] - p[: len(p) - n + 1] == n - 1))
    return int(d[full[0]]) if len(full) else None


def matches(text: str, block: Block) -> list[tuple[int, int, int, int]]:
    """(item_id, start, end, edits): for each item that the text holds, its best place, in code points of the text."""
    code, where = plain(text)
    best: dict[int, tuple[int, int, int]] = {}
    for x in block.parts:
        for i, found in _in(code, x).items():
            best[x.ids[i]] = min(found, best.get(x.ids[i], found))
    if block.words is not None:
        line = " " + code.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").rstrip(" ") + " "
        for end, (size, ids) in block.words.iter(line):
            for i in ids:
                best.setdefault(i, (0, end - 1 - size, end - 1))
    out = []
    for i, (cost, a, z) in sorted(best.items()):
        a, z = max(a, 0), min(max(z, a + 1), len(code))
        out.append((i, int(where[a]), int(where[z - 1]) + 1, cost))
    return out


def _in(code, x: Index) -> dict[int, tuple[int, int, int]]:
    """Edits, start and end of the best place of each item, by its number in x."""
    import numpy as np

    best: dict[int, tuple[int, int, int]] = {}
    for i, low, d, p in regions(code, x):
        if i in best and best[i][0] == 0:
            continue
        w, e, item_code = int(x.window[i]), int(x.edits[i]), x.codes[i]
        if (same := verbatim(d, p, w - x.q + 1)) is not None:
            best[i] = 0, same, same + w
            continue
        held = np.zeros(len(item_code) + 1, np.int64)  # windows of the item with too few of its q-grams can't match
        held[np.unique(p) + 1] = 1
        held = np.cumsum(held)
        starts = np.arange(len(item_code) - w + 1)
        starts = starts[held[np.minimum(starts + w - x.q + 1, len(item_code))] - held[starts] >= x.least[i]]
        for part in range(0, len(starts), 256):
            cost, a, z = aligned(code, item_code, low, e, w, starts[part : part + 256])
            if cost <= e and (i not in best or cost < best[i][0]):
                best[i] = cost, a, z
    return best


def find(df: DataFrame, benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """df with a column `found`: for each benchmark item (item_id, text) that the row's text holds, where and with how many edits.

    Null and empty texts hold nothing, and null, empty or letterless items are in nothing; an item of fewer than SHORT_Q letters and digits is held
    where it stands as whole words. The benchmark is collected in blocks of bounded size, one pass over df each (with several, df is written between
    them, so that a worker holds one block's index at a time); df is not shuffled, and rows keep their columns (but `found` itself is replaced).
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).dropna()
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-chars // block_chars) or 1
    folder = common.shared_folder(df.sparkSession) if blocks > 1 else ""
    common.modest_batches(df.sparkSession)
    out = df.withColumn("found", F.array().cast(FOUND))
    for b in range(blocks):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).distinct().orderBy("item_id", "text").collect()
        shared = df.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, [tuple(r) for r in rows]))
        held = _held(shared)
        out = out.withColumn("found", F.concat("found", held(F.coalesce(F.col("text").cast("string"), F.lit("")))))
        if blocks > 1:
            out = common.stored(out, folder, f"block-{b}")
    return out


def _held(shared):
    @F.arrow_udf(FOUND)
    def held(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([("item_id", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("edits", pa.int32())]))
        for texts in batches:
            x = _index(shared)
            yield pa.array([[{"item_id": i, "start": s, "end": e, "edits": n} for i, s, e, n in matches(t, x)] for t in texts.to_pylist()], kind)

    return held


_built: dict[str, Block] = {}


def _index(shared) -> Block:
    """The index of a broadcast block, built once per worker, which holds one at a time."""
    key, items = shared.value
    if key not in _built:
        _built.clear()
        _built[key] = index(items)
    return _built[key]


def contaminated(df: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, start, end (code points), edits: a row for each item that a document holds, and no other rows."""
    rows = find(common.texts(df), benchmark).select("doc_id", F.explode("found").alias("m"))
    return rows.select("doc_id", "m.item_id", "m.start", "m.end", "m.edits")


def without_benchmark(df: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of df, all columns, that hold no benchmark item."""
    return find(df, benchmark).filter(F.size("found") == 0).select(df.columns)
