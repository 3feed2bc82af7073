"""Words and word shingles of texts as 64-bit hashes, equal on every machine: whole batches at a time, in numpy.

A word is a run of anything but blanks (20, 09 to 0D), with A-Z in lower case. Its hash is a polynomial in its bytes,
taken from running sums over the batch's bytes, then scrambled.
"""

from __future__ import annotations

from functools import lru_cache

_SEED, _BASE = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
#: Bytes that are hashed at once; a longer word is hashed in one go.
SPAN = 1 << 18


def mixed(x):
    """A bijective scrambling of 64-bit values."""
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def _tables():
    """A value for each byte, alike for a letter's two cases; which bytes are blanks."""
    import numpy as np

    value = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_SEED))
    value[ord("A") : ord("Z") + 1] = value[ord("a") : ord("z") + 1]
    blank = np.zeros(256, bool)
    blank[[0x20, *range(0x09, 0x0E)]] = True
    return value, blank


@lru_cache(maxsize=2)
def _powers(n: int):
    """The first n powers of the base and of its inverse modulo 2^64."""
    import numpy as np

    def of(base):
        out = np.full(n, np.uint64(base % (1 << 64)))
        out[:1] = 1
        return np.multiply.accumulate(out)

    return of(_BASE), of(pow(_BASE, -1, 1 << 64))


def _span_hashes(code):
    """Hash, and place of the first byte, of each word in an array of bytes."""
    import numpy as np

    value, blank = _tables()
    solid = np.zeros(len(code) + 2, np.int8)
    solid[1:-1] = ~blank[code]
    turn = np.diff(solid)
    begin, end = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
    power, inverse = _powers(max(SPAN, 1 << (len(code) - 1).bit_length()) if len(code) else SPAN)
    sums = np.zeros(len(code) + 1, np.uint64)
    np.cumsum(value[code] * power[: len(code)], out=sums[1:])
    return mixed((sums[end] - sums[begin]) * inverse[begin] + (end - begin).astype(np.uint64)), begin


def word_hashes(texts: list[str]):
    """The hashes of all words of the texts, text after text, and how many words each text has."""
    import numpy as np

    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    size = np.array([len(r) + 1 for r in raw], np.int64)
    data = np.frombuffer(b" ".join([*raw, b""]), np.uint8)
    _, blank = _tables()
    hashes, at, lo = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], 0
    while lo < len(data):
        hi = min(lo + SPAN, len(data))
        if hi < len(data):  # ends at a blank
            back = np.flatnonzero(blank[data[lo:hi]])
            while not len(back):
                lo_, hi = hi, min(hi + SPAN, len(data))
                back = np.flatnonzero(blank[data[lo_:hi]]) + (lo_ - lo)
            hi = lo + int(back[-1]) + 1
        h, begin = _span_hashes(data[lo:hi])
        hashes.append(h)
        at.append(begin + lo)
        lo = hi
    edge = np.searchsorted(np.concatenate(at), np.r_[0, np.cumsum(size)])
    return np.concatenate(hashes), np.diff(edge)


def joined(h, k: int):
    """Hashes of all runs of k of the word hashes h."""
    import numpy as np

    n = max(0, len(h) - k + 1)
    out = h[:n].copy()
    for j in range(1, k):
        out *= np.uint64(_SEED)
        out += h[j : j + n]
    return mixed(out)


def shingle_sets(texts: list[str], k: int):
    """The sorted distinct shingle hashes of every text, one after the other, and where each text's begin (one more at the end).

    A shingle has k words; a text with fewer words has its whole sequence as one, a text without words none.
    """
    import numpy as np

    h, n = word_hashes(texts)
    first = np.cumsum(n) - n
    m = np.where(n >= k, n - k + 1, (n > 0).astype(np.int64))
    edge = np.r_[0, np.cumsum(m)]
    flat = np.zeros(int(edge[-1]), np.uint64)
    whole = np.repeat(n >= k, m)
    at = np.repeat(first - edge[:-1], m) + np.arange(len(flat))
    flat[whole] = joined(h, k)[at[whole]]
    for i in np.flatnonzero((n > 0) & (n < k)).tolist():
        flat[edge[i]] = mixed(joined(h[first[i] : first[i] + n[i]], int(n[i])) + n[i : i + 1].astype(np.uint64))[0]
    bounds = edge.tolist()
    for a, z in zip(bounds[:-1], bounds[1:], strict=True):
        flat[a:z].sort()
    new = np.ones(len(flat), bool)
    new[1:] = flat[1:] != flat[:-1]
    new[edge[:-1][m > 0]] = True
    return flat[new], np.r_[0, np.cumsum(new)][edge]
