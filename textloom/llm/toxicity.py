"""Toxicity by a weighted lexicon, matched by Aho-Corasick on folded text and normalised by length.

Folding undoes disguises: compatibility forms, case, look-alike letters of other scripts, and digits or signs
that stand for letters. The lexicon (whole words with weights) is learned from labelled rows;
exception phrases switch off matches inside them. A logistic curve over the normalised weight gives the score.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Letters of other scripts that look like Latin ones, and digits and signs used for letters.
LOOKALIKES = {"а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "і": "i", "ѕ": "s", "ј": "j", "ԁ": "d", "һ": "h", "ӏ": "l", "к": "k", "м": "m", "т": "t", "в": "b", "α": "a", "ο": "o", "ρ": "p", "ν": "v", "ι": "i", "κ": "k", "τ": "t", "υ": "u", "ı": "i", "ɑ": "a", "ɡ": "g"}
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "l"}
#: Phrases in which an otherwise abusive word is harmless.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "class clown", "clown fish", "sore loser", "idiot proof")

#: Rows of the sample that is learned from. Only this bounds the learning.
SAMPLE_ROWS = 20_000
#: The share of entries that may stand in the lexicon by chance; the share of toxic rows among those with an entry. Entries are whole words:
#: beginnings of words would also match harmless ones ('path' of 'pathetic'), and found no toxic text more on held-out rows.
FALSE_SHARE, LEAST_PRECISION = 0.05, 0.7

_FOLD = str.maketrans(LOOKALIKES)
_UNLEET = str.maketrans(SUBSTITUTES)
_WORD = re.compile(r"[^\W_]+")
_DISGUISED = re.compile(r"(?=[0-9@$!|]*[^\W\d_])[^\W_@$!|]*(?:[0-9]|[@$!|](?=[^\W_]))(?:[^\W_]|[@$!|](?=[^\W_]))*")  # a sign at a word's end is none of it


def folded(text: str) -> str:
    """The words of a text, undisguised, with a space on either side of each."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text).casefold().translate(_FOLD)
    else:
        text = text.lower()
    text = _DISGUISED.sub(lambda m: m[0].translate(_UNLEET), text)
    return " " + " ".join(_WORD.findall(text)) + " "


def features(text: str) -> set[str]:
    return {f" {w} " for w in folded(text).split()}


@dataclass(frozen=True)
class Model:
    """lexicon: (" word ", weight); the score is logistic in slope * normalised weight + bias."""

    lexicon: tuple[tuple[str, float], ...]
    slope: float
    bias: float
    exceptions: tuple[str, ...] = EXCEPTIONS


class Matcher:
    """The automata of a model, built once per task."""

    def __init__(self, model: Model):
        self.model = model
        self.lexicon = self._automaton(model.lexicon)
        self.exceptions = self._automaton([(f" {p} ", 0.0) for p in model.exceptions])

    @staticmethod
    def _automaton(entries):
        import ahocorasick

        found = ahocorasick.Automaton()
        for phrase, weight in entries:
            found.add_word(phrase, (len(phrase), weight))
        found.make_automaton()
        return found if len(found) else None

    def __call__(self, text: str) -> tuple[float, int, int]:
        """Sum of weights of the matched words (each once, by its heaviest entry), how many they are, and how many words there are."""
        line = folded(text)
        n_words = line.count(" ") - 1 if len(line) > 2 else 0
        at: dict[int, float] = {}
        if self.lexicon and n_words:
            for end, (size, weight) in self.lexicon.iter(line):
                start = end - size + 1
                at[start] = max(weight, at.get(start, 0.0))
        if at and self.exceptions:
            for end, (size, _) in self.exceptions.iter(line):
                for start in [s for s in at if end - size + 1 <= s < end]:
                    del at[start]
        return sum(at.values()), len(at), n_words

    def score(self, total: float, n_words: int) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.model.slope * strength(total, n_words) + self.model.bias))))


def strength(total: float, n_words: int) -> float:
    """Normalised by length: an insult weighs less in a long text, but slowly, since it does not go away there."""
    return total / (1.0 + math.log1p(n_words / 200.0))


def weight(n: int, clean: int, n_toxic: int, n_clean: int) -> float:
    """Log of how much likelier a feature is in toxic rows, from counts with half a row added to each."""
    return round(math.log((n + 0.5) / (n_toxic + 1)) - math.log((clean + 0.5) / (n_clean + 1)), 6)


def chance(n: int, clean: int, n_toxic: int, n_clean: int) -> float:
    """How likely a feature of n toxic and `clean` clean rows is so unevenly spread by chance: likelihood ratio test. 1 if it isn't commoner in toxic rows."""
    if n * n_clean <= clean * n_toxic:
        return 1.0
    total, found = n_toxic + n_clean, n + clean
    cells = ((n, found, n_toxic), (clean, found, n_clean), (n_toxic - n, total - found, n_toxic), (n_clean - clean, total - found, n_clean))
    ratio = 2 * sum(x * math.log(x * total / (row * column)) for x, row, column in cells if x)
    return math.erfc(math.sqrt(max(0.0, ratio) / 2))


def accepted(chances: list[tuple[float, int]], tests: int | None = None) -> float:
    """The greatest chance at which FALSE_SHARE of the accepted at most are expected to be accidents (Benjamini and Hochberg), of (chance, how many) out of `tests`."""
    limit, k = -1.0, 0
    tests = sum(many for _, many in chances) if tests is None else tests
    for p, many in sorted(chances):
        k += many
        if p * tests <= FALSE_SHARE * k:
            limit = p
    return limit


def learn(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """The lexicon and curve from labelled rows (doc_id, toxic), a sample of at most sample_rows rows by hash of doc_id.

    docs: (doc_id, text). Equal texts count once. A feature enters if it is commoner in toxic rows than chance allows (accepted()) and
    most rows that have it (LEAST_PRECISION) are toxic. Without toxic or clean rows the model matches nothing and says 0.
    """
    # The sample is bounded, so it may be broadcast, and so may what is counted in it.
    sample = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).dropna().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    rows = docs.join(F.broadcast(sample), "doc_id").groupBy(F.xxhash64("text").alias("same"), F.length("text")).agg(F.first("text").alias("text"), F.max("toxic").alias("toxic"))
    folder = common.shared_folder(docs.sparkSession)
    rows = common.stored(rows.select("text", "toxic"), folder, "labelled")
    sizes = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    if not n_toxic or not n_clean:
        return Model((), 1.0, -10.0)

    def count(only):
        def run(batches):
            for b in batches:
                n = Counter()
                for t in b["text"]:
                    n.update(features(t) if only is None else features(t) & only)
                if n:
                    yield pd.DataFrame({"feature": list(n.keys()), "n": list(n.values())})

        return run

    def counted(which, only=None):
        return rows.filter(F.col("toxic") == which).select("text").mapInPandas(count(only), "feature string, n long").groupBy("feature").agg(F.sum("n").alias("n"))

    toxic_counts = common.stored(counted(1), folder, "toxic-features")
    by_rows = {r["n"]: r["count"] for r in toxic_counts.groupBy("n").count().collect()}
    # A feature of so many toxic rows has this chance at best, with no clean row: fewer rows can't pass, whatever clean rows say.
    chances = [(chance(n, 0, n_toxic, n_clean), many) for n, many in by_rows.items()]
    limit, tests = accepted(chances), sum(by_rows.values())
    toxic = {r["feature"]: r["n"] for r in toxic_counts.filter(F.col("n").isin([n for n in by_rows if chance(n, 0, n_toxic, n_clean) <= limit])).collect()}
    clean = {r["feature"]: r["n"] for r in counted(0, frozenset(toxic)).collect()} if toxic else {}
    p = {f: chance(n, clean.get(f, 0), n_toxic, n_clean) for f, n in toxic.items()}
    limit = accepted([(x, 1) for x in p.values()], tests)
    lexicon = tuple(sorted((f, weight(n, clean.get(f, 0), n_toxic, n_clean)) for f, n in toxic.items() if p[f] <= limit and n >= LEAST_PRECISION * (n + clean.get(f, 0))))
    draft = Model(lexicon, 1.0, 0.0)

    def place(batches):
        match = Matcher(draft)
        for b in batches:
            yield pd.DataFrame({"x": [strength(w, n) for w, _, n in map(match, b["text"])], "toxic": b["toxic"]})

    points = rows.mapInPandas(place, "x double, toxic int").toPandas()  # two numbers for each row of the bounded sample
    return Model(lexicon, *_logistic(points["x"].to_numpy(), points["toxic"].to_numpy()))


def _logistic(x, y, ridge: float = 1e-3) -> tuple[float, float]:
    """Slope and bias by Newton's method, with a slight pull towards zero so that separable rows stay finite."""
    import numpy as np

    order = np.lexsort((y, x))
    a, beta = np.stack([x, np.ones_like(x)], 1)[order], np.zeros(2)
    y = y[order]
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + len(y) * ridge * np.eye(2) * [[1, 0], [0, 1e-3]] + 1e-9 * np.eye(2), a.T @ (y - p) - len(y) * ridge * beta * [1, 1e-3])
        beta += step
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0]), float(beta[1])


def toxicity(df: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (0 to 1), predicted (1 if score >= 0.5), n_hits, n_words of each row of df.

    Null and empty texts have no words and get the curve's value at 0. Repeated rows stay; other columns are ignored.
    The whole text is read; no shuffle.
    """

    def make():
        match = Matcher(model)

        def score(texts):
            found = [match(t) for t in texts]
            return [match.score(w, n) for w, _, n in found], [h for _, h, _ in found], [n for _, _, n in found]

        return score

    out = common.per_text(common.texts(df), {"score": "double", "n_hits": "long", "n_words": "long"}, make)
    return out.select("doc_id", "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), "n_hits", "n_words")


def held_out(doc_id: str = "doc_id"):
    """True for the fifth of the rows whose labels are never learned from."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def learned(df: DataFrame, labels: DataFrame) -> Model:
    return learn(common.texts(df), labels.filter(~held_out()))


def without_toxic(df: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of df, all columns, whose text isn't predicted to be toxic. The verdict is on the text, row by row."""
    model = learned(df, labels)

    common.modest_batches(df.sparkSession)
    @F.arrow_udf("boolean")
    def bad(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        match = Matcher(model)
        for texts in batches:
            yield pa.array([match.score(w, n) >= 0.5 for w, _, n in map(match, texts.to_pylist())], pa.bool_())

    return df.filter(~bad(F.coalesce(F.col("text").cast("string"), F.lit(""))))
