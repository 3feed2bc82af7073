"""Many phrases in a text at once: one automaton over all of them, built once a task, reads each text once."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


class Finder:
    """All places of some phrases, by Aho-Corasick. The places of one phrase don't overlap; those of different ones may."""

    def __init__(self, phrases: Iterable[str]):
        import ahocorasick

        self.phrases = sorted({p for p in phrases if p})
        self.automaton = ahocorasick.Automaton()
        for k, p in enumerate(self.phrases):
            self.automaton.add_word(p, (k, len(p)))
        if self.phrases:
            self.automaton.make_automaton()

    def places(self, text: str) -> list[tuple[int, int]]:
        """(number of the phrase, start), in the order in which they end."""
        if not self.phrases or not text:
            return []
        out, reached = [], {}
        for end, (k, size) in self.automaton.iter(text):
            start = end - size + 1
            if start >= reached.get(k, 0):
                reached[k] = end + 1
                out.append((k, start))
        return out


def places(text: Column, language: Column, phrases: dict[str, Iterable[str]], fold: bool = False) -> Column:
    """array<struct<phrase, start>> of the phrases of a row's language in its text, by start; places are code points of the text as given.

    fold: A to Z of the text are read as a to z.
    """
    known = {lang: sorted(set(some)) for lang, some in phrases.items()}

    @F.arrow_udf("array<struct<phrase:string,start:int>>")
    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        finders = {lang: Finder(some) for lang, some in known.items()}
        kind = pa.list_(pa.struct([("phrase", pa.string()), ("start", pa.int32())]))
        for texts, languages in batches:
            rows = [sorted((at, f.phrases[k]) for k, at in f.places(t.encode().lower().decode() if fold else t)) if t and (f := finders.get(lang)) else [] for t, lang in zip(texts.to_pylist(), languages.to_pylist(), strict=True)]
            yield pa.array([[{"phrase": p, "start": at} for at, p in row] for row in rows], kind)

    return run(text, language)


def members(lists: dict[str, dict[str, Iterable[str]]]) -> dict[str, tuple[Finder, list[tuple[int, ...]]]]:
    """language to its finder and, for each of its phrases, the numbers of the lists that have it. lists: name to language to phrases."""
    out = {}
    for lang in next(iter(lists.values())):
        mine = [{*some[lang]} for some in lists.values()]
        f = Finder(set().union(*mine))
        out[lang] = f, [tuple(j for j, some in enumerate(mine) if p in some) for p in f.phrases]
    return out


def counted(text: str, of: tuple[Finder, list[tuple[int, ...]]] | None, n: int) -> list[int]:
    """How often the phrases of each of n lists, as members() gives them, stand in a text."""
    out = [0] * n
    for k, _ in of[0].places(text) if of else ():
        for j in of[1][k]:
            out[j] += 1
    return out


def counts(text: Column, language: Column, lists: dict[str, dict[str, Iterable[str]]]) -> Column:
    """struct of counts, one of each named list: how often the phrases of a row's language stand in its text. lists: name to language to phrases."""
    names = list(lists)

    @F.arrow_udf("struct<" + ",".join(f"{n}:int" for n in names) + ">")
    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        known = members(lists)
        for texts, languages in batches:
            rows = [counted(t or "", known.get(lang), len(names)) for t, lang in zip(texts.to_pylist(), languages.to_pylist(), strict=True)]
            yield pa.StructArray.from_arrays([pa.array([r[j] for r in rows], pa.int32()) for j in range(len(names))], names)

    return run(text, language)
