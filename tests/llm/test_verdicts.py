"""License notices with words put in, taken out and cut, against brute force; toxicity on harmless sentences and held-out labels; near duplicates under one id; long pieces."""

import math
import random
import re

import pytest

from textloom.llm import common

HARMLESS = ["the path through the forest leads home", "an idiom of the language", "we lose the game", "it is worth a look", "a loose tooth and a wort plant", "she moved the stupa", "the cloud over the trast", "scumble the paint", "a clove and a closet"]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_harmless_sentences_and_held_out_labels(spark, sf):
    from textloom.llm.toxicity import Matcher, held_out, learned, toxicity

    docs, labels = (spark.read.parquet(f"/root/testdata/{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = learned(docs, labels)
    match = Matcher(model)
    assert [t for t in HARMLESS if match.score(*match(t)[::2]) >= 0.5] == []
    if sf == "sf0.1":
        rows = toxicity(docs.join(labels.filter(held_out()).select("doc_id"), "doc_id"), model).join(labels, "doc_id").groupBy("toxic", "predicted").count().collect()
        n = {(r["toxic"], r["predicted"]): r["count"] for r in rows}
        assert n[1, 1] / (n[1, 1] + n.get((1, 0), 0)) >= 0.9 and n[1, 1] / (n[1, 1] + n.get((0, 1), 0)) >= 0.95


def test_texts_under_one_id_all_stay(spark):
    from textloom.llm.jaccard_join import one_of_each

    long = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(1, long), (2, long + " more"), (2, "some text that is quite another one, which no other row has"), (2, "some text that is quite another one, which no other row has"), (2, "and a third one that stands under the same id as the others do"), (3, long)]
    left = sorted(tuple(r) for r in one_of_each(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80).collect())
    assert {r for r in left if r[0] == 1} == {(1, long)} and not any(r[0] == 3 for r in left)
    assert len(left) == len(set(left)) and {t for i, t in left if i == 2} <= {t for i, t in rows if i == 2}


def test_long_pieces_are_counted_as_the_library_does():
    from tokenizers import Tokenizer

    from textloom.llm.bytelevel import MergeCounter

    path = common.tokenizer_path("byte_bpe_50k.json")
    lib, counter, rng = Tokenizer.from_file(path), MergeCounter(path), random.Random(1)
    for n in (1, 2, 4095, 4096, 30_000):
        word = "".join(rng.choice("abcdefghilmnorstu") for _ in range(n))
        assert counter.piece(word) == len(lib.encode(word, add_special_tokens=False).ids)


def licenses_by_hand(texts):
    """labels and score of each text: every place of every key phrase, its template aligned within the band."""
    from textloom.llm import license_scan as ls

    words = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)) for t in texts]
    idf = {w: math.log((len(texts) + 1) / (sum(w in x for x in map(set, words)) + 1)) + 1 for _, own, *_ in ls.templates() for w in own}
    out = []
    for x in words:
        labels, score = set(), 0.0
        for label, own, key_at, key, base in ls.templates():
            for i in [i for i in range(len(x) - len(key) + 1) if x[i : i + len(key)] == key]:
                at = i - key_at
                same = lambda k, d: 0 <= k < len(own) and 0 <= at + k + d < len(x) and x[at + k + d] == own[k]  # noqa: B023, E731
                there = [at + k >= 0 and any(same(k, d) and (same(k + 1, d) or same(k - 1, d)) for d in range(-ls.BAND, ls.BAND + 1)) for k in range(len(own))]
                coverage = sum(idf[w] for w, on in zip(own, there, strict=True) if on) / sum(idf[w] for k, w in enumerate(own) if at + k >= 0)
                if base or coverage >= ls.LEAST_COVERAGE:
                    labels.add(label)
                    score = max(score, coverage)
        out.append((",".join(sorted(labels)), score))
    return out


def test_notices_with_words_put_in_taken_out_and_cut(spark):
    from textloom.llm.license_scan import NOTICES, license_scan

    rng = random.Random(7)
    texts, wanted = [], []
    for label, text, _ in NOTICES:
        w = text.split()
        middle = len(w) // 2
        for changed in (w, [*w[:middle], "really", *w[middle:]], [*w[: middle - 9], *w[middle - 8 :]], w[: len(w) * 3 // 4], w[len(w) // 4 :]):
            texts.append(" ".join(changed))
            wanted.append(label if changed is w or len(changed) > len(w) else None)
        for _ in range(6):
            v = list(w)
            for _ in range(rng.randint(1, 4)):
                k = rng.randrange(len(v))
                v[k : k + rng.randint(0, 2)] = rng.choice([[], ["word"], ["the"], ["a", "b"]])
            texts.append("some words before " * rng.randint(0, 2) + " ".join(v) + " and behind" * rng.randint(0, 2))
            wanted.append(None)
    texts += ["nothing of it", "", "mit license apache license general public license"]
    wanted += [None] * 3
    got = {r["doc_id"]: r for r in license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, (labels, score) in enumerate(licenses_by_hand(texts)):
        assert got[i]["labels"] == labels and got[i]["score"] == pytest.approx(score, abs=1e-9), texts[i]
        assert wanted[i] is None or wanted[i] in labels.split(",")
