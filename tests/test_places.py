"""Places in texts: phrases, running values, intervals, islands of sentences, and swaps put back by place."""

import random
import re

import pytest
from pyspark.sql import functions as F

from textloom.functions import arrays, phrases, tokens
from textloom.operators import intervals, lines, rewrite, sentences, swaps
from textloom.sources import documents as src


def test_phrases_are_counted_as_str_count_does(spark):
    rng = random.Random(4)
    known = ["ab", "aba", "b a", "aa", "bab ab", "c"]
    texts = ["".join(rng.choice("ab c😀") for _ in range(rng.randint(0, 60))) for _ in range(200)] + [None, "aaaa", "ababab"]
    df = spark.createDataFrame([(i, t, "en" if i % 5 else "xx") for i, t in enumerate(texts)], "i int, t string, l string")
    got = df.select("t", "l", phrases.places(F.col("t"), F.col("l"), {"en": known}).alias("p"), phrases.counts(F.col("t"), F.col("l"), {"x": {"en": known[:3]}, "y": {"en": known[2:]}}).alias("c")).collect()
    for r in got:
        on = r["l"] == "en" and r["t"]
        want = sorted((m.start(), p) for p in known for m in re.finditer(re.escape(p), r["t"])) if on else []
        assert [(p["start"], p["phrase"]) for p in r["p"]] == want
        assert (r["c"]["x"], r["c"]["y"]) == tuple(sum(r["t"].count(p) for p in some) if on else 0 for some in (known[:3], known[2:]))


def test_matches_and_unions(spark):
    rng = random.Random(6)
    texts = ["".join(rng.choice("ab1 😀") for _ in range(rng.randint(0, 50))) for _ in range(100)] + ["", None]
    for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", tokens.matches(F.col("t"), "[ab]+|1").alias("m")).collect():
        assert r["m"] is None if r["t"] is None else [tuple(x) for x in r["m"]] == [(m.start(), m.end(), m[0]) for m in re.finditer("[ab]+|1", r["t"])]
    spans = [[(s := rng.randint(0, 50), s + rng.randint(1, 9)) for _ in range(rng.randint(0, 12))] for _ in range(100)]
    for r in spark.createDataFrame([(x,) for x in spans], "x array<struct<s:int,e:int>>").select("x", lines.merged(F.col("x")).alias("y")).collect():
        held = {p for a in r["x"] for p in range(2 * a["s"], 2 * a["e"] + 1)}  # halves, so that spans that touch are one
        assert [(a["s"], a["e"]) for a in r["y"]] == [(p // 2, next(q for q in range(p, 999) if q + 1 not in held) // 2) for p in sorted(held) if p - 1 not in held]


def test_a_text_of_a_million_lines(spark):
    df = spark.createDataFrame([(1, "ab\n" * 1_000_000)], "doc_id long, text string")
    r = lines.line_kinds(df, ["doc_id"]).agg(F.count("*").alias("n"), F.max("start").alias("last"), F.sum(F.col("start") - 3 * F.col("line")).alias("off")).first()
    assert (r["n"], r["last"], r["off"]) == (1_000_001, 3_000_000, 0)


@pytest.mark.parametrize("width", [1, 3, 1024])
def test_overlapping_intervals(spark, width):
    rng = random.Random(9)
    make = lambda n: [(rng.randint(0, 3), s := rng.randint(0, 60), s + rng.randint(0, 12), k) for k in range(n)]
    a, b = make(60), make(80)
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, s int, e int, k int")
    got = sorted((r["k"], r["other_k"]) for r in intervals.overlapping(frame(a), frame(b), ["doc_id"], width=width).collect())
    assert got == sorted((x[3], y[3]) for x in a for y in b if x[0] == y[0] and x[1] < x[2] and y[1] < y[2] and x[1] < y[2] and y[1] < x[2])
    points = sorted((r["k"], r["other_k"]) for r in intervals.points_within(frame(a), frame(b), ["doc_id"], "s", width).select("k", "other_k").collect())
    assert points == sorted((x[3], y[3]) for x in a for y in b if x[0] == y[0] and y[1] <= x[1] < y[2])


def test_a_text_with_very_many_spans(spark):
    spans = spark.range(100_000).select(F.lit(1).alias("doc_id"), (F.col("id") * 10).alias("s"), (F.col("id") * 10 + 12).alias("e"))
    points = spark.range(200_000).select(F.lit(1).alias("doc_id"), (F.col("id") * 5).alias("at"))
    assert intervals.points_within(points, spans, ["doc_id"], "at").count() == 100_000 + 99_999 + 100_000
    assert intervals.overlapping(spans, spans, ["doc_id"]).count() == 100_000 + 2 * 99_999


def test_burstiness_of_sentences_with_abbreviations(spark):
    texts = ["Dr. Smith came. He left at no. Then Mr. And Mrs. Jones e.g. Nobody stayed! Really? Yes.", "one", "", None, "  ", "A. B. C. Inc. D", "Five words stand in here. Two words.\n\nThen one more etc. Done. ok. not here"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", sentences.structural_burstiness(F.col("t")).alias("b"), sentences.sentence_lengths(F.col("t")).alias("n")).collect()
    for r in rows:
        assert r["b"] == pytest.approx(rewrite.burstiness(r["t"] or "")) and r["n"] == [len(s.split()) for s in rewrite.split_sentences(r["t"] or "")]


def swap_frame(spark, texts, language="en", strength="aggressive"):
    return spark.createDataFrame([(i, t, language, strength) for i, t in enumerate(texts)], "doc_id long, text string, language string, strength string")


def always(monkeypatch):
    monkeypatch.setattr(swaps, "chance", lambda seed, layer, key, place, first=1: F.lit(0.0))


def test_swaps_in_english(spark, monkeypatch):
    always(monkeypatch)
    texts = ["LEVERAGE this. Leverage `leverage` that, utilize it. The leverages stay.", "It is important to note a big-time plan. It is important to noted.", None, "", "nothing here"]
    rows = swaps.swapped(swap_frame(spark, texts), ["doc_id"]).orderBy("doc_id").collect()
    assert [r["text"] for r in rows] == ["USE this. Use `leverage` that, use it. The leverages stay.", "Note a big-time scheme. It is key to noted.", None, "", "nothing here"]
    assert rows[0]["transformations"] == ["word:LEVERAGE->USE", "word:Leverage->Use", "word:utilize->use"] and rows[4]["transformations"] == []


def test_swaps_in_hebrew_take_prefixes(spark, monkeypatch):
    always(monkeypatch)
    known = spark.createDataFrame([("he", "מקיף", "word", ["מלא"]), ("he", "המלך", "word", ["הנסיך"]), ("he", "מלך", "word", ["שר"])], "language string, word string, layer string, options array<string>")
    rows = swaps.swapped(swap_frame(spark, ["המקיף ושהמקיף המלך ומלך אמקיף ה־מקיף."], "he"), ["doc_id"], known, {}).collect()
    assert rows[0]["text"] == "המלא ושהמלא הנסיך ושר אמקיף ה־מלא."


def test_swaps_by_seed_and_strength(spark):
    texts = ["leverage robust utilize seamless pivotal crucial " * 30]
    one, again, other = (swaps.swapped(swap_frame(spark, texts), ["doc_id"], seed=s).first()["text"] for s in (1, 1, 2))
    assert one == again != other
    share = lambda strength: len(swaps.swapped(swap_frame(spark, texts, strength=strength), ["doc_id"], phrases={}).first()["transformations"]) / 180
    assert share("light") == pytest.approx(0.2, abs=0.1) and share("medium") == pytest.approx(0.5, abs=0.12) and share("aggressive") == pytest.approx(0.85, abs=0.1)


def test_swaps_take_a_dictionary_file(spark, tmp_path, monkeypatch):
    always(monkeypatch)
    (tmp_path / "d.json").write_text('{"words": {"grand": ["large", "great"]}}')
    known = src.dictionary(spark, str(tmp_path / "d.json"), "words").select(F.lit("en").alias("language"), "word", F.lit("word").alias("layer"), "options")
    assert swaps.swapped(swap_frame(spark, ["A grand plan, GRAND."]), ["doc_id"], known, {}).first()["text"] == "A large plan, LARGE."


def test_settled_edits_do_not_overlap():
    rng = random.Random(2)
    for _ in range(300):
        edits = [{"s": (s := rng.randint(0, 30)), "e": s + rng.randint(1, 8), "layer": rng.randint(1, 3)} for _ in range(rng.randint(0, 9))]
        edits = list({(x["s"], x["e"], x["layer"]): x for x in edits}.values())
        rank = lambda x: (x["layer"], x["s"] - x["e"], x["s"])
        want = [x for x in edits if not any(y["s"] < x["e"] and x["s"] < y["e"] and rank(y) < rank(x) for y in edits)]
        assert sorted(swaps.settled("x" * 60 + ".", edits), key=rank) == sorted(want, key=rank)


def test_arrays(spark):
    df = spark.createDataFrame([([3, 1, 2],), ([],), ([5],)], "a array<long>")
    rows = df.select(arrays.sums(F.col("a")).alias("s"), arrays.before(F.col("a"), F.lit(0).cast("long")).alias("b")).collect()
    assert [(r["s"], r["b"]) for r in rows] == [([3, 4, 6], [0, 3, 1]), ([], []), ([5], [0])]


def test_own_words_and_phrases_in_the_metrics(spark, tmp_path):
    from textloom.functions import lexicon as lx
    from textloom.operators import metrics
    from textloom.plans import workflows

    (tmp_path / "ranks").write_text("zeta\nAlpha\nbeta\n", encoding="utf-8")
    own = lx.with_ranks(lx.lexicon(spark), "en", src.word_list(spark, str(tmp_path / "ranks")))
    own = lx.with_flag(own, "en", "is_machine", spark.createDataFrame([("Beta", ["b"])], "word string, options array<string>"))
    assert lx.vocabulary_sizes(own)["en"] == 3 and own.filter("language = 'en' AND is_machine").count() == 1
    df = spark.createDataFrame([(1, "Alpha beta gamma alpha beta. Moreover so to say.", "en")], "doc_id long, text string, language string")
    r = metrics.metrics(df, ["doc_id"], (), own, {"en": ["so to say"], "he": []}).first()
    import math

    assert r["ai_phrase_density"] == pytest.approx((2 + 3) / 9) and r["transition_word_frequency"] == pytest.approx(1 / 9)
    assert r["perplexity_proxy"] == pytest.approx(math.log((2 + 3 + 4 + 2 + 3 + 4 * 4) / 9 + 1) / math.log(3 + 2))
    out = workflows.detect(df, ["doc_id"], None, own, {"en": ["so to say"], "he": []}).first()
    assert out["ai_phrase_density"] == r["ai_phrase_density"] and len(out["segments"]) == 2


def test_own_rules_in_the_rewriting(spark):
    from textloom.operators import rules
    from textloom.plans import workflows

    df = spark.createDataFrame([(1, "We went there zigzag, in order to see all of the plan, and it was good.", "en")], "doc_id long, text string, language string")
    own = [rules.Rule("vocab", r"\bzigzag\b", "straight", "zig")]
    known = spark.createDataFrame([("en", "nothing", "word", ["x"])], "language string, word string, layer string, options array<string>")
    r = workflows.rewritten(df, ["doc_id"], seed=3, tells=own, known=known, phrases={}).first()
    assert "straight" in r["text"] and "in order to" in r["text"] and "tells:zig:1" in r["transformations"]
