"""Python's line kinds against the JVM's, looks before patterns, and sentences in one pass."""

import random
import re
import time

from pyspark.sql import functions as F

from textloom.operators import lines, rewrite, rules, sentences


def test_line_kinds_agree_on_other_blanks(spark):
    body = ["All rights reserved. ", " ", " # Head", "1. Item", "١. Item of list", "Läbel: body of it", "a b c d e f g h i", "Meta Title: body", " \t", "end.\x0B"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(body)], "i long, t string").select("t", lines.line_kind(F.col("t")).alias("k")).collect()
    assert [(r["t"], r["k"]["kind"], r["k"]["body_start"]) for r in rows] == [(t, *lines.kind_of_line(t)) for t in body]


def test_spans_are_those_of_all_patterns():
    rng, parts = random.Random(5), ["a ", "`", "```", "![", "[", "]", "(", ")", "](", "][", "]: ", "\n", "x@y.org ", "@me ", "#tag ", "HTTPS://x.y ", "wWw.x.y ", "12 ", "Big Plan Here "]
    for _ in range(300):
        text = "".join(rng.choice(parts) for _ in range(30))
        every = sorted((m.start(), m.end(), k) for k, p in lines.SPANS.items() for m in re.finditer(p, text))
        assert [x for x in lines.spans_of(text) if x[2] in lines.SPANS] == every


def brute(text):
    """Sentences by looking back, word by word."""
    out, joins = [], False
    for piece in re.split(rf"(?<=[.!?]){sentences.BLANK}+(?=[A-Zא-ת])", text):
        if piece:
            n = len(re.findall(sentences.WORD, piece))
            out = [*out[:-1], out[-1] + n] if joins else [*out, n]
            joins = bool((m := re.search(r"([A-Za-z.]+)\.\Z", piece)) and m[1].lower() in sentences.ABBREVIATIONS)
    return out


def test_sentence_lengths_in_one_pass(spark):
    rng, parts = random.Random(7), ["Dr. ", "x.Prof. ", "e.g. ", "Word ", "low ", "! ", "? ", ".\n", "..", "A", "\x1c", " ", "שלום. "]
    texts = ["".join(rng.choice(parts) for _ in range(40)) for _ in range(300)] + ["", None, "A. " * 100_000, "aaaa." * 100_000]
    began = time.perf_counter()
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", sentences.sentence_lengths(F.col("t")).alias("n")).collect()
    assert time.perf_counter() - began < 30 and all(r["n"] == brute(r["t"] or "") for r in rows if len(r["t"] or "") < 1000)


def test_rules_are_tried_where_their_matches_may_begin():
    every, rng = [*rules.TELLS, *rules.PHRASES, *rules.FILLERS, *rules.HACKY], random.Random(9)
    odd = [rules.Rule("x", r"a|b", "", "all"), rules.Rule("x", r"(?:ab)?cd", "z", "part"), rules.Rule("x", r"is\s+(\w+)", "$1", "word")]
    parts = [rules.sample(r) for r in every] + [" ", ". ", "İn order to ", "ſeamlessly works ", "ıs able to ", "IN ORDER TO", "xin order to", "cd", "abcd", "is  it "]
    for _ in range(200):
        text = want = " ".join(rng.choice(parts) for _ in range(12))
        got, log = {}, {}
        for r in (*every, *odd):
            want, n = re.subn("(?i)" + r.pattern, re.sub(r"\$(\d)", r"\\g<\1>", r.replacement), want)
            log |= {r.tag: log.get(r.tag, 0) + n} if n else {}
        assert rules.folded_text(text, [*every, *odd], got) == want and got == log
    assert all(rules.heads(r.pattern) for r in every) and rules.heads("a|b") == () == rules.heads("(?x)a b")


def test_many_rules_take_one_look(spark):
    df = spark.createDataFrame([("word and more of it. " * 100_000,), (None,), ("in order to",)], "t string")
    began = time.perf_counter()
    rows = df.select(rules.rule_counts(F.col("t"), rules.TELLS).alias("c")).collect()
    assert time.perf_counter() - began < 30 and [[(x["tag"], x["n"]) for x in r["c"]] for r in rows] == [[], [], [("in_order_to", 1)]]


def test_sentences_are_cut_as_by_looking_back():
    rng, parts = random.Random(11), ["Dr. ", "x.Prof. ", "e.g. ", "Word ", "low ", "! ", ".\n", "..", "A", "שלום. ", "\n"]
    for _ in range(300):
        text, out = "".join(rng.choice(parts) for _ in range(40)), []
        for piece in re.split(r"(?<=[.!?])\s+(?=[A-Zא-ת])", text):
            if out and (m := re.search(r"([A-Za-z.]+)\.$", out[-1])) and m[1].lower() in rewrite.ABBREVIATIONS:
                out[-1] += " " + piece
            elif piece:
                out.append(piece)
        assert rewrite.split_sentences(text) == out
