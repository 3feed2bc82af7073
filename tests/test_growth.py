"""Steps that must grow no faster than their texts: same results, in the row and without shuffling words."""

import random

from pyspark.sql import functions as F

from textloom.functions import lexicon as lx
from textloom.operators import hidden, metrics, swaps
from textloom.plans import workflows


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def frame(spark, texts, language="en"):
    return spark.createDataFrame([(i, t, language) for i, t in enumerate(texts)], "doc_id long, text string, language string")


def test_the_own_lexicon_is_counted_in_the_row(spark):
    rng = random.Random(5)
    known = [w for language, w, *_ in lx.rows() if language == "en"] + ["Ärger", "It's", "zebra", "was taken", "beübe be enenü"]
    texts = [None, "", " . ! ", *["".join(rng.choice(known) + rng.choice([" ", ". ", "! \n", ", "]) for _ in range(rng.randint(1, 60))) for _ in range(40)]]
    df = frame(spark, texts).unionByName(frame(spark, lx.HEDGES["he"], "he").withColumn("doc_id", F.col("doc_id") + 1000)).unionByName(frame(spark, ["no list"], "fr").withColumn("doc_id", F.lit(2000).cast("long")))
    mine, joined = metrics.detect(df, ["doc_id"]), metrics.detect(df, ["doc_id"], (), lx.lexicon(spark))
    assert "Exchange" not in plan(mine) and "Generate" not in plan(mine)
    assert {r["doc_id"]: r for r in mine.collect()} == {r["doc_id"]: r for r in joined.select(*mine.columns).collect()}


def test_passives_end_at_letters_of_all_scripts():
    text = lambda t: metrics._passives(t.encode().lower())
    assert [text(t) for t in ("It WAS taken.", "ieübe enen", "be enenü", "“be enen”", "be enen bé", "½is taken½")] == [1, 0, 0, 1, 1, 1]


def test_sentences_of_a_text_are_joined_with_nothing(spark):
    top = metrics.top_segments(frame(spark, ["One sentence is here. Another one stands there! " * 3]), ["doc_id"])
    assert plan(top).count("Join") == 0 and plan(top).count("Exchange") == 1
    assert [(r["rank"], r["start"], r["text"]) for r in top.orderBy("rank").collect()][0][2] in ("One sentence is here.", "Another one stands there!")


def test_hidden_characters_are_found_without_a_walk_over_all(spark):
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    df = frame(spark, ["a\u200Bb", "Ａ \uFEFFb\x07", "plain", None, "ﬁx it", "\U000E0041x \u3000 y —  z"])
    found = hidden.findings(df)
    assert "split(" not in plan(found) and spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "500"
    got = {r["doc_id"]: [(f["kind"], f["index"]) for f in r["findings"]] for r in found.collect()}
    assert got == {0: [("zero_width", 1)], 1: [("bom", 2), ("control", 4), ("homoglyph", 0)], 2: [], 3: [], 4: [("homoglyph", 0), ("homoglyph", 1), ("homoglyph", 3), ("homoglyph", 4)], 5: [("control", 0), ("special_space", 3)]}
    out = {r["doc_id"]: (r["text"], r["removed_count"], r["normalized_count"]) for r in hidden.clean(df).collect()}
    assert out == {0: ("ab", 1, 0), 1: ("A b", 2, 0), 2: ("plain", 0, 0), 3: (None, 0, 0), 4: ("fix it", 0, 0), 5: ("x   y, z", 1, 1)}


def test_a_report_looks_at_texts_for_sentences_and_once_more(spark):
    found = workflows.detect(frame(spark, ["One sentence is here. Another one stands there! ", "", None]), ["doc_id"])
    assert plan(found).count("Join") == 1 and plan(found).count("Scan") == 2
    assert {r["doc_id"]: len(r["segments"] or []) for r in found.collect()} == {0: 2, 1: 0, 2: 0}


def test_tokens_that_no_table_knows_become_no_rows(spark):
    df = frame(spark, ["Big plans, don't help BIG_ones x-ray", None]).unionByName(frame(spark, ["והגדול"], "he")).withColumns({"strength": F.lit("medium"), "key": F.lit("k")})
    found = lambda known: sorted((r["s"], r["e"], r["old"], r["prefix"], r["word"]) for r in swaps.words(df, ["doc_id"], known).collect())
    assert found({"en": {"big", "don't"}, "he": {"גדול"}}) == [(0, 3, "Big", "", "big"), (0, 6, "והגדול", "וה", "גדול"), (11, 16, "don't", "", "don't")]
    assert [x for x in found(None) if x[2].isascii()] == [(0, 3, "Big", "", "big"), (4, 9, "plans", "", "plans"), (11, 16, "don't", "", "don't"), (17, 21, "help", "", "help"), (22, 30, "BIG_ones", "", "big_ones"), (31, 36, "x-ray", "", "x-ray")]
    assert [x[3:] for x in found(None) if not x[2].isascii()] == [("", "והגדול"), ("ו", "הגדול"), ("וה", "גדול")]


def test_both_sides_of_a_rewriting_are_measured_in_one_row(spark):
    df = frame(spark, ["It is important to note that we leverage plans. It was taken.", ""]).withColumns({"source": F.lit("We leverage robust plans, moreover."), "text": F.col("text")})
    both = workflows.before_and_after(df, ["doc_id"])
    assert "Join" not in plan(both) and "Exchange" not in plan(both)
    one = lambda c: {r["doc_id"]: r["ai_probability"] for r in metrics.detect(df.withColumn("text", F.col(c)), ["doc_id"]).collect()}
    a, b = one("source"), one("text")
    assert {r["doc_id"]: (r["probability_before"], r["probability_after"]) for r in both.collect()} == {k: (a[k], b[k]) for k in a}
