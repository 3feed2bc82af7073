"""Behaviour of the text operators on small texts of our own."""

import pytest
from pyspark.sql import functions as F

from textloom.operators import admission as adm
from textloom.operators import hidden, lines, metrics, rewrite, rules, scorer
from textloom.plans import workflows
from textloom.sources import documents as src


def frame(spark, texts, language="en"):
    return spark.createDataFrame([(i, t, language) for i, t in enumerate(texts)], "doc_id long, text string, language string")


def texts_of(df):
    return [r["text"] for r in df.orderBy("doc_id").collect()]


def test_no_words_is_human(spark):
    rows = metrics.detect(frame(spark, ["12 + 30 = 42", "", None]), ["doc_id"]).collect()
    assert [(round(r["ai_probability"], 6), r["verdict"]) for r in rows] == [(0.14, "human")] * 3


def test_uniform_sentences_have_low_burstiness(spark):
    r = metrics.detect(frame(spark, ["One two three. Four five six. Seven eight nine."]), ["doc_id"]).first()
    assert r["burstiness"] == 0 and r["avg_sentence_length"] == 3


@pytest.mark.parametrize("p, verdict", [(0.34, "human"), (0.35, "mixed"), (0.64, "mixed"), (0.65, "ai")])
def test_verdict_bounds(spark, p, verdict):
    assert spark.range(1).select(metrics.verdict(F.lit(p))).first()[0] == verdict


def test_segments_are_places_in_the_text(spark):
    text = "  First words of it. 😀 Second one stands here! And a third one follows? No."
    rows = metrics.top_segments(frame(spark, [text]), ["doc_id"]).collect()
    assert len(rows) == 3 and all(text[r["start"] : r["end"]] == r["text"] for r in rows)


def test_cleaning(spark):
    rows = hidden.clean(frame(spark, ["\uFEFFa\u200Bb\u00A0c\uFEFFd\u200E—e", "plain", None, "Ⅳ", "x   y"])).orderBy("doc_id").collect()
    assert [r["text"] for r in rows] == ["\uFEFFab cd\u200E, e", "plain", None, "IV", "x   y"]
    assert (rows[0]["removed_count"], rows[0]["normalized_count"]) == (2, 1)
    assert [f["kind"] for f in rows[4]["findings"]] == ["excessive_whitespace"]
    again = hidden.clean(frame(spark, [r["text"] for r in rows])).orderBy("doc_id").collect()
    assert [r["text"] for r in again] == [r["text"] for r in rows]


def test_code_points_of_any_plane(spark):
    assert spark.createDataFrame([("a",), ("\u200B",), ("😀",)], "c string").select(hidden.code_point(F.col("c"))).collect() == [("U+0061",), ("U+200B",), ("U+1F600",)]


def test_homoglyphs(spark):
    """The scan compares place by place as far as both forms go; cleaning only where the length stays."""
    df = frame(spark, ["ａb", "ﬁ x"])
    assert [[f["kind"] for f in r["findings"]] for r in hidden.findings(df).orderBy("doc_id").collect()] == [["homoglyph"], ["homoglyph"] * 2]
    assert [[f["kind"] for f in r["findings"]] for r in hidden.clean(df).orderBy("doc_id").collect()] == [["homoglyph"], []]


def test_runs_of_blanks_are_findings_with_their_places(spark):
    text = "  a  b\t\tc \n   d   "
    found = hidden.clean(frame(spark, [text])).first()["findings"]
    assert [(f["kind"], f["index"], f["char"], f["note"]) for f in found] == [("excessive_whitespace", 3, " ", "2 blanks in a row"), ("excessive_whitespace", 6, "\t", "2 blanks in a row"), ("excessive_whitespace", 15, " ", "3 blanks in a row")]


def test_names_of_format_characters(spark):
    found = hidden.findings(frame(spark, ["a\u0007b\u2066c"])).first()["findings"]
    assert [(f["kind"], f["note"]) for f in found] == [("control", "UNKNOWN"), ("control", "LEFT-TO-RIGHT ISOLATE")]


def test_dashes(spark):
    texts = ["2020–2024", "a – b", "a–b–c", "so —  it", "3 – 4"]
    assert texts_of(hidden.clean(frame(spark, texts))) == ["2020–2024", "a - b", "a - b - c", "so, it", "3  -  4"]


def test_line_kinds_agree_in_both_forms(spark):
    text = "# Head\n\n> Short quote\n> a long quote that goes on until it ends here, surely.\n1. Item\n- an item of many words that ends with a full stop.\nMeta Title (5): body\nShort line\nA line of prose that has more than eight words in all"
    rows = lines.line_kinds(frame(spark, [text]), ["doc_id"]).orderBy("line").collect()
    assert [(r["kind"], r["body_start"]) for r in rows] == [lines.kind_of_line(x) for x in text.split("\n")]
    assert [r["kind"] for r in rows] == ["heading", "blank", "heading", "list_item", "heading", "list_item", "label_line", "heading", "prose"]
    assert all(text[r["start"] : r["end"]] == r["text"] for r in rows)


def test_spans():
    text = "We met Acme Widget Co there, see https://x.org/a and `code`, mail me@x.org (call 12) @you #tag and more of it."
    found = {text[s:e].strip() for s, e, _ in lines.spans_of(text)}
    assert {"Acme Widget Co", "https://x.org/a", "`code`", "me@x.org", "(call 12)", "@you", "#tag"} <= found


def test_merging_spans(spark):
    df = spark.sql("SELECT array(named_struct('s', 5, 'e', 9), named_struct('s', 0, 'e', 3), named_struct('s', 3, 'e', 4), named_struct('s', 6, 'e', 7)) AS r")
    assert [tuple(x) for x in df.select(lines.merged(F.col("r"))).first()[0]] == [(0, 4), (5, 9)]


@pytest.mark.parametrize("before, after", [("sold 12500 in 2026", "sold 12,500 in 2026"), ("2100 and 1999", "2,100 and 1999"), ("12500. 12,500 12500.5", "12500. 12,500 12500.5"), ("1234567 x", "1,234,567 x"), ("0012500 and 00000", "12,500 and 0"), ("9" * 25 + " x", "9," + ",".join(["999"] * 8) + " x")])
def test_thousands(spark, before, after):
    padded = f"of all that we have seen here so far, {before} and so on it goes."
    assert texts_of(rules.numbers(frame(spark, [padded]))) == [padded.replace(before, after)] == [rules.numbered(padded)[0]]


def test_tells_in_both_forms(spark):
    texts = ["Moreover, we delve into it in order to learn, as it serves as a guide to all of us here.", "Nothing to do in this line, that much is plain to see.", "See `in order to` there and in order to go on with all the rest of it."]
    rows = rules.scrub_tells(frame(spark, texts)).orderBy("doc_id").collect()
    assert [(r["text"], r["transformations"]) for r in rows] == [rules.scrubbed(t) for t in texts]
    assert rows[0]["text"] == "We examine it to learn, as it is a guide to all of us here." and "`in order to`" in rows[2]["text"]


def test_headings(spark):
    texts = ["# The Big API Plan\nSome prose here that is long enough to be no heading at all.", "1. My IPHONE 4S And Ios App: The GitHub\n\n> NASA'S Own Words", "", None, "# המוצר Of The Year"]
    rows = rewrite.headings(frame(spark, texts), ["doc_id"]).orderBy("doc_id").collect()
    assert [r["text"] for r in rows] == ["# The big API plan\nSome prose here that is long enough to be no heading at all.", "1. My iphone 4S and iOS app: the GitHub\n\n> NASA'S own words", "", None, "# המוצר Of The Year"]
    assert [r["transformations"] for r in rows] == [["headings:1"], ["headings:2"], [], [], []]


def test_sentences_and_abbreviations():
    assert rewrite.split_sentences("We saw Dr. Smith there. He left.") == ["We saw Dr. Smith there.", "He left."]


def test_long_sentences_are_split():
    text = "We went on and on along the road that leads to the town where we all once lived, and then we came back by the same long road as before it got dark."
    assert "lived. Then we" in rewrite.restructured(text, "en", "medium", rewrite.Chance(1, "s"))
    assert rewrite.structure(text, "en", "light", rewrite.Chance(1, "s")) == text


def test_long_paragraphs_are_cut_whole():
    four = "Here is one of them. Here is two of them.\nHere is three of them. Here is four of them."
    assert rewrite.wrapped(four) == "Here is one of them. Here is two of them. Here is three of them.\n\nHere is four of them."
    assert rewrite.wrapped("- " + four) == "- " + four and rewrite.burstiness("One two. One two.") == 0


def test_pivots():
    assert rewrite.unpivoted("It isn't just about speed; it's about trust.") == ("Speed. It's trust.", 1)
    assert rewrite.unpivoted("One; two three four; this is so. Next; no.") == ("One; Two three four. This is so. Next; no.", 1)
    assert rewrite.unpivoted("A short; it's x.") == ("A short; it's x.", 0)
    assert rewrite.unpivoted("This was not merely a matter of taste; that is really about money! It will not be only fun; it is work.") == ("Taste. That is money! Fun. It is work.", 2)
    assert rewrite.unpivoted("They all went home; its end is near. He said it is; it.") == ("They all went home; its end is near. He said it is; it.", 0)


def test_workflow(spark):
    df = frame(spark, ["Moreover, we leverage it\u200B in order to sell 12500 units to all of the people there.", None, ""])
    rows = workflows.rewritten(df, ["doc_id"]).orderBy("doc_id").collect()
    assert "\u200B" not in rows[0]["text"] and "12,500" in rows[0]["text"] and rows[0]["report"]["removed_count"] == 1
    assert rows[1]["text"] is None and rows[2]["text"] == ""
    assert workflows.rewritten(df.repartition(3), ["doc_id"]).orderBy("doc_id").collect() == rows
    assert workflows.before_and_after(workflows.rewritten(df, ["doc_id"]), ["doc_id"]).count() == 3


def test_detect_report(spark):
    row = workflows.detect(frame(spark, ["One two three four. Five six seven eight."]), ["doc_id"]).first()
    assert len(row["segments"]) == 2 and row["model_score"]["enabled"] is False


def test_model_states(spark):
    df = frame(spark, ["abc"])
    state = lambda load: tuple(scorer.score_with(df, load).first()["model_score"])
    assert state(lambda: lambda t: {"score": 1.7}) == (True, True, 1.0, None)
    assert state(lambda: lambda t: "x")[:3] == (True, False, None)
    with pytest.raises(TypeError):
        scorer.as_score("x")


def test_client(spark):
    df = frame(spark, ["abc"]).withColumn("strength", F.lit("medium"))
    r = scorer.rewritten_by(df, lambda t, lang, s: (t.upper(), 3, int(s["top_p"] * 100))).first()
    assert (r["text"], r["llm_prompt_tokens"], r["llm_output_tokens"], r["llm_error"]) == ("ABC", 3, 90, None)

    def broken(t, lang, s):
        raise OSError("down")

    assert scorer.rewritten_by(df, broken).first()["llm_error"] == "OSError: down"


def test_validation(spark):
    df = src.with_options(frame(spark, ["ok", "", "   ", "x" * 10_001, "x" * 50_001, None]))
    good, bad = src.validated(df)
    assert [r["doc_id"] for r in good.collect()] == [0]
    assert {r["doc_id"]: r["reason"] for r in bad.collect()} == {1: "empty", 2: "blank", 3: "over_cap", 4: "too_long", 5: "empty"}


def brute(rows, capacity, window):
    kept, out = {}, {}
    for i, k, t in sorted(rows, key=lambda r: (r[2], r[0])):
        w = kept.setdefault(k, [])
        w[:] = [x for x in w if x >= t - window]
        out[i] = len(w) < capacity
        if out[i]:
            w.append(t)
    return out


def requests_of(seed, n=300):
    import random

    r = random.Random(seed)
    return [(i, r.choice("aaab"), float(r.randint(0, 400))) for i in range(n)]


@pytest.mark.parametrize("capacity, window", [(5, 30.0), (1, 10.0), (0, 10.0)])
def test_admission(spark, capacity, window):
    rows = requests_of(1)
    df = spark.createDataFrame([*rows, (900, None, 1.0), (901, "a", None)], "event_id long, key string, ts double").withColumn("allowed", F.lit(1))
    assert {r["event_id"]: r["allowed"] for r in adm.admission(df, capacity, window).collect()} == brute(rows, capacity, window)


def test_admission_opens_and_keeps_keys_apart(spark):
    rows = [(1, "a", 100.0), (2, "a", 105.0), (3, "a", 110.0), (4, "a", 111.0), (5, "b", 100.0)]
    got = {r["event_id"]: (r["allowed"], r["retry_after_s"]) for r in adm.admission(spark.createDataFrame(rows, "event_id long, key string, ts double"), 1, 10.0).collect()}
    assert got == {1: (True, 0), 2: (False, 6), 3: (False, 1), 4: (True, 0), 5: (True, 0)}


def test_admission_stream(spark, tmp_path):
    """The stream decides like the batch form when rows come in order of time, over several micro-batches and a restart."""
    from textloom.streaming.admission import admission_stream

    provider = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = sorted(requests_of(2, 120), key=lambda r: (r[2], r[0]))
    schema = "event_id long, key string, ts double"

    def run(part, k):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        query = admission_stream(stream, 3, 20.0).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        assert query.awaitTermination(120)

    run(rows[:70], 0)
    run(rows[70:], 1)
    got = {r["event_id"]: r["allowed"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    spark.conf.set(provider, old)
    assert got == brute(rows, 3, 20.0)


def test_sinks_and_dictionaries(spark, tmp_path):
    src.write_markdown(frame(spark, ["# Hi"]), str(tmp_path / "md"))
    files = [f.read_bytes() for f in (tmp_path / "md").glob("part-*")]
    assert any(f.startswith("\uFEFF# Hi".encode()) for f in files)
    assert "zero_width" in src.findings_json(hidden.findings(frame(spark, ["a\u200Bb"])), ["doc_id"]).first()["report"]
    assert src.read_ranks(str(tmp_path / "none")) == [] and src.read_dictionary(str(tmp_path / "none"), "x") == {}
    words = spark.createDataFrame([("b",), ("a",), ("b",)], "word string")
    assert [tuple(r) for r in src.ranks(words).orderBy("rank").collect()] == [("b", 1), ("a", 2)]


def test_dictionaries_by_spark(spark, tmp_path):
    (tmp_path / "words").write_text("the\nof\n\nand\nof\n", encoding="utf-8")
    assert {(r["word"], r["rank"]) for r in src.word_list(spark, str(tmp_path / "words")).collect()} == {("the", 1), ("and", 3), ("of", 4)}
    (tmp_path / "d.json").write_text('{"en": {"big": ["large", "great"]}, "he": {}}', encoding="utf-8")
    assert [tuple(r) for r in src.dictionary(spark, str(tmp_path / "d.json"), "en").collect()] == [("big", ["large", "great"])]
    assert src.dictionary(spark, str(tmp_path / "d.json"), "fr").count() == src.dictionary(spark, str(tmp_path / "none"), "en").count() == src.word_list(spark, str(tmp_path / "none")).count() == 0


def test_leading_signals(spark):
    found = metrics.detect(frame(spark, ["One two three. Four five six. Seven eight nine. It might perhaps be so."]), ["doc_id"]).select(metrics.leading_signals().alias("s")).first()["s"]
    assert [x["name"] for x in found][0] == "Burstiness (low)" and len(found) == 3 and [x["value"] for x in found] == sorted((x["value"] for x in found), reverse=True)


def test_entry_without_the_subpackage():
    """In a copy without the two folders and the pipeline, the entry and the other queries still stand."""
    import shutil
    import subprocess
    import sys
    import tempfile
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    with tempfile.TemporaryDirectory() as copy:
        for name in ("textloom", "__spark_entry__.py"):
            (shutil.copytree if (root / name).is_dir() else shutil.copy)(root / name, Path(copy) / name)
        shutil.rmtree(Path(copy) / "textloom" / "llm", ignore_errors=True)
        code = "import __spark_entry__ as e; q = e.queries(); assert 'detect_verdict' in q and 'pipeline' not in q and not [n for n in q if n.startswith('op')]; print(len(q), len(e.oracle_sql()))"
        done = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, env={k: v for k, v in __import__("os").environ.items() if k != "PYTHONPATH"})
        assert done.returncode == 0, done.stderr
