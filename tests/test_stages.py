"""Marks in texts, files as sinks, figures of runs, client calls, batched models and streaming state."""

import random
import time

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from textloom.operators import admission as adm
from textloom.operators import client, render, scorer
from textloom.plans import workflows
from textloom.sources import figures, files


def frame(spark, texts, language="en"):
    return spark.createDataFrame([(i, t, language) for i, t in enumerate(texts)], "doc_id long, text string, language string")


def by_hand(text, spans):
    """Marks by walking over the places, with a stack; spans are nested or apart."""
    out, stack = [], []
    for i in range(len(text) + 1):
        while stack and stack[-1][1] == i:
            out.append(f"</{stack.pop()[2]}>")
        for x in sorted((x for x in spans if x[0] == i), key=lambda x: (-x[1], x[2])):
            stack.append(x)
            out.append(f"<{x[2]}>")
        out.append({"<": "&lt;", ">": "&gt;", "&": "&amp;"}.get(text[i : i + 1], text[i : i + 1]))
    return "".join(out)


def test_rendered_marks(spark):
    rng = random.Random(3)
    texts, spans = ["".join(rng.choice("ab<&😀 ") for _ in range(40)) for _ in range(60)], []
    for _ in texts:
        mine, open_ = set(), [(0, 40)]
        for _ in range(6):
            s, e = rng.choice(open_)
            if e - s > 1:
                a = rng.randint(s, e - 1)
                b = rng.randint(a + 1, e)
                if not any(x[0] < b and a < x[1] and not (x[0] <= a and b <= x[1]) and not (a <= x[0] and x[1] <= b) for x in mine):
                    mine.add((a, b, rng.choice("xyz")))
                    open_.append((a, b))
        spans.append(mine)
    rows = [(i, *x) for i, some in enumerate(spans) for x in some]
    got = render.rendered(frame(spark, texts), ["doc_id"], spark.createDataFrame(rows, "doc_id long, s int, e int, tag string")).collect()
    assert len(got) == len(texts) and all(r["rendered"] == by_hand(r["text"], spans[r["doc_id"]]) for r in got)


def test_crossing_spans_are_clipped(spark):
    spans = spark.createDataFrame([(0, 0, 4, "a"), (0, 2, 6, "b"), (0, 3, 9, "c"), (0, 5, 5, "d"), (1, 0, 1, "a")], "doc_id long, s int, e int, tag string")
    rows = render.rendered(frame(spark, ["0123456789", None, "plain"]), ["doc_id"], spans).orderBy("doc_id").collect()
    assert [r["rendered"] for r in rows] == ["<a>01<b>2<c>3</c></b></a>456789", None, "plain"]


def test_a_file_for_each_row(spark, tmp_path):
    df = frame(spark, ["# One", "twoä", None]).withColumn("name", F.concat(F.lit("doc-"), "doc_id")).repartition(3)
    files.write_files(df, str(tmp_path / "out"), "name")
    assert {f.name: f.read_bytes() for f in (tmp_path / "out").iterdir()} == {"doc-0.md": "﻿# One".encode(), "doc-1.md": "﻿twoä".encode(), "doc-2.md": "﻿".encode()}
    files.write_files(df.filter("doc_id = 0").withColumn("text", F.lit("new")), (tmp_path / "out").as_uri(), "name")  # again: the same file
    assert sorted(f.name for f in (tmp_path / "out").iterdir()) == ["doc-0.md", "doc-1.md", "doc-2.md"] and (tmp_path / "out" / "doc-0.md").read_text() == "﻿new"
    files.write_files(df.filter("doc_id = 1"), str(tmp_path / "out"), "name", mode="overwrite")
    assert [f.name for f in (tmp_path / "out").iterdir()] == ["doc-1.md"]
    files.write_json_files(df.filter("doc_id = 0").select("name", "text"), str(tmp_path / "json"), "name")
    assert '"text" : "# One"' in (tmp_path / "json" / "doc-0.json").read_text()


def test_failed_tasks_leave_no_files(spark, tmp_path):
    df = frame(spark, ["a", "b", "c"]).withColumn("name", F.when(F.col("doc_id") == 2, "../up").otherwise(F.col("doc_id").cast("string"))).repartition(3)
    for bad in (df, df.withColumn("name", F.lit("same"))):
        with pytest.raises(Exception, match="no name for a file|same name"):
            files.write_files(bad, str(tmp_path / "out"), "name")
        assert not (tmp_path / "out").exists() or list((tmp_path / "out").iterdir()) == []


def test_figures_of_runs(spark):
    df = frame(spark, ["fine text", "", None, "x" * 60_000, "more of it"])
    df = df.withColumn("strength", F.lit("medium"))
    seen = Observation()
    assert figures.validated(df, seen).count() == 2
    assert seen.get == {"rows": 5, "refused": 3, "characters": 9 + 60_000 + 10}
    seen, texts = Observation(), ["Moreover, we leverage it in order to sell 12500 units to all of the people there.", "Nothing to do in this line, that much is plain to see.", None]
    rows = figures.rewritten(workflows.rewritten(frame(spark, texts), ["doc_id"]), seen).collect()
    want = {"rows": 3, "changed": sum(r["source"] != r["text"] for r in rows), "characters": sum(len(r["source"] or "") for r in rows), "characters_after": sum(len(r["text"] or "") for r in rows), "entries": sum(len(r["transformations"]) for r in rows)}
    assert seen.get == want and want["changed"] >= 1


def test_client_calls_are_tried_again_and_kept(spark, tmp_path):
    log = tmp_path / "calls"
    log.mkdir()

    def load():
        def call(request):
            mine = list(log.glob(f"{request['text']}-*"))
            (log / f"{request['text']}-{len(mine)}-{time.time_ns()}").touch()
            if request["text"] == "slow" and len(mine) < 2:
                raise TimeoutError("too slow")
            if request["text"] == "no":
                raise client.Refused("not this")
            if request["text"] == "down" and len(mine) < 3:
                raise ConnectionError("down")
            return request["text"].upper(), 5, int(100 * request["top_p"])

        return call

    df = frame(spark, ["one", "slow", "no", "down", None]).withColumn("strength", F.lit("light")).repartition(2)
    ask = lambda: {r["doc_id"]: tuple(r)[1:] for r in client.answered(df, ["doc_id"], load, str(tmp_path / "answers"), tries=3, wait_s=0.01).collect()}
    first = ask()
    assert first == {0: ("ONE", 5, 85, None, 1), 1: ("SLOW", 5, 85, None, 3), 2: ("no", None, None, "refused: not this", 1), 3: ("down", None, None, "network: down", 3)}
    second = ask()  # answered ones aren't asked again, so their tokens count once
    assert second == first | {3: ("DOWN", 5, 85, None, 1)} and len(list(log.glob("one-*"))) == 1 and len(list(log.glob("no-*"))) == 2
    assert sum(x[1] or 0 for x in second.values()) == 15


def test_models_score_in_batches(spark):
    def load():
        def score(texts):
            return [len(t) / 100 for t in texts]

        score.batched = True
        return score

    df = frame(spark, ["a" * 30, None, "b" * 400])
    rows = scorer.score_with(df, load, batch=2).orderBy("doc_id").collect()
    assert [(r["model_score"]["available"], r["model_score"]["score"]) for r in rows] == [(True, 0.3), (True, 0.0), (True, 1.0)]


@pytest.fixture
def rocksdb(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(name, old)


def test_state_of_a_stream_outlives_restarts_and_expires(spark, tmp_path, rocksdb):
    from textloom.streaming.admission import admission_stream

    schema = "event_id long, key string, ts double"

    def put(rows, state):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in-{state}"))

    def started(state, idle_ms, admitted, **trigger):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / f"in-{state}"))
        return admission_stream(stream, 2, 100.0, idle_ms, admitted).writeStream.format("parquet").option("path", str(tmp_path / f"out-{state}")).option("checkpointLocation", str(tmp_path / state)).trigger(**trigger).start()

    def decided(state):
        return {r["event_id"]: r["allowed"] for r in spark.read.schema("event_id long, allowed boolean").parquet(str(tmp_path / f"out-{state}")).collect()}

    def run(rows, admitted=None, state="state"):
        put(rows, state)
        assert started(state, None, admitted, availableNow=True).awaitTermination(120)
        return decided(state)

    first = [(1, "a", 0.0), (2, "a", 1.0), (3, "a", 2.0), (4, "b", 0.0)]
    second = [(5, "a", 50.0), (6, "b", 60.0), (7, "b", 61.0)]
    got = run(first) and run(second)
    assert got == {r["event_id"]: r["allowed"] for r in adm.admission(spark.createDataFrame(first + second, schema), 2, 100.0).collect()}
    assert got[3] is False and got[5] is False and got[7] is False
    put([(1, "a", 0.0), (2, "a", 1.0), (3, "a", 2.0)], "idle")
    query = started("idle", 500, None, processingTime="200 milliseconds")
    try:
        for k, rows in enumerate(([], [(5, "a", 6.0)])):
            if rows:
                time.sleep(4)  # the timer of the key goes off in a batch without rows
                put(rows, "idle")
            until = time.time() + 60
            while not ((tmp_path / "out-idle").exists() and len(decided("idle")) == 3 + k) and time.time() < until:
                time.sleep(0.5)
    finally:
        query.stop()
    assert decided("idle") == {1: True, 2: True, 3: False, 5: True}
    known = spark.createDataFrame([("a", 0.0), ("a", 1.0), ("c", 3.0)], "key string, ts double")
    assert run([(1, "a", 2.0), (2, "c", 4.0), (3, "c", 5.0)], admitted=known, state="known") == {1: False, 2: True, 3: False}


@pytest.mark.parametrize("gap", [1.0, 40.0])
def test_a_key_over_several_tasks(spark, gap):
    rng, at, rows = random.Random(8), 0.0, []
    for i in range(6000):  # one key has most of the requests; with long gaps its ranges come apart
        at += rng.choice([0.0, 0.5, 1.0]) if rng.random() < 0.98 else gap
        rows.append((i, "hot" if rng.random() < 0.9 else f"k{rng.randint(0, 9)}", at))
    df = spark.createDataFrame(rows + [(9000, None, 1.0), (9001, "hot", None)], "event_id long, key string, ts double").repartition(5)
    got = adm.admission_in_ranges(df, 4, 10.0, range_rows=500).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, adm.admission(df, 4, 10.0).collect())) and len(got) == 6000
    assert sorted(map(tuple, adm.admission_in_ranges(df.limit(50), 4, 10.0).collect())) == sorted(map(tuple, adm.admission(df.limit(50), 4, 10.0).collect()))


def test_settings_of_the_session(spark):
    from textloom.sources import documents as src

    assert src.settings(spark) == src.Settings()
    spark.conf.set("spark.textloom.cap", "77")
    spark.conf.set("spark.textloom.strength", "light")
    try:
        assert src.settings(spark) == src.Settings(strength="light", cap=77)
    finally:
        spark.conf.unset("spark.textloom.cap")
        spark.conf.unset("spark.textloom.strength")
