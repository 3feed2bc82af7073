"""What the n-gram Jaccard join leaves on disk, shuffles and pairs on its way."""

import random
import time

import pytest
from pyspark.sql import functions as F
from test_operators import components_by_hand


@pytest.fixture
def rows():
    """Long texts that share a rare passage with a few others, and near copies of some of them."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    texts = [[word() for _ in range(rng.randint(150, 200))] for _ in range(60)]
    for g in range(0, 60, 3):
        passage = [word() for _ in range(12)]
        for w in texts[g : g + 3]:
            w[10:22] = passage
    for w in texts[:12]:
        copy = list(w)
        copy[rng.randrange(30, 100)] = word()
        texts.append(copy)
    return [(i, " ".join(w)) for i, w in enumerate(texts)]


@pytest.mark.parametrize("broadcast", [0, 30, 2_000_000])
def test_unrelated_texts_become_no_pairs(spark, rows, tmp_path, monkeypatch, broadcast):
    from textloom.llm import common
    from textloom.llm import jaccard_join as jj

    monkeypatch.setattr(common, "BROADCAST_ROWS", broadcast)
    folder = f"file://{tmp_path}/steps"
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jj.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90, folder).collect()}
    assert got == components_by_hand(rows, 3, 90)
    pairs = {tuple(sorted(p)) for p in spark.read.parquet(f"{folder}/pairs-0").collect()}
    assert pairs == {(i, 60 + i) for i in range(12)}


def test_a_step_leaves_no_shuffle_files(spark, tmp_path):
    from textloom.llm import jaccard_join as jj

    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {n for n in disk.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in n}
    before = files()
    step = jj._stored(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), f"file://{tmp_path}", "step")
    until = time.time() + 20
    while files() - before and time.time() < until:
        time.sleep(0.2)
    assert not files() - before and step.count() == 7
    assert spark.conf.get(jj.CLEANUP, None) is None


def test_classes_are_no_shuffled_arrays(spark, tmp_path, monkeypatch):
    from textloom.llm import common
    from textloom.llm import jaccard_join as jj

    monkeypatch.setattr(common, "BROADCAST_ROWS", 20)
    at = [*range(200), *range(1 << 33, (1 << 33) + 130)]
    first = {r for r in at if r % 3 == 0 or r % 64 in (0, 1, 62, 63)}
    prints = spark.createDataFrame([(r + 5, "c", 3, [r], r) for r in at], "doc_id long, c string, n long, few array<long>, r long")
    one = spark.createDataFrame([("c", r + 5, r, 1) for r in first], "c string, cid long, r long, copies long")
    got = jj._classes(prints, one, f"file://{tmp_path}")
    assert sorted(r["cid"] for r in got.select("cid").collect()) == sorted(r + 5 for r in first) and got.columns == ["cid", "n", "few"]
    assert "Exchange hashpartitioning" not in got._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("percent", [1, 50, 80, 90, 99, 100])
def test_slack(spark, percent):
    from textloom.llm import jaccard_join as jj

    sizes = spark.range(1, 3000).select(F.col("id").alias("n")).select("n", jj._slack(percent).alias("slack"))
    assert all(r["slack"] == jj.slack(r["n"], percent) >= 0 and jj.prefix_size(r["n"], percent) + r["slack"] <= r["n"] for r in sizes.collect())
