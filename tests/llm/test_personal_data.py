"""Personal data: base spans against the plain patterns, the added ones by examples, EM and the sweep against loops."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.llm import personal_data as pd_

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
YES = [
    ("write to jane.doe (at) example (dot) com today", ["email:9:40"]), ("mail: bob [at] mail.example.org", ["email:6:31"]), ("e-mail eve at example dot com", ["email:7:29"]),
    ("call 030 1234 5678 now", ["phone:5:18"]), ("Tel. (030) 555-1234", ["phone:5:19"]), ("phone: 212-555-0187.", ["phone:7:19"]), ("card 4111.1111.1111.1111", ["card:5:24"]), ("the server 192[.]168[.]1[.]20 answers", ["ip:11:29"]),
    ("host 2001:db8:0:0:0:0:2:1 is up", ["ip:5:25"]), ("IP 2001:db8::2:1 is up", ["ip:3:16"]),
]
NO = ["nothing here", "look at the thing. Com is a word", "at 12:30 we met, 3:2 they won", "version 1:2:3:4:5:6:7:8 of it", "card 4111.1111.1111.1112", "In 1998 the 12 men of 2003-2004 came, pages 100-200", "order id 212-555-0187x", "a::b and std::cd", "x = 10/20/30 40-50", "dotted.words.here and 1.5.2"]
AWKWARD = [None, "", "a@b.c.@d.e..f@g.h", "x@y@z.w a@b", "1.2.3.4.5.6.7.8 256.1.1.1 00255.0.0.0", "4111 1111 1111 1111 4111-1111-1111-1111 4111 1111 1111 1112 123", "+1 (017) 555-7713 +49 (0) 30 1234567 +1 2 +123456789012345678",
           "漢字😀a.b+c@d-e.fg😀 +4930 1234567", "+1 (017) 555-7713 4111111111111111@x.yz 10.0.0.1@h.de", "1 " * 3000 + "a@b" + ".c" * 4000, "a" * 50_000 + "1" * 50_000, "(" * 3000 + "+1" + "(" * 3000 + "5", "1.2.3.4 " * 20_000, "0" * 2000 + "1.0.0.1"]


def base_by_hand(text):
    out = []
    for k, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p[-9:]) > 255 or len(p.lstrip("0")) > 3 for p in m[0].split(".")) or kind == "phone" and not 9 <= len(d) <= 15:
                continue
            if kind == "card" and (not 13 <= len(d) <= 19 or sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10):
                continue
            out.append((k, m.start(), m.end()))
    return sorted(out)


def joined(spans):
    return ",".join(f"{pd_.KINDS[k]}:{s}:{e}" for k, s, e in spans)


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(3)
    texts = AWKWARD + ["".join(rng.choice(["1", "2.", "3", "@", "a", ".b", "-", " ", "+1", "(", "😀", "4111111111111111"]) for _ in range(rng.randint(0, 120))) for _ in range(400)]
    rows = [(i, t, "en", 1, "s", "k") for i, t in enumerate(texts)] + [(3, AWKWARD[3], "en", 1, "s", "k"), (None, "no id a@b.cd", "en", 1, "s", "k")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, kind int, spans string, s string").repartition(4)


def test_base_and_added_spans(spark, docs, sf_dir):
    for df in (docs, spark.read.parquet(f"{sf_dir}/documents.parquet")):
        texts = [(r["doc_id"], r["text"]) for r in df.collect()]
        got = pd_.personal_data(df).collect()
        want = sorted((str(i), joined(base_by_hand(t))) for i, t in texts)
        assert len(got) == len(texts)
        found = sorted((str(r["doc_id"]), r["base_sha256"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) for r in got)
        assert found == sorted((i, hashlib.sha256(b.encode()).hexdigest(), *[len(re.findall(rf"\b{k}:", b)) for k in pd_.KINDS]) for i, b in want)
        for r in got:  # base ones stay; added ones are in order and touch no base span
            base = next(b for i, b in want if i == str(r["doc_id"]) and hashlib.sha256(b.encode()).hexdigest() == r["base_sha256"])
            every, own = [x for x in r["spans"].split(",") if x], [x for x in base.split(",") if x]
            assert set(own) <= set(every) and len(every) - len(own) == r["n_added"]
            place = [(pd_.KINDS.index(k), int(s), int(e)) for k, s, e in (x.split(":") for x in every)]
            assert place == sorted(place)
            if len(every) < 2000:
                mine = [p for p, x in zip(place, every, strict=True) if x not in own]
                assert not any(p[1] < q[2] and q[1] < p[2] for p in mine for q in place if q not in mine)
        if df is not docs:
            assert not any(r["n_added"] for r in got)  # the invented texts hold base spans only
    assert pd_.personal_data(docs.filter("false")).count() == 0


def test_examples(spark, sf_dir):
    rows = spark.createDataFrame([(-k, t) for k, t in enumerate([t for t, _ in YES] + NO, 1)], "doc_id long, text string")
    by_id = {r["doc_id"]: r["spans"] for r in pd_.personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").unionByName(rows)).collect()}
    assert [by_id[-k] for k in range(1, len(YES) + 1)] == [",".join(w) for _, w in YES]
    assert [t for k, t in enumerate(NO, len(YES) + 1) if by_id[-k]] == []


def test_native(docs):
    plan = pd_.candidates(docs.select("doc_id", "text"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_running_and_free(spark):
    from textloom.functions.arrays import running, sums

    rng = random.Random(1)
    arrays = [[rng.randint(-5, 9) for _ in range(n)] for n in (0, 1, 2, 3, 7, 8, 9, 100)]
    df = spark.createDataFrame([(a,) for a in arrays], "a array<long>")
    for r in df.select("a", sums(F.col("a")).alias("s"), running(F.col("a"), lambda x, y: F.greatest(x, y)).alias("m")).collect():
        assert r["s"] == np.cumsum(r["a"]).tolist() and r["m"] == np.maximum.accumulate(np.array(r["a"], int)).tolist()
    spans = [[(s := rng.randint(0, 60), s + rng.randint(1, 9), rng.random() < 0.3) for _ in range(rng.randint(0, 12))] for _ in range(80)]
    df = spark.createDataFrame([(x,) for x in spans], "x array<struct<s:long,e:long,base:boolean>>")
    for r in df.select("x", pd_.free(F.col("x")).alias("y")).collect():
        kept = [(a["s"], a["e"], a["base"]) for a in r["x"] if a["base"] or not any(b["base"] and b["s"] < a["e"] and a["s"] < b["e"] for b in r["x"])]
        assert sorted(map(tuple, r["y"])) == sorted(kept)


def test_em_against_loops():
    rng = np.random.default_rng(2)
    true = rng.random(400) < 0.6
    right = np.array([0.9, 0.7, 0.8, 0.95])
    votes = np.where(rng.random((400, 4)) < right, 1, -1) * np.where(true, 1, -1)[:, None] * (rng.random((400, 4)) < 0.8)
    got, share, table = pd_.em(votes, np.ones(400))
    p, q = pd_.PRIOR_TRUE, [[list(pd_.FALSE_VOTES), list(pd_.TRUE_VOTES)] for _ in range(4)]
    for _ in range(200):
        like = []
        for row in votes:
            a, b = math.log(1 - p), math.log(p)
            for j, v in enumerate(row):
                a, b = a + math.log(q[j][0][1 - v]), b + math.log(q[j][1][1 - v])
            like.append(1 / (1 + math.exp(a - b)))
        p = (sum(like) + pd_.BELIEF / 2) / (400 + pd_.BELIEF)
        for j in range(4):
            for y, prior in enumerate((pd_.FALSE_VOTES, pd_.TRUE_VOTES)):
                w = [x if y else 1 - x for x in like]
                q[j][y] = [(sum(x for x, row in zip(w, votes, strict=True) if 1 - row[j] == v) + pd_.BELIEF * prior[v]) / (sum(w) + pd_.BELIEF) for v in range(3)]
    assert np.allclose(got, like, atol=1e-5) and abs(share - p) < 1e-5 and np.allclose(table, q, atol=1e-5)
    known = (votes * np.log(right / (1 - right))).sum(1) + np.log(0.6 / 0.4) > 0  # what knowing the labelers would give
    assert ((got > 0.5) == true).mean() > (known == true).mean() - 0.06 and table[3, 1, 0] > table[1, 1, 0]  # the better labeler is told from the worse
    alike, share, _ = pd_.em(np.empty((0, 4), int), np.empty(0))
    assert len(alike) == 0 and share == pd_.PRIOR_TRUE
