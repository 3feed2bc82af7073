"""The training-text operators against brute force, the libraries and exact round trips, on small tables with awkward rows."""

import hashlib
import math
import os
import random
import re
import subprocess
import sys
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.llm import common

LONG = "word " * 3000 + "x" * 9000
AWKWARD = [
    (1, "The quick brown fox jumps over the lazy dog and runs off into the deep dark wood."), (2, None), (3, ""), (4, "   \n\t "), (5, "one"),
    (6, "The quick brown fox jumps over the lazy dog and runs off into the deep dark wood."), (7, LONG), (8, "naïve 漢字 😀 text with <|endoftext|> in it  and   blanks "), (9, "Released under the MIT License. Licensed under the Apache License, Version 2.0"), (None, "no id"),
    (10, "THE QUICK brown fox jumps over the lazy dog and runs off into the deep dark wood."), (10, "THE QUICK brown fox jumps over the lazy dog and runs off into the deep dark wood."),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 7, "h") for i, t in AWKWARD], "doc_id long, text string, lang string, source string, n_chars long, n_words long, h string").repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.filter("false")


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_token_counts(docs, none):
    from tokenizers import Tokenizer

    from textloom.llm.token_counts import token_counts

    path = common.tokenizer_path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    got = token_counts(docs, path).collect()
    assert len(got) == len(AWKWARD)
    want = {i: len(lib.encode(t or "", add_special_tokens=False).ids) for i, t in AWKWARD}
    assert all(r["n_tokens"] == want[r["doc_id"]] and r["over_limit"] == (r["n_tokens"] > 512) for r in got)
    assert token_counts(none, path).count() == 0


def test_chunks_never_change_tokens():
    from tokenizers import Tokenizer

    from textloom.llm.bytelevel import CachedEncoder, MergeCounter

    path = common.tokenizer_path("byte_bpe_50k.json")
    lib, rng = Tokenizer.from_file(path), random.Random(3)
    texts = ["".join(rng.choice(" \n\t   \x0b\rab'sS tré1²_-<|endoftext|>漢́\U0001f600 ") for _ in range(rng.randint(0, 40))) for _ in range(2000)]
    want = [e.ids for e in lib.encode_batch(texts, add_special_tokens=False)]
    assert [MergeCounter(path).count(t) for t in texts[:300]] == [len(w) for w in want[:300]]
    assert [np.frombuffer(b, "<u2").tolist() for b in CachedEncoder(path, "<u2").encode_all(texts)] == want


def test_encoder_keeps_to_its_core():
    """Spark deals tasks to cores; the library starts no threads of its own beside them."""
    code = (
        "import os; from textloom.llm import bytelevel, common; e = bytelevel.CachedEncoder(common.tokenizer_path('byte_bpe_50k.json'), '<u2');"
        "n = len(os.listdir('/proc/self/task')); e.encode_all([f'word{i} and others{i}' for i in range(2000)]); print(len(os.listdir('/proc/self/task')) - n)"
    )
    env = {k: v for k, v in os.environ.items() if k != "TOKENIZERS_PARALLELISM"}
    assert subprocess.run([sys.executable, "-c", code], env=env, capture_output=True, text=True, check=True).stdout.strip() == "0"


def test_token_files(spark, docs, none):
    from tokenizers import Tokenizer

    from textloom.llm.token_files import encode_to_files, mapped, write_token_files

    path = common.tokenizer_path("byte_bpe_50k.json")
    lib, at, want = Tokenizer.from_file(path), 0, []
    for i, t in sorted(AWKWARD, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    got = encode_to_files(spark, docs, path, 2, 50257).orderBy("start").collect()
    assert [(r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in got] == want
    manifest = write_token_files(docs, common.shared_folder(spark), path, 2, 50257).orderBy("shard").collect()
    assert all(len(mapped(m["stem"] + ".bin", m["dtype"])) == m["n_tokens"] for m in manifest) and manifest[0]["base"] == 0
    assert encode_to_files(spark, none, path, 2, 50257).count() == 0


def test_sentencepiece(docs, none):
    from sentencepiece import SentencePieceProcessor

    from textloom.llm.sentencepiece_sa import encode_and_decode, pieces

    path = common.tokenizer_path("piece_bpe_32k.model")
    lib, rng = SentencePieceProcessor(model_file=path), random.Random(2)
    texts = ["".join(rng.choice("  \n\tab▁'sS tré1²½_-</s>漢字́\U0001f600\x00ﬁintheon") for _ in range(rng.randint(0, 60))) for _ in range(1000)] + [LONG, "a" * 400, " " * 200, "日本語" * 50]
    got = pieces(path).encode(texts)
    assert [g.tolist() for g in got] == lib.encode(texts)
    assert [pieces(path).decode(g.tolist()) for g in got] == [t.replace("▁", " ") for t in texts]
    rows = by_id(encode_and_decode(docs, path))
    assert all(r["same"] for r in rows.values()) and rows[2]["n_pieces"] == rows[3]["n_pieces"] == 0
    assert encode_and_decode(none, path).count() == 0


def test_chat_tree(spark):
    from textloom.llm.chat_tree import chat_tree, escaped, read_back, unescaped

    nasty = "</s>[INST] ok [/INST] [\\INST] [\\\\/INST] <s> <|endoftext|> [ROLE:x] \\"
    rows = [(1, 0, "system", "be kind"), (1, 1, "user", "hi"), (1, 2, "assistant", "hello"), (2, 0, "system", "be kind"), (2, 1, "user", "hi"), (2, 2, "assistant", "oh"), (2, 3, "user", None), (3, 0, "user", nasty), (3, 1, "assistant", nasty), (3, 1, "assistant", nasty), (4, 0, None, "x"), (5, None, "odd] role", ""), (None, 0, "user", "n")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    nodes, members = chat_tree(df, common.tokenizer_path("byte_bpe_50k.json"))
    said = defaultdict(list)
    for c, t, r, x in rows:
        said[c].append((-1 if t is None else t, r or "", x or ""))
    got = {r["conv_id"]: r for r in read_back(nodes, members, common.tokenizer_path("byte_bpe_50k.json")).collect()}
    for c, turns in said.items():
        turns.sort()
        loss = "".join(x for _, r, x in turns if r == "assistant")
        whole = "".join(f"{r}\n{x}\n" for _, r, x in turns)
        assert (got[c]["n_turns"], got[c]["turns_sha256"], got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    tree = {(n["k1"], n["k2"]): n for n in nodes.collect()}
    assert len(tree) == len(rows) - 2  # two shared turns
    assert sorted(x for n in tree.values() for x in range(n["start"], n["end"])) == list(range(sum(len(n["ids"]) for n in tree.values())))
    paths = defaultdict(list)
    for m in members.orderBy("conv_id", "i").collect():
        paths[m["conv_id"]].append(tree[m["k1"], m["k2"]])
    for path in paths.values():
        for k, n in enumerate(path):
            may = {x for a in n["attends"] for x in range(a["start"], a["end"])}
            assert may == {x for p in path[: k + 1] for x in range(p["start"], p["end"])}
            assert n["position"] == sum(len(p["ids"]) for p in path[:k])
    texts = spark.createDataFrame([(nasty,), (None,), ("",)], "t string")
    assert [r[0] for r in texts.select(unescaped(escaped(F.col("t")))).collect()] == [nasty, None, ""]
    path = common.tokenizer_path("byte_bpe_50k.json")
    assert read_back(*chat_tree(df.filter("false"), path), path).count() == 0
    from tokenizers import Tokenizer

    decode = Tokenizer.from_file(path).decode
    for n in tree.values():  # the ids under the loss mask are the assistant's text, and nothing else is
        assert decode(n["ids"], skip_special_tokens=False) == n["formatted"]
        if n["formatted"].startswith("<s>"):
            assert n["loss_at"] is None
        else:
            assert " " + decode(n["ids"][n["loss_at"] : n["loss_at"] + n["loss_ids"]], skip_special_tokens=False) + " </s>" == n["formatted"]


def test_chat_tree_is_read_through_the_stream(spark):
    """Nodes whose places or intervals are wrong give wrong conversations."""
    from textloom.llm.chat_tree import chat_tree, read_back

    path = common.tokenizer_path("byte_bpe_50k.json")
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"turn {t}" if t < 3 else f"turn {t} of {c}") for c in range(4) for t in range(6)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("k1", F.lit(1)).withColumn("path", F.lit("x"))
    nodes, members = chat_tree(df, path)
    right = {r["conv_id"]: r for r in read_back(nodes, members, path).collect()}
    assert len({r["turns_sha256"] for r in right.values()}) == 4 and all(r["n_turns"] == 6 for r in right.values())
    moved = nodes.withColumn("start", F.col("start") + 1).withColumn("end", F.col("end") + 1)
    assert {r["conv_id"]: r for r in read_back(moved, members, path).collect()} != right


def test_toxicity(spark, docs, none):
    from textloom.llm.toxicity import Matcher, Model, folded, learned, toxicity, without_toxic

    rng = random.Random(4)
    rows, marks = [], []
    for i in range(400):
        words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(rng.randint(5, 80))]
        if i % 4 == 0:
            words[rng.randrange(len(words))] = rng.choice(["zorkface", "ZORKFACE", "z0rkface", "zоrkface"])
        rows.append((i, " ".join(words)))
        marks.append((i, 1, int(i % 4 == 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    model = learned(df, labels)
    got = {r["doc_id"]: r for r in toxicity(df, model).collect()}
    assert all(got[i]["predicted"] == t for i, _, t in marks if zlib.crc32(str(i).encode()) % 5 == 0)
    assert without_toxic(df, labels).count() == 300
    assert folded("Th3 ІDIOT 1d10t") == " the idiot idiot " and Matcher(Model(((" trash ", 9.0),), 1.0, -1.0))("a trash can")[1] == 0
    assert all(0 <= r["score"] <= 1 for r in toxicity(docs, model).collect()) and toxicity(none, model).count() == 0
    assert learned(df, labels.filter("false")).lexicon == ()


def license_by_hand(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    at = sorted((j, label) for p, label in {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}.items() for j in range(len(w)) if w[j : j + len(p.split())] == p.split())
    return len(w), len(at), at[0][0] if at else None, at[-1][0] if at else None, ",".join(sorted({x for _, x in at}))


def test_licenses(spark, none):
    from textloom.llm.license_scan import license_scan

    texts = [t for _, t in AWKWARD] + ["MIT license mit-license MITlicense mit  license", "gnu general public\nlicense general public license", "café MIT License", "mit license " * 2000, "under the GNU Lesser General Public License it is"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in license_scan(df).collect():
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == license_by_hand(texts[r["doc_id"]])
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) | {""} and 0 <= r["score"] <= 1
    assert license_scan(none).count() == 0


def test_licenses_that_open_with_the_key_phrase(spark):
    from textloom.llm.license_scan import TEMPLATES, license_scan

    cut = [(label, " ".join(words[words.index(key) :].split())) for label, words, key in TEMPLATES]
    named = [("apache-2.0", "Apache License\nVersion 2.0, January 2004"), ("lgpl", "GNU Lesser General Public License"), ("mpl-2.0", "Mozilla Public License Version 2.0"), ("mpl-2.0", "of the Mozilla Public License, v. 2.0")]
    texts = [*cut, *named, *((label, f"{text} {'and other words ' * 9}") for label, text in cut)]
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(texts)], "doc_id long, text string")
    for r in license_scan(df).collect():
        label, text = texts[r["doc_id"]]
        assert label in r["labels"].split(",") and r["score"] >= 0.6, text
        assert any(p["label"] == label and p["at"] == 0 for p in r["places"]), text
    # the phrase's end alone isn't the phrase
    assert [(r["labels"], r["score"]) for r in license_scan(spark.createDataFrame([(1, "public license v 2 0"), (2, "commons attribution 4 0 international license")], "doc_id long, text string")).collect()] == [("", 0.0)] * 2


def backoff_by_hand(rows, order):
    words = [t.encode().lower().split() for _, t in rows]
    grams = lambda w: Counter(tuple(w[i : i + n]) for n in range(1, order + 1) for i in range(len(w) - n + 1))
    own = [grams(w) for w in words]
    every = sum(own, Counter())
    n_words, out = sum(map(len, words)), []
    for w, mine in zip(words, own, strict=True):
        total, short = 0.0, 0
        for j in range(len(w)):
            p, used = max(every[(w[j],)] - mine[(w[j],)], 0.5) / max(n_words - len(w), 1), 1
            for n in range(2, min(order, j + 1) + 1):
                g = tuple(w[j - n + 1 : j + 1])
                c, h = every[g] - mine[g], every[g[:-1]] - mine[g[:-1]]
                p, used = (c / h, n) if c > 0 and h > 0 else (0.4 * p, used)
            total, short = total + math.log10(min(p, 1)), short + (used == 1)
        out.append((len(w), total / len(w) if w else None, short))
    return out


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_lm_scores(docs, none, spark, order, monkeypatch):
    from textloom.llm import lm_scoring as lm

    monkeypatch.setattr(lm, "CHUNK_CHARS", 400)  # several chunks and partitions
    monkeypatch.setattr(lm, "GRAMS_PER_PARTITION", 50)
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice("a b c d e f".split()) for _ in range(rng.randint(0, 30)))) for i in range(60)] + [(100, "g h i j"), (101, "g h i j k"), (102, "only here are these words")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("chunk", F.lit("x")).withColumn("round", F.lit(1))
    got = {r["doc_id"]: r for r in lm.lm_scores(df, order).collect()}
    for (i, _), (n, score, short) in zip(rows, backoff_by_hand(rows, order), strict=True):
        assert (got[i]["n_tokens"], got[i]["n_backoff"]) == (n, short) and (got[i]["score"] is None if score is None else abs(got[i]["score"] - score) < 1e-9)
    if order == 3:
        assert lm.lm_scores(docs).count() == len(AWKWARD) and lm.lm_scores(none).count() == 0


def test_packing():
    from textloom.llm.lm_scoring import packed, packed_sorted, unpacked, unpacked_sorted

    r = np.random.default_rng(1)
    for n in (0, 1, 1000):
        x, c = np.unique(r.integers(0, 2**64 - 1, n, np.uint64)), r.integers(0, 2**32 - 1, n, np.uint32)
        assert (unpacked_sorted(packed_sorted(x)) == x).all() and (unpacked(packed(c), "<u4") == c).all()


def test_what_chunks_send_is_small():
    """Texts without repeats and small numbers are sent by their entropy: LZ4, which Spark shuffles with, would leave both as they are."""
    from textloom.llm.lm_scoring import packed, squeezed, unpacked, unsqueezed

    r = np.random.default_rng(2)
    text = "".join(r.choice(list("etaoinsh rdlu"), 3000)).encode()
    totals = np.minimum(r.geometric(0.5, 20_000), 200).astype("<u4")
    assert len(squeezed(text)) < 0.6 * len(text) and len(packed(totals)) < 0.5 * len(totals)
    for x in (text, b"", "x\x00漢😀".encode()):
        assert unsqueezed(squeezed(x)) == x
    assert (unpacked(packed(totals), "<u4") == totals).all()


def edits_fit(code, item, w, e):
    for s in range(len(item) - w + 1):
        row = [0] * (len(code) + 1)
        for a in range(w):
            new = [row[0] + 1]
            for j in range(1, len(code) + 1):
                new.append(min(row[j - 1] + (code[j - 1] != item[s + a]), row[j] + 1, new[-1] + 1))
            row = new
        if min(row) <= e:
            return True
    return False


def test_decontamination(spark, docs, none):
    from textloom.llm.decontaminate import contaminated, index, matches, plain, without_benchmark

    rng = random.Random(9)
    for _ in range(12):
        item = " ".join("".join(rng.choice("abcdef") for _ in range(5)) for _ in range(rng.choice([12, 22])))
        changed = list(item)
        for _ in range(rng.randint(2, 14)):
            j = rng.randrange(len(changed))
            changed[j] = rng.choice(["", "x", "yz", changed[j] + "q"])
        x = index([(1, item)])
        text = "foo bar " + "".join(changed) + " baz"
        assert bool(matches(text, x)) == edits_fit(plain(text)[0], x.parts[0].codes[0], int(x.parts[0].window[0]), int(x.parts[0].edits[0]))
    passage = AWKWARD[0][1]
    bench = spark.createDataFrame([(1, passage.upper().replace(" ", "  ")), (2, None), (3, ""), (4, "...")], "item_id long, text string")
    assert sorted((r["doc_id"], r["item_id"]) for r in contaminated(docs, bench).collect()) == [(1, 1), (6, 1), (10, 1), (10, 1)]
    kept = without_benchmark(docs, bench)
    assert kept.columns == docs.columns and kept.count() == len(AWKWARD) - 4
    assert contaminated(none, bench).count() == 0 and contaminated(docs, bench.filter("false")).count() == 0


def components_by_hand(rows, k, percent):
    def shingles(t):
        w = (t or "").encode().lower().split()
        return frozenset([tuple(w)] if 0 < len(w) < k else zip(*[w[i:] for i in range(k)], strict=False)) if w else frozenset()

    sets, parent = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_decontamination_of_short_items(spark):
    """Items of any length are found: short ones by shorter q-grams, the shortest as whole words; against plain edit distance."""
    from textloom.llm.decontaminate import SHORT_Q, budget, index, matches, plain

    assert [m[0] for m in matches("say abc def g and hello wor there", index([(1, "abc def g"), (2, "hello wor"), (3, "AND!"), (4, "her"), (5, "say"), (6, "there")]))] == [1, 2, 3, 5, 6]
    rng = random.Random(2)
    for _ in range(60):
        n = rng.randint(SHORT_Q, 60)
        item = "".join(rng.choice("abcdef ") for _ in range(n)).strip() or "abcdef"
        changed = list(item)
        for _ in range(rng.randint(0, 5)):
            j = rng.randrange(len(changed))
            changed[j] = rng.choice(["", "x", "yz", changed[j] + "q"])
        text = "foo bar " + "".join(changed) + " baz"
        code = plain(item)[0]
        code = code[:-1] if len(code) and code[-1] == 32 else code
        if len(code) >= SHORT_Q:
            assert bool(matches(text, index([(1, item)]))) == edits_fit(plain(text)[0], code, *budget(len(code))), (item, text)


def test_decontamination_in_blocks(spark):
    from textloom.llm.decontaminate import find

    items = [(i, f"item {i} asks what number {i * 7919} and word {chr(97 + i % 26) * 5} have to do with each other in the end") for i in range(12)]
    bench = spark.createDataFrame([*items, (99, None), (100, ""), (101, "...")], "item_id long, text string")
    docs = spark.createDataFrame([(i, f"before it {t} after it", "kept") for i, t in items] + [(50, None, "x"), (51, "nothing here", "y")], "doc_id long, text string, found string")
    for chars in (10**6, 200):
        got = {r["doc_id"]: [m["item_id"] for m in r["found"]] for r in find(docs, bench, chars).collect()}
        assert all(i in got[i] for i, _ in items) and got[50] == got[51] == []


@pytest.mark.parametrize("k, percent", [(3, 90), (5, 80)])
def test_jaccard_join(spark, none, k, percent, monkeypatch):
    from textloom.llm import jaccard_join as jj

    monkeypatch.setattr(jj, "FEW", 4)
    monkeypatch.setattr(jj, "BLOCK", 8)
    rng = random.Random(k)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    base, shared = [word() for _ in range(120)], [word() for _ in range(40)]
    rows = [(0, " ".join(base)), (1, None), (2, ""), (3, "a b"), (4, "A  b"), (5, "a")]
    for i in range(6, 60):  # near copies of one text, and texts that share a passage
        w = list(base) if i % 2 else [*(word() for _ in range(rng.randint(2, 80))), *shared]
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = word()
        rows.append((i, " ".join(w)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jj.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), k, percent).collect()}
    assert got == components_by_hand(rows, k, percent)
    assert jj.jaccard_join(none, k, percent).count() == 0


def test_one_of_each(docs):
    from textloom.llm.jaccard_join import one_of_each

    kept = one_of_each(docs, 5, 80)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect()) == [(False, i) for i in (1, 2, 3, 4, 5, 7, 8, 9)] + [(True, 0)]


def test_components(spark):
    from textloom.llm.components import components

    rng = random.Random(1)
    links = [(i, i + 1) for i in range(100, 160)] + [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(30)]
    parent = {x: x for p in links for x in p}
    for _ in range(200):
        for a, b in links:
            parent[a] = parent[b] = min(parent[a], parent[b])
    got = {r["id"]: r["component_id"] for r in components(spark.createDataFrame(links, "a long, b long"), common.shared_folder(spark)).collect()}
    assert got == {x: p for x, p in parent.items() if x in got} and set(got) >= {x for a, b in links if a != b for x in (a, b)}


def winnow_by_hand(text, k, w):
    """Kept (hash, position): the cyclic polynomial rolled along the text, the least of each window by its upper 33 bits, rightmost of equal ones."""
    import xxhash

    turn = lambda x, by: ((x << by % 64) | (x >> (64 - by % 64))) & (2**64 - 1) if by % 64 else x
    signed = lambda x: x - 2**64 if x >> 63 else x
    s = re.sub(r"[ \t\n\x0b\f\r]+", "", text or "")
    letters = [xxhash.xxh64_intdigest(c.encode(), 42) for c in s]
    if not s:
        return []
    if len(s) < k:
        found = [signed(xxhash.xxh64_intdigest(s.encode(), 42))]
    else:
        now, found = 0, []
        for i, x in enumerate(letters):
            now = turn(now, 1) ^ x ^ (turn(letters[i - k], k) if i >= k else 0)
            if i >= k - 1:
                found.append(signed(turn(now, 1 - k)))
    out = []
    for i in range(max(1, len(found) - w + 1)):
        window = found[i : i + w]
        least = min(x >> 31 for x in window)
        at = i + max(j for j, x in enumerate(window) if x >> 31 == least)
        if not out or out[-1][1] != at:
            out.append((found[at], at))
    return out


@pytest.mark.parametrize("k, w", [(16, 8), (5, 3), (7, 1), (1, 6), (12, 4)])
def test_winnowing(spark, k, w):
    from textloom.llm.winnowing import winnowed

    r = random.Random(3)
    texts = [t for _, t in AWKWARD] + ["abcdefghijklmno", "abcdefghijklmnop", "abcdefghijklmnopq", "a" * 60, "ab" * 40, "漢字😀" * 20] + ["".join(r.choice("abc d\n") for _ in range(r.randint(0, 300))) for _ in range(30)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("t", F.coalesce("text", F.lit("")))
    got = {x["doc_id"]: [tuple(v) for v in x["kept"]] for x in df.select("doc_id", winnowed(F.col("t"), k, w).alias("kept")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == winnow_by_hand(t, k, w), (i, k, w)


def test_winnowing_reads_each_place_once(spark):
    """A kept value's place is taken out of its low bits once, not anew wherever it is used: all of this is done for each element."""
    from textloom.llm.winnowing import _MASK, winnowed

    plan = spark.range(1).select(winnowed(F.col("id").cast("string")))._jdf.queryExecution().optimizedPlan().toString()
    assert 1 <= plan.count(str(_MASK)) <= 4


def test_winnowing_evaluates_nothing_twice(spark, docs):
    """A letter is hashed once, not for each shift of its turn; a row's sets of hashes, and where it differs from its edited text, are made once."""
    from textloom.llm.winnowing import edited_fingerprints, winnowed

    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    with_limits = {"spark.sql.maxPlanStringLength": "1000000", "spark.sql.debug.maxToStringFields": "1000"}
    for name, value in with_limits.items():
        spark.conf.set(name, value)
    try:
        assert plan(spark.range(1).select(winnowed(F.col("id").cast("string")).alias("kept"))).count("xxhash64(") == 2  # of letters, and of a short text
        whole = plan(edited_fingerprints(docs))
    finally:
        for name in with_limits:
            spark.conf.unset(name)
    assert (whole.count("array_intersect("), whole.count("array_position(")) == (2, 1)


def test_winnowing_around_a_window(spark):
    """Texts of one gram, of one window, of one more and of one less, and grams longer than a turn of 64 bits."""
    from textloom.llm.winnowing import winnowed

    r = random.Random(6)
    for k, w in ((16, 8), (64, 3), (65, 8), (66, 2), (130, 5)):
        texts = ["".join(r.choice("abcé😀 ") for _ in range(2 * k + w)) for _ in range(3)]
        texts = [t[:n] for t in ("".join(x.split()) for x in texts) for n in (0, 1, k - 1, k, k + 1, k + w - 2, k + w - 1, k + w, len(t))]
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        for x in df.select("doc_id", "text", winnowed(F.col("text"), k, w).alias("kept")).collect():
            assert [tuple(v) for v in x["kept"]] == winnow_by_hand(x["text"], k, w), (k, w, len(x["text"]))


def test_edited_fingerprints(spark, docs, none):
    from textloom.llm.winnowing import K, W, digest, edited_fingerprints, winnowed

    r = random.Random(4)
    rows = [(i, t) for i, t in AWKWARD if i is not None][:-1]
    rows += [(1000 + i, "".join(r.choice("abcdef gh") for _ in range(r.randint(0, 400)))) for i in range(120)]
    rows += [(2000 + i, "".join(r.choice("ab ") for _ in range(r.randint(0, 90)))) for i in range(120)] + [(3000 + i, " " * (i % 3 * 30) + "aab" * i) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kept", F.lit(1)).withColumn("next", F.lit("x")).withColumn("h", F.lit(2))
    order = sorted(((i, t or "") for i, t in rows), reverse=True)
    edits = {i: t[: len(t) - len(t) // 2] + order[(j + 1) % len(order)][1][: len(t) // 2] for j, (i, t) in enumerate(order)}
    found = by_id(edited_fingerprints(df))
    direct = {x[0]: x[1] for x in spark.createDataFrame(list(edits.items()), "doc_id long, text string").select("doc_id", digest(winnowed(F.col("text")))).collect()}
    like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    for j, (i, t) in enumerate(order):
        one, two, three = ({h for h, _ in winnow_by_hand(x, K, W)} for x in (t, edits[i], order[(j + 1) % len(order)][1]))
        got = found[i]
        assert (got["n_chars"], got["edited_sha256"], got["edited_fingerprint"]) == (len(t), hashlib.sha256(edits[i].encode()).hexdigest(), direct[i])
        assert (got["near_edited"], got["near_next"], got["n_kept"]) == (pytest.approx(like(one, two)), pytest.approx(like(one, three)), len(one))
        assert t != edits[i] or got["fingerprint"] == got["edited_fingerprint"]
    assert found[1]["fingerprint"] == found[6]["fingerprint"]
    assert edited_fingerprints(docs).count() == len(AWKWARD) and edited_fingerprints(none).count() == 0


def test_winnowing_wherever_a_passage_stands(spark):
    from textloom.llm.winnowing import K, W, fingerprints

    r = random.Random(5)
    runs = ["".join(chr(r.randrange(0x4E00, 0x9000)) for _ in range(300)), "".join(r.choice("abcdefghij/+=0123") for _ in range(300)), "".join(r.choice("漢😀字🎉x") for _ in range(300)), "words of a text that is put in anew, " * 3]
    rows = [(10 * i + j, front + t) for i, t in enumerate(runs) for j, front in enumerate(("", "x", "😀", "xyz "))]
    rows += [(100 + j, front + runs[0][120 : 120 + K + W - 1]) for j, front in enumerate(("", "q"))]
    got = {f["doc_id"]: dict(zip(f["positions"], f["hashes"], strict=True)) for f in fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in enumerate(runs):
        n, kept = len("".join(t.split())) - K + 1, got[10 * i]
        for j, shift in ((1, 1), (2, 1), (3, 3)):
            both = {p for p, h in kept.items() if got[10 * i + j].get(p + shift) == h}
            assert all(both & set(range(a, a + W)) for a in range(n - W + 1)), (i, j)
    assert all(set(got[100 + j].values()) & set(got[k].values()) for j in (0, 1) for k in (0, 1, 2, 3))


def test_ids_beyond_doubles(spark):
    """A null id beside them doesn't make whole numbers inexact."""
    from textloom.llm import jaccard_join, lm_scoring, sentencepiece_sa, token_counts, token_files, toxicity

    big = 2**53 + 1
    df = spark.createDataFrame([(big, "some words that stand here"), (None, "other words"), (-big, None)], "doc_id long, text string").coalesce(1)
    bpe, piece = common.tokenizer_path("byte_bpe_50k.json"), common.tokenizer_path("piece_bpe_32k.model")
    model = toxicity.Model(((" words ", 1.0),), 1.0, 0.0)
    found = {
        "op1": sentencepiece_sa.encode_and_decode(df, piece), "op2": token_files.encode_to_files(spark, df, bpe, 2, 50257), "op4": toxicity.toxicity(df, model),
        "op6": lm_scoring.lm_scores(df), "op8": jaccard_join.jaccard_join(df, 3, 90), "op9": token_counts.token_counts(df, bpe),
    }
    for name, rows in found.items():
        assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in rows.collect()) == [(False, -big), (False, big), (True, 0)], name


def toxicity_by_hand(text, model):
    from textloom.llm.toxicity import folded

    words, exact = folded(text).split(), {f.strip(): w for f, w in model.lexicon if f.endswith(" ")}
    begin = {f.strip(): w for f, w in model.lexicon if not f.endswith(" ")}
    excused = {i for e in model.exceptions for i in range(len(words)) for j in range(len(e.split())) if words[i - j : i - j + len(e.split())] == e.split() and i >= j}
    total = hits = 0
    for i, w in enumerate(words):
        weights = ([exact[w]] if w in exact else []) + [v for b, v in begin.items() if w.startswith(b)]
        if weights and i not in excused:
            total, hits = total + max(weights), hits + 1
    x = model.slope * total / (1 + math.log1p(len(words) / 200)) + model.bias
    return 1 / (1 + math.exp(-max(-30, min(30, x)))), hits, len(words)


def test_toxicity_against_hand(spark):
    from textloom.llm.toxicity import EXCEPTIONS, Model, folded, toxicity

    assert [folded(t).strip() for t in ("You 1d10t!", "М0r0n", "ＳＣＵＭ", "year 2024 b4", "@ss $cum!!")] == ["you idiot", "moron", "scum", "year 2024 ba", "ass scum"]
    model = Model(((" idiot ", 2.0), (" moro", 1.5), (" moron ", 2.5), (" trash ", 1.0), (" scum ", 3.0)), 0.9, -1.0)
    r, pool = random.Random(8), "you idiot 1diot idiots moronic m0ron trash can bin scum hello there the a Моrоn".split()
    texts = [" ".join(r.choice(pool) for _ in range(r.randint(0, 40))) for _ in range(150)] + list(EXCEPTIONS) + ["", None]
    got = {x["doc_id"]: x for x in toxicity(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    for i, t in enumerate(texts):
        score, hits, words = toxicity_by_hand(t or "", model)
        assert (got[i]["n_hits"], got[i]["n_words"]) == (hits, words) and abs(got[i]["score"] - score) < 1e-12 and got[i]["predicted"] == (score >= 0.5), t


def test_lexicon_against_hand(spark, sf_dir):
    from textloom.llm.toxicity import FALSE_SHARE, LEAST_PRECISION, chance, features, held_out, learned, weight

    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = {r["text"]: 0 for r in docs.join(labels.filter(~held_out()), "doc_id").select(F.coalesce("text", F.lit("")).alias("text")).collect()}
    for r in docs.join(labels.filter(~held_out()), "doc_id").select(F.coalesce("text", F.lit("")).alias("text"), "toxic").collect():
        rows[r["text"]] = max(rows[r["text"]], r["toxic"])
    n = Counter(rows.values())
    toxic, clean = Counter(), Counter()
    for t, y in rows.items():
        (toxic if y else clean).update(features(t))
    p = {f: chance(c, clean[f], n[1], n[0]) for f, c in toxic.items()}
    ranked = sorted(p.values())
    limit = max((x for k, x in enumerate(ranked, 1) if x * len(p) <= FALSE_SHARE * k), default=-1.0)
    want = {(f, weight(c, clean[f], n[1], n[0])) for f, c in toxic.items() if p[f] <= limit and c >= LEAST_PRECISION * (c + clean[f])}
    assert want and set(learned(docs, labels).lexicon) == want


def test_pipeline_of_awkward_tables(spark, tmp_path):
    """Null and empty texts, repeated rows and ids, extra columns, labels and benchmark without rows: through run(), stage by stage from stored tables."""
    import corpus_pipeline

    long = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(1, long, "x"), (2, long, "y"), (2, long, "y"), (3, None, "n"), (4, "", "e"), (None, "no id here at all", "z"), (5, long + " thirteen", "v"), (6, "quite another text, by itself", "w")]
    spark.createDataFrame(rows, "doc_id long, text string, piece_ids string").withColumn("found", F.lit(1)).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(9, "quite another text, by itself"), (10, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got) == [(False, 1), (False, 3), (False, 4), (True, 0)]
    assert all(r["decoded"] == (r["text"] or "") for r in got) and [len(r["piece_ids"]) for r in got if not r["text"]] == [0, 0]
    empty = tmp_path / "empty"
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(str(tmp_path / f"{name}.parquet")).filter("false").write.parquet(str(empty / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(empty)).count() == 0


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    left = docs
    for name, stage in corpus_pipeline.STAGES:
        left = stage(spark, left, sf_dir)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert left.columns == docs.columns
    rows = left.collect()
    assert 0 < len(rows) < docs.count() and all(r["decoded"] == r["text"] for r in rows)
    bench = [r["text"] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert not any(b in r["text"] for r in rows for b in bench)
    toxic = {r["doc_id"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").filter("toxic = 1").collect()}
    insult = re.compile(r"\b(idiot|moron|scum|stupid)\b")
    assert not [r["doc_id"] for r in rows if r["doc_id"] in toxic and len(insult.findall(r["text"])) > 2]
