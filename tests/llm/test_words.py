"""Spelling variants and source divergence against brute force, on small tables with awkward rows."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, word string, docs long, term string"


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    rng = random.Random(5)
    letters = ["ab", "cé", "dÿ", "abÉ"]
    texts = [" ".join("".join(rng.choice(rng.choice(letters)) for _ in range(rng.choice([3, 5, 5, 6, 7]))) for _ in range(rng.randint(0, 400))) for _ in range(60)]
    texts += ["abcde " * 50 + "abcdé " * 20 + "abcdee " * 9, "ABCDE×÷x", "mnopqr " * 3 + "mnopqs " * 8 + "mnopts " * 20 + "mnouts " * 50, "x" * 3000 + " " + "x" * 2999, "x" * 3000, "x" * 3000 + " " + "x" * 2999, "x" * 2999, None, "", "1234 5_6", "漢字 абвгд'абвгд", "İstanbul STRASSE ß"]
    rows = [(i, t, ["en", "fr", None, "xx"][i % 4 if i % 9 else 3], [f"s{i % 3}", None][i % 7 == 0], 1, 2, "w", 3, "t") for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, "abcde abcde no id", "en", "s0", 1, 2, "w", 3, "t"), (7, "abcde of another text with the same id", "en", "s0", 1, 2, "w", 3, "t")]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def variants_by_hand(rows):
    count = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    count = {w: n for w, n in count.items() if n >= 3 and len(w) >= 5}
    holes = defaultdict(set)  # words by what a letter less leaves, with the letter's place
    for w in count:
        for k in range(len(w)):
            holes[k, w[:k] + w[k + 1 :]].add(w)
    near = defaultdict(set)
    for (_, short), some in holes.items():
        some = some | ({short} & count.keys())
        for w in some:
            near[w] |= some - {w}
    form = {}
    for w, some in near.items():
        best = min(some, key=lambda v: (-count[v], v), default=None)
        if best is not None and count[best] >= 2 * count[w]:
            form[w] = best
    out = set()
    for w, n in count.items():
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n, len(near[w]), count.get(form.get(w))))
    return out


def test_spelling_variants(spark, docs, sf_dir):
    from textloom.llm.spelling import spelling_variants

    for df in (docs, spark.read.parquet(f"{sf_dir}/documents.parquet")):
        want = variants_by_hand([(r["doc_id"], r["text"]) for r in df.collect()])
        got = [tuple(r) for r in spelling_variants(df).collect()]
        assert len(got) == len(want) and set(got) == want
        assert any(w[1] for w in want) and any(w[1] != w[2] for w in want if w[1]) or df is not docs
    assert spelling_variants(docs.filter("false")).count() == 0


def divergence_by_hand(rows, least=10):
    count, seen, groups = Counter(), defaultdict(set), set()
    for k, (text, lang, source) in enumerate(rows):
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or ""):
            t = "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
            count[lang, source, t] += 1
            seen[lang, t].add(k)
    out = []
    for lang in {g[0] for g in groups}:
        kept, sources = [t for (x, t), some in seen.items() if x == lang and len(some) >= least], sorted(s for x, s in groups if x == lang)
        n = {s: sum(count[lang, s, t] for t in kept) for s in sources}
        p = {(s, t): 1 + 10**9 * (count[lang, s, t] + 2) // (n[s] + 2 * len(kept)) for s in sources for t in kept}
        q = {t: 1 + 10**9 * (sum(count[lang, s, t] for s in sources) + 2) // (sum(n.values()) + 2 * len(kept)) for t in kept}
        for s in sources:
            pairs = [(-sum((p[s, t] - p[o, t]) ** 2 // (p[s, t] + p[o, t]) for t in kept), o.encode()) for o in sources if o != s]
            terms = [(-((p[s, t] - q[t]) ** 2 // (p[s, t] + q[t])), t.encode()) for t in kept if count[lang, s, t] and p[s, t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:10])):
                out += [(lang, s, part, item.decode(), -v, i) for i, (v, item) in enumerate(found, 1)]
    return out


def test_source_divergence(spark, docs, monkeypatch):
    from textloom.llm import source_divergence as sd

    rows = [(r["text"], r["lang"], r["source"]) for r in docs.collect()]
    for least, block, size in ((10, 8192, 12_000_000), (2, 7, 500)):
        monkeypatch.setattr(sd, "TERMS_A_BLOCK", block)
        monkeypatch.setattr(sd, "SLICE_BYTES", size)
        got = [tuple(r) for r in sd.source_divergence(docs, least).collect()]
        want = divergence_by_hand(rows, least)
        assert sorted(got) == sorted(want) and {r[2] for r in got} == {"pair", "term"}
    none = [tuple(r) for r in sd.source_divergence(docs, 1000).collect()]  # no term is kept
    assert sorted(none) == sorted(divergence_by_hand(rows, 1000)) and all(r[4] == 0 for r in none)
    assert sd.source_divergence(docs.filter("false")).count() == 0


def test_slices_of_one_hash_are_told_apart():
    from textloom.llm.source_divergence import grouped, slices

    texts = pa.array(["ab Ab ab", "abc", "", "b漢c ab", "abcab"], pa.large_string())
    data, offsets = np.frombuffer(texts.buffers()[2], np.uint8), np.frombuffer(texts.buffers()[1], np.int64)
    small, begin, end, doc = slices(data, offsets)
    words = [small[a:z].tobytes().decode() for a, z in zip(begin, end, strict=True)]
    assert words == ["ab", "ab", "ab", "abc", "b漢c", "ab", "abcab"] and doc.tolist() == [0, 0, 0, 1, 3, 3, 4]
    for digest in (None, lambda b: 7, len):
        number, first = grouped(small, begin, end, digest)
        assert [words[first[k]] for k in number] == words and len(set(number.tolist())) == len(set(words)) == len(first)


def test_shares_are_exact():
    from textloom.llm.source_divergence import divergence, pair_sums, share

    for count, total, terms in ((0, 0, 1), (9 * 10**14, 4 * 10**15, 10**9), (123456789012, 987654321098765, 7), (5, 5, 1)):
        assert int(share(count, total, terms)) == 1 + 10**9 * (count + 2) // (total + 2 * terms)
    rng = np.random.default_rng(1)
    dense = rng.integers(0, 3, (6, 40))
    dense[2] = 0
    n, p0 = dense.sum(1), share(np.zeros(6, np.int64), dense.sum(1), 40)
    row, column = np.nonzero(dense)
    sums = pair_sums(np.searchsorted(row, np.arange(7)), column, share(dense[row, column], n[row], 40), p0, 40)
    p = share(dense, n[:, None], 40)
    assert (sums == divergence(p[:, None], p[None]).sum(2)).all()
