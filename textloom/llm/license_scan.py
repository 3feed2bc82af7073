"""License scans with a positional rare-token index, in DataFrame expressions only.

The index lists, for the highest-IDF words of each template's key phrase, where the word stands in the template. A file's occurrences of
those words are looked up; each gives the templates that have the word and the place where they would begin. Postings are
intersected by that place: only a template that two rare words of the file put at one and the same place goes on to be verified,
by a key phrase word for word and by the share of its words, weighted by IDF, that stand there or a few words off. All of it happens within
the row: nothing is shuffled but the document counts of the templates' own words.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: Phrases that must be found wherever their words follow each other, and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Fixed values: (label, words of the template, key phrase in it), from the licences' own notices.
TEMPLATES = [
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license", "creative commons attribution"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("gpl-2.0", "licensed under the gnu general public license version 2", "gnu general public license version 2"),
    ("gpl-3.0", "licensed under the gnu general public license version 3", "gnu general public license version 3"),
    ("lgpl", "licensed under the gnu lesser general public license", "gnu lesser general public license"),
    ("agpl", "licensed under the gnu affero general public license", "gnu affero general public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "permission to use copy modify and or distribute this software"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted free of charge"),
    ("mit", "released under the mit license", "mit license"),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
]
#: Whole notices as the licences print them, with their mandatory phrases. Files hold them word for word, perhaps cut at either end.
NOTICES = [
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license", "unless required by applicable law or agreed to in writing"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "included in all copies or substantial portions of the software"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", "redistributions in binary form must reproduce the above copyright notice"),
    ("gpl-2.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose", "either version 2 of the license or at your option any later version"),
    ("gpl-3.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose", "either version 3 of the license or at your option any later version"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness", "the author disclaims all warranties with regard to this software"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0", "if a copy of the mpl was not distributed with this file"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means", "free to copy modify publish use compile sell or distribute this software"),
]
#: Another phrase of each notice of which one has to be there, so that a word put into either doesn't hide the notice.
OTHER_KEYS = {
    "apache-2.0": "you may not use this file except in compliance with the license", "mit": "permission is hereby granted free of charge", "bsd": "redistributions of source code must retain the above copyright notice",
    "gpl-2.0": "license as published by the free software foundation either version 2", "gpl-3.0": "license as published by the free software foundation either version 3",
    "isc": "permission to use copy modify and or distribute this software", "mpl-2.0": "subject to the terms of the mozilla public license", "unlicense": "free and unencumbered software released into the public domain",
}
#: Postings of a template, and how many of them must agree on its place.
RARE, AGREE, LEAST_COVERAGE = 3, 2, 0.6
#: How far words may have moved from their places, by words put in or taken out.
BAND = 4
POSTING = T.ArrayType(T.StructType([T.StructField(n, t) for n, t in (("word", T.StringType()), ("at", T.IntegerType()), ("template", T.IntegerType()), ("key_at", T.IntegerType()))]))
TEMPLATE = T.ArrayType(T.StructType([T.StructField(n, t) for n, t in (
    ("template", T.IntegerType()), ("label", T.StringType()), ("base", T.BooleanType()), ("words", T.ArrayType(T.StringType())), ("weights", T.ArrayType(T.DoubleType())), ("key_at", T.IntegerType()), ("key", T.ArrayType(T.StringType())))]))


def templates() -> list[tuple[str, list[str], int, list[str], bool]]:
    """label, words, where the key phrase begins, key phrase, whether it is one of PHRASES."""
    out = [(label, p.split(), 0, p.split(), True) for p, label in PHRASES.items()]
    for label, text, key in TEMPLATES + NOTICES + [(label, text, OTHER_KEYS[label]) for label, text, _ in NOTICES]:
        w, k = text.split(), key.split()
        out.append((label, w, next(i for i in range(len(w)) if w[i : i + len(k)] == k), k, False))
    return out


def file_words(text: Column) -> Column:
    """Lower-cased words; the words of the templates are plain letters, so other alphabets' case doesn't matter to them."""
    return F.filter(F.split(F.lower(text), NOT_WORD), lambda w: w != "")


def word_idf(docs: DataFrame) -> dict[str, float]:
    """IDF over all documents of the words that templates have: a bounded set, whatever the corpus."""
    known = sorted({w for _, words, _, _, _ in templates() for w in words})
    found = docs.select(F.explode(F.array_intersect(file_words(F.col("text")), F.array(*map(F.lit, known)))).alias("word"))
    n, df = docs.count(), {r["word"]: r["count"] for r in found.groupBy("word").count().collect()}
    return {w: math.log((n + 1) / (df.get(w, 0) + 1)) + 1.0 for w in known}


def index(idf: dict[str, float]) -> tuple[list, list]:
    """Postings of each template's rarest words, and the templates' table."""
    postings, table = [], []
    for k, (label, words, key_at, key, base) in enumerate(templates()):
        rarest = sorted(range(key_at, key_at + len(key)), key=lambda i: (-idf[words[i]], i))[:RARE]
        postings += [(words[i], i, k, key_at) for i in rarest]
        table.append((k, label, base, words, [idf[w] for w in words], key_at, key))
    return postings, table


def _literal(rows: list, kind: T.ArrayType) -> Column:
    """A constant array of structs."""
    def one(value, t):
        if isinstance(t, T.ArrayType):
            return F.array(*[one(v, t.elementType) for v in value])
        if isinstance(t, T.StructType):
            return F.struct(*[one(v, f.dataType).alias(f.name) for v, f in zip(value, t.fields, strict=True)])
        return F.lit(value).cast(t)

    return one(rows, kind)


#: A place is a number below _PLACES: how far a template would begin behind _BEFORE words before the text.
_PLACES, _BEFORE = 1 << 40, 1 << 20


def places(words: Column, idf: dict[str, float]) -> Column:
    """Each place of each template in an array of words: template, label, base, at (words from 0), coverage (0 to 1, by IDF).

    A template may begin before the text does, as when the text opens with its key phrase: the key phrase decides. Its place is then 0, and
    coverage is of the words from there on.
    """
    postings, table = index(idf)
    rare = sorted({w for w, *_ in postings})
    table_col, postings_col = _literal(table, TEMPLATE), _literal(postings, POSTING)
    hits = F.filter(F.transform(words, lambda w, i: F.when(w.isin(*rare), F.struct(w.alias("word"), i.alias("i")))), lambda h: h.isNotNull())
    # One number for a template and the place where it would begin, which may lie before the text.
    begun = F.flatten(F.transform(hits, lambda h: F.transform(F.filter(postings_col, lambda p: (p["word"] == h["word"]) & (h["i"] - p["at"] + p["key_at"] >= 0)), lambda p: p["template"].cast("long") * _PLACES + (h["i"] - p["at"] + _BEFORE))))

    def agreed(sorted_: Column) -> Column:
        """Postings intersected: numbers that stand AGREE times in a row."""
        kept = F.filter(F.transform(sorted_, lambda x, i: F.when((i >= AGREE - 1) & (F.get(sorted_, i - (AGREE - 1)) == x), x)), lambda x: x.isNotNull())
        return F.transform(F.array_distinct(kept), lambda x: F.struct(F.floor(x / _PLACES).cast("int").alias("template"), (x % _PLACES - _BEFORE).cast("int").alias("at")))

    def verified(found: Column) -> Column:
        def one(c):
            def known(t):
                at, own = F.greatest(c["at"], F.lit(0)), t["words"]

                def same(k, d):
                    return F.coalesce(F.get(words, c["at"] + k + d) == F.get(own, k), F.lit(False))

                # A word is there if it stands at its place or a few words off, and so does one beside it.
                there = F.transform(own, lambda _, k: (c["at"] + k >= 0) & F.exists(F.sequence(F.lit(-BAND), F.lit(BAND)), lambda d: same(k, d) & (same(k + 1, d) | same(k - 1, d))))
                covered = F.aggregate(F.zip_with(there, t["weights"], lambda on, v: F.when(on, v).otherwise(F.lit(0.0))), F.lit(0.0), lambda s, v: s + v)
                total = F.aggregate(F.slice(t["weights"], F.greatest(-c["at"], F.lit(0)) + 1, F.size(own)), F.lit(0.0), lambda s, v: s + v)
                key = F.slice(words, c["at"] + t["key_at"] + 1, F.size(t["key"])) == t["key"]
                return F.struct(t["template"].alias("template"), t["label"].alias("label"), t["base"].alias("base"), at.alias("at"), F.when(key, covered / total).alias("coverage"))

            return known(F.element_at(table_col, c["template"] + 1))

        return F.filter(F.transform(found, one), lambda p: p["base"] & p["coverage"].isNotNull() | (p["coverage"] >= LEAST_COVERAGE))

    return F.element_at(F.transform(F.array(F.array_sort(begun)), lambda b: verified(agreed(b))), 1)


def license_scan(df: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, places of each row of df.

    Words are counted from 0 over the whole text. n_base counts all places of PHRASES, first_word and last_word are the smallest and
    largest of their starts (null if there are none). labels also has the templates'; label lists are sorted, distinct, joined by commas, and
    empty if nothing is found. score: the best coverage of a template at a verified place, else 0. Null and empty
    texts have no words. Repeated rows stay, other columns are ignored.
    """
    docs = common.texts(df)
    idf = word_idf(docs)
    found = docs.select("doc_id", F.regexp_count("text", F.lit(WORD)).cast("long").alias("n_words"), F.element_at(F.transform(F.array(file_words(F.col("text"))), lambda w: places(w, idf)), 1).alias("places"))

    def summed(p):
        base = F.filter(p, lambda x: x["base"])
        starts = F.transform(base, lambda x: x["at"])
        names = lambda q: F.array_join(F.array_sort(F.array_distinct(F.transform(q, lambda x: x["label"]))), ",")
        return F.struct(F.size(base).cast("long").alias("n_base"), F.array_min(starts).cast("long").alias("first_word"), F.array_max(starts).cast("long").alias("last_word"), names(base).alias("base_labels"), names(p).alias("labels"), F.coalesce(F.array_max(F.transform(p, lambda x: x["coverage"])), F.lit(0.0)).alias("score"))

    out = found.withColumn("s", F.element_at(F.transform(F.array("places"), summed), 1))
    return out.select("doc_id", "n_words", "s.*", F.transform("places", lambda x: F.struct(x["label"].alias("label"), x["at"].alias("at"), x["coverage"].alias("coverage"))).alias("places"))
