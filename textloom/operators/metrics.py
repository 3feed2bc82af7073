"""Twelve stylometric metrics, their sub-scores, and the fused probability with its verdict.

All numbers that a text gives by itself are counted in its row, in one pass in Arrow batches; so are the words of the library's own short lexicon,
which is at hand in every task. A lexicon of the caller's may be large: its look-ups need the words as rows, one join (broadcast if it is small), then one
aggregation, which carries the row's own numbers along and so shuffles one short row per text.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import batches as batch
from ..functions import lexicon as lx
from ..functions import phrases, tokens

#: The passive's pattern by language, and the weights of the sub-scores (sum 1).
PASSIVE = {
    "en": r"(?i)\b(am|is|are|was|were|be|been|being)\s+[A-Za-z]+(ed|en|own|orn|ought|aught|ade|one)\b",
    "he": "(?<![\\u05D0-\\u05EA])(?:\\u05E0[\\u05D0-\\u05EA]{3,5}|\\u05D4\\u05D5[\\u05D0-\\u05EA]{2,4})(?![\\u05D0-\\u05EA])",
}
WEIGHTS = {"perplexity": 0.14, "burstiness": 0.14, "phrase": 0.16, "passive": 0.06, "transition": 0.08, "vocab": 0.10, "hedge": 0.04, "start": 0.08, "quantifier": 0.06, "pronoun": 0.14}
METRICS = ["perplexity_proxy", "burstiness", "avg_sentence_length", "sentence_length_stdev", "ai_phrase_density", "passive_voice_ratio", "transition_word_frequency", "vocab_diversity", "hedging_ratio", "sentence_start_diversity", "quantifier_overuse", "pronoun_pattern_score"]


def norm(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (value - F.lit(low)) / F.lit(high - low)))


def ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


#: What a row's own pass counts.
_COUNTS = ("n_words", "n_sentences", "distinct_words", "n_starts", "distinct_starts", "passive", "phrase_hits", "quantifier_phrases", "ranks", *lx.FLAGS)
_LENGTHS = ("avg_sentence_length", "sentence_length_stdev")
# English is read as UTF-8: its patterns are of ASCII, which bytes match faster.
_EN_WORD, _EN_END, _EN_BLANK = re.compile(tokens.WORD["en"].replace("A-Z", "").encode()), re.compile(tokens.SENTENCE_END.encode()), b" \t\n\r\f\v"
_EN_PASSIVE = re.compile(PASSIVE["en"].removeprefix("(?i)").replace("A-Z", "").replace("(", "(?:").encode())
_OTHER = re.compile(r"[^\x00-\x7F\W]+")
_HE_WORD, _HE_END, _HE_PASSIVE = re.compile(tokens.WORD["he"]), re.compile(tokens.SENTENCE_END, re.ASCII), re.compile(PASSIVE["he"])


def _passives(raw: bytes) -> int:
    """Passives of a lower-cased English text, in UTF-8. A letter beyond ASCII is part of a word, too: where one stands, bytes only say that there may be a passive."""
    n = len(_EN_PASSIVE.findall(raw))
    if n and not raw.isascii():
        n = len(_EN_PASSIVE.findall(_OTHER.sub(lambda m: "".join("_" if c.isalpha() else c for c in m[0]), raw.decode()).encode()))
    return n


def _spread(n: list[int]) -> tuple[float, float]:
    """Mean and standard deviation."""
    mean = sum(n) / len(n)
    total = 0.0
    for x in n:
        total += (x - mean) * (x - mean)
    return mean, math.sqrt(total / len(n))


def _shape(text: Column, language: Column, lists: dict[str, dict], known: dict[str, dict], sizes: dict[str, int]) -> Column:
    """struct of _COUNTS and _LENGTHS. known: language to word to (rank, flags); lists: machine phrases and quantifiers of several words. Without `known`, neither ranks nor flags count."""
    kinds = [*(f"{c}:long" for c in _COUNTS), *(f"{c}:double" for c in _LENGTHS)]

    @F.arrow_udf(f"struct<{','.join(kinds)}>")
    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        members = phrases.members(lists)
        for texts, languages in batches:
            columns = [[] for _ in kinds]
            for t, lang in zip(texts.to_pylist(), languages.to_pylist(), strict=True):
                if lang == "en":
                    raw = t.encode().lower()
                    pieces, found, passive = [x for x in _EN_END.split(raw) if x.strip(_EN_BLANK)], _EN_WORD.findall, _passives(raw)
                else:
                    pieces, found, passive = [x for x in _HE_END.split(t) if x.strip(" \t\n\r\f\v")], _HE_WORD.findall, len(_HE_PASSIVE.findall(t))
                by_piece = [found(x) for x in pieces]
                words = [w for some in by_piece for w in some]
                mean, deviation = _spread([len(some) for some in by_piece] or [0])
                starts = [some[0] for some in by_piece if some]
                ranks, flags, mine, unknown = 0, [0] * len(lx.FLAGS), known.get(lang, {}), sizes["en" if lang == "en" else "he"] + 1
                for w in words:
                    if x := mine.get(w):
                        ranks += unknown if x[0] is None else x[0]
                        for k in x[1]:
                            flags[k] += 1
                    else:
                        ranks += unknown
                row = (len(words), len(pieces), len(set(words)), len(starts), len(set(starts)), passive, *phrases.counted(t.lower(), members.get(lang), len(lists)), ranks, *flags, mean, deviation)
                for column, x in zip(columns, row, strict=True):
                    column.append(x)
            yield pa.StructArray.from_arrays([pa.array(x, pa.int64() if k < len(_COUNTS) else pa.float64()) for k, x in enumerate(columns)], [*_COUNTS, *_LENGTHS])

    return run(text, language)


def own_words() -> dict[str, dict]:
    """The library's own lexicon, as _shape() looks words up: English ones as bytes."""
    out: dict[str, dict] = {}
    for language, word, rank, *flags in lx.rows():
        out.setdefault(language, {})[word.encode() if language == "en" else word] = (rank, tuple(k for k, x in enumerate(flags) if x))
    return out


def with_shape(df: DataFrame, machine_phrases: dict = lx.MACHINE_PHRASES, quantifiers: dict = lx.QUANTIFIERS, known: dict[str, dict] | None = None) -> DataFrame:
    """Adds n_words, n_sentences, the metrics that need no dictionary of words, and what `known`, as own_words() gives it, says of the words. Phrases by language are parameters."""
    batch.small(df.sparkSession)
    many = {k: [q for q in v if " " in q] for k, v in quantifiers.items()}
    sizes = {k: lx.vocabulary_size(k) for k in ("en", "he")}
    shape = _shape(F.coalesce("text", F.lit("")), F.coalesce("language", F.lit("")), {"machine": machine_phrases, "many": many}, known or {}, sizes)
    df = df.withColumn("_x", shape)
    df = df.withColumns({c: F.col(f"_x.{c}").cast("int") for c in ("n_words", "n_sentences", "phrase_hits", "quantifier_phrases")} | {c: F.col(f"_x.{c}") for c in ("ranks", *lx.FLAGS, *_LENGTHS)})
    df = df.withColumn("burstiness", ratio(F.col("sentence_length_stdev"), F.col("avg_sentence_length")))
    df = df.withColumn("vocab_diversity", ratio(F.col("_x.distinct_words").cast("double"), F.col("n_words")))
    df = df.withColumn("sentence_start_diversity", F.col("_x.distinct_starts") / F.greatest("_x.n_starts", F.lit(1)))
    return df.withColumn("passive_voice_ratio", F.col("_x.passive") / F.greatest("n_sentences", F.lit(1))).drop("_x")


def metrics(df: DataFrame, keys: list[str], keep: list[str] = (), lexicon: DataFrame | None = None, machine_phrases: dict = lx.MACHINE_PHRASES) -> DataFrame:
    """keys, keep, the twelve metrics, n_words, n_sentences of each (text, language) in df; keys identify its rows.

    language is 'en' or 'he'. A text without words has metrics of 0; null texts count as empty. lexicon: words of one's own, as functions.lexicon.lexicon()
    gives them or with_ranks() changes them; machine_phrases: phrases by language.
    """
    df = df.withColumn("text", F.coalesce("text", F.lit("")))
    own = ["n_words", "n_sentences", "burstiness", "avg_sentence_length", "sentence_length_stdev", "vocab_diversity", "sentence_start_diversity", "passive_voice_ratio", "phrase_hits", "quantifier_phrases"]
    if lexicon is None:
        sizes, out = {k: lx.vocabulary_size(k) for k in ("en", "he")}, with_shape(df, machine_phrases, known=own_words())
    else:
        sizes = lx.vocabulary_sizes(lexicon)
        shaped = with_shape(df, machine_phrases).select(*keys, *keep, "language", *own, F.explode_outer(tokens.words(F.col("text"), F.col("language"))).alias("word"))
        joined = shaped.join(lx.small(lexicon), ["language", "word"], "left")
        unknown = F.when(F.col("language") == "en", sizes["en"]).otherwise(sizes["he"]) + 1
        flag = lambda c: F.sum(F.coalesce(F.col(c), F.lit(False)).cast("long")).alias(c)
        # A row's own numbers are keys too: they hang on its keys, and without them as values the aggregation hashes instead of sorting all words.
        out = joined.groupBy(*keys, "language", *keep, *own).agg(F.sum(F.when(F.col("word").isNotNull(), F.coalesce("rank", unknown))).alias("ranks"), *map(flag, lx.FLAGS))
    n = F.col("n_words")
    size = F.when(F.col("language") == "en", sizes["en"]).otherwise(sizes["he"])
    any_word = lambda c: F.when(n == 0, F.lit(0.0)).otherwise(c)
    return out.select(
        *keys, *keep, "language", "n_words", "n_sentences",
        any_word(F.ln(F.col("ranks") / n + 1) / F.ln(size + F.lit(2.0))).alias("perplexity_proxy"),
        *[any_word(F.col(c)).alias(c) for c in ("burstiness", "avg_sentence_length", "sentence_length_stdev")],
        ratio(F.col("is_machine") + 3.0 * F.col("phrase_hits"), n).alias("ai_phrase_density"),
        any_word(F.col("passive_voice_ratio")).alias("passive_voice_ratio"),
        ratio(F.col("is_transition").cast("double"), n).alias("transition_word_frequency"),
        F.col("vocab_diversity"),
        ratio(F.col("is_hedge").cast("double"), n).alias("hedging_ratio"),
        any_word(F.col("sentence_start_diversity")).alias("sentence_start_diversity"),
        ratio(F.col("is_quantifier") + F.col("quantifier_phrases").cast("double"), n).alias("quantifier_overuse"),
        ratio(F.col("is_pronoun").cast("double"), n).alias("pronoun_pattern_score"),
    )


def sub_scores() -> dict[str, Column]:
    """How machine-like each metric is, 0 to 1 (perplexity may dip just below). A text without words: burstiness only."""
    some = lambda c: F.when(F.col("n_words") == 0, F.lit(0.0)).otherwise(c)
    return {
        "perplexity": some(1.0 - F.col("perplexity_proxy")),
        "burstiness": 1.0 - norm(F.col("burstiness"), 0.3, 0.9),
        "phrase": norm(F.col("ai_phrase_density"), 0.0, 0.08),
        "passive": norm(F.col("passive_voice_ratio"), 0.0, 0.6),
        "transition": norm(F.col("transition_word_frequency"), 0.0, 0.035),
        "vocab": some(1.0 - norm(F.col("vocab_diversity"), 0.3, 0.75)),
        "hedge": some(norm(F.col("hedging_ratio"), 0.005, 0.04)),
        "start": some(1.0 - norm(F.col("sentence_start_diversity"), 0.5, 0.95)),
        "quantifier": norm(F.col("quantifier_overuse"), 0.0, 0.04),
        "pronoun": some(1.0 - norm(F.col("pronoun_pattern_score"), 0.0, 0.08)),
    }


def fused() -> Column:
    parts = sub_scores()
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), sum((F.lit(w) * parts[k] for k, w in WEIGHTS.items()), F.lit(0.0))))


def verdict(p: Column) -> Column:
    return F.when(p < F.lit(0.35), "human").when(p < F.lit(0.65), "mixed").otherwise("ai")


def detect(df: DataFrame, keys: list[str], keep: list[str] = (), lexicon: DataFrame | None = None, machine_phrases: dict = lx.MACHINE_PHRASES) -> DataFrame:
    """metrics(), ai_probability and verdict of each row."""
    out = metrics(df, keys, keep, lexicon, machine_phrases).withColumn("ai_probability", fused())
    return out.withColumn("verdict", verdict(F.col("ai_probability")))


#: What a sentence's leading sub-score is called, in the order that breaks ties.
REASONS = [("phrase", "AI phrase density"), ("burstiness", "Low burstiness"), ("perplexity", "Predictable vocabulary"), ("passive", "Passive voice"), ("transition", "Transition overuse"), ("pronoun", "Pronoun pattern")]


#: What a text's leading signals are called, in the order that breaks ties, and the metric of each.
SIGNALS = [("AI phrase density", "ai_phrase_density"), ("Burstiness (low)", "burstiness"), ("Passive voice", "passive_voice_ratio"), ("Transitions", "transition_word_frequency"), ("Hedging", "hedging_ratio")]


def leading_signals(k: int = 3) -> Column:
    """array<struct<name, value>> of a detect() row's k greatest signals, greatest first. Even sentences are a signal, so burstiness counts down from 1."""
    value = lambda m: 1.0 - F.least(F.lit(1.0), F.col(m)) if m == "burstiness" else F.col(m)
    each = F.array(*[F.struct((-value(m)).alias("down"), F.lit(o).alias("o"), F.lit(name).alias("name")) for o, (name, m) in enumerate(SIGNALS)])
    return F.transform(F.slice(F.array_sort(each), 1, k), lambda x: F.struct(x["name"].alias("name"), (-x["down"]).alias("value")))


def top_segments(df: DataFrame, keys: list[str], k: int = 5, lexicon: DataFrame | None = None, machine_phrases: dict = lx.MACHINE_PHRASES) -> DataFrame:
    """The k most machine-like sentences of at least three words of each text: keys, rank, start, end, text, sub_score, reason.

    Ties go to the earlier sentence. start and end are code points of the text. Each task keeps its own k best of a text before they are shuffled, with their text.
    """
    from pyspark.sql.window import Window

    found = df.select(*keys, "language", F.explode(tokens.segments(F.coalesce("text", F.lit("")))).alias("s")).select(*keys, "language", "s.*")
    found = found.filter(F.regexp_count("text", F.lit(r"\S+")) >= 3)
    scored = detect(found, [*keys, "start", "end"], ["text"], lexicon, machine_phrases)
    parts = sub_scores()
    best = F.array_max(F.array(*[F.struct(parts[name].alias("v"), F.lit(-o).alias("o"), F.lit(label).alias("label")) for o, (name, label) in enumerate(REASONS)]))
    scored = scored.select(*keys, "start", "end", "text", F.col("ai_probability").alias("sub_score"), best["label"].alias("reason"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("sub_score"), "start"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= k).select(*keys, "rank", "start", "end", "text", "sub_score", "reason")
