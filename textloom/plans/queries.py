"""Registered queries of the text-analytics operators, each with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..functions import phrases, tokens
from ..operators import admission as adm
from ..operators import hidden, intervals, lines, metrics, render, rewrite, rules, scorer, sentences, swaps
from ..sources import documents as src
from . import workflows

#: The stored documents lack most of what the operators look for: rows with something put in stand beside them, by doc_id, in Spark and in SQL alike.
INJECTED = {
    0: "'The \u0007bell, \u00ADⅠ and ａbc – so we say, ＡＢ for 10–20 or 30 – 40,  twice   \u2064over and Ⅷ times. ' || text",
    1: "'Moreover, this is fine. Furthermore, we leverage robust plans in order to help. ' || text",
    2: "text || ' It might possibly be a comprehensive plan, perhaps. It was broken and they were taken by several people and a lot of others.'",
    3: "substring(text, 1, 12) || '\u200B' || substring(text, 13, 8) || '\u00A0' || substring(text, 21, 9) || '\uFEFF' || substring(text, 30) || '\u200E'",
    4: "text || ' It was good — very good. Sold 12500 and 8000 units in 2026'",
    5: "'# The Big Plan\n1. First Part\n- a longer list item that ends here with many words in it.\nMeta Title (12 characters): the body\n> quoted words stand here and go on for quite some time.\n\n' || text",
    6: "text || ' See https://example.org/a_b and `co\u200Bde here`, [a\u00AD link](https://x.org/y_(z)), @someone and #topic (see 12).'",
    7: "'12 + 30 = 42?!'",
    8: "'It is important to note that data plays a crucial role. It is due to the fact that things that actually work serve us. ' || text",
    9: "'It isn''t just about speed,or a deep look; it''s about trust. Here 0012500 and 00123 were sold. At the end of the day, we harness the power of data. ' || text",
}
#: Behind them stands something that each rewriting rule has work with: a tenth of the rules in each.
_SAMPLES = [f"{rules.sample(r)} it goes on from here." for r in (*rules.TELLS, *rules.PHRASES, *rules.FILLERS, *rules.HACKY)]
INJECTED = {k: f"{x} || ' So it was. " + " ".join(_SAMPLES[k::10]).replace("'", "''") + "'" if k != 7 else x for k, x in INJECTED.items()}
HEBREW = [
    "חשוב לציין כי המוצר הזה הוא מקיף. אולי נראה אותו מחר, אולם לא היום. אנחנו רוצים לראות הרבה דברים.",
    "הדוח המקיף נכתב בידי צוות גדול. הוא נשלח אתמול. ייתכן שהמחיר מכריע, ולכן נמתין.",
    "בעידן של היום הכול מהיר. אני חושב שזה חשוב. לפיכך כדאי להטמיע את התהליך המורכב לאט.",
    "כמה אנשים באו. רבים מהם נשארו! האם הם יחזרו? כנראה שכן, אבל מי יודע.",
    "המערכת הוטמעה בשנה שעברה. היא נבדקה שוב ושוב. בנוסף נמצאו בה מספר תקלות.",
    "שלום",
    "לכאורה הכול פשוט. אך כשבוחנים את הפרטים, רואים עד כמה הנושא מורכב ומכריע. מגוון דעות נשמע.",
    "היא אמרה לו. הוא אמר לה. הם אמרו להם. אנחנו שתקנו, ואתם הקשבתם.",
    "פרק ראשון\nבפרק הזה נדבר על העיר הגדולה והמהירה. חשוב לציין שהיא גדולה, וחשוב לזכור זאת.\n- סעיף אחד ארוך שיש בו הרבה מילים על נושא אחד בלבד.",
    "ד\"ר כהן הגיע ב-12 בינואר. הפגישה נקבעה לשעה 10. בפרט נדון במחיר המקיף, שהוסכם מראש, ובמועד שנקבע.",
]
_CASES = " ".join(f"WHEN {k} THEN {v}" for k, v in INJECTED.items())
TEXT = f"CASE CAST(doc_id % 10 AS INT) {_CASES} ELSE text END"
_HEBREW_SQL = "[" + ", ".join("'" + t.replace("'", "''") + "'" for t in HEBREW) + "][CAST(doc_id % 10 AS INT) + 1]"
_READ_AS = "CASE WHEN lang = 'he' THEN 'he' ELSE 'en' END"
#: Every stored document with its own text, all languages but Hebrew read as English; the texts with something put in are rows beside them.
_SQL_DOCS = f"""docs AS (SELECT doc_id, text, {_READ_AS} AS language, source FROM documents UNION ALL SELECT -1 - doc_id, {TEXT}, 'en', source FROM documents WHERE lang = 'en'
 UNION ALL SELECT -1 - doc_id, {_HEBREW_SQL}, 'he', source FROM documents WHERE lang <> 'en')"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _spark_text() -> str:
    """TEXT as Spark's SQL writes it."""
    return TEXT.replace("\n", "\\n").replace("''", "\\'")


def whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of documents with their own texts; below them, under negative ids, a row for each with a text that the operators have work with."""
    docs = table(spark, sf_dir, "documents")
    beside = docs.select(F.expr("-1 - doc_id").alias("doc_id"), F.when(F.col("lang") == "en", F.expr(_spark_text())).otherwise(F.element_at(F.array(*map(F.lit, HEBREW)), (F.col("doc_id") % 10).cast("int") + 1)).alias("text"), F.when(F.col("lang") == "en", "en").otherwise("he").alias("language"), "source", "lang")
    return docs.select("doc_id", "text", F.expr(_READ_AS).alias("language"), "source").unionByName(beside.filter("lang IS NOT NULL").drop("lang"))


#: Blanks of all kinds, for RE2.
_WHITE = r"[\t-\r \x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def _q(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def _by_language(f) -> str:
    return f"CASE WHEN language = 'en' THEN {f('en')} ELSE {f('he')} END"


# Validation and counts


def validate_docs(spark, sf_dir):
    docs = src.with_options(table(spark, sf_dir, "documents").withColumn("language", F.col("lang")))
    return docs.select("doc_id", F.coalesce(src.rejection(), F.lit("ok")).alias("reason"), F.char_length("text").cast("long").alias("chars"), F.regexp_count("text", F.lit(r"\S+")).cast("long").alias("words"))


VALIDATE = f"""SELECT doc_id, CASE WHEN text IS NULL OR length(text) = 0 THEN 'empty' WHEN length(text) > {src.HARD_CAP} THEN 'too_long' WHEN NOT regexp_matches(text, '\\S') THEN 'blank'
 WHEN lang NOT IN ('en', 'he') THEN 'language' WHEN length(text) > {src.DEFAULT_CAP} THEN 'over_cap' ELSE 'ok' END AS reason, CAST(length(text) AS BIGINT) AS chars, CAST(len(regexp_extract_all(text, '\\S+')) AS BIGINT) AS words FROM documents"""

#: Hebrew words are whole runs of letters, so the passive's pattern is one of words.
_HE_PASSIVE = "נ[א-ת]{3,5}|הו[א-ת]{2,4}"
_WORDS = "CASE WHEN language = 'en' THEN list_transform(regexp_extract_all({0}, '[A-Za-z'']+'), lambda x: lower(x)) ELSE regexp_extract_all({0}, '[א-ת]+') END"
_COUNT = "CASE WHEN language = 'en' THEN len(regexp_extract_all({0}, '[A-Za-z'']+')) ELSE len(regexp_extract_all({0}, '[א-ת]+')) END"


def _shape_sql(source: str) -> str:
    """CTEs from `source` (doc_id, text, language, ...) to `shaped`: one row per doc_id with lists."""
    return f"""cut AS (SELECT *, {_WORDS.format("text")} AS w, list_filter(list_transform(regexp_split_to_array(text, '[.!?]+\\s+'), lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: s <> '') AS s FROM {source}),
shaped AS (SELECT *, len(w) AS n_words, len(s) AS n_sentences, CASE WHEN len(s) = 0 THEN [len(w)] ELSE list_transform(s, lambda x: {_COUNT.format("x")}) END AS l,
 list_filter(list_transform(s, lambda x: lower(CASE WHEN language = 'en' THEN regexp_extract(x, '[A-Za-z'']+') ELSE regexp_extract(x, '[א-ת]+') END)), lambda x: x <> '') AS starts FROM cut)"""


def _occurrences_sql(phrases) -> str:
    return " + ".join(f"((length(lower(text)) - length(replace(lower(text), '{p.replace(chr(39), chr(39) * 2)}', ''))) // {len(p)})" for p in phrases) or "0"


def token_stats(spark, sf_dir, texts=whole):
    found = metrics.with_shape(texts(spark, sf_dir), {}, {})
    r = lambda c: F.round(c, 6).alias(c)
    return found.select("doc_id", F.col("n_words").cast("long").alias("n_words"), F.col("n_sentences").cast("long").alias("n_sentences"), r("avg_sentence_length"), r("sentence_length_stdev"), r("burstiness"), r("vocab_diversity"), r("sentence_start_diversity"))


TOKEN_STATS = f"""WITH {_SQL_DOCS}, {_shape_sql("docs")}
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(n_sentences AS BIGINT) AS n_sentences, round(list_avg(l), 6) AS avg_sentence_length, round(list_aggregate(l, 'stddev_pop'), 6) AS sentence_length_stdev,
 round(CASE WHEN list_avg(l) = 0 THEN 0 ELSE list_aggregate(l, 'stddev_pop') / list_avg(l) END, 6) AS burstiness, round(CASE WHEN n_words = 0 THEN 0 ELSE len(list_distinct(w)) / CAST(n_words AS DOUBLE) END, 6) AS vocab_diversity,
 round(len(list_distinct(starts)) / CAST(greatest(len(starts), 1) AS DOUBLE), 6) AS sentence_start_diversity FROM shaped"""


def _lexicon_sql() -> str:
    known: dict[tuple[str, str], list] = {}
    for language in ("en", "he"):
        for i, w in enumerate(lx.FREQUENT[language], 1):
            known.setdefault((language, w), ["NULL", 0, 0, 0, 0, 0])[0] = i
        for c, words in enumerate((lx.MACHINE_WORDS[language], lx.TRANSITIONS[language], lx.HEDGES[language], lx.QUANTIFIERS[language], lx.PRONOUNS[language]), 1):
            for w in words:
                if " " not in w:
                    known.setdefault((language, w), ["NULL", 0, 0, 0, 0, 0])[c] = 1
    rows = ", ".join(f"('{lang}', '{w}', {', '.join(map(str, v))})" for (lang, w), v in sorted(known.items()))
    return f"lex(language, word, rank, m, t, h, q, p) AS (VALUES {rows})"


def _detect_sql(source: str, keep: str = "") -> str:
    """CTEs from `source` to `fused`: metrics and probability of each row. keep: other columns to carry, with commas before."""
    size = _by_language(lambda x: str(lx.vocabulary_size(x)))
    passive = metrics.PASSIVE["en"].replace("'", "''")
    many = {k: [q for q in v if " " in q] for k, v in lx.QUANTIFIERS.items()}
    norm = lambda v, a, b: f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, ({v} - {a}::DOUBLE) / {b - a!r}::DOUBLE))"
    some = lambda e: f"CASE WHEN n_words = 0 THEN 0::DOUBLE ELSE {e} END"
    w = metrics.WEIGHTS
    return f"""{_lexicon_sql()}, {_shape_sql(source)},
hits AS (SELECT row_id, sum(coalesce(lex.rank, {size.replace("language", "x.language")} + 1)) AS ranks, sum(coalesce(m, 0)) AS m, sum(coalesce(t, 0)) AS t, sum(coalesce(h, 0)) AS h, sum(coalesce(q, 0)) AS q, sum(coalesce(p, 0)) AS p
 FROM (SELECT row_id, language, unnest(w) AS word FROM shaped) x LEFT JOIN lex USING (language, word) GROUP BY row_id),
measured AS (SELECT shaped.row_id{keep}, language, n_words, n_sentences,
 {some(f"ln(ranks / n_words + 1) / ln({size} + 2.0)")} AS perplexity_proxy,
 {some("CASE WHEN list_avg(l) = 0 THEN 0 ELSE list_aggregate(l, 'stddev_pop') / list_avg(l) END")} AS burstiness,
 {some("list_avg(l)")} AS avg_sentence_length, {some("list_aggregate(l, 'stddev_pop')")} AS sentence_length_stdev,
 {some(f"(m + 3.0 * ({_by_language(lambda x: _occurrences_sql(lx.MACHINE_PHRASES[x]))})) / n_words")}::DOUBLE AS ai_phrase_density,
 {some(f"(CASE WHEN language = 'en' THEN len(regexp_extract_all(text, '{passive}')) ELSE len(list_filter(w, lambda x: regexp_full_match(x, '{_HE_PASSIVE}'))) END) / greatest(n_sentences, 1)::DOUBLE")} AS passive_voice_ratio,
 {some("t / n_words::DOUBLE")} AS transition_word_frequency, {some("len(list_distinct(w)) / n_words::DOUBLE")} AS vocab_diversity, {some("h / n_words::DOUBLE")} AS hedging_ratio,
 {some("len(list_distinct(starts)) / greatest(len(starts), 1)::DOUBLE")} AS sentence_start_diversity,
 {some(f"(q + ({_by_language(lambda x: _occurrences_sql(many[x]))})) / n_words::DOUBLE")} AS quantifier_overuse, {some("p / n_words::DOUBLE")} AS pronoun_pattern_score
 FROM shaped LEFT JOIN hits USING (row_id)),
subs AS (SELECT *, {some("1.0 - perplexity_proxy")} AS s_perplexity, 1.0 - {norm("burstiness", 0.3, 0.9)} AS s_burstiness, {norm("ai_phrase_density", 0.0, 0.08)} AS s_phrase, {norm("passive_voice_ratio", 0.0, 0.6)} AS s_passive,
 {norm("transition_word_frequency", 0.0, 0.035)} AS s_transition, {some("1.0 - " + norm("vocab_diversity", 0.3, 0.75))} AS s_vocab, {some(norm("hedging_ratio", 0.005, 0.04))} AS s_hedge, {some("1.0 - " + norm("sentence_start_diversity", 0.5, 0.95))} AS s_start,
 {norm("quantifier_overuse", 0.0, 0.04)} AS s_quantifier, {some("1.0 - " + norm("pronoun_pattern_score", 0.0, 0.08))} AS s_pronoun FROM measured),
fused AS (SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, {" + ".join(f"{v}::DOUBLE * s_{k}" for k, v in w.items())})) AS ai_probability FROM subs)"""


_VERDICT = "CASE WHEN ai_probability < 0.35::DOUBLE THEN 'human' WHEN ai_probability < 0.65::DOUBLE THEN 'mixed' ELSE 'ai' END"
_KEYED = "keyed AS (SELECT *, doc_id AS row_id FROM docs)"


def detect_verdict(spark, sf_dir, texts=whole):
    found = metrics.detect(texts(spark, sf_dir), ["doc_id"])
    return found.select("doc_id", "language", F.col("n_words").cast("long").alias("n_words"), *[F.round(m, 6).alias(m) for m in metrics.METRICS], F.round("ai_probability", 6).alias("ai_probability"), "verdict")


DETECT = f"""WITH {_SQL_DOCS}, {_KEYED}, {_detect_sql("keyed")}
SELECT row_id AS doc_id, language, CAST(n_words AS BIGINT) AS n_words, {", ".join(f"round({m}, 6) AS {m}" for m in metrics.METRICS)}, round(ai_probability, 6) AS ai_probability, {_VERDICT} AS verdict FROM fused"""


def leading_signals(spark, sf_dir, texts=whole):
    found = metrics.detect(texts(spark, sf_dir), ["doc_id"]).select("doc_id", F.posexplode(metrics.leading_signals()).alias("rank", "s"))
    return found.select("doc_id", (F.col("rank") + 1).cast("long").alias("rank"), "s.name", F.round("s.value", 6).alias("value"))


LEADING = f"""WITH {_SQL_DOCS}, {_KEYED}, {_detect_sql("keyed")}, each AS ({" UNION ALL ".join(f"SELECT row_id, {o} AS o, '{name}' AS name, {'1.0 - least(1.0, burstiness)' if m == 'burstiness' else m} AS value FROM fused" for o, (name, m) in enumerate(metrics.SIGNALS))}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY value DESC, o) AS rank FROM each) SELECT row_id AS doc_id, rank, name, round(value, 6) AS value FROM ranked WHERE rank <= 3"""


def lexicon_hits(spark, sf_dir, texts=whole):
    """Words in the lexicon's classes over the whole corpus, by language: the counted semi-joins."""
    docs = texts(spark, sf_dir)
    rows = docs.select("language", F.explode(tokens.words(F.col("text"), F.col("language"))).alias("word")).join(F.broadcast(lx.lexicon(spark)), ["language", "word"])
    return rows.groupBy("language").agg(*[F.count_if(c).cast("long").alias(c) for c in ("is_machine", "is_transition", "is_hedge", "is_quantifier", "is_pronoun")], F.count("rank").cast("long").alias("ranked"))


LEXICON_HITS = f"""WITH {_SQL_DOCS}, {_lexicon_sql()} SELECT language, CAST(sum(m) AS BIGINT) AS is_machine, CAST(sum(t) AS BIGINT) AS is_transition, CAST(sum(h) AS BIGINT) AS is_hedge, CAST(sum(q) AS BIGINT) AS is_quantifier, CAST(sum(p) AS BIGINT) AS is_pronoun, count(rank) AS ranked
FROM (SELECT language, unnest({_WORDS.format("text")}) AS word FROM docs) JOIN lex USING (language, word) GROUP BY language"""


def verdict_by_source(spark, sf_dir, texts=whole):
    found = metrics.detect(texts(spark, sf_dir), ["doc_id"], ["source"])
    return found.groupBy("source", "verdict").agg(F.count("*").alias("n"), F.round(F.avg("ai_probability"), 6).alias("mean_probability"))


VERDICT_BY_SOURCE = f"""WITH {_SQL_DOCS}, {_KEYED}, {_detect_sql("keyed", ", source")} SELECT source, {_VERDICT} AS verdict, count(*) AS n, round(avg(ai_probability), 6) AS mean_probability FROM fused GROUP BY 1, 2"""


def labels_vs_score(spark, sf_dir, texts=whole):
    found = metrics.detect(texts(spark, sf_dir), ["doc_id"]).join(table(spark, sf_dir, "labels"), "doc_id")
    return found.groupBy("quality").agg(F.count("*").alias("n"), F.round(F.avg("ai_probability"), 6).alias("mean_probability"))


LABELS = f"""WITH {_SQL_DOCS}, {_KEYED}, {_detect_sql("keyed")} SELECT quality, count(*) AS n, round(avg(ai_probability), 6) AS mean_probability FROM fused JOIN labels ON row_id = labels.doc_id GROUP BY quality"""


def conversation_roles(spark, sf_dir):
    """Mean probability of each role's turns."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text", F.lit("en").alias("language"))
    found = metrics.detect(rows, ["conv_id", "turn"], ["role"])
    return found.groupBy("role").agg(F.count("*").alias("n"), F.round(F.avg("ai_probability"), 6).alias("mean_probability"))


ROLES = f"""WITH keyed AS (SELECT conv_id || '-' || turn AS row_id, role, text, 'en' AS language FROM conversations), {_detect_sql("keyed", ", role")} SELECT role, count(*) AS n, round(avg(ai_probability), 6) AS mean_probability FROM fused GROUP BY role"""


def top_segments(spark, sf_dir, texts=whole):
    found = metrics.top_segments(texts(spark, sf_dir), ["doc_id"])
    return found.select("doc_id", F.col("rank").cast("long").alias("rank"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.md5("text").alias("text_md5"), F.round("sub_score", 6).alias("sub_score"), "reason")


_REASON = "list_reduce([" + ", ".join(f"{{'v': s_{k}, 'label': '{v}'}}" for k, v in metrics.REASONS) + "], lambda a, b: CASE WHEN b.v > a.v THEN b ELSE a END).label"
SEGMENTS = f"""WITH {_SQL_DOCS}, marked AS (SELECT doc_id, language, text, regexp_replace(text, '([.!?])(\\s+)', '\\1' || chr(1) || '\\2' || chr(2), 'g') AS m FROM docs),
pieces AS (SELECT doc_id, language, unnest(string_split(m, chr(1))) AS x, generate_subscripts(string_split(m, chr(1)), 1) AS i FROM marked),
parts AS (SELECT doc_id, language, i, CASE WHEN i = 1 THEN x ELSE split_part(x, chr(2), 2) END AS text, CASE WHEN i = 1 THEN 0 ELSE length(split_part(x, chr(2), 1)) END AS gap FROM pieces),
placed AS (SELECT *, sum(length(text) + gap) OVER (PARTITION BY doc_id ORDER BY i) AS stop FROM parts),
keyed AS (SELECT doc_id || '-' || i AS row_id, doc_id, i, language, text, stop - length(text) AS start, stop FROM placed WHERE len(list_filter(regexp_split_to_array(text, '\\s+'), lambda t: t <> '')) >= 3),
{_detect_sql("keyed", ", doc_id, start, stop, text")},
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ai_probability DESC, start) AS rank FROM fused)
SELECT doc_id, rank, CAST(start AS BIGINT) AS start, CAST(stop AS BIGINT) AS "end", md5(text) AS text_md5, round(ai_probability, 6) AS sub_score, {_REASON} AS reason FROM ranked WHERE rank <= 5"""

def phrase_places(spark, sf_dir, texts=whole):
    """Every place of every machine-like phrase, in the lower-cased text."""
    rows = texts(spark, sf_dir).select("doc_id", F.explode(phrases.places(F.lower("text"), F.col("language"), lx.MACHINE_PHRASES)).alias("p"))
    return rows.select("doc_id", "p.phrase", F.col("p.start").cast("long").alias("start"))


PHRASE_PLACES = f"""WITH {_SQL_DOCS}, p(language, phrase) AS (VALUES {", ".join(f"('{lang}', '{x.replace(chr(39), chr(39) * 2)}')" for lang, some in lx.MACHINE_PHRASES.items() for x in some)}),
cut AS (SELECT doc_id, phrase, string_split(lower(text), phrase) AS q FROM docs JOIN p USING (language) WHERE contains(lower(text), phrase)),
placed AS (SELECT doc_id, phrase, unnest(q) AS x, generate_subscripts(q, 1) AS i, len(q) AS n FROM cut)
SELECT doc_id, phrase, CAST(sum(length(x)) OVER (PARTITION BY doc_id, phrase ORDER BY i) + (i - 1) * length(phrase) AS BIGINT) AS start FROM placed QUALIFY i < n"""


def structural_burstiness(spark, sf_dir, texts=whole):
    return texts(spark, sf_dir).select("doc_id", F.round(sentences.structural_burstiness(F.col("text")), 6).alias("burstiness"), F.size(sentences.sentence_lengths(F.col("text"))).cast("long").alias("n_sentences"))


#: A mark is put where a piece ends; pieces behind one that ends in an abbreviation have its island.
STRUCTURAL = f"""WITH {_SQL_DOCS}, cut AS (SELECT doc_id, string_split(regexp_replace(text, '([.!?])({_WHITE}+)([A-Zא-ת])', '\\1' || chr(1) || '\\3', 'g'), chr(1)) AS q FROM docs),
pieces AS (SELECT doc_id, unnest(q) AS x, generate_subscripts(q, 1) AS i FROM cut),
flagged AS (SELECT *, lower(regexp_extract(x, '([A-Za-z.]+)\\.\\z', 1)) IN ({_q(sentences.ABBREVIATIONS)}) AS short FROM pieces WHERE x <> ''),
numbered AS (SELECT *, sum(CASE WHEN short THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS island FROM flagged),
lengths AS (SELECT doc_id, coalesce(island, 0) AS island, sum(len(regexp_extract_all(x, '{_WHITE.replace("[", "[^", 1)}+'))) AS n FROM numbered GROUP BY ALL)
SELECT docs.doc_id, round(CASE WHEN coalesce(max(n), 0) = 0 THEN 0 ELSE stddev_pop(n) / avg(n) END, 6) AS burstiness, count(n) AS n_sentences FROM docs LEFT JOIN lengths USING (doc_id) GROUP BY docs.doc_id"""

# Hidden characters

_SPACES = "".join(hidden.SPACES)
_STRIP = "".join(hidden.STRIP)
_CONTROL_SQL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F\p{Cf}]"
_KIND = f"""CASE WHEN c IN ({_q(hidden.STRIP)}) THEN 'zero_width' WHEN c IN ({_q(hidden.REPORT_ONLY)}) THEN 'bidi_mark' WHEN c = '{hidden.BOM}' THEN 'bom' WHEN c = '{chr(0xA0)}' THEN 'nbsp' WHEN c IN ({_q(hidden.SPACES)}) THEN 'special_space'
 WHEN regexp_full_match(c, '{_CONTROL_SQL}') THEN 'control' END"""
_KINDS = ["zero_width", "bidi_mark", "bom", "nbsp", "special_space", "control"]


def _compatible() -> dict[str, str]:
    """Every character that compatibility normalisation replaces by something else, by Unicode's own tables."""
    return {c: n for c in map(chr, range(1, 0x110000)) if not 0xD800 <= ord(c) < 0xE000 and (n := unicodedata.normalize("NFKC", c)) != c}


def _class_of(chars) -> str:
    """A class of RE2 for some characters, as ranges."""
    points, out = sorted(map(ord, chars)), []
    for c in points:
        if out and c == out[-1][1] + 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "[" + "".join(f"\\x{{{a:X}}}" + (f"-\\x{{{z:X}}}" if z > a else "") for a, z in out) + "]"


def _nfkc_sql(source: str, name: str) -> str:
    """CTEs from `source` (row_id, t) to `name` (row_id, t, u): u is t in compatibility form. Characters are replaced one by one, then composed."""
    known = _compatible()
    rows = ", ".join(f"('{c}', '{n.replace(chr(39), chr(39) * 2)}')" for c, n in known.items())
    return f"""{name}_map(c, n) AS (VALUES {rows}), {name}_hit AS (SELECT row_id, t FROM {source} WHERE regexp_matches(t, '{_class_of(known)}')),
{name}_chars AS (SELECT row_id, unnest(string_split(t, '')) AS c, generate_subscripts(string_split(t, ''), 1) AS i FROM {name}_hit),
{name}_back AS (SELECT row_id, string_agg(coalesce(n, c), '' ORDER BY i) AS u FROM {name}_chars LEFT JOIN {name}_map USING (c) GROUP BY row_id),
{name} AS (SELECT row_id, t, nfc_normalize(coalesce(u, t)) AS u FROM {source} LEFT JOIN {name}_back USING (row_id))"""


def invisible_findings(spark, sf_dir, texts=whole):
    rows = texts(spark, sf_dir).select("doc_id", F.explode(hidden.scan(F.col("text"))).alias("f"))
    return rows.select("doc_id", "f.kind", "f.codepoint", F.col("f.index").cast("long").alias("index"), "f.note")


_NOTES = " ".join(f"WHEN '{c}' THEN '{n}'" for c, n in sorted((hidden.NAMES | hidden.STRIP | hidden.REPORT_ONLY | hidden.SPACES | {hidden.BOM: "BYTE ORDER MARK"}).items()))
_CHARS = "chars AS (SELECT doc_id, unnest(string_split(text, '')) AS c, generate_subscripts(string_split(text, ''), 1) - 1 AS i FROM docs)"
_CODE = "'U+' || lpad(upper(to_hex(unicode(c))), CAST(greatest(4, length(to_hex(unicode(c)))) AS INTEGER), '0')"
FINDINGS = f"""WITH {_SQL_DOCS}, {_CHARS}
SELECT doc_id, {_KIND} AS kind, {_CODE} AS codepoint, CAST(i AS BIGINT) AS index, CASE c {_NOTES} ELSE 'UNKNOWN' END AS note FROM chars WHERE {_KIND} IS NOT NULL"""


def finding_counts(spark, sf_dir, texts=whole):
    return hidden.finding_counts(texts(spark, sf_dir), ["doc_id"])


#: Characters beside which the normal form has another one, as far as the shorter of the two goes.
_SWAPPED = f"""raw AS (SELECT doc_id AS row_id, text AS t FROM docs), {_nfkc_sql("raw", "normal")},
swapped AS (SELECT row_id AS doc_id, unnest(string_split(t, '')[:least(length(t), length(u))]) AS c, unnest(string_split(u, '')[:least(length(t), length(u))]) AS d, generate_subscripts(string_split(t, '')[:least(length(t), length(u))], 1) - 1 AS i FROM normal WHERE t <> u)"""
COUNTS = f"""WITH {_SQL_DOCS}, {_CHARS}, found AS (SELECT doc_id, {_KIND} AS kind FROM chars), {_SWAPPED},
n AS (SELECT doc_id, {", ".join(f"CAST(count(*) FILTER (kind = '{k}') AS BIGINT) AS {k}" for k in _KINDS)} FROM found GROUP BY doc_id), h AS (SELECT doc_id, count(*) AS homoglyph FROM swapped WHERE c <> d AND NOT regexp_full_match(c, '{_WHITE}') GROUP BY doc_id)
SELECT doc_id, {", ".join(f"coalesce({k}, 0) AS {k}" for k in [*_KINDS, "homoglyph"])}, CAST({" + ".join(f"coalesce({k}, 0)" for k in [*_KINDS, "homoglyph"] if k != "bidi_mark")} AS BIGINT) AS total FROM docs LEFT JOIN n USING (doc_id) LEFT JOIN h USING (doc_id)"""


def clean_text(spark, sf_dir, texts=whole):
    out = hidden.clean(texts(spark, sf_dir))
    return out.select("doc_id", F.md5("text").alias("text_md5"), "removed_count", "normalized_count")


_KEPT_CONTROL = f"{hidden.BOM}{''.join(hidden.REPORT_ONLY)}"
_STRIPPED = f"replace(translate(translate(text, '{_STRIP}', ''), '{_SPACES}', '{' ' * len(_SPACES)}'), '{hidden.BOM}', '')"
#: Of the class Cf, all but the marks that stay; RE2 has no difference of classes, so those are put aside as characters that are no text.
_ASIDE = f"translate({_STRIPPED}, '{''.join(hidden.REPORT_ONLY)}', '{chr(0xE000)}{chr(0xE001)}')"
_DASHED = r"""regexp_replace(regexp_replace(regexp_replace(u, '\s*—\s*', ', ', 'g'), '(\D)(\s*)–(\s*)(\D)', '\1 - \4', 'g'), '(\D)(\s*)–(\s*)(\D)', '\1 - \4', 'g')"""
CLEAN = f"""WITH {_SQL_DOCS}, bare AS (SELECT doc_id AS row_id, (CASE WHEN text[1] = '{hidden.BOM}' THEN '{hidden.BOM}' ELSE '' END) || translate(regexp_replace({_ASIDE}, '{_CONTROL_SQL}', '', 'g'), '{chr(0xE000)}{chr(0xE001)}', '{"".join(hidden.REPORT_ONLY)}') AS t FROM docs),
{_nfkc_sql("bare", "normal")}
SELECT doc_id, md5({_DASHED}) AS text_md5,
 CAST(len(regexp_extract_all(text, '[{_STRIP}]')) + len(regexp_extract_all(text[2:], '{hidden.BOM}')) + len(regexp_extract_all(translate(text, '{_STRIP}{_KEPT_CONTROL}', ''), '{_CONTROL_SQL}')) AS BIGINT) AS removed_count, CAST(len(regexp_extract_all(text, '[{_SPACES}]')) AS BIGINT) AS normalized_count FROM docs JOIN normal ON row_id = doc_id"""

# Lines and spans


def line_kinds(spark, sf_dir, texts=whole):
    found = lines.line_kinds(texts(spark, sf_dir), ["doc_id"])
    return found.select("doc_id", F.col("line").cast("long").alias("line"), "start", "end", "kind", F.col("body_start").cast("long").alias("body_start"))


def _marked(pattern: str) -> str:
    return f"length(regexp_extract(x, '{pattern}'))"


_LABEL_SQL = lines.LABEL.replace(r"(?=\S)", "")
_SHORT = lambda body: f"(len(regexp_split_to_array(regexp_replace({body}, '^\\s+|\\s+$', '', 'g'), '\\s+')) <= {lines.MAX_HEADING_WORDS} AND NOT regexp_matches(regexp_replace({body}, '^\\s+|\\s+$', '', 'g'), '[.!?:;]$'))"
LINE_KINDS = f"""WITH {_SQL_DOCS}, cut AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM docs),
placed AS (SELECT *, coalesce(sum(length(x) + 1) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start, {_marked(lines.BLOCKQUOTE)} AS q, {_marked(lines.LIST_MARKER)} AS b,
 CASE WHEN regexp_matches(x, '{_LABEL_SQL}\\S') THEN {_marked(_LABEL_SQL)} ELSE 0 END AS p FROM cut),
named AS (SELECT *, CASE WHEN regexp_full_match(x, '\\s*') THEN 'blank' WHEN regexp_matches(x, '{lines.HEADING}') THEN 'heading' WHEN q > 0 THEN CASE WHEN {_SHORT("x[q+1:]")} THEN 'heading' ELSE 'list_item' END
 WHEN b > 0 THEN CASE WHEN {_SHORT("x[b+1:]")} THEN 'heading' ELSE 'list_item' END WHEN p > 0 THEN 'label_line' WHEN {_SHORT("x")} THEN 'heading' ELSE 'prose' END AS kind FROM placed)
SELECT doc_id, CAST(line AS BIGINT) AS line, CAST(start AS BIGINT) AS start, CAST(start + length(x) AS BIGINT) AS "end", kind, CAST(CASE kind WHEN 'list_item' THEN CASE WHEN q > 0 THEN q ELSE b END WHEN 'label_line' THEN p ELSE 0 END AS BIGINT) AS body_start FROM named"""


def protected_spans(spark, sf_dir, texts=whole):
    rows = texts(spark, sf_dir).select("doc_id", F.explode(lines.protected_spans()("text")).alias("r"))
    return rows.select("doc_id", F.col("r.s").cast("long").alias("s"), F.col("r.e").cast("long").alias("e"), "r.kind")


#: The span patterns without look-arounds, which RE2 lacks: what must not stand before is matched too, and sorted out or left off behind.
_WITHOUT_LOOKING = {
    "link": lines.SPANS["link"].replace(r"(?<!\!)", "!?"), "ref_link": lines.SPANS["ref_link"].replace(r"(?<!\!)", "!?"), "ref_definition": lines.SPANS["ref_definition"].replace(r"\[(?!\^)[^\]\n]+", r"\[[^\]\n\^][^\]\n]*"),
    "mention": lines.SPANS["mention"].replace("(?<![A-Za-z0-9_])", "(?:^|[^A-Za-z0-9_])"), "hashtag": lines.SPANS["hashtag"].replace("(?<![A-Za-z0-9_])", "(?:^|[^A-Za-z0-9_])"), "title": lines.TITLE_RUN.replace(r"\s", _WHITE),  # blanks of all kinds, as in Python
}


def _matches_sql(name: str, pattern: str) -> str:
    """doc_id, text, kind, x, pos: every match of a pattern and its place, from the lengths of the matches and of what is between them."""
    p = pattern.replace("'", "''")
    return f"""SELECT doc_id, text, '{name}' AS kind, unnest(m) AS x, unnest(list_transform(range(1, len(m) + 1), lambda i: list_sum(list_transform(q[:i], lambda y: length(y))) + coalesce(list_sum(list_transform(m[:i - 1], lambda y: length(y))), 0))) AS pos
 FROM (SELECT doc_id, text, regexp_extract_all(text, '{p}') AS m, regexp_split_to_array(text, '{p}') AS q FROM docs) WHERE len(m) > 0"""


def _spans_sql() -> str:
    """CTEs up to `spans` (doc_id, s, e, kind): protected spans, headings among them."""
    every = " UNION ALL ".join(_matches_sql(k, v) for k, v in (lines.SPANS | _WITHOUT_LOOKING).items())
    lined = "WITH " + LINE_KINDS[len(f"WITH {_SQL_DOCS}, ") :]
    return f"""found AS ({every}), lined AS ({lined}),
titles AS (SELECT doc_id, x, pos, right(rtrim(text[:pos], ' ' || chr(9)), 1) AS before FROM found WHERE kind = 'title'),
spans AS (SELECT doc_id, pos + CASE WHEN kind IN ('mention', 'hashtag') AND x[1] NOT IN ('@', '#') THEN 1 ELSE 0 END AS s, pos + length(x) AS e, kind FROM found WHERE kind <> 'title' AND NOT (kind IN ('link', 'ref_link') AND x[1] = '!')
 UNION ALL SELECT doc_id, pos, pos + length(x), 'proper_noun' FROM titles WHERE before <> '' AND before NOT IN ('.', '!', '?', ':', chr(10))
 UNION ALL SELECT doc_id, pos + length(regexp_extract(x, '^{lines.TITLE_TOKEN}{_WHITE}+')), pos + length(x), 'proper_noun' FROM titles WHERE (before = '' OR before IN ('.', '!', '?', ':', chr(10))) AND len(regexp_extract_all(x, '{lines.TITLE_TOKEN}')) >= 3
 UNION ALL SELECT doc_id, start, "end", kind FROM lined WHERE kind = 'heading' UNION ALL SELECT doc_id, start, start + body_start, kind FROM lined WHERE kind <> 'heading' AND body_start > 0)"""


#: Spans that touch are one.
_MERGED_SQL = """reached AS (SELECT *, max(e) OVER (PARTITION BY doc_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM spans),
islands AS (SELECT *, sum(CASE WHEN before IS NULL OR s > before THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM reached),
merged AS (SELECT doc_id, min(s) AS s, max(e) AS e FROM islands GROUP BY doc_id, island)"""
PROTECTED = f"WITH {_SQL_DOCS}, {_spans_sql()} SELECT doc_id, CAST(s AS BIGINT) AS s, CAST(e AS BIGINT) AS e, kind FROM spans"
MERGED_SPANS = f"""WITH {_SQL_DOCS}, {_spans_sql()}, {_MERGED_SQL}
SELECT docs.doc_id, count(s) AS n, CAST(coalesce(sum(e - s), 0) AS BIGINT) AS covered, CAST(min(s) AS BIGINT) AS first, CAST(max(e) AS BIGINT) AS last FROM docs LEFT JOIN merged USING (doc_id) GROUP BY docs.doc_id"""
#: A run of digits, commas, points and hyphens has a number to change if it begins with four digits or more and ends there or goes on with a hyphen.
THOUSANDS = f"""WITH {_SQL_DOCS}, {_spans_sql()}, {_MERGED_SQL},
cut AS (SELECT doc_id, text, regexp_extract_all(text, '[0-9,.\\-]+') AS m, regexp_split_to_array(text, '[0-9,.\\-]+') AS q FROM docs),
placed AS (SELECT doc_id, unnest(q) AS between, unnest(list_append(m, '')) AS x, generate_subscripts(q, 1) AS i FROM cut),
starts AS (SELECT *, sum(length(between) + length(x)) OVER (PARTITION BY doc_id ORDER BY i) - length(x) AS pos, regexp_extract(x, '^([0-9]{{4,}})(-|$)', 1) AS digits FROM placed),
judged AS (SELECT *, digits <> '' AND NOT regexp_full_match(digits, '(19|20)[0-9][0-9]') AND NOT EXISTS (SELECT 1 FROM merged WHERE merged.doc_id = starts.doc_id AND s < pos + length(digits) AND e > pos) AS changes FROM starts),
plain AS (SELECT *, CASE WHEN ltrim(digits, '0') = '' THEN '0' ELSE ltrim(digits, '0') END AS d FROM judged)
SELECT doc_id, md5(string_agg(between || CASE WHEN changes THEN reverse(regexp_replace(regexp_replace(reverse(d), '([0-9]{{3}})', '\\1,', 'g'), ',$', '')) || x[length(digits) + 1:] ELSE x END, '' ORDER BY i)) AS text_md5, CAST(count(*) FILTER (changes) AS BIGINT) AS n_changed FROM plain GROUP BY doc_id"""


def merged_spans(spark, sf_dir, texts=whole):
    """The union of each text's protected spans, headings included: how many, how many characters they cover, and the outermost places."""
    rows = texts(spark, sf_dir).select("doc_id", lines.merged_ranges()("text").alias("r"))
    covered = F.aggregate("r", F.lit(0), lambda n, x: n + x["e"] - x["s"])
    return rows.select("doc_id", F.size("r").cast("long").alias("n"), covered.cast("long").alias("covered"), F.array_min(F.transform("r", lambda x: x["s"])).cast("long").alias("first"), F.array_max(F.transform("r", lambda x: x["e"])).cast("long").alias("last"))


def findings_in_spans(spark, sf_dir, texts=whole):
    """Hidden characters that stand in protected spans, with the span that each lies in."""
    docs = texts(spark, sf_dir)
    points = docs.select("doc_id", F.explode(hidden.scan(F.col("text"))).alias("f")).select("doc_id", "f.kind", "f.index")
    spans = docs.select("doc_id", F.explode(lines.merged_ranges()("text")).alias("r")).select("doc_id", "r.*")
    found = intervals.points_within(points, spans, ["doc_id"], "index")
    return found.select("doc_id", "kind", F.col("index").cast("long").alias("index"), F.col("other_s").cast("long").alias("s"), F.col("other_e").cast("long").alias("e"))


FINDINGS_IN_SPANS = f"""WITH {_SQL_DOCS}, {_spans_sql()}, {_MERGED_SQL}, {_CHARS}
SELECT doc_id, {_KIND} AS kind, CAST(i AS BIGINT) AS index, CAST(s AS BIGINT) AS s, CAST(e AS BIGINT) AS e FROM chars JOIN merged USING (doc_id) WHERE s <= i AND i < e AND {_KIND} IS NOT NULL"""


def segments_over_spans(spark, sf_dir, texts=whole):
    """Sentences that protected spans reach into: how many, and how many of the sentence's characters they cover."""
    docs = texts(spark, sf_dir)
    found = docs.select("doc_id", F.explode(tokens.segments(F.col("text"))).alias("x")).select("doc_id", "x.start", "x.end")
    spans = docs.select("doc_id", F.explode(lines.merged_ranges()("text")).alias("r")).select("doc_id", "r.*")
    met = intervals.overlapping(found, spans, ["doc_id"], ("start", "end"))
    inside = F.least("end", "other_e") - F.greatest("start", "other_s")
    return met.groupBy("doc_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end")).agg(F.count("*").alias("n_spans"), F.sum(inside).cast("long").alias("covered"))


SEGMENTS_OVER_SPANS = f"""WITH {_SQL_DOCS}, {_spans_sql()}, {_MERGED_SQL}, {SEGMENTS[len(f"WITH {_SQL_DOCS}, ") : SEGMENTS.index("keyed AS")]} cut AS (SELECT doc_id, stop - length(text) AS start, stop FROM placed WHERE text <> '')
SELECT doc_id, CAST(start AS BIGINT) AS start, CAST(stop AS BIGINT) AS "end", count(*) AS n_spans, CAST(sum(least(stop, e) - greatest(start, s)) AS BIGINT) AS covered FROM cut JOIN merged USING (doc_id) WHERE s < stop AND start < e GROUP BY ALL"""


def merge_ranges(spark, sf_dir):
    """Union of intervals: each user's events as [second, second + 600 * (1 + event_id % 5)), merged. An island begins where no earlier interval reaches."""
    from pyspark.sql.window import Window

    events = table(spark, sf_dir, "events").select("user_id", F.unix_seconds(F.col("ts").cast("timestamp")).cast("long").alias("s"), "event_id").withColumn("e", F.expr("s + 600 * (1 + event_id % 5)"))
    order = Window.partitionBy("user_id").orderBy("s", "e")
    reached = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = events.withColumn("new", F.coalesce((F.col("s") > reached).cast("int"), F.lit(1)))
    marked = marked.withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy("user_id", "island").agg(F.min("s").alias("s"), F.max("e").alias("e")).drop("island")


MERGE = """WITH x AS (SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) AS s, CAST(floor(epoch(ts)) AS BIGINT) + 600 * (1 + event_id % 5) AS e FROM events),
y AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM x),
z AS (SELECT *, sum(CASE WHEN before IS NULL OR s > before THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM y)
SELECT user_id, min(s) AS s, max(e) AS e FROM z GROUP BY user_id, island"""

# Rewriting


def rule_audit(spark, sf_dir, texts=whole):
    """How often each tell rule applies, corpus-wide, on the whole text."""
    rows = texts(spark, sf_dir).select(F.explode(rules.rule_counts(F.col("text"), rules.TELLS)).alias("c"))
    return rows.groupBy(F.col("c.tag").alias("tag")).agg(F.sum("c.n").cast("long").alias("n"), F.count("*").alias("docs"))


def _rule_audit_sql(table: list[rules.Rule]) -> str:
    parts = [f"SELECT '{r.tag}' AS tag, len(regexp_extract_all(t, '(?i){r.pattern.replace(chr(39), chr(39) * 2)}')) AS n FROM r{i}" for i, r in enumerate(table)]
    return f"WITH {_SQL_DOCS}, whole_texts AS (SELECT doc_id, 0 AS k, '' AS kept, text AS t FROM docs), {_stepped_sql(table, 'whole_texts')}, c AS ({' UNION ALL '.join(parts)}) SELECT tag, CAST(sum(n) AS BIGINT) AS n, count(*) AS docs FROM c WHERE n > 0 GROUP BY tag"


def post_audit(spark, sf_dir, texts=whole):
    """How often each phrase, filler and worn phrase is rewritten, corpus-wide, on the whole text."""
    rows = texts(spark, sf_dir).select(F.explode(rules.rule_counts(F.col("text"), _POST)).alias("c"))
    return rows.groupBy(F.col("c.tag").alias("tag")).agg(F.sum("c.n").cast("long").alias("n"), F.count("*").alias("docs"))


_POST = [*rules.PHRASES, *rules.FILLERS, *rules.HACKY]


def _stepped_sql(table: list[rules.Rule], source: str) -> str:
    """CTEs from `source` (doc_id, k, kept, t) to `stepped`: t after all rules in order, f with a bit for each that matched, n with its matches by rule."""
    steps, last = [], f"SELECT doc_id, k, kept, t, 0::HUGEINT AS f FROM {source}"
    for i, r in enumerate(table):
        p, new = r.pattern.replace("'", "''"), r.replacement.replace("$1", "\\1").replace("'", "''")
        steps.append(f"r{i} AS MATERIALIZED ({last})")
        last = f"SELECT doc_id, k, kept, regexp_replace(t, '{p}', '{new}', 'gi') AS t, f + CASE WHEN regexp_matches(t, '(?i){p}') THEN {1 << i}::HUGEINT ELSE 0 END AS f FROM r{i}"
    return ", ".join(steps) + f", stepped AS ({last})"


def _tell_scrub_sql() -> str:
    merged = _MERGED_SQL.replace("FROM spans)", "FROM spans WHERE kind <> 'heading')")
    tidy = "regexp_replace(regexp_replace(t, '  +', ' ', 'g'), '[ \\t]+([!?.,:;])', '\\1', 'g')"
    return f"""WITH {_SQL_DOCS}, {_spans_sql()}, {merged},
segs AS (SELECT *, lag(e, 1, 0) OVER (PARTITION BY doc_id ORDER BY s) AS prev FROM merged),
parts AS (SELECT doc_id, s AS k, text[prev + 1:s] AS t, text[s + 1:e] AS kept FROM segs JOIN docs USING (doc_id)
 UNION ALL SELECT doc_id, 1099511627776::BIGINT, text[coalesce(stop, 0) + 1:], '' FROM docs LEFT JOIN (SELECT doc_id, max(e) AS stop FROM merged GROUP BY doc_id) USING (doc_id)),
{_stepped_sql(rules.TELLS, "parts")},
glued AS (SELECT doc_id, string_agg(t || kept, '' ORDER BY k) AS t, bit_or(f) AS f FROM stepped GROUP BY doc_id),
tidied AS (SELECT glued.doc_id, f, CASE WHEN t = text THEN t ELSE array_to_string(list_transform(string_split(regexp_replace({tidy}, '(\\A|[.!?][ \\t]+)([a-z])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda x, i: CASE WHEN i > 1 THEN upper(x[1]) || x[2:] ELSE x END), '') END AS t FROM glued JOIN docs USING (doc_id))
SELECT doc_id, md5(t) AS text_md5, CAST(length(t) AS BIGINT) AS chars, CAST(bit_count(f) AS BIGINT) AS n_changes FROM tidied"""


def _stated(df: DataFrame) -> DataFrame:
    """Strength by doc_id, so that each is met."""
    return df.withColumn("strength", F.expr("element_at(array('light', 'medium', 'aggressive'), CAST(pmod(doc_id, 3) AS INT) + 1)"))


def _digest(df: DataFrame) -> DataFrame:
    return df.select("doc_id", F.md5("text").alias("text_md5"), F.char_length("text").cast("long").alias("chars"), F.size("transformations").cast("long").alias("n_changes"))


def tell_scrub(spark, sf_dir, texts=whole):
    return _digest(rules.scrub_tells(texts(spark, sf_dir)))


def thousands(spark, sf_dir, texts=whole):
    return rules.numbers(texts(spark, sf_dir)).select("doc_id", F.md5("text").alias("text_md5"), "n_changed")


def headings(spark, sf_dir, texts=whole):
    return _digest(rewrite.headings(_stated(texts(spark, sf_dir)), ["doc_id"]))


def _headings_sql() -> str:
    first = LINE_KINDS[len(f"WITH {_SQL_DOCS}, ") : LINE_KINDS.rindex("SELECT doc_id, CAST(line")].rstrip()
    allowed = "CASE lower(w) " + " ".join(f"WHEN '{a.lower()}' THEN '{a}'" for a in rewrite.ACRONYMS) + " END"
    token, mark = (p.replace("'", "''") for p in (rewrite._TOKEN, rewrite._MARK))
    return f"""WITH {_SQL_DOCS}, {first},
cut_up AS (SELECT doc_id, line, x, regexp_extract(x, '{mark}') AS mark, x[length(regexp_extract(x, '{mark}')) + 1:] AS body FROM named JOIN docs USING (doc_id) WHERE kind = 'heading' AND language = 'en' AND NOT regexp_matches(x, '[\\x{{590}}-\\x{{5FF}}]')),
toks AS (SELECT *, regexp_extract_all(body, '{token}') AS m, regexp_split_to_array(body, '{token}') AS q FROM cut_up),
cased AS (SELECT *, list_transform(m, lambda w, i: coalesce({allowed}, CASE WHEN i = 1 OR regexp_matches(w, '[0-9]') OR regexp_full_match(w, '[A-Z][A-Z''&\\-]{{0,3}}[A-Z]') THEN w ELSE lower(w) END)) AS n FROM toks),
new AS (SELECT doc_id, line, mark || array_to_string(list_transform(q, lambda g, i: g || coalesce(n[i], '')), '') AS y FROM cased),
whole AS (SELECT doc_id, string_agg(coalesce(y, x), chr(10) ORDER BY line) AS t, count(*) FILTER (y <> x) AS n FROM named LEFT JOIN new USING (doc_id, line) GROUP BY doc_id)
SELECT doc_id, md5(t) AS text_md5, CAST(length(t) AS BIGINT) AS chars, CAST(n > 0 AS BIGINT) AS n_changes FROM whole"""


def lexical_swap(spark, sf_dir, texts=whole):
    return _digest(rewrite.lexical_swap(_stated(texts(spark, sf_dir)), ["doc_id"]))


def restructure(spark, sf_dir, texts=whole):
    return _digest(rewrite.restructure(_stated(texts(spark, sf_dir)), ["doc_id"]))


def vary_vocabulary(spark, sf_dir, texts=whole):
    return _digest(rewrite.vary_vocabulary(_stated(texts(spark, sf_dir)), ["doc_id"]))


def post_polish(spark, sf_dir, texts=whole):
    return _digest(rewrite.post_polish(_stated(texts(spark, sf_dir)), ["doc_id"]))


def swap_candidates(spark, sf_dir, texts=whole):
    """Words of the text that a swap may replace, and by how many words: the equi-join of words and alternatives."""
    known = [(lang, w, len(o)) for lang, t in lx.MACHINE_WORDS.items() for w, o in t.items()]
    options = spark.createDataFrame(known, "language string, word string, options int")
    words = texts(spark, sf_dir).select("doc_id", "language", F.explode(tokens.words(F.col("text"), F.col("language"))).alias("word"))
    return words.join(F.broadcast(options), ["language", "word"]).groupBy("doc_id", "word").agg(F.count("*").alias("n"), F.max("options").cast("long").alias("options"))


SWAP_CANDIDATES = f"""WITH {_SQL_DOCS}, o(language, word, options) AS (VALUES {", ".join(f"('{lang}', '{w}', {len(x)})" for lang, t in lx.MACHINE_WORDS.items() for w, x in t.items())})
SELECT doc_id, word, count(*) AS n, CAST(max(options) AS BIGINT) AS options FROM (SELECT doc_id, language, unnest({_WORDS.format("text")}) AS word FROM docs) JOIN o USING (language, word) GROUP BY doc_id, word"""


def swapped_words(spark, sf_dir, texts=whole):
    """Phrases, machine-like words and synonyms swapped by chance outside protected spans."""
    return _digest(swaps.swapped(_stated(texts(spark, sf_dir)), ["doc_id"]))


def _swapped_sql() -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    alt = ", ".join(f"('{lang}', {quoted(w)}, '{layer}', [{_q(o)}])" for layer, some in (("word", lx.MACHINE_WORDS), ("synonym", lx.SYNONYMS)) for lang, t in some.items() for w, o in t.items())
    phr = ", ".join(f"('{lang}', {quoted(p)}, {quoted(r)})" for lang, some in lx.MACHINE_PHRASES.items() for p, r in some.items())
    chance = lambda layer, place, first=1: f"(CAST('0x' || substr(md5(concat_ws(':', '0', {layer}, doc_id, {place})), {first}, 8) AS BIGINT) / 4294967296.0::DOUBLE)"
    ratio = "CASE strength " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in swaps.RATIOS.items()) + " END"
    layer = "CASE layer " + " ".join(f"WHEN '{k}' THEN {{}}" for k in swaps.LAYERS) + " END"
    share, number = layer.format(*[f"{v}::DOUBLE" for v in swaps.LAYERS.values()]), layer.format(*range(1, len(swaps.LAYERS) + 1))
    cased = lambda old, new: f"CASE WHEN language = 'he' THEN {new} WHEN length({old}) > 1 AND {old} = upper({old}) AND {old} <> lower({old}) THEN upper({new}) WHEN {old}[1] = upper({old}[1]) AND {old}[1] <> lower({old}[1]) THEN upper(({new})[1]) || ({new})[2:] ELSE {new} END"
    en, he = (quoted(swaps.TOKEN[k]) for k in ("en", "he"))
    low = f"translate(text, '{swaps._UPPER}', '{swaps._LOWER}')"
    return f"""WITH {_SQL_DOCS}, {_spans_sql()}, {_MERGED_SQL},
alt(language, word, layer, options) AS (VALUES {alt}), phr(language, phrase, new) AS (VALUES {phr}),
st AS (SELECT *, ['light', 'medium', 'aggressive'][((doc_id % 3) + 3) % 3 + 1] AS strength FROM docs),
toks AS (SELECT *, CASE WHEN language = 'he' THEN regexp_extract_all(text, {he}) ELSE regexp_extract_all(text, {en}) END AS m, CASE WHEN language = 'he' THEN regexp_split_to_array(text, {he}) ELSE regexp_split_to_array(text, {en}) END AS q FROM st),
tok AS (SELECT doc_id, language, strength, unnest(q) AS between, unnest(list_append(m, '')) AS x, generate_subscripts(q, 1) AS i FROM toks),
placed_tok AS (SELECT *, CAST(sum(length(between) + length(x)) OVER (PARTITION BY doc_id ORDER BY i) - length(x) AS BIGINT) AS s FROM tok),
v AS (SELECT doc_id, language, strength, s, x, n, CASE WHEN language = 'he' THEN x[:n] ELSE '' END AS prefix, CASE WHEN language = 'he' THEN x[n + 1:] ELSE lower(x) END AS word FROM placed_tok, (SELECT unnest(range(0, {swaps.MOST_CLITICS + 1})) AS n)
 WHERE x <> '' AND (language = 'he' AND length(x) > n AND translate(x[:n], '{swaps.CLITICS}', '') = '' OR language <> 'he' AND n = 0)),
w AS (SELECT *, {number} AS number, options[CAST(floor({chance("layer", "s", 9)} * len(options)) AS BIGINT) + 1] AS pick FROM v JOIN alt USING (language, word) WHERE {chance("layer", "s")} < {ratio} * {share}),
best AS (SELECT doc_id, s, s + length(x) AS e, number AS layer, x AS old, CASE WHEN language = 'he' THEN prefix || pick ELSE {cased("x", "pick")} END AS new FROM w QUALIFY row_number() OVER (PARTITION BY doc_id, s ORDER BY number, CASE WHEN n = 0 THEN -9 ELSE -n END) = 1),
pcut AS (SELECT doc_id, language, strength, text, phrase, new, string_split({low}, phrase) AS q FROM st JOIN phr USING (language) WHERE contains({low}, phrase)),
pat AS (SELECT *, unnest(q) AS x, generate_subscripts(q, 1) AS i, len(q) AS n FROM pcut),
pplace AS (SELECT * EXCLUDE (q), CAST(sum(length(x)) OVER (PARTITION BY doc_id, phrase ORDER BY i) + (i - 1) * length(phrase) AS BIGINT) AS s FROM pat QUALIFY i < n),
pold AS (SELECT *, text[s + 1:s + length(phrase)] AS old FROM pplace WHERE NOT regexp_matches(CASE WHEN s > 0 THEN text[s] ELSE '' END || substr(text, CAST(s + length(phrase) + 1 AS BIGINT), 1), '[\\p{{L}}\\p{{N}}_]') AND {chance("'phrase'", "CAST(s AS BIGINT)")} < {ratio}),
edits AS (SELECT * FROM best UNION ALL SELECT doc_id, s, s + length(phrase), 1, old, {cased("old", "new")} FROM pold),
free AS (SELECT * FROM edits a WHERE NOT EXISTS (SELECT 1 FROM merged m WHERE m.doc_id = a.doc_id AND m.s < a.e AND a.s < m.e)),
kept AS (SELECT * FROM free a WHERE NOT EXISTS (SELECT 1 FROM free b WHERE b.doc_id = a.doc_id AND b.s < a.e AND a.s < b.e AND row(b.layer, b.s - b.e, b.s) < row(a.layer, a.s - a.e, a.s))),
gaps AS (SELECT *, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS prev FROM kept),
built AS (SELECT gaps.doc_id, string_agg(text[prev + 1:s] || new, '' ORDER BY s) AS head, max(e) AS last, count(*) AS n FROM gaps JOIN docs USING (doc_id) GROUP BY gaps.doc_id),
done AS (SELECT doc_id, coalesce(head || text[last + 1:], text) AS t, coalesce(n, 0) AS n FROM docs LEFT JOIN built USING (doc_id))
SELECT doc_id, md5(t) AS text_md5, CAST(length(t) AS BIGINT) AS chars, CAST(n AS BIGINT) AS n_changes FROM done"""


def rewritten(spark, sf_dir, texts=whole):
    return _digest(workflows.rewritten(_stated(texts(spark, sf_dir)), ["doc_id"]))


def before_after(spark, sf_dir, texts=whole):
    found = workflows.before_and_after(workflows.rewritten(_stated(texts(spark, sf_dir)), ["doc_id"]), ["doc_id"])
    return found.select("doc_id", F.round("probability_before", 6).alias("probability_before"), "verdict_before", F.round("probability_after", 6).alias("probability_after"), "verdict_after")


def detect_report(spark, sf_dir, texts=whole):
    found = workflows.detect(texts(spark, sf_dir), ["doc_id"])
    places = F.concat_ws(",", F.transform("segments", lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))))
    return found.select("doc_id", F.round("ai_probability", 6).alias("ai_probability"), "verdict", F.size("findings").cast("long").alias("n_findings"), F.size(F.slice("findings", 1, src.SHOWN)).cast("long").alias("n_shown"), F.coalesce(F.size("segments"), F.lit(0)).cast("long").alias("n_segments"), places.alias("places"))


def _detect_report_sql() -> str:
    one = SEGMENTS[len(f"WITH {_SQL_DOCS}, ") :]
    return f"""WITH {_SQL_DOCS}, whole AS ({DETECT}), top AS (WITH {one}), {_CHARS}, {_SWAPPED},
n AS (SELECT doc_id, count(*) AS n FROM chars WHERE {_KIND} IS NOT NULL GROUP BY doc_id), h AS (SELECT doc_id, count(*) AS h FROM swapped WHERE c <> d AND NOT regexp_full_match(c, '{_WHITE}') GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS k, string_agg(start || '-' || "end", ',' ORDER BY rank) AS places FROM top GROUP BY doc_id)
SELECT doc_id, ai_probability, verdict, coalesce(n, 0) + coalesce(h, 0) AS n_findings, least({src.SHOWN}, coalesce(n, 0) + coalesce(h, 0)) AS n_shown, coalesce(k, 0) AS n_segments, coalesce(places, '') AS places FROM whole LEFT JOIN n USING (doc_id) LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)"""


#: What the model of model_score() looks at: length and the share of letters.
_SEEN = {"a": "ln(1.0::DOUBLE + length(text))", "b": "length(regexp_replace(text, '[^\\p{L}]', '', 'g')) / greatest(length(text), 1)::DOUBLE"}


def model_states(spark, sf_dir, texts=whole):
    """The optional model's three states: left out, broken, and there. The model is a Gaussian for each class of quality with common variances,
    learned from all labelled documents: means and variances are all that the loader takes along."""
    n = F.char_length("text")
    seen = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").dropna(subset=["quality"]), "doc_id").filter("text IS NOT NULL")
    seen = seen.select("quality", F.log1p(n).alias("a"), (F.char_length(F.regexp_replace("text", r"[^\p{L}]", "")) / F.greatest(n, F.lit(1))).alias("b"))
    mean = lambda c, k: F.avg(F.when(F.col("quality") == k, F.col(c)))
    m = seen.agg(*[mean(c, k).alias(f"{c}{k}") for c in "ab" for k in (0, 1)], *[F.var_pop(c).alias(f"v{c}") for c in "ab"]).first().asDict()

    def load():
        import math

        def score(t: str) -> float:
            x = {"a": math.log1p(len(t)), "b": sum(map(str.isalpha, t)) / max(len(t), 1)}
            return 1 / (1 + math.exp(-sum(((x[c] - m[f"{c}0"]) ** 2 - (x[c] - m[f"{c}1"]) ** 2) / (2 * m[f"v{c}"]) for c in "ab")))

        return score

    def broken():
        raise OSError("no weights")

    docs = texts(spark, sf_dir)
    states = [scorer.score_with(docs, f).select("doc_id", F.lit(name).alias("state"), "model_score.enabled", "model_score.available", F.round("model_score.score", 6).alias("score"), "model_score.detail") for name, f in (("off", None), ("broken", broken), ("on", load))]
    return states[0].unionByName(states[1]).unionByName(states[2])


def model_score(spark, sf_dir, texts=whole):
    """The scores of the model that is there."""
    return model_states(spark, sf_dir, texts).filter("state = 'on'").select("doc_id", "enabled", "available", "score")


_APART = " + ".join(f"((({e}) - {c}0) ** 2 - (({e}) - {c}1) ** 2) / (2 * v{c})" for c, e in _SEEN.items())
MODEL_STATES = f"""WITH {_SQL_DOCS}, x AS (SELECT quality, {", ".join(f"{e} AS {c}" for c, e in _SEEN.items())} FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL AND text IS NOT NULL),
m AS (SELECT {", ".join(f"avg({c}) FILTER (quality = {k}) AS {c}{k}" for c in _SEEN for k in (0, 1))}, {", ".join(f"var_pop({c}) AS v{c}" for c in _SEEN)} FROM x)
SELECT doc_id, 'off' AS state, false AS enabled, false AS available, NULL::DOUBLE AS score, NULL::VARCHAR AS detail FROM docs UNION ALL SELECT doc_id, 'broken', true, false, NULL, 'no weights' FROM docs
UNION ALL SELECT doc_id, 'on', true, true, round(1 / (1 + exp(-({_APART}))), 6), NULL FROM docs, m"""


MODEL_SCORE = f"SELECT doc_id, enabled, available, score FROM ({MODEL_STATES}) WHERE state = 'on'"


def rendered(spark, sf_dir, texts=whole):
    """Texts with marks around their most machine-like sentences, and around hidden characters, within them or apart."""
    docs = texts(spark, sf_dir)
    top = metrics.top_segments(docs, ["doc_id"]).select("doc_id", F.col("start").alias("s"), F.col("end").alias("e"), F.lit("mark").alias("tag"))
    marks = docs.select("doc_id", F.explode(hidden.scan(F.col("text"))).alias("f")).select("doc_id", F.col("f.index").alias("s"), (F.col("f.index") + 1).alias("e"), F.col("f.kind").alias("tag"))
    out = render.rendered(docs, ["doc_id"], top.unionByName(marks))
    return out.select("doc_id", F.md5("rendered").alias("rendered_md5"), F.char_length("rendered").cast("long").alias("chars"))


_ESCAPED = "replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
RENDERED = f"""WITH {_SQL_DOCS}, top AS (WITH {SEGMENTS[len(f"WITH {_SQL_DOCS}, ") :]}), {_CHARS}, spans AS (SELECT doc_id, start AS s, "end" AS e, 'mark' AS tag FROM top UNION ALL SELECT doc_id, i, i + 1, {_KIND} FROM chars WHERE {_KIND} IS NOT NULL),
marks AS (SELECT doc_id, s AS place, 1 AS opens, -e AS o, '<' || tag || '>' AS m FROM spans UNION ALL SELECT doc_id, e, 0, -s, '</' || tag || '>' FROM spans),
cut AS (SELECT *, coalesce(lag(place) OVER (PARTITION BY doc_id ORDER BY place, opens, o), 0) AS prev FROM marks),
built AS (SELECT doc_id, string_agg({_ESCAPED.format("text[prev + 1:place]")} || m, '' ORDER BY place, opens, o) AS head, max(place) AS last FROM cut JOIN docs USING (doc_id) GROUP BY doc_id),
done AS (SELECT doc_id, coalesce(head || {_ESCAPED.format("text[last + 1:]")}, {_ESCAPED.format("text")}) AS t FROM docs LEFT JOIN built USING (doc_id))
SELECT doc_id, md5(t) AS rendered_md5, CAST(length(t) AS BIGINT) AS chars FROM done"""


def findings_report(spark, sf_dir, texts=whole):
    return src.findings_json(hidden.findings(texts(spark, sf_dir)), ["doc_id"])


#: The reader's form of JSON: two blanks a level, a list's braces on the lines of its brackets.
_ENTRY = r"""'{\n    "kind" : "' || kind || '",\n    "char" : ' || to_json(c) || ',\n    "codepoint" : "' || codepoint || '",\n    "index" : ' || i || ',\n    "note" : ' || to_json(note) || '\n  }'""".replace(r"\n", "' || chr(10) || '")
FINDINGS_REPORT = f"""WITH {_SQL_DOCS}, {_CHARS}, {_SWAPPED},
every AS (SELECT doc_id, 0 AS part, i, c, {_KIND} AS kind, CASE c {_NOTES} ELSE 'UNKNOWN' END AS note FROM chars WHERE {_KIND} IS NOT NULL UNION ALL SELECT doc_id, 1, i, c, 'homoglyph', 'normalizes to ' || d FROM swapped WHERE c <> d AND NOT regexp_full_match(c, '{_WHITE}')),
listed AS (SELECT doc_id, string_agg({_ENTRY}, ', ' ORDER BY part, i) AS found FROM (SELECT *, {_CODE} AS codepoint FROM every) GROUP BY doc_id)
SELECT doc_id, '{{' || chr(10) || '  "findings" : [ ' || CASE WHEN found IS NULL THEN '' ELSE found || ' ' END || ']' || chr(10) || '}}' AS report FROM docs LEFT JOIN listed USING (doc_id)"""

# State

CAPACITY, WINDOW_S = 3, 86_400.0


def admission(spark, sf_dir):
    """Requests of each user, at most CAPACITY in WINDOW_S seconds."""
    events = table(spark, sf_dir, "events").select("event_id", F.col("user_id").cast("string").alias("key"), F.unix_seconds(F.col("ts").cast("timestamp")).cast("double").alias("ts"))
    return adm.admission(events, CAPACITY, WINDOW_S)


def admission_ranges(spark, sf_dir):
    """The same with each user's requests in ranges of time: eight ranges of all requests, walked apart and mended where they meet."""
    events = table(spark, sf_dir, "events").select("event_id", F.col("user_id").cast("string").alias("key"), F.unix_seconds(F.col("ts").cast("timestamp")).cast("double").alias("ts"))
    return adm.admission_in_ranges(events, CAPACITY, WINDOW_S, range_rows=max(1, -(-events.count() // 8)))


ADMISSION = f"""WITH RECURSIVE e AS (SELECT event_id, user_id, floor(epoch(ts))::DOUBLE AS t, row_number() OVER (PARTITION BY user_id ORDER BY floor(epoch(ts)), event_id) AS i FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
run AS (SELECT event_id, user_id, t, i, [t] AS kept, true AS allowed, 0::BIGINT AS retry FROM e WHERE i = 1
 UNION ALL SELECT n.event_id, n.user_id, n.t, n.i, CASE WHEN len(k) < {CAPACITY} THEN list_append(k, n.t) ELSE k END, len(k) < {CAPACITY}, CASE WHEN len(k) < {CAPACITY} THEN 0 ELSE CAST(floor(greatest(0, {WINDOW_S} - (n.t - k[1]))) AS BIGINT) + 1 END
 FROM (SELECT e.*, list_filter(run.kept, lambda x: x >= e.t - {WINDOW_S}) AS k FROM run JOIN e ON e.user_id = run.user_id AND e.i = run.i + 1) n)
SELECT event_id, CAST(user_id AS VARCHAR) AS key, t AS ts, allowed, retry AS retry_after_s FROM run"""


QUERIES = (
    detect_verdict, leading_signals, validate_docs, token_stats, lexicon_hits, verdict_by_source, labels_vs_score, conversation_roles, top_segments, phrase_places, structural_burstiness, invisible_findings, finding_counts, clean_text, line_kinds, protected_spans, merged_spans, findings_in_spans, segments_over_spans, merge_ranges,
    rule_audit, post_audit, tell_scrub, thousands, headings, lexical_swap, restructure, vary_vocabulary, post_polish, swap_candidates, swapped_words, rewritten, before_after, detect_report, model_score, model_states, rendered, findings_report, admission, admission_ranges,
)


#: DuckDB takes only ASCII letters as part of a word at \b; the reference and Spark take all ('übe den' holds no 'be'). The first queries' texts have no others there.
_ASCII_PASSIVE = f"regexp_extract_all(text, '{metrics.PASSIVE['en'].replace(chr(39), chr(39) * 2)}')"
_PASSIVE = _ASCII_PASSIVE.replace("(text,", r"(regexp_replace(text, '[^\x00-\x7F\P{L}]', '_', 'g'),")

def queries():
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    known = {
        "detect_verdict": DETECT, "leading_signals": LEADING, "validate_docs": VALIDATE, "token_stats": TOKEN_STATS, "lexicon_hits": LEXICON_HITS, "verdict_by_source": VERDICT_BY_SOURCE, "labels_vs_score": LABELS, "conversation_roles": ROLES, "top_segments": SEGMENTS, "phrase_places": PHRASE_PLACES, "structural_burstiness": STRUCTURAL, "findings_in_spans": FINDINGS_IN_SPANS, "segments_over_spans": SEGMENTS_OVER_SPANS,
        "invisible_findings": FINDINGS, "finding_counts": COUNTS, "clean_text": CLEAN, "line_kinds": LINE_KINDS, "merge_ranges": MERGE, "rule_audit": _rule_audit_sql(rules.TELLS), "post_audit": _rule_audit_sql(_POST), "tell_scrub": _tell_scrub_sql(), "swap_candidates": SWAP_CANDIDATES, "swapped_words": _swapped_sql(), "lexical_swap": _swapped_sql(), "headings": _headings_sql(), "model_score": MODEL_SCORE, "model_states": MODEL_STATES, "rendered": RENDERED, "admission": ADMISSION, "admission_ranges": ADMISSION, "detect_report": _detect_report_sql(), "findings_report": FINDINGS_REPORT, "protected_spans": PROTECTED, "merged_spans": MERGED_SPANS, "thousands": THOUSANDS,
    }
    return {k: v.replace(_ASCII_PASSIVE, _PASSIVE) for k, v in known.items()}
