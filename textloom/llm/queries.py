"""The registered queries of the operators in this subpackage, with their production parameters."""

from __future__ import annotations

from . import common
from .common import table


def op1_sentencepiece(spark, sf_dir):
    from .sentencepiece_sa import encode_and_decode

    return encode_and_decode(table(spark, sf_dir, "documents"), common.tokenizer_path("piece_bpe_32k.model"))


def op2_token_files(spark, sf_dir):
    from .token_files import encode_to_files

    return encode_to_files(spark, table(spark, sf_dir, "documents"), common.tokenizer_path("byte_bpe_50k.json"), end_id=2, vocabulary=50257).drop("shard")


def op3_chat_tree(spark, sf_dir):
    from .chat_tree import chat_tree, read_back

    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    tokenizer = common.tokenizer_path("byte_bpe_50k.json")
    return read_back(*chat_tree(rows, tokenizer), tokenizer).drop("n_ids")


#: The same from the conversations themselves, with the lengths of the template's marks.
OP3 = r"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
 UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
f AS (SELECT *, length(regexp_replace(text, '([<\[])(\\*)(s>|/s>|INST\]|/INST\]|ROLE:|/ROLE\]|\|endoftext\|>)', '\1\\\2\3', 'g')) + CASE role WHEN 'user' THEN 18 WHEN 'assistant' THEN 6 ELSE 18 + length(url_encode(role)) END AS chars FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
 CAST(length(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS BIGINT) AS loss_chars,
 sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256, CAST(sum(chars) AS BIGINT) AS formatted_chars FROM f GROUP BY conv_id"""


def op4_toxicity(spark, sf_dir):
    from .toxicity import held_out, learned, toxicity

    docs = table(spark, sf_dir, "documents")
    scored = toxicity(docs, learned(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted", "n_hits", "n_words")


def op5_license_scan(spark, sf_dir):
    from .license_scan import license_scan

    return license_scan(table(spark, sf_dir, "documents")).drop("places")


def op6_lm_scores(spark, sf_dir):
    from .lm_scoring import lm_scores

    return lm_scores(table(spark, sf_dir, "documents"))


def op7_decontamination(spark, sf_dir):
    from .decontaminate import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_jaccard_join(spark, sf_dir):
    from .jaccard_join import jaccard_join

    return jaccard_join(table(spark, sf_dir, "documents"), k=3, percent=90)


def op9_token_counts(spark, sf_dir):
    from .token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), common.tokenizer_path("byte_bpe_50k.json"), limit=512)


def op10_winnowing(spark, sf_dir):
    from .winnowing import edited_fingerprints

    return edited_fingerprints(table(spark, sf_dir, "documents"))


def op11_spelling_variants(spark, sf_dir):
    from .spelling import spelling_variants

    return spelling_variants(table(spark, sf_dir, "documents"))


def op12_personal_data(spark, sf_dir):
    from .personal_data import personal_data

    return personal_data(table(spark, sf_dir, "documents"))


def op13_source_divergence(spark, sf_dir):
    from .source_divergence import source_divergence

    return source_divergence(table(spark, sf_dir, "documents"))


#: All sources by all kept terms, zeros included, in whole numbers of any size.
OP13 = r"""WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM d),
kept AS (SELECT lang, t FROM w GROUP BY lang, t HAVING count(DISTINCT r) >= 10),
c AS (SELECT lang, source, t, count(*) AS n FROM w JOIN kept USING (lang, t) GROUP BY lang, source, t),
g AS (SELECT DISTINCT lang, source FROM d), v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang), ng AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY lang, source), nl AS (SELECT lang, sum(n) AS total FROM c GROUP BY lang),
cl AS (SELECT lang, t, sum(n) AS n FROM c GROUP BY lang, t),
p AS (SELECT lang, source, t, coalesce(n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(n, 0) + 2)) // (coalesce(total, 0) + 2 * v) AS p FROM g JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN c USING (lang, source, t) LEFT JOIN ng USING (lang, source)),
q AS (SELECT lang, t, 1 + (1000000000::HUGEINT * (n + 2)) // (total + 2 * v) AS q FROM cl JOIN v USING (lang) JOIN nl USING (lang)),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.t = b.t AND a.source <> b.source GROUP BY ALL
 UNION ALL SELECT a.lang, a.source, 'pair', b.source, 0 FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source WHERE a.lang NOT IN (SELECT lang FROM v)),
terms AS (SELECT lang, source, 'term' AS part, t AS item, (p - q) * (p - q) // (p + q) AS value FROM p JOIN q USING (lang, t) WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM r WHERE part = 'pair' OR rank <= 10"""


def queries():
    found = (op1_sentencepiece, op2_token_files, op3_chat_tree, op4_toxicity, op5_license_scan, op6_lm_scores, op7_decontamination, op8_jaccard_join, op9_token_counts, op10_winnowing, op11_spelling_variants, op12_personal_data, op13_source_divergence)
    return {f.__name__: f for f in found}


def oracle_sql():
    return {"op3_chat_tree": OP3, "op13_source_divergence": OP13}
