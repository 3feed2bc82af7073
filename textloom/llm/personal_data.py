"""Personal data by weak supervision, in DataFrame expressions only: labelers vote on candidate spans, expectation-maximisation
weighs the labelers, and a classifier trained on its verdicts decides.

Base spans are matches of four fixed patterns that pass a check. Candidates are these, the matches that fail, and matches of wider patterns
(disguised addresses, other separators, national numbers). Four labelers vote for, against or not at all: the pattern's strict form and the check
(regex), lists of domains, networks, issuers and codes (gazetteer), and words before the span (context). Votes and a few signs of shape are counted
over all documents; there are at most a few thousand combinations, whatever the corpus. EM estimates from them how reliable each labeler is for
each kind, and so how likely each combination is; a logistic classifier learns that from votes and signs and adds the spans that it accepts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import before, let, running, sums
from . import common

KINDS = ("email", "ip", "card", "phone")
#: Fixed values, all as possessive and anchored as their meaning allows, so that a long run is read once: the base patterns.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_AT, _DOT = r"(?:\(at\)|\[at\]|\{at\})", r"(?:\(dot\)|\[dot\]|\{dot\}|\x20dot\x20|\.)"
_SEP = r"(?:[._/\u2013\u00A0]|\x20\x20)"
#: Wider patterns, looked for where no base span stands.
WIDE = {
    "email": rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:\x20?{_AT}\x20?[A-Za-z0-9-]++(?:\x20?{_DOT}\x20?[A-Za-z0-9-]++)++|\x20at\x20[A-Za-z0-9-]++(?:\x20dot\x20[A-Za-z0-9-]++)++)",
    "ip": r"(?<![0-9A-Za-z:.\]])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6}|[0-9]{1,3}(?:(?:\[\.\]|\(\.\)|\[dot\])[0-9]{1,3}){3})(?![0-9A-Za-z:\[])",
    "card": rf"(?<![0-9])(?:[0-9]{{4}}({_SEP})[0-9]{{4}}\1[0-9]{{4}}\1[0-9]{{1,7}}|[0-9]{{4}}({_SEP})[0-9]{{6}}\2[0-9]{{5}})(?![0-9])",
    "phone": r"(?<![0-9A-Za-z+.-])(?:\([0-9]{2,5}\)\x20?[0-9]{2,4}(?:[\x20.-][0-9]{2,5}){1,3}|00[1-9][0-9]{0,2}[\x20-][0-9]{1,4}(?:[\x20.-][0-9]{2,5}){1,4}|0[0-9]{2,4}[\x20/-][0-9]{2,4}(?:[\x20.-][0-9]{2,5}){1,3}|[2-9][0-9]{2}([-.\x20])[2-9][0-9]{2}\1[0-9]{4})(?![0-9A-Za-z])",
}
#: What a text must have for its patterns to be worth a look.
_QUICK = {"email": r"@|(?i)[(\[{\x20](?:at)[)\]}\x20]", "ip": r"[0-9]\.[0-9]|[0-9A-Fa-f]:|[\])][0-9]", "card": "[0-9]{4}|[0-9][\x20-][0-9]", "phone": r"\+[0-9]|[0-9]{2}[\x20)./-]\x20?[0-9]{2}"}
#: Fixed values, the gazetteers: top domains, networks that are nobody's, card issuers by first digits and length, calling and area codes.
DOMAINS = "com net org edu gov mil int info biz io co me app dev name example test de fr es it nl be lu at ch uk ie us ca mx br ar cl pe au nz jp cn kr in sg il tr ru ua pl cz sk hu ro bg gr pt se no fi dk is ee lv lt eu".split()
NOBODYS = r"^0*(?:0|127|22[4-9]|23[0-9]|24[0-9]|25[0-5])\.|^::|^(?i)(?:fe80|f[cd][0-9a-f]{2}|ff[0-9a-f]{2})"
ISSUERS = r"^(?:4(?:[0-9]{12}|[0-9]{15}|[0-9]{18})|5[1-5][0-9]{14}|2(?:22[1-9]|2[3-9][0-9]|[3-6][0-9]{2}|7[01][0-9]|720)[0-9]{12}|3[47][0-9]{13}|3(?:0[0-5]|[68][0-9])[0-9]{11}|35[0-9]{14}|6(?:011|5[0-9]{2})[0-9]{12})$"
CALLING = r"^(?:\+|00)(?:1[2-9]|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|2[1-689][0-9]|3[578][0-9]|42[0-9]|5[09][0-9]|6[789][0-9]|8[05789][0-9]|9[679][0-9])|^\(?0[1-9]|^\(?[2-9][0-9]{2}[).\x20-]"
#: Words before a span that speak for its kind, and such as speak against any.
CUES = {
    "email": "e-?mails?|mails?|mailto|contact|correo|courriel|write to|kontakt", "ip": "ip|ipv[46]|hosts?|address|adresse|server|client|login|from",
    "card": "cards?|visa|mastercard|amex|credit|debit|karte|carte|tarjeta|payment", "phone": "phone|tel|telephone|call|mobile|cell|fax|whatsapp|sms|telefon|t[ée]l[ée]phone|tel[ée]fono|handy",
}
AGAINST = "version|ver|v|release|isbn|issn|doi|order|invoice|page|pages|section|chapter|serial|sku|part|sha|hash|token|id"
#: Code points before a span that are read for such words.
REACH = 40
LABELERS, SIGNS = ("form", "listed", "cue", "check"), ("glued", "bracketed", "long")
#: The belief that stands in for data: how often a labeler votes for, not, or against a span, true or false, worth so many spans; and the classifier's.
TRUE_VOTES, FALSE_VOTES, BELIEF, PRIOR_TRUE = (0.7, 0.27, 0.03), (0.2, 0.4, 0.4), 20.0, 0.5
_RIDGE = 5.0


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether the check digit of a string of digits is right."""
    each = F.filter(F.split(F.reverse(number), ""), lambda c: c != "")
    value = F.transform(each, lambda c, i: F.when(i % 2 == 1, c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)).otherwise(c.cast("int")))
    return F.aggregate(value, F.lit(0), lambda a, x: a + x) % 10 == 0


def passes(kind: str, value: Column) -> Column:
    """The check of a kind, on strict and on wider matches alike."""
    if kind == "email":
        return F.char_length(value) <= 254
    if kind == "ip":
        return F.regexp_replace(value, r"[\[(](?:\.|dot)[\])]", ".").rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.(?!$)|$)){4}$") | value.rlike("^(?=.*[0-9])[0-9A-Fa-f:]*:[0-9A-Fa-f:]*$")
    n = F.char_length(digits(value))
    return n.between(9, 15) if kind == "phone" else F.when(n.between(13, 19), luhn(digits(value))).otherwise(False)


def kept(kind: str, value: Column) -> Column:
    """Whether a match of the base pattern is a base span."""
    return F.lit(True) if kind == "email" else passes(kind, value)


def listed(kind: str, value: Column) -> Column:
    if kind == "email":
        return F.lower(F.regexp_extract(value, "([A-Za-z0-9-]+)$", 1)).isin(DOMAINS)
    if kind == "ip":
        return ~value.rlike(NOBODYS)
    return digits(value).rlike(ISSUERS) if kind == "card" else F.regexp_replace(value, r"^(\+)[\x20(]*", "$1").rlike(CALLING)


def matches(text: Column, pattern: str) -> Column:
    """array<struct<s, e, value, left, right>> of a pattern's matches, in order: places in code points, and what stands beside them.

    Places add up from the lengths of the matches and of what is between them.
    """
    def placed(x: Column) -> Column:
        m, between = x["m"], x["q"]
        ends = sums(F.transform(m, lambda v, i: (F.char_length(F.get(between, i)) + F.char_length(v)).cast("long")))
        return let(ends, lambda e: F.transform(m, lambda v, i: F.struct((F.get(e, i) - F.char_length(v)).alias("s"), F.get(e, i).alias("e"), v.alias("value"), F.right(F.get(between, i), F.lit(REACH)).alias("left"), F.left(F.get(between, i + 1), F.lit(1)).alias("right"))))

    p = F.lit(pattern)
    return let(F.struct(F.regexp_extract_all(text, p, F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("q")), placed)


def voted(kind: str, strict: bool, found: Column) -> Column:
    """Spans with their votes (-1, 0, 1) and signs."""
    def vote(good: Column, bad: Column) -> Column:
        return F.when(good, 1).when(bad, -1).otherwise(0)

    def one(x: Column) -> Column:
        v, left, right = x["value"], x["left"], x["right"]
        cue = vote(left.rlike(rf"(?i)\b(?:{CUES[kind]})\b[^\n]{{0,16}}$"), left.rlike(rf"(?i)\b(?:{AGAINST})\b[^\n]{{0,6}}$"))
        votes = (F.lit(1 if strict else 0), vote(listed(kind, v), ~listed(kind, v)), cue, vote(passes(kind, v), ~passes(kind, v)))
        signs = (left.rlike(r"[\p{L}\p{N}_]$") | right.rlike(r"^[\p{L}\p{N}_]"), left.rlike(r"[(\[{<\"']$"), F.char_length(v) > 24)
        base = kept(kind, v) if strict else F.lit(False)
        return F.struct(F.lit(KINDS.index(kind)).alias("kind"), x["s"].alias("s"), x["e"].alias("e"), base.alias("base"), *[c.cast("int").alias(n) for n, c in zip((*LABELERS, *SIGNS), (*votes, *signs), strict=True)])

    return F.transform(found, one)


def free(spans: Column) -> Column:
    """The spans (s, e, base, ...) that are base or touch no base span of their own text: one pass each way over the sorted spans."""
    def one(x: Column) -> Column:
        first = F.lit(-1).cast("long")
        ends = let(running(F.transform(x, lambda r: F.when(r["base"], r["e"]).otherwise(first)), lambda a, b: F.greatest(a, b)), lambda e: before(e, first))
        last = F.lit(1 << 62).cast("long")
        turned = F.reverse(F.transform(x, lambda r: F.when(r["base"], r["s"]).otherwise(last)))
        starts = let(running(turned, lambda a, b: F.least(a, b)), lambda s: F.reverse(before(s, last)))
        return let(F.struct(ends.alias("ends"), starts.alias("starts")), lambda y: F.filter(x, lambda r, i: r["base"] | (F.get(y["ends"], i) <= r["s"]) & (F.get(y["starts"], i) >= r["e"])))

    return let(F.array_sort(spans, lambda a, b: F.when(a["s"] < b["s"], -1).when(a["s"] > b["s"], 1).when(a["base"] & ~b["base"], -1).when(~a["base"] & b["base"], 1).otherwise(0)), one)


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id and spans of each row of docs (doc_id, text): base spans, and candidates that touch none."""
    text, every = F.col("text"), []
    for kind in KINDS:
        mine = [voted(kind, strict, matches(text, patterns[kind])) for strict, patterns in ((True, BASE), (False, WIDE))]
        every.append(F.when(text.rlike(_QUICK[kind]), F.concat(*mine)))
    some = F.flatten(F.array_compact(F.array(*every)))
    return docs.select("doc_id", let(some, lambda s: F.when(F.size(s) > 1, free(s)).otherwise(s)).alias("spans"))


@dataclass(frozen=True)
class Model:
    """reliabilities: for each kind, the share of true spans and each labeler's votes (for, none, against) on true and on false ones.
    weights: for each kind the classifier's bias, then a weight for each vote for, each vote against, and each sign."""

    reliabilities: tuple
    weights: tuple[tuple[float, ...], ...]


def em(votes, counts, steps: int = 500, least: float = 1e-10):
    """How likely the spans of each row are true, the share of true ones, and each labeler's votes (labeler, true or false, vote) by EM.

    votes: rows of -1, 0, 1; counts: how many spans have them. Labelers are taken to err independently; beliefs count as BELIEF spans.
    """
    import numpy as np

    prior = np.array([FALSE_VOTES, TRUE_VOTES])[None].repeat(votes.shape[1], 0)
    share, table, which, last = PRIOR_TRUE, prior, 1 - votes, None
    labeler = np.arange(votes.shape[1])
    for _ in range(steps):
        log = np.log([1 - share, share])[None] + np.log(table[labeler[None], :, which]).sum(1)
        true = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -500, 500)))
        if last is not None and np.abs(true - last).max(initial=0.0) < least:
            break
        last = true
        weight = np.stack([1 - true, true], 1) * counts[:, None]
        share = (weight[:, 1].sum() + BELIEF * PRIOR_TRUE) / (weight.sum() + BELIEF)
        seen = np.stack([[[weight[which[:, j] == v, y].sum() for v in range(3)] for y in range(2)] for j in labeler]) if len(votes) else 0 * prior
        table = (seen + BELIEF * prior) / (np.sum(seen, 2, keepdims=True) + BELIEF)
    return true, share, table


def features(votes, signs):
    import numpy as np

    return np.concatenate([np.ones((len(votes), 1)), votes == 1, votes == -1, signs], 1).astype(float)


def believed() -> list[float]:
    """The classifier's weights before it has seen anything: what the beliefs about votes amount to. Signs of shape speak against a span or not at all."""
    import math

    ratio = [math.log(t / f) for t, f in zip(TRUE_VOTES, FALSE_VOTES, strict=True)]
    n = len(LABELERS)
    return [n * ratio[1], *[ratio[0] - ratio[1]] * n, *[ratio[2] - ratio[1]] * n, -1.0, 0.0, 0.0]


def trained(x, true, counts, start):
    """Logistic weights by Newton's method, fitted to likelihoods rather than labels and drawn towards `start`."""
    import numpy as np

    w, start = np.array(start), np.array(start)
    x, y, n = np.concatenate([x, x]), np.concatenate([np.ones(len(x)), np.zeros(len(x))]), np.concatenate([counts * true, counts * (1 - true)])
    n = n / max(1.0, n.sum() / 10_000)  # a large corpus leaves the belief its say
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + _RIDGE * np.eye(len(w)), x.T @ (n * (y - p)) - _RIDGE * (w - start))
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return w


def learned(spans: DataFrame) -> Model:
    """The model of candidates(). What comes to the driver are counts of combinations of kind, votes and signs: 4 * 3^4 * 2^3 at most."""
    import numpy as np

    names = ("kind", *LABELERS, *SIGNS)
    rows = spans.select(F.inline("spans")).groupBy(*names).count().collect()
    table = np.array(sorted(tuple(r) for r in rows), float).reshape(-1, len(names) + 1)
    reliabilities, weights = [], []
    for kind in range(len(KINDS)):
        mine = table[table[:, 0] == kind]
        votes, signs, counts = mine[:, 1 : 1 + len(LABELERS)].astype(int), mine[:, 1 + len(LABELERS) : -1], mine[:, -1]
        true, share, by_vote = em(votes, counts)
        reliabilities.append((float(share), by_vote.round(6).tolist()))
        weights.append(tuple(round(float(w), 6) for w in trained(features(votes, signs), true, counts, believed())))
    return Model(tuple(reliabilities), tuple(weights))


def likelihood(model: Model, x: Column) -> Column:
    """The classifier's say on a candidate, 0 to 1."""
    parts = [F.lit(1.0), *[(x[n] == 1).cast("double") for n in LABELERS], *[(x[n] == -1).cast("double") for n in LABELERS], *[x[n].cast("double") for n in SIGNS]]
    total = None
    for kind, weights in enumerate(model.weights):
        say = sum((F.lit(w) * p for w, p in zip(weights, parts, strict=True)), F.lit(0.0))
        total = F.when(x["kind"] == kind, say) if total is None else total.when(x["kind"] == kind, say)
    return 1 / (1 + F.exp(-total))


def personal_data(df: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added of each row of df (doc_id, text).

    n_*: base spans of each kind, which are leftmost matches that do not overlap within their kind; a match that fails its kind's check is
    dropped. base_sha256: of the base spans as kind:start:end (code points, end exclusive), joined by commas, by kind as in KINDS, then start. spans: these
    and those of the others that pass their check and that the classifier accepts (half a chance or more), joined likewise. n_added: how many of them are its own; none touches a base span.

    Null and empty texts have no spans. Repeated rows stay; other columns are ignored; an empty table gives no rows. Texts are read once; what is
    found, without the texts, is a table in the shared folder. Nothing is shuffled but the counts of combinations.
    """
    found = common.stored(candidates(common.texts(df)), common.shared_folder(df.sparkSession), "spans")
    model = learned(found)

    def joined(spans: Column) -> Column:
        named = lambda x: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), x["kind"] + 1), x["s"].cast("string"), x["e"].cast("string"))
        return F.array_join(F.transform(F.array_sort(F.transform(spans, lambda x: F.struct(x["kind"], x["s"], x["e"]))), named), ",")

    base, every = F.filter("spans", lambda x: x["base"]), F.filter("spans", lambda x: x["base"] | (x["check"] >= 0) & (likelihood(model, x) >= 0.5))
    of = lambda k: F.filter("spans", lambda x: x["base"] & (x["kind"] == k))
    counts = [F.size(of(k)).cast("long").alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(every).alias("spans"), (F.size(every) - F.size(base)).cast("long").alias("n_added"))
