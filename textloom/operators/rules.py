"""Ordered rewriting rules as tables, applied in order with an audit of what each one changed."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import batches
from . import lines


class Rule(NamedTuple):
    category: str
    pattern: str
    replacement: str
    tag: str


def _table(category: str, *rows: tuple[str, str, str]) -> list[Rule]:
    return [Rule(category, pattern, new, tag) for tag, pattern, new in rows]


# Patterns and replacements that have to be these for the same texts to come out.
_FIXED = [
    *_table(
        "vocab",
        ("delve", r"\bdelve into\b", "examine"),
        ("delves", r"\bdelves into\b", "examines"),
    ),
    *_table(
        "copula",
        ("serves_as", r"\b(?:serves|acts|functions) as (an?|the)\b", "is $1"),
    ),
    *_table(
        "redundant",
        ("in_order_to", r"\bin order to\b", "to"),
        ("due_to_the_fact", r"\bdue to the fact that\b", "because"),
        ("prior_to", r"\bprior to\b", "before"),
        ("number_of", r"\ba (?:large|significant) number of\b", "many"),
        ("at_this_point", r"\bat this point in time\b", "now"),
        ("in_the_event", r"\bin the event that\b", "if"),
        ("for_the_purpose", r"\bfor the purpose of\b", "for"),
        ("in_spite", r"\bin spite of the fact that\b", "although"),
    ),
    *_table(
        "hedging",
        ("may_possibly", r"\bmay possibly\b", "may"),
    ),
    *_table(
        "landscape",
        ("landscape", r"\bthe (?:digital|modern|current) landscape\b", "the field"),
        ("fast_paced", r"\bin today'?s fast[- ]paced world\b", "today"),
    ),
    *_table(
        "phrase",
        ("things_that", r"\bthings that actually ", "things that "),
        ("in_a_way", r"\bis done in a way that is\b", "is"),
        ("quick_win", r"\ba quick win\b", "a win"),
    ),
    *_table(
        "filler",
        ("end_of_day", r"\bAt the end of the day,?[ \t]*", ""),
        ("said_and_done", r"\bWhen all is said and done,?[ \t]*", ""),
        ("speak", r"\bThe results speak for themselves[.,:;!?][ \t]*", ""),
    ),
    *_table(
        "hacky",
        ("next_level", r"\btake your\s+(\w+)\s+to the next level\b", "improve your $1"),
        ("cutting_edge", r"\bcutting[- ]edge\b", "modern"),
        ("bridge", r"\bbridge the gap between\b", "connect"),
        ("state_of_the_art", r"\bstate[- ]of[- ]the[- ]art\b", "modern"),
        ("paradigm", r"\ba paradigm shift\b", "a change"),
    ),
]
# Rules of our own, by the same categories. Callers may pass others.
_OWN = [
    *_table(
        "vocab",
        ("signpost", r"\b(?:Furthermore|Moreover|Additionally),[ \t]+", ""),
        ("worth_noting", r"\bIt is (?:worth noting|important to note) that[ \t]+", ""),
        ("in_summary", r"\bIn (?:conclusion|summary|essence),[ \t]+", ""),
        ("showcases", r"\bshowcases\b", "shows"),
        ("underscores", r"\bunderscores the (?:importance|need)\b", "shows the need"),
        ("tapestry", r"\ba rich tapestry of\b", "a mix of"),
        ("plethora", r"\ba plethora of\b", "many"),
        ("myriad", r"\ba myriad of\b", "many"),
        ("pivotal", r"\bplays a (?:pivotal|vital|crucial) role in\b", "matters for"),
        ("testament", r"\bstands as a testament to\b", "shows"),
        ("meticulous", r"\bmeticulously (crafted|designed|planned)\b", "carefully $1"),
        ("embark", r"\bembark on a journey\b", "begin"),
        ("ever_evolving", r"\bever[- ]evolving\b", "changing"),
        ("seamlessly", r"\bseamlessly (integrates?|connects?|works?)\b", "$1"),
        ("elevate", r"\belevate your\b", "improve your"),
        ("needless", r"\bNeedless to say,[ \t]+", ""),
        ("that_being_said", r"\bThat being said,[ \t]+", ""),
    ),
    *_table(
        "copula",
        ("served_as", r"\b(?:served|acted|functioned) as (an?|the)\b", "was $1"),
        ("serve_as", r"\b(?:serve|act|function) as (?:the|an?)\b", "are"),
        ("stands_as", r"\bstands as (an?|the)\b", "is $1"),
        ("represents", r"\brepresents a (shift|change|step)\b", "is a $1"),
        ("remains_a", r"\bcontinues to be (an?|the)\b", "is still $1"),
        ("proves_to_be", r"\bproves to be (an?|the)\b", "is $1"),
    ),
    *_table(
        "redundant",
        ("with_regard", r"\bwith (?:regard|respect) to\b", "about"),
        ("has_the_ability", r"\bhas the ability to\b", "can"),
        ("have_the_ability", r"\bhave the ability to\b", "can"),
        ("majority", r"\bthe (?:vast )?majority of\b", "most"),
        ("each_and_every", r"\beach and every\b", "every"),
    ),
    *_table(
        "hedging",
        ("potentially", r"\b(could|might) potentially\b", "$1"),
        ("might_perhaps", r"\bmight perhaps\b", "might"),
        ("could_argue", r"\bone could argue that[ \t]+", ""),
        ("generally_speaking", r"\bGenerally speaking,[ \t]+", ""),
    ),
    *_table(
        "sycophantic",
        ("great_question", r"\b(?:Great|Excellent) question[!.][ \t]*", ""),
        ("absolutely_right", r"\bYou(?:'re| are) absolutely right[!.][ \t]*", ""),
        ("good_point", r"\bThat(?:'s| is) (?:a great|an excellent) point[!.][ \t]*", ""),
        ("happy_to_help", r"\bI(?:'d| would) be happy to help[!.][ \t]*", ""),
    ),
    *_table(
        "chatbot",
        ("hope_this_helps", r"\bI hope this helps[!.][ \t]*", ""),
        ("as_an_ai", r"\bAs an AI language model,[ \t]+", ""),
        ("let_me_know", r"\bLet me know if you have any (?:other |further )?questions[!.][ \t]*", ""),
        ("feel_free", r"\bFeel free to reach out[!.][ \t]*", ""),
    ),
    *_table(
        "landscape",
        ("digital_age", r"\bin the digital age\b", "today"),
        ("in_the_realm", r"\bin the (?:realm|world) of\b", "in"),
        ("forefront", r"\bat the forefront of\b", "leading"),
    ),
    *_table(
        "dive",
        ("deep_dive", r"\bdeep dive into\b", "look at"),
        ("dive_in", r"\blet'?s dive in[.!]?", ""),
        ("dive_deeper", r"\bdive deeper into\b", "look closer at"),
        ("lets_explore", r"\bLet'?s (?:explore|unpack) (?:this|it)[.!][ \t]*", ""),
    ),
    *_table(
        "phrase",
        ("what_matters", r"\bwhat (?:truly|really) matters\b", "what counts"),
        ("here_is_the_thing", r"\bhere's the thing[:,][ \t]+", ""),
        ("the_key_is", r"\bthe key here is to\b", "it helps to"),
        ("make_no_mistake", r"\bmake no mistake[:,][ \t]+", ""),
        ("in_other_words", r"\bin other words,[ \t]+", ""),
        ("simply_put", r"\bsimply put,[ \t]+", ""),
        ("the_bottom_line", r"\bthe bottom line is that\b", "in short,"),
        ("a_wide_range", r"\ba wide (?:range|variety|array) of\b", "many"),
        ("on_a_daily_basis", r"\bon a (?:daily|regular) basis\b", "often"),
        ("in_terms_of", r"\bin terms of how\b", "in how"),
        ("first_and_foremost", r"\bfirst and foremost\b", "first"),
        ("last_but_not_least", r"\blast but not least\b", "last"),
        ("the_fact_that", r"\bthe simple fact that\b", "that"),
        ("is_able_to", r"\bis able to\b", "can"),
        ("are_able_to", r"\bare able to\b", "can"),
        ("take_into_account", r"\btake into (?:account|consideration)\b", "consider"),
        ("with_that_in_mind", r"\bwith that in mind,[ \t]+", ""),
    ),
    *_table(
        "filler",
        ("to_be_clear", r"\bTo be clear,[ \t]*", ""),
        ("to_be_honest", r"\bTo be honest,[ \t]*", ""),
        ("truth_is", r"\bThe truth is,[ \t]*", ""),
        ("goes_without", r"\bIt goes without saying(?: that)?,?[ \t]*", ""),
        ("in_the_long_run", r"\bIn the grand scheme of things,?[ \t]*", ""),
        ("all_things", r"\bAll things considered,[ \t]*", ""),
        ("by_and_large", r"\bBy and large,[ \t]*", ""),
        ("as_we_know", r"\bAs we all know,[ \t]*", ""),
    ),
    *_table(
        "hacky",
        ("harness", r"\b(?:harness|unleash|unlock) the (?:full )?(?:power|potential) of\b", "use"),
        ("game_changer", r"\ba (?:real |true )?game[- ]changer\b", "a big change"),
        ("one_stop", r"\bone[- ]stop shop\b", "single place"),
        ("best_of_breed", r"\bbest[- ](?:of|in)[- ](?:breed|class)\b", "good"),
        ("move_the_needle", r"\bmoves? the needle\b", "helps"),
        ("low_hanging", r"\blow[- ]hanging fruit\b", "easy gains"),
        ("win_win", r"\ba win[- ]win\b", "good for both"),
        ("think_outside", r"\bthink outside the box\b", "be inventive"),
        ("synergy", r"\bcreates? synergies\b", "work together"),
        ("mission_critical", r"\bmission[- ]critical\b", "essential"),
        ("supercharge", r"\bsupercharge your\b", "speed up your"),
        ("skyrocket", r"\bskyrocket\b", "rise"),
        ("turbocharge", r"\bturbocharge\b", "speed up"),
        ("stay_ahead", r"\bstay ahead of the curve\b", "keep up"),
        ("raise_the_bar", r"\braises? the bar\b", "sets a standard"),
        ("hit_the_ground", r"\bhit the ground running\b", "start fast"),
        ("peace_of_mind", r"\bgives? you peace of mind\b", "reassures you"),
        ("future_proof", r"\bfuture[- ]proof\b", "lasting"),
        ("at_scale", r"\bscale new heights\b", "grow"),
        ("no_brainer", r"\ba no[- ]brainer\b", "easy"),
    ),
]


def _rules(*categories: str) -> list[Rule]:
    """The rules of some categories, category after category: fixed ones, then our own."""
    return [r for c in categories for r in (*_FIXED, *_OWN) if r.category == c]


TELLS = _rules("vocab", "copula", "redundant", "hedging", "sycophantic", "chatbot", "landscape", "dive")
PHRASES, FILLERS, HACKY = _rules("phrase"), _rules("filler"), _rules("hacky")
#: An empty adjective between a determiner and a common noun.
INTENSIFIER = r"(?i)\b(a|an|the|this|that|these|those|our|your|their|its|my)\s+(?:genuine|real|actual|truly|true|specific|deeper|deep)\s+(?=(?-i:[a-z][a-z'\-]{2,})\b)"


def sample(rule: Rule) -> str:
    """A text that the rule's pattern matches: the first of each choice, without what may be left out."""
    p, last = rule.pattern.replace(r"\b", ""), None
    while p != last:  # groups, innermost first
        last, p = p, re.sub(r"\((?:\?:)?([^()]*)\)(\??)", lambda m: "" if m[2] else m[1].split("|")[0], p)
    p = re.sub(r"\[ \\t\]\+|\\s\+", " ", re.sub(r"\[ \\t\]\*", "", p))
    p = re.sub(r"\[(.)[^\]]*\](\??)", lambda m: "" if m[2] else m[1], p)
    return re.sub(r".\?", "", p).replace(r"\w+", "work")


PHRASES.sort(key=lambda r: -len(sample(r)))  # longest first, so that no phrase takes a part of a longer one away


#: How many beginnings of a pattern's matches may be told apart.
MOST_HEADS = 48
_ATOM = re.compile(r"(?P<b>\\b)|(?P<group>\((?:\?:)?(?P<of>[^()\[\]\\{}*+.^$]*)\))|(?P<set>\[(?P<in>[^\[\]\\^]+)\])|(?P<one>[^()\[\]\\{}*+?.^$|])")
_SPELLED = re.compile(r"[A-Za-z' ]*(?:\??[A-Za-z' ]+)*\??")


def _spelled(choice: str) -> set[str]:
    """What a choice of plain characters, some of which may be left out, stands for."""
    out = {""}
    for m in re.finditer(r"(.)(\??)", choice):
        out = {o + x for o in out for x in ({m[1], ""} if m[2] else {m[1]})}
    return out


@lru_cache(maxsize=1024)
def heads(pattern: str) -> tuple[str, ...]:
    """Strings, lower-cased, with one of which every match of a pattern begins; none if they can't be told."""
    out, i = {""}, 0
    while m := _ATOM.match(pattern, i):
        if m["b"]:
            i = m.end()
            continue
        many = re.compile(r"[?*+{][?+]?").match(pattern, m.end())
        if many and many[0] != "?":
            break
        if m["group"]:
            if m["of"].startswith("?") or not all(map(_SPELLED.fullmatch, m["of"].split("|"))):
                break
            some = set().union(*map(_spelled, m["of"].split("|")))
        else:
            some = {m["one"]} if m["one"] else set(m["in"])
            if m["in"] and "-" in m["in"][1:-1]:
                break
        new = {o + x for o in out for x in (some | {""} if many else some)}
        if len(new) > MOST_HEADS or not all(x.isascii() for x in some):
            break
        out, i = new, many.end() if many else m.end()
    if "|" in re.sub(r"\((?:\?:)?[^()]*\)|\[[^\]]*\]", "", pattern):  # choices of the pattern as a whole
        return ()
    return tuple(sorted({o.lower() for o in out})) if "" not in out else ()


def plain_case(text: str) -> str:
    """A text's letters as heads() has them, place for place: with those that Python takes for i, k or s where case doesn't count."""
    return text.lower() if text.isascii() else text.replace("\u0130", "i").lower().replace("\u0131", "i").replace("\u017F", "s")


@lru_cache(maxsize=1024)
def _compiled(rule: Rule) -> tuple[re.Pattern, str, tuple[str, ...]]:
    return re.compile("(?i)" + rule.pattern), re.sub(r"\$(\d)", r"\\g<\1>", rule.replacement), heads(rule.pattern)


def may_match(low: str, rules: list[Rule]) -> bool:
    return any(not (h := heads(r.pattern)) or any(x in low for x in h) for r in rules)


def _applied(text: str, low: str, rule: Rule) -> tuple[str, int]:
    """re.subn() of a rule, tried only where a match may begin; low is plain_case(text)."""
    pattern, new, begins = _compiled(rule)
    if not begins:
        return pattern.subn(new, text)
    places = set()
    for x in begins:
        at = low.find(x)
        while at >= 0:
            places.add(at)
            at = low.find(x, at + 1)
    parts, done, n = [], 0, 0
    for at in sorted(places):
        if at >= done and (m := pattern.match(text, at)):
            parts += [text[done:at], m.expand(new)]
            done, n = m.end(), n + 1
    return ("".join([*parts, text[done:]]), n) if n else (text, 0)


def rule_counts(text: Column, rules: list[Rule]) -> Column:
    """array<struct<tag, n>> of the rules that match, in order, each counted on the text as the rules before it leave it. Null texts have none."""
    kind = pa.list_(pa.struct([("tag", pa.string()), ("n", pa.int32())]))

    @F.arrow_udf("array<struct<tag:string,n:int>>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            out = []
            for t in texts.to_pylist():
                counts: dict[str, int] = {}
                folded_text(t or "", rules, counts)
                out.append([{"tag": tag, "n": n} for tag, n in counts.items()])
            yield pa.array(out, kind)

    batches.small(SparkSession.getActiveSession())
    return run(text)


_BLANKS = re.compile(r"(?P<many>  +)|[ \t]+(?=[!?.,:;])")
_START = re.compile(r"[.!?][ \t]+[a-z]")
_BEFORE_END = tuple(" " + x for x in "!?.,:;")


def tidy(t: str | None) -> str | None:
    """One blank where there were several, none before an end mark, and a capital letter at the start and behind end marks of the same line."""
    if not t:
        return t
    if "  " in t or "\t" in t or any(x in t for x in _BEFORE_END):
        t = _BLANKS.sub(lambda m: " " if m["many"] else "", t)
        t = re.sub(r" (?=[!?.,:;])", "", t)  # of several blanks before an end mark one is left
    t = t[:1].upper() + t[1:] if "a" <= t[:1] <= "z" else t
    return _START.sub(lambda m: m[0][:-1] + m[0][-1].upper(), t)


def folded_text(text: str, rules: list[Rule], log: dict[str, int]) -> str:
    """The text after all rules, in order, whatever the case of letters; how often each matched goes to log, by tag."""
    low = plain_case(text)
    for r in rules:
        text, n = _applied(text, low, r)
        if n:
            log[r.tag] = log.get(r.tag, 0) + n
            low = plain_case(text)
    return text


def scrubbed(text: str, table: list[Rule] = TELLS) -> tuple[str, list[str]]:
    """The text with the rules applied outside protected spans (headings aren't protected), and what each changed."""
    low, counts = plain_case(text), {}
    if not may_match(low, table):
        return text, []
    new = lines.free_parts(text, lambda t: folded_text(t, table, counts), headings=False)
    return (tidy(new) if new != text else text), [f"tells:{r}:{counts[r]}" for r in dict.fromkeys(r.tag for r in table) if r in counts]


def scrub_tells(df: DataFrame, rules: list[Rule] = TELLS) -> DataFrame:
    """df with the rules applied to text outside protected spans, and `transformations`, an audit of layer:tag:count.

    Headings aren't protected here. A text that no rule changes stays as it is; null stays null. A look for what the rules' matches begin with settles most
    texts; only the others' spans are sought and their rules tried, in Arrow batches.
    """

    @F.pandas_udf("struct<text:string,log:array<string>>")
    def run(texts):
        import pandas as pd

        rows = [(None, []) if t is None else scrubbed(t, rules) for t in texts]
        return pd.DataFrame({"text": [None if new == old else new for (new, _), old in zip(rows, texts, strict=True)], "log": [x for _, x in rows]})

    batches.small(df.sparkSession)
    found = df.withColumn("_r", run.asNondeterministic()("text"))  # so marked, it is neither repeated nor merged with later steps
    return found.withColumn("text", F.coalesce("_r.text", "text")).withColumn("transformations", F.coalesce("_r.log", F.array().cast("array<string>"))).drop("_r")


_NUMBER = re.compile(r"(?<![\d,.\-])\d{4,}(?![\d,.])", re.ASCII)
_FOUR = re.compile(r"\d{4}", re.ASCII)
_YEAR = re.compile(r"(?:19|20)\d\d", re.ASCII)


def numbered(text: str) -> tuple[str, int]:
    """Commas at the thousands of whole numbers of four or more digits outside protected spans, and how many numbers that concerns.

    Years 1900 to 2099, decimals, numbers with commas already and numbers that end a sentence stay. Leading zeros go.
    """
    n = 0

    def one(m):
        nonlocal n
        if _YEAR.fullmatch(m[0]):
            return m[0]
        n += 1
        digits = m[0].lstrip("0") or "0"
        head = len(digits) % 3 or 3
        return ",".join([digits[:head], *(digits[i : i + 3] for i in range(head, len(digits), 3))])

    return lines.free_parts(text, lambda t: _NUMBER.sub(one, t) if _FOUR.search(t) else t), n


def numbers(df: DataFrame) -> DataFrame:
    """df with numbered() texts, and n_changed, how many numbers it altered. Texts without such digits never leave the JVM's side of the batch."""

    @F.pandas_udf("struct<text:string,n:long>")
    def run(texts):
        import pandas as pd

        rows = [(None, 0) if t is None else numbered(t) for t in texts]
        return pd.DataFrame({"text": [t for t, _ in rows], "n": [n for _, n in rows]})

    batches.small(df.sparkSession)
    out = df.withColumn("_r", run.asNondeterministic()(F.when(F.col("text").rlike("[0-9]{4}"), F.col("text"))))
    return out.withColumn("text", F.coalesce("_r.text", "text")).withColumn("n_changed", F.coalesce("_r.n", F.lit(0)).cast("long")).drop("_r")
