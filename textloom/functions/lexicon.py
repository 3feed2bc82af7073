"""Word lists as small tables. All are parameters of the operators; these are the defaults."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The word sets of the metrics.
TRANSITIONS = {
    "en": ["however", "moreover", "furthermore", "additionally", "consequently", "nevertheless", "nonetheless", "subsequently", "therefore", "thus", "hence", "indeed", "specifically", "particularly", "essentially"],
    "he": ["לפיכך", "בנוסף", "יתרה", "אולם", "ברם", "אומנם", "מאידך", "מכאן", "ולכן", "כך", "אכן", "במיוחד", "בפרט"],
}
HEDGES = {
    "en": ["might", "could", "may", "perhaps", "possibly", "seemingly", "arguably", "presumably", "likely", "potentially", "apparently", "supposedly"],
    "he": ["אולי", "ייתכן", "כנראה", "ככל", "כביכול", "לכאורה", "כפי", "נראה", "עשוי", "עשויה", "יתכן"],
}
QUANTIFIERS = {
    "en": ["many", "several", "various", "numerous", "multiple", "a lot", "a few", "plenty", "myriad", "plethora"],
    "he": ["רבים", "רבות", "מספר", "כמה", "מגוון", "שונים", "שונות", "מרובים", "המוני", "המון"],
}
PRONOUNS = {
    "en": ["i", "we", "us", "our", "you", "they", "them", "their", "it", "its", "he", "she", "him", "her", "his", "hers"],
    "he": ["אני", "אנחנו", "אנו", "אתה", "את", "אתם", "אתן", "הוא", "היא", "הם", "הן", "שלי", "שלנו", "שלך", "שלו", "שלה", "שלהם", "שלהן"],
}

# Lists of our own: frequent words by rank, machine-like words and phrases with plainer ones, synonyms, vocabulary swaps.
FREQUENT = {
    "en": "the of and to a in is it you that he was for on are with as his they at be this from have or by one had not but what all were when we there can an your which their said if do will each about how up out them then she many some so these would other into has more her two like him see time could no make than first been its who now people my made over did down only way find use may water long little very after words called just where most know".split(),
    "he": "של את על לא הוא זה היא עם כל אני גם כי או אם יש אבל מה היה רק יותר אין כמו בין עד לפני אחרי אחד".split(),
}
MACHINE_WORDS = {
    "en": {
        "leverage": ["use"], "utilize": ["use"], "robust": ["solid", "strong"], "seamless": ["smooth"], "comprehensive": ["full"], "pivotal": ["key"], "crucial": ["key"], "delve": ["look"], "facilitate": ["help"], "foster": ["build"],
        "tapestry": ["mix"], "multifaceted": ["complex"], "intricate": ["complex"], "holistic": ["whole"], "moreover": ["also"], "furthermore": ["also"], "streamline": ["simplify"], "underscore": ["show"], "additionally": ["also"], "consequently": ["so"],
        "nevertheless": ["still"], "nonetheless": ["still"], "paramount": ["vital"], "plethora": ["lot"], "myriad": ["many"], "realm": ["field"], "landscape": ["field"], "embark": ["start"], "endeavor": ["try"], "elevate": ["raise"],
        "harness": ["use"], "unleash": ["free"], "unlock": ["open"], "empower": ["help"], "enhance": ["improve"], "optimize": ["improve"], "bolster": ["support"], "garner": ["get"], "showcase": ["show"], "exemplify": ["show"],
        "elucidate": ["explain"], "meticulous": ["careful"], "meticulously": ["carefully"], "seamlessly": ["smoothly"], "effortlessly": ["easily"], "notably": ["mainly"], "arguably": ["perhaps"], "invaluable": ["useful"], "indispensable": ["needed"], "transformative": ["big"],
        "groundbreaking": ["new"], "innovative": ["new"], "dynamic": ["lively"], "vibrant": ["lively"], "bustling": ["busy"], "profound": ["deep"], "nuanced": ["subtle"], "compelling": ["strong"], "noteworthy": ["notable"], "commendable": ["good"],
        "testament": ["proof"], "cornerstone": ["base"], "beacon": ["guide"], "journey": ["path"], "synergy": ["teamwork"], "paradigm": ["model"], "ecosystem": ["system"], "stakeholders": ["people"], "actionable": ["useful"], "scalable": ["growing"],
        "proactive": ["early"], "proactively": ["early"], "mitigate": ["reduce"], "navigate": ["handle"], "resonate": ["connect"], "spearhead": ["lead"], "orchestrate": ["arrange"], "augment": ["add"], "cultivate": ["grow"], "ascertain": ["find"],
        "commence": ["begin"], "culminate": ["end"],
    },
    "he": {"מקיף": ["מלא"], "מכריע": ["חשוב"], "מורכב": ["סבוך"], "להטמיע": ["ליישם"]},
}
MACHINE_PHRASES = {
    "en": {
        "it is important to note": "note", "plays a crucial role": "matters", "a wide range of": "many", "in today's world": "today", "in the realm of": "in", "on the other hand": "but", "it is worth noting": "note", "it is worth mentioning": "note",
        "plays a vital role": "matters", "plays a pivotal role": "matters", "a testament to": "proof of", "at the end of the day": "finally", "in the ever-evolving": "in the changing", "in the world of": "in", "when it comes to": "with", "as a result of": "from",
        "in light of": "given", "in the face of": "despite", "a variety of": "many", "a multitude of": "many", "an array of": "many", "the importance of": "why", "in conclusion": "finally", "to sum up": "finally", "in summary": "finally",
        "first and foremost": "first", "last but not least": "last", "not only that": "also", "needless to say": "clearly", "it goes without saying": "clearly", "by and large": "mostly", "more often than not": "often", "for the most part": "mostly",
        "in many ways": "often", "to a certain extent": "partly", "on a regular basis": "often", "in close proximity": "near", "with the aim of": "to", "with a view to": "to", "in an effort to": "to", "as well as": "and", "in addition to": "besides",
        "take into consideration": "consider", "gain a deeper understanding": "learn", "shed light on": "explain", "pave the way for": "allow", "strike a balance": "balance", "stand the test of time": "last", "push the boundaries": "go further", "raise the bar": "do better",
        "open up new possibilities": "help", "unlock the potential": "use", "harness the power": "use", "foster a sense of": "build", "a deep dive into": "a look at",
    },
    "he": {"חשוב לציין": "נציין", "בעידן של היום": "היום"},
}
SYNONYMS = {
    "en": {
        "big": ["large"], "quick": ["fast"], "begin": ["start"], "help": ["aid"], "show": ["display"], "buy": ["purchase"], "large": ["big"], "people": ["folks"], "important": ["key"], "many": ["plenty of"], "small": ["little"], "often": ["frequently"],
        "use": ["apply"], "need": ["require"], "get": ["obtain"], "give": ["offer"], "find": ["spot"], "think": ["believe"], "try": ["attempt"], "ask": ["inquire"], "keep": ["hold"], "change": ["shift"], "end": ["finish"], "work": ["labor"], "job": ["task"],
        "problem": ["issue"], "idea": ["notion"], "plan": ["scheme"], "part": ["piece"], "place": ["spot"], "kind": ["sort"], "reason": ["cause"], "result": ["outcome"], "goal": ["aim"], "chance": ["shot"], "hard": ["tough"], "easy": ["simple"], "good": ["fine"],
        "bad": ["poor"], "new": ["fresh"], "old": ["aged"], "fast": ["quick"], "slow": ["sluggish"], "clear": ["plain"], "sure": ["certain"], "right": ["correct"], "wrong": ["mistaken"], "happy": ["glad"], "sad": ["unhappy"], "smart": ["bright"], "rich": ["wealthy"],
        "strong": ["sturdy"], "build": ["make"], "choose": ["pick"], "learn": ["study"], "speak": ["talk"], "allow": ["let"],
    },
    "he": {"גדול": ["רחב"], "מהיר": ["זריז"], "חשוב": ["מרכזי"]},
}
VOCABULARY = {
    "very": ["really", "quite"], "however": ["still", "yet"], "because": ["since"], "for example": ["say"], "important": ["big"], "different": ["other"], "difficult": ["tough"], "improve": ["lift"], "additional": ["more"], "approximately": ["about"],
    "assist": ["help"], "attempt": ["try"], "complete": ["finish"], "consider": ["weigh"], "currently": ["now"], "demonstrate": ["show"], "determine": ["find"], "ensure": ["make sure"], "especially": ["above all"], "frequently": ["often"], "immediately": ["at once"],
    "in addition": ["also"], "individuals": ["people"], "necessary": ["needed"], "obtain": ["get"], "primarily": ["mainly"], "provide": ["give"], "purchase": ["buy"], "require": ["need"], "significant": ["big"], "therefore": ["so"],
}
FRAGMENTS = ["And it shows.", "Simple as that.", "No surprise there.", "Worth a pause.", "That counts.", "Not by chance.", "Few would argue.", "And rightly so."]


def rows(frequent=FREQUENT, machine=MACHINE_WORDS) -> list[tuple]:
    """language, word, rank (of the last line a word stands on), is_machine, is_transition, is_hedge, is_quantifier, is_pronoun."""
    rows: dict[tuple[str, str], list] = {}

    def put(language, word, column, value=True):
        rows.setdefault((language, word), [None, False, False, False, False, False])[column] = value

    for language in ("en", "he"):
        for rank, word in enumerate(frequent.get(language, ()), 1):
            put(language, word.lower(), 0, rank)
        for column, words in enumerate((machine.get(language, {}), TRANSITIONS[language], HEDGES[language], QUANTIFIERS[language], PRONOUNS[language]), 1):
            for word in words:
                if " " not in word:
                    put(language, word, column)
    return [(*key, *value) for key, value in sorted(rows.items())]


def lexicon(spark: SparkSession, frequent=FREQUENT, machine=MACHINE_WORDS) -> DataFrame:
    """rows() as a table."""
    return spark.createDataFrame(rows(frequent, machine), "language string, word string, rank int, is_machine boolean, is_transition boolean, is_hedge boolean, is_quantifier boolean, is_pronoun boolean")


#: Rows of a table of words that may be broadcast.
BROADCAST_ROWS = 200_000
FLAGS = ("is_machine", "is_transition", "is_hedge", "is_quantifier", "is_pronoun")


def small(words: DataFrame) -> DataFrame:
    """A table of words, marked to be broadcast if a count says that it is small."""
    return F.broadcast(words) if words.count() <= BROADCAST_ROWS else words


def with_ranks(words: DataFrame, language: str, ranks: DataFrame) -> DataFrame:
    """A lexicon with the frequency list of one language replaced by ranks (word, rank), as sources.documents.word_list() and ranks() give them."""
    mine = words.filter(F.col("language") == language).drop("rank")
    new = mine.join(ranks.select(F.lower("word").alias("word"), F.col("rank").cast("int").alias("rank")).groupBy("word").agg(F.max("rank").alias("rank")), "word", "full")
    new = new.select(F.lit(language).alias("language"), "word", "rank", *[F.coalesce(c, F.lit(False)).alias(c) for c in FLAGS])
    return new.unionByName(words.filter(F.col("language") != language))


def with_flag(words: DataFrame, language: str, flag: str, listed: DataFrame) -> DataFrame:
    """A lexicon in which the words of a dictionary (word, ...) and no others of one language have a flag of FLAGS."""
    new = words.filter(F.col("language") == language).drop(flag).join(listed.select(F.lower("word").alias("word"), F.lit(True).alias(flag)).distinct(), "word", "full")
    new = new.select(F.lit(language).alias("language"), "word", "rank", *[F.coalesce(c, F.lit(False)).alias(c) for c in FLAGS])
    return new.unionByName(words.filter(F.col("language") != language))


def vocabulary_sizes(words: DataFrame) -> dict[str, int]:
    found = {r["language"]: r["n"] for r in words.groupBy("language").agg(F.count("rank").alias("n")).collect()}
    return {k: found.get(k, 0) for k in ("en", "he")}


def vocabulary_size(language: str, frequent=FREQUENT) -> int:
    return len({w.lower() for w in frequent.get(language, ())})
