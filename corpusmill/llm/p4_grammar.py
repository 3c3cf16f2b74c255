"""Problem 4: abusive, hateful and sexual content, by a weighted finite-state pattern grammar.

Each clause of a text goes through machines that are composed:

1. spelling: look-alikes, leet digits, stars, spaced-out and stretched letters become plain words;
2. lexicon: each word becomes one symbol of a small alphabet of classes; names of groups that only these
   texts have are learned from labelled samples;
3. negation: a transducer that takes insults out of the reach of "is not";
4. reported speech and teaching: transducers that scale a clause down if it speaks about words, or
   about medicine, art and lessons without addressing the reader;
5. rules: a weighted acceptor of insults at a target, threats, curses, degraded groups, calls for harm,
   sexual acts and offers, built from named machines; it gives a clause its score by category.

Isolated words score nothing; a clause must be matched.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.machines import Acceptor, Composition, Transducer, run
from corpusmill.llm.words import fold
from corpusmill.plans.layout import table

CATEGORIES = ("abuse", "hate", "sexual")
#: A side is bad from this score on.
THRESHOLD = 1.0

# The classes of the lexicon, one symbol each. A word has one class.
CLASSES: dict[str, str] = {
    # second person, first person, third person
    "Y": "you your yours yourself yourselves u ur youre you're thou",
    "M": "i me my mine we our us i'll i'm i'd im ill we'll",
    "H": "he she they him her his their them hers theirs themselves himself herself",
    # be, modal, determiner, negation
    "B": "is are was were be been being am isn't aren't",
    "W": "will would should ought must shall gonna going deserve deserves",
    "D": "a an the this that these those every all whole some such one",
    "N": "not never no nobody none don't doesn't didn't won't cannot can't dont cant nothing",
    # strong insults; words that insult only beside a target or another insult; adjectives
    "I": "idiot idiots moron morons imbecile imbeciles cretin cretins halfwit halfwits dimwit dimwits loser losers "
    "coward cowards maggot maggots degenerate degenerates scumbag scum bootlicker bootlickers slob slobs creep creeps "
    "bum bums bastard bastards bitch jerk jackass dumbass asshole twat prick wanker dickhead fool fools nitwit "
    "numbskull scoundrel lowlife simpleton buffoon dunce retard whore slut",
    "J": "rat rats cow cows pig pigs weasel weasels clown clowns dog dogs snake snakes worm worms trash garbage waste "
    "failure animals animal vermin parasite parasites filth subhuman subhumans cockroaches plague disgrace brute swine "
    "leech leeches savages disease",
    "A": "stupid dumb filthy disgusting worthless useless pathetic stinking brainless fat lying ugly lazy dirty dense "
    "ignorant rotten miserable wretched hideous repulsive vile spineless gutless inferior",
    # dismissal, curse, harm, removal of people
    "F": "lost whining shut crawl dirt piss fuck screw",
    "C": "choke drown disappear rot die spit vanish croak",
    "K": "kill break burn beat beaten beating hang hanged sink sunk sinking freeze shoot stab strangle smash crush punch "
    "regret hurt destroy wiped driven exterminated gassed drowned shot lynched deported whipped slit murder",
    "R": "out back border fence away boat rid eradicated",
    "E": "breed hate trust hire steal lie marries marry ruined deserve belong wants table blood pray key cost",
    # to move or shut people away
    "O": "lock drive ship throw drag kick chase",
    # groups of people; others are learned, see learn_groups
    "G": "immigrant immigrants foreigner foreigners refugee refugees women woman men cripples cripple race jews muslims "
    "christians blacks whites gays lesbians arabs gypsies migrants natives elderly disabled believers atheists",
    # sexual: explicit nouns and adjectives; body and undressing; acts
    "X": "sex porn striptease erotic sexual horny orgasm blowjob masturbate nude nudes naked intercourse genitals penis "
    "vagina pornographic xxx fucking undress thrusting thrust",
    "S": "thighs breasts breast lips skirt trousers dress bra panties body bodies nipples clothes everything legs lap bed "
    "room tongue",
    "T": "moan moaning moaned screamed pleasure licked lick knelt kneel touch press pressed slid slide breathing came "
    "undressed pulled taste caress stroke begged wear wet opened pay tonight",
    # reporting and teaching words
    "Q": "insult insults calling called calls quoted quote quotes removed moderators moderator leaflet explains "
    "explained reported novel villain sneers sneered article condemned criticised criticized harms offensive slur slurs "
    "study studied",
    "L": "class clinic screening education contraception health statue doctor medical patient anatomy biology "
    "painting textbook lesson cancer gut harmless",
}
#: Words of the known patterns that need to be told apart from any other word; lower-case symbols.
CLASSES |= {
    "h": "hope", "g": "go get", "l": "like", "f": "favour favor", "w": "world", "b": "born", "m": "mouth face "
    "mother legs", "Z": "brain brains mind", "o": "only", "p": "people person", "k": "keep", "t": "too", "v": "loves love wanted", "d": "disgust "
    "sick sickens despise", "c": "children school", "r": "real", "u": "lol omg lmao", "e": "and or", "x": "phone oral hot "
    "favours pictures videos massage cam", "z": "send show tell come filmed want", "n": "someone somebody", "a": "what how",
    "i": "in into inside", "s": "so very really", "y": "off down open slowly", "j": "of", "q": "said says",
    "P": "peace luck applause style happily",
}

#: Machines that rules are built from.
NAMED = {
    "insult": "[A_]{0,3} I | A{1,3} [_j]{0,2} J",  # a strong insult, or an animal with an adjective
    "you_are": "Y s? B? D?",
    "group": "[Dpc_]? G | D [A_]? G",
    "low": "[DAs_]{0,3} [AJ]",
    "harm": "K Y | Y K | K [_D]{0,1} Y [A_]{0,2} [mZ_]",  # somebody harms the reader
    "ought": "W _? B .{0,5} K",
    "body": "S",
}
#: Weighted rules over symbols; _ is any other word and # a number.
RULES: list[tuple[str, float, str]] = [
    # abuse: an insult aimed at the reader or at a person
    ("abuse", 2.0, "<you_are> [A_s]{0,2} (?: I | A [_j]{0,2} J) | Y s? B D [A_s]{0,2} J | Y J $"),
    ("abuse", 2.0, "[au] D? <insult> [_Dj]{0,3} Y B"),
    ("abuse", 1.5, "[au] .{0,3} D [_]{0,1} <insult>"),
    ("abuse", 1.5, "a D <insult>"),
    ("abuse", 1.6, "F [ADYj_]{0,5} [IJ]"),
    ("abuse", 1.4, "^ g? F? <insult> $"),
    ("abuse", 1.4, "^ g F A"),
    ("abuse", 1.6, "[IJ] [A_]{0,2} Y .{0,4} A"),
    ("abuse", 1.5, "o D <insult> _{0,2} W"),
    ("abuse", 1.5, "[_HD] B D <insult> [_Hj]{0,4} W D? K"),
    ("abuse", 1.5, "Y _ (?:i _)? _? D <insult>"),
    ("abuse", 1.4, "p l Y W N"),
    ("abuse", 1.6, "a _ [D_] p B D A"),
    # abuse: looks and mind of the reader
    ("abuse", 1.4, "Y A [mZ]"),
    ("abuse", 1.4, "F Y [A_]{0,2} [mZ]"),
    ("abuse", 1.4, "Y [A_]{0,2} [mZ] .{0,6} [dA]"),
    ("abuse", 1.6, "Y _ D Z j"),
    ("abuse", 1.2, "B [D_] A .{0,3} Y [mZ]"),
    # abuse: threats and curses
    ("abuse", 2.0, "M W [^NMQ]{0,14} <harm>"),
    ("abuse", 2.0, "M K Y"),
    ("abuse", 1.8, "M h Y C [^P]{0,3} $ | M h Y C [^Pi] | M h Y C i [^P]"),
    ("abuse", 1.8, "g? C Y"),
    ("abuse", 1.8, "w D f .{0,3} C"),
    ("abuse", 1.6, "F R .{0,4} Y"),
    ("abuse", 1.6, "M C _ Y"),
    ("abuse", 1.6, "N v Y"),
    ("abuse", 1.6, "Y d M"),
    # hate: a group is degraded
    ("hate", 2.0, "<group> .{0,4} B [DAs_]{0,3} J"),
    ("hate", 2.0, "[HD] [cpG_]? .{0,2} B [DAs_]{0,2} [JA] (?:J|e|$)"),
    ("hate", 2.0, "G B t? <low>"),
    ("hate", 2.0, "H c B [AJ]"),
    ("hate", 2.0, "E l J"),
    ("hate", 1.8, "D D? [_G] B A (?:e A)"),
    ("hate", 1.8, "N (?:W )? E D? G .{0,4} [EA]"),
    ("hate", 1.8, "N E D? [_G] [DH] .{0,2} E"),
    ("hate", 1.8, "G .{0,6} H E B A"),
    ("hate", 1.8, "H D? E e E"),
    ("hate", 1.6, "N E D G"),
    ("hate", 1.6, "G N? .{0,2} N E .{0,5} H E .{0,2} R"),
    ("hate", 1.6, "E D [_j]{0,2} D? G .{0,4} E"),
    # hate: a call to harm or remove a group
    ("hate", 2.0, "[Gp_] .{0,8} <ought>"),
    ("hate", 2.0, "W .{0,8} [G_] _ B K R"),
    ("hate", 2.0, "[GH_] _ B K R"),
    ("hate", 1.6, "[kO] <group> (?:R|i)"),
    ("hate", 1.6, "G .{0,10} _ H K"),
    ("hate", 1.6, "n W g? [R_] [R_j]{0,2} H"),
    # sexual: acts, offers and descriptions
    ("sexual", 2.0, "<body> .{0,7} T .{0,5} T"),
    ("sexual", 2.0, "T .{0,8} T .{0,4} H _? <body> | T .{0,8} H _? <body> .{0,8} [TX] | X .{0,12} H _? <body>"),
    ("sexual", 2.0, "H <body> .{0,3} (?:e .{0,3})? T"),
    ("sexual", 2.0, "X .{0,3} e .{0,3} T"),
    ("sexual", 2.0, "X .{0,8} [SX]"),
    ("sexual", 2.0, "B X e .{0,6} [Xx]"),
    ("sexual", 1.8, "X Y .{0,8} [TS]"),
    ("sexual", 1.8, "z M .{0,3} (?:X|x) .{0,14} Y <body>"),
    ("sexual", 1.8, "z .{0,3} M? <body> .{0,8} T .{0,4} [Xx]"),
    ("sexual", 1.8, "z .{0,8} Y T .{0,5} <body>"),
    ("sexual", 1.8, "T <body> .{0,10} z .{0,3} T"),
    ("sexual", 1.8, "<body> B .{0,5} Y .{0,8} T"),
    ("sexual", 1.8, "T .{0,4} <body> y? .{0,10} (?:X|x x)"),
    ("sexual", 1.8, "z H _? X"),
    ("sexual", 1.6, "B _? X .{0,14} X"),
    ("sexual", 1.6, "M z _ X Y"),
]
#: "is not a ..." puts what follows out of reach: states after a form of be, and after its negation.
NEGATION = Transducer(
    {(0, "B"): (1, "*"), (1, "N"): (2, "*"), (1, "B"): (1, "*"), (1, "*"): (0, "*"), (2, "DAs"): (2, "_"), (2, "IJX"): (0, "_"), (2, "*"): (0, "*")}, {}
)
#: Words about words scale a clause down; "said" does unless the writer says it.
REPORTED = Transducer({(0, "Q"): (2, "*"), (0, "q"): (2, "*"), (0, "M"): (1, "*"), (1, "q"): (0, "_"), (1, "Q"): (2, "*"), (1, "*"): (0, "*")}, {2: 0.15})
#: So do lessons, medicine and art, unless the reader is addressed.
TEACHING = Transducer({(0, "L"): (1, "*"), (0, "Y"): (2, "*"), (1, "Y"): (2, "*")}, {1: 0.15})

LEET = str.maketrans({"1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "0": "o", "@": "a", "$": "s", "!": "i", "8": "b"})
TOKEN = re.compile(r"[a-z0-9@$#*!]*[a-z][a-z0-9@$#*!]*(?:'[a-z]+)?|[@$#*!0-9]{2,}|\d+|[.!?;]+(?=\s|$)|\n")
BREAKS = ".!?;\n"
SPACED = re.compile(r"(?<![^\W\d_])(?:[a-z0-9@$#*](?:\. ?| )){2,}[a-z0-9@$#*](?![^\W\d_])")
REPEAT = re.compile(r"(.)\1+")


class Lexicon:
    """Transducers 1 and 2: a word as spelt -> its class symbol, with a memory of words seen."""

    def __init__(self, groups: frozenset[str] = frozenset()) -> None:
        self.classes = {g: "G" for g in groups} | {w: s for s, ws in CLASSES.items() for w in ws.split()}
        self.squeezed = {}
        for w, s in self.classes.items():
            if len(w) > 3:
                self.squeezed.setdefault(REPEAT.sub(r"\1", w), s)
        for w in ("sex",):
            self.squeezed[w] = self.classes[w]
        self.by_size: dict[int, list[tuple[str, str]]] = {}
        for w, s in self.classes.items():
            if s in "IJAKXSTGFC" or w in ("you", "your"):
                self.by_size.setdefault(len(w), []).append((w, s))
        self.parts = {w: s for w, s in self.classes.items() if len(w) > 2} | {"a": "D", "an": "D"}
        self.parts |= {w: "_" for w in ("of", "piece", "space", "breathing", "heavily", "call")}
        self.memory: dict[str, str] = {}

    def symbol(self, token: str) -> str:
        found = self.memory.get(token)
        if found is None:
            if len(self.memory) > 200_000:
                self.memory.clear()
            found = self.memory[token] = self.look_up(token)
        return found

    def look_up(self, token: str) -> str:
        if token[0] in BREAKS and token.strip(BREAKS) == "":
            return "|"
        if token in self.classes:
            return self.classes[token]
        if token.isdigit():
            return "#"
        if len(token) == 1:
            return "1"  # perhaps a part of a word written apart
        plain = token.rstrip("!'").translate(LEET)
        if plain in self.classes:
            return self.classes[plain]
        if plain.endswith("'s") and plain[:-2] in self.classes:
            return self.classes[plain[:-2]]
        masked = "*" in plain or "#" in plain
        if masked and any(c.isalpha() for c in plain):
            for w, s in self.by_size.get(len(plain), []):
                if all(a == b or a in "*#" for a, b in zip(plain, w)):
                    return s
        if not masked:
            short = REPEAT.sub(r"\1", plain)
            if short != plain and short in self.squeezed:
                return self.squeezed[short]
            if "1" in token:
                again = token.replace("1", "l").translate(LEET)
                if again in self.classes:
                    return self.classes[again]
        return "_"

    def unspace(self, match: re.Match) -> str:
        """Letters written apart, as the words of the lexicon they spell, or as they stood."""
        run = re.sub(r"[ .]", "", match[0]).translate(LEET)
        best: list[list[str] | None] = [[]] + [None] * len(run)
        for end in range(1, len(run) + 1):
            for start in range(max(0, end - 14), end):
                if best[start] is not None and run[start:end] in self.parts:
                    words = [*best[start], run[start:end]]
                    if best[end] is None or len(words) < len(best[end]):
                        best[end] = words
        words = best[-1]
        if words is None or all(len(w) == 1 for w in words):
            whole = self.look_up(run)
            return run if whole != "_" else match[0]
        return " ".join(words)


@lru_cache(maxsize=4)
def lexicon(groups: frozenset[str] = frozenset()) -> Lexicon:
    return Lexicon(groups)


@lru_cache(maxsize=1)
def grammar() -> tuple[Composition, Acceptor]:
    """The composed transducers and the rules."""
    return Composition(NEGATION, Composition(REPORTED, TEACHING)), Acceptor(RULES, CATEGORIES, NAMED)


def text_symbols(text: str, groups: frozenset[str] = frozenset()) -> str:
    """The symbols of a text through spelling and lexicon; | stands between clauses."""
    lex = lexicon(groups)
    folded = fold(text)
    memory, symbol = lex.memory, lex.symbol
    symbols = "".join([memory.get(t) or symbol(t) for t in TOKEN.findall(folded)])
    if "1" in symbols:
        if symbols.count("1") >= 2 and SPACED.search(folded):
            symbols = "".join([symbol(t) for t in TOKEN.findall(SPACED.sub(lex.unspace, folded))])
        symbols = symbols.replace("1", "_")
    return symbols


#: Scores of clauses seen, by their symbols; emptied when full (only speed depends on it).
SEEN: dict[str, tuple[float, float, float]] = {}


def score_clause(symbols: str) -> tuple[float, float, float]:
    """Scores by category of one clause."""
    known = SEEN.get(symbols)
    if known is None:
        if len(SEEN) > 300_000:
            SEEN.clear()
        known = SEEN[symbols] = run(symbols, *grammar())
    return known


def score_text(text: str | None, groups: frozenset[str] = frozenset()) -> tuple[float, float, float]:
    """Highest clause score of each category; zeros for null and empty texts."""
    best = (0.0, 0.0, 0.0)
    if text:
        for symbols in text_symbols(text, groups).split("|"):
            found = SEEN.get(symbols) or score_clause(symbols)
            if any(found):
                best = tuple(map(max, best, found))
    return best


NAME_LIKE = re.compile(r"(?<=[a-z,] )(?<! in )(?<! at )(?<!from )(?<!near )(?<!until )[A-Z][a-z]{3,}")
#: Labelled texts that must have a word for it to be a group's name, and how many times more often than
#: other texts those labelled hate must have it.
GROUP_TEXTS, GROUP_TIMES = 3, 1.5
#: Bound of the labelled sample.
LABELLED = 20_000


def learn_groups(labels: DataFrame, text: str = "text", category: str = "category") -> frozenset[str]:
    """Names of groups in labelled texts: capital words inside sentences, not after words of place and time,
    that several texts have, those labelled hate more often than others.

    Reads at most LABELLED rows, chosen by a hash of the text; null texts and categories are left out.
    Without labels there are none, and the rules rest on the general lexicon.
    """
    rows = labels.where(F.col(text).isNotNull() & F.col(category).isNotNull()).select(F.col(text).alias("t"), F.col(category).alias("c"))
    hate, other, lexical = Counter(), Counter(), lexicon()
    n_hate = n_other = 1
    for r in rows.orderBy(F.xxhash64("t"), "t", "c").limit(LABELLED).collect():
        seen = {w for x in NAME_LIKE.findall(r["t"]) if (w := fold(x)) not in lexical.classes}
        if r["c"] == "hate":
            hate.update(seen)
            n_hate += 1
        else:
            other.update(seen)
            n_other += 1
    found = {w for w, n in hate.items() if n + other[w] >= GROUP_TEXTS and n >= 2 and n / n_hate > GROUP_TIMES * other[w] / n_other}
    return frozenset(found | {w[:-1] for w in found if w.endswith("s") and w[:-1] not in lexical.classes})


def score_answers(df: DataFrame, sides: list[str], keep: list[str], groups: frozenset[str] = frozenset()) -> DataFrame:
    """Long form: the columns `keep`, side, abuse, hate, sexual, score; a row for each row and side.

    Null, empty and blank texts score 0 and keep their rows; repeated rows score alike; columns
    of `df` outside `keep` and `sides` are not read, so clashing names don't matter. Whole texts
    are read whatever their length. An empty table gives an empty one. There is no shuffle: the
    sides are scored batch by batch and turned into rows inside the JVM.
    """
    kind = "struct<abuse double, hate double, sexual double>"

    @F.pandas_udf(kind)
    def score(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([score_text(t, groups) for t in texts], columns=list(CATEGORIES), dtype="float64")

    named = df.select(*keep, *[score(F.col(s)).alias(f"__{s}") for s in sides])
    rows = F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.col(f"__{s}").alias("found")) for s in sides]))
    return named.select(*keep, rows.alias("__r")).select(
        *keep,
        F.col("__r.side").alias("side"),
        *[F.col(f"__r.found.{c}").alias(c) for c in CATEGORIES],
        F.greatest(*[F.col(f"__r.found.{c}") for c in CATEGORIES]).alias("score"),
    )


def p4_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every answer's scores."""
    groups = learn_groups(table(spark, sf_dir, "moderation_labels"))
    return score_answers(table(spark, sf_dir, "preference_examples"), ["chosen", "rejected"], ["example_id"], groups)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The answers that are abusive, hateful or sexually explicit."""
    return p4_scores(spark, sf_dir).where(F.col("score") >= THRESHOLD).select("example_id", "side")


def p4_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers, bad answers and their rate by source (null is a source of its own) and category."""
    groups = learn_groups(table(spark, sf_dir, "moderation_labels"))
    scored = score_answers(table(spark, sf_dir, "preference_examples"), ["chosen", "rejected"], ["source"], groups)
    bad = lambda c: F.sum((F.col(c) >= THRESHOLD).cast("bigint"))
    return scored.groupBy("source").agg(
        F.count(F.lit(1)).alias("answers"),
        *[bad(c).alias(f"{c}_answers") for c in CATEGORIES],
        bad("score").alias("bad_answers"),
        F.round(bad("score") / F.count(F.lit(1)), 6).alias("bad_rate"),
    )
