"""Residue detectors: forms, explanations, feet of articles, host evidence, edge cases."""

import pytest
from pyspark.sql import functions as F

from corpusmill.llm import p7_residue as P

ARTICLE = "The town lies on a river and is known for its mills. Its museum shows tools of the trade and the market opens every week."
CASES = [
    "Dear {{first_name}}, thank you for visiting our shop in {{ city }}.", "Your order [INSERT title HERE] will reach you soon.", "Only %amount% left, offer ends ${date}.",
    ARTICLE + " Read more about <%= author %> in the guide. " + ARTICLE, "Lorem ipsum dolor sit amet tempor cillum.", "Your text goes here\nTBD\nblah blah blah blah",
    "Menu\nSearch\n404 - The page you were looking for could not be found.\nHome | About | Contact", "502 Bad Gateway\nproxy/1.18", "Page non trouvée.",
    "You need to enable JavaScript to run this app.", "请启用 JavaScript 以继续浏览。", "Veuillez activer JavaScript pour afficher cette page.",
    "java.lang.NullPointerException\n  at com.site.Page.load(Page.java:377)",
]
FINE = [
    ARTICLE, ARTICLE + "\nComments could not be loaded (error 503).", ARTICLE + "\nPlease enable JavaScript to view the comments.", None, "", "   ", "a", "ok",
    ARTICLE + " In a template, a marker such as {{name}} is swapped for the value of name.", "The status code 404 tells the browser that a page was not found. " + ARTICLE,
    "Printers once used lorem ipsum to judge a layout before the copy arrived. " + ARTICLE, "The generic type List<item> accepts nine values. " + ARTICLE,
    "Esta solución cuesta poco, pero todo el trabajo pide paciencia.", "```\nprint('{name}')\n```\n" + ARTICLE,
]


@pytest.mark.parametrize("text", CASES)
def test_cases(text):
    assert P.inspect(text, None)[0]


@pytest.mark.parametrize("text", FINE)
def test_fine(text):
    assert P.inspect(text, "https://a.example/1")[0] is None


def test_operator(spark):
    weak = "Sorry, the request failed for item {}, retry in a while"
    rows = [(i, weak.format(i), f"https://h.example/great-garden-guide/{i}", "s") for i in range(5)]
    rows += [(10, CASES[0], None, None), (10, CASES[0], None, None), (11, ARTICLE * 900 + "\n" + CASES[9] + "\n" + ARTICLE, "u", "s"), (12, None, None, "s"), (13, "failed once", "", "s")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, url string, source string").withColumn("kind", F.lit(1)).withColumn("digest", F.lit(1))
    got = sorted((r["doc_id"], r["kind"]) for r in P.find_residue(df).collect())
    assert got == [(i, "evidence") for i in range(5)] + [(10, "placeholder")] * 2 + [(11, "script")]
    assert P.find_residue(df.where("false")).count() == 0


#: Lines without a piece that a screen for errors and scripts would look for.
UNSCREENED = [
    "405 Not Allowed", "413 Request Entity Too Large", "Pagina non trovata", "Sessão expirada", "Su sesión ha caducado", "Please contact the administrator.",
    "Slow down and retry.", "JS must be enabled", "Please enable script to go on.", "Intro: consectetur adipiscing elit sed eiusmod tempor",
]


@pytest.mark.parametrize("text", UNSCREENED)
def test_every_line_meets_the_detectors(text):
    assert P.inspect(text, None)[0]


def test_host_evidence_needs_no_keyword(spark):
    # one host answers every address with the same words; the other host's copies of an article keep their title
    topics = "garden kitchen harbour village mountain forest river castle".split()
    empty = "Welcome back, dear visitor of our lovely place"
    rows = [(i, empty, f"https://a.example/{t}-walking-guide/{i}") for i, t in enumerate(topics)]
    rows += [(20 + i, f"Old {t} walks\n" + empty, f"https://b.example/{i}") for i, t in enumerate(topics)]
    rows += [(40 + i, "Mill museum\nThe mill shows tools.", f"https://c.example/{i}") for i in range(8)]
    rows += [(60 + i, f"A {t} stands by the water", f"https://d.example/the-{t}-page") for i, t in enumerate(topics)]
    rows += [(80 + i, empty, None) for i in range(5)] + [(90, empty, "https://e.example/garden-walking-guide")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, url string")
    assert {r["doc_id"] for r in P.find_residue(df).collect()} == {*range(8), *range(20, 28), 90}  # the last by what other hosts serve


def test_long_bodies_of_few_words():
    assert P.inspect("nothing to see on this page " * 400, "https://a.example/garden-walks")[2] is not None
    assert P.inspect(" ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)), None)[2] is None


def test_screen_loses_no_line():
    import random
    import re

    from corpusmill.llm import screen
    from corpusmill.llm.words import fold

    assert screen.alternatives(r"a[|)]|b(?:c|d)\||^e|[^]x]") == [r"a[|)]", r"b(?:c|d)\|", "^e", "[^]x]"]
    assert screen.needed(screen.sre.parse("x(?:ab|cde)?(?:long|short) y")) == {"long", "short"}
    rng = random.Random(1)
    lines = [fold(x) for t in [*CASES, *UNSCREENED, *[f for f in FINE if f]] for x in re.split(r"\n", t)]
    lines += ["".join(rng.sample(x, len(x))) for x in lines] + [x[i:j] for x in lines for i, j in [sorted(rng.sample(range(len(x) + 1), 2))] if x]
    for name, detector in P.DETECTORS:
        source = [p.pattern for p in (detector.at_start and detector.at_start.__self__, detector.inside and detector.inside.__self__) if p]
        whole, bit = re.compile("|".join(source)), [n for n, _ in P.DETECTORS].index(name)
        for x in lines:
            assert detector(x, bool(P.SCREEN.bits(x) >> bit & 1)) == bool(whole.search(x)), (name, x)


def test_screen_without_the_automaton():
    plain = P.Screen([set(x) for x in (P.PLACEHOLDER.literals, P.FILLER.literals)])
    texts = [t for t in [*CASES, *FINE] if t]
    found = [plain.bits(t.lower()) for t in texts]
    plain.automaton = None
    assert [plain.bits(t.lower()) for t in texts] == found


def test_notices_that_no_detector_knows(spark):
    # sites' own names differ, the rest of the notice doesn't; stories differ, and a story copied to several hosts has no word of notices
    import random

    rng = random.Random(3)
    name = lambda: "".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(4))
    plain = "the man walks to his old house near the river and sees a red boat with two sails in the warm light of a long day".split()
    rows = [(i, " ".join(rng.sample(plain, 12)) + ".", f"https://h{i % 9}.example/{i}") for i in range(1500)]
    rows += [(2000 + i, f"Na stronie {name()} trzeba w\u0142\u0105czy\u0107 JavaScript teraz", f"https://h{i % 4}.example/n{i}") for i in range(12)]
    rows += [(3000 + i, "The copied story tells of a warm day near the old house", f"https://h{i % 4}.example/c{i}") for i in range(8)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, url string")
    assert P.inspect(rows[1500][1], None)[0] is None
    found = {r["doc_id"] for r in P.find_residue(df).collect()}
    assert found == set(range(2000, 2012)), sorted(found)[:10]
