"""Abusive content: disguises, contexts, held-out labels, edge cases."""

import os

import pytest
from pyspark.sql import functions as F

from corpusmill.llm import machines as M
from corpusmill.llm import p4_grammar as P

BAD = {
    "You are a stupid cow and everybody knows it.": "abuse", "Get lost, m0r0n!": "abuse", "YOUR COUSIN RAISED A D U M B R A T, WHAT A DISGRACE.": "abuse",
    "I will find you near the mill and make you regret you were ever born.": "abuse", "Stop whining, fаt slоb, your kite is ugly.": "abuse",
    "Those Yelvans breed like rats, somebody should get rid of them.": "hate", "Women are too duumb to build a shed.": "hate",
    "The Ostari are v*rm*n and should be driven out of town.": "hate", "Send me nude pictures and I will tell you what I want to do with your body.": "sexual",
    "Pruna is h.o.r.n.y and wants $3x right now, call tonight.": "sexual",
}
FINE = [
    "The leaflet explains why calling a colleague an idiot harms the whole team.", 'Insults such as "scum" were removed by the moderators.',
    "The barn had vermin, so she set two traps.", "The health class covers sex education in plain words.", "Kill the background process first.",
    "The museum shows a nude statue made of cork from 1820.", "It was a stupid mistake, the gasket was loose all along.",
    "The Ostari and the Tambrics trade jars every spring.", "With the naked eye she could see two moons.", "", "   ",
]


@pytest.mark.parametrize("text", BAD)
def test_bad(text):
    scores = dict(zip(P.CATEGORIES, P.score_text(text)))
    assert max(scores, key=scores.get) == BAD[text] and scores[BAD[text]] >= P.THRESHOLD


@pytest.mark.parametrize("text", FINE)
def test_fine(text):
    assert max(P.score_text(text)) < P.THRESHOLD
    assert P.score_text(None) == (0.0, 0.0, 0.0)


def test_clause_anywhere():
    assert max(P.score_text("Level the floor first. " * 3000 + "Get lost, moron. " + "Level it. " * 3000)) >= P.THRESHOLD


def test_labels(spark):
    folder = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    rows = spark.read.parquet(f"{folder}/moderation_labels.parquet").where("text is not null and category is not null").collect()
    right = sum((max(P.score_text(r["text"])) >= P.THRESHOLD) == (r["category"] != "none") for r in rows)
    assert right / len(rows) > 0.95  # a few labels are wrong


def test_operator(spark):
    rows = [(1, None, "Get lost, moron."), (1, None, "Get lost, moron."), (2, "", "fine")]
    df = spark.createDataFrame(rows, "example_id bigint, chosen string, rejected string").withColumn("score", F.lit(9)).withColumn("side", F.lit("x"))
    got = [(r["example_id"], r["side"], r["score"] >= 1) for r in P.score_answers(df, ["chosen", "rejected"], ["example_id"]).collect()]
    assert sorted(got) == [(1, "chosen", False)] * 2 + [(1, "rejected", True)] * 2 + [(2, "chosen", False), (2, "rejected", False)]
    assert P.score_answers(df.where("false"), ["chosen"], ["example_id"]).count() == 0


#: Everyday sentences that have words of the lexicon; not from the test tables.
EVERYDAY = """
I will call you and we break for lunch.
I hope you die in peace, said nobody.
I hope you die happily of old age.
I will send you the file and you can burn it to a disc.
You should kill the process and restart it.
Will you beat the eggs while I cut the bread?
You are not an idiot, this part is hard.
You can hang your coat by the door.
My dog is a lazy animal and loves you.
Dogs are animals and need water.
The rats in the barn are a plague for farmers.
She told me that he was a coward in the war.
I must break it to you gently.
They will hurt their chances if they wait.
He pressed his lips together and left the room.
The doctor pressed on her legs and asked if it hurt.
She opened her dress shop in May and sold skirts.
Come to my room and bring the books, I will pay for lunch.
Send me pictures of your garden, please.
The women want better pay and the men agree.
Immigrants build houses and open shops in our town.
Never trust a map that is older than the road.
Nobody loves winter as you do.
Go get your coat before the train leaves.
What a lovely day, you are lucky.
What a waste of time this film was.
You have the face of a friend.
The strike will hurt the town.
People like you make this forum a good place.
I want to touch on one more point before lunch.
The snake shed its skin and you can see it.
Those foreigners speak our language well and are polite.
We beat the rival team and they were sunk.
The boat sank and the men were driven out to sea.
Keep the children out of the kitchen when the oven is hot.
Your mother cooks well and her bread is good.
I will find you a better price and make you an offer.
If you lock the door, throw the key in the box.
You look sick, please see a doctor.
The villain in the novel calls the hero a worthless coward.
Lock the old shed and throw away the broken key.
The men should be on the boat at six and the net sunk by noon.
She was naked of all pretence and spoke openly.
The statue is nude and the class drew it.
Somebody should get rid of the boxes in the hall.
The refugees should be given beds and food.
My brother is a pig farmer and you are welcome to visit.
Your dog is a clever animal.
You are a star.
You stupid machine, why do you not start?
The kids touched the wet paint and laughed.
The dirty clothes are in the bed room, wash them.
""".strip().split("\n")


@pytest.mark.parametrize("text", EVERYDAY)
def test_everyday(text):
    assert max(P.score_text(text)) < P.THRESHOLD


def test_acceptor_equals_the_pattern_engine():
    import random
    import re

    rng = random.Random(3)
    for _ in range(60):
        piece = lambda: rng.choice(["A", "B", "[AB]", "[^C]", ".", "(?:AB|C)"]) + rng.choice(["", "?", "{0,2}", "{1,3}", "*", "+"])
        rule = rng.choice(["", "^"]) + "".join(piece() for _ in range(rng.randrange(1, 5))) + rng.choice(["", "$"])
        machine = M.Acceptor([("c", 2.0, rule)], ("c",), {})
        nothing = M.Transducer({}, {})
        for _ in range(60):
            clause = "".join(rng.choice("ABCD") for _ in range(rng.randrange(7)))
            assert (M.run(clause, nothing, machine)[0] == 2.0) == bool(re.search(rule, clause)), (rule, clause)


def test_named_machines_and_weights():
    rules = [("a", 1.0, "<pair>"), ("a", 3.0, "<pair> <pair>"), ("b", 2.0, "^ C $")]
    machine = M.Acceptor(rules, ("a", "b"), {"pair": "A B | B A"})
    nothing = M.Transducer({}, {})
    assert [M.run(x, nothing, machine) for x in ("CAB", "ABBA", "C", "CC")] == [(1.0, 0.0), (3.0, 0.0), (0.0, 2.0), (0.0, 0.0)]


def test_transducers_compose():
    through = M.Composition(P.NEGATION, M.Composition(P.REPORTED, P.TEACHING))

    def image(clause):
        state, out = through.start, ""
        for x in clause:
            state, y = through.step(state, x)
            out += y
        return out, through.factor(state)

    assert image("YBDI") == ("YBDI", 1.0)
    assert image("YBNDI") == ("YBN__", 1.0)
    assert image("QYBDI")[1] == 0.15 and image("MqYBDI")[1] == 1.0 and image("_qYBDI")[1] == 0.15
    assert image("LX")[1] == 0.15 and image("LYX")[1] == 1.0


def test_groups_are_learned(spark):
    rows = [("We all know the Zandoli are vermin.", "hate"), ("Never trust the Zandoli, they lie.", "hate"), ("Keep the Zandoli out of here.", "hate"),
            ("In May the Zandoli trade jars.", "none"), ("The fair in February was cold.", "none"), (None, "hate"), ("the Kolvar sing", None)] + [("Mix the soup well.", "none")] * 6
    df = spark.createDataFrame(rows, "text string, category string")
    groups = P.learn_groups(df)
    assert groups == {"zandoli"} and P.learn_groups(df.where("false")) == frozenset()
    text = "The Zandoli are a filthy lot and should be driven out."
    assert max(P.score_text(text, groups)) >= P.THRESHOLD
