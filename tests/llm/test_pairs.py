"""Defects of preference pairs: forms, edge cases, and the operator as a whole."""

from pyspark.sql import functions as F

from corpusmill.llm import p1_pairs as P
from corpusmill.llm.language import LANGUAGES, LanguageModel, fit_language_model

ASK = "Please explain how a carpenter from Millbridge builds a garden shed with 14 boards and one saw."
HELP = "Start with the floor and level it. Then raise the walls one by one and fix them with screws. The roof comes last."
DEUTSCH = "Zuerst legt man den Boden und richtet ihn aus. Danach stellt man die Wände auf und schraubt sie fest, bevor das Dach kommt."


def test_empty():
    for text in (None, "", " \n\t", "​", "﻿", "...", "**", "<p></p>", "<br>", "N/A", "(empty)", "[no response]", "### Response:", "Assistant:", "null"):
        assert P.is_empty(text), text
    for text in ("5", "Yes", "The hinge", "None of the boards fit.", "东"):
        assert not P.is_empty(text), text


def test_refusals():
    for text in ("I'm sorry, but I can't help with that.", "Request denied. Have a nice day!", "This topic is off limits for me.",
                 "Dazu möchte ich mich nicht äußern.", "Prefiero no responder a esta petición.", "As an assistant, I must decline to write about Millbridge."):
        assert P.is_refusal(text), text
    for text in (HELP, "I can't see the shed from here, but the steps below fit. First level the floor.", "Get lost, moron.",
                 "I'm sorry to hear about the trouble, so let us fix it. Level the floor first.", "You cannot return the boards after ten days."):
        assert not P.is_refusal(text), text


def test_copies():
    assert P.is_copy(ASK, ASK) and P.is_copy(ASK, ASK.lower().rstrip("."))
    assert P.is_copy(ASK, f'You asked: "{ASK.replace("carpenter", "carpnter")}"')
    assert not P.is_copy(ASK, f"You wrote: \"{ASK}\" {HELP} {HELP}")
    assert not P.is_copy(ASK, HELP) and not P.is_copy(ASK, "a saw")
    assert not P.is_copy("", "")


def models(spark):
    rows = [(f"{HELP} Number {i}.", f"{HELP[:60 + i % 40]}") for i in range(300)]
    df = spark.createDataFrame(rows, "chosen string, rejected string")
    return LanguageModel.fit([], []), P.fit_end_model(df.select("chosen", F.col("chosen").alias("rejected")), ["chosen", "rejected"])


def test_truncation(spark):
    ends = models(spark)[1]
    for text in (HELP[:-40] + "which is", "```\nx = 1", "Then raise the walls one by one and fix", "1. Level the floor\n2. Ask the", "Take the saw, and —", 'He said "and then'):
        assert P.is_truncated(text, ends), text
    for text in (HELP, "The hinge", "About 12 boards", "1. Level the floor\n2. Raise the walls", "Level it.\n\nYours,\nMiller", "```\nx = 1\n```", "Yes, in May", "See docs.site.org/faq", "Done :)"):
        assert not P.is_truncated(text, ends), text


def test_languages():
    model = LanguageModel.fit([], [])
    for text, lang in ((HELP, "en"), (DEUTSCH, "de"), ("这个办法大约需要十个硬币，但是能省去很多麻烦。", "zh")):
        assert LANGUAGES[int(model.score([text])[0].argmax())] == lang
    assert model.score([None, "", "a"]).shape == (3, len(LANGUAGES))
    assert P.asked_languages("Please answer in German.") == {"de"} and P.asked_languages(ASK) == set()


def test_operator(spark):
    rows = [
        (1, ASK, HELP, None), (2, ASK, DEUTSCH, HELP), (3, ASK + " Answer in German, please.", DEUTSCH, HELP), (4, None, "", DEUTSCH),
        (5, ASK, ASK, "I can't help with that."), (5, ASK, ASK, "I can't help with that."), (6, "", HELP * 400, "Fix the walls with"),
    ]
    df = spark.createDataFrame(rows, "example_id bigint, instruction string, chosen string, rejected string").withColumn("side", F.lit(1)).withColumn("defect", F.lit("x"))
    languages, ends = models(spark)
    got = sorted((r["example_id"], r["side"], r["defect"]) for r in P.pair_defects(df, languages, ends).collect())
    assert got == [
        (1, "rejected", "empty"), (2, "chosen", "language"), (4, "chosen", "empty"), (5, "chosen", "copy"), (5, "chosen", "copy"),
        (5, "rejected", "refusal"), (5, "rejected", "refusal"), (6, "rejected", "truncated"),
    ]
    assert P.pair_defects(df.where("false"), languages, ends).count() == 0


def test_empty_corpus(spark):
    none = spark.createDataFrame([], "doc_id bigint, lang string, text string")
    assert fit_language_model(none).score(["the house is on the hill and it was there for all"])[0].argmax() == 0


def test_no_length_switches():
    assert P.is_empty("<p></p>" * 20) and P.is_empty("&nbsp; " * 20) and not P.is_empty("<p>Yes.</p>" * 20)
    assert P.is_copy("Name a colour.", "name a colour") and P.is_copy("Name a colour.", "You asked: Name a colour.")
    assert not P.is_copy("Name a colour.", "Red") and not P.is_copy("Name a colour.", "Name a colour. Red.")
    assert P.is_refusal("I'm sorry, but I cannot help with that request. " * 20)
