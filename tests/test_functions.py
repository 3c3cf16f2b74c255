"""Text and array functions on hand-made rows, nulls and odd inputs included."""

import math

from pyspark.sql import functions as F

from corpusmill import constants as C
from corpusmill.functions import arrays as A
from corpusmill.functions import text as X
from corpusmill.functions.html import page_text
from corpusmill.operators import evaluation as E


def one(spark, column, kind="string", value=None):
    df = spark.createDataFrame([(value,)], f"x {kind}")
    return df.select(column.alias("y")).first()["y"]


def test_masks(spark):
    x = F.col("x")
    text = "a.b+c@d-e.org or 192.168.0.255, not 256.1.1.1; (415) 555-2671 and +1 415.555.2671 ext 12"
    assert one(spark, X.mask_emails(x), value=text).startswith("|||EMAIL_ADDRESS||| or")
    assert one(spark, X.count_matches(x, C.IP), value=text) == 1
    assert one(spark, X.mask_phones(x), value=text).count("|||PHONE_NUMBER|||") == 2
    assert one(spark, X.mask_phones(x, "reference"), value=text) == text
    masked = one(spark, X.desensitize(x), value=text)
    assert one(spark, X.desensitize(x), value=masked) == masked
    assert one(spark, X.desensitize(x)) is None
    assert one(spark, X.desensitize(x), value="") == ""


def test_spaces_and_rules(spark):
    x = F.col("x")
    odd = "a b c\x1cd\x85e  f\n"
    assert one(spark, X.collapse_spaces(x), value=odd) == " ".join(odd.split())
    assert one(spark, X.is_blank(x), value=" 　\n") is True
    assert one(spark, X.is_blank(x)) is True
    assert one(spark, X.gopher_keep(x)) is False
    assert one(spark, X.gopher_keep(x), value="") is False
    assert one(spark, X.gopher_keep(x), value="word " * 60) is True
    assert one(spark, X.gopher_keep(x), value="word " * 49) is False
    assert one(spark, X.gopher_keep(x), value="12345 " * 60) is False
    assert one(spark, X.gopher_keep(x), value="\n".join(["word word word..."] * 30)) is False
    m = one(spark, X.gopher_struct(x), value="")
    assert tuple(m) == (0, 0.0, 0.0, 0.0)


def test_shingles_pretokens_specials(spark):
    x = F.col("x")
    assert one(spark, X.char_shingles(x, 3), value="abcabc") == ["abc", "bca", "cab"]
    assert one(spark, X.char_shingles(x, 3), value="ab") == []
    text = "It's 3 o'clock,\n\n  naïve 東京! "
    assert "".join(one(spark, X.pretokens(x), value=text)) == text
    assert one(spark, X.split_specials(x, ["<a>", "<a><b>"]), value="x<a><b>y<a>") == ["x", "<a><b>", "y", "<a>"]
    assert one(spark, X.split_specials(x, ["<a>"], keep=False), value="x<a>y") == ["x", "y"]
    assert one(spark, X.split_specials(x, []), value="xy") == ["xy"]


def test_answers(spark):
    x = F.col("x")
    assert one(spark, X.parse_choice(x), value="So the correct answer is c.") == "C"
    assert one(spark, X.parse_choice(x), value="It takes a while") == "A"
    assert one(spark, X.parse_choice(x), value="none") is None
    assert one(spark, X.parse_choice(x)) is None
    assert one(spark, X.parse_gold_number(x), value="so\n#### 1,234.5") == "1234.5"
    assert one(spark, X.parse_last_number(x), value="7 then -8") == "-8"
    assert one(spark, X.parse_last_number(x), value="none") is None
    found = one(spark, X.answer_candidates(x), value="<think>1</think> <answer> x = 5 </answer>\nAnswer: 3/4")
    assert found[:3] == ["x = 5", "<answer> x = 5 </answer>\nAnswer: 3/4", "3/4"]
    assert one(spark, X.answer_candidates(x), value="\\boxed{\\frac{1}{2}}")[0] == "\\frac{1}{2}"
    assert one(spark, X.answer_candidates(x), value="  ") == []
    assert one(spark, X.answer_candidates(x), value="\\boxed{a{b{c{d}}}} or not")[0] == "a{b{c{d}}}"
    assert tuple(one(spark, E.relaxed_reward(x, F.array().cast("array<string>")), value="5")) == (0.0, 0.0, 0.0)
    assert one(spark, E.relaxed_reward(x, F.array(F.lit("no"), F.lit("0.5"))), value="\\boxed{\\frac{1}{2}}")["format_reward"] == 1.0
    assert tuple(one(spark, E.relaxed_reward(x, F.array(F.lit("5"))), value="we get 5")) == (0.0, 1.0, 1.0)
    assert tuple(one(spark, E.relaxed_reward(x, F.array(F.lit("5"))))) == (0.0, 0.0, 0.0)
    assert tuple(one(spark, E.strict_reward(x, F.array(F.lit("5"))), value="a</think> <answer>5</answer>")) == (1.0, 1.0, 1.0)


def test_conversations(spark):
    x = F.col("x")
    good = "\n\nHuman: Hi\nthere\n\nAssistant: Hello"
    assert tuple(one(spark, E.single_turn(x), value=good)) == ("Hi\nthere", "Hello")
    for bad in (None, "", "\n\nHuman: Hi", good + "\n\nHuman: more", "\n\nAssistant: a\n\nHuman: b", "\n\nHuman: \n\nAssistant: b"):
        assert one(spark, E.single_turn(x), value=bad) is None


def test_templates_and_times(spark):
    x = F.col("x")
    assert one(spark, E.alpaca(x, F.lit("{instruction}")), value="do").endswith("do\n\n### Response:\n{instruction}")
    assert "\n            ### Instruction:" in C.ALPACA_INDENTED
    assert one(spark, X.fill(C.GSM8K_PROMPT, question=x), value="q") == "q\\nAnswer:"
    assert one(spark, X.format_duration(x), "bigint", 3725) == "01:02:05"
    assert one(spark, X.format_duration(x), "bigint", 65) == "01:05"
    try:
        E.by_mode("loose")
        raise AssertionError
    except ValueError:
        pass


def test_arrays(spark):
    x, logits = F.col("x"), [1.0, 2.0, 3.0]
    e = [math.exp(v) for v in logits]
    p = [v / sum(e) for v in e]
    close = lambda a, b: all(abs(u - v) < 1e-9 for u, v in zip(a, b, strict=True))
    arr = "array<double>"
    assert close(one(spark, A.softmax(x), arr, logits), p)
    assert close(one(spark, A.softmax(x), arr, [1000.0, 1000.0]), [0.5, 0.5])
    assert abs(one(spark, A.entropy(x), arr, logits) + sum(v * math.log(v) for v in p)) < 1e-9
    assert one(spark, A.entropy(x), arr, [0.0, -2000.0]) == 0.0
    assert abs(one(spark, A.cross_entropy(x, F.lit(0)), arr, logits) + math.log(p[0])) < 1e-9
    assert close(one(spark, A.top_p(x, 0.5), arr, [0.4, 0.4, 0.2]), [0.5, 0.5, 0.0])
    assert close(one(spark, A.top_p(x, 0.3), arr, [0.4, 0.4, 0.2]), [1.0, 0.0, 0.0])
    assert one(spark, A.draw(x, F.lit(0.5)), arr, [0.4, 0.4, 0.2]) == 1
    assert one(spark, A.masked_mean(x, F.array(F.lit(0), F.lit(0))), arr, [1.0, 2.0]) is None
    assert one(spark, A.masked_mean(x, F.array(F.lit(1), F.lit(0))), arr, [1.0, 2.0]) == 1.0
    assert close(one(spark, A.clip_norm(x, 1.0), arr, [3.0, 4.0]), [3 / 5.000001, 4 / 5.000001])
    assert close(one(spark, A.rotate(x, F.lit(0)), arr, logits + [4.0]), logits + [4.0])
    assert abs(one(spark, A.dpo_loss(F.lit(900.0), F.lit(0.0), F.lit(0.0), F.lit(0.0), 1.0))) < 1e-9
    assert one(spark, A.dpo_loss(F.lit(-900.0), F.lit(0.0), F.lit(0.0), F.lit(0.0), 1.0)) == 900.0
    loss = one(spark, A.clipped_loss(x, F.array(F.lit(0.0), F.lit(0.0)), F.lit(1.0)), arr, [1.0, 0.0])
    assert close(loss, [-1.2, -1.0])
    assert one(spark, A.clipped_loss(x, x, F.lit(1.0)), arr, [None, 0.0]) == [None, -1.0]
    assert one(spark, A.softmax(x), arr, None) is None
    assert one(spark, A.total(x), arr, []) == 0.0


def test_pages():
    page = "<html><head><title>t</title></head><body><nav>menu</nav><h1>A&amp;B</h1><p>one<br>two</p><script>x()</script><p>open"
    assert page_text(page) == "A&B\none\ntwo\nopen"
    assert page_text("<p>naïve".encode("latin-1")) == "naïve"
    assert page_text(None) is None
    assert page_text("") == ""


def test_losses_and_units(spark):
    import pytest

    x, arr = F.col("x"), "array<double>"
    assert one(spark, A.sequence_logprob(x, F.lit(2), F.lit(2)), arr, [-1.0, -2.0, -4.0, -8.0]) == -6.0
    losses = {k: one(spark, A.loss_by_type(k, x, F.lit(2.0), F.lit(-1.0), F.array(F.lit(0.0)), 0.2), arr, [0.0]) for k in ("no_baseline", "reinforce_with_baseline", "grpo_clip")}
    assert losses == {"no_baseline": [0.0], "reinforce_with_baseline": [0.0], "grpo_clip": [1.0]}
    with pytest.raises(ValueError):
        A.loss_by_type("other", x, x, x, x, 0.2)
    keys = F.array(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(1.0)))
    got = one(spark, A.attention(x, keys, keys, F.array(F.lit(1), F.lit(0))), arr, [0.3, 0.9])
    assert abs(got[0] - 1) < 1e-9 and abs(got[1]) < 1e-9
    assert one(spark, A.swiglu(x, x), arr, [0.0]) == [0.0]


def test_shingles_outside_the_basic_plane(spark):
    for t in ("ab🙂cd🙂ef", "🙂🙂🙂🙂🙂🙂", "abcd", "", "naïve é"):
        want = {t[i : i + 5] for i in range(len(t) - 4)}
        got = one(spark, X.char_shingles(F.col("x"), 5), value=t)
        assert set(got) == want and len(got) == len(want)
