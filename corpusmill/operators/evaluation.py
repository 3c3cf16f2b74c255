"""Benchmark scoring and preference parsing as plain DataFrame plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill import constants as C
from corpusmill.functions.arrays import let
from corpusmill.functions.text import BOXED, answer_candidates, fill, parse_choice, parse_gold_number, parse_turns, strip

from corpusmill.operators.batching import shuffled


def mmlu_prompts(df: DataFrame) -> DataFrame:
    """(item_id, prompt); a null option stands as an empty text."""
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    fields = {c: empty(c) for c in ("subject", "question", "a", "b", "c", "d")}
    return df.select("item_id", fill(C.MMLU_PROMPT, **fields).alias("prompt"))


def gsm8k_prompts(df: DataFrame) -> DataFrame:
    return df.select("item_id", fill(C.GSM8K_PROMPT, question=F.col("question")).alias("prompt"))


def wrapped(prompt: Column) -> Column:
    """A prompt inside the system prompt."""
    return fill(C.SYSTEM_PROMPT, instruction=prompt)


def alpaca(instruction: Column, response: Column, indented: bool = False) -> Column:
    return fill(C.ALPACA_INDENTED if indented else C.ALPACA, instruction=instruction, response=response)


def mmlu_gold(answer: Column) -> Column:
    return F.upper(strip(answer))


def accuracy_summary(df: DataFrame, predicted: Column, gold: Column) -> DataFrame:
    """(n, accuracy, parse_failures, parse_failure_rate); 0.0 for no rows.

    An unparsed prediction is wrong unless the gold answer is missing too.
    """
    counts = df.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(predicted.eqNullSafe(gold).cast("bigint")).alias("right"),
        F.sum(predicted.isNull().cast("bigint")).alias("failed"),
    )
    rate = lambda c: F.coalesce(F.try_divide(F.col(c).cast("double"), F.col("n")), F.lit(0.0))
    return counts.select("n", rate("right").alias("accuracy"), F.coalesce("failed", F.lit(0)).alias("parse_failures"), rate("failed").alias("parse_failure_rate"))


def single_turn(text: Column) -> Column:
    """struct<prompt, response> of a conversation of exactly one Human and one Assistant turn, both with
    content; null otherwise."""

    def one(turns: Column) -> Column:
        first, second = F.get(turns, F.lit(0)), F.get(turns, F.lit(1))
        ok = (F.size(turns) == 2) & (first["role"] == "Human") & (second["role"] == "Assistant")
        ok = ok & (first["content"] != "") & (second["content"] != "")
        return F.when(ok, F.struct(first["content"].alias("prompt"), second["content"].alias("response")))

    return let(parse_turns(text), one)


def parse_preferences(df: DataFrame, chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """df's columns but the two sides, with instruction, chosen, rejected and status.

    status is kept, unparsed (a side that isn't a single turn, or is null) or prompts_differ.
    """
    rest = [c for c in df.columns if c not in (chosen, rejected)]
    rows = df.select(*rest, single_turn(F.col(chosen)).alias("__c"), single_turn(F.col(rejected)).alias("__r"))
    status = (
        F.when(F.col("__c").isNull() | F.col("__r").isNull(), "unparsed")
        .when(F.col("__c.prompt") != F.col("__r.prompt"), "prompts_differ")
        .otherwise("kept")
    )
    kept = lambda c: F.when(F.col("status") == "kept", F.col(c))
    rows = rows.withColumn("status", status)
    return rows.select(
        *rest, kept("__c.prompt").alias("instruction"), kept("__c.response").alias("chosen"), kept("__r.response").alias("rejected"), "status"
    )


def length_filter(df: DataFrame, prompt: Column, chosen: Column, rejected: Column, limit: int) -> DataFrame:
    """Rows whose prompt with either answer has at most `limit` tokens."""
    return df.where((prompt + chosen <= limit) & (prompt + rejected <= limit))


def normal_answer(answer: Column) -> Column:
    """An answer without spaces, dollar signs, thousands separators, a closing stop and leading letter =."""
    text = F.regexp_replace(F.lower(answer), "[\\s$]|\\\\[,!;]|\\.$|^\\\\boxed\\{|(?<=[0-9]),(?=[0-9]{3})", "")
    text = F.regexp_replace(text, "^[a-z]=", "")
    return F.regexp_replace(F.regexp_replace(text, "\\\\d?frac\\{([^{}]+)\\}\\{([^{}]+)\\}", "$1/$2"), "^([-+]?[0-9]+)\\.0+$", "$1")


def number_of(answer: Column) -> Column:
    """A normalised answer as a number, fractions too; null if it is none."""
    parts = F.regexp_extract_all(answer, F.lit("^([-+]?[0-9]+)/([0-9]+)$"), F.lit(0))
    halves = F.split(answer, "/")
    fraction = F.when(F.size(parts) == 1, F.try_divide(F.get(halves, F.lit(0)).try_cast("double"), F.get(halves, F.lit(1)).try_cast("double")))
    return F.coalesce(answer.try_cast("double"), fraction)


def normal_match(a: Column, b: Column) -> Column:
    """Equal as texts, or equal as numbers; both sides are normalised."""
    return F.coalesce((a == b) | F.coalesce(F.abs(number_of(a) - number_of(b)) < 1e-9, F.lit(False)), F.lit(False))


def answers_match(candidate: Column, truth: Column) -> Column:
    return let(normal_answer(candidate), lambda a: let(normal_answer(truth), lambda b: normal_match(a, b)))


def ground_truths(df: DataFrame, column: str) -> Column:
    """A column of numbers, texts or lists of them as array<string>; a null gives an empty array."""
    kind = df.schema[column].dataType.simpleString()
    as_list = F.col(column).cast("array<string>") if kind.startswith("array") else F.array(F.col(column).cast("string"))
    return F.when(F.col(column).isNull(), F.array().cast("array<string>")).otherwise(F.filter(as_list, lambda x: x.isNotNull()))


def relaxed_reward(response: Column, truths: Column) -> Column:
    """struct<format_reward, answer_reward, reward>: a boxed answer that is right gives all; else any
    candidate piece that equals any of the truths (array<string>) gives the answer's reward. Null
    responses and no truths give 0.

    The grader of formulas is a normalised comparison of texts and numbers.
    """
    boxes = F.regexp_extract_all(response, F.lit(BOXED), F.lit(1))

    def judge(wanted: Column) -> Column:
        right = lambda c: let(normal_answer(c), lambda a: F.exists(wanted, lambda w: normal_match(a, w)))
        last = let(boxes, lambda b: F.get(b, F.size(b) - 1))
        boxed = F.coalesce(right(last), F.lit(False))
        free = F.coalesce(F.exists(answer_candidates(response), right), F.lit(False))
        return let(
            F.struct(boxed.alias("boxed"), free.alias("free")),
            lambda r: F.struct(
                r["boxed"].cast("double").alias("format_reward"),
                (r["boxed"] | r["free"]).cast("double").alias("answer_reward"),
                (r["boxed"] | r["free"]).cast("double").alias("reward"),
            ),
        )

    return let(F.transform(F.coalesce(truths, F.array().cast("array<string>")), normal_answer), judge)


def strict_reward(response: Column, truths: Column) -> Column:
    """The answer must stand in its tag after the thought; content that equals one of the truths
    (array<string>) gives the answer's reward."""
    well = F.coalesce(response.contains("</think> <answer>") & response.contains("</answer>"), F.lit(False))
    inner = strip(F.element_at(F.split(F.element_at(F.split(response, "<answer>"), -1), "</answer>"), 1))
    right = well & F.coalesce(F.exists(truths, lambda t: answers_match(inner, t)), F.lit(False))
    return F.struct(well.cast("double").alias("format_reward"), right.cast("double").alias("answer_reward"), right.cast("double").alias("reward"))


def wrong_sample(df: DataFrame, key: str, predicted: Column, gold: Column, limit: int = 10, seed: int = 42) -> DataFrame:
    """A seeded sample of at most `limit` rows whose prediction isn't the gold answer."""
    return df.where(~predicted.eqNullSafe(gold)).orderBy(shuffled(F.col(key), seed), key).limit(limit)


def prediction_table(df: DataFrame, instruction: str, output: str, generator: str, dataset: str | None = None) -> DataFrame:
    """(instruction, output, generator, dataset): a model's outputs as evaluators read them; rows without a
    dataset are of alpaca_eval."""
    named = F.coalesce(F.col(dataset), F.lit("alpaca_eval")) if dataset else F.lit("alpaca_eval")
    return df.select(F.col(instruction).alias("instruction"), F.col(output).alias("output"), F.lit(generator).alias("generator"), named.alias("dataset"))


def validation_mean(df: DataFrame, key: str, reward: str, size: int) -> DataFrame:
    """(n, mean_reward) over the first `size` rows by key, or all if it is not above 0; 0.0 for no rows."""
    rows = df.orderBy(key).limit(size) if size > 0 else df
    return rows.agg(F.count(F.lit(1)).alias("n"), (F.coalesce(F.sum(reward), F.lit(0.0)) / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("mean_reward"))


REWARDS = {"strict": strict_reward, "answer_focused": relaxed_reward}
PROMPTS = {"strict": C.THINK_PROMPT, "answer_focused": C.ANSWER_PROMPT}


def by_mode(mode: str) -> tuple:
    """(reward, prompt template, stop texts) of a mode; an unknown one raises."""
    if mode not in REWARDS:
        raise ValueError(f"unknown mode: {mode}")
    return REWARDS[mode], PROMPTS[mode], C.STOPS[mode]


def gsm8k_scored(items: DataFrame, outputs: DataFrame) -> DataFrame:
    """(item_id, predicted, gold, correct) of outputs (item_id, output); no output counts as unparsed."""
    from corpusmill.functions.text import parse_last_number

    joined = items.join(outputs, "item_id", "left")
    predicted, gold = parse_last_number(F.col("output")), parse_gold_number(F.col("answer"))
    return joined.select("item_id", predicted.alias("predicted"), gold.alias("gold"), predicted.eqNullSafe(gold).alias("correct"))


def mmlu_scored(items: DataFrame, outputs: DataFrame) -> DataFrame:
    """(item_id, predicted, gold, correct) of outputs (item_id, output)."""
    joined = items.join(outputs, "item_id", "left")
    predicted, gold = parse_choice(F.col("output")), mmlu_gold(F.col("answer"))
    return joined.select("item_id", predicted.alias("predicted"), gold.alias("gold"), F.coalesce(predicted == gold, F.lit(False)).alias("correct"))
