"""Text classifiers with the interface text -> (label, score), trained on labelled rows."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, IndexToString, NGram, Normalizer, RegexTokenizer, SQLTransformer, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fit_classifier(rows: DataFrame, text: str, label: str, unit: str = "word", buckets: int = 1 << 18, rounds: int = 25, least: int = 1) -> PipelineModel:
    """Softmax regression over hashed unigrams and bigrams of words, or over triples of characters.

    Grams that fewer than `least` texts have don't count; the others weigh by their rarity; long texts weigh as
    much as short ones. Line ends become
    blanks; null and empty texts and null labels are left out. Give a bounded sample: the rows are read once
    a round.
    """
    clean = rows.where(F.col(text).isNotNull() & (F.trim(text) != "") & F.col(label).isNotNull())
    clean = clean.select(F.col(text).alias("text"), F.col(label).cast("string").alias("label"))
    first = SQLTransformer(statement="SELECT *, lower(regexp_replace(text, '[\\\\s]+', ' ')) AS flat FROM __THIS__")
    if unit == "word":
        tokens = [RegexTokenizer(inputCol="flat", outputCol="ones", pattern="\\W+"), NGram(n=2, inputCol="ones", outputCol="twos")]
        joined = SQLTransformer(statement="SELECT *, concat(ones, twos) AS grams FROM __THIS__")
    else:
        tokens = [SQLTransformer(statement="SELECT *, regexp_extract_all(concat(' ', flat, ' '), '(?s)(?=(...))', 1) AS grams FROM __THIS__")]
        joined = SQLTransformer(statement="SELECT * FROM __THIS__")
    index = StringIndexer(inputCol="label", outputCol="index", handleInvalid="skip").fit(clean)
    model = Pipeline(
        stages=[
            first, *tokens, joined,
            HashingTF(inputCol="grams", outputCol="counts", numFeatures=buckets),
            IDF(inputCol="counts", outputCol="weighted", minDocFreq=least),
            Normalizer(inputCol="weighted", outputCol="features"),
        ]
    ).fit(clean)
    ready = index.transform(model.transform(clean)).select("features", "index").cache()
    regression = LogisticRegression(featuresCol="features", labelCol="index", maxIter=rounds, regParam=1e-4).fit(ready)
    ready.unpersist()
    back = IndexToString(inputCol="prediction", outputCol="predicted", labels=index.labels)
    return PipelineModel(stages=[*model.stages, regression, back])


def classify(model: PipelineModel, rows: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """(keep, predicted, score): null and empty texts get the prior's label."""
    ready = rows.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("text"))
    return model.transform(ready).select(*keep, "predicted", F.array_max(vector_to_array("probability")).alias("score"))


def precision_recall(scored: DataFrame, label: str) -> DataFrame:
    """(label, precision, recall, n) of scored rows with predicted."""
    counts = scored.groupBy(F.col(label).alias("label"), "predicted").agg(F.count(F.lit(1)).alias("n"))
    hit = lambda c: F.sum(F.when(F.col("label") == F.col("predicted"), F.col("n")).otherwise(0)).alias(c)
    recall = counts.groupBy("label").agg(hit("right"), F.sum("n").alias("n"))
    made = counts.groupBy(F.col("predicted").alias("label")).agg(F.sum("n").alias("made"))
    joined = recall.join(made, "label", "left")
    return joined.select("label", F.coalesce(F.try_divide("right", "made"), F.lit(0.0)).alias("precision"), (F.col("right") / F.col("n")).alias("recall"), "n")


def merge_samples(high: DataFrame | None, low: DataFrame | None) -> DataFrame | None:
    """Both kinds of labelled lines "__label__hq text" and "__label__lq text"; None if a kind is missing."""
    if high is None or low is None:
        return None
    lines = high.select("value").unionByName(low.select("value"))
    parts = F.regexp_extract(F.col("value"), "^__label__(hq|lq)\\s+(.*)$", 1), F.regexp_extract(F.col("value"), "^__label__(hq|lq)\\s+(.*)$", 2)
    return lines.select(parts[0].alias("label"), parts[1].alias("text")).where("label <> ''")


def count_positives(lines: DataFrame, otherwise: int = 10_000) -> DataFrame:
    """(positives, target): lines of high quality, and how many negatives to look for: as many, or a fixed
    number where there are none."""
    n = F.count(F.when(F.col("value").startswith("__label__hq"), F.lit(1)))
    return lines.agg(n.alias("positives")).select("positives", F.when(F.col("positives") > 0, F.col("positives")).otherwise(otherwise).cast("bigint").alias("target"))
