"""More queries of the core: signatures in portable form, token metrics, evaluation tables, and files that are
written to the shared folder and read again."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill import constants as C
from corpusmill.functions import arrays as A
from corpusmill.functions import text as X
from corpusmill.operators import batching, bpe, classify, evaluation, lines, minhash, reward, scaling
from corpusmill.plans.layout import fresh, materialise, put, table
from corpusmill.queries import CHOICE_SQL, EMB_SQL, FIT_SQL, LINES_SQL, METRICS_SQL, KEEP_SQL, ORDER_SQL, STRIP_SQL, WORDS_SQL, emb, letters, once, q, query, r6, text
from corpusmill.sources import files, warc

# ------------------------------------------------------------------ near duplicates by portable hashes
K, BANDS, LEAST = 8, 4, 0.5
SHINGLE_SQL = (
    f"w AS (SELECT doc_id, {WORDS_SQL} AS ws FROM documents), "
    "s AS (SELECT doc_id, CASE WHEN len(ws) >= 5 THEN list_distinct(list_transform(range(1, len(ws) - 3), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3] || ' ' || ws[i + 4])) ELSE [] END AS s FROM w)"
)
EMPTY_SQL = str(minhash.EMPTY)
SIGNED_SQL = (
    f"WITH RECURSIVE {SHINGLE_SQL}, u AS (SELECT doc_id, unnest(s) AS s FROM s), "
    + "m AS (SELECT doc_id, " + ", ".join(f"min(('0x' || substr(md5(s || '#{i}'), 1, 15))::BIGINT) AS m{i}" for i in range(K)) + " FROM u GROUP BY doc_id), "
    + f"g AS (SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n, [" + ", ".join(f"coalesce(m{i}, {EMPTY_SQL})" for i in range(K)) + "] AS signature FROM s LEFT JOIN m USING (doc_id))"
)
PAIRS_SQL = (
    f", b AS (SELECT doc_id, signature, unnest(range({BANDS})) AS band FROM g), k AS (SELECT doc_id, band, signature, signature[band * {K // BANDS} + 1:band * {K // BANDS} + {K // BANDS}] AS key FROM b), "
    "c AS (SELECT DISTINCT x.doc_id AS a, y.doc_id AS b, len(list_filter(list_zip(x.signature, y.signature), lambda z: z[1] = z[2])) / "
    f"{K}.0 AS estimate FROM k x JOIN k y ON x.band = y.band AND x.key = y.key AND x.doc_id < y.doc_id)"
)


def word_shingles(n: int):  # noqa: ANN201
    ws = X.split_words(text())
    return A.let(ws, lambda w: F.when(F.coalesce(F.size(w), F.lit(0)) < n, F.array().cast("array<string>")).otherwise(
        F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(w, i, n), " ")))))


def signed(spark: SparkSession, d: str) -> DataFrame:
    """(id, n, signature) over five-word shingles of texts as they are; null texts have none."""
    return minhash.md5_signatures(table(spark, d, "documents"), "doc_id", word_shingles(5), K)


@query(f"WITH {SHINGLE_SQL}, u AS (SELECT unnest(s) AS s FROM s), c AS (SELECT s, count(*) AS n FROM u GROUP BY s) SELECT CAST(n AS BIGINT) AS documents, CAST(count(*) AS BIGINT) AS shingles FROM c GROUP BY n")
def shingle_frequencies(spark: SparkSession, d: str) -> DataFrame:
    """How many five-word shingles stand in how many documents: the inverted scan, counts combined early."""
    rows = table(spark, d, "documents").select(F.explode(word_shingles(5)).alias("s"))
    return rows.groupBy("s").agg(F.count(F.lit(1)).alias("documents")).groupBy("documents").agg(F.count(F.lit(1)).alias("shingles"))


@query(SIGNED_SQL + " SELECT doc_id, n, signature FROM g")
def md5_signatures(spark: SparkSession, d: str) -> DataFrame:
    return signed(spark, d).select(F.col("id").alias("doc_id"), F.col("n").cast("bigint").alias("n"), "signature")


@query(SIGNED_SQL + PAIRS_SQL + " SELECT a, b, CAST(estimate AS DOUBLE) AS estimate FROM c WHERE b IN (SELECT doc_id FROM g WHERE n > 0)")
def md5_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Pairs that share a band with their estimates, over texts that have shingles."""
    rows = materialise(signed(spark, d).where("n > 0").select(F.col("id").alias("rep"), "signature"), "signed")
    return minhash.candidate_pairs(rows, BANDS)


CLUSTER_SQL = (
    SIGNED_SQL + PAIRS_SQL
    + f", e AS (SELECT a, b FROM c WHERE estimate >= {LEAST} UNION ALL SELECT b, a FROM c WHERE estimate >= {LEAST}), "
    "r(id, seen) AS (SELECT doc_id, doc_id FROM g UNION SELECT r.id, e.b FROM r JOIN e ON r.seen = e.a), "
    "l AS (SELECT id AS doc_id, min(seen) AS cluster FROM r GROUP BY id), n AS (SELECT a AS doc_id, count(*) AS links FROM e GROUP BY a)"
)


def clustered(spark: SparkSession, d: str) -> DataFrame:
    rows = materialise(signed(spark, d), "signed")
    return minhash.cluster(rows.select("id", F.md5(F.array_join("signature", ",")).alias("class"), "n", "signature"), "doc_id", BANDS, LEAST)


@query(CLUSTER_SQL + " SELECT l.doc_id, cluster, CAST(coalesce(links, 0) AS BIGINT) AS links FROM l LEFT JOIN n USING (doc_id)")
def md5_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Every document's cluster and number of links; texts of equal signatures are one class."""
    return clustered(spark, d)


@query(CLUSTER_SQL + " SELECT doc_id FROM l WHERE doc_id = cluster")
def md5_representatives(spark: SparkSession, d: str) -> DataFrame:
    """The least id of each cluster."""
    return clustered(spark, d).where("doc_id = cluster").select("doc_id")


# ------------------------------------------------------------------ evaluation
CANDIDATE = {"fraction": "\\\\frac\\{[^{}]+\\}\\{[^{}]+\\}", "number": "-?[0-9]+(?:\\.[0-9]+)?(?:/[0-9]+)?", "assignment": "[A-Za-z]\\s*=\\s*[-+]?[0-9]+(?:\\.[0-9]+)?"}
BOXED_SQL = q(X.BOXED.replace("++", "+"))
CANDIDATES_SQL = (
    f"WITH o AS (SELECT rollout_id, response, row_number() OVER (PARTITION BY rollout_id ORDER BY response) AS k FROM (SELECT DISTINCT rollout_id, {STRIP_SQL('response')} AS response FROM rollouts)), "
    f"l AS (SELECT rollout_id, k, response AS t, list_filter(list_transform(regexp_split_to_array(response, '\\r\\n|[\\n\\r]'), lambda x: {STRIP_SQL('x')}), lambda x: x <> '') AS ls, regexp_extract_all(response, {BOXED_SQL}, 1) AS bs FROM o), "
    f"e AS (SELECT *, CASE WHEN len(ls) > 0 THEN {STRIP_SQL('regexp_replace(ls[-1], ' + q('(?i)^(final answer|answer)' + chr(92) + 's*[:：]' + chr(92) + 's*') + ', ' + q('') + ')')} ELSE '' END AS z FROM l) "
    "SELECT rollout_id, CASE WHEN t IS NOT NULL THEN list_sort(list_distinct(list_filter(list_concat(["
    f"CASE WHEN contains(t, '<answer>') AND contains(t, '</answer>') THEN {STRIP_SQL(chr(115) + 'tring_split(string_split(t, ' + q('<answer>') + ')[-1], ' + q('</answer>') + ')[1]')} ELSE '' END, "
    f"CASE WHEN len(bs) > 0 THEN {STRIP_SQL('bs[-1]')} ELSE '' END, CASE WHEN contains(t, '</think>') THEN {STRIP_SQL('string_split(t, ' + q('</think>') + ')[-1]')} ELSE '' END, z, "
    + ", ".join(f"regexp_extract(z, {q('(' + p + ')' + chr(92) + 's*$')}, 1)" for p in CANDIDATE.values())
    + ", t], list_concat(" + ", ".join(f"regexp_extract_all(t, {q(CANDIDATE[p])})[-3:]" for p in ("fraction", "number")) + ")), lambda x: x <> ''))) END AS candidates FROM e"
)


@query(CANDIDATES_SQL)
def answer_pieces(spark: SparkSession, d: str) -> DataFrame:
    """The pieces of each response that may be its answer, as an ordered set."""
    rows = table(spark, d, "rollouts").select("rollout_id", X.strip(F.col("response")).alias("response")).distinct()
    return rows.select("rollout_id", F.array_sort(X.answer_candidates(F.col("response"))).alias("candidates"))


COMMA_SQL = lambda c: f"regexp_replace({c}, '([0-9]),([0-9]{{3}})', '\\1\\2', 'g')"
NORM_SQL = lambda c: (
    "regexp_replace(regexp_replace(regexp_replace(regexp_replace(" + COMMA_SQL(COMMA_SQL(f"lower({c})"))
    + ", '[\\s\\v$]|\\\\[,!;]|\\.$|^\\\\boxed\\{', '', 'g'), '^[a-z]=', ''), '\\\\d?frac\\{([^{}]+)\\}\\{([^{}]+)\\}', '\\1/\\2', 'g'), '^([-+]?[0-9]+)\\.0+$', '\\1')"
)
NUM_SQL = lambda c: f"coalesce(TRY_CAST({c} AS DOUBLE), CASE WHEN regexp_full_match({c}, '[-+]?[0-9]+/[0-9]+') THEN TRY_CAST(string_split({c}, '/')[1] AS DOUBLE) / nullif(TRY_CAST(string_split({c}, '/')[2] AS DOUBLE), 0) END)"
SAME_SQL = lambda a, b: f"coalesce({a} = {b} OR coalesce(abs({NUM_SQL(a)} - {NUM_SQL(b)}) < 1e-9, false), false)"


@query(
    "WITH r AS (SELECT DISTINCT rollout_id, item_id, response FROM rollouts), a AS (SELECT rollout_id, response, " + NORM_SQL("answer") + " AS w FROM r LEFT JOIN math_problems USING (item_id)), c AS ("
    + CANDIDATES_SQL.replace("SELECT DISTINCT rollout_id, " + STRIP_SQL("response") + " AS response FROM rollouts", "SELECT DISTINCT rollout_id, response AS raw, " + STRIP_SQL("response") + " AS response FROM rollouts")
    .replace("SELECT rollout_id, response, row_number() OVER (PARTITION BY rollout_id ORDER BY response)", "SELECT rollout_id, raw, response, row_number() OVER (PARTITION BY rollout_id ORDER BY response)")
    .replace("SELECT rollout_id, k, response AS t,", "SELECT rollout_id, raw, k, response AS t,").replace("SELECT rollout_id, CASE WHEN t IS NOT NULL", "SELECT rollout_id, raw, bs, CASE WHEN t IS NOT NULL")
    + "), n AS (SELECT a.rollout_id, a.response, w, list_transform(candidates, lambda x: " + NORM_SQL("x") + ") AS ns, CASE WHEN len(bs) > 0 THEN " + NORM_SQL("bs[-1]") + " END AS b FROM a JOIN c ON a.rollout_id = c.rollout_id AND a.response IS NOT DISTINCT FROM c.raw), "
    "f AS (SELECT rollout_id, response, " + SAME_SQL("b", "w") + " AS boxed, len(list_filter(coalesce(ns, []), lambda x: " + SAME_SQL("x", "w") + ")) > 0 AS free FROM n) "
    "SELECT rollout_id, md5(response) AS digest, CASE WHEN boxed THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS format_reward, CASE WHEN boxed OR free THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS reward FROM f"
)
def relaxed_scores(spark: SparkSession, d: str) -> DataFrame:
    """Every response's relaxed reward against its problem's answer."""
    problems = table(spark, d, "math_problems")
    problems = problems.select("item_id", evaluation.ground_truths(problems, "answer").alias("truths"))
    rows = table(spark, d, "rollouts").select("rollout_id", "item_id", "response").distinct().join(problems, "item_id", "left")
    rows = rows.select("rollout_id", F.md5("response").alias("digest"), evaluation.relaxed_reward(F.col("response"), F.col("truths")).alias("r"))
    return rows.select("rollout_id", "digest", "r.format_reward", "r.reward")


TAG_SQL = STRIP_SQL("string_split(string_split(response, '<answer>')[-1], '</answer>')[1]")


@query(
    "WITH r AS (SELECT DISTINCT rollout_id, item_id, response FROM rollouts), s AS (SELECT rollout_id, response, coalesce(contains(response, '</think> <answer>') AND contains(response, '</answer>'), false) AS well, "
    f"{NORM_SQL(TAG_SQL)} AS x, {NORM_SQL('answer')} AS w FROM r LEFT JOIN math_problems USING (item_id)) "
    f"SELECT rollout_id, md5(response) AS digest, CASE WHEN well THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS format_reward, CASE WHEN well AND {SAME_SQL('x', 'w')} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS reward FROM s"
)
def strict_scores(spark: SparkSession, d: str) -> DataFrame:
    """Every response's strict reward against its problem's answer."""
    problems = table(spark, d, "math_problems")
    problems = problems.select("item_id", evaluation.ground_truths(problems, "answer").alias("truths"))
    rows = table(spark, d, "rollouts").select("rollout_id", "item_id", "response").distinct().join(problems, "item_id", "left")
    judge = evaluation.by_mode("strict")[0]
    rows = rows.select("rollout_id", F.md5("response").alias("digest"), judge(F.col("response"), F.col("truths")).alias("r"))
    return rows.select("rollout_id", "digest", "r.format_reward", "r.reward")


@query("SELECT item_id, CASE WHEN answer IS NULL THEN [] ELSE [answer] END AS truths FROM math_problems")
def truth_lists(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "math_problems")
    return rows.select("item_id", evaluation.ground_truths(rows, "answer").alias("truths"))


GOLD_SQL = f"upper({STRIP_SQL('answer')})"


@query(f"SELECT item_id FROM (SELECT item_id, {CHOICE_SQL('d')} AS p, {GOLD_SQL} AS g FROM mmlu) WHERE p IS DISTINCT FROM g ORDER BY {ORDER_SQL('item_id')} LIMIT 10")
def wrong_answers(spark: SparkSession, d: str) -> DataFrame:
    """A seeded sample of ten wrong predictions; the fourth option stands in for a model's output."""
    rows = table(spark, d, "mmlu")
    return evaluation.wrong_sample(rows, "item_id", X.parse_choice(F.col("d")), evaluation.mmlu_gold(F.col("answer"))).select("item_id")


@query("SELECT instruction, chosen AS output, 'model' AS generator, coalesce(source, 'alpaca_eval') AS dataset FROM preference_examples")
def prediction_table(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.prediction_table(table(spark, d, "preference_examples"), "instruction", "chosen", "model", "source")


@query("SELECT CAST(count(*) AS BIGINT) AS n, round(sum(reward) / count(*), 6) AS mean_reward FROM (SELECT DISTINCT rollout_id, coalesce(reward, 0) AS reward FROM rollouts ORDER BY rollout_id, reward LIMIT 50)")
def validation_reward(spark: SparkSession, d: str) -> DataFrame:
    """Mean reward of the first fifty rollouts; a null reward counts as 0."""
    rows = table(spark, d, "rollouts").select("rollout_id", F.coalesce("reward", F.lit(0.0)).alias("reward")).distinct()
    return evaluation.validation_mean(rows.withColumn("order", F.struct("rollout_id", "reward")), "order", "reward", 50).select("n", r6("mean_reward").alias("mean_reward"))


@query("SELECT example_id FROM preference_examples WHERE length(instruction) + length(chosen) <= 600 AND length(instruction) + length(rejected) <= 600")
def length_filter(spark: SparkSession, d: str) -> DataFrame:
    """Characters stand in for tokens; rows with a null part have no length."""
    rows = table(spark, d, "preference_examples")
    return evaluation.length_filter(rows, F.length("instruction"), F.length("chosen"), F.length("rejected"), 600).select("example_id")


@query("SELECT example_id, 0 AS output_no, chosen AS output FROM preference_examples UNION ALL SELECT example_id, 1, rejected FROM preference_examples")
def expanded_rollouts(spark: SparkSession, d: str) -> DataFrame:
    """One row an answer, both answers standing in for sampled outputs."""
    rows = table(spark, d, "preference_examples").withColumn("outputs", F.array("chosen", "rejected"))
    return reward.expand_rollouts(rows, "outputs", ["example_id"])


LAST_SQL = "replace(regexp_extract_all(answer, '" + C.NUMBER + "')[-1], ',', '')"
FIRST_SQL = "replace(nullif(regexp_extract(answer, '####\\s*(" + C.NUMBER + ")', 1), ''), ',', '')"


@query(f"SELECT item_id, {LAST_SQL} AS predicted, {FIRST_SQL} AS gold, {LAST_SQL} IS NOT DISTINCT FROM {FIRST_SQL} AS correct FROM gsm8k")
def gsm8k_scored(spark: SparkSession, d: str) -> DataFrame:
    """The reference answers stand in for a model's outputs."""
    items = table(spark, d, "gsm8k")
    return evaluation.gsm8k_scored(items, items.select("item_id", F.col("answer").alias("output")))


@query(f"SELECT item_id, {CHOICE_SQL('d')} AS predicted, {GOLD_SQL} AS gold, coalesce({CHOICE_SQL('d')} = {GOLD_SQL}, false) AS correct FROM mmlu")
def mmlu_scored(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "mmlu")
    return evaluation.mmlu_scored(items, items.select("item_id", F.col("d").alias("output")))


# ------------------------------------------------------------------ token metrics
ZIP_SQL = "zip AS (SELECT rollout_id, unnest(logprobs)::DOUBLE AS lp, generate_subscripts(logprobs, 1) AS i, len(logprobs) AS n, reward FROM (SELECT DISTINCT rollout_id, logprobs, reward FROM rollouts WHERE logprobs IS NOT NULL AND reward IS NOT NULL AND len(list_filter(logprobs, lambda x: x IS NULL)) = 0))"


def metrics(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "rollouts").select("rollout_id", "logprobs", "reward").distinct()
    return rows.where("logprobs is not null and reward is not null and size(logprobs) > 0 and not exists(logprobs, x -> x is null)")


@query(f"WITH {ZIP_SQL} SELECT rollout_id, round(sum(CASE WHEN i >= 3 AND i < n THEN lp ELSE 0 END), 6) AS logprob FROM zip GROUP BY rollout_id, reward, n")
def sequence_logprobs(spark: SparkSession, d: str) -> DataFrame:
    """Of responses after a prompt of three tokens that leave the last place out."""
    rows = metrics(spark, d)
    return rows.select("rollout_id", r6(A.sequence_logprob(F.col("logprobs"), F.lit(3), F.greatest(F.size("logprobs") - 3, F.lit(0)))).alias("logprob"))


@query(
    f"WITH {ZIP_SQL}, t AS (SELECT rollout_id, reward, lp, exp(lp - lp * 1.1) AS r, reward - 0.5 AS a FROM zip) SELECT rollout_id, round(sum(-reward * lp), 6) AS no_baseline, round(sum(-a * lp), 6) AS reinforce, "
    "round(sum(-least(r * a, least(greatest(r, 0.8), 1.2) * a)), 6) AS clipped, round(avg(CASE WHEN r BETWEEN 0.8 AND 1.2 THEN 0.0 ELSE 1.0 END), 6) AS clipped_share FROM t GROUP BY rollout_id, reward"
)
def loss_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Summed token losses of all kinds; old log-probabilities are the new ones times 1.1."""
    lp = F.col("lp")
    rows = metrics(spark, d).withColumn("lp", F.transform("logprobs", lambda v: v.cast("double")))
    old, adv = F.transform(lp, lambda v: v * 1.1), F.col("reward") - 0.5
    of = lambda kind: r6(A.total(A.loss_by_type(kind, lp, F.col("reward"), adv, old, 0.2)))
    return rows.select(
        "rollout_id", of("no_baseline").alias("no_baseline"), of("reinforce_with_baseline").alias("reinforce"), of("grpo_clip").alias("clipped"), r6(A.clipped_share(lp, old)).alias("clipped_share")
    )


DPO_SQL = "CASE WHEN x >= 0 THEN ln(1 + exp(-x)) ELSE -x + ln(1 + exp(x)) END"


@query(
    "WITH m AS (SELECT rollout_id, any_value(step) AS step, any_value(group_no) AS group_no, any_value(reward) AS reward, any_value(list_sum(list_transform(logprobs, lambda v: CAST(v AS DOUBLE)))) AS lp FROM (SELECT DISTINCT rollout_id, step, group_no, reward, logprobs FROM rollouts "
    "WHERE reward IS NOT NULL AND logprobs IS NOT NULL AND len(logprobs) > 0 AND len(list_filter(logprobs, lambda x: x IS NULL)) = 0) GROUP BY rollout_id HAVING count(*) = 1), "
    "g AS (SELECT step, group_no, (array_agg(lp ORDER BY reward DESC, rollout_id))[1] AS c, (array_agg(lp ORDER BY reward, rollout_id))[1] AS r FROM m WHERE step IS NOT NULL AND group_no IS NOT NULL GROUP BY step, group_no HAVING max(reward) > min(reward)), "
    f"l AS (SELECT step, 0.1 * ((c - r) - (0.9 * c - 0.9 * r)) AS x, c > r AS won FROM g) SELECT step, CAST(count(*) AS BIGINT) AS pairs, round(avg({DPO_SQL}), 6) AS loss, round(avg(CASE WHEN won THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM l GROUP BY step"
)
def dpo_rollouts(spark: SparkSession, d: str) -> DataFrame:
    """Preference loss and accuracy by step: a group's best and worst rollout by their summed token
    log-probabilities; the reference model's are nine tenths of these."""
    rows = table(spark, d, "rollouts").select("rollout_id", "step", "group_no", "reward", "logprobs").distinct()
    rows = rows.where("reward is not null and size(logprobs) > 0 and not exists(logprobs, x -> x is null)")
    one = rows.groupBy("rollout_id").agg(*[F.first(c).alias(c) for c in ("step", "group_no", "reward", "logprobs")], F.count(F.lit(1)).alias("k")).where("k = 1")
    one = one.withColumn("lp", A.sequence_logprob(F.col("logprobs"), F.lit(1), F.size("logprobs")))
    best = lambda sign: F.min_by("lp", F.struct((F.col("reward") * sign).alias("r"), F.col("rollout_id")))
    pairs = one.where("step is not null and group_no is not null").groupBy("step", "group_no").agg(
        best(-1).alias("c"), best(1).alias("r"), F.max("reward").alias("high"), F.min("reward").alias("low")
    )
    loss = A.dpo_loss(F.col("c"), F.col("r"), F.col("c") * 0.9, F.col("r") * 0.9, 0.1)
    return pairs.where("high > low").groupBy("step").agg(
        F.count(F.lit(1)).alias("pairs"), r6(F.avg(loss)).alias("loss"), r6(F.avg((F.col("c") > F.col("r")).cast("double"))).alias("accuracy")
    )


@query(f"WITH {EMB_SQL}, v AS (SELECT label, vec_id, max(CASE WHEN i = 1 THEN top + ln(total) - v END) AS loss FROM z JOIN (SELECT vec_id, label FROM embeddings) USING (vec_id) GROUP BY ALL) SELECT label, round(avg(loss), 6) AS mean_loss, round(sum(loss), 4) AS summed_loss FROM v GROUP BY label")
def token_losses(spark: SparkSession, d: str) -> DataFrame:
    """Cross-entropy by label, its mean and its sum; embeddings stand in for logits, the target is the first."""
    rows = table(spark, d, "embeddings").withColumn("loss", A.cross_entropy(emb(), F.lit(0)))
    return reward.token_losses(rows, ["label"], "loss").select("label", r6("mean_loss").alias("mean_loss"), F.round("summed_loss", 4).alias("summed_loss"))


@query(
    "WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE / 2 AS v, generate_subscripts(embedding, 1) AS i FROM embeddings), s AS (SELECT vec_id, max(v) AS top FROM e GROUP BY vec_id), "
    "z AS (SELECT vec_id, i, exp(v - top) AS x FROM e JOIN s USING (vec_id)), c AS (SELECT vec_id, i, sum(x) OVER (PARTITION BY vec_id ORDER BY i) / sum(x) OVER (PARTITION BY vec_id) AS mass FROM z) "
    "SELECT vec_id, CAST(coalesce(min(CASE WHEN mass > (vec_id * 37 % 101) / 101.0 THEN i END), max(i)) - 1 AS INTEGER) AS token FROM c GROUP BY vec_id"
)
def drawn_tokens(spark: SparkSession, d: str) -> DataFrame:
    """A token drawn at temperature 2, by numbers that follow the id."""
    p = A.softmax(emb(), 2.0)
    rows = table(spark, d, "embeddings").select("vec_id", p.alias("p"))
    return rows.select("vec_id", A.draw(F.col("p"), F.expr("(vec_id * 37 % 101) / 101.0D")).cast("int").alias("token"))


@query(
    "WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS i, len(embedding) AS d FROM embeddings), "
    "p AS (SELECT a.vec_id, a.i, a.v, b.v AS o, vec_id % 50 / pow(10000, (a.i - a.i % 2) / a.d) AS angle FROM e a JOIN e b USING (vec_id) WHERE b.i = CASE WHEN a.i % 2 = 0 THEN a.i + 1 ELSE a.i - 1 END), "
    "t AS (SELECT vec_id, i, CASE WHEN i % 2 = 0 THEN v * cos(angle) - o * sin(angle) ELSE o * sin(angle) + v * cos(angle) END AS x FROM p), "
    "s AS (SELECT vec_id, sum(v / (1 + exp(-v))) AS silu, sum(v / (1 + exp(-v)) * v) AS gated FROM e GROUP BY vec_id) "
    "SELECT vec_id, round(max(x), 6) AS rotated_top, round(sum(x * i), 4) AS rotated_sum, round(any_value(silu), 5) AS silu, round(any_value(gated), 5) AS gated FROM t JOIN s USING (vec_id) GROUP BY vec_id"
)
def vector_units(spark: SparkSession, d: str) -> DataFrame:
    """Rotated by position, and gated, embeddings."""
    rows = table(spark, d, "embeddings").select("vec_id", "embedding", A.rotate(emb(), F.col("vec_id") % 50).alias("x"))
    weighted = A.total(F.transform("x", lambda v, i: v * i))
    return rows.select(
        "vec_id", r6(F.array_max("x")).alias("rotated_top"), F.round(weighted, 4).alias("rotated_sum"),
        F.round(A.total(A.silu(emb())), 5).alias("silu"), F.round(A.total(A.swiglu(emb(), emb())), 5).alias("gated"),
    )


PART_SQL = lambda k: f"CAST(embedding[{k * 16 + 1}:{k * 16 + 16}] AS DOUBLE[])"


@query(
    "WITH p AS (SELECT vec_id, embedding, [" + ", ".join(f"list_inner_product({PART_SQL(0)}, {PART_SQL(k)}) / 4" for k in range(4)) + "] AS s FROM embeddings), "
    "e AS (SELECT vec_id, embedding, list_transform(s, lambda x: exp(x - list_max(s))) AS e FROM p), w AS (SELECT vec_id, embedding, list_transform(e, lambda x: x / list_sum(e)) AS w FROM e), "
    "o AS (SELECT vec_id, list_transform(range(1, 17), lambda j: w[1] * embedding[j] + w[2] * embedding[j + 16] + w[3] * embedding[j + 32] + w[4] * embedding[j + 48]) AS o FROM w) "
    "SELECT vec_id, round(list_sum(o), 5) AS total, round(list_max(o), 6) AS top, round(list_cosine_similarity(o, o), 6) AS self FROM o"
)
def attention_outputs(spark: SparkSession, d: str) -> DataFrame:
    """The first quarter of a vector attends to its four quarters."""
    parts = F.array(*[F.slice("embedding", k * 16 + 1, 16) for k in range(4)])
    rows = table(spark, d, "embeddings").select("vec_id", A.attention(F.slice("embedding", 1, 16), parts, parts).alias("o"))
    o = F.col("o")
    return rows.select("vec_id", F.round(A.total(o), 5).alias("total"), r6(F.array_max(o)).alias("top"), r6(A.cosine(o, o)).alias("self"))


@query("SELECT rollout_id, step, group_no, round(sum(reward) OVER (PARTITION BY step, group_no ORDER BY reward DESC, rollout_id ROWS UNBOUNDED PRECEDING), 6) AS mass FROM (SELECT DISTINCT rollout_id, step, group_no, reward, item_id FROM rollouts WHERE reward IS NOT NULL)")
def reward_mass(spark: SparkSession, d: str) -> DataFrame:
    """Rewards added up from the best on, by group: the relational form of top-p."""
    rows = once(spark, d).where("reward is not null")
    return reward.running_mass(rows, ["step", "group_no"], "reward", ["rollout_id"]).select("rollout_id", "step", "group_no", r6("mass").alias("mass"))


# ------------------------------------------------------------------ batches
STREAM_SQL = "s AS (SELECT string_agg(question, '' ORDER BY item_id) AS s FROM gsm8k WHERE question IS NOT NULL), c AS (SELECT list_transform(regexp_extract_all(s, '(?s).'), lambda x: ascii(x)) AS c FROM s)"


@query(f"WITH {STREAM_SQL} SELECT CAST(r AS BIGINT) AS \"row\", c[r * 97 + 1:r * 97 + 64] AS x, c[r * 97 + 2:r * 97 + 65] AS y FROM c, range(40) t(r)")
def language_model_batches(spark: SparkSession, d: str) -> DataFrame:
    """Forty pairs of input and target from given starts in the stream of all questions' characters."""
    placed = batching.stream_positions(letters(spark, d).where("ids is not null"), "item_id", "ids")
    stream = placed.select("position", F.posexplode("ids").alias("i", "token")).select((F.col("position") + F.col("i")).alias("at"), "token")
    starts = spark.range(40).select(F.col("id").alias("row"), (F.col("id") * 97).alias("start"))
    return batching.lm_batches(stream, starts, 64)


@query(
    f"WITH {STREAM_SQL}, r AS (SELECT r, c, ('0x' || substr(md5('42|3|' || CAST(r AS VARCHAR)), 1, 15))::BIGINT % (len(c) - 65) AS s FROM c, range(40) t(r)) "
    "SELECT CAST(r AS BIGINT) AS \"row\", c[s + 1:s + 64] AS x, c[s + 2:s + 65] AS y FROM r"
)
def random_batches(spark: SparkSession, d: str) -> DataFrame:
    """Forty pairs of input and target from starts drawn by hash."""
    placed = batching.stream_positions(letters(spark, d).where("ids is not null"), "item_id", "ids")
    n = placed.agg(F.max(F.col("position") + F.size("ids"))).first()[0]
    stream = placed.select("position", F.posexplode("ids").alias("i", "token")).select((F.col("position") + F.col("i")).alias("at"), "token")
    starts = spark.range(40).withColumnRenamed("id", "row").withColumn("start", batching.random_starts(n, 64, 3))
    return batching.lm_batches(stream, starts, 64)


@query("SELECT CAST(r AS BIGINT) AS \"row\", CAST(r AS BIGINT) AS corrected, CAST(r // 8 * 8 AS BIGINT) AS reference FROM range(100) t(r)")
def validation_starts(spark: SparkSession, d: str) -> DataFrame:
    """Starts of validation rows, and those of the stated form, which repeats a batch's first row."""
    rows = spark.range(100).withColumnRenamed("id", "row")
    return rows.select("row", batching.sequential_starts(8).alias("corrected"), batching.sequential_starts(8, "reference").cast("bigint").alias("reference"))


@query("SELECT source, CAST(floor(sum(n_chars) / 1024) AS BIGINT) AS batches FROM documents GROUP BY source")
def batch_counts(spark: SparkSession, d: str) -> DataFrame:
    """Whole batches of 1,024 characters by source."""
    rows = table(spark, d, "documents").groupBy("source").agg(F.sum("n_chars").alias("n"))
    return rows.select("source", batching.batch_count(F.col("n"), 1024).alias("batches"))


@query("SELECT CAST(s AS BIGINT) AS seconds, CASE WHEN s >= 3600 THEN printf('%02d:%02d:%02d', s // 3600, s % 3600 // 60, s % 60) ELSE printf('%02d:%02d', s // 60, s % 60) END AS duration FROM range(0, 100000, 37) t(s)")
def durations(spark: SparkSession, d: str) -> DataFrame:
    return spark.range(0, 100_000, 37).select(F.col("id").alias("seconds"), X.format_duration(F.col("id")).alias("duration"))


NAMED_FIT = FIT_SQL.replace("min_by(parameters, (final_loss, parameters))", "(array_agg(parameters ORDER BY final_loss, parameters))[1]")


@query(NAMED_FIT + " SELECT CAST(x AS DOUBLE) AS compute_budget, round(b + a * log10(x), 5) AS log10_parameters, round(log10(x / 6) - b - a * log10(x), 5) AS log10_tokens FROM f, (VALUES (1e22), (1e23), (1e24)) t(x)")
def isoflop_far(spark: SparkSession, d: str) -> DataFrame:
    """Best sizes and tokens at budgets beyond the runs."""
    fit = scaling.power_law(scaling.best_by_budget(table(spark, d, "isoflop_runs")))
    rows = scaling.extrapolate(fit, 1e22).union(scaling.extrapolate(fit, 1e23)).union(scaling.extrapolate(fit, 1e24))
    return rows.select("compute_budget", F.round(F.log10("parameters"), 5).alias("log10_parameters"), F.round(F.log10("tokens"), 5).alias("log10_tokens"))


@query(NAMED_FIT + " SELECT round(18 + i * 6 / 999.0, 6) AS log10_budget, round(b + a * (18 + i * 6 / 999.0), 5) AS log10_parameters FROM f, range(1000) t(i)")
def isoflop_series(spark: SparkSession, d: str) -> DataFrame:
    fit = scaling.power_law(scaling.best_by_budget(table(spark, d, "isoflop_runs")))
    return scaling.fit_series(fit, 18, 24).select(r6("log10_budget").alias("log10_budget"), F.round("log10_parameters", 5).alias("log10_parameters"))


# ------------------------------------------------------------------ files
def writing(kind: str, write: Callable[[str, pd.DataFrame], None]) -> Callable:
    """A mapInPandas function that hands each task's rows to `write` with a path of its own."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import uuid

        for batch in batches:
            if len(batch):
                write(f"{kind}/{uuid.uuid4().hex}", batch)
        yield pd.DataFrame({"done": [1]})

    return run


def archive(spark: SparkSession, d: str) -> DataFrame:
    """All documents as web archives, a file a batch of rows: html responses, plain ones for odd ids, and a
    request record each; read again."""
    folder = fresh(spark, "archive")

    def write(path: str, rows: pd.DataFrame) -> None:
        import gzip

        out = []
        for i, t in zip(rows["doc_id"], rows["text"]):
            body = (t or "").encode("utf-8", "surrogatepass")
            kind = "text/plain" if i % 2 else "text/html; charset=utf-8"
            http = f"HTTP/1.1 200 OK\r\nContent-Type: {kind}\r\n\r\n".encode() + body
            for record, data in (("request", b"GET / HTTP/1.1\r\n\r\n"), ("response", http)):
                head = f"WARC/1.0\r\nWARC-Type: {record}\r\nWARC-Target-URI: {i}\r\nContent-Length: {len(data)}\r\n\r\n"
                out.append(head.encode() + data + b"\r\n\r\n")
        put(path + ".warc.gz", gzip.compress(b"".join(out), 1))
        put(path + ".warc.wet.gz", b"not an archive of pages")

    table(spark, d, "documents").select("doc_id", "text").mapInPandas(writing(folder, write), "done int").count()
    return warc.read_warc(spark, folder)


@query("SELECT CAST(doc_id AS VARCHAR) AS url, md5(coalesce(text, '')) AS digest, CASE WHEN doc_id % 2 = 1 THEN 'text/plain' ELSE 'text/html; charset=utf-8' END AS content_type FROM documents")
def archive_responses(spark: SparkSession, d: str) -> DataFrame:
    """The responses of web archives."""
    rows = archive(spark, d).where("rec_type = 'response'")
    return rows.select("url", F.md5("payload").alias("digest"), "content_type")


@query("SELECT rec_type, CAST(sum(n) AS BIGINT) AS n FROM (SELECT unnest(['request', 'response']) AS rec_type, count(*) AS n FROM documents) GROUP BY rec_type")
def archive_records(spark: SparkSession, d: str) -> DataFrame:
    """Records by type; the files that are no archives of pages aren't listed."""
    return archive(spark, d).groupBy("rec_type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT CAST(doc_id AS VARCHAR) AS url FROM documents WHERE doc_id % 2 = 0")
def archive_pages(spark: SparkSession, d: str) -> DataFrame:
    """The html responses, by content type."""
    return warc.html_responses(archive(spark, d)).select("url")


@query()
def negative_samples(spark: SparkSession, d: str) -> DataFrame:
    """Page texts of the archives, masked and on one line, the first hundred by address."""
    return warc.negative_samples(archive(spark, d), 100)


@query("SELECT doc_id, md5(text) AS digest FROM documents")
def jsonl_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents as objects by line, in sub-folders, with a bad line in one file; read again."""
    folder = fresh(spark, "jsonl")
    files.write_json(table(spark, d, "documents").select("doc_id", "text"), f"{folder}/a/wiki_00")
    put(f"{folder}/b/wiki_01", b"not an object\n\n")
    rows = files.read_jsonl(spark, folder, "doc_id bigint, text string")
    return rows.select("doc_id", F.md5("text").alias("digest"))


@query("SELECT item_id, question, answer FROM gsm8k")
def strict_jsonl(spark: SparkSession, d: str) -> DataFrame:
    """Objects by line where every line must be one."""
    folder = fresh(spark, "strict")
    files.write_json(table(spark, d, "gsm8k").select("item_id", "question", "answer"), folder)
    return files.read_jsonl(spark, folder, "item_id bigint, question string, answer string", strict=True, pattern="*.json")


@query("SELECT replace(subject, '_', ' ') AS subject, question, a, b, c, d, upper(" + STRIP_SQL("answer") + ") AS answer FROM mmlu WHERE question IS NOT NULL AND answer IS NOT NULL AND subject IS NOT NULL")
def mmlu_files(spark: SparkSession, d: str) -> DataFrame:
    """Choice questions as files without headers, one a subject; read again."""
    folder = fresh(spark, "mmlu")

    def write(rows: pd.DataFrame) -> pd.DataFrame:
        subject = rows["subject"].iloc[0].replace(" ", "_")
        body = rows[["question", "a", "b", "c", "d", "answer"]].to_csv(index=False, header=False)
        put(f"{folder}/{subject}_test.csv", body.encode() + b"a row,of three,fields\n")
        put(f"{folder}/{subject}_dev.csv", body.encode())
        return pd.DataFrame({"done": [1]})

    rows = table(spark, d, "mmlu").where("question is not null and answer is not null and subject is not null")
    rows.groupBy("subject").applyInPandas(write, "done int").count()
    return files.read_mmlu(spark, folder)


@query("SELECT CAST(item_id AS VARCHAR) AS item_id, problem AS prompts_final FROM math_problems WHERE problem IS NOT NULL")
def csv_with_header(spark: SparkSession, d: str) -> DataFrame:
    folder = fresh(spark, "csv")
    rows = table(spark, d, "math_problems").where("problem is not null").select("item_id", F.col("problem").alias("prompts_final"))
    rows.write.option("header", "true").option("escape", '"').csv(folder)
    return files.read_csv(spark, folder).select("item_id", "prompts_final")


@query("SELECT parameters, compute_budget, final_loss FROM isoflop_runs")
def json_array(spark: SparkSession, d: str) -> DataFrame:
    """Runs as one array in a file; read again."""
    path = fresh(spark, "runs") + "/runs.json"
    runs = table(spark, d, "isoflop_runs").select("parameters", "compute_budget", "final_loss")
    array = runs.agg(F.to_json(F.collect_list(F.struct("*"))).alias("j")).first()["j"]  # the small table of runs
    put(path, array.encode())
    return files.read_json_array(spark, path, "parameters bigint, compute_budget double, final_loss double")


@query("SELECT doc_id, md5(text) AS digest FROM documents WHERE text <> ''")
def whole_files(spark: SparkSession, d: str) -> DataFrame:
    """Documents as one file each; read again as wholes. Files without a byte give no row."""
    folder = fresh(spark, "whole")

    def write(path: str, rows: pd.DataFrame) -> None:
        for i, t in zip(rows["doc_id"], rows["text"]):
            put(f"{folder}/{i % 100}/{i}.txt", t.encode())

    table(spark, d, "documents").where("text is not null").select("doc_id", "text").mapInPandas(writing(folder, write), "done int").count()
    rows = files.read_bytes_ignoring(spark, folder)
    return rows.select(F.regexp_extract("path", "([0-9]+)\\.txt$", 1).cast("bigint").alias("doc_id"), F.md5("text").alias("digest"))


@query("SELECT doc_id, md5(text) AS digest FROM documents WHERE doc_id IN (SELECT doc_id FROM (" + METRICS_SQL + f"SELECT doc_id FROM m WHERE {KEEP_SQL}))")
def kept_documents(spark: SparkSession, d: str) -> DataFrame:
    """The documents that the rule filter keeps, written by id and read again."""
    folder, rows = fresh(spark, "kept"), table(spark, d, "documents")
    files.write_kept(rows.select("doc_id", "text"), rows.where(X.gopher_keep(text())), "doc_id", folder)
    return spark.read.parquet(folder).select("doc_id", F.md5("text").alias("digest"))


def labelled(spark: SparkSession, d: str) -> DataFrame:
    """Kept documents as lines of high quality and all others as lines of low quality, in files; merged."""
    high, low = fresh(spark, "high"), fresh(spark, "low")
    flat = X.collapse_spaces(text())
    rows = table(spark, d, "documents").where(~X.is_blank(text()))
    files.write_labelled(rows.where(X.gopher_keep(text())), F.lit("hq"), flat, high)
    files.write_labelled(rows.where(~X.gopher_keep(text())), F.lit("lq"), flat, low)
    return spark.read.text([high, low])


LABELS_SQL = METRICS_SQL.replace("SELECT doc_id, CAST(len(ws)", "SELECT doc_id, ws, CAST(len(ws)") + f", l AS (SELECT CASE WHEN {KEEP_SQL} THEN 'hq' ELSE 'lq' END AS label, array_to_string(ws, ' ') AS text FROM m WHERE n_words > 0) "


@query(LABELS_SQL + "SELECT label, md5(text) AS digest FROM l")
def merged_samples(spark: SparkSession, d: str) -> DataFrame:
    """Both kinds of labelled lines, written, read and merged."""
    rows = labelled(spark, d)
    high, low = (rows.where(F.col("value").startswith(f"__label__{k}")) for k in ("hq", "lq"))
    return classify.merge_samples(high, low).select("label", F.md5("text").alias("digest"))


@query(LABELS_SQL + "SELECT CAST(count(*) FILTER (label = 'hq') AS BIGINT) AS positives, CAST(CASE WHEN count(*) FILTER (label = 'hq') > 0 THEN count(*) FILTER (label = 'hq') ELSE 10000 END AS BIGINT) AS target FROM l")
def positive_target(spark: SparkSession, d: str) -> DataFrame:
    """Lines of high quality, and how many negatives to look for."""
    return classify.count_positives(labelled(spark, d))


@query()
def quality_classifier(spark: SparkSession, d: str) -> DataFrame:
    """(label, precision, recall, n) on a held-out tenth of at most 4,000 labelled lines, by hash."""
    rows = labelled(spark, d)
    high, low = (rows.where(F.col("value").startswith(f"__label__{k}")) for k in ("hq", "lq"))
    sample = classify.merge_samples(high, low).orderBy(F.md5("text")).limit(4000).withColumn("key", F.md5("text"))
    split = materialise(batching.split_by_ratio(sample, "key", 0.1), "quality")
    model = classify.fit_classifier(split.where("split = 'train'"), "text", "label")
    scored = classify.classify(model, split.where("split = 'val'"), "text", ["label"])
    return classify.precision_recall(scored, "label").select("label", r6("precision").alias("precision"), r6("recall").alias("recall"), "n")


@query("SELECT item_id, list_transform(regexp_extract_all(question, '(?s).'), lambda x: ascii(x)) AS ids FROM gsm8k")
def cached_ids(spark: SparkSession, d: str) -> DataFrame:
    """Token ids written once and read again; characters stand in for tokens."""
    folder = fresh(spark, "ids")
    files.write_ids(letters(spark, d), folder)
    return spark.read.parquet(folder)


@query("SELECT replace(subject, ' ', '_') AS token, CAST(row_number() OVER (ORDER BY subject) - 1 AS INTEGER) AS id FROM (SELECT DISTINCT subject FROM mmlu WHERE subject IS NOT NULL)")
def vocabulary_files(spark: SparkSession, d: str) -> DataFrame:
    """A vocabulary and its merges as files, read again; the subjects stand in for tokens, a pair of neighbours for a merge."""
    rows = table(spark, d, "mmlu").where("subject is not null").select("subject").distinct().orderBy("subject").collect()  # a list of subjects
    tokens = [r["subject"].replace(" ", "_") for r in rows]
    paths = bpe.write_vocabulary({t: i for i, t in enumerate(tokens)}, {p: i for i, p in enumerate(zip(tokens, tokens[1:]))}, fresh(spark, "vocabulary"))
    vocab, ranks = bpe.load(*paths)
    if list(ranks) != list(zip(tokens, tokens[1:])):
        raise ValueError("merges are not read as written")
    return spark.createDataFrame(list(vocab.items()), "token string, id int")


@query("SELECT step, CAST(count(reward) AS BIGINT) * 2 AS n, round(avg(reward), 6) AS mean FROM (SELECT DISTINCT rollout_id, step, group_no, reward, item_id FROM rollouts) GROUP BY step")
def appended_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Records appended twice to a log of objects by line; read again and added up."""
    folder = fresh(spark, "metrics")
    stats = reward.reward_stats(once(spark, d), ["step"], "reward")
    for _ in range(2):
        files.append_metrics(stats.select("step", "n", "mean"), folder)
    log = spark.read.schema("step int, n bigint, mean double").json(folder)
    return log.groupBy("step").agg(F.sum("n").alias("n"), r6(F.max("mean")).alias("mean"))


@query("SELECT raw_id, chosen, rejected, source FROM (SELECT raw_id, chosen, rejected, 'f' || raw_id % 4 AS source FROM raw_preferences)")
def preference_folders(spark: SparkSession, d: str) -> DataFrame:
    """Conversations in four folders of objects by line; read again with the folder as their source."""
    root = fresh(spark, "folders")
    rows = table(spark, d, "raw_preferences").select("raw_id", "chosen", "rejected")
    for k in range(4):
        files.write_json(rows.where(F.col("raw_id") % 4 == k), f"{root}/f{k}")
    return files.read_folders(spark, [f"f{k}" for k in range(4)], root, "raw_id bigint, chosen string, rejected string")


@query(f"WITH {LINES_SQL.strip().removeprefix('WITH ').strip().split('c AS (')[0].rstrip().rstrip(',')} SELECT doc_id, CAST(pos - 1 AS INTEGER) AS pos, md5(line) AS digest FROM l")
def text_lines(spark: SparkSession, d: str) -> DataFrame:
    """All lines with their terminators."""
    return lines.split_lines(table(spark, d, "documents")).select("doc_id", "pos", F.md5("line").alias("digest"))


@query(f"SELECT doc_id FROM documents WHERE length({STRIP_SQL('text')}) > 100")
def long_texts(spark: SparkSession, d: str) -> DataFrame:
    """Texts of more than a hundred characters once stripped."""
    return table(spark, d, "documents").where(warc.long_enough(text())).select("doc_id")
