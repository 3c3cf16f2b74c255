"""Queries of the core operators over the test tables, and the SQL that each is compared with.

A query without SQL is one that SQL can't express at that size; tests compare it with brute force.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill import constants as C
from corpusmill.functions import arrays as A
from corpusmill.functions import text as X
from corpusmill.operators import batching, bpe, classify, evaluation, lines, minhash, reward, scaling
from corpusmill.plans.layout import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

Query = Callable[[SparkSession, str], DataFrame]


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def q(value: str) -> str:
    """A text as an SQL literal."""
    return "'" + value.replace("'", "''") + "'"


def text() -> Column:
    return F.col("text")


r6 = lambda c: F.round(c, 6)
r9 = lambda c: F.round(c, 9)

# ------------------------------------------------------------------ scalar text operators
WORDS_SQL = f"list_filter(regexp_split_to_array(text, {q(C.SPACE + '+')}), lambda w: w <> '')"
METRICS_SQL = f"""
WITH w AS (SELECT doc_id, text, {WORDS_SQL} AS ws, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
m AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words,
  CASE WHEN len(ws) > 0 THEN list_sum(list_transform(ws, lambda x: length(x))) / CAST(len(ws) AS DOUBLE) ELSE 0.0 END AS mean_word_length,
  CASE WHEN len(ws) > 0 THEN len(list_filter(ls, lambda x: regexp_matches(x, {q(chr(92) + '.' + chr(92) + '.' + chr(92) + '.' + C.SPACE + '*$')}))) / CAST(len(ls) AS DOUBLE) ELSE 0.0 END AS ellipsis_ratio,
  CASE WHEN len(ws) > 0 THEN len(list_filter(ws, lambda x: regexp_matches(x, '\\p{{L}}'))) / CAST(len(ws) AS DOUBLE) ELSE 0.0 END AS alpha_ratio FROM w)
"""


@query(METRICS_SQL + "SELECT doc_id, n_words, round(mean_word_length, 6) AS mean_word_length, round(ellipsis_ratio, 6) AS ellipsis_ratio, round(alpha_ratio, 6) AS alpha_ratio FROM m")
def gopher_metrics(spark: SparkSession, d: str) -> DataFrame:
    m = X.gopher_metrics(text())
    rows = table(spark, d, "documents").where("text is not null")
    return rows.select("doc_id", m["n_words"].alias("n_words"), *[r6(m[k]).alias(k) for k in ("mean_word_length", "ellipsis_ratio", "alpha_ratio")])


KEEP_SQL = "alpha_ratio > 0.8 AND ellipsis_ratio < 0.3 AND n_words BETWEEN 50 AND 100000 AND mean_word_length > 3 AND mean_word_length < 10"


@query(METRICS_SQL + f"SELECT doc_id FROM m WHERE {KEEP_SQL}")
def gopher_filter(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where(X.gopher_keep(text())).select("doc_id")


def masked(name: str, pattern: str, mask: str, f: Callable[[Column], Column]) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return table(spark, d, "documents").select("doc_id", F.md5(f(text())).alias("digest"), X.count_matches(text(), pattern).alias("n"))

    run.__name__ = name
    query(
        f"SELECT doc_id, md5(regexp_replace(text, {q(pattern)}, {q(mask)}, 'g')) AS digest, CAST(len(regexp_extract_all(text, {q(pattern)})) AS BIGINT) AS n FROM documents"
    )(run)


masked("mask_emails", C.EMAIL, C.EMAIL_MASK, X.mask_emails)
masked("mask_ips", C.IP, C.IP_MASK, X.mask_ips)


# the look-around of the phone pattern as groups; two passes, since neighbours share a character between them
PHONE_RE2 = q("(^|[^0-9])" .replace("(^", "(?i)(^") + C.PHONE_BODY.removeprefix("(?i)(?<![0-9])") + "($|[^0-9])")
PHONE_ONCE = lambda c: f"regexp_replace({c}, {PHONE_RE2}, {q(chr(92) + '1' + C.PHONE_MASK + chr(92) + '2')}, 'g')"
PHONE_SQL = lambda c: PHONE_ONCE(PHONE_ONCE(c))
MASK_COUNT = lambda c: f"len(string_split({c}, {q(C.PHONE_MASK)}))"


@query(f"SELECT doc_id, md5({PHONE_SQL('text')}) AS digest, CAST({MASK_COUNT(PHONE_SQL('text'))} - {MASK_COUNT('text')} AS BIGINT) AS n FROM documents")
def mask_phones(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(X.mask_phones(text())).alias("digest"), X.count_matches(text(), C.PHONE["corrected"]).alias("n"))


@query("SELECT doc_id, md5(text) AS digest, CAST(CASE WHEN text IS NOT NULL THEN 0 END AS BIGINT) AS n FROM documents")
def mask_phones_as_stated(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents")
    return rows.select("doc_id", F.md5(X.mask_phones(text(), "reference")).alias("digest"), X.count_matches(text(), C.PHONE["reference"]).alias("n"))


@query(
    f"SELECT doc_id, md5(regexp_replace(regexp_replace(text, {q(C.EMAIL)}, {q(C.EMAIL_MASK)}, 'g'), {q(C.IP)}, {q(C.IP_MASK)}, 'g')) AS digest FROM documents"
)
def desensitize_as_stated(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(X.desensitize(text(), "reference")).alias("digest"))


EMAIL_SQL = lambda c: f"regexp_replace({c}, {q(C.EMAIL)}, {q(C.EMAIL_MASK)}, 'g')"
CLEAN_SQL = lambda c: f"regexp_replace({PHONE_SQL(EMAIL_SQL(c))}, {q(C.IP)}, {q(C.IP_MASK)}, 'g')"


@query(f"SELECT doc_id, md5({CLEAN_SQL('text')}) AS digest FROM documents")
def desensitize(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(X.desensitize(text())).alias("digest"))


@query(f"SELECT doc_id, md5(array_to_string({WORDS_SQL}, ' ')) AS digest FROM documents")
def collapse_whitespace(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(X.collapse_spaces(text())).alias("digest"))


@query(
    METRICS_SQL.replace("WITH w AS", f"WITH masked AS (SELECT doc_id, {CLEAN_SQL('text')} AS text FROM documents), w AS").replace("FROM documents WHERE", "FROM masked WHERE")
    .replace("SELECT doc_id, CAST(len(ws)", "SELECT doc_id, ws, CAST(len(ws)")
    + f"SELECT doc_id, 'hq' AS label, md5(array_to_string(ws, ' ')) AS digest FROM m WHERE {KEEP_SQL}"
)
def positive_samples(spark: SparkSession, d: str) -> DataFrame:
    """Blank guard, masks, rule filter, one line."""
    return positives(spark, d).select("doc_id", "label", F.md5("text").alias("digest"))


def positives(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").where(~X.is_blank(text())).select("doc_id", X.desensitize(text()).alias("text"))
    return rows.where(X.gopher_keep(text())).select("doc_id", F.lit("hq").alias("label"), X.collapse_spaces(text()).alias("text"))


@query(
    METRICS_SQL.replace("WHERE text IS NOT NULL", "")
    + f"SELECT CASE WHEN coalesce(n_words, 0) = 0 THEN 'blank' WHEN {KEEP_SQL} THEN 'kept' ELSE 'rejected' END AS reason, CAST(count(*) AS BIGINT) AS n FROM m GROUP BY 1"
)
def skip_reasons(spark: SparkSession, d: str) -> DataFrame:
    return lines.skip_reasons(table(spark, d, "documents"), X.is_blank(text()), X.gopher_keep(text()))


NORMAL_SQL = f"strip_accents(trim(regexp_replace(regexp_replace(lower(text), {q('[^' + chr(92) + 'p{L}' + chr(92) + 'p{N}_' + C.SPACE[1:-1] + ']')}, '', 'g'), {q(C.SPACE + '+')}, ' ', 'g')))"


@query(f"SELECT doc_id, md5({NORMAL_SQL}) AS digest FROM documents")
def dedup_normal(spark: SparkSession, d: str) -> DataFrame:
    """The deduplication form of all documents; a null text has none."""

    @F.pandas_udf("string")
    def normal(texts):  # noqa: ANN001, ANN202
        return texts.map(minhash.normalise, na_action="ignore")

    return table(spark, d, "documents").select("doc_id", F.md5(normal(text())).alias("digest"))


CHARS = "regexp_extract_all(text, '(?s).')"


@query(f"SELECT doc_id, CAST(CASE WHEN len(c) < 5 THEN 0 ELSE len(list_distinct(list_transform(range(1, len(c) - 3), lambda i: c[i] || c[i + 1] || c[i + 2] || c[i + 3] || c[i + 4]))) END AS BIGINT) AS n FROM (SELECT doc_id, {CHARS} AS c FROM documents WHERE text IS NOT NULL)")
def shingle_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.size(X.char_shingles(text(), 5)).cast("bigint").alias("n"))


# ------------------------------------------------------------------ lines
LINES_SQL = """
WITH l AS (SELECT doc_id, unnest(regexp_extract_all(regexp_replace(text, '\\r\\n?', chr(10), 'g'), '[^\\n]*\\n|[^\\n]+')) AS line,
                  generate_subscripts(regexp_extract_all(regexp_replace(text, '\\r\\n?', chr(10), 'g'), '[^\\n]*\\n|[^\\n]+'), 1) AS pos FROM documents),
c AS (SELECT line, count(*) AS n FROM l GROUP BY line)
"""


@query(LINES_SQL + "SELECT md5(line) AS digest, CAST(n AS BIGINT) AS n FROM c")
def line_counts(spark: SparkSession, d: str) -> DataFrame:
    return lines.line_counts(table(spark, d, "documents")).select(F.md5("line").alias("digest"), "n")


@query(
    LINES_SQL
    + "SELECT d.doc_id, md5(coalesce(k.t, '')) AS digest FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN (SELECT doc_id, string_agg(l.line, '' ORDER BY pos) AS t FROM l JOIN c USING (line) WHERE n = 1 GROUP BY doc_id) k USING (doc_id)"
)
def exact_line_dedup(spark: SparkSession, d: str) -> DataFrame:
    return lines.unique_lines(table(spark, d, "documents")).select("doc_id", F.md5("text").alias("digest"))


# ------------------------------------------------------------------ near duplicates
@query()
def minhash_signature(spark: SparkSession, d: str) -> DataFrame:
    return minhash.signatures(table(spark, d, "documents"), "doc_id", "text").select(F.col("id").alias("doc_id"), "signature")


@query()
def dup_clusters(spark: SparkSession, d: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, d, "documents"))


@query()
def dedup_keep(spark: SparkSession, d: str) -> DataFrame:
    """The document of the least id of each cluster."""
    return minhash.near_duplicates(table(spark, d, "documents")).where("doc_id = cluster").select("doc_id")


# ------------------------------------------------------------------ tokenizer tables
@query("SELECT w AS pretoken, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest(regexp_extract_all(text, '[^ \\t\\n\\r\\f\\x0b]+')) AS w FROM documents) GROUP BY w")
def word_counts(spark: SparkSession, d: str) -> DataFrame:
    words = table(spark, d, "documents").select(F.explode(X.pretokens(text(), "[^ \\t\\n\\r\\f\\x0b]+")).alias("pretoken"))
    return words.groupBy("pretoken").agg(F.count(F.lit(1)).alias("n"))


SEP = chr(0xFDD0)  # a character that no text may have
NO_SPACE = f"[^{C.WHITE[1:-1]}]"
# a run of white space gives its last character to what follows: a mark before it stands for the look-ahead
TOKENS_SQL = lambda c: (
    f"regexp_extract_all(regexp_replace({c}, {q(f'({C.WHITE})({NO_SPACE})')}, {q(SEP + chr(92) + '1' + chr(92) + '2')}, 'g'), "
    + q(f"'(?:[sdmt]|ll|ve|re)| ?\\p{{L}}+| ?\\p{{N}}+| ?[^{C.WHITE[1:-1]}\\p{{L}}\\p{{N}}{SEP}]+|{C.WHITE}+") + ")"
)
PRE_SQL = f"t AS (SELECT unnest({TOKENS_SQL('text')}) AS pretoken FROM documents), p AS (SELECT pretoken, count(*) AS n FROM t GROUP BY pretoken)"
BYTES_SQL = "b AS (SELECT regexp_extract_all(hex(encode(pretoken)), '..') AS b, n FROM p)"
PAIRS_OF_SQL = "u AS (SELECT unnest(list_zip(b[1:len(b) - 1], b[2:len(b)])) AS z, n FROM b WHERE len(b) > 1), c AS (SELECT z[1] AS \"left\", z[2] AS \"right\", CAST(sum(n) AS BIGINT) AS n FROM u GROUP BY ALL)"


@query(f"WITH s AS (SELECT unnest(string_split(text, '<|endoftext|>')) AS text FROM documents), {PRE_SQL.replace('FROM documents', 'FROM s')} SELECT pretoken, CAST(n AS BIGINT) AS n FROM p")
def pretoken_counts(spark: SparkSession, d: str) -> DataFrame:
    return bpe.pretoken_counts(table(spark, d, "documents"), specials=["<|endoftext|>"])


@query(f"WITH {PRE_SQL}, {BYTES_SQL}, {PAIRS_OF_SQL} SELECT * FROM c")
def pair_counts(spark: SparkSession, d: str) -> DataFrame:
    return bpe.pair_counts(bpe.pretoken_counts(table(spark, d, "documents")))


@query(f"WITH {PRE_SQL}, {BYTES_SQL}, {PAIRS_OF_SQL} SELECT * FROM c ORDER BY n DESC, \"left\" DESC, \"right\" DESC LIMIT 1")
def best_pair(spark: SparkSession, d: str) -> DataFrame:
    return bpe.best_pair(bpe.pair_counts(bpe.pretoken_counts(table(spark, d, "documents"))))


@query(
    f"WITH {PRE_SQL}, h AS (SELECT array_to_string(regexp_extract_all(hex(encode(pretoken)), '..'), ' ') || ' ' AS h, n FROM p), "
    f"b AS (SELECT string_split(rtrim(replace(h, '20 74 ', '2074 ')), ' ') AS b, n FROM h), {PAIRS_OF_SQL} SELECT * FROM c"
)
def merged_pair_counts(spark: SparkSession, d: str) -> DataFrame:
    """Pair counts once a blank and a t have been merged."""
    return bpe.pair_counts(bpe.merge_pair(bpe.pretoken_counts(table(spark, d, "documents")), "20", "74"))


@query(f"SELECT w AS pretoken, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest(regexp_extract_all(text, {q(C.PRETOKEN_SIMPLE)})) AS w FROM documents) GROUP BY w")
def simple_pretoken_counts(spark: SparkSession, d: str) -> DataFrame:
    words = table(spark, d, "documents").select(F.explode(X.pretokens(text(), C.PRETOKEN_SIMPLE)).alias("pretoken"))
    return words.groupBy("pretoken").agg(F.count(F.lit(1)).alias("n"))


CUTS = ["the", "there", "."]
CUT_SQL = f"regexp_replace(text, '(there|the|[.])', {q(SEP + chr(92) + '1' + SEP)}, 'g')"


@query(f"SELECT doc_id, list_filter(string_split({CUT_SQL}, {q(SEP)}), lambda x: x <> '') AS pieces FROM documents")
def special_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Texts cut at tokens that stay as pieces; of two that start alike the longer one."""
    return table(spark, d, "documents").select("doc_id", X.split_specials(text(), CUTS).alias("pieces"))


@query("SELECT doc_id, list_filter(string_split(regexp_replace(text, '(there|the|[.])', " + q(SEP) + ", 'g'), " + q(SEP) + "), lambda x: x <> '') AS pieces FROM documents")
def special_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Texts cut at tokens that are dropped."""
    return table(spark, d, "documents").select("doc_id", X.split_specials(text(), CUTS, keep=False).alias("pieces"))


@query("SELECT CAST(b AS INTEGER) AS byte, CASE WHEN p THEN chr(CAST(b AS INTEGER)) ELSE chr(CAST(255 + sum(CASE WHEN p THEN 0 ELSE 1 END) OVER (ORDER BY b) AS INTEGER)) END AS letter FROM (SELECT b, b BETWEEN 33 AND 126 OR b BETWEEN 161 AND 172 OR b >= 174 AS p FROM range(256) t(b))")
def byte_letters(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame(list(bpe.byte_table().items()), "byte int, letter string")


@query("SELECT CAST(b AS INTEGER) AS id, printf('%02X', CAST(b AS INTEGER)) AS token FROM range(256) t(b) UNION ALL VALUES (256, hex(encode('<|a|>'))), (257, hex(encode('<|b|>')))")
def initial_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    return bpe.initial_vocabulary(spark, ["<|a|>", "<|b|>", "<|a|>"]).select("id", F.hex("token").alias("token"))


@query("SELECT hex(encode(instruction)) AS token, CAST(max(example_id) AS BIGINT) AS id FROM preference_examples WHERE instruction IS NOT NULL GROUP BY instruction")
def token_ids(spark: SparkSession, d: str) -> DataFrame:
    """Of equal tokens the highest id; instructions stand in for tokens."""
    rows = table(spark, d, "preference_examples").where("instruction is not null")
    rows = rows.select(F.encode("instruction", "utf-8").alias("token"), F.col("example_id").alias("id"))
    return bpe.highest_ids(rows).select(F.hex("token").alias("token"), "id")


@query()
def bpe_encode(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode(table(spark, d, "preference_examples"), "example_id", "instruction", {"<|endoftext|>": 50256})


@query("SELECT example_id, coalesce(instruction, '') AS text FROM preference_examples")
def bpe_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    return bpe.decode(bpe.encode(table(spark, d, "preference_examples"), "example_id", "instruction"), "example_id")


# ------------------------------------------------------------------ evaluation
NUM = q(C.NUMBER)
GOLD_SQL = f"replace(nullif(regexp_extract(answer, {q('####' + chr(92) + 's*(' + C.NUMBER + ')')}, 1), ''), ',', '')"
LAST_SQL = lambda c: f"replace(regexp_extract_all({c}, {NUM})[-1], ',', '')"


@query(f"SELECT item_id, {GOLD_SQL} AS gold, {LAST_SQL('answer')} AS predicted FROM gsm8k")
def gsm8k_parse(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "gsm8k")
    return rows.select("item_id", X.parse_gold_number(F.col("answer")).alias("gold"), X.parse_last_number(F.col("answer")).alias("predicted"))


@query("SELECT item_id, question || '\\nAnswer:' AS prompt FROM gsm8k")
def gsm8k_prompts(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.gsm8k_prompts(table(spark, d, "gsm8k"))


def replaced(template: str, **fields: str) -> str:
    out = q(template)
    for k, v in fields.items():
        out = f"replace({out}, '{{{k}}}', {v})"
    return out


@query(
    "SELECT item_id, " + replaced(C.SYSTEM_PROMPT, instruction="p") + " AS prompt FROM (SELECT item_id, "
    + replaced(C.MMLU_PROMPT, **{c: f"coalesce({c}, '')" for c in ("subject", "a", "b", "c", "d", "question")}) + " AS p FROM mmlu)"
)
def mmlu_prompts(spark: SparkSession, d: str) -> DataFrame:
    rows = evaluation.mmlu_prompts(table(spark, d, "mmlu"))
    return rows.select("item_id", evaluation.wrapped(F.col("prompt")).alias("prompt"))


CHOICE_SQL = lambda c: f"upper(coalesce(nullif(regexp_extract({c}, '(?i)the\\s+correct\\s+answer\\s+is\\s*([ABCD])\\b', 1), ''), nullif(regexp_extract({c}, '(?i)\\b([ABCD])\\b', 1), '')))"


@query(
    f"WITH p AS (SELECT {CHOICE_SQL('d')} AS predicted, upper(trim(answer)) AS gold FROM mmlu) "
    "SELECT CAST(count(*) AS BIGINT) AS n, round(avg(CASE WHEN predicted IS NOT DISTINCT FROM gold THEN 1.0 ELSE 0.0 END), 6) AS accuracy, "
    "CAST(count(*) FILTER (predicted IS NULL) AS BIGINT) AS parse_failures, round(avg(CASE WHEN predicted IS NULL THEN 1.0 ELSE 0.0 END), 6) AS parse_failure_rate FROM p"
)
def mmlu_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """The fourth option's text stands in for a model's output."""
    done = evaluation.accuracy_summary(table(spark, d, "mmlu"), X.parse_choice(F.col("d")), evaluation.mmlu_gold(F.col("answer")))
    return done.select("n", r6("accuracy").alias("accuracy"), "parse_failures", r6("parse_failure_rate").alias("parse_failure_rate"))


# a text with two fields: the halves around them, so that a field's name inside a field stays as it is
def filled(template: str, first: str, second: str, a: str, b: str) -> str:
    head, rest = template.split("{" + first + "}")
    middle, tail = rest.split("{" + second + "}")
    return f"{q(head)} || {a} || {q(middle)} || {b} || {q(tail)}"


@query(f"SELECT example_id, md5({filled(C.ALPACA, 'instruction', 'response', 'instruction', 'chosen')}) AS digest FROM preference_examples")
def alpaca_texts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "preference_examples")
    return rows.select("example_id", F.md5(evaluation.alpaca(F.col("instruction"), F.col("chosen"))).alias("digest"))


@query(f"SELECT example_id, md5({filled(C.ALPACA_INDENTED, 'instruction', 'response', 'instruction', 'rejected')}) AS digest FROM preference_examples")
def alpaca_indented(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "preference_examples")
    return rows.select("example_id", F.md5(evaluation.alpaca(F.col("instruction"), F.col("rejected"), True)).alias("digest"))


@query(f"SELECT item_id, replace({q(C.THINK_PROMPT)}, '{{question}}', problem) AS strict, replace({q(C.ANSWER_PROMPT)}, '{{question}}', problem) AS answer_focused FROM math_problems")
def mode_prompts(spark: SparkSession, d: str) -> DataFrame:
    """The prompts of both reward modes."""
    rows = table(spark, d, "math_problems")
    return rows.select("item_id", *[X.fill(evaluation.by_mode(m)[1], question=F.col("problem")).alias(m) for m in ("strict", "answer_focused")])


# turns: marks stand for the look-ahead; an empty turn takes the next one's name as its content
STRIP_SQL = lambda c: f"regexp_replace(regexp_replace({c}, {q('^' + C.SPACE + '+')}, ''), {q(C.SPACE + '+$')}, '')"
TURN_SQL = "(?s)(Human|Assistant):\\s*(.*)"
TURNS_SQL = lambda c: (
    f"list_filter(string_split(regexp_replace(regexp_replace({c}, '(Human|Assistant):\\s*\\n\\n(Human|Assistant):', '\\1:\\2:', 'g'), '\\n\\n(Human|Assistant):', {q(SEP + chr(92) + '1:')}, 'g'), {q(SEP)}), "
    f"lambda x: regexp_matches(x, {q(TURN_SQL)}))"
)
ROLE_SQL, SAID_SQL = (lambda x: f"regexp_extract({x}, {q(TURN_SQL)}, 1)"), (lambda x: STRIP_SQL(f"regexp_extract({x}, {q(TURN_SQL)}, 2)"))
WELL_SQL = lambda t: f"len({t}) = 2 AND {ROLE_SQL(t + '[1]')} = 'Human' AND {ROLE_SQL(t + '[2]')} = 'Assistant' AND {SAID_SQL(t + '[1]')} <> '' AND {SAID_SQL(t + '[2]')} <> ''"
PREFERENCES_SQL = (
    f"WITH t AS (SELECT raw_id, {TURNS_SQL('chosen')} AS c, {TURNS_SQL('rejected')} AS r FROM raw_preferences), "
    f"s AS (SELECT raw_id, c, r, CASE WHEN NOT coalesce({WELL_SQL('c')}, false) OR NOT coalesce({WELL_SQL('r')}, false) THEN 'unparsed' "
    f"WHEN {SAID_SQL('c[1]')} <> {SAID_SQL('r[1]')} THEN 'prompts_differ' ELSE 'kept' END AS status FROM t) "
)


@query(f"WITH t AS (SELECT raw_id, {TURNS_SQL('chosen')} AS t FROM raw_preferences) SELECT raw_id, CASE WHEN t IS NOT NULL THEN list_transform(t, lambda x: {ROLE_SQL('x')}) END AS roles, list_transform(t, lambda x: {SAID_SQL('x')}) AS contents FROM t")
def conversation_turns(spark: SparkSession, d: str) -> DataFrame:
    turns = X.parse_turns(F.col("chosen"))
    return table(spark, d, "raw_preferences").select("raw_id", turns["role"].alias("roles"), turns["content"].alias("contents"))


@query(PREFERENCES_SQL + f"SELECT raw_id, status, CASE WHEN status = 'kept' THEN {SAID_SQL('c[1]')} END AS instruction, CASE WHEN status = 'kept' THEN {SAID_SQL('c[2]')} END AS chosen, CASE WHEN status = 'kept' THEN {SAID_SQL('r[2]')} END AS rejected FROM s")
def preference_pairs(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.parse_preferences(table(spark, d, "raw_preferences")).select("raw_id", "status", "instruction", "chosen", "rejected")


@query(PREFERENCES_SQL + "SELECT status, CAST(count(*) AS BIGINT) AS n FROM s GROUP BY status")
def preference_load_counts(spark: SparkSession, d: str) -> DataFrame:
    return preference_pairs(spark, d).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def rollouts(spark: SparkSession, d: str) -> DataFrame:
    return reward.latest(table(spark, d, "rollouts"), "rollout_id", "logged_at")


@query()
def answer_candidates(spark: SparkSession, d: str) -> DataFrame:
    rows = rollouts(spark, d)
    return rows.select("rollout_id", X.answer_candidates(F.col("response")).alias("candidates"))


@query()
def relaxed_rewards(spark: SparkSession, d: str) -> DataFrame:
    problems = table(spark, d, "math_problems")
    problems = problems.select("item_id", evaluation.ground_truths(problems, "answer").alias("truths"))
    rows = rollouts(spark, d).select("rollout_id", "item_id", "response").join(problems, "item_id", "left")
    return rows.select("rollout_id", evaluation.relaxed_reward(F.col("response"), F.col("truths")).alias("r")).select("rollout_id", "r.*")


# ------------------------------------------------------------------ rewards and losses
ONCE_SQL = "WITH o AS (SELECT DISTINCT rollout_id, step, group_no, reward, item_id FROM rollouts), g AS (SELECT step, group_no, avg(reward) AS m, stddev_samp(reward) AS s, count(*) AS k FROM o GROUP BY ALL)"


def once(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "rollouts").select("rollout_id", "step", "group_no", "reward", "item_id").distinct()


@query(
    ONCE_SQL + " SELECT o.rollout_id, o.reward, round((o.reward - m) / (coalesce(s, 0) + 1e-6), 4) AS advantage FROM o JOIN g ON o.step IS NOT DISTINCT FROM g.step AND o.group_no IS NOT DISTINCT FROM g.group_no"
)
def group_advantage(spark: SparkSession, d: str) -> DataFrame:
    rows = reward.group_advantages(once(spark, d), ["step", "group_no"], "reward")
    return rows.select("rollout_id", "reward", F.round("advantage", 4).alias("advantage"))


@query("SELECT step, CAST(count(reward) AS BIGINT) AS n, round(avg(reward), 6) AS mean, round(stddev_pop(reward), 6) AS std FROM (SELECT DISTINCT rollout_id, step, group_no, reward, item_id FROM rollouts) GROUP BY step")
def reward_stats(spark: SparkSession, d: str) -> DataFrame:
    return reward.reward_stats(once(spark, d), ["step"], "reward").select("step", "n", r6("mean").alias("mean"), r6("std").alias("std"))


@query(ONCE_SQL + ", b AS (SELECT *, row_number() OVER (PARTITION BY step, group_no ORDER BY reward DESC, rollout_id) AS k FROM o WHERE reward IS NOT NULL) SELECT step, group_no, rollout_id, reward FROM b WHERE k = 1")
def best_in_group(spark: SparkSession, d: str) -> DataFrame:
    return reward.best_in_group(once(spark, d), ["step", "group_no"], "rollout_id", "reward")


PAIRS_SQL = "zip AS (SELECT rollout_id, step, unnest(logprobs) AS lp, unnest(response_mask) AS m FROM (SELECT DISTINCT rollout_id, step, logprobs, response_mask FROM rollouts WHERE logprobs IS NOT NULL AND response_mask IS NOT NULL))"


def tokens(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "rollouts").select("rollout_id", "step", "logprobs", "response_mask")
    return rows.where("logprobs is not null and response_mask is not null").distinct()


@query(f"WITH {PAIRS_SQL} SELECT rollout_id, round(sum(coalesce(CAST(lp AS DOUBLE) * m, 0)) / nullif(sum(m), 0), 6) AS mean_logprob, round(sum(coalesce(CAST(lp AS DOUBLE) * m, 0)) / 128, 6) AS normalised FROM zip GROUP BY rollout_id, step")
def masked_means(spark: SparkSession, d: str) -> DataFrame:
    lp, m = F.col("logprobs"), F.col("response_mask")
    rows = tokens(spark, d).where("size(logprobs) > 0")
    return rows.select("rollout_id", r6(A.masked_mean(lp, m)).alias("mean_logprob"), r6(A.masked_normalise(lp, m, 128.0)).alias("normalised"))


@query(f"WITH {PAIRS_SQL} SELECT step, round(-sum(coalesce(CAST(lp AS DOUBLE) * m, 0)) / nullif(sum(m), 0) / 4, 6) AS loss FROM zip GROUP BY step")
def sft_loss(spark: SparkSession, d: str) -> DataFrame:
    rows = tokens(spark, d).withColumn("loss", F.transform("logprobs", lambda v: -v))
    return reward.batch_loss(rows, ["step"], "loss", "response_mask", 4).select("step", r6("loss").alias("loss"))


@query(
    f"WITH {PAIRS_SQL}, a AS (SELECT rollout_id, avg(reward) - 0.5 AS adv FROM rollouts GROUP BY rollout_id), "
    "t AS (SELECT step, m, adv, exp(CAST(lp AS DOUBLE) - CAST(CAST(lp AS DOUBLE) * 1.1 AS DOUBLE)) AS r FROM zip JOIN a USING (rollout_id) WHERE adv IS NOT NULL) "
    "SELECT step, round(sum(CASE WHEN r IS NULL THEN 0 ELSE -least(r * adv, least(greatest(r, 0.8), 1.2) * adv) * coalesce(m, 0) END) / nullif(sum(m), 0), 6) AS loss FROM t GROUP BY step"
)
def clip_loss(spark: SparkSession, d: str) -> DataFrame:
    """Old log-probabilities are the new ones times 1.1; a rollout's advantage is its mean reward less 0.5. A
    token without a log-probability has no loss, but counts."""
    adv = table(spark, d, "rollouts").groupBy("rollout_id").agg((F.avg("reward") - 0.5).alias("adv")).where("adv is not null")
    rows = tokens(spark, d).join(adv, "rollout_id").withColumn("lp", F.transform("logprobs", lambda v: v.cast("double")))
    rows = rows.withColumn("loss", A.clipped_loss(F.col("lp"), F.transform("lp", lambda v: v * 1.1), F.col("adv")))
    return reward.batch_loss(rows, ["step"], "loss", "response_mask").select("step", r6("loss").alias("loss"))


DPO_SQL = "CASE WHEN x >= 0 THEN ln(1 + exp(-x)) ELSE -x + ln(1 + exp(x)) END"


@query(
    f"WITH l AS (SELECT source, 0.1 * ((coalesce(length(chosen), 0) - coalesce(length(rejected), 0)) / 10.0) AS x, coalesce(length(chosen), 0) > coalesce(length(rejected), 0) AS won FROM preference_examples) "
    f"SELECT source, round(avg({DPO_SQL}), 6) AS loss, round(avg(CASE WHEN won THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM l GROUP BY source"
)
def dpo_eval(spark: SparkSession, d: str) -> DataFrame:
    """Lengths over ten stand in for sequence log-probabilities; the reference model gives 0 to both."""
    n = lambda c: F.coalesce(F.length(c), F.lit(0)) / 10.0
    zero = F.lit(0.0)
    loss = A.dpo_loss(n("chosen"), n("rejected"), zero, zero, 0.1)
    won = (n("chosen") > n("rejected")).cast("double")
    rows = table(spark, d, "preference_examples").groupBy("source")
    return rows.agg(r6(F.avg(loss)).alias("loss"), r6(F.avg(won)).alias("accuracy"))


EMB_SQL = "e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings), s AS (SELECT vec_id, max(v) AS top FROM e GROUP BY vec_id), z AS (SELECT e.vec_id, e.i, e.v, top, sum(exp(v - top)) OVER (PARTITION BY e.vec_id) AS total FROM e JOIN s USING (vec_id))"


def emb() -> Column:
    return F.col("embedding")


@query(
    f"WITH {EMB_SQL} SELECT vec_id, round(max(exp(v - top) / total), 9) AS top_share, round(sum(exp(v - top) / total * exp(v - top) / total), 9) AS squares, "
    "round(-sum(exp(v - top) / total * (v - top - ln(total))), 6) AS entropy, round(max(CASE WHEN i = 1 THEN top + ln(total) - v END), 6) AS first_loss FROM z GROUP BY vec_id"
)
def softmax_entropy(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings stand in for logits."""
    p = A.softmax(emb())
    rows = table(spark, d, "embeddings").select("vec_id", "embedding", p.alias("p"))
    return rows.select(
        "vec_id",
        r9(F.array_max("p")).alias("top_share"),
        r9(A.dot(F.col("p"), F.col("p"))).alias("squares"),
        r6(A.entropy(emb())).alias("entropy"),
        r6(A.cross_entropy(emb(), F.lit(0))).alias("first_loss"),
    )


@query(
    f"WITH {EMB_SQL}, o AS (SELECT vec_id, i, exp(v - top) / total AS p, coalesce(sum(exp(v - top) / total) OVER (PARTITION BY vec_id ORDER BY v DESC, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM z) "
    "SELECT vec_id, CAST(count(*) AS BIGINT) AS kept, round(max(p) / sum(p), 6) AS top_share FROM o WHERE before < 0.5 GROUP BY vec_id"
)
def top_p(spark: SparkSession, d: str) -> DataFrame:
    p = A.top_p(A.softmax(emb()), 0.5)
    rows = table(spark, d, "embeddings").select("vec_id", p.alias("p"))
    return rows.select("vec_id", F.size(F.filter("p", lambda v: v > 0)).cast("bigint").alias("kept"), r6(F.array_max("p")).alias("top_share"))


@query(
    "WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v FROM embeddings), n AS (SELECT vec_id, sum(v * v) AS ss, max(v) AS top, count(*) AS k FROM e GROUP BY vec_id) "
    "SELECT vec_id, round(sqrt(ss), 6) AS norm, round(top / sqrt(ss / k + 1e-5), 6) AS rms_top, round(top * CASE WHEN sqrt(ss) > 0.5 THEN 0.5 / (sqrt(ss) + 1e-6) ELSE 1 END, 6) AS clipped_top FROM n"
)
def vector_norms(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings")
    return rows.select(
        "vec_id", r6(A.norm(emb())).alias("norm"), r6(F.array_max(A.rms_norm(emb()))).alias("rms_top"), r6(F.array_max(A.clip_norm(emb(), 0.5))).alias("clipped_top")
    )


# ------------------------------------------------------------------ order, splits, packing
ORDER_SQL = lambda key: f"md5('42|' || CAST({key} AS VARCHAR))"


@query(
    f"SELECT example_id, CASE WHEN row_number() OVER (ORDER BY {ORDER_SQL('example_id')}) <= (SELECT CAST(floor(count(*) * 0.1) AS BIGINT) FROM preference_examples) THEN 'val' ELSE 'train' END AS split FROM preference_examples"
)
def train_val_split(spark: SparkSession, d: str) -> DataFrame:
    return batching.split_by_ratio(table(spark, d, "preference_examples").select("example_id"), "example_id", 0.1)


@query(f"SELECT example_id, CASE WHEN row_number() OVER (ORDER BY {ORDER_SQL('example_id')}) <= 50 THEN 'val' ELSE 'train' END AS split FROM preference_examples")
def split_by_count(spark: SparkSession, d: str) -> DataFrame:
    return batching.split_by_count(table(spark, d, "preference_examples").select("example_id"), "example_id", 50)


@query(f"SELECT example_id FROM preference_examples ORDER BY {ORDER_SQL('example_id')} LIMIT 100")
def capped_examples(spark: SparkSession, d: str) -> DataFrame:
    return batching.cap(table(spark, d, "preference_examples").select("example_id"), "example_id", 100)


@query(
    f"WITH n AS (SELECT count(*) AS n FROM math_problems), p AS (SELECT item_id, row_number() OVER (ORDER BY {ORDER_SQL('item_id')}) - 1 AS position FROM math_problems), "
    "r AS (SELECT item_id, CAST(position + k * n AS BIGINT) AS draw FROM p, n, (VALUES (0), (1), (2)) v(k)) SELECT item_id, draw FROM r WHERE draw < 1000"
)
def sampled_prompts(spark: SparkSession, d: str) -> DataFrame:
    return batching.sample_prompts(table(spark, d, "math_problems").select("item_id"), "item_id", 1000)


@query(
    f"WITH p AS (SELECT doc_id, row_number() OVER (ORDER BY {ORDER_SQL('doc_id')}) - 1 AS position FROM documents) SELECT CAST(position // 32 AS BIGINT) AS batch, array_agg(doc_id ORDER BY position) AS keys FROM p GROUP BY 1"
)
def minibatches(spark: SparkSession, d: str) -> DataFrame:
    return batching.minibatches(table(spark, d, "documents"), "doc_id", 32)


def letters(spark: SparkSession, d: str) -> DataFrame:
    """Character codes of questions stand in for token ids."""
    codes = F.transform(F.regexp_extract_all("question", F.lit("(?s)."), F.lit(0)), lambda c: F.ascii(c))
    return table(spark, d, "gsm8k").select("item_id", codes.alias("ids"))


@query(
    "WITH t AS (SELECT item_id, list_concat([1], list_concat(list_transform(list_filter(string_split(question, ''), lambda c: c <> ''), lambda c: ascii(c)), [2])) AS ids FROM gsm8k), "
    "u AS (SELECT item_id, unnest(ids) AS token, generate_subscripts(ids, 1) AS i FROM t), p AS (SELECT token, row_number() OVER (ORDER BY item_id, i) - 1 AS spot FROM u), "
    "c AS (SELECT spot // 128 AS chunk, spot, token FROM p UNION ALL SELECT spot // 128 - 1, spot, token FROM p WHERE spot % 128 = 0 AND spot > 0) "
    "SELECT CAST(chunk AS BIGINT) AS chunk, (array_agg(token ORDER BY spot))[1:128] AS input_ids, (array_agg(token ORDER BY spot))[2:129] AS labels FROM c GROUP BY chunk HAVING count(*) = 129"
)
def pack_sequences(spark: SparkSession, d: str) -> DataFrame:
    return batching.pack(letters(spark, d), "item_id", "ids", 128, 1, 2)


CODES_SQL = lambda c: f"list_transform(regexp_extract_all(coalesce({c}, ''), '(?s).'), lambda x: ascii(x))"


@query(
    f"WITH t AS (SELECT item_id, item_id // 16 AS b, {CODES_SQL('problem')} AS p, {CODES_SQL('answer')} AS r FROM math_problems), m AS (SELECT b, max(len(p) + len(r)) AS n FROM t GROUP BY b), "
    "f AS (SELECT item_id, n, list_concat(list_concat(p, r), list_transform(range(n - len(p) - len(r)), lambda i: 0)) AS v, "
    "list_concat(list_concat(list_transform(p, lambda x: false), list_transform(r, lambda x: true)), list_transform(range(n - len(p) - len(r)), lambda i: false)) AS k FROM t JOIN m USING (b)) "
    "SELECT item_id, v[1:n - 1] AS input_ids, v[2:n] AS labels, k[2:n] AS response_mask FROM f"
)
def prompt_response_mask(spark: SparkSession, d: str) -> DataFrame:
    codes = lambda c: F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit("(?s)."), F.lit(0)), lambda x: F.ascii(x))
    rows = table(spark, d, "math_problems")
    rows = rows.select("item_id", codes(F.col("problem")).alias("p"), codes(F.col("answer")).alias("r"), F.expr("item_id div 16").alias("b"))
    return batching.pad_pairs(rows, "item_id", "p", "r", 0, "b")


@query("SELECT CAST(r AS BIGINT) AS step, round(CASE WHEN r < 10 THEN 0.001 * r / 10 WHEN r > 90 THEN 0.0001 ELSE 0.0001 + 0.0009 * (1 + cos(3.141592653589793 * (r - 10) / 80)) / 2 END, 9) AS rate FROM range(120) t(r)")
def cosine_schedule(spark: SparkSession, d: str) -> DataFrame:
    return spark.range(120).select(F.col("id").alias("step"), r9(X.cosine_rate(F.col("id"), 1e-3, 1e-4, 10, 90)).alias("rate"))


# ------------------------------------------------------------------ scaling law
BEST_SQL = "WITH b AS (SELECT compute_budget, min_by(parameters, (final_loss, parameters)) AS parameters, min(final_loss) AS final_loss FROM isoflop_runs WHERE parameters IS NOT NULL AND compute_budget IS NOT NULL AND final_loss IS NOT NULL GROUP BY compute_budget)"
FIT_SQL = BEST_SQL + ", f AS (SELECT regr_slope(log10(parameters), log10(compute_budget)) AS a, regr_intercept(log10(parameters), log10(compute_budget)) AS b FROM b)"


@query(BEST_SQL.replace("min_by(parameters, (final_loss, parameters))", "(array_agg(parameters ORDER BY final_loss, parameters))[1]") + " SELECT compute_budget, parameters, final_loss FROM b")
def isoflop_best(spark: SparkSession, d: str) -> DataFrame:
    return scaling.best_by_budget(table(spark, d, "isoflop_runs"))


@query(FIT_SQL.replace("min_by(parameters, (final_loss, parameters))", "(array_agg(parameters ORDER BY final_loss, parameters))[1]") + " SELECT round(a, 6) AS a, round(b, 5) AS log10_alpha, round((b + a * 23), 5) AS log10_parameters FROM f")
def isoflop_fit(spark: SparkSession, d: str) -> DataFrame:
    fit = scaling.power_law(scaling.best_by_budget(table(spark, d, "isoflop_runs")))
    return fit.select(r6("a").alias("a"), F.round("log10_alpha", 5).alias("log10_alpha"), F.round(F.col("log10_alpha") + F.col("a") * 23, 5).alias("log10_parameters"))


# ------------------------------------------------------------------ classifiers
@query()
def language_id(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, predicted, score) of a character model fitted on at most 2,000 labelled documents."""
    rows = table(spark, d, "documents")
    sample = rows.where("lang is not null and text is not null").orderBy(F.xxhash64("doc_id")).limit(2000)
    return classify.classify(classify.fit_classifier(sample, "text", "lang", "char"), rows, "text", ["doc_id"])


def held_out(spark: SparkSession, d: str, label: Column) -> DataFrame:
    """(label, precision, recall, n) on a held-out tenth of the labelled samples."""
    rows = table(spark, d, "moderation_labels").where("text is not null and category is not null")
    rows = batching.split_by_ratio(rows.select("label_id", "text", label.alias("label")), "label_id", 0.1)
    model = classify.fit_classifier(rows.where("split = 'train'"), "text", "label", least=2)
    scored = classify.classify(model, rows.where("split = 'val'"), "text", ["label"])
    return classify.precision_recall(scored, "label").select("label", r6("precision").alias("precision"), r6("recall").alias("recall"), "n")


@query()
def moderation_classifier(spark: SparkSession, d: str) -> DataFrame:
    """All categories."""
    return held_out(spark, d, F.col("category"))


@query()
def nsfw_classifier(spark: SparkSession, d: str) -> DataFrame:
    """Sexual content against all else."""
    return held_out(spark, d, F.when(F.col("category") == "sexual", "nsfw").otherwise("sfw"))


@query()
def toxic_classifier(spark: SparkSession, d: str) -> DataFrame:
    """Abuse and hate against all else."""
    return held_out(spark, d, F.when(F.col("category").isin("abuse", "hate"), "toxic").otherwise("non-toxic"))


@query()
def html_texts(spark: SparkSession, d: str) -> DataFrame:
    """Visible text of all documents, read as pages."""
    from corpusmill.functions.html import html_text

    return table(spark, d, "documents").select("doc_id", html_text(text()).alias("text"))
