"""Named queries over the driver's tables and the SQL that each must agree with.

Documents are samples with their first 80 characters as instruction; a user turn and the assistant's next one are a
sample too. Doubles are rounded to six digits on both sides.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.backends.embeddings import find_similar
from tidemark.frame import Samples, category_share, describe, length_histogram
from tidemark.functions import scores
from tidemark.functions.text import SPACES
from tidemark.operators.dedup import ExactDedup, TfidfDedup, block_pairs, greedy_near, tfidf_vectors
from tidemark.operators.diversity import category_diversity, diversity_score, kmeans, maxmin
from tidemark.operators.enrich import LLMSynthesis, ReasoningChainEnhancer
from tidemark.operators.filters import KnowledgeFilter, LengthFilter, NoiseDetector, PrefixAdder, QualityFilter, knowledge_scores, quality_metrics
from tidemark.plans import evaluation
from tidemark.plans.stages import chain
from tidemark.plans.storage import ship
from tidemark.schema import META, set_meta
from tidemark.sources.files import convert_qa, sft_rows

_queries: dict = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        @wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(spark, sf_dir)

        _queries[f.__name__] = run
        if sql is not None:
            _sql[f.__name__] = sql
        return f

    return add


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


# -- inputs --


def _samples(df: DataFrame) -> DataFrame:
    empty = F.struct(*[F.lit(None).cast(f.dataType).alias(f.name) for f in META.fields])
    return df.select("id", "instruction", F.lit("").alias("input"), "output", "category", empty.alias("meta"), F.lit(None).cast("string").alias("metadata_json"), "_ord")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return _samples(d.select(F.col("doc_id").cast("string").alias("id"), F.substring("text", 1, 80).alias("instruction"), F.col("text").alias("output"), F.col("source").alias("category"), F.col("doc_id").alias("_ord")))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user turn and the assistant's turn after it; one shuffle by conversation."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = c.select("conv_id", "turn", "role", "text", F.lead("role").over(w).alias("r2"), F.lead("turn").over(w).alias("t2"), F.lead("text").over(w).alias("x2"))
    c = c.where((F.col("role") == "user") & (F.col("r2") == "assistant") & (F.col("t2") == F.col("turn") + 1))
    key = F.col("conv_id") * 100 + F.col("turn")
    kind = F.when(F.col("conv_id") % 2 == 0, "reasoning").otherwise("daily")
    return _samples(c.select(key.cast("string").alias("id"), F.col("text").alias("instruction"), F.col("x2").alias("output"), kind.alias("category"), key.alias("_ord")))


def vectors(spark: SparkSession, sf_dir: str, most: int | None = None) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    e = e.where(F.col("vec_id") < most) if most else e
    return e.select(F.col("vec_id").alias("_ord"), F.col("embedding").alias("vec"))


DOCS = "s AS (SELECT CAST(doc_id AS VARCHAR) AS id, substr(text, 1, 80) AS instruction, text AS output, source AS category, doc_id AS ord FROM documents)"
PAIRS = (
    "s AS (SELECT CAST(a.conv_id * 100 + a.turn AS VARCHAR) AS id, a.text AS instruction, b.text AS output,"
    " CASE WHEN a.conv_id % 2 = 0 THEN 'reasoning' ELSE 'daily' END AS category, a.conv_id * 100 + a.turn AS ord"
    " FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user' AND b.role = 'assistant')"
)


def _words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '{SPACES}+'), lambda w: w <> '')"


def _any(x: str, needles: tuple[str, ...], how: str = "contains") -> str:
    quoted = [n.replace("'", "''") for n in needles]
    return "(" + " OR ".join(f"{how}({x}, '{n}')" for n in quoted) + ")"


def _part(x: str, least: int, most: int) -> str:
    return f"CASE WHEN length({x}) < {least} THEN 0.3::DOUBLE WHEN length({x}) > {most} THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END"


_LOW_WORDS = _words("lower(output)")
QUALITY = (
    f"(({_part('instruction', 10, 2000)}) + ({_part('output', 20, 8000)})"
    f" + (CASE WHEN len({_LOW_WORDS}) > 10 THEN least(1.0::DOUBLE, 1.5::DOUBLE * len(list_distinct({_LOW_WORDS})) / len({_LOW_WORDS})) ELSE 0.8::DOUBLE END)"
    f" + (CASE WHEN {_any('lower(output)', scores.REFUSALS)} THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END)"
    f" + (CASE WHEN contains(instruction, '?') OR {_any('lower(instruction)', scores.QUESTIONS, 'starts_with')} THEN 1.0::DOUBLE ELSE 0.7::DOUBLE END)) / 5::DOUBLE"
)
SCORED = f"q AS (SELECT *, {QUALITY} AS score FROM s)"


# -- quality --


@query(f"WITH {DOCS}, {SCORED} SELECT id, round(score, 6) AS quality_score FROM q")
def quality_score(spark, d):
    return documents(spark, d).select("id", r6(QualityFilter().score()).alias("quality_score"))


@query(f"WITH {PAIRS}, {SCORED} SELECT id, instruction, output, round(score, 6) AS quality_score FROM q WHERE round(score, 9) >= 0.8::DOUBLE")
def quality_filter(spark, d):
    return QualityFilter(0.8).apply(pairs(spark, d)).select("id", "instruction", "output", r6("meta.quality_score").alias("quality_score"))


@query(
    f"WITH {DOCS}, {SCORED}, k AS (SELECT score, round(score, 9) >= 0.8::DOUBLE AS ok FROM q) SELECT count(*) AS input_count, count(*) FILTER (WHERE ok) AS output_count,"
    " count(*) FILTER (WHERE NOT ok) AS filtered_count, round(count(*) FILTER (WHERE NOT ok) / count(*)::DOUBLE, 6) AS filter_rate, 0.8::DOUBLE AS threshold,"
    " round(avg(score), 6) AS avg_score, round(min(score), 6) AS min_score, round(max(score), 6) AS max_score FROM k"
)
def quality_filter_metrics(spark, d):
    m = quality_metrics(documents(spark, d), QualityFilter(0.8))
    return m.select("input_count", "output_count", "filtered_count", r6("filter_rate").alias("filter_rate"), "threshold", r6("avg_score").alias("avg_score"), r6("min_score").alias("min_score"), r6("max_score").alias("max_score"))


# -- exact dedup --


def _norm(x: str) -> str:
    return f"md5(array_to_string({_words(f'lower({x})')}, ' '))"


_FIELD = {"instruction": "instruction", "output": "output", "both": "instruction || '|||' || output", "all": "instruction || '|||' || '' || '|||' || output"}


def _dedup(field: str):
    sql = f"WITH {DOCS}, k AS (SELECT id, ord, {_norm(_FIELD[field])} AS key FROM s) SELECT id, key FROM k QUALIFY row_number() OVER (PARTITION BY key ORDER BY ord) = 1"

    def run(spark, d):
        op = ExactDedup(field)
        return op.apply(documents(spark, d)).select("id", op.key().alias("key"))

    run.__name__ = f"exact_dedup_{field}"
    query(sql)(run)


for _f in _FIELD:
    _dedup(_f)


@query(f"WITH {DOCS}, k AS (SELECT ord, {_norm('output')} AS key FROM s) SELECT key, count(*) AS n, min(ord) AS first, max(ord) AS last, array_to_string(list_sort(list(ord)), ',') AS positions FROM k GROUP BY key HAVING count(*) > 1")
def exact_dup_groups(spark, d):
    g = ExactDedup("output").find_duplicates(documents(spark, d))
    return g.select("key", F.size("positions").cast("long").alias("n"), F.array_min("positions").alias("first"), F.array_max("positions").alias("last"), F.array_join(F.col("positions").cast("array<string>"), ",").alias("positions"))


# -- knowledge --

_KW = (
    f"w AS (SELECT ord, unnest({_words(chr(108) + 'ower(instruction || chr(32) || output)')}) AS w FROM s), c AS (SELECT ord, w, count(*) AS c FROM w GROUP BY ord, w),"
    " t AS (SELECT ord, sum(c) AS total, count(*) AS kinds FROM c GROUP BY ord),"
    " h AS (SELECT c.ord, any_value(total)::DOUBLE AS total, any_value(kinds)::DOUBLE AS kinds, -sum(c / total::DOUBLE * log2(c / total::DOUBLE + 1e-10)) AS h FROM c JOIN t ON c.ord = t.ord GROUP BY c.ord),"
    " k AS (SELECT s.*, CASE WHEN h.total > 0 THEN (least(1.0::DOUBLE, h.h / 8) + least(1.0::DOUBLE, length(output) / 1000.0::DOUBLE) + kinds / h.total) / 3"
    " ELSE least(1.0::DOUBLE, length(output) / 1000.0::DOUBLE) END AS score FROM s LEFT JOIN h ON s.ord = h.ord)"
)


@query(f"WITH {DOCS}, {_KW} SELECT id, round(score, 6) AS knowledge_score FROM k")
def knowledge_score(spark, d):
    return knowledge_scores(documents(spark, d)).select("id", r6("knowledge_score").alias("knowledge_score"))


@query(f"WITH {PAIRS}, {_KW} SELECT id, round(score, 6) AS knowledge_score, row_number() OVER (ORDER BY round(score, 9) DESC, ord) - 1 AS rank FROM k QUALIFY rank < 100")
def knowledge_topk(spark, d):
    return KnowledgeFilter(top_k=100).apply(pairs(spark, d)).select("id", r6("meta.knowledge_score").alias("knowledge_score"), F.col("_ord").alias("rank"))


@query(f"WITH {PAIRS}, {_KW} SELECT id, round(score, 6) AS knowledge_score FROM k WHERE round(score, 9) >= 0.7::DOUBLE")
def knowledge_min_score(spark, d):
    return KnowledgeFilter(min_score=0.7).apply(pairs(spark, d)).select("id", r6("meta.knowledge_score").alias("knowledge_score"))


_DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda p: p[1]::DOUBLE * p[2]::DOUBLE))"


@query(f"WITH e AS (SELECT vec_id AS ord, embedding AS v FROM embeddings) SELECT a.ord AS vec_id, round(max({_DOT.format(a='a.v', b='b.v')}), 6) AS ref_sim FROM e a, e b WHERE b.ord < 20 GROUP BY a.ord")
def knowledge_reference_sim(spark, d):
    v = vectors(spark, d).withColumns({"instruction": F.lit(""), "output": F.lit("")})
    return knowledge_scores(v, vectors(spark, d, 20)).select(F.col("_ord").alias("vec_id"), r6("ref_sim").alias("ref_sim"))


_HAN = "regexp_extract_all(output, '[\\x{4e00}-\\x{9fff}]')"
_CJK = ("什么是光合作用？", "如何写一首诗", "为什么天空是蓝的", "你好", "今天 天气 怎么样", "介绍 首都 的 历史", "计算 步骤 和 方法", "讲个 故事")
_CJK_SQL = "[" + ", ".join(f"'{x}'" for x in _CJK) + "]"
CJK = f"z AS (SELECT CAST(doc_id AS VARCHAR) AS id, {_CJK_SQL}[CAST(doc_id % {len(_CJK)} AS INTEGER) + 1] || substr(text, 1, CAST(doc_id % 50 AS INTEGER)) AS instruction, {_CJK_SQL}[CAST(doc_id // 8 % {len(_CJK)} AS INTEGER) + 1] || substr(text, 1, CAST(doc_id % 300 AS INTEGER)) AS output FROM documents)"


def _cjk(spark, d):
    t = spark.read.parquet(f"{d}/documents.parquet")
    pick = lambda k: F.element_at(F.array(*[F.lit(x) for x in _CJK]), (k % len(_CJK) + 1).cast("int"))
    i, n = F.col("doc_id"), lambda m: (F.col("doc_id") % m).cast("int")
    return t.select(
        i.cast("string").alias("id"), F.concat(pick(i), F.col("text").substr(F.lit(1), n(50))).alias("instruction"),
        F.concat(pick(F.floor(i / 8)), F.col("text").substr(F.lit(1), n(300))).alias("output"), i.alias("_ord"),
    )


@query(
    f"WITH {CJK} SELECT id, round((least(1.0::DOUBLE, length(output) / 200.0::DOUBLE) + len(list_distinct({_HAN}))::DOUBLE / greatest(len({_HAN}), 1)"
    f" + least(1.0::DOUBLE, 0.5::DOUBLE + CASE WHEN regexp_matches(output, '\\p{{Nd}}') THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN {_any('output', scores.MARKS)} THEN 0.1::DOUBLE ELSE 0 END"
    f" + CASE WHEN {_any('instruction', scores.ASKS)} THEN 0.2::DOUBLE ELSE 0 END)) / 3, 6) AS score FROM z"
)
def offline_knowledge_score(spark, d):
    return _cjk(spark, d).select("id", r6(scores.offline_knowledge_score(F.col("instruction"), F.col("output"))).alias("score"))


# -- noise --


def _count_of(x: str, n: str) -> str:
    return f"(length({x}) - length(replace({x}, '{n}', ''))) // {len(n)}"


def _strip(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{SPACES}+', ''), '{SPACES}+$', '')"


_W = _words("output")
_RULES = [
    (f"length({_strip('instruction')}) < 5", "error", 0.9, "instruction_too_short"),
    (f"length({_strip('output')}) < 10", "error", 0.8, "output_too_short"),
    (f"len({_W}) > 20 AND len(list_distinct({_W})) / len({_W})::DOUBLE < 0.3::DOUBLE", "error", 0.85, "highly_repetitive"),
    (f"contains(instruction, '?') AND length(output) < 50 AND NOT {_any('lower(output)', scores.ANSWERS)}", "ambiguity", 0.6, "possible_incomplete_answer"),
    (_any("lower(output)", scores.DODGES), "ambiguity", 0.5, "contains_refusal"),
    (" + ".join(_count_of("output", a) for a in scores.ARTIFACTS) + " > 10", "error", 0.6, "excessive_artifacts"),
]
# documents with a short head and a shortened text, so that the rules have something to find
NOISY = "s AS (SELECT CAST(doc_id AS VARCHAR) AS id, doc_id AS ord, CASE WHEN doc_id % 5 = 0 THEN substr(text, 1, 3) WHEN doc_id % 5 = 1 THEN substr(text, 1, 20) || '?' ELSE substr(text, 1, 80) END AS instruction, CASE WHEN doc_id % 7 = 0 THEN substr(text, 1, 8) WHEN doc_id % 7 = 1 THEN 'Sorry, but I cannot help. ' || text WHEN doc_id % 7 = 2 THEN substr(text, 1, 30) WHEN doc_id % 7 = 3 THEN repeat('...', 12) || text ELSE text END AS output FROM documents)"
ISSUES = NOISY + ", i AS (" + " UNION ALL ".join(f"SELECT id, ord, {k} AS rule, '{kind}' AS noise_type, {sure}::DOUBLE AS confidence, '{why}' AS reason FROM s WHERE {test}" for k, (test, kind, sure, why) in enumerate(_RULES)) + ")"
PRIMARY = ISSUES + ", p AS (SELECT * FROM i QUALIFY row_number() OVER (PARTITION BY ord ORDER BY confidence DESC, rule) = 1), a AS (SELECT s.*, p.noise_type, p.confidence, p.reason, CASE WHEN p.confidence >= 0.5::DOUBLE AND p.noise_type = 'error' THEN 'remove' WHEN p.confidence >= 0.5::DOUBLE AND p.noise_type = 'ambiguity' THEN 'flag' ELSE 'keep' END AS action FROM s LEFT JOIN p ON s.ord = p.ord)"


def _noisy(spark, d):
    t, i = F.col("text"), F.col("doc_id")
    head = lambda n: F.substring("text", 1, n)
    instruction = F.when(i % 5 == 0, head(3)).when(i % 5 == 1, F.concat(head(20), F.lit("?"))).otherwise(head(80))
    output = F.when(i % 7 == 0, head(8)).when(i % 7 == 1, F.concat(F.lit("Sorry, but I cannot help. "), t)).when(i % 7 == 2, head(30)).when(i % 7 == 3, F.concat(F.lit("..." * 12), t)).otherwise(t)
    rows = spark.read.parquet(f"{d}/documents.parquet").select(i.cast("string").alias("id"), instruction.alias("instruction"), output.alias("output"), F.lit("other").alias("category"), i.alias("_ord"))
    return _samples(rows)


@query(f"WITH {ISSUES} SELECT id, noise_type, confidence, reason FROM i")
def noise_issues(spark, d):
    x = F.explode(scores.noise_issues(F.col("instruction"), F.col("output")))
    return _noisy(spark, d).select("id", x.alias("x")).select("id", "x.noise_type", "x.confidence", "x.reason")


@query(f"WITH {PRIMARY} SELECT id, coalesce(reason, 'no_issues') AS reason, action = 'flag' AS flagged FROM a WHERE action <> 'remove'")
def noise_actions(spark, d):
    out = NoiseDetector().apply(_noisy(spark, d))
    return out.select("id", F.col("meta.noise_detection.reason").alias("reason"), F.coalesce("meta.flagged", F.lit(False)).alias("flagged"))


@query(f"WITH {PRIMARY} SELECT count(*) AS input_count, count(*) FILTER (WHERE action <> 'remove') AS output_count, count(*) FILTER (WHERE action = 'remove') AS removed_count, count(*) FILTER (WHERE action = 'flag') AS flagged_count FROM a")
def noise_metrics(spark, d):
    a = F.col("_action")
    return NoiseDetector().judged(_noisy(spark, d)).agg(F.count("*").alias("input_count"), F.count_if(a != "remove").alias("output_count"), F.count_if(a == "remove").alias("removed_count"), F.count_if(a == "flag").alias("flagged_count"))


# -- predicates and classes --


@query(f"WITH {PAIRS} SELECT id, category = 'reasoning' AND NOT {_any('lower(output)', scores.CHAINED)} AS wanted FROM s")
def should_enhance(spark, d):
    return pairs(spark, d).select("id", ReasoningChainEnhancer("echo").wanted().alias("wanted"))


@query(f"WITH {DOCS}, {SCORED} SELECT id, score < 0.95::DOUBLE AS wanted FROM q")
def should_synthesize(spark, d):
    scored = set_meta(documents(spark, d), quality_score=QualityFilter().score())
    return scored.select("id", LLMSynthesis("echo", quality_threshold=0.95).wanted().alias("wanted"))


_NUM = r"\b[0-9]+\.?[0-9]*\b"


@query(
    f"WITH n AS (SELECT doc_id, list_distinct(regexp_extract_all(regexp_replace(text, '[^ -~]', 'x', 'g'), '{_NUM}')) AS a, list_distinct(regexp_extract_all(regexp_replace(substr(text, 1, CAST(length(text) // 2 AS INTEGER)), '[^ -~]', 'x', 'g'), '{_NUM}')) AS b FROM documents)"
    " SELECT doc_id, CAST(len(a) AS INTEGER) AS n, len(a) = 0 OR len(list_intersect(a, b)) / len(a)::DOUBLE >= 0.5::DOUBLE AS ok FROM n"
)
def numeric_overlap(spark, d):
    text = F.regexp_replace("text", "[^ -~]", "x")
    half = F.regexp_replace(F.col("text").substr(F.lit(1), F.floor(F.length("text") / 2).cast("int")), "[^ -~]", "x")
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.size(scores.numbers(text)).alias("n"), scores.keeps_numbers(text, half).alias("ok"))


_HITS = {k: " + ".join(f"CAST(contains(lower(instruction), '{w}') AS INTEGER)" for w in ws) for k, ws in scores.COUNTED.items()}
_TOP = "greatest(" + ", ".join(_HITS.values()) + ")"


@query(f"WITH {CJK} SELECT id, CASE WHEN {_TOP} = 0 THEN 'daily' " + " ".join(f"WHEN ({h}) = {_TOP} THEN '{k}'" for k, h in _HITS.items()) + " END AS category FROM z")
def classify_count(spark, d):
    return _cjk(spark, d).select("id", scores.category_by_count(F.col("instruction")).alias("category"))


@query(f"WITH {CJK} SELECT id, CASE " + " ".join(f"WHEN {_any('instruction', ws)} THEN '{k}'" for k, ws in scores.FIRST.items()) + " ELSE 'daily' END AS category FROM z")
def classify_first(spark, d):
    return _cjk(spark, d).select("id", scores.category_by_first(F.col("instruction")).alias("category"))


@query(f"WITH {CJK} SELECT 'baike_' || lpad(id, 6, '0') AS id, {_strip('instruction')} AS instruction, {_strip('output')} AS output FROM z WHERE length(id) <= 6")
def convert_questions(spark, d):
    qa = _cjk(spark, d).select(F.col("instruction").alias("question"), F.col("output").alias("answer"), "_ord")
    return convert_qa(qa).select("id", "instruction", "output")


# -- container --


@query(
    f"WITH {DOCS} SELECT count(*) AS count, min(length(instruction)) AS instruction_min, max(length(instruction)) AS instruction_max, round(avg(length(instruction)), 6) AS instruction_mean,"
    " min(length(output)) AS output_min, max(length(output)) AS output_max, round(avg(length(output)), 6) AS output_mean FROM s"
)
def describe_samples(spark, d):
    m = describe(documents(spark, d))
    return m.withColumns({c: r6(c) for c in ("instruction_mean", "output_mean")})


_queries["describe"] = _queries.pop("describe_samples")
_sql["describe"] = _sql.pop("describe_samples")


@query(f"WITH {DOCS} SELECT category, count(*) AS n, round(count(*) / sum(count(*)) OVER ()::DOUBLE, 6) AS share FROM s GROUP BY category")
def category_shares(spark, d):
    return category_share(documents(spark, d)).withColumn("share", r6("share"))


_queries["category_share"] = _queries.pop("category_shares")
_sql["category_share"] = _sql.pop("category_shares")


@query(
    f"WITH {DOCS}, l AS (SELECT length(output) AS n FROM s), e AS (SELECT min(n) AS lo, max(n) AS hi FROM l)"
    " SELECT CAST(CASE WHEN hi = lo THEN 0 ELSE least(49, floor((n - lo) / ((hi - lo) / 50.0::DOUBLE))) END AS INTEGER) AS bucket, count(*) AS n FROM l, e GROUP BY 1"
)
def length_histograms(spark, d):
    return length_histogram(documents(spark, d), "output")


_queries["length_histogram"] = _queries.pop("length_histograms")
_sql["length_histogram"] = _sql.pop("length_histograms")


@query(f"WITH {DOCS} SELECT id FROM s ORDER BY md5('42:' || id), id LIMIT 50")
def sample_hash(spark, d):
    return Samples(documents(spark, d)).sample(50).df.select("id")


@query(f"WITH {DOCS} SELECT id, instruction FROM s ORDER BY ord LIMIT 25")
def head(spark, d):
    return Samples(documents(spark, d)).head(25).df.select("id", "instruction")


@query(f"WITH {DOCS} SELECT id, instruction FROM s ORDER BY ord DESC LIMIT 25")
def tail(spark, d):
    return Samples(documents(spark, d)).tail(25).df.select("id", "instruction")


@query("WITH d AS (SELECT doc_id FROM documents), m AS (SELECT min(doc_id) AS lo, max(doc_id) AS hi FROM d), c AS (SELECT conv_id * 100 + turn AS k FROM conversations)"
       f", {PAIRS}, l AS (SELECT min(ord) AS low FROM s) SELECT CAST(doc_id AS VARCHAR) AS id, doc_id AS ord FROM d UNION ALL SELECT id, ord - low + hi + 1 FROM s, m, l")  # fmt: skip
def concat(spark, d):
    return Samples(documents(spark, d)).concat(Samples(pairs(spark, d))).df.select("id", F.col("_ord").alias("ord"))


@query("SELECT CAST(doc_id AS VARCHAR) AS id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def diff_anti(spark, d):
    other = spark.read.parquet(f"{d}/labels.parquet").select(F.col("doc_id").cast("string").alias("id"))
    return Samples(documents(spark, d)).diff(Samples(other)).df.select("id")


@query(f"WITH {DOCS} SELECT id, output FROM s WHERE length(output) BETWEEN 50 AND 5000")
def length_filter(spark, d):
    return LengthFilter().apply(documents(spark, d)).select("id", "output")


@query(f"WITH {PAIRS} SELECT id, 'Answer: ' || output AS output FROM s")
def prefix_adder(spark, d):
    return PrefixAdder().apply(pairs(spark, d)).select("id", "output")


@query(f"WITH {DOCS} SELECT instruction, '' AS input, output FROM s")
def sft_export(spark, d):
    return sft_rows(documents(spark, d)).select("instruction", "input", "output")


# -- evaluation --


@query(
    f"WITH {DOCS}, {SCORED}, k AS (SELECT * FROM q WHERE round(score, 9) >= 0.7::DOUBLE) SELECT count(*) AS total, 0.5::DOUBLE AS knowledge_mean, round(avg(score), 6) AS quality_mean, round(min(score), 6) AS quality_min, round(max(score), 6) AS quality_max,"
    " round(avg(length(instruction)), 6) AS instruction_length_mean, max(length(instruction))::DOUBLE AS instruction_length_max, round(avg(length(output)), 6) AS output_length_mean, max(length(output))::DOUBLE AS output_length_max,"
    " count(DISTINCT instruction) AS unique_instructions, round(count(DISTINCT instruction) / count(*)::DOUBLE, 6) AS unique_ratio, CAST(0 AS BIGINT) AS reasoning_count, 0.0::DOUBLE AS synthesis_rate FROM k"
)
def sandbox_metrics(spark, d):
    m = evaluation.dataset_metrics(QualityFilter(0.7).apply(documents(spark, d)))
    names = ("knowledge_mean", "quality_mean", "quality_min", "quality_max", "instruction_length_mean", "instruction_length_max", "output_length_mean", "output_length_max")
    return m.select("total", *[r6(n).alias(n) for n in names], "unique_instructions", r6("unique_ratio").alias("unique_ratio"), "reasoning_count", "synthesis_rate")


@query(f"WITH {PAIRS} SELECT category, count(*) AS n FROM s GROUP BY category")
def category_counts(spark, d):
    return category_diversity(pairs(spark, d))


_SCORE = "CASE WHEN (turn + length(text)) % {m} = 0 THEN NULL ELSE CAST(length(text) % {k} + 1 AS DOUBLE) END"


@query(
    f"WITH r AS (SELECT conv_id, turn, role, [{_SCORE.format(m=7, k=5)}, {_SCORE.format(m=3, k=4)}, {_SCORE.format(m=2, k=3)}] AS v FROM conversations),"
    " m AS (SELECT role, list_avg(list_filter(v, lambda x: x IS NOT NULL)) AS s FROM r) SELECT role AS model, round(avg(s), 6) AS score FROM m GROUP BY role"
)
def human_eval_scores(spark, d):
    c = spark.read.parquet(f"{d}/conversations.parquet")
    n = F.length("text")
    s = lambda m, k: F.when((F.col("turn") + n) % m != 0, (n % k + 1).cast("double"))
    values = F.create_map(F.lit("accuracy"), s(7, 5), F.lit("completeness"), s(3, 4), F.lit("fluency"), s(2, 3))
    one = F.struct(F.col("turn").cast("string").alias("response_id"), F.col("text").alias("content"), F.col("role").alias("_model"), values.alias("scores"))
    sheet = c.groupBy(F.col("conv_id").alias("question_id")).agg(F.collect_list(one).alias("responses"))
    return evaluation.human_scores(sheet).withColumn("score", r6("score"))


@query(
    "WITH m AS (SELECT lang AS model, avg(n_chars) AS score FROM documents GROUP BY lang), b AS (SELECT score AS b FROM m WHERE model = 'en'), r AS (SELECT model, score, score / b * 100 AS rel FROM m, b)"
    " SELECT model, round(score, 6) AS score, round(rel, 6) AS relative, CASE WHEN rel >= 95 THEN 'reached' WHEN rel >= 90 THEN 'near' ELSE 'missed' END AS verdict FROM r"
)
def relative_to_baseline(spark, d):
    m = spark.read.parquet(f"{d}/documents.parquet").groupBy(F.col("lang").alias("model")).agg(F.avg("n_chars").alias("score"))
    return evaluation.relative_to(m, "en").withColumns({"score": r6("score"), "relative": r6("relative")})


# -- similarity and diversity --

UNIT = "e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE / (sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE))) + 1e-9)) AS v FROM embeddings)"
SIMILAR = UNIT + f", p AS (SELECT a.vec_id AS i, b.vec_id AS j, round({_DOT.format(a='a.v', b='b.v')}, 9) AS sim FROM e a JOIN e b ON a.vec_id < b.vec_id), g AS MATERIALIZED (SELECT i, j, sim FROM p WHERE sim >= 0.3::DOUBLE)"
GREEDY = (
    ", n AS (SELECT i, list(j) AS js FROM g GROUP BY i), o AS MATERIALIZED (SELECT {id} AS k, js, row_number() OVER (ORDER BY {id}) AS st FROM {rows} LEFT JOIN n ON {id} = n.i),"
    " r AS (SELECT CAST(0 AS BIGINT) AS st, CAST([] AS BIGINT[]) AS gone UNION ALL SELECT o.st, CASE WHEN o.js IS NULL OR list_contains(r.gone, o.k) THEN r.gone ELSE list_concat(r.gone, o.js) END FROM r JOIN o ON o.st = r.st + 1),"
    " f AS (SELECT gone FROM r ORDER BY st DESC LIMIT 1)"
)


@query(f"WITH {SIMILAR} SELECT i, j, round(sim, 6) AS sim FROM g")
def similar_pairs(spark, d):
    return block_pairs(vectors(spark, d), 0.3).withColumn("sim", r6("sim"))


@query(f"WITH RECURSIVE {SIMILAR}{GREEDY.format(id='e.vec_id', rows='e')} SELECT e.vec_id FROM e, f WHERE NOT list_contains(f.gone, e.vec_id)")
def semantic_dedup_greedy(spark, d):
    v = vectors(spark, d)
    return v.join(greedy_near(v, 0.3), "_ord", "left_anti").select(F.col("_ord").alias("vec_id"))


_TOK = "[\\x{4e00}-\\x{9fff}]|[\\p{L}\\p{N}]"
TFIDF = (
    f"{PAIRS}, tk AS (SELECT ord, unnest(regexp_extract_all(lower(output), '{_TOK}')) AS tok FROM s), tf AS (SELECT ord, tok, count(*) AS c FROM tk GROUP BY ord, tok), df AS (SELECT tok, count(*) AS df FROM tf GROUP BY tok), n AS (SELECT count(*) AS n FROM s),"
    " ok AS (SELECT tok, df, n, df >= 2 AND df < 0.8::DOUBLE * n AS ok FROM df, n), vo AS (SELECT * FROM ok WHERE ok OR NOT (SELECT bool_or(ok) FROM ok)),"
    " w AS (SELECT ord, tf.tok, c * ln(n / (df + 1)::DOUBLE) AS w FROM tf JOIN vo ON tf.tok = vo.tok), nm AS (SELECT ord, sqrt(sum(w * w)) AS norm FROM w GROUP BY ord),"
    " u AS (SELECT w.ord, tok, w / CASE WHEN norm = 0 THEN 1 ELSE norm END AS w FROM w JOIN nm ON w.ord = nm.ord),"
    " g AS (SELECT a.ord AS i, b.ord AS j, round(sum(a.w * b.w), 9) AS sim FROM u a JOIN u b ON a.tok = b.tok AND a.ord < b.ord GROUP BY 1, 2 HAVING round(sum(a.w * b.w), 9) >= 0.99::DOUBLE)"
)


@query(f"WITH {TFIDF} SELECT i, j, round(sim, 6) AS sim FROM g")
def tfidf_pairs(spark, d):
    s = pairs(spark, d)
    return block_pairs(tfidf_vectors(s, F.col("output")), 0.99).withColumn("sim", r6("sim"))


@query(f"WITH RECURSIVE {TFIDF}{GREEDY.replace(', n AS', ', nb AS').replace('JOIN n ON {id} = n.i', 'JOIN nb ON {id} = nb.i').format(id='s.ord', rows='s')} SELECT s.id FROM s, f WHERE NOT list_contains(f.gone, s.ord)")
def tfidf_dedup(spark, d):
    return TfidfDedup(0.99, "output").apply(pairs(spark, d)).select("id")


@query(
    f"WITH e AS (SELECT vec_id, embedding AS v, sqrt({_DOT.format(a='embedding', b='embedding')}) AS n FROM embeddings), p AS (SELECT q.vec_id AS query, c.vec_id AS match, round({_DOT.format(a='q.v', b='c.v')} / ((q.n + 1e-9) * (c.n + 1e-9)), 6) AS sim FROM e q, e c WHERE q.vec_id <> c.vec_id)"
    " SELECT query, match, sim, CAST(row_number() OVER (PARTITION BY query ORDER BY sim DESC, match) AS INTEGER) AS rank FROM p QUALIFY rank <= 10"
)
def find_similar_topk(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    return find_similar(e, e, 10)


@query(
    f"WITH {UNIT}, x AS (SELECT unnest(v) AS x, generate_subscripts(v, 1) AS d FROM e), s AS (SELECT d, sum(x) AS s, sum(x * x) AS q, count(*) AS n FROM x GROUP BY d)"
    " SELECT round(1 - (sum(s * s) - sum(q)) / (max(n)::DOUBLE * (max(n) - 1)), 6) AS diversity_score FROM s"
)
def diversity_scores(spark, d):
    return diversity_score(vectors(spark, d)).select(r6("diversity_score").alias("diversity_score"))


_queries["diversity_score"] = _queries.pop("diversity_scores")
_sql["diversity_score"] = _sql.pop("diversity_scores")


@query(
    f"WITH RECURSIVE {UNIT}, r AS (SELECT 0 AS step, e.vec_id, CASE WHEN e.vec_id = 0 THEN 1e9::DOUBLE ELSE round({_DOT.format(a='e.v', b='z.v')}, 9) END AS most, CAST(0 AS BIGINT) AS pick FROM e, e z WHERE z.vec_id = 0"
    f" UNION ALL SELECT step + 1, x.vec_id, CASE WHEN x.vec_id = x.p THEN 1e9::DOUBLE ELSE greatest(x.most, round({_DOT.format(a='e.v', b='z.v')}, 9)) END, x.p"
    " FROM (SELECT *, first_value(vec_id) OVER (ORDER BY most, vec_id) AS p FROM r WHERE step < 19) x JOIN e ON e.vec_id = x.vec_id JOIN e z ON z.vec_id = x.p)"
    " SELECT DISTINCT pick AS vec_id, CAST(step AS INTEGER) AS rank FROM r"
)
def maxmin_select(spark, d):
    return maxmin(vectors(spark, d), 20).select(F.col("_ord").alias("vec_id"), "rank")


@query()
def kmeans_select(spark, d):
    return kmeans(vectors(spark, d), 20).select(F.col("_ord").alias("vec_id"), "rank")


# -- chains --


@query(f"WITH {DOCS}, k AS (SELECT *, {_norm('instruction')} AS key FROM s), f AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY key ORDER BY ord) = 1), q AS (SELECT *, {QUALITY} AS score FROM f) SELECT id, round(score, 6) AS quality_score FROM q WHERE round(score, 9) >= 0.8::DOUBLE")
def stage1_chain(spark, d):
    out = chain(documents(spark, d), [ExactDedup("instruction"), QualityFilter(0.8)])
    return out.select("id", r6("meta.quality_score").alias("quality_score"))


@query(f"WITH {PAIRS}, {_KW} SELECT id, round(score, 6) AS knowledge_score, row_number() OVER (ORDER BY round(score, 9) DESC, ord) - 1 AS rank FROM k QUALIFY rank < 40")
def stage2_chain(spark, d):
    out = chain(pairs(spark, d), [KnowledgeFilter(80), KnowledgeFilter(40)])
    return out.select("id", r6("meta.knowledge_score").alias("knowledge_score"), F.col("_ord").alias("rank"))


def queries() -> dict:
    from tidemark.plans import catalog_frames  # noqa: F401  adds its own

    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_sql)
