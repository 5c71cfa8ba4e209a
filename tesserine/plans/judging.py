"""Queries that check and judge answers and figures, and their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserine.functions import text as T
from tesserine.operators import answers, errors, evaluate, evidence, figures
from tesserine.plans.retrieval import REF_IDS, passages, segments
from tesserine.runtime import load, once


def _generation(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return once(load(spark, sf_dir, "generation").select("gen_id", *columns), "gen_id", "gen_id", *columns)


def numbers_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many different numbers each document has, the least and the largest of them."""
    n = T.numbers_in(F.col("text"))
    return load(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.size(n).cast("long").alias("numbers"), F.coalesce(F.array_min(n), F.lit(0.0)).alias("least"), F.coalesce(F.array_max(n), F.lit(0.0)).alias("most"))


def reply_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many numbers the first line of every explanation gives, and their sum."""
    n = T.reply_numbers(F.col("explanation"))
    return _generation(spark, sf_dir, "explanation").select("gen_id", F.size(n).cast("long").alias("numbers"), F.round(F.aggregate(n, F.lit(0.0), lambda s, x: s + x), 4).alias("total"))


def figure_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The figures that documents mention."""
    return load(spark, sf_dir, "documents").select("doc_id", F.explode(T.figure_numbers(F.col("text"))).alias("figure"))


def caption_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The figures whose caption starts a line of a block."""
    return load(spark, sf_dir, "blocks").select("block_id", F.explode(figures.caption_numbers(F.col("text"))).alias("figure")).distinct()


def answer_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers by type, and the sum of the numbers they give."""
    rows = _generation(spark, sf_dir, "answer_value", "answer_unit").where("answer_value is not null")
    return rows.groupBy(T.answer_type(F.col("answer_value")).alias("type")).agg(F.count("*").alias("answers"), F.count(T.answer_number(F.col("answer_value"), F.col("answer_unit"))).alias("with_number"))


def ungrouped_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answer values without grouping commas."""
    return _generation(spark, sf_dir, "answer_value").where("answer_value is not null").select("gen_id", T.ungrouped(F.col("answer_value")).alias("value"))


def tidy_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answer values as they are exported: without grouping commas, calculator output cut."""
    return _generation(spark, sf_dir, "answer_value").where("answer_value is not null").select("gen_id", answers.tidy_number(F.col("answer_value")).alias("value"))


def parsed_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The references of every answer with their position."""
    rows = _generation(spark, sf_dir, "ref_id").select("gen_id", F.posexplode(T.ref_ids(F.col("ref_id"))).alias("pos", "ref"))
    return rows.select("gen_id", F.col("pos").cast("long").alias("pos"), "ref")


def quote_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a recorded hit's chunk holds the last sentence of its own embedded text, white space aside."""
    hits = load(spark, sf_dir, "search_hits").where("chunk_id is not null").select(F.col("query_id").alias("question_id"), "chunk_id").distinct()
    quotes = once(load(spark, sf_dir, "chunks"), "chunk_id").select("chunk_id", F.element_at(F.split("embed_text", r"(?<=[.!?])\s+"), -1).alias("quote"))
    cited = hits.join(quotes, "chunk_id", "left")
    return evidence.quotes_found(cited, once(load(spark, sf_dir, "chunks"), "chunk_id")).select("question_id", "chunk_id", "status")


def export_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stands against exporting the answers of one run as they are."""
    rows = load(spark, sf_dir, "generation").drop("created_at").distinct()
    asked = rows.groupBy("id").agg(F.min("question").alias("question"), F.lit("text").alias("answer_unit"))
    return answers.export_problems(asked, rows.where("run_id = 'run-01'"))


def export_problems_by_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stands against exporting the answers of each run as they are; the unit of a question is the one most answers have (the smallest of equally frequent ones)."""
    rows = load(spark, sf_dir, "generation").drop("created_at").distinct()
    units = rows.groupBy("id", "question", "answer_unit").agg(F.count("*").alias("n")).groupBy("id", "answer_unit").agg(F.sum("n").alias("n"), F.min("question").alias("q"))
    asked = units.where("id is not null").groupBy("id").agg(F.min("q").alias("question"), F.min(F.struct((-F.col("n")).alias("m"), "answer_unit"))["answer_unit"].alias("answer_unit"))
    return answers.export_problems(asked, rows, "run_id")


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every answer scored against the answer that most runs give to its question (the smallest of equally frequent ones)."""
    rows = _generation(spark, sf_dir, "id", "answer_value", "answer_unit", "ref_id").where("id is not null and answer_value is not null")
    votes = rows.groupBy("id", "answer_value").agg(F.count("*").alias("n"), F.min("gen_id").alias("first"))
    best = votes.groupBy("id").agg(F.min(F.struct((-F.col("n")).alias("m"), "answer_value", "first")).alias("b"))
    gold = best.select("id", F.col("b.answer_value").alias("gold_value"), F.col("b.first").alias("gold_gen"))
    refs = rows.select(F.col("gen_id").alias("gold_gen"), T.ref_ids(F.col("ref_id")).alias("gold_refs"))
    r = rows.join(gold, "id").join(refs, "gold_gen").withColumn("refs", T.ref_ids(F.col("ref_id")))
    ok = F.col("answer_value") == F.col("gold_value")
    f1 = errors.reference_scores(F.col("gold_refs"), F.col("refs"))[2]
    na, out = F.col("gold_value") == "is_blank", F.col("answer_value") == "is_blank"
    shared = F.arrays_overlap("gold_refs", "refs")
    return r.select(
        "gen_id", "gold_value", errors.bucket(na, out, ok, f1, shared & (F.col("answer_unit") != ""), shared).alias("bucket"), F.round(errors.score(ok, f1, na == out), 6).alias("score")
    )


def error_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bucket and score of every answer, measured by the majority answer."""
    return _scored(spark, sf_dir).select("gen_id", "bucket", "score")


def points_lost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points lost by bucket."""
    return errors.points_lost(_scored(spark, sf_dir))


def score_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean score by type of the majority answer."""
    return errors.breakdown(_scored(spark, sf_dir), F.array(T.answer_type(F.col("gold_value"))), "type")


def value_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In how many chunks of the papers a numeric answer refers to its number is printed."""
    rows = _generation(spark, sf_dir, "answer_value", "answer_unit", "ref_id").select("gen_id", T.answer_number(F.col("answer_value"), F.col("answer_unit")).alias("value"), F.explode(T.ref_ids(F.col("ref_id"))).alias("ref_id"))
    numbers = passages(spark, sf_dir).where("ref_id is not null").select("item_id", "ref_id", F.explode(T.numbers_in(F.col("body"))).alias("n"))
    near = rows.where("value is not null").withColumn("key", F.round("value", 6))
    hits = near.join(numbers.withColumn("key", F.round("n", 6)), ["ref_id", "key"]).where(F.abs(F.col("n") - F.col("value")) <= 1e-9 * F.greatest(F.lit(1.0), F.abs("value")))
    counts = hits.groupBy("gen_id").agg(F.countDistinct("item_id").alias("chunks"))
    return rows.where("value is not null").select("gen_id").distinct().join(counts, "gen_id", "left").fillna(0, ["chunks"])


def chart_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figure texts from readings: every figure block's text taken as the model's reply, described for search."""
    replies = once(load(spark, sf_dir, "blocks").where("kind = 'figure'"), "block_id").select("block_id", F.to_json(F.struct(F.lit("Line_Chart").alias("kind"), F.col("text").alias("summary"))).alias("reply"))
    return figures.readings(replies).select("block_id", figures.description(F.col("reading"), F.lit("")).alias("text"))


def chart_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of chart reading: the explanations of up to three runs as replies, the last run's number as gold."""
    rows = _generation(spark, sf_dir, "id", "run_id", "explanation", "answer_value", "answer_unit", "ref_id").where("id is not null")
    gold = rows.withColumn("v", T.answer_number(F.col("answer_value"), F.col("answer_unit"))).where("v is not null")
    gold = gold.groupBy("id").agg(F.max_by(F.struct("v", "ref_id"), F.struct("run_id", "gen_id")).alias("g")).select("id", F.col("g.v").alias("gold"), T.ref_ids(F.col("g.ref_id")).alias("gold_refs"))
    from pyspark.sql import Window

    order = Window.partitionBy("id").orderBy("run_id", "gen_id")
    reads = rows.join(gold, "id").withColumn("rank", F.row_number().over(order)).where("rank <= 3")
    reads = reads.select(
        F.col("id").alias("query_id"), "rank", figures.numbers_match(F.col("explanation"), F.col("gold"), 0.01).alias("correct"),
        F.arrays_overlap("gold_refs", T.ref_ids(F.col("ref_id"))).alias("from_gold"), F.col("explanation").isNull().alias("errored"), T.reply_numbers(F.col("explanation")).alias("numbers"),
    )
    return evaluate.read_summary(reads)


def validated_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All answers as replies, checked against the passages they were given: the first three recorded hits of their question.

    Every answer that is no abstention cites the first passage with its first 60 characters and the second, where there is
    one, with the first segment of its own supporting materials (with its first 60 characters where it has none).
    """
    rows = _generation(spark, sf_dir, "id", "question", "answer", "answer_value", "explanation", "answer_unit", "supporting_materials").where("id is not null")
    p = passages(spark, sf_dir).select(F.col("item_id").alias("chunk_id"), "ref_id", "body")
    hits = load(spark, sf_dir, "search_hits").where("hit_rank <= 3").select(F.col("query_id").alias("gen_id"), "chunk_id").distinct().join(p, "chunk_id")
    given = hits.groupBy("gen_id").agg(F.array_sort(F.collect_list(F.struct("chunk_id", "ref_id", F.concat(F.lit("https://library.example/"), "ref_id").alias("url"), F.col("body").alias("text")))).alias("passages"))
    own = F.get(T.evidence(F.col("supporting_materials")), F.lit(0))
    head = lambda x: F.substring(x["text"], 1, 60)
    cited = F.transform(F.slice("passages", 1, 2), lambda x, i: F.struct(x["chunk_id"].alias("chunk_id"), F.when(i == 1, F.coalesce(own, head(x))).otherwise(head(x)).alias("quote")))
    none = F.array().cast("array<struct<chunk_id:string,quote:string>>")
    rows = rows.join(given, "gen_id", "left").withColumn("evidence", F.when(F.col("answer_value") == "is_blank", none).otherwise(F.coalesce(cited, none)))
    replies = rows.select(F.col("gen_id").cast("string").alias("id"), "question", "answer_unit", F.to_json(F.struct("answer", "answer_value", "explanation", "evidence")).alias("reply"), "passages")
    return answers.validated(replies).select("id", "answer_value", "ref_id", "error")


QUERIES = {
    f.__name__: f
    for f in (
        numbers_in, reply_numbers, figure_mentions, caption_lines, answer_types, ungrouped_values, tidy_values, parsed_refs, quote_status, export_problems, export_problems_by_run, error_buckets, points_lost,
        score_by_type, value_recall, chart_readings, chart_answers, validated_answers,
    )
}


def _numbers_sql(text: str) -> str:
    found = f"regexp_extract_all(coalesce({text}, ''), '(-?[0-9][0-9,]*(?:\\.[0-9]+)?)', 1)"
    return f"list_sort(list_distinct(list_transform({found}, lambda x: try_cast(replace(x, ',', '') AS DOUBLE))))"


_IS_NUMBER = r"'^\s*[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\s*$'"
_TYPE = f"""CASE WHEN trim({{v}}) = 'is_blank' THEN 'unanswerable' WHEN regexp_matches(trim({{v}}), '^[(\\[]') THEN 'list/range' WHEN trim({{v}}) IN ('0', '1') THEN 'true/false'
  WHEN regexp_matches(replace(trim({{v}}), ',', ''), {_IS_NUMBER}) THEN 'number' ELSE 'text' END"""
_NUMBER = f"""CASE WHEN trim(coalesce(answer_unit, '')) NOT IN ('', 'is_blank') AND regexp_matches(trim(replace(answer_value, ',', '')), {_IS_NUMBER}) THEN try_cast(trim(replace(answer_value, ',', '')) AS DOUBLE) END"""
_COLLAPSED = f"trim(regexp_replace({{0}}, '[{T.SPACES}]+', ' ', 'g'))"
_SCORED = f"""WITH r AS (SELECT DISTINCT gen_id, id, answer_value, answer_unit, {REF_IDS} AS refs FROM generation WHERE id IS NOT NULL AND answer_value IS NOT NULL),
v AS (SELECT id, answer_value, count(*) AS n, min(gen_id) AS first FROM r GROUP BY ALL),
g AS (SELECT id, answer_value AS gold_value, first AS gold_gen FROM v QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC, answer_value, first) = 1),
j AS (SELECT r.*, gold_value, x.refs AS gold_refs, len(list_distinct(r.refs)) AS np, len(list_distinct(x.refs)) AS ng, len(list_intersect(r.refs, x.refs)) AS same FROM r JOIN g USING (id) JOIN r x ON x.gen_id = gold_gen),
k AS (SELECT *, answer_value = gold_value AS ok, CASE WHEN np + ng = 0 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * same / (np + ng) END AS f1, gold_value = 'is_blank' AS na, answer_value = 'is_blank' AS out FROM j),
s AS (SELECT gen_id, gold_value, CASE WHEN na AND ok THEN 'correct_na' WHEN na THEN 'answered_unanswerable' WHEN ok AND f1 = 1 THEN 'correct' WHEN ok THEN 'citation_off'
    ELSE CASE WHEN out THEN 'abstain_' ELSE 'wrong_' END || CASE WHEN same > 0 AND coalesce(answer_unit <> '', false) THEN 'had_evidence' WHEN same > 0 THEN 'gold_doc_only' ELSE 'no_gold_doc' END END AS bucket,
  round(0.75::DOUBLE * CAST(ok AS DOUBLE) + 0.2::DOUBLE * f1 + 0.05::DOUBLE * CAST(na = out AS DOUBLE), 6) AS score FROM k)
"""

def _first_segment(s: str) -> str:
    return f"(CASE WHEN len({segments('quoted', s)}) > 0 THEN {segments('quoted', s)} ELSE {segments('marked', s)} END)[1]"


def _tidy(v: str) -> str:
    plain = f"CASE WHEN regexp_matches({v}, '^-?[0-9]{{1,3}}(?:,[0-9]{{3}})+(?:\\.[0-9]+)?$') THEN replace({v}, ',', '') ELSE {v} END"
    cut = f"regexp_replace(CAST(CAST(format('{{:.2e}}', CAST({v} AS DOUBLE)) AS DECIMAL(38, 18)) AS VARCHAR), '\\.?0+$', '')"
    long = f"regexp_matches({v}, '^-?[0-9]+\\.[0-9]{{7,}}$') AND length(regexp_replace(regexp_replace({v}, '^[-0.]+', ''), '[^0-9]', '', 'g')) >= 7"
    return f"CASE WHEN {long} THEN {cut} ELSE {plain} END"


_STRIP = f"regexp_replace({{0}}, '^[{T.SPACES}]+|[{T.SPACES}]+$', '', 'g')"
_REPLY = f"""WITH p AS (SELECT DISTINCT ON (chunk_id) chunk_id, metadata['ref_id'] AS ref_id, text AS body FROM chunks),
h AS (SELECT query_id AS gen_id, list(p ORDER BY p.chunk_id) AS ps FROM (SELECT DISTINCT query_id, chunk_id FROM search_hits WHERE hit_rank <= 3) JOIN p USING (chunk_id) GROUP BY 1),
g AS (SELECT gen_id, {_STRIP.format('answer')} AS a, {_STRIP.format('answer_value')} AS v, {_STRIP.format('explanation')} AS e, coalesce({_first_segment('supporting_materials')}, left(ps[2].body, 60)) AS own, ps[1] AS one, ps[2] AS two, answer_value IS DISTINCT FROM 'is_blank' AND ps IS NOT NULL AS cites
  FROM (SELECT DISTINCT gen_id, id, answer, answer_value, explanation, supporting_materials FROM generation) LEFT JOIN h USING (gen_id) WHERE id IS NOT NULL),
t AS (SELECT *, {_tidy('v')} AS value FROM g),
c AS (SELECT *, CASE WHEN coalesce(a, '') = '' THEN 'answer is missing, blank or no text' WHEN coalesce(value, '') = '' THEN 'answer_value is missing, blank or no text' WHEN coalesce(e, '') = '' THEN 'explanation is missing, blank or no text'
    WHEN value = 'is_blank' AND cites THEN 'an abstention cites evidence' WHEN value = 'is_blank' THEN NULL WHEN lower(value) IN ('nan', 'inf', '-inf', 'infinity', 'na', 'n/a') THEN 'the value is not finite' WHEN NOT cites THEN 'an answer cites nothing'
    WHEN {_STRIP.format("left(one.body, 60)")} = '' THEN 'a quote is blank' WHEN coalesce(one.ref_id, '') = '' THEN 'a cited passage has no reference or no URL'
    WHEN two IS NULL THEN NULL WHEN {_STRIP.format('own')} = '' THEN 'a quote is blank' WHEN NOT contains({_COLLAPSED.format('two.body')}, {_COLLAPSED.format('own')}) THEN 'a quote does not stand in its passage' WHEN coalesce(two.ref_id, '') = '' THEN 'a cited passage has no reference or no URL' END AS error FROM t)
SELECT CAST(gen_id AS VARCHAR) AS id, CASE WHEN error IS NULL THEN value END AS answer_value,
  CASE WHEN error IS NOT NULL THEN NULL WHEN value = 'is_blank' THEN value WHEN two IS NULL OR two.ref_id = one.ref_id THEN '["' || one.ref_id || '"]' ELSE '["' || one.ref_id || '", "' || two.ref_id || '"]' END AS ref_id, error FROM c"""
_READS = f"""WITH r AS (SELECT DISTINCT gen_id, id, run_id, explanation, answer_value, answer_unit, ref_id, {REF_IDS} AS refs FROM generation WHERE id IS NOT NULL),
g AS (SELECT id, arg_max({{'v': v, 'refs': refs}}, {{'r': run_id, 'g': gen_id}}) AS g FROM (SELECT *, {_NUMBER} AS v FROM r) WHERE v IS NOT NULL GROUP BY id),
l AS (SELECT r.*, g.g.v AS gold, g.g.refs AS gold_refs, row_number() OVER (PARTITION BY id ORDER BY run_id, gen_id) AS rank, {{numbers}} AS ns FROM r JOIN g USING (id) QUALIFY rank <= 3),
m AS (SELECT id, rank, len(list_intersect(refs, gold_refs)) > 0 AS from_gold, explanation IS NULL AS errored, len(ns) > 0 AS any_number,
  len(list_filter(ns, lambda n: abs(n - gold) <= greatest(0.01 * greatest(abs(n), abs(gold)), 1e-9) OR round(n, places) = round(gold, places))) > 0 AS correct FROM (
    SELECT *, list_filter(range(0, 14), lambda p: p = 13 OR round(gold, p :: INTEGER) = gold)[1] :: INTEGER AS places FROM l)),
q AS (SELECT id, bool_or(from_gold AND rank = 1) AS g1, bool_or(from_gold) AS g3, bool_or(correct AND rank = 1) AS a1, bool_or(correct) AS a3, bool_or(correct AND from_gold AND rank = 1) AS s1, bool_or(correct AND from_gold) AS s3,
  bool_or(rank = 1 AND any_number AND NOT correct) AS w1, count(*) FILTER (WHERE errored) AS e FROM m GROUP BY id)
SELECT count(*) AS questions, CAST(sum(e) AS BIGINT) AS read_errors, avg(g1::DOUBLE) AS gold_doc_read_1, avg(g3::DOUBLE) AS gold_doc_read_3, avg(a1::DOUBLE) AS answer_1, avg(a3::DOUBLE) AS answer_3, avg(s1::DOUBLE) AS strict_answer_1, avg(s3::DOUBLE) AS strict_answer_3, avg(w1::DOUBLE) AS wrong_number_1 FROM q"""
_REPLY_NUMBERS = _numbers_sql(
    "regexp_replace(coalesce(list_filter(regexp_split_to_array(coalesce(explanation, ''), '\\r\\n|[\\n\\r]'), lambda x: regexp_replace(x, '[" + T.SPACES + "]', '', 'g') <> '')[1], ''), '(?i)\\bfig(?:ure)?s?\\.?\\s*[0-9]+(?:\\s*\\([0-9A-Za-z_]\\))?', ' ', 'g')"
)

SQL = {
    "tidy_values": f"SELECT DISTINCT gen_id, {_tidy('answer_value')} AS value FROM generation WHERE answer_value IS NOT NULL",
    "validated_answers": _REPLY,
    "chart_answers": _READS.replace("{numbers}", _REPLY_NUMBERS),
    "export_problems_by_run": f"""WITH r AS (SELECT DISTINCT gen_id, run_id, id, question, answer, answer_value, answer_unit, ref_id, ref_url, supporting_materials, explanation FROM generation),
u AS (SELECT id, answer_unit, count(*) AS n FROM r WHERE id IS NOT NULL GROUP BY ALL), q AS (SELECT id, min(question) AS q FROM r WHERE id IS NOT NULL GROUP BY id),
v AS (SELECT id, answer_unit AS u FROM u QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC, answer_unit NULLS FIRST) = 1),
w AS (SELECT q.id, q, u, run_id FROM q JOIN v USING (id), (SELECT DISTINCT run_id FROM r WHERE run_id IS NOT NULL)),
b AS (SELECT coalesce(w.run_id, a.run_id) AS run_id, coalesce(w.id, a.id) AS id, CASE WHEN a.gen_id IS NULL THEN 'missing id' WHEN w.id IS NULL THEN 'unknown id'
  WHEN len(list_filter([a.id, question, answer, answer_value, ref_id, ref_url, supporting_materials, explanation], lambda x: {_STRIP.format("coalesce(x, '')")} = '')) > 0 THEN 'blank field'
  WHEN question <> q OR answer_unit IS DISTINCT FROM u THEN 'changed input'
  WHEN answer_value = 'is_blank' AND NOT (ref_id = 'is_blank' AND ref_url = 'is_blank' AND supporting_materials = 'is_blank') THEN 'abstention with evidence' END AS problem FROM w FULL JOIN r a ON w.id = a.id AND w.run_id = a.run_id)
SELECT run_id, id, problem FROM b WHERE problem IS NOT NULL UNION ALL SELECT run_id, id, 'repeated id' FROM r GROUP BY run_id, id HAVING count(*) > 1""",
    "numbers_in": f"SELECT doc_id, len(n) AS numbers, coalesce(n[1], 0) AS least, coalesce(n[-1], 0) AS most FROM (SELECT doc_id, {_numbers_sql('text')} AS n FROM documents WHERE text IS NOT NULL)",
    "reply_numbers": f"""SELECT gen_id, len(n) AS numbers, coalesce(round(list_sum(n), 4), 0) AS total FROM (SELECT gen_id, {_numbers_sql("regexp_replace(coalesce(l[1], ''), '(?i)\\bfig(?:ure)?s?\\.?\\s*[0-9]+(?:\\s*\\([0-9A-Za-z_]\\))?', ' ', 'g')")} AS n
  FROM (SELECT gen_id, list_filter(regexp_split_to_array(coalesce(explanation, ''), '\\r\\n|[\\n\\r]'), lambda x: regexp_replace(x, '[{T.SPACES}]', '', 'g') <> '') AS l FROM (SELECT DISTINCT gen_id, explanation FROM generation)))""",
    "figure_mentions": r"SELECT doc_id, unnest(list_distinct(regexp_extract_all(coalesce(text, ''), '(?i)\bfig(?:ure)?s?\.?\s*([0-9]+)', 1))) AS figure FROM documents",
    "caption_lines": r"SELECT DISTINCT block_id, unnest(regexp_extract_all(coalesce(text, ''), '(?im)^\s*(?:figure|fig\.?)\s*([0-9]+)\b', 1)) AS figure FROM blocks",
    "answer_types": f"SELECT {_TYPE.format(v='answer_value')} AS type, count(*) AS answers, count({_NUMBER}) AS with_number FROM (SELECT DISTINCT gen_id, answer_value, answer_unit FROM generation WHERE answer_value IS NOT NULL) GROUP BY 1",
    "ungrouped_values": r"SELECT DISTINCT gen_id, CASE WHEN regexp_matches(answer_value, '^-?[0-9]{1,3}(?:,[0-9]{3})+(?:\.[0-9]+)?$') THEN replace(answer_value, ',', '') ELSE answer_value END AS value FROM generation WHERE answer_value IS NOT NULL",
    "parsed_refs": f"SELECT gen_id, pos - 1 AS pos, r[pos] AS ref FROM (SELECT gen_id, r, unnest(range(1, len(r) + 1)) AS pos FROM (SELECT DISTINCT gen_id, {REF_IDS} AS r FROM generation))",
    "quote_status": f"""WITH c AS (SELECT DISTINCT ON (chunk_id) chunk_id, {_COLLAPSED.format('text')} AS body,
    {_COLLAPSED.format("coalesce((regexp_split_to_array(regexp_replace(embed_text, '([.!?])' || chr(92) || 's+', chr(92) || '1' || chr(31), 'g'), chr(31)))[-1], '')")} AS quote FROM chunks)
SELECT DISTINCT query_id AS question_id, h.chunk_id, CASE WHEN c.chunk_id IS NULL THEN 'unknown passage' WHEN quote = '' THEN 'blank quote' WHEN NOT contains(coalesce(body, ''), quote) THEN 'absent quote' ELSE 'ok' END AS status
FROM search_hits h LEFT JOIN c USING (chunk_id) WHERE h.chunk_id IS NOT NULL""",
    "export_problems": """WITH r AS (SELECT DISTINCT gen_id, run_id, id, question, answer, answer_value, answer_unit, ref_id, ref_url, supporting_materials, explanation FROM generation),
q AS (SELECT id, min(question) AS q, 'text' AS u FROM r GROUP BY id), a AS (SELECT * FROM r WHERE run_id = 'run-01'),
b AS (SELECT coalesce(q.id, a.id) AS id, CASE WHEN a.id IS NULL THEN 'missing id' WHEN q.id IS NULL THEN 'unknown id'
  WHEN len(list_filter([a.id, question, answer, answer_value, ref_id, ref_url, supporting_materials, explanation], lambda v: trim(coalesce(v, '')) = '')) > 0 THEN 'blank field'
  WHEN question <> q OR answer_unit IS DISTINCT FROM u THEN 'changed input'
  WHEN answer_value = 'is_blank' AND NOT (ref_id = 'is_blank' AND ref_url = 'is_blank' AND supporting_materials = 'is_blank') THEN 'abstention with evidence' END AS problem FROM q FULL JOIN a ON q.id = a.id)
SELECT id, problem FROM b WHERE problem IS NOT NULL UNION ALL SELECT id, 'repeated id' FROM a GROUP BY id HAVING count(*) > 1""",
    "error_buckets": _SCORED + "SELECT gen_id, bucket, score FROM s",
    "points_lost": _SCORED + "SELECT bucket, count(*) AS questions, round(count(*) / (SELECT count(*) FROM s)::DOUBLE, 6) AS share, round(sum(1 - score) / (SELECT count(*) FROM s), 6) AS lost FROM s GROUP BY bucket",
    "score_by_type": _SCORED + f"SELECT {_TYPE.format(v='gold_value')} AS type, count(*) AS questions, round(avg(score), 6) AS mean_score FROM s GROUP BY 1",
    "value_recall": f"""WITH r AS (SELECT DISTINCT gen_id, {_NUMBER} AS value, unnest({REF_IDS}) AS ref_id FROM generation), v AS (SELECT * FROM r WHERE value IS NOT NULL),
p AS (SELECT chunk_id, metadata['ref_id'] AS ref_id, unnest({_numbers_sql('text')}) AS n FROM (SELECT DISTINCT ON (chunk_id) * FROM chunks))
SELECT v.gen_id, count(DISTINCT chunk_id) AS chunks FROM v LEFT JOIN p ON p.ref_id = v.ref_id AND abs(n - value) <= 1e-9 * greatest(1, abs(value)) GROUP BY v.gen_id""",
    "chart_readings": "SELECT DISTINCT block_id, 'Figure (line chart)' || chr(10) || 'Summary: ' || trim(text) AS text FROM blocks WHERE kind = 'figure'",
}
