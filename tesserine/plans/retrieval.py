"""Queries of retrieval, fusion and its evaluation, and their SQL counterparts.

Searches take as queries every row whose id is divisible by 20, against all rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserine.functions import text as T
from tesserine.operators import answers, dense, enrich, evaluate, evidence, fusion, incremental, lexical
from tesserine.runtime import load, once, stage, texts


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, doc_id, ref_id, kind, text, body) of all chunks; text is what is searched, body what is shown."""
    text = enrich.embedded_text(F.col("text"), F.col("embed_text"))
    return once(texts(spark, sf_dir, "chunks"), "chunk_id").select(
        F.col("chunk_id").alias("item_id"), "doc_id", F.try_element_at("metadata", F.lit("ref_id")).alias("ref_id"), "kind", text.alias("text"), F.col("text").alias("body")
    )


def _generation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once(load(spark, sf_dir, "generation"), "gen_id")


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, query, refs, supporting) of the search queries."""
    rows = _generation(spark, sf_dir).where("gen_id % 20 = 0")
    return rows.select(F.col("gen_id").alias("query_id"), F.col("question").alias("query"), T.ref_ids(F.col("ref_id")).alias("refs"), F.col("supporting_materials").alias("supporting"))


def _long(ranking: DataFrame) -> DataFrame:
    return ranking.withColumn("rank", F.col("rank").cast("long"))


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best chunks by BM25 for every query."""
    return _long(lexical.bm25(passages(spark, sf_dir), asked(spark, sf_dir)))


def bm25_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same among tables only, with the statistics of all chunks."""
    return _long(lexical.bm25(passages(spark, sf_dir), asked(spark, sf_dir), where=F.col("kind") == "table"))


def tfidf_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best chunks by TF-IDF for every query."""
    return _long(lexical.tfidf(passages(spark, sf_dir), asked(spark, sf_dir)))


def _vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding").dropDuplicates(["query_id"])


def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten most similar vectors for every query vector."""
    return _long(dense.cosine_topk(load(spark, sf_dir, "embeddings"), _vector_queries(spark, sf_dir)))


def cosine_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same among vectors of one label."""
    return _long(dense.cosine_topk(load(spark, sf_dir, "embeddings"), _vector_queries(spark, sf_dir), where=F.col("label") == 3))


def _two_rankings(spark: SparkSession, sf_dir: str, weights=None, k: int = 50) -> DataFrame:
    p, q = passages(spark, sf_dir), asked(spark, sf_dir)
    return fusion.stacked(lexical.bm25(p, q, k), lexical.tfidf(p, q, k), weights=weights)


def rrf_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 and TF-IDF fused by rank, twenty items a query."""
    return _long(fusion.rrf(_two_rankings(spark, sf_dir), 60, 20))


def rrf_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with TF-IDF at a tenth of the weight."""
    return _long(fusion.rrf(_two_rankings(spark, sf_dir, [1.0, 0.1]), 60, 20))


def rrf_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from the first twenty ranks only."""
    return _long(fusion.rrf(_two_rankings(spark, sf_dir), 60, 20, depth=20))


def rrf_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First items of every setting of a grid of fusion settings."""
    grid = fusion.rrf_grid(stage(_two_rankings(spark, sf_dir), "rankings"), [10, 30, 60], [0.1, 0.5, 1.0])
    return _long(grid.where("rank = 1")).drop("rank")


def rerank_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first twenty of BM25 ordered by length (the shortest first), the rest behind them."""
    p = passages(spark, sf_dir)
    base = stage(lexical.bm25(p, asked(spark, sf_dir), 30), "ranking")
    scores = base.join(p.select("item_id", (-F.length("text")).cast("double").alias("pair_score")), "item_id").select("query_id", "item_id", "pair_score")
    return _long(fusion.reranked(base.select("query_id", "item_id", "rank"), scores, 20))


def second_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of a first search and, behind them, those of a second one that were not among them."""
    p, q = passages(spark, sf_dir), asked(spark, sf_dir)
    return _long(answers.appended(lexical.bm25(p, q, 5), lexical.tfidf(p, q, 5)))


def table_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables that the passages found mention, of the passages' own documents."""
    p = passages(spark, sf_dir)
    found = lexical.bm25(p, asked(spark, sf_dir), 10).select("query_id", "item_id", "rank")
    return _long(answers.mentioned_tables(found, p.select("item_id", "doc_id", F.col("body").alias("text")), 3).withColumnRenamed("added_no", "rank"))


def ranking_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which queries a cache of recorded hits can answer ten deep."""
    cached = load(spark, sf_dir, "search_hits").groupBy("query_id").agg(F.max("hit_rank").alias("depth"))
    return incremental.reusable(cached, cached.select("query_id", F.lit(10).alias("k"))).select("query_id", "cached")


def evidence_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verbatim segments of all supporting materials."""
    rows = load(spark, sf_dir, "generation").select("gen_id", F.posexplode(T.evidence(F.col("supporting_materials"))).alias("pos", "segment"))
    return rows.select("gen_id", F.col("pos").cast("long").alias("pos"), "segment").distinct()


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text block as a segment of its paper, to be found again in the chunks of the paper."""
    rows = load(spark, sf_dir, "blocks").where("kind = 'text' AND size(source_refs) > 0")
    return once(rows.select(F.col("block_id").alias("segment_id"), F.col("doc_id").alias("group"), "text"), "segment_id", "segment_id", "group", "text")


def evidence_bag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks that have at least seven tenths of the words of a text block of their paper."""
    p = passages(spark, sf_dir).select("item_id", F.col("doc_id").alias("group"), F.col("body").alias("text"))
    return evidence.bag_coverage(_segments(spark, sf_dir), p).select("segment_id", "item_id", F.col("shared").cast("long").alias("shared"), F.col("words").cast("long").alias("words"))


def evidence_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks that have at least seven tenths of the words of a text block of their paper in order."""
    p = passages(spark, sf_dir).select("item_id", F.col("doc_id").alias("group"), F.col("body").alias("text"))
    return evidence.coverage(_segments(spark, sf_dir), p)


def _judged(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    p = passages(spark, sf_dir)
    q = evaluate.in_corpus(asked(spark, sf_dir), p)
    ranking = stage(lexical.bm25(p, q, 20), "ranking")
    return p, q, ranking


def doc_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every query the rank of the first chunk of a paper it refers to (0: none), and the tokens of the first five chunks."""
    p, q, ranking = _judged(spark, sf_dir)
    ranked = evaluate.first_ranks(q, ranking, evaluate.gold_items(q, p, ranking), "doc_rank")
    out = evaluate.context_tokens(ranked, ranking, evaluate.context_sizes(p, ranking))
    return out.select("query_id", F.coalesce("doc_rank", F.lit(0)).cast("long").alias("doc_rank"), F.col("ctx_tokens").cast("long").alias("ctx_tokens"))


def retrieval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall of papers and passages, mean reciprocal rank and context size of BM25."""
    p, q, ranking = _judged(spark, sf_dir)
    return evaluate.summary(evaluate.judged(q.withColumn("evidence", T.evidence(F.col("supporting"))), p, ranking))


QUERIES = {
    f.__name__: f
    for f in (
        bm25_topk, bm25_filtered, tfidf_topk, cosine_topk, cosine_where, rrf_equal, rrf_weighted, rrf_depth, rrf_sweep, rerank_head, second_hop, table_expansion, ranking_cache,
        evidence_segments, evidence_bag, evidence_coverage, doc_ranks, retrieval_metrics,
    )
}

_STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
TERM = "([a-z0-9]+(?:[.,][0-9]+)*)"


def terms_sql(text: str, stop: bool = True) -> str:
    found = f"regexp_extract_all(lower(coalesce({text}, '')), '{TERM}', 1)"
    return f"list_filter({found}, lambda t: t NOT IN ({_STOP}))" if stop else found


REF_IDS = """CASE WHEN trim(coalesce(ref_id, '')) IN ('', 'is_blank') THEN []
  WHEN starts_with(trim(ref_id), '[') THEN regexp_extract_all(trim(ref_id), '["'']([^"'']*)["'']', 1) ELSE [trim(ref_id)] END"""

BASE = f"""p AS (SELECT DISTINCT ON (chunk_id) chunk_id AS item_id, doc_id, metadata['ref_id'] AS ref_id, kind, coalesce(nullif(embed_text, ''), text) AS text, text AS body FROM chunks),
q AS (SELECT DISTINCT ON (gen_id) gen_id AS query_id, question AS query, {REF_IDS} AS refs FROM generation WHERE gen_id % 20 = 0)"""


def bm25_sql(where: str = "true", queries: str = "q") -> str:
    return f"""pt AS (SELECT item_id, kind, {terms_sql('text')} AS w FROM p),
st AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM pt),
qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({terms_sql('query')}) AS term FROM {queries}) GROUP BY ALL),
po AS (SELECT item_id, kind, len, term, count(*) AS tf FROM (SELECT item_id, kind, len(w) AS len, unnest(w) AS term FROM pt) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM po GROUP BY term),
bs AS (SELECT query_id, item_id, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / CASE WHEN mean > 0 THEN mean ELSE 1 END))), 6) AS score
  FROM qt JOIN df USING (term) JOIN po USING (term), st WHERE {where} GROUP BY query_id, item_id),
bm25 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM bs WHERE score > 0)"""


_GRAMS = "list_filter(regexp_extract_all(lower(coalesce({0}, '')), '([\\p{{L}}\\p{{N}}_]{{2,}})', 1), lambda t: t NOT IN (" + _STOP.replace("{", "{{") + "))"
_PAIRS = "list_concat(w, list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1]))"
TFIDF = f"""tp AS (SELECT item_id, term, count(*) AS tf FROM (SELECT item_id, unnest({_PAIRS}) AS term FROM (SELECT item_id, {_GRAMS.format('text')} AS w FROM p)) GROUP BY ALL),
tn AS (SELECT count(*) AS n FROM p),
ti AS (SELECT term, ln((max(n) + 1) / (count(*) + 1)::DOUBLE) + 1 AS idf FROM tp, tn GROUP BY term),
tw AS (SELECT item_id, term, (ln(tf) + 1) * idf AS w FROM tp JOIN ti USING (term)),
tl AS (SELECT item_id, sqrt(sum(w * w)) AS l FROM tw GROUP BY item_id),
tq AS (SELECT query_id, term, (ln(count(*)) + 1) * max(idf) AS w FROM (SELECT query_id, unnest({_PAIRS}) AS term FROM (SELECT query_id, {_GRAMS.format('query')} AS w FROM q)) JOIN ti USING (term) GROUP BY ALL),
tql AS (SELECT query_id, sqrt(sum(w * w)) AS l FROM tq GROUP BY query_id),
ts AS (SELECT query_id, item_id, round(d / (tl.l * tql.l), 6) AS score FROM (SELECT query_id, item_id, sum(tq.w * tw.w) AS d FROM tq JOIN tw USING (term) GROUP BY ALL) JOIN tl USING (item_id) JOIN tql USING (query_id)),
tfidf AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM ts)"""


def _rrf_sql(k: str, w: str, depth: int, tail: str) -> str:
    return f"""WITH {BASE}, {bm25_sql()}, {TFIDF},
ls AS (SELECT 0 AS list_no, 1.0::DOUBLE AS weight, query_id, item_id, rank FROM bm25 WHERE rank <= {depth} UNION ALL SELECT 1, {w}, query_id, item_id, rank FROM tfidf WHERE rank <= {depth}),
fs AS (SELECT query_id, item_id, round(sum(weight / ({k} + rank)), 9) AS score, min({{'list_no': list_no, 'rank': rank}}) AS seen FROM ls GROUP BY ALL),
fr AS (SELECT query_id, item_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seen, item_id) AS rank FROM fs)
{tail}"""


def _cosine_sql(where: str) -> str:
    return f"""WITH v AS (SELECT DISTINCT ON (vec_id) * FROM embeddings),
s AS (SELECT q.vec_id AS query_id, v.vec_id AS item_id, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score FROM v q, v WHERE q.vec_id % 20 = 0 AND {where})
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM s QUALIFY rank <= 10"""


_WORDS6 = f"list_filter(list_transform(flatten(list_transform({{0}}, lambda p: string_split_regex(p, '\\.\\.\\.|…|\\s--\\s'))), lambda p: regexp_replace(p, '^[ .…''\"]+|[ .…''\"]+$', '', 'g')), lambda p: len(list_filter(regexp_split_to_array(p, '[{T.SPACES}]+'), lambda w: w <> '')) >= 6)"
_MARK = "string_split(regexp_replace(regexp_replace(coalesce(s, ''), '(?i)^\\s*(?:quote|evidence)\\s*:\\s*', ''), '\\b[a-z]+[0-9]{4}[a-z]?\\s*:\\s*', chr(31), 'g'), chr(31))"



def segments(which: str, s: str) -> str:
    """The verbatim segments of a column of supporting materials: quoted ones, or those between marks."""
    parts = f"regexp_extract_all(coalesce({s}, ''), '[\"“]([^\"”]+)[\"”]', 1)" if which == "quoted" else _MARK.replace("coalesce(s, '')", f"coalesce({s}, '')")
    return _WORDS6.format(parts)


# Difflib's matching blocks: the longest common run of words (the first in the segment, then in the passage, of equally long
# ones), then the same before and behind it. n numbers the words of segments `sg` and passages `pg`, `pairs` names them.
_ALIGNED = """held AS (SELECT segment_id, item_id, contains(' ' || array_to_string(p.t, ' ') || ' ', ' ' || array_to_string(s.t, ' ') || ' ') AS whole FROM pairs JOIN sg s USING (segment_id) JOIN pg p USING (item_id)),
todo AS (SELECT segment_id, item_id FROM held WHERE NOT whole),
sx AS (SELECT segment_id, unnest(t) AS w, unnest(range(1, len(t) + 1)) AS i FROM sg WHERE segment_id IN (SELECT segment_id FROM todo)),
px AS (SELECT item_id, unnest(t) AS w, unnest(range(1, len(t) + 1)) AS j FROM pg WHERE item_id IN (SELECT item_id FROM todo)),
mt AS (SELECT segment_id, item_id, i, j FROM todo JOIN sx USING (segment_id) JOIN px USING (item_id, w)),
mr AS (SELECT segment_id, item_id, i, j, max(i) OVER (PARTITION BY segment_id, item_id, i - j, part) - i + 1 AS len FROM (
  SELECT *, i - row_number() OVER (PARTITION BY segment_id, item_id, i - j ORDER BY i) AS part FROM mt)),
lx AS (SELECT segment_id, item_id, min({'m': -len, 'i': i, 'j': j}) AS x FROM mr GROUP BY ALL),
ij AS (SELECT segment_id, item_id, i, min(j) AS low, max(j) AS high FROM mt GROUP BY ALL),
ok AS (SELECT segment_id, item_id FROM ij JOIN lx USING (segment_id, item_id) JOIN sg USING (segment_id) GROUP BY segment_id, item_id  -- what can still match beside the longest run
  HAVING -any_value(x.m) + count(*) FILTER (WHERE i < x.i AND low < x.j) + count(*) FILTER (WHERE i >= x.i - x.m AND high >= x.j - x.m) >= 0.7 * len(any_value(t))),
bl AS (
  SELECT segment_id, item_id, len(any_value(s.t)) + 1 AS b, len(any_value(p.t)) + 1 AS d, list({'i': i, 'j': j, 'n': mr.len}) AS ms, 0 :: BIGINT AS size FROM mr SEMI JOIN ok USING (segment_id, item_id) JOIN sg s USING (segment_id) JOIN pg p USING (item_id) GROUP BY segment_id, item_id
  UNION ALL SELECT segment_id, item_id, CASE WHEN side = 1 THEN x.i ELSE b END, CASE WHEN side = 1 THEN x.j ELSE d END,
    CASE WHEN side = 1 THEN list_filter(ms, lambda m: m.i < x.i AND m.j < x.j) ELSE list_filter(ms, lambda m: m.i >= x.i - x.m AND m.j >= x.j - x.m) END, CASE WHEN side = 1 THEN -x.m ELSE 0 END
  FROM (SELECT *, list_min(list_transform(ms, lambda m: {'m': -least(m.n, b - m.i, d - m.j), 'i': m.i, 'j': m.j})) AS x FROM bl WHERE len(ms) > 0), (VALUES (1), (2)) AS sides(side)),
cv AS (SELECT segment_id, item_id, sum(size) AS same FROM bl GROUP BY ALL),
covered AS (SELECT segment_id, item_id, 1.0 :: DOUBLE AS coverage FROM held WHERE whole UNION ALL SELECT segment_id, item_id, same / len(t)::DOUBLE FROM cv JOIN sg USING (segment_id) WHERE same / len(t)::DOUBLE >= 0.7)"""


def _pairs_sql() -> str:
    """The pairs of one group of which the passage has seven tenths of the segment's words, from sg and pg (id, g, t)."""
    return """sw AS (SELECT segment_id, g, len, term, count(*) AS n FROM (SELECT segment_id, g, len(t) AS len, unnest(t) AS term FROM sg) GROUP BY ALL),
pw AS (SELECT item_id, g, term, count(*) AS n FROM (SELECT item_id, g, unnest(t) AS term FROM pg) GROUP BY ALL),
pairs AS (SELECT segment_id, item_id FROM sw JOIN pw USING (g, term) GROUP BY segment_id, item_id HAVING sum(least(sw.n, pw.n)) >= ceil(0.7 * max(len) - 1e-9))"""


SQL = {
    "bm25_topk": f"WITH {BASE}, {bm25_sql()} SELECT * FROM bm25 WHERE rank <= 10",
    "bm25_filtered": f"""WITH {BASE}, {bm25_sql("kind = 'table'")} SELECT * FROM bm25 WHERE rank <= 10""",
    "tfidf_topk": f"WITH {BASE}, {TFIDF} SELECT * FROM tfidf WHERE rank <= 10",
    "cosine_topk": _cosine_sql("true"),
    "cosine_where": _cosine_sql("v.label = 3"),
    "rrf_equal": _rrf_sql("60", "1.0", 50, "SELECT * FROM fr WHERE rank <= 20"),
    "rrf_weighted": _rrf_sql("60", "0.1", 50, "SELECT * FROM fr WHERE rank <= 20"),
    "rrf_depth": _rrf_sql("60", "1.0", 20, "SELECT * FROM fr WHERE rank <= 20"),
    "rrf_sweep": f"""WITH {BASE}, {bm25_sql()}, {TFIDF},
ls AS (SELECT 0 AS list_no, query_id, item_id, rank FROM bm25 WHERE rank <= 50 UNION ALL SELECT 1, query_id, item_id, rank FROM tfidf WHERE rank <= 50),
g AS (SELECT k_rrf, weight FROM (VALUES (10), (30), (60)) AS k(k_rrf), (VALUES (0.1::DOUBLE), (0.5::DOUBLE), (1.0::DOUBLE)) AS w(weight)),
fs AS (SELECT k_rrf, weight, query_id, item_id, round(sum(CASE WHEN list_no = 0 THEN 1.0::DOUBLE ELSE weight END / (k_rrf + rank)), 9) AS score, min({{'list_no': list_no, 'rank': rank}}) AS seen FROM ls, g GROUP BY k_rrf, weight, query_id, item_id)
SELECT k_rrf, weight, query_id, item_id FROM fs QUALIFY row_number() OVER (PARTITION BY k_rrf, weight, query_id ORDER BY score DESC, seen, item_id) = 1""",
    "table_expansion": f"""WITH {BASE}, {bm25_sql()}, f AS (SELECT query_id, item_id, rank FROM bm25 WHERE rank <= 10),
tb AS (SELECT item_id AS table_id, doc_id, upper(regexp_extract(left(body, 80), '(?i)^\\W*table\\s+([ivxlc]+|[0-9]+)\\b', 1)) AS label FROM p WHERE contains(body, '|')),
mn AS (SELECT query_id, rank, doc_id, at_no, upper(m[at_no]) AS label FROM (SELECT query_id, rank, doc_id, m, unnest(range(1, len(m) + 1)) AS at_no FROM (
  SELECT query_id, rank, doc_id, regexp_extract_all(body, '(?i)\\b(?:table|tab\\.)\\s+([ivxlc]+|[0-9]+)\\b', 1) AS m FROM f JOIN p USING (item_id)))),
fd AS (SELECT query_id, table_id, min({{'rank': rank, 'at_no': at_no, 'table_id': table_id}}) AS first FROM mn JOIN tb USING (doc_id, label) WHERE label <> '' GROUP BY ALL)
SELECT query_id, table_id AS item_id, row_number() OVER (PARTITION BY query_id ORDER BY first) AS rank FROM fd a WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.query_id = a.query_id AND f.item_id = a.table_id) QUALIFY rank <= 3""",
    "rerank_head": f"""WITH {BASE}, {bm25_sql()}, h AS (SELECT query_id, item_id, rank AS base, rank > 20 AS tail, CASE WHEN rank <= 20 THEN length(text) END AS l FROM bm25 JOIN p USING (item_id) WHERE rank <= 30)
SELECT query_id, item_id, row_number() OVER (PARTITION BY query_id ORDER BY tail, l NULLS LAST, base) AS rank FROM h""",
    "second_hop": f"""WITH {BASE}, {bm25_sql()}, {TFIDF}, b AS (SELECT query_id, item_id, rank FROM bm25 WHERE rank <= 5),
a AS (SELECT query_id, item_id, 0 AS part, rank FROM b UNION ALL SELECT query_id, item_id, 1, rank FROM (SELECT query_id, item_id, rank FROM tfidf WHERE rank <= 5) ANTI JOIN b USING (query_id, item_id))
SELECT query_id, item_id, row_number() OVER (PARTITION BY query_id ORDER BY part, rank, item_id) AS rank FROM a""",
    "ranking_cache": "SELECT query_id, max(hit_rank) >= 10 AS cached FROM search_hits GROUP BY query_id",
    "evidence_segments": f"""SELECT DISTINCT gen_id, pos - 1 AS pos, l[pos] AS segment FROM (SELECT gen_id, l, unnest(range(1, len(l) + 1)) AS pos FROM (
  SELECT gen_id, CASE WHEN len(a) > 0 THEN a ELSE b END AS l FROM (
    SELECT gen_id, {_WORDS6.format("regexp_extract_all(coalesce(s, ''), '[\"“]([^\"”]+)[\"”]', 1)")} AS a, {_WORDS6.format(_MARK)} AS b FROM (SELECT gen_id, supporting_materials AS s FROM generation))))""",
    "evidence_bag": f"""WITH s AS (SELECT DISTINCT block_id AS segment_id, doc_id, {terms_sql('text', False)} AS t FROM blocks WHERE kind = 'text' AND len(source_refs) > 0),
sw AS (SELECT segment_id, doc_id, len, term, count(*) AS n FROM (SELECT segment_id, doc_id, len(t) AS len, unnest(t) AS term FROM s) GROUP BY ALL),
pw AS (SELECT item_id, doc_id, term, count(*) AS n FROM (SELECT chunk_id AS item_id, doc_id, unnest({terms_sql('text', False)}) AS term FROM (SELECT DISTINCT ON (chunk_id) * FROM chunks)) GROUP BY ALL)
SELECT segment_id, item_id, CAST(sum(least(sw.n, pw.n)) AS BIGINT) AS shared, max(len) AS words FROM sw JOIN pw USING (doc_id, term) GROUP BY segment_id, item_id HAVING sum(least(sw.n, pw.n)) >= ceil(0.7 * max(len) - 1e-9)""",
    "evidence_coverage": f"""WITH RECURSIVE sg AS (SELECT DISTINCT block_id AS segment_id, doc_id AS g, {terms_sql('text', False)} AS t FROM blocks WHERE kind = 'text' AND len(source_refs) > 0),
pg AS (SELECT chunk_id AS item_id, doc_id AS g, {terms_sql('text', False)} AS t FROM (SELECT DISTINCT ON (chunk_id) * FROM chunks)), {_pairs_sql()}, {_ALIGNED} SELECT segment_id, item_id, coverage FROM covered""",
    "retrieval_metrics": f"""WITH RECURSIVE {BASE}, qs AS (SELECT * FROM q WHERE query_id IN (SELECT query_id FROM (SELECT query_id, unnest(refs) AS ref_id FROM q) SEMI JOIN p USING (ref_id))),
{bm25_sql('true', 'qs')}, r AS (SELECT * FROM bm25 WHERE rank <= 20),
sl AS (SELECT query_id, g, CASE WHEN len(a) > 0 THEN a ELSE b END AS l FROM (SELECT DISTINCT query_id, unnest(refs) AS g, {segments('quoted', 's')} AS a, {segments('marked', 's')} AS b FROM qs JOIN (SELECT DISTINCT ON (gen_id) gen_id AS query_id, supporting_materials AS s FROM generation) USING (query_id))),
sg AS (SELECT query_id || ':' || g || ':' || i AS segment_id, query_id, g, {terms_sql('l[i]', False)} AS t FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM sl)),
pg AS (SELECT item_id, ref_id AS g, {terms_sql('body', False)} AS t FROM p WHERE ref_id IS NOT NULL), {_pairs_sql()}, {_ALIGNED},
gp AS (SELECT DISTINCT query_id, item_id FROM covered JOIN sg USING (segment_id)),
x AS (SELECT qs.query_id, min(rank) FILTER (WHERE list_contains(refs, p.ref_id)) AS dr, min(rank) FILTER (WHERE gp.item_id IS NOT NULL) AS pr,
  coalesce(sum(ceil(len(list_filter(regexp_split_to_array(p.body, '[{T.SPACES}]+'), lambda w: w <> '')) * 1.3::DOUBLE)) FILTER (WHERE rank <= 5), 0) AS ctx
  FROM qs LEFT JOIN r USING (query_id) LEFT JOIN p USING (item_id) LEFT JOIN gp ON gp.query_id = qs.query_id AND gp.item_id = r.item_id GROUP BY qs.query_id),
y AS (SELECT x.*, x.query_id IN (SELECT query_id FROM gp) AS has FROM x)
SELECT count(*) AS questions, count(*) FILTER (WHERE has) AS passage_questions, {', '.join(f"round(avg(CASE WHEN dr <= {k} THEN 1.0::DOUBLE ELSE 0 END), 6) AS doc_recall_{k}" for k in (1, 5, 10, 20))},
  {', '.join(f"round(avg(CASE WHEN pr <= {k} THEN 1.0::DOUBLE ELSE 0 END) FILTER (WHERE has), 6) AS passage_recall_{k}" for k in (1, 5, 10, 20))}, round(avg(coalesce(1.0::DOUBLE / pr, 0)) FILTER (WHERE has), 6) AS passage_mrr, round(avg(ctx), 6) AS ctx_tokens_5 FROM y""",
    "doc_ranks": f"""WITH {BASE}, qs AS (SELECT * FROM q WHERE query_id IN (SELECT query_id FROM (SELECT query_id, unnest(refs) AS ref_id FROM q) SEMI JOIN p USING (ref_id))),
{bm25_sql('true', 'qs')}, r AS (SELECT * FROM bm25 WHERE rank <= 20)
SELECT qs.query_id, coalesce(min(rank) FILTER (WHERE list_contains(refs, p.ref_id)), 0) AS doc_rank,
  CAST(coalesce(sum(ceil(len(list_filter(regexp_split_to_array(p.body, '[{T.SPACES}]+'), lambda w: w <> '')) * 1.3::DOUBLE)) FILTER (WHERE rank <= 5), 0) AS BIGINT) AS ctx_tokens
FROM qs LEFT JOIN r USING (query_id) LEFT JOIN p USING (item_id) GROUP BY qs.query_id""",
}
