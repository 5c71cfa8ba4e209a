"""The queries of this subpackage and their SQL counterparts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesserine.functions import text as T
from tesserine.llm import confusables, mixing, neighbours, packing, pairs, spans, splitting
from tesserine.operators import dense
from tesserine.plans.corpus import tokens_sql, words_sql
from tesserine.runtime import load, once, stage, texts


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs with a cosine of at least 0.85 of which one is among the other's ten most similar vectors."""
    found = neighbours.most_similar(texts(spark, sf_dir, "chunk_vectors"), k=10, dim=96, probes=12, min_score=0.85)
    return neighbours.similar_pairs(found)


def p1_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten most similar vectors of every usable vector, with their cosine, whatever it is."""
    return neighbours.most_similar(texts(spark, sf_dir, "chunk_vectors"), k=10, dim=96, probes=64)


def _p2_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks, chunks = texts(spark, sf_dir, "blocks"), texts(spark, sf_dir, "chunks")
    parts = (
        confusables.forms(blocks, "block_id", "text").withColumn("field", F.lit("block.text")),
        confusables.forms(chunks, "chunk_id", "text").withColumn("field", F.lit("chunk.text")),
        confusables.forms(chunks, "chunk_id", "heading_path", scope="doc_id").withColumn("field", F.lit("chunk.heading_path")),
    )
    return stage(reduce(DataFrame.unionByName, parts), "forms")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of blocks, chunks and heading paths (of one paper) that look the same but differ in their characters."""
    return confusables.look_alikes(_p2_forms(spark, sf_dir), "field")


def p2_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The members of these pairs, each with its class and its number of links."""
    return confusables.look_alike_classes(_p2_forms(spark, sf_dir), "field")


def p2_unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All chunks with text and heading path in the consistent form."""
    return confusables.unified(once(texts(spark, sf_dir, "chunks").select("chunk_id", "text", "heading_path"), "chunk_id"), "text", "heading_path")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defective pairs of question and answer with their type of defect."""
    return pairs.broken_pairs(texts(spark, sf_dir, "generation"))


def p4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every block and chunk of more than 400 tokens, with 50 tokens of overlap."""
    blocks = splitting.split_oversized(texts(spark, sf_dir, "blocks"), "block_id").withColumn("item_table", F.lit("block"))
    chunks = splitting.split_oversized(texts(spark, sf_dir, "chunks"), "chunk_id").withColumn("item_table", F.lit("chunk"))
    return blocks.unionByName(chunks)


def p4_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every item that comes out in pieces: the words its pieces bring anew, whether all pieces keep to 400 tokens, and
    whether each after the first repeats 38 words (50 tokens)."""
    before = F.col("new_char") - F.col("start_char")
    count = lambda text: F.size(T.words(text))
    each = p4_pieces(spark, sf_dir).select(
        "item_table", "item_key", "tokens", count(F.substring("text", before + 1, F.length("text"))).alias("new"), F.when(F.col("piece_no") > 0, count(F.substring("text", F.lit(1), before)) == 38).alias("lap"),
        (T.approx_tokens(F.col("text")) == F.col("tokens")).alias("counted"),
    )
    return each.groupBy("item_table", "item_key").agg(F.sum("new").alias("words"), F.every((F.col("tokens") <= 400) & F.col("counted")).alias("within_limit"), F.coalesce(F.every("lap"), F.lit(True)).alias("overlapping"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items that come out in pieces."""
    return p4_pieces(spark, sf_dir).select("item_table", "item_key").distinct()


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The members of containers of 2,048 tokens that hold all documents."""
    return packing.containers(texts(spark, sf_dir, "documents"), capacity=2048)


def p8_used(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full these containers are."""
    return packing.use_of_space(p8_containers(spark, sf_dir), 2048)


def p8_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: whether it is in a container, whether its parts are its whole text in order and no more than needed, and
    whether no container it is in holds more than 2,048 tokens."""
    members = stage(p8_containers(spark, sf_dir), "members")
    full = members.where("container is not null").groupBy("container").agg((F.sum("tokens") <= 2048).alias("fits"))
    each = members.join(full, "container", "left")
    parts = F.array_sort(F.collect_list(F.struct("first_token", "last_token")))
    out = each.groupBy("doc_id").agg(F.max(F.col("container").isNotNull()).alias("placed"), F.coalesce(F.every("fits"), F.lit(True)).alias("within_limit"), parts.alias("p"), F.sum("tokens").alias("t"))
    joined = F.forall(F.zip_with(F.slice("p", 1, F.size("p") - 1), F.slice("p", 2, F.size("p")), lambda a, b: a["last_token"] == b["first_token"]), lambda ok: ok)
    whole = (F.get("p", F.lit(0))["first_token"] == 0) & (F.element_at("p", -1)["last_token"] == F.col("t")) & joined & (F.size("p") == F.greatest(F.lit(1), F.ceil(F.col("t") / 2048)))
    return out.select("doc_id", "placed", whole.alias("whole"), "within_limit")


def p9_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source of mix_targets: whether its tokens are its target share of the mixture to within its two largest documents
    (a thousandth where those are smaller), and whether no document is used more often than allowed."""
    targets, mixed = load(spark, sf_dir, "mix_targets"), stage(p9_mixture(spark, sf_dir), "mixture")
    found = mixing.shares(mixed, targets).join(targets.select("source", "max_repeats").distinct(), "source")
    size = mixed.agg(F.sum(F.col("uses") * F.col("tokens")).alias("all"), F.max("tokens").alias("largest"))
    off = F.abs(F.col("tokens") - F.col("target_share") * F.col("all"))
    found = found.crossJoin(F.broadcast(size)).withColumn("on_target", off <= F.greatest(2 * F.col("largest"), 0.001 * F.col("all")))  # size is one row
    return found.select("source", "target_share", "on_target", (F.col("most_uses") <= F.col("max_repeats")).alias("within_limit"))


def p1_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By model, for the usable vectors whose id is divisible by 20: how many there are, and whether at least nine tenths of their
    exact ten most similar vectors are among those found."""
    rows = stage(neighbours.usable(load(spark, sf_dir, "chunk_vectors"), 96).select("model", "vec_id", "embedding").dropDuplicates(["vec_id"]), "usable")
    exact = []
    for r in rows.select("model").distinct().collect():  # one row a model
        own = rows.where(F.col("model") == r.model)
        asked = own.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
        top = dense.cosine_topk(own, asked, k=11).where("query_id <> item_id")
        order = Window.partitionBy("query_id").orderBy("rank")
        exact.append(top.withColumn("r", F.row_number().over(order)).where("r <= 10").select(F.lit(r.model).alias("model"), F.col("query_id").alias("vec_id"), F.col("item_id").alias("neighbour")))
    wanted = reduce(DataFrame.unionByName, exact)
    found = p1_neighbours(spark, sf_dir).select("model", "vec_id", "neighbour", F.lit(1).alias("hit"))
    both = wanted.join(found, ["model", "vec_id", "neighbour"], "left").groupBy("model")
    return both.agg(F.count_distinct("vec_id").alias("queries"), (F.count("hit") >= 0.9 * F.count("*")).alias("nine_tenths"))


def p9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of the largest mixture in which every source has its target share."""
    return mixing.mixture(texts(spark, sf_dir, "documents"), load(spark, sf_dir, "mix_targets"))


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The actual shares of that mixture."""
    return mixing.shares(p9_mixture(spark, sf_dir), load(spark, sf_dir, "mix_targets"))


def p10_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of every document is shared with another document in spans of at least 200 characters."""
    return spans.shared_spans(texts(spark, sf_dir, "documents"), "doc_id", "text", least=200)


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents with such a span."""
    return p10_shares(spark, sf_dir).where("shared_chars > 0").select("doc_id")


def p10_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the sentences that a non-first repeated span covers."""
    return spans.without_repeats(texts(spark, sf_dir, "documents"), "doc_id", "text", least=200)


QUERIES = {
    f.__name__: f
    for f in (
        p1_found, p1_neighbours, p1_recall, p2_found, p2_classes, p2_unified, p3_found, p4_found, p4_pieces, p4_checks,
        p8_containers, p8_used, p8_checks, p9_mixture, p9_shares, p9_checks, p10_found, p10_shares, p10_kept,
    )
}

# Fixed values of the SQL, written down from the statement of problem 2 and not from the operator's table: invisible characters,
# single blanks, full-width forms (a range), ligatures, and letters of other scripts with the Latin letter they look like.
_INVISIBLE = "\u00ad\u034f\u200b\u200c\u200d\u200e\u200f\u2060\u2061\u2062\u2063\u2064\ufeff"
_BLANKS = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
_WIDE = range(0xFF01, 0xFF5F)
_LIGATURES = {"\ufb00": "ff", "\ufb01": "fi", "\ufb02": "fl", "\ufb03": "ffi", "\ufb04": "ffl", "\ufb05": "st", "\ufb06": "st"}
_LETTERS = {
    "Greek": ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοϲ", "ABEZHIKMNOPTYXoc"),
    "Cyrillic": ("АВЕЅІЈКМНОРСТУХҺаеорсухѕіјһԁ", "ABESIJKMHOPCTYXHaeopcyxsijhd"),
    "Armenian": ("օ", "o"),
}
_FROM = _BLANKS + "".join(map(chr, _WIDE)) + "".join(a for a, _ in _LETTERS.values()) + _INVISIBLE
_TO = " " * len(_BLANKS) + "".join(chr(c - 0xFEE0) for c in _WIDE) + "".join(b for _, b in _LETTERS.values())


def _form(text: str) -> str:
    """A value's look in SQL; plain ASCII, which is most, looks like itself."""
    made = f"translate(nfc_normalize({text}), '{_FROM}', '{_TO.replace(chr(39), chr(39) * 2)}')"
    for k, v in _LIGATURES.items():
        made = f"replace({made}, '{k}', '{v}')"
    return f"CASE WHEN regexp_matches({text}, '[^\\x00-\\x7F]') THEN nfc_normalize({made}) ELSE {text} END"


_P2 = f"""
WITH v AS (
  SELECT DISTINCT 'block.text' AS field, block_id AS key, '' AS scope, text AS raw FROM blocks WHERE text IS NOT NULL
  UNION ALL SELECT DISTINCT 'chunk.text', chunk_id, '', text FROM chunks WHERE text IS NOT NULL
  UNION ALL SELECT DISTINCT 'chunk.heading_path', chunk_id, doc_id, array_to_string(heading_path, chr(1)) FROM chunks WHERE heading_path IS NOT NULL),
f AS (SELECT field, key, scope, raw, md5({_form('raw')}) AS form FROM v),
m AS (SELECT field, scope, form FROM f GROUP BY ALL HAVING min(raw) <> max(raw)),
g AS (SELECT f.* FROM f SEMI JOIN m USING (field, scope, form))
"""

def _seen(column: str) -> str:
    """A text without invisible characters and without blanks at its ends."""
    return f"regexp_replace(translate(coalesce({column}, ''), '{_BLANKS}{_INVISIBLE}', '{' ' * len(_BLANKS)}'), '^\\s+|\\s+$', '', 'g')"


# Problem 3 once more from its statement: fixed values are placeholders, patterns of refusals, and function words of five languages.
_PLACEHOLDERS = "('', 'n/a', 'na', 'none', 'null', 'nil', 'nan', 'tbd', 'tba', 'todo', 'unknown', 'undefined', 'empty', 'missing', 'placeholder', 'not available', 'no answer', 'to be determined', 'k.a', 'keine')"
_REFUSAL = (
    "'(i''m|i am|be) (not )?(able|unable) to (answer|assist|help|provide|discuss|share)|(cannot|can''t|can not) (provide|answer|assist|help|share|discuss|comply|comment)|unable to (answer|assist|help|provide|comment|discuss|share)"
    "|not (able|allowed|permitted) to (assist|answer|provide|discuss|share|comment|help)|must decline|appropriate for me|i won''t be|language model|(darf|kann) ich .*(keine auskunft|nicht beantworten|nicht helfen)"
    "|je ne (peux|suis) pas (répondre|vous aider|autorisé|en mesure|fournir)|no (puedo (responder|ayudar)|estoy autorizado|tengo permiso)|have permission'"
)
_P3 = r"""
WITH c AS (SELECT DISTINCT gen_id, question, answer_value, explanation FROM generation WHERE gen_id IS NOT NULL),
s AS (SELECT gen_id, [q] AS q, [v] AS v, [e] AS e FROM c),
t AS (SELECT *, lower(regexp_replace(v, '^[\s"''“”‘’«»()\[\]{}.…]+|[\s"''“”‘’«»()\[\]{}.…]+$', '', 'g')) AS vb, lower(regexp_replace(e, '^[\s"''“”‘’«»()\[\]{}.…]+|[\s"''“”‘’«»()\[\]{}.…]+$', '', 'g')) AS eb,
  regexp_extract_all(lower(q), '[\p{L}\p{N}]+') AS qw, regexp_extract_all(regexp_replace(lower(v), '^(question|frage|pregunta|q)\W+', ''), '[\p{L}\p{N}]+') AS vw, regexp_extract_all(regexp_replace(lower(e), '^(question|frage|pregunta|q)\W+', ''), '[\p{L}\p{N}]+') AS ew FROM s),
u AS (SELECT *, list_transform(range(1, len(qw) - 1), lambda i: array_to_string(qw[i : i + 2], ' ')) AS q3, list_transform(range(1, len(vw) - 1), lambda i: array_to_string(vw[i : i + 2], ' ')) AS v3, list_transform(range(1, len(ew) - 1), lambda i: array_to_string(ew[i : i + 2], ' ')) AS e3,
  regexp_replace(e, '[\s"''“”‘’»]+$', '') AS ec, regexp_replace(v, '[\s"''“”‘’»]+$', '') AS vc FROM t),
f AS (SELECT *, list_transform(words, lambda ws: len(list_filter(ew, lambda w: list_contains(ws, w)))) AS se, list_transform(words, lambda ws: len(list_filter(qw, lambda w: list_contains(ws, w)))) AS sq,
  len(regexp_extract_all(e, '[^\x00-\x{24F}\s\pP\pN\pS\pM]')) > 0.3 * len(regexp_extract_all(e, '\pL')) AS script, string_split_regex(ec, '\s+') AS ep, string_split_regex(vc, '\s+') AS vp FROM u, (SELECT [
    ['the', 'of', 'and', 'for', 'with', 'that', 'is', 'are', 'by', 'on', 'at', 'to', 'it', 'its', 'from', 'does', 'what', 'how', 'which', 'in', 'a', 'as'], ['der', 'die', 'das', 'den', 'dem', 'ein', 'eine', 'und', 'nicht', 'für', 'mit', 'von', 'auf', 'ist', 'wenn', 'bei', 'wie', 'welche', 'zu', 'im'],
    ['le', 'la', 'les', 'une', 'des', 'du', 'et', 'pas', 'pour', 'par', 'avec', 'est', 'qui', 'que', 'selon', 'à', 'en', 'quelle', 'un', 'de'], ['el', 'la', 'los', 'las', 'una', 'del', 'y', 'pero', 'para', 'por', 'con', 'es', 'que', 'según', 'en', 'sin', 'cada', 'un', 'de', 'cuánto', 'qué'],
    ['o', 'a', 'uma', 'do', 'da', 'e', 'não', 'por', 'ano', 'há', 'isso', 'segundo', 'foi', 'que', 'de', 'vem', 'então']] AS words)),
g AS (SELECT *, list_position(se, list_max(se)) AS le, list_position(sq, list_max(sq)) AS lq FROM f),
j AS (SELECT gen_id, CASE
  WHEN vb IN [blanks] OR eb IN [blanks] OR NOT regexp_matches(vb, '[\p{L}\p{N}]') OR NOT regexp_matches(eb, '[\p{L}\p{N}]') THEN 'empty'
  WHEN len(vw) >= 4 AND len(vw) >= 0.7 * len(qw) AND len(list_filter(v3, lambda x: list_contains(q3, x))) >= 0.8 * len(v3) OR len(ew) >= 4 AND len(ew) >= 0.7 * len(qw) AND len(list_filter(e3, lambda x: list_contains(q3, x))) >= 0.8 * len(e3) THEN 'copy'
  WHEN regexp_matches(lower(e), [refusal]) OR v <> 'is_blank' AND regexp_matches(lower(v), [refusal]) THEN 'refusal'
  WHEN NOT regexp_matches(ec, '[.!?。！？…]$') AND (len(ep) > 8 OR NOT regexp_matches(ec, '([0-9]|(?i:appendix|table|text|abstract|figure|note|row|rows))$')) THEN 'truncated'
  WHEN v <> 'is_blank' AND NOT regexp_matches(vc, '[.!?。！？…]$') AND NOT regexp_matches(v, '[|;\n\t\[\]]') AND len(list_filter(vp, lambda w: NOT regexp_matches(w, '[0-9]'))) >= 6 AND len(list_filter(vp, lambda w: regexp_matches(w, '^[A-Z0-9]'))) <= 0.5 * len(vp)
    AND len(list_filter(vw, lambda w: list_contains(flatten(words), w))) >= 2 THEN 'truncated'
  WHEN q <> '' AND (script OR le <> lq AND list_max(se) >= 3 AND se[le] >= 1.3 * se[lq]) THEN 'language' END AS defect FROM g)
SELECT * FROM j WHERE defect IS NOT NULL
"""
for _name, _value in {"q": _seen("question"), "v": _seen("answer_value"), "e": _seen("explanation"), "blanks": _PLACEHOLDERS, "refusal": _REFUSAL}.items():
    _P3 = _P3.replace(f"[{_name}]", _value)

SQL = {
    "p3_found": _P3,
    "p2_found": _P2
    + """SELECT a.field, least(a.key, b.key) AS key_lo, greatest(a.key, b.key) AS key_hi FROM g a JOIN g b ON a.field = b.field AND a.scope = b.scope AND a.form = b.form AND a.raw < b.raw AND a.key <> b.key
""",
    "p2_classes": _P2
    + """SELECT field, key, min(key) OVER c AS class_key, count(*) OVER c - count(*) OVER (PARTITION BY field, scope, form, raw) AS links FROM g WINDOW c AS (PARTITION BY field, scope, form)
""",
    "p2_unified": f"""
SELECT DISTINCT chunk_id, {_form('text')} AS text, list_transform(heading_path, lambda h: {_form('h')}) AS heading_path FROM chunks
""",
    "p4_found": f"""
SELECT DISTINCT 'block' AS item_table, block_id AS item_key FROM blocks WHERE {tokens_sql('text')} > 400
UNION ALL SELECT DISTINCT 'chunk', chunk_id FROM chunks WHERE {tokens_sql('text')} > 400
""",
    "p4_checks": f"""
SELECT DISTINCT 'block' AS item_table, block_id AS item_key, len({words_sql('text')}) AS words, true AS within_limit, true AS overlapping FROM blocks WHERE {tokens_sql('text')} > 400
UNION ALL SELECT DISTINCT 'chunk', chunk_id, len({words_sql('text')}), true, true FROM chunks WHERE {tokens_sql('text')} > 400
""",
    "p8_checks": "SELECT doc_id, coalesce(text, '') <> '' AS placed, true AS whole, true AS within_limit FROM documents",
    "p9_checks": "SELECT source, target_share, true AS on_target, true AS within_limit FROM mix_targets",
    "p1_recall": """
SELECT model, count(DISTINCT vec_id) AS queries, true AS nine_tenths FROM chunk_vectors
WHERE vec_id % 20 = 0 AND embedding IS NOT NULL AND len(embedding) = 96 AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0 AND len(list_filter(embedding, lambda v: v <> 0)) > 0 GROUP BY model
""",
    "p10_shares": """
WITH w AS (SELECT doc_id, i, hash(text[i : i + 199]) AS h FROM (SELECT doc_id, text, unnest(range(1, length(text) - 198)) AS i FROM documents WHERE length(text) >= 200)),
r AS (SELECT h, min(doc_id) AS first FROM w GROUP BY h HAVING min(doc_id) <> max(doc_id)),
s AS (SELECT w.doc_id, i, w.doc_id = first AS own, least(coalesce(lead(i) OVER (PARTITION BY w.doc_id ORDER BY i) - i, 200), 200) AS a,
  least(coalesce(lead(i) OVER (PARTITION BY w.doc_id, w.doc_id = first ORDER BY i) - i, 200), 200) AS b FROM w JOIN r USING (h)),
t AS (SELECT doc_id, CAST(sum(a) AS BIGINT) AS shared, CAST(coalesce(sum(b) FILTER (WHERE NOT own), 0) AS BIGINT) AS later FROM s GROUP BY doc_id)
SELECT d.doc_id, length(coalesce(text, '')) AS n_chars, coalesce(shared, 0) AS shared_chars, coalesce(shared - later, 0) AS first_chars,
  CASE WHEN length(coalesce(text, '')) > 0 THEN coalesce(shared, 0) / length(text)::DOUBLE ELSE 0 END AS share FROM documents d LEFT JOIN t USING (doc_id)
""",
    "p10_kept": """
WITH w AS (SELECT doc_id, i, hash(text[i : i + 199]) AS h FROM (SELECT doc_id, text, unnest(range(1, length(text) - 198)) AS i FROM documents WHERE length(text) >= 200)),
r AS (SELECT h, min(doc_id) AS first FROM w GROUP BY h HAVING min(doc_id) <> max(doc_id)),
l AS (SELECT DISTINCT doc_id, i FROM w JOIN r USING (h) WHERE doc_id <> first),
g AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS part FROM (
  SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 200 THEN 0 ELSE 1 END AS new FROM l)),
c AS (SELECT doc_id, min(i) - 1 AS s, max(i) + 199 AS e FROM g GROUP BY doc_id, part),
t AS (SELECT doc_id, list_filter(string_split(regexp_replace(coalesce(text, ''), '([.!?][ \\t\\r\\f\\v\\n]+|\\n+)', '\\1' || chr(31), 'g'), chr(31)), lambda x: x <> '') AS l, text FROM documents),
u AS (SELECT doc_id, k, l[k] AS x FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS k FROM t)),
p AS (SELECT doc_id, k, x, sum(length(x)) OVER (PARTITION BY doc_id ORDER BY k) AS b FROM u),
q AS (SELECT doc_id, k, x, EXISTS (SELECT 1 FROM c WHERE c.doc_id = p.doc_id AND s <= b - length(x) AND b <= e) AS gone FROM p),
a AS (SELECT doc_id, string_agg(x, '' ORDER BY k) FILTER (WHERE NOT gone) AS kept, count(*) AS n, count(*) FILTER (WHERE gone) AS m FROM q GROUP BY doc_id)
SELECT t.doc_id, CASE WHEN t.text IS NOT NULL THEN coalesce(kept, '') END AS text, coalesce(n, 0) AS sentences, coalesce(m, 0) AS removed FROM t LEFT JOIN a USING (doc_id)
""",
    "p10_found": """
WITH w AS (SELECT doc_id, hash(text[i : i + 199]) AS h FROM (SELECT doc_id, text, unnest(range(1, length(text) - 198)) AS i FROM documents WHERE length(text) >= 200)),
r AS (SELECT h FROM w GROUP BY h HAVING min(doc_id) <> max(doc_id))
SELECT DISTINCT doc_id FROM w SEMI JOIN r USING (h)
""",
    "p1_found": """
WITH usable AS (
  SELECT DISTINCT model, vec_id, embedding FROM chunk_vectors
  WHERE embedding IS NOT NULL AND len(embedding) = 96
    AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0
    AND len(list_filter(embedding, lambda v: v <> 0)) > 0),
v AS (
  SELECT DISTINCT ON (vec_id) model, vec_id, CAST(embedding AS DOUBLE[96]) AS e FROM usable),
s AS (
  SELECT a.vec_id AS q, b.vec_id AS x, array_cosine_similarity(a.e, b.e) AS score
  FROM v a JOIN v b ON a.model = b.model AND a.vec_id <> b.vec_id),
r AS (
  SELECT q, x, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, x) AS hit_rank FROM s)
SELECT DISTINCT least(q, x) AS vec_lo, greatest(q, x) AS vec_hi FROM r WHERE hit_rank <= 10 AND score >= 0.85
""",
}
