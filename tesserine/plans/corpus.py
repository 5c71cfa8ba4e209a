"""Queries of the operators that build a corpus, and their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserine.functions import text as T
from tesserine.operators import chunking, enrich, incremental, nested, ordered
from tesserine.plans import chunk_sql, strategies
from tesserine.plans.preparation import PLACED
from tesserine.runtime import load, once, stage, texts
from tesserine.sources import parsed
from tesserine.streaming.index import event_counts

MODEL = "wren-embed-small"
WS = f"[{T.SPACES}]+"


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once(texts(spark, sf_dir, "chunks"), "chunk_id")


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once(texts(spark, sf_dir, "blocks"), "block_id")


def approx_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number, median and largest size of chunks by kind."""
    sizes = load(spark, sf_dir, "chunks").select("chunk_id", "kind", T.approx_tokens(F.col("text")).alias("t")).distinct()
    return sizes.groupBy("kind").agg(F.count("*").alias("chunks"), F.median("t").alias("median_tokens"), F.max("t").cast("long").alias("max_tokens"))


def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentences of all documents."""
    found = texts(spark, sf_dir, "documents").select("doc_id", F.posexplode(chunking.sentences(F.col("text"))).alias("pos", "sentence"))
    return found.select("doc_id", F.col("pos").cast("long").alias("pos"), "sentence")


def fixed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sliding word windows over every document."""
    return chunking.text_windows(texts(spark, sf_dir, "documents"), "doc_id", "text")


def _lines(documents: DataFrame) -> DataFrame:
    """The lines of documents that are not blank, as blocks of one section."""
    lines = documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("block_no", "text"))
    return lines.where(F.size(T.words(F.col("text"))) > 0).select(
        F.col("doc_id").cast("string").alias("doc_id"), "block_no", F.lit("text").alias("kind"), "text", F.array(F.lit("all")).alias("heading_path")
    )


def packed_text(lines: DataFrame) -> DataFrame:
    """(doc_id, chunk_no, lines, tokens) of lines packed up to 400 tokens, in order; a line with parts in two chunks counts in both."""
    packed = chunking.packed(lines, chunking.HYBRID)
    return packed.groupBy(F.col("doc_id").cast("long").alias("doc_id"), "chunk_no").agg(F.countDistinct("block_no").alias("lines"), F.sum("size").alias("tokens"))


def packed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of every document packed up to 400 tokens, in order; lines of over 400 tokens fall into sentences, those into windows of words."""
    return packed_text(_lines(load(spark, sf_dir, "documents")))


def packed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """packed_documents of the documents without a line of over 400 tokens, which are those its SQL covers."""
    lines = _lines(load(spark, sf_dir, "documents"))
    over = lines.where(T.approx_tokens(F.col("text")) > chunking.HYBRID.limit).select("doc_id").distinct()
    return packed_text(lines.join(over, "doc_id", "left_anti"))


def section_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of neighbouring blocks with the same heading path."""
    found = ordered.runs(_blocks(spark, sf_dir).select("doc_id", "block_no", "heading_path"), ["doc_id"], "block_no", "heading_path", "section_no")
    return found.groupBy("doc_id", "section_no").agg(F.count("*").alias("blocks"))


def _titled(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = _blocks(spark, sf_dir)
    titles = load(spark, sf_dir, "corpus_metadata").select(enrich.stem(F.col("local_path")).alias("doc_id"), "title").groupBy("doc_id").agg(F.min("title").alias("title"))
    return blocks.join(titles, "doc_id", "left")


def hybrid_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All blocks packed section by section, with heading prefix."""
    return strategies.chunks(_titled(spark, sf_dir), "hybrid").select("chunk_id", "doc_id", "kind", "text", "embed_text", "heading_path", "pages", "source_refs")


def section_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All blocks as one chunk a section up to 1,200 tokens."""
    return strategies.chunks(_titled(spark, sf_dir), "section").select("chunk_id", "doc_id", "kind", "text", "embed_text", "pages")


def fixed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All blocks as sliding windows whatever their sections."""
    return strategies.chunks(_titled(spark, sf_dir), "fixed").select("chunk_id", "doc_id", "text", "pages")


def parsed_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest parse of every document as blocks in reading order."""
    return parsed.blocks(parsed.latest(texts(spark, sf_dir, "parsed_json"))).drop("metadata")


def parsed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From parsed documents to finished chunks with figure chunks made of the labels printed in figures."""
    blocks = parsed.blocks(parsed.latest(texts(spark, sf_dir, "parsed_json")), figure_text=parsed.labels_text)
    return strategies.chunks(stage(blocks, "blocks"), "hybrid_figlabels").select("chunk_id", "doc_id", "kind", "text", "embed_text", "pages")


def table_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cell rows of all tables as markdown lines, from the flat tables of the parsed records."""
    document = nested.document_nodes(texts(spark, sf_dir, "parsed_json"))
    cells = nested.attached(document).where("part = 'data.grid'")
    text = T.table_cell(F.col("fields")["text"])
    rows = cells.groupBy("record_id", "item_ref", "row").agg(F.array_sort(F.collect_list(F.struct("ordinal", text.alias("text")))).alias("c"))
    rows = rows.where(F.exists("c", lambda c: c["text"] != ""))
    line = T.table_line(F.transform("c", lambda c: c["text"]))
    return rows.select("record_id", "item_ref", F.col("row").cast("long").alias("row"), line.alias("line"))


def kept_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks by document, all and those outside dropped sections."""
    blocks = load(spark, sf_dir, "blocks").select("block_id", "doc_id", chunking.outside_sections(F.col("heading_path")).alias("kept")).distinct()
    return blocks.groupBy("doc_id").agg(F.count("*").alias("blocks"), F.count(F.when(F.col("kept"), 1)).alias("kept"))


def section_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many blocks lie below headings of each name."""
    each = load(spark, sf_dir, "blocks").select("block_id", F.explode("heading_path").alias("h")).where("h is not null").select("block_id", T.section_name(F.col("h")).alias("name"))
    return each.distinct().groupBy("name").agg(F.count("*").alias("blocks"))


def min_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of at least five tokens."""
    return load(spark, sf_dir, "blocks").where(chunking.at_least(F.col("text"))).select("block_id").distinct()


def heading_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chunk's text behind its title and heading path."""
    title = F.try_element_at(F.col("metadata"), F.lit("title"))
    text = enrich.heading_prefix(title, F.col("heading_path"), F.col("text"))
    return load(spark, sf_dir, "chunks").select("chunk_id", text.alias("embed_text")).distinct()


def dense_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New chunk ids, dense in every document, after the small chunks are left out."""
    rows = load(spark, sf_dir, "chunks").where(chunking.at_least(F.col("text"), 60)).select("doc_id", "chunk_id", F.element_at(F.split("chunk_id", "::"), -1).cast("int").alias("at")).distinct()
    rows = ordered.numbered(rows, ["doc_id"], "at", "pos")
    return rows.select("chunk_id", F.format_string("%s::kept::%04d", "doc_id", "pos").alias("new_id"))


def citation_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a vector index keeps of every chunk."""
    return enrich.citation_columns(_chunks(spark, sf_dir), MODEL)


def corpus_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chunk with the metadata of its paper."""
    return enrich.corpus_metadata(load(spark, sf_dir, "chunks").select("chunk_id", "doc_id").distinct(), load(spark, sf_dir, "corpus_metadata"))


def block_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every block with the kinds of the blocks around it."""
    found = ordered.neighbours(load(spark, sf_dir, "blocks").select("doc_id", "block_no", "block_id", "kind").distinct(), ["doc_id"], "block_no", 1, ["kind"])
    return found.select("block_id", F.array_join(F.transform("context", lambda c: c["kind"]), ",").alias("kinds"))


def embed_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hash of what is embedded of every chunk."""
    return incremental.hashed(load(spark, sf_dir, "chunks"), MODEL).select("chunk_id", "embed_hash")


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the index holds: a hash under the model a vector was made with."""
    v = load(spark, sf_dir, "chunk_vectors").where("embedding is not null").select("chunk_id", "model").distinct()
    text = F.coalesce(enrich.embedded_text(F.col("text"), F.col("embed_text")), F.lit(""))
    c = load(spark, sf_dir, "chunks").select("chunk_id", text.alias("t")).distinct()
    return v.join(c, "chunk_id").select("chunk_id", T.embed_hash(F.col("model"), F.col("t")).alias("embed_hash"))


def index_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an indexing run with one model would embed, skip and delete."""
    return incremental.index_stats(incremental.hashed(load(spark, sf_dir, "chunks"), MODEL).select("chunk_id", "embed_hash"), _stored(spark, sf_dir))


def changed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks it would embed."""
    return incremental.changed(incremental.hashed(load(spark, sf_dir, "chunks"), MODEL).select("chunk_id", "embed_hash"), _stored(spark, sf_dir)).select("chunk_id")


def fresh_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded hits without those of chunks that no longer exist, ranked anew."""
    hits = load(spark, sf_dir, "search_hits").select("query_id", "chunk_id", "hit_rank")
    return incremental.fresh_hits(hits, load(spark, sf_dir, "chunks")).select("query_id", "chunk_id", "hit_rank", F.col("rank").cast("long").alias("rank"))


def first_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of equal documents the first."""
    docs = load(spark, sf_dir, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("hash"))
    return docs.groupBy("hash").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


def kind_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks by kind, and in how many documents it is the most frequent one (the first by name of equal ones)."""
    each = load(spark, sf_dir, "blocks").select("block_id", "doc_id", "kind").distinct().groupBy("doc_id", "kind").agg(F.count("*").alias("n"))
    top = each.groupBy("doc_id").agg(F.min(F.struct((-F.col("n")).alias("m"), "kind")).alias("t")).groupBy(F.col("t.kind").alias("kind")).agg(F.count("*").alias("most_common_in"))
    return each.groupBy("kind").agg(F.sum("n").alias("blocks")).join(top, "kind", "left").fillna(0, ["most_common_in"])


def snapshot_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a snapshot of the index would hold."""
    keys = {"documents": "doc_id", "blocks": "block_id", "chunks": "chunk_id", "chunk_vectors": "vec_id", "parsed_json": "record_id"}
    counts = [load(spark, sf_dir, t).agg(F.lit(t).alias("part"), F.count_distinct(k).alias("keys"), F.count("*").alias("rows")) for t, k in keys.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


def version_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The version a paper's URL names against the first one its text names for it."""
    name, pinned = T.preprint(F.col("url"), r"\.example/abs/", "[0-9a-z]{6}")
    papers = load(spark, sf_dir, "corpus_metadata").select(F.col("id").alias("ref_id"), name.alias("name"), pinned.alias("pinned"))
    papers = papers.where("ref_id is not null").groupBy("ref_id").agg(F.max("name").alias("name"), F.max("pinned").alias("pinned"))
    named = load(spark, sf_dir, "generation").select(F.explode(F.regexp_extract_all("ref_url", F.lit(r"\.example/abs/([0-9a-z]{6}v[0-9]+)"), 1)).alias("u"))
    named = named.select(F.substring("u", 1, 6).alias("name"), F.substring("u", 7, 9).alias("stamp")).groupBy("name").agg(F.max("stamp").alias("stamp"))
    found = papers.join(named, "name", "left")
    check = T.version_check(F.coalesce("pinned", F.lit("")), F.coalesce("stamp", F.lit("")))
    return found.select("ref_id", check.alias("result"))


def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by hour and type."""
    out = event_counts(load(spark, sf_dir, "events"))
    return out.select(F.unix_timestamp("start").alias("start"), "event_type", "events", "value")


QUERIES = {
    f.__name__: f
    for f in (
        approx_tokens, sentence_split, fixed_windows, packed_documents, packed_lines, section_runs, hybrid_chunks, section_chunks, fixed_chunks, parsed_blocks, parsed_chunks, table_markdown,
        kept_sections, section_names, min_tokens, heading_prefix, dense_ids, citation_columns, corpus_join, block_context, embed_hashes, index_diff, changed_chunks, fresh_hits,
        first_texts, kind_counts, snapshot_counts, version_checks, event_windows,
    )
}

_CLASS = WS.replace("'", "''")


def words_sql(text: str) -> str:
    return f"list_filter(regexp_split_to_array({text}, '{_CLASS}'), lambda w: w <> '')"


def tokens_sql(text: str) -> str:
    return f"CAST(coalesce(ceil(len({words_sql(text)}) * 1.3::DOUBLE), 0) AS BIGINT)"


_SECTION = r"lower(regexp_replace(regexp_replace({h}, '^(?:[IVXLC]+|[A-Z]|[0-9]+(?:\.[0-9]+)*)\.?\s+', ''), '^[ :]+|[ :]+$', '', 'g'))"
_DROPPED = ", ".join(f"'{n}'" for n in chunking.DROPPED_SECTIONS)
_EMBEDDED = "coalesce(nullif(embed_text, ''), text)"
_STEM = r"regexp_replace(regexp_extract(local_path, '[^/]*$'), '(.)\.[^.]*$', '\1')"
_STORED = f"""stored AS (SELECT DISTINCT v.chunk_id, sha256(v.model || chr(10) || coalesce({_EMBEDDED}, '')) AS embed_hash
  FROM (SELECT DISTINCT chunk_id, model FROM chunk_vectors WHERE embedding IS NOT NULL) v JOIN (SELECT DISTINCT chunk_id, text, embed_text FROM chunks) c USING (chunk_id)),
now AS (SELECT DISTINCT chunk_id, sha256('{MODEL}' || chr(10) || coalesce({_EMBEDDED}, '')) AS embed_hash FROM chunks)"""

SQL = {
    **chunk_sql.SQL,
    "table_markdown": PLACED
    + f""", g AS (SELECT *, unnest(range(coalesce(json_array_length(x, '$.data.grid'), 0)::BIGINT)) AS row FROM n),
c AS (SELECT record_id, ref, row, k, replace(trim(regexp_replace(coalesce(json_extract_string(x, '$.data.grid[' || row || '][' || k || '].text'), ''), '{WS}', ' ', 'g')), '|', chr(92) || '|') AS t
  FROM (SELECT *, unnest(range(coalesce(json_array_length(x, '$.data.grid[' || row || ']'), 0)::BIGINT)) AS k FROM g))
SELECT record_id, ref AS item_ref, row, '| ' || string_agg(t, ' | ' ORDER BY k) || ' |' AS line FROM c GROUP BY ALL HAVING max(t) <> ''""",
    "approx_tokens": f"""SELECT kind, count(*) AS chunks, median(t)::DOUBLE AS median_tokens, max(t) AS max_tokens
FROM (SELECT DISTINCT chunk_id, kind, {tokens_sql('text')} AS t FROM chunks) GROUP BY kind""",
    "sentence_split": r"""SELECT doc_id, pos - 1 AS pos, s[pos] AS sentence FROM (
  SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS pos FROM (
    SELECT doc_id, list_filter(string_split(regexp_replace(text, '([.!?])\s+([A-Z0-9("''])', '\1' || chr(31) || '\2', 'g'), chr(31)), lambda x: x <> '') AS s FROM documents WHERE text IS NOT NULL))""",
    "fixed_windows": f"""SELECT doc_id, k::INTEGER AS window_no, len(list_slice(w, k * 192 + 1, k * 192 + 230))::INTEGER AS words, array_to_string(list_slice(w, k * 192 + 1, k * 192 + 230), ' ') AS text
FROM (SELECT doc_id, w, unnest(range(0, CAST(ceil(greatest(len(w) - 230, 0) / 192.0) AS BIGINT) + 1)) AS k FROM (SELECT doc_id, {words_sql('text')} AS w FROM documents) WHERE len(w) > 0)""",
    "packed_lines": f"""WITH RECURSIVE l AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n, {tokens_sql('line')} AS t FROM (
    SELECT doc_id, i, s[i] AS line FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents WHERE text IS NOT NULL)))
  WHERE len({words_sql('line')}) > 0),
over AS (SELECT DISTINCT doc_id FROM l WHERE t > 400),
f AS (
  SELECT doc_id, n, t, t AS held, 0 AS g FROM l WHERE n = 1
  UNION ALL SELECT l.doc_id, l.n, l.t, CASE WHEN f.held + l.t > 400 THEN l.t ELSE f.held + l.t END, f.g + CASE WHEN f.held + l.t > 400 THEN 1 ELSE 0 END
  FROM f JOIN l ON l.doc_id = f.doc_id AND l.n = f.n + 1),
g AS (SELECT doc_id, g, count(*) AS lines, sum(t) AS tokens, max(g) OVER (PARTITION BY doc_id) AS last FROM f WHERE doc_id NOT IN (SELECT doc_id FROM over) GROUP BY doc_id, g),
m AS (SELECT a.doc_id, a.last FROM g a JOIN g b ON a.doc_id = b.doc_id AND a.g = a.last AND b.g = a.last - 1 AND a.tokens < 50 AND a.tokens + b.tokens <= 450)
SELECT g.doc_id, CAST(CASE WHEN g.g = m.last THEN g.g - 1 ELSE g.g END AS INTEGER) AS chunk_no, CAST(sum(lines) AS BIGINT) AS lines, CAST(sum(tokens) AS BIGINT) AS tokens FROM g LEFT JOIN m USING (doc_id) GROUP BY ALL""",
    "section_runs": """SELECT doc_id, max(start) AS section_no, count(*) AS blocks FROM (
  SELECT doc_id, block_no, max(start) OVER (PARTITION BY doc_id ORDER BY block_no) AS start FROM (
    SELECT doc_id, block_no, CASE WHEN row_number() OVER w = 1 OR heading_path IS DISTINCT FROM lag(heading_path) OVER w THEN block_no END AS start
    FROM (SELECT DISTINCT ON (block_id) * FROM blocks) WINDOW w AS (PARTITION BY doc_id ORDER BY block_no))) GROUP BY doc_id, start""",
    "kept_sections": f"""SELECT doc_id, count(*) AS blocks, count(*) FILTER (WHERE kept) AS kept FROM (
  SELECT DISTINCT block_id, doc_id, len(list_filter(coalesce(heading_path, []), lambda h: {_SECTION.format(h='h')} IN ({_DROPPED}))) = 0 AS kept FROM blocks) GROUP BY doc_id""",
    "section_names": f"""SELECT name, count(*) AS blocks FROM (SELECT DISTINCT block_id, {_SECTION.format(h='h')} AS name FROM (SELECT block_id, unnest(heading_path) AS h FROM blocks) WHERE h IS NOT NULL) GROUP BY name""",
    "min_tokens": f"SELECT DISTINCT block_id FROM blocks WHERE {tokens_sql('text')} >= 5",
    "heading_prefix": """SELECT DISTINCT chunk_id, CASE WHEN len(p) > 0 THEN array_to_string(p, ' > ') || chr(10) || chr(10) || text ELSE text END AS embed_text FROM (
  SELECT chunk_id, text, list_concat(list_filter([metadata['title']], lambda t: t IS NOT NULL), coalesce(heading_path, [])) AS p FROM chunks)""",
    "dense_ids": f"""SELECT chunk_id, format('{{}}::kept::{{:04d}}', doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY place) - 1) AS new_id FROM (
  SELECT DISTINCT doc_id, chunk_id, CAST(split_part(chunk_id, '::', 3) AS INTEGER) AS place FROM chunks WHERE {tokens_sql('text')} >= 60)""",
    "citation_columns": f"""SELECT DISTINCT chunk_id, doc_id, kind, strategy, array_to_string(coalesce(heading_path, []), ' > ') AS heading_path, array_to_string(coalesce(pages, []), ',') AS pages,
  coalesce(pages[1], -1) AS page_start, sha256('{MODEL}' || chr(10) || {_EMBEDDED}) AS embed_hash,
  nullif(metadata['ref_id'], '') AS ref_id, nullif(metadata['title'], '') AS title, nullif(metadata['url'], '') AS url, nullif(metadata['year'], '') AS year FROM chunks""",
    "corpus_join": f"""WITH p AS (SELECT {_STEM} AS doc_id, arg_max({{'ref_id': nullif(id, ''), 'url': nullif(url, ''), 'year': nullif(year, ''), 'doc_type': nullif(type, ''), 'ref_title': nullif(title, '')}}, coalesce(id, '')) AS m
  FROM corpus_metadata WHERE coalesce(local_path, '') <> '' GROUP BY 1)
SELECT c.chunk_id, c.doc_id, m.ref_id, m.url, m.year, m.doc_type, m.ref_title FROM (SELECT DISTINCT chunk_id, doc_id FROM chunks) c LEFT JOIN p USING (doc_id)""",
    "block_context": """SELECT block_id, array_to_string(list_filter([lag(kind) OVER w, kind, lead(kind) OVER w], lambda k: k IS NOT NULL), ',') AS kinds
FROM (SELECT DISTINCT doc_id, block_no, block_id, kind FROM blocks) WINDOW w AS (PARTITION BY doc_id ORDER BY block_no)""",
    "embed_hashes": f"SELECT DISTINCT chunk_id, sha256('{MODEL}' || chr(10) || coalesce({_EMBEDDED}, '')) AS embed_hash FROM chunks",
    "index_diff": f"""WITH {_STORED}, b AS (SELECT n.embed_hash AS new, s.embed_hash AS old FROM now n FULL JOIN stored s USING (chunk_id))
SELECT count(*) FILTER (WHERE new IS NOT NULL AND new IS DISTINCT FROM old) AS embedded, count(*) FILTER (WHERE new = old) AS skipped, count(*) FILTER (WHERE new IS NULL) AS deleted,
  CAST(ceil(count(*) FILTER (WHERE new IS NOT NULL AND new IS DISTINCT FROM old) / 64.0) AS BIGINT) AS batches FROM b""",
    "changed_chunks": f"WITH {_STORED} SELECT chunk_id FROM now ANTI JOIN stored USING (chunk_id, embed_hash)",
    "fresh_hits": """SELECT query_id, chunk_id, hit_rank, row_number() OVER (PARTITION BY query_id ORDER BY hit_rank, chunk_id) AS rank
FROM (SELECT DISTINCT query_id, chunk_id, hit_rank FROM search_hits WHERE chunk_id IN (SELECT chunk_id FROM chunks))""",
    "first_texts": "SELECT sha256(coalesce(text, '')) AS hash, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1",
    "kind_counts": """WITH e AS (SELECT doc_id, kind, count(*) AS n FROM (SELECT DISTINCT block_id, doc_id, kind FROM blocks) GROUP BY ALL),
t AS (SELECT kind, count(*) AS m FROM (SELECT doc_id, kind FROM e QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, kind) = 1) GROUP BY kind)
SELECT e.kind, CAST(sum(n) AS BIGINT) AS blocks, coalesce(max(m), 0) AS most_common_in FROM e LEFT JOIN t USING (kind) GROUP BY e.kind""",
    "snapshot_counts": " UNION ALL ".join(
        f"SELECT '{t}' AS part, count(DISTINCT {k}) AS keys, count(*) AS rows FROM {t}"
        for t, k in (("documents", "doc_id"), ("blocks", "block_id"), ("chunks", "chunk_id"), ("chunk_vectors", "vec_id"), ("parsed_json", "record_id"))
    ),
    "version_checks": r"""WITH p AS (SELECT id AS ref_id, max(regexp_extract(url, '\.example/abs/([0-9a-z]{6})', 1)) AS name, max(regexp_extract(url, '\.example/abs/[0-9a-z]{6}(v[0-9]+)', 1)) AS pinned FROM corpus_metadata WHERE id IS NOT NULL GROUP BY id),
n AS (SELECT u[1:6] AS name, max(u[7:]) AS stamp FROM (SELECT unnest(regexp_extract_all(ref_url, '\.example/abs/([0-9a-z]{6}v[0-9]+)', 1)) AS u FROM generation) GROUP BY 1)
SELECT ref_id, CASE WHEN coalesce(pinned, '') = '' THEN 'unpinned' WHEN coalesce(stamp, '') = '' THEN 'no-stamp' WHEN pinned = stamp THEN 'match' ELSE 'mismatch ' || stamp END AS result FROM p LEFT JOIN n USING (name)""",
    "event_windows": "SELECT CAST(epoch(time_bucket(INTERVAL 1 HOUR, ts)) AS BIGINT) AS start, event_type, count(*) AS events, round(sum(value), 4) AS value FROM events GROUP BY ALL",
}
