"""SQL counterparts of the queries that turn parsed documents into blocks and blocks into chunks.

Packing, joining sentences and following references go step by step, so these are recursive queries; each step is written
from what the operators promise, not from how they do it.
"""

from __future__ import annotations

from tesserine.functions import text as T

CLASS = f"[{T.SPACES}]"
WS = f"{CLASS}+"
DROPPED = "'references', 'bibliography', 'citations and bibliography', 'contents', 'table of contents', 'list of figures', 'list of tables'"
SECTION = r"lower(regexp_replace(regexp_replace({h}, '^(?:[IVXLC]+|[A-Z]|[0-9]+(?:\.[0-9]+)*)\.?\s+', ''), '^[ :]+|[ :]+$', '', 'g'))"


def words(text: str) -> str:
    return f"list_filter(regexp_split_to_array({text}, '{WS}'), lambda w: w <> '')"


def tokens(text: str) -> str:
    return f"CAST(coalesce(ceil(len({words(text)}) * 1.3::DOUBLE), 0) AS BIGINT)"


def collapsed(text: str) -> str:
    return f"trim(regexp_replace({text}, '{WS}', ' ', 'g'))"


def stripped(text: str) -> str:
    return f"regexp_replace({text}, '^{WS}|{WS}$', '', 'g')"


BLOCKS = r"""ti AS (SELECT regexp_replace(regexp_extract(local_path, '[^/]*$'), '(.)\.[^.]*$', '\1') AS doc_id, min(title) AS title FROM corpus_metadata GROUP BY 1),
b AS (SELECT doc_id, block_no, coalesce(kind, 'text') AS kind, coalesce(text, '') AS text, heading_path, page, source_refs, title FROM (SELECT DISTINCT ON (block_id) * FROM blocks) LEFT JOIN ti USING (doc_id))"""
KEPT = f"kb AS (SELECT * FROM b WHERE len(list_filter(coalesce(heading_path, []), lambda h: {SECTION.format(h='h')} IN ({DROPPED}))) = 0)"


def numbered(limit: int, least: int, separate: bool) -> str:
    """The pieces `sz` of the blocks `b` and their chunks `al`, section by section."""
    most = int(limit / 1.3)
    figure = "kind = 'figure'" if separate else "false"
    table = "kind = 'table'" if separate else "false"
    return f"""{KEPT},
rn AS (SELECT *, max(s) OVER (PARTITION BY doc_id ORDER BY block_no) AS section_no FROM (
  SELECT *, CASE WHEN row_number() OVER w = 1 OR heading_path IS DISTINCT FROM lag(heading_path) OVER w THEN block_no END AS s FROM kb WINDOW w AS (PARTITION BY doc_id ORDER BY block_no))),
big AS (SELECT doc_id, block_no, string_split(regexp_replace(text, '([.!?]){WS}([A-Z0-9("''])', '\\1' || chr(31) || '\\2', 'g'), chr(31)) AS s FROM rn WHERE {tokens('text')} > {limit} AND kind NOT IN ('table', 'figure')),
se AS (SELECT doc_id, block_no, i, s[i] AS x, {words('s[i]')} AS w FROM (SELECT *, unnest(range(1, len(s) + 1)) AS i FROM big)),
un AS (SELECT doc_id, block_no, x, n, row_number() OVER (PARTITION BY doc_id, block_no ORDER BY i, j) AS k FROM (
  SELECT doc_id, block_no, i, 0 AS j, x, len(w) AS n FROM se WHERE ceil(len(w) * 1.3::DOUBLE) <= {limit}
  UNION ALL SELECT doc_id, block_no, i, j, array_to_string(list_slice(w, j * {most} + 1, (j + 1) * {most}), ' '), least(len(w) - j * {most}, {most})
    FROM (SELECT *, unnest(range(0, CAST(ceil(len(w) / {most}.0) AS BIGINT))) AS j FROM se WHERE ceil(len(w) * 1.3::DOUBLE) > {limit}))),
gr AS (
  SELECT doc_id, block_no, k, x, n AS held, 0 AS g FROM un WHERE k = 1
  UNION ALL SELECT u.doc_id, u.block_no, u.k, u.x, CASE WHEN ceil((gr.held + u.n) * 1.3::DOUBLE) > {limit} THEN u.n ELSE gr.held + u.n END, gr.g + CASE WHEN ceil((gr.held + u.n) * 1.3::DOUBLE) > {limit} THEN 1 ELSE 0 END
  FROM gr JOIN un u ON u.doc_id = gr.doc_id AND u.block_no = gr.block_no AND u.k = gr.k + 1),
pc AS (
  SELECT rn.* REPLACE (p.text AS text), p.g AS piece_no FROM (SELECT doc_id, block_no, g, {stripped("string_agg(x, ' ' ORDER BY k)")} AS text FROM gr GROUP BY ALL) p JOIN rn USING (doc_id, block_no)
  UNION ALL SELECT *, 0 FROM rn ANTI JOIN big USING (doc_id, block_no)),
sz AS (SELECT *, {tokens('text')} AS size, {figure} AS aside, {table} AS alone FROM pc),
sq AS (SELECT *, row_number() OVER (PARTITION BY doc_id, section_no ORDER BY block_no, piece_no) AS m FROM sz WHERE NOT aside),
fl AS (
  SELECT doc_id, section_no, block_no, piece_no, m, size AS total, alone, 0 AS g FROM sq WHERE m = 1
  UNION ALL SELECT s.doc_id, s.section_no, s.block_no, s.piece_no, s.m, CASE WHEN s.alone OR fl.alone OR fl.total + s.size > {limit} THEN s.size ELSE fl.total + s.size END, s.alone,
    fl.g + CASE WHEN s.alone OR fl.alone OR fl.total + s.size > {limit} THEN 1 ELSE 0 END
  FROM fl JOIN sq s ON s.doc_id = fl.doc_id AND s.section_no = fl.section_no AND s.m = fl.m + 1),
gs AS (SELECT doc_id, section_no, g, max(total) AS total, bool_or(alone) AS alone, max(g) OVER (PARTITION BY doc_id, section_no) AS last FROM fl GROUP BY doc_id, section_no, g),
mg AS (SELECT a.doc_id, a.section_no, a.g FROM gs a JOIN gs b ON a.doc_id = b.doc_id AND a.section_no = b.section_no AND b.g = a.g - 1
  WHERE a.g = a.last AND NOT a.alone AND NOT b.alone AND a.total < {least} AND a.total + b.total <= {limit + least}),
nu AS (
  SELECT doc_id, section_no, block_no, piece_no, CASE WHEN mg.g IS NOT NULL THEN fl.g - 1 ELSE fl.g END AS chunk_no FROM fl LEFT JOIN mg USING (doc_id, section_no, g)),
al AS (
  SELECT * FROM nu UNION ALL SELECT z.doc_id, z.section_no, z.block_no, z.piece_no, coalesce(t.n, 0) + row_number() OVER (PARTITION BY z.doc_id, z.section_no ORDER BY z.block_no, z.piece_no) - 1
  FROM sz z LEFT JOIN (SELECT doc_id, section_no, max(chunk_no) + 1 AS n FROM nu GROUP BY ALL) t USING (doc_id, section_no) WHERE z.aside)"""


def packed(strategy: str, limit: int, least: int, separate: bool, columns: str) -> str:
    """Chunks of the blocks `b`."""
    return f"""{numbered(limit, least, separate)},
jo AS (SELECT sz.*, al.chunk_no, CASE WHEN lag(kind) OVER w IS NULL THEN '' WHEN kind = 'list_item' AND lag(kind) OVER w = 'list_item' THEN chr(10) ELSE chr(10) || chr(10) END AS sep
  FROM sz JOIN al USING (doc_id, section_no, block_no, piece_no) WINDOW w AS (PARTITION BY doc_id, section_no, chunk_no ORDER BY block_no, piece_no)),
ch AS (SELECT doc_id, section_no, chunk_no, string_agg(sep || text, '' ORDER BY block_no, piece_no) AS text, arg_min(heading_path, block_no * 100000 + piece_no) AS heading_path,
    CASE WHEN bool_and(kind = 'table') THEN 'table' WHEN bool_and(kind = 'figure') THEN 'figure' ELSE 'text' END AS kind, coalesce(list_sort(list_distinct(list(page) FILTER (WHERE page IS NOT NULL))), []) AS pages,
    flatten(list(coalesce(source_refs, []) ORDER BY block_no, piece_no)) AS source_refs, min(title) AS title FROM jo GROUP BY doc_id, section_no, chunk_no),
ps AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY section_no, chunk_no) - 1 AS pos FROM ch WHERE {tokens('text')} >= 5),
tt AS (SELECT doc_id, min(title) AS title FROM b GROUP BY doc_id),
cf AS (SELECT format('{{}}::{strategy}::{{:04d}}', doc_id, pos) AS chunk_id, doc_id, kind, text, heading_path, pages, source_refs,
  array_to_string(list_concat(list_filter([tt.title], lambda t: t IS NOT NULL), coalesce(heading_path, [])), ' > ') AS above FROM ps JOIN tt USING (doc_id))
SELECT chunk_id, doc_id, kind, text, CASE WHEN above <> '' THEN above || chr(10) || chr(10) || text ELSE text END AS embed_text, {columns} FROM cf"""


FIXED = f"""WITH {BLOCKS}, {KEPT},
ww AS (SELECT doc_id, page, x, row_number() OVER (PARTITION BY doc_id ORDER BY block_no, i) - 1 AS nr FROM (SELECT doc_id, block_no, page, w[i] AS x, i FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM (SELECT doc_id, block_no, page, {words('text')} AS w FROM kb)))),
ln AS (SELECT doc_id, CAST(ceil(greatest(count(*) - 230, 0) / 192.0) AS BIGINT) AS last FROM ww GROUP BY doc_id),
ex AS (SELECT doc_id, page, x, nr, unnest(range(greatest(0, CAST(floor((nr - 230) / 192.0) AS BIGINT) + 1), least(last, CAST(floor(nr / 192.0) AS BIGINT)) + 1)) AS k FROM ww JOIN ln USING (doc_id)),
wi AS (SELECT doc_id, k, string_agg(x, ' ' ORDER BY nr) AS text, coalesce(list_sort(list_distinct(list(page) FILTER (WHERE page IS NOT NULL))), []) AS pages FROM ex GROUP BY doc_id, k)
SELECT format('{{}}::fixed::{{:04d}}', doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1) AS chunk_id, doc_id, text, pages FROM wi WHERE {tokens('text')} >= 5"""

_TOP = "'abstract', 'references', 'bibliography', 'acknowledgment', 'acknowledgments', 'acknowledgement', 'acknowledgements', 'appendix', 'appendices', 'executive summary', 'table of contents', 'contents', 'list of figures', 'list of tables', 'citations and bibliography'"
_ROMAN, _LETTER, _DECIMAL = r"^([IVXLC]+)\.\s+\S", r"^[A-Z]\.\s+\S", r"^(\d{1,2}(?:\.\d{1,2})*)\.?\s+\S"
_WORTH = "CASE {c} WHEN 'I' THEN 1 WHEN 'V' THEN 5 WHEN 'X' THEN 10 WHEN 'L' THEN 50 WHEN 'C' THEN 100 ELSE 0 END"
_VALUE = f"CAST(list_sum(list_transform(range(1, length(rm) + 1), lambda i: CASE WHEN {_WORTH.format(c='rm[i]')} < {_WORTH.format(c='rm[i + 1]')} THEN -1 ELSE 1 END * {_WORTH.format(c='rm[i]')})) AS BIGINT)"
_TEXTS = "array_to_string(list_filter(list_transform(json_extract_string(item, '$.{0}[*].\"$ref\"'), lambda f: json_extract_string(r, '$.texts[' || regexp_extract(f, '^[^/]*/texts/([0-9]+)$', 1) || '].text')), lambda t: t <> ''), chr(10) || chr(10))"


def read_blocks(figures: bool) -> str:
    """The blocks `pb` of the newest whole parse of every document; with figures those of labels printed in pictures too."""
    figure = f""" UNION ALL SELECT doc_id, label, 1000000, 'figure', 'Figure' || CASE WHEN cap <> '' THEN chr(10) || cap ELSE '' END || chr(10) || 'Text in figure: ' || left(array_to_string(ls, '; '), 1500), page, list_concat([self_ref], refs), false
  FROM (SELECT *, list_filter(list_distinct_ordered, lambda x: x <> '' AND NOT list_contains(own, x)) AS ls FROM pics) WHERE len(ls) >= 3""" if figures else ""
    return f"""wh AS (SELECT doc_id, record_id, parsed_at, substr(raw, strpos(raw, '{{')) AS r FROM parsed_json WHERE raw IS NOT NULL AND doc_id IS NOT NULL AND json_valid(substr(raw, strpos(raw, '{{')))),
nw AS (SELECT DISTINCT ON (doc_id) doc_id, r FROM wh ORDER BY doc_id, parsed_at DESC, record_id DESC),
wk AS (
  SELECT doc_id, [i] AS label, [] :: VARCHAR[] AS above, json_extract_string(r, '$.body.children[' || i || ']."$ref"') AS ref FROM (SELECT *, unnest(range(coalesce(json_array_length(r, '$.body.children'), 0)::BIGINT)) AS i FROM nw)
  UNION ALL SELECT doc_id, list_append(label, i), list_append(above, ref), json_extract_string(x, '$.children[' || i || ']."$ref"') FROM (
    SELECT *, unnest(range(coalesce(json_array_length(x, '$.children'), 0)::BIGINT)) AS i FROM (
      SELECT wk.*, json_extract(r, '$.' || regexp_extract(ref, '^[^/]*/(texts|groups)/[0-9]+$', 1) || '[' || regexp_extract(ref, '([0-9]+)$', 1) || ']') AS x FROM wk JOIN nw USING (doc_id)
      WHERE regexp_matches(ref, '^[^/]*/(texts|groups)/[0-9]+$') AND NOT list_contains(above, ref)) WHERE coalesce(nullif(json_extract_string(x, '$.content_layer'), ''), 'body') = 'body')),
it AS (SELECT *, json_extract_string(item, '$.self_ref') AS self_ref, CAST(json_extract_string(item, '$.prov[0].page_no') AS INTEGER) AS page FROM (
  SELECT doc_id, label, r, regexp_extract(ref, '^[^/]*/([a-z]+)/', 1) AS coll, json_extract(r, '$.' || regexp_extract(ref, '^[^/]*/([a-z]+)/', 1) || '[' || regexp_extract(ref, '([0-9]+)$', 1) || ']') AS item
  FROM wk JOIN nw USING (doc_id) WHERE regexp_matches(ref, '^[^/]*/(texts|tables|pictures)/[0-9]+$') AND NOT list_contains(above, ref))
  WHERE json_type(item) = 'OBJECT' AND coalesce(nullif(json_extract_string(item, '$.content_layer'), ''), 'body') = 'body'),
tx AS (SELECT doc_id, label, page, self_ref, coalesce(json_extract_string(item, '$.label'), '') AS lb, coalesce(json_extract_string(item, '$.text'), '') AS t FROM it WHERE coll = 'texts'),
gd AS (SELECT doc_id, label, row, string_agg(c, ' | ' ORDER BY k) AS line, count(*) AS n FROM (
    SELECT doc_id, label, row, k, replace({collapsed("coalesce(json_extract_string(item, '$.data.grid[' || row || '][' || k || '].text'), '')")}, '|', chr(92) || '|') AS c FROM (
      SELECT *, unnest(range(coalesce(json_array_length(item, '$.data.grid[' || row || ']'), 0)::BIGINT)) AS k FROM (SELECT *, unnest(range(coalesce(json_array_length(item, '$.data.grid'), 0)::BIGINT)) AS row FROM it WHERE coll = 'tables')))
  GROUP BY ALL HAVING max(c) <> ''),
md AS (SELECT doc_id, label, string_agg('| ' || line || ' |' || CASE WHEN nth = 1 THEN chr(10) || '|' || repeat(' --- |', n) ELSE '' END, chr(10) ORDER BY row) AS m FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, label ORDER BY row) AS nth FROM gd) GROUP BY ALL),
pr AS (SELECT doc_id, label, page, self_ref, j, json_extract(r, '$.texts[' || regexp_extract(ref, '^[^/]*/texts/([0-9]+)$', 1) || ']') AS c, part FROM (
    SELECT *, json_extract_string(item, '$.' || part || '[' || j || ']."$ref"') AS ref FROM (SELECT *, unnest(range(coalesce(json_array_length(item, '$.' || part), 0)::BIGINT)) AS j FROM it, (VALUES ('captions'), ('footnotes'), ('children')) AS parts(part)))
  WHERE regexp_matches(ref, '^[^/]*/texts/[0-9]+$')),
pp AS (SELECT doc_id, label, part, j, json_extract_string(c, '$.self_ref') AS ref, coalesce(json_extract_string(c, '$.text'), '') AS t, CAST(json_extract_string(c, '$.prov[0].page_no') AS INTEGER) AS page FROM pr WHERE json_type(c) = 'OBJECT'),
jn AS (SELECT doc_id, label, list(ref ORDER BY part, j) FILTER (WHERE part <> 'children' AND ref IS NOT NULL) AS refs, string_agg(t, chr(10) || chr(10) ORDER BY j) FILTER (WHERE part = 'captions' AND t <> '') AS ct, string_agg(t, chr(10) || chr(10) ORDER BY j) FILTER (WHERE part = 'footnotes' AND t <> '') AS nt,
    string_agg(trim(t), chr(10) ORDER BY j) FILTER (WHERE part = 'captions' AND trim(t) <> '') AS cap, list({collapsed('t')}) FILTER (WHERE part = 'captions' AND t <> '') AS own, list({collapsed('t')} ORDER BY j) FILTER (WHERE part = 'children') AS labels,
    list(ref ORDER BY j) FILTER (WHERE part = 'captions' AND ref IS NOT NULL) AS crefs FROM pp GROUP BY doc_id, label),
pics AS (SELECT it.doc_id, it.label, it.page, it.self_ref, coalesce(cap, '') AS cap, coalesce(own, []) AS own, coalesce(crefs, []) AS refs,
    list_filter(coalesce(labels, []), lambda x, i: list_position(labels, x) = i) AS list_distinct_ordered FROM it LEFT JOIN jn USING (doc_id, label) WHERE coll = 'pictures'),
li AS (
  SELECT doc_id, label, 0 AS sub, CASE WHEN lb IN ('section_header', 'title') THEN CASE WHEN regexp_matches(h, '(?i)^(table|figure|fig\\.) ') THEN 'caption' WHEN regexp_matches(h, '^[\\p{{L}}\\p{{N}}]') AND length(regexp_replace(h, '[^\\p{{L}}]', '', 'g')) >= 3 THEN 'heading' ELSE 'text' END
      WHEN lb IN ('list_item', 'caption', 'formula', 'code') THEN lb ELSE 'text' END AS kind,
    CASE WHEN lb IN ('section_header', 'title') THEN h WHEN lb = 'list_item' AND t <> '' THEN '- ' || t ELSE t END AS text, page, [self_ref] AS refs, true AS flow FROM (SELECT *, {collapsed('t')} AS h FROM tx WHERE lb NOT IN ('page_header', 'page_footer'))
  UNION ALL SELECT it.doc_id, it.label, 0, 'table', array_to_string(list_filter([ct, m, nt], lambda x: x <> ''), chr(10) || chr(10)), it.page, list_concat([self_ref], coalesce(refs, [])), false FROM it LEFT JOIN jn USING (doc_id, label) LEFT JOIN md USING (doc_id, label) WHERE coll = 'tables'
  UNION ALL SELECT pp.doc_id, pp.label, j, 'caption', t, pp.page, [pp.ref], false FROM pp JOIN it USING (doc_id, label) WHERE coll = 'pictures' AND part = 'captions'{figure}),
hd AS (SELECT doc_id, label, text AS h, page, row_number() OVER (PARTITION BY doc_id ORDER BY label) AS k, regexp_extract(text, '{_ROMAN}', 1) AS rm FROM li WHERE kind = 'heading'),
th AS (SELECT doc_id, h AS title, label FROM hd WHERE k = 1 AND (page = 1 OR page IS NULL) AND NOT regexp_matches(h, '{_ROMAN}') AND NOT regexp_matches(h, '{_LETTER}') AND NOT regexp_matches(h, '{_DECIMAL}') AND lower(h) NOT IN ({_TOP})),
hs AS (SELECT doc_id, label, h, CASE WHEN rm <> '' THEN {_VALUE} ELSE 0 END AS value, length(rm) AS signs, row_number() OVER (PARTITION BY doc_id ORDER BY label) AS k FROM hd ANTI JOIN th USING (doc_id, label)),
lv AS (
  SELECT doc_id, 0 :: BIGINT AS k, 0 :: BIGINT AS roman, 0 :: BIGINT AS depth, 0 :: BIGINT AS lev, [] :: STRUCT(l BIGINT, h VARCHAR)[] AS path FROM nw
  UNION ALL SELECT doc_id, k, roman, depth, lev, list_append(list_filter(path, lambda p: p.l < lev), {{'l': lev, 'h': h}}) FROM (
    SELECT *, CASE WHEN way IN (1, 2, 3) THEN depth ELSE CASE WHEN way = 4 THEN 1 ELSE old + 1 END END AS lev FROM (
      SELECT s.doc_id, s.k, s.h, lv.path, lv.depth AS old, way, CASE WHEN way = 1 THEN value ELSE lv.roman END AS roman,
        CASE way WHEN 1 THEN 1 WHEN 2 THEN CASE WHEN lv.roman > 0 THEN 2 ELSE 1 END WHEN 3 THEN len(string_split(regexp_extract(s.h, '{_DECIMAL}', 1), '.')) WHEN 4 THEN 0 ELSE lv.depth END AS depth
      FROM lv JOIN hs s ON s.doc_id = lv.doc_id AND s.k = lv.k + 1, LATERAL (SELECT CASE WHEN value > 0 AND (signs > 1 OR value = 1 OR value = lv.roman + 1) THEN 1 WHEN regexp_matches(s.h, '{_LETTER}') THEN 2
        WHEN regexp_matches(s.h, '{_DECIMAL}') THEN 3 WHEN regexp_matches(s.h, '(?i)^appendix\\b') OR trim(lower(s.h), ' :') IN ({_TOP}) THEN 4 ELSE 5 END AS way)))),
pa AS (SELECT hs.doc_id, hs.label, list_transform(path, lambda p: p.h) AS path FROM hs JOIN lv USING (doc_id, k)),
nb AS (SELECT li.doc_id, li.label, li.sub, li.kind, {stripped('li.text')} AS text, li.page, list_filter(li.refs, lambda x: x IS NOT NULL) AS source_refs, pa.path FROM li ASOF LEFT JOIN pa ON li.doc_id = pa.doc_id AND li.label >= pa.label WHERE li.kind <> 'heading' AND {stripped('li.text')} <> ''),
pb AS (SELECT nb.doc_id, coalesce(nullif(th.title, ''), nullif(json_extract_string(nw.r, '$.name'), ''), nb.doc_id) AS title, CAST(row_number() OVER (PARTITION BY nb.doc_id ORDER BY nb.label, nb.sub) - 1 AS INTEGER) AS block_no, kind, text, coalesce(path, []) AS heading_path, nb.page, source_refs
  FROM nb JOIN nw USING (doc_id) LEFT JOIN th ON th.doc_id = nb.doc_id)"""


SQL = {
    "hybrid_chunks": f"WITH RECURSIVE {BLOCKS}, {packed('hybrid', 400, 50, True, 'heading_path, pages, source_refs')}",
    "section_chunks": f"WITH RECURSIVE {BLOCKS}, {packed('section', 1200, 0, False, 'pages')}",
    "fixed_chunks": FIXED,
    "packed_documents": f"""WITH RECURSIVE b AS (SELECT doc_id, i - 1 AS block_no, 'text' AS kind, s[i] AS text, ['all'] AS heading_path, NULL AS page, NULL AS source_refs, NULL AS title
  FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents WHERE text IS NOT NULL)) WHERE len({words('s[i]')}) > 0), {numbered(400, 50, True)}
SELECT doc_id, CAST(chunk_no AS INTEGER) AS chunk_no, count(DISTINCT block_no) AS lines, CAST(sum(size) AS BIGINT) AS tokens FROM sz JOIN al USING (doc_id, section_no, block_no, piece_no) GROUP BY doc_id, chunk_no""",
    "parsed_blocks": f"WITH RECURSIVE {read_blocks(False)} SELECT * FROM pb",
    "parsed_chunks": f"WITH RECURSIVE {read_blocks(True)}, b AS (SELECT * FROM pb), {packed('hybrid_figlabels', 400, 50, True, 'pages')}",
}
