"""Queries of the general data-preparation operators and their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserine.functions import text as T
from tesserine.operators import nested, packed, units
from tesserine.runtime import load, stage, texts

PACKED_FIELDS = ("ref_id", "ref_url", "supporting_materials", "answer_value")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every link from an item of a parsed record to its children, captions, footnotes, page positions and cells."""
    document = stage(nested.document_nodes(texts(spark, sf_dir, "parsed_json"), scalars=nested.LINK_FIELDS), "nodes")
    return nested.links(document)


def _label():
    """An item's Dewey label as text."""
    return F.array_join(F.col("item_dewey").cast("array<string>"), ".")


def p5_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items of all parsed records as a flat table."""
    return nested.items(nested.document_nodes(texts(spark, sf_dir, "parsed_json"))).withColumn("item_dewey", _label())


def p5_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page positions of all items as a flat table, each with the label of its item."""
    document = nested.document_nodes(texts(spark, sf_dir, "parsed_json"))
    parts = nested.attached(document).where("part = 'prov'")
    return parts.select("record_id", _label().alias("item_dewey"), "item_ref", F.col("ordinal").cast("long").alias("position"), F.col("fields")["page_no"].try_cast("int").alias("page_no"))


def p5_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells of all tables as a flat table, each with the label of its item."""
    document = nested.document_nodes(texts(spark, sf_dir, "parsed_json"))
    parts = nested.attached(document).where("part = 'data.grid'")
    return parts.select("record_id", _label().alias("item_dewey"), "item_ref", F.col("row").cast("long").alias("row"), F.col("ordinal").cast("long").alias("col"), F.coalesce(F.col("fields")["text"], "value").alias("text"))


def p6_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every single amount of the answers in the common unit of its quantity."""
    return units.amounts(texts(spark, sf_dir, "generation"), load(spark, sf_dir, "unit_catalog"), "gen_id", "answer_value", "answer_unit")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of answers to one question that give the same amount in different units or scales."""
    questions = load(spark, sf_dir, "generation").select("gen_id", "id").distinct()
    found = p6_amounts(spark, sf_dir).join(questions, "gen_id")
    return units.same_amounts(found, "gen_id", "id").select("gen_id_lo", "gen_id_hi")


def p7_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every value of the four packed fields with its position, single values included."""
    return packed.unpacked(texts(spark, sf_dir, "generation"), "gen_id", PACKED_FIELDS)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The values of those fields that hold two or more."""
    return p7_values(spark, sf_dir).where("n_values > 1").select("gen_id", "field", "pos", "item")


QUERIES = {f.__name__: f for f in (p5_found, p5_items, p5_positions, p5_cells, p6_found, p6_amounts, p7_found, p7_values)}

_ALIASES = ", ".join(f"('{u}', '{a.replace('|', ' ')}')" for u, forms in units.SPELLINGS.items() for a in forms.split())
_SPELL = (
    r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(translate({0}, '³²₂₃⁻    ', '3223-    '), "
    r"'(?i)\b(?:of )?(?:CO2(?:e|eq|-eq)?|carbon dioxide(?: equivalents?)?)\s*$', ''), '(?i)CO2(?:e|eq|-eq)?\s*$', ''), '\^3', '3', 'g'), '[\s.·⋅\-–/]+', '', 'g')"
)
_Q = {"scale": units.SCALE, "amount": units.AMOUNT.replace("'", "''"), "blank": units.BLANK}
_SCALES = ", ".join(f"('{k}', {v!r}::DOUBLE)" for k, v in units.SCALES.items())


def _scaled(column: str, i: int) -> str:
    u = f"trim(regexp_replace(coalesce({column}, ''), '{_Q['blank']}+', ' ', 'g'))"
    head, tail = f"^({_Q['scale']})(?: of)? (.+)$", f"^(.+?) ?\\(({_Q['scale']})\\)$"
    word = f"CASE WHEN regexp_matches({u}, '{head}') THEN regexp_extract({u}, '{head}', 1) ELSE regexp_extract({u}, '{tail}', 2) END"
    bare = f"CASE WHEN regexp_matches({u}, '{head}') THEN regexp_extract({u}, '{head}', 2) WHEN regexp_matches({u}, '{tail}') THEN regexp_extract({u}, '{tail}', 1) ELSE {u} END"
    return f"lower({word}) AS w{i}, {_SPELL.format('(' + bare + ')')} AS u{i}"


_AMOUNTS = f"""
WITH names AS (
  SELECT unit, unit AS name FROM unit_catalog UNION ALL SELECT unit, unit_name FROM unit_catalog
  UNION ALL SELECT u, a FROM (VALUES {_ALIASES}) AS forms(u, a) WHERE u IN (SELECT unit FROM unit_catalog)),
spelt AS (
  SELECT {_SPELL.format('name')} AS alias, unit FROM names
  UNION SELECT {_SPELL.format("(name || 's')")}, unit FROM names WHERE length(name) > 2),
known AS (
  SELECT alias, min(unit) AS unit FROM (SELECT alias, unit FROM spelt UNION SELECT lower(alias), unit FROM spelt WHERE length(alias) > 2)
  WHERE alias <> '' GROUP BY alias),
scales(word, scale) AS (VALUES {_SCALES}),
base AS (
  SELECT DISTINCT gen_id, answer_unit AS field,
    replace(replace(regexp_replace(translate(answer_value, '⁰¹²³⁴⁵⁶⁷⁸⁹⁻' || chr(8203) || chr(65279), '0123456789-'), '^{_Q['blank']}+|{_Q['blank']}+$', '', 'g'), '₂', '2'), 'm3', 'm³') AS v
  FROM generation WHERE gen_id IS NOT NULL),
parts AS (
  SELECT gen_id, field, regexp_extract(v, '{_Q['amount']}', ['number', 'p1', 'p2', 'word', 'rest']) AS p FROM base WHERE regexp_matches(v, '{_Q['amount']}')),
digits AS (
  SELECT gen_id, field, regexp_replace(translate(p.number, '−    ''’ ', '-'), '^\\+', '') AS t,
    coalesce(try_cast(regexp_replace(replace(p.p1 || p.p2, '−', '-'), '^\\+', '') AS INTEGER), 0) AS exponent, lower(p.word) AS w0, coalesce(p.rest, '') AS rest FROM parts),
parsed AS (
  SELECT gen_id, w0, rest <> '' AS has_text, {_scaled('rest', 1)}, {_scaled('field', 2)},
    try_cast(CASE WHEN regexp_matches(t, '^-?\\d{{1,3}}(,\\d{{3}})+(\\.\\d+)?$') THEN replace(t, ',', '')
      WHEN regexp_matches(t, '^-?\\d{{1,3}}(\\.\\d{{3}}){{2,}}(,\\d+)?$') OR regexp_matches(t, '^-?\\d{{1,3}}(\\.\\d{{3}})+,\\d+$') THEN replace(replace(t, '.', ''), ',', '.')
      ELSE replace(t, ',', '.') END AS DOUBLE) * pow(10.0::DOUBLE, exponent) AS bare FROM digits),
chosen AS (
  SELECT p.gen_id, p.bare, coalesce(s0.scale, 1) AS scale0,
    CASE WHEN has_text THEN coalesce(e1.unit, f1.unit) ELSE coalesce(e2.unit, f2.unit) END AS unit,
    CASE WHEN has_text THEN coalesce(s1.scale, 1) ELSE coalesce(s2.scale, 1) END AS scale1
  FROM parsed p LEFT JOIN scales s0 ON s0.word = p.w0 LEFT JOIN scales s1 ON s1.word = p.w1 LEFT JOIN scales s2 ON s2.word = p.w2
    LEFT JOIN known e1 ON e1.alias = p.u1 LEFT JOIN known f1 ON f1.alias = lower(p.u1)
    LEFT JOIN known e2 ON e2.alias = p.u2 LEFT JOIN known f2 ON f2.alias = lower(p.u2)),
amounts AS (
  SELECT gen_id, bare, scale0 * scale1 AS scale, c.unit, quantity, common_unit, bare * (scale0 * scale1) * factor + shift AS amount
  FROM chosen JOIN unit_catalog c USING (unit) WHERE bare IS NOT NULL)
"""

_ITEMS = """
WITH j AS (SELECT DISTINCT record_id, substr(raw, strpos(raw, '{')) AS r FROM parsed_json WHERE raw IS NOT NULL AND json_valid(substr(raw, strpos(raw, '{')))),
items AS (
  SELECT record_id, json_extract(r, '$.body') AS x FROM j WHERE json_type(r, '$.body') = 'OBJECT'
  UNION ALL SELECT record_id, unnest(json_extract(r, '$.texts[*]')) FROM j
  UNION ALL SELECT record_id, unnest(json_extract(r, '$.groups[*]')) FROM j
  UNION ALL SELECT record_id, unnest(json_extract(r, '$.tables[*]')) FROM j
  UNION ALL SELECT record_id, unnest(json_extract(r, '$.pictures[*]')) FROM j),
named AS (SELECT record_id, json_extract_string(x, '$.self_ref') AS ref, x FROM items),
refs AS (
  SELECT record_id, ref, link, json_extract_string(c, '$."$ref"') AS child FROM (
    SELECT record_id, ref, 'children' AS link, unnest(json_extract(x, '$.children[*]')) AS c FROM named
    UNION ALL SELECT record_id, ref, 'captions', unnest(json_extract(x, '$.captions[*]')) FROM named
    UNION ALL SELECT record_id, ref, 'footnotes', unnest(json_extract(x, '$.footnotes[*]')) FROM named)),
grid AS (SELECT record_id, ref, x, unnest(range(coalesce(json_array_length(x, '$.data.grid'), 0)::BIGINT)) AS i FROM named),
cells AS (SELECT record_id, ref, i, unnest(range(coalesce(json_array_length(x, '$.data.grid[' || i || ']'), 0)::BIGINT)) AS k FROM grid)
"""

PLACED = """
WITH j AS (SELECT DISTINCT record_id, substr(raw, strpos(raw, '{')) AS r FROM parsed_json WHERE raw IS NOT NULL AND json_valid(substr(raw, strpos(raw, '{')))),
i AS (SELECT record_id, 'body' AS collection, CAST(list_position(json_keys(r), 'body') - 1 AS VARCHAR) AS item_dewey, '#/body' AS place, json_extract(r, '$.body') AS x FROM j WHERE json_type(r, '$.body') = 'OBJECT'""" + "".join(
    f"""
  UNION ALL SELECT record_id, '{c}', (list_position(json_keys(r), '{c}') - 1) || '.' || k, '#/{c}/' || k, json_extract(r, '$.{c}[' || k || ']')
    FROM (SELECT *, unnest(range(coalesce(json_array_length(r, '$.{c}'), 0)::BIGINT)) AS k FROM j)"""
    for c in ("texts", "groups", "tables", "pictures")
) + """),
n AS (SELECT record_id, collection, item_dewey, coalesce(json_extract_string(x, '$.self_ref'), place) AS ref, x FROM i)
"""

# Problem 7 once more from its statement: JSON arrays, lists of quoted values, and for the rest what parts the values of each field.
_VALUES = r"""
WITH r AS (SELECT DISTINCT gen_id, ref_id, ref_url, supporting_materials, answer_value FROM generation WHERE gen_id IS NOT NULL),
l AS (SELECT gen_id, field, text FROM (UNPIVOT r ON ref_id, ref_url, supporting_materials, answer_value INTO NAME field VALUE text)),
t AS (SELECT DISTINCT gen_id, field, regexp_replace(translate(text, '[IN]', ''), '^[SP]+|[SP]+$', '', 'g') AS x FROM l),
b AS (SELECT *, json_valid(x) AND x[1] = '[' AS js, CASE WHEN regexp_matches(x, '^\[.*\]$', 's') OR regexp_matches(x, '^\([^)]*\)$', 's') OR regexp_matches(x, '^\([^)]*\(.*\)$', 's') OR regexp_matches(x, '^\{.*\}$', 's') THEN regexp_replace(x[2 : -2], '^\s+|\s+$', '', 'g') ELSE x END AS y FROM t),
q AS (SELECT *, regexp_matches(y, '^"([^"\\]|\\.|"")*"(\s*([,;|&/]|\|\||--|and|und|et|y)?\s*"([^"\\]|\\.|"")*")*[\s,;|]*$', 's') AS dq, regexp_matches(y, '^''([^''\\]|\\.|''[a-zA-Z])*''(\s*[,;|&/]\s*''([^''\\]|\\.|''[a-zA-Z])*'')*[\s,;|]*$', 's') AS sq,
   regexp_matches(y, '^“[^”]*”([\s,;|&/\-]*(?:and|und|et|y)?[\s,;|&/\-]*“[^”]*”)*[\s,;|]*$', 's') AS cq, regexp_matches(y, '^«[^»]*»([\s,;|&/\-]*(?:and|und|et|y)?[\s,;|&/\-]*«[^»]*»)*[\s,;|]*$', 's') AS gq FROM b),
p AS (SELECT gen_id, field, CASE
  WHEN js THEN list_transform(json_extract(x, '$[*]'), lambda e: json_extract_string(e, '$'))
  WHEN dq THEN list_transform(regexp_extract_all(y, '"((?:[^"\\]|\\.|"")*)"', 1), lambda e: replace(replace(e, '""', '"'), '\"', '"'))
  WHEN sq THEN list_transform(regexp_extract_all(y, '''((?:[^''\\]|\\.|''[a-zA-Z])*)''', 1), lambda e: replace(e, '\''', ''''))
  WHEN cq THEN regexp_extract_all(y, '“([^”]*)”', 1)
  WHEN gq THEN regexp_extract_all(y, '«([^»]*)»', 1)
  WHEN field = 'ref_url' THEN string_split(regexp_replace(y, '[\s|;,]+([a-z][a-z0-9+.\-]*://)', chr(31) || '\1', 'g'), chr(31))
  WHEN field = 'supporting_materials' THEN string_split_regex(y, '\s*(?:\n+|\|\|?|\s--\s)\s*')
  WHEN field = 'ref_id' THEN string_split_regex(y, '\s*(?:[\n\t|;/&,]+|,?\s(?:and|und|et|y)\s)\s*')
  WHEN regexp_matches(y, '^[+\-−~≈±]?[\d.,]+(\s(and|und|et|y)\s[\d.,]+)+$') THEN string_split_regex(y, '\s(?:and|und|et|y)\s')
  WHEN regexp_matches(y, '^[^,;|\n]*$') OR NOT regexp_matches(y, '[|;\n]') AND len(string_split_regex(y, '\s+')) >= 8 AND regexp_matches(y, '^[A-Z]') AND regexp_matches(y, '[.?!]$') THEN [y]
  WHEN regexp_matches(y, '^(ca\.|approx\.?|about|around|circa|~|≈|±)?\s*[+\-−]?\d{1,3}(,\d{3})+(\.\d+)?$') AND NOT regexp_matches(y, '^\d{1,3},\d{3}$') THEN [y]
  WHEN regexp_matches(y, '[|;\n]') THEN string_split_regex(y, '\s*[|;\n]+\s*')
  WHEN regexp_matches(y, '^[+\-−~≈±]?[0-9]+,[0-9]+$') AND y <> x AND NOT regexp_matches(y, '^[0-9]{1,3},[0-9]{3}$') THEN string_split(y, ',')
  WHEN regexp_matches(y, ',\s') THEN string_split_regex(regexp_replace(y, ',?\s(?:and|und|et|y)\s', ', ', 'g'), '\s*,\s+')
  WHEN regexp_matches(y, '^[^\d]*[\d,.+eE×*^\-−]+$') AND regexp_matches(y, '\d,\d') AND NOT regexp_matches(y, '^[+\-−~≈±]?\s*\d{1,3}(,\d{3})+(\.\d+)?$') AND regexp_matches(y, ',.*,|\..*,|,.*\.') THEN string_split(y, ',')
  ELSE [y] END AS v FROM q),
z AS (SELECT gen_id, field, list_filter(list_transform(v, lambda e: regexp_replace(regexp_replace(regexp_replace(e, '^\s+|\s+$', '', 'g'), '^"(.*)"$', '\1', 's'), '^“(.*)”$', '\1', 's')), lambda e: regexp_replace(e, '[ ;,|]', '', 'g') <> '') AS v FROM p)
""".replace("[IN]", "".join(packed.INVISIBLE)).replace("[SP]", f"[{T.SPACES}]")

SQL = {
    "p7_values": _VALUES + "SELECT gen_id, field, CAST(k AS INTEGER) AS pos, v[k] AS item, CAST(len(v) AS INTEGER) AS n_values FROM (SELECT *, unnest(range(1, len(v) + 1)) AS k FROM z)",
    "p7_found": _VALUES + "SELECT gen_id, field, CAST(k AS INTEGER) AS pos, v[k] AS item FROM (SELECT *, unnest(range(1, len(v) + 1)) AS k FROM z WHERE len(v) > 1)",
    "p5_items": PLACED
    + """SELECT record_id, item_dewey, collection, ref AS self_ref, json_extract_string(x, '$.label') AS label, json_extract_string(x, '$.content_layer') AS content_layer,
  json_extract_string(x, '$.name') AS name, json_extract_string(x, '$.text') AS text FROM n""",
    "p5_positions": PLACED
    + """SELECT record_id, item_dewey, ref AS item_ref, k AS position, CAST(json_extract_string(x, '$.prov[' || k || '].page_no') AS INTEGER) AS page_no
FROM (SELECT *, unnest(range(coalesce(json_array_length(x, '$.prov'), 0)::BIGINT)) AS k FROM n)""",
    "p5_cells": PLACED
    + """, g AS (SELECT *, unnest(range(coalesce(json_array_length(x, '$.data.grid'), 0)::BIGINT)) AS row FROM n)
SELECT record_id, item_dewey, ref AS item_ref, row, k AS col, json_extract_string(x, '$.data.grid[' || row || '][' || k || '].text') AS text
FROM (SELECT *, unnest(range(coalesce(json_array_length(x, '$.data.grid[' || row || ']'), 0)::BIGINT)) AS k FROM g)""",
    "p5_found": _ITEMS
    + """SELECT DISTINCT r.record_id, r.ref AS parent_ref, r.child AS child_ref, r.link FROM refs r SEMI JOIN named n ON n.record_id = r.record_id AND n.ref = r.child
UNION ALL SELECT DISTINCT record_id, ref, ref || '/prov/' || i, 'prov' FROM (SELECT record_id, ref, unnest(range(coalesce(json_array_length(x, '$.prov'), 0)::BIGINT)) AS i FROM named)
UNION ALL SELECT DISTINCT record_id, ref, ref || '/data/grid/' || i || '/' || k, 'cell' FROM cells""",
    "p6_amounts": _AMOUNTS + "SELECT gen_id, bare, scale, unit, quantity, common_unit, amount FROM amounts",
    "p6_found": _AMOUNTS
    + """, q AS (SELECT a.*, g.id FROM amounts a JOIN (SELECT DISTINCT gen_id, id FROM generation) g USING (gen_id) WHERE g.id IS NOT NULL)
SELECT x.gen_id AS gen_id_lo, y.gen_id AS gen_id_hi FROM q x JOIN q y ON x.id = y.id AND x.quantity = y.quantity AND x.gen_id < y.gen_id
WHERE abs(x.amount - y.amount) <= 0.005 * greatest(abs(x.amount), abs(y.amount)) AND abs(x.bare - y.bare) > 0.005 * greatest(abs(x.bare), abs(y.bare))""",
}
