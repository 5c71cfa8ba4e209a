"""Nested records, units and packed fields: behaviour on small fixtures, with nulls, empty tables, repeats and clashing columns."""

import json

import pytest

from tesserine.operators import nested, packed, units

DOC = {
    "name": "d",
    "body": {"self_ref": "#/body", "children": [{"$ref": "#/texts/0"}, {"$ref": "#/tables/0"}, {"$ref": "#/texts/0"}, {"$ref": "#/texts/9"}]},
    "texts": [{"self_ref": "#/texts/0", "children": None, "label": "text", "text": "a", "prov": [{"page_no": 1}, {"page_no": 2}]}],
    "tables": [{"self_ref": "#/tables/0", "captions": [{"$ref": "#/texts/0"}], "data": {"grid": [[{"text": "x"}, {"text": ""}], []]}}],
    "pictures": [],
}


def records(spark, rows):
    return spark.createDataFrame(rows, "record_id long, raw string, path string, dewey int")


def test_nested_links(spark):
    raw = json.dumps(DOC)
    rows = [(1, "﻿ \n" + raw, "p", 1), (1, "﻿ \n" + raw, "p", 1), (2, raw[:-5], "p", 1), (3, None, "p", 1), (4, "", None, 1), (5, raw + " x", "p", 1), (None, raw, "p", 1), (6, "no json", "p", 1)]
    document = nested.document_nodes(records(spark, rows))
    got = {tuple(r) for r in nested.links(document).collect()}
    assert got == {
        (1, "#/body", "#/texts/0", "children"), (1, "#/body", "#/tables/0", "children"), (1, "#/tables/0", "#/texts/0", "captions"),
        (1, "#/texts/0", "#/texts/0/prov/0", "prov"), (1, "#/texts/0", "#/texts/0/prov/1", "prov"),
        (1, "#/tables/0", "#/tables/0/data/grid/0/0", "cell"), (1, "#/tables/0", "#/tables/0/data/grid/0/1", "cell"),
    }


def test_nested_labels(spark):
    all_nodes = nested.nodes(records(spark, [(1, '{"a": [{"b": 1}, {"b": null, "c": [5, "x"]}]}', None, None)]), "record_id", "raw").collect()
    at = {tuple(r.dewey): r for r in all_nodes}
    assert len(at) == len(all_nodes)
    assert all(tuple(r.parent) == k[:-1] and (k == () or k[:-1] in at) for k, r in at.items())
    assert [r.path for _, r in sorted(at.items())] == ["", "a", "a[]", "a[]", "a[].c", "a[].c[]", "a[].c[]"]
    assert at[0, 1].fields == {"b": None} and at[0, 1, 1, 1].value == "x"


def test_nested_empty(spark):
    assert nested.links(nested.document_nodes(records(spark, []))).count() == 0


CATALOG = [("kWh", "kilowatt hour", "energy", "kWh", 1.0, 0.0), ("MWh", "megawatt hour", "energy", "kWh", 1000.0, 0.0), ("mL", "millilitre", "volume", "L", 0.001, 0.0), ("ML", "megalitre", "volume", "L", 1e6, 0.0),
           ("t", "metric ton", "mass", "kg", 1000.0, 0.0), ("kg", "kilogram", "mass", "kg", 1.0, 0.0), ("short ton", "US short ton", "mass", "kg", 907.18474, 0.0), ("K", "kelvin", "temperature", "degC", 1.0, -273.15),
           ("m3", "cubic metre", "volume", "L", 1000.0, 0.0), ("degC", "degree Celsius", "temperature", "degC", 1.0, 0.0)]


@pytest.mark.parametrize(
    ("value", "unit", "want"),
    [
        ("1,234.5 kWh", None, 1234.5), ("1.234.500", "kWh", 1234500.0), ("2 500", "MWh", 2.5e6), ("≈1.5k", "kWh", 1500.0), ("3 x 10^4", "kWh", 3e4), ("2.5e+03 KWH", "text", 2500.0),
        ("7 million", "thousand mL", 7e6), ("2", "ML", 2e6), ("2", "ml", 0.002), ("5", "kg CO₂e (thousands)", 5000.0), ("4 metric tons of CO2e", "kg", 4000.0), ("1", "US tons", 907.18474),
        ("300 K", None, 26.85), ("12", "m³", 12000.0), ("4.5 m3", None, 4500.0), ("-3", "°C", -3.0), ("0", "degC", 0.0),
        ("10-20", "kWh", None), ("10 to 20", "kWh", None), ("(1, 2)", "kWh", None), ("1,904 racks", "kWh", None), ("5", "text", None), ("5", None, None), (None, "kWh", None), ("", "kWh", None), ("is_blank", "kWh", None),
        ("x" * 50000, "kWh", None),
    ],
)
def test_amounts(spark, value, unit, want):
    row = (1, value, unit, 9.0, "x")
    rows = spark.createDataFrame([row, row, (None, *row[1:])], "gen_id long, v string, unit string, amount double, quantity string")
    catalog = spark.createDataFrame(CATALOG, "unit string, unit_name string, quantity string, common_unit string, factor double, shift double")
    got = units.amounts(rows, catalog, "gen_id", "v", "unit").collect()
    assert units.amounts(rows.limit(0), catalog, "gen_id", "v", "unit").isEmpty() if want == 0.0 else True
    assert [pytest.approx(r.amount) for r in got] == ([] if want is None else [want])


def test_same_amounts_match_brute_force(spark):
    import random

    rng = random.Random(3)
    rows = [(i, rng.choice("ab"), rng.choice("xy"), rng.choice([1.0, 1000.0, 3.0]) * rng.uniform(0.99, 1.01), rng.choice([0.0, -5.0, 5.0, 5.01, 5.024, 5.03, 5.1])) for i in range(300)]
    df = spark.createDataFrame(rows, "gen_id long, id string, quantity string, bare double, amount double")
    near = lambda p, q: abs(p - q) <= 0.005 * max(abs(p), abs(q))
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1:3] == b[1:3] and near(a[4], b[4]) and not near(a[3], b[3])}
    got = [tuple(r) for r in units.same_amounts(df, "gen_id", "id").collect()]
    assert set(got) == want and len(got) == len(want)


FIELDS = ("ref_id", "ref_url", "supporting_materials", "answer_value")
PACKED = [
    ("['a2020', 'b2021']", "https://x.example/a;v=1?id=2; https://x.example/b,c.pdf", "First sentence has five words. -- Second one, too; has a few.", "(7,039, 761)"),
    ("a2020;b2021 ;;", "https://x.example/a|b\nhttps://x.example/c", '"One ""quoted"" sentence of words.","Another sentence of some words"', "1,257"),
    ("a2020, b2021 & c2022", "https://x.example/a", "One sentence of five words, no more; none.", "Fen Yard | Kelp Row"),
    ("a2020 | b2021; c2022", None, "Only one sentence stands in this field", "10 to 20"),
    ("a2020\tb2021", "", "A first sentence of six words.\nA second sentence of six words.", '["Alder & Sons, Inc.", "Dune, Marsh and Co."]'),
    ("a2020", "https://x.example/a https://x.example/b", "Plain text of one sentence here.", "5 and 6 and 7.5"),
    ("['x\\'y2020', 'b2021']", "https://x.example/q", "Another sentence of five words.", "(436,485,92)"),
]
WANT = {
    ("ref_id", 0): ["a2020", "b2021"], ("ref_id", 1): ["a2020", "b2021"], ("ref_id", 2): ["a2020", "b2021", "c2022"], ("ref_id", 3): ["a2020", "b2021", "c2022"], ("ref_id", 4): ["a2020", "b2021"], ("ref_id", 5): ["a2020"],
    ("ref_id", 6): ["x'y2020", "b2021"], ("ref_url", 0): ["https://x.example/a;v=1?id=2", "https://x.example/b,c.pdf"], ("ref_url", 1): ["https://x.example/a|b", "https://x.example/c"],
    ("ref_url", 5): ["https://x.example/a", "https://x.example/b"], ("supporting_materials", 0): ["First sentence has five words.", "Second one, too; has a few."],
    ("supporting_materials", 1): ['One "quoted" sentence of words.', "Another sentence of some words"], ("supporting_materials", 2): ["One sentence of five words, no more; none."],
    ("answer_value", 0): ["7,039", "761"], ("answer_value", 1): ["1,257"], ("answer_value", 2): ["Fen Yard", "Kelp Row"], ("answer_value", 3): ["10 to 20"], ("answer_value", 4): ["Alder & Sons, Inc.", "Dune, Marsh and Co."],
    ("answer_value", 5): ["5", "6", "7.5"], ("answer_value", 6): ["436", "485", "92"],
}


def test_unpacked(spark):
    singles = [("c2020", "https://x.example/z", "A sentence that has no list in it.", v) for v in ("5", "Fen Yard", "7.5", "Kelp Row", "3,000", "12")]
    rows = [(i, *r, i) for i, r in enumerate(PACKED * 1 + singles * 2)]
    df = spark.createDataFrame(rows + rows[:2] + [(None, "a2020", None, None, None, 0)], "gen_id long, ref_id string, ref_url string, supporting_materials string, answer_value string, item int")
    got: dict = {}
    for r in packed.unpacked(df, "gen_id", FIELDS).orderBy("gen_id", "field", "pos").collect():
        got.setdefault((r.field, r.gen_id), []).append(r.item)
        assert r.pos == len(got[r.field, r.gen_id])
    for key, want in WANT.items():
        assert got[key] == want, key
    assert ("ref_url", 3) not in got and ("ref_url", 4) not in got


def test_unpacked_empty_and_long(spark):
    schema = "gen_id long, ref_id string, ref_url string, supporting_materials string, answer_value string"
    assert packed.unpacked(spark.createDataFrame([], schema), "gen_id", FIELDS).count() == 0
    long = ";".join(["a2020"] * 20000)
    df = spark.createDataFrame([(1, long, None, None, None), (2, "b2021", None, None, None)], schema)
    assert packed.unpacked(df, "gen_id", FIELDS).where("gen_id = 1").count() == 20000
