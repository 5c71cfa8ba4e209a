"""Lexical and dense rankings, fusion, evidence, answers, errors and figures on small fixtures."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from tesserine.operators import answers, dense, errors, evaluate, evidence, figures, fusion, incremental, lexical


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_bm25(spark):
    p = frame(spark, [("a", "water water"), ("b", "water carbon"), ("c", "carbon " + "filler " * 30), ("d", None), ("e", "h100 4,096 tokens")], "item_id string, text string")
    q = frame(spark, [(1, "water"), (2, "carbon"), (3, "H100 with 4,096"), (4, "the"), (5, None)], "query_id long, query string")
    got = {}
    for r in lexical.bm25(p, q, 10).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.item_id)
    assert got == {1: ["a", "b"], 2: ["b", "c"], 3: ["e"]}
    only = lexical.bm25(p, q, 10, where=F.col("item_id") == "b").where("query_id = 1").first()
    every = lexical.bm25(p, q, 10).where("query_id = 1 and item_id = 'b'").first()
    assert only.score == every.score and only.rank == 1
    assert lexical.bm25(p.limit(0), q).count() == 0 and lexical.tfidf(p, q, 1).where("query_id = 1").first().item_id == "a"


RANKINGS = ["tfidf_topk", "rrf_sweep", "bm25_filtered", "doc_ranks", "bm25_topk", "table_expansion", "rerank_head", "second_hop", "rrf_depth", "rrf_weighted"]  # queries whose rankings must not move pairs


@pytest.mark.parametrize("name", RANKINGS)
def test_rankings_move_the_best_only(spark, monkeypatch, name):
    """What is ranked is k rows a query and task, not every pair of a query and a passage."""
    from tests.conftest import DATA
    from tesserine.plans import catalogue

    seen, ranked = [], lexical._ranked
    monkeypatch.setattr(lexical, "_ranked", lambda scored, k: seen.append((scored, k)) or ranked(scored, k))
    result = catalogue.QUERIES[name](spark, str(DATA))
    assert seen and result.columns[-1] in ("rank", "item_id", "ctx_tokens")
    for scored, k in seen:
        most = scored.groupBy("query_id", F.spark_partition_id()).count().agg(F.max("count")).first()[0]
        assert "Join" not in scored._jdf.queryExecution().executedPlan().toString() and 0 < most <= k


def test_rankings_in_blocks(spark, monkeypatch):
    """The rankings of blocks of passages and queries are those of all pairs, and no pairs are joined or summed up in Spark."""
    rng = random.Random(11)
    words = [f"w{i}" for i in range(12)]
    texts = {f"p{i:03}": rng.choices(words, weights=range(1, 13), k=rng.randint(0, 6)) for i in range(300)}
    asked = {q: rng.choices([*words, "absent"], k=4) for q in range(15)}
    p = frame(spark, [(i, " ".join(t)) for i, t in texts.items()], "item_id string, text string").repartition(3)
    q = frame(spark, [(i, " ".join(t)) for i, t in asked.items()], "query_id long, query string")
    monkeypatch.setattr(lexical, "BLOCK_ROWS", 40)
    monkeypatch.setattr(lexical, "QUERY_ROWS", 20)
    monkeypatch.setattr(lexical, "OUT_ROWS", 30)
    grams = lambda t: [*t, *(" ".join(x) for x in zip(t, t[1:]))]
    n, mean = len(texts), sum(map(len, texts.values())) / len(texts)
    df = lambda term: sum(term in grams(t) for t in texts.values())
    every = {term: df(term) for t in (*texts.values(), *asked.values()) for term in grams(t)}
    okapi = lambda a, b: sum(math.log1p((n - every[t] + 0.5) / (every[t] + 0.5)) * b.count(t) * 2.5 / (b.count(t) + 1.5 * (0.25 + 0.75 * len(b) / mean)) for t in a)
    vector = lambda t: {x: (1 + math.log(grams(t).count(x))) * (1 + math.log((1 + n) / (1 + every[x]))) for x in grams(t) if every[x]}

    def cos(a, b):
        x, y = vector(a), vector(b)
        return sum(x[t] * y[t] for t in x.keys() & y.keys()) / math.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values())) if x.keys() & y.keys() else 0

    for function, score in ((lexical.bm25, okapi), (lexical.tfidf, cos)):
        want = {(i, r): item for i, a in asked.items() for r, (_, item) in enumerate(sorted((-round(s, 6), item) for item, b in texts.items() for s in (score(a, b),) if s > 0)[:7], 1)}
        found = function(p, q, 7)
        assert {(r.query_id, r["rank"]): r.item_id for r in found.collect()} == want
        assert "Join" not in (plan := found._jdf.queryExecution().executedPlan().toString()) and "HashAggregate" not in plan
    found = lexical.tfidf(p, q, 7).collect()
    monkeypatch.setattr(lexical, "VOCABULARY", 0)
    assert sorted(lexical.tfidf(p, q, 7).collect()) == sorted(found)


def ranking(spark, lists):
    return [frame(spark, [(1, str(x), i + 1) for i, x in enumerate(items)], "query_id long, item_id string, rank int") for items in lists]


@pytest.mark.parametrize(("lists", "weights", "want"), [([[7, 3, 1], [3, 2, 9]], None, ["3", "7", "2", "1", "9"]), ([[1, 2], [2]], None, ["2", "1"]), ([[5], [6]], None, ["5", "6"]), ([[5, 6], [6, 5]], [1.0, 0.2], ["5", "6"])])
def test_rrf(spark, lists, weights, want):
    got = fusion.rrf(fusion.stacked(*ranking(spark, lists), weights=weights)).orderBy("rank").collect()
    assert [r.item_id for r in got] == want
    with pytest.raises(ValueError):
        fusion.stacked(*ranking(spark, lists), weights=[1.0] * 5)


def test_rerank(spark):
    base = ranking(spark, [[0, 1, 2, 3, 4]])[0]
    scores = frame(spark, [(1, str(i), float(s)) for i, s in enumerate([1, 5, 3, 9, 7])], "query_id long, item_id string, pair_score double")
    assert [r.item_id for r in fusion.reranked(base, scores, 3).orderBy("rank").collect()] == ["1", "2", "0", "3", "4"]


def test_cosine_topk(spark):
    rng = random.Random(5)
    vectors = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(200)] + [[0.0] * 8, [float("nan")] + [1.0] * 7, None, [1.0] * 3]
    df = frame(spark, [(i, v) for i, v in enumerate(vectors)] + [(3, vectors[3])], "vec_id long, embedding array<float>")
    got = {(r.query_id, r["rank"]): (r.item_id, r.score) for r in dense.cosine_topk(df, df.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), 5).collect()}
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))
    for q in range(0, 200, 20):
        want = sorted(range(200), key=lambda i: -cos(vectors[q], vectors[i]))[:5]
        assert [got[q, r + 1][0] for r in range(5)] == want
    pair = spark.range(1).select(dense.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0))).alias("c"), dense.cosine(F.array(F.lit(0.0)), F.array(F.lit(0.0))).alias("n")).first()
    assert pair.c == pytest.approx(2**-0.5) and pair.n is None
    v = spark.createDataFrame([("water water cooling",)], "t string").select(dense.hashed_embedding(F.col("t")).alias("v")).first().v
    assert len(v) == 64 and sum(x * x for x in v) == pytest.approx(1.0)


def test_coverage_matches_brute_force(spark):
    rng = random.Random(6)
    vocabulary = ["the", "of"] + [f"w{i}" for i in range(25)]
    seg = [(i, rng.choice("gh"), " ".join(rng.choices(vocabulary, k=rng.randint(1, 9)))) for i in range(25)]
    pas = [(i, rng.choice("gh"), " ".join(rng.choices(vocabulary, k=30))) for i in range(30)]
    pas += [(100 + s[0], s[1], "x " + s[2].upper() + "  y") for s in seg[:8]]
    s, p = frame(spark, [*seg, seg[0], (99, "g", None)], "segment_id long, group string, text string"), frame(spark, pas, "item_id long, group string, text string")
    bag = lambda a, b: sum(min(a.count(t), b.count(t)) for t in set(a))
    words = lambda t: t.lower().split()
    want = {(x[0], y[0]): bag(words(x[2]), words(y[2])) for x in seg for y in pas if x[1] == y[1] and bag(words(x[2]), words(y[2])) >= math.ceil(0.7 * len(words(x[2])) - 1e-9)}
    assert {(r.segment_id, r.item_id): r.shared for r in evidence.bag_coverage(s, p).collect()} == want
    exact = {(r.segment_id, r.item_id): r.coverage for r in evidence.coverage(s, p).collect()}
    assert all(exact[x[0], 100 + x[0]] == 1.0 for x in seg[:8]) and set(exact) <= set(want)


def test_coverage_in_tiles(spark, monkeypatch):
    """A group in tiles and groups in buckets give what all pairs give; pairs are not made by a join."""
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(9)]
    text = lambda most: " ".join(rng.choices(vocabulary, k=rng.randint(1, most)))
    seg = [(i, "hot" if i < 25 else f"g{i % 3}", text(80 if i % 4 == 0 else 9)) for i in range(40)]
    pas = [(f"p{i}", "hot" if i < 25 else f"g{i % 3}", text(60)) for i in range(40)]
    pas += [(f"c{i}", s[1], "x " + s[2] + " y") for i, s in enumerate(seg[:5])]
    monkeypatch.setattr(evidence, "TILE", (7, 9))
    monkeypatch.setattr(evidence, "SMALL", 4)
    monkeypatch.setattr(evidence, "OUT_ROWS", 3)
    s, p = frame(spark, [*seg, seg[0], (77, None, "w1")], "segment_id long, group string, text string"), frame(spark, [*pas, pas[0], ("n", None, "w1")], "item_id string, group string, text string")
    bag = lambda a, b: sum(min(a.count(t), b.count(t)) for t in set(a))
    pairs = [(x[0], y[0], x[2].split(), y[2].split()) for x in seg for y in pas if x[1] == y[1]]
    found = evidence.bag_coverage(s, p)
    assert sorted((r.segment_id, r.item_id, r.shared, r.words) for r in found.collect()) == sorted((i, j, bag(a, b), len(a)) for i, j, a, b in pairs if bag(a, b) >= math.ceil(0.7 * len(a) - 1e-9))
    assert "array_intersect" not in found._jdf.queryExecution().toString()
    want = sorted((i, j, c) for i, j, a, b in pairs for c in (evidence.in_order(a, b),) if c >= 0.7)
    assert sorted(tuple(r) for r in evidence.coverage(s, p).collect()) == want


def test_pairs_are_not_aligned_one_by_one(monkeypatch):
    """Bit rows give difflib's blocks, for segments and passages longer than a machine word too; no matcher goes through the pairs."""
    import numpy as np

    rng = random.Random(9)
    vocabulary = [f"r{i}" for i in range(150)] + ["the", "of", "a"] * 30
    pas = [rng.choices(vocabulary, k=rng.randint(1, 400)) for _ in range(60)]
    seg = [rng.choices(vocabulary, k=rng.randint(1, 25)) for _ in range(60)]
    seg += [[w for w in p[i : i + n] if rng.random() < 0.85] for p in pas for i, n in ((0, 90), (30, 12)) if len(p) > 60]
    want = {(i, j): c for i, s in enumerate(seg) for j, p in enumerate(pas) for c in (evidence.in_order(s, p),) if c >= 0.7}
    code = {w: i for i, w in enumerate(dict.fromkeys(vocabulary))}
    flat = lambda rows: (np.array([code[w] for r in rows for w in r]), np.cumsum([0, *map(len, rows)]))
    monkeypatch.setattr(evidence, "SequenceMatcher", None)
    for window, words, pairs in ((32, 1 << 20, 2_000_000), (3, 50, 40)):
        monkeypatch.setattr(evidence, "WINDOW", window)
        monkeypatch.setattr(evidence, "CLOSE_WORDS", words)
        monkeypatch.setattr(evidence, "PAIRS", pairs)
        got = {(i, j): c for part in evidence._covered(flat(seg), flat(pas), 0.7) for i, j, c in zip(*(v.tolist() for v in part))}
        assert got == want and len(got) > 90


def test_gold_items_of_a_ranking(spark):
    q = frame(spark, [(1, ["r", "s"]), (2, ["r"])], "query_id long, refs array<string>")
    chunks = frame(spark, [("a", "r"), ("b", "r"), ("c", "s"), ("d", None)], "item_id string, ref_id string")
    ranked = frame(spark, [(1, "c", 1), (1, "d", 2), (2, "c", 1), (2, "b", 2)], "query_id long, item_id string, rank int")
    assert sorted(tuple(r) for r in evaluate.gold_items(q, chunks, ranked).collect()) == [(1, "c"), (2, "b")]
    assert evaluate.gold_items(q, chunks).count() == 5
    texts = frame(spark, [("a", "x y"), ("b", "x"), ("c", "x y z")], "item_id string, body string")
    assert sorted(tuple(r) for r in evaluate.context_sizes(texts, ranked, 1).collect()) == [("c", 4)]


def test_metrics(spark):
    rows = frame(spark, [(1, 1, 2, True, 100), (2, 6, None, True, 50), (3, None, None, False, 0)], "query_id long, doc_rank int, passage_rank int, has_passage boolean, ctx_tokens long")
    m = evaluate.summary(rows).first()
    assert (m.doc_recall_1, m.doc_recall_10, m.passage_recall_1, m.passage_recall_5, m.passage_mrr, m.ctx_tokens_5) == (0.333333, 0.666667, 0.0, 0.5, 0.25, 50.0)
    assert evaluate.summary(rows.where("not has_passage")).first().passage_mrr is None


P = [{"chunk_id": "c1", "ref_id": "r1", "url": "u1", "text": "Water  use was\n5 litres."}, {"chunk_id": "c2", "ref_id": None, "url": "u", "text": "x"}]
Q = {"id": "q", "question": "Q?", "answer_unit": "L"}


def reply(**changes):
    return json.dumps({"answer": "a", "answer_value": "1,500", "explanation": "e", "evidence": [{"chunk_id": "c1", "quote": "use was 5 litres"}]} | changes)


def test_coverage_bound():
    rng = random.Random(3)
    for _ in range(300):
        a, b = (rng.choices("abcdef", k=rng.randint(0, 12)) for _ in range(2))
        exact = evidence.in_order(a, b)
        assert evidence.in_order(a, b, 0.7) in ((exact,) if exact >= 0.7 else (0.0, exact))


REPLIES = "id string, question string, answer_unit string, reply string, passages array<struct<chunk_id:string,ref_id:string,url:string,text:string>>"


def test_checked_answers(spark):
    bad = (reply(answer_value="nan"), reply(answer_value="1e999"), reply(evidence=[]), reply(evidence=[{"chunk_id": "no", "quote": "x"}]), reply(evidence=[{"chunk_id": "c1", "quote": "invented"}]), reply(evidence=[{"chunk_id": "c2", "quote": "x"}]),
           reply(answer=" "), reply(evidence="x"), reply(answer_value="is_blank"), "[]", "no", None, reply(evidence=[{"chunk_id": 1, "quote": "x"}]), reply(answer_value=5), reply(evidence=["c1"]), reply(evidence=[{"chunk_id": "c1", "quote": " "}]))
    good = [("q", "Q?", "L", reply(), P), ("blank", "Q?", "L", reply(answer_value="is_blank", evidence=[]), P), (None, "Q?", None, reply(answer_value="two", evidence=[{"chunk_id": "c1", "quote": " 5  litres. "}] * 2), P), ("none", "Q?", "L", reply(), None)]
    df = spark.createDataFrame([*good, *((f"bad {i}", "Q?", "L", b, P) for i, b in enumerate(bad))], REPLIES)
    got = {r.id: r for r in answers.validated(df).collect()}
    row = got["q"]
    assert row.error is None and row.answer_value == "1500" and row.ref_id == '["r1"]' and row.ref_url == '["u1"]' and row.supporting_materials == 'r1: "use was 5 litres"'
    assert got["blank"].error is None and got["blank"].ref_url == "is_blank"
    assert got[""].answer_value == "two" and got[""].ref_id == '["r1"]' and got[""].supporting_materials == 'r1: "5  litres."\nr1: "5  litres."' and got[""].answer_unit == ""
    assert got["none"].error == "a passage is cited that was not given"
    for i in range(len(bad)):
        assert got[f"bad {i}"].error and got[f"bad {i}"].answer_value is None and got[f"bad {i}"].question == "Q?", bad[i]
    assert answers.validated(df.limit(0)).count() == 0


TIDY = [("100,000", "100000"), ("10,00", "10,00"), ("1.3333333333333333", "1.33"), ("1234.5678912", "1230"), ("0.00000123", "0.00000123"), ("text", "text"), ("-0.123456789", "-0.123"), ("9.9999999", "10"), (None, None)]


def test_tidy_number(spark):
    df = spark.createDataFrame(TIDY, "value string, want string")
    assert [(r.value, r.got) for r in df.select("value", answers.tidy_number(F.col("value")).alias("got")).collect()] == TIDY


def test_export_and_tables(spark):
    q = frame(spark, [("1", "a", "u"), ("2", "b", "u"), ("3", "c", "u"), ("4", "d", "u")], "id string, question string, answer_unit string")
    good = ("a", "x", "v", "u", "r", "l", "s", "e")
    rows = [("1", *good), ("1", *good), ("2", "b", "x", "is_blank", "u", "r", "is_blank", "is_blank", "e"), ("3", "changed", *good[1:]), ("9", *good)]
    df = frame(spark, rows, "id string, question string, answer string, answer_value string, answer_unit string, ref_id string, ref_url string, supporting_materials string, explanation string")
    assert {tuple(r) for r in answers.export_problems(q, df).collect()} == {("1", "repeated id"), ("2", "abstention with evidence"), ("3", "changed input"), ("4", "missing id"), ("9", "unknown id")}
    runs = df.where("id <> '9'").withColumn("run_id", F.lit("b")).unionByName(df.where("id = '1'").distinct().withColumn("run_id", F.lit("a")))
    want = {("b", "1", "repeated id"), ("b", "2", "abstention with evidence"), ("b", "3", "changed input"), ("b", "4", "missing id"), *(("a", i, "missing id") for i in "234")}
    assert {tuple(r) for r in answers.export_problems(q, runs, "run_id").collect()} == want
    chunks = frame(spark, [("t1", "d", "Table 1: x | y"), ("t2", "d", "Table II x | y"), ("o1", "o", "Table 1 | z"), ("p", "d", "see table ii, Tab. 1 and Table 1"), ("n", "d", "Table 3 prose")], "item_id string, doc_id string, text string")
    found = answers.mentioned_tables(frame(spark, [(1, 1, "p")], "query_id long, rank int, item_id string"), chunks, 5).orderBy("added_no").collect()
    assert [r.item_id for r in found] == ["t2", "t1"]
    f = spark.createDataFrame([('{"queries": [" a ", "b", "a", 3, ""]}',), ("bad",), (None,)], "r string").select(answers.followup_queries(F.col("r"), 2).alias("q")).collect()
    assert [r.q for r in f] == [["a", "b"], [], []]


def test_buckets(spark):
    rows = [(True, True, True, 0.0, False, False, "correct_na"), (True, False, False, 0.0, False, False, "answered_unanswerable"), (False, False, True, 1.0, False, False, "correct"), (False, False, True, 0.5, False, True, "citation_off"),
            (False, True, False, 0.0, True, True, "abstain_had_evidence"), (False, True, False, 0.0, False, True, "abstain_gold_doc_only"), (False, True, False, 0.0, False, False, "abstain_no_gold_doc"),
            (False, False, False, 0.0, True, True, "wrong_had_evidence"), (False, False, False, 0.0, False, True, "wrong_gold_doc_only"), (False, False, False, 0.0, False, False, "wrong_no_gold_doc")]
    df = frame(spark, rows, "a boolean, b boolean, c boolean, d double, e boolean, f boolean, want string")
    assert all(r.got == r.want for r in df.select("want", errors.bucket(*[F.col(c) for c in "abcdef"]).alias("got")).collect())


def test_figures(spark):
    raw = [('```json\n{"kind": "Bar", "data": [{"x": 1, "y": 2}, {"z": "c"}], "legend": "a"}\n```',), ("nothing",), (None,), ('{"legend": ["a", "b"], "data": "| p |"}',), ("[1]",)]
    read = [r.r for r in spark.createDataFrame(raw, "t string").select(figures.reading(F.col("t")).alias("r")).collect()]
    assert read[0].data == "| x | y | z |\n| --- | --- | --- |\n| 1 | 2 |  |\n|  |  | c |" and read[0].legend == ["a"] and read[0].kind == "bar" and not read[0].parse_error
    assert read[1].parse_error and read[1].summary == "nothing" and read[2].summary == "" and read[3].legend == ["a", "b"] and read[3].data == "| p |" and read[3].kind == "unknown" and read[4].parse_error
    replies = [('{"kind": "line_chart", "title": "T", "legend": ["a", "b"], "data": "' + "\\n".join(map(str, range(85))) + '"}',), ('{"kind": "logo", "title": "x"}',), ('{"kind": "bar"}',)]
    got = [r.d for r in figures.readings(spark.createDataFrame(replies, "reply string")).select(figures.description(F.col("reading"), F.lit("Cap")).alias("d")).collect()]
    assert got[0].startswith("Figure (line chart)\nCap\nTitle: T\nLegend: a, b\nData:\n0\n") and got[0].endswith("79\n... (5 more rows)") and got[1] is None and got[2] == "Figure (bar)\nCap"
    df = spark.createDataFrame([("28.54", 28.5, True), ("28.4", 28.5, False), ("2007", 2007.0, True), ("2008", 2007.0, False), ("Fig. 5", 5.0, False), ("x", None, False)], "r string, g double, want boolean")
    assert all(r.got == r.want for r in df.select("want", figures.numbers_match(F.col("r"), F.col("g")).alias("got")).collect())
    cap = spark.createDataFrame([("Figure 3: x\nsee Figure 4\n  fig. 30 y",)], "t string").select(figures.caption_numbers(F.col("t")).alias("c")).first().c
    assert cap == ["3", "30"]


def test_embedder_contract(spark):
    rows = spark.createDataFrame([(i, f"text {i}") for i in range(35)], "n int, embed_text string").repartition(2)
    sizes = []

    def embed(texts):
        if len(texts) > 16:
            raise AssertionError(sizes)
        return [[float(len(t)), 1.0] for t in texts]

    assert {r.vector[0] for r in incremental.embedded(rows, embed, 2).collect()} == {6.0, 7.0}
    with pytest.raises(Exception, match="wrong vectors"):
        incremental.embedded(rows, lambda t: [[0.0, 0.0]] * len(t), 2).collect()
