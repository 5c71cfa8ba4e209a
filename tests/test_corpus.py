"""Headings, blocks, chunks, order-dependent operators, metadata and incremental indexing on small fixtures."""

import itertools
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from tesserine.functions import text as T
from tesserine.operators import chunking, enrich, incremental, ordered
from tesserine.operators.headings import outline, roman
from tesserine.plans import corpus, strategies
from tesserine.sources import files, parsed


def test_heading_levels():
    *_, last = outline(["1 Scope", "2. Methods", "2.1 Meters", "2.1.1 Flow", "Loose  end", "3. Findings"])
    assert last == ["3. Findings"] and [roman(x) for x in ("XIV", "IX", "XLIX", "CXC", "III")] == [14, 9, 49, 190, 3]
    paths = list(outline(["I. Aims", "A. Sites", "Remarks", "B. Years", "II. Outcome", "C. Winter", "III. Outlook", "Bibliography :", "Appendix B"]))
    assert paths == [["I. Aims"], ["I. Aims", "A. Sites"], ["I. Aims", "A. Sites", "Remarks"], ["I. Aims", "B. Years"], ["II. Outcome"], ["II. Outcome", "C. Winter"], ["III. Outlook"], ["Bibliography :"], ["Appendix B"]]
    assert list(outline(["C. First", "D. Second", "Plain"])) == [["C. First"], ["D. Second"], ["D. Second", "Plain"]]  # C. without roman numbers before it is a letter


def test_document_blocks(spark):
    doc = {
        "name": "n", "body": {"children": [{"$ref": f"#/{r}"} for r in ("texts/0", "texts/1", "groups/0", "tables/0", "pictures/0", "texts/5", "texts/99", "bad")]},
        "texts": [
            {"self_ref": "#/texts/0", "label": "title", "text": "A  Title", "prov": [{"page_no": 1}]}, {"self_ref": "#/texts/1", "label": "section_header", "text": "1 Intro"},
            {"self_ref": "#/texts/2", "label": "list_item", "text": "one"}, {"self_ref": "#/texts/3", "label": "caption", "text": "Table 1: x"}, {"self_ref": "#/texts/4", "label": "page_header", "text": "skip"},
            {"self_ref": "#/texts/5", "label": "text", "text": "furniture", "content_layer": "furniture"}, *({"self_ref": f"#/texts/{6 + i}", "label": "text", "text": f"label {i}"} for i in range(3)),
        ],
        "groups": [{"self_ref": "#/groups/0", "children": [{"$ref": "#/texts/2"}, {"$ref": "#/texts/4"}]}],
        "tables": [{"self_ref": "#/tables/0", "captions": [{"$ref": "#/texts/3"}], "data": {"grid": [[{"text": "a|b"}, {"text": " c  d "}], [{"text": ""}], [None, {"text": "e"}]]}}],
        "pictures": [{"self_ref": "#/pictures/0", "children": [{"$ref": f"#/texts/{6 + i}"} for i in range(3)]}],
    }
    df = spark.createDataFrame([("d", json.dumps(doc))], "doc_id string, raw string")
    rows = parsed.blocks(df, figure_text=parsed.labels_text).orderBy("block_no").collect()
    assert {r.title for r in rows} == {"A Title"} and [r.block_no for r in rows] == [0, 1, 2]
    assert [(r.kind, r.text) for r in rows] == [
        ("list_item", "- one"), ("table", "Table 1: x\n\n| a\\|b | c d |\n| --- | --- |\n|  | e |"), ("figure", "Figure\nText in figure: label 0; label 1; label 2"),
    ]
    assert rows[0].heading_path == ["1 Intro"] and rows[1].source_refs == ["#/tables/0", "#/texts/3"] and rows[2].metadata == {"figure_index": "0"}


def test_repeated_and_circular_references(spark):
    doc = {
        "name": "n", "body": {"children": [{"$ref": "#/groups/0"}, {"$ref": "#/texts/0"}, {"$ref": "#/groups/1"}]},
        "texts": [{"self_ref": "#/texts/0", "label": "text", "text": "twice"}, {"self_ref": "#/texts/1", "label": "text", "text": "once"}],
        "groups": [{"self_ref": "#/groups/0", "children": [{"$ref": "#/texts/0"}, {"$ref": "#/texts/1"}]}, {"self_ref": "#/groups/1", "children": [{"$ref": "#/groups/1"}]}],
    }
    rows = parsed.blocks(spark.createDataFrame([("d", json.dumps(doc))], "doc_id string, raw string")).orderBy("block_no").collect()
    assert [r.text for r in rows] == ["twice", "once", "twice"]


def test_blocks_of_bad_records(spark):
    df = spark.createDataFrame([("a", None), ("b", "{"), ("c", "[]"), ("d", '{"body": null}'), (None, "{}")], "doc_id string, raw string")
    assert parsed.blocks(df).count() == 0


def brute_packing(sizes, kinds, how):
    groups, figures, current = [], [], []
    for i, (s, k) in enumerate(zip(sizes, kinds)):
        if how.separate and k == "figure":
            figures.append([i])
        elif how.separate and k == "table":
            groups += [current] * bool(current) + [[i]]
            current = []
        else:
            if current and sum(sizes[j] for j in current) + s > how.limit:
                groups, current = [*groups, current], []
            current.append(i)
    groups += [current] * bool(current)
    if len(groups) > 1:
        a, b = groups[-2:]
        atomic = lambda g: how.separate and kinds[g[0]] in ("table", "figure")
        ta, tb = (sum(sizes[i] for i in g) for g in (a, b))
        if not atomic(a) and not atomic(b) and tb < how.least and ta + tb <= how.limit + how.least:
            groups[-2:] = [a + b]
    return {i: n for n, g in enumerate(groups + figures) for i in g}


def test_packing_matches_brute_force():
    rng = random.Random(1)
    for how in (chunking.HYBRID, chunking.SECTION, chunking.Packing(100, 20)):
        for _ in range(300):
            n = rng.randint(0, 12)
            sizes, kinds = [rng.choice([1, 10, 45, 60, 150, 390, 700]) for _ in range(n)], [rng.choice(["text", "text", "list_item", "table", "figure"]) for _ in range(n)]
            assert dict(enumerate(chunking.packed_groups(kinds, sizes, how))) == brute_packing(sizes, kinds, how)


def blocks_frame(spark, rows):
    return spark.createDataFrame([(*r, ["#/x"], {"k": str(r[1])}, "Title") for r in rows], "doc_id string, block_no int, kind string, text string, heading_path array<string>, page int, source_refs array<string>, metadata map<string,string>, title string")


def test_hybrid_chunks(spark):
    words = lambda n, w="w": " ".join([w] * n)
    run_on = words(900)
    rows = [("d", 0, "list_item", "- a b c d e", ["S"], 1), ("d", 1, "list_item", "- f g h i j", ["S"], 2), ("d", 2, "table", words(500, "|"), ["S"], 2), ("d", 3, "text", run_on, ["S"], None),
            ("d", 4, "figure", words(9, "fig"), ["S"], 3), ("d", 5, "text", words(8), ["T"], 4), ("d", 6, "text", words(8, "x"), ["S"], 4), ("d", 7, "text", words(30), ["References"], 5), ("e", 0, "text", None, None, None)]
    got = strategies.chunks(blocks_frame(spark, rows), "hybrid").orderBy("chunk_id").collect()
    assert [r.chunk_id for r in got] == [f"d::hybrid::{i:04d}" for i in range(len(got))]
    assert got[0].text == "- a b c d e\n- f g h i j" and got[0].pages == [1, 2] and got[0].embed_text == "Title > S\n\n" + got[0].text and got[0].metadata == {"k": "1"}
    assert got[1].kind == "table" and len(got[1].text.split()) == 500
    text = [r for r in got if r.heading_path == ["S"] and r.kind == "text"]
    assert sum(r.text.count("w") for r in text) == 900 and all(math.ceil(1.3 * len(r.text.split())) <= 450 for r in text)
    assert [r.kind for r in got].index("figure") == [r.heading_path for r in got].index(["T"]) - 1  # after the text of its section run
    assert not any("References" in (r.heading_path or []) for r in got)
    plain = strategies.chunks(blocks_frame(spark, [r for r in rows if r[2] != "figure"]), "hybrid").collect()
    assert {r.text for r in plain} == {r.text for r in got if r.kind != "figure"}
    with pytest.raises(KeyError):
        strategies.chunks(blocks_frame(spark, rows), "none")


def test_fixed_chunks(spark):
    rng = random.Random(2)
    rows, words = [], []
    for i in range(40):
        own = [f"{i}.{j}" for j in range(rng.choice([0, 3, 50, 400]))]
        words += own
        rows.append(("d", i, "text", "  ".join(own), ["S", str(i)], i))
    got = strategies.chunks(blocks_frame(spark, rows), "fixed").orderBy("pos").collect()
    want = []
    for start in itertools.count(0, 192):
        want.append(" ".join(words[start : start + 230]))
        if start + 230 >= len(words):
            break
    assert [r.text for r in got] == want


def test_sentence_pieces():
    text = "One two three. Four five six! seven (Eight) nine? " + "w " * 40 + "end."
    pieces = chunking.sentence_pieces(text, 13)
    assert all(chunking.tokens_of(len(p.split())) <= 13 for p in pieces) and " ".join(pieces).split() == text.split()
    assert chunking.sentence_pieces("", 10) == []


def test_ordered_operators_cross_buckets(spark):
    rng = random.Random(4)
    rows = [(k, i, rng.choice("ab") if i % 7 else None) for k in ("hot", "x") for i in range(60 if k == "hot" else 5)]
    df = spark.createDataFrame(rows, "k string, n int, v string")
    got = {(r.k, r.n): (r.run, r.no) for r in ordered.numbered(ordered.runs(df, ["k"], "n", "v", "run", bucket=8), ["k"], "n", "no", bucket=8).collect()}
    for k in ("hot", "x"):
        start, last = 0, ()
        for i, (_, n, v) in enumerate(r for r in rows if r[0] == k):
            if (v,) != last:
                start, last = n, (v,)
            assert got[k, n] == (start, i)
    near = {(r.k, r.n): [c.n for c in r.context] for r in ordered.neighbours(df, ["k"], "n", 2, ["n"]).collect()}
    assert near["hot", 0] == [0, 1, 2] and near["hot", 30] == [28, 29, 30, 31, 32]


def test_metadata(spark):
    chunks = spark.createDataFrame([("c1", "p_1.v2", None), ("c2", "none", None)], "chunk_id string, doc_id string, url string").drop("url")
    corpus = spark.createDataFrame([("r1", "paper", "T", "2020", "", "a/b/p_1.v2.pdf"), ("r2", "", "T2", None, "u", "p_1.v2.pdf"), ("r3", "x", "y", "z", "u", None)], "id string, type string, title string, year string, url string, local_path string")
    got = {r.chunk_id: r for r in enrich.corpus_metadata(chunks, corpus).collect()}
    assert got["c1"].ref_id == "r2" and got["c1"].url == "u" and got["c1"].doc_type is None and got["c2"].ref_id is None


def test_incremental(spark):
    now = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "chunk_id string, embed_hash string")
    old = spark.createDataFrame([("a", "1"), ("b", "0"), ("z", "9")], "chunk_id string, embed_hash string")
    assert {r.chunk_id for r in incremental.changed(now, old).collect()} == {"b", "c"} and [r.chunk_id for r in incremental.stale(now, old).collect()] == ["z"]
    assert tuple(incremental.index_stats(now, old).first()) == (2, 1, 1, 1)
    after = incremental.updated(old, incremental.changed(now, old), now)
    assert tuple(incremental.index_stats(now, after).first()) == (0, 3, 0, 0)


def test_stream_indexes_once(spark, tmp_path):
    from tesserine.streaming.index import index_stream

    source, index, check = (str(tmp_path / d) for d in ("in", "index", "check"))
    (tmp_path / "in").mkdir()
    make = lambda rows: [json.dumps({"chunk_id": c, "text": t, "embed_text": t}) for c, t in rows]
    run = lambda: index_stream(spark, source, index, check, "m", lambda df: df.withColumn("vector", F.array(F.length("embed_text").cast("float")))).awaitTermination()
    (tmp_path / "in" / "1.json").write_text("\n".join(make([("a", "x"), ("b", "yy")])))
    run()
    (tmp_path / "in" / "2.json").write_text("\n".join(make([("a", "x"), ("b", "changed"), ("c", "z")])))
    run()
    rows = spark.read.parquet(index)
    assert rows.count() == 4 and {(r.chunk_id, r.vector[0]) for r in incremental.latest(rows, "batch").collect()} == {("a", 1.0), ("b", 7.0), ("c", 1.0)}
    run()
    assert spark.read.parquet(index).count() == 4


def test_files(spark, tmp_path):
    (tmp_path / "q.csv").write_text('﻿id,question,answer_unit,answer_value\n1,"a ""b"",\nc",kWh,5\n2,d,,6\n', encoding="utf-8")
    got = files.read_questions(spark, str(tmp_path / "q.csv")).orderBy("id").collect()
    assert [tuple(r) for r in got] == [("1", 'a "b",\nc', "kWh"), ("2", "d", "")]
    (tmp_path / "bad.csv").write_text("id,question,answer_unit\n1,a,\n1,b,\n")
    with pytest.raises(ValueError, match="repeat"):
        files.read_questions(spark, str(tmp_path / "bad.csv"))
    (tmp_path / "no.csv").write_text("id,question\n1,a\n")
    with pytest.raises(ValueError, match="lacks"):
        files.read_questions(spark, str(tmp_path / "no.csv"))
    chunks = spark.createDataFrame([("c", "d", "s", "text", "t", "", ["h"], [1], ["#"], {"k": "v"})], files.CHUNKS)
    files.write_chunks(chunks, str(tmp_path / "c.jsonl"))
    back = files.read_any(spark, str(tmp_path / "c.jsonl")).first()
    assert back.embed_text == "t" and back.metadata == {"k": "v"}
    with pytest.raises(ValueError, match="no loader"):
        files.read_any(spark, "x.pdf")


def test_text_functions(spark):
    one = lambda c, **v: spark.range(1).select(*[F.lit(x).alias(k) for k, x in v.items()]).select(c).first()[0]
    t = F.col("t")
    assert one(T.approx_tokens(t), t="a b c d e") == 7 and one(T.approx_tokens(t), t="") == 0
    assert one(T.numbers_in(t), t="1,234.5 and 2010-2014, x7") == [-2014.0, 7.0, 1234.5, 2010.0]
    assert one(T.reply_numbers(t), t="\n \nFig. 8 shows 28.54, Figure 2(d)\n99") == [28.54]
    assert one(T.figure_numbers(t), t="Figs. 3, fig 12 and Figure 3") == ["12", "3"]
    assert one(T.section_name(t), t="IV. Related Work :") == "related work" and one(T.section_name(t), t="A Study") == "study"
    assert one(T.ref_ids(t), t="['a', \"b\"]") == ["a", "b"] and one(T.ref_ids(t), t="is_blank") == [] and one(T.ref_ids(t), t=" a ") == ["a"] and one(T.ref_ids(t), t="[broken") == ["[broken"]
    assert one(T.evidence(t), t='x "one two three four five six ... seven eight nine ten eleven twelve" "short"') == ["one two three four five six", "seven eight nine ten eleven twelve"]
    assert one(T.evidence(t), t="Quote: ab2020a: one two three four five six b2021: short -- a b c d e f g") == ["one two three four five six", "a b c d e f g"]
    assert one(T.answer_type(t), t="1,234") == "number" and one(T.answer_type(t), t="(1, 2)") == "list/range" and one(T.answer_type(t), t="1d") == "text"
    assert one(T.table_label(t), t=" Table iv: x") == "IV" and one(T.table_mentions(t), t="see Tab. 3 and table IV") == ["3", "IV"]
    assert one(T.json_object(t), t="```json\n{\"a\": 1}\n``` ok") == '{"a": 1}' and one(T.json_object(t), t="none") is None
    assert one(T.without_thinking(t), t="<think>a\nb</think>c") == "c" and one(T.ungrouped(t), t="100,000") == "100000" and one(T.ungrouped(t), t="10,00") == "10,00"
    assert one(T.collection_name(t, t), t="a/b") == "a-b__a-b" and one(T.preprint(t)[1], t="https://arxiv.org/abs/2401.12345v2") == "v2"


def test_event_counts_of_a_stream(spark, tmp_path):
    from tesserine.streaming.index import event_counts

    rows = [(f"2025-01-01 0{h}:{m:02d}:00", kind, float(m)) for h in range(4) for m in range(0, 60, 7) for kind in "ab"]
    events = spark.createDataFrame(rows, "at string, event_type string, value double").select(F.to_timestamp("at").alias("ts"), "event_type", "value")
    events.write.parquet(str(tmp_path / "in"))
    stream = event_counts(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")))
    run = stream.writeStream.outputMode("complete").format("memory").queryName("counted").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    run.awaitTermination()
    assert sorted(map(tuple, spark.table("counted").collect())) == sorted(map(tuple, event_counts(events).collect()))
    assert spark.table("counted").count() == 8


def brute_packed(text):
    """(lines, tokens) of every chunk, one unit at a time."""
    tokens = lambda words: math.ceil(len(words) * 1.3)
    units = []
    for no, line in enumerate(text.split("\n")):
        if tokens(line.split()) <= 400:
            units += [(no, tokens(line.split()))] if line.split() else []
            continue
        held: list = []
        spaced = line.replace(". ", ".\n").split("\n")  # the fixture's sentences end in ". " before a capital
        for sentence in (s.split() for s in spaced):
            for part in [sentence[i : i + 307] for i in range(0, len(sentence), 307)]:
                if held and tokens(held + part) > 400:
                    units.append((no, tokens(held)))
                    held = []
                held = held + part
        units.append((no, tokens(held)))
    chunks: list = []
    for no, n in units:
        if not chunks or sum(m for _, m in chunks[-1]) + n > 400:
            chunks.append([])
        chunks[-1].append((no, n))
    if len(chunks) > 1 and sum(m for _, m in chunks[-1]) < 50 and sum(m for _, m in chunks[-1] + chunks[-2]) <= 450:
        chunks[-2:] = [chunks[-2] + chunks[-1]]
    return [(len({no for no, _ in c}), sum(m for _, m in c)) for c in chunks]


def test_packed_documents_keep_oversized_lines(spark, tmp_path):
    rng = random.Random(3)
    sentence = lambda: "W" + "w " * rng.randint(1, 120) + "end."
    line = lambda n: " ".join(sentence() for _ in range(n))
    texts = ["\n".join(rng.choice([line(1), line(3), line(30), "", " "]) for _ in range(rng.randint(1, 12))) + "\nshort" for _ in range(30)]
    texts += ["w " * 307, "w " * 308, "w " * 2000 + "\na\nb", "a\n" + "w " * 700 + "end. " + line(9), line(200), "a b\nc"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r.doc_id, r.chunk_no): (r.lines, r.tokens) for r in corpus.packed_documents(spark, str(tmp_path)).collect()}
    assert got == {(i, n): chunk for i, t in enumerate(texts) for n, chunk in enumerate(brute_packed(t))}
    some = {(r.doc_id, r.chunk_no): (r.lines, r.tokens) for r in corpus.packed_lines(spark, str(tmp_path)).collect()}
    assert some.items() < got.items() and {i for i, _ in got} == set(range(len(texts)))
