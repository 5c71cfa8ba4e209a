"""Retriever objects, snapshots, reports, gold loaders, images and the command line."""

import struct

import pytest
from pyspark.sql import functions as F

from tesserine import __main__ as cli
from tesserine.functions import text as T
from tesserine.operators import reports, retrievers
from tesserine.sources import files, parsed, snapshot

DOC = (
    '{"name": "d%d", "body": {"children": [{"$ref": "#/texts/0"}, {"$ref": "#/texts/1"}, {"$ref": "#/pictures/0"}]}, '
    '"texts": [{"self_ref": "#/texts/0", "label": "section_header", "text": "1 Water use"}, {"self_ref": "#/texts/1", "label": "text", "text": "%s cooling water in the data hall is measured by meters %d."}, '
    '{"self_ref": "#/texts/2", "label": "caption", "text": "Figure 1: water"}], "pictures": [{"self_ref": "#/pictures/0", "captions": [{"$ref": "#/texts/2"}]}], "groups": [], "tables": []}'
)


@pytest.fixture
def passages(spark):
    rows = [("c0", "d0", "water use of a cooling tower", "text", "r0"), ("c1", "d0", "carbon of chips", "text", "r0"), ("c2", "d1", "Figure water by year", "figure", "r1"), ("c3", "d1", "figure carbon", "figure", "r1")]
    return spark.createDataFrame(rows, "item_id string, doc_id string, text string, kind string, ref_id string")


def test_retrievers(spark, passages):
    q = spark.createDataFrame([(1, "cooling water"), (2, "carbon")], "query_id long, query string")
    both = retrievers.Fused([retrievers.Bm25(), retrievers.Dense()], weights=[1.0, 0.5])
    assert both.name == "rrf(bm25+dense-hashed-noinstr, k=60 w=1,0.5)"
    first = {r.query_id: r.item_id for r in both.fit(passages).search(q, 3).where("rank = 1").collect()}
    assert first[1] == "c0" and first[2] in ("c1", "c3")
    longest = retrievers.Reranked(retrievers.Bm25(), lambda query, text: F.length(text).cast("double"), 3).fit(passages)
    assert [r.item_id for r in longest.search(q, 2).where("query_id = 1").orderBy("rank").collect()] == ["c0", "c2"]
    cache = spark.createDataFrame([("carbon", "c3", 1), ("carbon", "gone", 2), ("cooling water", "c3", 1)], "query string, item_id string, rank int")
    got = retrievers.Cached(retrievers.Bm25(), cache).fit(passages).search(q, 2).collect()
    assert {(r.query_id, r.item_id) for r in got} == {(2, "c3"), (1, "c0"), (1, "c2")}
    found = retrievers.figure_searcher(passages, ref_id="r1").search(q, 5).collect()
    assert {r.item_id for r in found} <= {"c2", "c3"}


def test_snapshot(spark, tmp_path):
    a, b, where = spark.range(5), spark.createDataFrame([], "x int"), str(tmp_path / "snap")
    manifest = snapshot.build(spark, {"a": a, "b": b}, where, model="m")
    assert list(manifest["parts"]) == ["a"] and snapshot.read_manifest(spark, where)["model"] == "m"
    snapshot.install(spark, where, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t" / "a")).count() == 5
    with pytest.raises(snapshot.SnapshotError, match="already"):
        snapshot.install(spark, where, str(tmp_path / "t"))
    snapshot.install(spark, where, str(tmp_path / "t"), force=True)
    spark.range(6).write.mode("overwrite").parquet(where + "/a")
    with pytest.raises(snapshot.SnapshotError, match="not what"):
        snapshot.install(spark, where, str(tmp_path / "u"))
    with pytest.raises(snapshot.SnapshotError):
        snapshot.build(spark, {"../a": a}, where)
    with pytest.raises(snapshot.SnapshotError):
        snapshot.read_manifest(spark, str(tmp_path))
    assert spark.createDataFrame([('{"image": "data:image/png;base64,AAA", "k": 1}',)], "r string").select(snapshot.without_images(F.col("r")).alias("r")).first().r == '{"image": null, "k": 1}'


def test_reports(spark):
    df = spark.createDataFrame([("a", 0.5, 2), ("b", None, 3)], "r string, m double, n int")
    assert reports.markdown_table(df.orderBy("r")) == "| r | m | n |\n|---|---|---|\n| a | 0.500 | 2 |\n| b | n/a | 3 |"
    assert reports.difference(0.5, 0.25) == "+0.250" and reports.difference(None, 1) == "n/a"
    delta = {(x.r, x.metric): x.delta for x in reports.compared(df, df.withColumn("m", F.lit(0.25)), "r").collect()}
    assert delta["a", "m"] == 0.25 and delta["b", "n"] == 0
    assert reports.best_setting(df.fillna(0), "n", "m").first().r == "b"
    assert reports.same_rows(df, df) and not reports.same_rows(df, df.limit(1))
    assert reports.sample(df, 1, "r", 3).collect() == reports.sample(df, 1, "r", 3).collect()
    assert reports.fingerprint({"a": 1, "b": 2}) == reports.fingerprint({"b": 2, "a": 1})
    assert reports.finite_or_null(spark.createDataFrame([(float("nan"), 1.0)], "a double, b double")).first().a is None
    s = spark.createDataFrame([("bm25", "2"), ("dense", "1")], "retriever string, created_at string")
    assert reports.newest(s).first().retriever == "bm25" and reports.newest(s, "dense").first().retriever == "dense"


def test_gold_and_images(spark, tmp_path):
    rows = [("1", "q", "['a2020']", 'x "one two three four five six"', "1", "0", "5", "kWh", "see Fig. 3"), ("2", "q", "is_blank", "", "1", "1", "x", "", ""), ("3", "q", "", "", "0", "0", "", "", "")]
    df = spark.createDataFrame(rows, "id string, question string, ref_id string, supporting_materials string, Figure string, is_NA string, answer_value string, answer_unit string, note string")
    gold = files.gold_questions(df).collect()
    assert [g.id for g in gold] == ["1"] and gold[0].flags["Figure"] and not gold[0].flags["Table"] and gold[0].evidence == ["one two three four five six"]
    assert [(f.id, f.number) for f in files.figure_questions(df).collect()] == [("1", 5.0)]
    (tmp_path / "d1").mkdir()
    (tmp_path / "d1" / "figure_07.png").write_bytes(b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + struct.pack(">II", 640, 480))
    image = files.read_images(spark, str(tmp_path)).first()
    assert (image.doc_id, image.figure_index, image.pixels) == ("d1", 7, 640 * 480)
    xml = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>A\n  b</title><published>2024-01-02</published><author><name>X</name></author></entry></feed>'
    entry = spark.createDataFrame([(xml,)], "x string").select(files.atom_entry(F.col("x")).alias("e")).first().e
    assert (entry.title, entry.year, entry.authors) == ("A b", "2024", ["X"])


def test_figure_readings_become_blocks(spark):
    records = spark.createDataFrame([("d1", DOC % (1, "all", 1))], "doc_id string, raw string")
    readings = spark.createDataFrame([("d1", 0, "Figure (bar)\nTitle: W"), ("d1", 5, "x")], "doc_id string, figure_index int, text string")
    got = [(r.kind, r.text) for r in parsed.blocks_with_readings(records, readings).orderBy("block_no").collect()]
    assert got[-1] == ("figure", "Figure (bar)\nFigure 1: water\nTitle: W") and [k for k, _ in got] == ["text", "caption", "figure"]


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "docs").mkdir()
    for i in range(3):
        (tmp_path / "docs" / f"d{i}.json").write_text(DOC % (i, ("rural", "urban", "coastal")[i], i))
    (tmp_path / "meta.csv").write_text("id,type,title,year,url,local_path\n" + "".join(f"r{i},paper,T{i},2020,u,x/d{i}.pdf\n" for i in range(3)))
    (tmp_path / "q.csv").write_text("id,question,ref_id,supporting_materials,is_NA\n1,urban cooling water,r1,,0\n2,nothing,is_blank,,1\n")
    chunks, index = str(tmp_path / "c.jsonl"), str(tmp_path / "index")
    cli.main(["chunk", str(tmp_path / "docs"), chunks, "--metadata", str(tmp_path / "meta.csv")])
    rows = files.read_chunks(spark, chunks).orderBy("chunk_id").collect()
    assert len(rows) == 3 and rows[1].metadata["ref_id"] == "r1" and rows[1].embed_text.startswith("d1 > 1 Water use\n\n")
    cli.main(["index", chunks, index])
    cli.main(["index", chunks, index])
    assert spark.read.parquet(index).count() == 3 and "| 0 | 3 | 0 | 0 |" in capsys.readouterr().out
    cli.main(["search", chunks, "urban water", "-k", "1"])
    assert "d1::hybrid::0000" in capsys.readouterr().out
    cli.main(["evaluate", chunks, str(tmp_path / "q.csv"), "--retriever", "bm25,hybrid"])
    out = capsys.readouterr().out
    assert "rrf(bm25+dense-hashed-noinstr, k=60 w=1,1)" in out and "| 1 | 0 | 1.000 |" in out
    (tmp_path / "q2.csv").write_text("id,question,ref_id,supporting_materials,is_NA\n1,urban cooling water,r1,\"\"\"cooling water in the data hall is measured\"\"\",0\n")
    cli.main(["evaluate", chunks, str(tmp_path / "q2.csv"), "--retriever", "bm25"])
    tokens = T.approx_tokens(F.col("text"))
    total = sum(r.t for r in files.read_chunks(spark, chunks).select(tokens.alias("t")).collect())
    assert "| 1 | 1 | 1.000 | 1.000 | 1.000 | 1.000 | 1.000 | 1.000 | 1.000 | 1.000 | 1.000 | " in (out := capsys.readouterr().out) and f"{total:.3f} |" in out
    cli.main(["sweep", chunks, str(tmp_path / "q2.csv"), "--rrf-ks", "60", "--dense-weights", "0.1"])
    assert "| 1 | 1 | 1.000 |" in capsys.readouterr().out
    kept = str(tmp_path / "kept.jsonl")
    files.write_chunks(files.read_chunks(spark, chunks).where("doc_id <> 'd0'"), kept)
    cli.main(["index", kept, index, "--prune"])
    assert spark.read.parquet(index).count() == 2 and "| 0 | 2 | 1 | 0 |" in capsys.readouterr().out
    cli.main(["delete", index, "d1"])
    assert [r.chunk_id for r in spark.read.parquet(index).collect()] == ["d2::hybrid::0000"]
    cli.main(["delete", index, "--all"])
    assert spark.read.parquet(index).count() == 0
    cli.main(["index", chunks, index])
    cli.main(["sweep", chunks, str(tmp_path / "q.csv"), "--rrf-ks", "60", "--dense-weights", "0.1"])
    cli.main(["publish", str(tmp_path / "snap"), index])
    cli.main(["install", str(tmp_path / "snap"), str(tmp_path / "back")])
    assert spark.read.parquet(str(tmp_path / "back" / "index")).count() == 3


MODEL = """
import json
def reply(row):
    p = row["passages"][0]
    value = "oops" if row["id"] == "2" and not __import__("os").path.exists(FLAG) else "1,234"
    quote = "invented" if value == "oops" else " ".join(p["text"].split()[:4])
    return json.dumps({"answer": "a", "answer_value": value, "explanation": "e.", "evidence": [{"chunk_id": p["chunk_id"], "quote": quote}]})
"""


def test_generate_and_analyze(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.chdir(tmp_path)
    monkeypatch.setenv("PYTHONPATH", str(tmp_path))
    (tmp_path / "fake_model.py").write_text(f"FLAG = {str(tmp_path / 'flag')!r}\n" + MODEL)
    spark.sparkContext.addPyFile(str(tmp_path / "fake_model.py"))
    (tmp_path / "docs").mkdir()
    for i in range(3):
        (tmp_path / "docs" / f"d{i}.json").write_text(DOC % (i, ("rural", "urban", "coastal")[i], i))
    (tmp_path / "meta.csv").write_text("id,type,title,year,url,local_path\n" + "".join(f"r{i},paper,T{i},2020,u{i},x/d{i}.pdf\n" for i in range(3)))
    (tmp_path / "q.csv").write_text("id,question,answer_unit\n1,urban cooling water,L\n2,coastal cooling water,L\n")
    (tmp_path / "gold.csv").write_text('id,answer_value,ref_id,supporting_materials\n1,1234,r1,"""urban cooling water in the data hall"""\n2,99,r2,"""coastal cooling water in the data hall"""\n')
    chunks, out = str(tmp_path / "c.jsonl"), str(tmp_path / "run")
    cli.main(["chunk", str(tmp_path / "docs"), chunks, "--metadata", str(tmp_path / "meta.csv")])
    cli.main(["generate", chunks, str(tmp_path / "q.csv"), out, "--reply", "fake_model:reply", "--retriever", "bm25", "-k", "2"])
    assert "| 1 | 1 |" in capsys.readouterr().out
    (tmp_path / "flag").write_text("")
    cli.main(["generate", chunks, str(tmp_path / "q.csv"), out, "--reply", "fake_model:reply", "--retriever", "bm25", "-k", "2", "--csv", str(tmp_path / "answers")])
    assert "| 2 | 1 |" in capsys.readouterr().out and spark.read.parquet(out).count() == 3  # the sound answer was kept, the other one tried again
    assert {r.answer_value for r in files.read_csv(spark, str(tmp_path / "answers")).collect()} == {"1234"}
    cli.main(["analyze", chunks, str(tmp_path / "gold.csv"), out])
    said = capsys.readouterr().out
    assert "| correct | 1 | 0.500 | 0.000 |" in said and "| wrong_had_evidence | 1 | 0.500 | 0.375 |" in said


def test_staged_tables_can_be_released(spark):
    import glob

    from tesserine import runtime

    assert runtime.stage(spark.range(3), "probe").count() == 3
    where = runtime.shared_dir(spark).removeprefix("file://")
    assert glob.glob(f"{where}/probe-*")
    runtime.release(spark)
    assert not glob.glob(f"{where}/probe-*") and not runtime._STAGED
