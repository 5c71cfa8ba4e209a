"""Command line: python -m tesserine COMMAND ..."""

from __future__ import annotations

import argparse
import importlib
import sys
from pathlib import Path

from pyspark.sql import functions as F

from tesserine.functions import text as T
from tesserine.operators import answers, enrich, errors, evaluate, evidence, figures, fusion, incremental, reports, retrievers
from tesserine.plans import strategies
from tesserine.runtime import session, stage
from tesserine.sources import files, parsed, snapshot

ONE_QUERY = "query_id long, query string"


def _passages(spark, path):
    chunks = files.read_any(spark, path) if path.endswith(".jsonl") else spark.read.parquet(path)
    text = enrich.embedded_text(F.col("text"), F.col("embed_text"))
    meta = [F.try_element_at("metadata", F.lit(k)).alias(k) for k in ("ref_id", "url")]
    return chunks.select(F.col("chunk_id").alias("item_id"), "doc_id", "kind", *meta, text.alias("text"), F.col("text").alias("body"))


def _retriever(name, args):
    parts = {"bm25": retrievers.Bm25, "tfidf": retrievers.Tfidf, "dense": retrievers.Dense}
    if name in parts:
        return parts[name]()
    return retrievers.Fused([parts[args.lexical](), retrievers.Dense()], args.rrf_k, args.depth, [1.0, args.dense_weight])


def chunk(spark, args):
    """Parsed JSON files to chunks."""
    records = parsed.read_json_files(spark, args.source)
    text = parsed.labels_text if args.strategy == "hybrid_figlabels" else None
    blocks = parsed.blocks_with_readings(records, spark.read.parquet(args.readings)) if args.readings else parsed.blocks(records, figure_text=text)
    chunks = strategies.chunks(blocks, args.strategy, args.max_tokens)
    if args.metadata:
        meta = enrich.corpus_metadata(chunks, files.read_csv(spark, args.metadata))
        names = list(enrich.CORPUS_FIELDS.values())
        entries = F.filter(F.array(*[F.struct(F.lit(n).alias("key"), F.col(n).alias("value")) for n in names]), lambda e: e["value"].isNotNull())
        chunks = meta.withColumn("metadata", F.map_concat(F.map_filter(F.coalesce("metadata", F.create_map().cast("map<string,string>")), lambda k, v: ~k.isin(*names)), F.map_from_entries(entries))).drop(*names)
    files.write_chunks(chunks, args.out)


def _replace(spark, table, path):
    """Puts a table that was made from the one at path in its place; the old one stays until the new one is whole."""
    table.write.mode("overwrite").parquet(path + ".new")
    fs, place = snapshot._fs(spark, path)
    fs.delete(place, True)
    fs.rename(snapshot._fs(spark, path + ".new")[1], place)


def index(spark, args):
    """Chunks to vectors, only what is new or changed; --prune also drops what no longer exists, --rebuild makes everything anew."""
    from tesserine.operators.dense import hashed_embedding

    current = incremental.hashed(files.read_any(spark, args.chunks), args.model)
    fresh, there = current, snapshot.exists(spark, args.index) and not args.rebuild
    if there:
        stored = incremental.latest(spark.read.parquet(args.index), "at")
        print(reports.markdown_table(incremental.index_stats(current, stored)))
        fresh = incremental.changed(current, stored)
    rows = fresh.withColumn("vector", hashed_embedding(F.col("embed_text"))).withColumn("at", F.current_timestamp())
    if there and args.prune:
        _replace(spark, incremental.updated(stored, rows, current), args.index)
    else:
        rows.write.mode("overwrite" if args.rebuild else "append").parquet(args.index)


def delete(spark, args):
    """Documents out of an index; all of them with --all."""
    rows = spark.read.parquet(args.index)
    own = F.substring_index("chunk_id", "::", 1)
    _replace(spark, rows.limit(0) if args.all else rows.where(~own.isin(*args.documents)), args.index)
    print(reports.markdown_table(spark.read.parquet(args.index).agg(F.count_distinct("chunk_id").alias("chunks"))))


def search(spark, args):
    """The best passages for one question."""
    passages = _passages(spark, args.chunks)
    passages = passages.where(F.col("ref_id") == args.ref_id) if args.ref_id else passages
    hits = _retriever(args.retriever, args).fit(passages).search(spark.createDataFrame([(1, args.query)], ONE_QUERY), args.k)
    _show(hits, passages)


def figure_search(spark, args):
    """The best figures for one question."""
    passages = _passages(spark, args.chunks)
    _show(retrievers.figure_searcher(passages, ref_id=args.ref_id).search(spark.createDataFrame([(1, args.query)], ONE_QUERY), args.k), passages)


def _show(hits, passages):
    print(reports.markdown_table(hits.join(passages, "item_id").orderBy("rank").select("rank", "item_id", "ref_id", F.substring("body", 1, 160).alias("text"))))


def _questions(spark, args, passages):
    gold = files.gold_questions(files.read_csv(spark, args.questions)).select(F.col("id").alias("query_id"), F.col("question").alias("query"), "refs", "evidence")
    return stage(evaluate.in_corpus(gold, passages), "questions")


def evaluation(spark, args):
    """Recall of papers and of passages with the evidence, reciprocal rank and context size, by retriever."""
    passages = _passages(spark, args.chunks)
    questions = _questions(spark, args, passages)
    for name in args.retriever.split(","):
        r = _retriever(name, args)
        ranking = stage(r.fit(passages).search(questions, 20), "ranking")
        print(f"\n{r.name}\n" + reports.markdown_table(evaluate.summary(evaluate.judged(questions, passages, ranking))))


def sweep(spark, args):
    """The same over a grid of fusion settings; the two retrievers search once."""
    passages = _passages(spark, args.chunks)
    questions = _questions(spark, args, passages)
    lists = stage(fusion.stacked(*(r.fit(passages).search(questions, max(20, args.depth)) for r in (retrievers.Bm25(), retrievers.Dense()))), "rankings")
    grid = stage(fusion.rrf_grid(lists, args.rrf_ks, args.dense_weights).where("rank <= 20"), "grid")
    for k in args.rrf_ks:
        for w in args.dense_weights:
            ranking = grid.where((F.col("k_rrf") == k) & (F.col("weight") == w)).select("query_id", "item_id", "rank")
            print(f"\nrrf(bm25+dense, k={k} w=1,{w:g})\n" + reports.markdown_table(evaluate.summary(evaluate.judged(questions, passages, ranking))))


def _callable(name):
    sys.path.insert(0, str(Path.cwd()))
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


def generate(spark, args):
    """Answers to questions: search, add tables that are mentioned, ask a model (--reply module:function of a dict), check.

    Sound answers of the same settings are kept, so a run that was broken off goes on where it stopped.
    """
    settings = {"retriever": args.retriever, "k": args.k, "tables": args.expand_tables, "reply": args.reply}
    mark = reports.fingerprint(settings)
    questions = files.read_questions(spark, args.questions)
    if snapshot.exists(spark, args.out):
        questions = answers.pending(questions, spark.read.parquet(args.out), mark)
    questions = stage(questions, "pending")
    passages = _passages(spark, args.chunks)
    ask = questions.select(F.col("id").alias("query_id"), F.col("question").alias("query"))
    hits = stage(_retriever(args.retriever, args).fit(passages).search(ask, args.k), "hits")
    plain = passages.select("item_id", "doc_id", F.col("body").alias("text"))
    tables = answers.mentioned_tables(hits.select("query_id", "rank", "item_id"), plain, args.expand_tables)
    given = hits.select("query_id", "item_id", "rank").unionByName(tables.select("query_id", "item_id", (F.col("added_no") + args.k).alias("rank")))
    shown = given.join(passages, "item_id").select("query_id", F.struct("rank", F.col("item_id").alias("chunk_id"), "ref_id", "url", F.col("body").alias("text")).alias("p"))
    shown = shown.groupBy(F.col("query_id").alias("id")).agg(F.transform(F.array_sort(F.collect_list("p")), lambda p: F.struct(p["chunk_id"].alias("chunk_id"), p["ref_id"].alias("ref_id"), p["url"].alias("url"), p["text"].alias("text"))).alias("passages"))
    replies = stage(answers.generated(questions.join(shown, "id", "left"), _callable(args.reply)), "replies")
    done = answers.validated(replies).withColumn("fingerprint", F.lit(mark)).withColumn("at", F.current_timestamp())
    done.join(replies.select("id", F.transform("passages", lambda p: p["chunk_id"]).alias("passage_ids")), "id").write.mode("append").parquet(args.out)
    total = spark.read.parquet(args.out).where(F.col("fingerprint") == mark)
    print(reports.markdown_table(total.agg(F.count_distinct(F.when(F.col("error").isNull(), F.col("id"))).alias("answered"), F.count(F.when(F.col("error").isNotNull(), 1)).alias("rejected"))))
    if args.csv:
        files.write_answers(total.where("error is null").dropDuplicates(["id"]), args.csv)


def analyze(spark, args):
    """Answers of a run against gold: scores and what went wrong, with the passages the answers were given."""
    gold = files.read_csv(spark, args.gold).select("id", F.col("answer_value").alias("gold_value"), T.ref_ids(F.col("ref_id")).alias("gold_refs"), T.evidence(F.col("supporting_materials")).alias("evidence"))
    run = spark.read.parquet(args.run).where("error is null")
    run = run.groupBy("id").agg(F.max_by(F.struct("answer_value", "ref_id", "passage_ids"), "at").alias("a")).select("id", "a.*")
    passages = _passages(spark, args.chunks)
    both = stage(gold.join(run, "id"), "answered")
    shown = both.select("id", "gold_refs", F.explode("passage_ids").alias("item_id")).join(passages.select("item_id", "ref_id", "body"), "item_id")
    in_gold = shown.where(F.array_contains("gold_refs", F.col("ref_id"))).select("id", "item_id", "body")
    segments = both.select("id", F.posexplode("evidence").alias("n", "text")).select(F.concat_ws("\u0001", "id", "n").alias("segment_id"), F.col("id").alias("group"), "text")
    items = in_gold.select(F.concat_ws("\u0001", "id", "item_id").alias("item_id"), F.col("id").alias("group"), F.col("body").alias("text"))
    held = evidence.coverage(segments, items).select(F.substring_index("segment_id", "\u0001", 1).alias("id")).distinct().withColumn("has_evidence", F.lit(True))
    rows = both.join(in_gold.select("id").distinct().withColumn("has_gold", F.lit(True)), "id", "left").join(held, "id", "left").fillna(False, ["has_gold", "has_evidence"])
    value, wanted = (answers.tidy_number(F.trim(c)) for c in ("answer_value", "gold_value"))
    number = lambda c: F.when(T.is_number(c), c.try_cast("double"))
    ok = F.coalesce(F.abs(number(value) - number(wanted)) <= 0.001 * F.abs(number(wanted)), F.lower(value) == F.lower(wanted), F.lit(False))
    f1 = errors.reference_scores(F.col("gold_refs"), T.ref_ids(F.col("ref_id")))[2]
    na, blank = wanted == "is_blank", value == "is_blank"
    judged = rows.select("id", "gold_value", errors.bucket(na, blank, ok, f1, F.col("has_evidence"), F.col("has_gold")).alias("bucket"), errors.score(ok, f1, na == blank).alias("score"))
    print(reports.markdown_table(errors.points_lost(judged).orderBy(F.desc("lost"))))
    print("\n" + reports.markdown_table(errors.breakdown(judged, F.array(T.answer_type(F.col("gold_value"))), "type").orderBy("type")))


def describe(spark, args):
    """Which figures still need a reading; with --reply they are read (module:function of a dict) and added to the readings."""
    pictures = files.read_images(spark, args.images)
    there = snapshot.exists(spark, args.readings)
    cache = spark.read.parquet(args.readings) if there else spark.createDataFrame([], "doc_id string, figure_index int, image_hash string, version string")
    missing = figures.missing_readings(pictures, cache, args.version, args.min_pixels)
    print(reports.markdown_table(missing.groupBy("doc_id").count().orderBy("doc_id")))
    if args.reply:
        read = figures.readings(answers.generated(missing, _callable(args.reply)))
        read = read.select("doc_id", "figure_index", "image_hash", F.lit(args.version).alias("version"), "reading", figures.description(F.col("reading"), F.lit("")).alias("text"))
        stage(read, "readings").write.mode("append").parquet(args.readings)


def versions(spark, args):
    """The version of every preprint that a paper's URL names against the one its text is stamped with."""
    papers = files.read_csv(spark, args.metadata, ("id", "url", "local_path"))
    name, pinned = T.preprint(F.col("url"))
    texts = spark.read.text(args.texts, wholetext=True).select(enrich.stem(F.input_file_name()).alias("doc_id"), F.regexp_extract("value", r"arXiv:[0-9.]+(v[0-9]+)", 1).alias("stamp"))
    found = papers.select("id", enrich.stem(F.col("local_path")).alias("doc_id"), name.alias("name"), pinned.alias("pinned")).where("name <> ''").join(texts, "doc_id", "left")
    print(reports.markdown_table(found.select("id", T.version_check(F.col("pinned"), F.coalesce("stamp", F.lit(""))).alias("result")).orderBy("id")))


def publish(spark, args):
    """A snapshot of tables."""
    print(snapshot.build(spark, {p.rsplit("/", 1)[-1].split(".")[0]: spark.read.parquet(p) for p in args.tables}, args.out))


def install(spark, args):
    """A snapshot's tables to where they are used."""
    print(snapshot.install(spark, args.snapshot, args.target, args.force))


def main(argv=None) -> None:
    parser = argparse.ArgumentParser(prog="tesserine", description=__doc__)
    parser.add_argument("--master", default=None)
    commands = parser.add_subparsers(required=True)

    def command(name, run, *positional):
        p = commands.add_parser(name, help=(run.__doc__ or "").splitlines()[0])
        p.set_defaults(command=run)
        for x in positional:
            p.add_argument(x)
        return p

    p = command("chunk", chunk, "source", "out")
    p.add_argument("--strategy", default="hybrid", choices=sorted(strategies.STRATEGIES))
    p.add_argument("--max-tokens", type=int), p.add_argument("--metadata"), p.add_argument("--readings")
    p = command("index", index, "chunks", "index")
    p.add_argument("--model", default="hashed"), p.add_argument("--rebuild", action="store_true"), p.add_argument("--prune", action="store_true")
    p = command("delete", delete, "index")
    p.add_argument("documents", nargs="*"), p.add_argument("--all", action="store_true")
    fused = []
    p = command("search", search, "chunks", "query")
    p.add_argument("-k", type=int, default=10), p.add_argument("--ref-id"), p.add_argument("--retriever", default="hybrid"), fused.append(p)
    p = command("figures", figure_search, "chunks", "query")
    p.add_argument("-k", type=int, default=10), p.add_argument("--ref-id")
    p = command("evaluate", evaluation, "chunks", "questions")
    p.add_argument("--retriever", default="bm25,tfidf,hybrid"), fused.append(p)
    p = command("generate", generate, "chunks", "questions", "out")
    p.add_argument("--reply", required=True), p.add_argument("--retriever", default="hybrid"), p.add_argument("-k", type=int, default=10)
    p.add_argument("--expand-tables", type=int, default=3), p.add_argument("--csv"), fused.append(p)
    for p in fused:
        p.add_argument("--lexical", default="bm25", choices=("bm25", "tfidf")), p.add_argument("--rrf-k", type=int, default=60)
        p.add_argument("--depth", type=int, default=50), p.add_argument("--dense-weight", type=float, default=1.0)
    p = command("sweep", sweep, "chunks", "questions")
    p.add_argument("--rrf-ks", type=int, nargs="+", default=[10, 30, 60]), p.add_argument("--dense-weights", type=float, nargs="+", default=[0.1, 0.5, 1.0]), p.add_argument("--depth", type=int, default=50)
    command("analyze", analyze, "chunks", "gold", "run")
    p = command("describe", describe, "images", "readings")
    p.add_argument("--version", default="1"), p.add_argument("--min-pixels", type=int, default=10_000), p.add_argument("--reply")
    command("versions", versions, "metadata", "texts")
    p = command("publish", publish, "out")
    p.add_argument("tables", nargs="+")
    p = command("install", install, "snapshot", "target")
    p.add_argument("--force", action="store_true")
    args = parser.parse_args(argv)
    args.command(session(master=args.master), args)


if __name__ == "__main__":
    main()
