"""Retrieval metrics over long ranking tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserine.functions import text as T
from tesserine.operators import evidence
from tesserine.runtime import small, stage

TOP_ITEMS = 1_000_000  # passages among the first ones of which the ids are broadcast at most


def first_ranks(questions: DataFrame, ranking: DataFrame, gold: DataFrame, name: str) -> DataFrame:
    """questions with `name`: the best rank at which a gold item (query_id, item_id) stands, null where none does."""
    hits = ranking.join(gold.select("query_id", "item_id").distinct(), ["query_id", "item_id"], "left_semi").groupBy("query_id").agg(F.min("rank").alias(name))
    return questions.join(hits, "query_id", "left")


def in_corpus(questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """Questions (query_id, refs) with at least one reference that some chunk has."""
    known = chunks.select(F.col("ref_id").alias("ref")).where("ref is not null").distinct()
    scoped = questions.select("query_id", F.explode("refs").alias("ref")).join(known, "ref", "left_semi").select("query_id").distinct()
    return questions.join(scoped, "query_id", "left_semi")


def gold_items(questions: DataFrame, chunks: DataFrame, ranking: DataFrame | None = None) -> DataFrame:
    """(query_id, item_id): chunks of the papers a question refers to; only those in its ranking where one is given."""
    refs = questions.select("query_id", F.explode("refs").alias("ref_id")).distinct()
    items = chunks.select("item_id", "ref_id")
    if ranking is None:
        return refs.join(items, "ref_id").select("query_id", "item_id")
    return ranking.select("query_id", "item_id").join(items, "item_id").join(refs, ["query_id", "ref_id"], "left_semi").select("query_id", "item_id")


def judged(questions: DataFrame, passages: DataFrame, ranking: DataFrame) -> DataFrame:
    """questions (query_id, refs, evidence) with doc_rank, passage_rank, has_passage and ctx_tokens, what summary() is made from.

    passages(item_id, ref_id, body). A gold passage is one of a paper the question refers to that covers one of the segments of
    `evidence` in order; a question has one where any such passage exists, found or not.
    """
    refs = questions.select("query_id", F.explode("refs").alias("group"), "evidence").distinct()
    segments = refs.select("query_id", "group", F.posexplode("evidence").alias("n", "text")).withColumn("segment_id", F.concat_ws("\u0001", "query_id", "n"))
    covered = evidence.coverage(segments.select("segment_id", "group", "text"), passages.select("item_id", F.col("ref_id").alias("group"), F.col("body").alias("text")))
    kind = dict(questions.dtypes)["query_id"]
    gold = stage(covered.select(F.split("segment_id", "\u0001")[0].cast(kind).alias("query_id"), "item_id").distinct(), "gold-passages")
    results = first_ranks(questions, ranking, gold_items(questions, passages, ranking), "doc_rank")
    results = first_ranks(results, ranking, gold, "passage_rank")
    results = results.join(gold.select("query_id").distinct().withColumn("has_passage", F.lit(True)), "query_id", "left").fillna(False, ["has_passage"])
    return context_tokens(results, ranking, context_sizes(passages, ranking))


def summary(results: DataFrame, ks=(1, 5, 10, 20)) -> DataFrame:
    """One row of metrics from (query_id, doc_rank, passage_rank, has_passage, ctx_tokens).

    doc_recall over all questions; passage metrics over those whose evidence is somewhere in a gold paper; a mean over no
    question is null.
    """
    with_passage = F.col("has_passage")
    at = lambda rank, k: F.coalesce((F.col(rank) <= k).cast("double"), F.lit(0.0))
    doc = [F.round(F.avg(at("doc_rank", k)), 6).alias(f"doc_recall_{k}") for k in ks]
    passage = [F.round(F.avg(F.when(with_passage, at("passage_rank", k))), 6).alias(f"passage_recall_{k}") for k in ks]
    mrr = F.round(F.avg(F.when(with_passage, F.coalesce(F.lit(1.0) / F.col("passage_rank"), F.lit(0.0)))), 6).alias("passage_mrr")
    return results.agg(F.count("*").alias("questions"), F.count(F.when(with_passage, 1)).alias("passage_questions"), *doc, *passage, mrr, F.round(F.avg("ctx_tokens"), 6).alias("ctx_tokens_5"))


def context_tokens(questions: DataFrame, ranking: DataFrame, sizes: DataFrame, k: int = 5) -> DataFrame:
    """questions with ctx_tokens: the tokens (item_id, tokens) of the first k items."""
    top = ranking.where(F.col("rank") <= k).join(sizes, "item_id").groupBy("query_id").agg(F.sum("tokens").alias("ctx_tokens"))
    return questions.join(top, "query_id", "left").fillna(0, ["ctx_tokens"])


def context_sizes(passages: DataFrame, ranking: DataFrame, k: int = 5) -> DataFrame:
    """(item_id, tokens) of the passages (item_id, body) among the first k of a question; other texts are not counted."""
    top = small(ranking.where(F.col("rank") <= k).select("item_id").distinct(), TOP_ITEMS)
    return passages.select("item_id", "body").join(top, "item_id", "left_semi").select("item_id", T.approx_tokens(F.col("body")).alias("tokens"))


def figure_summary(results: DataFrame, ks=(1, 5, 10)) -> DataFrame:
    """Recall of figures and values from (figure_rank, value_rank, scores_figure, scores_value), each over the questions it scores."""
    at = lambda rank, k: F.coalesce((F.col(rank) <= k).cast("double"), F.lit(0.0))
    parts = [F.round(F.avg(F.when(F.col(f"scores_{m}"), at(f"{m}_rank", k))), 6).alias(f"{m}_recall_{k}") for m in ("figure", "value") for k in ks]
    return results.agg(F.count("*").alias("questions"), *parts)


def read_summary(reads: DataFrame, n: int = 3) -> DataFrame:
    """Rates of a run that reads charts, from (query_id, rank, correct, from_gold, errored, numbers): all over questions."""
    upto = lambda k, c: F.max(F.coalesce((F.col("rank") <= k) & c, F.lit(False)))
    each = reads.groupBy("query_id").agg(
        *[upto(k, F.col("from_gold")).alias(f"g{k}") for k in (1, n)],
        *[upto(k, F.col("correct")).alias(f"a{k}") for k in (1, n)],
        *[upto(k, F.col("correct") & F.col("from_gold")).alias(f"s{k}") for k in (1, n)],
        upto(1, (F.size("numbers") > 0) & ~F.col("correct")).alias("w1"),
        F.sum(F.col("errored").cast("int")).alias("e"),
    )
    rate = lambda c: F.avg(F.col(c).cast("double"))
    names = {"g": "gold_doc_read", "a": "answer", "s": "strict_answer"}
    return each.agg(
        F.count("*").alias("questions"), F.sum("e").alias("read_errors"), *[rate(f"{p}{k}").alias(f"{name}_{k}") for p, name in names.items() for k in (1, n)], rate("w1").alias("wrong_number_1")
    )
