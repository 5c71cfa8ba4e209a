"""What went wrong with answers: score, bucket, points lost, breakdowns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def reference_scores(gold: Column, predicted: Column) -> tuple[Column, Column, Column]:
    """(precision, recall, f1) of two sets of references; two empty sets agree fully."""
    g, p = F.array_distinct(gold), F.array_distinct(predicted)
    same = F.size(F.array_intersect(g, p)).cast("double")
    both_empty = (F.size(g) == 0) & (F.size(p) == 0)
    share = lambda of: F.when(both_empty, 1.0).when(F.size(of) == 0, 0.0).otherwise(same / F.size(of))
    f1 = F.when(both_empty, 1.0).otherwise(2 * same / (F.size(g) + F.size(p)))
    return share(p), share(g), f1


def bucket(gold_is_na: Column, abstained: Column, value_ok: Column, ref_f1: Column, has_evidence: Column, has_gold_doc: Column) -> Column:
    where = F.when(has_evidence, "had_evidence").when(has_gold_doc, "gold_doc_only").otherwise("no_gold_doc")
    failed = F.concat(F.when(abstained, "abstain_").otherwise("wrong_"), where)
    return (
        F.when(gold_is_na & value_ok, "correct_na").when(gold_is_na, "answered_unanswerable")
        .when(value_ok & (ref_f1 == 1.0), "correct").when(value_ok, "citation_off").otherwise(failed)
    )


def score(value_ok: Column, ref_f1: Column, na_ok: Column, weights=(0.75, 0.20, 0.05)) -> Column:
    return weights[0] * value_ok.cast("double") + weights[1] * ref_f1 + weights[2] * na_ok.cast("double")


def points_lost(rows: DataFrame) -> DataFrame:
    """(bucket, questions, share, lost): by bucket of rows(bucket, score), lost points as a part of all questions."""
    each = rows.groupBy("bucket").agg(F.count("*").alias("questions"), F.sum(1 - F.col("score")).alias("points"))
    total = F.sum("questions").over(Window.partitionBy())  # over one row a bucket
    return each.select("bucket", "questions", F.round(F.col("questions") / total, 6).alias("share"), F.round(F.col("points") / total, 6).alias("lost"))


def breakdown(rows: DataFrame, keys: Column, name: str) -> DataFrame:
    """(name, questions, mean_score): by each key of an array column; a row counts in every group it has."""
    each = rows.select("score", F.explode(F.when(F.size(keys) > 0, keys).otherwise(F.array(F.lit("none")))).alias(name))
    return each.groupBy(name).agg(F.count("*").alias("questions"), F.round(F.avg("score"), 6).alias("mean_score"))
