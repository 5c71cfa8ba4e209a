"""Reports of a run: markdown tables, differences between runs, samples to look at, fingerprints of settings."""

from __future__ import annotations

import hashlib
import json
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_ROWS = 10_000  # a report is read by people


def number(value, digits: int = 3) -> str:
    """A value for a report; missing ones are n/a."""
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "n/a"
    return f"{value:.{digits}f}" if isinstance(value, float) else str(value)


def difference(new, old) -> str:
    return "n/a" if new is None or old is None else f"{new - old:+.3f}"


def markdown_table(df: DataFrame) -> str:
    """A small table as markdown; more than MAX_ROWS rows are refused."""
    rows = df.limit(MAX_ROWS + 1).collect()
    if len(rows) > MAX_ROWS:
        raise ValueError(f"a report of more than {MAX_ROWS} rows")
    line = lambda cells: "| " + " | ".join(cells) + " |"
    return "\n".join([line(df.columns), "|" + "---|" * len(df.columns), *(line([number(v) for v in r]) for r in rows)])


def compared(new: DataFrame, old: DataFrame, key: str) -> DataFrame:
    """Metrics of two runs by key: (key, metric, new, old, delta); what only one run has is kept."""
    metrics = [c for c in new.columns if c != key and c in old.columns]
    long = lambda df, name: df.select(key, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias(name)) for m in metrics])).alias("m")).select(key, "m.*")
    return long(new, "new").join(long(old, "old"), [key, "metric"], "full_outer").withColumn("delta", F.round(F.col("new") - F.col("old"), 6))


def newest(summaries: DataFrame, prefer: str | None = None) -> DataFrame:
    """The latest summary (retriever, created_at), one whose retriever's name has `prefer` before all others."""
    first = F.contains("retriever", F.lit(prefer)) if prefer else F.lit(False)
    return summaries.orderBy(F.desc(first), F.desc("created_at")).limit(1)


def best_setting(grid: DataFrame, *metrics: str) -> DataFrame:
    """The setting with the best metrics, compared in order."""
    return grid.agg(F.max_by(F.struct("*"), F.struct(*metrics)).alias("b")).select("b.*")


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Two tables hold the same bag of rows."""
    b = b.select(*a.columns)
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def sample(df: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """n rows in a seeded order that depends on keys only, so a rerun shows the same ones."""
    return df.orderBy(F.xxhash64(F.lit(seed), key), key).limit(n)


def fingerprint(settings: dict) -> str:
    return hashlib.sha256(json.dumps(settings, sort_keys=True, default=str).encode()).hexdigest()


def finite_or_null(df: DataFrame) -> DataFrame:
    """NaN and infinite numbers as nulls, for JSON."""
    fix = lambda c: F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.col(c)).alias(c)
    return df.select(*[fix(c) if t in ("double", "float") else c for c, t in df.dtypes])
