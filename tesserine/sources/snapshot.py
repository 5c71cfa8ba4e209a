"""Snapshots of an index: tables as parquet with a manifest, installed only if whole."""

from __future__ import annotations

import json
import re
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

IMAGE_FIELDS = r'"(image|page_image|uri)"\s*:\s*"data:image[^"]*"'


class SnapshotError(ValueError):
    """A snapshot that is not whole or would overwrite something."""


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def without_images(raw):
    """A parsed document's JSON without the images in it."""
    return F.regexp_replace(raw, IMAGE_FIELDS, '"$1": null')


def build(spark: SparkSession, tables: dict[str, DataFrame], path: str, **facts: str) -> dict:
    """Writes every table that has rows below path and a manifest with their counts; returns the manifest."""
    manifest: dict = {"created_at": datetime.now(timezone.utc).isoformat(timespec="seconds"), **facts, "parts": {}}
    for name, df in tables.items():
        if not re.fullmatch(r"[A-Za-z0-9_-]+", name):
            raise SnapshotError(f"{name!r} is no name of a part")
        df.write.mode("overwrite").parquet(f"{path}/{name}")
        back = spark.read.parquet(f"{path}/{name}")
        digest = back.agg(F.count("*").alias("rows"), F.coalesce(F.bit_xor(F.xxhash64(*[F.to_json(F.struct(F.col(c))) for c in back.columns])), F.lit(0)).alias("digest")).first()
        if digest.rows:
            manifest["parts"][name] = {"rows": digest.rows, "digest": digest.digest}
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")
    return manifest


def read_manifest(spark: SparkSession, path: str) -> dict:
    if not exists(spark, f"{path}/manifest"):
        raise SnapshotError(f"{path} has no manifest")
    return json.loads(spark.read.text(f"{path}/manifest").first().value)


def install(spark: SparkSession, path: str, target: str, force: bool = False) -> dict:
    """Copies the parts of a snapshot to target after checking their counts and digests; existing parts are kept unless forced."""
    manifest = read_manifest(spark, path)
    taken = [n for n in manifest["parts"] if exists(spark, f"{target}/{n}")]
    if taken and not force:
        raise SnapshotError(f"{target} already has {taken}")
    for name, facts in manifest["parts"].items():
        if not re.fullmatch(r"[A-Za-z0-9_-]+", name):
            raise SnapshotError(f"{name!r} is no name of a part")
        df = spark.read.parquet(f"{path}/{name}")
        found = df.agg(F.count("*").alias("rows"), F.coalesce(F.bit_xor(F.xxhash64(*[F.to_json(F.struct(F.col(c))) for c in df.columns])), F.lit(0)).alias("digest")).first()
        if (found.rows, found.digest) != (facts["rows"], facts["digest"]):
            raise SnapshotError(f"{name} is not what the manifest says")
    stamp = manifest["created_at"].replace(":", "")
    for name in manifest["parts"]:  # all parts are written before any is put in its place
        spark.read.parquet(f"{path}/{name}").write.mode("overwrite").parquet(f"{target}/{name}.{stamp}.new")
    for name in manifest["parts"]:
        fs, place = _fs(spark, f"{target}/{name}")
        if name in taken:
            fs.rename(place, _fs(spark, f"{target}/{name}.{stamp}.old")[1])
        fs.rename(_fs(spark, f"{target}/{name}.{stamp}.new")[1], place)
    return manifest
