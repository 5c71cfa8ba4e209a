"""Session access, table loading and lineage cuts shared by all operators."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

_OWN: list[str] = []
_STAGED: list[str] = []


def session(app: str = "tesserine", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators expect; `conf` overrides them."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def spread(table: DataFrame) -> DataFrame:
    """A table just read, dealt out over all cores where it comes in parts for less than half of them; larger ones stay where they are.

    A small file is one task however much work its texts are. What is moved is less than half a part for each core.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(cores) if table._jdf.queryExecution().toRdd().getNumPartitions() * 2 <= cores else table


def texts(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table whose texts take long to work on."""
    return spread(load(spark, sf_dir, table))


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors see: spark.checkpoint.dir, or one of our own where it is unset (tests, local mode)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not _OWN:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        own = os.path.join(tempfile.gettempdir(), f"tesserine-{uuid.uuid4().hex}")
        os.makedirs(own, exist_ok=True)
        _OWN.append(own)
        atexit.register(_clean, own)
    return "file://" + _OWN[0]


def _clean(folder: str) -> None:
    import shutil

    shutil.rmtree(folder, ignore_errors=True)


def stage(df: DataFrame, label: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts the lineage and outlives lost executors.

    The table goes when the driver ends; a session that lives long calls release() once its results are written.
    """
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    fs, where = _hadoop(df.sparkSession, path)
    fs.deleteOnExit(where)  # with the driver's JVM; release() does it earlier
    _STAGED.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Deletes the tables this process staged; results that still read them must have been written before."""
    while _STAGED:
        fs, path = _hadoop(spark, _STAGED.pop())
        fs.delete(path, True)


def _hadoop(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def small(df: DataFrame, rows: int) -> DataFrame:
    """df with a broadcast hint if it has at most `rows` rows, else as it is (the join is then a shuffled one)."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


FEW_KEYS = 1_000_000  # repeated keys that are broadcast at most; more are joined by shuffle


def once(df: DataFrame, key: str, *same: str) -> DataFrame:
    """df with the rows of repeated keys once (by the columns `same`, by the key alone where none are named).

    Only keys are counted and moved; of the rows themselves only those whose key is repeated. Rows with a null key stay.
    """
    repeated = stage(df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(key), "repeated-keys")
    known = small(repeated, FEW_KEYS)
    return df.join(known, key, "left_anti").unionByName(df.join(known, key, "left_semi").dropDuplicates([*same] or [key]).select(*df.columns))


def widened(schema: StructType, name: str, kind: DataType) -> StructType:
    """A new schema with one more field (StructType.add would change the data frame's own)."""
    return StructType([*schema.fields, StructField(name, kind)])
