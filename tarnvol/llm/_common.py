"""Shared plumbing of the training-data operators: staging tables and document hygiene."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship

#: ASCII white space of the text contracts.
WS_CLASS = r"[\x20\x09-\x0D]+"
WORD_CLASS = r"[^\x20\x09-\x0D]+"

_OWN: dict[str, str] = {}


def staging_root(spark: SparkSession) -> str:
    """The shared folder for cut lineage: ``spark.checkpoint.dir``; a temporary one only where it is unset and all runs in one process."""
    if root := spark.conf.get("spark.checkpoint.dir", ""):
        return root
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="tarnvol-")
        atexit.register(shutil.rmtree, _OWN[app], ignore_errors=True)
    return _OWN[app]


def staging_path(spark: SparkSession, label: str) -> str:
    return f"{staging_root(spark).rstrip('/')}/tarnvol/{label}-{uuid.uuid4().hex[:12]}"


def until_exit(spark: SparkSession, path: str) -> None:
    """Let the session take away what it has staged when it ends."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: lost executors cannot take it away."""
    path = staging_path(df.sparkSession, label)
    df.write.parquet(path)
    until_exit(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def key_and_text(docs: DataFrame) -> DataFrame:
    """Only ``doc_id`` (long) and ``text`` (null: empty); any other column is pruned at the scan."""
    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def grouped(df: DataFrame, keys: list[str], *aggregates: Column) -> DataFrame:
    """``groupBy(keys).agg(...)`` that leaves no partitioning by the keys behind.

    A join with the result then has an exchange of its own on either side, which adaptive
    execution can split where a key is hot, and a later grouping adds up before its shuffle.
    """
    return df.groupBy(F.struct(*keys).alias("_group")).agg(*aggregates).select("_group.*", *(c for c in df.groupBy().agg(*aggregates).columns))


def own_name(df: DataFrame, wish: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while wish.lower() in taken:
        wish += "_"
    return wish


def text_hash() -> Column:
    """64 bits of a text that may be null: with the doc_id, the name of a row."""
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` less the rows whose (doc_id, text hash) ``gone`` (doc_id, h; no nulls) lists, whatever their other columns."""
    key, h = own_name(docs, "_key"), own_name(docs, "_h")
    gone = gone.select(F.col("doc_id").alias(key), F.col("h").alias(h)).distinct()
    return docs.join(gone, (docs["doc_id"].cast("long") == F.col(key)) & (F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit(""))) == F.col(h)), "left_anti")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def vocabulary(name: str) -> str:
    """Place of a public vocabulary; overridable as a parameter of every tokenizer operator."""
    import public_tokenizers

    return public_tokenizers.path(name)


def single_thread() -> None:
    """A task has one core: keep native tokenizer pools from starting their own threads."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    os.environ.setdefault("RAYON_NUM_THREADS", "1")
