"""Operator 4: exact de-duplication by progressive refinement, in DataFrame functions only.

One scan measures each text (length, hash of a short prefix, full hash of the normalised
text).  Rows are then grouped by length; rows whose length another row has are
grouped by length and prefix hash; only what survives both is grouped by full hash,
so the wide key is shuffled for real candidates only.  Every grouping is a
partial aggregate before its shuffle, so a text that fills a third of the table costs a
row for each task.

Edge cases: null text equals empty text; a text of white space equals one space; rows that
repeat a doc_id and its text share one verdict; rows without a doc_id never
stay before rows that have one, and a group of such rows alone has a null
keep_id and keeps all; an empty table gives an empty result; other columns are
not read here and are carried untouched by ``drop_exact``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import WS_CLASS, documents, grouped, key_and_text, own_name, stage, text_hash, without

#: Characters of the prefix level.
PREFIX = 64


def measured(docs: DataFrame) -> DataFrame:
    norm = F.regexp_replace("text", WS_CLASS, " ")
    return key_and_text(docs).select("doc_id", text_hash().alias("h"), norm.alias("norm")).select("doc_id", "h", F.length("norm").alias("n"), F.xxhash64(F.substring("norm", 1, PREFIX)).alias("prefix"), F.sha2("norm", 256).alias("text_sha256"))


def refine(rows: DataFrame) -> DataFrame:
    """Groups of two or more equal texts: n, prefix, text_sha256, keep_id, group_size."""

    def repeated(df: DataFrame, *keys: str) -> DataFrame:
        return grouped(df, [*keys], F.count("*").alias("_c")).where("_c > 1").drop("_c")

    by_length = rows.join(repeated(rows, "n"), "n", "left_semi")
    by_prefix = by_length.join(repeated(by_length, "n", "prefix"), ["n", "prefix"], "left_semi")
    return grouped(by_prefix, ["n", "prefix", "text_sha256"], F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size")).where("group_size > 1")


def verdicts(docs: DataFrame) -> DataFrame:
    rows = stage(measured(docs), "measured")
    found = rows.join(refine(rows), ["n", "prefix", "text_sha256"], "left")
    keep = F.coalesce("keep_id", "doc_id")
    return found.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), F.coalesce(keep == F.col("doc_id"), keep.isNull()).alias("kept"), "text_sha256", "h")


def exact_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row."""
    return verdicts(docs).drop("h")


def drop_exact(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, all columns; of rows that repeat a doc_id and its text to the byte, one, whichever.

    Rows that repeat a doc_id with other texts are judged by their texts.  Rows without a doc_id go
    where a row that has one has their text, else all stay.
    """
    told = stage(verdicts(docs), "verdicts")
    gone = told.where("not kept")
    left = without(docs, gone.where("doc_id is not null").select("doc_id", "h"))
    lost = gone.where("doc_id is null").select("h").distinct()
    if not lost.isEmpty():
        h = own_name(docs, "_h")
        left = left.join(lost.select(F.col("h").alias(h)), left["doc_id"].isNull() & (F.xxhash64(F.coalesce(left["text"].cast("string"), F.lit(""))) == F.col(h)), "left_anti")
    again = stage(grouped(told.where("kept and doc_id is not null"), ["doc_id"], F.count("*").alias("c")).where("c > 1").select("doc_id"), "again")
    if again.isEmpty():
        return left
    # Only rows that share a doc_id are compared with each other.
    key, h = own_name(docs, "_key"), own_name(docs, "_h")
    again = again.select(F.col("doc_id").alias(key))
    several = left.join(again, left["doc_id"].cast("long") == F.col(key), "left_semi")
    one = several.withColumn(h, F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))).dropDuplicates(["doc_id", h]).drop(h)
    return left.join(again, left["doc_id"].cast("long") == F.col(key), "left_anti").unionByName(one)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


OP4_SQL = r"""
WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM n JOIN g USING (text_sha256)
"""
