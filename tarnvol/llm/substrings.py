"""Operators 3 and 7: passages that repeat, by words and by bytes.

Edge cases of both: null text has no units and nothing is removed from it; texts
shorter than a window are never touched; very long texts are one row of a
block and are never cut; rows that repeat a doc_id are documents of their own
(operator 3: elsewhere; operator 7: neither is smaller than the other); rows without
a doc_id count as larger than every id and as equal to each other; equal texts are
as many occurrences; an empty table gives an empty result; other columns, whatever
their names, are passed by.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import documents, key_and_text, ship
from .windows import Block, Rule, mark

#: 35 words: windows of 35 consecutive words that start anywhere else; anchors of 8 words.
WORDS = Rule(length=35, gram=8, earlier=False, words=True)
#: 50 bytes that a smaller doc_id has; anchors of 16 bytes.
BYTES = Rule(length=50, gram=16, earlier=True, words=False)


def _kept_words(block: Block, gone: np.ndarray) -> list[bytes]:
    out = []
    for a, b, x, y in zip(block.of[:-1].tolist(), block.of[1:].tolist(), block.bounds[:-1].tolist(), block.bounds[1:].tolist(), strict=True):
        words = block.data[x:y].tobytes().split()  # at the six ASCII spaces
        out.append(b" ".join(compress(words, (~gone[a:b]).tolist()) if gone[a:b].any() else words))
    return out


def _kept_bytes(block: Block, gone: np.ndarray) -> tuple[list[bytes], list[int]]:
    out, runs = [], []
    for a, b in zip(block.of[:-1].tolist(), block.of[1:].tolist(), strict=True):
        g = gone[a:b]
        runs.append(int(g[:1].sum() + np.count_nonzero(g[1:] & ~g[:-1])))
        out.append(block.data[a:b][~g].tobytes() if runs[-1] else block.data[a:b].tobytes())
    return out, runs


def _sums(block: Block, gone: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(gone)])
    return total[block.of[1:]] - total[block.of[:-1]]


def drop_repeated_words(docs: DataFrame, rule: Rule = WORDS) -> DataFrame:
    """doc_id, n_words, n_removed and the kept words joined by one space (binary, UTF-8)."""

    def finish(table: pa.Table, block: Block, gone: np.ndarray) -> pa.Table:
        return pa.table([table["doc_id"], pa.array(np.diff(block.of), pa.int64()), pa.array(_sums(block, gone), pa.int64()), pa.array(_kept_words(block, gone), pa.binary())], names=["doc_id", "n_words", "n_removed", "kept"])

    return mark(key_and_text(docs), rule, finish, "doc_id long, n_words long, n_removed long, kept binary")


def cut_repeated_words(docs: DataFrame, rule: Rule = WORDS) -> DataFrame:
    """``docs``, all columns, with repeated words cut out of ``text``; the white space before them stays.

    A text without such words, or a null one, is unchanged; ``n_chars``, if there is one, follows the text.
    """
    ship(docs.sparkSession)
    schema, names = docs.schema, docs.columns

    def finish(table: pa.Table, block: Block, gone: np.ndarray) -> pa.Table:
        n = len(block.data)
        change = np.zeros(n + 1, np.int64)
        until = np.append(block.starts[1:], n)
        last = np.append(block.of[1:], 0)[np.searchsorted(block.of, np.arange(len(block.starts)), side="right") - 1] - 1 == np.arange(len(block.starts))
        edge = np.append(block.bounds[1:], n)[np.searchsorted(block.bounds, block.starts, side="right") - 1] if len(block.starts) else until
        until = np.where(last, edge, until)
        np.add.at(change, block.starts[gone], 1)
        np.add.at(change, until[gone], -1)
        keep = np.cumsum(change)[:n] == 0
        touched = _sums(block, gone) > 0
        texts = [block.data[a:b][keep[a:b]].tobytes().decode() for a, b, t in zip(block.bounds[:-1], block.bounds[1:], touched, strict=True) if t]
        return pa.table([table["row"], pa.array(touched), pa.array(_spread(texts, touched), pa.string())], names=["row", "touched", "kept"])

    held = key_and_text_with(docs)
    out = mark(held, rule, finish, T.StructType([T.StructField("row", held.schema["row"].dataType), T.StructField("touched", T.BooleanType()), T.StructField("kept", T.StringType())]))
    text = F.when(F.col("touched"), F.col("kept")).otherwise(F.col("row.text"))
    new = {"text": text, "n_chars": F.when(F.col("touched"), F.length("kept")).otherwise(F.col("row.n_chars"))} if "n_chars" in names else {"text": text}
    return out.select(*(new.get(c, F.col(f"row.`{c}`")).cast(schema[c].dataType).alias(c) for c in names))


def _spread(texts: list[str], where: np.ndarray) -> list[str | None]:
    rest = iter(texts)
    return [next(rest) if w else None for w in where.tolist()]


def key_and_text_with(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))


def drop_earlier_bytes(docs: DataFrame, rule: Rule = BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the remaining bytes."""

    def finish(table: pa.Table, block: Block, gone: np.ndarray) -> pa.Table:
        kept, runs = _kept_bytes(block, gone)
        return pa.table([table["doc_id"], pa.array(np.diff(block.of), pa.int64()), pa.array(_sums(block, gone), pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return mark(key_and_text(docs), rule, finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeated_words(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_earlier_bytes(documents(spark, sf_dir)).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
