"""Operator 10: best-fit decreasing packing of tokenised documents.

Lengths are whole numbers up to the capacity, so the items form at most
``capacity`` classes.  Best-fit decreasing treats members of a class alike;
it is therefore run on the class counts: a segment tree over remaining
capacities finds the tightest open bins, and a whole run of equal bins takes its
share of a class at once.  The outcome is a table of at most a few thousand
intervals "members i..j of class s go to bins b, b+1, ... at offset o" — its size
depends on the capacity, not on the corpus — and the items look their place up
by their rank within their class.  Nothing that grows with the corpus reaches the
driver, and the bins are those of the one-by-one procedure.

Edge cases: null text is empty text (one piece, the end id alone); texts longer
than the capacity are cut into full pieces and a last shorter one; equal lengths
and repeated rows are told apart by (doc_id, piece, crc) order, any order giving
as many bins; rows without a doc_id are packed too; an empty table packs into
nothing; other columns are never read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import documents, key_and_text, shuffle_width, stage, vocabulary
from .chunks import library_encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class TightestFit:
    """Segment tree over remaining capacities 0..capacity: which has open bins, and the least that is enough."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.open = [0] * (2 * self.leaves)

    def put(self, capacity: int, bins: int) -> None:
        at = self.leaves + capacity
        while at:
            self.open[at] += bins
            at >>= 1

    def find(self, least: int) -> int | None:
        """The smallest capacity of at least ``least`` that has an open bin."""
        at = self.leaves + least
        if self.open[at]:
            return least
        while at > 1:
            if at % 2 == 0 and self.open[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if self.open[2 * at] else 2 * at + 1
                return at - self.leaves
            at >>= 1
        return None


def pack_classes(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing on class counts.

    Rows (length, first rank, members, first bin, members a bin, offset): member
    ``first + i`` lies in bin ``bin + i // a`` at ``offset + length * (i % a)``.
    """
    tree, runs, out, new = TightestFit(capacity), {}, [], 0  # runs: remaining capacity -> [(first bin, bins)]

    def give(remaining: int, first: int, bins: int) -> None:
        if bins and remaining:
            runs.setdefault(remaining, []).append((first, bins))
            tree.put(remaining, bins)

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            room = tree.find(length)
            if room is None:
                # no bin fits: open as many as full ones need, the last perhaps less full
                each = capacity // length
                first, bins = new, -(-left // each)
                new += bins
                give(capacity, first, bins)
                continue
            first, bins = runs[room].pop()
            tree.put(room, -bins)
            each = room // length  # after one member the same bin is the tightest, as long as it fits
            full = min(bins, left // each)
            if full:
                out.append((length, rank, full * each, first, each, capacity - room))
                give(room - each * length, first, full)
                left, rank = left - full * each, rank + full * each
            if full < bins:
                if 0 < left < each:
                    out.append((length, rank, left, first + full, each, capacity - room))
                    give(room - left * length, first + full, 1)
                    full, left, rank = full + 1, 0, rank + left
                give(room, first + full, bins - full)
    return out


def cut(docs: DataFrame, capacity: int = 2048, tokenizer: str | None = None, end_id: int = 0) -> DataFrame:
    """Tokenise whole texts and cut them into pieces of at most ``capacity`` ids; one narrow pass."""
    file = tokenizer or vocabulary("word_bpe_49k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = library_encoder(file)
        kind = enc.dtype
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part, rows = batch.slice(at, 512), []
                for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    ids = np.append(np.frombuffer(enc.encode(text), kind).astype("<u4"), np.array([end_id], "<u4"))
                    for k, start in enumerate(range(0, len(ids), capacity)):
                        piece = ids[start : start + capacity]
                        rows.append((key, k, start, len(piece), zlib.crc32(piece.tobytes())))
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return key_and_text(docs).mapInArrow(run, PIECES)


def pack(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """``pieces`` (with ``doc_id, piece, length``; staged) plus sequence_id and offset."""
    spark = pieces.sparkSession
    # Ranks within a length: blocks by key, counts a block, and row numbers inside a block; no task sees a whole class.
    blocks = 4 * shuffle_width(spark)
    keyed = pieces.withColumn("_block", F.pmod(F.xxhash64("doc_id", "piece", *(c for c in ("ids_crc32",) if c in pieces.columns)), F.lit(blocks)).cast("int"))
    sizes = keyed.groupBy("length", "_block").agg(F.count("*").alias("_n"))
    before = sizes.select("length", "_block", (F.sum("_n").over(Window.partitionBy("length").orderBy("_block")) - F.col("_n")).alias("_before"))
    counts = {r[0]: r[1] for r in sizes.groupBy("length").agg(F.sum("_n")).collect()}  # at most ``capacity`` rows
    if any(n < 1 or n > capacity for n in counts):
        raise ValueError(f"lengths must be from 1 to {capacity}")
    runs = pack_classes(counts, capacity)
    firsts = {}
    for length, rank, *_ in runs:
        firsts.setdefault(length, []).append(rank)
    # Rows by (length, first rank): bounded by the capacity's arithmetic, a few thousand at 2048.
    table = {(r[0], r[1]): r for r in runs}
    flat = [(length, [(table[length, f][1], table[length, f][3], table[length, f][4], table[length, f][5]) for f in fs]) for length, fs in firsts.items()]
    places = spark.createDataFrame(flat, "length long, runs array<struct<first:long,bin:long,each:long,offset:long>>")
    own = Window.partitionBy("length", "_block").orderBy("doc_id", "piece", *(c for c in ("ids_crc32",) if c in pieces.columns))
    ranked = keyed.withColumn("_row", F.row_number().over(own)).join(before, ["length", "_block"]).withColumn("_rank", F.col("_before") + F.col("_row") - 1)
    run = F.element_at(F.filter("runs", lambda x: x["first"] <= F.col("_rank")), -1)
    i = F.col("_rank") - F.col("_run.first")
    return (
        ranked.join(F.broadcast(places), "length")
        .withColumn("_run", run)
        .select(*pieces.columns, (F.col("_run.bin") + F.floor(i / F.col("_run.each")).cast("long")).alias("sequence_id"), (F.col("_run.offset") + F.col("length") * F.pmod(i, F.col("_run.each"))).alias("offset"))
    )


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(stage(cut(documents(spark, sf_dir)), "pieces"))
