"""Operator 2: shards of near equal bytes that keep equal texts together.

The groups (rows of equal text) are put in order of their first document and cut into
contiguous runs so that the largest run is as small as can be: the smallest
feasible capacity is found by binary search, a capacity being feasible if greedy
filling needs no more runs than there are shards.

The order is never gathered.  The driver holds *cells* — runs of consecutive
groups with their bytes — CELLS at first, and SPLIT for each that a cut may fall into.  On cells, greedy filling gives a
lower bound (a cell may be cut anywhere) and an upper bound (only between
cells); cells in which some cut may lie are split by one aggregation, until both
bounds agree and every cut lies between two groups.  The answer is exact.

Edge cases: null text has 16 bytes and equals empty text; rows without a doc_id order
last; rows that repeat a doc_id get slots of their own; an empty table gives
an empty result; fewer groups than shards leave shards empty; other columns are not
read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import documents, key_and_text, shuffle_width, stage

SHARDS = 40
#: Cells the order is first cut into, and a cell at a time later.
CELLS, SPLIT = 8192, 64

Cell = tuple[int, int, int]  # first rank, groups, bytes


def _fill(cells: list[Cell], capacity: int, anywhere: bool) -> tuple[int, list[int]]:
    """Runs needed, and the byte positions of their starts; ``anywhere``: cells of several groups may be cut at any byte."""
    runs, start, at = 1, 0, 0
    starts = [0]
    for _, groups, size in cells:
        end = at + size
        while end - start > capacity:
            if anywhere and groups > 1:
                start += capacity  # not before ``at``: the cell's start fitted
            else:
                if at == start:
                    return 1 << 60, starts  # the cell alone is too large
                start = at
            starts.append(start)
            runs += 1
            if runs > 1 << 20:
                return runs, starts
        at = end
    return runs, starts


def _least(cells: list[Cell], shards: int, low: int, high: int, anywhere: bool) -> int:
    while low < high:
        mid = (low + high) // 2
        if _fill(cells, mid, anywhere)[0] <= shards:
            high = mid
        else:
            low = mid + 1
    return low


def minimax_cuts(cells: list[Cell], largest: int, shards: int, split) -> tuple[int, list[int]]:
    """The least capacity and the start of every run in bytes; ``split(cells)`` gives finer cells for some."""
    total = sum(c[2] for c in cells)
    while True:
        bottom = max(largest, -(-total // shards))
        low = _least(cells, shards, bottom, total, True)
        high = _least(cells, shards, bottom, total, False)
        a, b = _fill(cells, low, False)[1] if low == high else None, None
        if low == high:
            return low, a
        # A cut of any capacity in between lies between the pessimistic cut of the least and the optimistic one of the most.
        early, b = [], _fill(cells, high, True)[1]
        start = at = 0
        early.append(0)
        for _, _, size in cells:
            while at + size - start > low:
                start = at if at > start else at + size
                early.append(start)
                if start > at:
                    break
            at += size
        ranges = [(early[i] if i < len(early) else b[i], b[i]) for i in range(len(b))]
        chosen, at, i = [], 0, 0
        spans = sorted((min(x, y), max(x, y)) for x, y in ranges)
        for cell in cells:
            end = at + cell[2]
            if cell[1] > 1 and any(x < end and y >= at for x, y in spans):
                chosen.append(cell)
            at = end
        if not chosen:
            chosen = [c for c in cells if c[1] > 1]
        finer = {c: split_cells for c, split_cells in split(chosen).items()}
        cells = [x for c in cells for x in finer.get(c, [c])]


def sized(docs: DataFrame) -> DataFrame:
    return key_and_text(docs).select("doc_id", F.octet_length("text").cast("long").alias("bytes"), F.crc32(F.col("text").cast("binary")).alias("text_crc32"), F.xxhash64("text").alias("h"))


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    spark = docs.sparkSession
    rows = stage(sized(docs).withColumn("size", F.col("bytes") + 16).withColumn("id", F.coalesce("doc_id", F.lit((1 << 63) - 1))), "sized")
    key = ["h", "text_crc32", "bytes"]
    groups = rows.groupBy(*key).agg(F.min("id").alias("first"), F.sum("size").alias("total"), F.count("*").alias("members"))
    width = max(8, shuffle_width(spark))
    # Order: range parts, then rows numbered in each part; parts meet in a prefix over one row each.
    parts = stage(groups.repartitionByRange(width, "first", "h").withColumn("part", F.spark_partition_id()), "groups")
    each = parts.groupBy("part").agg(F.count("*").alias("n"), F.sum("total").alias("b"), F.max("total").alias("most"))
    before, rank, at, largest = [], 0, 0, 0
    for r in sorted(each.collect()):  # one row a range part
        before.append((r["part"], rank, at))
        rank, at, largest = rank + r["n"], at + r["b"], max(largest, r["most"])
    if not before:
        before = [(0, 0, 0)]
    bases = spark.createDataFrame(before, "part int, base long, base_bytes long")
    inside = Window.partitionBy("part").orderBy("first", "h", "text_crc32", "bytes")
    placed = stage(
        parts.join(F.broadcast(bases), "part")  # one row a range part
        .withColumn("rank", F.col("base") + F.row_number().over(inside) - 1)
        .withColumn("start", F.col("base_bytes") + F.sum("total").over(inside) - F.col("total"))
        .select(*key, "total", "rank", "start"),
        "placed",
    )
    step = max(1, -(-rank // CELLS))

    def gather(df: DataFrame, cell) -> list[Cell]:
        got = df.groupBy(cell.alias("cell")).agg(F.min("rank"), F.count("*"), F.sum("total")).collect()  # at most CELLS rows, or SPLIT for a cell
        return sorted((r[1], r[2], r[3]) for r in got)

    def split(chosen: list[Cell]) -> dict[Cell, list[Cell]]:
        out: dict[Cell, list[Cell]] = {}
        for i in range(0, len(chosen), 256):
            some = chosen[i : i + 256]
            table = spark.createDataFrame([(a, a + n, max(1, -(-n // SPLIT))) for a, n, _ in some], "lo long, hi long, step long")
            hit = placed.join(F.broadcast(table), (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))  # 256 rows at most
            fine = gather(hit, F.struct("lo", F.floor((F.col("rank") - F.col("lo")) / F.col("step")).alias("k")))
            for c in some:
                out[c] = [x for x in fine if c[0] <= x[0] < c[0] + c[1]]
        return out

    cells = gather(placed, F.floor(F.col("rank") / step))
    _, cuts = minimax_cuts(cells, largest, shards, split) if cells else (0, [0])
    number = sum(((F.col("start") >= c).cast("int") for c in cuts[1:]), F.lit(0))
    home = placed.select(*key, number.alias("shard"))
    put = rows.join(home, key)
    # Slots: by blocks of rows; the blocks' counts meet in one small table, so no task holds a shard.
    blocks = 4 * width
    # Rows without a doc_id share one id: any number, made once before the rows are staged, spreads them.
    apart = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id())
    put = stage(put.withColumn("block", F.pmod(F.xxhash64("id", apart), F.lit(blocks)).cast("int")), "put")
    counts = put.groupBy("shard", "block").agg(F.count("*").alias("n"))
    first = counts.select("shard", "block", (F.sum("n").over(Window.partitionBy("shard").orderBy("block")) - F.col("n")).alias("first"))
    own = Window.partitionBy("shard", "block").orderBy("id", "text_crc32")
    return (
        put.withColumn("row", F.row_number().over(own))
        .join(first, ["shard", "block"])
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("first") + F.col("row") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )


def op2_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(documents(spark, sf_dir))
