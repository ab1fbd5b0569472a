"""Operator 1: token-id shards with a minimal perfect hash index.

Shards are flat files of records in ascending doc_id order, written by Spark's
own committer (so retries and lost executors leave one copy):

    doc_id int64 | has_id u8 | n_tokens u32 | n_tokens ids (u16 or u32) | 0x0A

all little-endian.  The index maps a doc_id in constant time to (shard, byte
offset, length): keys are dealt to buckets by hash, every bucket holds a
cascade of collision-free bit arrays (rank of the set bit = slot) and, per slot,
a 32-bit fingerprint of the key, so a key that was never stored is told apart.

Edge cases: null text is empty text (only the end id); rows without a doc_id are
stored first and read by scan, having no key; rows that repeat a doc_id lie side
by side and one key answers for all of them; an empty table gives no records;
other columns are never read.
"""

from __future__ import annotations

import math
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import documents, key_and_text, stage, staging_path, until_exit, vocabulary
from .chunks import library_encoder

_HEAD = "<qBI"
_HEAD_BYTES = struct.calcsize(_HEAD)
#: Bits of the first array for each key.
GAMMA = 2
#: Keys in an index bucket, about; text bytes in a shard, about.
BUCKET_KEYS = 20_000
SHARD_BYTES = 8 << 20


@dataclass(frozen=True)
class Shards:
    path: str
    width: int
    count: int


def _arrow_rows(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def write_shards(docs: DataFrame, tokenizer: str | None = None, end_id: int = 2, shard_bytes: int = SHARD_BYTES) -> Shards:
    """One range shuffle of the texts, encoding at its far side, one flat file a shard."""
    from tokenizers import Tokenizer

    file = tokenizer or vocabulary("byte_bpe_50k.json")
    width = 2 if max(Tokenizer.from_file(file).get_vocab_size(), end_id + 1) <= 1 << 16 else 4
    src = key_and_text(docs)
    total = src.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    n = max(1, -(-total // shard_bytes))

    def run(batches):
        enc, end = library_encoder(file, width), int(end_id).to_bytes(width, "little")
        for part in _arrow_rows(batches, 512):
            out = []
            for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                ids = enc.encode(text) + end
                out.append(struct.pack(_HEAD, key or 0, key is not None, len(ids) // width) + ids)
            yield pa.record_batch([pa.array(out, pa.binary())], names=["record"])

    path = staging_path(docs.sparkSession, "shards")
    # Rows of one doc_id lie side by side; rows without one are spread by their texts.
    apart = F.when(F.col("doc_id").isNull(), F.xxhash64("text"))
    ranged = src.repartitionByRange(n, F.col("doc_id"), apart).sortWithinPartitions("doc_id", apart, "text")
    ranged.mapInArrow(run, "record binary").select(F.col("record").cast("string")).write.option("compression", "none").text(path)
    until_exit(docs.sparkSession, path)
    return Shards(path, width, n)


def _records(data: bytes, width: int) -> Iterator[tuple[int, bool, int, int]]:
    at = 0
    while at < len(data):
        key, has, n = struct.unpack_from(_HEAD, data, at)
        yield key, bool(has), n, at
        at += _HEAD_BYTES + n * width + 1


def directory(spark: SparkSession, shards: Shards) -> DataFrame:
    """Every record's place: shard, file, offset (bytes), start (ids before it in the shard), n_tokens; read from the files."""

    def run(batches):
        for part in _arrow_rows(batches, 1):
            path, data = part.column(0)[0].as_py(), part.column(1)[0].as_buffer()
            rows = list(_records(memoryview(data), shards.width))
            if not rows:
                continue
            key, has, n, at = (np.array(x) for x in zip(*rows, strict=True))
            shard = int(re.search(r"part-(\d+)", path)[1])
            yield pa.record_batch(
                [
                    pa.array(key, pa.int64(), mask=~has.astype(bool)), pa.array(np.full(len(n), shard), pa.int32()), pa.array([path] * len(n)),
                    pa.array(at, pa.int64()), pa.array(np.cumsum(n) - n, pa.int64()), pa.array(n, pa.int64()),
                ],
                names=["doc_id", "shard", "file", "offset", "start", "n_tokens"],
            )

    files = spark.read.format("binaryFile").load(shards.path).select("path", "content")
    return files.mapInArrow(run, "doc_id long, shard int, file string, offset long, start long, n_tokens long")


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    x = keys.astype(np.uint64) + np.uint64((seed + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def build_levels(keys: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Bit arrays of a minimal perfect hash over distinct ``keys`` and the slot of every key."""
    levels, slots, left, base = [], np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
    while len(left):
        size = max(64, GAMMA * len(left))
        at = (_mix(keys[left], len(levels)) % np.uint64(size)).astype(np.int64)
        bits = np.bincount(at, minlength=size) == 1
        rank = np.cumsum(bits) - bits
        alone = bits[at]
        slots[left[alone]] = base + rank[at[alone]]
        base += int(bits.sum())
        left = left[~alone]
        levels.append(bits)
    return levels, slots


def find_slots(keys: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """Slot of every key, -1 where no level has it (surely not stored)."""
    slots, left, base = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
    for k, bits in enumerate(levels):
        at = (_mix(keys[left], k) % np.uint64(len(bits))).astype(np.int64)
        hit = bits[at]
        slots[left[hit]] = base + (np.cumsum(bits) - bits)[at[hit]]
        base += int(bits.sum())
        left = left[~hit]
    return slots


def _fingerprint(keys: np.ndarray) -> np.ndarray:
    return (_mix(keys, 1 << 20) >> np.uint64(32)).astype("<u4")


def _bucket(n: int):
    return F.pmod(F.xxhash64("doc_id"), F.lit(n)).cast("int").alias("bucket")


INDEX = "bucket int, n long, sizes array<int>, bits binary, fingerprint binary, shard binary, offset binary, n_tokens binary, copies binary"


def build_index(entries: DataFrame, bucket_keys: int = BUCKET_KEYS) -> tuple[DataFrame, int]:
    """One row a bucket; buckets hold about ``bucket_keys`` keys, so each fits a task at any corpus size."""
    keyed = entries.where("doc_id is not null").groupBy("doc_id").agg(F.min(F.struct("shard", "offset", "n_tokens")).alias("at"), F.count("*").alias("copies"))
    n = max(1, -(-entries.count() // bucket_keys))

    def build(table: pa.Table) -> pa.Table:
        keys = table["doc_id"].to_numpy()
        levels, slots = build_levels(keys)
        order = np.argsort(slots)

        def packed(name: str, kind: str) -> bytes:
            return table[name].to_numpy()[order].astype(kind).tobytes()

        row = {
            "bucket": [table["bucket"][0].as_py()], "n": [len(keys)], "sizes": [[len(b) for b in levels]], "bits": [np.packbits(np.concatenate(levels)).tobytes()],
            "fingerprint": [_fingerprint(keys)[order].tobytes()], "shard": [packed("shard", "<i4")], "offset": [packed("offset", "<i8")], "n_tokens": [packed("n_tokens", "<i8")], "copies": [packed("copies", "<i4")],
        }
        return pa.table(row, schema=pa.schema([("bucket", pa.int32()), ("n", pa.int64()), ("sizes", pa.list_(pa.int32())), *((c, pa.binary()) for c in ("bits", "fingerprint", "shard", "offset", "n_tokens", "copies"))]))

    flat = keyed.select("doc_id", "at.*", "copies").withColumn("bucket", _bucket(n))
    return flat.groupBy("bucket").applyInArrow(build, INDEX), n


def look_up(keys: DataFrame, index: DataFrame, n: int) -> DataFrame:
    """shard, offset, n_tokens, copies of each requested ``doc_id``; no row for a key that was not stored."""

    def probe(wanted: pa.Table, index: pa.Table) -> pa.Table:
        names = ["doc_id", "shard", "offset", "n_tokens", "copies"]
        schema = pa.schema([("doc_id", pa.int64()), ("shard", pa.int32()), ("offset", pa.int64()), ("n_tokens", pa.int64()), ("copies", pa.int32())])
        if not wanted.num_rows or not index.num_rows:
            return schema.empty_table()
        row = index.to_pylist()[0]
        bits = np.unpackbits(np.frombuffer(row["bits"], np.uint8)).astype(bool)
        levels, at = [], 0
        for size in row["sizes"]:
            levels.append(bits[at : at + size])
            at += size
        keys = wanted["doc_id"].to_numpy()
        slots = find_slots(keys, levels)
        sure = slots >= 0
        sure[sure] = np.frombuffer(row["fingerprint"], "<u4")[slots[sure]] == _fingerprint(keys[sure])
        cols = [keys[sure], *(np.frombuffer(row[c], k)[slots[sure]] for c, k in (("shard", "<i4"), ("offset", "<i8"), ("n_tokens", "<i8"), ("copies", "<i4")))]
        return pa.table([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], names=names)

    wanted = keys.select("doc_id").where("doc_id is not null").withColumn("bucket", _bucket(n))
    return wanted.groupBy("bucket").cogroup(index.groupBy("bucket")).applyInArrow(probe, "doc_id long, shard int, offset long, n_tokens long, copies int")


def _direct(path: str):
    """A file system that executors can open for positioned reads, or None."""
    from pyarrow import fs

    try:
        store, inner = fs.FileSystem.from_uri(path)
        store.get_file_info(inner)
        return store
    except Exception:  # noqa: BLE001  no such client here: read whole files through Spark
        return None


def read_payload(spark: SparkSession, found: DataFrame, places: DataFrame, shards: Shards, fold) -> DataFrame:
    """``fold(ids) -> int`` of every found record.  Requests of a shard go to one task, which reads the ranges it was told."""
    width = shards.width
    names = places.groupBy("shard").agg(F.min("file").alias("file"))
    wanted = found.join(names, "shard")
    out = "doc_id long, shard int, offset long, n_tokens long, value long"

    def answer(keys, shard, offset, n, value):
        return pa.record_batch([pa.array(keys, pa.int64()), pa.array(shard, pa.int32()), pa.array(offset, pa.int64()), pa.array(n, pa.int64()), pa.array(value, pa.int64())], names=["doc_id", "shard", "offset", "n_tokens", "value"])

    def records(rows, read):
        got = []
        for key, shard, offset, n, copies in rows:
            for _ in range(copies):
                head = bytes(read(offset, _HEAD_BYTES))
                stored, has, n = struct.unpack(_HEAD, head)
                if has != (key is not None) or (has and stored != key):
                    raise ValueError(f"record at shard {shard}, offset {offset} is not that of doc_id {key}")
                got.append((key, shard, offset, n, fold(bytes(read(offset + _HEAD_BYTES, n * width)))))
                offset += _HEAD_BYTES + n * width + 1
        return answer(*zip(*got, strict=True))

    if _direct(shards.path) is not None:

        def ranges(batches):
            from pyarrow import fs

            name = handle = None
            for part in _arrow_rows(batches, 4096):
                rows = part.to_pylist()
                at = 0
                while at < len(rows):
                    end = at
                    while end < len(rows) and rows[end]["file"] == rows[at]["file"]:
                        end += 1
                    if name != rows[at]["file"]:
                        name = rows[at]["file"]
                        store, inner = fs.FileSystem.from_uri(name)
                        handle = store.open_input_file(inner)

                    def read(offset, size, handle=handle):
                        handle.seek(offset)
                        return handle.read(size)

                    yield records([(r["doc_id"], r["shard"], r["offset"], r["n_tokens"], r["copies"]) for r in rows[at:end]], read)
                    at = end

        wide = min(shards.count, 4 * max(1, spark.sparkContext.defaultParallelism) * 64)
        return wanted.repartition(wide, "shard").sortWithinPartitions("shard", "offset").mapInArrow(ranges, out)

    def join(wanted: pa.Table, content: pa.Table) -> pa.Table:
        if not wanted.num_rows:
            return pa.Table.from_batches([answer([], [], [], [], [])])
        data = memoryview(content["content"][0].as_buffer())
        rows = [(r["doc_id"], r["shard"], r["offset"], r["n_tokens"], r["copies"]) for r in wanted.to_pylist()]
        return pa.Table.from_batches([records(rows, lambda offset, size: data[offset : offset + size])])

    content = spark.read.format("binaryFile").load(shards.path).select(F.regexp_extract("path", r"part-(\d+)", 1).cast("int").alias("shard"), "content")
    return found.groupBy("shard").cogroup(content.groupBy("shard")).applyInArrow(join, out)


def shard_bases(places: DataFrame, shards: int) -> DataFrame:
    """shard, base: the ids of all shards before it, by prefix sums in two levels of about the root of the shards each."""
    run = max(1, math.isqrt(shards))
    per = places.groupBy("shard").agg(F.sum("n_tokens").alias("ids")).withColumn("run", F.floor(F.col("shard") / run))
    runs = per.groupBy("run").agg(F.sum("ids").alias("all"))
    before = runs.select("run", (F.sum("all").over(Window.orderBy("run")) - F.col("all")).alias("before"))
    inside = (F.sum("ids").over(Window.partitionBy("run").orderBy("shard")) - F.col("ids")).alias("inside")
    return per.select("shard", "run", inside).join(before, "run").select("shard", (F.col("before") + F.col("inside")).alias("base"))


def op1_token_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode, write, index, then fetch every document's ids through the index."""
    docs = documents(spark, sf_dir)
    shards = write_shards(docs)
    places = stage(directory(spark, shards), "directory")
    index, n = build_index(places)
    index = stage(index, "mph")
    keys = key_and_text(docs).select("doc_id").where("doc_id is not null").distinct()
    keyless = places.where("doc_id is null").select("doc_id", "shard", "offset", "n_tokens", F.lit(1).alias("copies"))
    found = look_up(keys, index, n).unionByName(keyless)
    width = shards.width

    def crc(ids: bytes) -> int:
        return zlib.crc32(np.frombuffer(ids, f"<u{width}").astype("<u4").tobytes())

    got = read_payload(spark, found, places, shards, crc)
    bases = shard_bases(places, shards.count)
    starts = places.select("shard", "offset", "start").join(bases, "shard")
    return got.join(starts, ["shard", "offset"]).select("doc_id", (F.col("base") + F.col("start")).alias("start"), "n_tokens", F.col("value").alias("ids_crc32"), "shard", "offset")
