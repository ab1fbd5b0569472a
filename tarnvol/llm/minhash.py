"""Operator 9: near-duplicate components by b-bit MinHash, confirmed on full shingle sets.

* One pass over the texts makes each document's distinct shingle hashes (64 bits, mixed after
  each word, so that no linear relation of the texts survives), a 128-bit BLAKE2 digest of the
  whole set, band keys from the full minima and a packed signature of the low ``BITS``
  bits of each minimum.  Documents whose whole sets have one digest are one *node* from then
  on, however many copies there are.
* Band keys shared by several nodes make candidates.  Similarity is estimated from the
  packed signatures by exclusive-or and bit counts, corrected for the ``2**-BITS`` of
  positions that agree by chance; the estimate chooses the pairs of round 1 and decides nothing.
* Round 1: each node is confirmed against the best of its buckets' leaders, one pair a
  node, on full sets dealt by hub and chunk.
* Round 2: nodes of a bucket that are still in different components meet with their
  full sets, in chunks of bounded size (small groups of buckets at once, others bucket by bucket); all pairs with a band in common are counted inside the task, and
  only links that join two components leave it.  A pair already connected needs no check.

Edge cases: null text and texts without words have an empty set, no link and
themselves as component; fewer words than a shingle make one shingle of all; rows
that repeat a doc_id are nodes by their own texts; rows without a doc_id count as larger
than every id and their component is null only if nothing in it has an id; very
long texts are one row; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import documents, grouped, key_and_text, shuffle_width, stage, text_hash, without
from .components import components
from .windows import _SEP, U, hash_bytes, hash_units, mix, trimmed

BANDS, ROWS, BITS = 32, 4, 4
#: Round 1 tries estimates down to this far below the threshold; what it leaves out meets in round 2.
MARGIN = 0.15
#: Members of a bucket that one task compares with each other; pairs that one confirming task holds.
CHUNK, PAIRS = 1024, 1500
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_RNG = np.random.default_rng(20240229)
_FACTORS = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * U(2) + U(1)
LAST = (1 << 63) - 1


def slices(batches: Iterator[pa.RecordBatch], most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Runs of rows of about ``most`` text bytes; one row at least."""
    for batch in batches:
        size = np.cumsum(np.concatenate([[0], pa.compute.binary_length(batch.column("text")).to_numpy(zero_copy_only=False)]))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(size, size[at] + most, side="right")) - 1)
            yield batch.slice(at, end - at)
            at = end


def shingle_sets(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted, and the bounds of each text's part."""
    texts = texts.cast(pa.large_string())
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8)[bounds[0] : bounds[-1]] if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    data, bounds = _LOWER[data], bounds - bounds[0]
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds] = True
    inside = np.concatenate([[False], ~_SEP[data], [False]])
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | edge[:-1]))
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | edge[1:])) + 1
    word = hash_bytes(data, starts, ends - starts)
    of = np.searchsorted(starts, bounds)
    n = np.diff(of)
    many = np.where(n >= words, n - words + 1, (n > 0).astype(np.int64))
    doc = np.repeat(np.arange(len(n)), many)
    first = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many) + of[:-1][doc]
    h = hash_units(word, first, np.minimum(words, of[1:][doc] - first))
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[fresh], doc[fresh]
    return h, np.searchsorted(doc, np.arange(len(n) + 1))


def _nodes(h: np.ndarray, at: np.ndarray) -> list[bytes | None]:
    """128 bits of each whole set; None for an empty one."""
    return [hashlib.blake2b(h[a:b].tobytes(), digest_size=16).digest() if b > a else None for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


SIGNED = "doc_id long, h long, n long, node binary, sig array<long>, bands array<long>"


def sign(docs: DataFrame, words: int) -> DataFrame:
    def run(batches):
        for part in slices(batches):
            h, at = shingle_sets(part.column("text"), words)
            n = np.diff(at)
            some = np.flatnonzero(n)
            rows = {"doc_id": part.column("doc_id"), "h": part.column("h"), "n": pa.array(n, pa.int64()), "node": pa.array(_nodes(h, at), pa.binary())}
            sig, bands = np.zeros((len(n), BANDS * ROWS * BITS // 64), U), np.zeros((len(n), BANDS), U)
            if len(some):
                begin = at[:-1][some]
                least = np.stack([np.minimum.reduceat(h * a, begin) for a in _FACTORS], 1)
                low = mix(least) & U((1 << BITS) - 1)
                per = 64 // BITS
                sig[some] = np.bitwise_or.reduce(low.reshape(len(some), -1, per) << (np.arange(per, dtype=U) * U(BITS)), axis=2)
                key = np.zeros((len(some), BANDS), U)
                for r in range(ROWS):
                    key = mix(key * U(0x9E3779B97F4A7C15) + least.reshape(len(some), BANDS, ROWS)[:, :, r])
                bands[some] = mix(key + np.arange(BANDS, dtype=U))
            for name, x in (("sig", sig), ("bands", bands)):
                rows[name] = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.view(np.int64).ravel()))
            yield pa.record_batch(list(rows.values()), names=list(rows))

    return key_and_text(docs).withColumn("h", text_hash()).mapInArrow(run, SIGNED)


def agreement(a: Column, b: Column) -> Column:
    """Collision-corrected similarity of two packed signatures (BITS = 4), from bit counts."""
    words = BANDS * ROWS * BITS // 64
    other = F.lit(0)
    for i in range(words):
        x = F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        other = other + F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111)))
    chance = 2.0**-BITS
    return (1 - other / F.lit(BANDS * ROWS) - chance) / (1 - chance)


def full_sets(docs: DataFrame, nodes: DataFrame, needed: DataFrame, words: int) -> DataFrame:
    """node, shingles (sorted hashes, binary) of the ``needed`` nodes, from their least documents' whole texts."""
    wanted = nodes.join(needed, "node").select("rep", F.col("h").alias("rep_h"), "node")

    def sets(batches):
        for batch in batches:
            for part in slices([batch]):
                h, at = shingle_sets(part.column("text"), words)
                mine = np.array([x == y for x, y in zip(_nodes(h, at), part.column("node").to_pylist(), strict=True)], bool)
                yield pa.record_batch([part.column("node").filter(pa.array(mine)), pa.array([h[a:b].tobytes() for a, b, m in zip(at[:-1], at[1:], mine, strict=True) if m], pa.binary())], names=["node", "shingles"])

    # By id and text hash: rows without an id share one id, and are told apart by their texts.
    texts = key_and_text(docs).withColumn("id", F.coalesce("doc_id", F.lit(LAST))).withColumn("h", text_hash()).join(wanted, (F.col("id") == F.col("rep")) & (F.col("h") == F.col("rep_h"))).select("node", "text")
    # Rows that repeat a doc_id and a text give one set.
    return stage(texts.mapInArrow(sets, "node binary, shingles binary").dropDuplicates(["node"]), "sets")


def _confirm(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes whose full sets are linked."""
    spark = pairs.sparkSession
    needed = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    held = full_sets(docs, nodes, needed, words)
    hubs = grouped(pairs, ["a"], F.count("*").alias("c")).withColumn("chunks", F.ceil(F.col("c") / PAIRS).cast("int"))
    count = pairs.count()
    tasks = max(1, shuffle_width(spark), -(-count // PAIRS))
    chunk = F.pmod(F.xxhash64("b"), F.col("chunks")).cast("int")
    key = F.pmod(F.xxhash64("a", "chunk"), F.lit(tasks)).cast("int")
    partners = pairs.join(hubs, "a").withColumn("chunk", chunk).join(held.withColumnRenamed("node", "b"), "b").select("a", "chunk", "b", "shingles")
    centres = hubs.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).join(held.withColumnRenamed("node", "a"), "a").select("a", "chunk", F.lit(None).cast("binary").alias("b"), "shingles")
    dealt = partners.unionByName(centres).withColumn("key", key)

    def compare(table):
        a, chunk, b = table["a"].to_pylist(), table["chunk"].to_pylist(), table["b"].to_pylist()
        sets = [np.frombuffer(x.as_buffer(), U) for x in table["shingles"]]
        hub = {(a[i], chunk[i]): sets[i] for i in range(len(a)) if b[i] is None}
        left, right = [], []
        for i in range(len(a)):
            if b[i] is None:
                continue
            x, y = hub[a[i], chunk[i]], sets[i]
            if len(y) > len(x):
                x, y = y, x
            at = np.searchsorted(x, y)
            both = int(np.count_nonzero(x[np.minimum(at, len(x) - 1)] == y))
            if 100 * both >= percent * (len(x) + len(y) - both):
                left.append(a[i])
                right.append(b[i])
        return pa.table([pa.array(left, pa.binary()), pa.array(right, pa.binary())], names=["a", "b"])

    return dealt.repartition(tasks, "key").groupBy("key").applyInArrow(compare, "a binary, b binary")


def _between(rows: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that connect different ``root``s inside a ``unit``; rows have unit, by_bucket, m (rows of the unit), node, root, n, bands, shingles.

    A unit of more than CHUNK rows is cut into chunks and each two chunks meet in one task, so memory is bounded.
    A task counts the full sets of all pairs that share a band and whose parts are not yet joined, and
    gives a link only where it joins two parts: never all pairs of a group.  In a unit that is
    one bucket, a pair is counted where it shares its first band only.
    """
    chunks = F.ceil(F.col("m") / CHUNK).cast("int")
    met = rows.withColumn("own", F.pmod(F.xxhash64("node"), chunks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), chunks - 1)))
    met = met.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))
    tasks = max(shuffle_width(rows.sparkSession), -(-rows.count() // CHUNK))
    met = met.withColumn("task", F.pmod(F.xxhash64("unit", "i", "j"), F.lit(tasks)).cast("int")).drop("m", "other")

    def join(table):
        unit, i, j, n, own = (table[c].to_numpy() for c in ("unit", "i", "j", "n", "own"))
        one_bucket, node = table["by_bucket"].to_numpy(zero_copy_only=False), table["node"].to_pylist()
        roots = table["root"].to_pylist()
        number = {x: k for k, x in enumerate(dict.fromkeys(roots))}
        root = np.array([number[x] for x in roots], np.int64)
        bands = np.array(table["bands"].to_pylist(), np.int64)
        sets = [np.frombuffer(x.as_buffer(), U) for x in table["shingles"]]
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            while (up := parent.get(x, x)) != x:
                parent[x] = parent.get(up, up)
                x = up
            return x

        out_a, out_b = [], []
        order = np.lexsort((j, i, unit))
        cut = np.flatnonzero((np.diff(unit[order]) != 0) | (np.diff(i[order]) != 0) | (np.diff(j[order]) != 0)) + 1
        for g in np.split(order, cut):
            one, two = (g, g) if i[g[0]] == j[g[0]] else (g[own[g] == i[g]], g[own[g] == j[g]])
            for at, x in enumerate(one):
                y = two[at + 1 :] if one is two else two
                y = y[root[y] != root[x]]
                y = y[np.minimum(n[y], n[x]) * 100 >= np.maximum(n[y], n[x]) * percent]
                if len(y):
                    same = bands[y] == bands[x]
                    y = y[same.any(1) & ((bands[x][same.argmax(1)] == unit[x]) | ~one_bucket[x])]
                for k in range(0, len(y), 64):
                    mine = find(int(root[x]))
                    some = [z for z in y[k : k + 64] if find(int(root[z])) != mine]
                    if not some:
                        continue
                    flat = np.concatenate([sets[z] for z in some])
                    size = np.array([len(sets[z]) for z in some])
                    where = np.minimum(np.searchsorted(sets[x], flat), len(sets[x]) - 1)
                    both = np.add.reduceat(sets[x][where] == flat, np.cumsum(size) - size, dtype=np.int64)
                    for z in np.array(some)[100 * both >= percent * (len(sets[x]) + size - both)]:
                        a, b = find(int(root[x])), find(int(root[z]))
                        if a != b:
                            parent[a] = b
                            out_a.append(node[x])
                            out_b.append(node[z])
        return trimmed(pa.table([pa.array(out_a, pa.binary()), pa.array(out_b, pa.binary())], names=["a", "b"]))

    return stage(met.repartition(tasks, "task").groupBy("task").applyInArrow(join, "a binary, b binary"), "more")


def near_components(docs: DataFrame, words: int = 3, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row."""
    return near_rows(docs, words, percent).drop("h")


def near_rows(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, h (hash of the text, to tell rows of one doc_id apart); documents with ``100 * intersection >= percent * union`` are linked."""
    spark = docs.sparkSession
    floor = percent / 100 - MARGIN
    signed = stage(sign(docs, words).withColumn("id", F.coalesce("doc_id", F.lit(LAST))), "signed")
    # One row a node: that of its least document (equal sets have equal signatures); added up before the shuffle, however many copies there are.
    first = grouped(signed.where("n > 0"), ["node"], F.min(F.struct("id", "h", "n", "sig", "bands")).alias("x"))
    nodes = stage(first.select("node", F.col("x.id").alias("rep"), "x.h", "x.n", "x.sig", "x.bands"), "nodes")
    slim = nodes.select("node", "n", "sig")

    member = nodes.select("node", "rep", F.explode("bands").alias("bucket"))
    # The leader is the least document: where copies were made from one text, most likely that text.
    shared = grouped(member, ["bucket"], F.count("*").alias("m"), F.min(F.struct("rep", "node")).alias("l")).where("m > 1").select("bucket", F.col("l.node").alias("leader"))
    member = stage(member.join(shared, "bucket"), "members")

    def close(na: Column, nb: Column) -> Column:
        return F.least(na, nb) * 100 >= F.greatest(na, nb) * percent

    right = slim.select(F.col("node").alias("leader"), F.col("n").alias("n2"), F.col("sig").alias("sig2"))
    star = member.where("node != leader").select("node", "leader").distinct().join(slim, "node").join(right, "leader")
    star = star.where(close(F.col("n"), F.col("n2"))).withColumn("score", agreement(F.col("sig"), F.col("sig2"))).where(F.col("score") >= floor)
    first = stage(star.groupBy("node").agg(F.max(F.struct("score", "leader")).alias("best")).select(F.col("best.leader").alias("a"), F.col("node").alias("b")), "first")
    ids = nodes.select("node", "rep", "h")
    linked = stage(_confirm(first, docs, ids, words, percent), "linked")
    root = components(linked.select(F.col("a").alias("u"), F.col("b").alias("v")))

    # Round 2: what shares a bucket and is not yet connected.
    named = member.select("bucket", "node").join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = grouped(named, ["bucket"], F.min("root").alias("x"), F.max("root").alias("y"), F.min("node").alias("first"), F.count("*").alias("m")).where("x != y").select("bucket", "first", "m")
    open_ = stage(named.join(mixed, "bucket").select("bucket", "node", "root", "first", "m"), "open")
    group = components(open_.select(F.col("node").alias("u"), F.col("first").alias("v")))
    # Small groups of chained buckets meet as one, each set sent once; in large ones each bucket meets on its own.
    grp = open_.select("node", "root").distinct().join(group.withColumnRenamed("root", "grp"), "node", "left").withColumn("grp", F.coalesce("grp", "node"))
    each = stage(grp.join(grouped(grp, ["grp"], F.count("*").alias("size")), "grp"), "grouped")
    whole = each.where(F.col("size") <= CHUNK).select(F.xxhash64("grp").alias("unit"), F.lit(False).alias("by_bucket"), F.col("size").alias("m"), "node", "root")
    apart = open_.join(each.where(F.col("size") > CHUNK).select("node"), "node").select(F.col("bucket").alias("unit"), F.lit(True).alias("by_bucket"), "m", "node", "root")
    held = nodes.select("node", "n", "bands").join(full_sets(docs, ids, each.select("node"), words), "node")
    more = _between(stage(whole.unionByName(apart).join(held, "node"), "round2"), percent)
    label = lambda c: F.coalesce(F.col(c), F.col(c[0]))
    ra, rb = root.select(F.col("node").alias("a"), F.col("root").alias("a_root")), root.select(F.col("node").alias("b"), F.col("root").alias("b_root"))
    merged = components(more.join(ra, "a", "left").join(rb, "b", "left").select(label("a_root").alias("u"), label("b_root").alias("v")))
    # node -> root of round 1 -> root of round 2 -> least document of that component.
    last = merged.select(F.col("node").alias("root"), F.col("root").alias("final"))
    final = ids.drop("h").join(root, "node", "left").withColumn("root", F.coalesce("root", "node")).join(last, "root", "left").select("node", "rep", F.coalesce("final", "root").alias("final"))
    least = grouped(final, ["final"], F.min("rep").alias("component_id"))
    of_node = stage(final.join(least, "final").select("node", "component_id"), "of_node")
    out = signed.select("doc_id", "id", "h", "n", "node").join(of_node, "node", "left")
    component = F.coalesce("component_id", "id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(component != LAST, component).alias("component_id"), (F.col("id") == component).alias("kept"), "h")


def drop_near(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay, all columns; rows without a doc_id always do."""
    return without(docs, near_rows(docs, words, percent).where("not kept and doc_id is not null").select("doc_id", "h"))


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(documents(spark, sf_dir))
