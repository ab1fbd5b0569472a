"""Operator 8: lines that repeat up to a few edits, by a segment-partition join.

Two lines within ``edits`` edits share a segment: cut the shorter one into ``edits + 1``
even parts; one part is untouched and lies in the longer line at a shift the edits
allow.  Every distinct line therefore files its parts in an index by (length, part
number, content) and probes, for each length it can be near to, the few
substrings that may equal a part (the multi-match-aware selection).  File and
probe entries meet by hash, packed in blobs a task and key, so copies of one
line in a task's slice are entered once.  What meets is thinned by a character-count sketch that
no ``edits`` edits can move far.

A key's task gives no pairs, only the links that join its candidates into groups, fewer
than its entries.  The lines of a candidate group then meet with their texts, in chunks
where a group is large; there the same join finds the pairs, a banded bit-parallel edit
distance (one bit a diagonal) verifies each once, and the task gives the count of links of
each line and the links that join: never all pairs of a group.

Equal lines are one class, known by 128 bits of their whole text that are no linear function
of it; 64 of them stand for it in entries.

Lines are \\n-split parts with a word, unchanged; distances are in code points.
Lines shorter than ``least`` are classed by equality only.

Edge cases: null text has no lines; blank lines are no lines (their numbers stay
counted); equal lines are one class and need no link; lines that repeat inside one
document count as any other; rows that repeat a doc_id give the same (doc_id, line) twice; rows
without a doc_id order last; very long lines are handled whole; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import documents, grouped, key_and_text, shuffle_width, stage, text_hash
from .components import components
from .minhash import LAST, slices
from .windows import _BASE, U, hash_bytes, mix, prefix_sums, span_hash, trimmed

EDITS, LEAST = 2, 20
#: Bytes of entries in a key, about; entries that a task gathers before it sends them; pairs of a cross comparison at a time; lines of a candidate group in a chunk.
KEY_BYTES, GATHER, CROSS, CHUNK = 6 << 20, 400_000, 1 << 17, 512


def within(a: str, b: str, edits: int) -> bool:
    """Edit distance of at most ``edits``: reachable diagonals as bits, one word for each number of errors."""
    if abs(len(a) - len(b)) > edits:
        return False
    same = len(os.path.commonprefix((a, b)))
    a, b = a[same:], b[same:]
    tail = len(os.path.commonprefix((a[::-1], b[::-1])))
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    width, full = 2 * edits + 1, (1 << 2 * edits + 1) - 1
    reach = [0] * (edits + 1)
    reach[0] = 1 << edits
    for d in range(1, edits + 1):  # characters of b before any of a
        reach[d] = reach[d - 1] | reach[d - 1] << 1 & full
    for i, x in enumerate(a):
        hit = 0
        for j in range(width):
            k = i + j - edits
            if 0 <= k < len(b) and b[k] == x:
                hit |= 1 << j
        after = [reach[0] & hit]
        for d in range(1, edits + 1):
            after.append(reach[d] & hit | reach[d - 1] | reach[d - 1] >> 1 | after[d - 1] << 1 & full)
        if not after[-1]:
            return False
        reach = after
    j = len(b) - len(a) + edits
    return 0 <= j < width and bool(reach[-1] >> j & 1)


class Lines:
    """The lines of a batch of texts: bounds in code points, owner, number, identity."""

    def __init__(self, texts: list[str]):
        joined = "\n".join(texts) + "\n" if texts else ""
        self.points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
        self.ends = np.flatnonzero(self.points == 10)
        self.starts = np.concatenate([[0], self.ends[:-1] + 1]) if len(self.ends) else self.ends
        per = np.array([t.count("\n") + 1 for t in texts], np.int64)
        self.doc = np.repeat(np.arange(len(texts)), per)
        self.number = np.arange(len(self.ends)) - np.repeat(np.cumsum(per) - per, per)
        word = ~np.isin(self.points, [32, 9, 10, 11, 12, 13])
        total = np.concatenate([[0], np.cumsum(word)])
        some = total[self.ends] > total[self.starts]
        self.starts, self.ends, self.doc, self.number = (x[some] for x in (self.starts, self.ends, self.doc, self.number))
        self.length = self.ends - self.starts
        raw = self.points.view(np.uint8)
        self.node = hash_bytes(raw, 4 * self.starts, 4 * self.length, 1).view(np.int64)

    def check(self) -> np.ndarray:
        """The other half of each line's 128 bits."""
        return hash_bytes(self.points.view(np.uint8), 4 * self.starts, 4 * self.length, 2).view(np.int64)

    def sums(self) -> np.ndarray:
        return prefix_sums(_POINT[self.points & 0xFFFF] + self.points, _BASE)

    def text(self, i: int) -> str:
        return self.points[self.starts[i] : self.ends[i]].tobytes().decode("utf-32-le", "surrogatepass")

    def sketch(self, which: np.ndarray) -> np.ndarray:
        """Sixteen character classes, their counts modulo 4."""
        cls = (_POINT[self.points & 0xFFFF] >> U(60)).astype(np.uint8)
        # Two bits a class: the sums of four classes at a time wrap inside their own 16 bits.
        out = np.zeros(len(which), np.uint32)
        lo, hi = self.starts[which], self.ends[which]
        for c in range(0, 16, 4):
            one = np.where((cls >= c) & (cls < c + 4), U(1) << ((cls & 3).astype(U) * U(16)), U(0))
            total = np.zeros(len(one) + 1, U)
            np.cumsum(one, out=total[1:])
            n = total[hi] - total[lo]
            for k in range(4):
                out |= ((n & U(3)).astype(np.uint32)) << np.uint32(2 * (c + k))
                n >>= U(16)
        for i in np.flatnonzero(hi - lo >= 1 << 16).tolist():  # too long for sixteen bits a class
            out[i] = int(((np.bincount(cls[lo[i] : hi[i]], minlength=16) & 3) << (2 * np.arange(16))).sum())
        return out


_POINT = mix((np.arange(1 << 16, dtype=U) + U(1)) * U(0x9E3779B97F4A7C15))


def entries(lines: Lines, edits: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """key, node, sketch and kind (0 filed, 1 probing) of the distinct long lines."""
    which = np.unique(lines.node, return_index=True)[1]
    which = which[lines.length[which] >= max(least, edits + 1)]
    start, length, node, sketch, sums = lines.starts[which], lines.length[which], lines.node[which], lines.sketch(which), lines.sums()
    parts = edits + 1
    keys, rows, kinds = [], [], []

    def enter(size: np.ndarray, part: int, at: np.ndarray, width: np.ndarray, kind: int, sel: np.ndarray) -> None:
        h = span_hash(sums, _BASE, at[sel], at[sel] + width[sel])
        keys.append(mix(h ^ mix((size[sel] * 64 + part).astype(U))))
        rows.append(sel)
        kinds.append(np.full(len(sel), kind, np.uint8))

    everyone = np.arange(len(which))
    for less in range(edits + 1):
        size = length - less  # of the filed line
        short, more = size // parts, size % parts
        for part in range(parts):
            width = short + (part >= parts - more)
            offset = part * short + np.maximum(0, part - (parts - more))
            if less == 0:
                enter(size, part, start + offset, width, 0, everyone)
            low = max(-part, less - (edits - part))
            high = min(part, less + (edits - part))
            for shift in range(low, high + 1):
                at = offset + shift
                fits = np.flatnonzero((at >= 0) & (at + width <= length) & (size >= max(least, parts)))
                enter(size, part, start + at, width, 1, fits)
    if not keys:
        return np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, "<u4"), np.zeros(0, np.uint8)
    row = np.concatenate(rows)
    return np.concatenate(keys), node[row], sketch[row], np.concatenate(kinds)


def _far(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Circular distance of two sketches: at most two for an edit."""
    out = np.zeros(len(x), np.int64)
    for c in range(16):
        d = (x >> np.uint32(2 * c) & np.uint32(3)).astype(np.int8) - (y >> np.uint32(2 * c) & np.uint32(3)).astype(np.int8)
        d = np.abs(d)
        out += np.minimum(d, 4 - d)
    return out


_ENTRY = np.dtype([("key", "<u4"), ("sketch", "<u4"), ("node", "<i8"), ("kind", "u1")])


def packed(key: np.ndarray, node: np.ndarray, sketch: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Entries in order of their whole 64-bit key, each once; 32 middle bits of the key are kept."""
    order = np.lexsort((node, kind, key))
    key, node, sketch, kind = key[order], node[order], sketch[order], kind[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1]) | (kind[1:] != kind[:-1])
    entry = np.zeros(int(new.sum()), _ENTRY)
    entry["key"], entry["sketch"], entry["node"], entry["kind"] = (key[new] >> U(8)).astype(np.uint32), sketch[new], node[new], kind[new]
    return entry


def meet(entry: np.ndarray, edits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of nodes that share a key and are near by sketch, in bounded portions; a pair may come again."""
    order = np.lexsort((entry["node"], entry["key"], entry["kind"]))
    entry = entry[order]
    new = np.ones(len(entry), bool)
    new[1:] = (entry["key"][1:] != entry["key"][:-1]) | (entry["node"][1:] != entry["node"][:-1]) | (entry["kind"][1:] != entry["kind"][:-1])
    entry = entry[new]
    filed, probing = entry[entry["kind"] == 0], entry[entry["kind"] == 1]
    lo, hi = np.searchsorted(filed["key"], probing["key"], "left"), np.searchsorted(filed["key"], probing["key"], "right")
    some = np.flatnonzero(hi > lo)
    probing, lo, hi = probing[some], lo[some], hi[some]
    total = np.concatenate([[0], np.cumsum(hi - lo)])
    for part in range(0, int(total[-1]), CROSS):
        flat = np.arange(part, min(part + CROSS, int(total[-1])))
        p = np.searchsorted(total, flat, "right") - 1
        f = lo[p] + flat - total[p]
        other = probing["node"][p] != filed["node"][f]
        p, f = p[other], f[other]
        near = _far(probing["sketch"][p], filed["sketch"][f]) <= 2 * edits
        if near.any():
            a, b = probing["node"][p[near]], filed["node"][f[near]]
            yield np.minimum(a, b), np.maximum(a, b)


class Parts:
    """Union-find over whatever it meets."""

    def __init__(self):
        self.up: dict = {}

    def find(self, x):
        while (up := self.up.get(x, x)) != x:
            self.up[x] = self.up.get(up, up)
            x = up
        return x

    def join(self, a, b) -> bool:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[a] = b
        return a != b


def _distinct(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return a[new], b[new]


def candidates(src: DataFrame, keys: int, edits: int, least: int) -> DataFrame:
    """(u, v): links that join the candidate groups of each key."""

    def blobs(gathered: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        key, node, sketch, kind = (np.concatenate(x) for x in zip(*gathered, strict=True))
        # 24 bits above those that are kept deal the entries.
        order = np.argsort(key, kind="stable")
        key, node, sketch, kind = key[order], node[order], sketch[order], kind[order]
        cut = np.searchsorted(((key >> U(40)) * U(keys) >> U(24)).astype(np.int64), np.arange(keys + 1))
        some = np.flatnonzero(np.diff(cut))
        return pa.record_batch([pa.array(some, pa.int32()), pa.array([packed(*(x[cut[k] : cut[k + 1]] for x in (key, node, sketch, kind))).tobytes() for k in some], pa.binary())], names=["key", "entries"])

    def send(batches):
        gathered, held = [], 0
        for part in slices(batches):
            gathered.append(entries(Lines(part.column("text").to_pylist()), edits, least))
            held += len(gathered[-1][0])
            if held > GATHER:
                yield blobs(gathered)
                gathered, held = [], 0
        if gathered:
            yield blobs(gathered)

    def join(table):
        parts, out = Parts(), []
        for a, b in meet(np.frombuffer(b"".join(table["entries"].to_pylist()), _ENTRY), edits):
            out += [pair for pair in zip(*(x.tolist() for x in _distinct(a, b)), strict=True) if parts.join(*pair)]
        return trimmed(pa.table([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], names=["u", "v"]))

    return src.mapInArrow(send, "key int, entries binary").repartition(max(shuffle_width(src.sparkSession), 1), "key").groupBy("key").applyInArrow(join, "u long, v long")


def compared(bodies: list[str], side: np.ndarray, edits: int, least: int) -> Iterator[tuple[int, int]]:
    """Pairs (i, j) of different lines within ``edits``; of two sides, one of each; of one, each pair once."""
    lines = Lines(bodies)
    key, node, sketch, kind = entries(lines, edits, least)
    place: dict[int, list[int]] = {}
    for i, x in enumerate(lines.node.tolist()):
        place.setdefault(x, []).append(i)
    many = {x: at for x, at in place.items() if len(at) > 1}  # different texts, one 64-bit name
    found: list[tuple[np.ndarray, np.ndarray]] = list(meet(packed(key, node, sketch, kind), edits))
    a, b = _distinct(*(np.concatenate(x) for x in zip(*found, strict=True))) if found else (np.zeros(0, np.int64),) * 2
    pairs = [(i, j) for x, y in zip(a.tolist(), b.tolist(), strict=True) for i in place[x] for j in place[y]]
    pairs += [(i, j) for at in many.values() for k, i in enumerate(at) for j in at[k + 1 :]]
    both = len(np.unique(side)) > 1
    for i, j in pairs:
        if (not both or side[i] != side[j]) and min(lines.length[i], lines.length[j]) >= least and within(bodies[i], bodies[j], edits):
            yield i, j


def line_links(docs: DataFrame, edits: int = EDITS, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """Lines (doc_id, id, line, node, cls, length), and of distinct near lines the links that join them (a, b) or a count of links (a, links); a, b: cls."""
    spark = docs.sparkSession
    src = key_and_text(docs).withColumn("id", F.coalesce("doc_id", F.lit(LAST))).withColumn("h", text_hash())

    def number(batches):
        for part in slices(batches):
            x = Lines(part.column("text").to_pylist())
            cls = np.stack([x.node, x.check()], 1).astype("<i8")
            cls = pa.Array.from_buffers(pa.binary(16), len(cls), [None, pa.py_buffer(cls.tobytes())]).cast(pa.binary())
            of = pa.array(x.doc)
            yield pa.record_batch([part.column("doc_id").take(of), part.column("id").take(of), part.column("h").take(of), pa.array(x.number, pa.int32()), pa.array(x.node), cls, pa.array(x.length, pa.int64())], names=["doc_id", "id", "h", "line", "node", "cls", "length"])

    lines = stage(src.mapInArrow(number, "doc_id long, id long, h long, line int, node long, cls binary, length long"), "lines")
    probes = sum(max(0, min(p, d + edits - p) - max(-p, d - edits + p) + 1) for d in range(edits + 1) for p in range(edits + 1))
    keys = max(1, lines.where(F.col("length") >= least).count() * (edits + 1 + probes) * _ENTRY.itemsize // KEY_BYTES)
    groups = components(candidates(src.select("text"), keys, edits, least))
    members = stage(groups.unionByName(groups.select(F.col("root").alias("node"), "root").distinct()), "candidates")
    # One place of each candidate line; by id and text hash, which tells rows without an id apart.
    places = grouped(lines.join(members, "node"), ["cls", "node", "root"], F.min(F.struct("id", "h", "line")).alias("at")).groupBy("at.id", "at.h").agg(F.collect_list(F.struct("at.line", "cls", "root")).alias("wanted"))  # of one document's lines

    def fetch(batches):
        for batch in batches:
            for part in slices([batch]):
                for text, wanted in zip(part.column("text").to_pylist(), part.column("wanted").to_pylist(), strict=True):
                    body = text.split("\n")
                    yield pa.record_batch([pa.array([w["cls"] for w in wanted], pa.binary()), pa.array([w["root"] for w in wanted], pa.int64()), pa.array([body[w["line"]] for w in wanted], pa.string())], names=["cls", "root", "body"])

    bodies = stage(src.join(places, ["id", "h"]).select("text", "wanted").mapInArrow(fetch, "cls binary, root long, body string").dropDuplicates(["cls"]), "bodies")
    chunks = F.ceil(F.col("m") / CHUNK).cast("int")
    met = bodies.join(grouped(bodies, ["root"], F.count("*").alias("m")).where("m > 1"), "root").withColumn("own", F.pmod(F.xxhash64("cls"), chunks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), chunks - 1)))
    met = met.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("m", "other")
    tasks = max(shuffle_width(spark), -(-bodies.count() // (2 * CHUNK)))

    def compare(table):
        root, i, j, own = (table[c].to_numpy() for c in ("root", "i", "j", "own"))
        cls, body = table["cls"].to_pylist(), table["body"].to_pylist()
        degree, parts, out = {}, Parts(), []
        order = np.lexsort((j, i, root))
        cut = np.flatnonzero((np.diff(root[order]) != 0) | (np.diff(i[order]) != 0) | (np.diff(j[order]) != 0)) + 1
        for g in np.split(order, cut):
            side = own[g] if i[g[0]] != j[g[0]] else np.zeros(len(g), np.int64)
            for x, y in compared([body[k] for k in g], side, edits, least):
                a, b = cls[g[x]], cls[g[y]]
                degree[a], degree[b] = degree.get(a, 0) + 1, degree.get(b, 0) + 1
                if parts.join(a, b):
                    out.append((a, b, None))
        out += [(a, None, n) for a, n in degree.items()]
        return trimmed(pa.table([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.binary(), pa.binary(), pa.int64()))], names=["a", "b", "links"]))

    met = met.withColumn("task", F.pmod(F.xxhash64("root", "i", "j"), F.lit(tasks)).cast("int"))
    return lines, stage(met.repartition(tasks, "task").groupBy("task").applyInArrow(compare, "a binary, b binary, links long"), "line_links")


def near_lines(docs: DataFrame, edits: int = EDITS, least: int = LEAST) -> DataFrame:
    """One row a line: its class of equal lines (first place), the class's links, the first line it is connected to, and whether it stays."""
    lines, found = line_links(docs, edits, least)
    classes = grouped(lines, ["cls"], F.min(F.struct("id", "line")).alias("first"), F.count("*").alias("copies"))
    degree = found.where("links is not null").groupBy(F.col("a").alias("cls")).agg(F.sum("links").alias("n_links"))
    root = components(found.where("links is null").select(F.col("a").alias("u"), F.col("b").alias("v"))).withColumnRenamed("node", "cls")
    named = stage(classes.join(degree, "cls", "left").join(root, "cls", "left").withColumn("root", F.coalesce("root", "cls")), "line_classes")
    # Only components of two or more classes meet; the rest are their own first line.
    linked = named.where("n_links is not null")
    least_of = grouped(linked, ["root"], F.min("first").alias("group_first"))
    named = named.join(least_of, "root", "left").withColumn("group_first", F.coalesce("group_first", "first"))
    out = lines.select("doc_id", "id", "line", "cls").join(named.select("cls", "first", "copies", "n_links", "group_first"), "cls")
    shown = lambda c: F.when(F.col(c)["id"] != LAST, F.col(c)["id"])
    return out.select(
        "doc_id", "line", shown("first").alias("class_doc_id"), F.col("first.line").alias("class_line"), "copies", F.coalesce("n_links", F.lit(0)).alias("n_links"),
        shown("group_first").alias("group_doc_id"), F.col("group_first.line").alias("group_line"), (F.struct("id", "line") == F.col("group_first")).alias("kept"),
    )


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_lines(documents(spark, sf_dir))
