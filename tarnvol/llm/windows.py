"""Repeated windows of fixed length in a corpus, by prefix-partitioned suffix structures.

Used by operators 3 (words) and 7 (bytes).  Steps, all on blocks of whole documents
(a few MB each, dealt by doc_id) that are shuffled once and read three times:

1. *Sample suffixes.*  Every window of ``length`` units owns the k-gram of least hash
   in it; equal windows own equal k-grams.  The owned positions (anchors) are a few
   per cent of all.  An anchor carries its window starts ``lo..hi``, which make up
   a span; windows are thereby split among anchors without overlap.
2. *Partition by a short prefix.*  Anchors meet by the k units they start with.
   Anchors with the same k-gram and the same span are one leaf with several
   occurrences; a block sends a leaf once, however many copies it holds.  A leaf goes on
   only if it may share a window with another one: a shared window reaches at least
   half of the rest to the left or to the right of the k-gram, so one of the two
   contexts must be equal.
3. *Longer prefixes, suffix structure.*  What goes on is dealt by the k-gram with that
   context (left and right apart).  A partition builds a suffix array with
   common-prefix lengths over the spans, scans it with a stack for its common-prefix
   intervals (the internal nodes of the suffix tree), and takes those of depth >=
   ``length`` whose occurrences differ on their left: the maximal repeats, with all
   their occurrences.  They decide which windows go.  A prefix that more than
   ``GROUP`` leaves share grows to the whole window; such a group is a single node, known
   by a 128-bit digest, of which a block sends one row, so no partition outgrows a task.
4. *Mark.*  Blocks take back one byte for each leaf and a bit for each window asked
   about, and remove the units that a judged window covers.

Units are compared as they are: bytes as bytes, words by 64 bits that are no linear function
of their characters; a leaf is known by 64 bits of its span beside its k-gram's key.
Nothing is collected on the driver; a common passage costs a row for each block that
holds it, not for each pair of its copies.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import shuffle_width

U = np.uint64
_MASK = (1 << 64) - 1
_BASE, _STEP = 0xD1342543DE82EF95, 0xAF251AF3B0F025B5  # odd multipliers
_POS = 30  # bits of a position in a piece
RESOLVED, LEFT, RIGHT, WHOLE_LEFT, WHOLE_RIGHT = 1, 2, 4, 8, 16
#: Leaves of one prefix beyond which it grows to the whole window.
GROUP = 4096
#: Units that are hashed at a time inside a block; parts into which a key's spans are dealt.
PIECE, SPAN_KEYS = 1 << 19, 8
MOVED = "key int, block int, kind int, payload binary"
_MOVED = pa.schema([("key", pa.int32()), ("block", pa.int32()), ("kind", pa.int32()), ("payload", pa.binary())])
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


@dataclass(frozen=True)
class Rule:
    """``length`` units a window, ``gram`` units an anchor; ``earlier``: a window goes if a smaller doc_id has it, else if it is found anywhere else."""

    length: int
    gram: int
    earlier: bool
    words: bool

    @property
    def half(self) -> int:
        """Units beside the k-gram that a window has on one of its sides at least."""
        return -(-(self.length - self.gram) // 2)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse modulo 2**64, i < n at least."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            x = np.full(size, b, U)
            x[0] = 1
            both.append(np.multiply.accumulate(x))
        have = _powers[base] = (both[0], both[1])
    return have[0][:n], have[1][:n]


def prefix_sums(units: np.ndarray, base: int) -> np.ndarray:
    up, _ = powers(base, len(units) + 1)
    out = np.zeros(len(units) + 1, U)
    np.cumsum(units * up[: len(units)], out=out[1:])
    return out


def span_hash(sums: np.ndarray, base: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """A linear hash of any run: for sampling and dealing only, never to tell texts apart."""
    _, down = powers(base, len(sums))
    return mix((sums[hi] - sums[lo]) * down[lo])


_BYTE = mix((np.arange(256, dtype=U) + U(1)) * U(0x9E3779B97F4A7C15))
_SEP = np.zeros(256, bool)
_SEP[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Bytes beyond which a run is hashed by the library, one at a time.
_LONG = 512


def hash_bytes(data: np.ndarray, at: np.ndarray, size: np.ndarray, seed: int = 0) -> np.ndarray:
    """64 bits of each run of bytes, eight bytes a step, mixed after each: no linear relation of the bytes survives."""
    eight = np.ndarray(len(data) + 1, "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), 0, (1,))
    out = mix(size.astype(U) * U(0x9E3779B97F4A7C15) + U(seed))
    live = np.flatnonzero(size <= _LONG)
    for step in range(0, _LONG, 8):
        live = live[size[live] > step]
        if not len(live):
            break
        x, rest = eight[at[live] + step], size[live] - step
        short = np.flatnonzero(rest < 8)
        x[short] &= (U(1) << (rest[short].astype(U) * U(8))) - U(1)
        out[live] = mix(out[live] ^ x) + U(step + 1)
    for i in np.flatnonzero(size > _LONG).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[at[i] : at[i] + size[i]], digest_size=8, salt=seed.to_bytes(8, "little")).digest(), "little")
    return out


def hash_units(units: np.ndarray, at: np.ndarray, size: np.ndarray, seed: int = 0) -> np.ndarray:
    """64 bits of each run of 64-bit units, mixed after each unit."""
    out = mix(size.astype(U) * U(0x9E3779B97F4A7C15) + U(seed))
    live = np.arange(len(at))
    for step in range(int(size.max()) if len(size) else 0):
        live = live[size[live] > step]
        out[live] = mix(out[live] ^ units[at[live] + step]) + U(step + 1)
    return out


class Block:
    """Documents of a block as one run of bytes, and its units."""

    def __init__(self, table: pa.Table, rule: Rule):
        self.rule = rule
        texts = pa.concat_arrays([c.cast(pa.large_string()) for c in table["text"].chunks]) if table.num_rows else pa.array([], pa.large_string())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        data = np.frombuffer(texts.buffers()[2], np.uint8) if len(texts) and texts.buffers()[2] is not None else np.zeros(0, np.uint8)
        self.data = data[offsets[0] : offsets[-1]]
        self.bounds = offsets - offsets[0]
        ids = table["doc_id"].to_numpy(zero_copy_only=False) if table.num_rows else np.zeros(0)
        null = table["doc_id"].is_null().to_numpy(zero_copy_only=False) if table.num_rows else np.zeros(0, bool)
        if null.any():
            ids = table["doc_id"].fill_null(0).to_numpy(zero_copy_only=False)
        self.ids = np.where(null, np.iinfo(np.int64).max, ids.astype(np.int64)) if len(null) else np.zeros(0, np.int64)
        if rule.words:
            self._words()
        else:
            self.starts, self.ends, self.of = None, None, self.bounds
            self.units = self.data

    def _words(self) -> None:
        sep = _SEP[self.data]
        edge = np.zeros(len(sep) + 1, bool)
        edge[self.bounds] = True
        inside = ~sep
        before = np.empty_like(inside)
        before[:1] = False
        before[1:] = inside[:-1]
        self.starts = np.flatnonzero(inside & (~before | edge[:-1]))
        after = np.empty_like(inside)
        after[-1:] = False
        after[:-1] = inside[1:]
        self.ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
        self.of = np.searchsorted(self.starts, self.bounds)
        self.units = hash_bytes(self.data, self.starts, self.ends - self.starts)

    def symbols(self, lo: int, hi: int) -> bytes:
        return self.units[lo:hi].tobytes()

    def digests(self, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """128 bits of the window at each start."""
        size, fold = np.full(len(starts), self.rule.length), hash_units if self.rule.words else hash_bytes
        return fold(self.units, starts, size, 1), fold(self.units, starts, size, 2)

    def _pieces(self) -> Iterator[tuple[int, int]]:
        """Runs of whole documents of about PIECE units: (first, end) document."""
        at = 0
        while at < len(self.of) - 1:
            end = max(at + 1, int(np.searchsorted(self.of, self.of[at] + PIECE, side="right")) - 1)
            yield at, end
            at = end

    def _sample(self, first: int, end: int) -> tuple[np.ndarray, ...] | None:
        """Anchors of some documents: window starts lo..hi, own position, k-gram hash, contexts (0: not inside the span)."""
        length, gram, half = self.rule.length, self.rule.gram, self.rule.half
        base, width = int(self.of[first]), length - gram + 1
        bounds = self.of[first : end + 1] - base
        sizes = np.diff(bounds)
        starts = np.concatenate([np.zeros(0, np.int64), *(np.arange(a, b - length + 1) for a, b in zip(bounds[:-1][sizes >= length], bounds[1:][sizes >= length], strict=True))])
        if not len(starts):
            return None
        units = self.units[base : int(self.of[end])]
        sums = prefix_sums(units if self.rule.words else _BYTE[units], _STEP)
        down = powers(_STEP, len(sums))[1]

        def rolling(n: int) -> np.ndarray:
            """Hash of the n units from each position."""
            x = (sums[n:] - sums[:-n]) * down[: len(sums) - n]
            x ^= x >> U(31)
            x *= U(0xD6E8FEB86659FD93)
            x ^= x >> U(32)
            return x

        hashes = rolling(gram)
        keys = (hashes & U(_MASK ^ ((1 << _POS) - 1))) | np.arange(len(hashes), dtype=U)
        done = 1
        while 2 * done <= width:
            keys = np.minimum(keys[:-done], keys[done:])
            done *= 2
        if done < width:
            keys = np.minimum(keys[: len(keys) - (width - done)], keys[width - done :])
        own = (keys[starts] & U((1 << _POS) - 1)).astype(np.int64)
        del keys
        cut = np.flatnonzero(np.diff(own)) + 1
        begin, last = np.concatenate([[0], cut]), np.concatenate([cut, [len(own)]]) - 1
        lo, hi, own = starts[begin], starts[last], own[begin]
        beside = rolling(half)
        left, right = np.zeros(len(own), np.uint16), np.zeros(len(own), np.uint16)
        some = np.flatnonzero(own - half >= lo)
        left[some] = (beside[own[some] - half] >> U(40)) % U(65535) + U(1)
        some = np.flatnonzero(own + gram + half <= hi + length)
        right[some] = (beside[own[some] + gram] >> U(40)) % U(65535) + U(1)
        # The least of many hashes is small: mixed again, or most leaves would go to the first keys.
        return lo + base, hi + base, own + base, mix(hashes[own] + U(1)), left, right

    def anchors(self) -> bool:
        """Fill in the anchors and their leaves; False if no document has a whole window."""
        found = [x for a, b in self._pieces() if (x := self._sample(a, b)) is not None]
        if not found:
            return False
        self.lo, self.hi, self.own, h, left, right = (np.concatenate(x) for x in zip(*found, strict=True))
        size = self.hi - self.lo + self.rule.length
        span = (hash_units if self.rule.words else hash_bytes)(self.units, self.lo, size) ^ mix((self.own - self.lo + 1).astype(U))
        self.doc = np.searchsorted(self.of, self.lo, side="right") - 1
        order = np.lexsort((self.ids[self.doc], span, h))
        h, span = h[order], span[order]
        fresh = np.ones(len(h), bool)
        fresh[1:] = (h[1:] != h[:-1]) | (span[1:] != span[:-1])
        self.at = np.flatnonzero(fresh)  # first member in order of each leaf: of its least document
        self.order, self.cls = order, np.cumsum(fresh) - 1
        self.h, self.span = h[self.at], span[self.at]
        self.left, self.right = left[order[self.at]], right[order[self.at]]
        self.least = self.ids[self.doc[order[self.at]]]
        self.count = np.diff(np.concatenate([self.at, [len(h)]]))
        return True


def dealt(h: np.ndarray, keys: int) -> np.ndarray:
    return ((h >> U(32)) * U(keys) >> U(32)).astype(np.int64)


def _rows(block: int, kind: int, parts: list[tuple[int, bytes]]) -> pa.RecordBatch:
    key, payload = zip(*parts, strict=True)
    n = len(parts)
    return pa.record_batch([pa.array(key, pa.int32()), pa.array([block] * n, pa.int32()), pa.array([kind] * n, pa.int32()), pa.array(payload, pa.binary())], schema=_MOVED)


def _table(batches: list[pa.RecordBatch]) -> pa.Table:
    return pa.Table.from_batches(batches, schema=_MOVED)


#: What a block sends of a leaf: 32 bits of the k-gram, the span, the contexts, the least document or the count.
_LEAF = (("h", "<u4"), ("span", "<u8"), ("left", "<u2"), ("right", "<u2"))


def send_classes(block: Block, number: int, keys: int) -> pa.Table:
    """Per key: the leaves in order of (h, span)."""
    if not block.anchors():
        return _table([])
    cut = np.searchsorted(dealt(block.h, keys), np.arange(keys + 1))
    value = block.least if block.rule.earlier else np.minimum(block.count, 2)
    wide = bool(len(value) and (value.min() < 0 or value.max() >= 1 << 32))
    leaf = np.empty(len(block.h), np.dtype([*_LEAF, ("value", "<i8" if wide else "<u4")]))
    leaf["h"], leaf["span"], leaf["left"], leaf["right"], leaf["value"] = (block.h >> U(8)).astype(np.uint32), block.span, block.left, block.right, value
    parts = [(k, bytes([wide]) + leaf[a:b].tobytes()) for k, a, b in zip(range(keys), cut[:-1], cut[1:], strict=True) if b > a]
    return _table([_rows(number, 0, parts)])


def _opened(payload: bytes) -> np.ndarray:
    got = np.frombuffer(payload, np.dtype([*_LEAF, ("value", "<i8" if payload[0] else "<u4")]), offset=1)
    return got.astype([*_LEAF, ("value", "<i8")])


def _partners(h: np.ndarray, context: np.ndarray) -> np.ndarray:
    """How many of these leaves have the same k-gram and (non-zero) context, for each; 0 for those without one."""
    out = np.zeros(len(h), np.int64)
    some = np.flatnonzero(context)
    _, of, count = np.unique(h[some].astype(U) << U(16) | context[some], return_inverse=True, return_counts=True)
    out[some] = count[of]
    return out


def judge_classes(table: pa.Table, earlier: bool) -> pa.Table:
    """One byte a leaf, back to its block: RESOLVED (it recurs), or the sides on which it may share windows with other leaves."""
    payloads = table["payload"].to_pylist()
    if not payloads:
        return _table([])
    opened = [_opened(p) for p in payloads]
    sizes = [len(x) for x in opened]
    leaf = np.concatenate(opened)
    del opened, payloads
    order = np.lexsort((leaf["value"], leaf["span"], leaf["h"]))
    h, span, v = leaf["h"][order], leaf["span"][order], leaf["value"][order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (span[1:] != span[:-1])
    at, of = np.flatnonzero(new), np.cumsum(new) - 1
    if earlier:
        resolved = v > v[at][of]
        ask = ~resolved
    else:
        total = np.add.reduceat(v, at)
        resolved = (total > 1)[of]
        ask = new.copy()
    code = resolved.astype(np.uint8)
    for context, side, whole in ((leaf["left"][order][at], LEFT, WHOLE_LEFT), (leaf["right"][order][at], RIGHT, WHOLE_RIGHT)):
        many = _partners(h[at], context)
        goes = many > 1
        if not earlier:  # some leaf of the group must be open, else all is decided
            group = np.where(goes, h[at].astype(U) << U(16) | context, U(_MASK))
            goes &= np.isin(group, group[goes & (total == 1)])
        code += (ask & goes[of]) * np.uint8(side) + (ask & (goes & (many > GROUP))[of]) * np.uint8(whole)
    out = np.empty(len(h), np.uint8)
    out[order] = code
    cut = np.cumsum([0, *sizes])
    return pa.table([table["key"], table["block"], table["kind"], pa.array([out[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())], schema=_MOVED)


def _codes(block: Block, table: pa.Table, kind: int = 0) -> np.ndarray:
    got = sorted((k, p) for k, t, p in zip(table["key"].to_pylist(), table["kind"].to_pylist(), table["payload"].to_pylist(), strict=True) if t == kind)
    out = np.frombuffer(b"".join(p for _, p in got), np.uint8)
    if len(out) != len(block.h):
        raise ValueError("a block changed between two readings")
    return out


#: A span: its leaf in the block, the first of its windows that is meant, how many, and the least document.
_ASK = np.dtype([("entry", "<u4"), ("first", "u1"), ("windows", "u1"), ("doc", "<i8")])
#: A window by its digest.
_WHOLE = np.dtype([("a", "<u8"), ("b", "<u8"), ("entry", "<u4"), ("first", "u1"), ("doc", "<i8")])


def send_spans(block: Block, number: int, codes: pa.Table, keys: int) -> pa.Table:
    """The spans that were asked for, by key of the longer prefix; and the codes again, for the last step."""
    if not codes.num_rows or not block.anchors():
        return _table([])
    code = _codes(block, codes)
    out = [_rows(number, 1, [(number % keys, code.tobytes())])]
    length, half = block.rule.length, block.rule.half
    for side, whole, context in ((LEFT, WHOLE_LEFT, block.left), (RIGHT, WHOLE_RIGHT, block.right)):
        entry = np.flatnonzero(code & side)
        member = block.order[block.at[entry]]
        lo, hi, border = block.lo[member], block.hi[member], block.own[member] - half
        first, last = (lo, np.minimum(hi, border)) if side == LEFT else (np.maximum(lo, border + 1), hi)
        some = last >= first
        entry, lo, first, last = entry[some], lo[some], first[some], last[some]
        if not len(entry):
            continue
        big = (code[entry] & whole) > 0
        key = dealt(mix((block.h[entry] >> U(8)) ^ mix(context[entry].astype(U) + U(side << 20))), keys)
        ask = np.zeros(len(entry), _ASK)
        ask["entry"], ask["first"], ask["windows"], ask["doc"] = entry, first - lo, last - first + 1, block.least[entry]
        by_key: dict[int, tuple[list, list]] = {}
        for i, k, a, b in zip(np.flatnonzero(~big).tolist(), key[~big].tolist(), first[~big].tolist(), last[~big].tolist(), strict=True):
            head, body = by_key.setdefault(k, ([], []))
            head.append(i)
            body.append(block.symbols(a, b + length))
        if by_key:
            out.append(_rows(number, 2, [(k, len(i).to_bytes(4, "little") + ask[i].tobytes() + b"".join(s)) for k, (i, s) in by_key.items()]))
        if big.any():
            ask, first = ask[big], first[big]
            n = ask["windows"].astype(np.int64)
            offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            wide = np.zeros(len(offset), _WHOLE)
            wide["a"], wide["b"] = block.digests(np.repeat(first, n) + offset)
            wide["entry"], wide["first"], wide["doc"] = np.repeat(ask["entry"], n), np.repeat(ask["first"], n) + offset, np.repeat(ask["doc"], n)
            wide = wide[np.argsort(wide["a"], kind="stable")]
            cut = np.searchsorted(dealt(wide["a"], keys), np.arange(keys + 1))
            out.append(_rows(number, 3, [(k, wide[a:b].tobytes()) for k, a, b in zip(range(keys), cut[:-1], cut[1:], strict=True) if b > a]))
    return _table(out)


def _ranks(x: np.ndarray) -> np.ndarray:
    order = np.argsort(x)
    x = x[order]
    new = np.zeros(len(x), np.int32)
    new[:1] = 1
    new[1:] = x[1:] != x[:-1]
    out = np.empty(len(x), np.int32)
    out[order] = np.cumsum(new, dtype=np.int32)
    return out


def _eights(symbols: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The next eight bytes as a big-endian number, with zeros past the span's end, and how many they are below."""
    out = np.ndarray(len(symbols) + 1, ">u8", np.concatenate([symbols, np.zeros(9, np.uint8)]), 0, (1,))[:-1].astype(U)
    over = np.maximum(0, np.arange(len(symbols)) + 8 - ends).astype(U) * U(8)
    return out >> over << over


def suffix_array(symbols: np.ndarray, ends: np.ndarray, deepest: int) -> tuple[np.ndarray, Callable[[np.ndarray, np.ndarray], np.ndarray]]:
    """Ranks of all suffixes (each up to its span's end) by prefix doubling, and a common-prefix function from the ranks kept."""
    n = len(symbols)
    at = np.arange(n)
    levels: list[tuple[int, np.ndarray]] = []
    if symbols.dtype == np.uint8:
        # Eight bytes at once; a suffix that ends within them sorts before its extensions by zeros.
        rank, step = _ranks(_eights(symbols, ends)), 8
    else:
        rank, step = _ranks(symbols), 1
    levels.append((step, rank))
    while step < deepest:
        inside = np.flatnonzero(at + step < ends)
        pair = rank * np.int64(n + 1)
        pair[inside] += rank[inside + step]
        rank = _ranks(pair)
        step *= 2
        levels.append((step, rank))
    text = symbols

    def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        a, b, total = a.copy(), b.copy(), np.zeros(len(a), np.int64)
        ea, eb = ends[np.minimum(a, n - 1)], ends[np.minimum(b, n - 1)]

        def go(size: int, values: np.ndarray) -> None:
            both = np.flatnonzero((a + size <= ea) & (b + size <= eb))
            same = both[values[a[both]] == values[b[both]]]
            total[same] += size
            a[same] += size
            b[same] += size

        for size, ranks in reversed(levels):
            go(size, ranks)
        for _ in range(levels[0][0] - 1):  # what is left is shorter than the first level
            go(1, text)
        return total

    return rank, common


def deep_intervals(lcp: np.ndarray, least: int, left: np.ndarray | None = None) -> Iterator[tuple[int, int, int, bool, bool]]:
    """Common-prefix intervals of depth >= ``least``: (first, last, depth, outermost, maximal).

    ``lcp[i]`` is between suffixes i-1 and i.  These are the internal nodes of the suffix
    tree that lie that deep.  ``maximal``: the occurrences differ on their left
    (``left`` holds the symbol before each suffix; where there is none, a value that no other has).
    """
    deep = np.flatnonzero(lcp >= least)
    if not len(deep):
        return
    changes = np.cumsum(np.concatenate([[0], left[1:] != left[:-1]])) if left is not None else None
    breaks = np.flatnonzero(np.diff(deep) > 1) + 1
    begins, stops = deep[np.concatenate([[0], breaks])], deep[np.concatenate([breaks, [len(deep)]]) - 1]
    for begin, stop in zip(begins.tolist(), stops.tolist(), strict=True):
        stack: list[tuple[int, int]] = []  # (depth, first)
        for i, depth in enumerate([*lcp[begin : stop + 1].tolist(), 0], begin):
            first = i - 1
            while stack and stack[-1][0] > depth:
                d, first = stack.pop()
                yield first, i - 1, d, depth < least and not stack, changes is None or bool(changes[i - 1] > changes[first])
            if depth >= least and (not stack or stack[-1][0] < depth):
                stack.append((depth, first))


def maximal_repeats(symbols: np.ndarray, ends: np.ndarray, sizes: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Maximal repeats of ``least`` or more symbols inside spans: suffixes in order, and (first, last, depth) of each group of occurrences."""
    of = np.repeat(np.arange(len(sizes)), sizes)
    rank, common = suffix_array(symbols, ends, int(sizes.max()))
    starts = np.flatnonzero(np.arange(len(symbols)) + least <= ends)
    sa = starts[np.argsort(rank[starts], kind="stable")]
    lcp = np.zeros(len(sa), np.int64)
    lcp[1:] = common(sa[:-1], sa[1:])
    before = _ranks(symbols).astype(np.int64)
    left = np.where(np.concatenate([[-1], of[:-1]]) == of, np.concatenate([[0], before[:-1]]), -1 - np.arange(len(of)))[sa]
    groups = [(first, last, depth) for first, last, depth, _, maximal in deep_intervals(lcp, least, left) if maximal]
    first, last, depth = np.array(groups, np.int64).reshape(-1, 3).T
    return sa, first, last, depth


def _masks(n: int, at: np.ndarray, bit: np.ndarray) -> np.ndarray:
    out = np.zeros(n, U)
    np.bitwise_or.at(out, at, U(1) << bit.astype(U))
    return out


def _judged_spans(spans: list[bytes], rule: Rule) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(entry, first, bits of windows that go) for each payload, by the maximal repeats of all of them."""
    heads, bodies = [], []
    for p in spans:
        n = int.from_bytes(p[:4], "little")
        heads.append(np.frombuffer(p, _ASK, n, 4))
        bodies.append(np.frombuffer(p, U if rule.words else np.uint8, offset=4 + n * _ASK.itemsize))
    head, symbols = np.concatenate(heads), np.concatenate(bodies)
    del bodies
    sizes = head["windows"].astype(np.int64) - 1 + rule.length
    end = np.cumsum(sizes)
    of = np.repeat(np.arange(len(head)), sizes)
    sa, first, last, depth = maximal_repeats(symbols, end[of], sizes, rule.length)
    gone = np.zeros(len(symbols) + 1, np.int32)
    docs = head["doc"][of[sa]]
    # All occurrences of each group, some groups at a time; the windows inside an occurrence go by the group's verdict.
    many = last - first + 1
    least = np.minimum.reduceat(np.append(docs, 0), np.stack([first, last + 1], 1).ravel())[::2] if len(first) else first
    total = np.concatenate([[0], np.cumsum(many)])
    at = 0
    while at < len(first):
        stop = max(at + 1, int(np.searchsorted(total, total[at] + (1 << 20), "right")) - 1)
        group = np.repeat(np.arange(at, stop), many[at:stop])
        member = first[group] + np.arange(len(group)) - (total[group] - total[at])
        goes = docs[member] > least[group] if rule.earlier else np.ones(len(group), bool)
        p = sa[member[goes]]
        np.add.at(gone, p, 1)
        np.add.at(gone, p + depth[group[goes]] - rule.length + 1, -1)
        at = stop
    window = np.flatnonzero(np.cumsum(gone[:-1]) > 0)
    masks = _masks(len(head), of[window], window - (end - sizes)[of[window]])
    cut = np.cumsum([0, *map(len, heads)])
    for h, x, y in zip(heads, cut[:-1], cut[1:], strict=True):
        yield h, masks[x:y]


def _judged_windows(payloads: list[bytes], rule: Rule) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The same for windows known by their digests: each digest is one node with all its occurrences."""
    heads = [np.frombuffer(p, _WHOLE) for p in payloads]
    head = np.concatenate(heads)
    order = np.lexsort((head["doc"], head["b"], head["a"]))
    a, b, doc = head["a"][order], head["b"][order], head["doc"][order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    at, of = np.flatnonzero(new), np.cumsum(new) - 1
    gone = np.zeros(len(a), bool)
    gone[order] = doc > doc[at][of] if rule.earlier else np.diff(np.append(at, len(a)))[of] > 1
    cut = np.cumsum([0, *map(len, heads)])
    for h, x, y in zip(heads, cut[:-1], cut[1:], strict=True):
        yield h, gone[x:y].astype(U)


_ANSWER = np.dtype([("entry", "<u4"), ("first", "u1"), ("mask", "<u8")])


def judge_spans(table: pa.Table, rule: Rule) -> pa.Table:
    """A bit for every window of a partition that goes."""
    kinds, payloads = table["kind"].to_pylist(), table["payload"].to_pylist()
    blocks, keys = table["block"].to_pylist(), table["key"].to_pylist()
    out = [_rows(b, 1, [(k, p)]) for b, k, t, p in zip(blocks, keys, kinds, payloads, strict=True) if t == 1]
    for kind, judged in ((2, _judged_spans), (3, _judged_windows)):
        mine = [i for i, t in enumerate(kinds) if t == kind]
        if not mine:
            continue
        for i, (head, mask) in zip(mine, judged([payloads[i] for i in mine], rule), strict=True):
            hit = np.flatnonzero(mask)
            if len(hit):
                answer = np.zeros(len(hit), _ANSWER)
                answer["entry"], answer["first"], answer["mask"] = head["entry"][hit], head["first"][hit], mask[hit]
                out.append(_rows(blocks[i], 2, [(keys[i], answer.tobytes())]))
    return _table(out)


def removed_units(block: Block, answers: pa.Table) -> np.ndarray:
    """Which units a judged window covers."""
    n, length = len(block.units), block.rule.length
    if not block.anchors():
        return np.zeros(n, bool)
    code = _codes(block, answers, kind=1)[block.cls]  # by member, in order
    whole = (code & RESOLVED).astype(bool)
    ids = block.ids[block.doc[block.order]]
    if block.rule.earlier:
        whole |= ids > block.least[block.cls]
    member = block.order[whole]
    cover = np.zeros(n + 1, np.int32)  # windows lo..hi cover lo up to hi + length
    np.add.at(cover, block.lo[member], 1)
    np.add.at(cover, block.hi[member] + length, -1)
    got = [np.frombuffer(p, _ANSWER) for t, p in zip(answers["kind"].to_pylist(), answers["payload"].to_pylist(), strict=True) if t == 2]
    if got:
        got = np.concatenate(got)
        masks = np.zeros(len(block.h), U)
        np.bitwise_or.at(masks, got["entry"].astype(np.int64), got["mask"] << got["first"].astype(U))
        mine = masks[block.cls]
        keep = (mine != 0) & ~whole
        if block.rule.earlier:
            keep &= ids == block.least[block.cls]
        member, mine = block.order[keep], mine[keep]
        for bit in range(length - block.rule.gram + 1):
            at = block.lo[member[(mine >> U(bit)) & U(1) > 0]] + bit
            np.add.at(cover, at, 1)
            np.add.at(cover, at + length, -1)
    return np.cumsum(cover, dtype=np.int32)[:n] > 0


def trimmed(result: pa.Table) -> pa.Table:
    """Give freed memory back before the next block: a worker's size is then that of one block, not of its history."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: nothing to trim
        pass
    return result


def mark(docs: DataFrame, rule: Rule, finish: Callable[[pa.Table, Block, np.ndarray], pa.Table], schema, block_bytes: int = 4 << 20, key_bytes: int = 8 << 20) -> DataFrame:
    """``finish(rows of a block, block, removed units)`` over all blocks of ``docs`` (doc_id, text and what ``finish`` wants).

    A block sends a row for each key it has a leaf of, so rows are at most the corpus squared over
    (block bytes times key bytes) and never more than the leaves: both sizes are as large as a worker bears.
    """
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    tasks = shuffle_width(spark)
    blocks = max(1, -(-total // block_bytes), min(4 * tasks, total // (1 << 18)))
    share = 2 / (rule.length - rule.gram + 2) / (6 if rule.words else 1)
    keys = max(1, round(total * share * 20 / key_bytes), min(tasks, total // (1 << 20)))
    finer = keys * SPAN_KEYS
    width = max(tasks, min(blocks, keys))
    number = F.pmod(F.xxhash64(F.coalesce("doc_id", F.xxhash64("text"))), F.lit(blocks)).cast("int")
    held = docs.withColumn("block", number).repartition(width, "block")

    def first(key, table):
        return trimmed(send_classes(Block(table, rule), key[0].as_py(), keys))

    def second(table):
        return trimmed(judge_classes(table, rule.earlier))

    def third(key, table, codes):
        return trimmed(send_spans(Block(table, rule), key[0].as_py(), codes, finer))

    def fourth(table):
        return trimmed(judge_spans(table, rule))

    def last(key, table, answers):
        block = Block(table, rule)
        return trimmed(finish(table, block, removed_units(block, answers)))

    classes = held.groupBy("block").applyInArrow(first, MOVED)
    codes = classes.repartition(width, "key").groupBy("key").applyInArrow(second, MOVED)
    spans = held.groupBy("block").cogroup(codes.groupBy("block")).applyInArrow(third, MOVED)
    answers = spans.repartition(width, "key").groupBy("key").applyInArrow(fourth, MOVED)
    return held.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(last, schema)
