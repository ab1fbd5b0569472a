"""Operator 6: byte-level BPE by a lazily determinised transducer, and a streaming decoder.

A token sequence is the BPE encoding of its bytes exactly when every adjacent
pair of tokens re-encodes to itself.  That makes the encoder a non-deterministic
transducer whose hypotheses are (last token, bytes of the open token); at most
one hypothesis per start of the open token can be alive.  States of the
determinised machine are sets of hypotheses with the outputs they disagree on;
what all agree on is emitted at once, so a token leaves after bounded lookahead.
States and transitions are made when first met and dropped past a bound.

Edge cases: null text is empty text; empty text has no tokens and the SHA-256 of
the empty string in both hash columns; repeated rows are encoded row by row; an
empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

import base64
import hashlib
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ._common import documents, key_and_text, vocabulary
from .chunks import ChunkEncoder

#: States kept before all are dropped; transitions are twice, token pairs four times as many at most.
_STATE_LIMIT = 100_000
#: Encoded chunks kept (some 200 bytes each).
PIECES_KEPT = 1_200_000


def load_ranks(file: str) -> dict[bytes, int]:
    with open(file, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def merge_by_rank(piece: bytes, ranks: dict[bytes, int], below: int = 1 << 60) -> list[bytes]:
    """The defining procedure: merge the adjacent pair of lowest rank (``below`` a bound), leftmost first, until none is left."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], 1 << 60))
        if ranks.get(parts[best] + parts[best + 1], below) >= below:
            break
        parts[best : best + 2] = [parts[best] + parts[best + 1]]
    return parts


class BpeTransducer:
    """Numbered states over bytes: ``encode_piece`` runs them, ``_step`` makes a transition when it is first met.

    A hypothesis is (last closed token, trie node of the open one, closed tokens not yet
    emitted).  Tokens are their ranks, so a step is a few integer lookups.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.top = max(ranks.values()) + 1
        #: node << 8 | byte -> node of the trie of all tokens, and the token that ends at a node.
        self.child: dict[int, int] = {}
        self.token = [-1]
        for token, rank in ranks.items():
            node = 0
            for byte in token:
                to = self.child.get(node << 8 | byte)
                if to is None:
                    to = self.child[node << 8 | byte] = len(self.token)
                    self.token.append(-1)
                node = to
            self.token[node] = rank
        self.bytes = {rank: token for token, rank in ranks.items()}
        #: left * top + right -> the token that the two make together.
        self.joined: dict[int, int] = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    self.joined[left * self.top + right] = rank
        self.pairs: dict[int, bool] = {}
        self.made: dict[int, tuple[int, int] | None] = {}
        self.reset()

    def reset(self) -> None:
        self.states: list[tuple] = [()]
        self.numbers: dict[tuple, int] = {(): 0}
        self.moves: dict[int, tuple[int, tuple[int, ...]]] = {}
        self.ends: dict[int, tuple[int, ...]] = {}

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes ``token``; None for a byte and for a token its own merges do not reach."""
        got = self.made.get(token, 0)
        if got == 0:
            got, text = None, self.bytes[token]
            if len(text) > 1:
                parts = merge_by_rank(text, self.ranks, below=token)
                got = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None
            self.made[token] = got
        return got

    def follows(self, last: int, token: int) -> bool:
        """Do the two stay apart?  Undo the merges next to the border, latest first: at no time may the border pair have been the lower-ranked choice."""
        joined, top, x, y, until = self.joined, self.top, last, token, 1 << 60
        while True:
            # until: rank of the merge that took x or y; the left of two equal ranks goes first
            if joined.get(x * top + y, 1 << 60) < until:
                return False
            a, b = self.halves(x), self.halves(y)
            if a is None and b is None:
                return not any(t is not None and len(self.bytes[t]) > 1 and self.halves(t) is None for t in (last, token))
            if b is None or (a is not None and x > y):
                until, x = x, a[1]
            else:
                until, y = y + 1, b[0]

    def _closes(self, last: int, node: int) -> int:
        """The token that ends at ``node`` if it may stand after ``last`` (-1: none before it); else -1."""
        token = self.token[node]
        if token < 0 or last < 0:
            return token
        key = last * self.top + token
        ok = self.pairs.get(key)
        if ok is None:
            if len(self.pairs) > 4 * _STATE_LIMIT:
                self.pairs.clear()
            ok = self.pairs[key] = self.follows(last, token)
        return token if ok else -1

    def _step(self, number: int, byte: int) -> tuple[int, tuple[int, ...]]:
        alive, child, closed = [], self.child, False
        if number == 0:
            alive.append((-1, child[byte], ()))
        for last, node, held in self.states[number]:
            to = child.get(node << 8 | byte)
            if to is not None:
                alive.append((last, to, held))
            # The encoding of what was read is one sequence, so one hypothesis at most closes here.
            if not closed and (token := self._closes(last, node)) >= 0:
                alive.append((token, child[byte], (*held, token)))
                closed = True
        agreed = alive[0][2] if len(alive) == 1 else tuple(os.path.commonprefix([h[2] for h in alive]))
        if agreed:
            alive = [(last, node, held[len(agreed) :]) for last, node, held in alive]
        state = tuple(alive)
        if (to := self.numbers.get(state)) is None:
            to = self.numbers[state] = len(self.states)
            self.states.append(state)
        self.moves[number << 8 | byte] = out = (to, agreed)
        return out

    def _end(self, number: int) -> tuple[int, ...]:
        closed = [(*held, token) for last, node, held in self.states[number] if (token := self._closes(last, node)) >= 0]
        if len(closed) != 1 and number:
            raise ValueError("the vocabulary is not closed under its own merges")
        self.ends[number] = closed[0] if closed else ()
        return self.ends[number]

    def encode_piece(self, piece: bytes) -> list[int]:
        if len(self.states) > _STATE_LIMIT or len(self.moves) > 2 * _STATE_LIMIT:
            self.reset()
        state, out, moves = 0, [], self.moves
        for byte in piece:
            got = moves.get(state << 8 | byte)
            state, emitted = got if got is not None else self._step(state, byte)
            if emitted:
                out += emitted
        got = self.ends.get(state)
        out += got if got is not None else self._end(state)
        return out


class StreamingDecoder:
    """Ids in any portions, text out as soon as its bytes form whole characters.

    The state is the unfinished tail of at most three bytes; what can never
    become a character is replaced by U+FFFD, as a whole-text decoder would.
    """

    def __init__(self, tokens: dict[int, bytes]):
        self.tokens, self.tail = tokens, b""

    @staticmethod
    def unfinished(data: bytes) -> int:
        """How many of the last bytes start a character that may still be completed."""
        for back in range(1, min(3, len(data)) + 1):
            lead = data[-back]
            if lead & 0xC0 != 0x80:
                need = 2 if 0xC2 <= lead < 0xE0 else 3 if 0xE0 <= lead < 0xF0 else 4 if 0xF0 <= lead < 0xF5 else 1
                if need <= back:
                    return 0
                low, high = {0xE0: (0xA0, 0xBF), 0xED: (0x80, 0x9F), 0xF0: (0x90, 0xBF), 0xF4: (0x80, 0x8F)}.get(lead, (0x80, 0xBF))
                return back if back == 1 or low <= data[1 - back] <= high else 0
        return 0

    def feed_bytes(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def feed(self, ids) -> str:
        data = self.tail + self.feed_bytes(ids)
        cut = len(data) - self.unfinished(data)
        self.tail = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def finish(self) -> str:
        rest, self.tail = self.tail, b""
        return rest.decode("utf-8", "replace")


@lru_cache(maxsize=1)
def rank_encoder(file: str, pattern: str) -> ChunkEncoder:
    import regex

    ranks = load_ranks(file)
    machine = BpeTransducer(ranks)
    split = regex.compile(pattern).findall

    def piece(text: str) -> list[int]:
        return machine.encode_piece(text.encode())

    def whole(text: str) -> list[int]:
        return [i for p in split(text) for i in piece(p)]

    enc = ChunkEncoder(split, piece, whole, 4, kept=PIECES_KEPT)
    enc.tokens = {rank: token for token, rank in ranks.items()}
    return enc


def encode_decode(docs: DataFrame, file: str | None = None, pattern: str | None = None, portion: int = 4096) -> DataFrame:
    """doc_id, ids (array<int>) as little-endian binary, decoded text and digests; one narrow pass, no shuffle."""
    import public_tokenizers

    file, pattern = file or vocabulary("byte_bpe_multi_50k.tiktoken"), pattern or public_tokenizers.PATTERN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = rank_encoder(file, pattern)
        decimal = [str(i).encode() for i in range(max(enc.tokens) + 1)]
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = []
                for text in part.column(1).to_pylist():
                    ids = np.frombuffer(enc.encode(text), "<u4").tolist()
                    told, back, decoder = hashlib.sha256(), hashlib.sha256(), StreamingDecoder(enc.tokens)
                    for i in range(0, len(ids), portion):
                        told.update((b"," if i else b"") + b",".join(map(decimal.__getitem__, ids[i : i + portion])))
                        back.update(decoder.feed(ids[i : i + portion]).encode())
                    back.update(decoder.finish().encode())
                    rows.append((len(ids), told.hexdigest(), back.hexdigest()))
                n, told, back = zip(*rows, strict=True)
                yield pa.record_batch([part.column(0), pa.array(n, pa.int64()), pa.array(told), pa.array(back)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return key_and_text(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op6_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(documents(spark, sf_dir))
