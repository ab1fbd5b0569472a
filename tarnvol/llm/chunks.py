"""Whole-text encoding through a cache of space-delimited chunks.

Every split pattern in use ends a match where a non-space is followed by white
space, so a text may be cut there and the parts encoded apart; the ids are those
of the whole text.  A chunk seen before costs one dictionary lookup; a new one
is split into pieces and each new piece goes to the library's BPE model once.
"""

from __future__ import annotations

import sys
import unicodedata
from array import array
from collections.abc import Callable, Sequence
from functools import lru_cache
from itertools import islice

# Unicode White_Space, fixed values.
_SPACES = "\t\n\x0b\x0c\r \x85\xa0                　"
_RUNS = tuple(s + " " for s in _SPACES)
#: Letters up to here are classed alike by every Unicode version of the libraries.
_PLAIN = "ɏ"
#: Entries of a cache before its newer half goes; an operator whose pieces are dear may keep more of them.
_LIMIT = 600_000


def _forget(cache: dict) -> None:
    """Drop the newer half: frequent entries come early."""
    for key in list(islice(cache, len(cache) // 2, None)):
        del cache[key]


class ChunkEncoder:
    """``encode(text) -> bytes`` of little-endian ids; memory is bounded by the cache limit.

    ``pieces`` splits a plain chunk, ``model`` encodes a piece, ``whole`` encodes
    any text with the complete tokenizer (used for chunks with rarer characters
    and for texts with runs of white space before a space or with one of
    ``added``, the tokens that are matched in the text before it is split).
    ``spaced``: a piece keeps the space before it; else pieces are lower case
    without it.
    """

    def __init__(self, pieces: Callable[[str], list[str]], model: Callable[[str], list[int]], whole: Callable[[str], list[int]], width: int, spaced: bool = True, added: Sequence[str] = (), kept: int = _LIMIT):
        self.pieces, self.model, self.whole, self.spaced, self.added = pieces, model, whole, spaced, tuple(added)
        self.kept = kept
        self.dtype = f"<u{width}"
        self.code = {2: "H", 4: "I"}[width]
        self.chunks: dict[str, bytes] = {}
        self.known: dict[str, bytes] = {}

    def _pack(self, ids) -> bytes:
        packed = array(self.code, ids)
        if sys.byteorder == "big":
            packed.byteswap()
        return packed.tobytes()

    def _piece(self, piece: str) -> bytes:
        word = piece[1:] if self.spaced and piece[0] == " " else "" if self.spaced else piece
        if word.isalpha() and word.isascii():  # a whole chunk by itself: kept once, as that
            got = self.chunks.get(word)
            if got is None:
                got = self.chunks[word] = self._pack(self.model(piece))
            return got
        got = self.known.get(piece)
        if got is None:
            if len(self.known) >= self.kept // 2:
                _forget(self.known)
            got = self.known[piece] = self._pack(self.model(piece))
        return got

    def _chunk(self, chunk: str) -> bytes:
        if chunk.isascii():
            if chunk[1:].isalpha() and chunk[0] == " ":
                return self._piece(chunk if self.spaced else chunk[1:].lower())
        elif max(chunk) > _PLAIN:
            return self._pack(self.whole(chunk))
        return b"".join(map(self._piece, self.pieces(chunk)))

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if any(run in text for run in _RUNS) or any(token in text for token in self.added):
            return self._pack(self.whole(text))
        first, *rest = text.split(" ")
        cache = self.chunks
        try:
            return self._chunk(first) + b"".join(map(cache.__getitem__, rest))
        except KeyError:
            pass
        fresh = [c for c in set(rest) if c not in cache]
        if len(cache) + len(fresh) > self.kept:
            _forget(cache)
            fresh = [c for c in set(rest) if c not in cache]
        for chunk in fresh:
            cache[chunk] = self._chunk(" " + chunk)
        return self._chunk(first) + b"".join(map(cache.__getitem__, rest))


def _byte_alphabet() -> dict[int, str]:
    """The usual printable stand-ins for the 256 bytes of a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


@lru_cache(maxsize=1)
def library_encoder(file: str, width: int = 0) -> ChunkEncoder:
    """An encoder over a ``tokenizers`` JSON file of the byte-level or the word-end kind; one a worker process, its caches last from task to task."""
    import json

    import regex
    from tokenizers import Tokenizer

    from ._common import single_thread

    single_thread()
    tok = Tokenizer.from_file(file)
    table = _byte_alphabet()
    model = tok.model
    with open(file, encoding="utf-8") as f:
        spec = json.load(f)
    width = width or (2 if tok.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4)

    def whole(text: str) -> list[int]:
        return tok.encode(text, add_special_tokens=False).ids

    def ids(piece: str) -> list[int]:
        return [t.id for t in model.tokenize(piece.encode().decode("latin-1").translate(table))]

    if spec["normalizer"] is None:
        import public_tokenizers

        pieces = regex.compile(public_tokenizers.PATTERN).findall
    else:
        split = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])

        def pieces(chunk: str) -> list[str]:
            if "İ" in chunk:  # its lower case is two characters
                return []
            return split.findall(unicodedata.normalize("NFC", chunk).lower())

    enc = ChunkEncoder(pieces, ids, whole, width, spec["normalizer"] is None, [t["content"] for t in spec["added_tokens"]])
    if spec["normalizer"] is not None:
        inner = enc._chunk
        enc._chunk = lambda chunk: enc._pack(whole(chunk)) if "İ" in chunk else inner(chunk)
    return enc
