"""Token ids of whole texts by the ``tokenizers`` library, with a bounded memory of pieces already encoded.

A byte-level BPE splits a text into pre-tokens and encodes each alone. A literal space before a non-space
character always opens a pre-token, so the text between two such spaces can be encoded once and remembered.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

DEFAULT_TOKENIZER = "byte_bpe_50k.json"


def public_path(name: str = DEFAULT_TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_alphabet() -> dict[int, str]:
    """Code points 0-255 to the printable characters by which byte-level BPE names bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


_WORD = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+")
_PLAIN = re.compile(r"[\n!-~¡-ÿ]*")
_PARTS = re.compile(r"'(?:[stmd]|re|ve|ll)| ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[0-9]+| ?[!-/:-@\[-`{-~]+|\n+\Z|\n+(?=\n)|\n")
_OPEN = re.compile(r" (?=\S)")
_ODD_SPACE = re.compile(r" (?:\s|\Z)")


#: Pieces remembered by a worker unless a caller says otherwise: 140 MB, or twice that while old ones are looked up.
CACHE_PIECES = 700_000


class _Pieces(dict):
    """Piece (without its leading space) to its ids as little-endian 32-bit bytes. At most 2 x ``most`` are held."""

    def __init__(self, encoder: Encoder, most: int) -> None:
        super().__init__()
        self.encoder, self.most, self.old = encoder, most, {}

    def __missing__(self, piece: str) -> bytes:
        got = self.old.get(piece)
        if got is None:
            got = self.encoder.piece(" " + piece)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[piece] = got
        return got


class Encoder:
    def __init__(self, path: str, cache: int = CACHE_PIECES) -> None:
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        #: Strings that the library takes as tokens of their own wherever they stand; texts that hold one are encoded whole.
        self.special = [x.content for x in self.whole.get_added_tokens_decoder().values()]
        self.model = self.whole.model
        with open(path) as f:
            kind = json.load(f)
        pre = kind.get("pre_tokenizer") or {}
        #: Pieces are exact only for a plain byte-level BPE; others encode whole texts.
        self.by_piece = kind["model"]["type"] == "BPE" and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not kind.get("normalizer") and not kind["model"].get("dropout")
        self.alphabet = _byte_alphabet()
        self.packed = [i.to_bytes(4, "little") for i in range(self.whole.get_vocab_size())]
        self.pieces = _Pieces(self, cache)

    def _slow(self, text: str) -> bytes:
        return np.asarray(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _bpe(self, pretoken: str) -> bytes:
        if pretoken.isascii() and pretoken.isprintable():
            named = "Ġ" + pretoken[1:] if pretoken[0] == " " else pretoken
        else:
            named = pretoken.encode().decode("latin-1").translate(self.alphabet)
        packed = self.packed
        return b"".join([packed[t.id] for t in self.model.tokenize(named)])

    def piece(self, text: str) -> bytes:
        if _WORD.fullmatch(text, 1):
            return self._bpe(text)
        if _PLAIN.fullmatch(text, 1):
            parts = _PARTS.findall(text)
            if sum(map(len, parts)) == len(text):
                held = self.pieces
                return b"".join([held[p[1:]] if p[0] == " " and len(p) > 1 and len(parts) > 1 else self._bpe(p) for p in parts])
        return self._slow(text)

    def ids(self, text: str) -> bytes:
        """The ids of a whole text, four little-endian bytes each."""
        if not text:
            return b""
        if not self.by_piece or any(x in text for x in self.special):
            return self._slow(text)
        parts = text.split(" ") if not _ODD_SPACE.search(text) else _OPEN.split(text)
        first = self._slow(parts[0]) if parts[0] else b""
        if parts[0] == "" and len(parts) == 1:
            return self._slow(text)
        return first + b"".join(map(self.pieces.__getitem__, parts[1:]))


@functools.lru_cache(1)
def encoder(path: str, cache: int = CACHE_PIECES) -> Encoder:
    return Encoder(path, cache)


def encoded(batch: pa.RecordBatch, text: str, path: str, end: int | None, cache: int = CACHE_PIECES) -> Iterator[tuple[int, bytes]]:
    """(row of the batch, ids with the end id) for each row; a null text has none but the end id."""
    enc = encoder(path, cache)
    tail = b"" if end is None else int(end).to_bytes(4, "little")
    for i, t in enumerate(batch.column(text).to_pylist()):
        yield i, enc.ids(t or "") + tail
