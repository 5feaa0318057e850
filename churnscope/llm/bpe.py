"""Byte-level BPE encoding and decoding by prefix dynamic programming.

For every prefix of a piece exactly one token can come last in its encoding. The
codec stores that token, so encoding walks the bytes once, appending continues
where it stopped, and an edit recomputes only the pieces that it touches.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnscope.llm.common import bound_batches

_END = 1 << 60


class Codec:
    """Ranks as bytes -> id. Ids are ranks, as in tiktoken's files."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, cached: int = 150_000):
        self.ranks, self.pattern, self.cached = ranks, regex.compile(pattern), cached
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        #: Tokens at a token's right (left) edge while it grows from one byte, by rank.
        self.right: dict[int, tuple[int, ...]] = {}
        self.left: dict[int, tuple[int, ...]] = {}
        for b, i in sorted(ranks.items(), key=lambda x: x[1]):
            if len(b) == 1:
                self.right[i] = self.left[i] = (i,)
            elif len(halves := self._merged(b, i)) == 2 and all(h in self.right for h in halves):
                self.right[i] = self.right[halves[1]] + (i,)
                self.left[i] = self.left[halves[0]] + (i,)
        self._pieces: dict[str, bytes] = {}
        self._apart: dict[int, bool] = {}

    @classmethod
    def from_file(cls, path: str, pattern: str, **options) -> Codec:
        with open(path, "rb") as f:
            return cls.from_bytes(f.read(), pattern, **options)

    @classmethod
    def from_bytes(cls, data: bytes, pattern: str, **options) -> Codec:
        return cls(dict(rank_pairs(data)), pattern, **options)

    def _merged(self, data: bytes, below: int = _END) -> list[int]:
        """Lowest rank first, leftmost at ties, with ranks under ``below`` only."""
        parts = [data[k : k + 1] for k in range(len(data))]
        while len(parts) > 1:
            rank, k = min((self.ranks.get(parts[k] + parts[k + 1], _END), k) for k in range(len(parts) - 1))
            if rank >= below:
                break
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return [self.ranks[p] for p in parts]

    def _stay_apart(self, first: int, second: int) -> bool:
        """Whether the merges keep a boundary between two adjacent tokens.

        Edges grow in order of rank. A merge across happens if its rank comes
        before the next growth on the left and not after that on the right.
        """
        a, b, i, j = self.right[first], self.left[second], 0, 0
        ranks, bytes_of = self.ranks, self.bytes_of
        while True:
            next_a = a[i + 1] if i + 1 < len(a) else _END
            next_b = b[j + 1] if j + 1 < len(b) else _END
            across = ranks.get(bytes_of[a[i]] + bytes_of[b[j]])
            if across is not None and across < next_a and across <= next_b:
                return False
            if next_a == next_b == _END:
                return True
            if next_a <= next_b:
                i += 1
            else:
                j += 1

    def extend(self, data: bytes, last: list[int]) -> list[int]:
        """Fill ``last`` (the last token of each non-empty prefix) up to the end of ``data``."""
        find, right, apart = self.ranks.get, self.right, self._apart
        for end in range(len(last) + 1, len(data) + 1):
            for start in range(end - 1, max(-1, end - 1 - self.longest), -1):
                token = find(data[start:end])
                if token is None or token not in right:
                    continue
                if start == 0:
                    break
                pair = last[start - 1] << 32 | token
                fits = apart.get(pair)
                if fits is None:
                    if len(apart) >= self.cached:
                        apart.clear()
                    fits = apart[pair] = self._stay_apart(last[start - 1], token)
                if fits:
                    break
            else:
                raise ValueError("the ranks lack a single byte of the text")
            last.append(token)
        return last

    def walk_back(self, last: list[int]) -> list[int]:
        ids, end = [], len(last)
        while end:
            ids.append(last[end - 1])
            end -= len(self.bytes_of[ids[-1]])
        return ids[::-1]

    def encode_piece(self, piece: str) -> list[int]:
        data = piece.encode()
        whole = self.ranks.get(data)
        return [whole] if whole is not None else self.walk_back(self.extend(data, []))

    def _packed(self, piece: str) -> bytes:
        if len(self._pieces) >= self.cached:
            self._pieces.clear()
        packed = array("I", self.encode_piece(piece)).tobytes()
        if len(piece) <= 64:
            self._pieces[piece] = packed
        return packed

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        known, packed = self._pieces.get, self._packed
        return b"".join([known(p) or packed(p) for p in self.pattern.findall(text)])

    def decode(self, packed: bytes) -> bytes:
        return unpacked(self.bytes_of, packed)


def rank_pairs(data: bytes) -> Iterator[tuple[bytes, int]]:
    """(token, id) of a rank file's lines."""
    return ((base64.b64decode(b), int(i)) for b, i in (line.split() for line in data.splitlines() if line))


def unpacked(bytes_of: dict[int, bytes], packed: bytes) -> bytes:
    """The bytes that packed ids stand for."""
    ids = array("I")
    ids.frombytes(packed)
    return b"".join(map(bytes_of.__getitem__, ids))


class EditableEncoding:
    """An encoded text that can be appended to and edited.

    Pieces are cut from left to right, and a cut depends on the text up to one
    character past its end. So all pieces that end before an edit stay, and once a
    cut after the edit falls where an old one did, the rest stays too.
    """

    def __init__(self, codec: Codec, text: str = ""):
        self.codec, self.text, self.ends, self.ids = codec, "", [], []
        self._states: dict[str, list[int]] = {}
        self.edit(0, 0, text)

    def append(self, more: str) -> None:
        self.edit(len(self.text), len(self.text), more)

    def edit(self, start: int, end: int, new: str) -> int:
        """Replace text[start:end]; returns how many pieces were encoded anew."""
        text, shift = self.text[:start] + new + self.text[end:], len(new) - (end - start)
        keep = next((k for k, e in enumerate(self.ends) if e >= start), len(self.ends))
        at = self.ends[keep - 1] if keep else 0
        old = {e + shift: k for k, e in enumerate(self.ends) if e >= end and k >= keep}
        ends, ids, k_old = [], [], len(self.ends)
        while at < len(text):
            piece = self.codec.pattern.match(text, at)[0]
            at += len(piece)
            ends.append(at)
            ids.append(self._encode(piece))
            if at >= start + len(new) and at in old:
                k_old = old[at] + 1
                break
        self.ends = self.ends[:keep] + ends + [e + shift for e in self.ends[k_old:]]
        self.ids = self.ids[:keep] + ids + self.ids[k_old:]
        self.text = text
        return len(ends)

    def _encode(self, piece: str) -> list[int]:
        data = piece.encode()
        whole = self.codec.ranks.get(data)
        if whole is not None:
            return [whole]
        stem = next((p for p in self._states if piece.startswith(p)), None)
        last = self.codec.extend(data, list(self._states.get(stem, [])))
        self._states = {piece: last}
        return self.codec.walk_back(last)

    def flat(self) -> list[int]:
        return [i for piece in self.ids for i in piece]


_loaded: dict[tuple[bytes, str], Codec] = {}


def _codec(data: bytes, pattern: str) -> Codec:
    """One codec per Python worker: its tables take a second to build."""
    key = (hashlib.sha256(data).digest(), pattern)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Codec.from_bytes(data, pattern)
    return _loaded[key]


def encoder(rank_data: bytes, pattern: str):
    """A pandas UDF text -> ids as little-endian unsigned 32-bit integers; null is the empty text."""

    @F.pandas_udf("binary")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = _codec(rank_data, pattern)
        for texts in batches:
            yield pd.Series([codec.encode(t) if t else b"" for t in texts], dtype=object)

    return encode


def decoder(rank_data: bytes):
    """A pandas UDF packed ids -> bytes; null decodes to no bytes. It needs the tokens alone."""

    @F.pandas_udf("binary")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bytes_of = {i: b for b, i in rank_pairs(rank_data)}
        for packed in batches:
            yield pd.Series([unpacked(bytes_of, p) if p else b"" for p in packed], dtype=object)

    return decode


def read_ranks(path: str) -> bytes:
    """The rank file as it is; a vocabulary has a fixed size, about 1 MB here."""
    with open(path, "rb") as f:
        return f.read()


def n_ids(packed: Column) -> Column:
    return (F.octet_length(packed) / 4).cast("long")


def bpe_encode(docs: DataFrame, rank_path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """``docs`` with a binary column ``_ids``: each whole text's ids, null as the empty text.

    One map over the rows. Tokens, long texts and repeated rows need no special
    care; extra columns pass through.
    """
    bound_batches(docs.sparkSession)
    return docs.withColumn("_ids", encoder(read_ranks(rank_path), pattern)(F.col(text_col)))


def bpe_decode(encoded: DataFrame, rank_path: str) -> DataFrame:
    """Adds a binary column ``_bytes``: what the ids in ``_ids`` stand for."""
    return encoded.withColumn("_bytes", decoder(read_ranks(rank_path))(F.col("_ids")))
