"""Byte-level BPE: encoding by a segment tree over byte positions, and decoding.

A piece that is itself a token is that token. Any other piece is merged: leaf i of the tree holds (rank, i) of the pair
that starts at byte i, each inner node the least of its two, so the root is the leftmost pair of the lowest rank. A
merge changes the pairs at two live neighbours and takes one out; each is a point update of logarithmic cost. Pieces
are remembered per worker in two generations of bounded size.

Nulls: a null text is an empty one (no ids); a null doc_id stays null. Repeated rows are encoded each. Empty tables
give empty results. Columns other than doc_id and text are not read. Texts are encoded whole, whatever their length.
"""

from __future__ import annotations

import base64

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phylospark.llm import common as c

_NONE = 1 << 62
_POSITION = (1 << 40) - 1


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a base64 token and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one piece."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    size = 1 << max(0, (n - 1).bit_length())
    tree = [_NONE] * (2 * size)
    rank = ranks.get
    for i in range(n - 1):
        r = rank(piece[i : i + 2])
        if r is not None:
            tree[size + i] = r << 40 | i
    for i in range(size - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a < b else b
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))

    def update(i: int, value: int) -> None:
        i += size
        tree[i] = value
        i >>= 1
        while i:
            a, b = tree[2 * i], tree[2 * i + 1]
            low = a if a < b else b
            if tree[i] == low:
                return
            tree[i] = low
            i >>= 1

    while (top := tree[1]) != _NONE:
        left = top & _POSITION
        right = after[left]
        end = after[left] = after[right]
        if right < n:
            update(right, _NONE)
        if end < n:
            before[end] = left
            r = rank(piece[left : after[end]])
            update(left, _NONE if r is None else r << 40 | left)
        else:
            update(left, _NONE)
        if (prev := before[left]) >= 0:
            r = rank(piece[prev:end])
            update(prev, _NONE if r is None else r << 40 | prev)
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : after[i]]])
        i = after[i]
    return ids


class Remembered(dict):
    """Results of `make` by key, in two generations of at most `most` entries each; long keys are not kept."""

    def __init__(self, make, most: int = 400_000, longest: int = 64) -> None:
        super().__init__()
        self.make, self.most, self.longest, self.old = make, most, longest, {}

    def __missing__(self, key):
        found = self.old.get(key)
        if found is None:
            found = self.make(key)
        if len(key) <= self.longest:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[key] = found
        return found


class Codec:
    """Encoder and decoder for a rank file and the pattern that splits texts."""

    def __init__(self, path: str, pattern: str) -> None:
        import regex

        self.ranks = read_ranks(path)
        self.tokens = dict(zip(self.ranks.values(), self.ranks, strict=True))
        self.pieces = regex.compile(pattern).findall
        self.ids = Remembered(lambda piece: b"".join(i.to_bytes(4, "little") for i in merge(piece.encode("utf-8"), self.ranks)))

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.ids.__getitem__, self.pieces(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, memoryview(ids).cast("I")))


_LOADED: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """One codec for each worker."""
    if (path, pattern) not in _LOADED:
        _LOADED[path, pattern] = Codec(path, pattern)
    return _LOADED[path, pattern]


_OUT = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("decoded", pa.binary())])


def encode_decode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit integers), decoded (bytes, decoded from the ids)."""

    def run(batches):
        own = codec(path, pattern)
        out = c.Rows(_OUT)
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                ids = own.encode(text.as_py())
                decoded = own.decode(ids)
                if out.add(len(ids) + len(decoded), doc_id.as_py(), len(ids) // 4, ids, decoded):
                    yield out.flush()
        yield out.flush()

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), c.text_of(docs).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded binary")


def digest(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, and the digests of ids and decoded bytes."""
    return encoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
