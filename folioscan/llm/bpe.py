"""Byte-level BPE encoding and decoding with a segment tree.

The leaves of the tree are byte positions. The leaf of a live token's first byte holds the rank of the pair that the
token forms with the next live one; inner nodes hold the least value below, ties to the left, so the root names the
next merge. A merge touches three leaves: its own, the one that goes, and the live neighbour to the left.
"""

from __future__ import annotations

import base64
from functools import cache
from hashlib import sha256
from itertools import chain

from pyspark.sql import DataFrame

from .common import arrow_map
from .pieces import BYTE_LEVEL_PATTERN, ChunkedPieces


def encode_piece(piece: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """Ids of one pre-token; a pre-token that is in the vocabulary as a whole is one id."""
    if (whole := ranks.get(piece)) is not None:
        return (whole,)
    n = len(piece)
    if not n:
        return ()
    width = 1 << (n - 1).bit_length()
    shift = n.bit_length()
    none = 1 << 62
    rank_of, mask = ranks.get, (1 << shift) - 1
    tree = [none] * (2 * width)
    for i in range(n - 1):
        if (r := rank_of(piece[i : i + 2])) is not None:
            tree[width + i] = r << shift | i
    for node in range(width - 1, 0, -1):
        a, b = tree[2 * node], tree[2 * node + 1]
        tree[node] = a if a < b else b
    after, before = list(range(1, n + 2)), list(range(-1, n))

    def put(i: int, value: int) -> None:
        node = width + i
        if tree[node] == value:
            return
        tree[node] = value
        node >>= 1
        while node:
            a, b = tree[2 * node], tree[2 * node + 1]
            least = a if a < b else b
            if tree[node] == least:
                return
            tree[node] = least
            node >>= 1

    while (top := tree[1]) != none:
        i = top & mask
        j = after[i]
        end = after[i] = after[j]
        put(j, none)
        if end < n:
            before[end] = i
            r = rank_of(piece[i : after[end]])
            put(i, none if r is None else r << shift | i)
        else:
            put(i, none)
        if (h := before[i]) >= 0:
            r = rank_of(piece[h:end])
            put(h, none if r is None else r << shift | h)
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : after[i]]])
        i = after[i]
    return tuple(ids)


class ByteBpe:
    """Encoder and decoder for a file of ranks (base64 bytes and rank on each line)."""

    def __init__(self, path: str, pattern: str = BYTE_LEVEL_PATTERN):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes_of = {i: b for b, i in self.ranks.items()}
        self.digits = {i: str(i) for i in self.bytes_of}
        self.pieces = ChunkedPieces(pattern, lambda piece: encode_piece(piece, self.ranks), lambda values: tuple(chain.from_iterable(values)))

    def encode(self, text: str | None) -> tuple[int, ...]:
        return self.pieces(text or "")

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@cache
def codec(path: str, pattern: str) -> ByteBpe:
    return ByteBpe(path, pattern)


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str = BYTE_LEVEL_PATTERN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id and ids (array of int) of the whole text, without special tokens.

    One map over the scan. A null or empty text has no ids; repeated rows, null ids, empty tables and extra columns
    are as in count_tokens. Work on one pre-token of n bytes is O(n log n), however long it is.
    """

    def batch(ids, texts):
        encode = codec(ranks_path, pattern).encode
        return {"id": ids, "ids": [encode(t) for t in texts]}

    kind = docs.schema[id_col].dataType.simpleString()
    return arrow_map(docs, [id_col, text_col], batch, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def decode_documents(encoded: DataFrame, ranks_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Per row: id and decoded (binary), the bytes that the ids stand for. Null ids decode to no bytes; an unknown id is an error."""

    def batch(keys, ids):
        decode = codec(ranks_path, BYTE_LEVEL_PATTERN).decode
        return {"id": keys, "decoded": [decode(x or ()) for x in ids]}

    kind = encoded.schema[id_col].dataType.simpleString()
    return arrow_map(encoded, [id_col, ids_col], batch, f"id {kind}, decoded binary").withColumnRenamed("id", id_col)


def encode_digests(docs: DataFrame, ranks_path: str, pattern: str = BYTE_LEVEL_PATTERN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """encode_documents and decode_documents in one pass: n_tokens, and SHA-256 of the decimal ids and of the decoded bytes.

    The ids of a document never leave its worker, which spares writing four bytes a token to Arrow and back.
    """

    def batch(ids, texts):
        own = codec(ranks_path, pattern)
        n, said, decoded = [], [], []
        digits = own.digits.__getitem__
        for t in texts:
            e = own.encode(t)
            n.append(len(e))
            said.append(sha256(" ".join(map(digits, e)).encode()).hexdigest())
            decoded.append(sha256(own.decode(e)).hexdigest())
        return {"id": ids, "n_tokens": n, "ids_sha256": said, "decoded_sha256": decoded}

    kind = docs.schema[id_col].dataType.simpleString()
    return arrow_map(docs, [id_col, text_col], batch, f"id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)
