"""Token counts by heap-and-linked-list byte-pair merging.

The symbols of a pre-token form a doubly linked list; a heap holds the ranks of adjacent pairs. The lowest rank,
leftmost first, is popped and merged until no pair has a rank. The count is the number of first symbols minus the
number of merges; identifiers are never made.
"""

from __future__ import annotations

import json
from functools import cache
from heapq import heapify, heappop, heappush

import regex
from pyspark.sql import DataFrame

from .common import arrow_map
from .pieces import BYTE_LEVEL_PATTERN, ChunkedPieces

ONE = [bytes([i]) for i in range(256)]


@cache
def printable_bytes() -> dict[str, int]:
    """Characters that stand for bytes in the vocabulary files: visible Latin-1 for itself, the rest from U+0100 on."""
    shown = [i for i in range(256) if 33 <= i <= 126 or 161 <= i <= 255 and i != 173]
    hidden = [i for i in range(256) if i not in set(shown)]
    return {chr(i): i for i in shown} | {chr(256 + k): i for k, i in enumerate(hidden)}


def merged_length(piece: bytes, ranks: dict[tuple[bytes, bytes], int]) -> int:
    """How many symbols are left of a pre-token after all merges."""
    n = len(piece)
    if n < 2:
        return n
    symbol: list[bytes | None] = [ONE[x] for x in piece]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    shift = n.bit_length()
    rank_of = ranks.get
    heap = [r << shift | i for i in range(n - 1) if (r := rank_of((symbol[i], symbol[i + 1]))) is not None]
    heapify(heap)
    mask, merges = (1 << shift) - 1, 0
    while heap:
        top = heappop(heap)
        i = top & mask
        left, j = symbol[i], after[i]
        if left is None or j == n or rank_of((left, symbol[j])) != top >> shift:
            continue  # one of the two has been merged meanwhile
        symbol[i] = joined = left + symbol[j]
        symbol[j] = None
        merges += 1
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if (r := rank_of((joined, symbol[k]))) is not None:
                heappush(heap, r << shift | i)
        if (h := before[i]) >= 0 and (r := rank_of((symbol[h], joined))) is not None:
            heappush(heap, r << shift | h)
    return n - merges


class TokenCounter:
    """Counts as the library counts for a byte-level BPE .json file, special strings in texts included."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, split = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or split["type"] != "ByteLevel" or split["add_prefix_space"] or spec["normalizer"]:
            raise ValueError(f"{path}: only byte-level BPE without normalizer or prefix space is counted")
        table = printable_bytes()
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        self.ranks = {(bytes(map(table.__getitem__, a)), bytes(map(table.__getitem__, b))): r for r, (a, b) in enumerate(pairs)}
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.marks = special
        self.pieces = ChunkedPieces(BYTE_LEVEL_PATTERN, lambda piece: merged_length(piece, self.ranks), sum)

    def __call__(self, text: str | None) -> int:
        if not text:
            return 0
        if any(m in text for m in self.marks):
            parts = self.special.split(text)
            return len(parts) - 1 + sum(map(self.pieces, parts))
        return self.pieces(text)


@cache
def counter(path: str) -> TokenCounter:
    """One for each Python worker, which keeps it from task to task."""
    return TokenCounter(path)


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    One map over the scan; nothing is shuffled. A null or empty text has 0 bytes and 0 tokens; a null id stays null;
    repeated rows give repeated results; an empty table gives an empty one; other columns, whatever their names, are
    not read. A text of any length is counted whole, in O(n log n) for its longest pre-token. tokenizer_path must
    lead to the file on every machine.
    """

    def batch(ids, texts):
        count = counter(tokenizer_path)
        tokens = [count(t) for t in texts]
        return {"id": ids, "n_bytes": [len((t or "").encode("utf-8", "surrogatepass")) for t in texts], "n_tokens": tokens, "over_limit": [n > limit for n in tokens]}

    kind = docs.schema[id_col].dataType.simpleString()
    out = arrow_map(docs, [id_col, text_col], batch, f"id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
    return out.withColumnRenamed("id", id_col)
