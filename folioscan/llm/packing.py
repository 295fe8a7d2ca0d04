"""Packing tokenized documents into sequences by a configuration linear program.

Rows of the program are piece lengths with their counts, columns are configurations: multisets of lengths that fit into
one sequence. A covering program is solved: as few sequences, fractional ones too, as cover every count. Multiplicative
weights price the lengths, each by exp(-eta * covered share); a knapsack dynamic program finds the configuration worth
most at those prices, which is used until its scarcest length is covered. Most pricings look at the lengths that lag and
at random ones; every FULL rounds one looks at all lengths, and its value makes the prices a feasible dual solution, and
so a lower bound for any packing. The fractional levels are then rounded down, and what that leaves, less than a sequence
for each configuration, is solved again in whole steps.

The plan depends on the length histogram alone, which has as many entries as a sequence has tokens at most; the pieces
themselves stay where they are and look up their places by length and rank.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import pairwise
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BoundedCache, materialize

#: Lengths that most pricings look at: the longest open, those that lag most, and random ones; and rounds from one pricing over all lengths to the next.
LONGEST, LAGGING, SPREAD, FULL = 4, 24, 56, 50


#: Stops that may part from a word, words that are encoded at once, and texts whose unknown words are gathered.
STOPS, TOGETHER, GROUP = (b".", b",", b";", b":", b"!", b"?"), 256, 256


class WordTokens:
    """Ids of whole texts as little-endian unsigned 32-bit bytes, looked up word by word.

    Fits tokenizers that fold case, drop white space, never join characters across it and part letters from other characters.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_file(path)
        self.words = BoundedCache(self.ids, cap=800_000)

    def ids(self, word: bytes) -> bytes:
        return self.many([word])[word]

    @staticmethod
    def parts(word: bytes) -> tuple[bytes, ...]:
        """A stop behind a small letter is a pre-token of its own; other letters may fold to several characters."""
        if len(word) > 1 and word[-1:] in STOPS:
            before = word[:-1].decode("utf-8", "replace")[-1]
            if before.isalpha() and before.islower():
                return word[:-1], word[-1:]
        return (word,)

    def together(self, words: list[bytes]) -> Iterator[bytes]:
        """The ids of each word. Words are encoded some at a time, a blank between them, and their ids told apart by places."""
        for k in range(0, len(words), TOGETHER):
            texts = [w.decode("utf-8", "replace") for w in words[k : k + TOGETHER]]
            got = self.own.encode(" ".join(texts), add_special_tokens=False)
            begin = np.cumsum([0, *(len(t) + 1 for t in texts[:-1])])
            of = np.searchsorted(begin, np.array([o[0] for o in got.offsets], np.int64), "right") - 1
            data = np.array(got.ids, "<u4").tobytes()
            edges = 4 * np.concatenate(([0], np.cumsum(np.bincount(of, minlength=len(texts)))))
            yield from (data[a:z] for a, z in pairwise(edges.tolist()))

    def many(self, words: Iterable[bytes]) -> dict[bytes, bytes]:
        """The ids of words that aren't known yet. Their parts are encoded together."""
        split = {w: self.parts(w) for w in words}
        need = list({p for parts in split.values() for p in parts if p not in self.words})
        new = dict(zip(need, self.together(need), strict=True))
        return new | {w: b"".join([new[p] if p in new else self.words[p] for p in parts]) for w, parts in split.items()}

    def each(self, texts: list[str | None]) -> Iterator[bytes]:
        """The ids of each text, in order. Texts are taken GROUP at a time, and the words among them that aren't known are met
        once and kept while there is room."""
        known = self.words
        for k in range(0, len(texts), GROUP):
            split, found, missing = [], [], set()
            for t in texts[k : k + GROUP]:
                data = (t or "").encode("utf-8", "replace")
                if b"<|" in data:
                    words, ids = [], [self(t)]
                else:
                    words = data.lower().split()
                    ids = list(map(known.get, words))
                    if None in ids:
                        missing.update([w for w, x in zip(words, ids, strict=True) if x is None])
                split.append(words)
                found.append(ids)
            new = self.many(missing)
            for w, x in new.items():
                if not known.keep(w, x):
                    break
            for words, ids in zip(split, found, strict=True):
                yield b"".join([new[w] if x is None else x for w, x in zip(words, ids, strict=True)] if None in ids else ids)

    def __call__(self, text: str | None) -> bytes:
        """Letters A-Z are folded first, as the tokenizer does anyway, unless the text may hold special strings, which aren't folded."""
        data = (text or "").encode("utf-8", "replace")
        return b"".join(map(self.words.__getitem__, (data if b"<|" in data else data.lower()).split()))


@cache
def word_tokens(path: str) -> WordTokens:
    return WordTokens(path)


def configuration(lengths: np.ndarray, left: np.ndarray, prices: np.ndarray, capacity: int) -> np.ndarray:
    """How often each length goes into the configuration of the highest price: a bounded knapsack over capacities.

    Counts are split into powers of two, so that a length is used any number of times up to what is left of it.
    """
    items = []
    for k, (size, n) in enumerate(zip(lengths.tolist(), left.tolist(), strict=True)):
        n, part = min(n, capacity // size), 1
        while n > 0:
            part = min(part, n)
            items.append((k, part, part * size, part * float(prices[k])))
            n -= part
            part *= 2
    best = np.zeros(capacity + 1)
    taken = np.zeros((len(items), capacity + 1), bool)
    for t, (_, _, size, price) in enumerate(items):
        offer = best[:-size] + price
        better = offer > best[size:]
        taken[t, size:] = better
        np.copyto(best[size:], offer, where=better)
    used, room = np.zeros(len(lengths), np.int64), capacity
    for t in range(len(items) - 1, -1, -1):
        if taken[t, room]:
            k, part, size, _ = items[t]
            used[k] += part
            room -= size
    return used


def most_valuable(lengths: np.ndarray, prices: np.ndarray, capacity: int) -> float:
    """The price of the best configuration of any of the lengths, which ascend, each used any number of times."""
    best = np.zeros(capacity + 1)
    upto = np.searchsorted(lengths, np.arange(capacity + 1), "right")
    for c in range(1, capacity + 1):
        k = upto[c]
        best[c] = max(best[c - 1], float((best[c - lengths[:k]] + prices[:k]).max())) if k else best[c - 1]
    return float(best[capacity])


def covering(lengths: np.ndarray, demand: np.ndarray, capacity: int, whole: bool, eta: float = 1.0) -> tuple[dict[tuple, float], float]:
    """Levels of configurations that cover the demand of the lengths, which ascend, and a lower bound on their sum.

    Each round covers a length, in whole steps at least one piece, so there are no more rounds than lengths, and in
    whole steps no more than that times the logarithm of the largest demand.
    """
    rng, left, levels = np.random.default_rng(0), demand.astype(np.float64), {}
    bound, rounds = float((lengths * demand).sum()) / capacity, 0
    while len(live := np.flatnonzero(left)):
        if not whole and rounds % FULL == 0:
            price = lengths * np.exp(-eta * (1 - left / demand))
            bound = max(bound, float((demand * price).sum()) / most_valuable(lengths, price, capacity))
        share = left[live] / demand[live]
        lag = np.argpartition(-share, min(LAGGING, len(live)) - 1)[:LAGGING]
        some = rng.integers(0, len(live), SPREAD)
        chosen = live[np.unique(np.concatenate((lag, some, np.arange(max(0, len(live) - LONGEST), len(live)))))]
        price = lengths[chosen] * np.exp(-eta * (1 - left[chosen] / demand[chosen]))
        used = configuration(lengths[chosen], np.ceil(left[chosen]).astype(np.int64), price, capacity)
        at = np.flatnonzero(used)
        own, n = chosen[at], used[at]
        level = float((left[own] / n).min())
        level = max(1.0, np.floor(level)) if whole else level
        left[own] -= level * n
        left[own[left[own] < 1e-6]] = 0
        content = tuple(zip(lengths[own].tolist(), n.tolist(), strict=True))
        levels[content] = levels.get(content, 0) + level
        rounds += 1
    return levels, bound


class Program(NamedTuple):
    """plan: (sequences, [(length, pieces a sequence), ...]) that together use every piece exactly once; the sum of the
    fractional levels; and a lower bound on the sequences of any packing."""

    plan: list[tuple[int, list[tuple[int, int]]]]
    fractional: float
    bound: float


def program(histogram: dict[int, int], capacity: int) -> Program:
    """The covering program solved and rounded. Lengths that nothing fits beside are sequences of their own and left out of it."""
    lengths = np.array(sorted(k for k in histogram if k > 0), np.int64)
    demand = np.array([histogram[k] for k in lengths.tolist()], np.int64)
    alone = lengths + (lengths[0] if len(lengths) else 0) > capacity
    plan = [(int(n), [(int(k), 1)]) for k, n in zip(lengths[alone].tolist(), demand[alone].tolist(), strict=True)]
    single = sum(n for n, _ in plan)
    left = dict(zip(lengths[~alone].tolist(), demand[~alone].tolist(), strict=True))
    levels, bound = covering(lengths[~alone], demand[~alone], capacity, False)
    for content, level in sorted(levels.items(), key=lambda x: -x[1]):
        if n := min([int(level + 1e-6), *(left[k] // m for k, m in content)]):
            plan.append((n, list(content)))
            for k, m in content:
                left[k] -= n * m
    rest = np.array([k for k, n in left.items() if n], np.int64)
    again, _ = covering(rest, np.array([left[k] for k in rest.tolist()], np.int64), capacity, True)
    plan += [(int(n), list(content)) for content, n in again.items()]
    return Program(plan, single + sum(levels.values()), single + bound)


class Places:
    """For each length, ranges of ranks and where their pieces go."""

    def __init__(self, plan):
        by: dict[int, list[tuple[int, int, int, int]]] = {}
        ranks: dict[int, int] = {}
        sequence = 0
        for times, content in plan:
            at = 0
            for length, n in content:
                rank = ranks.get(length, 0)
                by.setdefault(length, []).append((rank, n, sequence, at))
                ranks[length] = rank + times * n
                at += length * n
            sequence += times
        self.sequences = sequence
        self.by = {k: tuple(np.array(c, np.int64) for c in zip(*v, strict=True)) for k, v in by.items()}

    def __call__(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
        for k in np.unique(length):
            low, n, first, at = self.by[int(k)]
            mine = np.flatnonzero(length == k)
            e = np.searchsorted(low, rank[mine], "right") - 1
            times, slot = np.divmod(rank[mine] - low[e], n[e])
            sequence[mine], offset[mine] = first[e] + times, at[e] + slot * k
        return sequence, offset


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int, with_ids: bool, id_col: str, text_col: str) -> DataFrame:
    """Tokenized pieces with their partition and their rank among the partition's pieces of equal length."""
    kind = docs.schema[id_col].dataType.simpleString()
    ids = ", ids binary" if with_ids else ""

    names = ["id", "piece", "start", "length", "ids_crc32", "pid", "rank", "ids"]
    kinds = [pa.int32(), *[pa.int64()] * 3, pa.int32(), pa.int64(), pa.binary()]

    def run(batches):
        tokens, end, pid, seen = word_tokens(tokenizer_path), int(end_id).to_bytes(4, "little"), TaskContext.get().partitionId(), {}

        for b in batches:
            row, rows = [], []
            for at, data in enumerate(tokens.each(b.column(1).to_pylist())):
                data += end
                n = len(data) // 4
                for k, start in enumerate(range(0, n, capacity)):
                    part = data[4 * start : 4 * (start + capacity)]
                    length = len(part) // 4
                    seen[length] = rank = seen.get(length, -1) + 1
                    row.append(at)
                    rows.append((k, start, length, zlib.crc32(part), pid, rank, part if with_ids else None))
            columns = [list(c) for c in zip(*rows, strict=True)] or [[]] * 7
            arrays = [b.column(0).take(pa.array(row, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))]
            yield pa.RecordBatch.from_arrays(arrays[: 7 + with_ids], names[: 7 + with_ids])

    return docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, pid int, rank bigint{ids}")


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents with sequence_id and offset; with_ids adds the ids (little-endian unsigned 32-bit).

    A document is its ids and then end_id; only one longer than capacity is cut. A null or empty text is the end id
    alone. Every row is packed for itself, so repeated rows give repeated pieces, and a null id stays null; an empty
    table gives no pieces; other columns aren't read. To the driver go the counts of each length (capacity entries at
    most); to the executors goes a plan whose size doesn't follow the number of documents but its logarithm.
    """
    pieces = materialize(token_pieces(docs, tokenizer_path, capacity, end_id, with_ids, id_col, text_col), "pieces")
    counts = materialize(pieces.groupBy("length", "pid").agg(F.count(F.lit(1)).alias("n")), "lengths")
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = pieces.sparkSession.sparkContext.broadcast(Places(program(histogram, capacity).plan))
    before = Window.partitionBy("length").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "pid", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    # A row for each length and partition: no table to broadcast.
    ranked = pieces.join(bases.hint("merge"), ["length", "pid"]).withColumn("rank", F.col("rank") + F.col("base")).drop("base", "pid")
    own = ["id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    kinds = dict(pieces.dtypes)

    def place(batches):
        for b in batches:
            sequence, offset = places.value(b.column("length").to_numpy(), b.column("rank").to_numpy())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in own), pa.array(sequence), pa.array(offset)], [*own, "sequence_id", "offset"])

    placed = ranked.select(*own, "rank").mapInArrow(place, ", ".join(f"{c} {kinds[c]}" for c in own) + ", sequence_id bigint, offset bigint")
    return placed.withColumnRenamed("id", id_col)
