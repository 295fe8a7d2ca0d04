"""Exact top-k inner products on a bit-sliced index.

Each component is quantised to an integer and stored as bit slices: bitmaps over the rows of a block, one for each
binary digit. A query's score is the sum, over its components' binary digits, of shifted slices; full adders on whole
bitmaps (carry-save, three bitmaps into two) make the slices of the scores of all rows at once. The top rows are then
selected from the most significant slice downward, and ties at the boundary are resolved by id.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Rows of one index block and queries of one query block.
BLOCK, QUERIES = 32_768, 256
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


class SliceBlock:
    """Bit slices of up to BLOCK vectors; x[d] = low[d] + sum of 2**j * slice[d][j]."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        n, dims = vectors.shape
        self.ids, self.n, self.dims, self.words = ids, n, dims, (n + 63) // 64
        self.low = vectors.min(axis=0) if n else np.zeros(dims, np.int64)
        span = (vectors - self.low).astype(np.uint64)
        self.width = [int(x).bit_length() for x in (span.max(axis=0) if n else span[:0].sum(axis=0))]
        self.first = np.cumsum([0, *self.width])
        self.slices = np.zeros((int(self.first[-1]), self.words), np.uint64)
        for d in range(dims):
            for j in range(self.width[d]):
                self.slices[self.first[d] + j] = bitmap((span[:, d] >> np.uint64(j)) & np.uint64(1), self.words)

    def plane_sums(self, query: np.ndarray) -> tuple[list[np.ndarray], int]:
        """Slices of the scores less a constant, and the constant. Negative components use complemented slices."""
        columns: dict[int, list[np.ndarray]] = {}
        constant = 0
        straight, turned = self.slices, self.complement()
        for d, q in enumerate(query.tolist()):
            if not q:
                continue
            constant += q * int(self.low[d])
            source, a = straight, abs(q)
            if q < 0:
                constant -= a * ((1 << self.width[d]) - 1)
                source = turned
            own = source[self.first[d] : self.first[d + 1]]
            b = 0
            while a:
                if a & 1:
                    for j in range(len(own)):
                        columns.setdefault(b + j, []).append(own[j])
                a >>= 1
                b += 1
        sums: list[np.ndarray] = []
        weight, carried = 0, None
        while columns or carried is not None:
            own = columns.pop(weight, None)
            parts = ([np.array(own)] if own else []) + ([carried] if carried is not None else [])
            x = np.concatenate(parts) if parts else np.zeros((1, self.words), np.uint64)
            carries = []
            while len(x) > 2:
                k = len(x) // 3
                a, b, c = x[:k], x[k : 2 * k], x[2 * k : 3 * k]
                u = a ^ b
                carries.append((a & b) | (u & c))
                x = np.concatenate((u ^ c, x[3 * k :])) if len(x) > 3 * k else u ^ c
            if len(x) == 2:
                carries.append((x[0] & x[1])[None])
                x = (x[0] ^ x[1])[None]
            sums.append(x[0])
            carried = np.concatenate(carries) if carries else None
            weight += 1
        return sums, constant

    def complement(self) -> np.ndarray:
        if not hasattr(self, "_turned"):
            self._turned = self.slices ^ ALL
        return self._turned

    def top(self, query_id, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the block's k best rows other than query_id's."""
        dims = max(self.dims, len(query))
        q = np.zeros(dims, np.int64)
        q[: len(query)] = query
        sums, constant = self.plane_sums(q[: self.dims])
        open_rows = bitmap((self.ids != query_id).astype(np.uint64), self.words)
        sure = np.zeros(self.words, np.uint64)
        for s in reversed(sums):
            more = open_rows & s
            n = int(np.bitwise_count(sure | more).sum())
            if n >= k:
                open_rows = more
            else:
                sure |= more
                open_rows &= ~s
        rows = positions(sure)
        ties = positions(open_rows)
        if (need := k - len(rows)) < len(ties):
            ties = ties[np.argsort(self.ids[ties], kind="stable")[:need]]
        rows = np.concatenate((rows, ties))
        score = np.full(len(rows), constant, np.int64)
        for w, s in enumerate(sums):
            score += ((s[rows >> 6] >> (rows & 63).astype(np.uint64)) & np.uint64(1)).astype(np.int64) << w
        return self.ids[rows], score


def bitmap(bits: np.ndarray, words: int) -> np.ndarray:
    out = np.zeros(words * 64, np.uint8)
    out[: len(bits)] = bits
    return np.packbits(out, bitorder="little").view("<u8")


def positions(bits: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bits.view(np.uint8), bitorder="little"))


def matrix(vectors: list[list[int]]) -> np.ndarray:
    """Rows of one width; a component that a vector lacks is 0."""
    width = max(map(len, vectors), default=0)
    if all(len(v) == width for v in vectors):
        return np.array(vectors, np.int64).reshape(len(vectors), width)
    out = np.zeros((len(vectors), width), np.int64)
    for k, v in enumerate(vectors):
        out[k, : len(v)] = v
    return out


def blocks(vectors: DataFrame, size: int, build) -> tuple[DataFrame, int]:
    """(lot, block): vectors dealt out evenly to lots of about size rows, gathered into pickled blocks of size rows at most; and the number of lots."""
    n = vectors.count()
    parts = max(1, -(-n // size))

    def run(batches):
        ids: list[int] = []
        own: list[list[int]] = []
        for b in batches:
            ids += b.column(0).to_pylist()
            own += b.column(1).to_pylist()
            while len(ids) >= size:
                yield made(ids[:size], own[:size])
                del ids[:size], own[:size]
        if ids:
            yield made(ids, own)

    def made(ids, own):
        block = pickle.dumps(build(np.array(ids, np.int64), matrix(own)))
        return pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([block], pa.binary())], ["lot", "block"])

    return vectors.repartition(parts).mapInArrow(run, "lot int, block binary"), parts


def quantised(vectors: DataFrame, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """(id, q): floor(scale * component); without rows whose id or vector is null or holds a null or non-finite component."""
    x = F.col(vector_col)
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    sound = vectors.filter(F.col(id_col).isNotNull() & x.isNotNull()).filter(F.coalesce(fine, F.lit(False)))
    return sound.select(F.col(id_col).cast("long").alias("id"), F.transform(x, lambda v: F.floor(v.cast("double") * scale).cast("long")).alias("q"))


def top_k(vectors: DataFrame, query_filter, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each query its k rows of the highest integer inner product, ties to smaller ids.

    query_filter is a predicate on column id. Queries meet rows block by block: each pair of a query block and an
    index block is one task's unit and returns k rows a query, which a window per query merges. Rows with the query's
    id are left out; a repeated query row is one query; a repeated row is a candidate each time. Rows that are null or
    hold null or non-finite components take no part; vectors of other widths count missing components as 0; scores
    wrap at 64 bits. Fewer rows than k give all of them; empty tables give no rows; other columns aren't read.
    """
    all_rows = materialize(quantised(vectors, scale, id_col, vector_col), "quantised")
    asked = all_rows.filter(query_filter).dropDuplicates(["id", "q"])
    index, lots = blocks(all_rows, BLOCK, SliceBlock)
    index = materialize(index, "slices")
    queries = materialize(blocks(asked, QUERIES, lambda ids, q: (ids, q))[0], "queries")

    def score(batches):
        for b in batches:
            for asked, own in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids, q = pickle.loads(asked)
                block = pickle.loads(own)
                found = [block.top(i, v, k) for i, v in zip(ids.tolist(), q, strict=True)]
                n = [len(f[0]) for f in found]
                if sum(n):
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, n)), pa.array(np.concatenate([f[0] for f in found])), pa.array(np.concatenate([f[1] for f in found]))], ["query_id", "vec_id", "score"])

    # Query blocks go to every lot of the index; the index, which is the larger side, isn't sent around.
    sent = queries.select(F.explode(F.sequence(F.lit(0), F.lit(lots - 1))).alias("lot"), F.col("block").alias("asked"))
    pairs = sent.join(index.hint("shuffle_hash"), "lot").select("asked", "block")
    best = pairs.mapInArrow(score, "query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
