"""Substring dedup by relative Lempel-Ziv parsing.

Documents are factored against the documents with smaller ids. The reference is indexed in blocks by anchors: every
window of size words holds an anchor, its run of anchor words with the least hash, and the index knows for an anchor its
first occurrence in the document with the least id, and the block of words around it. So a document meets just the
blocks that it can share a window with, one for each of its anchors, and never all of them.

A document's anchors that follow each other at one distance to one reference document are a chain: as anchors overlap, all
words from the first to the last of a chain match. A match is a chain with what its ends match in their blocks, to the left
and to the right, so it can't be extended within reach of its anchors. The greedy parse takes, from left to right, the
match that reaches farthest, and what no match holds stays literal. A match of size words or more is a duplicate span.

Windows at the ends of matches, where this document parts from the first occurrence, may still start in another earlier
document. Each is looked up, by 128 bits, among the windows that other documents have at the ends of their matches: a window
that the block of its anchor holds is part of a match, so an equal window anywhere else is at the end of one, too.
Together that finds exactly the windows that start in an earlier document.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import SPACE, discard, fresh, materialize, row_key
from .hashing import mix, run_hashes, words_of

SIZE, ANCHOR = 13, 8


class Anchored(NamedTuple):
    """Anchors of the windows of some rows: row, place (in the words of all rows), value, and the places of its first and last window."""

    row: np.ndarray
    place: np.ndarray
    value: np.ndarray
    first: np.ndarray
    last: np.ndarray


def anchors(h: np.ndarray, offsets: np.ndarray, size: int, anchor: int) -> Anchored:
    """Anchors of the rows whose words h lie between offsets; leftmost of equals. No window reaches over a row's end."""
    none = np.empty(0, np.int64)
    if len(h) < size:
        return Anchored(none, none, none.astype(np.uint64), none, none)
    g = run_hashes(h, anchor)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    window = np.flatnonzero(np.arange(size, len(h) + 1) <= offsets[1:][row[: len(h) - size + 1]])
    # The least of size - anchor + 1 neighbours, leftmost of equals, by comparing one shift after another.
    least, place = g[window].copy(), window.copy()
    for k in range(1, size - anchor + 1):
        other = g[window + k]
        better = other < least
        least[better] = other[better]
        place[better] = window[better] + k
    cut = np.flatnonzero(np.diff(place, prepend=-1) | np.diff(row[window], prepend=-1))
    ends = np.append(cut[1:], len(window)) - 1
    return Anchored(row[window[cut]], place[cut], least[cut], window[cut], window[ends])


def anchor_rows(own: DataFrame, size: int, anchor: int) -> DataFrame:
    """(anchor, id, mark, place): the first occurrence of every anchor in every row."""
    kind = own.schema["id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            for w in words_of(b.column(2)):
                found = anchors(w.hashes[0], w.offsets, size, anchor)
                order = np.lexsort((found.place, found.value, found.row))
                row, value = found.row[order], found.value[order]
                once = np.diff(row, prepend=-1).astype(bool)
                once[1:] |= value[1:] != value[:-1]
                take = pa.array(row[once] + w.first)
                place = found.place[order][once] - w.offsets[row[once]]
                yield pa.RecordBatch.from_arrays([pa.array(value[once].view(np.int64)), b.column(0).take(take), b.column(1).take(take), pa.array(place.astype(np.int32))], ["anchor", "id", "mark", "place"])

    return own.select("id", "mark", "text").mapInArrow(run, f"anchor bigint, id {kind}, mark bigint, place int")


def by_document(rows: DataFrame) -> DataFrame:
    """(id, anchors): the other columns of rows as one list for each id. Rows are sorted by id and cut where it changes."""
    kinds = dict(rows.dtypes)
    names = [c for c in rows.columns if c != "id"]

    def run(batches):
        held = None
        for b in batches:
            whole = pa.concat_batches([held, b]) if held is not None else b
            ids = whole.column(0)
            change = np.flatnonzero(pc.not_equal(ids.slice(1), ids.slice(0, max(0, len(ids) - 1))).to_numpy(zero_copy_only=False)) + 1
            last = int(change[-1]) if len(change) else 0
            if last:
                yield lists(whole.slice(0, last), np.concatenate(([0], change)))
            held = whole.slice(last)
        if held is not None and len(held):
            yield lists(held, np.array([0, len(held)]))

    def lists(b, bounds):
        columns = [pa.concat_arrays([b.column(c)]) for c in names]
        made = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.StructArray.from_arrays(columns, names))
        return pa.RecordBatch.from_arrays([b.column(0).take(pa.array(bounds[:-1])), made], ["id", "anchors"])

    fields = ",".join(f"{c}:{kinds[c]}" for c in names)
    return rows.select("id", *names).repartition("id").sortWithinPartitions("id").mapInArrow(run, f"id {kinds['id']}, anchors array<struct<{fields}>>")


def shared_anchors(own: DataFrame, size: int, anchor: int) -> DataFrame:
    """(id, anchors): for each id its anchors (a, ref, ref_mark, ref_place) that another id has too, with their first occurrence."""
    every = materialize(anchor_rows(own, size, anchor), "anchors")
    met = every.groupBy("anchor").agg(F.min("id").alias("ref"), F.max("id").alias("high"), F.min_by("mark", "id").alias("ref_mark"), F.min_by("place", "id").alias("ref_place"))
    met = materialize(met.filter(F.col("ref") != F.col("high")).drop("high"), "shared")
    # One row an anchor on the hashed side, so the many rows needn't be sorted.
    rows = every.select("anchor", "id").join(met.hint("shuffle_hash"), "anchor")
    out = materialize(by_document(rows.select("id", F.col("anchor").alias("a"), "ref", "ref_mark", "ref_place")), "parts")
    discard(every, met)
    return out


class Known(NamedTuple):
    """Anchors of some rows that are shared: which of the anchors found, and the index of each in the rows' lists."""

    which: np.ndarray
    entry: np.ndarray


def looked_up(found: Anchored, values: np.ndarray, row: np.ndarray) -> Known:
    """values and row are the listed anchors and the rows that they are listed for."""
    # A key for an anchor in a row. Two anchors that share a key are told apart by their values.
    keys = values ^ mix(row.astype(np.uint64))
    order = np.argsort(keys, kind="stable")
    mine = found.value ^ mix(found.row.astype(np.uint64))
    at = np.searchsorted(keys, mine, sorter=order)
    hit = at < len(keys)
    entry = order[at[hit]]
    hit[hit] = (values[entry] == found.value[hit]) & (row[entry] == found.row[hit])
    return Known(np.flatnonzero(hit), order[at[hit]])


#: What a row of an anchor's occurrence stands for: a block of the index, or which sides of it aren't inside a chain.
BLOCK, LEFT, RIGHT, BOTH = 0, 1, 2, 3


def occurrences(own: DataFrame, parts: DataFrame, size: int, anchor: int) -> DataFrame:
    """Occurrences of shared anchors: (id, mark, anchor, check, place, kind, chain, few, block, windows, ref).

    kind says whether the row is a block of the index (the anchor's first occurrence), the left or the right end of a
    chain of size words or more, or a member of a shorter chain, with both sides. check is a second hash of the anchor;
    chain the number of words of a long chain, or of the anchor; block holds the hashes of the size - anchor words on either
    side, outward, 0 where the text ends; windows holds two hashes of each window that reaches out of the chain, the
    first of them few words before the place, each next one word earlier.
    """
    kind = own.schema["id"].dataType
    side = size - anchor

    def chunk(b, w):
        """One batch of rows for the words w of the batch b."""
        h, offsets = w.hashes[0], w.offsets
        rows = len(offsets) - 1
        lists = b.column(3).slice(w.first, rows)
        bounds = lists.offsets.to_numpy()
        listed = lists.values.slice(bounds[0], bounds[-1] - bounds[0])
        field = lambda c: listed.field(c).to_numpy(zero_copy_only=False)
        found = anchors(h, offsets, size, anchor)
        known = looked_up(found, field("a").view(np.uint64), np.repeat(np.arange(rows), np.diff(bounds)))
        if not len(known.which):
            return None
        row, place = found.row[known.which], found.place[known.which]
        local = place - offsets[row]
        entry = known.entry
        ref = listed.field("ref").take(pa.array(entry))
        code = ref.dictionary_encode().indices.to_numpy(zero_copy_only=False)
        mark, ref_place = field("ref_mark")[entry], field("ref_place")[entry].astype(np.int64)
        take = pa.array(row + w.first)
        ids, marks = b.column(0).take(take), b.column(1).take(take)
        own_first = pc.equal(ids, ref).to_numpy(zero_copy_only=False) & (marks.to_numpy(zero_copy_only=False) == mark) & (local == ref_place)
        follows = np.zeros(len(row), bool)
        follows[1:] = (known.which[1:] == known.which[:-1] + 1) & (row[1:] == row[:-1]) & (code[1:] == code[:-1]) & (mark[1:] == mark[:-1]) & (np.diff(ref_place - local) == 0) & (np.diff(place) <= anchor) & ~own_first[1:] & ~own_first[:-1]
        begin = np.flatnonzero(~follows)
        end = np.append(begin[1:], len(row)) - 1
        words = place[end] - place[begin] + anchor
        long = (words >= size) & ~own_first[begin]
        length = np.repeat(words, end - begin + 1)
        single = np.flatnonzero(np.repeat(~long, end - begin + 1))
        first, last = found.first[known.which], found.last[known.which]
        side_of = np.where(own_first[single], BLOCK, BOTH)
        k = np.concatenate((single, begin[long], end[long]))
        what = np.concatenate((side_of, np.full(int(long.sum()), LEFT), np.full(int(long.sum()), RIGHT)))
        few = np.where(what == LEFT, 1, place[k] - last[k])
        many = np.where(what == RIGHT, side - 1, place[k] - first[k])
        count = np.where(what == BLOCK, 0, np.maximum(0, many - few + 1))
        of = np.repeat(np.arange(len(k)), count)
        before = few[of] + np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
        window = place[k][of] - before
        pairs = np.stack([run_hashes(x, size)[window] for x in w.hashes], axis=1) if len(of) else np.zeros((0, 2), np.uint64)
        around = np.concatenate((place[k][:, None] - 1 - np.arange(side), place[k][:, None] + anchor + np.arange(side)), axis=1)
        inside = (around >= offsets[row[k]][:, None]) & (around < offsets[row[k] + 1][:, None])
        block = np.where(inside, h[np.clip(around, 0, len(h) - 1)], np.uint64(0))
        chain = np.where((what == LEFT) | (what == RIGHT), length[k], anchor)
        pick = pa.array(k)
        int32 = lambda x: pa.array(x.astype(np.int32))
        columns = [
            ids.take(pick), marks.take(pick), pa.array(found.value[known.which][k].view(np.int64)), pa.array(run_hashes(w.hashes[1], anchor)[place[k]].view(np.int64)),
            int32(local[k]), int32(what), int32(chain), int32(few), ragged_bytes(block, np.full(len(k), 2 * side)), ragged_bytes(pairs, 2 * count), ref.take(pick),
        ]
        return pa.RecordBatch.from_arrays(columns, ["id", "mark", "anchor", "check", "place", "kind", "chain", "few", "block", "windows", "ref"])

    def run(batches):
        last, marks = object(), set()
        for b in batches:
            # Repeated rows of an id and a text follow each other here and count once.
            keep = np.ones(len(b), bool)
            for k, (i, m) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
                if i != last:
                    last, marks = i, set()
                keep[k] = m not in marks
                marks.add(m)
            b = b if keep.all() else b.filter(pa.array(keep))
            for w in words_of(b.column(2), seeds=2):
                if (out := chunk(b, w)) is not None:
                    yield out

    texts = own.select("id", "mark", "text").join(parts.hint("merge"), "id")
    name = kind.simpleString()
    schema = f"id {name}, mark bigint, anchor bigint, check bigint, place int, kind int, chain int, few int, block binary, windows binary, ref {name}"
    return materialize(texts.select("id", "mark", "text", "anchors").mapInArrow(run, schema), "occurrences")


def ragged_bytes(numbers: np.ndarray, counts: np.ndarray) -> pa.Array:
    """64-bit numbers, counts of them to a binary value."""
    edges = np.concatenate(([0], np.cumsum(8 * counts))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(numbers))])


def numbers_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """What ragged_bytes was given."""
    own = pa.concat_arrays([column.cast(pa.large_binary())])
    edges = np.frombuffer(own.buffers()[1], np.int64, len(own) + 1, own.offset * 8)
    n = (edges[-1] - edges[0]) // 8
    return np.frombuffer(own.buffers()[2], np.uint64, n, edges[0]) if n else np.zeros(0, np.uint64), np.diff(edges) // 8


def matched(mine: np.ndarray, other: np.ndarray) -> np.ndarray:
    """How many words from the anchor outward are equal, for each row of words; 0 stands for none."""
    return np.cumprod((mine == other) & (mine != 0), axis=1).sum(axis=1)


def matches(found: DataFrame, size: int, anchor: int) -> DataFrame:
    """Matches with the index's blocks, and the windows at their ends that no match holds.

    (id, mark, start, n, ref, ref_start): a match of n words at a smaller id; (id, mark, start, w1, w2): a window.
    """
    side = size - anchor
    kind = dict(found.dtypes)["id"]
    names = ["id", "mark", "start", "n", "ref", "ref_start", "w1", "w2"]

    def run(batches):
        for b in batches:
            get = lambda c: b.column(c).to_numpy(zero_copy_only=False).astype(np.int64)  # noqa: E731, B023
            block, other = (numbers_of(b.column(c))[0].reshape(-1, 2 * side) for c in ("block", "ref_block"))
            what, place, chain = get("kind"), get("place"), get("chain")
            # Within a long chain other anchors at the same distance vouch for this one.
            same = (get("check") == get("ref_check")) | (what != BOTH)
            left = np.where(same, np.where(what == RIGHT, side, matched(block[:, :side], other[:, :side])), -1)
            right = np.where(same, np.where(what == LEFT, side, matched(block[:, side:], other[:, side:])), -1)
            whole = np.flatnonzero(same & b.column("earlier").to_numpy(zero_copy_only=False))
            start = np.where(what == RIGHT, place + anchor - chain, place - left)
            length = chain + np.where(what == RIGHT, 0, left) + np.where(what == LEFT, 0, right)
            ref_start = start + get("ref_place") - place
            take, none = pa.array(whole), pa.nulls(len(whole), pa.int64())
            int32 = lambda x: pa.array(x.astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.column("id").take(take), b.column("mark").take(take), int32(start[whole]), int32(length[whole]), b.column("ref").take(take), int32(ref_start[whole]), none, none], names)
            pairs, counts = numbers_of(b.column("windows"))
            pairs, counts = pairs.reshape(-1, 2), counts // 2
            of = np.repeat(np.arange(len(b)), counts)
            before = get("few")[of] + np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)
            k = np.flatnonzero((left[of] < before) | (right[of] < side - before))
            take, none = pa.array(of[k]), pa.nulls(len(k), pa.int32())
            hashes = np.ascontiguousarray(pairs[k]).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("id").take(take), b.column("mark").take(take), int32(place[of[k]] - before[k]), none, pa.nulls(len(k), b.schema.field("ref").type), none, pa.array(hashes[:, 0]), pa.array(hashes[:, 1])], names)

    index = found.filter(F.col("kind") == BLOCK).select("anchor", F.col("place").alias("ref_place"), F.col("check").alias("ref_check"), F.col("block").alias("ref_block"))
    met = found.filter(F.col("kind") != BLOCK).join(index.hint("merge"), "anchor").withColumn("earlier", F.col("ref") < F.col("id"))
    met = met.select("id", "mark", "check", "place", "kind", "chain", "few", "block", "windows", "ref", "ref_place", "ref_check", "ref_block", "earlier")
    return materialize(met.mapInArrow(run, f"id {kind}, mark bigint, start int, n int, ref {kind}, ref_start int, w1 bigint, w2 bigint"), "matches")


def late_windows(ends: DataFrame) -> DataFrame:
    """The rows (w1, w2, id, mark, start) of ends whose window a smaller id has too.

    Equal windows are sorted together and compared with the least id among them, so no more rows come out than went in,
    however large a group of near copies is.
    """
    return ends.withColumn("low", F.min("id").over(Window.partitionBy("w1", "w2"))).filter(F.col("low") < F.col("id")).drop("low")


def duplicate_runs(docs: DataFrame, size: int = SIZE, anchor: int = ANCHOR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, mark, runs): for each document that has any, its matches (start, n, ref, ref_start) of size words or more and
    its windows (ref null) that start in another earlier document. id and mark are as in common.row_key."""
    own = docs.filter(F.col(id_col).isNotNull()).select(row_key(id_col, text_col).alias("k"), F.col(text_col).alias("text")).select("k.id", "k.mark", "text")
    parts = shared_anchors(own, size, anchor)
    found = occurrences(own, parts, size, anchor)
    discard(parts)
    every = matches(found, size, anchor)
    discard(found)
    late = late_windows(every.filter(F.col("w1").isNotNull()).select("w1", "w2", "id", "mark", "start"))
    run = lambda n: F.struct("start", n.cast("int").alias("n"), "ref", "ref_start")
    spans = every.filter(F.col("n") >= size).select("id", "mark", run(F.col("n")).alias("r"))
    late = late.select("id", "mark", "start", F.lit(None).cast(dict(every.dtypes)["ref"]).alias("ref"), F.lit(None).cast("int").alias("ref_start")).select("id", "mark", run(F.lit(size)).alias("r"))
    out = materialize(spans.union(late).groupBy("id", "mark").agg(F.collect_set("r").alias("runs")), "runs")
    discard(every)
    return out


class Factor(NamedTuple):
    start: int
    n: int
    ref: object
    ref_start: int


def merged(runs: list) -> list[Factor]:
    """Matches with one reference at one distance that overlap or touch, as one each: nothing longer matches there."""
    out: list[Factor] = []
    by: dict[tuple, int] = {}
    for start, n, ref, ref_start in sorted((r["start"], r["n"], r["ref"], r["ref_start"]) for r in runs if r["ref"] is not None):
        key = ref, ref_start - start
        k = by.get(key)
        if k is not None and start <= out[k].start + out[k].n:
            out[k] = out[k]._replace(n=max(out[k].n, start + n - out[k].start))
        else:
            by[key] = len(out)
            out.append(Factor(start, n, ref, ref_start))
    return out


def greedy_parse(runs: list) -> list[Factor]:
    """The factors of a document from left to right: of the matches at a place the one that reaches farthest, from where the
    factor before it ends; words between factors are literals."""
    every, out, at, k = sorted(merged(runs), key=lambda f: f.start), [], 0, 0
    best: Factor | None = None
    while True:
        while k < len(every) and every[k].start <= at:
            if best is None or every[k].start + every[k].n > best.start + best.n:
                best = every[k]
            k += 1
        if best is not None and best.start + best.n > at:
            skip = at - best.start
            out.append(Factor(at, best.n - skip, best.ref, best.ref_start + skip))
            at += best.n - skip
        elif k < len(every):
            at = every[k].start
        else:
            return out


def spans(runs: list, words: int) -> list[tuple[int, int]]:
    """Word spans [from, to) that the runs cover, in order and apart."""
    out: list[tuple[int, int]] = []
    for start, n in sorted((r["start"], r["n"]) for r in runs):
        end = min(start + n, words)
        if out and start <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], end)
        elif start < end:
            out.append((start, end))
    return out


def without(data: bytes, starts: np.ndarray, cut: list[tuple[int, int]]) -> str:
    """data less the words of the spans, each with the white space behind it; starts are the places of all words."""
    place = lambda word: int(starts[word]) if word < len(starts) else len(data)
    kept, at = [], 0
    for a, e in cut:
        kept.append(data[at : place(a)])
        at = place(e)
    return b"".join([*kept, data[at:]]).decode("utf-8", "replace")


def remove_repeats(docs: DataFrame, size: int = SIZE, anchor: int = ANCHOR, id_col: str = "doc_id", text_col: str = "text", n_words: str | None = None, n_removed: str | None = None, factors: str | None = None) -> DataFrame:
    """docs, all columns, with text_col less all words covered by a window of size words that also starts in a document
    with a smaller id. n_words, n_removed and factors name columns for the number of words, of those removed, and for the
    greedy parse (start, n, ref, ref_start, in words) relative to the documents with smaller ids.

    Windows are judged on the input. A null text stays null and has no words; a null id is neither cut nor a reference;
    rows that repeat an id and its text are one document; rows that share an id alone are each cut for what they hold,
    and none is a reference for the other; an empty table gives an empty one; a text without duplicates comes back
    unchanged; columns of any name stay as they are. Any length is parsed whole.
    """
    key, mark, runs = fresh(docs, "key", "mark", "runs")
    found = duplicate_runs(docs, size, anchor, id_col, text_col).select(F.col("id").alias(key), F.col("mark").alias(mark), F.col("runs").alias(runs))
    # Whole texts are joined by merging at every size: what they meet grows with them.
    joined = docs.join(found.hint("merge"), (F.col(id_col) == F.col(key)) & (F.xxhash64(text_col) == F.col(mark)), "left").drop(key, mark)
    fields = docs.schema.fields
    at, width = docs.schema.fieldNames().index(text_col), len(fields)
    names = [f"c{k}" for k in range(width)]
    kinds = [f"c{k} {f.dataType.simpleString()}" for k, f in enumerate(fields)]
    kind = docs.schema[id_col].dataType
    extra = [(n_words, "bigint"), (n_removed, "bigint"), (factors, f"array<struct<start:int,n:int,ref:{kind.simpleString()},ref_start:int>>")]
    factor = pa.list_(pa.struct([("start", pa.int32()), ("n", pa.int32()), ("ref", to_arrow_type(kind)), ("ref_start", pa.int32())]))

    def run(batches):
        for b in batches:
            texts, found = b.column(at).to_pylist(), b.column(width).to_pylist()
            n, gone, parsed = [], [], []
            for w in words_of(b.column(at), seeds=0, spans=True):
                for k, (first, end) in enumerate(zip(w.offsets[:-1].tolist(), w.offsets[1:].tolist(), strict=True), w.first):
                    cut = spans(found[k], end - first) if found[k] else []
                    if cut:
                        texts[k] = without(texts[k].encode("utf-8", "replace"), w.start[first:end], cut)
                    n.append(end - first)
                    gone.append(sum(e - a for a, e in cut))
                    parsed.append([f._asdict() for f in greedy_parse(found[k])] if factors and found[k] else [])
            columns = [pa.array(texts, b.schema.field(at).type) if j == at else b.column(j) for j in range(width)]
            more = [pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(parsed, factor)]
            yield pa.RecordBatch.from_arrays(columns + [m for m, (x, _) in zip(more, extra, strict=True) if x], names + [f"x{j}" for j, (x, _) in enumerate(extra) if x])

    # Names that mapInArrow can't resolve are set again behind it.
    out = joined.toDF(*names, "runs").mapInArrow(run, ", ".join(kinds + [f"x{j} {t}" for j, (x, t) in enumerate(extra) if x]))
    return out.toDF(*docs.columns, *(x for x, _ in extra if x))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, n_removed and the SHA-256 of the kept words joined by blanks, from the texts that remove_repeats leaves."""
    left = remove_repeats(docs.select(id_col, text_col), id_col=id_col, text_col=text_col, n_words="n_words", n_removed="n_removed")
    words = F.filter(F.split(F.coalesce(text_col, F.lit("")), f"{SPACE}+"), lambda x: x != "")
    return left.select(id_col, "n_words", "n_removed", F.sha2(F.array_join(words, " ").cast("binary"), 256).alias("kept_sha256"))
