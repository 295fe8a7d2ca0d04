"""Near-duplicate documents by fast similarity sketches, banding and exact verification.

Sketch: in round i every shingle is hashed to one bin and offers the value (i, hash); a bin keeps its least. After
that, round T + b offers every shingle to bin b alone, so each of the T coordinates fills after at most 2T rounds, and
mostly after T ln T / set size. Two sets agree in a coordinate with the chance of their similarity, with Chernoff
bounds. BANDS bands of ROWS coordinates make candidates: a pair of similarity 0.75 shares no band with a chance of
(1 - 0.75**6)**64 < 4e-6.

Documents of one shingle set are one class from the start. In a bucket all members are tied to the least one by
verified links. Where that leaves a bucket with several components, its sets are settled exactly by a prefix filter:
those in different components meet where a prefix of their rarest shingles does, and sizes, places and bitmaps rule out
what can't be linked. If very many still meet, they are first dealt out at random into small hands, each round making
fewer pairs than members, which joins what is linked densely. So no group of copies is expanded into its pairs, and no
link of a bucket is lost.
"""

from __future__ import annotations

from functools import reduce
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, discard, fresh, materialize
from .components import components
from .hashing import A, mix, shingle_set, words_of

BANDS, ROWS = 64, 6
T = BANDS * ROWS
#: Pairs for each row of rare shingles that are held against each other at once; beyond that, members of a hand, and
#: rounds of dealing at most. What dealing leaves is settled exactly.
DENSE, HAND, TURNS = 256, 4, 6
#: Bits of a set's bitmap.
BITS = 1024
LOW = np.uint64(0xFFFFFFFF)
S32, S40 = np.uint64(32), np.uint64(40)
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def sketch(s: np.ndarray, t: int = T) -> np.ndarray:
    """t coordinates of a non-empty set of 64-bit hashes. Rounds are made several at a time for small sets."""
    n, i = len(s), 0
    out = np.full(t, EMPTY)
    while i < t and (out == EMPTY).any():
        r = np.arange(i, min(t, i + max(1, 4096 // n)), dtype=np.uint64)
        h = mix(s[None, :] ^ mix(r)[:, None])
        bins = ((h >> S32) * np.uint64(t)) >> S32
        np.minimum.at(out, bins.ravel().astype(np.int64), ((r << S40)[:, None] | (h & LOW)).ravel())
        i += len(r)
    bare = np.flatnonzero(out == EMPTY)
    step = max(1, 65_536 // n)
    for k in range(0, len(bare), step):
        b = bare[k : k + step]
        r = (b + t).astype(np.uint64)
        out[b] = (r << S40) | (mix(s[None, :] ^ mix(r)[:, None]) & LOW).min(axis=1)
    return out


def band_keys(coordinates: np.ndarray) -> np.ndarray:
    rows = coordinates.reshape(BANDS, ROWS)
    key = np.arange(BANDS, dtype=np.uint64)
    for j in range(ROWS):
        key = mix(key * A + rows[:, j])
    return key.view(np.int64)


def bitmap(s: np.ndarray) -> np.ndarray:
    """Bit j of BITS is the parity of the number of members that fall into class j of as many, by their top bits."""
    odd = np.bincount((s >> np.uint64(32)).astype(np.int64) * BITS >> 32, minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def hopeful(a: Column, b: Column, n: Column, m: Column, percent: int) -> Column:
    """Whether the bitmaps a and b of sets of n and m members leave room for a link; lossless.

    A bit in which two bitmaps differ takes a member of its class that one set alone has, so the sets share at most
    half of n + m less these bits.
    """
    bits = reduce(lambda x, y: x + y, (F.bit_count(F.get(a, F.lit(k)).bitwiseXOR(F.get(b, F.lit(k)))) for k in range(BITS // 64)))
    # shared <= (n + m - bits) / 2 and all >= (n + m + bits) / 2
    return (n + m - bits) * 100 >= (n + m + bits) * percent


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def sketched(docs: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """Per row: id, mark, n_shingles, a 128-bit hash of the set, its band keys and its bitmap."""

    def run(batches):
        for b in batches:
            live = b.column(0).is_valid().to_numpy(zero_copy_only=False)
            for w in words_of(b.column(2), True):
                n, one, two, keys, bits = [], [], [], [], []
                for k, (first, end) in enumerate(pairwise(w.offsets.tolist()), w.first):
                    s = shingle_set(w.hashes[0][first:end], size)
                    n.append(len(s))
                    whole = xxhash.xxh3_128_intdigest(s.tobytes())
                    one.append((whole >> 64) - (1 << 63))
                    two.append((whole & (1 << 64) - 1) - (1 << 63))
                    fine = len(s) and live[k]
                    keys.append(band_keys(sketch(s)) if fine else None)
                    bits.append(bitmap(s) if fine else None)
                rows = b.slice(w.first, len(n))
                numbers = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), *(pa.array(x, pa.int64()) for x in (n, one, two)), pa.array(keys, numbers), pa.array(bits, numbers)], ["id", "mark", "n_shingles", "set1", "set2", "bands", "bits"])

    kind = docs.schema[id_col].dataType.simpleString()
    own = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("mark"), F.col(text_col).alias("text"))
    return own.mapInArrow(run, f"id {kind}, mark bigint, n_shingles bigint, set1 bigint, set2 bigint, bands array<bigint>, bits array<bigint>")


def whole_sets(docs: DataFrame, wanted: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """(node, s) with the full set of each document in wanted (id, mark, node)."""

    def run(batches):
        for b in batches:
            for w in words_of(b.column(1), True):
                sets = [shingle_set(w.hashes[0][first:end], size).tobytes() for first, end in pairwise(w.offsets.tolist())]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(w.first, len(sets)), pa.array(sets, pa.binary())], ["node", "s"])

    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("mark"), F.col(text_col).alias("text"))
    # Whole texts are joined by merging at every size: what they meet grows with them.
    own = texts.join(wanted.hint("merge"), ["id", "mark"]).select("node", "text")
    return materialize(own.mapInArrow(run, "node bigint, s binary").dropDuplicates(["node"]), "sets")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes whose full sets are similar enough."""
    one = pairs.join(sets.select(F.col("node").alias("a"), F.col("s").alias("x")).hint("merge"), "a")
    both = one.join(sets.select(F.col("node").alias("b"), F.col("s").alias("y")).hint("merge"), "b")

    def batch(a, b, x, y):
        fine = [similar(np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64), percent) for p, q in zip(x, y, strict=True)]
        return {"a": [v for v, f in zip(a, fine, strict=True) if f], "b": [v for v, f in zip(b, fine, strict=True) if f]}

    return materialize(arrow_map(both, ["a", "b", "x", "y"], batch, "a bigint, b bigint"), "links")


def apart(pairs: DataFrame, label: DataFrame) -> DataFrame:
    """The pairs whose ends aren't known to be in one component: label (node, component), each node once."""
    at = lambda c: label.select(F.col("node").alias(c), F.col("component").alias(f"of_{c}"))
    of = lambda c: F.coalesce(f"of_{c}", c)
    return pairs.join(at("a"), "a", "left").join(at("b"), "b", "left").filter(of("a") != of("b")).select("a", "b")


def labelled(rows: DataFrame, label: DataFrame) -> DataFrame:
    """rows (node, ...) with the component c of each node."""
    return rows.join(label, "node", "left").withColumn("c", F.coalesce("component", "node")).drop("component")


def joined(links: DataFrame, label: DataFrame | None = None) -> DataFrame:
    """A stored table (node, component) for links (a, b) and the components label, stored and used up, that were known before.

    Old components are single nodes here, so only what links them is gone through again.
    """
    if label is None:
        return materialize(components(links), "labels")
    ends = lambda c, x: label.select(F.col("node").alias(c), F.col("component").alias(x))
    found = links.join(ends("a", "x"), "a", "left").join(ends("b", "y"), "b", "left").select(F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b"))
    new = materialize(components(found), "merged")
    old = label.join(new.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    alone = new.join(label, "node", "left_anti")
    out = materialize(old.union(alone.select("node", "component")), "labels")
    discard(new, label)
    return out


def rare_first(known: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(key, node, n, at): the first n - ceil(t n) + 1 shingles of each set in known (node, n), rare ones first, from at = 0.

    All sets are in one order, by the number of sets that have a shingle and then by its hash. Two sets that are linked
    share a shingle of these, and from the first that they share on, both have enough left for the link. So copies of
    a template that differ too much to be linked don't meet at the template's shingles.
    """

    def spread(node, s):
        each = [np.frombuffer(x, np.int64) for x in s]
        return {"node": np.repeat(np.array(node, np.int64), [len(x) for x in each]), "shingle": np.concatenate(each) if each else []}

    own = sets.join(known.select("node").hint("merge"), "node", "left_semi")
    flat = materialize(arrow_map(own, ["node", "s"], spread, "node bigint, shingle bigint"), "shingles")
    often = materialize(flat.groupBy("shingle").agg(F.count(F.lit(1)).alias("often")), "often")
    ranked = flat.join(often.hint("merge"), "shingle").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("often", "shingle"))).alias("s"))
    keep = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    heads = ranked.join(known.hint("merge"), "node").select("node", "n", F.posexplode(F.slice("s", 1, keep.cast("int"))).alias("at", "x"))
    # A shingle of one set alone meets nothing.
    out = materialize(heads.filter("x.often > 1").select(F.col("x.shingle").alias("key"), "node", "n", "at"), "heads")
    discard(flat, often)
    return out


def cross_pairs(heads: DataFrame) -> float:
    """How many pairs of a key's rows are in different components c, summed over keys."""
    per = heads.groupBy("key", "c").agg(F.count(F.lit(1)).cast("double").alias("m")).groupBy("key").agg((F.sum("m") * F.sum("m") - F.sum(F.col("m") * F.col("m"))).alias("x"))
    return (per.agg(F.sum("x")).first()[0] or 0) / 2


def sizes_fit(percent: int) -> Column:
    return (F.col("c") != F.col("e")) & (F.least("n", "m") * 100 >= F.greatest("n", "m") * percent)


def dealt(heads: DataFrame, turn: int, percent: int) -> DataFrame:
    """Pairs (a, b) of different components: the rows of a key are dealt out into hands of about HAND at random, and each is
    paired with the least of its hand. That makes fewer pairs than rows, however many rows a key has."""
    size = materialize(heads.groupBy("key").agg(F.count(F.lit(1)).alias("size")), "sizes")
    hands = heads.join(size.hint("merge"), "key").withColumn("hand", F.pmod(F.xxhash64("node", F.lit(turn)), F.ceil(F.col("size") / HAND)))
    least = hands.groupBy("key", "hand").agg(F.min(F.struct("node", "n", "c")).alias("l")).select("key", "hand", F.col("l.node").alias("b"), F.col("l.n").alias("m"), F.col("l.c").alias("e"))
    out = hands.join(materialize(least, "hands").hint("merge"), ["key", "hand"]).filter(sizes_fit(percent))
    out = materialize(out.select(F.greatest("node", "b").alias("a"), F.least("node", "b").alias("b")).distinct(), "dealt")
    discard(size)
    return out


def met(heads: DataFrame, bitmaps: DataFrame, percent: int) -> DataFrame:
    """A stored table of every pair (a, b) of different components that meets at a key and may be linked by sizes, places and bitmaps."""
    other = heads.select("key", F.col("node").alias("b"), F.col("n").alias("m"), F.col("c").alias("e"), F.col("at").alias("to"))
    need = F.ceil((F.col("n") + F.col("m")) * percent / (100 + percent))
    fit = (F.col("node") > F.col("b")) & (F.col("c") != F.col("e")) & (F.least(F.col("n") - F.col("at"), F.col("m") - F.col("to")) >= need)
    pairs = materialize(heads.join(other.hint("merge"), "key").filter(fit).select(F.col("node").alias("a"), "b").distinct(), "pairs")
    end = lambda c, x, k: bitmaps.select(F.col("node").alias(c), F.col("bits").alias(x), F.col("n").alias(k))
    both = pairs.join(end("a", "x", "n"), "a").join(end("b", "y", "m"), "b")
    out = materialize(both.filter(hopeful(F.col("x"), F.col("y"), F.col("n"), F.col("m"), percent)).select("a", "b"), "rest")
    discard(pairs)
    return out


def linked(members: DataFrame, bitmaps: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """A stored table (node, component) from bucket members (key, node, n, leader) and bitmaps (node, n, bits)."""
    tied = materialize(members.filter(F.col("node") != F.col("leader")).select(F.col("node").alias("a"), F.col("leader").alias("b")).distinct(), "tied")
    # The least leader first; nodes that are linked to one leader needn't be held against it again.
    first = verified(tied.groupBy("a").agg(F.min("b").alias("b")), sets, percent)
    more = verified(apart(tied, first.select(F.col("a").alias("node"), F.col("b").alias("component"))), sets, percent)
    label = joined(first.union(more))
    discard(tied, first, more)
    known = labelled(members.select("key", "node", "n"), label)
    mixed = materialize(known.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high")).filter("low <> high").select("key"), "mixed")
    known = materialize(members.select("key", "node", "n").join(mixed.hint("merge"), "key", "left_semi").select("node", "n").distinct(), "open")
    heads = rare_first(known, sets, percent)
    discard(mixed, known)
    total = heads.count()
    for turn in range(TURNS):
        if cross_pairs(labelled(heads, label)) <= DENSE * total:
            break
        pairs = dealt(labelled(heads, label), turn, percent)
        found = verified(pairs, sets, percent)
        label = joined(found, label)
        discard(pairs, found)
    pairs = met(labelled(heads, label), bitmaps, percent)
    found = verified(pairs, sets, percent)
    label = joined(found, label)
    discard(heads, pairs, found)
    return label


def judged(docs: DataFrame, size: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """Per row: id, mark, n_shingles, component_id and kept."""
    own = materialize(sketched(docs, size, id_col, text_col), "sketches")
    alive = own.filter(F.col("id").isNotNull() & (F.col("n_shingles") > 0))
    same = ["set1", "set2"]
    # Nodes are classes of rows with one set, numbered: rows may share an id and differ in their sets.
    classes = materialize(alive.groupBy(*same).agg(F.min("id").alias("rep")).withColumn("node", F.monotonically_increasing_id()), "classes")
    reps = alive.join(classes.hint("merge"), same).filter(F.col("id") == F.col("rep")).dropDuplicates(["node"]).select("node", "id", "mark", F.col("n_shingles").alias("n"), "bands", "bits")
    reps = materialize(reps, "reps")
    bands = reps.select(F.explode("bands").alias("key"), "node", "n")
    buckets = bands.groupBy("key").agg(F.min("node").alias("leader"), F.max("node").alias("other")).filter(F.col("leader") != F.col("other")).select("key", "leader")
    buckets = materialize(buckets, "buckets")
    members = materialize(bands.join(buckets.hint("merge"), "key"), "members")
    discard(buckets)
    wanted = materialize(reps.select("node", "id", "mark").join(members.select("node").distinct(), "node", "left_semi"), "wanted")
    sets = whole_sets(docs, wanted, size, id_col, text_col)
    label = linked(members, reps.select("node", "n", "bits"), sets, percent)
    discard(members, wanted, sets, reps)
    of = classes.join(label, "node", "left").withColumn("c", F.coalesce("component", "node"))
    least = materialize(of.groupBy("c").agg(F.min("rep").alias("found")), "least")
    named = materialize(of.join(least, "c").select("set1", "set2", "found"), "named")
    discard(classes, label, least)
    met = (own.set1 == named.set1) & (own.set2 == named.set2) & own.id.isNotNull() & (own.n_shingles > 0)
    out = own.join(named.hint("merge"), met, "left").select("id", "mark", "n_shingles", F.coalesce("found", "id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)))


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_shingles, component_id (least id reachable over links) and kept (id = component_id).

    Two documents are linked if 100 * shared shingles >= percent * all their shingles. Texts without words, null or
    empty, are linked with nothing; a null id is linked with nothing, has no component and is kept; rows that share an
    id are judged each by its own text, and component_id is the least id of all rows reachable; an empty table gives an
    empty one; extra columns aren't read. Any length is taken whole.
    """
    return judged(docs, size, percent, id_col, text_col).select(F.col("id").alias(id_col), "n_shingles", "component_id", "kept")


def keep_one(docs: DataFrame, size: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns of any names, less those whose component has a smaller id; cases as in near_duplicates."""
    key, mark = fresh(docs, "key", "mark")
    gone = judged(docs, size, percent, id_col, text_col).filter(~F.col("kept")).select(F.col("id").alias(key), F.col("mark").alias(mark)).distinct()
    return docs.join(materialize(gone, "gone").hint("merge"), (F.col(id_col) == F.col(key)) & (F.xxhash64(text_col) == F.col(mark)), "left_anti")
