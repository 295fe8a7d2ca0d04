"""Language-model scores of documents beside a unigram base score.

One pass over the training documents writes word counts, counts of subword pairs and training windows. Word counts are
summed by word; the most frequent ones, a bounded number, go to every worker, and words beyond them are looked up by a
join, where their part of both scores is made. Windows are dealt out to trainers whose number grows with the corpus;
their weights are averaged. A second pass over all documents scores them.
"""

from __future__ import annotations

import base64
import math
import pickle
import uuid
import zlib
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import attention
from .common import BoundedCache, crc32_of_id, discard, materialize
from .hashing import Coded, coded, places

#: Subword ids (the first ranks of the vocabulary, which are a vocabulary of their own), and word counts that every worker holds.
SUBWORDS, HEAD = 2048, 262_144
#: Windows of one trainer, windows of a step, and steps that a trainer of fewer windows takes at most, over and over them.
WINDOWS, BATCH, STEPS = 120_000, 128, 1000
#: Distinct words that a worker gathers before it hands them on, and pairs of ids that are counted at once.
FLUSH, PAIRS = 200_000, 1_000_000
#: Bytes of texts whose words are coded together, where words are counted and where texts are scored, which takes more memory.
COUNTED, SCORED = 1 << 21, 1 << 20
#: Weight of a word's own share in the score, next to the attention model's; the log of words without a count at hand.
SHARE, UNSEEN = 0.5, -1e9


class Subwords:
    """Ids of lower-cased words, each with a blank before it, as little-endian unsigned 16-bit bytes."""

    def __init__(self, path: str, size: int):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        ranks = {k: v for k, v in ranks.items() if v < size}
        # A word has no blank inside, so texts of words are parted into the words again, each with the blank before it.
        self.own = tiktoken.Encoding("prefix", pat_str=r"\x20[^\x20]*", mergeable_ranks=ranks, special_tokens={})
        # Ids that open a word.
        self.opens = np.zeros(size, bool)
        self.opens[[v for k, v in ranks.items() if k.startswith(b" ")]] = True
        self.words: dict[bytes, bytes] = BoundedCache(lambda w: self.fresh([w])[0], cap=250_000)

    def fresh(self, words: list[bytes]) -> list[bytes]:
        """Ids of some words, encoded together and parted where an id begins with a blank, as there is none inside a word."""
        text = b"".join([b" " + w for w in words])
        try:
            text = text.decode()
        except UnicodeDecodeError:
            words = [w.decode("utf-8", "replace").encode() for w in words]
            text = b"".join([b" " + w for w in words]).decode()
        found = np.array(self.own.encode_ordinary(text), "<u2")
        at = (2 * np.flatnonzero(self.opens[found])).tolist()
        data = found.tobytes()
        return [data[a:e] for a, e in zip(at, [*at[1:], len(data)], strict=True)]

    def many(self, words: list[bytes]) -> list[bytes]:
        """Ids of each of some distinct words: those at hand looked up, the others met together."""
        out = list(map(self.words.get, words))
        lacking = [k for k, x in enumerate(out) if x is None]
        if lacking:
            new = [words[k] for k in lacking]
            room = self.words.cap - len(self.words)
            for k, w, x in zip(lacking, new, self.fresh(new), strict=True):
                out[k] = x
                if room > 0 and len(w) <= self.words.max_key:
                    self.words[w] = x
                    room -= 1
        return out

    def __call__(self, words: list[bytes]) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.words.__getitem__, words)), "<u2").astype(np.int64)


class Known:
    """The log10 of the share of each word that every worker holds, and the model's weights; one for each run."""

    last: tuple[str, Known] | None = None

    def __init__(self, model: bytes):
        self.log, self.weights = pickle.loads(model)

    @classmethod
    def of(cls, run: str, model) -> Known:
        if cls.last is None or cls.last[0] != run:
            cls.last = None
            cls.last = run, cls(model.value)
        return cls.last[1]


class Stream(NamedTuple):
    """Ids of all texts one after another, an end before the first and behind each; places of the ends; each word's number of ids, an end's is 1."""

    ids: np.ndarray
    ends: np.ndarray
    sizes: np.ndarray


def stream_of(c: Coded, ids: list[bytes], end: int) -> Stream:
    """ids: those of each distinct word, little-endian unsigned 16-bit."""
    flat = np.frombuffer(b"".join([*ids, np.array([end], "<u2").tobytes()]), "<u2").astype(np.int64)
    size = np.array([len(x) >> 1 for x in ids] + [1])
    sizes = size[c.code]
    behind = np.cumsum(sizes)
    # What leads from a place in the stream to that in flat, for each word.
    at = np.repeat((np.cumsum(size) - size)[c.code] - behind + sizes, sizes)
    at += np.arange(len(at))
    ends = behind[c.offsets[1:] - 1]
    return Stream(np.concatenate(([end], flat[at])), np.concatenate(([0], ends)), sizes)


@cache
def subwords(path: str, size: int) -> Subwords:
    return Subwords(path, size)


def gathered(train: DataFrame, path: str, size: int, text_col: str) -> DataFrame:
    """(kind, item, code, n): 0 counts of a word (empty: the end), 1 counts of a pair of ids, 2 training windows.

    Training windows stand side by side, so that every id is a target once.
    """
    ids = size + 1
    names = ["kind", "item", "code", "n"]

    def run(batches):
        encode, end = subwords(path, size), size
        words, pairs = {}, np.zeros(ids * ids, np.int64)
        codes, held, met = [], 0, words.get

        def counts():
            yield pa.RecordBatch.from_arrays([pa.array([0] * len(words), pa.int8()), pa.array(list(words), pa.binary()), pa.nulls(len(words), pa.int64()), pa.array(list(words.values()), pa.int64())], names)
            words.clear()

        def count_pairs():
            if codes:
                np.add(pairs, np.bincount(np.concatenate(codes), minlength=len(pairs)), out=pairs)
                codes.clear()

        def windows(s: Stream):
            n = np.diff(s.ends)
            of = -(-n // attention.WIDTH)
            begin = np.repeat(s.ends[:-1], of) + attention.WIDTH * places(of)
            long = np.minimum(attention.WIDTH, np.repeat(s.ends[1:], of) - begin) + 1
            at = np.repeat(begin, long) + places(long)
            edges = np.concatenate(([0], np.cumsum(2 * long))).astype(np.int32)
            item = pa.Array.from_buffers(pa.binary(), len(long), [None, pa.py_buffer(edges), pa.py_buffer(s.ids[at].astype("<i2"))])
            none = pa.nulls(len(long), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(long), 2, np.int8)), item, none, none], names)

        for b in batches:
            for c in coded(b.column(0), COUNTED):
                for word, n in zip([*c.words, b""], np.bincount(c.code, minlength=len(c.words) + 1).tolist(), strict=True):
                    words[word] = met(word, 0) + n
                s = stream_of(c, encode.many(c.words), end)
                codes.append(s.ids[:-1] * ids + s.ids[1:])
                held += len(s.ids)
                if held > PAIRS:
                    count_pairs()
                    held = 0
                yield windows(s)
                if len(words) > FLUSH:
                    yield from counts()
        yield from counts()
        count_pairs()
        seen = np.flatnonzero(pairs)
        yield pa.RecordBatch.from_arrays([pa.array([1] * len(seen), pa.int8()), pa.nulls(len(seen), pa.binary()), pa.array(seen), pa.array(pairs[seen])], names)

    return train.select(text_col).mapInArrow(run, "kind tinyint, item binary, code bigint, n bigint")


def steps_for(n: int) -> int:
    """Steps of a trainer of n windows: enough to see each at least once."""
    return max(-(-n // BATCH), min(STEPS, 200 + n // 8))


def trained(windows: DataFrame, n: int, shared, size: int) -> dict[str, np.ndarray]:
    """Weights averaged over trainers, each of which has about WINDOWS windows; one row a trainer and weight is summed."""
    trainers = max(1, round(n / WINDOWS))
    start = attention.fresh(size + 1)

    def run(batches):
        own = [np.full((0, attention.WIDTH + 1), -1, np.int16)]
        for b in batches:
            item = pa.concat_arrays([b.column(0)])
            edges = np.frombuffer(item.buffers()[1], np.int32, len(item) + 1, item.offset * 4)
            flat = np.frombuffer(item.buffers()[2], "<i2", (edges[-1] - edges[0]) // 2, edges[0])
            part = np.full((len(b), attention.WIDTH + 1), -1, np.int16)
            part[np.arange(attention.WIDTH + 1) < (np.diff(edges) // 2)[:, None]] = flat
            own.append(part)
        own = np.concatenate(own)
        if len(own):
            w = attention.train(start, shared.value, own, steps_for(len(own)), BATCH)
            flat = np.concatenate([v.ravel() for v in w.values()]).astype(np.float64)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat * len(own)), pa.array([len(own)] * len(flat), pa.int64())], ["k", "v", "n"])

    parts = windows.repartition(trainers).mapInArrow(run, "k bigint, v double, n bigint")
    rows = parts.groupBy("k").agg((F.sum("v") / F.sum("n")).alias("v")).toPandas()
    flat = np.zeros(sum(v.size for v in start.values()))
    if not len(rows):
        return start
    flat[rows["k"].to_numpy()] = rows["v"].to_numpy()
    out, at = {}, 0
    for k, v in start.items():
        out[k] = flat[at : at + v.size].reshape(v.shape).astype(np.float32)
        at += v.size
    return out


def score_documents(docs: DataFrame, ranks_path: str, subword_ids: int = SUBWORDS, head: int = HEAD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, held_out, n_tokens, n_known, train_tokens, base_score, score and attention_score.

    Rows whose crc32 of the id's decimal text is 0 modulo 10 are held out; counts and model learn from all others.
    attention_score is the log10 probability of the whole lower-cased text by the attention model alone. In score, each
    word's probability is the mean of the attention model's, given all before it in its window, and of the word's own
    share among training tokens, 0 for an unknown word; that stays a probability. head is the number of words whose
    counts every worker holds; no result depends on it. A null or empty
    text is its end alone; a null id is neither held out nor left out of training; rows that repeat each count; without
    training rows every word is unknown; an empty table gives an empty one; extra columns aren't read.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    held = F.coalesce(crc32_of_id(F.col(id_col)) % 10 == 0, F.lit(False))
    found = materialize(gathered(docs.filter(~held), ranks_path, subword_ids, text_col), "gathered")
    counts = materialize(found.filter("kind = 0").groupBy("item").agg(F.sum("n").alias("c")), "counts")
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    ids = subword_ids + 1
    # At most ids * ids rows and head rows come to the driver.
    rows = found.filter("kind = 1").groupBy("code").agg(F.sum("n").cast("float").alias("n")).select(F.col("code").cast("int").alias("code"), "n").toArrow()
    pairs = np.zeros(ids * ids, np.float32)
    pairs[rows["code"].to_numpy()] = rows["n"].to_numpy()
    del rows
    shared = spark.sparkContext.broadcast(attention.PairModel(pairs.reshape(ids, ids)))
    del pairs
    windows = found.filter("kind = 2").select("item")
    weights = trained(windows, windows.count(), shared, subword_ids)
    discard(found)
    bottom = n + 0.1 * (v + 1)
    known = {}
    for b in counts.orderBy(F.col("c").desc(), "item").limit(head).toArrow().to_batches(max_chunksize=20_000):
        known.update(zip(b.column(0).to_pylist(), (math.log10((c + 0.1) / bottom) for c in b.column(1).to_pylist()), strict=True))
    model = spark.sparkContext.broadcast(pickle.dumps((known, weights)))
    del known
    run_id = uuid.uuid4().hex

    def score(c: Coded) -> dict:
        own = Known.of(run_id, model)
        s = stream_of(c, subwords(ranks_path, subword_ids).many(c.words), subword_ids)
        logs = attention.score_stream(own.weights, shared.value, s.ids, s.ends)
        context = np.add.reduceat(logs, np.cumsum(s.sizes) - s.sizes)
        alone = np.array([own.log.get(w, UNSEEN) for w in [*c.words, b""]])[c.code]
        met = alone > UNSEEN
        both = np.logaddexp(context + math.log(1 - SHARE), alone * math.log(10) + math.log(SHARE)) / math.log(10)
        n = np.diff(c.offsets)
        text = np.repeat(np.arange(c.rows), n)
        total = lambda x: np.bincount(text, x, c.rows)
        # Words beyond those at hand, by row and word: each with the logs of all its places.
        far = np.flatnonzero(~met)
        far = far[np.lexsort((c.code[far], text[far]))]
        first = np.flatnonzero(np.diff(text[far], prepend=-1) | np.diff(c.code[far], prepend=-1))
        said = [*c.words, b""]
        item = pa.array([said[k] for k in c.code[far[first]].tolist()], pa.binary())
        each = pa.ListArray.from_arrays(pa.array(np.append(first, len(far)).astype(np.int32)), pa.array(context[far]))
        rest = pa.StructArray.from_arrays([item, each], ["item", "logs"])
        edges = np.searchsorted(text[far[first]], np.arange(c.rows + 1)).astype(np.int32)
        return {
            "n_tokens": n, "seen": total(met).astype(np.int64), "base": total(np.where(met, alone, 0.0)), "score": total(np.where(met, both, 0.0)), "attention_score": total(context) / math.log(10),
            "rest": pa.ListArray.from_arrays(pa.array(edges), rest),
        }

    def run(batches):
        row = TaskContext.get().partitionId() << 40
        kinds = {"n_tokens": pa.int64(), "seen": pa.int64(), "base": pa.float64(), "score": pa.float64(), "attention_score": pa.float64(), "rest": pa.list_(pa.struct([("item", pa.binary()), ("logs", pa.list_(pa.float64()))]))}
        for b in batches:
            for c in coded(b.column(2), SCORED):
                got = score(c)
                columns = [pa.array(range(row, row + c.rows), pa.int64()), *(b.column(k).slice(c.first, c.rows) for k in (0, 1)), *(got[k] if isinstance(got[k], pa.Array) else pa.array(got[k], t) for k, t in kinds.items())]
                yield pa.RecordBatch.from_arrays(columns, ["row", "id", "held_out", *kinds])
                row += c.rows

    every = docs.select(F.col(id_col).alias("id"), held.alias("held_out"), F.col(text_col).alias("text"))
    scored = every.mapInArrow(run, f"row bigint, id {kind}, held_out boolean, n_tokens bigint, seen bigint, base double, score double, attention_score double, rest array<struct<item:binary,logs:array<double>>>")
    scored = materialize(scored, "scored")
    far = scored.select("row", F.explode("rest").alias("r")).select("row", "r.item", "r.logs").join(counts, "item", "left")
    c, m = F.coalesce("c", F.lit(0)), F.size("logs").cast("long")
    log = F.log10((c + 0.1) / F.lit(float(bottom)))

    def mixed(context):
        """log10 of the mean of a word's context probability and its share; an unknown word's share is 0."""
        a, b = context + math.log(1 - SHARE), log * math.log(10) + math.log(SHARE)
        return F.when(c > 0, F.greatest(a, b) + F.log1p(F.exp(-F.abs(a - b)))).otherwise(a) / math.log(10)

    both = F.aggregate("logs", F.lit(0.0), lambda so_far, context: so_far + mixed(context))
    sums = far.select("row", F.when(c > 0, m).otherwise(0).alias("more"), (m * log).alias("below"), both.alias("both"))
    sums = sums.groupBy("row").agg(*(F.sum(k).alias(k) for k in ("more", "below", "both")))
    joined = scored.drop("rest").join(materialize(sums, "sums"), "row", "left")
    zero = lambda x: F.coalesce(x, F.lit(0))
    return joined.select(F.col("id").alias(id_col), "held_out", "n_tokens", (F.col("seen") + zero("more")).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), (F.col("base") + zero("below")).alias("base_score"), (F.col("score") + zero("both")).alias("score"), "attention_score")
