import math
import random

import numpy as np
from pyspark.sql import functions as F

from folioscan.llm.topk import SliceBlock, top_k


def brute(rows, asked, k=5):
    fine = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, q in {(i, tuple(q)) for i, q in fine if asked(i)}:
        best = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in fine if j != i)[:k]
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    return sorted(out)


def test_block_equals_brute_force():
    rng = np.random.default_rng(2)
    x = rng.integers(-130, 140, (700, 9))
    x[5:60] = x[5]
    block = SliceBlock(np.arange(700)[::-1].copy(), x)
    for k in (1, 5, 40):
        for q in (x[3], x[5], np.zeros(9, int), -x[7]):
            ids, score = block.top(3, q, k)
            want = sorted(((-int(s), 699 - j) for j, s in enumerate(x @ q) if 699 - j != 3))[:k]
            assert sorted(zip((-score).tolist(), ids.tolist())) == want


def test_operator_with_gaps_ties_and_repeats(spark):
    rng = random.Random(4)
    rows = [(i, [rng.uniform(-0.6, 0.6) for _ in range(8)], "x") for i in range(300)]
    rows += [(400 + i, rows[7][1], None) for i in range(30)] + [(350, None, "x"), (351, [1.0, None] * 4, "x"), (352, [float("nan")] * 8, "x"), (353, [float("inf")] * 8, "x"), (None, [0.5] * 8, "x"), (360, [], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    got = sorted(map(tuple, top_k(df, F.col("id") % 50 == 0).collect()))
    assert got == brute([r[:2] for r in rows], lambda i: i % 50 == 0)
    assert top_k(df.limit(0), F.col("id") % 50 == 0).collect() == []
    assert len(top_k(df.filter("vec_id in (0, 1, 2)"), F.col("id") % 50 == 0).collect()) == 2
    twice = df.filter("vec_id < 40")
    assert len(top_k(twice.union(twice), F.col("id") % 50 == 0).collect()) == 5


def test_query_on_a_table(spark):
    from folioscan.llm.queries import op10_bit_sliced_top_k

    sf = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert sorted(map(tuple, op10_bit_sliced_top_k(spark, sf).collect())) == brute(rows, lambda i: i % 50 == 0)
