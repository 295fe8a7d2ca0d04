"""Rules over groups of rows: runs of Arrow rows in place of a frame for each group, and what texts with a match have."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from folioscan.functions import patterns as P
from folioscan.functions.groups import whole_groups
from folioscan.functions.text import NEEDS, dehyphenate, matched, occurrences, stripped
from folioscan.operators import content, layout
from folioscan.sources.papers import SCHEMAS


def test_groups_stay_whole_over_the_edges_of_batches():
    rng = random.Random(1)
    for _ in range(200):
        sizes = [rng.randint(1, 7) for _ in range(rng.randint(0, 9))]
        rows = [(k // 2, k % 2, i) for k, n in enumerate(sizes) for i in range(n)]
        t = pa.table(dict(zip("abi", map(list, zip(*rows, strict=True)) if rows else ([], [], []), strict=True)))
        batches, at = [], 0
        while at < len(t):
            n = rng.randint(0, 6)
            batches += t.slice(at, n).to_batches()
            at += n
        got = [g for part, ends in whole_groups(iter(batches), ["a", "b"]) for a, e in zip(ends, ends[1:], strict=False) for g in [list(zip(*(part.column(c).to_pylist()[a:e] for c in "abi"), strict=True))]]
        want, at = [], 0
        for n in sizes:
            want.append(rows[at : at + n])
            at += n
        assert got == want


def test_pages_are_marked_on_all_cores_and_without_a_frame_each(spark):
    """Small rows with much work: Spark alone would put them into one task, and a frame for each page cost ten times the marks."""
    box = lambda x0, y, x1: {"x0": float(x0), "y0": float(y), "x1": float(x1), "y1": y + 8.0}
    rows = [(p, 1, i, 0, 0, box(72, 60 + 14 * i, 300), "some text that is long enough", 10.0, 0.0) for p in range(40) for i in range(6)]
    rows += [(p, 1, 100 + i, 0, 0, box(20, 60 + 14 * i, 30), str(i + 1), 5.0, 0.0) for p in range(0, 40, 2) for i in range(5)]
    lines = spark.createDataFrame(rows, SCHEMAS["lines"])
    pages = spark.createDataFrame([(p, 1, 0.0, 0.0, 600.0, 800.0, None, 0, 0) for p in range(40)], SCHEMAS["pages"])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        marked = layout.marked_lines(lines, pages)
        got = sorted((r.paper_id, r.block_no) for r in marked.filter("is_review").collect())
        own = spark.createDataFrame([(k, n, "(" * n) for k in range(30) for n in (1, 2)], "paper_id bigint, page_num int, content_text string")
        said = content.bracket_places(own, content.bracket_balance(own))
        places = {r.paper_id: len(r.examples) for r in said.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == [(p, 100 + i) for p in range(0, 40, 2) for i in range(5)]
    assert places == dict.fromkeys(range(30), 3)
    for frame in (marked, said):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "FlatMapGroupsInPandas" not in plan and "REPARTITION_BY_NUM" in plan


def test_what_texts_with_a_match_have(spark):
    """Guards change no result, whatever a text is made of."""
    rng = random.Random(2)
    parts = ["TODO", "fixme", "FİXME", "Fıxme", "XxX", "tbd", "??", "Eq. ?", ",,", ";;", "..", " , ", " ; ", "\n,", "fig. 3", "table 4", "Figure 7", "Fig.2", "Table 12", "a.b@x.org", "ACKNOWLEDGMENTS", "Acknowledgement", "word-", "-\n", "­ \t\n b", " ", "\u0085", " ", "\n", "x", "\U0001f600", ""]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 6))) for _ in range(1500)] + [None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    t = F.col("t")
    whole = lambda p: F.coalesce(F.size(F.regexp_extract_all(t, F.lit(p), F.lit(0))), F.lit(0))
    for p in NEEDS:
        assert df.filter(occurrences(t, p) != whole(p)).isEmpty() and df.filter(~matched(t, p).eqNullSafe(t.rlike(p))).isEmpty()
        assert not df.filter(t.rlike(p)).isEmpty()
    assert df.filter(~stripped(t).eqNullSafe(F.regexp_replace(t, r"(?U)^\s+|\s+$", ""))).isEmpty()
    assert df.filter(~dehyphenate(t).eqNullSafe(F.regexp_replace(t, P.HYPHENATED, ""))).isEmpty()
