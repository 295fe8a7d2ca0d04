import random
import re

import pytest

from folioscan.llm.lines import NEAR, remove_lines


def within(a, b, near):
    if a == b:
        return True
    if min(len(a), len(b)) < near or abs(len(a) - len(b)) > 1:
        return False
    a, b = sorted((a, b), key=len)
    p = next((i for i, x in enumerate(a) if x != b[i]), len(a))
    return a[p + 1 :] == b[p + 1 :] if len(a) == len(b) else a[p:] == b[p + 1 :]


def brute(rows, near=NEAR):
    every = [(i, k, x) for i, t in sorted(rows) if t is not None for k, x in enumerate(t.split("\n"))]
    earlier, gone = [], set()
    for i, k, x in every:
        if re.search(r"[^\x20\x09-\x0D]", x):
            if any(within(x, y, near) for y in earlier):
                gone.add((i, k))
            earlier.append(x)
    return {i: t if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone) for i, t in rows}


def edit(rng, x):
    p = rng.randint(0, len(x))
    return rng.choice((x[:p] + rng.choice("abé漢") + x[p:], x[:p] + x[p + 1 :], x[: max(0, p - 1)] + "z" + x[p:]))


def test_lines_equal_brute_force(spark):
    rng = random.Random(8)
    pool = ["".join(rng.choices("abcé漢 ", k=rng.randint(0, 60))) for _ in range(60)] + ["a" * 30, "ab" * 15, "b" * 16, "", " ", "\t", "short"]
    rows = []
    for i in range(120):
        own = []
        for _ in range(rng.randint(0, 6)):
            x = rng.choice(pool) if rng.random() < 0.5 else "".join(rng.choices("abcdefgh ", k=rng.randint(0, 50)))
            for _ in range(rng.choice((0, 0, 1, 2))):
                x = edit(rng, x)
            own.append(x)
        rows.append((3 * i, "\n".join(own)))
    rows += [(1000, None), (1001, ""), (1002, "\n\n"), (1003, "q" + "xy" * 40000), (1004, "xy" * 20000 + "z" + "xy" * 20000), (1005, "xy" * 40000)]
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, line string, said string").repartition(5)
    got = remove_lines(docs, n_removed="n").collect()
    assert {r.doc_id: r.text for r in got} == brute(rows)
    before = dict(rows)
    assert all(r.n == (before[r.doc_id] or "").count("\n") - r.text.count("\n") for r in got if r.text)
    odd = spark.createDataFrame([(None, rows[0][1]), (None, None), (0, rows[0][1]), (0, rows[0][1])], "doc_id long, text string")
    out = remove_lines(odd).collect()
    assert sorted(str(r.text) for r in out if r.doc_id is None) == sorted([str(rows[0][1]), "None"])
    assert len({r.text for r in out if r.doc_id == 0}) == 1
    assert remove_lines(odd.limit(0)).collect() == []


@pytest.mark.parametrize("near", [1, 4])
def test_short_lines_can_be_near_too(spark, near):
    rng = random.Random(near)
    rows = [(i, "\n".join("".join(rng.choices("abc ", k=rng.randint(0, 7))) for _ in range(3))) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.text for r in remove_lines(docs, near=near).collect()} == brute(rows, near)


def test_rows_that_share_an_id_lose_only_lines_of_their_own(spark):
    rows = [(1, "the very first line of all\nanother"), (5, "unrelated first line of B\nunrelated second line B"), (5, "fifth\nthe very first line of all")]
    got = {r.text for r in remove_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {rows[0][1], rows[1][1], "fifth"}


def test_columns_of_any_name_stay(spark):
    rows = [(1, "one line\ntwo", "a", "b", "c", "d"), (2, "one line", "e", "f", "g", "h")]
    names = ["doc_id", "text", "__lines", "__GONE", "a`b", "x.y"]
    df = spark.createDataFrame(rows, names)
    got = {r[0]: tuple(r) for r in remove_lines(df).select(*(f"`{n.replace('`', '``')}`" for n in names)).collect()}
    assert got == {1: rows[0], 2: (2, "", *rows[1][2:])}
