import random
import re
from collections import defaultdict
from hashlib import sha256

import numpy as np
import pyarrow as pa

from folioscan.llm import hashing
from folioscan.llm.components import components
from folioscan.llm.minhash import bitmap, hopeful, keep_one, near_duplicates, sketch
from folioscan.llm.substrings import digests, late_windows, remove_repeats

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fold(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def shingles(text):
    w = WORD.findall(fold(text))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set()


def brute_components(rows):
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    by = defaultdict(set)
    for i, s in sets.items():
        for x in s:
            by[x].add(i)
    seen = {(a, b) for ids in by.values() for a in ids for b in ids if a < b}
    for a, b in seen:
        n = len(sets[a] & sets[b])
        if 100 * n >= 75 * len(sets[a] | sets[b]):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {i: (len(s), root(i)) for i, s in sets.items()}


def brute_repeats(rows, size=13):
    first = {}
    words = {i: WORD.findall(t or "") for i, t in rows}
    for i in sorted(words):
        w = words[i]
        for k in range(len(w) - size + 1):
            first.setdefault(tuple(w[k : k + size]), i)
    out = {}
    for i, w in words.items():
        gone = {k + j for k in range(len(w) - size + 1) if first[tuple(w[k : k + size])] < i for j in range(size)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out[i] = (len(w), len(gone), sha256(kept.encode()).hexdigest())
    return out


def corpus(seed=3):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdeé", k=rng.randint(1, 6))) for _ in range(900)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passages = [text(60), text(25), text(13), text(12)]
    rows = []
    for i in range(150):
        w = text(rng.randint(0, 120))
        for p in passages:
            if rng.random() < 0.4:
                at = rng.randint(0, len(w))
                w[at:at] = p
        rows.append(w)
    for i in range(150):
        w = list(rng.choice(rows[:40]))
        for _ in range(rng.choice((0, 0, 1, 2, 5))):
            if w:
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
        rows.append(w)
    base = text(200)
    for i in range(60):
        w = list(base)
        w[3 * i] = f"new{i}"
        rows.append(w)
    rng.shuffle(rows)
    made = [(7 * i + 1, rng.choice((" ", "\n", " \t")).join(w)) for i, w in enumerate(rows)]
    made += [(5000, None), (5001, ""), (5002, "  \n"), (5003, "One two"), (5004, "one TWO"), (5005, "b a " * 8000), (5006, "É é É é x"), (5007, "é é é é x")]
    return made


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, n string").repartition(7)


def test_sketch_estimates_similarity_and_fills():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2**63, 6000).astype(np.uint64)
    for size in (1, 2, 7, 100, 2000):
        a, b = x[: 2 * size], x[size : 3 * size]
        agree = np.mean([np.mean(sketch(a + np.uint64(k), 384) == sketch(b + np.uint64(k), 384)) for k in range(5)])
        assert abs(agree - 1 / 3) < 0.12
        assert (sketch(a, 384) == sketch(a[::-1].copy(), 384)).all()


def test_bitmaps_never_rule_out_a_link(spark):
    rng = np.random.default_rng(7)
    rows = []

    def pair(each, own):
        x = rng.integers(0, 2**63, each + own, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, each + own, dtype=np.uint64)
        return x[own:], x[:each]

    put = lambda a, b, link: rows.append((bitmap(a).tolist(), bitmap(b).tolist(), len(a), len(b), link))
    for each, own in ((7, 1), (70, 10), (350, 50), (3500, 500), (35000, 5000)):
        for _ in range(40):
            put(*pair(each, own), True)
    for _ in range(40):
        put(*pair(160, 40), False)
    frame = spark.createDataFrame(rows, "a array<bigint>, b array<bigint>, n bigint, m bigint, link boolean")
    got = frame.select("link", hopeful(*(frame[c] for c in "abnm"), 75).alias("fine")).collect()
    assert all(r.fine for r in got if r.link) and not any(r.fine for r in got if not r.link)


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(500, 560)] + [(900, k) for k in range(901, 990)] + [(3, 3), (None, 4)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    nodes = {x for a, b in edges for x in (a, b) if a is not None and a != b}
    label = {x: x for x in nodes}
    for _ in range(len(nodes)):
        for a, b in edges:
            if a is not None and a != b:
                label[a] = label[b] = min(label[a], label[b])
    assert got == label
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_near_duplicates_equal_brute_force(spark):
    rows = corpus()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(frame(spark, rows)).collect()}
    assert got == brute_components(rows)
    docs = frame(spark, rows[:50] + rows[:5] + [(None, rows[0][1]), (None, None)])
    out = near_duplicates(docs).collect()
    assert len(out) == 57 and all(r.kept for r in out if r.doc_id is None)
    kept = keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in out)
    assert near_duplicates(docs.limit(0)).collect() == []


def test_groups_around_the_threshold_lose_no_link(spark):
    """Copies of one template with similarities from 0.6 to 0.9, and of another with a fresh part each, far from linked."""
    rng = random.Random(12)
    word = lambda: f"v{rng.randrange(10**9)}"
    rows = []
    for length, least, most, n in ((60, 1, 4, 150), (300, 4, 16, 80), (120, 20, 24, 80)):
        base = [word() for _ in range(length)]
        for _ in range(n):
            w = list(base)
            for _ in range(rng.randint(least, most)):
                w[rng.randrange(length)] = word()
            rows.append((len(rows), " ".join(w)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(frame(spark, rows)).collect()}
    want = brute_components(rows)
    assert got == want and 20 < len({c for _, c in want.values()}) < 300


def test_rows_that_share_an_id_are_judged_by_their_own_text(spark):
    words = lambda c, n: " ".join(f"{c}{k}" for k in range(n))
    rows = [(1, words("a", 40)), (5, words("b", 30)), (5, words("a", 40) + " x"), (7, words("b", 30)), (5, words("b", 30))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id) for r in near_duplicates(df).collect()) == [(1, 1), (5, 1), (5, 5), (5, 5), (7, 5)]
    assert sorted(tuple(r) for r in keep_one(df).collect()) == sorted([rows[0], rows[1], rows[4]])


def test_repeats_equal_brute_force(spark):
    rows = corpus(9)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in digests(frame(spark, rows)).collect()}
    assert got == brute_repeats(rows)
    docs = frame(spark, rows[:60] + rows[:3] + [(None, rows[0][1]), (None, None)])
    out = remove_repeats(docs, n_removed="gone").collect()
    assert len(out) == 65
    assert digests(docs.limit(0)).collect() == []
    texts = dict(rows)
    for r in out:
        if not r.gone and r.doc_id is not None:
            assert r.text == texts[r.doc_id]
        if r.doc_id is None:
            assert r.gone == 0
    small = remove_repeats(docs, size=4, anchor=2, n_removed="gone")
    assert {r.doc_id: r.gone for r in small.collect() if r.doc_id is not None} == {i: v[1] for i, v in brute_repeats(rows[:60], 4).items()}


def test_windows_of_a_large_group_are_found_in_one_pass(spark):
    """Near copies that share their edits: windows that the first occurrence lacks, each in many documents."""
    rng = random.Random(21)
    base = [f"b{k}" for k in range(40)]
    rows = []
    for i in range(400):
        w = list(base)
        for _ in range(2):
            w[rng.randrange(40)] = f"e{rng.randrange(4)}"
        rows.append((i, " ".join(w)))
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in digests(frame(spark, rows)).collect()}
    assert got == brute_repeats(rows)
    ends = [(k % 7, k % 3, 1000 - k, k, 5) for k in range(900)] + [(1, 1, 50, 1, 1), (1, 1, 50, 2, 9), (8, 8, 3, 1, 1), (8, 8, 3, 1, 4)]
    out = late_windows(spark.createDataFrame(ends, "w1 long, w2 long, id long, mark long, start int").repartition(5))
    least = {}
    for a, b, i, *_ in ends:
        least[a, b] = min(i, least.get((a, b), i))
    assert sorted(map(tuple, out.collect())) == sorted(e for e in ends if e[2] > least[e[:2]])
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()


def brute_parse(words, earlier, least=13):
    out, at = [], 0
    while at < len(words):
        n = 0
        for w in earlier:
            for s in range(len(w)):
                k = 0
                while at + k < len(words) and s + k < len(w) and w[s + k] == words[at + k]:
                    k += 1
                n = max(n, k)
        if n >= least:
            out.append((at, n))
        at += n if n >= least else 1
    return out


def test_factors_equal_a_greedy_parse(spark):
    rng = random.Random(4)
    count = iter(range(10**6))
    new = lambda n: [f"w{next(count)}" for _ in range(n)]
    words = [new(rng.randint(40, 90)) for _ in range(12)]
    for _ in range(30):
        w = new(3)
        for _ in range(rng.randint(0, 4)):
            one = rng.choice(words[:12])
            a = rng.randrange(len(one) - 13)
            w += one[a : a + rng.randint(8, 60)] + new(rng.randint(1, 5))
        words.append(w)
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(words)], "doc_id long, text string").repartition(6)
    got = {r.doc_id: r.f for r in remove_repeats(docs, factors="f").collect()}
    for i, w in enumerate(words):
        assert [(f.start, f.n) for f in got[i]] == brute_parse(w, words[:i])
        assert all(words[f.ref][f.ref_start : f.ref_start + f.n] == w[f.start : f.start + f.n] for f in got[i])


def test_rows_that_share_an_id_are_cut_for_their_own_words(spark):
    words = lambda c, n: " ".join(f"{c}{k}" for k in range(n))
    rows = [(1, words("a", 40)), (5, words("b", 30)), (5, words("c", 5) + " " + words("a", 20)), (7, words("b", 30) + " x")]
    got = {(r.doc_id, r.text.strip()) for r in remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {rows[0], rows[1], (5, words("c", 5)), (7, "x")}


def test_repeats_leave_columns_of_any_name(spark):
    text = " ".join(map(str, range(20)))
    rows = [(1, text, "a", 3, "k"), (2, f"y {text} z", "b", 4, "l")]
    df = spark.createDataFrame(rows, ["doc_id", "text", "__runs", "__KEY", "a`b.c"])
    got = remove_repeats(df)
    assert got.columns == df.columns and sorted(map(tuple, got.collect())) == [rows[0], (2, "y z", "b", 4, "l")]


def test_words_of_columns_equal_words_of_texts(monkeypatch):
    rng = random.Random(1)
    texts = ["".join(rng.choices("abcAé \n\t\x0b漢", k=rng.randint(0, 60))) for _ in range(800)] + [None, "", " ", "x" * 500 + " yy " + "z" * 64 + " " + "q" * 65, "ab " * 200]
    for chunk in (64, 1 << 12):
        monkeypatch.setattr(hashing, "CHUNK", chunk)
        monkeypatch.setattr(hashing, "_polynomials", [])
        for lower in (False, True):
            seen, met = {}, 0
            for w in hashing.words_of(pa.array(texts, pa.string()), lower, 2, True):
                for k in range(len(w.offsets) - 1):
                    data = (texts[w.first + k] or "").encode()
                    own = range(w.offsets[k], w.offsets[k + 1])
                    said = (data.lower() if lower else data).split()
                    assert [data[w.start[i] : w.end[i]].lower() for i in own] == [x.lower() for x in said]
                    for x, i in zip(said, own, strict=True):
                        assert seen.setdefault(x, (w.hashes[0][i], w.hashes[1][i])) == (w.hashes[0][i], w.hashes[1][i])
                    met += 1
            assert met == len(texts) and all(len({v[s] for v in seen.values()}) == len(seen) for s in (0, 1))


def test_queries_on_a_table(spark):
    from folioscan.llm.queries import op6_fast_similarity_sketch, op9_relative_lempel_ziv

    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in op6_fast_similarity_sketch(spark, sf).collect()} == brute_components(rows)
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in op9_relative_lempel_ziv(spark, sf).collect()} == brute_repeats(rows)
