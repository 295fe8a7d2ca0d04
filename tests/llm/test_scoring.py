import math
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pyarrow as pa

from folioscan.llm import attention
from folioscan.llm.hashing import coded
from folioscan.llm.scoring import BATCH, Subwords, gathered, score_documents, steps_for

RANKS = P.path("byte_bpe_50k.tiktoken")


def words_of(text):
    return (text or "").encode("utf-8", "replace").lower().split()


def model(seed=0, ids=20):
    rng = np.random.default_rng(seed)
    pairs = rng.integers(0, 50, (ids, ids)).astype(float) + 5 * np.eye(ids, k=1)
    w = attention.fresh(ids)
    w["U"] = rng.normal(0, 0.3, w["U"].shape).astype(np.float32)
    return w, attention.PairModel(pairs), rng


def test_gradients_match_differences():
    w, pair, rng = model()
    ids = rng.integers(0, 20, (3, attention.WIDTH))
    target = rng.integers(0, attention.CLASSES, ids.shape)
    weight = np.ones(ids.shape, np.float32)
    grad, _ = attention.gradients(w, pair, ids, target, weight)
    exact = {k: v.astype(np.float64) for k, v in w.items()}
    for k, v in exact.items():
        at = tuple(rng.integers(0, n) for n in v.shape)
        losses = []
        for d in (1e-4, -1e-4):
            moved = exact | {k: v.copy()}
            moved[k][at] += d
            losses.append(attention.gradients(moved, pair, ids, target, weight)[1])
        assert abs((losses[0] - losses[1]) / 2e-4 - grad[k][at]) < 2e-3, k


def test_model_is_causal_and_normalised():
    w, pair, rng = model()
    ids = rng.integers(0, 20, (2, attention.WIDTH))
    y = attention.class_logs(w, pair, ids)
    other = ids.copy()
    other[:, 20:] = 3
    assert np.allclose(attention.class_logs(w, pair, other)[:, :20], y[:, :20], atol=1e-5)
    full = np.exp(y[:, :, pair.own] + pair.within[ids])
    assert np.allclose(full.sum(axis=2), 1, atol=1e-3)


def test_windows_score_every_id_once():
    w, pair, rng = model()
    texts = [rng.integers(0, 19, n) for n in (0, 1, 31, 32, 33, 55, 56, 57, 200)]
    got = attention.score(w, pair, texts, 19)
    want = []
    for t in texts:
        x = np.concatenate(([19], t, [19]))
        for k in range(len(x) - 1):
            start = 0 if k < attention.WIDTH else ((k - attention.OVERLAP) // (attention.WIDTH - attention.OVERLAP)) * (attention.WIDTH - attention.OVERLAP)
            ids = np.zeros((1, attention.WIDTH), np.int64)
            seen = x[start : k + 1]
            ids[0, : len(seen)] = seen
            y = attention.class_logs(w, pair, ids)[0, len(seen) - 1]
            want.append(y[pair.own[x[k + 1]]] + pair.within[x[k], x[k + 1]])
    assert np.allclose(got, want, atol=1e-3)


def test_training_learns_what_pairs_cannot():
    rng = np.random.default_rng(3)
    rows = np.array([np.tile(rng.permutation(20)[:6], 6)[: attention.WIDTH + 1] for _ in range(400)])
    pairs = np.zeros((20, 20))
    np.add.at(pairs, (rows[:, :-1].ravel(), rows[:, 1:].ravel()), 1)
    pair = attention.PairModel(pairs)
    start = attention.fresh(20)
    learned = attention.train(start, pair, rows[:300], 300)
    loss = lambda w: attention.gradients(w, pair, rows[300:, :-1], pair.own[rows[300:, 1:]], np.ones((100, attention.WIDTH), np.float32))[1]
    assert loss(learned) < loss(start) - 0.3


def test_training_takes_every_window(spark, monkeypatch):
    rng = np.random.default_rng(4)
    texts = [" ".join(rng.choice(["ab", "cat", "the", "né"], n)) for n in (0, 1, 60, 700, 3000)]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(2)
    got = Counter(bytes(r.item) for r in gathered(docs, RANKS, 300, "text").filter("kind = 2").collect())
    own, want = Subwords(RANKS, 300), Counter()
    for t in texts:
        x = np.concatenate(([300], own(words_of(t)), [300])).astype("<i2")
        want.update(x[f : f + attention.WIDTH + 1].tobytes() for f in range(0, len(x) - 1, attention.WIDTH))
    assert got == want

    met = Counter()
    real = attention.gradients
    monkeypatch.setattr(attention, "gradients", lambda w, pair, ids, *rest: met.update(ids[:, 0].tolist()) or real(w, pair, ids, *rest))
    w, pair, rng = model(ids=1500)
    windows = rng.integers(0, 1500, (1500, attention.WIDTH + 1)).astype(np.int16)
    windows[:, 0] = np.arange(1500)
    attention.train(w, pair, windows, -(-1500 // BATCH), BATCH)
    assert met == Counter(range(1500))
    assert all(steps_for(n) * BATCH >= n for n in (1, 127, 128, 129, 5000, 120_000, 179_999, 10**6))


def base(rows):
    c = Counter()
    for i, t in rows:
        if i is None or zlib.crc32(str(i).encode()) % 10:
            c.update([*words_of(t), b""])
    n, v = sum(c.values()), len(c)
    out = Counter()
    for i, t in rows:
        own = [*words_of(t), b""]
        out[i, i is not None and zlib.crc32(str(i).encode()) % 10 == 0, len(own), sum(c[x] > 0 for x in own), n, round(sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in own), 6)] += 1
    return out


def test_base_scores_equal_brute_force_and_cases_are_defined(spark):
    rows = [(i, f"The {w} cat é {w * 3}\n{'x' * (i % 7)} sat " * (i % 5)) for i, w in enumerate(("ab", "Cd", "e,f", "漢字") * 40)] + [(900, None), (901, ""), (None, "the cat"), (3, "again"), (3, "again"), (902, "z" * 60000)]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n long, item string").repartition(4)
    for head in (5, 100_000):
        got = score_documents(docs, RANKS, subword_ids=300, head=head).collect()
        assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == base(rows)
        assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    assert score_documents(docs.limit(0), RANKS, subword_ids=300).collect() == []


def test_scores_do_not_depend_on_a_words_rank(spark):
    rng = np.random.default_rng(8)
    rows = [(i, " ".join(f"w{k}" for k in rng.zipf(1.3, int(rng.integers(0, 60))) % 500)) for i in range(120)] + [(500, None), (501, "never met " * 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    few, all_ = ({r.doc_id: r for r in score_documents(docs, RANKS, subword_ids=300, head=n).collect()} for n in (2, 100_000))
    assert few.keys() == all_.keys()
    for i, r in few.items():
        assert abs(r.attention_score - all_[i].attention_score) < 1e-3
        assert abs(r.score - all_[i].score) < 1e-3


def test_held_out_texts_on_a_table(spark):
    """One held-out word in eight is unknown here; the base gives each of them the share of a single type, which isn't a probability."""
    from folioscan.llm.queries import op3_attention_scores

    sf = "/root/testdata/sf0.01"
    got = op3_attention_scores(spark, sf).collect()
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == base(rows)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.attention_score for r in held)
    assert sum(r.score for r in held) > 1.04 * sum(r.base_score for r in held)


def test_subwords_are_a_prefix_of_the_vocabulary():
    own = Subwords(RANKS, 300)
    assert own(words_of("Hello thé")).max() < 300


def test_words_are_encoded_together_as_each_alone():
    import tiktoken

    own = Subwords(RANKS, 2048)
    words = [*dict.fromkeys(words_of("The cat's thé 漢字  x a\u0085b \x1c \x00 é é it''s 12345 <|endoftext|> " + "z" * 3000 + " naïve the"))]
    ranks = {k: v for k, v in own.own._mergeable_ranks.items()}
    alone = tiktoken.Encoding("alone", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
    words.append(b"caf\xff\xe9")
    want = [np.array(alone.encode_ordinary(" " + w.decode("utf-8", "replace")), "<u2").tobytes() for w in words]
    assert own.many(words) == want == own.many(words[::-1])[::-1] == [own.words[w] for w in words]
    assert own.many([]) == []


def test_words_of_several_chunks_of_texts_are_coded_together():
    """Distinct words are looked up once in some megabytes of texts; what is coded is what bytes.split() finds."""
    rng = np.random.default_rng(5)
    signs = ["", " ", "\t\n", "\x0b", "\x0c\r", "\x1c", "\u0085", "\u00a0", "A", "É", "漢", "\x00", "zz", " b "]
    texts = ["".join(rng.choice(signs, n)) for n in range(60)] + [None, "", " ", "The cat " * 200_000]
    for own in (pa.array(texts, pa.string()), pa.array([*texts, "x"], pa.large_string()).slice(5, 50), pa.array([" "]), pa.array([None], pa.string())):
        (c,) = coded(own, 1 << 22)
        assert len(set(c.words)) == len(c.words) and b"" not in c.words
        said = [*c.words, None]
        assert [[said[k] for k in c.code[a:e]] for a, e in zip(c.offsets, c.offsets[1:], strict=False)] == [[*words_of(t), None] for t in own.to_pylist()]
    assert list(coded(pa.array([], pa.string()), 1 << 22)) == []
    parts = list(coded(pa.array(["ab " * 500_000] * 7), 1 << 22))
    assert [(c.first, c.rows, len(c.code)) for c in parts] == [(0, 2, 1_000_002), (2, 2, 1_000_002), (4, 2, 1_000_002), (6, 1, 500_001)]


def test_extreme_logits_stay_exact():
    """Where exp would leave the range of floats, rows are set against their largest; elsewhere both ways agree."""
    w, pair, rng = model()
    ids = rng.integers(0, 20, (3, attention.WIDTH))
    for k in (1, 300):
        big = w | {"Q": w["Q"] * k, "U": w["U"] * k}
        y = attention.class_logs(big, pair, ids)
        assert np.isfinite(y).all() and np.allclose(np.exp(y).sum(axis=2), 1, atol=1e-3)
        target = rng.integers(0, 20, ids.shape)
        group = pair.own[target]
        logs = attention.target_logs(big, attention.tables(big), pair, ids, target, 0)
        n, t = np.indices(ids.shape)
        assert np.allclose(logs, y[n, t, group] + pair.within[ids, target], rtol=1e-3, atol=1e-3)
        grad, loss = attention.gradients(big, pair, ids, group, np.ones(ids.shape, np.float32))
        assert abs(loss + y[n, t, group].mean()) < 1e-3 * max(1, abs(loss)) and all(np.isfinite(g).all() for g in grad.values())


def test_folded_matrices_equal_the_four():
    w, pair, _ = model()
    made = attention.tables(w)
    assert made[0].shape == (20, 3 * attention.DIM) and attention.folded(w).shape == (attention.DIM, 2 * attention.DIM)
    x = w["E"] + w["P"][0]
    scale = attention.DIM**-0.5
    assert np.allclose((x @ attention.folded(w)[:, : attention.DIM]) @ x.T, (x @ w["Q"] * scale) @ (x @ w["K"]).T, atol=1e-4)
    assert np.allclose((made[0] + made[1][0])[:, 2 * attention.DIM :], x @ w["V"] @ w["O"], atol=1e-4)
