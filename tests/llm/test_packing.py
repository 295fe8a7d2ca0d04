import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

from folioscan.llm.packing import Places, WordTokens, configuration, most_valuable, pack, program

WORDS = P.path("word_bpe_49k.json")


def test_tokens_match_library():
    own, library = WordTokens(WORDS), Tokenizer.from_file(WORDS)
    rng = random.Random(3)
    pool = list("abC deTH's  \n\t\r\x0b\x0c\x1c\x85\xa0.,;#019éÉÜß漢ñ😀́ΣİA") + ["<|endoftext|>", "<|startoftext|>", " the", "'LL"]
    for _ in range(2000):
        t = "".join(rng.choices(pool, k=rng.randint(0, 40)))
        assert np.frombuffer(own(t), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)


def test_words_encoded_together_match_words_alone():
    own, library = WordTokens(WORDS), Tokenizer.from_file(WORDS)
    rng = random.Random(5)
    pool = list("abC deTH's\x1c\x85\xa0.,;#019éÉÜß漢ñ😀́ΣİA\u200d\u3000\ufb01") + [" the", "'LL", "ing", "\ufffd"]
    texts = ["".join(rng.choices(pool, k=rng.randint(1, 12))) for _ in range(5000)]
    words = list(dict.fromkeys(w for t in texts for w in t.encode().lower().split()))
    for part in (words[:300], words[300:301], words):
        got = own.many(part)
        for w in part:
            assert np.frombuffer(got[w], "<u4").tolist() == library.encode(w.decode("utf-8", "replace"), add_special_tokens=False).ids, w
    own.words.cap = 500
    texts += ["".join(rng.choices([*pool, " ", "\n", "<|endoftext|>"], k=rng.randint(0, 40))) for _ in range(2000)] + [None, ""]
    for t, got in zip(texts, own.each(texts), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == library.encode(t or "", add_special_tokens=False).ids, repr(t)
    assert len(own.words) <= 500


def test_plan_uses_each_piece_once_and_is_near_the_bound():
    rng = random.Random(1)
    for sizes in ([min(4096, int(rng.lognormvariate(6, 1)) + 1) for _ in range(20000)], [1400] * 1000, [4096] * 7 + [2049] * 9, [1] * 5000, [3000, 1000, 96] * 50, []):
        h = Counter(sizes)
        plan, fractional, bound = program(h, 4096)
        used = Counter()
        for times, content in plan:
            assert sum(n * size for size, n in content) <= 4096
            for size, n in content:
                used[size] += times * n
        assert used == h
        sequences = Places(plan).sequences
        assert sum(sizes) / 4096 <= bound + 1e-6 and bound <= fractional + 1e-6 and bound <= sequences + 1e-6
        assert sequences <= fractional + len(plan)
        if len(h) > 100:
            assert sequences <= bound * 1.003 + 2
    exact = program(Counter([1400] * 1000), 4096)
    assert Places(exact.plan).sequences == 500 and abs(exact.bound - 500) < 1e-6 and abs(exact.fractional - 500) < 1e-6


def test_pricing_equals_enumeration():
    rng = random.Random(2)

    def best(items, room):
        return max([0.0, *(p + best(items, room - s) for s, p in items if s <= room)])

    for _ in range(30):
        sizes = sorted(rng.sample(range(2, 14), rng.randint(1, 5)))
        prices = [rng.random() * s for s in sizes]
        items = list(zip(sizes, prices, strict=True))
        assert abs(most_valuable(np.array(sizes), np.array(prices), 20) - best(items, 20)) < 1e-9
        used = configuration(np.array(sizes), np.full(len(sizes), 20), np.array(prices), 20)
        assert abs(float(used @ np.array(prices)) - best(items, 20)) < 1e-9 and int(used @ np.array(sizes)) <= 20


def check(rows, texts):
    library = Tokenizer.from_file(WORDS)
    by = defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for content in sequences.values():
        at = 0
        for offset, length in sorted(content):
            assert offset == at
            at += length
        assert at <= 4096
    assert set(by) == set(texts)
    for i, t in texts.items():
        ids = library.encode(t or "", add_special_tokens=False).ids + [1]
        at = 0
        for k, r in enumerate(sorted(by[i], key=lambda r: r.piece)):
            assert (r.piece, r.start, r.length) == (k, at, min(4096, len(ids) - at))
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    return len(sequences)


def test_pack_operator(spark):
    rows = [(1, "a b c", "x"), (2, None, None), (3, "", "x"), (4, "word " * 9000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length string")
    got = pack(docs, WORDS, with_ids=True).collect()
    check(got, {r[0]: r[1] for r in rows})
    assert all(zlib.crc32(bytes(r.ids)) == r.ids_crc32 for r in got)
    assert pack(docs.limit(0), WORDS).collect() == []
    assert len(pack(docs.union(docs), WORDS).collect()) == 2 * len(got)


def test_query_on_a_table(spark):
    from folioscan.llm.queries import op4_best_fit_packing

    sf = "/root/testdata/sf0.001"
    got = op4_best_fit_packing(spark, sf).collect()
    n = check(got, {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()})
    assert n <= -(-sum(r.length for r in got) // 4096) + 2
