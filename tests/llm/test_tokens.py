import base64
import random
from hashlib import sha256

import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from folioscan.llm.bpe import ByteBpe, decode_documents, encode_digests, encode_documents
from folioscan.llm.token_counts import TokenCounter, count_tokens

RANKS, JSON = P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_50k.json")


def texts():
    rng = random.Random(5)
    pool = list("ab cdeTH'st  \n\n\t\r.,;#$%019éüß漢字ñ😀\x1c\x85\xa0 ́|<>") + ["<|endoftext|>", " the", "tion", "   ", "'ll", " \n "]
    made = ["".join(rng.choices(pool, k=rng.randint(0, 60))) for _ in range(1500)]
    return made + ["", " ", "  a", "a  ", "a \n b", "a\n  b", "x" * 3000, "ab" * 5000, "the " * 4000, "éa" * 1500, "<|endoftext|>" * 3, "a<|endoftext|> b", None]


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return Tokenizer.from_file(JSON), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_counts_match_library(library):
    count = TokenCounter(JSON)
    for t in texts():
        assert count(t) == len(library[0].encode(t or "", add_special_tokens=False).ids), repr(t)


def test_ids_match_library_and_round_trip(library):
    own = ByteBpe(RANKS)
    for t in texts():
        ids = own.encode(t)
        assert list(ids) == library[1].encode_ordinary(t or ""), repr(t)
        assert own.decode(ids) == (t or "").encode()


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, id string, n_tokens string")


ROWS = [(1, "the cat", "x", "y"), (2, None, None, None), (3, "", "x", None), (1, "the cat", "x", "y"), (None, "a" * 70000, None, None)]


def test_count_operator_nulls_repeats_and_clashing_columns(spark, library):
    got = sorted(map(tuple, count_tokens(frame(spark, ROWS), JSON).collect()), key=str)
    want = sorted([(i, len((t or "").encode()), n := len(library[0].encode(t or "", add_special_tokens=False).ids), n > 512) for i, t, *_ in ROWS], key=str)
    assert got == want
    assert count_tokens(frame(spark, []), JSON).collect() == []


def test_encode_operators(spark, library):
    docs = frame(spark, ROWS)
    plain = encode_documents(docs, RANKS)
    by = {r.doc_id: r for r in encode_digests(docs, RANKS).collect()}
    for r in plain.collect():
        text = next(t for i, t, *_ in ROWS if i == r.doc_id) or ""
        assert list(r.ids) == library[1].encode_ordinary(text)
        assert by[r.doc_id].ids_sha256 == sha256(" ".join(map(str, r.ids)).encode()).hexdigest()
        assert by[r.doc_id].decoded_sha256 == sha256(text.encode()).hexdigest()
    for r in decode_documents(plain, RANKS).collect():
        assert bytes(r.decoded).decode() == (next(t for i, t, *_ in ROWS if i == r.doc_id) or "")
    assert encode_digests(frame(spark, []), RANKS).collect() == []


def test_queries_equal_library_on_a_table(spark, library):
    from folioscan.llm.queries import op7_token_counts, op8_byte_bpe

    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert {r.doc_id: r.n_tokens for r in op7_token_counts(spark, sf).collect()} == {i: len(library[0].encode(t, add_special_tokens=False).ids) for i, t in docs.items()}
    for r in op8_byte_bpe(spark, sf).collect():
        ids = library[1].encode_ordinary(docs[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == sha256(docs[r.doc_id].encode()).hexdigest()
