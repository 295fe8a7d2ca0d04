import random
import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers as P
from test_duplicates import brute_components, brute_repeats
from test_lines import brute as brute_lines
from tokenizers import Tokenizer

from folioscan.llm.quality import judge


def documents(seed=4):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(600)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passage, line = text(60), " ".join(text(8))
    rows = []
    for i in range(120):
        w = text(rng.randint(60, 160))
        if i % 4 == 0:
            w[20:20] = passage
        t = " ".join(w)
        if i % 3 == 0:
            t += "\n" + line + rng.choice(("", "x"))
        rows.append(t)
    rows += [rows[5], rows[5] + " more", rows[6].replace(" ", "%% "), "too short", "", None, " ".join(text(12000))]
    return [(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in enumerate(rows)]


def test_every_stage_equals_brute_force(spark, tmp_path):
    rows = documents()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(100)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    sf, path = str(tmp_path), f"{tmp_path}/documents.parquet"
    stages = dict(corpus_pipeline.STAGES)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = spark.read.parquet(path)
        texts = {r.doc_id: r.text for r in before.collect()}
        stage(spark, before, sf).write.parquet(path := f"{tmp_path}/{k}")
        got = spark.read.parquet(path)
        if name != "best-fit packing":
            assert got.columns == docs.columns
            after = {r.doc_id: r.text for r in got.collect()}
        if name == "quality rules":
            kept = {r.doc_id for r in judge(before, spark.read.parquet(f"{sf}/labels.parquet")).collect() if r.kept}
            assert after == {i: t for i, t in texts.items() if i in kept} and len(after) < len(texts)
        elif name == "line dedup":
            assert after == brute_lines(list(texts.items())) and after != texts
        elif name == "near dedup":
            assert after == {i: texts[i] for i, (_, c) in brute_components(list(texts.items())).items() if i == c} and len(after) < len(texts)
        elif name == "substring dedup":
            want = brute_repeats(list(texts.items()))
            assert {i: len((t or "").split()) for i, t in after.items()} == {i: n - m for i, (n, m, _) in want.items()} and after != texts
    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    pieces = got.collect()
    assert {r.doc_id for r in pieces} == set(after)
    for i, t in after.items():
        ids = library.encode(t or "", add_special_tokens=False).ids + [1]
        own = sorted((r for r in pieces if r.doc_id == i), key=lambda r: r.piece)
        assert [r.ids_crc32 for r in own] == [zlib.crc32(np.array(ids[s : s + 4096], "<u4").tobytes()) for s in range(0, len(ids), 4096)]
    whole = corpus_pipeline.run(spark, sf).collect()
    key = lambda r: (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
    assert sorted(map(key, whole)) == sorted(map(key, pieces))
    assert stages.keys() == {"quality rules", "line dedup", "near dedup", "substring dedup", "best-fit packing"}


def test_stages_take_empty_tables_nulls_and_clashing_columns(spark, tmp_path):
    spark.createDataFrame([(None, None, None), (1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kind = "doc_id long, text string, lang string, source string, n_chars long, id string, line string, key string, n int, runs string, lines string"
    rows = [(None, None, None, None, None, "a", "b", "c", 1, "d", "e"), (1, "word " * 60, None, None, None, None, None, None, None, None, None), (1, "word " * 60, None, None, None, None, None, None, None, None, None), (2, None, "en", None, 3, "a", "b", "c", 1, "d", "e")]
    for own in (rows, []):
        docs = spark.createDataFrame(own, kind)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, docs, str(tmp_path)).columns == docs.columns
            stage(spark, docs, str(tmp_path)).collect()
        assert (corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() > 0) == bool(own)
