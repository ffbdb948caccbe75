"""Contract cases at the edges: large vector components, token strings, unlabelled tables, long texts."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ticketlens.llm import features, langid, packing, pivots


@pytest.mark.parametrize("low, high", [(128.0, 256.0), (2.0**15, 2.0**16), (0.0, 1.0)])
def test_neighbours_of_large_components(spark, low, high):
    rng = np.random.default_rng(8)
    vectors = rng.uniform(low, high, size=(60, 64)).astype(np.float32).astype(float)
    vectors[3] = vectors[4] = vectors[50]  # ties
    vectors[7] = vectors[7] * 2.0**5  # one of another size
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id bigint, embedding array<double>")
    whole = [[int(np.floor(256 * x)) for x in v] for v in vectors]
    want = set()
    for q in range(0, 60, 20):
        every = sorted((-sum(a * b for a, b in zip(whole[q], w)), i) for i, w in enumerate(whole) if i != q)[:5]
        want |= {(q, rank, i, -s) for rank, (s, i) in enumerate(every, 1)}
    assert max(abs(s) for *_, s in want) < 2**63
    found = pivots.search(pivots.scaled(rows), 20).collect()
    assert {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in found} == want


def test_ids_are_those_of_the_tokenizer_as_loaded():
    from tokenizers import Tokenizer

    from ticketlens.llm.tokens import Encoder

    files = packing.token_files()
    plain, own = Tokenizer.from_file(files[0]), Encoder(*files)
    for text in ("a<|endoftext|>b", "<|endoftext|>", "a <|endoftext|> <|endo", "plain words, and more", "ünï 漢字 x", ""):
        assert np.frombuffer(own.encode(text), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids


def test_language_stage_without_labels_keeps_texts(spark, odd):
    bare = odd.withColumn("lang", F.lit(None).cast("string"))
    kept = corpus_pipeline.language_id(spark, bare, "")
    assert kept.columns == bare.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(
        str(r["doc_id"]) for r in odd.collect() if r["text"] and any(c.isalpha() for c in r["text"]))
    filled = corpus_pipeline.language_id(spark, odd.withColumn("lang", F.when(F.col("doc_id") != 9, F.col("lang"))), "")
    assert filled.where("lang is null").count() == 0


def test_slices_of_bounded_text(monkeypatch):
    monkeypatch.setattr(features, "SLICE", 10)
    texts = ["abc", None, "defgh", "x" * 50, "", "ijk", "lmnop", "qr"]
    parts = list(features.by_size([pa.RecordBatch.from_pydict({"text": texts}), pa.RecordBatch.from_pydict({"text": pa.array([], pa.string())})]))
    assert [p.column("text").to_pylist() for p in parts] == [["abc", None, "defgh"], ["x" * 50], ["", "ijk", "lmnop", "qr"]]


def test_one_text_much_longer_than_the_others(spark):
    rows = [(i, f"the quick brown fox number {i} jumps over the lazy dog", "en") for i in range(40)]
    rows += [(100 + i, f"der schnelle braune fuchs nummer {i} springt über den hund", "de") for i in range(40)]
    rows.append((500, "the lazy dog jumps over the fox " * 200_000, "en"))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    found = langid.identify(docs, langid.fit(docs)).collect()
    assert all(r["lang_pred"] == r["lang"] for r in found) and len(found) == 81


def test_the_schedule_writes_no_texts_and_the_join_leaves_few_tables(spark, tmp_path, monkeypatch):
    import os

    from ticketlens.llm import common, jaccard, mixing

    monkeypatch.setattr(common, "new_path", lambda spark, label: f"{tmp_path}/{label}-{len(os.listdir(tmp_path))}-{os.urandom(4).hex()}")
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(i, base + f" t{i % 4}" if i % 2 else f"{i} " + " ".join(f"x{i * j}" for j in range(40)), "ab"[i % 2]) for i in range(60)]
    docs = spark.createDataFrame(rows + rows[:3], "doc_id bigint, text string, source string")
    assert jaccard.one_of_each(docs).count() == 31
    assert {d.split("-")[0] for d in os.listdir(tmp_path)} <= {"prefixes", "labels"}
    assert mixing.scheduled(docs).where("text is null").count() == 0
    sizes = [d for d in os.listdir(tmp_path) if d.startswith("mix-sizes")]
    assert spark.read.parquet(f"{tmp_path}/{sizes[0]}").columns == ["doc_id", "source", "size", "_h", "_x"]
