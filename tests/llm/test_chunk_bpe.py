from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from inkgrid.llm import chunk_bpe
from inkgrid.llm.chunk_bpe import Solver, chunk_cuts, decode_documents, encode_documents, op11_chunked_bpe
from inkgrid.llm.common import vocabulary_path
from inkgrid.llm.encoding import encoder
from inkgrid.llm.textkit import utf8_chunks

from .conftest import DOCUMENTS, EXTRA, PASSAGE, sentence

NAMES = ["word_bpe_49k.json", "byte_bpe_50k.json"]
ODD = ["a", "B", "é", ".", ",", " ", "  ", "\n", "1", "<|endoftext|>", "<|startoftext|>", "\t", "Σ", "日", "'s", "-", "́", "word", "...", "İ", " ", "😀", "n't", "\x00", " "]


def odd_texts(seed: int, n: int, longest: int) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choice(ODD) for _ in range(rng.randint(0, longest))) for _ in range(n)]


def solved(solver: Solver, texts: list[str]) -> list[bytes]:
    import pyarrow as pa

    return [x for _, _, buf, offsets in utf8_chunks(pa.array(texts, pa.string())) for x in solver.encode(buf.tobytes(), buf, offsets)]


def library(name: str, texts: list[str]) -> list[bytes]:
    tokenizer = encoder(vocabulary_path(name)).tokenizer
    return [np.array(e.ids, "<u4").tobytes() for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("bits", [1, 3, 8])
@pytest.mark.parametrize("name", NAMES)
def test_repaired_chunks_equal_the_library(name, bits, monkeypatch):
    """Many more cuts than in production, in all places of a word: the repair decides."""
    monkeypatch.setattr(chunk_bpe, "BITS", bits)
    monkeypatch.setattr(chunk_bpe, "WINDOW", 4)
    texts = [t or "" for _, t in DOCUMENTS] + odd_texts(bits, 400, 60) + ["x" * 5000, "日" * 3000, "ab" * 4000, " " * 3000, "é " * 2000]
    solver = Solver(vocabulary_path(name))
    assert solved(solver, texts) == library(name, texts)
    assert solved(solver, texts[::-1]) == library(name, texts[::-1])  # from what is remembered now


def test_cuts_follow_content():
    texts = [sentence(1, 30) + " " + sentence(5, 400), sentence(2, 77) + " " + sentence(5, 400)]
    found = []
    for text in texts:
        data = text.encode()
        cuts = chunk_cuts(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
        pieces = [data[a:b] for a, b in zip(cuts[:-1], cuts[1:])]
        assert b"".join(pieces) == data and max(map(len, pieces)) <= chunk_bpe.LONGEST + 3
        found.append(pieces)
    assert len(set(found[0]) & set(found[1])) >= len(found[0]) - 4


def test_cuts_stand_before_characters_and_never_cross_texts():
    texts = [s.encode() for s in odd_texts(3, 300, 200)]
    buf, offsets = np.frombuffer(b"".join(texts), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    cuts = chunk_cuts(buf, offsets)
    assert set(np.unique(offsets)) <= set(cuts.tolist()) and (np.diff(cuts) > 0).all()
    for a, b in zip(cuts[:-1], cuts[1:]):
        buf[a:b].tobytes().decode()


def test_shared_chunks_are_encoded_once(spark):
    texts = [f"{sentence(i, 20)} {PASSAGE} {PASSAGE[::-1]} {sentence(i + 100, 20)}" for i in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    counts = {bytes(r["digest"]): r["n"] for r in chunk_bpe.chunk_counts(docs).collect()}
    plain: dict[bytes, int] = {}
    for text in texts:
        data = text.encode()
        cuts = chunk_cuts(np.frombuffer(data, np.uint8), np.array([0, len(data)])).tolist()
        for a, b in zip(cuts[:-1], cuts[1:]):
            key = hashlib.blake2b(data[a:b], digest_size=16).digest()
            plain[key] = plain.get(key, 0) + 1
    assert counts == plain
    path = vocabulary_path(NAMES[0])
    shared = chunk_bpe.shared_chunks(docs, path)
    assert {hashlib.blake2b(c, digest_size=16).digest() for c in shared} == {k for k, n in plain.items() if n > 1}
    assert len(chunk_bpe.shared_chunks(docs, path, most=1)) == 1
    for most in (0, 1, 1000):
        got = {r["doc_id"]: bytes(r["ids"]) for r in encode_documents(docs, path, most=max(most, 1)).collect()}
        assert [got[i] for i in range(40)] == library(NAMES[0], texts)


def test_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(chunk_bpe, "KEPT", 2000)
    solver, texts = Solver(vocabulary_path(NAMES[0])), [sentence(i, 300) for i in range(30)]
    for i, text in enumerate(texts):
        assert solved(solver, [text]) == library(NAMES[0], [text])
    assert solver.chunk_bytes < 20_000 and len(solver.chunks) < 60


@pytest.mark.parametrize("name", NAMES)
def test_round_trip_as_the_library_decodes(spark, name):
    texts = [t or "" for _, t in DOCUMENTS] + odd_texts(9, 100, 40)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    tokenizer = encoder(vocabulary_path(name)).tokenizer
    coded = encode_documents(docs, vocabulary_path(name), decode=True)
    want = {i: tokenizer.decode(np.frombuffer(x, "<u4").tolist(), skip_special_tokens=False) for i, x in enumerate(library(name, texts))}
    assert {r["doc_id"]: r["decoded"] for r in coded.collect()} == want
    assert {r["doc_id"]: r["decoded"] for r in decode_documents(coded, vocabulary_path(name)).collect()} == want


def test_query_on_odd_documents(spark, odd_dir):
    rows = op11_chunked_bpe(spark, odd_dir).collect()
    tokenizer = encoder(vocabulary_path(NAMES[0])).tokenizer
    want = []
    for i, text in DOCUMENTS:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(map(repr, map(tuple, rows))) == sorted(map(repr, want))


def test_query_on_an_empty_table(spark, empty_dir):
    assert op11_chunked_bpe(spark, empty_dir).collect() == []


def test_columns_are_kept(spark, odd_dir):
    docs = spark.read.parquet(f"{odd_dir}/documents.parquet")
    kept = encode_documents(docs, vocabulary_path(NAMES[0]), keep=["text", *[c for c in EXTRA if c != "ids"]])
    assert sorted(map(repr, ((r["doc_id"], r["text"]) for r in kept.collect()))) == sorted(map(repr, DOCUMENTS))
    with pytest.raises(ValueError):
        encode_documents(docs, vocabulary_path(NAMES[0]), keep=["ids"])
