import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from corpusgrep.llm import token_files
from corpusgrep.llm.elias_fano import EliasFano
from corpusgrep.llm.encoders import CachedEncoder, byte_words, lower_words

TEXTS = ["", None, "Hello, World! it's 3 o'clock", "a\tb c \n\n x  y\n", "<|endoftext|> done <|end of", "é" * 300 + " é ́x",
         "  two  spaces \n \n end ", "\n<|endoftext|>\n\nx \n<|endoftext|>", "日本語 テキスト 😀😀", "ΑΣ ΟΔΟΣ İstanbul ǅ", "x" * 5000, "\x1cab\x1f c", " ", "don't WE'LL"]


@pytest.mark.parametrize("values", [[], [0], [0, 0, 0], [5, 5, 9, 1000000], list(range(0, 5000, 3)), [2**40]])
def test_elias_fano(values):
    ef = EliasFano.frombytes(EliasFano.of(values).tobytes())
    assert ef.decode().tolist() == values
    assert [ef.select(i) for i in range(len(values))] == values


def test_elias_fano_is_small():
    values = np.cumsum(np.random.default_rng(1).integers(1, 2000, 20000))
    assert len(EliasFano.of(values).tobytes()) < 20000 * 12.5 / 8


@pytest.mark.parametrize("name,chunks", [("word_bpe_49k.json", lower_words), ("byte_bpe_50k.json", byte_words)])
def test_cached_encoder_is_the_library(name, chunks):
    library, ours = Tokenizer.from_file(public_tokenizers.path(name)), CachedEncoder(public_tokenizers.path(name), chunks)
    rng = np.random.default_rng(0)
    texts = [t or "" for t in TEXTS] + ["".join(rng.choice(list("ab' \n1.éÉD"), 60)) for _ in range(300)] + ["".join(rng.choice(list("ab' \n\t1.é́D"), 60)) for _ in range(300)]
    texts += ["".join(rng.choice(list("abßÿàöøÀÖØÞ12\'!"), 30)) for _ in range(300)] + ["chbeß und ÿx"]
    texts += [" ".join("'" + c + "s x" + c for c in map(chr, range(32, 256)))]
    for t in texts:
        assert np.frombuffer(ours(t), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)


@pytest.mark.parametrize("name,words", [("word_bpe_49k.json", lower_words), ("byte_bpe_50k.json", byte_words)])
def test_long_texts_in_parts(monkeypatch, name, words):
    monkeypatch.setattr("corpusgrep.llm.encoders.PART", 7)
    library, ours = Tokenizer.from_file(public_tokenizers.path(name)), CachedEncoder(public_tokenizers.path(name), words)
    rng = np.random.default_rng(0)
    for t in ["".join(rng.choice(list("ab' \n1.éÉD"), 80)) for _ in range(200)] + ["x" * 90, " " * 40]:
        assert np.frombuffer(ours(t), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)


def test_files(spark, tmp_path, monkeypatch):
    rows = [(i * 3 - 7, t, "x") for i, t in enumerate(TEXTS)] + [(None, "n", "x"), (None, None, "y"), (2, "again", None), (2, "again", None)]
    spark.createDataFrame(rows, "doc_id long, text string, ids string").write.parquet(str(tmp_path / "documents.parquet"))
    got = token_files.op1_elias_fano_tokens(spark, str(tmp_path)).orderBy("start").collect()
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {}
    for k, t, _ in rows:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes()
        want.setdefault((k, len(ids) // 4, zlib.crc32(ids)), []).append(1)
    assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in got), key=str) == sorted((k for k, v in want.items() for _ in v), key=str)
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    keys = [(r.doc_id is not None, r.doc_id or 0) for r in got]
    assert keys == sorted(keys)


def test_many_files_of_a_task(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "SEGMENT_TOKENS", 5)
    monkeypatch.setattr(token_files, "FILE_SEGMENTS", 2)
    spark.createDataFrame([(i, "some words " * (i % 7)) for i in range(300)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = token_files.op1_elias_fano_tokens(spark, str(tmp_path)).orderBy("doc_id").collect()
    at = 0
    for i, r in enumerate(got):
        assert (r.doc_id, r.start) == (i, at)
        at += r.n_tokens
    assert at == sum(1 + 2 * (i % 7) for i in range(300))


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert token_files.op1_elias_fano_tokens(spark, str(tmp_path)).count() == 0


def test_segments():
    ids = np.arange(10, dtype="<u4").tobytes()
    data = token_files.pack_segment([None, 4, 9], [2, 0, 8], ids, 2) + b"\n" + token_files.pack_segment([11], [10], ids, 4) + b"\n"
    first, second = token_files.segments(data)
    assert first.doc_ids() == [None, 4, 9] and second.doc_ids() == [11]
    assert first.ids(2).tolist() == list(range(2, 10)) and second.ids(0).tolist() == list(range(10))
