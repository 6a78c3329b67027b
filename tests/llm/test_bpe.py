import hashlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from corpusgrep.llm.bpe import BpeCodec, op6_bpe_speculate_verify

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = ["", None, "Hello, World! it's 3 o'clock", "a\tb c \n\n x  y\n", "<|endoftext|> done <|end of", "é" * 300 + " é ́x", "  two  spaces \n \n end ",
         "\n<|endoftext|>\n\nx \n<|endoftext|>", "日本語 テキスト 😀😀", "x" * 5000, "aaaaaaa " * 50, "\x1cab\x1f c", " ", "don't WE'LL", "-" * 3000, "\x00\x01"]


@pytest.fixture(scope="module")
def codec():
    return BpeCodec(PATH)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_whole_texts(codec, library):
    rng = np.random.default_rng(0)
    texts = TEXTS + ["".join(rng.choice(list("abethn' \n1.éÉD"), 80)) for _ in range(300)] + ["".join(map(chr, rng.integers(1, 900, 60))) for _ in range(200)]
    for text, ids in zip(texts, codec.encode(texts), strict=True):
        got = np.frombuffer(ids, "<u4")
        want = library.encode(text or "", add_special_tokens=False).ids
        assert got.tolist() == want, repr(text)
        assert codec.decode(got) == library.decode(want, skip_special_tokens=False)


def test_long_texts_in_parts(codec, library, monkeypatch):
    monkeypatch.setattr("corpusgrep.llm.encoders.PART", 7)
    monkeypatch.setattr("corpusgrep.llm.bpe.PART", 7)
    rng = np.random.default_rng(0)
    texts = ["".join(rng.choice(list("ab' \n1.éÉD\t"), 80)) for _ in range(200)] + ["x" * 90, "a", None]
    for text, ids in zip(texts, codec.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text or "", add_special_tokens=False).ids, repr(text)


def test_merging_and_proposals_agree(codec, library):
    rng = np.random.default_rng(1)
    words = ["".join(rng.choice(list("etaoinshrdlu"), rng.integers(1, 40))).encode() for _ in range(3000)] + [b"a" * n for n in range(1, 70)]
    for word, ids in zip(words, codec.encode_words(words), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == codec.merge(word) == [t.id for t in library.model.tokenize(word.decode())]
    wrong = [w for w in words if codec.propose(w) != codec.merge(w)]
    assert wrong and len(wrong) < len(words)


def test_pair_check_is_exact(codec):
    rng = np.random.default_rng(2)
    names = {i: t for t, i in codec.vocab.items()}
    pool = [i for i in range(3000) if codec.own[i] and i in names]
    a, b = rng.choice(pool, 4000), rng.choice(pool, 4000)
    for x, y, ok in zip(a.tolist(), b.tolist(), codec.compatible(a, b).tolist(), strict=True):
        assert ok == (codec.merge(codec.bytes[x] + codec.bytes[y]) == [x, y]), (names[x], names[y])
    for t in rng.choice(list(names), 3000).tolist():
        if names[t] not in codec.special:
            assert codec.own[t] == (codec.merge(codec.bytes[t]) == [t])


def test_decoding_odd_ids(codec, library):
    for ids in ([199, 198, 100000], [50256, 0], [130, 250, 5]):
        known = [i for i in ids if i < 50257]
        assert codec.decode(np.array(ids)) == library.decode(known, skip_special_tokens=False)


def test_query(spark, tmp_path, library):
    rows = [(i, t, "c") for i, t in enumerate(TEXTS)] + [(None, "n", None), (2, "twice", "c"), (2, "twice", "c")]
    spark.createDataFrame(rows, "doc_id long, text string, ids string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(map(tuple, op6_bpe_speculate_verify(spark, str(tmp_path)).collect()), key=str)
    want = []
    for k, t, _ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((k, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want, key=str)


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert op6_bpe_speculate_verify(spark, str(tmp_path)).count() == 0
