import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from corpusgrep.llm import gru
from corpusgrep.llm.suffix_dedup import whole_characters
from tests.llm.test_minhash import brute as near_brute
from tests.llm.test_pii import plain


def cut(texts):
    data = [t.encode() for t in texts]
    seen = Counter(d[i:i + 200] for d in data for i in range(len(d) - 199))
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - 199):
            if seen[d[i:i + 200]] > 1:
                gone[i:i + 200] = True
        out.append(bytes(b for b, g in zip(d, gone, strict=True) if not g).decode("utf-8", "ignore"))
    return out


def masked(text):
    spans, out, at = [], "", 0
    for a, kind, b in plain(text):
        if spans and spans[-1][2] > a:
            spans[-1] = (spans[-1][0], spans[-1][1], max(b, spans[-1][2]))
        else:
            spans.append((a, kind, b))
    for a, kind, b in spans:
        out += text[at:a] + "[" + ("EMAIL", "IP", "CARD", "PHONE")[kind] + "]"
        at = b
    return out + text[at:]


def test_against_brute_force(spark, tmp_path):
    rng = np.random.default_rng(11)
    calm, bad = [f"wörd{i}" for i in range(300)], ["vile", "nasty"]
    shared = " ".join(rng.choice(calm, 60))
    docs, labels = [], []
    for i in range(260):
        words = rng.choice(calm, rng.integers(1, 90)).tolist()
        toxic = int(i % 4 == 0)
        for _ in range(4 * toxic):
            words.insert(rng.integers(len(words) + 1), str(rng.choice(bad)))
        if i % 9 == 1:
            words.insert(rng.integers(len(words) + 1), shared)
        if i % 7 == 2:
            words += [f"u{i}@mail.example.org", "10.1.2.3"]
        text = " ".join(words)
        if i % 10 == 5 and docs:
            text = docs[-2][1]
        docs.append((i, text, "en", "s", len(text)))
        if toxic == (" vile" in text or " nasty" in text):
            labels.append((i, toxic, 1))
    docs += [(1000, "", "en", "s", 0), docs[6]]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, toxic int, quality int").write.parquet(str(tmp_path / "labels.parquet"))

    by_id = {d[0]: d[1] for d in docs}
    used = sorted((k, t) for k, t, _ in labels if zlib.crc32(str(k).encode()) % 5)
    scorer = gru.Scorer(gru.train([by_id[k] for k, _ in used], [t for _, t in used]))
    rows = [(k, t) for (k, t, *_), z in zip(docs, scorer.logits([d[1] for d in docs]), strict=True) if z < 0]
    assert 150 < len(rows) < 240 and not any("vile" in t for _, t in rows)
    rows = sorted({(k, t) for (k, t), (_, _, _, kept) in zip(rows, near_brute(rows), strict=True) if kept})
    texts = [masked(t) for t in cut([t for _, t in rows])]
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for (k, _), t in zip(rows, texts, strict=True):
        ids = [*library.encode(t, add_special_tokens=False).ids, 2]
        want.append((k, 0, 0, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(tuple(r[:5]) for r in got) == sorted(want)
    assert any(shared[:100] in d[1] for d in docs) and any("[EMAIL]" in t for t in texts)


def test_null_columns_and_empty_tables(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], "doc_id long, toxic int, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    for rows in ([], [(None, None, None, None, None), (1, None, None, None, None), (2, "a", None, None, None)]):
        docs = spark.createDataFrame(rows, schema)
        for _, stage in corpus_pipeline.STAGES:
            got = stage(spark, docs, str(tmp_path)).collect()
            assert len(got) == len(rows)
            if stage is not corpus_pipeline.pack and rows:
                assert sorted(got, key=str)[0].asDict().keys() == {"doc_id", "text", "lang", "source", "n_chars"}


def test_whole_characters(spark):
    raw = [b"plain", "é ü €😀".encode(), b"\xa9 x \xc3", b"\xe2\x82 y \xf0\x9f\x98", b"", b"\xed\xa0\x80z", b"a\xc3\xa9\xc3"]
    got = spark.createDataFrame([(x,) for x in raw], "b binary").select(whole_characters(F.col("b"))).collect()
    assert [r[0] for r in got] == [x.decode("utf-8", "ignore") for x in raw]
    assert re.match("plain", got[0][0])
