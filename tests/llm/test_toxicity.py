import os
import zlib

import numpy as np
import pytest

from corpusgrep.llm import gru
from corpusgrep.llm.toxicity import fit, op7_gru_toxicity, score


def random_model(seed=0):
    rng = np.random.default_rng(seed)
    p = {k: v.astype(np.float64) for k, v in gru.new_parameters(seed).items()}
    for k in ("word", "char"):
        p[k] = rng.normal(0, 0.5, p[k].shape)
    return p


def test_gradients():
    p, rng = random_model(), np.random.default_rng(1)
    real = np.ones((5, 3), bool)
    real[3:, 1], real[:, 2] = False, False
    gates = [rng.normal(size=(5, 3, 3 * gru.HIDDEN)) for _ in range(2)]
    y = np.array([1.0, 0.0, 1.0])

    def loss():
        z, cache = gru.forward(p, *gates, real)
        return (np.log1p(np.exp(z)) - y * z).sum(), z, cache

    _, z, cache = loss()
    g, d_f, d_b = gru.backward(p, real, cache, 1 / (1 + np.exp(-z)) - y)
    for name in ("Uf", "Ub", "A", "a", "v", "w", "c"):
        for i in rng.integers(0, p[name].size, 4):
            old = p[name].flat[i]
            values = []
            for d in (1e-5, -1e-5):
                p[name].flat[i] = old + d
                values.append(loss()[0])
            p[name].flat[i] = old
            assert abs((values[0] - values[1]) / 2e-5 - np.asarray(g[name]).flat[i]) < 1e-6, name
    for k, d in ((0, d_f), (1, d_b)):
        for i in rng.integers(0, gates[k].size, 8):
            old = gates[k].flat[i]
            values = []
            for e in (1e-5, -1e-5):
                gates[k].flat[i] = old + e
                values.append(loss()[0])
            gates[k].flat[i] = old
            assert abs((values[0] - values[1]) / 2e-5 - d.flat[i]) < 1e-6


def test_fast_path_is_the_network():
    p = {k: v.astype(np.float32) for k, v in random_model(3).items()}
    rng = np.random.default_rng(0)
    forth, back = rng.normal(size=(2, 50, 3 * gru.HIDDEN)).astype(np.float32)
    sizes = np.array([gru.WINDOW, 5, 0, gru.WINDOW, 1])
    flat, first = rng.integers(0, 50, sizes.sum()), np.cumsum(sizes) - sizes
    steps = np.arange(gru.WINDOW)[:, None]
    place, real = np.where(steps < sizes, first + steps, 0), steps < sizes
    want, _ = gru.forward(p, forth[flat[place]], back[flat[place]], real)
    assert np.allclose(gru.window_logits(p, forth, back, flat, sizes, 0)[0], want, atol=1e-4)


def gram_bucket(gram):
    mixed = sum(ord(c) * int(m) for c, m in zip(gram, gru._MIX, strict=True)) & 0xFFFFFFFFFFFFFFFF
    return ((mixed ^ mixed >> 31) * int(gru._MIX[0]) & 0xFFFFFFFFFFFFFFFF) >> 40 & gru.CHAR_BUCKETS - 1


def one_by_one(p, text):
    """The score by its definition, in plain loops: every reading, every word's states, every window."""
    rows = []
    for w in gru.split(text):
        chars = np.mean([p["char"][gram_bucket(f"^{w}$"[i:i + 3])] for i in range(len(w))], 0)
        rows.append(np.concatenate([p["word"][zlib.crc32(w.encode()) % gru.WORD_BUCKETS], chars]))
    if not rows:
        return p["c"][0]

    def read(some, side):
        h, out, n = np.zeros(gru.HIDDEN), [], gru.HIDDEN
        for x in some:
            g, m = x @ p[f"W{side}"] + p[f"b{side}"], h @ p[f"U{side}"]
            z, r = 1 / (1 + np.exp(-g[:n] - m[:n])), 1 / (1 + np.exp(-g[n:2 * n] - m[n:2 * n]))
            h = z * h + (1 - z) * np.tanh(g[2 * n:] + r * m[2 * n:])
            out.append(h)
        return out

    found, width = [], min(len(rows), gru.WINDOW)
    for reading in range(gru.READINGS):
        cuts = sorted({0, len(rows), *range(reading * gru.WINDOW // gru.READINGS, len(rows), gru.WINDOW)})
        states = []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            states += [np.concatenate(x) for x in zip(read(rows[a:b], "f"), read(rows[a:b][::-1], "b")[::-1], strict=True)]
        for a in range(len(rows) - width + 1):
            some = np.array(states[a:a + width])
            e = np.exp(np.tanh(some @ p["A"] + p["a"]) @ p["v"])
            found.append((e / e.sum()) @ some @ p["w"] + p["c"][0])
    return max(found)


def test_scores_by_definition(monkeypatch):
    rng = np.random.default_rng(4)
    p = random_model(6)
    texts = ["", "one", *(" ".join(rng.choice([f"w{i}" for i in range(60)], n)) for n in (7, 31, 32, 33, 40, 64, 150, 333))]
    want = [one_by_one(p, t) for t in texts]
    scorer = gru.Scorer({k: v.astype(np.float32) for k, v in p.items()})
    assert np.allclose(scorer.logits(texts), want, atol=1e-4)
    alone = [one_by_one(p, " ".join(texts[-1].split()[a:a + gru.WINDOW])) for a in range(0, 333 - gru.WINDOW, gru.STEP)]
    assert want[-1] > max(alone) - 1e-9  # the windows that are pieces are among all


def test_long_texts_in_parts(monkeypatch):
    rng = np.random.default_rng(5)
    scorer = gru.Scorer({k: v.astype(np.float32) for k, v in random_model(7).items()})
    texts = [" ".join(rng.choice([f"w{i}" for i in range(60)], n)) for n in (60, 127, 128, 129, 160, 1000, 1024)] + [" . " * 400, "x" * 3000]
    whole = scorer.logits(texts)
    monkeypatch.setattr(gru, "LONG", 4 * 4 * gru.WINDOW)
    assert np.allclose(scorer.logits(texts), whole, atol=1e-4)


def test_scores_do_not_depend_on_the_batch(monkeypatch):
    rng = np.random.default_rng(2)
    texts = [" ".join(rng.choice(["ab", "cde", "f'g", "É", "x"], n)) for n in (0, 1, 31, 32, 33, 100, 500)] + [None]
    scorer = gru.Scorer({k: v.astype(np.float32) for k, v in random_model(5).items()})
    together = scorer.logits(texts)
    assert np.allclose(together, [scorer.logits([t])[0] for t in texts], atol=1e-4)
    monkeypatch.setattr(gru, "CACHED", 2)
    assert np.allclose(together, gru.Scorer(scorer.p).logits(texts), atol=1e-4)
    assert together[0] == together[-1]


def tables(n, seed=0):
    rng = np.random.default_rng(seed)
    calm, bad = [f"calm{i}" for i in range(200)], ["nasty", "vile"]
    docs, labels = [], []
    for i in range(n):
        words = rng.choice(calm, rng.integers(1, 120)).tolist()
        toxic = int(rng.random() < 0.3)
        for _ in range(toxic * 3):
            words.insert(rng.integers(len(words) + 1), str(rng.choice(bad)))
        docs.append((i, " ".join(words), toxic))
        labels.append((i, toxic))
    return docs, labels


def test_query(spark, tmp_path):
    docs, labels = tables(500)
    docs += [(None, "nasty", 1), (1000, None, 0), (1001, "", 0), (docs[3][0], docs[3][1], 0)]
    spark.createDataFrame(docs, "doc_id long, text string, score int").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([*labels, (1000, None), (None, 1)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = op7_gru_toxicity(spark, str(tmp_path)).collect()
    assert len(got) == len(docs)
    truth = dict(labels)
    tested = [r for r in got if r.held_out and r.doc_id in truth]
    assert all(r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert np.mean([r.predicted == truth[r.doc_id] for r in tested]) > 0.95


def test_sample_bytes(spark, monkeypatch):
    learnt = []
    monkeypatch.setattr(gru, "train", lambda texts, labels: learnt.extend(map(len, texts)))
    monkeypatch.setattr("corpusgrep.llm.toxicity.SAMPLE_BYTES", 2000)
    rows = spark.range(50).selectExpr("id as doc_id", "repeat('a', if(id % 10 = 3, 5000, 100)) as text", "int(id % 2) as toxic")
    fit(rows.select("doc_id", "text"), rows.select("doc_id", "toxic"))
    assert learnt == [100] * 20


def test_extra_columns(spark):
    docs = spark.createDataFrame([(1, "a b", 5.0, None)], "doc_id long, text string, score double, t string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert score(docs, fit(docs, labels)).columns == ["doc_id", "text", "score", "t"]


def test_sample_sizes(spark, monkeypatch):
    learnt = []
    monkeypatch.setattr(gru, "train", lambda texts, labels: learnt.extend(labels))
    rows = spark.range(5000).selectExpr("id as doc_id", "'a' as text", "int(id % 3 = 0) as toxic")
    fit(rows.select("doc_id", "text"), rows.select("doc_id", "toxic"))
    assert (sum(learnt), len(learnt)) == (1000, 3000)


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert all(r.score < 0.5 for r in score(docs, fit(docs, labels)).collect())
    assert score(docs.limit(0), fit(docs, labels)).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no tables")
def test_held_out_accuracy(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    got = [(r.predicted, labels[r.doc_id]) for r in op7_gru_toxicity(spark, "/root/testdata/sf0.1").where("held_out").collect() if r.doc_id in labels]
    hits, false = sum(p and t for p, t in got), sum(p and not t for p, t in got)
    assert hits >= 0.75 * sum(t for _, t in got) and false <= 0.02 * sum(not t for _, t in got)
