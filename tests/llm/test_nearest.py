import numpy as np

from corpusgrep.llm import nearest as module
from corpusgrep.llm.nearest import nearest

SCHEMA = "vec_id long, embedding array<float>, rank string"


def brute(rows, queries, k):
    good = {(i, tuple(v)) for i, v, _ in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = []
    for i, v in good:
        if i in queries:
            near = sorted({(float(np.sqrt(((np.array(v, float) - np.array(w, float)) ** 2).sum())), j) for j, w in good if j != i and len(w) == len(v)})[:k]
            out += [(i, r + 1, j, s) for r, (s, j) in enumerate(near)]
    return sorted(out)


def rows(seed, n=700, dim=24):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(9, dim))
    vectors = (centres[rng.integers(0, 9, n)] + 0.2 * rng.normal(size=(n, dim))).astype(np.float32)
    out = [(i, v.tolist(), None) for i, v in enumerate(vectors)]
    out += [(1000 + i, vectors[7].tolist(), "x") for i in range(250)]
    odd = [None, [], [0.0] * dim, [float("nan")] * dim, [float("inf")] + [1.0] * (dim - 1), [None] + [1.0] * (dim - 1), [1.0, 2.0, 3.0], [1.0, 2.0, 4.0]]
    return out + [(2000 + i, v, "y") for i, v in enumerate(odd)] + [(None, vectors[0].tolist(), "z"), out[30], out[20]]


def test_against_all(spark, monkeypatch):
    monkeypatch.setattr(module, "TOGETHER", 13)
    monkeypatch.setattr(module, "VECTOR_BYTES", 40 * 8 * 24)
    monkeypatch.setattr(module, "QUERY_BYTES", 1)
    data = rows(0)
    asked = {i for i, _, _ in data if i is not None and i % 20 == 0 or i == 2006}
    df = spark.createDataFrame(data, SCHEMA).repartition(5)
    got = sorted(map(tuple, nearest(spark, df, df.where("vec_id % 20 = 0 or vec_id = 2006")).collect()))
    want = brute(data, asked, 10)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    hits = len({(g[0], g[2]) for g in got} & {(w[0], w[2]) for w in want}) / len(want)
    assert hits >= 0.999
    assert np.allclose([g[3] for g in got], [w[3] for w in want])


def test_repeated_rows(spark):
    rng = np.random.default_rng(3)
    data = [(i, rng.normal(size=8).astype(np.float32).tolist(), "") for i in range(40)]
    data += [data[1]] * 15 + [(1, data[2][1], ""), (3, data[3][1], "other column")]
    df = spark.createDataFrame(data, SCHEMA).coalesce(1)
    got, want = sorted(map(tuple, nearest(spark, df, df.where("vec_id % 20 = 0")).collect())), brute(data, {0, 20}, 10)
    assert [g[:3] for g in got] == [w[:3] for w in want] and len(got) == 20


def test_recall(spark):
    rng = np.random.default_rng(5)
    vectors = (rng.normal(size=(60, 48))[rng.integers(0, 60, 20_000)] + 0.4 * rng.normal(size=(20_000, 48))).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist(), None) for i, v in enumerate(vectors)], SCHEMA)
    got = {(r.query_id, r.vec_id) for r in nearest(spark, df, df.where("vec_id % 100 = 0")).collect()}
    want = {(q, int(j)) for q in range(0, 20_000, 100) for j in np.argsort(((vectors.astype(float) - vectors[q]) ** 2).sum(1), kind="stable")[1:11]}
    assert len(got) == len(want) and len(got & want) >= 0.999 * len(want)


def test_far_vectors(spark):
    rng = np.random.default_rng(2)
    data = [(i, (rng.normal(size=8) * scale).astype(np.float32).tolist(), "") for i, scale in enumerate([1.0] * 30 + [1e20] * 20 + [1e38] * 5)]
    df = spark.createDataFrame(data, SCHEMA)
    got, want = sorted(map(tuple, nearest(spark, df, df).collect())), brute(data, set(range(55)), 10)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want])


def test_bounds_hold():
    rng = np.random.default_rng(1)
    vectors, queries = rng.normal(size=(3000, 64)) + 1, rng.normal(size=(40, 64)) + 1
    centre, turn = vectors.mean(0), module.rotation(64)
    assert np.allclose(turn @ turn.T, np.eye(64))
    codes, norm, own = module.encode(vectors, centre, turn)
    low, high = module.bounds(module.unpacked(codes, 64), norm, own, queries, centre, turn)
    exact = ((queries[:, None] - vectors[None]) ** 2).sum(2)
    assert ((low <= exact) & (exact <= high)).mean() > 0.9999
    assert (low > np.sort(exact, 1)[:, 9:10]).mean() > 0.1


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert nearest(spark, empty, empty).count() == 0
    one = spark.createDataFrame([(1, [1.0, 2.0], "")], SCHEMA)
    assert nearest(spark, one, one).count() == 0
