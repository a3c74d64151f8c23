import math

import numpy as np

from tesserae.llm import topk

SCHEMA = "vec_id long, embedding array<float>, score string"


def brute(rows, k=5):
    good = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in good:
        if q % 50 == 0:
            s = sorted((-sum(x * y for x, y in zip(a, b, strict=False)), i) for i, b in good if i != q)[:k]
            out += [(q, n + 1, i, -x) for n, (x, i) in enumerate(s)]
    return sorted(out)


def run(spark, rows, k=5):
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], SCHEMA)
    return sorted(tuple(r) for r in topk.top_k(df, df.where("vec_id % 50 = 0"), k).collect())


def test_against_brute_force(spark):
    r = np.random.default_rng(0)
    rows = [(i, [float(np.float32(x)) for x in r.normal(size=8) * (r.random(8) > 0.3)]) for i in range(300)]
    rows += [(1000 + i, rows[3][1]) for i in range(7)]  # ties
    assert run(spark, rows) == brute(rows)


def test_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_BLOCK", 2)
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 7)
    r = np.random.default_rng(1)
    rows = [(i, [float(np.float32(x)) for x in r.normal(size=4)]) for i in range(260)]
    assert run(spark, rows) == brute(rows)


def test_odd_vectors(spark):
    rows = [(0, [1.0, 2.0]), (50, None), (100, [float("nan"), 1.0]), (1, [1.0, None]), (2, []), (3, [float("inf"), 0.0]), (4, [0.5, -0.25])]
    assert run(spark, rows) == brute(rows) == [(0, 1, 4, 256 * 128 - 512 * 64)]


def test_empty(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, [1.0])]) == []


def test_query_blocks_without_broadcast(spark, monkeypatch):
    """Three query blocks and more, one or several groups of them: no task gets the whole table."""
    monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 16)
    r = np.random.default_rng(4)
    rows = [(i, [float(np.float32(x)) for x in r.normal(size=6) * (r.random(6) > 0.5)]) for i in range(450)] + [(None, [1.0] * 6)]
    for together in (64, 2):
        monkeypatch.setattr(topk, "TOGETHER", together)
        df = spark.createDataFrame([(i, v, "x") for i, v in rows], SCHEMA)
        got = topk.top_k(df, df.where("vec_id % 50 = 0"), 5)
        top = {}
        for q, _, i, s in sorted(tuple(x) for x in got.collect()):
            top.setdefault(q, []).append((i, s))
        want = {}
        for q, _, i, s in brute([x for x in rows if x[0] is not None]):
            want.setdefault(q, []).append((i, s))
        assert top == want


def test_copies_of_query_blocks_are_no_broadcast(spark, monkeypatch):
    """Spark takes blocks that are dealt out in copies for as small as one of them; they must not go through the driver."""
    monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 16)
    r = np.random.default_rng(5)
    df = spark.createDataFrame([(i, [float(x) for x in r.normal(size=4)], "x") for i in range(450)], SCHEMA)
    got = topk.top_k(df, df.where("vec_id % 50 = 0"), 5)
    assert len(got.collect()) == 45
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()


def test_sparse_and_dense_components_of_all_sizes(spark):
    """Lists of most rows hold their zeros, values take 2, 4 or 8 bytes."""
    r = np.random.default_rng(6)
    for size in (1.0, 1e3, 1e6):
        rows = [(i, [float(np.float32(size * x)) for x in r.normal(size=6) * (r.random(6) > [0, 0.02, 0.3, 0.6, 0.95, 1])]) for i in range(260)]
        rows += [(i, v[:3]) for i, v in rows[40:60]] + [(100, rows[7][1])] + [(999, [1e9] * 6)] * (size == 1.0)
        c = [(i, [math.floor(256 * x) for x in v]) for i, v in rows]
        got = run(spark, rows)
        want = {}
        for i, a in c:
            if i % 50 == 0:
                want.setdefault(i, []).extend((-sum(x * y for x, y in zip(a, b, strict=False)), j) for j, b in c if j != i)
        assert got == sorted((i, n + 1, j, -x) for i, s in want.items() for n, (x, j) in enumerate(sorted(s)[:5]))
