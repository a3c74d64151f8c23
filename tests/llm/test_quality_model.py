import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.llm import quality_model as qm


@pytest.fixture(scope="module")
def corpus(spark):
    r = np.random.default_rng(0)
    word = lambda: "".join(r.choice(list("abcdefgh"), r.integers(2, 8)))
    rows = [(i, " ".join(word() + ("###" if i % 3 == 0 and r.random() < 0.6 else "") for _ in range(int(r.integers(5, 60)))), 1.5) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, f_upper double")
    return docs, docs.selectExpr("doc_id", "cast(doc_id % 3 > 0 AS int) AS quality").where("doc_id % 7 > 0")


def test_held_out_accuracy(spark, corpus):
    rows = qm.scored(*corpus).collect()
    assert len(rows) == 600 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert np.mean([r.predicted == (r.doc_id % 3 > 0) for r in rows if r.held_out]) > 0.95


def test_normal_equations_match_numpy(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(50, len(qm.COLUMNS)))
    df = spark.createDataFrame([(*map(float, row), int(i % 2)) for i, row in enumerate(x)], [*qm.COLUMNS, "y"])
    mean, dev = np.zeros(len(qm.COLUMNS)), np.ones(len(qm.COLUMNS))
    a, b = qm.normal_equations(df, mean, dev)
    f = qm.features(x, mean, dev)
    assert np.allclose(a, f.T @ f) and np.allclose(b, f.T @ (np.arange(50) % 2))


def test_isotonic_levels_never_fall():
    x, y = qm.pool(np.arange(6.0), np.array([0, 1, 0.5, 0.5, 2, 1.0]), np.ones(6))
    assert (np.diff(y) > 0).all() and y.tolist() == [0, 2 / 3, 1.5] and x.tolist() == [0, 2, 4.5]


def test_fourier_features_approximate_the_gaussian(monkeypatch):
    monkeypatch.setattr(qm, "N_COSINES", 4096)
    r = np.random.default_rng(2)
    x = r.normal(size=(20, len(qm.COLUMNS)))
    f = qm.features(x, np.zeros(x.shape[1]), np.ones(x.shape[1]))[:, :-1]
    want = np.exp(-((x[:, None] - x[None]) ** 2).sum(2) / (2 * qm.WIDTH**2))
    assert np.abs(f @ f.T - want).max() < 0.12


def test_odd_texts_no_labels_empty(spark, corpus):
    docs, labels = corpus
    more = spark.createDataFrame([(9000, None, 1.0), (9001, "", 1.0), (9001, "", 1.0), (9002, "z" * 100000, 1.0)], docs.schema)
    rows = qm.scored(docs.unionByName(more), labels).where("doc_id >= 9000").collect()
    assert len(rows) == 4 and len({r.score for r in rows if r.doc_id == 9001}) == 1
    assert {r.score for r in qm.scored(docs, labels.limit(0)).collect()} == {0.5}
    assert {r.score for r in qm.scored(docs, labels.where("quality = 1")).collect()} == {1.0}
    assert qm.scored(docs.limit(0), labels).collect() == []
    assert qm.scored(docs.limit(5), labels.withColumn("quality", F.lit(None).cast("int"))).count() == 5
