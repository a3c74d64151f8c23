import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tesserae.llm import ngram_lm as lm


def tokens(t):
    return re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + ["\0end"]


def brute(texts):
    uni, bi, tri, followers = Counter(), Counter(), Counter(), Counter()
    for i, t in enumerate(texts):
        if zlib.crc32(str(i).encode()) % 7 != 2:
            w = tokens(t)
            uni.update(w)
            bi.update(zip(["\0start", *w[:-1]], w, strict=True))
            bi["\0start", "\0start"] += 1
            x = ["\0start", "\0start", *w, "\0after"]
            tri.update(zip(x, x[1:], x[2:], strict=False))
    for u, v, _ in tri:
        followers[u, v] += 1
    n, v, starts = sum(uni.values()), len(uni), uni["\0end"]
    near = lambda p: float(lm.PROBABILITY[lm.probability_code(np.array([p]))[0]])
    out = {}
    for i, t in enumerate(texts):
        w, base, score = tokens(t), 0.0, 0.0
        for z, a, b in zip(["\0start", "\0start", *w[:-2]][: len(w)], ["\0start", *w[:-1]], w, strict=True):
            p = (uni[b] + 1) / (n + v + 1)
            c = starts if a == "\0start" else uni[a]
            base += math.log10(p)
            two = (bi[a, b] + lm.STRENGTH * p) / (c + lm.STRENGTH)
            term = near((tri[z, a, b] - lm.DISCOUNT) / bi[z, a]) if tri[z, a, b] else 0.0
            left = near(lm.DISCOUNT * followers[z, a] / bi[z, a]) if bi[z, a] else 1.0
            score += math.log10(min(1.0, term + left * two))
        out[i] = (zlib.crc32(str(i).encode()) % 7 == 2, len(w), sum(uni[x] > 0 for x in w), n, pytest.approx(base, abs=1e-6), pytest.approx(score, abs=1e-6))
    return out


def corpus():
    r = random.Random(3)
    vocab = [f"Wört{i}" for i in range(60)]
    return [" ".join(r.choice(vocab[: r.choice([5, 60])]) for _ in range(r.randrange(1, 40))) for _ in range(80)] + ["", None, " \n", "new words only", "a" * 5000]


@pytest.mark.parametrize("chunk", [None, 700])
def test_against_brute_force(spark, docs_of, chunk):
    texts = corpus()
    got = {r.doc_id: (r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in lm.scored(docs_of(texts), chunk).collect()}
    assert got == brute(texts)


def test_better_than_base_on_held_out_texts(spark, sf):
    rows = [r for r in lm.scored(spark.read.parquet(f"{sf}/documents.parquet")).collect() if r.held_out]
    assert rows and sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_elias_fano():
    r = np.random.default_rng(0)
    for n, top in ((1, 5), (1000, 2000), (1000, 2**50), (5, 0), (3000, 2**63)):
        x = np.sort(r.integers(0, top + 1, n, dtype=np.uint64))
        e = lm.EliasFano(*lm.EliasFano.pack(x))
        assert (e.at(np.arange(n)) == x).all()
        q = np.concatenate((x, r.integers(0, top + 1, 500, dtype=np.uint64)))
        assert (e.successor(q, np.zeros(len(q), int), np.full(len(q), n)) == np.searchsorted(x, q, "left")).all()
    assert lm.EliasFano(*lm.EliasFano.pack(np.zeros(0, np.uint64))).n == 0


def test_trie():
    r = np.random.default_rng(1)
    pairs = sorted({(int(a), int(b)) for a, b in zip(r.integers(0, 50, 2000) * 10**9, r.integers(0, 2**lm.BITS, 2000), strict=True)})
    v, w = (np.array([p[k] for p in pairs], np.uint64) for k in (0, 1))
    count = r.integers(1, 64, len(v))
    t = lm.Trie.build(v, w, count)
    total = {x: int(count[v == x].sum()) for x in set(v.tolist())}
    kinds = {x: int((v == x).sum()) for x in total}
    c = t.locate(v)
    left, counts = t.of_contexts(c)
    assert (t.find(c, w) == lm.probability_code(np.array([(n - lm.DISCOUNT) / total[x] for n, x in zip(count.tolist(), v.tolist(), strict=True)]))).all()
    assert (left == lm.probability_code(np.array([lm.DISCOUNT * kinds[x] / total[x] for x in v.tolist()]))).all() and (counts == lm.quantise(np.array([total[x] for x in v.tolist()]))).all()
    assert not t.find(c, w ^ np.uint64(1 << (lm.BITS - 1))).any() and (t.locate(v + np.uint64(1)) == -1).all()
    assert not lm.Trie.build(v[:0], w[:0], count[:0]).find(np.array([-1]), w[:1]).any()


def test_followers_of_a_context_sum_to_one():
    r = np.random.default_rng(2)
    count = r.integers(1, 9, 30)
    t = lm.Trie.build(np.full(30, 7, np.uint64), np.arange(30, dtype=np.uint64), count)
    c = t.locate(np.full(30, 7, np.uint64))
    assert lm.PROBABILITY[t.find(c, np.arange(30, dtype=np.uint64))].sum() + lm.PROBABILITY[t.of_contexts(c)[0][0]] == pytest.approx(1, abs=0.03)


def test_shared_and_null_ids_repeated_rows_and_one_large_text(spark):
    rows = [(1, "a b c"), (1, "d e"), (None, "a b c"), (None, None), (4, "a b c"), (4, "a b c"), (5, "x y z " * 60_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for chunk in (None, 10):
        got = lm.scored(docs, chunk).collect()
        assert sorted(r.n_tokens for r in got) == [1, 3, 4, 4, 4, 4, 180_001]
        assert len({round(r.score, 9) for r in got if r.n_tokens == 4}) == 1 and all(r.mean_score == r.score / r.n_tokens <= 0 for r in got)


def test_codes():
    c = np.array([1, 2, 64, 65, 1000, 10**8])
    back = lm.CODEBOOK[lm.quantise(c)]
    assert (back[:3] == c[:3]).all() and (np.abs(back / c - 1) < 0.06).all()


def test_empty(spark, docs_of):
    assert lm.scored(docs_of(["a"]).limit(0)).collect() == []
