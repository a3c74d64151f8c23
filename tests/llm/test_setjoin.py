import random
import re

import numpy as np
import pytest

from tesserae.llm import setjoin


def sets_of(text, n):
    w = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set())


def brute(texts, n, percent):
    sets = [sets_of(t, n) for t in texts]
    up = list(range(len(texts)))
    deg = [0] * len(texts)

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                deg[i] += 1
                deg[j] += 1
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return {i: (len(s), root(i), deg[i]) for i, s in enumerate(sets)}


def corpus(seed, families=12, size=9):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    out = []
    for f in range(families):
        base = [r.choice(vocab) for _ in range(r.choice([1, 2, 3, 5, 20, 60, 200]))]
        for _ in range(size):
            w = base[:]
            for _ in range(r.choice([0, 0, 1, 2, 4, 8]) if len(w) > 5 else r.choice([0, 1])):
                k = r.randrange(len(w))
                r.choice([lambda: w.insert(k, r.choice(vocab)), lambda: w.__setitem__(k, r.choice(vocab)), lambda: w.pop(k) if len(w) > 1 else None])()
            out.append(r.choice([" ", "\n", "  "]).join(w) if r.random() < 0.9 else " ".join(w).upper())
    out += ["", None, "  \t", "one", "One", "one two", "É é", "é é", "a\x00b c d", "the the the the the"]
    return out


@pytest.mark.parametrize(("n", "percent", "seed"), [(3, 90, 1), (5, 80, 2), (1, 50, 3), (3, 90, 4)])
def test_against_brute_force(spark, docs_of, n, percent, seed):
    texts = corpus(seed)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in setjoin.components_of(docs_of(texts), n, percent).collect()}
    assert got == brute(texts, n, percent)


def test_families_by_block(spark, docs_of, monkeypatch):
    monkeypatch.setattr(setjoin, "FAMILY", 3)
    texts = corpus(7)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in setjoin.components_of(docs_of(texts), 3, 90).collect()}
    assert got == brute(texts, 3, 90)


def test_no_linked_pair_lacks_a_common_signature():
    r = np.random.default_rng(0)
    classes = setjoin.Classes(90)
    for _ in range(300):
        size = int(r.integers(1, 400))
        s = np.unique(r.integers(0, 2**63, size, dtype=np.uint64) * np.uint64(2))
        cut = s[int(r.integers(0, max(1, len(s) // 12))) :]
        t = np.unique(np.concatenate((cut, r.integers(0, 2**63, len(s) // 25, dtype=np.uint64))))
        i = len(np.intersect1d(s, t))
        if i and 100 * i >= 90 * (len(s) + len(t) - i):
            assert len(np.intersect1d(classes.signatures(s), classes.signatures(t)))


def test_large_family_search():
    r = np.random.default_rng(5)
    base = np.unique(r.integers(0, 2**63, 300, dtype=np.uint64))
    sets = [np.unique(np.concatenate((np.delete(base, r.integers(0, len(base), 12)), r.integers(0, 2**63, 4, dtype=np.uint64)))) for _ in range(200)]
    _, total = setjoin.links(sets, [1] * 200, list(range(200)), 90)
    want = [sum(1 for j in range(200) if j != i and 100 * (k := len(np.intersect1d(sets[i], sets[j]))) >= 90 * (len(sets[i]) + len(sets[j]) - k)) for i in range(200)]
    assert total == want


def test_one_of_each(spark, docs_of):
    kept = setjoin.one_of_each(docs_of(["a b c d", "A b  c d", "x y z", "", None])).collect()
    assert sorted(r.doc_id for r in kept) == [0, 2, 3, 4]
    assert kept[0].score == "x"


def test_repeated_rows_and_empty(spark, docs_of):
    d = docs_of(["a b c d", "q"])
    rows = setjoin.components_of(d.unionByName(d), 3, 90).collect()
    assert len(rows) == 4 and {r.component_id for r in rows} == {0, 1}
    assert setjoin.components_of(d.limit(0)).collect() == []


def test_shared_and_null_ids(spark):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(1, a), (5, a + " x"), (5, b + " y"), (2, b), (None, a), (None, "alone here now")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in setjoin.components_of(docs, 3, 90).collect()), key=str)
    assert got == sorted([(1, 58, 1, 2), (5, 59, 1, 2), (5, 59, 2, 1), (2, 58, 2, 1), (None, 58, 1, 2), (None, 1, None, 0)], key=str)
    assert sorted(((r.doc_id, r.text) for r in setjoin.one_of_each(docs, 3, 90).collect()), key=str) == sorted([(1, a), (2, b), (None, "alone here now")], key=str)


def test_low_thresholds_find_contained_sets(spark, docs_of):
    w = [f"w{i}" for i in range(20)]
    got = {r.doc_id: r.n_links for r in setjoin.components_of(docs_of([" ".join(w[:10]), " ".join(w), "q r s"]), 1, 50).collect()}
    assert got == {0: 1, 1: 1, 2: 0}
    r = np.random.default_rng(1)
    for percent in (30, 50, 66, 80, 95):
        classes = setjoin.Classes(percent)
        for _ in range(60):
            s = np.unique(r.integers(0, 2**64, int(r.integers(1, 300)), dtype=np.uint64))
            cut = s[r.random(len(s)) < r.uniform(percent / 100 - 0.05, 1)]
            if len(cut) and 100 * len(cut) >= percent * len(s):
                assert len(np.intersect1d(classes.signatures(s), classes.signatures(cut)))


def test_long_lists_chain_no_strangers(spark, docs_of, monkeypatch):
    r = random.Random(11)
    shared = " ".join(f"s{i}" for i in range(60))
    texts = [" ".join([*(f"v{r.randrange(10**6)}" for _ in range(150)), shared]) for _ in range(30)]
    texts += [t + " more" for t in texts[:3]]
    docs = docs_of(texts).selectExpr("doc_id", "xxhash64(text) AS tkey", "text")
    sets = setjoin._profiles(docs, 3).where("size > 0")
    edges = setjoin._edges(docs, 3, 90, np.zeros(0, np.uint64))
    members = edges.where("star").selectExpr("a AS h1", "b AS list")
    assert members.count() > 30  # all share the passage
    found = {frozenset((e.a, e.b)) for e in setjoin._long_lists(members, sets, 90).collect()}
    assert len(found) <= 3  # not the 30 of a star, which made one family of all
    got = {x.doc_id: (x.n_shingles, x.component_id, x.n_links) for x in setjoin.components_of(docs_of(texts), 3, 90).collect()}
    assert got == brute(texts, 3, 90)
    for name, value in (("LEADERS", 2), ("LIST", 5)):  # the rest of such a list is a star
        monkeypatch.setattr(setjoin, name, value)
        assert {x.doc_id: (x.n_shingles, x.component_id, x.n_links) for x in setjoin.components_of(docs_of(texts + corpus(3, 3)), 3, 90).collect()} == brute(texts + corpus(3, 3), 3, 90)


def test_groups_hold_all_pairs_that_may_link():
    r = np.random.default_rng(3)
    base = [np.unique(r.integers(0, 2**64, n, dtype=np.uint64)) for n in (300, 330, 500)]
    sets = [np.unique(np.concatenate((b[r.random(len(b)) > cut], r.integers(0, 2**64, 3, dtype=np.uint64)))) for b in base for cut in (0, 0.02, 0.06, 0.1, 0.3)]
    sizes = np.array([len(s) for s in sets])
    label = setjoin.grouped([setjoin.sketch(s) for s in sets], sizes, 90, 256)
    assert len(set(label.tolist())) > 2
    for i in range(len(sets)):
        for j in range(i):
            if 100 * (k := len(np.intersect1d(sets[i], sets[j]))) >= 90 * (len(sets[i]) + len(sets[j]) - k):
                assert label[i] == label[j]
