import hashlib
import random

import numpy as np
import pytest

from tesserae.llm import suffix


def brute(texts, length):
    raws = [(t or "").encode() for t in texts]
    seen = {}
    for r in raws:
        for i in range(len(r) - length + 1):
            seen[r[i : i + length]] = seen.get(r[i : i + length], 0) + 1
    out = {}
    for k, r in enumerate(raws):
        gone = np.zeros(len(r) + 1, bool)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[0]) if len(r) else 0
        out[k] = (len(r), int(gone.sum()), spans, hashlib.sha256(bytes(b for b, g in zip(r, gone, strict=False) if not g)).hexdigest())
    return out


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé ") for _ in range(r.randrange(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(r.randrange(10, 160)) for _ in range(6)]
    out = []
    for _ in range(50):
        parts = [r.choice(shared) if r.random() < 0.4 else text(r.randrange(1, 60)) for _ in range(r.randrange(1, 5))]
        t = list(" ".join(parts))
        for _ in range(r.choice([0, 0, 1, 3])):
            t[r.randrange(len(t))] = "Z"
        out.append("".join(t))
    out += ["", None, "short", "a" * 1500, "ab" * 700, "a" * 399, "b" * 400, "c" * 401, out[0], out[0], "日本" * 150, "x" + "日本" * 150]
    return out


def run(docs, length):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.digests(docs, length).collect()}


@pytest.mark.parametrize(("seed", "length"), [(1, 400), (2, 100), (3, 40)])
def test_against_brute_force(spark, docs_of, seed, length):
    texts = corpus(seed)
    assert run(docs_of(texts), length) == brute(texts, length)


def test_hot_anchors_and_small_pieces(spark, docs_of, monkeypatch):
    monkeypatch.setattr(suffix, "HOT", 2)
    monkeypatch.setattr(suffix, "PIECE", 257)
    monkeypatch.setattr(suffix, "SORT_BYTES", 3000)
    texts = corpus(4)
    assert run(docs_of(texts), 100) == brute(texts, 100)


def test_merge_sort_and_common_extension():
    r = random.Random(0)
    texts = [bytes(r.choice(b"ab") for _ in range(r.randrange(4, 40))) for _ in range(300)]
    c = suffix.Contexts(texts, np.full(300, 3), np.array([i % 5 for i in range(300)]))
    got = c.order(True)
    assert got.tolist() == sorted(range(300), key=lambda i: (i % 5, texts[i][3:], i))
    a, b = np.arange(299), np.arange(1, 300)
    for x, n in zip(a, c.common(a, b, True), strict=True):
        s, t = texts[x][3:], texts[x + 1][3:]
        assert n == next((k for k, (p, q) in enumerate(zip(s, t, strict=False)) if p != q), min(len(s), len(t)))


def test_colliding_hashes_are_verified(monkeypatch):
    from tesserae.llm.common import Prefix

    texts = [bytes(random.Random(i).choices(b"abcdefgh", k=40)) for i in range(6)]
    texts.append(texts[0])
    c = suffix.Contexts(texts, np.full(7, 0), np.zeros(7, np.int64))
    whole = Prefix.span
    monkeypatch.setattr(c, "reach", lambda forward: np.full(7, 40))
    monkeypatch.setattr(Prefix, "span", lambda self, s, e: whole(self, s, e) % np.uint64(3))
    ctx, at = c.repeated(np.full(7, 21), 20)
    assert sorted(set(ctx.tolist())) == [0, 6]


def test_text_form(spark, docs_of):
    a = "é" * 250
    rows = {r.doc_id: r for r in suffix.without_repeats(docs_of([f"first {a} end", f"other {a} tail", "clean", None])).collect()}
    assert rows[0].text == "firstend" and rows[1].text == "othertail"  # the spaces beside the passage repeat too
    assert rows[2].text == "clean" and rows[3].text is None and rows[0].score == "x"


def test_empty_and_repeated_rows(spark, docs_of):
    d = docs_of(["q" * 500])
    assert suffix.digests(d.limit(0)).collect() == []
    twice = suffix.digests(docs_of(["abc " * 30 + str(i) for i in range(1)]).unionByName(docs_of(["abc " * 30 + "0"])), 100).collect()
    assert [r.n_removed for r in twice] == [121, 121]


def test_planted_passages(spark, docs_of):
    """400 bytes and more go, shorter ones stay; n_shared tells every passage of 300 bytes that stands in two texts."""
    r = random.Random(9)
    text = lambda n: "".join(r.choice("abcdefghij ") for _ in range(n))
    sizes = [150, 199, 300, 330, 399, 400, 401, 700, 2000]
    planted = [text(n) for n in sizes]
    texts = [f"{text(r.randrange(50, 900))}{k}{p}{k + 5}{text(r.randrange(50, 900))}" for p in planted for k in range(3)] + [text(900) for _ in range(5)] + [(x := text(250)) + "y" + x, None, "x" * 5000]
    rows = {x.doc_id: x for x in suffix.digests(docs_of(texts)).collect()}
    for i, n in enumerate(sizes):
        for k in range(3):
            own = rows[3 * i + k]
            assert (own.n_removed >= n) if n >= 400 else own.n_removed == 0
            assert own.n_shared > 0 if n >= suffix.PASSAGE + suffix.STEP - 1 else n >= suffix.PASSAGE or own.n_shared == 0
    assert [rows[i].n_shared for i in range(27, 35)] == [0] * 8 and rows[34].n_removed == 5000
    # against brute force: picked strings are the smallest of each STEP neighbours
    import collections

    owners = collections.defaultdict(set)
    for i, t in enumerate(texts):
        b = (t or "").encode()
        h = [suffix.mix(np.array([suffix.Prefix(np.frombuffer(b, np.uint8)).span(k, k + suffix.PASSAGE)]))[0] >> suffix.POS << suffix.POS for k in range(min(len(b) - suffix.PASSAGE + 1, 1200))] if len(b) < 1200 else []
        for k in range(len(h) - suffix.STEP + 1):
            best = min(range(k, k + suffix.STEP), key=lambda j: (h[j], j))
            owners[b[best : best + suffix.PASSAGE]].add(i)
    for s in owners.values():
        if len(s) > 1:
            assert all(rows[i].n_shared > 0 for i in s)


def test_null_and_shared_ids_and_clashing_names(spark):
    a, b = "abc def " * 40 + "one", "q r s t u " * 40 + "two"
    rows = [(None, a, 1, "k"), (None, a, 2, "k"), (7, b, 3, "k"), (7, "different", 4, "k"), (8, b, 5, "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans int, tkey string")
    got = suffix.digests(docs, 100).collect()
    assert len(got) == 5 and sum(r.n_removed == r.n_bytes for r in got) == 4 and sum(r.doc_id is None for r in got) == 2
    out = suffix.without_repeats(docs, 100)
    assert out.columns == docs.columns and sorted((r.spans, r.tkey, r.text) for r in out.collect()) == [(1, "k", ""), (2, "k", ""), (3, "k", ""), (4, "k", "different"), (5, "k", "")]
