"""Distances of sources against plain Python, and cases that real tables have."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tesserae.llm import divergence

LETTERS = re.compile("[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+")
SCHEMA = "doc_id long, text string, lang string, source string, term string, value long"


def brute(rows, min_docs, top):
    docs = [(lang or "", source or "", [w.translate({c: c + 32 for c in range(65, 91)}) for w in LETTERS.findall(text or "")]) for text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        seen, counts, total = Counter(), defaultdict(Counter), Counter()
        for _, source, words in own:
            seen.update(set(words))
            counts[source].update(words)
            total.update(words)
        kept = sorted(w for w, n in seen.items() if n >= min_docs)
        share = lambda c, n: 1 + 10**9 * (c + 2) // (n + 2 * len(kept))  # noqa: B023, E731
        p = {s: [share(c[w], sum(c[k] for k in kept)) for w in kept] for s, c in counts.items()}
        q = [share(total[w], sum(total[k] for k in kept)) for w in kept]
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in p:
            pairs = sorted((-sum(map(f, p[s], p[o])), o) for o in p if o != s)
            out += [(lang, s, "pair", o, -v, k) for k, (v, o) in enumerate(pairs, 1)]
            terms = sorted((-f(a, b), w.encode()) for a, b, w in zip(p[s], q, kept, strict=True) if counts[s][w] and a > b)[:top]
            out += [(lang, s, "term", w.decode(), -v, k) for k, (v, w) in enumerate(terms, 1)]
    return sorted(out)


def got(spark, rows, **given):
    df = spark.createDataFrame([(i, *r, "x", 1) for i, r in enumerate(rows)], SCHEMA)
    return sorted(tuple(r) for r in divergence.audit(df, **given).select("lang", "source", "part", "item", "value", "rank").collect())


def corpus(seed, n=120):
    r = np.random.default_rng(seed)
    words = [f"{a}{b}" for a in ("ba", "É", "zu", "Xy", "ñe") for b in "abcdefgh"]
    make = lambda: " ".join(words[min(int(k), 39)] + ("!", "")[int(k) % 2] for k in r.exponential(8, r.integers(0, 40)))
    return [(make(), ("en", "de")[i % 2], ("hot", f"s{i % 5}")[i % 3 > 0]) for i in range(n)]


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(divergence, "TILE", 2)
    rows = corpus(1)
    assert got(spark, rows, min_docs=4, top=5) == brute(rows, 4, 5)


def test_nulls_ties_and_groups_without_terms(spark):
    rows = [(None, None, "a"), ("", None, None), ("one one two", "en", "a"), ("one one two", "en", "a"), ("ONE two\x00two", "en", "b"), ("rare", "en", "c"), ("été 12 Été", "fr", "x"), ("x" * 300_000 + " one", "en", "c")]
    assert got(spark, rows, min_docs=2, top=10) == brute(rows, 2, 10)
    assert got(spark, rows, min_docs=50, top=10) == brute(rows, 50, 10)
    assert got(spark, [], min_docs=2) == []


def test_many_equal_values(spark):
    rows = [(" ".join(f"w{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(300)), "en", "a")] * 3 + [("other words only", "en", "b")] * 3
    assert got(spark, rows, min_docs=2, top=10) == brute(rows, 2, 10)


@pytest.mark.parametrize("block", [64, 128])
def test_blocks_change_nothing(spark, monkeypatch, block):
    monkeypatch.setattr(divergence, "BLOCK", block)
    rows = corpus(block) + [(" ".join(f"t{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(j, 200)), "en", f"s{j % 3}") for j in range(0, 60, 5)]
    assert got(spark, rows, min_docs=2, top=7) == brute(rows, 2, 7)
