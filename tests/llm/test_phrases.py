"""Collocations against plain Python, the summaries' guarantee, and cases that real tables have."""

import re
from collections import Counter

import numpy as np
import pytest

from tesserae.llm import phrases

SCHEMA = "doc_id long, text string, lang string, n long, score long"


def brute(rows, threshold, longest=5, share=100, first=2000):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = (text or "").translate({c: c + 32 for c in range(65, 91)})
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            f.update((lang, tuple(words[i : i + k])) for k in range(1, longest + 1) for i in range(len(words) - k + 1))
    f = {k: v for k, v in f.items() if v >= threshold}
    hidden = {(lang, w[i:j]) for (lang, w), a in f.items() for i in range(len(w)) for j in range(i + 2, len(w) + 1) if j - i < len(w) and 100 * a >= share * f[lang, w[i:j]]}
    out = {}
    for (lang, w), a in f.items():
        if len(w) > 1 and (lang, w) not in hidden:
            score, _, left, right = min((1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
            out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), left, right))
    return sorted((lang, k, p.decode(), -a, le, r, n[lang], -s) for lang, found in out.items() for k, (s, a, p, le, r) in enumerate(sorted(found)[:first], 1))


def got(spark, rows, **given):
    df = spark.createDataFrame([(i, *r, 7, 7) for i, r in enumerate(rows)], SCHEMA)
    return sorted(tuple(r) for r in phrases.collocations(df, **given).collect())


def corpus(seed, n=80, size=60):
    r = np.random.default_rng(seed)
    words, gaps = ["Of", "the", "été", "new", "york", "city", "x1", "(a)", "is", "ÀB"], [" ", "  ", "\t", ". ", ",", "\n", " "]
    return [("".join(words[min(int(k), 9)] + gaps[int(g)] for k, g in zip(r.exponential(3, size), r.integers(0, 7, size), strict=True)) + " New York City hall", ("en", "de", None)[i % 3]) for i in range(n)]


@pytest.mark.parametrize("share", [100, 80])
def test_against_brute_force(spark, share):
    rows = corpus(share)
    want = brute(rows, 8, share=share)
    assert len(want) > 60 and got(spark, rows, threshold=8, share=share) == want


def test_small_batches_and_ranks(spark, monkeypatch):
    for name, value in (("TOKENS", 100), ("MASS", 64), ("BUFFER", 64), ("SLACK", 1), ("ENTRIES", 20), ("FILTER_MOST", 20)):
        monkeypatch.setattr(phrases, name, value)
    rows = corpus(3)
    assert got(spark, rows, threshold=8, first=12) == brute(rows, 8, first=12)


def test_summaries_keep_every_frequent_key():
    r = np.random.default_rng(5)
    stream = np.concatenate((r.integers(0, 50_000, 40_000), np.repeat(r.integers(10**6, 10**7, 30), 200)))
    r.shuffle(stream)
    threshold, keys, counts, lost = 150, [], [], 0
    capacity = len(stream) // threshold + 1
    for part in np.array_split(stream, 40):
        k, c = np.unique(part, return_counts=True)
        k, c, less = phrases.merged([*keys, k], [*counts, c], capacity)
        keys, counts, lost = [k], [c], lost + less
        assert len(k) <= capacity
    assert lost < threshold
    true = Counter(stream.tolist())
    est = dict(zip(keys[0].tolist(), counts[0].tolist(), strict=True))
    assert all(est.get(k, 0) + lost >= n >= est.get(k, 0) for k, n in true.items() if n >= threshold)


def test_packed_round_trip():
    keys = np.array([0, 1, 5, 2**32 - 1], np.uint32)
    k, c = phrases.unpacked(phrases.packed(keys, np.array([1, 70_000, 3, 2**31])), 4)
    assert k.tolist() == keys.tolist() and c.tolist() == [1, 70_000, 3, 2**31]


def test_odd_rows(spark):
    rows = [(None, "en"), ("", None), (" . ,\t", "en"), ("a b a b a b", None), ("a b a b a b", "und"), ("w " * 50_000, "de"), ("one", "fr")]
    assert got(spark, rows, threshold=3) == brute(rows, 3)
    assert got(spark, [], threshold=3) == []


def test_disagreeing_hashes_are_counted_by_words(spark, monkeypatch):
    rows = corpus(9, 30)
    monkeypatch.setattr(phrases, "_grouped", lambda *a: None)
    assert got(spark, rows, threshold=8) == brute(rows, 8)
