"""License scans against an edit distance over whole texts, and cases that real tables have."""

import re

import numpy as np
import pytest

from tesserae.llm import licenses
from tesserae.llm.common import table


def brute(text):
    """n_words, n_base, first, last, base labels, labels and score, by every template at every place."""
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = [w.encode() for w in re.findall(licenses.WORD, low)]
    at, base, best = [], set(), []
    for label, t, most in licenses.templates():
        if most < 0:
            hits = [i for i in range(len(words) - len(t) + 1) if words[i : i + len(t)] == t]
            at += hits
            base |= {label} if hits else set()
        else:
            edits, a, b = licenses.closest(t, words)
            if edits <= most:
                best.append((label, 1 - edits / len(t), a, b - 1))
    labels = base | {x[0] for x in best if not any(y[1] > x[1] and y[2] <= x[3] and y[3] >= x[2] for y in best)}
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), 1.0 if base else max((x[1] for x in best), default=0.0)


def got(df):
    return {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, round(r.score, 9)) for r in licenses.scan(df).collect()}


def edited(notice, r, edits):
    words = notice.split()
    for _ in range(edits):
        k = int(r.integers(0, len(words)))
        kind = int(r.integers(0, 3))
        words = words[:k] + ([] if kind == 0 else ["foo"] if kind == 1 else ["bar", words[k]]) + words[k + 1 :]
    return " ".join(words)


def test_against_brute_force(docs_of):
    r = np.random.default_rng(4)
    texts = []
    for label, notice in licenses.BASE + licenses.NOTICES:
        most = len(licenses.split(notice)) // 5
        for edits in range(most + 2):
            texts.append("Some words first. " * int(r.integers(0, 4)) + edited(notice, r, edits) + " and others. " + ("CC BY-NC" if label == "mit" else ""))
    texts += [a + "\n" + b for (_, a), (_, b) in zip(licenses.NOTICES, licenses.NOTICES[1:], strict=False)]
    want = {i: (*brute(t)[:6], round(brute(t)[6], 9)) for i, t in enumerate(texts)}
    assert got(docs_of(texts)) == want
    assert len({w[5] for w in want.values()}) > 12


@pytest.mark.parametrize("label", ["gpl-3", "mit", "apache-2"])
def test_similar_notices_do_not_mix(docs_of, label):
    notice = next(n for name, n in licenses.NOTICES if name == label)
    assert got(docs_of([notice]))[0][5] == label


def test_base_places_and_odd_texts(docs_of):
    texts = [None, "", "cc by", "CC-BY-NC cc by nc by nc", "under the MIT-License under the mit license", "Apache License,\tVersion 2.0", "éunder the mit license", "x " * 30_000 + "cc by nc", "under the mit license under the mit license"]
    assert got(docs_of(texts)) == {i: (*brute(t)[:6], round(brute(t)[6], 9)) for i, t in enumerate(texts)}
    assert got(docs_of([])) == {}


def test_repeated_ids_and_rows(spark):
    rows = [(1, "cc by nc"), (1, "cc by nc"), (1, "nothing here"), (None, "under the mit license"), (None, None)]
    out = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.n_base, r.labels) for r in out) == [("1", 0, ""), ("1", 1, "cc-by-nc"), ("1", 1, "cc-by-nc"), ("None", 0, ""), ("None", 1, "mit")]


def test_whole_table(spark, sf):
    docs = table(spark, sf, "documents")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    want = {i: (*brute(t)[:6], round(brute(t)[6], 9)) for i, t in texts.items() if re.search("licen|cc", t or "", re.I)}
    found = got(docs)
    assert {i: found[i] for i in want} == want and all(v[1:] == (0, None, None, "", "", 0.0) for i, v in found.items() if i not in want)


def test_templates_are_checked():
    with pytest.raises(ValueError):
        licenses.templates([("x", "two words")], [])
    with pytest.raises(ValueError):
        licenses.templates([], [("x", "w " * (licenses.POSITIONS + 1))])
