import re

import pytest

from tesserae.llm import quality_rules as qr


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0d]+", text)
    seen = {}
    for i in range(len(w) - 7):
        seen.setdefault(tuple(w[i : i + 8]), []).append(i)
    cover = {k for v in seen.values() if len(v) > 1 for i in v for k in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0d]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(cover)


TEXTS = ["", None, " \n\t\x0b", "a b c", "one two three four five six seven eight " * 3, "x" * 10000, "é|日<>#*$%& a\n\nb\nb\n b\nb ", "a " * 50, " ".join(str(i) for i in range(60)) + " 3 4 5 6 7 8 9 10 11 zz 0 1 2 3 4 5 6 7 8", "w1 w2\r\nw1 w2\r\n", "dup line here\ndup line here\ndup line here", " ".join(map(str, range(4000))) + " " + " ".join(map(str, range(100, 300)))]


def test_statistics(spark, docs_of):
    rows = {r.doc_id: tuple(r[c] for c in qr.BASE) for r in qr.statistics(docs_of(TEXTS)).collect()}
    assert rows == {i: brute(t) for i, t in enumerate(TEXTS)}


def test_statistics_on_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = {r.doc_id: brute(r.text) for r in docs.collect()}
    assert {r.doc_id: tuple(r[c] for c in qr.BASE) for r in qr.statistics(docs).collect()} == want


@pytest.fixture(scope="module")
def junk(spark):
    good = [f"plain words of document number {i} that says nothing much at all but says it in rather many words indeed {i * 7}" for i in range(60)]
    bad = [f"buy ### now *** {i} ### cheap %%% deal $$$ offer ### yes *** call %%% me $$$ today ### or *** never {i} ###" for i in range(40)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(good + bad)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 60)) for i in range(100)] + [(None, 1), (5000, None)], "doc_id long, quality int")
    return docs, labels


def test_learns_an_ordered_list(spark, junk):
    docs, labels = junk
    rules = qr.learn(qr.statistics(docs), labels)
    assert rules and all(1 <= len(r) <= qr.MAX_CONDITIONS for r in rules)
    rows = {r.doc_id: r for r in qr.judged(docs, labels).collect()}
    assert len(rows) == 100 and all(rows[i].kept == (i < 60) for i in range(100) if not rows[i].base_failed)
    assert sorted(r.doc_id for r in qr.kept(docs, labels).collect()) == sorted(i for i in rows if rows[i].kept)


def test_the_list_is_applied_in_order(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 0.0), (0.0, 0.0)], "a double, b double")
    e = qr.expression([[("a", ">", 2.0)], [("a", "<=", 1.0), ("b", ">", 4.0)]])
    assert [r[0] for r in df.select(e).collect()] == [False, False, True]
    assert df.select(qr.expression([])).first()[0] is True


def test_without_labels_and_empty(spark, junk):
    docs, labels = junk
    none = labels.where("quality = 7")
    assert qr.learn(qr.statistics(docs), none) == []
    assert qr.learn(qr.statistics(docs), labels.where("quality = 1")) == []
    assert qr.judged(docs.limit(0), labels).collect() == []
    r = qr.judged(spark.createDataFrame([(1, None), (1, "a b")], "doc_id long, text string"), none).collect()
    assert len(r) == 2 and not any(x.kept for x in r) and all(x.base_failed for x in r)
