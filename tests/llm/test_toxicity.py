import numpy as np
import pytest

from tesserae.llm import toxicity


def plain(s, t, p=toxicity.ORDER, d=toxicity.DECAY):
    from itertools import combinations

    def subs(x):
        out = {}
        for i in combinations(range(len(x)), p):
            k = tuple(x[j] for j in i)
            out[k] = out.get(k, 0) + d ** (i[-1] - i[0] + 1)
        return out

    a, b = subs(s), subs(t)
    return sum(v * b.get(k, 0) for k, v in a.items())


def test_kernel_is_the_sum_over_subsequences():
    words = ["cat", "cart", "abcabc", "xyz", "ca", "tacocat"]
    got = toxicity.kernel(toxicity._codes(words), toxicity._codes(["cat"]))
    assert got == pytest.approx([plain(w, "cat") for w in words], rel=1e-4)
    c = toxicity._codes(words)
    assert toxicity.kernel(c, c) == pytest.approx([plain(w, w) for w in words], rel=1e-4)


def test_gapped_words_stay_near():
    s = toxicity.similarities(["idiot", "id-iot", "i.d.i.o.t", "idxiot", "i d i o t", "house", "", "idiot" + "q" * 60], ["idiot"])[:, 0]
    assert s[:3] == pytest.approx([1, 1, 1], abs=1e-3) and s[4] == pytest.approx(1, abs=1e-3)
    assert 0.15 < s[3] < 1 and s[5] == s[6] == 0


@pytest.fixture(scope="module")
def corpus(spark):
    r = np.random.default_rng(0)
    syll = ["th", "er", "in", "an", "re", "on", "at", "en"]
    text = lambda: " ".join("".join(r.choice(syll, r.integers(1, 4))) for _ in range(30))
    bad = ["moron", "stupid", "clown"]
    rows = [(i, f"{text()}. {text()} {bad[i % 3] if i % 2 else text()} on", "en", 9) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    return docs, docs.selectExpr("doc_id", "cast(doc_id % 2 AS int) AS toxic").where("doc_id < 300")


def test_held_out_accuracy(spark, corpus):
    rows = toxicity.scored(*corpus).collect()
    assert len(rows) == 400 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert np.mean([r.predicted == r.doc_id % 2 for r in rows if r.held_out or r.doc_id >= 300]) > 0.97


def test_inserted_characters_and_odd_texts(spark, corpus):
    docs, labels = corpus
    more = spark.createDataFrame([(1000, "on re mo-ron an", "x", 1), (1001, "then s t u p i d on", "x", 1), (1002, None, "x", 1), (1003, "", "x", 1), (1004, "on re an", "x", 1), (1004, "on re an", "x", 1)], docs.schema)
    got = {r.doc_id: r.predicted for r in toxicity.scored(docs.unionByName(more), labels).collect()}
    assert [got[i] for i in range(1000, 1005)] == [1, 1, 0, 0, 0]


ALTERED = {
    "one letter in the middle": lambda w: w[:3] + "x" + w[3:], "one after the first": lambda w: w[0] + "k" + w[1:], "one before the last": lambda w: w[:-1] + "q" + w[-1], "doubled": lambda w: w[:2] + w[1:],
    "two letters": lambda w: w[:3] + "xq" + w[3:], "two apart": lambda w: w[:2] + "v" + w[2:4] + "j" + w[4:], "after every letter": lambda w: "".join(c + "x" for c in w), "between all": "x".join, "all doubled": lambda w: "".join(c * 2 for c in w),
    "left out": lambda w: w[:2] + w[3:], "spaced": " ".join, "dots": ".".join, "hyphen": lambda w: w[:3] + "-" + w[3:],
}


def test_altered_insults_are_still_found(spark, corpus):
    docs, labels = corpus
    insults = ["moron", "stupid", "clown"]
    made = [(2000 + i, f"then on re {f(w)} an the. on re the an", "x", 1) for i, (f, w) in enumerate((f, w) for f in ALTERED.values() for w in insults)]
    clean = [(3000 + i, f"then on re {w} an the. on re the an", "x", 1) for i, w in enumerate(["more", "onrem", "cloth", "student", "studio", "clean", "moor", "stud", "crown", "marooned", "cloudenwin", "thereonin"])]
    got = {r.doc_id: r.predicted for r in toxicity.scored(docs.unionByName(spark.createDataFrame(made + clean, docs.schema)), labels).collect()}
    names = [k for k in ALTERED for _ in insults]
    assert not [n for n, row in zip(names, made, strict=True) if not got[row[0]]]
    assert not [row[1] for row in clean if got[row[0]]]


def test_altered_insults_of_held_out_texts(spark):
    """Recall under each alteration of the insults in texts that the model has not seen."""
    import re

    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    docs = docs.select("doc_id", "text").join(labels.select("doc_id"), "doc_id", "left_semi")
    words = ["trash", "worthless", "pathetic", "disgusting", "idiot", "loser", "moron", "scum", "clown", "stupid"]
    find = re.compile(rf"\b({'|'.join(words)})\b", re.I)
    toxic = [r for r in docs.join(labels.where("toxic = 1"), "doc_id").where("crc32(cast(doc_id AS string)) % 5 = 0").select("doc_id", "text").collect() if find.search(r.text)]
    kinds = list(ALTERED)
    more = [(10**9 + 1000 * k + i, find.sub(lambda m, f=f: f(m[0]), r.text)) for k, f in enumerate(ALTERED.values()) for i, r in enumerate(toxic)]
    got = toxicity.scored(docs.unionByName(spark.createDataFrame(more, docs.schema)), labels).where("doc_id >= 1000000000").collect()
    recall = {kinds[k]: np.mean([r.predicted for r in got if (r.doc_id - 10**9) // 1000 == k]) for k in range(len(kinds))}
    assert len(toxic) >= 50 and min(recall.values()) >= 0.9, recall


def test_spread():
    for word, want in (("idiot", 0), ("idxiot", 1), ("xidiot", 1), ("idiotx", 1), ("iidiot", 1), ("idxiqot", 2), ("ixdxixoxt", 4), ("iiddiioott", 5)):
        assert toxicity.spread("idiot", word) == pytest.approx(toxicity.GAP**want if want else 0)
    assert [toxicity.spread("idiot", w) for w in ("idit", "diot", "idio", "idot")] == [toxicity.MISSING] * 4
    assert not any(toxicity.spread("idiot", w) for w in ("toidi", "idt", "iqdwieort", "house", "ideot", "idiqwrot", ""))


def test_without_labels_and_empty(spark, corpus):
    docs, labels = corpus
    assert {r.score for r in toxicity.scored(docs, labels.limit(0)).collect()} == {0.0}
    assert toxicity.scored(docs.limit(0), labels).collect() == []


def test_rare_insults_stems_and_split_words(spark):
    """A hundred insults of which each is in one of a hundred toxic texts, some of them stems; and words in two pieces."""
    r = np.random.default_rng(3)
    letters = list("abcdefghilmnoprstuv")
    insults = ["".join(r.choice(letters, 8)) for _ in range(100)]
    syll = ["th", "er", "in", "an", "re", "on", "at", "en"]
    text = lambda: " ".join("".join(r.choice(syll, r.integers(1, 4))) for _ in range(30))
    word = lambda i: insults[i % 100] + ("".join(r.choice(syll, 2)) if i % 100 < 50 else "")
    rows = [(i, f"{text()} {word(i // 2)} on. {text()} {word(i // 2)}" if i % 2 else f"{text()}. {text()}") for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 AS int) AS toxic")
    split = spark.createDataFrame([(9000 + i, f"then on {insults[i][:3]} {insults[i][3:]} re. then {insults[i][:5]} {insults[i][5:]} on") for i in range(50, 100)], docs.schema)
    got = toxicity.scored(docs.unionByName(split), labels).collect()
    assert np.mean([x.predicted == x.doc_id % 2 for x in got if x.held_out and x.doc_id < 6000]) > 0.97
    assert np.mean([x.predicted for x in got if x.doc_id >= 9000]) > 0.9


def test_held_out_recall_of_each_language(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    docs = docs.join(labels.select("doc_id"), "doc_id", "left_semi")
    rows = toxicity.scored(docs, labels).join(labels.select("doc_id", "toxic"), "doc_id").join(docs.select("doc_id", "lang"), "doc_id").collect()
    for lang in ("en", "de", "fr", "es"):
        own = [r for r in rows if r.held_out and r.lang == lang]
        assert np.mean([r.predicted for r in own if r.toxic]) >= 0.9, lang
        assert np.mean([r.predicted for r in own if not r.toxic]) <= 0.05, lang


def test_null_shared_and_twice_labelled_ids_and_long_words(spark, corpus):
    docs, labels = corpus
    odd = spark.createDataFrame([(None, "you moron on", "x", 1), (1, "a different text", "x", 1), (7000, "z" * 300_000 + " moron", "x", 1)], docs.schema)
    both = labels.unionByName(spark.createDataFrame([(1, 0), (None, 1), (2, None)], labels.schema))
    rows = toxicity.scored(docs.unionByName(odd), both).collect()
    assert len(rows) == 403 and len({r.score for r in rows if r.doc_id == 7000}) == 1
