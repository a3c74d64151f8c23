import hashlib

import corpus_pipeline as cp
from tesserae.llm import mixing, piece_codec, quality_rules
from tests.llm.test_quality_rules import brute as words_brute
from tests.llm.test_setjoin import brute as join_brute


def test_stages_against_brute_force(spark, sf):
    raw = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    docs, columns = raw, raw.columns

    verdict = {r.doc_id: r for r in quality_rules.judged(docs, labels).collect()}
    for r in docs.collect():
        n, _, _, _, repeats = words_brute(r.text)
        assert verdict[r.doc_id].base_failed == (n < 20 or 100 * repeats > 30 * n)
    docs = cp.quality(spark, docs, sf).cache()
    assert docs.columns == columns
    assert {r.doc_id for r in docs.collect()} == {i for i, r in verdict.items() if r.kept}

    rows = sorted(docs.collect(), key=lambda r: r.doc_id)
    comp = join_brute([r.text for r in rows], 5, 80)
    docs = cp.near_duplicates(spark, docs, sf).cache()
    assert docs.columns == columns
    assert {r.doc_id for r in docs.collect()} == {r.doc_id for k, r in enumerate(rows) if comp[k][1] == k}

    before = {r.doc_id: r for r in docs.collect()}
    seen = {}
    for r in before.values():
        b = r.text.encode()
        for i in range(len(b) - 199):
            seen[b[i : i + 200]] = seen.get(b[i : i + 200], 0) + 1
    docs = cp.passages(spark, docs, sf).cache()
    assert docs.columns == columns and docs.count() == len(before)
    for r in docs.collect():
        b = before[r.doc_id].text.encode()
        gone = {k for i in range(len(b) - 199) if seen[b[i : i + 200]] > 1 for k in range(i, i + 200)}
        at, want = 0, []
        for c in before[r.doc_id].text:
            if not set(range(at, at + len(c.encode()))) <= gone:
                want.append(c)
            at += len(c.encode())
        assert r.text == "".join(want) and r.n_chars == len(r.text)

    copies = {r.doc_id: r.copies for r in mixing.rates(docs, labels, least=1.0).collect()}
    assert min(copies.values()) >= 1  # nothing is lost
    texts = {r.doc_id: r.text for r in docs.collect()}
    docs = cp.mixture(spark, docs, sf).cache()
    got = {}
    for r in docs.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
    assert docs.columns == columns and got == copies

    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=piece_codec.model_path())
    out = cp.encoded(spark, docs, sf).collect()
    assert len(out) == sum(copies.values())
    for r in out:
        ids = sp.encode(texts[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def test_run_and_empty_documents(spark, sf, tmp_path):
    import shutil

    assert cp.run(spark, sf).count() > 100
    spark.read.parquet(f"{sf}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    shutil.copy(f"{sf}/labels.parquet", f"{tmp_path}/labels.parquet")
    assert cp.run(spark, str(tmp_path)).collect() == []


def test_odd_rows_pass_every_stage(spark, sf):
    """Null and empty texts, null and shared ids, long texts, repeated rows, a passage of 51 words, clashing columns."""
    from pyspark.sql import functions as F

    raw = spark.read.parquet(f"{sf}/documents.parquet").limit(40).withColumn("spans", F.lit(1)).withColumn("rate", F.lit("x"))
    words = [f"wort{i}" for i in range(400)]
    passage = " ".join(words[:51])
    extra = [(None, None), (None, ""), (None, " ".join(words[100:160])), (9001, " ".join(words[160:230])), (9001, " ".join(words[230:300])), (9002, f"{' '.join(words[300:340])} {passage}"),
             (9003, f"{passage} {' '.join(words[340:380])}"), (9004, " ".join(f"w{i}" for i in range(30_000))), (9005, " ".join(words[60:90])), (9005, " ".join(words[60:90]))]
    rows = spark.createDataFrame([(i, t, "de", "s", len(t or ""), 1, "x") for i, t in extra], raw.schema)
    docs = raw.unionByName(rows)
    kept = cp.quality(spark, docs, sf).cache()
    assert kept.columns == docs.columns
    one = cp.near_duplicates(spark, kept, sf).cache()
    assert one.columns == docs.columns and one.where("doc_id = 9005").count() == 1 and one.where("doc_id = 9001").count() == 2 and one.where("doc_id IS NULL").count() == 1
    cut = cp.passages(spark, one, sf).cache()
    assert cut.columns == docs.columns and cut.count() == one.count()
    assert not [r for r in cut.where("doc_id IN (9002, 9003)").collect() if passage in r.text]
    mixed = cp.mixture(spark, cut, sf).cache()
    assert mixed.columns == docs.columns and mixed.distinct().count() == cut.distinct().count()
    assert cp.encoded(spark, mixed, sf).count() == mixed.count()
    for stage in (cp.near_duplicates, cp.passages, cp.mixture):
        assert stage(spark, docs.limit(0), sf).collect() == []
