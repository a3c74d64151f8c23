"""Span digests of whole tables, and passages of just over 50 words."""


def test_span_digests_of_every_text(spark, sf):
    import hashlib
    import struct

    from tesserae.llm import piece_codec

    texts = ["", None, " a", "a  b\n\x00é　x\t", "▁▁a ▁ b", "Ünïcödé 日本語 🙂 text", "x" * 5000 + " y", "1,234.5 %%% ### |", "same", "same"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").unionByName(spark.read.parquet(f"{sf}/documents.parquet").selectExpr("doc_id + 1000 AS doc_id", "text"))
    want = {r.doc_id: [n for pair in zip(r.starts, r.ends, strict=True) for n in pair] for r in piece_codec.encode(docs).collect()}
    got = {r.doc_id: r.spans_sha256 for r in piece_codec.digests(docs).collect()}
    assert got == {k: hashlib.sha256(struct.pack(f"<{len(v)}q", *v)).hexdigest() for k, v in want.items()}
    model = piece_codec.PieceModel(open(piece_codec.model_path(), "rb").read())
    model.squeeze = True  # the general path
    for t in texts:
        flat = [n for _, a, b in model.encode_with_spans(t) for n in (a, b)]
        assert model.digest(t)[2] == hashlib.sha256(struct.pack(f"<{len(flat)}q", *flat)).hexdigest()


def test_passages_of_51_words_are_caught(spark, sf):
    import random

    import corpus_pipeline

    r = random.Random(5)
    words = lambda n: " ".join("".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(n))
    shared = words(51)
    docs = spark.createDataFrame([(1, f"{words(80)} {shared} {words(80)}"), (2, f"{words(80)} {shared} {words(80)}"), (3, words(90))], "doc_id long, text string")
    assert 200 <= len(shared) < 400
    got = {x.doc_id: x.text for x in corpus_pipeline.passages(spark, docs, sf).collect()}
    assert len(got) == 3 and shared not in got[1] and shared not in got[2]
    assert all(len(got[i].split()) <= 161 for i in (1, 2)) and len(got[3].split()) == 90
