import hashlib
import re

import numpy as np
import pytest

from tesserae.llm import piece_codec

TEXTS = ["", None, " a", "  ", "a  b\n\x00é　x\t", "\n\n \nx", "▁▁a ▁ b", "  two  leading", "Ünïcödé 日本語 🙂 text", "aaaaaaaa" * 50, "the cat\nsat. The End!!", "ab " * 2000, "same", "same", "x" * 5000 + " y", "1,234.5 %%% ### |"]


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=piece_codec.model_path())


def test_equals_library(spark, docs_of, library):
    got = {r.doc_id: r for r in piece_codec.digests(docs_of(TEXTS)).collect()}
    for i, t in enumerate(TEXTS):
        ids = library.encode(t or "")
        assert got[i].n_tokens == len(ids), t
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_equals_library_on_table(spark, sf, library):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: r for r in piece_codec.digests(docs).collect()}
    for r in docs.collect():
        ids = library.encode(r.text)
        assert (got[r.doc_id].n_tokens, got[r.doc_id].ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())


def test_spans_cover_the_text(spark, docs_of):
    texts = ["  Ünï  日🙂 x\n", "plain words here", ""]
    for r in piece_codec.encode(docs_of(texts)).collect():
        raw = texts[r.doc_id].encode()
        assert len(r.ids) == len(r.starts) == len(r.ends)
        assert all(a <= b for a, b in zip(r.starts, r.ends, strict=True))
        if raw:
            assert r.starts[0] == 0 and r.ends[-1] == len(raw)
            raw.decode()
            assert all(raw[a:b].decode(errors="strict") is not None for a, b in zip(r.starts, r.ends, strict=True))


def test_decode_undoes_encode(spark, docs_of):
    texts = ["  a b", "日本 🙂", "line\nline", ""]
    back = {r.doc_id: r.text for r in piece_codec.decode(piece_codec.encode(docs_of(texts))).collect()}
    assert back == dict(enumerate(texts))


def made_map():
    import struct

    # a trie with the rules "a" -> "x" and "ab" -> "yz", written by hand
    units = [0] * 1024
    strings = b"x\0yz\0"

    def unit(label, offset, leaf=False):
        return label | leaf << 8 | offset << 10

    units[0] = unit(0, 256)
    base = 256
    units[base ^ ord("a")] = unit(ord("a"), 512, True)
    at = base ^ ord("a") ^ 512
    units[at] = 0x80000000
    units[at ^ ord("b")] = unit(ord("b"), 128, True)
    units[at ^ ord("b") ^ 128] = 0x80000000 | 2
    blob = struct.pack("<I", 4096) + struct.pack("<1024I", *units) + strings
    return piece_codec.CharacterMap(blob)


def test_character_map_takes_the_longest_rule():
    m = made_map()
    assert m.longest(b"abc", 0) == (2, b"yz")
    assert m.longest(b"ac", 0) == (1, b"x")
    assert m.longest(b"c", 0) is None


def test_both_merges_agree():
    m = piece_codec.load(piece_codec.model_path())
    for w in ["▁theation", "▁▁▁▁x", "▁aaaaaaaaaaaaa", "▁Ünïcödé", "▁日本語", "x", "▁123,456.00", "▁ththat!!"]:
        assert m._merge_short(w) == m._merge_long(w)


def test_empty_table(spark, docs_of):
    assert piece_codec.digests(docs_of(["a"]).limit(0)).collect() == []


def test_digests_go_through_the_map():
    """With rules "a" -> "x" and "ab" -> "yz": ids of the replaced text, spans of the original one."""
    import numpy as np

    with open(piece_codec.model_path(), "rb") as f:
        data = f.read()
    plain, m = piece_codec.PieceModel(data), piece_codec.PieceModel(data)
    m.map = made_map()
    for text in ["abc a b", "éab aab\n ba", "no rule here", "", "a", "日ab本", "b" * 90 + "ab" * 50]:
        normal, origin = m.origins(text)
        long, by_byte = m.normalise(text)
        assert normal == long and origin.tolist() == [by_byte[len(long[:k].encode())] for k in range(len(long) + 1)]
        assert m.encode(text) == plain.encode(text.replace("ab", "yz").replace("a", "x"))
        spans = m.encode_with_spans(text)
        assert m.digest(text)[0] == len(spans) and m.digest(text)[2] == hashlib.sha256(np.array([x[1:] for x in spans], "<i8").tobytes()).hexdigest()


def test_rows_without_or_with_one_id(spark):
    docs = spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "c"), (2, "w " * 100_000)], "doc_id long, text string")
    rows = piece_codec.digests(docs).collect()
    assert len(rows) == 4 and len({r.ids_sha256 for r in rows}) == 3


def test_kept_units_stay_when_the_table_is_full(monkeypatch):
    m = piece_codec.PieceModel(open(piece_codec.model_path(), "rb").read())
    monkeypatch.setattr(piece_codec, "CACHE_UNITS", 4)
    merged, merge = [], m.merge
    monkeypatch.setattr(m, "merge", lambda unit: merged.append(unit) or merge(unit))
    text = " ".join(["same words here"] + [f"other{i} same words here" for i in range(40)])
    want = m.encode_with_spans(text)
    merged.clear()
    n, ids, spans, _ = m.digest(text)
    assert (n, ids) == (len(want), hashlib.sha256(",".join(str(k) for k, _, _ in want).encode()).hexdigest())
    assert spans == hashlib.sha256(np.array([s[1:] for s in want], "<i8").tobytes()).hexdigest()
    assert merged.count("▁same") == 1 and max(len(m.cache), len(m.older)) <= 4


def test_a_word_is_one_unit_with_or_without_a_full_stop():
    m = piece_codec.load(piece_codec.model_path())
    assert m.units("one word. A word") == ["▁one", "▁word", ".", "▁A", "▁word"]
    assert m.units("m². x.y ..") == ["▁m².", "▁x", ".y", "▁.."]
    for text in ("m². x.y .. 3.14 a...b é.", "x²..", "²."):
        assert m.encode(text) == [k for u in re.findall(r"▁[^▁]*", m.origins(text)[0]) for p in m.merge(u) for k in m.ids_of(p)]
