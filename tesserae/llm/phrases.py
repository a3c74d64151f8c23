"""Phrases whose words stand together more often than apart, per language.

A phrase of up to `longest` words is a candidate where it occurs at least `threshold` times. Two passes over the texts find
all of them without a table of all n-grams:

1. Tasks hash the n-grams of about TOKENS words (language included) and send, per hash partition, the sorted fingerprints
   with their counts. Partitions merge these summaries as Misra-Gries does: equal fingerprints add up, and beyond its
   capacity a partition subtracts the count that brings it back there. The capacity exceeds SLACK times the partition's mass
   divided by the threshold, so that less than threshold / SLACK is ever subtracted: every frequent n-gram survives, with
   some that are not (their fingerprint is shared, or their count close to the threshold).
2. Survivors are set in a bitmap, at most 2^FILTER_MOST bits. Tasks count the n-grams that it lets pass by their words, and
   the exact counts decide. A fuller bitmap lets more pass and changes no result.

Parts of a frequent phrase are frequent themselves, so that the table of frequent phrases holds all counts that scores and
longer phrases need.

n-grams are grouped within a batch by two 64-bit hashes of different byte codes; a batch where they disagree is counted by
its words instead.

Cases: null text counts as empty, null lang as `und`; texts without words give nothing; repeated rows count as often as they
are; ties are ordered by phrase; very long texts are hashed about BUFFER bytes at a time (cut between words, as pieces go on);
an empty table gives an empty result; doc_id and other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.llm.common import KeyFilter, Prefix, key_filter, mix, released, stage, unstage

#: Words of a batch, bytes that are hashed at once, occurrences of a hash partition, entries of a task's counter.
TOKENS, BUFFER, MASS, ENTRIES = 250_000, 1 << 20, 1 << 23, 100_000
#: Capacity over mass / threshold; bits of a fingerprint within its partition; the filter has 2^FILTER_MOST bits at most.
SLACK, WIDTH, FILTER_MOST = 8, 32, 28
_STEP = np.uint64(0x9FB21C651E98DF25)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_OTHER = np.random.Generator(np.random.PCG64(7)).permutation(256).astype(np.uint8)
#: 1: between words, 2: between pieces.
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = 2


class Words:
    """The words of one batch: hashes (with the language in them), pieces, and where they stand in the lowered bytes."""

    def __init__(self, langs: list[str], texts: list[bytes], checked: bool = False):
        data = _LOWER[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
        kind = _KIND[data]
        gap = kind > 0
        edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
        if not gap[0]:
            edge = np.concatenate(([0], edge))
        self.start, self.end = edge[0::2], edge[1::2]
        breaks = np.flatnonzero(kind == 2)
        self.piece = np.searchsorted(breaks, self.start)
        ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
        self.owner = np.searchsorted(ends, self.start, "right")
        names, code = np.unique(np.array(langs, object), return_inverse=True)
        self.names, self.lang = names, code[self.owner]
        seed = np.array([int.from_bytes(hashlib.blake2b(n.encode(), digest_size=8).digest()) for n in names], np.uint64)[self.lang]
        self.raw = data.tobytes()
        self.hash = self._hashed(data) + seed
        self.check = self._hashed(_OTHER[data]) + seed if checked else None

    def _hashed(self, data: np.ndarray) -> np.ndarray:
        """Hashes of the words, BUFFER bytes at a time, cut where a word begins."""
        out, at = np.zeros(len(self.start), np.uint64), 0
        while at < len(self.start):
            to = max(at + 1, int(np.searchsorted(self.start, self.start[at] + BUFFER)))
            low = self.start[at]
            out[at:to] = mix(Prefix(data[low : self.end[to - 1]]).span(self.start[at:to] - low, self.end[at:to] - low))
            at = to
        return out

    def grams(self, longest: int, of: np.ndarray):
        """(n, first words, hashes) of the n-grams within pieces, for each n."""
        hashed = mix(of)
        for n in range(1, longest + 1):
            if n > 1:
                hashed = mix(hashed[:-1] * _STEP + of[n - 1 :])
            if len(hashed) == 0:
                return
            inside = self.piece[: len(hashed)] == self.piece[n - 1 :]
            yield n, np.flatnonzero(inside), hashed[inside]

    def phrase(self, first: int, n: int) -> bytes:
        return b" ".join(self.raw[a:b] for a, b in zip(self.start[first : first + n].tolist(), self.end[first : first + n].tolist(), strict=True))


def _firsts(ordered: np.ndarray) -> np.ndarray:
    """Where a value begins in a sorted array."""
    return np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])[: len(ordered)])


def _batches(frames, checked: bool = False):
    """Words of about TOKENS words at a time (6 bytes each)."""
    langs, texts, size = [], [], 0
    for batch in frames:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            langs.append(lang)
            texts.append(text)
            size += len(text) + 1
            if size >= 6 * TOKENS:
                yield Words(langs, texts, checked)
                langs, texts, size = [], [], 0
    if texts:
        yield Words(langs, texts, checked)


def packed(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted 32-bit keys as differences and their counts, in planes of bytes."""
    gaps = np.diff(keys, prepend=np.uint32(0)).astype("<u4")
    planes = np.concatenate((gaps.view(np.uint8).reshape(-1, 4).T, counts.astype("<u4").view(np.uint8).reshape(-1, 4).T))
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpacked(data: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data, max_output_size=8 * n), np.uint8).reshape(8, n)
    gaps, counts = (np.ascontiguousarray(planes[a : a + 4].T).view("<u4").ravel() for a in (0, 4))
    return np.cumsum(gaps, dtype=np.uint64).astype(np.uint32), counts.astype(np.int64)


def merged(keys: list, counts: list, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Misra-Gries: the sums of equal keys, at most capacity of them, and what was subtracted from each."""
    key, count = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key, kind="stable")
    key, count = key[order], count[order]
    new = _firsts(key)
    key, count = key[new], np.add.reduceat(count, new) if len(new) else count
    if len(key) <= capacity:
        return key, count, 0
    less = int(np.partition(count, len(count) - capacity - 1)[len(count) - capacity - 1])
    keep = count > less
    return key[keep], count[keep] - less, less


def _given(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))


def summaries(docs: DataFrame, longest: int, bits: int) -> DataFrame:
    """part, n_keys, mass and the packed fingerprints of one batch, per hash partition."""

    @released
    def run(frames):
        for words in _batches(frames):
            key = np.concatenate([h for _, _, h in words.grams(longest, words.hash)] or [np.zeros(0, np.uint64)])
            key >>= np.uint64(64 - WIDTH - bits)
            key.sort()
            new = _firsts(key)
            count, key = np.diff(np.append(new, len(key))), key[new]
            part = (key >> np.uint64(WIDTH)).astype(np.int64)
            own = (key & np.uint64(2**WIDTH - 1)).astype(np.uint32)
            cut = _firsts(part).tolist()
            spans = zip(cut, [*cut[1:], len(part)], strict=False)
            rows = [(int(part[a]), b - a, int(count[a:b].sum()), packed(own[a:b], count[a:b])) for a, b in spans if b > a]
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["part", "n_keys", "mass", "keys"])

    return _given(docs).mapInArrow(run, "part int, n_keys int, mass long, keys binary")


def survivors(summaries: DataFrame, threshold: int) -> DataFrame:
    """key: the fingerprints (partition and 32 bits) of which some n-gram can be frequent."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        capacity = SLACK * int(pdf["mass"].sum()) // threshold + 1
        keys, counts, size, lost = [], [], 0, 0
        for n, data in zip(pdf["n_keys"].tolist(), pdf["keys"], strict=True):
            k, c = unpacked(data, n)
            keys.append(k)
            counts.append(c)
            size += n
            if size > max(capacity, 1 << 20):
                k, c, less = merged(keys, counts, capacity)
                keys, counts, size, lost = [k], [c], len(k), lost + less
        key, count, less = merged(keys, counts, capacity)
        likely = count + lost + less >= threshold
        return pd.DataFrame({"key": (np.int64(pdf["part"].iloc[0]) << WIDTH) | key[likely].astype(np.int64)})

    return summaries.groupBy("part").applyInPandas(run, "key long")


def _grouped(words: Words, n: int, first: np.ndarray, hashed: np.ndarray, check: np.ndarray) -> list[tuple[int, int]] | None:
    """(first word of one, number) of each n-gram; None if the two hashes disagree."""
    order = np.argsort(hashed, kind="stable")
    hashed, check, first = hashed[order], check[order], first[order]
    new = _firsts(hashed)
    many = np.diff(np.append(new, len(hashed)))
    if (check != np.repeat(check[new], many)).any():
        return None
    return list(zip(first[new].tolist(), many.tolist(), strict=True))


def exact_counts(docs: DataFrame, longest: int, bits: int, given: tuple[int, bytes]) -> DataFrame:
    """lang, phrase, words and f of the n-grams that the filter lets pass, and of all words (phrase '', words 0)."""

    @released
    def run(frames):
        likely = KeyFilter(*given)
        found: dict = {}

        def rows():
            if found:
                names, phrases, lengths = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(phrases, pa.binary()), pa.array(lengths, pa.int32()), pa.array(list(found.values()), pa.int64())], names=["lang", "phrase", "words", "f"])

        for words in _batches(frames, True):
            for k, n in enumerate(np.bincount(words.lang, minlength=len(words.names)).tolist()):
                at = (words.names[k], b"", 0)
                found[at] = found.get(at, 0) + n
            for (n, first, hashed), (_, _, check) in zip(words.grams(longest, words.hash), words.grams(longest, words.check), strict=True):
                passed = np.flatnonzero(likely.passes(hashed >> np.uint64(64 - WIDTH - bits)))
                first, hashed, check = first[passed], hashed[passed], check[passed]
                groups = _grouped(words, n, first, hashed, check) or ((f, 1) for f in first.tolist())
                for at, many in groups:
                    name = (words.names[words.lang[at]], words.phrase(at, n), n)
                    found[name] = found.get(name, 0) + many
                if len(found) >= ENTRIES:
                    yield from rows()
                    found.clear()
        yield from rows()

    return _given(docs).mapInArrow(run, "lang string, phrase binary, words int, f long")


def frequent(docs: DataFrame, threshold: int = 100, longest: int = 5) -> DataFrame:
    """lang, phrase, words and f of every phrase of up to longest words that occurs at least threshold times, staged; the row
    with phrase '' has the number of all words."""
    bytes_ = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")).cast("long")).alias("n")).first().n or 0
    bits = min(16, max(4, (longest * bytes_ // 6 // MASS).bit_length()))
    likely = stage(survivors(summaries(docs, longest, bits), threshold), "phrases-survivors")
    given = key_filter(likely, most=FILTER_MOST)
    unstage(likely)
    counted = exact_counts(docs, longest, bits, given).groupBy("lang", "phrase", "words").agg(F.sum("f").alias("f"))
    return stage(counted.where((F.col("words") == 0) | (F.col("f") >= threshold)).withColumn("phrase", F.col("phrase").cast("string")), "phrases-frequent")


def collocations(docs: DataFrame, threshold: int = 100, longest: int = 5, share: int = 100, first: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's first phrases by score, a and phrase.

    The score of a phrase that occurs a times among n words is the least of floor(1000 a n / (l r)) over its cuts into parts
    that occur l and r times. Phrases inside a longer one that is at least share percent as frequent are left out.
    """
    table = frequent(docs, threshold, longest)
    words = F.split("phrase", " ")
    every = table.where("words > 0").select("lang", "phrase", "words", F.col("f").alias("a"))
    candidates = every.where("words > 1")
    part = lambda a, n: F.array_join(F.slice(words, a, n), " ")
    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("words") - n + 1), lambda i: part(i, n))))
    inner = candidates.where("words > 2").select("lang", F.explode(F.array_distinct(spans)).alias("phrase"), "a")
    covered = inner.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    open_ = candidates.join(covered, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("a"))).drop("longer")
    cuts = open_.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.withColumns({"left": part(F.lit(1), F.col("k")), "right": part(F.col("k") + 1, F.col("words"))})
    cuts = cuts.join(every.select("lang", F.col("phrase").alias("left"), F.col("a").alias("l")), ["lang", "left"]).join(every.select("lang", F.col("phrase").alias("right"), F.col("a").alias("r")), ["lang", "right"])
    cuts = cuts.join(table.where("words = 0").select("lang", F.col("f").alias("n")), "lang")
    wide = lambda c: f"cast({c} AS DECIMAL(19,0))"
    cuts = cuts.withColumn("score", F.expr(f"({wide('a')} * {wide('n')} * 1000) div ({wide('l')} * {wide('r')})"))
    scored = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("c"))
    out = scored.select("lang", "phrase", "a", F.col("c.l").alias("l"), F.col("c.r").alias("r"), "n", F.col("c.score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return out.withColumn("rank", rank).where(F.col("rank") <= first).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
