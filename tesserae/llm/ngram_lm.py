"""Trigram language model in Elias-Fano tries, one per shard of the contexts, and scores of all texts.

Texts are grouped into chunks of about CHUNK_BYTES by a hash of doc_id. A chunk sends its distinct words and trigrams, with
their training counts, to shards; a shard adds up the counts of all chunks, builds its trie and answers each chunk with
codes per trigram and context (and a count per word), in the order the chunk asked. Equal trigrams travel once per chunk, so
no word, however frequent, makes a large group, and nothing passes through the driver. Words lie in at most WORD_SHARDS
shards, trigrams in as many as keep a shard small; a chunk sends rows only to shards it has trigrams for, so rows never
outgrow the trigrams.

A trie's levels lie in one memory map (an anonymous one, as executors share no local disk). They are: contexts, a sequence in
Elias-Fano form; for each the quantised count of the bigram that it is, and the quantised share of probability that is left
for unseen followers; monotone pointers to its followers, in Elias-Fano form too; the followers, as a sequence made monotone
by the context's rank, each with one byte, its quantised smoothed probability. High parts stay bit vectors, searched through
a directory of one number per 512 bits. A follower is found by successor search between its context's pointers.

P(w | u v) = (c(u v w) - DISCOUNT) / c(u v) + left(u v) * P(w | v), left(u v) = DISCOUNT * followers(u v) / c(u v), 1 for
contexts not seen; the first term and left are what the trie stores, in steps of PROB_STEP in the logarithm.
P(w | v) = (c(v w) + STRENGTH * P(w)) / (c(v) + STRENGTH), P(w) = (c(w) + 1) / (N + V + 1). A text begins after two start
marks and ends with an end token; a mark after that, which is not scored, makes every bigram some trigram's context.

Cases: null and empty texts are a lone end token; repeated rows count and are scored as often as they occur; rows with one
doc_id, or with none, are rows of their own; very long texts are scored whole, in a chunk that is as much longer; without
training rows all counts are 0; an empty table gives an empty result; other columns are ignored. Hashes are told apart within
their shard, which a hash's highest bits choose: words by 48 further bits, contexts by 40, a context's followers by 32 in all
(fewer in shards of over 2 billion contexts).
"""

from __future__ import annotations

import mmap
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import mix, shuffle_partitions, unified, words_of

CHUNK_BYTES = 8 << 20
WORD_SHARDS = 1024
STRENGTH, DISCOUNT = 60.0, 0.7
#: Bits that travel of a word, a context and a follower.
WORD_BITS, CONTEXT_BITS, BITS = 48, 40, 32
START, END, AFTER = np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344), np.uint64(0xA4093822299F31D0)
EXACT, STEP, PROB_STEP = 64, 1.1, 0.09
SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, mean_score double"


# -- levels -----------------------------------------------------------------------------------------------------------
class Bits:
    """A bit vector with a directory of the ones before every 512 bits."""

    SLICE = 1 << 16

    def __init__(self, packed):
        raw = np.frombuffer(packed, np.uint8)
        self.words = np.zeros(-(-max(len(raw), 1) // 64) * 8, np.uint64)
        self.words.view(np.uint8)[: len(raw)] = raw
        ones = np.bitwise_count(self.words).reshape(-1, 8).sum(1, dtype=np.int64)
        self.ones = np.concatenate(([0], np.cumsum(ones)))
        self.zeros = 512 * np.arange(len(self.ones)) - self.ones

    def select(self, k: np.ndarray, bit: int) -> np.ndarray:
        """Places of the k-th (from 0) ones or zeros."""
        return np.concatenate([self._select(k[i : i + self.SLICE], bit) for i in range(0, max(len(k), 1), self.SLICE)])

    def _select(self, k: np.ndarray, bit: int) -> np.ndarray:
        directory = self.ones if bit else self.zeros
        block = np.searchsorted(directory, k, "right") - 1
        words = self.words.reshape(-1, 8)[block]
        if not bit:
            words = ~words
        sums = np.cumsum(np.bitwise_count(words), axis=1, dtype=np.int64)
        rest = k - directory[block]
        word = (sums <= rest[:, None]).sum(1)
        at = np.arange(len(k))
        rest -= np.where(word > 0, sums[at, np.maximum(word - 1, 0)], 0)
        x, place = words[at, word], (block * 8 + word) * 64
        for half in (32, 16, 8, 4, 2, 1):
            low = x & np.uint64((1 << half) - 1)
            n = np.bitwise_count(low).astype(np.int64)
            beyond = rest >= n
            rest -= np.where(beyond, n, 0)
            place += np.where(beyond, half, 0)
            x = np.where(beyond, x >> np.uint64(half), low)
        return place


class EliasFano:
    """A sequence that never falls: low parts in planes of bytes, high parts as the gaps of a bit vector."""

    def __init__(self, low, high, n: int, width: int):
        self.n, self.width = n, width
        self.low = np.frombuffer(low, np.uint8).reshape(width // 8, n)
        self.high = Bits(high)
        self.top = int(self.high.select(np.array([n - 1]), 1)[0]) - (n - 1) if n else -1

    @staticmethod
    def pack(values: np.ndarray) -> tuple[bytes, bytes, int, int]:
        n = len(values)
        top = int(values[-1]) if n else 0
        width = max(0, (top // max(n, 1)).bit_length() - 1) + 7 & ~7
        high = (values >> np.uint64(width)).astype(np.int64) if width < 64 else np.zeros(n, np.int64)
        unary = np.zeros((int(high[-1]) if n else 0) + n + 1, np.uint8)
        unary[high + np.arange(n)] = 1
        planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : width // 8].T)
        return planes.tobytes(), np.packbits(unary, bitorder="little").tobytes(), n, width

    def _low(self, i: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i), np.uint64)
        for k in range(self.width // 8):
            out |= self.low[k][i].astype(np.uint64) << np.uint64(8 * k)
        return out

    def at(self, i: np.ndarray) -> np.ndarray:
        high = (self.high.select(np.asarray(i, np.int64), 1) - i).astype(np.uint64)
        return (high << np.uint64(self.width) if self.width < 64 else 0) | self._low(i)

    def successor(self, x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """First place in [lo, hi) whose value is x or more; hi where there is none."""
        h = (x >> np.uint64(self.width)).astype(np.int64) if self.width < 64 else np.zeros(len(x), np.int64)
        inside = np.clip(h, 0, max(self.top, 0))
        # values with x's high part lie between two zeros of the bit vector
        after = np.where(h > self.top, self.n, self.high.select(inside, 0) - inside)
        first = np.where(h > self.top, self.n, np.where(h > 0, self.high.select(np.maximum(inside - 1, 0), 0) - (inside - 1), 0))
        end = np.minimum(hi.astype(np.int64), after)
        at, end = np.minimum(np.maximum(lo.astype(np.int64), first), end), end
        low = x & np.uint64((1 << self.width) - 1)
        live = np.flatnonzero(at < end)
        while len(live):
            mid = (at[live] + end[live]) // 2
            less = self._low(mid) < low[live]
            at[live[less]] = mid[less] + 1
            end[live[~less]] = mid[~less]
            live = live[at[live] < end[live]]
        return np.maximum(at, np.minimum(lo, hi))


def _mapped(*parts: bytes) -> list[memoryview]:
    """The parts in one memory map."""
    area = mmap.mmap(-1, max(1, sum(map(len, parts))))
    out, at = [], 0
    for p in parts:
        area[at : at + len(p)] = p
        out.append(memoryview(area)[at : at + len(p)])
        at += len(p)
    return out


class Trie:
    """Contexts with two codes each, pointers, and followers with a code each."""

    def __init__(self, contexts, pointers, followers, left: bytes, counts: bytes, probs: bytes, bits: int):
        maps = _mapped(*contexts[:2], *pointers[:2], *followers[:2], left, counts, probs)
        self.contexts, self.pointers, self.followers = (EliasFano(*maps[2 * k : 2 * k + 2], *x[2:]) for k, x in enumerate((contexts, pointers, followers)))
        self.left, self.counts, self.probs = (np.frombuffer(m, np.uint8) for m in maps[6:])
        self.bits = bits

    @classmethod
    def build(cls, v: np.ndarray, w: np.ndarray, count: np.ndarray) -> Trie:
        """From pairs of context and follower sorted by (v, w), each once."""
        first = np.flatnonzero(np.concatenate(([True], v[1:] != v[:-1]))) if len(v) else np.zeros(0, np.int64)
        many = np.diff(np.append(first, len(v)))
        rank = np.repeat(np.arange(len(first)), many)
        total = np.add.reduceat(count, first) if len(first) else np.zeros(0, np.int64)
        bits = min(BITS, 63 - max(1, len(first).bit_length()))
        below = rank.astype(np.uint64) << np.uint64(bits) | w >> np.uint64(BITS - bits)
        pointers = np.append(first, len(v)).astype(np.uint64)
        left, probs = probability_code(DISCOUNT * many / np.maximum(total, 1)), probability_code((count - DISCOUNT) / np.maximum(total[rank], 1))
        return cls(EliasFano.pack(v[first]), EliasFano.pack(pointers), EliasFano.pack(below), left.tobytes(), quantise(total).tobytes(), probs.tobytes(), bits)

    def locate(self, v: np.ndarray) -> np.ndarray:
        """Rank of each context, -1 where the trie lacks it."""
        n = self.contexts.n
        if not n or not len(v):
            return np.full(len(v), -1, np.int64)
        c = self.contexts.successor(v, np.zeros(len(v), np.int64), np.full(len(v), n))
        there = c < n
        there[there] = self.contexts.at(c[there]) == v[there]
        return np.where(there, c, -1)

    def of_contexts(self, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of what is left and of the count; 0 where there is no context."""
        if not self.contexts.n:
            return np.zeros(len(c), np.uint8), np.zeros(len(c), np.uint8)
        return np.where(c < 0, 0, self.left[c]).astype(np.uint8), np.where(c < 0, 0, self.counts[c]).astype(np.uint8)

    def find(self, c: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Code of the probability of each follower of the contexts of these ranks, 0 where the trie lacks it."""
        out = np.zeros(len(c), np.uint8)
        known = np.flatnonzero(c >= 0)
        if not len(known):
            return out
        c = c[known]
        lo, hi = self.pointers.at(c).astype(np.int64), self.pointers.at(c + 1).astype(np.int64)
        x = c.astype(np.uint64) << np.uint64(self.bits) | w[known] >> np.uint64(BITS - self.bits)
        p = self.followers.successor(x, lo, hi)
        there = p < hi
        there[there] = self.followers.at(p[there]) == x[there]
        out[known[there]] = self.probs[p[there]]
        return out


def quantise(count: np.ndarray) -> np.ndarray:
    above = EXACT + np.round(np.log(np.maximum(count, EXACT) / EXACT) / np.log(STEP))
    return np.where(count <= EXACT, count, np.minimum(above, 255)).astype(np.uint8)


def probability_code(p: np.ndarray) -> np.ndarray:
    """1 for 1, and one more for every PROB_STEP that the logarithm falls."""
    return np.clip(1 + np.round(-np.log(np.maximum(p, 1e-300)) / PROB_STEP), 1, 255).astype(np.uint8)


#: By code; 0 is for what is not there.
PROBABILITY = np.concatenate(([0.0], np.exp(-PROB_STEP * np.arange(255))))
CODEBOOK = np.concatenate((np.arange(EXACT + 1.0), EXACT * STEP ** np.arange(1, 256 - EXACT)))


# -- what chunks ask ---------------------------------------------------------------------------------------------------
class Asked:
    """The distinct words and trigrams of a chunk of texts; trigrams in the order of (context, word)."""

    def __init__(self, texts: list[bytes], shards: int):
        words, per = words_of(texts)
        self.shards, self.per = shards, per + 1
        ends = np.cumsum(self.per) - 1
        token = np.empty(len(words) + len(per), np.uint64)
        own = np.ones(len(token), bool)
        own[ends] = False
        token[own] = words
        token[ends] = END
        self.word, self.word_of = np.unique(token, return_inverse=True)
        # each text between two start marks and a mark after its end
        text_at = np.cumsum(self.per + 3) - (self.per + 3)
        seq = np.full(len(token) + 3 * len(per), START, np.uint64)
        place = np.arange(len(token)) + np.repeat(text_at + 2 - (ends + 1 - self.per), self.per)
        seq[place] = token
        seq[text_at + self.per + 2] = AFTER
        del words, token, own, place
        begins = np.ones(len(seq), bool)
        begins[text_at + self.per + 1] = False
        begins[text_at + self.per + 2] = False
        at = np.flatnonzero(begins)
        context = mix(seq[at] * np.uint64(0x9E3779B97F4A7C15) + seq[at + 1])
        w = seq[at + 2] >> np.uint64(64 - BITS)
        del seq, begins, at
        order = np.lexsort((w, context))
        context, w = context[order], w[order]
        new_context = np.concatenate(([True], context[1:] != context[:-1])) if len(context) else np.zeros(0, bool)
        new = new_context | np.concatenate(([True], w[1:] != w[:-1])) if len(context) else new_context
        self.trigram_of = np.empty(len(order), np.int32)
        self.trigram_of[order] = np.cumsum(new) - 1
        self.context_of = (np.cumsum(new_context) - 1)[new].astype(np.int32)
        self.context, self.w = context[new_context], w[new]

    def counts(self, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each word and trigram among the texts to train on."""
        return np.bincount(self.word_of[np.repeat(train, self.per)], minlength=len(self.word)), np.bincount(self.trigram_of[np.repeat(train, self.per + 1)], minlength=len(self.w))

    def rows(self, chunk: int, train: np.ndarray):
        word_n, n = self.counts(train)
        word_cut = _cuts(self.word, min(self.shards, WORD_SHARDS))
        cut = _cuts(self.context, self.shards)
        many = np.bincount(self.context_of, minlength=len(self.context))
        below = np.concatenate(([0], np.cumsum(many)))
        none = np.zeros(0, np.int64)
        for s in np.union1d(np.arange(len(word_cut) - 1), np.flatnonzero(np.diff(cut))).tolist():
            x, y = (word_cut[s], word_cut[s + 1]) if s < len(word_cut) - 1 else (0, 0)
            p, q = cut[s], cut[s + 1]
            i, j = below[p], below[q]
            yield (s, chunk, narrow(_within(self.word[x:y], len(word_cut) - 1, WORD_BITS), WORD_BITS), _small(word_n[x:y] if y > x else none), narrow(_within(self.context[p:q], self.shards, CONTEXT_BITS), CONTEXT_BITS), _small(many[p:q]), narrow(self.w[i:j]), _small(n[i:j]))


def _within(values: np.ndarray, shards: int, bits: int) -> np.ndarray:
    """The given number of bits of sorted hashes of one shard, after those that all of the shard share."""
    if not len(values):
        return values
    span = 2**64 // shards
    below = values - np.uint64(min(int(values[0]) // span, shards - 1) * span)
    return below >> np.uint64(max(0, (2**64 - (shards - 1) * span - 1).bit_length() - bits))


def _cuts(values: np.ndarray, shards: int) -> np.ndarray:
    """Where each shard's part of sorted 64-bit numbers begins, and the end."""
    edges = np.arange(1, shards, dtype=np.uint64) * np.uint64(2**64 // max(shards, 2))
    return np.concatenate(([0], np.searchsorted(values, edges), [len(values)]))


def narrow(x: np.ndarray, bits: int = BITS) -> bytes:
    """Numbers byte by byte in planes: sorted ones compress well so."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : bits // 8].T).tobytes()


def wide(b: bytes, bits: int = BITS) -> np.ndarray:
    planes = np.frombuffer(b, np.uint8).reshape(bits // 8, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : bits // 8] = planes.T
    return out.view("<u8").ravel().astype(np.uint64)


def _packed(codes: np.ndarray) -> bytes:
    """Codes, few of which are frequent, as they travel."""
    return zlib.compress(codes.tobytes(), 1)


def _small(n: np.ndarray) -> bytes:
    """Counts in the fewest bytes; the first byte tells how many."""
    kind = next(k for k in (np.uint8, np.uint32, np.uint64) if not len(n) or n.max() <= np.iinfo(k).max)
    return bytes([np.dtype(kind).itemsize]) + n.astype(kind).tobytes()


def _large(b: bytes) -> np.ndarray:
    return np.frombuffer(b, f"<u{b[0]}", offset=1).astype(np.int64)


def _added(keys: list[np.ndarray], counts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of keys (last key first in order) with positive counts, summed."""
    some = counts > 0
    keys, counts = [k[some] for k in keys], counts[some]
    order = np.lexsort(keys[::-1])
    keys, counts = [k[order] for k in keys], counts[order]
    if not len(counts):
        return keys, counts
    new = np.concatenate(([True], np.any([k[1:] != k[:-1] for k in keys], axis=0)))
    first = np.flatnonzero(new)
    return [k[first] for k in keys], np.add.reduceat(counts, first)


def _answers(rows: pd.DataFrame) -> pd.DataFrame:
    """One shard: adds up, builds the trie, answers each chunk."""
    words = [wide(x, WORD_BITS) for x in rows["words"]]
    (word,), total = _added([np.concatenate(words)], np.concatenate([_large(x) for x in rows["word_n"]]))
    context, many, w = [wide(x, CONTEXT_BITS) for x in rows["context"]], [_large(x) for x in rows["many"]], [wide(x) for x in rows["w"]]
    keys, counts = _added([np.repeat(np.concatenate(context), np.concatenate(many)), np.concatenate(w)], np.concatenate([_large(x) for x in rows["n"]]))
    trie = Trie.build(keys[0], keys[1], counts)
    del keys, counts
    # all chunks' questions at once
    asked = np.concatenate(words)
    at = np.searchsorted(word, asked)
    at_in = np.minimum(at, max(len(word) - 1, 0))
    own = np.where(word[at_in] == asked, total[at_in], 0) if len(word) else np.zeros(len(asked), np.int64)
    c = trie.locate(np.concatenate(context))
    left, count = trie.of_contexts(c)
    probs = trie.find(np.repeat(c, np.concatenate(many)), np.concatenate(w))
    cut = lambda x, parts: np.split(x, np.cumsum([len(p) for p in parts])[:-1])
    return pd.DataFrame({
        "chunk": rows["chunk"].to_numpy(), "shard": rows["shard"].to_numpy(), "word_n": [_small(x) for x in cut(own, words)], "left": [_packed(x) for x in cut(left, context)],
        "counts": [_packed(x) for x in cut(count, context)], "probs": [_packed(x) for x in cut(probs, w)], "n_total": int(total.sum()), "n_distinct": len(word),
    })


_ASK = "shard int, chunk int, words binary, word_n binary, context binary, many binary, w binary, n binary"
_ANSWER = "chunk int, shard int, word_n binary, left binary, counts binary, probs binary, n_total long, n_distinct long"


def _texts(pdf: pd.DataFrame) -> list[bytes]:
    return [t.encode() if isinstance(t, str) else b"" for t in pdf["text"]]


def scored(docs: DataFrame, chunk_bytes: int | None = None) -> DataFrame:
    """Base and model log10 probabilities of each row, and the model's per token; trained on the rows whose crc32(doc_id) mod
    7 is not 2."""
    docs = unified(docs)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_chunks = max(1, -(-size // (chunk_bytes or CHUNK_BYTES)))
    shards = max(shuffle_partitions(docs.sparkSession), n_chunks)
    held = (F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(7)) == 2).alias("held_out")
    rows = docs.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_chunks)).cast("int").alias("chunk"), "doc_id", "text", held)

    def ask(pdf):
        asked = Asked(_texts(pdf), shards)
        return pd.DataFrame(asked.rows(int(pdf["chunk"].iloc[0]), ~pdf["held_out"].to_numpy(bool)), columns=["shard", "chunk", "words", "word_n", "context", "many", "w", "n"])

    def score(pdf, got):
        asked = Asked(_texts(pdf), shards)
        got = got.sort_values("shard")
        code = lambda name: np.frombuffer(b"".join(map(zlib.decompress, got[name])), np.uint8)
        c = np.concatenate([_large(x) for x in got["word_n"]])[asked.word_of]
        total, distinct = int(got["n_total"].sum()), int(got["n_distinct"].sum())
        single = (c + 1) / (total + distinct + 1)
        first = np.cumsum(asked.per) - asked.per
        before = np.empty(len(c), float)
        before[1:] = c[:-1]
        before[first] = c[first + asked.per - 1]  # as many end tokens as start marks were trained on
        # a text has one trigram more than tokens; the bigram that ends with a token is the next trigram's context
        place = np.arange(len(c)) + np.repeat(np.arange(len(asked.per)), asked.per)
        trigram = asked.trigram_of[place]
        pair = CODEBOOK[code("counts")[asked.context_of[asked.trigram_of[place + 1]]]]
        two = (np.minimum(pair, before) + STRENGTH * single) / (before + STRENGTH)
        left = code("left")[asked.context_of[trigram]]
        three = PROBABILITY[code("probs")[trigram]] + np.where(left == 0, 1.0, PROBABILITY[left]) * two
        scores = np.add.reduceat(np.log10(np.minimum(three, 1.0)), first)
        return pd.DataFrame({
            "doc_id": pdf["doc_id"], "held_out": pdf["held_out"], "n_tokens": asked.per, "n_known": np.add.reduceat((c > 0).astype(np.int64), first), "train_tokens": total,
            "base_score": np.add.reduceat(np.log10(single), first), "score": scores, "mean_score": scores / asked.per,
        })

    answers = rows.groupBy("chunk").applyInPandas(ask, _ASK).groupBy("shard").applyInPandas(_answers, _ANSWER)
    return rows.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(score, SCHEMA)
