"""Toxicity scores: a support vector machine on gap-weighted subsequence kernels, with Nystroem landmarks.

The kernel of two strings counts their common subsequences of three letters, each weighted by a decay per letter it spans,
so that insults with inserted or missing letters stay close to the plain ones. Landmarks are learned from labelled texts:
beginnings, ends and wholes of words (with marks for a word's borders) that stand in toxic texts far more often than chance
allows, so rare insults and stems of inflected ones count too. A word is compared to a landmark by its window of about
the landmark's length; a whole landmark also by its longest subsequences, all its letters or all but one, wherever they stand
in the word (see spread), so that letters inserted at any place weigh little. A sentence is the sum of its words' kernel values (a convolution kernel); the Nystroem map turns
that into coordinates, on which a linear machine is trained with labelled sentences (the most suspicious one of each
labelled text). A text scores by its worst sentence, by the evidence of all its sentences and by its length, through a
fitted logistic curve. Words are taken by their letters alone; runs of single letters, and two neighbours that together look
like a landmark's whole word, count as one word.

Labels are used only from rows whose crc32(doc_id) mod 5 is not 0. Cases: null and empty texts, and texts without letters,
have no evidence; very long words are seen by their ends; repeated rows get equal scores; a null doc_id is held out or not
by the crc32 of an empty text; a doc_id labelled twice counts by its larger label; without labels of both classes every
score is 0; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import SPACE_CLASS, chunks, located_words, released, stage, unified, unstage

ORDER, DECAY = 3, 0.8
#: Similarities are raised to this power (a product of kernels is a kernel), which sets near misses apart from chance likeness.
POWER = 4
#: Landmarks at most, of which the CANDIDATES with most evidence are looked at.
N_LANDMARKS, CANDIDATES = 256, 4096
#: Forms of toxic texts' words, the most frequent, that are counted among clean ones too.
FORMS = 50_000
#: Letters of a landmark that is a beginning or end of words; of one that is a whole word.
STEM, WHOLE = (4, 10), (3, 14)
#: Likelihood ratio (G squared) from which a landmark's share among toxic texts is no chance, and the least texts.
EVIDENCE, LEAST_TEXTS = 24.0, 4
#: Hashes of which near copies share one.
ALIKE = 6
#: Odds of a landmark's word to stand in a toxic text, over those of any word.
ODDS = 3.0
#: Weight of each other letter between a whole landmark's letters, of a word that lacks one of them, and how many other
#: letters may differ from each other.
GAP, MISSING, EXTRA = 0.97, 0.9, 2
#: Kernel values below this count as 0; a word is compared to landmarks with which it shares most letters.
FLOOR, SHARED = 0.5, 0.7
#: At most about this many labelled rows of each class are learned from (chosen by a hash of doc_id).
LABELLED = 6_000
CACHE_WORDS = 1_500_000
BATCH_BYTES = 8 << 20
_LETTERS = re.compile(r"[\W\d_]+")
_BEGIN, _END = ord("^"), ord("$")
#: Letters that a window has more than the landmark.
_MORE = (0, 2)


def _codes(words: list[str]) -> np.ndarray:
    """Letters as numbers, one row per word; 0 fills up."""
    width = max(map(len, words), default=1) or 1
    return np.array([w.ljust(width, "\0") for w in words] or ["\0"], f"U{width}").view(np.uint32).reshape(-1, width)[: len(words)]


def kernel(words: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Subsequence kernel of each row of words with the same row of others (a single row of others: with that)."""
    n, m = words.shape[1], others.shape[1]
    live = [(words[:, i, None] == others) & (others != 0) for i in range(n)]
    zero = np.zeros((len(words), m + 1), np.float32)
    before = [np.ones_like(zero)] + [zero.copy() for _ in range(ORDER - 1)]  # K'_i of the letters so far
    total = np.zeros(len(words), np.float32)
    sq = np.float32(DECAY * DECAY)
    for i in range(n):
        hit = live[i]
        total += (hit * before[ORDER - 1][:, :-1]).sum(1) * sq
        new = before[:1]
        for k in range(1, ORDER):
            run = np.zeros(len(words), np.float32)
            row = np.zeros_like(zero)
            for j in range(m):
                run = run * np.float32(DECAY) + hit[:, j] * before[k - 1][:, j] * sq
                row[:, j + 1] = before[k][:, j + 1] * np.float32(DECAY) + run
            new.append(row)
        before = new
    return total


def _bits(codes: np.ndarray) -> np.ndarray:
    return np.where(codes > 0, np.uint64(1) << (codes.astype(np.uint64) * np.uint64(7) % np.uint64(61)), np.uint64(0))


def _mask(word: str) -> int:
    return int(np.bitwise_or.reduce(_bits(_codes([word])[0]), initial=np.uint64(0)))


class Words:
    """Distinct words by their letters: the first and the last WIDTH of each, and their letters so far as bits."""

    WIDTH = WHOLE[1] + 3

    def __init__(self, words: list[str]):
        self.plain = [_LETTERS.sub("", w) for w in words]
        w = self.WIDTH
        self.length = np.array([len(p) for p in self.plain], np.int64)
        self.head = _codes([p[:w].ljust(w, "\0") for p in self.plain])
        self.tail = _codes([p[-w:].rjust(w, "\0") for p in self.plain])
        self.head_mask = np.bitwise_or.accumulate(_bits(self.head), axis=1)
        self.tail_mask = np.bitwise_or.accumulate(_bits(self.tail)[:, ::-1], axis=1)

    def near(self, core: str) -> list[int]:
        """Words that hold the core's letters (its first ones, and of long words their first ones), or all but one of them,
        and are at most twice as long and a letter."""
        n, mask, first = len(core), np.uint64(_mask(core)), np.uint64(_mask(core[: self.WIDTH // 2]))
        seen = self.head_mask[:, min(2 * n + 1, self.WIDTH) - 1]
        longer = (self.length > n) & (self.length <= 2 * n + 1) & (seen & first == first)
        return np.flatnonzero(longer | ((self.length == n - 1) & (self.length >= STEM[0]) & (seen & ~mask == 0))).tolist()

    def windows(self, landmark: str):
        """(words, codes of a window of each) to compare with the landmark."""
        begin, end = landmark.startswith("^"), landmark.endswith("$")
        core = landmark.strip("^$")
        n, mask = len(core), np.uint64(_mask(core))
        need = max(2, int(np.ceil(SHARED * int(mask).bit_count())))
        reach = min(n + _MORE[-1], self.WIDTH) - 1
        if not begin and not end:
            rows = [(k, p[i : i + n + more]) for k, p in enumerate(self.plain) for more in _MORE for i in range(max(1, len(p) - n - more + 1)) if p]
            if rows:
                yield np.array([k for k, _ in rows]), _codes([x for _, x in rows])
            return
        seen = self.tail_mask if end and not begin else self.head_mask
        near = np.flatnonzero((np.bitwise_count(seen[:, reach] & mask) >= need) & (self.length >= n - 1) & ((self.length <= n + 3) | (begin != end)))
        if not len(near):
            return
        if begin and end:
            out = np.zeros((len(near), n + 5), np.uint32)
            out[:, 0], out[:, 1 : n + 4] = _BEGIN, self.head[near, : n + 3]
            out[np.arange(len(near)), 1 + self.length[near]] = _END
            yield near, out
            return
        mark = np.full((len(near), 1), _BEGIN if begin else _END, np.uint32)
        for more in _MORE:
            yield near, np.hstack((mark, self.head[near, : n + more])) if begin else np.hstack((self.tail[near, self.WIDTH - n - more :], mark))


def spread(core: str, word: str) -> float:
    """The gap weight of the longest subsequences: all letters of core in order in the word, GAP for each letter between or
    around them, of which there are at most EXTRA, or any number of one and the same; or all but one of core's letters and
    no others. 0 where neither holds."""
    n, more = len(core), len(word) - len(core)
    if more == -1:
        k = next((i for i in range(n - 1) if word[i] != core[i]), n - 1)
        return MISSING if word[k:] == core[k + 1 :] else 0.0
    if more < 1:
        return 0.0
    letters = iter(word)
    if not all(c in letters for c in core):
        return 0.0
    if more > EXTRA:
        rest = set(word) - set(core)
        if len(rest) > 1 or (rest and word.replace(next(iter(rest)), "") != core) or (not rest and more > n):
            return 0.0
        if not rest and word != "".join(c * (len(word) // n) for c in core):
            return 0.0
    return GAP**more


def similarities(words: list[str], landmarks: list[str]) -> np.ndarray:
    """Normalised kernel of each word (its letters alone) with each landmark; 0 below FLOOR.

    A landmark's ^ and $ stand for a word's beginning and end; one without either is looked for anywhere in the word.
    """
    out = np.zeros((len(words), len(landmarks)), np.float32)
    if not words:
        return out
    known = Words(words)
    for z, landmark in enumerate(landmarks):
        own = _codes([landmark])
        size = kernel(own, own)[0]
        for rows, codes in known.windows(landmark):
            value = kernel(codes, own)
            some = value > 0
            rows, codes, value = rows[some], codes[some], value[some]
            value = value / np.sqrt(np.maximum(kernel(codes, codes) * size, 1e-12))
            np.maximum.at(out[:, z], rows, np.where(value >= FLOOR, value**POWER, 0))
        core = landmark.strip("^$")
        if len(core) + 2 == len(landmark) and len(core) >= STEM[0]:
            for k in known.near(core):
                out[k, z] = max(out[k, z], spread(core, known.plain[k]))
    return out


class Sentences:
    """Kernel values of all sentences of batches of texts; values of words are kept between batches."""

    def __init__(self, landmarks: list[str]):
        self.landmarks = landmarks
        self.whole = [(z, x[1:-1], int(_mask(x[1:-1]))) for z, x in enumerate(landmarks) if x[0] == "^" and x[-1] == "$"]
        # first letter, last letter and length of whole words that two neighbours may be the parts of
        self.shapes = np.zeros((64, 64, 64), bool)
        for _, x, _ in self.whole:
            self.shapes[ord(x[0]) % 64, ord(x[-1]) % 64, len(x) : min(len(x) + 2, 64)] = True
        self.clear()

    def clear(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.row = np.zeros(0, np.int64)
        self.values = np.zeros((1, len(self.landmarks)), np.float32)  # row 0: no likeness

    def _learn(self, hashes: np.ndarray, words: list[str]) -> None:
        if len(self.known) + len(hashes) > CACHE_WORDS:
            self.clear()
        got = similarities(words, self.landmarks)
        some = got.any(1)
        row = np.zeros(len(hashes), np.int64)
        row[some] = len(self.values) + np.arange(some.sum())
        self.values = np.concatenate((self.values, got[some]))
        known = np.concatenate((self.known, hashes))
        order = np.argsort(known)
        self.known, self.row = known[order], np.concatenate((self.row, row))[order]

    def _joined(self, raw: bytes, data: np.ndarray, start: np.ndarray, end: np.ndarray, text: np.ndarray, row: np.ndarray):
        """(place, word) of runs of single letters, and of neighbours that have a whole landmark's ends, length and letters."""
        out = []
        single = np.flatnonzero((end - start) == 1)
        if len(single) > 2:
            cut = np.flatnonzero(np.concatenate(([True], (single[1:] != single[:-1] + 1) | (text[single[1:]] != text[single[:-1]]), [True])))
            out += [(int(single[a]), raw[start[single[a]] : end[single[b - 1]]].decode()) for a, b in zip(cut[:-1], cut[1:], strict=True) if b - a > 2]
        if self.whole and len(start) > 1:
            size = end[1:] - start[1:] + end[:-1] - start[:-1]
            fits = self.shapes[data[start[:-1]] % 64, data[end[1:] - 1] % 64, np.minimum(size, 63)] & (text[1:] == text[:-1]) & (row[1:] == 0) & (row[:-1] == 0)
            for i in np.flatnonzero(fits).tolist():
                both = raw[start[i] : end[i]] + raw[start[i + 1] : end[i + 1]]
                word = both.decode()
                mask = _mask(word)
                if any(len(x) <= len(word) <= len(x) + 1 and x[0] == word[0] and x[-1] == word[-1] and m & ~mask == 0 for _, x, m in self.whole):
                    out.append((i, word))
        return out

    def of(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, kernel values) of the sentences that have any, and the number of words of each text."""
        hashes, per, start, end = located_words(texts, lower=False)
        raw = b" ".join(texts) + b" "
        text = np.repeat(np.arange(len(texts)), per)
        unique, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.known, unique), max(len(self.known) - 1, 0))
        new = self.known[at] != unique if len(self.known) else np.ones(len(unique), bool)
        if new.any():
            if len(self.known) + new.sum() > CACHE_WORDS:
                new[:] = True  # the table starts anew with all of this batch
            f = first[new]
            self._learn(unique[new], [raw[s:e].decode() for s, e in zip(start[f].tolist(), end[f].tolist(), strict=True)])
        row = self.row[np.searchsorted(self.known, unique)][inverse] if len(unique) else np.zeros(0, np.int64)
        data = np.frombuffer(raw, np.uint8)
        stops = np.isin(data[end - 1], np.frombuffer(b".!?", np.uint8)) if len(end) else np.zeros(0, bool)
        lines = np.cumsum(data == 10)
        new_sentence = np.zeros(len(text), bool)
        if len(text):
            new_sentence[1:] = stops[:-1] | (lines[start[1:]] != lines[start[:-1]]) | (text[1:] != text[:-1])
        sentence = np.cumsum(new_sentence)
        places, rows = [np.flatnonzero(row)], [self.values[row[row > 0]]]
        if joined := self._joined(raw, data, start, end, text, row):
            places.append(np.array([p for p, _ in joined]))
            rows.append(similarities([w for _, w in joined], self.landmarks))
        place, value = np.concatenate(places), np.concatenate(rows)
        if not len(place):
            return place, value, per
        order = np.argsort(place, kind="stable")
        place, value = place[order], value[order]
        s = sentence[place]
        cut = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
        return text[place[cut]], np.add.reduceat(value, cut, axis=0), per

    def profile(self, texts: list[bytes], weights: np.ndarray) -> np.ndarray:
        """What a text is judged by: its worst sentence, all its evidence, that evidence for its length, and its length."""
        text, value, per = self.of(texts)
        margin = value.astype(float) @ weights if len(text) else np.zeros(0)
        worst, total = np.zeros(len(texts)), np.zeros(len(texts))
        np.maximum.at(worst, text, margin)
        np.add.at(total, text, np.maximum(margin, 0))
        return np.stack((np.minimum(worst, 20), np.log1p(total), np.minimum(total / (1 + per / 100), 20), np.log1p(per), np.ones(len(texts))), 1)


def _folds(docs: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """Texts and labels of the rows to learn from; the chosen ids are bounded, so the texts need not move."""
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("y IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("y").alias("y"))
    own = own.where(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) != 0)
    counts = {r.y: r.n for r in own.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = F.lit(0)
    for y, n in counts.items():
        share = F.when(F.col("y") == y, int(1_000_000 * min(1.0, LABELLED / n))).otherwise(share)
    chosen = own.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share)
    return _apart(docs.join(F.broadcast(chosen), "doc_id"))


def _apart(rows: DataFrame) -> DataFrame:
    """One row of each group of copies and near copies with one label, so that words of a text that is there a hundred times
    are no evidence: those that share one of ALIKE smallest hashes of three words, the first by doc_id and text."""
    cut = rows.withColumn("_w", F.array_remove(F.split(F.lower(F.coalesce("text", F.lit(""))), SPACE_CLASS), ""))
    threes = F.transform(F.sequence(F.lit(1), F.greatest(F.size("_w") - 2, F.lit(1))), lambda i: F.xxhash64(F.slice("_w", i, 3)))
    out = cut.withColumn("_h", threes).select("doc_id", "text", "y", *[F.array_min(F.transform("_h", lambda h, k=k: F.xxhash64(h, F.lit(k)))).alias(f"_g{k}") for k in range(ALIKE)])
    for k in range(ALIKE):
        out = out.groupBy("y", f"_g{k}").agg(F.min(F.struct("doc_id", "text", *[f"_g{j}" for j in range(k + 1, ALIKE)])).alias("_r")).select("y", f"_g{k}", "_r.*")
    return out.select("doc_id", "text", "y")


def landmarks_of(rows: DataFrame) -> list[str]:
    """Beginnings (^abcd), ends (abcd$) and wholes (^abcd$) of words whose share among toxic texts is beyond chance; one
    after the other, each with what those before it do not explain."""
    letters = F.regexp_replace(F.lower("text"), r"[^\p{L}\x20\x09-\x0D]+", "")
    words = rows.select("y", F.explode(F.array_distinct(F.filter(F.split(letters, SPACE_CLASS), lambda w: F.length(w) >= WHOLE[0]))).alias("w"))
    counts = stage(words.groupBy("w").agg(F.sum("y").alias("p"), F.count(F.lit(1)).alias("n")), "words")
    size = F.length("w")
    lengths = lambda: F.sequence(F.lit(STEM[0]), F.least(F.lit(STEM[1]), size - 1))
    forms = F.concat(
        F.when(size <= WHOLE[1], F.array(F.concat(F.lit("^"), "w", F.lit("$")))).otherwise(F.array().cast("array<string>")),
        F.when(size > STEM[0], F.concat(F.transform(lengths(), lambda k: F.concat(F.lit("^"), F.substring("w", 1, k))), F.transform(lengths(), lambda k: F.concat(F.right("w", k), F.lit("$"))))).otherwise(F.array().cast("array<string>")),
    )
    total = counts.agg(F.sum("p").alias("p"), F.sum("n").alias("n")).first()
    if not total["n"] or total["p"] in (0, total["n"]):
        return []
    share = total["p"] / total["n"]
    # forms that reach the evidence if no clean text holds them; only those are counted among all words
    least = max(LEAST_TEXTS, math.ceil(EVIDENCE / 2 / -math.log(share)))
    likely = counts.where("p > 0").select("p", F.explode(forms).alias("z")).groupBy("z").agg(F.sum("p").alias("p")).where(F.col("p") >= least)
    likely = likely.orderBy(F.desc("p"), "z").limit(FORMS)
    found = counts.select("n", F.explode(forms).alias("z")).join(F.broadcast(likely), "z").groupBy("z", "p").agg(F.sum("n").alias("n"))
    # at most CANDIDATES forms and FORMS words
    forms_found = {r.z: [r.p, r.n] for r in found.where(F.col("p") * (1 - share) >= ODDS * share * (F.col("n") - F.col("p"))).orderBy(F.desc("p"), "z").limit(CANDIDATES).collect()}
    members = {}
    for r in counts.where("p > 0").orderBy(F.desc("p"), "w").limit(FORMS).collect():
        for z in _forms(r.w):
            if z in forms_found:
                members.setdefault(z, []).append(r)
    unstage(counts)
    out: list[str] = []
    done: set[str] = set()
    while forms_found and len(out) < N_LANDMARKS:
        gain, _, best = max((_evidence(p, n, share), len(z), z) for z, (p, n) in forms_found.items())
        if gain < EVIDENCE:
            break
        core = best.strip("^$")
        if not any(_overlap(core, x.strip("^$")) for x in out):
            out.append(best)
        # what the landmark explains counts for no other form
        for r in members.get(best, []):
            if r.w not in done:
                done.add(r.w)
                for z in _forms(r.w):
                    if z in forms_found:
                        forms_found[z][0] -= r.p
                        forms_found[z][1] -= r.n
        forms_found.pop(best)
    return out


def _forms(w: str) -> list[str]:
    """The same forms of a word as landmarks_of() counts."""
    sizes = range(STEM[0], min(STEM[1], len(w) - 1) + 1)
    return [*([f"^{w}$"] if len(w) <= WHOLE[1] else []), *(f"^{w[:k]}" for k in sizes), *(f"{w[-k:]}$" for k in sizes)]


def _evidence(p: int, n: int, share: float) -> float:
    """G squared of p toxic among n, where the share of toxic ones is given; 0 if they are no more than chance, or too few."""
    if p < LEAST_TEXTS or p <= n * share or p * (1 - share) < ODDS * share * (n - p):
        return 0.0
    return 2 * (p * math.log(p / (n * share)) + ((n - p) * math.log((n - p) / (n * (1 - share))) if n > p else 0.0))


def _overlap(a: str, b: str) -> bool:
    """Whether one contains the other, or the end of one is the beginning of the other, by a stem's least length."""
    n = STEM[0]
    return a in b or b in a or any(a[-k:] == b[:k] or b[-k:] == a[:k] for k in range(n, min(len(a), len(b))))


def train_svm(x: np.ndarray, y: np.ndarray, c: float = 3000.0, rounds: int = 1000) -> tuple[np.ndarray, float]:
    """Linear machine by gradient steps on the squared hinge loss, classes weighted equally."""
    s = np.where(y == 1, 1.0, -1.0)
    w = np.where(y == 1, 0.5 / max((y == 1).sum(), 1), 0.5 / max((y == 0).sum(), 1))
    xb = np.hstack((x, np.ones((len(x), 1))))
    keep = np.append(np.full(x.shape[1], 1.0), 1e-3)
    v = np.zeros(xb.shape[1])
    step = 1.0 / (keep.max() + 2 * c * np.linalg.norm((xb * w[:, None]).T @ xb, 2))
    moved, t = v.copy(), 1.0
    for _ in range(rounds):
        slack = np.maximum(0, 1 - s * (xb @ moved))
        new = moved - step * (keep * moved - 2 * c * xb.T @ (w * s * slack))
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, moved, t = new, new + (t - 1) / t2 * (new - v), t2
    return v[:-1], float(v[-1])


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> dict | None:
    rows = stage(_folds(docs, labels, label), "labelled")
    names = landmarks_of(rows) if rows.select("y").distinct().count() == 2 else []
    if not names:
        unstage(rows)
        return None

    def worst(batches):
        own = Sentences(names)
        for pdf in batches:
            ys = pdf["y"].to_numpy()
            for ids, texts in chunks(range(len(pdf)), pdf["text"].str.lower()):
                best = np.zeros((len(texts), len(names)), np.float32)
                text, value, _ = own.of(texts)
                for k in np.argsort(value.sum(1), kind="stable").tolist():
                    best[text[k]] = value[k]
                yield pd.DataFrame({"y": ys[list(ids)], "x": list(best.astype(float))})

    got = rows.mapInPandas(worst, "y int, x array<double>").toPandas()  # at most 2 * LABELLED rows of fixed length
    x, y = np.array(got["x"].tolist()).reshape(len(got), len(names)), got["y"].to_numpy()
    gram = similarities([z.strip("^$") for z in names], names).astype(float)
    value, vector = np.linalg.eigh((gram + gram.T) / 2)
    good = value > 1e-6
    project = vector[:, good] / np.sqrt(value[good])
    w, _ = train_svm(x @ project, y)
    weights = project @ w

    def profiles(batches):
        own = Sentences(names)
        for pdf in batches:
            ys = pdf["y"].to_numpy()
            for ids, texts in chunks(range(len(pdf)), pdf["text"].str.lower()):
                yield pd.DataFrame({"y": ys[list(ids)], "x": list(own.profile(texts, weights))})

    got = rows.mapInPandas(profiles, "y int, x array<double>").toPandas()  # likewise
    unstage(rows)
    m, y = np.array(got["x"].tolist()), got["y"].to_numpy()
    # logistic curve through the profiles, by Newton steps
    a = np.zeros(m.shape[1])
    weigh = np.where(y == 1, np.sqrt(max((y == 0).sum(), 1) / max((y == 1).sum(), 1)), 1.0)  # between the classes' shares and equal ones
    target = np.where(y == 1, ((y == 1).sum() + 1) / ((y == 1).sum() + 2), 1 / ((y == 0).sum() + 2))
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(m @ a, -30, 30)))
        a = a + np.linalg.solve((m * (weigh * p * (1 - p))[:, None]).T @ m + 1e-2 * np.eye(len(a)), m.T @ (weigh * (target - p)) - 1e-2 * a)
    return {"landmarks": names, "weights": weights, "curve": a}


def scored(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> DataFrame:
    """doc_id, held_out, score and predicted of each row."""
    docs = unified(docs)
    held = (F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(5)) == 0).alias("held_out")
    model = fit(docs, labels, label)
    if model is None:
        return docs.select("doc_id", held, F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))

    @released
    def run(batches):
        own = Sentences(model["landmarks"])
        for pdf in batches:
            flags = pdf["held_out"].to_numpy()
            at = 0
            for ids, texts in chunks(pdf["doc_id"], [t.lower() if isinstance(t, str) else None for t in pdf["text"]], BATCH_BYTES):
                # row by row in a fixed order, so that equal texts score equally in whatever batch
                score = 1 / (1 + np.exp(-np.clip((own.profile(texts, model["weights"]) * model["curve"]).sum(1), -30, 30)))
                yield pd.DataFrame({"doc_id": ids, "held_out": flags[at : at + len(ids)], "score": score, "predicted": (score >= 0.5).astype(int)})
                at += len(ids)

    return docs.select("doc_id", "text", held).mapInPandas(run, "doc_id long, held_out boolean, score double, predicted int")
