"""Removal of byte strings of a given length that occur more than once, by a sparse suffix sort.

A string of L bytes holds a smallest K-gram (its anchor); equal strings have equal anchors at the same place, so only
suffixes at anchors need to be sorted: about 2 per L bytes instead of L.

1. Every text is cut into runs: maximal sequences of L-byte windows with the same anchor. Runs travel as digests of their
   bytes (128 bits of BLAKE2, so that equal digests mean equal bytes).
2. Runs whose anchor occurs once are dropped: nearly all by a bitmap of the repeated anchors' hashes. Runs that are equal throughout are one class: all their windows repeat, and
   one of them stands for the class from here on.
3. The bytes of the classes that share an anchor with another class meet in one bucket. Their suffixes are sorted by a
   merge sort whose comparison finds the common extension by binary search over polynomial prefix hashes; a second sort,
   leftwards from the anchors, does the same for what stands before them. Both orders and all common extensions of
   neighbours are verified byte by byte; where a hash collided, the bytes themselves are sorted. A window that reaches x
   bytes to the left of its anchor repeats where another context shares its interval of either order: x bytes to the
   left, L - x to the right.
4. Anchors with more than HOT classes do not meet in one task: their windows are counted as rows, by two 64-bit hashes of
   different make (polynomial of the bytes, sum of mixed 8-gram hashes).

Passages. digests() also tells where shorter passages stand in several texts: winnowing picks the smallest of each
sequence of STEP hashes of PASSAGE-byte strings; n_shared counts the picked strings that another text holds too, so it
is above 0 wherever PASSAGE + STEP - 1 bytes or more are shared. Nothing is removed for it.

Cases: null and empty texts and texts under L bytes lose nothing; matches do not cross texts; overlapping matches count;
equal rows (even with the same doc_id) are matches of each other; rows with the same or a null doc_id and different texts
are told apart by a hash of the text; very long texts are cut into overlapping pieces; an empty table gives an empty
result; other columns are ignored, or kept whatever their names by without_repeats().
"""

from __future__ import annotations

import hashlib
import os

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import NO_ID, KeyFilter, Prefix, key_filter, mix, released, shuffle_partitions, stage, unified, unstage

GRAM = 32
#: Windows that are looked at together; positions in such a piece fit in POS bits.
PIECE, POS = 1 << 18, np.uint64(20)
#: Classes of one anchor that are sorted in one task; beyond it, windows are counted as rows.
HOT = 4096
#: Bytes of contexts that a task sorts at once.
SORT_BYTES = 4 << 20
#: Bytes of the strings that tell shared passages, and how many of them one is picked from.
PASSAGE, STEP = 200, 101
_SPAN = "doc_id long, tkey long, start long, end long"


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each width consecutive values (block-wise running minima from both sides)."""
    n = len(values) - width + 1
    pad = -len(values) % width
    top = np.full(pad, np.iinfo(np.uint64).max, np.uint64)
    blocks = np.concatenate((values, top)).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def runs(data: np.ndarray, valid: np.ndarray, length: int, prefix: Prefix | None = None) -> tuple[np.ndarray, ...]:
    """first window, number of windows, anchor, hash of the anchor and digest (two numbers) of the runs of valid windows.

    data has length - 1 bytes more than there are windows; valid: the windows to look at.
    """
    gram = min(GRAM, length)
    prefix = prefix or Prefix(data)
    hashes = mix(prefix.grams(gram))
    at = np.arange(len(data) - gram + 1)
    keyed = (hashes >> POS << POS) | at.astype(np.uint64)
    low = sliding_min(keyed, length - gram + 1)
    window = np.flatnonzero(valid)
    if not len(window):
        return (window,) * 6
    anchor = (low[window] & np.uint64((1 << int(POS)) - 1)).astype(np.int64)
    new = np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (window[1:] != window[:-1] + 1)))
    first = np.flatnonzero(new)
    many = np.diff(np.append(first, len(window)))
    start, anchor = window[first], anchor[first]
    raw = data.tobytes()
    size = (many - 1 + length).tolist()
    place = (anchor - start).tolist()
    digest = b"".join([hashlib.blake2b(raw[s : s + n], digest_size=16, salt=p.to_bytes(4, "little")).digest() for s, n, p in zip(start.tolist(), size, place, strict=True)])
    two = np.frombuffer(digest, np.int64).reshape(-1, 2)
    return start, many, anchor, hashes[anchor].view(np.int64), two[:, 0], two[:, 1]


def _pieces(rows, length: int, least: int):
    """Buffers of whole texts of least bytes and pieces of longer ones: (data, (row, offset in the text, first byte, number
    of windows, number of bytes) of each)."""
    parts, where, size = [], [], 0
    for k, text in enumerate(rows):
        if len(text) < least:
            continue
        for at in range(0, max(1, len(text) - length + 1), PIECE):
            count = max(0, min(PIECE, len(text) - length + 1 - at))
            parts.append(text[at : at + count + length - 1])
            where.append((k, at, size, count, len(parts[-1])))
            size += len(parts[-1])
            if size >= PIECE:
                yield b"".join(parts), where
                parts, where, size = [], [], 0
    if parts:
        yield b"".join(parts), where


def picked(data: np.ndarray, first: np.ndarray, size: np.ndarray, prefix: Prefix | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(piece, hash) of the PASSAGE-byte strings that winnowing picks: the smallest hash of every STEP neighbours within a
    piece (of all, if a piece has fewer)."""
    n = len(data) - PASSAGE + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.arange(n)
    inside = np.zeros(len(data) + 1, np.int64)
    np.add.at(inside, first, 1)
    np.add.at(inside, first + np.maximum(size - PASSAGE + 1, 0), -1)
    hashes = mix((prefix or Prefix(data)).grams(PASSAGE))
    keyed = np.where(np.cumsum(inside)[:n] > 0, (hashes >> POS << POS) | at.astype(np.uint64), np.iinfo(np.uint64).max)
    # between two pieces lie PASSAGE - 1 places where no string starts, more than STEP
    edge = np.full(STEP - 1, np.iinfo(np.uint64).max, np.uint64)
    low = sliding_min(np.concatenate((edge, keyed, edge)), STEP)
    low = low[np.concatenate(([True], low[1:] != low[:-1])) & (low != np.iinfo(np.uint64).max)]  # places never fall
    place = (low & np.uint64((1 << int(POS)) - 1)).astype(np.int64)
    return np.searchsorted(first, place, "right") - 1, hashes[place].view(np.int64)


def _run_table(docs: DataFrame, length: int, prints: bool) -> DataFrame:
    """All runs of all texts; with prints also rows with the picked strings of a piece."""
    names = ["doc_id", "tkey", "start", "many", "anchor", "ahash", "r1", "r2", "prints"]

    @released
    def run(batches):
        for pdf in batches:
            ids, keys = pdf["doc_id"].to_numpy(), pdf["tkey"].to_numpy()
            for buffer, where in _pieces((t.encode() if isinstance(t, str) else b"" for t in pdf["text"]), length, min(length, PASSAGE) if prints else length):
                data = np.frombuffer(buffer, np.uint8)
                prefix = Prefix(data)
                k, offset, firsts, counts, sizes = (np.array(x) for x in zip(*where, strict=True))
                if len(data) >= length and counts.any():
                    valid = np.zeros(len(data) - length + 1, bool)
                    for first, count in zip(firsts.tolist(), counts.tolist(), strict=True):
                        valid[first : first + count] = True
                    start, many, anchor, ahash, r1, r2 = runs(data, valid, length, prefix)
                    of = np.searchsorted(firsts, start, "right") - 1
                    yield pd.DataFrame(dict(zip(names, (ids[k[of]], keys[k[of]], start + (offset - firsts)[of], many, anchor - start, ahash, r1, r2, None), strict=True)))
                if prints:
                    of, h = picked(data, firsts, sizes, prefix)
                    cut = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1]))) if len(of) else of
                    if len(cut):
                        row = k[of[cut]]
                        yield pd.DataFrame(dict(zip(names, (ids[row], keys[row], 0, 0, 0, 0, 0, 0, np.split(h, cut[1:])), strict=True)))

    return docs.mapInPandas(run, "doc_id long, tkey long, start long, many int, anchor int, ahash long, r1 long, r2 long, prints array<long>")


def merge_sort(items: np.ndarray, less) -> np.ndarray:
    """Bottom-up merge sort: each element's place is its own rank plus its rank in the run it is merged with, found by
    binary search with the comparison less(a, b), which works on arrays of items; for all elements at once."""
    n, width = len(items), 1
    at = np.arange(n)
    while width < n:
        left = (at // width) % 2 == 0
        base = at // (2 * width) * (2 * width)
        lo = np.where(left, np.minimum(base + width, n), base)
        end = np.where(left, np.minimum(base + 2 * width, n), np.minimum(base + width, n))
        other, hi = lo.copy(), end.copy()
        while True:
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                break
            mid = (lo[open_] + hi[open_]) // 2
            goes = less(items[mid], items[open_])  # the element at mid comes before ours; no two elements are equal
            lo[open_[goes]] = mid[goes] + 1
            hi[open_[~goes]] = mid[~goes]
        own = np.where(left, at - base, at - np.minimum(base + width, n))
        out = np.empty_like(items)
        out[base + own + lo - other] = items
        items = out
        width *= 2
    return items


class Contexts:
    """Byte strings around anchors, in groups with equal anchors."""

    def __init__(self, texts: list[bytes], anchors: np.ndarray, group: np.ndarray):
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        sizes = np.array([len(t) for t in texts], np.int64)
        self.start = np.cumsum(sizes) - sizes
        self.mid, self.end, self.group = self.start + anchors, self.start + sizes, group
        self.prefix = Prefix(self.data)
        self.raw = self.data.tobytes()
        self.sorted: dict[bool, tuple[np.ndarray, np.ndarray]] = {}

    def byte(self, i: np.ndarray, n: np.ndarray, forward: bool) -> np.ndarray:
        """What follows after n bytes of the extension; -1 at its end."""
        at = self.mid[i] + n if forward else self.mid[i] - 1 - n
        inside = at < self.end[i] if forward else at >= self.start[i]
        return np.where(inside, self.data[np.where(inside, at, 0)].astype(np.int64), -1)

    def common(self, a: np.ndarray, b: np.ndarray, forward: bool) -> np.ndarray:
        """Length of the common extension of two suffixes (or, leftwards, prefixes) at their anchors, by binary search."""
        x, y = self.mid[a], self.mid[b]
        lo = np.zeros(len(a), np.int64)
        hi = np.minimum(self.end[a] - x, self.end[b] - y) if forward else np.minimum(x - self.start[a], y - self.start[b])
        span = self.prefix.span
        while (lo < hi).any():
            half = (lo + hi + 1) // 2
            same = span(x, x + half) == span(y, y + half) if forward else span(x - half, x) == span(y - half, y)
            lo, hi = np.where(same, half, lo), np.where(same, hi, half - 1)
        return lo

    def order(self, forward: bool) -> np.ndarray:
        """Contexts sorted by group, then by their extension; equal ones by number."""
        sign = 1 if forward else -1

        def less(a, b):
            out = self.group[a] < self.group[b]
            near = np.flatnonzero(self.group[a] == self.group[b])
            if len(near):
                n = self.common(a[near], b[near], forward)
                p, q = self.byte(a[near], n, forward), self.byte(b[near], n, forward)
                out[near] = (p < q) | ((p == q) & (sign * a[near] < sign * b[near]))
            return out

        return merge_sort(np.argsort(self.group, kind="stable"), less)

    def neighbours(self, forward: bool) -> tuple[np.ndarray, np.ndarray]:
        """The order, and the common extension of each context with the one before it in the order (-1: another group).

        Verified: neighbours are equal for as long as said, and the byte that follows is the smaller one's.
        """
        if forward not in self.sorted:
            order = self.order(forward)
            shared = np.full(len(order), -1, np.int64)
            a, b = order[:-1], order[1:]
            near = np.flatnonzero(self.group[a] == self.group[b])
            a, b = a[near], b[near]
            shared[near + 1] = self.common(a, b, forward)
            self.sorted[forward] = (order, shared) if self._verified(a, b, shared[near + 1], forward) else self._by_bytes(forward)
        return self.sorted[forward]

    def _verified(self, a: np.ndarray, b: np.ndarray, n: np.ndarray, forward: bool) -> bool:
        raw, x, y = self.raw, self.mid[a], self.mid[b]
        if not forward:
            x, y = x - n, y - n
        if any(raw[p : p + k] != raw[q : q + k] for p, q, k in zip(x.tolist(), y.tolist(), n.tolist(), strict=True)):
            return False
        p, q = self.byte(a, n, forward), self.byte(b, n, forward)
        return bool(((p < q) | ((p == q) & (p == -1))).all())

    def _by_bytes(self, forward: bool) -> tuple[np.ndarray, np.ndarray]:
        """The same without hashes."""
        raw, ends = self.raw, list(zip(self.start.tolist(), self.mid.tolist(), self.end.tolist(), strict=True))
        keys = [raw[m:e] if forward else raw[s:m][::-1] for s, m, e in ends]
        group = self.group.tolist()
        order = sorted(range(len(keys)), key=lambda i: (group[i], keys[i]))
        shared = [-1] * len(order)
        for k in range(1, len(order)):
            i, j = order[k - 1], order[k]
            if group[i] == group[j]:
                shared[k] = len(os.path.commonprefix([keys[i], keys[j]]))
        return np.array(order, np.int64), np.array(shared, np.int64)

    def reach(self, forward: bool) -> np.ndarray:
        """The longest extension that each context shares with another of its group: with a neighbour in the order."""
        order, shared = self.neighbours(forward)
        out = np.zeros(len(order), np.int64)
        np.maximum.at(out, order, shared)
        np.maximum.at(out, order[:-1], shared[1:])
        return out

    def repeated(self, windows: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """(context, window) of all windows of length bytes that another context has too. windows: how many each has."""
        right, left = self.reach(True), self.reach(False)
        anchor = self.mid - self.start
        live = np.flatnonzero(right + left >= length)
        if not len(live):
            return live, live
        by_side = []
        for forward in (True, False):
            order, shared = self.neighbours(forward)
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            by_side.append((shared, rank[live]))
        (ahead, rank_ahead), (behind, rank_behind) = by_side
        most, least = np.minimum(anchor, left)[live], np.maximum(np.maximum(anchor - windows + 1, length - right), 0)[live]
        ctx, at = [], []
        for x in range(int(least.min()), int(most.max()) + 1):  # bytes of the window that stand before its anchor
            own = np.flatnonzero((least <= x) & (x <= most))
            if len(own) < 2:
                continue
            # intervals of either order whose members share enough, as numbers
            interval = np.cumsum(ahead < length - x)[rank_ahead[own]] * (len(ahead) + 1) + np.cumsum(behind < x)[rank_behind[own]]
            by = np.argsort(interval, kind="stable")
            same = interval[by][1:] == interval[by][:-1]
            found = live[own[by[np.concatenate(([False], same)) | np.concatenate((same, [False]))]]]
            ctx.append(found)
            at.append(anchor[found] - x)
        if not ctx:
            return live[:0], live[:0]
        ctx, at = np.concatenate(ctx), np.concatenate(at)
        by = np.lexsort((at, ctx))
        return ctx[by], at[by]


def _stretches(ids, keys, starts, length: int) -> pd.DataFrame:
    """Spans covered by windows, which come in order within a text's stretch."""
    if not len(starts):
        return pd.DataFrame({"doc_id": [], "tkey": [], "start": [], "end": []}).astype("int64")
    cut = np.flatnonzero(np.concatenate(([True], (starts[1:] != starts[:-1] + 1) | (ids[1:] != ids[:-1]) | (keys[1:] != keys[:-1]))))
    last = np.append(cut[1:], len(starts)) - 1
    return pd.DataFrame({"doc_id": ids[cut], "tkey": keys[cut], "start": starts[cut], "end": starts[last] + length})


def _sorted_spans(contexts: DataFrame, length: int) -> DataFrame:
    """Spans of repeated windows among contexts that meet at their anchors."""

    def flush(held):
        group = pd.factorize(np.array([r[0] for r in held], np.int64))[0]
        c = Contexts([r[6] for r in held], np.array([r[5] for r in held], np.int64), group)
        ctx, at = c.repeated(np.array([r[4] for r in held], np.int64), length)
        ids, keys, starts = (np.array([r[k] for r in held], np.int64)[ctx] for k in (1, 2, 3))
        return _stretches(ids, keys, starts + at, length)

    @released
    def run(batches):
        held, size = [], 0
        for pdf in batches:
            for r in pdf[["ahash", "doc_id", "tkey", "start", "many", "anchor", "context"]].itertuples(index=False):
                if size >= SORT_BYTES and held[-1][0] != r[0]:
                    yield flush(held)
                    held, size = [], 0
                held.append(r)
                size += len(r[6])
        if held:
            yield flush(held)

    width = shuffle_partitions(contexts.sparkSession)
    return contexts.repartition(width, "ahash").sortWithinPartitions("ahash").mapInPandas(run, _SPAN)


def _counted_spans(contexts: DataFrame, length: int) -> DataFrame:
    """The same for anchors with many classes: windows as rows, counted by two hashes."""

    @released
    def run(batches):
        for pdf in batches:
            for r in pdf[["doc_id", "tkey", "start", "many", "context"]].itertuples(index=False):
                data = np.frombuffer(r[4], np.uint8)
                p, at = Prefix(data), np.arange(r[3])
                short = np.arange(len(data) - 7)
                g = np.zeros(len(short) + 1, np.uint64)
                np.cumsum(mix(p.span(short, short + 8)), out=g[1:])
                yield pd.DataFrame({"h1": mix(p.span(at, at + length)).view(np.int64), "h2": mix(g[at + length - 7] - g[at]).view(np.int64), "doc_id": r[0], "tkey": r[1], "start": r[2] + at})

    rows = contexts.mapInPandas(run, "h1 long, h2 long, doc_id long, tkey long, start long")
    twice = rows.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h1", "h2")
    return rows.join(twice, ["h1", "h2"]).select("doc_id", "tkey", "start", (F.col("start") + length).alias("end"))


def _id() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))


def _keyed(docs: DataFrame) -> DataFrame:
    return unified(docs).select(_id().alias("doc_id"), F.xxhash64("text").alias("tkey"), "text")


def _shared(every: DataFrame) -> DataFrame:
    """(doc_id, tkey, n_shared) of texts with picked strings that another text has too."""
    prints = every.where("prints IS NOT NULL").select("doc_id", "tkey", F.explode("prints").alias("h"))
    owner = F.xxhash64("doc_id", "tkey")
    # a table of its own, so that the join's sides are plain shuffles, whose large keys Spark can split
    known = stage(prints.groupBy("h").agg(F.min(owner).alias("lo"), F.max(owner).alias("hi")).where("lo <> hi").select("h"), "shared")
    out = stage(prints.join(known, "h").groupBy("doc_id", "tkey").agg(F.count(F.lit(1)).alias("n_shared")), "texts-sharing")
    unstage(known)
    return out


def _likely(every: DataFrame) -> DataFrame:
    """The runs whose anchor may occur again. Only the anchors' hashes are shuffled; most runs of texts that are unlike go
    here, before their digests travel."""
    again = stage(every.groupBy(F.col("ahash").alias("key")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"), "anchors")
    given = key_filter(again)
    unstage(again)

    @released
    def run(batches):
        known = KeyFilter(*given)
        for batch in batches:
            yield batch.filter(pa.array(known.passes(batch.column("ahash").to_numpy(zero_copy_only=False))))

    return every.mapInArrow(run, every.schema)


def repeated_spans(docs: DataFrame, length: int = 400, passages: bool = False) -> DataFrame:
    """(doc_id, tkey, start, end): byte spans that windows of length bytes cover which start anywhere else too.

    With passages also (doc_id, tkey, null, null, n_shared). tkey: a hash of the text; a null doc_id is NO_ID.
    """
    keyed = _keyed(docs)
    table = stage(_run_table(keyed, length, passages), "runs")
    every = stage(_likely(table.where("many > 0").drop("prints")), "likely-runs")
    texts_sharing = _shared(table) if passages else None
    unstage(table)
    same = ["ahash", "r1", "r2"]
    classes = every.groupBy(*same).agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("doc_id", "tkey", "start")).alias("rep"))
    anchors = classes.groupBy("ahash").agg(F.sum("copies").alias("total"), F.count(F.lit(1)).alias("classes")).where("total > 1").select("ahash", "classes")
    hits = stage(
        every.join(classes.join(anchors, "ahash"), same)
        .select("doc_id", "tkey", "start", "many", "anchor", "ahash", "copies", "classes", (F.struct("doc_id", "tkey", "start") == F.col("rep")).alias("is_rep")),
        "hits",
    )
    unstage(every)
    full = hits.where("copies > 1").select("doc_id", "tkey", "start", (F.col("start") + F.col("many") - 1 + length).alias("end"))
    asked = (
        hits.where("is_rep AND classes > 1").dropDuplicates(["doc_id", "tkey", "start"])
        .groupBy("doc_id", "tkey").agg(F.collect_list(F.struct("start", "many", "anchor", "ahash", "classes")).alias("asked"))
    )

    @released
    def cut(batches):
        for pdf in batches:
            rows = []
            for doc_id, tkey, text, asked in zip(pdf["doc_id"], pdf["tkey"], pdf["text"], pdf["asked"], strict=True):
                raw = text.encode()
                rows += [(a["ahash"], a["classes"], doc_id, tkey, a["start"], a["many"], a["anchor"], raw[a["start"] : a["start"] + a["many"] - 1 + length]) for a in asked]
            yield pd.DataFrame(rows, columns=["ahash", "classes", "doc_id", "tkey", "start", "many", "anchor", "context"])

    texts = keyed.join(asked, ["doc_id", "tkey"]).mapInPandas(cut, "ahash long, classes long, doc_id long, tkey long, start long, many int, anchor int, context binary")
    spans = full.unionByName(_sorted_spans(texts.where(F.col("classes") <= HOT), length))
    if hits.where(F.col("classes") > HOT).limit(1).count():
        spans = spans.unionByName(_counted_spans(texts.where(F.col("classes") > HOT), length))
    return spans.unionByName(texts_sharing, allowMissingColumns=True) if passages else spans


def union_of(spans, size: int) -> list[tuple[int, int]]:
    """Maximal disjoint spans of those given."""
    out: list[list[int]] = []
    for s, e in sorted((int(x["start"]), int(x["end"])) for x in spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, min(e, size)) for s, e in out]


def digests(docs: DataFrame, length: int = 400) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and n_shared of each row."""

    @released
    def run(batches):
        for pdf in batches:
            rows = []
            for doc_id, text, spans, n in zip(pdf["doc_id"], pdf["text"], pdf["spans"], pdf["n_shared"], strict=True):
                raw = text.encode() if isinstance(text, str) else b""
                gone = union_of(spans if spans is not None else [], len(raw))
                h, at = hashlib.sha256(), 0
                for s, e in [*gone, (len(raw), len(raw))]:
                    h.update(raw[at:s])
                    at = e
                rows.append((doc_id, len(raw), sum(e - s for s, e in gone), len(gone), h.hexdigest(), n))
            out = pd.DataFrame(rows, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_shared"])
            yield out.assign(doc_id=pdf["doc_id"].astype("Int64").array)

    found = repeated_spans(docs, length, passages=True).groupBy("doc_id", "tkey").agg(
        F.collect_set(F.when(F.col("start").isNotNull(), F.struct("start", "end"))).alias("spans"), F.max("n_shared").alias("n_shared")
    )
    rows = _keyed(docs).join(found, ["doc_id", "tkey"], "left").select(F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), "text", "spans", F.coalesce("n_shared", F.lit(0)).alias("n_shared"))
    return rows.mapInPandas(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_shared long")


def cut_text(text: str, gone: list[tuple[int, int]]) -> str:
    """The text without the characters whose bytes all lie in the spans."""
    raw, parts, at = text.encode(), [], 0
    for s, e in gone:
        while s < e and s < len(raw) and raw[s] & 0xC0 == 0x80:
            s += 1
        while e > s and e < len(raw) and raw[e] & 0xC0 == 0x80:
            e -= 1
        parts.append(raw[at:s])
        at = e
    return b"".join([*parts, raw[at:]]).decode()


def without_repeats(docs: DataFrame, length: int = 400) -> DataFrame:
    """docs with the repeated passages cut out of text (whole characters only); all rows and other columns stay."""
    # names that no column of the table has
    free = "_" * (1 + max((len(c) for c in docs.columns), default=0))
    spans, key, own = f"{free}spans", f"{free}key", f"{free}id"

    @released
    def run(batches):
        for pdf in batches:
            pdf["text"] = [cut_text(t, union_of(s, len(t.encode()))) if isinstance(t, str) and s is not None else t for t, s in zip(pdf["text"], pdf[spans], strict=True)]
            yield pdf.drop(columns=[spans])

    found = repeated_spans(docs, length).groupBy(F.col("doc_id").alias(own), F.col("tkey").alias(key)).agg(F.collect_set(F.struct("start", "end")).alias(spans))
    keyed = docs.withColumn(own, _id()).withColumn(key, F.xxhash64(F.col("text").cast("string")))
    joined = keyed.join(found, [own, key], "left").select(*[docs[c] for c in docs.columns], spans)
    return joined.mapInPandas(run, docs.schema)
