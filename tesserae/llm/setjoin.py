"""Exact Jaccard self-join of word-shingle sets, and its components.

Candidates. Two linked sets share at least a share t of the larger one's shingles. In any order of all shingles that is the
same for every set, they therefore share one of the first s - ceil(t * s) + 1 of each (prefix filter); frequent shingles
come last in the order, so that boilerplate brings no strangers together. Any order is exact: the table of frequent
shingles (FREQUENT at most, counted within batches of texts) only makes the search cheap. A set signs its first shingles for
its own size class and for each class in which it can have a smaller partner. Signatures meet in hashed buckets. The sets
of a list with one signature are compared by their sketches: the counts of their shingles by parts of the hash space differ
by no more than the sets themselves, so pairs that differ by too much go, and passages that many texts share chain no
strangers together. Lists of up to SHORT become pairs. In a longer list one member after the other is compared with all, until
the rest hang together; its edges are a star for each component found. After LEADERS members, or in a list of over LIST, the
rest become one star, uncompared: that costs search in a larger family and loses no link. Components of the edges are families.

Links. Within a family the T-occurrence search counts overlaps on inverted lists (DivideSkip): the short lists of a set are
merged on a heap, the long ones are probed by binary search for the sets that can still reach the required overlap.
Families beyond FAMILY members are joined block by block, which is exact too, and their links joined into components.

Cases: null and empty texts, and texts without words, have no shingles and link with nothing; fewer words than n make one
shingle of them all; sets that are equal are searched once and counted as copies; repeated rows count as copies of each
other; rows with one doc_id and different texts are sets of their own; a null doc_id counts as the largest; very long texts
are taken whole, and a family's texts are split into blocks by their shingles too; an empty table gives an empty result;
other columns are ignored. Shingles are told apart by 64-bit hashes, sets by 128 bits.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import NO_ID, chunks, mix, released, shuffle_partitions, stage, unified, unstage, words_of
from tesserae.llm.components import components

#: Members of a family that are searched in one task; larger ones go block by block.
FAMILY = 4096
#: Sets with one signature that become pairs; members of a longer list that are compared with all others; the longest such list.
SHORT, LEADERS, LIST = 8, 256, 1 << 16
#: Frequent shingles that come last in the order, and how many a batch of texts proposes.
FREQUENT, BATCH_FREQUENT = 200_000, 4000
#: Shingles of a family's members that are searched in one task, likewise.
FAMILY_SHINGLES = 2 << 20
_M1, _M2, _M3 = np.uint64(0x9FB21C651E98DF25), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
#: Batches of texts of this many bytes sign together.
BATCH_BYTES = 8 << 20


def shingle_sets(texts: list[bytes], n: int = 3) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    words, per = words_of(texts)
    ends = np.cumsum(per)
    grams = np.zeros(len(words), np.uint64)
    if len(words) >= n:
        acc = words[: len(words) - n + 1].copy()
        for i in range(1, n):
            acc = mix(acc * _M1 + words[i : len(words) - n + 1 + i])
        grams[: len(acc)] = acc
    out = []
    for end, size in zip(ends.tolist(), per.tolist(), strict=True):
        at = end - size
        if size >= n:
            out.append(np.unique(grams[at : end - n + 1]))
        elif size:
            acc = words[at : at + 1]
            for w in words[at + 1 : end]:
                acc = mix(acc * _M1 + w)
            out.append(mix(acc + np.uint64(size)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def identity(s: np.ndarray) -> tuple[int, int]:
    """128 bits that tell sets apart."""
    with np.errstate(over="ignore"):
        return tuple(int(np.array([mix(s * m).sum()], np.uint64).view(np.int64)[0]) for m in (_M2, _M3))


def sketch(s: np.ndarray) -> bytes:
    """How many shingles lie in each of 2^k equal parts of the hash space, about 8 in each; 255 stands for more."""
    bits = max(3, min(12, (len(s) // 8).bit_length()))
    return np.minimum(np.bincount((s >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits), 255).astype(np.uint8).tobytes()


def may_link(x: bytes, y: bytes, size_x: int, size_y: int, percent: int) -> bool:
    """False only if the sets differ in more shingles than linked ones can."""
    a, b = (np.frombuffer(v, np.uint8).astype(np.int32) for v in ((x, y) if len(x) <= len(y) else (y, x)))
    if len(a) < len(b):
        b = np.minimum(b.reshape(len(a), -1).sum(1), 255)
    return (100 + percent) * int(np.abs(a - b).sum()) <= (100 - percent) * (size_x + size_y)


def needed(size_a, size_b, percent: int):
    """Overlap from which two sets of these sizes link: 100 * i >= percent * (a + b - i)."""
    return -(-(percent * (size_a + size_b)) // (100 + percent))


class Classes:
    """Signatures of sets: their first shingles, for each size class that a pair's smaller set can be in."""

    def __init__(self, percent: int, frequent: np.ndarray | None = None):
        """frequent: shingles that come last in the order, the most frequent first."""
        self.percent, self.bounds = percent, [1]
        often = np.zeros(0, np.uint64) if frequent is None else frequent
        by = np.argsort(often)
        self.often, self.rank = often[by], -by

    def of(self, size: int) -> int:
        while self.bounds[-1] <= size:
            self.bounds.append(self.bounds[-1] * 3 // 2 + 1)
        return int(np.searchsorted(self.bounds, size, "right")) - 1

    def first(self, s: np.ndarray) -> np.ndarray:
        """The first shingles of a sorted set, of which a linked set shares one."""
        count = len(s) - -(-self.percent * len(s) // 100) + 1
        if not len(self.often):
            return s[:count]
        at = np.minimum(np.searchsorted(self.often, s), len(self.often) - 1)
        last = self.often[at] == s
        head = s[~last][:count]
        if len(head) == count:
            return head
        rest = at[last]
        return np.concatenate((head, self.often[rest[np.argsort(self.rank[rest])][: count - len(head)]]))

    def signatures(self, s: np.ndarray) -> np.ndarray:
        least = self.of(max(1, -(-len(s) * self.percent // 100)))
        head = self.first(s) * _M1
        with np.errstate(over="ignore"):
            return np.concatenate([mix(head + np.uint64(k + 1) * _M3) for k in range(least, self.of(len(s)) + 1)])


def _profiles(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, tkey, size, h1, h2, sketch of each row; and for each batch of texts its most frequent shingles (size: -1, h1: the
    shingle, h2: the number of sets)."""

    def run(batches):
        for pdf in batches:
            for ids, texts in chunks(zip(pdf["doc_id"], pdf["tkey"], strict=True), pdf["text"], BATCH_BYTES):
                sets = shingle_sets(texts, n)
                h = [identity(s) for s in sets]
                yield pd.DataFrame({"doc_id": [i for i, _ in ids], "tkey": [k for _, k in ids], "size": [len(s) for s in sets], "h1": [x[0] for x in h], "h2": [x[1] for x in h], "sketch": [sketch(s) for s in sets]})
                shingle, count = np.unique(np.concatenate(sets), return_counts=True)
                often = np.flatnonzero(count > 1)
                often = often[np.argsort(-count[often], kind="stable")][:BATCH_FREQUENT]
                yield pd.DataFrame({"doc_id": 0, "tkey": 0, "size": -1, "h1": shingle[often].view(np.int64), "h2": count[often], "sketch": None})

    return docs.mapInPandas(released(run), "doc_id long, tkey long, size long, h1 long, h2 long, sketch binary")


def _frequent(profiles: DataFrame) -> np.ndarray:
    """The FREQUENT shingles that batches count most often, most frequent first."""
    counts = profiles.where("size < 0").groupBy("h1").agg(F.sum("h2").alias("n")).orderBy(F.desc("n"), "h1").limit(FREQUENT)
    return counts.select("h1").toPandas()["h1"].to_numpy(np.int64).view(np.uint64)


def _lists(sig: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, ...]:
    """The different rows in order of (signature, owner), the number of the list of each, and the lengths of the lists."""
    order = np.lexsort((owner, sig))
    sig, owner = sig[order], owner[order]
    other = np.concatenate(([True], (sig[1:] != sig[:-1]) | (owner[1:] != owner[:-1])))
    sig, owner = sig[other], owner[other]
    new = np.concatenate(([True], sig[1:] != sig[:-1]))
    return sig, owner, np.cumsum(new) - 1, np.diff(np.append(np.flatnonzero(new), len(sig)))


def _edges(docs: DataFrame, n: int, percent: int, frequent: np.ndarray) -> DataFrame:
    """Pairs (a, b) of h1 values of sets that share a signature; and, as star, the members (a) of each long list (b)."""
    buckets = shuffle_partitions(docs.sparkSession) * 2
    known = docs.sparkSession.sparkContext.broadcast(frequent)  # at most FREQUENT numbers

    def sign(batches):
        classes = Classes(percent, known.value)
        for pdf in batches:
            for _, texts in chunks(pdf["doc_id"], pdf["text"], BATCH_BYTES):
                sigs, owners, seen = [], [], set()
                for s in shingle_sets(texts, n):
                    if len(s):
                        h1 = identity(s)[0]
                        if h1 not in seen:
                            seen.add(h1)
                            sigs.append(classes.signatures(s))
                            owners.append(np.full(len(sigs[-1]), h1, np.int64))
                if not sigs:
                    continue
                sig, owner = np.concatenate(sigs), np.concatenate(owners)
                bucket = (sig % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
                rows = [(int(k), sig[order[x:y]].tobytes(), owner[order[x:y]].tobytes()) for k, (x, y) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if y > x]
                yield pd.DataFrame(rows, columns=["bucket", "x", "y"])

    def meet(batches):
        sigs, owners = [], []
        for pdf in batches:
            sigs += [np.frombuffer(x, np.uint64) for x in pdf["x"]]
            owners += [np.frombuffer(y, np.int64) for y in pdf["y"]]
        if not sigs:
            return
        sig, owner, which, length = _lists(np.concatenate(sigs), np.concatenate(owners))
        del sigs, owners
        long = length[which] > SHORT
        if long.any():
            yield pd.DataFrame({"a": owner[long], "b": sig[long].view(np.int64), "star": True})
        found = [np.zeros((2, 0), np.int64)]
        for gap in range(1, SHORT):
            i = np.flatnonzero((which[gap:] == which[:-gap]) & ~long[gap:])
            found.append(np.stack((owner[i], owner[i + gap])))
        a, b = np.unique(np.concatenate(found, axis=1), axis=1)
        if len(a):
            yield pd.DataFrame({"a": a, "b": b, "star": False})

    sent = docs.mapInPandas(released(sign), "bucket int, x binary, y binary")
    return sent.repartition(shuffle_partitions(docs.sparkSession), "bucket").mapInPandas(released(meet), "a long, b long, star boolean")


def _near(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sketches do not keep them apart."""

    def run(batches):
        for pdf in batches:
            keep = [may_link(x, y, p, q, percent) for x, y, p, q in zip(pdf["x"], pdf["y"], pdf["size_x"], pdf["size_y"], strict=True)]
            yield pdf.loc[keep, ["a", "b"]]

    of_a = sets.select(F.col("h1").alias("a"), F.col("sketch").alias("x"), F.col("size").alias("size_x"))
    of_b = sets.select(F.col("h1").alias("b"), F.col("sketch").alias("y"), F.col("size").alias("size_y"))
    return pairs.join(of_a, "a").join(of_b, "b").mapInPandas(released(run), "a long, b long")


def grouped(sketches: list[bytes], sizes: np.ndarray, percent: int, leaders: int) -> np.ndarray:
    """The first member of the group of each set of a list; sets that may link are in one group."""
    n, length = len(sketches), np.array([len(x) for x in sketches])
    counts = {}
    for k in np.unique(length).tolist():
        at = np.flatnonzero(length == k)
        counts[k] = {k: np.frombuffer(b"".join([sketches[i] for i in at.tolist()]), np.uint8).reshape(-1, k).astype(np.int16)}, at
    fold = lambda x, k: x if x.shape[1] == k else np.minimum(x.reshape(len(x), k, -1).sum(2), 255).astype(np.int16)
    label, apart = np.arange(n), np.zeros(n, np.int64)
    for q in range(n):
        if (label[q:] == label[q]).all():
            break
        if q < leaders:
            own = np.frombuffer(sketches[q], np.uint8).astype(np.int16)[None, :]
            for k, (tables, at) in counts.items():
                least = min(k, own.shape[1])
                if least not in tables:
                    tables[least] = fold(tables[k], least)
                apart[at] = np.abs(tables[least] - fold(own, least)).sum(1, dtype=np.int64)
            near = (100 + percent) * apart <= (100 - percent) * (sizes[q] + sizes)
            near &= 100 * np.minimum(sizes, sizes[q]) >= percent * np.maximum(sizes, sizes[q])
        else:
            near = np.arange(n) >= q
        met = np.unique(label[near])
        label[np.isin(label, met)] = met[0]
    return label


def _long_lists(entries: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) that connect the sets of each long list that may link."""
    leaders, longest = LEADERS, LIST

    def edges(owner, sketches, size):
        label = grouped(sketches, np.array(size, np.int64), percent, leaders)
        owner, away = np.array(owner, np.int64), label != np.arange(len(label))
        return owner[label[away]], owner[away]

    def run(batches):
        key, held, lead = None, ([], [], []), None  # lead: the first member of a list that has become too long
        for pdf in batches:
            which = pdf["list"].to_numpy(np.int64)
            cut = [0, *(np.flatnonzero(which[1:] != which[:-1]) + 1).tolist(), len(which)]
            out = []
            for x, y in zip(cut[:-1], cut[1:], strict=True):
                if which[x] != key:
                    if held[0]:
                        out.append(edges(*held))
                    key, held, lead = which[x], ([], [], []), None
                for to, column in zip(held, ("h1", "sketch", "size"), strict=True):
                    to.extend(pdf[column].iloc[x:y])
                if lead is None and len(held[0]) > longest:
                    lead = held[0][0]
                if lead is not None:
                    out.append((np.full(len(held[0]), lead, np.int64), np.array(held[0], np.int64)))
                    held = ([], [], [])
            if out:
                yield pd.DataFrame({"a": np.concatenate([a for a, _ in out]), "b": np.concatenate([b for _, b in out])})
        if held[0]:
            yield pd.DataFrame(dict(zip("ab", edges(*held), strict=True)))

    rows = entries.join(sets.select("h1", "sketch", "size"), "h1")
    width = shuffle_partitions(entries.sparkSession)
    return rows.repartition(width, "list").sortWithinPartitions("list").mapInPandas(released(run), "a long, b long")


class Search:
    """T-occurrence search over the sets of one family."""

    def __init__(self, sets: list[np.ndarray], percent: int):
        self.percent = percent
        self.order = sorted(range(len(sets)), key=lambda i: len(sets[i]))  # partners of a set come after it
        self.sets = [sets[i] for i in self.order]
        self.sizes = np.array([len(s) for s in self.sets], np.int64)
        tokens = np.concatenate(self.sets) if self.sets else np.zeros(0, np.uint64)
        member = np.repeat(np.arange(len(self.sets)), self.sizes)
        by = np.lexsort((member, tokens))
        tokens, self.members = tokens[by], member[by]
        first = np.flatnonzero(np.concatenate(([True], tokens[1:] != tokens[:-1]))) if len(tokens) else np.zeros(0, np.int64)
        self.tokens, self.first = tokens[first], np.append(first, len(tokens))

    def partners(self, q: int) -> np.ndarray:
        """Members after q that link with it."""
        size = int(self.sizes[q])
        last = int(np.searchsorted(self.sizes, size * 100 // self.percent, "right"))
        if last <= q + 1:
            return np.zeros(0, np.int64)
        at = np.searchsorted(self.tokens, self.sets[q])
        lengths = self.first[at + 1] - self.first[at]
        at = at[np.argsort(lengths, kind="stable")]
        lists = [self.members[self.first[i] : self.first[i + 1]] for i in at.tolist()]
        least = needed(size, size, self.percent)
        n_long = min(least - 1, int(least / (0.0085 * math.log2(max(len(lists[-1]), 2)) + 1)))
        short, long = lists[: size - n_long], lists[size - n_long :]
        count = self._merged(short, q, last)
        held = np.flatnonzero(count >= least - n_long) + q + 1
        if not len(held):
            return held
        have = count[held - q - 1]
        if sum(map(len, long)) <= 4 * len(long) * len(held):
            have = have + self._merged(long, q, last)[held - q - 1]
        else:
            for x in long:  # binary probe
                i = np.searchsorted(x, held)
                have = have + (x[np.minimum(i, len(x) - 1)] == held)
        return held[have >= needed(size, self.sizes[held], self.percent)]

    @staticmethod
    def _merged(lists: list[np.ndarray], q: int, last: int) -> np.ndarray:
        """How many of the sorted lists hold each member of q + 1 .. last - 1."""
        count = np.zeros(last - q - 1, np.int64)
        if sum(map(len, lists)) <= 256:
            for m in heapq.merge(*[x.tolist() for x in lists]):
                if q < m < last:
                    count[m - q - 1] += 1
            return count
        every = np.concatenate(lists)
        return np.bincount(every[(every > q) & (every < last)] - q - 1, minlength=last - q - 1)


def links(sets: list[np.ndarray], weights: list[int], names: list, percent: int, only=None) -> tuple[list[int], list[int]]:
    """For each set: the one with the smallest name in its component within this family, and the summed weight of the sets
    that it links to.

    only(i, j) tells whether this call counts the pair (for families that are searched block by block).
    """
    search, n = Search(sets, percent), len(sets)
    up, total = list(range(n)), [0] * n

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for q in range(n):
        i = search.order[q]
        for p in search.partners(q).tolist():
            j = search.order[p]
            if only is None or only(i, j):
                total[i] += weights[j]
                total[j] += weights[i]
                a, b = root(i), root(j)
                if a != b:
                    up[max(a, b, key=lambda k: names[k])] = min(a, b, key=lambda k: names[k])
    return [root(i) for i in range(n)], total


_FOUND = "h1 long, h2 long, n_links long, root long, blocked boolean, rep struct<doc_id: bigint, tkey: bigint>, head struct<doc_id: bigint, tkey: bigint>"


def _searched(rows: DataFrame, n: int, percent: int) -> DataFrame:
    """A row per set and task: its links there, and the first set (root: its h1, head: its representative) of its component
    as far as this task sees."""

    def flush(held):
        held = list({(r.doc_id, r.tkey): r for r in held}.values())
        sets = shingle_sets([r.text.encode() for r in held], n)
        blocked = held[0].blocks > 1
        only = (lambda x, y: held[x].part != held[y].part) if held[0].i != held[0].j else None
        reps = [(r.doc_id, r.tkey) for r in held]
        roots, total = links(sets, [r.copies for r in held], reps, percent, only)
        return pd.DataFrame({
            "h1": [r.h1 for r in held], "h2": [r.h2 for r in held], "n_links": total, "root": [held[k].h1 for k in roots], "blocked": blocked,
            "rep": [{"doc_id": d, "tkey": t} for d, t in reps], "head": [{"doc_id": reps[k][0], "tkey": reps[k][1]} for k in roots],
        })

    def run(batches):
        key, held = None, []
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                if (r.family, r.i, r.j) != key:
                    if held:
                        yield flush(held)
                    key, held = (r.family, r.i, r.j), []
                held.append(r)
        if held:
            yield flush(held)

    width = shuffle_partitions(rows.sparkSession)
    return rows.repartition(width, "family", "i", "j").sortWithinPartitions("family", "i", "j").mapInPandas(released(run), _FOUND)


def _whole(found: DataFrame) -> DataFrame:
    """h1, h2, n_links, head of the sets of blocked families: links of all blocks added, components joined across blocks."""
    sets = stage(found.where("blocked").groupBy("h1", "h2").agg(F.sum("n_links").alias("n_links"), F.min("rep").alias("rep")), "blocked")
    label = components(found.where("blocked"), "h1", "root", name="linked").withColumnsRenamed({"node": "h1"})
    own = sets.join(label, "h1", "left").withColumn("label", F.coalesce("label", "h1"))
    heads = own.groupBy("label").agg(F.min("rep").alias("head"))
    return own.join(heads, "label").select("h1", "h2", "n_links", "head")


def joined(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """doc_id, tkey, n_shingles, head (doc_id and tkey of the first row of its component), n_links, copies of each row.

    tkey: a hash of the text, which tells rows with one doc_id apart. A null doc_id counts as NO_ID.
    """
    docs = unified(docs).select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), F.xxhash64("text").alias("tkey"), "text")
    counted = stage(_profiles(docs, n), "profiles")
    profiles = counted.where("size >= 0")
    same = ["h1", "h2", "size"]
    reps = stage(profiles.where("size > 0").groupBy(*same).agg(F.min(F.struct("doc_id", "tkey")).alias("rep"), F.count(F.lit(1)).alias("copies"), F.any_value("sketch").alias("sketch")), "sets")
    edges = stage(_edges(docs, n, percent, _frequent(counted)), "edges")
    near = _near(edges.where("NOT star").select("a", "b").distinct(), reps, percent)
    far = _long_lists(edges.where("star").select(F.col("a").alias("h1"), F.col("b").alias("list")), reps, percent)
    met = stage(far.unionByName(near), "met")  # one Python worker a task, where the functions of both would run in two
    families = components(met, name="families").withColumnsRenamed({"node": "h1", "label": "family"})
    unstage(edges, met)
    members = stage(reps.join(families, "h1").select("h1", "h2", "size", "rep", "copies", "family"), "members")
    sizes = members.groupBy("family").agg(F.count(F.lit(1)).alias("m"), F.sum("size").alias("shingles"))
    blocks = sizes.select("family", F.ceil(F.greatest(F.col("m") / FAMILY, F.col("shingles") / FAMILY_SHINGLES)).cast("int").alias("blocks"))
    parted = members.join(blocks, "family").withColumn("part", F.pmod(F.xxhash64("h1", "h2"), F.col("blocks")).cast("int"))
    paired = parted.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        F.col("rep.doc_id").alias("doc_id"), F.col("rep.tkey").alias("tkey"), "h1", "h2", "copies", "part", "blocks", "family", F.least("part", "o").alias("i"), F.greatest("part", "o").alias("j")
    )
    # texts and members meet by row at every size; without the hint small inputs would broadcast the members
    found = stage(_searched(docs.join(paired.hint("merge"), ["doc_id", "tkey"]), n, percent), "links")
    unstage(members)
    classes = found.where("NOT blocked").select("h1", "h2", "n_links", "head")
    if found.where("blocked").limit(1).count():
        classes = classes.unionByName(_whole(found))
    known = reps.join(classes, ["h1", "h2"], "left").select(*same, "copies", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("head", "rep").alias("head"))
    own = F.struct("doc_id", "tkey")
    return profiles.join(known, same, "left").select(
        "doc_id", "tkey", F.col("size").alias("n_shingles"), F.coalesce("head", own).alias("head"),
        (F.coalesce("n_links", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1).alias("n_links"), F.coalesce("copies", F.lit(1)).cast("long").alias("copies"),
    )


def _id(column) -> Column:
    return F.nullif(column, F.lit(NO_ID))


def components_of(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links, copies of each row.

    component_id: the smallest doc_id reachable by links, itself included. n_links: the other rows it links to directly;
    copies: rows with the same set, itself included.
    """
    return joined(docs, n, percent).select(_id(F.col("doc_id")).alias("doc_id"), "n_shingles", _id(F.col("head.doc_id")).alias("component_id"), "n_links", "copies")


def one_of_each(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs that come first (by doc_id, null last, then by a hash of the text) in their component; rows that
    repeat both doc_id and text count as one document, rows that share a doc_id alone do not."""
    keep = joined(docs, n, percent).where("head = struct(doc_id, tkey)").select(F.col("doc_id").alias("_id"), F.col("tkey").alias("_tkey")).distinct()
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("_id"), F.xxhash64(F.col("text").cast("string")).alias("_tkey"))
    return rows.join(keep, ["_id", "_tkey"]).dropDuplicates(["_id", "_tkey"]).select("_row.*")
