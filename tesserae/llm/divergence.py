"""How far the sources of a language differ in their words, by count-level bitmaps.

Every group (a language and a source) gives each term that its language keeps a smoothed share p, scaled to an integer. Two
groups differ by the sum of floor((p - q)^2 / (p + q)) over all kept terms, terms that neither has included.

1. Terms are counted per group in one pass (partial counts per task, one shuffle by language and term); a language keeps
   the terms of at least min_docs of its documents.
2. Kept terms are sorted by language, total and term and numbered in blocks of BLOCK. For each block and group, the terms of
   equal count are one bitmap: a level, which holds its 64-bit words that are not zero. The terms that a group lacks are
   the complement of its levels.
3. Within a block, the AND of a level of one group and a level of another, and its number of bits, is a cell: so many terms
   have these two counts. Cells times f, summed over blocks, are the distance. The language's own totals are levels too:
   their cells with a group's levels give the terms that stand out in it.

Blocks hold the same number of terms whatever the groups' sizes, so that no group, source or word is in one task; groups
meet in tiles of TILE, so that a task holds two tiles of one block at most.

Cases: null text, lang and source count as ''; groups without terms, and languages that keep none, give pairs with value 0
and no terms; repeated rows count as often as they are; doc_id and other columns are not read; very long texts are counted
one at a time; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.llm.common import shuffle_partitions, stage, unstage

#: Terms of a block, groups of a tile, entries of the counters of a task, ANDs made at once.
BLOCK, TILE, ENTRIES, ANDS = 4096, 64, 400_000, 1 << 20
#: Added to each count, and what the shares are scaled by.
SMOOTH, SCALE = 2, 1_000_000_000
_LETTERS = bytes(c if c >= 0x80 or 0x41 <= c <= 0x5A or 0x61 <= c <= 0x7A else 0x20 for c in range(256)).lower()
_COUNTS = "lang string, source string, term binary, n long, docs long"
_LEVELS = "lang string, block string, source string, of_lang boolean, count long, word array<int>, bits array<long>"
_CELLS = "lang string, source string, item string, block string, place int, value long"


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n occurrences and the number of documents with the term: parts of the sums, several rows each."""

    def run(batches):
        found: dict = {}
        size = 0

        def rows():
            for (lang, source), (n, d) in found.items():
                terms = list(n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(terms)), pa.array([source] * len(terms)), pa.array(terms, pa.binary()), pa.array(list(n.values()), pa.int64()), pa.array([d[t] for t in terms], pa.int64())],
                    names=["lang", "source", "term", "n", "docs"],
                )

        for batch in batches:
            for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text")), strict=True):
                n, d = found.setdefault((lang, source), (Counter(), Counter()))
                words = text.translate(_LETTERS).split()
                size -= len(n)
                n.update(words)
                d.update(set(words))
                size += len(n)
                if size >= ENTRIES:
                    yield from rows()
                    found, size = {}, 0
        yield from rows()

    given = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]
    return docs.select(*given, F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text")).mapInArrow(run, _COUNTS)


def kept_terms(docs: DataFrame, min_docs: int) -> DataFrame:
    """lang, term, total and the list of (source, n) of the terms in at least min_docs documents of their language."""
    parts = term_counts(docs).withColumn("term", F.col("term").cast("string")).repartition(shuffle_partitions(docs.sparkSession), "lang", "term")
    each = parts.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    one = each.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("counts"))
    return one.where(F.col("docs") >= min_docs).drop("docs")


def _numbered(kept: DataFrame) -> DataFrame:
    """lang, block, place, term, total, counts: places 0 to BLOCK - 1 in the order of total and term."""
    many = max(1, min(shuffle_partitions(kept.sparkSession), -(-kept.count() // BLOCK)))
    ranged = kept.repartitionByRange(many, "lang", F.desc("total"), "term")
    run = ranged.withColumn("part", F.spark_partition_id()).withColumn("k", F.row_number().over(Window.partitionBy("part", "lang").orderBy(F.desc("total"), "term")) - 1)
    block = F.concat_ws("/", F.col("part").cast("string"), F.floor(F.col("k") / BLOCK).cast("string"))
    return run.select("lang", block.alias("block"), (F.col("k") % BLOCK).cast("int").alias("place"), "term", "total", "counts")


def _levels_of(place: np.ndarray, count: np.ndarray) -> list[tuple[int, list, list]]:
    """(count, word numbers, words) of each count: one bitmap of places."""
    order = np.lexsort((place, count))
    place, count = place[order], count[order]
    word, bit = place >> 6, np.uint64(1) << (place & 63).astype(np.uint64)
    new = np.flatnonzero(np.concatenate(([True], (count[1:] != count[:-1]) | (word[1:] != word[:-1]))))
    bits = np.bitwise_or.reduceat(bit, new).view(np.int64)
    cut = np.flatnonzero(np.concatenate(([True], count[new][1:] != count[new][:-1])))
    ends = np.append(cut[1:], len(new))
    return [(int(count[new[a]]), word[new[a:b]].tolist(), bits[a:b].tolist()) for a, b in zip(cut, ends, strict=True)]


def levels(numbered: DataFrame) -> DataFrame:
    """One bitmap per block, group and count, and of the language's totals (of_lang)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        lang, block = pdf["lang"].iloc[0], pdf["block"].iloc[0]
        place = pdf["place"].to_numpy(np.int64)
        rows = [(lang, block, "", True, *x) for x in _levels_of(place, pdf["total"].to_numpy(np.int64))]
        own: dict = {}
        for p, counts in zip(place.tolist(), pdf["counts"], strict=True):
            for c in counts:
                at = own.setdefault(c["source"], ([], []))
                at[0].append(p)
                at[1].append(c["n"])
        for source, (p, n) in own.items():
            rows += [(lang, block, source, False, *x) for x in _levels_of(np.array(p, np.int64), np.array(n, np.int64))]
        return pd.DataFrame(rows, columns=["lang", "block", "source", "of_lang", "count", "word", "bits"])

    return numbered.groupBy("lang", "block").applyInPandas(run, _LEVELS)


def f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / (p + q)) in whole numbers: shares are at most SCALE + 1, so that squares fit 64 bits."""
    return (p - q) ** 2 // (p + q)


def _cells(word: np.ndarray, bits: np.ndarray, left: np.ndarray, right: np.ndarray):
    """(i, j, AND of their words) of the entries of left and right that share a word and a bit, some at a time."""
    for w in np.intersect1d(word[left], word[right]):
        a, b = left[word[left] == w], right[word[right] == w]
        for k in range(0, len(a), max(1, ANDS // len(b))):
            part = a[k : k + max(1, ANDS // len(b))]
            both = bits[part][:, None] & bits[b][None, :]
            i, j = np.nonzero(both)
            yield part[i], b[j], both[i, j]


def _compared(top: int):
    """A function of one block and two tiles of groups: distances of pairs, and the places that stand out."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        lang, block, tile_a, tile_b = pdf[["lang", "block", "tile_a", "tile_b"]].iloc[0]
        total = pdf["of_lang"].to_numpy(bool)
        sources, group = np.unique(np.where(total, "", pdf["source"].to_numpy(object)).astype(object), return_inverse=True)
        group = np.where(total, -1, group)
        many = pdf["word"].map(len).to_numpy(np.int64)
        row = np.repeat(np.arange(len(pdf)), many)
        word = np.concatenate([np.asarray(x, np.int64) for x in pdf["word"]])
        bits = np.concatenate([np.asarray(x, np.int64) for x in pdf["bits"]]).view(np.uint64)
        share, own, tile = pdf["p"].to_numpy(np.int64)[row], group[row], pdf["tile"].to_numpy(np.int64)[row]
        positive = pdf["count"].to_numpy(np.int64)[row] > 0
        # the terms that a group lacks are what the language's levels have and its own do not
        every = np.zeros(BLOCK // 64, np.uint64)
        np.bitwise_or.at(every, word[own < 0], bits[own < 0])
        has = np.zeros((len(sources), BLOCK // 64), np.uint64)
        np.bitwise_or.at(has, (own[(own >= 0) & positive], word[(own >= 0) & positive]), bits[(own >= 0) & positive])
        zero = (own >= 0) & ~positive
        bits[zero] = every[word[zero]] & ~has[own[zero], word[zero]]
        out = []
        a, b = np.flatnonzero((own >= 0) & (tile == tile_a)), np.flatnonzero((own >= 0) & (tile == tile_b))
        sums = np.zeros(len(sources) ** 2)
        for i, j, both in _cells(word, bits, a, b):
            # sums of a block stay below BLOCK * (2 * SCALE + 2), where doubles are exact
            sums += np.bincount(own[i] * len(sources) + own[j], np.bitwise_count(both) * f(share[i], share[j]), len(sources) ** 2)
        for k in np.flatnonzero(sums):
            x, y = divmod(int(k), len(sources))
            if x != y and (tile_a != tile_b or x < y):
                out += [(lang, sources[x], sources[y], None, None, int(sums[k])), (lang, sources[y], sources[x], None, None, int(sums[k]))]
        if tile_a == tile_b:
            out += _standing_out(lang, block, sources, own, word, bits, share, positive, a, top)
        return pd.DataFrame(out, columns=["lang", "source", "item", "block", "place", "value"])

    return run


def _standing_out(lang, block, sources, own, word, bits, share, positive, groups, top: int) -> list[tuple]:
    """The places of each group whose cells with the language's totals have the highest values, at least top of them; of
    cells that are beaten or equal within the block, the first places."""
    found: dict = {}
    for i, j, both in _cells(word, bits, groups[positive[groups]], np.flatnonzero(own < 0)):
        more = share[i] > share[j]
        i, j, both = i[more], j[more], both[more]
        value = f(share[i], share[j])
        for x in np.unique(own[i]).tolist():
            mine = own[i] == x
            at = found.setdefault(x, [])
            at.append((value[mine], share[j][mine], word[i][mine], both[mine]))
    rows = []
    for x, parts in found.items():
        value, total, w, both = (np.concatenate(c) for c in zip(*parts, strict=True))
        many = np.bitwise_count(both).astype(np.int64)
        order = np.lexsort((w, -total, -value))
        value, total, w, both, many = value[order], total[order], w[order], both[order], many[order]
        least = value[min(np.searchsorted(np.cumsum(many), top), len(value) - 1)]
        given: dict = {}
        for v, t, k, m in zip(value.tolist(), total.tolist(), w.tolist(), both.tolist(), strict=True):
            if v < least:
                break
            for bit in range(64):
                if m >> bit & 1 and given.get((v, t), 0) < top:
                    given[v, t] = given.get((v, t), 0) + 1
                    rows.append((lang, sources[x], None, block, k * 64 + bit, v))
    return rows


def audit(docs: DataFrame, min_docs: int = 10, top: int = 10) -> DataFrame:
    """lang, source, part, item, value and rank: `pair` rows hold each other source of the language and the distance to it,
    `term` rows the top terms whose share exceeds the language's."""
    groups = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    kept = stage(kept_terms(docs, min_docs), "divergence-terms")
    numbered = stage(_numbered(kept), "divergence-blocks")
    level = stage(levels(numbered), "divergence-levels")
    mass = kept.select("lang", F.explode("counts").alias("c")).groupBy("lang", F.col("c.source").alias("source")).agg(F.sum("c.n").alias("mass"))
    whole = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("n_terms"), F.sum("total").alias("lang_mass"))
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    sized = groups.join(mass, ["lang", "source"], "left").join(whole, "lang", "left").fillna(0, ["mass", "n_terms", "lang_mass"])
    sized = stage(sized.withColumn("tile", F.floor(number / TILE).cast("int")), "divergence-groups")

    def share(count: str, total: str):
        return F.expr(f"1 + ((cast({count} AS DECIMAL(20,0)) + {SMOOTH}) * {SCALE}) div (cast({total} AS DECIMAL(20,0)) + {SMOOTH} * n_terms)")

    tiles = sized.groupBy("lang").agg((F.max("tile") + 1).alias("tiles"), F.max("n_terms").alias("n_terms"), F.max("lang_mass").alias("lang_mass"))
    own = level.where("NOT of_lang").unionByName(
        # a row without terms for each group of each block: what it lacks is known once its levels are at hand
        level.where("of_lang").select("lang", "block").distinct().join(sized.select("lang", "source"), "lang")
        .withColumns({"of_lang": F.lit(False), "count": F.lit(0).cast("long"), "word": F.sequence(F.lit(0), F.lit(BLOCK // 64 - 1)), "bits": F.array_repeat(F.lit(0).cast("long"), BLOCK // 64)})
    )
    own = own.join(sized, ["lang", "source"]).withColumn("p", share("count", "mass")).select(*level.columns, "tile", "p").join(tiles.select("lang", "tiles"), "lang")
    meet = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda t: F.struct(F.least(t, "tile").alias("a"), F.greatest(t, "tile").alias("b")))
    own = own.withColumn("m", F.explode(meet))
    totals = level.where("of_lang").join(tiles, "lang").withColumn("p", share("count", "lang_mass")).withColumn("tile", F.lit(-1))
    every_pair = F.flatten(F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda a: F.transform(F.sequence(a, F.col("tiles") - 1), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    totals = totals.withColumn("m", F.explode(every_pair)).select(*own.columns)
    both = own.unionByName(totals).withColumns({"tile_a": F.col("m.a").cast("int"), "tile_b": F.col("m.b").cast("int")}).drop("m", "tiles")
    cells = stage(both.groupBy("lang", "block", "tile_a", "tile_b").applyInPandas(_compared(top), _CELLS), "divergence-cells")
    unstage(level, kept)

    far = cells.where("item IS NOT NULL").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = sized.select("lang", "source").join(sized.select("lang", F.col("source").alias("item")), "lang").where("source <> item")
    pairs = pairs.join(far, ["lang", "source", "item"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))
    high = cells.where("place IS NOT NULL").join(numbered.select("lang", "block", "place", "term"), ["lang", "block", "place"])
    terms = high.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")).cast("int")
    return pairs.withColumn("rank", rank).unionByName(terms.withColumn("rank", rank).where(F.col("rank") <= top))
