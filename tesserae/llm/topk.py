"""Exact top-k inner products by exhaustive term-at-a-time accumulation.

Candidates are packed into blocks of postings: per vector component, the rows with a value there and the values. Queries are
packed into blocks of sparse rows. For each pair of blocks, each component's postings are scattered, weighted by the
queries' own values, into a dense score array (a posting list of most rows holds all of them, zeros too, and needs no places);
a partition selection keeps the best k of each query, and the blocks' winners are merged. Candidate blocks are dealt to parts,
and each part meets every query block by an equality join: that is the stated query set against all rows, in blocks. Up to
TOGETHER query blocks share a task; beyond it, or where copies of the queries would outweigh those of the candidates, parts
are dealt once per group of query blocks. That join is asked to be a merge join: Spark does not count in its estimates that
blocks are dealt out in copies, and would send all of them through the driver.

Cases: vectors that are null, empty or hold a null, NaN or infinite component take no part, neither as query nor as
candidate; rows with a null id neither; rows with the same id are rows of their own but never answer a query of that id;
equal scores go to the smaller id; vectors of unequal length are compared as if padded with zeros; with fewer than k others,
all are returned; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.llm.common import shuffle_partitions

QUERY_BLOCK = 4096
CANDIDATE_BLOCK = 1024
#: Query blocks that a task takes one after the other.
TOGETHER = 64
#: Scores that are summed at once: they and their shares stay in a core's cache.
SCORES = 1 << 17
_BLOB = "ids binary, heads binary, places binary, values binary"


def _usable(vectors: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """id and whole-number components of the vectors that take part."""
    fine = F.col("v").isNotNull() & F.col("id").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (
        vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).where(fine)
        .select("id", F.transform("v", lambda x: F.floor(x * scale)).alias("v"))
    )


def _packed(rows: DataFrame, block: int) -> DataFrame:
    """Consecutive rows of each partition as blocks of at most block rows: their ids and, by component, their postings."""

    def run(batches):
        ids, vecs = [], []

        def flush():
            m = np.zeros((max(map(len, vecs)), len(vecs)), np.int64)
            for r, v in enumerate(vecs):
                m[: len(v), r] = v
            listed = m != 0
            full = 2 * listed.sum(1) > len(vecs)
            listed[full] = True
            component, place = np.nonzero(listed)
            heads = np.searchsorted(component, np.arange(len(m) + 1))
            values, places = m[component, place], place[~full[component]]
            kind = next((t for t in (np.int16, np.int32) if largest(values) <= np.iinfo(t).max), np.int64)
            return pd.DataFrame({"ids": [np.array(ids, np.int64).tobytes()], "heads": [heads.astype(np.int64).tobytes()], "places": [places.astype(np.int32).tobytes()], "values": [values.astype(kind).tobytes()]})

        for pdf in batches:
            for i, v in zip(pdf["id"], pdf["v"], strict=True):
                ids.append(i)
                vecs.append(v)
                if len(ids) >= block:
                    yield flush()
                    ids, vecs = [], []
        if ids:
            yield flush()

    return rows.mapInPandas(run, _BLOB)


def largest(values: np.ndarray) -> int:
    """The largest absolute value, 0 of none."""
    return max(int(values.max(initial=0)), -int(values.min(initial=0)))


class Postings:
    """The postings of one block."""

    def __init__(self, ids: bytes, heads: bytes, places: bytes, values: bytes):
        self.ids, self.heads = np.frombuffer(ids, np.int64), np.frombuffer(heads, np.int64)
        n = int(self.heads[-1])
        self.places, self.values = np.frombuffer(places, np.int32), np.frombuffer(values, f"i{len(values) // n}" if n else np.int64)
        count = np.diff(self.heads)
        self.full = count == len(self.ids)
        self.at = np.concatenate(([0], np.cumsum(np.where(self.full, 0, count))))
        self.largest = largest(self.values)

    def of(self, d: int) -> tuple[np.ndarray | None, np.ndarray]:
        """Places (None: all rows) and values of a component."""
        values = self.values[self.heads[d] : self.heads[d + 1]]
        return None if self.full[d] else self.places[self.at[d] : self.at[d + 1]], values


def accumulate(queries: Postings, candidates: Postings, first: int, last: int) -> np.ndarray:
    """Scores of the queries first .. last - 1 against all candidates, one component's postings at a time."""
    dims = min(len(queries.heads), len(candidates.heads)) - 1
    kind = np.int32 if queries.largest * candidates.largest * max(dims, 1) < 2**31 else np.int64
    n, m = last - first, len(candidates.ids)
    scores, room = np.zeros((n, m), kind), np.empty((n, m), kind)
    for d in range(dims):
        rows, weights = queries.of(d)
        a, b = (first, last) if rows is None else np.searchsorted(rows, (first, last))
        places, values = candidates.of(d)
        if a == b or not len(values):
            continue
        weights = weights[a:b].astype(kind)[:, None]
        share = np.multiply(weights, values.astype(kind)[None, :], out=room[: b - a, : len(values)])
        if rows is None:
            scores[:, slice(None) if places is None else places] += share
        elif places is None:
            scores[rows[a:b] - first] += share
        else:
            scores[np.ix_(rows[a:b] - first, places)] += share
    return scores


def best(query: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows of a query, an id and a score, the k best of each query: the higher scores, then the smaller ids."""
    order = np.lexsort((ids, -scores, query))
    query, ids, scores = query[order], ids[order], scores[order]
    head = np.concatenate(([True], query[1:] != query[:-1])) if len(query) else np.zeros(0, bool)
    start = np.maximum.accumulate(np.where(head, np.arange(len(query)), 0))
    keep = np.arange(len(query)) - start < k
    return query[keep], ids[keep], scores[keep]


def winners(queries: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best candidates of each query, by partition selection: their query, id and score, and ties at the border too. A
    candidate with the id of its query is none."""
    own = queries[:, None] == ids[None, :] if np.isin(queries, ids).any() else None
    none = np.iinfo(scores.dtype).min
    if own is not None:
        scores = np.where(own, none, scores)
    row, place = np.nonzero(scores >= np.partition(scores, -k, axis=1)[:, -k, None]) if scores.shape[1] > k else np.nonzero(np.ones(scores.shape, bool))
    found = scores[row, place].astype(np.int64)
    there = found > none
    return queries[row[there]], ids[place[there]], found[there]


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score of the k largest inner products of each query among the vectors with another id."""
    spark = vectors.sparkSession
    rows = _usable(vectors, id_col, vec_col, scale)
    asked = _usable(queries, id_col, vec_col, scale)
    n_queries = asked.count()
    n_blocks = max(1, -(-n_queries // QUERY_BLOCK))
    # repartition() without keys deals rows out evenly; each of its partitions is one block of queries, or two
    q = _packed(asked.repartition(n_blocks), 2 * QUERY_BLOCK)
    c = _packed(rows, CANDIDATE_BLOCK)
    tasks, groups = shuffle_partitions(spark), -(-n_blocks // TOGETHER)
    if n_blocks > 1:  # each group has a copy of the candidates, each part one of the queries
        groups = min(n_blocks, max(groups, round(math.sqrt(tasks * n_queries / max(vectors.count(), 1)))))
    parts = -(-tasks // groups)
    q_names = [F.col(x).alias(f"q_{x}") for x in q.columns]

    def run(batches):
        held: dict = {}
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                asked_block, block = Postings(r.q_ids, r.q_heads, r.q_places, r.q_values), Postings(r.ids, r.heads, r.places, r.values)
                n = len(asked_block.ids)
                step = max(1, SCORES // max(len(block.ids), 1))
                found = [best(*winners(asked_block.ids[at : at + step], block.ids, accumulate(asked_block, block, at, min(n, at + step)), k), k) for at in range(0, n, step)]
                if r.q_ids in held:
                    found.append(held[r.q_ids])
                held[r.q_ids] = best(*map(np.concatenate, zip(*found, strict=True)), k)
        for query, ids, scores in held.values():
            yield pd.DataFrame({"query_id": query, "vec_id": ids, "score": scores})

    if n_blocks == 1:  # a few thousand queries, counted
        met = c.withColumn("group", F.lit(0)).repartition(parts, "ids").join(F.broadcast(q.select(F.lit(0).alias("group"), *q_names)), "group")
    else:
        dealt = q.select(F.pmod(F.spark_partition_id(), F.lit(groups)).alias("group"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), *q_names)
        met = c.select(F.pmod(F.xxhash64("ids"), F.lit(parts)).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"), *c.columns).join(dealt.hint("merge"), ["part", "group"])
    names = [f"q_{x}" for x in q.columns] + c.columns
    near = met.select(*names).mapInPandas(run, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
