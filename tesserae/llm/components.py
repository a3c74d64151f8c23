"""Connected components of an edge table, by minimum labels and pointer jumping; every round is a staged table.

Edges that come in one task are first replaced by a star around the smallest node of each of their components, so that what
the rounds join grows with the nodes and not with the pairs of a group that is linked throughout.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import stage, unstage


#: Edges that are replaced by stars at once.
EDGES = 1 << 20


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node that is not the smallest of its component, and that smallest node."""
    nodes, place = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = place[: len(a)], place[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        for at in (x, y, label[x], label[y]):
            np.minimum.at(new, at, low)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            away = label != np.arange(len(nodes))
            return nodes[away], nodes[label[away]]
        label = new


def _starred(edges: DataFrame) -> DataFrame:
    def run(batches):
        held, size = [], 0
        for pdf in batches:
            held.append(pdf)
            size += len(pdf)
            if size >= EDGES:
                yield pd.DataFrame(dict(zip("ab", stars(*(np.concatenate([p[c].to_numpy(np.int64) for p in held]) for c in "ab")), strict=True)))
                held, size = [], 0
        if size:
            yield pd.DataFrame(dict(zip("ab", stars(*(np.concatenate([p[c].to_numpy(np.int64) for p in held]) for c in "ab")), strict=True)))

    return edges.mapInPandas(run, "a long, b long")


def components(edges: DataFrame, a: str = "a", b: str = "b", name: str = "components") -> DataFrame:
    """(node, label) of every node that has an edge to another; label: the component's smallest node."""
    pairs = _starred(edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a <> b"))
    both = stage(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}-edges")
    last = labels = stage(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), name)
    while True:
        of_b = labels.select(F.col("node").alias("b"), F.col("label").alias("other"))
        near = both.join(of_b, "b").groupBy(F.col("a").alias("node")).agg(F.min("other").alias("m"))
        met = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "m").alias("l1"))
        jump = labels.select(F.col("node").alias("l1"), F.col("label").alias("l2"))
        new = stage(met.join(jump, "l1").select("node", "old", F.least("l1", "l2").alias("label")), name)
        unstage(last)
        last, labels = new, new.select("node", "label")
        if not new.where("label <> old").limit(1).count():
            unstage(both)
            return labels
