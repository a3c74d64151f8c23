"""Quality scores: random Fourier features of document statistics, ridge regression, isotonic calibration.

Statistics come from quality_rules.statistics (Spark expressions over whole texts) and are standardised by their training
mean and deviation. A fixed number of random cosines approximates a Gaussian kernel. Each partition sums its part of the
normal equations, Spark adds the parts, and the driver solves one system of fixed size. Predictions of training rows that
the system has not seen are counted in fixed bins, made monotone by pooling adjacent violators and joined by lines.

Labels are used only from rows whose crc32(doc_id) mod 5 is not 0. Cases: null and empty texts have the statistics of an
empty text and are scored like any other; repeated rows get equal scores; without labels of both classes, every score is
the share of label 1 (0.5 without any); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import stage
from tesserae.llm.quality_rules import FEATURES, labelled, statistics

COLUMNS = [*FEATURES, "f_digits", "f_log_words", "f_variety"]
N_COSINES, WIDTH, RIDGE = 256, 3.0, 1e-3
#: At most about this many labelled rows are learned from (chosen by a hash of doc_id).
LABELLED = 60_000
BINS, PARTS = 400, 16
#: Standardised statistics count as at most this many deviations.
CLIP = 5.0
THRESHOLD = 0.3


def _cosines(seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.Generator(np.random.PCG64(seed))
    return r.normal(size=(len(COLUMNS), N_COSINES)) / WIDTH, r.uniform(0, 2 * np.pi, N_COSINES)


def features(values: np.ndarray, mean: np.ndarray, deviation: np.ndarray) -> np.ndarray:
    """Random Fourier features and a constant. Columns are added in a fixed order, so a row's features do not depend on the
    rows beside it (a matrix product's last digits do)."""
    w, b = _cosines()
    z = np.clip((np.nan_to_num(values) - mean) / deviation, -CLIP, CLIP)
    angle = np.repeat(b[None, :], len(z), axis=0)
    for k in range(len(w)):
        angle += z[:, k, None] * w[k]
    return np.hstack((np.sqrt(2 / N_COSINES) * np.cos(angle), np.ones((len(z), 1))))


def predicted(values: np.ndarray, mean: np.ndarray, deviation: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Raw scores, each row summed for itself: equal rows get equal scores in whatever batch."""
    return (features(values, mean, deviation) * weights).sum(axis=1)


def normal_equations(rows: DataFrame, mean: np.ndarray, deviation: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums over all rows of features x features and features x y; parts are summed per partition, then by Spark."""

    def part(batches):
        total = None
        for pdf in batches:
            if len(pdf):
                f = features(pdf[COLUMNS].to_numpy(float), mean, deviation)
                own = f.T @ np.hstack((f, pdf[["y"]].to_numpy(float)))
                total = own if total is None else total + own
        if total is not None:
            yield pd.DataFrame({"i": range(len(total)), "row": list(total)})

    parts = rows.repartition(PARTS).mapInPandas(part, "i int, row array<double>").groupBy("i").agg(F.collect_list("row").alias("rows"))
    got = parts.select("i", F.aggregate(F.slice("rows", 2, PARTS), F.get("rows", F.lit(0)), lambda a, b: F.zip_with(a, b, lambda x, y: x + y)).alias("row")).orderBy("i").collect()  # N_COSINES + 1 rows
    m = np.array([r.row for r in got])
    return m[:, :-1], m[:, -1]


def pool(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic fit by pooling adjacent violators: centres and levels of the blocks."""
    blocks: list[list[float]] = []
    for a, b, c in zip(x, y, n, strict=True):
        blocks.append([a * c, b * c, c])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last, strict=True)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


def scored(docs: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """doc_id, held_out, score and predicted of each row."""
    stats = stage(statistics(docs, extra=True).select("doc_id", *COLUMNS), "statistics")
    fold = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(5))
    rows = stage(labelled(stats, labels, label, LABELLED).where(fold != 0).withColumn("fold", fold), "labelled")
    sums = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("y"), *[F.avg(c).alias(f"m_{c}") for c in COLUMNS], *[F.stddev_pop(c).alias(f"s_{c}") for c in COLUMNS]).first()
    flat = (sums["y"] or 0) / sums["n"] if sums["n"] else 0.5
    seen = rows.where("fold <> 4")
    classes = seen.select("y").distinct().count()
    if classes < 2:
        out = stats.select("doc_id", (fold == 0).alias("held_out"), F.lit(float(flat)).alias("score"))
        return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
    mean = np.array([sums[f"m_{c}"] for c in COLUMNS])
    deviation = np.array([sums[f"s_{c}"] or 1.0 for c in COLUMNS])
    deviation[deviation < 1e-12] = 1.0
    a, b = normal_equations(seen, mean, deviation)
    weights = np.linalg.solve(a + RIDGE * a[-1, -1] * np.eye(len(a)), b)

    def raw(batches):
        for pdf in batches:
            yield pdf.drop(columns=COLUMNS).assign(raw=predicted(pdf[COLUMNS].to_numpy(float), mean, deviation, weights))

    fresh = rows.where("fold = 4").select("y", *COLUMNS).mapInPandas(raw, "y int, raw double")
    binned = fresh.groupBy(F.round(F.least(F.greatest("raw", F.lit(-0.5)), F.lit(1.5)) * BINS).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("y")).orderBy("bin").collect()  # 2 * BINS + 1 rows at most
    if binned:
        x, y = pool(np.array([r.bin for r in binned]) / BINS, np.array([r.y for r in binned]), np.array([r.n for r in binned], float))
    else:
        x, y = np.array([0.0, 1.0]), np.array([0.0, 1.0])

    def final(batches):
        for pdf in batches:
            own = predicted(pdf[COLUMNS].to_numpy(float), mean, deviation, weights)
            # within a level the raw score still orders rows, by a thousandth at most
            yield pdf[["doc_id", "held_out"]].assign(score=np.clip(0.998 * np.interp(own, x, y) + 0.002 / (1 + np.exp(-4 * (own - 0.5))), 0, 1))

    out = stats.withColumn("held_out", fold == 0).mapInPandas(final, "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
