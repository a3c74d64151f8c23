"""The first matches of each request and the number of them all, without a row per pair.

Requests and scenes are listed under the cells of a range join. The scenes of a cell are dealt to parts of about PART by a hash,
and each request goes to every part of its cells. A task holds one part, in search order, as ranks of its values in blocks of
BLOCK scenes; requests stream past it. A comparison is one of two numbers of 16 bits, a count is the sum of a mask, and the
first matches are the first places of the mask; so what is shuffled is a few rows for each request and part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.operators import ranges

#: Scenes of a cell that a task holds, and those that are compared at once.
PART, BLOCK = 1 << 18, 1 << 16
_LEAST, _MOST = -(2**63), 2**63 - 1
_CELL = ["met", "level", "cx", "cy"]
#: Values of a scene that may be at most, or must be at least, the request's.
_AT_MOST = {"a": "c", "miny": "maxy", "until": "until", "cloud": "cloud"}
_AT_LEAST = {"c": "a", "maxy": "miny", "since": "since"}


class Block:
    """Scenes in search order, as ranks of their values."""

    def __init__(self, rows: dict[str, np.ndarray], start: int, end: int):
        self.start, self.size = start, end - start
        self.rows = {k: v[start:end] for k, v in rows.items()}
        self.ranks = {}
        for c in (*_AT_MOST, *_AT_LEAST):
            values, rank = np.unique(self.rows[c], return_inverse=True)
            self.ranks[c] = values, rank.astype(np.uint16)
        self.crosses = self.rows["minx"] > self.rows["maxx"]
        self.mask, self.part = np.empty(self.size, bool), np.empty(self.size, bool)

    def masks(self, asked: dict[str, np.ndarray]):
        """For each request with a match here: its place and the mask of the scenes that match."""
        tests, dead = [], np.zeros(len(asked["a"]), bool)
        for c, of in _AT_MOST.items():
            values, rank = self.ranks[c]
            at = np.searchsorted(values, asked[of], "right")
            dead |= at == 0
            tests.append((np.less, rank, at, len(values)))
        for c, of in _AT_LEAST.items():
            values, rank = self.ranks[c]
            at = np.searchsorted(values, asked[of], "left")
            dead |= at == len(values)
            tests.append((np.greater_equal, rank, at, 0))
        crossing = self.crosses.any()
        for i in np.flatnonzero(~dead).tolist():
            mask = self.mask
            mask[:] = True
            for test, rank, at, every in tests:
                if at[i] != every:
                    mask &= test(rank, np.uint16(at[i]), out=self.part)
            for c in ("begins_x", "begins_y"):  # the cell of the lower left corner of the overlap gives the pair
                if not asked[c][i]:
                    mask &= self.rows[c]
            if crossing or asked["minx"][i] > asked["maxx"][i]:
                mask &= self._first_parts({k: v[i] for k, v in asked.items()})
            yield i, mask

    def _first_parts(self, r: dict) -> np.ndarray:
        """Of several parts of boxes that cross the antimeridian, the first pair counts."""
        first = self.rows["piece"] == 0
        if r["minx"] > r["maxx"]:
            if r["piece"] == 0:
                return ~self.crosses | first
            return ~self.crosses & (self.rows["maxx"] < r["minx"])
        return ~self.crosses | first | (r["maxx"] < self.rows["minx"])


def _numbers(rows: pa.RecordBatch | pa.Table, names) -> dict[str, np.ndarray]:
    return {c: rows.column(c).to_numpy(zero_copy_only=False) if isinstance(rows, pa.RecordBatch) else rows.column(c).to_numpy() for c in names}


_NAMES = ("a", "c", "miny", "maxy", "since", "until", "cloud", "begins_x", "begins_y", "minx", "maxx", "piece")


class Part:
    """The scenes of a part, in search order."""

    def __init__(self, slices: list[pa.RecordBatch]):
        self.table = pa.Table.from_batches(slices).combine_chunks()
        rows, n = _numbers(self.table, _NAMES), self.table.num_rows
        self.blocks = [Block(rows, k, min(k + BLOCK, n)) for k in range(0, n, BLOCK)]

    def answers(self, asked: pa.RecordBatch):
        """request_id, top, scene_id, key of the first matches; n: the number of all matches, at the first row of each request."""
        most = asked.column("most").to_numpy()
        step = max(1, (1 << 20) // int(most.max()))
        for k in range(0, asked.num_rows, step):
            yield from self._answered(asked.slice(k, step), most[k : k + step])

    def _answered(self, asked: pa.RecordBatch, most: np.ndarray):
        values, count = _numbers(asked, _NAMES), np.zeros(len(most), np.int64)
        left, who, places = most.tolist(), [], []
        for b in self.blocks:
            for i, mask in b.masks(values):
                n = int(np.count_nonzero(mask))
                count[i] += n
                want = min(n, left[i])
                if want:
                    at = np.flatnonzero(mask[:4096])
                    if len(at) < want:
                        at = np.flatnonzero(mask)
                    who.append(np.full(want, i))
                    places.append(at[:want] + b.start)
                    left[i] -= want
        if not who:
            return
        who, places = np.concatenate(who), np.concatenate(places)
        some, first = np.unique(who, return_index=True)
        n = np.zeros(len(who), np.int64)
        n[first] = count[some]
        scenes = self.table.select(["scene_id", "key"]).take(pa.array(places))
        own = [asked.column(c).take(pa.array(who)) for c in ("request_id", "top")]
        yield pa.RecordBatch.from_arrays([*own, *[c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in scenes.columns], pa.array(n)], ["request_id", "top", "scene_id", "key", "n"])


def _answers(batches):
    key, held, part = None, [], None
    for batch in batches:
        of = np.stack([batch.column(c).to_numpy() for c in (*_CELL, "part", "side")])
        cut = [0, *(np.flatnonzero((of[:, 1:] != of[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
        for x, y in zip(cut[:-1], cut[1:], strict=True):
            if x == y:
                continue
            *now, side = of[:, x].tolist()
            if now != key:
                key, held, part = now, [], None
            if side == 0:
                held.append(batch.slice(x, y - x))
            elif held:
                part = part or Part(held)
                yield from part.answers(batch.slice(x, y - x))


def _instant(c: str, df: DataFrame, local: bool) -> Column:
    """Microseconds of a time; local: of one without a zone, as if it were in UTC."""
    if local and dict(df.dtypes)[c] == "timestamp_ntz":
        return F.expr(f"unix_micros(make_timestamp(year({c}), month({c}), day({c}), hour({c}), minute({c}), extract(SECOND FROM {c}), 'UTC'))")
    return F.unix_micros(F.col(c).cast("timestamp"))


def first_matches(asked: DataFrame, scenes: DataFrame, listed: DataFrame | None = None) -> DataFrame:
    """request_id, top, scene_id, key, n: rows that hold the first `most` scenes of each row of asked, newest first, undated
    scenes last, then by scene_id; n sums up to the number of all its matches, key orders by time. top is passed through.

    asked: request_id, top, most (at least 1), the box, since, until, cloud_max. listed: boxes that hold those of the scenes,
    from which levels and crowded cells are told, if that is cheaper than from the scenes.
    """
    listed = (scenes if listed is None else listed).select(*ranges._BOX)
    local = {dict(asked.dtypes)["since"], dict(asked.dtypes)["until"], dict(scenes.dtypes)["acquired_at"]} <= {"timestamp_ntz", "void"}
    l_parts, r_parts = ranges._parts(asked, "l_"), ranges._parts(scenes, "r_")
    l_levels, boxes = ranges._levels(l_parts, "l_"), ranges._parts(listed, "r_")
    r_levels = ranges._levels(boxes, "r_")
    cells = ranges._listed(boxes, "r_", l_levels).groupBy(*_CELL).agg(F.count(F.lit(1)).alias("n"))
    crowded = F.broadcast(cells.where(F.col("n") > PART).select(*_CELL, F.ceil(F.col("n") / PART).cast("int").alias("parts")))

    def common(rows: DataFrame, p: str, side: int, more: dict[str, Column]) -> DataFrame:
        begins = lambda x, at: ranges._cell(F.col(f"{p}{x}").cast("double"), F.col("level")) == F.col(at)
        box = {c: F.col(f"{p}{c}").cast("double") for c in ("a", "c", *ranges._BOX)}
        cell = {"met": (F.col("met") == "l").cast("int"), **{c: F.col(c).cast("long") for c in _CELL[1:]}}
        every = {**cell, "part": F.col("of_part"), "side": F.lit(side), **box, "piece": F.col(f"{p}part").cast("int"), "begins_x": begins("a", "cx"), "begins_y": begins("miny", "cy"), **more}
        return rows.select(*[v.alias(k) for k, v in every.items()])

    def null(c: str, df: DataFrame) -> Column:
        return F.lit(None).cast(df.schema[c].dataType)

    parts = F.coalesce("parts", F.lit(1))
    left = ranges._listed(l_parts, "l_", r_levels).join(crowded, _CELL, "left").withColumn("of_part", F.explode(F.sequence(F.lit(0), parts - 1)))
    right = ranges._listed(r_parts, "r_", l_levels).join(crowded, _CELL, "left").withColumn("of_part", F.pmod(F.xxhash64("scene_id"), parts).cast("int"))
    at = _instant("acquired_at", scenes, local)
    requests = common(left, "l_", 1, {
        "since": F.coalesce(_instant("since", asked, local), F.lit(_LEAST)), "until": F.coalesce(_instant("until", asked, local), F.lit(_MOST)),
        "cloud": F.coalesce(F.col("cloud_max").cast("double"), F.lit(float("nan"))), "request_id": F.col("request_id"), "top": F.col("top"), "most": F.col("most"),
        "scene_id": null("scene_id", scenes), "key": F.lit(0).cast("long"),
    })
    found = common(right, "r_", 0, {
        "since": F.coalesce(at, F.lit(_MOST)), "until": F.coalesce(at, F.lit(_LEAST)), "cloud": F.coalesce(F.col("cloud_cover").cast("double"), F.lit(float("-inf"))),
        "request_id": null("request_id", asked), "top": null("top", asked), "most": null("most", asked),
        "scene_id": F.col("scene_id"), "key": F.coalesce(_instant("acquired_at", scenes, True), F.lit(_LEAST)),
    })
    place = [*_CELL, "part"]
    sent = found.unionByName(requests).repartition(*place).sortWithinPartitions(*place, "side", F.desc("key"), "scene_id")
    kinds = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c, df in (("request_id", asked), ("top", asked), ("scene_id", scenes)))
    return sent.mapInArrow(_answers, f"{kinds}, key long, n long")
