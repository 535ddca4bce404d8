"""Problem 9: items of varying size in containers of fixed capacity, best fit decreasing.

Best fit decreasing depends only on how many items there are of each size, so the plan is made from
the histogram (at most capacity + 1 rows, whatever the number of items): a segment tree over the
remaining capacities finds the tightest open container, and items of one size are placed in runs.
The items then get their numbers within their size in parallel, and from them their containers; the
result is that of the item-by-item procedure.

Defined cases: an item beyond the capacity is cut into full pieces and a rest, each piece an item of
its own; an item of size 0 (also of null size) is one piece of size 0 in container 0; repeated rows are items of
their own only if their keys differ; no items give no rows.
"""
from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from treillis.session import bound_arrow_batches, cut

#: Items of one size numbered within one task.
ITEMS_PER_BUCKET = 50_000


class OpenContainers:
    """Segment tree over remaining capacities: how many runs of open containers each has."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.tree = [0] * (2 * self.size)
        self.runs: list[deque[tuple[int, int]]] = [deque() for _ in range(capacity + 1)]

    def add(self, remaining: int, first: int, number: int) -> None:
        runs = self.runs[remaining]
        if runs and sum(runs[-1]) == first:
            runs[-1] = (runs[-1][0], runs[-1][1] + number)
            return
        runs.append((first, number))
        self._change(remaining, 1)

    def take(self, remaining: int) -> tuple[int, int]:
        self._change(remaining, -1)
        return self.runs[remaining].popleft()

    def put_back(self, remaining: int, first: int, number: int) -> None:
        self.runs[remaining].appendleft((first, number))
        self._change(remaining, 1)

    def _change(self, at: int, by: int) -> None:
        at += self.size
        while at:
            self.tree[at] += by
            at >>= 1

    def tightest(self, least: int) -> int:
        """The smallest remaining capacity of at least ``least`` with an open container, or -1."""
        at = least + self.size
        if not self.tree[at]:
            while at > 1 and (at & 1 or not self.tree[at + 1]):
                at >>= 1
            if at <= 1:
                return -1
            at += 1
        while at < self.size:
            at = 2 * at if self.tree[2 * at] else 2 * at + 1
        return at - self.size


def plan_containers(histogram: dict[int, int], capacity: int) -> np.ndarray:
    """Runs (size, first item, items per container, first container) of best fit decreasing, sorted.

    A step uses up a run of equal containers or a size, and adds at most one run, so that there are
    at most 2 * capacity runs at a time and the plan doesn't grow with the number of items."""
    open_, plan, next_ = OpenContainers(capacity), [], 0
    for size in sorted((s for s in histogram if s > 0), reverse=True):
        left, item = histogram[size], 0
        while left:
            remaining = open_.tightest(size)
            if remaining < 0:
                number = -(-left // (capacity // size))
                open_.add(capacity, next_, number)
                next_ += number
                continue
            first, number = open_.take(remaining)
            each = min(remaining // size, left)
            used = min(number, left // each)
            plan.append((size, item, each, first))
            if used < number:
                open_.put_back(remaining, first + used, number - used)
            open_.add(remaining - each * size, first, used)
            item += used * each
            left -= used * each
    return np.array(sorted(plan), dtype=np.int64).reshape(-1, 4)


def pack(items: DataFrame, key: str, size: str, capacity: int) -> DataFrame:
    """``key``, ``rang`` (place of the piece in its item), ``taille`` and ``conteneur`` of every piece."""
    bound_arrow_batches(items.sparkSession)
    n = F.coalesce(F.col(size), F.lit(0)).cast("long")
    pieces = cut(
        items.select(F.col(key).alias("_cle"), n.alias("_n"))
        .select("_cle", "_n", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.col("_n") - 1) / capacity).cast("int")))).alias("rang"))
        .select("_cle", "rang", F.least(F.lit(capacity), F.col("_n") - F.col("rang").cast("long") * capacity).cast("int").alias("taille"))
    )
    histogram = {r[0]: r[1] for r in pieces.groupBy("taille").count().collect()}  # at most capacity + 1 rows
    plan = items.sparkSession.sparkContext.broadcast(plan_containers(histogram, capacity))
    buckets = max(8, -(-sum(histogram.values()) // ITEMS_PER_BUCKET))
    salted = pieces.withColumn("_b", F.pmod(F.xxhash64("_cle", "rang"), F.lit(buckets)).cast("int"))
    before = Window.partitionBy("taille").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = salted.groupBy("taille", "_b").count().select(F.col("taille").alias("_t"), F.col("_b").alias("_c"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_debut"))
    numbered = (
        salted.withColumn("_rn", F.row_number().over(Window.partitionBy("taille", "_b").orderBy("_cle", "rang")))
        .join(starts, (F.col("taille") == F.col("_t")) & (F.col("_b") == F.col("_c")))
        .select("_cle", "rang", "taille", (F.col("_debut") + F.col("_rn") - 1).cast("long").alias("_i"))
    )
    kind = items.schema[key].dataType.simpleString()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = plan.value
        order = runs[:, 0] << 44 | runs[:, 1]
        for batch in batches:
            sizes, number = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (2, 3))
            if len(runs):
                run = runs[np.maximum(np.searchsorted(order, sizes << 44 | number, side="right") - 1, 0)]
                container = np.where(sizes > 0, run[:, 3] + (number - run[:, 1]) // run[:, 2], 0)
            else:
                container = np.zeros(len(sizes), np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(container)], names=[key, "rang", "taille", "conteneur"])

    return numbered.mapInArrow(place, f"`{key}` {kind}, rang int, taille int, conteneur bigint")


def usage(packed: DataFrame, capacity: int) -> DataFrame:
    """Containers, the least possible number by total size, and the unused share of their capacity."""
    full = packed.groupBy("conteneur").agg(F.sum("taille").alias("plein"))
    return full.agg(
        F.count("*").alias("n_conteneurs"),
        F.ceil(F.sum("plein") / capacity).alias("n_au_moins"),
        F.max("plein").alias("plus_plein"),
        F.round(1 - F.sum("plein") / F.nullif(F.count("*") * F.lit(capacity), F.lit(0)), 6).alias("part_vide"),
    )
