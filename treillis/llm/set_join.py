"""Problem 5: all pairs of records whose sets of values overlap at least as much as a threshold.

Equal sets form a class and only one of them is compared. Values are put in one global order, frequent ones
last; two sets that reach the threshold share a value among the first few of each (prefix filter), so sets
meet only where they share such a value. There, T-occurrence list merging finds the partners of each set:
inverted lists over the sets that met, the longest lists set aside, the others merged with a heap that skips
what can't reach the required overlap (DivideSkip), and candidates looked up in the longest lists by binary
search. A pair is emitted only where its first common value sends it. A value that brings many sets
together is split into blocks, and each pair of blocks is a task of its own.

Defined cases: null values count for nothing, values of a set count once; sets below the least size have no
pair; equal sets are one class with its members; two references are never a pair; an empty side gives pairs
of the other only.
"""
from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treillis.session import bound_arrow_batches, cut

#: Least size of a set; the threshold is the fraction UP / DOWN of shared values in those of both.
LEAST, UP, DOWN = 12, 7, 10
#: Sets in a block, rows in a bucket of rare values, and most values counted as frequent.
BLOCK, BUCKET, FREQUENT = 5_000, 4_000, 20_000


def _ceil(a: int, b: int) -> int:
    return -(-a // b)


def record_sets(records: DataFrame, key: str = "enr_id") -> DataFrame:
    """``uid`` (even) and ``valeurs`` (64-bit digests of the distinct (trait, symbole)) of collected records."""
    def of(array: str, field: str):
        return F.transform(F.filter(F.coalesce(F.col(f"{array}.{field}"), F.array().cast("array<string>")), lambda x: x.isNotNull()), lambda x: F.xxhash64(F.lit(array), x))

    return records.select((F.col(key) * 2).alias("uid"), F.array_distinct(F.concat(of("H", "forme_normalisee"), of("TRT", "type"), of("SST", "tag"))).alias("valeurs"))


def reference_sets(signatures: DataFrame, key: str = "ref_id") -> DataFrame:
    """``uid`` (odd) and ``valeurs`` of references in long form."""
    known = signatures.filter("trait is not null and symbole is not null")
    return known.groupBy(key).agg(F.collect_set(F.xxhash64("trait", "symbole")).alias("valeurs")).select((F.col(key) * 2 + 1).alias("uid"), "valeurs")


def divide_skip(lists: list[list[int]], least: int, low: int, high: int) -> Iterator[tuple[int, int]]:
    """The numbers in [low, high) that stand in at least ``least`` of the sorted lists, and in how many."""
    # (list, place, end) of the part of each list that counts, longest last
    live = sorted(((x, a, b) for x in lists if (a := bisect_left(x, low)) < (b := bisect_left(x, high))), key=lambda x: x[2] - x[1])
    if len(live) < least:
        return
    aside = min(least - 1, int(least / (0.01 * log(live[-1][2] - live[-1][1] + 1) + 1)))
    long, short = live[len(live) - aside :], live[: len(live) - aside]
    need = least - aside
    at = [a for _, a, _ in short]
    heap = [(x[a], k) for k, (x, a, _) in enumerate(short)]
    heapq.heapify(heap)
    while heap:
        top = heap[0][0]
        same = []
        while heap and heap[0][0] == top:
            same.append(heapq.heappop(heap)[1])
        if len(same) >= need:
            n = len(same)
            for done, (x, a, b) in enumerate(reversed(long)):
                if n + aside - done < least:
                    break
                p = bisect_left(x, top, a, b)
                n += p < b and x[p] == top
            if n >= least:
                yield top, n
            target = top + 1
        else:
            while heap and len(same) < need - 1:
                same.append(heapq.heappop(heap)[1])
            if not heap:
                return
            target = heap[0][0]
            target = max(target, top + 1)
        for k in same:
            x, _, b = short[k]
            at[k] = p = bisect_left(x, target, at[k], b)
            if p < b:
                heapq.heappush(heap, (x[p], k))


def pairs_of(rows: list[tuple[int, bool, int, list[int], list[int]]]) -> Iterator[tuple[int, int, int]]:
    """Pairs (uid, smaller or equal partner, shared) of rows (uid, has a record, role, sent values, ordered values).

    Role 0 is searched and searches, 1 is only searched, 2 only searches."""
    rows = sorted(rows, key=lambda r: (len(r[4]), r[0]))
    index = [r for r in rows if r[2] != 2]
    sizes = [len(r[4]) for r in index]
    ranks = [(len(r[4]), r[0]) for r in index]
    lists: dict[int, list[int]] = {}
    for k, r in enumerate(index):
        for v in r[4]:
            lists.setdefault(v, []).append(k)
    for uid, real, role, sent, own in rows:
        if role == 1:
            continue
        n = len(own)
        smallest = _ceil(UP * n, DOWN)
        low, high = bisect_left(sizes, smallest), bisect_left(ranks, (n, uid))
        if low >= high:
            continue
        for k, shared in divide_skip([lists[v] for v in own if v in lists], _ceil(UP * (n + smallest), UP + DOWN), low, high):
            other = index[k]
            if DOWN * shared >= UP * (n + len(other[4]) - shared) and (real or other[1]):
                theirs = set(other[4])
                if next(v for v in own if v in theirs) in sent:
                    yield uid, other[0], shared


class SetJoin:
    """The similar pairs among the sets (uid, valeurs) given."""

    def __init__(self, sets: DataFrame):
        spark = sets.sparkSession
        bound_arrow_batches(spark)
        large = sets.filter(F.size("valeurs") >= LEAST).withColumn("valeurs", F.array_sort("valeurs"))
        self.sets = cut(large.select("uid", F.xxhash64("valeurs").alias("_h"), F.xxhash64(F.lit(1), "valeurs").alias("_k"), "valeurs"))
        self.classes = cut(self.sets.groupBy("_h", "_k").agg(F.min("uid").alias("classe"), F.count("*").alias("n"), F.min(F.col("uid") % 2).alias("_ref")))

    def members(self) -> DataFrame:
        """``uid`` and ``classe`` of every set."""
        return self.sets.select("uid", "_h", "_k").join(self.classes, ["_h", "_k"]).select("uid", "classe")

    def _ordered(self) -> DataFrame:
        one = self.sets.join(self.classes.select("_h", "_k", "classe", "_ref"), ["_h", "_k"]).filter("uid = classe").select("classe", "_ref", "valeurs")
        freq = one.select(F.explode("valeurs").alias("v")).groupBy("v").agg(F.count("*").alias("n"))
        total = self.classes.count()
        # At most FREQUENT values: sets have a few dozen values on average, and the sum bounds how many reach the limit.
        sums = one.agg(F.coalesce(F.sum(F.size("valeurs")), F.lit(0))).first()[0]
        frequent = {v: n for v, n in freq.filter(F.col("n") >= max(50, total // 1000, sums // FREQUENT)).collect()}
        sent = one.sparkSession.sparkContext.broadcast(frequent)

        def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                values = [sorted(x, key=lambda v: (sent.value.get(v, 0), v)) for x in b.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(values, pa.list_(pa.int64()))], names=["classe", "_ref", "valeurs"])

        return cut(one.mapInArrow(order, "classe bigint, _ref bigint, valeurs array<bigint>"))

    def class_pairs(self) -> DataFrame:
        """``classe_a``, ``classe_b`` and ``communs`` of every similar pair of classes."""
        ordered = self._ordered()
        n = F.size("valeurs")
        first = ordered.select("classe", "_ref", F.explode(F.slice("valeurs", F.lit(1), n - F.ceil(n * F.lit(UP) / F.lit(DOWN)).cast("int") + 1)).alias("v"))
        meeting = first.groupBy("v").agg(F.count("*").alias("_n"), F.min("_ref").alias("_r")).filter("_n > 1 and _r = 0").withColumn("_blocs", F.ceil(F.col("_n") / BLOCK).cast("int"))
        sent = cut(first.select("classe", "v").join(meeting.select("v", "_blocs"), "v"))
        buckets = max(8, _ceil(sent.count(), BUCKET))
        rare = sent.filter("_blocs = 1").groupBy("classe", F.pmod("v", F.lit(buckets)).alias("_cle")).agg(F.collect_set("v").alias("_v")).select("classe", "_cle", F.lit(-1).alias("_i"), F.lit(-1).alias("_j"), F.lit(0).alias("_role"), "_v")
        own = F.pmod(F.xxhash64("classe"), F.col("_blocs")).cast("int")
        hot = sent.filter("_blocs > 1").withColumn("_b", own).withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_blocs") - 1)))
        searched = hot.select("classe", F.col("v").alias("_cle"), F.col("_b").alias("_i"), F.col("_o").alias("_j"), F.when(F.col("_b") == F.col("_o"), 0).otherwise(1).alias("_role"), F.array("v").alias("_v"))
        searching = hot.filter("_b <> _o").select("classe", F.col("v").alias("_cle"), F.col("_o").alias("_i"), F.col("_b").alias("_j"), F.lit(2).alias("_role"), F.array("v").alias("_v"))
        rows = rare.union(searched).union(searching).join(ordered, "classe")

        def merge(part: pa.Table) -> pa.Table:
            cols = (part[c].to_pylist() for c in ("classe", "_ref", "_role", "_v", "valeurs"))
            found = list(pairs_of([(c, r == 0, role, v, x) for c, r, role, v, x in zip(*cols)]))
            a = np.array(found, dtype=np.int64).reshape(-1, 3)
            return pa.table({"classe_a": a[:, 0], "classe_b": a[:, 1], "communs": a[:, 2]})

        return rows.groupBy("_cle", "_i", "_j").applyInArrow(merge, "classe_a bigint, classe_b bigint, communs bigint")

    def links(self) -> DataFrame:
        """Every set's ``uid`` and ``classe``, the size of its class and its number of similar other sets.

        Sets of references count as partners of sets of records only."""
        pairs = cut(self.class_pairs())
        kinds = cut(self.members().groupBy("classe").agg(F.count_if(F.col("uid") % 2 == 0).alias("_rec"), F.count("*").alias("n")))
        both = pairs.select(F.col("classe_a").alias("classe"), F.col("classe_b").alias("_o")).union(pairs.select(F.col("classe_b"), F.col("classe_a")))
        other = both.join(kinds.select(F.col("classe").alias("_o"), F.col("_rec").alias("_orec"), F.col("n").alias("_on")), "_o").groupBy("classe").agg(F.sum("_orec").alias("_orec"), F.sum("_on").alias("_on"))
        mine = self.members().join(kinds, "classe").join(other, "classe", "left")
        is_rec = F.col("uid") % 2 == 0
        around = F.when(is_rec, F.col("n") - 1 + F.coalesce("_on", F.lit(0))).otherwise(F.col("_rec") + F.coalesce("_orec", F.lit(0)))
        return mine.select((F.floor(F.col("uid") / 2)).alias("id"), (~is_rec).alias("reference"), F.col("classe"), F.col("n").alias("n_classe"), around.alias("n_liens"))

    def pairs(self) -> DataFrame:
        """All pairs ``id_a``, ``id_b``, the smaller id first."""
        members = self.members()
        a, b = members.toDF("_a", "classe_a"), members.toDF("_b", "classe_b")
        apart = self.class_pairs().join(a, "classe_a").join(b, "classe_b").select("_a", "_b")
        several = self.classes.filter("n > 1").select(F.col("classe").alias("classe_a"))
        twin = a.join(several, "classe_a").join(members.toDF("_b", "classe_a"), "classe_a").filter("_a < _b").select("_a", "_b")
        x, y = F.col("_a"), F.col("_b")
        ids = [F.floor(c / 2).cast("long") for c in (x, y)]
        return apart.union(twin).filter((x % 2 == 0) | (y % 2 == 0)).select(F.least(*ids).alias("id_a"), F.greatest(*ids).alias("id_b"))
