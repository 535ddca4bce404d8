"""Problem 4: how often every distinct value occurs and in how many records.

Burst-trie counting: each task routes the values it reads through a trie whose leaves are small
containers of suffixes; a container that grows too large bursts into a node with one container a letter.
A full trie is sent on as rows of containers and begun anew, so that a task's memory is bounded. The
sizes of the containers, summed by prefix over all tasks, say which prefixes are heavy; a value's route is
its shortest prefix that isn't. There are few heavy prefixes whatever the number of values (those with
more than 1 / ROUTES of all entries, at most ROUTES at each depth), so they go to every task. Matching
subtrees of all tasks meet by route, each of bounded size, and are merged into one trie, container by container; a
value held by every record is one entry a task by then.

Defined cases: null values and null or empty arrays count nothing, the empty text is a value; values are
compared character for character; a value in several entries of a record counts once in its records; with
at most RARE records a value is rare even if it is also common.
"""
from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treillis.session import bound_arrow_batches, cut

#: Suffixes in a container before it bursts; entries in a task's trie before it is sent on.
BURST, FULL = 64, 100_000
#: Most heavy prefixes at one depth, entries a route may always have, and the deepest prefix that routes.
ROUTES, ROUTE_ENTRIES, DEPTH = 256, 20_000, 64
#: Values in at most RARE records are rare, in more than COMMON of all records common.
RARE, COMMON = 2, 0.2


class BurstTrie:
    """Counters of occurrences and records by term; a node maps a letter to a node or to a container."""

    def __init__(self):
        self.root, self.entries = [{}, None], 0

    def add(self, term: str, occurrences: int, records: int) -> None:
        node, i = self.root, 0
        while True:
            if i == len(term):
                if node[1] is None:
                    node[1] = [0, 0]
                    self.entries += 1
                count = node[1]
                break
            kid = node[0].get(term[i])
            if kid is None:
                kid = node[0][term[i]] = {}
            if type(kid) is list:
                node, i = kid, i + 1
                continue
            rest = term[i + 1 :]
            count = kid.get(rest)
            if count is None:
                count = kid[rest] = [0, 0]
                self.entries += 1
                if len(kid) > BURST:
                    node[0][term[i]] = self._burst(kid)
            break
        count[0] += occurrences
        count[1] += records

    def graft(self, prefix: str, suffixes: list[str], occurrences: list[int], records: list[int]) -> None:
        """Merges a container of another trie into the subtree at its prefix."""
        node = self.root
        for i, letter in enumerate(prefix):
            kid = node[0].get(letter)
            if type(kid) is list:
                node = kid
                continue
            rest, kid = prefix[i + 1 :], node[0].setdefault(letter, {})
            before = len(kid)
            for s, o, r in zip(suffixes, occurrences, records):
                count = kid.setdefault(rest + s, [0, 0])
                count[0] += o
                count[1] += r
            self.entries += len(kid) - before
            if len(kid) > BURST:
                node[0][letter] = self._burst(kid)
            return
        whole, self.root = self.root, node  # the prefix ends at a node: go on below it
        for s, o, r in zip(suffixes, occurrences, records):
            self.add(s, o, r)
        self.root = whole

    @staticmethod
    def _burst(container: dict[str, list[int]]) -> list:
        node: list = [{}, container.pop("", None)]
        for rest, count in container.items():
            node[0].setdefault(rest[0], {})[rest[1:]] = count
        return node

    def containers(self) -> Iterator[tuple[str, dict[str, list[int]]]]:
        """Each container with its prefix; a term that ends at a node is the empty suffix there."""
        stack: list = [("", self.root)]
        while stack:
            prefix, node = stack.pop()
            if type(node) is dict:
                yield prefix, node
                continue
            if node[1] is not None:
                yield prefix, {"": node[1]}
            stack.extend((prefix + letter, kid) for letter, kid in node[0].items())


_ROWS = "trait string, prefixe string, suffixes array<string>, occurrences array<bigint>, fiches array<bigint>"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tries: dict[str, BurstTrie] = defaultdict(BurstTrie)

    def sent(trait: str) -> Iterator[pa.RecordBatch]:
        columns: list[list] = [[], [], [], [], []]
        for prefix, container in tries.pop(trait).containers():
            for c, v in zip(columns, (trait, prefix, list(container), [x[0] for x in container.values()], [x[1] for x in container.values()])):
                c.append(v)
            if len(columns[0]) >= 2000:
                yield batch(columns)
                columns = [[], [], [], [], []]
        if columns[0]:
            yield batch(columns)

    def batch(c: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c[0], pa.string()), pa.array(c[1], pa.string()), pa.array(c[2], pa.list_(pa.string())), pa.array(c[3], pa.list_(pa.int64())), pa.array(c[4], pa.list_(pa.int64()))], names=["trait", "prefixe", "suffixes", "occurrences", "fiches"])

    for b in batches:
        names = b.column(0).to_pylist()
        for trait in dict.fromkeys(names):
            lists = b.column(1).filter(pc.equal(b.column(0), trait))
            row = pc.list_parent_indices(lists)
            coded = pc.dictionary_encode(pc.list_flatten(lists))
            code = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            keep = code >= 0
            n = len(coded.dictionary)
            occurrences = np.bincount(code[keep], minlength=n)
            records = np.bincount(np.unique(row.to_numpy()[keep].astype(np.int64) * max(n, 1) + code[keep]) % max(n, 1), minlength=n)
            trie = tries[trait]
            for term, o, r in zip(coded.dictionary.to_pylist(), occurrences.tolist(), records.tolist()):
                trie.add(term, o, r)
            if trie.entries >= FULL:
                yield from sent(trait)
    for trait in list(tries):
        yield from sent(trait)


def counts(values: DataFrame) -> DataFrame:
    """``trait``, ``symbole``, ``n_occurrences``, ``n_fiches`` from one row (trait, valeurs ARRAY<STRING>) for each record and trait."""
    spark = values.sparkSession
    bound_arrow_batches(spark)
    tries = cut(values.select("trait", "valeurs").filter("valeurs is not null").mapInArrow(_count, _ROWS))
    total = tries.agg(F.coalesce(F.sum(F.size("suffixes")), F.lit(0))).first()[0]
    most = max(ROUTE_ENTRIES, total // ROUTES)
    depths = F.sequence(F.lit(0), F.least(F.length("prefixe"), F.lit(DEPTH)))
    prefixes = tries.select("trait", F.explode(F.transform(depths, lambda n: F.substring("prefixe", F.lit(1), n))).alias("p"), F.size("suffixes").alias("n"))
    heavy: dict[str, set[str]] = defaultdict(set)
    for trait, p in prefixes.groupBy("trait", "p").agg(F.sum("n").alias("n")).filter(F.col("n") > most).select("trait", "p").collect():  # at most ROUTES a depth
        heavy[trait].add(p)
    sent = spark.sparkContext.broadcast(dict(heavy))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], [], [], [], []]
            for trait, prefix, suffixes, occurrences, records in zip(*(c.to_pylist() for c in b.columns)):
                over = sent.value.get(trait, ())
                n = next((n for n in range(len(prefix) + 1) if prefix[:n] not in over), None)
                if n is not None:
                    parts = {prefix[:n]: (suffixes, occurrences, records)}
                else:  # the prefix itself is divided further
                    parts = {}
                    for s, o, r in zip(suffixes, occurrences, records):
                        term = prefix + s
                        to = next((term[:n] for n in range(len(prefix) + 1, min(len(term), DEPTH + 1) + 1) if term[:n] not in over), term)
                        for x, v in zip(parts.setdefault(to, ([], [], [])), (s, o, r)):
                            x.append(v)
                for to, part in parts.items():
                    for c, v in zip(out, (trait, to, prefix, *part)):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in out[:3]), pa.array(out[3], pa.list_(pa.string())), *(pa.array(c, pa.list_(pa.int64())) for c in out[4:])], names=["trait", "route", "prefixe", "suffixes", "occurrences", "fiches"])

    def merged(part: pa.Table) -> pa.Table:
        """The subtrees of one route, of all tasks, as one trie, and its terms."""
        trie = BurstTrie()
        for row in zip(*(part[c].to_pylist() for c in ("prefixe", "suffixes", "occurrences", "fiches"))):
            trie.graft(*row)
        terms = [(prefix + s, o, r) for prefix, container in trie.containers() for s, (o, r) in container.items()]
        symbol, o, r = (list(c) for c in zip(*terms)) if terms else ([], [], [])
        return pa.table({"trait": pa.repeat(part["trait"][0], len(symbol)), "symbole": pa.array(symbol, pa.string()), "n_occurrences": pa.array(o, pa.int64()), "n_fiches": pa.array(r, pa.int64())})

    routed = tries.mapInArrow(route, "trait string, route string, prefixe string, suffixes array<string>, occurrences array<bigint>, fiches array<bigint>")
    return routed.groupBy("trait", "route").applyInArrow(merged, "trait string, symbole string, n_occurrences bigint, n_fiches bigint")


def marked(counted: DataFrame, n_records: int) -> DataFrame:
    """The counts with ``marque``: rare, commun or null."""
    return counted.withColumn("marque", F.when(F.col("n_fiches") <= RARE, "rare").when(F.col("n_fiches") > COMMON * n_records, "commun"))


def trait_values(records: DataFrame) -> DataFrame:
    """The rows counts() takes, from the arrays H, TRT and SST of collected records."""
    of: dict[str, Column] = {"H": F.col("H.forme_normalisee"), "TRT": F.col("TRT.type"), "SST": F.col("SST.tag")}
    return records.select(F.explode(F.array(*[F.struct(F.lit(t).alias("trait"), v.alias("valeurs")) for t, v in of.items()])).alias("_x")).select("_x.trait", "_x.valeurs")
