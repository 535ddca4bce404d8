"""Cluster trees: agglomerative clustering of the training examples of each relation, over all files.

The pair with the greatest link merges first, over the whole relation, and links may rise as nodes grow, so that
the merges of a relation are one sequence, run in a grouped map. Leaves that can't come to share symbols on both sides
are grown in groups of their own, whose merges are taken by turns; what is left has links of 0, and merges into its oldest
node. Memory grows with the entries of the vectors,
not with the pairs: products with a node come from inverted lists of the leaves' entries, which are handed on to
the merged node, and each node keeps its best later partner, worked out anew only when it may be the best of all.

A tree has its leaves first, in corpus order, then its merges in order. Of equal links (nine decimals) the pair with
the older first node, then the older second node merges; the older node is the first child. Leaves are placed so
that each node covers the places [debut, fin).

Defined cases: an example without symbols has links of 0 and merges last; equal examples merge first; a relation of one
example is a leaf that is a root; no rows give no nodes."""
from __future__ import annotations

import bisect
import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from treillis.model import ISOLATE
from treillis.operators import pairs
from treillis.session import bound_arrow_batches

NODES = (
    "noeud int, poids int, hauteur double, enfants array<int>, parent int, profondeur int, ordre int, ex bigint, debut int, fin int, "
    "norme_l double, norme_r double, n_l int, n_r int, voie boolean, liens bigint"
)
TREE = ["rt"]
#: Products of nodes kept for reuse, by side.
CACHE = 1_000_000


class Side:
    """The vectors of a tree's nodes on one side: entries by symbol, with the node that holds each."""

    def __init__(self, row: np.ndarray, code: np.ndarray, weight: np.ndarray, squares: np.ndarray, sizes: np.ndarray, union: bool):
        """Entries (row, code, weight), by row, of shared symbols; all entries' squares and numbers by row."""
        n, self.union = len(squares), union
        symbols, at = np.unique(code, return_inverse=True)
        weight = np.ones(len(weight)) if union else weight.astype(np.float64)
        order = np.argsort(at, kind="stable")
        self.owner, self.symbol, self.weight = row[order], at[order], weight[order]
        self.count = np.bincount(at, minlength=len(symbols))
        self.first = np.cumsum(self.count) - self.count
        self.n = n
        mine = np.bincount(row, minlength=n)
        split = np.cumsum(mine)[:-1]
        self.places = np.split(np.argsort(self.owner, kind="stable"), split)
        order = np.lexsort((at, row))
        self.vectors = list(zip(np.split(at[order], split), np.split(weight[order], split)))
        shared = np.bincount(row, weight * weight, n)
        self.single = sizes - mine  # symbols no other row has
        self.rest = self.single.astype(np.float64) if union else squares - shared
        self.square = shared + self.rest
        # Products of some nodes, the latest ones; the oldest gives way.
        self.kept = np.zeros((max(2, min(n, CACHE // max(1, n))), n))
        self.held = np.full(len(self.kept), -1, dtype=np.int64)
        self.slot, self.next = {}, 0

    def products(self, i: int) -> np.ndarray:
        """Products of node i with every node (with itself too)."""
        if i in self.slot:
            return self.kept[self.slot[i]]
        symbols, weight = self.vectors[i]
        size = self.count[symbols]
        total = int(size.sum())
        if 2 * total > len(self.owner):
            each = np.zeros(len(self.count))
            each[symbols] = weight
            found = np.bincount(self.owner, each[self.symbol] * self.weight, self.n)
        else:
            at = np.arange(total) + np.repeat(self.first[symbols] - np.cumsum(size) + size, size)
            found = np.bincount(self.owner[at], np.repeat(weight, size) * self.weight[at], self.n)
        found = found.astype(np.float64, copy=False)  # counts of nothing are whole numbers
        found[i] += self.rest[i]
        return self._keep(i, found)

    def _keep(self, i: int, row: np.ndarray) -> np.ndarray:
        if i not in self.slot:
            self.slot.pop(int(self.held[self.next]), None)
            self.slot[i], self.held[self.next] = self.next, i
            self.next = (self.next + 1) % len(self.kept)
        self.kept[self.slot[i]] = row
        return row

    def merge(self, i: int, j: int) -> None:
        """Node j goes into node i."""
        (a, x), (b, y) = self.vectors[i], self.vectors[j]
        at = np.searchsorted(a, b)
        shared = np.append(a, -1)[at] == b
        given = self.places[j]
        if self.union:  # of a symbol both hold, one entry stays
            new = None
            lost = np.isin(self.symbol[given], b[shared])
            self.weight[given[lost]] = 0.0
            given = given[~lost]
        else:
            new = self.products(i).copy()  # the other's row may take its place
            new += self.products(j)
            new[i] += new[j]
            new[j] = 0.0
        self.owner[given] = i
        if not self.union:
            x = x.copy()
            x[at[shared]] += y[shared]
        self.vectors[i] = np.insert(a, at[~shared], b[~shared]), np.insert(x, at[~shared], y[~shared])
        self.vectors[j] = b[:0], y[:0]
        self.places[i], self.places[j] = np.concatenate((self.places[i], given)), given[:0]
        self.rest[i] += self.rest[j]
        self.single[i] += self.single[j]
        if (slot := self.slot.pop(j, None)) is not None:
            self.held[slot] = -1
        if new is None:
            if (slot := self.slot.pop(i, None)) is not None:
                self.held[slot] = -1
            new = self.products(i)
        self._keep(i, new)
        known = np.flatnonzero(self.held >= 0)
        self.kept[known, i] = new[self.held[known]]
        self.kept[known, j] = 0.0
        self.square[i] = new[i]

    def size(self, i: int) -> int:
        return len(self.vectors[i][0]) + int(self.single[i])


class Links:
    """The links of a growing tree: for each node its best later partner, or a bound for it."""

    def __init__(self, sides: tuple[Side, Side]):
        self.sides, self.n = sides, sides[0].n
        self.alive = np.ones(self.n, dtype=bool)
        self.best, self.partner, self.stale = np.full(self.n, -1.0), np.zeros(self.n, np.int64), np.zeros(self.n, dtype=bool)
        for i in range(self.n - 1):
            self.refresh(i)

    def row(self, i: int) -> np.ndarray:
        """Links of node i with all nodes: the lesser cosine of both sides; -1 for itself and merged nodes."""
        out = None
        for s in self.sides:
            dots = s.products(i)
            scale = np.sqrt(s.square[i] * s.square)
            sim = np.divide(dots, scale, out=np.zeros(self.n), where=scale > 0)
            out = sim if out is None else np.minimum(out, sim)
        out = np.round(out, 9)
        out[~self.alive] = -1.0
        out[i] = -1.0
        return out

    def refresh(self, i: int, row: np.ndarray | None = None) -> np.ndarray:
        later = (self.row(i) if row is None else row)[i + 1 :]
        if len(later):
            k = int(later.argmax())
            self.best[i], self.partner[i] = later[k], i + 1 + k
        else:
            self.best[i] = -1.0
        self.stale[i] = False
        return later

    def greedy(self, over: float | None) -> tuple[int, int, float] | None:
        """The pair with the greatest link, the first of equals; none if it isn't over the threshold."""
        while True:
            i = int(self.best.argmax())
            if self.best[i] < 0 or (over is not None and not self.best[i] > over):
                return None
            if not self.stale[i]:
                return i, int(self.partner[i]), float(self.best[i])
            self.refresh(i)

    def sequential(self, over: float) -> tuple[int, int, float] | None:
        """The first pair in reading order whose link is over the threshold."""
        for i in np.flatnonzero(self.best > over):
            hits = np.flatnonzero((later := self.refresh(i)) > over)
            if len(hits):
                return int(i), int(i + 1 + hits[0]), float(later[hits[0]])
        return None

    def merge(self, i: int, j: int) -> None:
        for s in self.sides:
            s.merge(i, j)
        self.alive[j] = False
        self.best[j] = -1.0
        row = self.row(i)
        self.refresh(i, row)
        best, partner, stale, v = self.best[:j], self.partner[:j], self.stale[:j], row[:j]
        lost = self.alive[:j] & ((partner == i) | (partner == j)) & (np.arange(j) != i)
        before = self.alive[:j] & (np.arange(j) < i)
        rises = before & (v > best)  # over the bound of all others
        level = before & (v == best) & ~stale & (i <= partner)
        best[rises] = v[rises]
        partner[rises | level] = i
        stale[rises] = False
        stale |= lost & ~rises & ~level


def linked(n: int, entries: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The group of each row: rows of two groups share no symbol on one side, nor do any sums of them.

    ``entries`` has (row, code) of each side. Rows that meet through symbols of a side, within a group, stay in one; this
    goes on by turns of the sides until no group falls apart."""
    label, groups = np.zeros(n, dtype=np.int64), 0
    coded = [(row, np.unique(code, return_inverse=True)[1]) for row, code in entries]
    while groups < (groups := len(np.unique(label))):
        for row, code in coded:
            if not len(row):
                return np.arange(n)
            key = np.unique(label[row] * (code.max() + 1) + code, return_inverse=True)[1]
            new, old = np.arange(n), None
            while old is None or not np.array_equal(new, old):
                old, least = new, np.full(key.max() + 1, n)
                np.minimum.at(least, key, old[row])
                new = old.copy()
                np.minimum.at(new, row, least[key])
                new = np.minimum(new, new[new])
            label = new
    return label


class Vectors:
    """The entries (row, code, weight) of a tree's leaves on one side, by row; sums of squares and numbers of all entries by row."""

    def __init__(self, row: np.ndarray, code: np.ndarray, weight: np.ndarray, squares: np.ndarray, sizes: np.ndarray):
        self.row, self.code, self.weight, self.squares, self.sizes = row, code, weight, squares, sizes
        self.ends = np.searchsorted(row, np.arange(len(squares) + 1))

    def side(self, rows: np.ndarray, union: bool) -> Side:
        """Some of the leaves, in order, as the first nodes of a tree."""
        count = self.ends[rows + 1] - self.ends[rows]
        at = np.arange(count.sum()) + np.repeat(self.ends[rows] - np.cumsum(count) + count, count)
        return Side(np.repeat(np.arange(len(rows)), count), self.code[at], self.weight[at], self.squares[rows], self.sizes[rows], union)


class Sum:
    """Node 0 of a forest as it takes in the others, on one side: the sum of their vectors, and the nodes that come to share a symbol with it.

    A product with the sum is worked out from a node's own entries when it is asked for; the holders of a symbol are seen once, as
    it comes in. So the work is that of the entries, however many nodes hold a symbol."""

    def __init__(self, v: Vectors, slot: np.ndarray, n: int, union: bool):
        """slot: the node of each leaf."""
        self.union = union
        weight = np.ones(len(v.row)) if union else v.weight.astype(np.float64)
        codes, code = np.unique(v.code, return_inverse=True)
        m = max(1, len(codes))
        held, at = np.unique(slot[v.row] * m + code, return_inverse=True)
        owner, self.symbol = held // m, held % m
        summed = np.bincount(at, weight, len(held))
        self.weight = np.ones(len(held)) if union else summed
        self.ends = np.searchsorted(owner, np.arange(n + 1)).tolist()
        order = np.argsort(self.symbol, kind="stable")
        self.by_symbol = owner[order]
        self.starts = np.searchsorted(self.symbol[order], np.arange(m + 1)).tolist()
        each = np.bincount(v.row, minlength=len(slot))
        single = v.sizes - each
        rest = single if union else v.squares - np.bincount(v.row, v.weight.astype(np.float64) ** 2, len(slot))
        self.squares = (np.bincount(slot, rest, n) + np.bincount(owner, self.weight * self.weight, n)).tolist()
        self.single = np.bincount(slot, single, n).astype(np.int64).tolist()
        self.inside, self.sums = bytearray(m), [0.0] * m
        self.square, self.size = self.squares[0], self.single[0]
        self.first = self.take(0)

    def entries(self, k: int) -> tuple[list[int], list[float]]:
        low, high = self.ends[k], self.ends[k + 1]
        return self.symbol[low:high].tolist(), self.weight[low:high].tolist()

    def product(self, k: int) -> float:
        total, sums = 0.0, self.sums
        for s, w in zip(*self.entries(k)):
            total += sums[s] * w
        return total

    def take(self, k: int) -> list[int]:
        """Node k goes in; the nodes that hold a symbol it brings."""
        if k and not self.union:
            self.square += self.squares[k] + 2.0 * self.product(k)
        met, fresh = [], 0
        for s, w in zip(*self.entries(k)):
            if self.inside[s]:
                if not self.union:
                    self.sums[s] += w
                continue
            self.inside[s], self.sums[s] = 1, w
            fresh += 1
            met += self.by_symbol[self.starts[s] : self.starts[s + 1]].tolist()
        self.size += fresh + (self.single[k] if k else 0)
        if k and self.union:
            self.square += self.single[k] + fresh
        return met

    def cosine(self, k: int) -> float:
        scale = math.sqrt(self.square * self.squares[k])
        return self.product(k) / scale if scale > 0 else 0.0


def _of_group(vectors: tuple[Vectors, Vectors], rows: np.ndarray, union: bool, over: float | None, sequential: bool) -> Iterator[tuple]:
    """The merges of some leaves by themselves, in order: both nodes (their first leaves), the link, and by side norm and size after it."""
    sides = tuple(v.side(rows, union) for v in vectors)
    links = Links(sides)
    while (found := links.sequential(over) if sequential else links.greedy(over)) is not None:
        i, j, height = found
        links.merge(i, j)
        yield int(rows[i]), int(rows[j]), height, *((float(np.sqrt(s.square[i])), s.size(i)) for s in sides)


def _unlinked(vectors: tuple[Vectors, Vectors], first: np.ndarray, union: bool) -> Iterator[tuple]:
    """The merges of a forest whose nodes all have links of 0; ``first`` has the first leaf of each leaf's node.

    The two oldest nodes merge. As only the node that grows may come to have links over 0, it is in every later merge: with the
    node of the greatest link, else with the oldest."""
    names, slot = np.unique(first, return_inverse=True)
    n = len(names)
    sums = tuple(Sum(v, slot, n, union) for v in vectors)
    names = names.tolist()
    alive, met = bytearray(b"\1") * n, tuple(bytearray(n) for _ in sums)  # met: shares a symbol with node 0, by side
    alive[0], oldest = 0, 1
    waiting: list[int] = []  # alive and met on both sides

    def meet(found: tuple[list[int], list[int]]) -> None:
        for nodes, own, other in zip(found, met, met[::-1]):
            for k in nodes:
                if not own[k]:
                    own[k] = 1
                    if other[k] and alive[k]:
                        bisect.insort(waiting, k)

    meet(tuple(s.first for s in sums))
    for _ in range(n - 1):
        k, height = -1, 0.0
        if waiting:
            link = np.round([min(s.cosine(x) for s in sums) for x in waiting], 9)
            at = int(link.argmax())
            if link[at] > 0:
                k, height = waiting[at], float(link[at])
        if k < 0:
            while not alive[oldest]:
                oldest += 1
            k = oldest
        alive[k] = 0
        if met[0][k] and met[1][k]:
            waiting.remove(k)
        meet(tuple(s.take(k) for s in sums))
        yield names[0], names[k], height, *((math.sqrt(s.square), s.size) for s in sums)


def merges(vectors: tuple[Vectors, Vectors], union: bool, over: float | None, sequential: bool) -> Iterator[tuple]:
    """All merges of a tree, in order.

    Leaves fall into groups that have no link with one another, whatever merges within them. The merges of a group don't depend on
    the others, so each is grown by itself and the best (or first) of the groups' next merges is taken. Links of 0 come last."""
    n = len(vectors[0].squares)
    whole = over is not None and over < 0 and sequential  # links of 0 are over the threshold, in reading order
    label = np.zeros(n, dtype=np.int64) if whole else linked(n, [(v.row, v.code) for v in vectors])
    order = np.argsort(label, kind="stable")
    groups = [g for g in np.split(order, np.flatnonzero(np.diff(label[order])) + 1) if len(g) > 1]
    running = [_of_group(vectors, g, union, over if whole else max(over or 0.0, 0.0), sequential) for g in groups]
    rank = (lambda m: m[:2]) if sequential else (lambda m: (-m[2], *m[:2]))
    heap = [(rank(m), k, m) for k, r in enumerate(running) if (m := next(r, None)) is not None]
    heapq.heapify(heap)
    first = np.arange(n)
    while heap:
        _, k, found = heap[0]
        yield found
        first[found[1]] = found[0]
        if (m := next(running[k], None)) is None:
            heapq.heappop(heap)
        else:
            heapq.heapreplace(heap, (rank(m), k, m))
    if not sequential and (over is None or over < 0):
        while not np.array_equal(first, up := first[first]):
            first = up
        yield from _unlinked(vectors, first, union)


def grow(vectors: tuple[Vectors, Vectors], ex: np.ndarray, union: bool = False, over: float | None = None, sequential: bool = False) -> dict[str, list]:
    """The nodes of one tree (or of a forest, if a threshold ends the merges early), as columns of NODES."""
    n = len(ex)
    node = {c.split()[0]: [None] * n for c in NODES.split(", ")}
    node.update(noeud=list(range(n)), poids=[1] * n, ordre=list(range(n)), ex=[int(e) for e in ex])
    for v, c in zip(vectors, "lr"):
        node[f"norme_{c}"], node[f"n_{c}"] = np.sqrt(v.sizes if union else v.squares).astype(np.float64).tolist(), [int(x) for x in v.sizes]
    at, left = list(range(n)), n
    computed = n * (n - 1) // 2
    for i, j, height, (norm_l, n_l), (norm_r, n_r) in merges(vectors, union, over, sequential):
        left -= 1
        computed += left - 1
        kids, new = [at[i], at[j]], len(node["noeud"])
        for c, v in {"noeud": new, "poids": sum(node["poids"][k] for k in kids), "hauteur": height, "enfants": kids, "ordre": i, "norme_l": norm_l, "norme_r": norm_r, "n_l": n_l, "n_r": n_r}.items():
            node[c].append(v)
        for c in ("parent", "ex", "profondeur", "debut", "fin", "voie"):
            node[c].append(None)
        for k in kids:
            node["parent"][k] = new
        at[i] = new
    node["liens"] = [computed] * len(node["noeud"])
    place = 0
    for k in reversed(node["noeud"]):  # parents come after their children
        up = node["parent"][k]
        if up is None:
            node["profondeur"][k], node["debut"][k], node["voie"][k] = 0, place, True
            place += node["poids"][k]
        else:
            first, second = node["enfants"][up]
            other = second if k == first else first
            node["profondeur"][k] = node["profondeur"][up] + 1
            node["debut"][k] = node["debut"][up] + (0 if k == first else node["poids"][first])
            heavy = node["poids"][k] > node["poids"][other] or (node["poids"][k] == node["poids"][other] and k == second)
            node["voie"][k] = node["voie"][up] and heavy and node["poids"][other] <= ISOLATE
        node["fin"][k] = node["debut"][k] + node["poids"][k]
    return node


def _listed(part: pa.Table, name: str) -> np.ndarray:
    return part[name].combine_chunks().flatten().to_numpy(zero_copy_only=False)


def cluster(side_rows: DataFrame, union: bool = False, over: float | None = None, sequential: bool = False, by: tuple[str, ...] = ("rt",)) -> DataFrame:
    """The trees (``by`` and NODES) of every relation; with a threshold, the forests of threshold fusion.

    ``by`` may hold more keys, such as a configuration and a fold. Corpus order is by lot, line and id."""
    packed = pairs.packed(side_rows, pairs.coded(side_rows), [*by, "lot", "ordre", "ex"], sizes=True)
    return packed_cluster(packed, union, over, sequential, by)


def packed_cluster(packed: DataFrame, union: bool = False, over: float | None = None, sequential: bool = False, by: tuple[str, ...] = ("rt",)) -> DataFrame:
    """cluster() of packed vectors (``by``, lot, ordre, ex, PARTS, nL, nR)."""
    bound_arrow_batches(packed.sparkSession)
    schema = pa.schema([*((c, pa.string()) for c in by), *_arrow(NODES)])

    def tree(key: tuple, part: pa.Table) -> pa.Table:
        part = part.sort_by([("lot", "ascending"), ("ordre", "ascending"), ("ex", "ascending")])
        vectors = []
        for c in pairs.SIDES:
            row = np.repeat(np.arange(len(part)), part[f"s{c}"].combine_chunks().value_lengths().to_numpy(zero_copy_only=False))
            vectors.append(Vectors(row, _listed(part, f"s{c}"), _listed(part, f"p{c}"), part[f"c{c}"].to_numpy(), part[f"n{c}"].to_numpy()))
        nodes = grow(tuple(vectors), part["ex"].to_numpy(), union, over, sequential)
        named = {c: [k.as_py()] * len(nodes["noeud"]) for c, k in zip(by, key)}
        return pa.table({**named, **nodes}, schema=schema)

    keys = ", ".join(f"{c} string" for c in by)
    texts = packed.select(*[F.col(c).cast("string").alias(c) for c in by], "lot", "ordre", "ex", *pairs.PARTS, "nL", "nR")
    return texts.groupBy(*by).applyInArrow(tree, f"{keys}, {NODES}")


def _arrow(schema: str) -> list[tuple[str, pa.DataType]]:
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), "array<int>": pa.list_(pa.int32()), "array<double>": pa.list_(pa.float64())}
    return [(name, kinds[kind]) for name, kind in (c.split() for c in schema.split(", "))]


def global_ids(nodes: DataFrame) -> DataFrame:
    """The nodes with ``id``, unique over all trees: types in order, one after the other."""
    sizes = nodes.groupBy("rt").agg(F.count("*").alias("_n"))  # a row a relation
    before = sizes.select("rt", F.coalesce(F.sum("_n").over(Window.orderBy("rt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    return nodes.join(F.broadcast(before), "rt").withColumn("id", F.col("_b") + F.col("noeud")).drop("_b")


def node_symbols(nodes: DataFrame, tree: DataFrame, leaves: DataFrame) -> DataFrame:
    """(rt, noeud, cote, symbole, poids): the summed vectors of the given nodes (rt, noeud, debut, fin) of a tree.

    Rows are the leaves of each node, so ask for the nodes that matter."""
    under = nodes.select("rt", "noeud", F.explode(F.sequence(F.col("debut"), F.col("fin") - 1)).alias("debut"))
    at = tree.filter("enfants is null").select("rt", "debut", "ex")
    return under.join(at, ["rt", "debut"]).join(leaves.select("rt", "ex", "cote", "symbole", "poids"), ["rt", "ex"]).groupBy("rt", "noeud", "cote", "symbole").agg(F.sum("poids").alias("poids"))


def shared_weights(asked: DataFrame, nodes: DataFrame, tree: DataFrame, leaves: DataFrame) -> DataFrame:
    """(rt, noeud, cote, symbole, poids): what the summed vectors of nodes (rt, noeud, debut, fin) hold of the symbols asked for (rt, noeud, cote, symbole).

    A node's sum is the difference of two running sums over the leaves in the order of the tree, in exact decimals, so that no leaf is
    repeated under the nodes that cover it. Symbols that a node lacks have no row."""
    key, exact = ["rt", "cote", "symbole"], "decimal(28,18)"
    held = leaves.join(tree.filter("enfants is null").select("rt", "ex", "debut"), ["rt", "ex"]).join(asked.select(*key).distinct(), key, "left_semi")
    each = held.select(*key, F.col("debut").alias("_p"), F.lit(1).alias("_o"), F.col("poids").cast(exact).alias("_w"), F.lit(None).cast("int").alias("noeud"), F.lit(None).cast("int").alias("_s"))
    bounds = F.explode(F.array(*[F.struct(F.col(c).alias("_p"), F.lit(s).alias("_s")) for c, s in (("debut", -1), ("fin", 1))]))
    ends = asked.join(nodes.select("rt", "noeud", "debut", "fin"), ["rt", "noeud"]).select(*key, "noeud", bounds.alias("x"))
    ends = ends.select(*key, F.col("x._p").alias("_p"), F.lit(0).alias("_o"), F.lit(0).cast(exact).alias("_w"), "noeud", F.col("x._s").alias("_s"))
    running = Window.partitionBy(*key).orderBy("_p", "_o").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = each.unionByName(ends).withColumn("_r", F.sum("_w").over(running)).filter("_s is not null")
    return summed.groupBy("rt", "noeud", "cote", "symbole").agg(F.sum(F.when(F.col("_s") > 0, F.col("_r")).otherwise(-F.col("_r"))).cast("double").alias("poids")).filter("poids > 0")


def single_leaves(packed: DataFrame) -> DataFrame:
    """The leaves of every tree before any merge, with the columns that the answers need; packed as for packed_cluster()."""
    place = F.row_number().over(Window.partitionBy("rt").orderBy("lot", "ordre", "ex")) - 1
    none = lambda kind: F.lit(None).cast(kind)
    each = packed.select("rt", "ex", place.alias("noeud"), F.sqrt("cL").alias("norme_l"), F.sqrt("cR").alias("norme_r"))
    return each.select("*", F.lit(1).alias("poids"), F.lit(0).alias("profondeur"), none("array<int>").alias("enfants"), none("int").alias("parent"), F.col("noeud").alias("debut"), (F.col("noeud") + 1).alias("fin"))


def cut_forest(nodes: DataFrame, threshold: float, by: tuple[str, ...] = ("rt",)) -> DataFrame:
    """The forest left of each tree when merges stop before the first with a link under the threshold.

    Merges are taken in their order, as heights needn't fall; ``racine`` marks nodes without a kept parent."""
    first = nodes.groupBy(*by).agg(F.min(F.when(F.col("hauteur") < threshold, F.col("noeud"))).alias("_c"))
    kept = nodes.join(first, list(by)).filter("_c is null or noeud < _c")
    return kept.withColumn("racine", F.col("parent").isNull() | F.coalesce(F.col("parent") >= F.col("_c"), F.lit(False))).drop("_c")


def inversions(nodes: DataFrame) -> DataFrame:
    """Nodes higher than a merged child, with the first such child and the gap."""
    child = nodes.filter("hauteur is not null").select("rt", F.col("noeud").alias("enfant"), F.col("parent").alias("noeud"), F.col("hauteur").alias("hc"))
    rank = nodes.select("rt", "noeud", "hauteur", "enfants")
    found = rank.join(child, ["rt", "noeud"]).filter("hauteur > hc").withColumn("_r", F.array_position("enfants", F.col("enfant")))
    return found.groupBy("rt", "noeud").agg(F.min_by(F.struct("enfant", (F.col("hauteur") - F.col("hc")).alias("ecart")), "_r").alias("x")).select("rt", "noeud", "x.*")


def isolates(nodes: DataFrame) -> DataFrame:
    """Small groups split off on the way from the root down the heavy children (``voie``), and what is left (``noyau``)."""
    kids = nodes.filter("parent is not null").groupBy("rt", F.col("parent").alias("noeud")).agg(F.min("poids").alias("petit"))
    way = nodes.filter("voie").select("rt", "noeud", "poids")
    off = way.join(kids, ["rt", "noeud"]).filter(F.col("petit") <= ISOLATE).groupBy(*TREE).agg(F.count("*").alias("n_isolats"), F.sum("petit").alias("n_isoles"))
    return way.groupBy(*TREE).agg(F.min("poids").alias("noyau")).join(off, TREE, "left").fillna(0, ["n_isolats", "n_isoles"])


def measures(nodes: DataFrame) -> DataFrame:
    """Size, depth, heights, inversions, grafts and isolates of each tree."""
    weights = nodes.filter("parent is not null").groupBy("rt", F.col("parent").alias("noeud")).agg(F.min("poids").alias("pmin"), F.max("poids").alias("pmax"))
    grafts = weights.groupBy(*TREE).agg(F.count_if((F.col("pmin") == 1) & (F.col("pmax") > 1)).alias("greffes"))
    biggest = weights.join(nodes.filter("parent is null").select("rt", "noeud"), ["rt", "noeud"]).groupBy("rt").agg(F.max("pmax").alias("plus_gros_enfant"))
    inv = inversions(nodes).groupBy(*TREE).agg(F.count("*").alias("inversions"), F.max("ecart").alias("inversion_max"))
    root = F.col("parent").isNull()
    base = nodes.groupBy(*TREE).agg(
        F.count_if(F.col("enfants").isNull()).alias("feuilles"), F.count("*").alias("noeuds"), F.max("profondeur").alias("profondeur"),
        F.max(F.when(root, F.col("hauteur"))).alias("hauteur_racine"), F.max("hauteur").alias("hauteur_max"), F.median("hauteur").alias("hauteur_mediane"),
        F.max(F.when(root, F.col("n_l"))).alias("racine_l"), F.max(F.when(root, F.col("n_r"))).alias("racine_r"), F.max("liens").alias("liens"),
    )
    out = base.join(grafts, TREE, "left").join(biggest, TREE, "left").join(inv, TREE, "left").join(isolates(nodes), TREE, "left")
    return out.fillna(0, ["greffes", "inversions", "n_isolats", "n_isoles"])


def runaways(forest: DataFrame) -> DataFrame:
    """Rules (parentless nodes of a fusion) that hold over half of their type or grew a side over three times the leaves' median."""
    sizes = forest.groupBy(*TREE).agg(F.count_if(F.col("enfants").isNull()).alias("_n"), F.median(F.when(F.col("enfants").isNull(), F.col("n_l"))).alias("_l"), F.median(F.when(F.col("enfants").isNull(), F.col("n_r"))).alias("_r"))
    rules = forest.filter("parent is null and enfants is not null").join(sizes, TREE)
    rules = rules.withColumn("couvre", F.col("poids") > 0.5 * F.col("_n")).withColumn("enfle", (F.col("n_l") > 3 * F.col("_l")) | (F.col("n_r") > 3 * F.col("_r")))
    return rules.filter("couvre or enfle").select("rt", "noeud", "poids", "n_l", "n_r", "couvre", "enfle")
