"""Classification of examples by the cluster trees of all relations: descent, exhaustive search, roots, neighbours.

A block of questions meets a whole tree in one task. Products with the leaves come from the symbols both have; with the
leaves in the order of the tree a node's product is a difference of running sums, so that a node's score costs no more
than a leaf's; the best node is found among those above leaves that share a symbol. A descent looks at no leaves: the holders of
a symbol stand in the order of the tree, and each step down divides their range. Each task gives one row a question and tree; no score of a node is shuffled."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treillis.model import TIGHT
from treillis.operators import pairs
from treillis.operators.clustering import _arrow
from treillis.session import bound_arrow_batches, cut

#: Questions of a block, and places of leaves looked at at once, by all questions of a strip.
BLOCK, AT_ONCE = 2_000, 3_000_000
#: So many blocks in one where questions only descend, as each block gets its own copy of the tree.
DESCENDING = 4
#: Scores that are less by more than this aren't equal in nine decimals.
CLOSE = 1e-8
#: Parts a block of questions and tree, up to a number of parts.
PARTS_A_BLOCK, MOST_PARTS = 3, 300
#: The answer of a tree: where the descent stops, the best of all nodes, of leaves and of roots, the depth of the last node
#: above both the stop and the best one, and the way to the stop from its root.
ANSWERS = (
    "ex bigint, noeud int, score double, profondeur int, poids int, feuille boolean, calculs int, meilleur int, score_meilleur double, voisin int, score_voisin double, "
    "racine int, score_racine double, niveau_commun int, dessous boolean, n_noeuds int, n_feuilles int, n_racines int, chemin array<int>, scores array<double>"
)


class Lists:
    """The leaves' entries on one side by symbol, then place, with running sums of their weights: what a symbol weighs in a node is the difference of two."""

    def __init__(self, row: np.ndarray, code: np.ndarray, weight: np.ndarray, n: int):
        """Entries (place, code, weight) by place, of n leaves."""
        order, self.width = np.argsort(code, kind="stable"), n + 1
        self.codes, count = np.unique(code, return_counts=True)
        self.ends = np.concatenate(([0], np.cumsum(count)))
        self.keys = np.repeat(np.arange(len(count)) * self.width, count) + row[order]
        self.sums = np.concatenate(([0.0], np.cumsum(weight[order], dtype=np.longdouble)))  # over all symbols, so in more digits

    def held(self, row: np.ndarray, code: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of a block's entries those whose symbol has holders: row, rank of the symbol, weight, and the range of its holders."""
        rank = np.searchsorted(self.codes, code)
        known = np.append(self.codes, -1)[rank] == code
        rank = rank[known]
        return row[known], rank, weight[known], self.ends[rank], self.ends[rank + 1]

    def before(self, rank: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The end of each symbol's holders that stand before a place."""
        return np.searchsorted(self.keys, rank * self.width + place)

    def dots(self, row: np.ndarray, weight: np.ndarray, low: np.ndarray, high: np.ndarray, n: int) -> np.ndarray:
        return np.bincount(row, weight * (self.sums[high] - self.sums[low]).astype(np.float64), n)


class Tree:
    """A tree (or forest) as arrays; nodes are numbered by their place in ``ids``."""

    def __init__(self, rows: pa.Table):
        rows = rows.sort_by("noeud")
        get = lambda c: rows[c].to_numpy()
        self.ids, self.weight, self.depth = get("noeud").astype(np.int64), get("poids"), get("profondeur")
        n = len(self.ids)
        self.norms = {"L": get("norme_l"), "R": get("norme_r")}
        kids, up = rows["enfants"].combine_chunks(), rows["parent"].fill_null(-1).to_numpy()
        self.first, self.second = np.full((2, n), -1, dtype=np.int64)
        inner = np.flatnonzero(kids.is_valid().to_numpy(zero_copy_only=False))
        pair = np.searchsorted(self.ids, kids.flatten().to_numpy(zero_copy_only=False)).reshape(-1, 2)
        self.first[inner], self.second[inner] = pair.T
        at = np.minimum(np.searchsorted(self.ids, up), n - 1)
        self.parent = np.where(self.ids[at] == up, at, -1)
        self.roots, self.leaves = np.flatnonzero(self.parent < 0), np.flatnonzero(self.first < 0)
        # The forest may be cut: places are those of its own leaves.
        start, end = get("debut").astype(np.int64), get("fin").astype(np.int64)
        kept = np.sort(start[self.leaves])
        self.start, self.end = np.searchsorted(kept, start), np.searchsorted(kept, end)
        self.n = n
        self.by_place = self.leaves[np.argsort(start[self.leaves])]
        self.block = pairs.Block(pa.table({c: rows[c] for c in pairs.PARTS}).take(pa.array(self.by_place)).to_struct_array().combine_chunks())
        # Of two leaves that stand side by side, the last node above both, as its place in ``upper``, the highest first; before them -1, between trees.
        inner = inner[np.argsort(self.depth[inner], kind="stable")]
        self.between = np.full(self.block.n, -1, dtype=np.int32)
        self.between[self.end[self.first[inner]] - 1] = np.arange(len(inner))
        self.upper = inner
        # Ways of heavier children: the first node of each one's way.
        heavy = np.where(self.end[self.first] - self.start[self.first] >= self.end[self.second] - self.start[self.second], self.first, self.second)[inner]
        self.head = np.arange(n)
        self.head[heavy] = self.parent[heavy]
        self.inverse = {c: np.divide(1.0, x, out=np.zeros(n), where=x > 0) for c, x in self.norms.items()}
        while not np.array_equal(self.head, up := self.head[self.head]):
            self.head = up

    def asked(self, asked: pairs.Block) -> Iterator[tuple[int, int, Strip]]:
        """By strip of questions: its bounds and their scores."""
        size, ready = max(1, AT_ONCE // max(1, self.block.n)), {}
        for c in pairs.SIDES:
            (ra, sa, wa), (rb, sb, wb) = asked.sides[c], self.block.sides[c]
            order = np.argsort(sb, kind="stable")
            sb, rb, wb = sb[order], rb[order], wb[order]
            ends = np.searchsorted(ra, np.arange(asked.n + 1))  # entries stand by row
            ready[c] = ends.tolist(), rb, wb, list(zip(np.searchsorted(sb, sa).tolist(), np.searchsorted(sb, sa, "right").tolist(), wa.tolist()))
        for low in range(0, asked.n, size):
            high = min(low + size, asked.n)
            yield low, high, Strip(self, {c: x[low:high] for c, x in asked.norms.items()}, [self.products(ready, q) for q in range(low, high)])

    def products(self, ready: dict[str, tuple], q: int) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """The places of the leaves that share a symbol with a question, and by side the products with them.

        Of one question at a time, so that what is as wide as the tree stays in the processor's cache."""
        dots = {}
        for c, (ends, places, weights, entries) in ready.items():
            mine = [x for x in entries[ends[q] : ends[q + 1]] if x[0] < x[1]]
            if not mine:
                dots[c] = np.zeros(self.block.n)
                continue
            dots[c] = np.bincount(np.concatenate([places[a:b] for a, b, _ in mine]), np.concatenate([w * weights[a:b] for a, b, w in mine]), self.block.n)
        met = np.flatnonzero((dots["L"] != 0) | (dots["R"] != 0))
        return met, {c: x[met] for c, x in dots.items()}

    def stops(self, strip: Strip) -> tuple[np.ndarray, np.ndarray]:
        """The best stop of each question over all roots (the first of equals), and how many scores were looked at."""
        h, r = strip.h, len(self.roots)
        who, at = np.repeat(np.arange(h), r), np.tile(self.roots, h)
        value, seen = strip.score(who, at), np.ones(h * r, dtype=np.int64)
        live = np.arange(h * r)
        while len(live):
            live = live[self.first[at[live]] >= 0]
            a, b = self.first[at[live]], self.second[at[live]]
            x, y = strip.score(np.tile(who[live], 2), np.concatenate((a, b))).reshape(2, -1)
            seen[live] += 2
            down = np.maximum(x, y) > value[live]
            live, best, high = live[down], np.where(y > x, b, a)[down], np.maximum(x, y)[down]
            at[live], value[live] = best, high
        value, at = value.reshape(h, r), at.reshape(h, r)
        top = np.where(value == value.max(axis=1, keepdims=True), at, self.n)
        return top.min(axis=1), seen.reshape(h, r).sum(axis=1)

    def descend(self, asked: pairs.Block, paths: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[np.ndarray, ...]]]:
        """stops() of a tree with one root, for all questions together: the stop of each, its score, and how many scores were looked at;
        with ``paths`` by level who came to which node with which score."""
        h, root = asked.n, int(self.roots[0])
        at, seen = np.full(h, root), np.ones(h, dtype=np.int64)
        lists = {c: Lists(*self.block.sides[c], self.block.n) for c in pairs.SIDES}
        held = {c: x.held(*asked.sides[c]) for c, x in lists.items()}

        def score(who: np.ndarray, node: np.ndarray, dots: dict[str, np.ndarray]) -> np.ndarray:
            total = np.zeros(len(who))
            for c, x in dots.items():
                scale = asked.norms[c][who] * self.norms[c][node]
                total += 0.5 * np.divide(x, scale, out=np.zeros(len(who)), where=scale > 0)
            return np.round(total, 9)

        value = score(np.arange(h), at, {c: lists[c].dots(x[0], x[2], *x[3:], h) for c, x in held.items()})
        live, ways = np.arange(h if self.first[root] >= 0 else 0), [(np.arange(h), at.copy(), value.copy())]
        while len(live):
            n, a, b = len(live), self.first[at[live]], self.second[at[live]]
            place, cut_at, left, right = self.start[b], {}, {}, {}
            for c, (row, rank, weight, low, high) in held.items():
                cut_at[c] = mid = lists[c].before(rank, place[row])
                left[c], right[c] = lists[c].dots(row, weight, low, mid, n), lists[c].dots(row, weight, mid, high, n)
            x, y = score(live, a, left), score(live, b, right)
            seen[live] += 2
            best, second = np.maximum(x, y), y > x
            down, node = best > value[live], np.where(second, b, a)
            moved = live[down]
            at[moved], value[moved] = node[down], best[down]
            if paths:
                ways.append((moved, node[down], best[down]))
            stay = down & (self.first[node] >= 0)
            live, slot = live[stay], np.cumsum(stay) - 1
            for c, (row, rank, weight, low, high) in held.items():
                low, high = np.where(second[row], cut_at[c], low), np.where(second[row], high, cut_at[c])
                keep = stay[row] & (low < high)
                held[c] = slot[row[keep]], rank[keep], weight[keep], low[keep], high[keep]
        return at, value, seen, ways

    def common_depth(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The depth of the last node above (or equal to) both; -1 if they are of different trees."""
        a, b = a.copy(), b.copy()
        while len(live := np.flatnonzero((a >= 0) & (b >= 0) & (self.head[a] != self.head[b]))):
            x, y = self.head[a[live]], self.head[b[live]]
            low = self.depth[x] >= self.depth[y]
            a[live], b[live] = np.where(low, self.parent[x], a[live]), np.where(low, b[live], self.parent[y])
        return np.where((a >= 0) & (b >= 0), np.minimum(self.depth[a], self.depth[b]), -1)

    def ways(self, stops: np.ndarray) -> list[list[int]]:
        """The nodes from the root to each stop."""
        out = []
        for k in stops.tolist():
            way = [k]
            while (k := int(self.parent[k])) >= 0:
                way.append(k)
            out.append(way[::-1])
        return out


class Strip:
    """The scores (nine decimals) of some questions in a tree, worked out for the nodes that are asked for."""

    def __init__(self, tree: Tree, norms: dict[str, np.ndarray], met: list[tuple[np.ndarray, dict[str, np.ndarray]]]):
        """met: by question the places of the leaves that share a symbol with it, and the products with them."""
        self.tree, self.norms, self.h = tree, norms, len(norms["L"])
        self.places, self.dots = [p for p, _ in met], {c: [x[c] for _, x in met] for c in pairs.SIDES}
        # Running sums of the products over these places, after a 0; where a question's sums begin; the places of all questions, one after the other.
        counts = [len(p) for p in self.places]
        self.begin = np.cumsum([0, *(k + 1 for k in counts)])
        self.sums = {c: np.concatenate([np.cumsum(np.concatenate(([0.0], x))) for x in self.dots[c]]) for c in pairs.SIDES}
        self.keys = np.concatenate(self.places) + np.repeat(np.arange(self.h) * (tree.block.n + 1), counts)

    def score(self, who: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Of each question ``who`` the score of its node ``at``."""
        t, total = self.tree, np.zeros(len(at))
        row = who * (t.block.n + 1)
        first, last = (np.searchsorted(self.keys, row + x[at]) + who for x in (t.start, t.end))
        for c in pairs.SIDES:
            sums, scale = self.sums[c], self.norms[c][who] * t.norms[c][at]
            total += 0.5 * np.divide(sums[last] - sums[first], scale, out=np.zeros(len(at)), where=scale > 0)
        return np.round(total, 9)

    def best(self, who: np.ndarray, at: np.ndarray, value: np.ndarray, none: int) -> tuple[np.ndarray, np.ndarray]:
        """The first of each question's best nodes of those given, and its score; all others score 0, the first of which is ``none``."""
        top = np.zeros(self.h)
        np.maximum.at(top, who, value)
        node = np.where(top > 0, self.tree.n, none)
        good = (value == top[who]) & (value > 0)
        np.minimum.at(node, who[good], at[good])
        return node, top

    def best_of_all(self, inner: bool = True) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
        """The best of all nodes (of the leaves only, without ``inner``), and of the leaves.

        Weights are over 0. Of nodes one above the other that have the same leaves in common with a question, the lowest has the least
        norm, so the best score, and the first number. So there are to be seen only these leaves and, of each two that stand side by side, the last node above both.
        The score proper is worked out for those that come close to the best one."""
        t, kept = self.tree, []
        share = {c: np.divide(0.5, x, out=np.zeros(self.h), where=x > 0) for c, x in self.norms.items()}
        for q, places in enumerate(self.places):
            if not len(places):
                continue
            leaves = t.by_place[places]
            value = sum(self.dots[c][q] * t.inverse[c][leaves] * share[c][q] for c in pairs.SIDES)
            near = value.max()
            leaves = leaves[value >= near - CLOSE]
            upper = leaves[:0]
            if inner and len(places) > 1:
                key = np.minimum.reduceat(t.between, places)[:-1]
                upper = t.upper[key[key >= 0]]
                before = np.repeat(np.arange(len(places) + 1, dtype=np.int32), np.diff(places, prepend=-1, append=t.block.n))  # how many of the places stand before each place
                low, high = (self.begin[q] + before[x[upper]] for x in (t.start, t.end))
                value = sum((self.sums[c][high] - self.sums[c][low]) * t.inverse[c][upper] * share[c][q] for c in pairs.SIDES)
                upper = upper[value >= max(near, value.max(initial=0.0)) - CLOSE]
            kept.append((q, leaves, upper))
        who = [np.repeat([q for q, *_ in kept], [len(x[c]) for x in kept]).astype(np.int64) for c in (1, 2)]
        at = [np.concatenate([x[c] for x in kept]) if kept else who[0] for c in (1, 2)]
        value = [self.score(w, a) for w, a in zip(who, at)]
        leaf = self.best(who[0], at[0], value[0], int(t.leaves[0]))
        return self.best(*(np.concatenate(x) for x in (who, at, value)), 0), leaf

    def best_root(self) -> tuple[np.ndarray, np.ndarray]:
        roots = self.tree.roots
        part = self.score(np.repeat(np.arange(self.h), len(roots)), np.tile(roots, self.h)).reshape(self.h, -1)
        k = part.argmax(axis=1)
        return roots[k], part[np.arange(self.h), k]


def _answer(asked: pa.Table, rows: pa.Table, paths: bool, which: str = "tout") -> pa.Table:
    tree, block = Tree(rows), pairs.Block(asked.select(list(pairs.PARTS)).to_struct_array().combine_chunks())
    out, schema = [], pa.schema(_arrow(ANSWERS))
    ex = asked["ex"].to_numpy()
    ids = lambda x: pa.array(tree.ids[x], pa.int32())
    one = len(tree.roots) == 1 and which in ("tout", "descente")
    stops, values, counts, levels = tree.descend(block, paths) if one else (None, None, None, [])
    for low, high, strip in [(0, block.n, None)] if one and which == "descente" else tree.asked(block):
        h = high - low
        whole = lambda x: pa.array(np.broadcast_to(x, h), pa.int32())  # noqa: B023, E731
        got = {"ex": ex[low:high], "n_noeuds": whole(tree.n), "n_feuilles": whole(len(tree.leaves)), "n_racines": whole(len(tree.roots))}
        if which in ("tout", "descente"):
            stop, seen = (stops[low:high], counts[low:high]) if one else tree.stops(strip)
            score = values if strip is None else strip.score(np.arange(h), stop)
            got |= {"noeud": ids(stop), "score": score, "profondeur": whole(tree.depth[stop]), "poids": whole(tree.weight[stop]), "feuille": tree.first[stop] < 0, "calculs": whole(seen)}
        if which != "descente":
            (best, top), (leaf, near) = strip.best_of_all(which != "feuilles")
            got |= {"voisin": ids(leaf), "score_voisin": near}
        if which in ("tout", "noeuds"):
            got |= {"meilleur": ids(best), "score_meilleur": top}
        if which == "tout":
            root, high_root = strip.best_root()
            below = (tree.start[stop] <= tree.start[best]) & (tree.end[best] <= tree.end[stop])
            got |= {"racine": ids(root), "score_racine": high_root, "niveau_commun": whole(tree.common_depth(stop, best)), "dessous": below}
        if paths and strip is None:
            who, nodes, scores = (np.concatenate(x) for x in zip(*levels))
            order = np.argsort(who, kind="stable")  # a question's levels stay in order
            ends = pa.array(np.concatenate(([0], np.cumsum(np.bincount(who, minlength=h)))), pa.int32())
            got |= {"chemin": pa.ListArray.from_arrays(ends, ids(nodes[order])), "scores": pa.ListArray.from_arrays(ends, pa.array(scores[order]))}
        elif paths:
            ways = tree.ways(stop)
            got |= {"chemin": pa.array([tree.ids[w].tolist() for w in ways], pa.list_(pa.int32())), "scores": pa.array([strip.score(np.full(len(w), k), np.array(w)).tolist() for k, w in enumerate(ways)], pa.list_(pa.float64()))}
        out.append(pa.table({f.name: got[f.name] if f.name in got else pa.nulls(h, f.type) for f in schema}, schema=schema))
    return pa.concat_tables(out) if out else schema.empty_table()


def tree_answers(questions: DataFrame, leaves: DataFrame, nodes: DataFrame, by: tuple[str, ...] = ("rt",), paths: bool = False, which: str = "tout") -> DataFrame:
    """packed_answers() of sides."""
    codes = pairs.coded(questions, leaves)
    return packed_answers(pairs.packed(questions, codes, [*by[:-1], "ex"]), pairs.packed(leaves, codes, [*by, "ex"]), nodes, by, paths, which)


def packed_answers(asked: DataFrame, vectors: DataFrame, nodes: DataFrame, by: tuple[str, ...] = ("rt",), paths: bool = False, which: str = "tout") -> DataFrame:
    """The answer (``by`` and ANSWERS) of every tree to every question; the way to the stop only with ``paths``, as trees may be deep.

    ``by`` ends with the relation; the keys before it (a configuration, a fold) are those of the questions too. A question
    that shares nothing with a tree scores 0 there and stops at its root; no trees or no questions give no rows. With ``which``
    ``descente``, ``feuilles`` or ``noeuds`` the columns of the stop, of the best leaf, or of the best leaf and node are worked out and the others are null."""
    bound_arrow_batches(asked.sparkSession)
    own = list(by[:-1])
    most = asked.groupBy(*own).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    asked = asked.select(*own, "ex", *pairs.PARTS)
    blocks = max(1, -(-most // (BLOCK * DESCENDING if which == "descente" else BLOCK)))
    asked = asked.withColumn("_bloc", F.pmod(F.xxhash64("ex"), F.lit(blocks)).cast("int"))
    keys = [*by, "_bloc"]
    trees = nodes.select(*by).distinct()  # a row a tree
    left = asked.join(F.broadcast(trees), own) if own else asked.crossJoin(F.broadcast(trees))
    vectors = vectors.select(*by, "ex", *pairs.PARTS)
    columns = ["noeud", "poids", "profondeur", "enfants", "parent", "debut", "fin", "norme_l", "norme_r"]
    named = lambda key, t: pa.table({**{c: pa.array([k.as_py()] * len(t), pa.string()) for c, k in zip(by, key)}, **{c: t[c] for c in t.column_names}})

    def bundle(key: tuple, part: pa.Table) -> pa.Table:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, (rows := part.select([*columns, *pairs.PARTS])).schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_table(rows)
        return named(key, pa.table({"arbre": pa.array([sink.getvalue().to_pybytes()], pa.binary())}))

    held = nodes.select(*[F.col(c).cast("string").alias(c) for c in by], "ex", *columns).join(vectors, [*by, "ex"], "left").groupBy(*by)
    each = held.applyInArrow(bundle, ", ".join(f"{c} string" for c in by) + ", arbre binary")  # a row a tree, as it is sent to every block
    right = each.withColumn("_bloc", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select(*[F.col(c).alias(f"{c}_t") for c in keys], "arbre")

    def run(key: tuple, one: pa.Table, two: pa.Table) -> pa.Table:
        got = _answer(one, pa.ipc.open_stream(two["arbre"][0].as_buffer()).read_all(), paths, which) if len(one) and len(two) else pa.schema(_arrow(ANSWERS)).empty_table()
        return named(key[: len(by)], got)

    # Work goes with the questions, not with the bytes that are shuffled: parts enough that blocks of a large tree seldom share a task.
    parts = max(1, min(PARTS_A_BLOCK * blocks * trees.count(), max(MOST_PARTS, blocks)))
    left, right = left.repartition(parts, *keys), right.repartition(parts, *[f"{c}_t" for c in keys])
    return left.groupBy(*keys).cogroup(right.groupBy(*[f"{c}_t" for c in keys])).applyInArrow(run, ", ".join(f"{c} string" for c in by) + ", " + ANSWERS)


def stops(answers: DataFrame) -> DataFrame:
    """Where the descent of each question stopped in each tree, with the depth and the evaluations."""
    return answers.drop("meilleur", "score_meilleur", "voisin", "score_voisin", "racine", "score_racine", "niveau_commun", "dessous", "n_noeuds", "n_feuilles", "n_racines")


def best_everywhere(answers: DataFrame, which: str = "tous") -> DataFrame:
    """(ex, rt, noeud, score, calculs): the best node of all trees among all nodes, roots or leaves (first rt, then node of equals)."""
    node, score, n = {"tous": ("meilleur", "score_meilleur", "n_noeuds"), "racines": ("racine", "score_racine", "n_racines"), "feuilles": ("voisin", "score_voisin", "n_feuilles")}[which]
    top = answers.groupBy("ex").agg(F.min_by(F.struct("rt", F.col(node).alias("noeud"), F.col(score).alias("score")), F.struct(-F.col(score), "rt", node)).alias("x"), F.sum(n).alias("calculs"))
    return top.select("ex", "x.*", "calculs")


def winners(answers: DataFrame, keys: tuple[str, ...] = ("ex",)) -> DataFrame:
    """The best answer of each question by descent in every tree (first rt, then node of equals), the second answer, the
    relative gap, and the evaluations over all trees."""
    order = F.struct(-F.col("score"), "rt", "noeud")
    both = answers.groupBy(*keys).agg(
        F.min_by(F.struct("rt", *[c for c in stops(answers).columns if c not in (*keys, "rt", "calculs")]), order).alias("x"),
        F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("m"), "rt"))).alias("_r"), F.sum("calculs").alias("calculs"),
    )
    out = both.select(*keys, F.col("x.rt").alias("predit"), *[f"x.{c}" for c in ("noeud", "score", "profondeur", "poids", "feuille", "chemin", "scores")], F.get("_r", F.lit(1)).alias("_s"), "calculs")
    out = out.withColumn("second", F.col("_s.rt")).withColumn("score_second", -F.col("_s.m")).drop("_s")
    return out.withColumn("ecart", gap(F.col("score"), F.col("score_second"))).withColumn("serre", F.col("ecart") < TIGHT)


def ranked(answers: DataFrame, *ties: str) -> DataFrame:
    """Answers of each example with their rank by score, then the given columns."""
    w = Window.partitionBy("ex").orderBy(F.desc("score"), *ties)
    return answers.withColumn("rang", F.row_number().over(w))


def gap(first: Column, second: Column) -> Column:
    """Relative gap of the two best scores; 1 without a second or with a best score of 0."""
    return F.when(second.isNull() | (first == 0), 1.0).otherwise((first - second) / F.nullif(first, F.lit(0.0)))


def with_gap(answers: DataFrame) -> DataFrame:
    """The winner of each example with the second answer and the relative gap; ``serre`` marks tight ones."""
    r = ranked(answers, "rt")
    pick = lambda k, c: F.max(F.when(F.col("rang") == k, F.col(c)))
    best = r.filter("rang <= 2").groupBy("ex").agg(pick(1, "rt").alias("predit"), pick(1, "score").alias("score"), pick(2, "rt").alias("second"), pick(2, "score").alias("score_second"))
    return best.withColumn("ecart", gap(F.col("score"), F.col("score_second"))).withColumn("serre", F.col("ecart") < TIGHT)


def stop_kind(stops: DataFrame) -> DataFrame:
    """feuille, racine or interne."""
    return stops.withColumn("nature", F.when(F.col("feuille"), "feuille").when(F.col("profondeur") == 0, "racine").otherwise("interne"))


def decisive_symbols(queries: DataFrame, centers: DataFrame, winners: DataFrame, k: int = 5) -> DataFrame:
    """The k symbols of each side that the example shares with the winner's profile, by share."""
    profile = centers.select(F.col("rt").alias("predit"), "cote", "symbole", F.col("poids").alias("part"))
    shared = queries.select("ex", "cote", "symbole", "poids").join(winners.select("ex", "predit"), "ex").join(profile, ["predit", "cote", "symbole"])
    w = Window.partitionBy("ex", "cote").orderBy(F.desc("part"), "symbole")
    return shared.withColumn("rang", F.row_number().over(w)).filter(F.col("rang") <= k)


def best_node_oracle(answers: DataFrame) -> DataFrame:
    """The stop against the best node of the same tree: optimal, premature (the best is below) or wrong branch; depth of their last common node."""
    kind = F.when(F.col("score") >= F.col("score_meilleur"), "optimal").when(F.col("dessous"), "premature").otherwise("branche")
    return answers.select("ex", "rt", "noeud", "meilleur", "score", "score_meilleur", "niveau_commun", kind.alias("verdict"))


def branch_directions(answers: DataFrame, nodes: DataFrame) -> DataFrame:
    """How often the way down takes the heavy or the light child, by level."""
    ways = answers.select("rt", F.explode("chemin").alias("noeud")).groupBy("rt", "noeud").agg(F.count("*").alias("_n"))
    weights = nodes.select("rt", "noeud", "parent", "profondeur", "poids")
    sibling = weights.select("rt", "parent", F.col("noeud").alias("_s"), F.col("poids").alias("_sp"))
    both = ways.join(weights, ["rt", "noeud"]).join(sibling, ["rt", "parent"]).filter("_s <> noeud")
    of = lambda c: F.coalesce(F.sum(F.when(c, F.col("_n"))), F.lit(0)).cast("long")
    return both.groupBy("profondeur").agg(of(F.col("poids") > F.col("_sp")).alias("lourd"), of(F.col("poids") < F.col("_sp")).alias("leger"), of(F.col("poids") == F.col("_sp")).alias("egal"))
