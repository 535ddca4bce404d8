"""Trees of many examples that have little in common: the same results as loops, by work that goes with what is shared."""
import random

import numpy as np
import pyarrow as pa
import pytest

from tests.test_trees import loop_tree, score
from treillis.operators import classify, clustering, pairs


def vectors_of(sides):
    """Entries of one side, of a list of {code: weight}."""
    row = np.repeat(np.arange(len(sides)), [len(s) for s in sides])
    return clustering.Vectors(row, np.array([c for s in sides for c in s], dtype=np.int64), np.array([w for s in sides for w in s.values()], dtype=float), np.array([float(sum(w * w for w in s.values())) for s in sides]), np.array([len(s) for s in sides]))


def scattered(seed, n, codes):
    """Sides of few symbols of many, some empty, some the same: most links are 0, and rise as the oldest node grows."""
    rng = random.Random(seed)
    out = [[{rng.randrange(codes): rng.randrange(1, 4) for _ in range(rng.choice((0, 1, 1, 2, 3)))} for _ in "LR"] for _ in range(n)]
    return out + [out[k] for k in range(0, n, 9)]


def grown(sides, **how):
    return clustering.grow(tuple(vectors_of([s[c] for s in sides]) for c in (0, 1)), np.arange(len(sides)), **how)


@pytest.mark.parametrize("seed,codes", [(1, 60), (2, 25), (3, 200)])
def test_groups_and_what_is_unlinked_equal_loops(seed, codes):
    sides = scattered(seed, 36, codes)
    for how in ({}, {"union": True}, {"over": 0.3}, {"over": -1.0}, {"over": -1.0, "union": True}, {"over": 0.2, "sequential": True}, {"over": -1.0, "sequential": True}):
        v = [[dict.fromkeys(s, 1) for s in x] for x in sides] if how.get("union") else sides
        want, got = loop_tree(v, **how), grown(sides, **how)
        assert list(zip(got["enfants"], got["hauteur"])) == [n[:2] for n in want.values()]
        for k, n in want.items():
            assert (got["n_l"][k], got["n_r"][k]) == tuple(len(s) for s in n[2])
            assert (got["norme_l"][k], got["norme_r"][k]) == pytest.approx([sum(w * w for w in s.values()) ** 0.5 for s in n[2]])


def test_groups_grow_by_themselves(monkeypatch):
    """Rows of two groups are never in one table of products."""
    seen, real = [], clustering.Side.__init__
    monkeypatch.setattr(clustering.Side, "__init__", lambda self, *a: (seen.append(len(a[3])), real(self, *a))[1])
    sides = [[{g: 1, 1000 + k: 1}, {g: 2}] for k, g in enumerate([0, 1, 2, 3] * 25)] + [[{0: 1}, {}], [{}, {1: 1}]]
    got = grown(sides)
    assert max(seen) == 25 and len(got["noeud"]) == 2 * len(sides) - 1


def tree_of(sides, nodes):
    """The rows that classify.Tree takes."""
    rows = {c: pa.array(nodes[c]) for c in ("noeud", "poids", "profondeur", "parent", "debut", "fin", "norme_l", "norme_r")} | {"enfants": pa.array(nodes["enfants"], pa.list_(pa.int32()))}
    held = [sides[e] if e is not None else [{}, {}] for e in nodes["ex"]]
    return pa.table(rows | parts_of(held))


def parts_of(sides):
    out = {}
    for k, c in enumerate("LR"):
        out |= {f"c{c}": pa.array([float(sum(w * w for w in s[k].values())) for s in sides]), f"s{c}": pa.array([list(s[k]) for s in sides], pa.list_(pa.int64())), f"p{c}": pa.array([[float(w) for w in s[k].values()] for s in sides], pa.list_(pa.float64()))}
    return out


def answers_of(sides, nodes, asked):
    return classify._answer(pa.table({"ex": pa.array(range(len(asked)), pa.int64())} | parts_of(asked)), tree_of(sides, nodes), False).to_pylist()


@pytest.mark.parametrize("seed,cut", [(4, False), (5, False), (6, True)])
def test_best_nodes_equal_all_scores(seed, cut):
    """In trees and in forests."""
    sides, asked = scattered(seed, 40, 30), scattered(seed + 10, 40, 30)
    nodes, want = grown(sides, over=0.2 if cut else None), loop_tree(sides, over=0.2 if cut else None)
    inside = {c: k for k, n in want.items() for c in n[0] or []}
    depth = lambda k: 0 if k not in inside else 1 + depth(inside[k])
    above = lambda k: [k] if k not in inside else [*above(inside[k]), k]
    for q, r in zip(asked, answers_of(sides, nodes, asked)):
        each = {k: score(n[2], q) for k, n in want.items()}
        first = lambda among: min(among, key=lambda k: (-each[k], k))  # noqa: B023, E731
        assert r["meilleur"] == first(each) and r["score_meilleur"] == pytest.approx(each[r["meilleur"]], abs=2e-9)
        assert r["voisin"] == first(k for k in each if want[k][0] is None) and r["racine"] == first(k for k in each if k not in inside)
        common = [k for k in above(r["noeud"]) if k in above(r["meilleur"])]
        assert r["niveau_commun"] == (depth(common[-1]) if common else -1)


def test_work_of_a_deep_tree(monkeypatch):
    """A tree as deep as it has leaves: few nodes are scored for a question, and the last common node takes few steps."""
    n = 3_000
    sides = [[{k: 1}, {k: 1}] for k in range(n)]
    nodes = grown(sides)
    assert max(nodes["profondeur"]) == n - 1
    steps, scored, real = [], [], classify.Strip.score
    monkeypatch.setattr(classify.Strip, "score", lambda self, who, at: (scored.append(len(at)), real(self, who, at))[1])
    tree = classify.Tree(tree_of(sides, nodes))
    flat = np.flatnonzero
    monkeypatch.setattr(np, "flatnonzero", lambda x: (steps.append(1), flat(x))[1])
    assert tree.common_depth(np.array([0, n - 1]), np.array([1, 5])).tolist() == [n - 2, 0]
    assert len(steps) < 10
    assert [r["voisin"] for r in answers_of(sides, nodes, [[{n - 1: 1}, {n - 1: 1}], [{n - 2: 2}, {}]])] == [n - 1, n - 2]
    assert sum(scored) < 100


@pytest.mark.parametrize("union", [False, True])
def test_holders_of_a_symbol_are_seen_once(monkeypatch, union):
    """A symbol that all leaves have on one side: a merge looks at the entries of its node, not at all leaves."""
    n, seen, real = 400, [], clustering.Sum.take
    monkeypatch.setattr(clustering.Sum, "take", lambda self, k: (found := real(self, k), seen.append(len(found)))[0])
    got = grown([[{0: 1, k + 1: 2}, {k: 1}] for k in range(n)], union=union)
    assert got["hauteur"][n:] == [0.0] * (n - 1) and got["enfants"][-1] == [2 * n - 3, n - 1]
    assert sum(seen) <= 3 * n


def test_a_level_is_scored_at_once(monkeypatch):
    """All questions of a block go down a deep tree together, both children in one step."""
    n = 300
    sides = [[{k: 1}, {k: 1}] for k in range(n)]
    nodes, steps, real = grown(sides), [], classify.Strip.score
    monkeypatch.setattr(classify.Strip, "score", lambda self, who, at: (steps.append(1), real(self, who, at))[1])
    got = answers_of(sides, nodes, [sides[0]] * 250)
    assert {(r["noeud"], r["profondeur"], r["calculs"]) for r in got} == {(0, n - 1, 2 * n - 1)}
    assert len(steps) < n + 10
