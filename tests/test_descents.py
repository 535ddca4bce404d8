"""Descents alone, and best nodes alone: what they give equals the whole answers, and they do no more than they need."""
import pyarrow as pa
import pytest

from tests.test_tree_sizes import grown, parts_of, scattered, tree_of
from tests.test_trees import SIDES, drawn, loop_descent, loop_tree, score
from treillis.operators import classify, clustering


def answer(sides, nodes, asked, which, paths=False):
    table = pa.table({"ex": pa.array(range(len(asked)), pa.int64())} | parts_of(asked))
    tree = tree_of(sides, nodes)
    return classify._answer(table, tree.set_column(tree.column_names.index("parent"), "parent", tree["parent"].cast(pa.int32())), paths, which).to_pylist()


@pytest.mark.parametrize("seed", [4, 5])
def test_descents_look_at_no_leaves(monkeypatch, seed):
    """Stops, ways and counts are those of loops, without a product with all leaves."""
    sides, asked = scattered(seed, 40, 30), scattered(seed + 10, 60, 30)
    nodes, want = grown(sides), loop_tree(sides)
    monkeypatch.setattr(classify.Tree, "products", lambda *a: pytest.fail("a question met all leaves"))
    for q, r in zip(asked, answer(sides, nodes, asked, "descente", True), strict=True):
        at, seen, way = loop_descent(want, len(want) - 1, q)
        assert (r["noeud"], r["calculs"], r["chemin"], r["profondeur"]) == (at, seen, way, len(way) - 1)
        assert r["scores"] == pytest.approx([score(want[k][2], q) for k in way], abs=2e-9) and r["score"] == r["scores"][-1]
        assert r["meilleur"] is None and r["feuille"] == (want[at][0] is None)


def test_descent_in_a_tree_of_one_leaf_or_without_symbols():
    one = [[{1: 1}, {2: 1}]]
    got = answer(one, grown(one), [[{1: 2}, {}], [{7: 1}, {8: 1}]], "descente", True)
    assert [(r["noeud"], r["score"], r["calculs"], r["chemin"]) for r in got] == [(0, 0.5, 1, [0]), (0, 0.0, 1, [0])]
    empty = [[{}, {}], [{}, {}]]
    assert [(r["noeud"], r["score"], r["calculs"]) for r in answer(empty, grown(empty), [[{1: 1}, {}]], "descente")] == [(2, 0.0, 3)]


def test_best_nodes_need_no_descent(monkeypatch):
    sides, asked = scattered(4, 40, 30), scattered(14, 40, 30)
    nodes = grown(sides)
    whole = answer(sides, nodes, asked, "tout")
    for name in ("stops", "descend"):
        monkeypatch.setattr(classify.Tree, name, lambda *a: pytest.fail("a question descended"))
    some = answer(sides, nodes, asked, "noeuds")
    for c in ("meilleur", "score_meilleur", "voisin", "score_voisin", "n_noeuds"):
        assert [r[c] for r in some] == [r[c] for r in whole]
    assert all(r["noeud"] is None for r in some)


def test_descending_blocks_share_a_tree(spark, monkeypatch):
    """Fewer copies of a tree are sent where questions only descend; in blocks of any size the answers are the same."""
    frame = spark.createDataFrame(drawn(3, 1)[0], SIDES)
    nodes = clustering.cluster(frame)
    columns = ["ex", "rt", "noeud", "score", "profondeur", "calculs"]
    want = sorted(classify.tree_answers(frame, frame, nodes, which="descente").select(*columns).collect())
    monkeypatch.setattr(classify, "BLOCK", 2)
    got = classify.tree_answers(frame, frame, nodes, which="descente")
    assert sorted(got.select(*columns).collect()) == want
    plan = got._jdf.queryExecution().toString()
    blocks = -(-frame.select("ex").distinct().count() // (2 * classify.DESCENDING))
    assert f"pmod(xxhash64(ex" in plan and f"cast({blocks} as bigint)" in plan
