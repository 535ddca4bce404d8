from test_study import inputs
from test_trees import SIDES, drawn

from pyspark.sql import functions as F

from treillis.model import RETAINED
from treillis.operators import classify, clustering, crossval, pairs, signatures, similarity


def test_study_collects_fixed_symbols_once(spark, monkeypatch):
    """The symbols that no fold changes are worked out once, not for each fold."""
    calls, real = [], signatures.hypernyms
    monkeypatch.setattr(signatures, "hypernyms", lambda *a: calls.append(1) or real(*a))
    rows, records = inputs(spark)
    assert crossval.study(rows, records, [RETAINED.but(weighting="jdm_idf")], [7], 3).count() == 3
    assert len(calls) == 1


def test_packed_terms_equal_packed_sides(spark):
    rows, records = inputs(spark)
    sigs = signatures.signatures(records, RETAINED)
    got = pairs.packed_terms(rows.select("lot", "ex", "rt", "ordre", "A", "B"), sigs)
    sides = similarity.sides(rows, sigs)
    want = {r["ex"]: r for r in pairs.packed(sides, pairs.coded(sides), ["ex"], sizes=True).collect()}
    mine = got.collect()
    assert len(mine) == len(want) == rows.count()
    for r in mine:
        w = want[r["ex"]]
        for c in "LR":
            assert (r[f"n{c}"], round(r[f"c{c}"], 9)) == (w[f"n{c}"], round(w[f"c{c}"], 9))
            assert set(map(lambda x: round(x, 9), w[f"p{c}"])) <= set(map(lambda x: round(x, 9), r[f"p{c}"]))
    trees = lambda t: sorted((r["rt"], r["noeud"], r["hauteur"] or 0.0, r["debut"]) for r in t.collect())
    assert trees(clustering.packed_cluster(got)) == trees(clustering.cluster(sides))


def test_asked_answers_equal_whole_ones(spark):
    frame = spark.createDataFrame(drawn(3, 1)[0], SIDES)
    asked = frame.filter("ordre % 2 = 0").withColumn("ex", F.col("ex") + 7_000_000)
    nodes = clustering.cluster(frame)
    whole = classify.tree_answers(asked, frame, nodes)
    for which, columns in (("descente", ["noeud", "score", "profondeur", "poids", "feuille", "calculs"]), ("feuilles", ["voisin", "score_voisin", "n_feuilles"])):
        some = classify.tree_answers(asked, frame, nodes, which=which)
        assert sorted(some.select("ex", "rt", *columns).collect()) == sorted(whole.select("ex", "rt", *columns).collect())
        assert some.filter("meilleur is not null").count() == 0


def test_shared_weights_equal_node_symbols(spark):
    frame = spark.createDataFrame(drawn(3, 1)[0], SIDES)
    nodes = clustering.cluster(frame)
    want = {(r["rt"], r["noeud"], r["cote"], r["symbole"]): r["poids"] for r in clustering.node_symbols(nodes, nodes, frame).collect()}
    asked = nodes.select("rt", "noeud").crossJoin(frame.select("cote", "symbole").distinct())
    got = {(r["rt"], r["noeud"], r["cote"], r["symbole"]): r["poids"] for r in clustering.shared_weights(asked, nodes, nodes, frame).collect()}
    assert got == want


def test_roots_need_no_tree(spark):
    from __spark_entry__ import SMOKE_DIR
    from treillis.plans import reference

    f = reference.Frames(spark, SMOKE_DIR)
    got = {r["ex"]: (r["predit"], r["noeud"], r["calculs"]) for r in reference.queries()["roots_only"](spark, SMOKE_DIR).collect()}
    assert got == {r["ex"]: (r["predit"], r["noeud"], r["calculs"]) for r in reference.roots_only(f).collect()}
    assert not any(k.startswith("arbres") for k in f.kept)
    assert got == {r["ex"]: (r["rt"], r["noeud"], r["calculs"]) for r in classify.best_everywhere(f.tree_answers(), "racines").collect()}


def test_neighbours_need_no_tree(spark):
    from __spark_entry__ import SMOKE_DIR
    from treillis.plans import reference

    f = reference.Frames(spark, SMOKE_DIR)
    got = {r["ex"]: (r["predit"], r["noeud"], r["calculs"]) for r in reference.nearest_neighbour(f).collect()}
    assert not any(k.startswith("arbres") for k in f.kept)
    assert got == {r["ex"]: (r["rt"], r["noeud"], r["calculs"]) for r in classify.best_everywhere(f.tree_answers(), "feuilles").collect()}
