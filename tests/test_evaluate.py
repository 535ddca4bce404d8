import pytest

from treillis.operators import crossval, evaluate

PRED = "ex bigint, attendu string, predit string, score double"


def test_metrics(spark):
    p = spark.createDataFrame([(1, "a", "a", 0.9), (2, "a", "b", 0.4), (3, "b", "b", 0.5), (4, "c", "b", 0.1), (5, "a", None, 0.0)], PRED)
    types = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "rt string")
    got = {r["rt"]: (r["precision"], r["rappel"], round(r["f1"], 6)) for r in evaluate.per_type(p, types).collect()}
    assert got == {"a": (1.0, pytest.approx(1 / 3), 0.5), "b": (pytest.approx(1 / 3), 1.0, 0.5), "c": (0.0, 0.0, 0.0), "d": (0.0, 0.0, 0.0)}
    assert evaluate.macro(p, types).first()["f1"] == pytest.approx(0.25)
    m = {r["attendu"]: (r["a"], r["b"], r["c"]) for r in evaluate.confusion(p, ["a", "b", "c"]).collect()}
    assert m == {"a": (1, 1, 0), "b": (0, 1, 0), "c": (0, 1, 0)}
    kept = {r["seuil"]: (r["gardes"], r["justes"], r["justes_perdus"]) for r in evaluate.abstention(p, [0.0, 0.45]).collect()}
    assert kept == {0.0: (5, 2, 0), 0.45: (2, 2, 0)}


def test_exact_tests(spark):
    changed = spark.createDataFrame([("corrige",)] * 39 + [("casse",)] * 29 + [("autre",)], "changement string")
    assert evaluate.sign_test(changed).first()["p"] == pytest.approx(0.274990, abs=1e-6)
    for signs, p in (([1] * 10, 0.001953), ([1, -1, -1, -1, -1, -1, 1, -1, -1, 1], None)):
        d = spark.createDataFrame([(k, s * (k + 1.0)) for k, s in enumerate(signs)], "k int, d double")
        row = evaluate.wilcoxon(d).first()
        if p:
            assert row["w_plus"] == 55 and row["p"] == pytest.approx(p, abs=1e-6)
        else:
            assert row["w_plus"] == 18 and row["p"] == pytest.approx(0.375, abs=1e-6)
    with pytest.raises(Exception, match="more than 20"):
        evaluate.wilcoxon(spark.createDataFrame([(k, k + 1.0) for k in range(21)], "k int, d double")).collect()
    v = spark.createDataFrame([(0, 3.0), (1, 1.0), (2, 3.0), (3, 2.0)], "k int, v double")
    assert [r["rang_moyen"] for r in evaluate.average_ranks(v, "v").orderBy("k").collect()] == [3.5, 1.0, 3.5, 2.0]


def test_folds(spark):
    import random

    rng = random.Random(42)
    places = list(range(10))
    rng.shuffle(places)
    assert places == [7, 3, 2, 8, 5, 6, 9, 4, 0, 1]
    dealt = crossval.seeded_folds({"b": 11, "a": 10})
    assert [p for t, p, f in dealt if t == "a" and f == 0] == [7, 3]
    assert sorted(f for t, _, f in dealt if t == "b") == [0, 0, 1, 1, 2, 2, 3, 3, 4, 4, 4]
    rows = spark.createDataFrame([(i, "r" if i % 3 else "s") for i in range(40)], "ex bigint, rt string")
    folds = crossval.hashed_folds(rows, [1, 2], 5, ("rt",))
    assert folds.groupBy("graine", "ex").count().filter("count <> 1").count() == 0
    assert {r["n"] for r in folds.filter("rt = 'r' and pli < 4").groupBy("graine", "pli").count().withColumnRenamed("count", "n").collect()} == {5}


def test_choice(spark):
    rows = [(c, 1, k, f) for c, fs in {"best": (0.8, 0.9, 0.7), "near": (0.79, 0.91, 0.68), "far": (0.3, 0.4, 0.2)}.items() for k, f in enumerate(fs)]
    m = spark.createDataFrame(rows, "cle string, graine int, pli int, f1 double")
    ranks = spark.createDataFrame([("best", 2, 0), ("near", 1, 1), ("far", 0, 2)], "cle string, rang int, place int")
    assert evaluate.choose_simplest(m, ranks).first()["cle"] == "near"
    assert {r["cle"] for r in evaluate.beats(m, "far").filter("bat").collect()} == {"best", "near"}


def test_causes(spark):
    p = spark.createDataFrame([(1, "a", "b", 0.9, "a", 0.01), (2, "a", "b", 0.9, "c", 0.5), (3, "a", "a", 0.9, "b", 0.5)], PRED + ", second string, ecart double")
    rows = spark.createDataFrame([(1, "x", "y"), (2, "x", "z"), (3, "x", "y")], "ex bigint, A string, B string")
    traits = spark.createDataFrame([("x", False, False, True), ("y", False, False, False)], "terme string, pauvre boolean, singulier boolean, polysemique boolean")
    got = {r["ex"]: (r["causes"], r["cause"]) for r in evaluate.error_causes(p, rows, traits).collect()}
    assert got == {1: (["classe_multiple", "polysemie"], "classe_multiple"), 2: (["connaissance", "polysemie"], "connaissance")}
