from test_trees import loop_descent, loop_tree, score

from pyspark.sql import functions as F

from treillis import cli
from treillis.model import RECORD_SCHEMA, RETAINED
from treillis.operators import crossval
from treillis.sources import store

EXAMPLES = "lot string, ex bigint, rt string, ordre int, split string, A string, B string, syntagme string"


def inputs(spark):
    words = ["or", "fer", "bois", "eau", "lin", "sel", "blé", "riz"]
    entry = lambda w: (w, 10.0, 1, False, w)
    records = [(w, None, True, None, [entry(f"h{k % 3}"), entry(f"h{k % 4 + 3}")], [("r_isa", k + 1)], [("CHOSE", 5.0, False)] if k % 2 else None, None, None) for k, w in enumerate(words)]
    rows = [(f"f{k % 3}", k, "rs"[(k * k) % 3 == 1], k // 3, "train", words[k % 8], words[(k * 3 + 1) % 8] if k % 7 else "rare", f"p{k}") for k in range(36)]
    return spark.createDataFrame(rows, EXAMPLES), spark.createDataFrame(records, RECORD_SCHEMA)


def test_study_equals_loops(spark):
    from treillis.operators import similarity
    from treillis.operators.signatures import signatures

    rows, records = inputs(spark)
    config = RETAINED.but(weighting="jdm_idf")
    got = {r["pli"]: r for r in crossval.study(rows, records, [config], [7], 3).collect()}
    folds = {r["ex"]: r for r in crossval.hashed_folds(rows, [7], 3, ("rt",)).collect()}
    assert sorted(got) == [0, 1, 2]
    for p, measured in got.items():
        train = [r for r in folds.values() if r["pli"] != p]
        terms = spark.createDataFrame([(t,) for t in {t for r in train for t in (r["A"], r["B"])} - {"rare"}], "terme string")
        sides = {}
        for r in similarity.sides(rows, signatures(records, config, terms)).collect():
            sides.setdefault(r["ex"], [{}, {}])["LR".index(r["cote"])][r["symbole"]] = r["poids"]
        trees = {}
        for rt in "rs":
            trees[rt] = loop_tree([sides[r["ex"]] for r in sorted((r for r in train if r["rt"] == rt), key=lambda r: (r["lot"], r["ordre"], r["ex"]))])
        told, roots = {}, 0
        for ex, r in folds.items():
            if r["pli"] == p:
                found = {rt: loop_descent(t, len(t) - 1, sides[ex]) for rt, t in trees.items()}
                best = min(trees, key=lambda rt: (-score(trees[rt][found[rt][0]][2], sides[ex]), rt))  # noqa: B023
                told[ex], roots = best, roots + (found[best][0] == len(trees[best]) - 1)
        f1 = []
        for rt in "rs":
            hit = sum(told[e] == rt == folds[e]["rt"] for e in told)
            f1.append(2 * hit / (sum(t == rt for t in told.values()) + sum(folds[e]["rt"] == rt for e in told)))
        assert abs(measured["f1"] - sum(f1) / 2) < 1e-9 and abs(measured["racine"] - roots / len(told)) < 1e-9


def test_command_line_learns_and_tests(spark, tmp_path):
    rows, records = inputs(spark)
    corpus = rows.select(F.col("ex").alias("ligne_id"), F.col("lot").alias("fichier"), F.col("ordre").alias("ligne"), "syntagme", "A", "B", F.col("rt").alias("relation"), F.when(F.col("ex") % 4 == 0, "test").otherwise("train").alias("split"), *[F.lit(None).cast("string").alias(c) for c in ("det", "definitude", "ambigu", "candidats")])
    corpus.write.parquet(str(tmp_path / f"{cli.CORPUS}.parquet"))
    records.withColumn("enr_id", F.monotonically_increasing_id()).write.parquet(str(tmp_path / f"{cli.RECORDS}.parquet"))
    cli.learn(spark, str(tmp_path), str(tmp_path / "model"))
    assert cli.test(spark, str(tmp_path), str(tmp_path / "model")).first()["n"] == 9
    assert "chemin" in store.load(spark, str(tmp_path / "model" / "predictions")).columns
    cli.predict(spark, str(tmp_path / "model"), ["or de fer"], 3, True, None)
