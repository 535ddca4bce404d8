import json

from pyspark.sql import functions as F

from treillis.operators import nested

LOADED = "enr_id bigint, terme string, H array<struct<nom: string, poids: double>>, TRT array<struct<type: string, n bigint>>, diagnostic_singulier struct<raison: string, H: array<struct<nom: string, poids: double>>>, recu_ts timestamp"


def lines():
    rec = {"terme": "t", "H": [{"nom": "a", "poids": 1}, None, {"nom": "b"}], "extra": [{"k": [1, 2]}, {"k": []}]}
    return [
        json.dumps(rec), "﻿" + json.dumps({"lot": {"x": [rec]}}), json.dumps([{"H": {"nom": "solo"}, "terme": None}]), json.dumps({"terme": "t", "H": json.dumps(rec["H"]), "TRT": "n/a"}),
        json.dumps({"terme": "t", "diagnostic_singulier": json.dumps({"raison": "r", "H": {"nom": "d"}}), "TRT": [{"type": "x", "n": 1.0}]}), json.dumps(rec)[:-3], "", None, "null", "# x", json.dumps({"a": json.dumps(rec)}), "[1, 2]",
    ]


def test_children_and_tables(spark):
    raw = spark.createDataFrame(list(enumerate(lines(), 100)), "enr_id bigint, brut string").withColumn("fichier", F.lit("f"))
    loaded = spark.createDataFrame([(1, "a", [("x", 1.0), None], None, ("r", [("y", 2.0)]), None), (2, None, None, [], None, None)], LOADED)
    got = sorted(tuple(r) for r in nested.all_children(loaded, raw).collect())
    assert got == sorted(
        [(1, "H", 0), (1, "diagnostic_singulier.H", 0), (102, "H", 0), (104, "diagnostic_singulier.H", 0), (104, "TRT", 0)] + [(k, "H", r) for k in (100, 101, 103, 110) for r in (0, 2)]
    )
    tables = nested.all_tables(loaded, raw)
    assert {"", "H", "TRT", "diagnostic_singulier.H", "extra", "extra.k"} <= set(tables)
    inner = sorted((r["enr_id"], r["parent"], r["rang"], r["valeur"]) for r in tables["extra.k"].collect())
    assert inner == [(k, [0], r, r + 1) for k in (100, 101, 110) for r in (0, 1)]
    assert {(r["enr_id"], r["rang"], r["nom"]) for r in tables["H"].filter("enr_id in (1, 102)").collect()} == {(1, 0, "x"), (102, 0, "solo")}
    assert tables[""].count() == 2 + 6
    assert nested.all_children(loaded.limit(0), raw.limit(0)).count() == 0


def test_places_are_the_keys_of_the_tables(spark):
    raw = spark.createDataFrame(list(enumerate(lines(), 100)), "enr_id bigint, brut string")
    loaded = spark.createDataFrame([(1, "a", [("x", 1.0), None], None, ("r", [("y", 2.0)]), None)], LOADED)
    for records in nested.collected(loaded, raw):
        tables = nested.flatten(records, "enr_id")
        want = sorted((r["enr_id"], path, r["parent"], r["rang"]) for path, t in tables.items() if path for r in t.collect())
        assert sorted(tuple(r) for r in nested.child_places(records, "enr_id").collect()) == want
    bare = spark.createDataFrame([(1, "a")], "enr_id bigint, terme string")
    assert nested.child_places(bare, "enr_id").count() == 0


def test_objects_keyed_by_data(spark, monkeypatch):
    monkeypatch.setattr(nested, "WIDE", 5)
    rows = [(k, json.dumps({"terme": "t", "H": [{"nom": "a"}], "index": {f"mot{k}": {"n": [k]}}})) for k in range(9)]
    raw = spark.createDataFrame(rows, "enr_id bigint, brut string")
    shapes = nested.infer(raw, "brut", "terme")
    assert nested.merged_schema(shapes).simpleString() == "struct<H:array<struct<nom:string>>,index:string,terme:string>"
    loaded = spark.createDataFrame([], LOADED)
    _, read = nested.collected(loaded, raw)
    assert {r["index"] for r in read.collect()} == {json.dumps({f"mot{k}": {"n": [k]}}) for k in range(9)}
    assert nested.all_children(loaded, raw).count() == 9


def test_merged_schema():
    shapes = {"": {"object"}, "\x1fa": {"array", "object"}, "\x1fa\x1f": {"object", "null"}, "\x1fa\x1f\x1fn": {"bigint"}, "\x1fa\x1fn": {"double"}, "\x1fb": {"text", "bigint"}, "\x1fc": {"null"}}
    assert nested.merged_schema(shapes).simpleString() == "struct<a:array<struct<n:double>>,b:string,c:string>"
