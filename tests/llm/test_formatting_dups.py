from pyspark.sql import functions as F

from treillis.llm import formatting_dups as dups

SCHEMA = "enr_id bigint, forme_normalisee string, H array<struct<nom: string, poids: double, type_noeud: bigint, lang_prefix: boolean, forme_normalisee: string>>"
E1, E2 = ("Nom", 1.0, 1, False, "nom"), ("Été!", 2.0, None, True, "été")
ROWS = [
    (7, "L'été  bleu", [E1, E2]), (3, "l été BLEU", [("é té", 2.0, None, True, "ÉTÉ"), ("no-m", 1.0, 1, False, "n o m")]), (5, "lete bleu", [E1, E2]), (4, "lété bleu", [E1, E2, E2]),
    (9, "lété bleu", [E1]), (10, None, [E1]), (11, "x", None), (12, "x", []), (13, "X.", []), (14, "x", [None]), (15, "x", [("a", None, 1, False, "b")]), (16, "x", [("a", 1.0, None, False, "b")]),
]


def test_copies(spark):
    frame = spark.createDataFrame(ROWS, SCHEMA).withColumn("premier", F.lit(1))
    assert {tuple(r) for r in dups.copies(frame, "enr_id", ["forme_normalisee", "H"]).collect()} == {(3, 7), (12, 13)}
    n = {r[0]: r[1] for r in dups.collapsed(frame, "enr_id", ["forme_normalisee", "H"]).collect()}
    assert n == {3: 2, 4: 1, 5: 1, 9: 1, 10: 1, 11: 1, 12: 2, 14: 1, 15: 1, 16: 1}
    assert dups.copies(frame.limit(0), "enr_id", ["forme_normalisee", "H"]).count() == 0


def test_structures_with_one_digest_stay_apart(spark, monkeypatch):
    monkeypatch.setattr(dups, "digest", lambda value, kind: F.lit(1).cast("long"))
    monkeypatch.setattr(dups, "PART", 2)
    frame = spark.createDataFrame(ROWS, SCHEMA)
    assert {tuple(r) for r in dups.copies(frame, "enr_id", ["forme_normalisee", "H"]).collect()} == {(3, 7), (12, 13)}
