import pytest
from pyspark.sql import functions as F

from treillis.model import REFERENCE, RETAINED, Config
from treillis.operators import signatures as s
from treillis.model import RECORD_SCHEMA

ENTRY = ("Navire", 40.0, 1, False, "navire")


@pytest.fixture(scope="module")
def records(spark):
    rows = [
        ("u", None, True, None, [ENTRY, ("navire", 60.0, 1, False, "navire"), ("véhicule", 30.0, 1, False, "véhicule"), ("objet", -5.0, 1, False, "objet"), None], [("r_isa", 9), ("r_lieu", 0), ("r_holo", 99), ("r_wiki", 5000), None],
         [("PLACE", 20.0, False), ("PLACE", 50.0, False), ("DET", 25.0, True)], None, None),
        ("v", None, True, None, None, [], [("PLACE", 0.0, False)], None, None),
    ]
    return spark.createDataFrame(rows, RECORD_SCHEMA)


def symbols(frame, term="u"):
    return {r["symbole"]: round(r["poids"], 9) for r in frame.filter(F.col("terme") == term).collect()}


def test_weights(records):
    base = {"H:navire": 1.0, "H:véhicule": 0.5, "TRT:r_isa": 0.5, "TRT:r_holo": 1.0, "SST:PLACE": 1.0, "SST:DET": 0.5}
    assert symbols(s.signatures(records, RETAINED)) == base
    assert symbols(s.signatures(records, RETAINED.but(sst="sans_morpho"))) == {k: v for k, v in base.items() if k != "SST:DET"}
    assert symbols(s.signatures(records, RETAINED.but(term="T0"))) == {**base, "u": 1.0}
    assert symbols(s.signatures(records, RETAINED.but(term="T1"))) == {**base, "H:u": 1.0}
    assert symbols(s.signatures(records, RETAINED.but(weighting="binaire"))) == dict.fromkeys(base, 1.0)
    assert symbols(s.signatures(records, RETAINED.but(weighting="jdm_H"))) == {k: v if k[0] == "H" else 1.0 for k, v in base.items()}
    assert symbols(s.signatures(records, REFERENCE), "v") == {"v": 1.0}
    assert symbols(s.signatures(records, RETAINED.but(h=1, trt="aucun", sst="aucune"))) == {"H:navire": 1.0}


def test_idf_drops_what_all_hold(spark, records):
    both = records.union(records.filter("terme = 'u'").withColumn("terme", F.lit("w")))
    train = spark.createDataFrame([("u",), ("v",), ("w",)], "terme string")
    got = symbols(s.signatures(both, Config(weighting="idf"), train))
    assert got["H:navire"] == pytest.approx(0.405465108)
    assert symbols(s.signatures(both.filter("terme <> 'v'"), Config(weighting="idf"), train.filter("terme <> 'v'"))) == {}
    assert symbols(s.signatures(records, RETAINED.but(df_min=2))) == {}


def test_thresholds_count_absent_terms(spark):
    counts = spark.createDataFrame([("a", "t", 3), ("b", "t", 10), ("c", "x", 1)], "terme string, type string, n bigint")
    assert {r["type"]: round(r["seuil"], 9) for r in s.type_thresholds(counts, 4).collect()} == {"t": 2.94, "x": 0.0}
    assert {r["type"] for r in s.frequent_types(counts, 2).collect()} == {"t"}
    assert [r["terme"] for r in s.trt_policy(counts, "top_idf", 1, 4).filter("type = 'x'").collect()] == ["c"]


def test_last_record_and_vocabulary(spark, records):
    twice = records.filter("terme = 'u'").withColumn("enr_id", F.lit(2)).union(records.filter("terme = 'u'").withColumn("H", F.lit(None).cast(records.schema["H"].dataType)).withColumn("enr_id", F.lit(5)))
    assert s.last_records(twice).first()["H"] is None
    voc = sorted((r["dim"], r["symbole"]) for r in s.vocabulary(s.signatures(records, REFERENCE)).collect())
    assert [v for v, _ in voc] == list(range(len(voc))) and [x for _, x in voc] == sorted(x for _, x in voc)
    assert s.signatures(records.limit(0), RETAINED).count() == 0
    assert Config.of(RETAINED.but(h=None).key) == RETAINED.but(h=None)
