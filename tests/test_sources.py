import hashlib
import json

import pytest
from pyspark.sql import functions as F

from treillis.operators import clustering, similarity
from treillis.operators.signatures import signature_chain, signatures
from treillis.model import RECORD_SCHEMA, RETAINED
from treillis.sources import collection, corpus, network, store
from treillis.streaming import scoring


def test_raw_corpus(spark, tmp_path):
    (tmp_path / "raw").mkdir()
    lines = ["﻿chat du rabbin ; r_own\r".encode(), b"sans relation", "sac de riz du Laos; r_lieu".encode(), b"\xff ; r", b"", "a ; b ; c".encode(), *["lit de plume ; r_x".encode()] * 50, b""]
    (tmp_path / "raw" / "c.csv").write_bytes(b"\n".join(lines))
    raw = corpus.read_raw(spark, str(tmp_path / "raw"))
    bad = {r["ligne"]: r["anomalie"] for r in raw.filter("anomalie is not null").collect()}
    assert bad == {2: "champs", 4: "utf-8", 5: "vide", 6: "champs"}
    clean = corpus.clean(raw)
    rows = {r["ligne"]: r for r in clean.collect()}
    assert (rows[1]["A"], rows[1]["B"], rows[1]["relation"], rows[1]["split"]) == ("chat", "rabbin", "r_own", "train")
    assert rows[3]["ambigu"] == "oui" and rows[3]["A"] == "" and rows[3]["candidats"] == "sac / riz du Laos | sac de riz / Laos"
    assert rows[56]["split"] == "test" and len(rows) == 52
    corpus.write_clean(clean, str(tmp_path / "clean"))
    again = corpus.read_clean(spark, str(tmp_path / "clean"))
    assert again.count() == 52 and again.filter("A = ''").count() == 1 and again.filter("candidats is null").count() == 0
    terms = {(r["terme"], r["role"]): (r["relations_associees"], r["nb_occurrences"], r["nb_candidats_ambigus"]) for r in corpus.term_dictionary(again).collect()}
    assert terms["sac", "A"] == ("r_lieu", 0, 1) and terms["lit", "A"] == ("r_x", 50, 0)
    contexts = corpus.term_contexts(again.withColumn("ligne_id", F.monotonically_increasing_id()))
    absent = spark.createDataFrame([("rabbins",), ("sac",), ("plume",)], "terme string").union(spark.createDataFrame([("chat",)], "terme string"))
    known = spark.createDataFrame([("Chat",)], "terme string")
    proposals = {r["terme"]: r["raison"] for r in corpus.replacement_proposals(absent, contexts, known).collect()}
    assert proposals == {"sac": "candidat de découpage seulement", "plume": "aucune variante existante", "chat": "aucune variante existante"}


def test_collection(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"terme":"a","existe":true}\n\nnot json\n{"terme":"a","existe":false}\n{"terme":"b"}\n')
    records = collection.read_records(spark, str(tmp_path / "c.jsonl"))
    assert collection.skipped_lines(records).count() == 1
    last = {r["terme"]: r["existe"] for r in collection.last_of_each(records).collect()}
    assert last == {"a": False, "b": None}
    terms = spark.createDataFrame([("a",), ("z",)], "terme string")
    fetch = lambda todo: todo.select("terme", F.lit(True).alias("existe"))
    assert collection.collect_increment(terms, records, fetch, str(tmp_path / "out")) == 1
    done = spark.read.schema(RECORD_SCHEMA).json(str(tmp_path / "out"))
    assert [r["terme"] for r in done.collect()] == ["z"]
    edges = spark.createDataFrame([("t", "x", "r", 5.0), ("t", "x", "r", 7.0), ("t", "en:y", "r", 9.0), ("t", "_INFO-SEM-MASC", "i", 3.0), ("t", "n", "r", -1.0), ("q", "t", "r", 2.0)], "src string, dst string, type string, w double")
    nodes = spark.createDataFrame([(1, "x", 1, 2.0)], "id bigint, nom string, type int, w double")
    h = collection.hypernyms_of_edges(edges, nodes, "r")
    assert [(r["nom"], r["poids"], r["lang_prefix"]) for r in h.filter("terme = 't'").orderBy("rang").collect()] == [("en:y", 9.0, True), ("x", 7.0, False)]
    tags = collection.tags_of_targets(edges.select(F.col("src").alias("terme"), F.col("dst").alias("nom"), F.col("w").alias("poids")))
    assert [tuple(r) for r in tags.collect()] == [("t", "MASC", 3.0, True)]
    types = spark.createDataFrame([(4, "r", None)], "id int, nom string, description string")
    whole = collection.assemble(spark.createDataFrame([("t",), ("ts",)], "terme string"), h, collection.incoming_histogram(edges, types), tags, spark.createDataFrame([], "terme string, nom string, poids double"))
    assert {r["terme"]: (r["H"] and len(r["H"]), r["diagnostic_singulier"]) for r in whole.collect()}["t"] == (2, None)
    assert {tuple(r) for r in collection.first_existing_variant(terms, spark.createDataFrame([("A",), ("zz",)], "terme string")).collect()} == set()
    collection.repair(spark, str(tmp_path / "c.jsonl"), str(tmp_path / "repaired"))
    assert spark.read.text(str(tmp_path / "repaired")).count() == 3


def test_client(tmp_path):
    sent, slept = [], []
    answers = {"node_by_name/chat%20noir": [(500, "x"), (200, '{"id": 1}')], "node_by_name/rien": [(404, "")], "bad": [(403, "")]}

    def send(url, limit):
        sent.append(url)
        return answers[url.split("/", 3)[3]].pop(0)

    client = network.Client("http://h/", str(tmp_path), send=send, sleep=slept.append, clock=lambda: 0.0)
    assert client.node("chat noir") == {"id": 1} and client.node("chat noir") == {"id": 1}
    assert not client.exists("rien") and not client.exists("rien") and len(sent) == 3
    assert 1.0 in slept and 0.3 in slept
    with pytest.raises(PermissionError):
        client.get("bad")
    assert [c["cached"] for c in client.calls] == [False, True, False, True]
    request = network.Request.of("relations", "to", "chat noir", b=True, a=[2, 1], c=None)
    assert request.options == (("a", "1"), ("a", "2"), ("b", "true")) and request.path == "/relations/to/chat%20noir"
    assert request.key == hashlib.sha256(b'{"params": [["a", "1"], ["a", "2"], ["b", "true"]], "path": "/relations/to/chat%20noir"}').hexdigest()
    assert (tmp_path / (network.Request.of("node_by_name", "chat noir").key + ".json")).exists()
    told = [(404, ""), (500, '{"detail":"Node not found"}'), (200, '{"status_code":404}'), (500, "{}"), (200, "{}"), (200, "[]"), (500, "x")]
    assert [network.Answer(*a).missing for a in told] == [True, True, True, False, False, False, False]
    with pytest.raises(ConnectionError):
        network.Client("http://h", str(tmp_path), offline=True).node("autre")


def test_data_source(spark, tmp_path):
    client = network.Client("http://h", str(tmp_path), send=lambda u, t: (200, json.dumps({"nodes": [{"id": 2, "name": "b"}], "relations": [{"node1": 1, "node2": 2, "type": 6, "w": 3}]})), sleep=lambda s: None)
    client.relations("a", True)
    spark.dataSource.register(network.LexicalNetwork)
    got = spark.read.format("lexical_network").options(cache=str(tmp_path), terms='["a"]').load().collect()
    assert [tuple(r) for r in got] == [("a", 1, 2, "b", 6, 3.0)]


def test_collecting_from_the_network(spark, tmp_path):
    edge = lambda b, t, w: {"node1": 1, "node2": b, "type": t, "w": w}
    nodes = [{"id": 2, "name": "navire", "type": 1}, {"id": 3, "name": "_INFO-SEM-MASC", "type": 36}]
    answers = {
        "node_by_name/bac": {"id": 1, "name": "bac", "type": 1, "w": 50}, "relations/from/bac": {"nodes": nodes, "relations": [edge(2, 6, 30), edge(2, 6, -1), edge(3, 36, 9)]},
        "relations/from/ba": {}, "relations/to/bac": {"relations": [{"type": 9, "w": 1}, {"type": 9, "w": 2}, {"type": 4, "w": 0}]},
    }

    def send(url, limit):
        path = url.split("/", 3)[3].split("?")[0]
        return (200, json.dumps(answers[path])) if path in answers else (404, "") if "rien" in path else (403, "")

    client = network.Client("http://h", str(tmp_path / "cache"), send=send, sleep=lambda s: None)
    for name in ("bac", "ba"):
        for kind in (6, 36, 1):
            client.relations(name, True, [kind])
    client.node("bac"), client.relations("bac", False, narrow=True)
    with pytest.raises(network.NotFound):
        client.node("rien")
    fetch = collection.network_records(spark, {"cache": str(tmp_path / "cache"), "log": str(tmp_path / "log")}, {"r_isa": 6, "r_infopot": 36, "r_raff_sem": 1, "r_patient": 9})
    terms = spark.createDataFrame([("bac",), ("rien",), ("panne",)], "terme string")
    done = spark.createDataFrame([], "terme string")
    assert collection.collect_increment(terms, done, fetch, str(tmp_path / "fiches"), batch=2) == 2
    got = {r["terme"]: r for r in spark.read.schema(RECORD_SCHEMA).json(str(tmp_path / "fiches")).collect()}
    assert [(h["nom"], h["poids"]) for h in got["bac"]["H"]] == [("navire", 30.0)] and [tuple(t) for t in got["bac"]["TRT"]] == [("r_patient", 2)]
    assert [s["tag"] for s in got["bac"]["SST"]] == ["MASC"] and got["bac"]["noeud"]["id"] == 1 and got["rien"]["existe"] is False
    assert [r["terme"] for r in spark.read.json(str(tmp_path / "fiches_erreurs")).collect()] == ["panne"]
    assert spark.read.json(str(tmp_path / "log")).filter("cached").count() > 0


def test_store_and_streams(spark, tmp_path):
    m = spark.createDataFrame([("k", 1, 0, 0.5), ("k", 1, 1, 0.6), ("j", 1, 0, 0.7)], "cle string, graine int, pli int, f1 double")
    store.save(m, str(tmp_path / "m"), "cle")
    back = store.load(spark, str(tmp_path / "m"))
    assert {r["cle"] for r in store.complete_measures(back, 1, 2).collect()} == {"k"}
    assert [tuple(r) for r in store.missing_tasks(back.select("cle").distinct(), [1], 2, back).collect()] == [("j", 1, 1)]
    entry = [("navire", 1.0, 1, False, "navire")]
    records = spark.createDataFrame([("chat", None, True, None, entry, None, None, None, None)], RECORD_SCHEMA)
    sigs = signatures(records, RETAINED)
    rows = spark.createDataFrame([("f", 1, "r", 1, "train", "chat", "rabbin")], "lot string, ex bigint, rt string, ordre int, split string, A string, B string")
    sides = similarity.sides(rows, sigs)
    store.Model(sigs, sides, rows.withColumn("syntagme", F.lit("chat du rabbin")), clustering.cluster(sides)).save(str(tmp_path / "model"))
    model = store.Model.load(spark, str(tmp_path / "model"))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("chat du rabbin\nrien\nlune de miel\nlune de chat du rabbin\nlune d'or\n")
    table = scoring.score_file(spark, str(tmp_path / "in"), model)
    assert table.columns == ["ex", *scoring.SCORED]
    scored = {r["syntagme"]: (r["predit"], r["score"], r["arret"], r["poids_noeud"], r["exemple_noeud"]) for r in table.collect()}
    assert scored["chat du rabbin"] == ("r", 1.0, "feuille", 1, "chat du rabbin") and scored["rien"] == (None,) * 5 and scored["lune de miel"] == ("AUCUNE", 0.0, None, None, None)
    phrases = spark.createDataFrame([(1, "lune de chat du rabbin")], "ex bigint, syntagme string")
    known = lambda *t: spark.createDataFrame([(x,) for x in t], "terme string")
    assert scoring.chosen_splits(phrases, known("lune de chat", "rabbin")).first()["B"] == "rabbin" and scoring.chosen_splits(phrases, known("lune")).first()["A"] == "lune"
    fetched = spark.createDataFrame([("or", "H", "rabbin", 1.0)], "terme string, trait string, symbole string, poids double")
    gold = spark.createDataFrame([(1, "lune d'or")], "ex bigint, syntagme string")
    assert scoring.score_phrases(gold, model).first()["predit"] == "AUCUNE" and scoring.score_phrases(gold, model, {"reseau": fetched}).first()["score"] == 0.5
    chain = {r["terme"]: r["provenance"] for r in signature_chain(known("chat", "or", "lune"), {"modele": sigs, "reseau": fetched}).collect()}
    assert chain == {"chat": "modele", "or": "reseau", "lune": "vide"}
    for _ in range(2):
        scoring.stream_scores(spark, str(tmp_path / "in"), model, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5
    (tmp_path / "rec").mkdir()
    (tmp_path / "rec" / "a.json").write_text('{"terme":"a"}\n{"terme":"a","existe":true}\n{"x":1}\n')
    scoring.stream_records(spark, str(tmp_path / "rec"), str(tmp_path / "done"), str(tmp_path / "cp2")).awaitTermination()
    assert [(r["terme"], r["existe"]) for r in scoring.latest_records(spark, str(tmp_path / "done")).collect()] == [("a", True)]
