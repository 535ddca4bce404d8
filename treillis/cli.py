"""Command line: check a corpus, collect its terms, learn a model, score phrases, study configurations.

    python -m treillis.cli check RAW CLEAN      raw corpus files to the clean CSV, with counts
    python -m treillis.cli collect DATA OUT --cache C [--base URL] [--limit N]     records of the terms not yet collected
    python -m treillis.cli learn DATA MODEL     tables of a data folder to signatures and trees
    python -m treillis.cli predict MODEL [PHRASE ...] [--file F] [--top N] [--detail] [--cache C]     without phrases: asks for them
    python -m treillis.cli study DATA OUT [--seeds 42,43] [--key K ...]    measures of configurations by folds, resumed
    python -m treillis.cli search DATA OUT      the staged search, with the configuration kept at each stage
    python -m treillis.cli weights DATA OUT [--seeds ...]     weighted traits against none, with exact tests over seeds
    python -m treillis.cli replay DATA MODEL [--no-test]     coverage, learning, tree measures, evaluation, study"""
from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treillis.model import RETAINED, Config
from treillis.operators import classify, clustering, crossval, evaluate, quality, similarity
from treillis.operators.signatures import last_records, signatures
from treillis.session import cut, local_session, table
from treillis.sources import collection, corpus, store
from treillis.sources.store import Model
from treillis.streaming import scoring

CORPUS, RECORDS, KINDS = "corpus_r_processus_instr_1", "termes_jdm", "jdm_relations_types"


def learn(spark, data: str, model: str) -> None:
    rows = similarity.examples(table(spark, data, CORPUS)).filter("split = 'train'")
    sigs = cut(signatures(last_records(table(spark, data, RECORDS)), RETAINED))
    sides = cut(similarity.sides(rows, sigs))
    Model(sigs, sides, rows.select("ex", "syntagme"), clustering.cluster(sides)).save(model)


def test(spark, data: str, model: str) -> DataFrame:
    """Metrics of the test rows by descent; the answers of every tree and the predictions are stored beside the model."""
    known = Model.load(spark, model)
    rows = similarity.examples(table(spark, data, CORPUS)).filter("split = 'test'")
    store.save(classify.tree_answers(similarity.sides(rows, known.signatures), known.leaves, known.nodes, paths=True), f"{model}/reponses")
    answers = store.load(spark, f"{model}/reponses")
    store.save(classify.winners(answers).join(rows.select("ex", F.col("rt").alias("attendu")), "ex"), f"{model}/predictions")
    done = store.load(spark, f"{model}/predictions")
    return evaluate.macro(done, done.select(F.col("attendu").alias("rt")).distinct())


def collect(spark, data: str, out: str, options: dict[str, str], limit: int | None) -> int:
    terms = similarity.terms_of(similarity.examples(table(spark, data, CORPUS)))
    kinds = {r["nom"]: r["id"] for r in table(spark, data, KINDS).select("id", "nom").collect()}  # a fixed table
    fetch = collection.network_records(spark, options, {"r_isa": 6, "r_infopot": 36, "r_raff_sem": 1, **kinds})
    return collection.collect_increment(terms, table(spark, data, RECORDS).select("terme"), fetch, out, limit)


def study(spark, data: str, out: str, configs: list[Config], seeds: list[int]) -> DataFrame:
    """Measures of the configurations; those stored in ``out`` are not worked out again."""
    rows, records = similarity.examples(table(spark, data, CORPUS)).filter("split = 'train'"), last_records(table(spark, data, RECORDS))
    for config in configs:
        for seed in seeds:
            path = f"{out}/{config.key.replace('|', '_')}/{seed}"
            try:
                spark.read.parquet(path).first()
            except Exception:  # noqa: BLE001 - not there yet, or cut off in writing
                store.save(crossval.study(rows, records, [config], [seed]), path)
    return spark.read.parquet(*[f"{out}/{c.key.replace('|', '_')}/{s}" for c in configs for s in seeds])


def weights(spark, data: str, out: str, seeds: list[int]) -> DataFrame:
    """Each weighting against none: mean gain over seeds and the exact signed-rank test."""
    configs = [RETAINED.but(weighting=w) for w in ("binaire", "jdm_H", "jdm_TRT", "jdm_SST", "jdm")]
    by_seed = study(spark, data, out, configs, seeds).groupBy("cle", "graine").agg(F.round(F.avg("f1"), 9).alias("f1"))
    none = by_seed.filter(F.col("cle") == configs[0].key).select("graine", F.col("f1").alias("r"))
    d = by_seed.filter(F.col("cle") != configs[0].key).join(none, "graine").select("cle", F.round(F.col("f1") - F.col("r"), 9).alias("d"))
    return evaluate.wilcoxon(d, "d", "cle").join(d.groupBy("cle").agg(F.avg("d").alias("gain")), "cle")


def predict(spark, model: str, phrases: list[str], top: int, detail: bool, cache: str | None) -> None:
    known, more = Model.load(spark, model), {}
    asked = spark.createDataFrame(list(enumerate(phrases)), "ex bigint, syntagme string")
    if cache:  # terms the model lacks, from the cache of the network
        split = scoring.chosen_splits(asked, known.signatures.select("terme"))
        terms = similarity.terms_of(split.filter("A is not null")).join(known.signatures.select("terme"), "terme", "left_anti")
        fetched = collection.network_records(spark, {"cache": cache}, {"r_isa": 6, "r_infopot": 36, "r_raff_sem": 1})(terms)
        more["reseau"] = cut(signatures(fetched.filter("existe and erreur is null"), RETAINED))
    scoring.score_phrases(asked, known, more).orderBy("ex").show(1000, False)
    if detail:
        split = scoring.chosen_splits(asked, known.signatures.select("terme"))
        answers = cut(scoring.answers_of(split, known, more, paths=True))
        classify.ranked(classify.stops(answers), "rt", "noeud").filter(F.col("rang") <= top).orderBy("ex", "rang").show(1000, False)


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = parser.add_subparsers(dest="what", required=True)
    places = {"check": ("raw", "clean"), "collect": ("data", "out"), "learn": ("data", "model"), "replay": ("data", "model"), "predict": ("model",), "study": ("data", "out"), "search": ("data", "out"), "weights": ("data", "out")}
    commands = {name: sub.add_parser(name) for name in places}
    for name, of in places.items():
        for place in of:
            commands[name].add_argument(place)
    commands["replay"].add_argument("--no-test", action="store_true")
    commands["predict"].add_argument("phrases", nargs="*")
    commands["predict"].add_argument("--file")
    commands["predict"].add_argument("--top", type=int, default=3)
    commands["predict"].add_argument("--detail", action="store_true")
    for name in ("predict", "collect"):
        commands[name].add_argument("--cache")
    commands["collect"].add_argument("--base", default="")
    commands["collect"].add_argument("--limit", type=int)
    for name in ("study", "weights"):
        commands[name].add_argument("--seeds", default="42")
    commands["study"].add_argument("--key", action="append")
    o = parser.parse_args(arguments)
    spark = local_session("treillis")
    seeds = [int(s) for s in getattr(o, "seeds", "42").split(",")]
    if o.what == "check":
        if o.raw.rstrip("/") == o.clean.rstrip("/"):
            print("the clean folder must not be the raw one", file=sys.stderr)
            return 1
        raw = corpus.read_raw(spark, o.raw)
        clean = corpus.clean(raw)
        corpus.write_clean(clean, o.clean)
        quality.corpus_counts(clean).orderBy("fichier").show(200, False)
        raw.filter("anomalie is not null").show(200, False)
    elif o.what == "collect":
        if not o.cache:
            print("--cache is needed", file=sys.stderr)
            return 1
        print(collect(spark, o.data, o.out, {"cache": o.cache, "base": o.base, "offline": str(not o.base).lower(), "log": f"{o.out}_appels"}, o.limit), "records")
    elif o.what == "learn":
        learn(spark, o.data, o.model)
    elif o.what == "replay":
        quality.coverage(corpus.term_contexts(table(spark, o.data, CORPUS)), last_records(table(spark, o.data, RECORDS))).orderBy("niveau", "role", "relation").show(200, False)
        learn(spark, o.data, o.model)
        clustering.measures(store.load(spark, f"{o.model}/nodes")).show(200, False)
        if not o.no_test:
            test(spark, o.data, o.model).show()
            study(spark, o.data, f"{o.model}/etude", [RETAINED], seeds).show(200, False)
    elif o.what == "study":
        configs = [Config.of(k) for k in o.key or [RETAINED.key, RETAINED.but(weighting="binaire").key]]
        evaluate.indistinguishable(evaluate.aggregate(study(spark, o.data, o.out, configs, seeds))).show(200, False)
    elif o.what == "search":
        rows, records = similarity.examples(table(spark, o.data, CORPUS)).filter("split = 'train'"), last_records(table(spark, o.data, RECORDS))
        found = crossval.search(rows, records, seeds, measure=crossval.centroid_measures)
        store.save(spark.createDataFrame([(s, c.key, f) for s, c, f in found], "etape string, cle string, f1 double"), o.out)
        store.load(spark, o.out).show(20, False)
    elif o.what == "weights":
        weights(spark, o.data, o.out, seeds).show(20, False)
    elif o.file:
        store_at = f"{o.file}.predictions.csv"
        scoring.score_file(spark, o.file, Model.load(spark, o.model)).select(*scoring.SCORED).write.mode("overwrite").option("header", True).csv(store_at)
        print(store_at)
    else:
        for phrases in [o.phrases] if o.phrases else iter(lambda: [input("> ").strip()], [""]):
            predict(spark, o.model, phrases, o.top, o.detail, o.cache)
    return 0


if __name__ == "__main__":
    sys.exit(main())
