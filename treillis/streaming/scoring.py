"""Phrases scored by descent in a stored model's trees, in batches and streams, and records collected as files arrive."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treillis.functions.text import resolve, split_candidates
from treillis.model import RECORD_SCHEMA
from treillis.operators import classify, similarity
from treillis.operators.signatures import signature_chain
from treillis.sources.collection import last_of_each
from treillis.sources.store import Model

#: Columns of a scored phrase, in their published order.
SCORED = ["syntagme", "A", "B", "predit", "score", "second", "ecart_relatif", "serre", "arret", "poids_noeud", "profondeur", "exemple_noeud"]


def chosen_splits(phrases: DataFrame, known: DataFrame) -> DataFrame:
    """(ex, syntagme, A, B) of phrases (ex, syntagme): of several splits the one whose terms are both ``known`` (terme), else the first.

    A phrase that can't be split has nulls."""
    split = resolve(phrases.select("ex", split_candidates(F.col("syntagme")).alias("candidats")), known, "ex").select("ex", "A", "B")
    return phrases.select("ex", "syntagme").join(split, "ex", "left")


def answers_of(split: DataFrame, model: Model, more: dict[str, DataFrame] | None = None, paths: bool = False) -> DataFrame:
    """What every tree of the model answers to split phrases; ``more`` has signatures of other sources, asked in order after the model's own."""
    rows = split.filter("A is not null").select(F.lit(None).cast("string").alias("lot"), "ex", F.lit(None).cast("string").alias("rt"), F.lit(0).alias("ordre"), F.lit(None).cast("string").alias("split"), "A", "B")
    found = signature_chain(similarity.terms_of(rows), {"modele": model.signatures, **(more or {})})
    return classify.tree_answers(similarity.sides(rows, found.filter("symbole is not null")), model.leaves, model.nodes, paths=paths)


def score_phrases(phrases: DataFrame, model: Model, more: dict[str, DataFrame] | None = None) -> DataFrame:
    """``ex`` and SCORED of phrases (ex, syntagme).

    AUCUNE, a score of 0 and nulls where no tree shares a symbol; nulls but for the phrase where it can't be split."""
    known = model.signatures.select("terme").distinct()
    for other in (more or {}).values():
        known = known.union(other.select("terme").distinct())
    split = chosen_splits(phrases, known)
    best = classify.winners(answers_of(split, model, more))
    first = model.nodes.select(F.col("rt").alias("predit"), "noeud", "ordre")
    leaf = model.nodes.filter("enfants is null").select(F.col("rt").alias("predit"), F.col("noeud").alias("ordre"), F.col("ex").alias("_e"))
    example = model.examples.select(F.col("ex").alias("_e"), F.col("syntagme").alias("exemple_noeud"))
    placed = best.join(first, ["predit", "noeud"]).join(leaf, ["predit", "ordre"]).join(example, "_e", "left")
    stop = F.when(F.col("feuille"), "feuille").otherwise("interne")
    told = placed.select("ex", "predit", "score", "second", F.col("ecart").alias("ecart_relatif"), "serre", stop.alias("arret"), F.col("poids").alias("poids_noeud"), "profondeur", "exemple_noeud")
    out = split.join(told, "ex", "left")
    none = F.col("score") == 0
    return out.select("ex", "syntagme", "A", "B", F.when(none, "AUCUNE").otherwise(F.col("predit")).alias("predit"), "score", *[F.when(~none, F.col(c)).alias(c) for c in SCORED[5:]])


def _phrases(lines: DataFrame) -> DataFrame:
    return lines.filter(F.trim("value") != "").select(F.monotonically_increasing_id().alias("ex"), F.trim("value").alias("syntagme"))


def score_file(spark: SparkSession, path: str, model: Model) -> DataFrame:
    """Scores of a text file with one phrase a line."""
    return score_phrases(_phrases(spark.read.text(path)), model)


def stream_scores(spark: SparkSession, folder: str, model: Model, out: str, checkpoint: str):
    """Scores the text files of a folder as they arrive; each batch is written once under its number."""
    lines = spark.readStream.schema("value string").text(folder)

    def write(batch: DataFrame, number: int) -> None:
        score_phrases(_phrases(batch.persist()), model).write.mode("overwrite").parquet(f"{out}/lot={number}")
        batch.unpersist()

    return lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_records(spark: SparkSession, folder: str, out: str, checkpoint: str):
    """Collected records of a folder's JSON lines as they arrive, each batch under its number, with their order; no state is kept.

    latest_records() has the last one of each term."""
    records = spark.readStream.schema(RECORD_SCHEMA).json(folder)

    def write(batch: DataFrame, number: int) -> None:
        batch.filter("terme is not null").withColumn("_ordre", F.monotonically_increasing_id()).write.mode("overwrite").parquet(f"{out}/lot={number}")

    return records.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_records(spark: SparkSession, out: str) -> DataFrame:
    """The last record of each term that stream_records() wrote."""
    rows = spark.read.parquet(out).withColumn("_ordre", F.struct("lot", "_ordre")).drop("lot")
    return last_of_each(rows)
