"""Corpus files: the raw line format with physical line numbers, and the clean CSV."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treillis.functions.text import comparison_form, settle, split_candidates, strip
from treillis.model import CLEAN_COLUMNS, CLEAN_SCHEMA
from treillis.sources.collection import first_existing_variant

#: The first lines of a file are for training.
TRAIN_LINES = 50


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """Every physical line: (fichier, ligne, syntagme, relation, anomalie, texte); bad lines have the reason and no fields.

    A line is ``phrase ; relation``. The byte order mark of a file's first line and a carriage return at a line's
    end are dropped; empty lines at the end of a file are no lines."""
    files = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("fichier"), "content")
    lines = files.select("fichier", F.posexplode(F.split(F.decode("content", "ISO-8859-1"), "\n")).alias("pos", "_l"))
    # One byte a character until here, so that each line can be checked by itself.
    line = lines.select("fichier", (F.col("pos") + 1).alias("ligne"), F.encode(F.regexp_replace("_l", r"\r\z", ""), "ISO-8859-1").alias("_b"))
    text = line.withColumn("texte", F.try_validate_utf8(F.col("_b").cast("string"))).withColumn("texte", F.when(F.col("ligne") == 1, F.regexp_replace("texte", "^﻿", "")).otherwise(F.col("texte")))
    last = text.groupBy("fichier").agg(F.max(F.when(F.length("_b") > 0, F.col("ligne"))).alias("_fin"))
    fields = F.transform(F.split("texte", ";", -1), strip)
    good = (F.size(fields) == 2) & (fields[0] != "") & (fields[1] != "")
    why = F.when(F.col("texte").isNull(), "utf-8").when(strip(F.col("texte")) == "", "vide").when(F.size(fields) != 2, "champs").when(~good, "champ vide")
    out = text.join(last, "fichier").filter("ligne <= _fin").withColumn("anomalie", why)
    return out.select("fichier", "ligne", F.when(F.col("anomalie").isNull(), fields[0]).alias("syntagme"), F.when(F.col("anomalie").isNull(), fields[1]).alias("relation"), "anomalie", "texte")


def clean(raw: DataFrame) -> DataFrame:
    """Splits and resolves the good lines: the clean columns with fichier and ligne."""
    rows = raw.filter("anomalie is null").withColumn("candidats", split_candidates(F.col("syntagme")))
    rows = settle(rows)
    one = F.when(F.size("candidats") == 1, F.element_at("candidats", 1))
    many = F.size("candidats") > 1
    listed = F.array_join(F.transform("candidats", lambda c: F.concat(c["A"], F.lit(" / "), c["B"])), " | ")
    return rows.select(
        "fichier", "ligne", "syntagme", *[F.coalesce(one[c], F.lit("")).alias(c) for c in ("A", "B")], "relation", F.when(F.col("ligne") <= TRAIN_LINES, "train").otherwise("test").alias("split"),
        *[F.coalesce(one[c], F.lit("")).alias(c) for c in ("det", "definitude")], F.when(many, "oui").otherwise("non").alias("ambigu"), F.when(many, listed).otherwise("").alias("candidats"), "arbitre",
    )


def write_clean(rows: DataFrame, path: str) -> None:
    """The clean CSV, a folder a file, with a header and empty texts for what is missing."""
    ordered = rows.select("fichier", "ligne", *CLEAN_COLUMNS).repartition("fichier").sortWithinPartitions("fichier", "ligne").drop("ligne")
    ordered.write.mode("overwrite").partitionBy("fichier").option("header", True).option("emptyValue", "").csv(path)


def read_clean(spark: SparkSession, path: str) -> DataFrame:
    """The clean CSV with its declared schema; empty fields are empty texts, not nulls."""
    rows = spark.read.schema(CLEAN_SCHEMA).option("header", True).option("enforceSchema", True).csv(path)
    return rows.select(*[F.coalesce(c, F.lit("")).alias(c) for c in CLEAN_COLUMNS], *[c for c in rows.columns if c not in CLEAN_COLUMNS])


def term_dictionary(rows: DataFrame) -> DataFrame:
    """Terms by role with their relations, firm occurrences and those as candidates of ambiguous rows, sorted."""
    firm = rows.filter("coalesce(A, '') <> '' and coalesce(B, '') <> ''").select("relation", F.explode(F.array(F.struct(F.lit("A").alias("role"), F.col("A").alias("terme")), F.struct(F.lit("B").alias("role"), F.col("B").alias("terme")))).alias("x"), F.lit(0).alias("_c"))
    maybe = rows.filter("candidats <> ''").select("relation", F.explode(F.split("candidats", r" \| ")).alias("_p")).withColumn("_s", F.split("_p", " / "))
    maybe = maybe.filter(F.size("_s") == 2).select("relation", F.explode(F.array(*[F.struct(F.lit(r).alias("role"), F.col("_s")[i].alias("terme")) for i, r in enumerate("AB")])).alias("x"), F.lit(1).alias("_c"))
    out = firm.union(maybe).groupBy("x.terme", "x.role").agg(
        F.array_join(F.array_sort(F.collect_set("relation")), "|").alias("relations_associees"), F.count_if(F.col("_c") == 0).alias("nb_occurrences"), F.count_if(F.col("_c") == 1).alias("nb_candidats_ambigus")
    )
    return out


def sorted_terms(terms: DataFrame) -> DataFrame:
    """The dictionary in its published order."""
    return terms.orderBy(comparison_form(F.col("terme")), "terme", "role")


def term_contexts(rows: DataFrame) -> DataFrame:
    """Inverted index of terms: where each stands, as a firm term or as a candidate."""
    keep = ["ligne_id", "fichier", "relation", "syntagme"]
    firm = rows.filter("coalesce(A, '') <> '' and coalesce(B, '') <> ''").select(*keep, F.lit("ferme").alias("origine"), F.explode(F.array(*[F.struct(F.lit(r).alias("role"), F.col(r).alias("terme")) for r in "AB"])).alias("x"))
    maybe = rows.filter("candidats <> ''").select(*keep, F.lit("candidat").alias("origine"), F.explode(F.split("candidats", r" \| ")).alias("_p")).withColumn("_s", F.split("_p", " / ")).filter(F.size("_s") == 2)
    maybe = maybe.select(*keep, "origine", F.explode(F.array(*[F.struct(F.lit(r).alias("role"), F.col("_s")[i].alias("terme")) for i, r in enumerate("AB")])).alias("x"))
    return firm.union(maybe).select("x.terme", "x.role", "origine", *keep).distinct()


def replacement_proposals(absent: DataFrame, contexts: DataFrame, known: DataFrame) -> DataFrame:
    """Absent terms with each of their contexts and the first existing spelling variant; terms that only stand as candidates get none."""
    firm = contexts.groupBy("terme").agg(F.every(F.col("origine") == "candidat").alias("_seul"))
    best = first_existing_variant(absent, known).withColumnRenamed("variante", "candidat")
    rows = absent.join(contexts, "terme").join(firm, "terme").join(best, "terme", "left")
    reason = F.when(F.col("_seul"), "candidat de découpage seulement").when(F.col("candidat").isNull(), "aucune variante existante").otherwise("variante existante")
    return rows.select("terme", "role", "origine", "ligne_id", "relation", "syntagme", reason.alias("raison"), F.when(~F.col("_seul"), F.col("candidat")).alias("candidat"))
