"""The collection: records as JSON lines, incremental collection, records from edges, session log."""
from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from treillis.functions.text import language_prefix, merge_key, singular, spelling_variants
from treillis.model import MORPHOLOGICAL_TAGS, RECORD_SCHEMA
from treillis.session import cut
from treillis.sources.network import LexicalNetwork

#: Prefix of the names of targets that are tags.
TAG_PREFIX = "_INFO-SEM-"


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of JSON lines with their line order; unreadable lines have ``terme`` null (see skipped_lines)."""
    lines = spark.read.text(path).withColumn("_ordre", F.monotonically_increasing_id())
    return lines.filter(F.trim("value") != "").select("_ordre", "value", F.from_json("value", RECORD_SCHEMA, {"mode": "PERMISSIVE"}).alias("r")).select("_ordre", "value", "r.*")


def skipped_lines(records: DataFrame) -> DataFrame:
    return records.filter("terme is null").select("_ordre", "value")


def last_of_each(records: DataFrame, order: str = "_ordre") -> DataFrame:
    """The last record of each term."""
    cols = [c for c in records.columns if c not in (order, "value", "terme")]
    return records.filter("terme is not null").groupBy("terme").agg(F.max_by(F.struct(*cols), order).alias("r")).select("terme", "r.*")


def still_missing(terms: DataFrame, done: DataFrame) -> DataFrame:
    """Terms not collected yet."""
    return terms.join(done.select("terme").distinct(), "terme", "left_anti")


def repair(spark: SparkSession, path: str, out: str) -> None:
    """The lines of a collection that can be read, such as were not cut off in writing, to a new folder."""
    kept = read_records(spark, path).filter("terme is not null")
    kept.select("value").write.mode("overwrite").text(out)


def collect_increment(terms: DataFrame, done: DataFrame, fetch, path: str, limit: int | None = None, batch: int = 500) -> int:
    """Fetches the missing terms (``fetch``: terms to records) and appends them; may be run again after a failure.

    Terms go in batches of about ``batch``, and each is written before the next is asked for. Records with a text in a column
    ``erreur`` go to ``path`` + "_erreurs" instead; their terms are still missing and are tried again by the next run.
    Returns the number of records in ``path``."""
    todo = still_missing(terms, done)
    if limit is not None:
        todo = todo.orderBy("terme").limit(limit)
    todo = cut(todo.select("terme").distinct())
    parts = max(1, -(-todo.count() // batch))
    for part in range(parts):
        fetched = cut(fetch(todo.filter(F.pmod(F.xxhash64("terme"), F.lit(parts)) == part)))
        if "erreur" in fetched.columns:
            fetched.filter("erreur is not null").select("terme", "erreur", F.current_timestamp().alias("vu_utc")).write.mode("append").json(f"{path}_erreurs")
            fetched = fetched.filter("erreur is null").drop("erreur")
        fetched.write.mode("append").json(path)
    return terms.sparkSession.read.schema(RECORD_SCHEMA).json(path).count()


def network_records(spark: SparkSession, options: dict[str, str], kinds: dict[str, int]):
    """A ``fetch`` for collect_increment from the network source: ``kinds`` has the ids of all relation types by name,
    among them r_isa, r_infopot and r_raff_sem. Terms the network lacks are records with ``existe`` false."""
    spark.dataSource.register(LexicalNetwork)
    named = spark.createDataFrame([(k, n) for n, k in kinds.items()], "type_id bigint, type string")

    def fetch(todo: DataFrame) -> DataFrame:
        terms = [r[0] for r in todo.select("terme").collect()]  # one batch
        read = lambda asked, **how: spark.read.format("lexical_network").options(**options, detail="true", terms=json.dumps(asked, ensure_ascii=False), **how).load()
        nodes = cut(read(terms, what="nodes"))
        known = [r[0] for r in nodes.filter("erreur is null").select("terme").collect()]
        single = [r[0] for r in todo.select(singular(F.col("terme")).alias("s")).filter("s is not null").collect()]
        out = {name: cut(read(sorted({*known, *single}), direction="from", types=f"[{kinds[name]}]")) for name in ("r_isa", "r_infopot", "r_raff_sem")}
        into = cut(read(known, direction="to", narrow="true"))
        failed = nodes.union(into)
        for frame in out.values():
            failed = failed.union(frame)
        errors = failed.filter("erreur is not null").groupBy("terme").agg(F.min("erreur").alias("erreur"))
        targets = lambda name: out[name].filter((F.col("type") == kinds[name]) & (F.col("w") > 0)).select("terme", F.coalesce("nom", F.col("node2").cast("string")).alias("nom"), F.col("w").alias("poids"), "type_noeud")
        rank = F.row_number().over(Window.partitionBy("terme").orderBy(F.desc("poids"), "nom"))
        h = targets("r_isa").select("terme", rank.alias("rang"), "nom", "poids", "type_noeud", language_prefix(F.col("nom")).isNotNull().alias("lang_prefix"), merge_key(F.col("nom")).alias("forme_normalisee"))
        counts = into.filter("w > 0").groupBy("terme", F.col("type").alias("type_id")).agg(F.count("*").alias("n"))
        histogram = counts.join(named, "type_id", "left").select("terme", F.coalesce("type", F.col("type_id").cast("string")).alias("type"), "n")
        whole = assemble(todo, h, histogram, tags_of_targets(targets("r_infopot")), targets("r_raff_sem").select("terme", "nom", "poids"), nodes.filter("erreur is null"))
        return whole.join(errors, "terme", "left")

    return fetch


def hypernyms_of_edges(edges: DataFrame, nodes: DataFrame, kind: str) -> DataFrame:
    """Targets of a type with positive weight: (terme, rang, nom, poids, type_noeud, lang_prefix, forme_normalisee), heaviest first.

    Of repeated edges the heaviest counts; a target without a node keeps its own name."""
    best = edges.filter((F.col("type") == kind) & (F.col("w") > 0)).groupBy("src", "dst").agg(F.max("w").alias("poids"))
    named = best.join(nodes.select(F.col("nom").alias("dst"), F.col("type").alias("type_noeud")), "dst", "left")
    rank = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("poids"), "dst"))
    return named.select(F.col("src").alias("terme"), rank.alias("rang"), F.col("dst").alias("nom"), "poids", "type_noeud", language_prefix(F.col("dst")).isNotNull().alias("lang_prefix"), merge_key(F.col("dst")).alias("forme_normalisee"))


def tags_of_targets(targets: DataFrame) -> DataFrame:
    """Targets whose name has the tag prefix: (terme, tag, poids, morpho)."""
    tag = F.substring("nom", F.lit(len(TAG_PREFIX) + 1), F.length("nom"))
    return targets.filter(F.col("nom").startswith(TAG_PREFIX)).select("terme", tag.alias("tag"), "poids", tag.isin(*MORPHOLOGICAL_TAGS).alias("morpho"))


def incoming_histogram(edges: DataFrame, types: DataFrame) -> DataFrame:
    """Number of incoming edges with positive weight by term and type, with the type's id where it is known."""
    counts = edges.filter("w > 0").groupBy(F.col("dst").alias("terme"), "type").agg(F.count("*").alias("n"))
    return counts.join(types.select(F.col("nom").alias("type"), F.col("id").alias("type_id")), "type", "left")


def assemble(terms: DataFrame, hypernyms: DataFrame, histogram: DataFrame, tags: DataFrame, refinements: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Records of terms from their edges, with the diagnostic of the singular where H is empty.

    With ``nodes`` (terme, node1, type, w) also ``existe`` and ``noeud``; terms without a node have no traits."""
    entry = F.struct("nom", "poids", F.col("type_noeud").cast("bigint").alias("type_noeud"), "lang_prefix", "forme_normalisee")
    by_rank = F.array_sort(F.collect_list(F.struct("rang", entry.alias("e"))))
    h = hypernyms.groupBy("terme").agg(F.transform(by_rank, lambda x: x["e"]).alias("H"))
    trt = histogram.groupBy("terme").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "type", "n"))), lambda x: F.struct(x["type"].alias("type"), x["n"].alias("n"))).alias("TRT"))
    sst = tags.groupBy("terme").agg(F.array_sort(F.collect_list(F.struct("tag", "poids", "morpho"))).alias("SST"))
    raff = refinements.groupBy("terme").agg(F.array_sort(F.collect_list(F.struct("nom", "poids"))).alias("raffinements"))
    whole = terms.join(h, "terme", "left").join(trt, "terme", "left").join(sst, "terme", "left").join(raff, "terme", "left")
    tested = whole.withColumn("_s", F.when(F.col("H").isNull(), singular(F.col("terme"))))
    found = h.select(F.col("terme").alias("_s"), F.size("H").alias("H_taille"), F.col("H").alias("_h"))
    told = F.struct(F.col("_s").alias("forme_testee"), F.col("H_taille").isNotNull().alias("existe"), F.coalesce("H_taille", F.lit(0)).alias("H_taille"), F.col("_h").alias("H"))
    traits = ["H", "TRT", "SST", "raffinements"]
    out = tested.join(found, "_s", "left").select("terme", *traits, F.when(F.col("H").isNull(), told).alias("diagnostic_singulier"))
    if nodes is None:
        return out
    node = nodes.select("terme", F.struct(F.col("node1").alias("id"), F.col("type").cast("string").alias("type"), F.col("w").alias("poids")).alias("noeud"))
    there = F.col("noeud").isNotNull()
    return out.join(node, "terme", "left").select("terme", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("collecte_utc"), there.alias("existe"), "noeud", *[F.when(there, F.col(c)).alias(c) for c in [*traits, "diagnostic_singulier"]])


def first_existing_variant(terms: DataFrame, known: DataFrame) -> DataFrame:
    """(terme, variante): the first spelling variant of each term that ``known`` (terme) has; terms without one have no row."""
    tried = terms.select("terme", F.posexplode(spelling_variants(F.col("terme"))).alias("pos", "v")).join(known.select(F.col("terme").alias("v")).distinct(), "v", "left_semi")
    return tried.groupBy("terme").agg(F.min_by("v", "pos").alias("variante"))


def log_session(spark: SparkSession, row: dict, path: str) -> None:
    """Appends a session's figures; totals come from reading the table."""
    spark.createDataFrame([row]).write.mode("append").json(path)


def session_totals(sessions: DataFrame) -> DataFrame:
    return sessions.agg(F.count("*").alias("n"), F.sum("duree_s").alias("duree_s"), F.sum("collectes").alias("collectes"), F.sum("erreurs").alias("erreurs"))
