"""Signatures: sparse weighted symbol vectors of terms, in long form (terme, trait, symbole, poids).

Defined cases: null and empty arrays give no symbols; entries with null, zero or negative weight are left out;
a term collected again counts with its last record; a term without a record has only its own symbol."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treillis.model import EXCLUDED_TYPES, FREQUENT_SHARE, IDF_FAMILY, PERCENTILE, WEIGHTED_TRAITS, Config
from treillis.session import cut


def last_records(records: DataFrame, order: str = "enr_id", fields: tuple[str, ...] = ("existe", "H", "TRT", "SST", "raffinements", "diagnostic_singulier")) -> DataFrame:
    """One record a term, the last one."""
    kept = F.struct(*[F.col(f) for f in fields])
    return records.filter("terme is not null").groupBy("terme").agg(F.max_by(kept, order).alias("r")).select("terme", "r.*")


def hypernyms(records: DataFrame, without_prefix: bool = False) -> DataFrame:
    """Entries of H with positive weight, one for each form (heaviest, first of equals): ``rang_h`` by weight, then name."""
    each = records.select("terme", F.posexplode("H").alias("pos", "e")).select("terme", "pos", "e.nom", "e.poids", F.coalesce("e.lang_prefix", F.lit(False)).alias("prefixe"), F.coalesce("e.forme_normalisee", F.lower("e.nom")).alias("forme"))
    each = each.filter("poids > 0 and nom is not null")
    if without_prefix:
        each = each.filter("not prefixe")
    best = Window.partitionBy("terme", "forme").orderBy(F.desc("poids"), "pos")
    merged = each.withColumn("_n", F.row_number().over(best)).filter("_n = 1")
    rank = Window.partitionBy("terme").orderBy(F.desc("poids"), "nom", "pos")  # the entries of one record
    return merged.select("terme", "nom", "forme", "poids", F.row_number().over(rank).alias("rang_h"))


def relation_counts(records: DataFrame) -> DataFrame:
    """Entries of TRT with a positive count and a telling type; of a type listed twice the last."""
    each = records.select("terme", F.posexplode("TRT").alias("pos", "e")).filter(F.col("e.type").isNotNull() & (F.col("e.n") > 0) & ~F.col("e.type").isin(*EXCLUDED_TYPES))
    return each.groupBy("terme", F.col("e.type").alias("type")).agg(F.max_by("e.n", "pos").alias("n"))


def tags(records: DataFrame) -> DataFrame:
    """Tags of SST with positive weight: the greatest weight and the last ``morpho`` of each."""
    each = records.select("terme", F.posexplode("SST").alias("pos", "e")).filter("e.poids > 0 and e.tag is not null")
    return each.groupBy("terme", F.col("e.tag").alias("tag")).agg(F.max("e.poids").alias("poids"), F.max_by(F.coalesce("e.morpho", F.lit(False)), "pos").alias("morpho"))


def type_thresholds(counts: DataFrame, n_terms: int, share: float = PERCENTILE) -> DataFrame:
    """The percentile of each type's counts over all terms, absent ones as 0 (as a frequency, not by filling up)."""
    present = counts.groupBy("type", "n").agg(F.count("*").alias("f"))
    absent = counts.groupBy("type").agg((F.lit(n_terms) - F.count("*")).alias("f")).filter("f > 0").select("type", F.lit(0).cast("long").alias("n"), "f")
    return present.unionByName(absent).groupBy("type").agg(F.percentile("n", F.lit(share), F.col("f")).alias("seuil"))


def frequent_types(counts: DataFrame, n_terms: int, share: float = FREQUENT_SHARE) -> DataFrame:
    """Types that more than a share of all terms has."""
    return counts.groupBy("type").agg(F.count("*").alias("n_termes")).filter(F.col("n_termes") > share * n_terms)


def kept_types(counts: DataFrame, mode: str, training: DataFrame | None = None) -> DataFrame:
    """The counts kept by a mode; its statistics come from the training terms (``terme``) only."""
    if mode == "tous":
        return counts
    if mode == "aucun":
        return counts.limit(0)
    if training is None:
        known, n = counts, counts.select("terme").distinct().count()
    else:
        known, n = counts.join(training, "terme", "left_semi"), training.count()
    if mode == "sans_frequents":
        return counts.join(frequent_types(known, n).select("type"), "type", "left_anti")
    return counts.join(type_thresholds(known, n), "type", "left").filter(F.col("n") > F.coalesce("seuil", F.lit(0.0))).drop("seuil")


def _over_most(value: Column) -> Column:
    return value / F.max(value).over(Window.partitionBy("terme"))


def fixed_symbols(records: DataFrame, config: Config) -> DataFrame:
    """The symbols that don't depend on the training terms: those of H and SST and the own ones; ``_p`` is over 0 for own symbols."""
    h = hypernyms(records)
    if config.h is not None:
        h = h.filter(F.col("rang_h") <= config.h)
    parts = [h.select("terme", F.lit("H").alias("trait"), F.concat(F.lit("H:"), "nom").alias("symbole"), _over_most(F.col("poids")).alias("poids"), F.lit(0).alias("_p"))]
    if config.sst != "aucune":
        sst = tags(records)
        if config.sst == "sans_morpho":
            sst = sst.filter("not morpho")
        parts.append(sst.select("terme", F.lit("SST").alias("trait"), F.concat(F.lit("SST:"), "tag").alias("symbole"), _over_most(F.col("poids")).alias("poids"), F.lit(0).alias("_p")))
    if config.term != "T2":
        own = F.col("terme") if config.term == "T0" else F.concat(F.lit("H:"), "terme")
        parts.append(records.select("terme", F.lit("terme" if config.term == "T0" else "H").alias("trait"), own.alias("symbole"), F.lit(1.0).alias("poids"), F.lit(1).alias("_p")))
    return reduce(DataFrame.unionByName, parts)


def collected_symbols(records: DataFrame, config: Config, training: DataFrame | None = None, given: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Symbols of the terms with their collection weights, the term's own symbol last.

    Of a symbol the own term and an entry of H share, the own term's weight 1 holds; of a symbol two entries give, the
    lesser weight. ``given`` has fixed_symbols() and relation_counts() of the records, where they are at hand."""
    fixed, counts = given or (fixed_symbols(records, config), relation_counts(records))
    trt = kept_types(counts, config.trt, training).withColumn("_l", F.log(1 + F.col("n")))
    rows = fixed.unionByName(trt.select("terme", F.lit("TRT").alias("trait"), F.concat(F.lit("TRT:"), "type").alias("symbole"), _over_most(F.col("_l")).alias("poids"), F.lit(0).alias("_p")))
    return rows.groupBy("terme", "symbole").agg(F.max_by(F.struct("trait", "poids"), F.struct(F.col("_p"), -F.col("poids"))).alias("x")).select("terme", "x.trait", "symbole", "x.poids")


def signatures(records: DataFrame, config: Config, training: DataFrame | None = None, given: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Signatures under a configuration: (terme, trait, symbole, poids).

    Document frequencies come from the training terms (all terms if none are given); weights of 0 are left out."""
    raw = collected_symbols(records, config, training, given)
    weighted = F.when(F.col("trait").isin(*WEIGHTED_TRAITS[config.weighting]), F.col("poids")).otherwise(1.0)
    if config.weighting not in IDF_FAMILY and config.df_min <= 1:
        return raw.withColumn("poids", weighted).filter("poids > 0")
    known = raw if training is None else raw.join(training, "terme", "left_semi")
    n = (records if training is None else training).count()
    df = document_frequency(known)
    joined = raw.join(df.select("symbole", "df"), "symbole", "left")
    if config.df_min > 1:
        joined = joined.filter(F.coalesce("df", F.lit(0)) >= config.df_min)
    factor = F.log(F.lit(float(n)) / F.coalesce("df", F.lit(1))) if config.weighting in IDF_FAMILY else F.lit(1.0)
    return joined.select("terme", "trait", "symbole", (weighted * factor).alias("poids")).filter("poids > 0")


def signature_chain(terms: DataFrame, sources: dict[str, DataFrame]) -> DataFrame:
    """(terme, symbole, poids, provenance): each term's signature from the first source that has the term.

    A term that no source has is one row without symbol, of provenance ``vide``."""
    parts = [s.select("terme").distinct().select("terme", F.lit(k).alias("_k"), F.lit(name).alias("provenance")) for k, (name, s) in enumerate(sources.items())]
    first = terms.join(reduce(DataFrame.unionByName, parts), "terme", "left").groupBy("terme").agg(F.min_by("provenance", "_k").alias("provenance"))
    rows = [s.select("terme", "symbole", "poids", F.lit(name).alias("provenance")) for name, s in sources.items()]
    return first.fillna("vide", ["provenance"]).join(reduce(DataFrame.unionByName, rows), ["terme", "provenance"], "left").select("terme", "symbole", "poids", "provenance")


def document_frequency(symbols: DataFrame) -> DataFrame:
    """How many terms hold each symbol."""
    return symbols.groupBy("trait", "symbole").agg(F.count("*").alias("df"))


def vocabulary(symbols: DataFrame) -> DataFrame:
    """Distinct symbols with dense numbers in order, numbered in parallel (ranges, then places within them)."""
    distinct = symbols.select("symbole").distinct()
    ranged = cut(distinct.repartitionByRange("symbole").withColumn("_part", F.spark_partition_id()))  # written once, as both readings need the same ranges
    ranged = ranged.withColumn("_n", F.row_number().over(Window.partitionBy("_part").orderBy("symbole")))
    sizes = ranged.groupBy(F.col("_part").alias("_q")).agg(F.count("*").alias("_c"))
    before = sizes.withColumn("_b", F.coalesce(F.sum("_c").over(Window.orderBy("_q").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # one row a partition
    return ranged.join(F.broadcast(before), F.col("_part") == F.col("_q")).select("symbole", (F.col("_b") + F.col("_n") - 1).cast("long").alias("dim"))


def as_maps(symbols: DataFrame) -> DataFrame:
    """Signatures as maps, for storing or handing on."""
    return symbols.groupBy("terme").agg(F.map_from_entries(F.collect_list(F.struct("symbole", "poids"))).alias("signature"))


def weights_decay(records: DataFrame, deepest: int = 50) -> DataFrame:
    """Mean weight of the H entries by rank, relative to the first of their term."""
    h = hypernyms(records).filter(F.col("rang_h") <= deepest)
    share = h.withColumn("part", F.col("poids") / F.max("poids").over(Window.partitionBy("terme")))
    return share.groupBy("rang_h").agg(F.count("*").alias("n"), F.avg("part").alias("part_moyenne"))


def trt_policy(counts: DataFrame, policy: str, value: float, n_terms: int) -> DataFrame:
    """Archived selections of relation types: ``top`` by count, ``part`` of the dominant type, ``centile``, ``frequents`` dropped,
    or ``top_idf`` by (1 + log10 n) * log(N / df)."""
    if policy == "top":
        w = Window.partitionBy("terme").orderBy(F.desc("n"), "type")
        return counts.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= int(value)).drop("_r")
    if policy == "part":
        return counts.withColumn("_m", F.max("n").over(Window.partitionBy("terme"))).filter(F.col("n") >= value * F.col("_m")).drop("_m")
    if policy == "frequents":
        return counts.join(frequent_types(counts, n_terms, value).select("type"), "type", "left_anti")
    if policy == "centile":
        return counts.join(type_thresholds(counts, n_terms, value), "type").filter("n > seuil").drop("seuil")
    df = counts.groupBy("type").agg(F.count("*").alias("_df"))
    score = (1 + F.log10("n")) * F.log(F.lit(float(n_terms)) / F.col("_df"))
    w = Window.partitionBy("terme").orderBy(F.desc("_s"), "type")
    return counts.join(df, "type").withColumn("_s", score).withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= int(value)).select("type", "terme", "n")
