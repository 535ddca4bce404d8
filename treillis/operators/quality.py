"""Quality reports over corpus, collection and signatures, and the benches of archived studies."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from treillis.functions.text import comparison_form
from treillis.operators import pairs


def corpus_counts(corpus: DataFrame) -> DataFrame:
    """Rows, training, test and ambiguous rows by file, and in all (fichier null)."""
    amb = F.coalesce(F.col("ambigu"), F.lit("non")) == "oui"
    return corpus.rollup("fichier").agg(
        F.count("*").alias("n"), F.count_if(F.col("split") == "train").alias("n_train"), F.count_if(F.col("split") == "test").alias("n_test"), F.count_if(amb).alias("n_ambigus"),
        F.count_if((F.coalesce("A", F.lit("")) != "") & (F.coalesce("B", F.lit("")) != "")).alias("n_decoupes"),
    )


def diversity(corpus: DataFrame) -> DataFrame:
    """Distinct terms of each side and how many stand at least twice and three times."""
    each = corpus.select(F.explode(F.array(*[F.struct(F.lit(r).alias("role"), F.col(r).alias("terme")) for r in "AB"])).alias("x")).filter("x.terme <> ''").groupBy("x.role", "x.terme").agg(F.count("*").alias("c"))
    return each.groupBy("role").agg(F.count("*").alias("n_distincts"), F.count_if(F.col("c") >= 2).alias("n_2"), F.count_if(F.col("c") >= 3).alias("n_3"))


def definiteness(corpus: DataFrame) -> DataFrame:
    """Crosstab of determiner and definiteness with totals (nulls)."""
    return corpus.filter("det <> '' and definitude <> ''").cube("det", "definitude").agg(F.count("*").alias("n"))


def duplicates_within(corpus: DataFrame) -> DataFrame:
    """Phrases that stand more than once in a file, with first and last line."""
    return corpus.filter("syntagme is not null").groupBy("fichier", comparison_form(F.col("syntagme")).alias("forme")).agg(F.count("*").alias("n"), F.min("ligne").alias("premiere"), F.max("ligne").alias("derniere")).filter("n > 1")


def duplicates_across(corpus: DataFrame) -> DataFrame:
    """Phrases of more than one file."""
    return corpus.filter("syntagme is not null").groupBy(comparison_form(F.col("syntagme")).alias("forme")).agg(F.count_distinct("fichier").alias("n_fichiers"), F.count("*").alias("n"), F.count_distinct("relation").alias("n_relations")).filter("n_fichiers > 1")


def duplicate_pairs(corpus: DataFrame) -> DataFrame:
    """Pairs (A, B) that stand more than once, and of what kind they are."""
    pairs = corpus.filter("A <> '' and B <> ''").groupBy(comparison_form(F.col("A")).alias("a"), comparison_form(F.col("B")).alias("b"))
    kind = F.when(F.col("n_relations") > 1, "relations différentes").when(F.col("n_formes") > 1, "formes différentes").otherwise("même syntagme")
    return pairs.agg(F.count("*").alias("n"), F.count_distinct("relation").alias("n_relations"), F.count_distinct(comparison_form(F.col("syntagme"))).alias("n_formes")).filter("n > 1").withColumn("nature", kind)


def coverage(contexts: DataFrame, records: DataFrame) -> DataFrame:
    """Terms of the corpus by role and relation, and how many the collection knows; totals have nulls."""
    known = records.select("terme", F.coalesce("existe", F.lit(False)).alias("existe"))
    each = contexts.select("terme", "role", "relation").distinct().join(known, "terme", "left")
    return each.cube("role", "relation").agg(F.count_distinct("terme").alias("n_termes"), F.count_distinct(F.when(F.col("existe"), F.col("terme"))).alias("n_trouves"), F.grouping_id().alias("niveau"))


def reconcile(records: DataFrame, expected: DataFrame) -> DataFrame:
    """Terms by where they stand: corpus and collection, corpus only, collection only; and those the network lacks."""
    both = records.select("terme", F.coalesce("existe", F.lit(False)).alias("existe")).join(expected.withColumn("_a", F.lit(True)), "terme", "full")
    place = F.when(F.col("existe").isNull(), "absent de la collecte").when(F.col("_a").isNull(), "hors corpus").when(~F.col("existe"), "absent du réseau").otherwise("retenu")
    return both.groupBy(place.alias("etat")).agg(F.count("*").alias("n"))


def trait_sizes(records: DataFrame) -> DataFrame:
    """Least, quartiles, greatest and number of empty ones of each array of the records."""
    arrays = F.array(*[F.struct(F.lit(c).alias("trait"), F.coalesce(F.size(c), F.lit(0)).alias("n")) for c in ("H", "TRT", "SST", "raffinements")])
    each = records.select(F.explode(F.transform(arrays, lambda x: F.struct(x["trait"].alias("trait"), F.greatest(x["n"], F.lit(0)).alias("n")))).alias("x")).select("x.*")
    q = lambda p: F.percentile("n", F.lit(p))
    return each.groupBy("trait").agg(F.count("*").alias("n_termes"), F.count_if(F.col("n") == 0).alias("n_vides"), F.min("n").alias("mini"), q(0.25).alias("q1"), q(0.5).alias("mediane"), q(0.75).alias("q3"), F.max("n").alias("maxi"), F.sum("n").alias("total"))


def noise(records: DataFrame) -> DataFrame:
    """Entries of H with a language prefix, with weight not positive, and spellings merged away."""
    each = records.select("terme", F.explode("H").alias("e")).filter("e is not null")
    forms = each.groupBy("terme").agg(F.count("*").alias("n"), F.count_if("e.lang_prefix").alias("prefixes"), F.count_if(~(F.coalesce("e.poids", F.lit(0.0)) > 0)).alias("nuls"), F.count_distinct(F.coalesce("e.forme_normalisee", F.lower("e.nom"))).alias("formes"))
    return forms.agg(F.count("*").alias("n_termes"), F.sum("n").alias("n_entrees"), F.sum("prefixes").alias("n_prefixes"), F.sum("nuls").alias("n_nuls"), F.sum(F.col("n") - F.col("formes")).alias("n_doublons"))


def polysemy(records: DataFrame) -> DataFrame:
    """Terms by number of refinements."""
    return records.groupBy(F.greatest(F.coalesce(F.size("raffinements"), F.lit(0)), F.lit(0)).alias("n_raffinements")).agg(F.count("*").alias("n_termes"))


def signature_sizes(symbols: DataFrame) -> DataFrame:
    """Sizes of signatures by trait and in all (trait null)."""
    each = symbols.groupBy("terme", "trait").agg(F.count("*").alias("n")).cube("terme", "trait").agg(F.sum("n").alias("n"), F.grouping("terme").alias("_t")).filter("_t = 0")
    q = lambda p: F.percentile("n", F.lit(p))
    return each.groupBy("trait").agg(F.count("*").alias("n_termes"), F.min("n").alias("mini"), q(0.5).alias("mediane"), F.max("n").alias("maxi"), F.sum("n").alias("total"))


def poor_signatures(symbols: DataFrame, least: int = 3) -> DataFrame:
    return symbols.groupBy("terme").agg(F.count("*").alias("n")).filter(F.col("n") < least)


def top_symbols(symbols: DataFrame, n: int = 30) -> DataFrame:
    """The symbols most terms hold, with their rank; the symbol breaks ties."""
    top = symbols.groupBy("trait", "symbole").agg(F.count("*").alias("df")).orderBy(F.desc("df"), "symbole").limit(n)
    return top.withColumn("rang", F.row_number().over(Window.orderBy(F.desc("df"), "symbole")))


def best_by_trait(symbols: DataFrame) -> DataFrame:
    """The symbol most terms hold, by trait."""
    df = symbols.groupBy("trait", "symbole").agg(F.count("*").alias("df"))
    return df.groupBy("trait").agg(F.min_by(F.struct("symbole", "df"), F.struct(-F.col("df"), F.col("symbole"))).alias("x")).select("trait", "x.*")


def own_symbol_carriers(symbols: DataFrame) -> DataFrame:
    """How many other terms hold a term's H symbol, and which one with most weight."""
    own = symbols.select("terme").distinct().select(F.col("terme").alias("porte"), F.concat(F.lit("H:"), "terme").alias("symbole"))
    held = symbols.join(own, "symbole").filter("terme <> porte")
    return held.groupBy("porte").agg(F.count("*").alias("n_porteurs"), F.min_by("terme", F.struct(-F.col("poids"), F.col("terme"))).alias("premier"))


def same_signatures(a: DataFrame, b: DataFrame) -> DataFrame:
    """Terms of both tables and how many have the same symbols in each."""
    of = lambda t, n: t.groupBy("terme").agg(F.array_sort(F.collect_set("symbole")).alias(n))
    return of(a, "x").join(of(b, "y"), "terme").agg(F.count("*").alias("n"), F.count_if(F.col("x") == F.col("y")).alias("egales"))


def merge_criterion_sweep(side_rows: DataFrame, thresholds: list[float]) -> DataFrame:
    """Pairs of all examples that share a symbol, and those over each threshold on both sides and in the mean, by ``meme`` (same relation or not)."""
    return pairs.threshold_counts(side_rows, thresholds)


def noise_signal(side_rows: DataFrame) -> DataFrame:
    """Median, upper decile and share over one half of the scores of all pairs that share a symbol, of one relation and of different ones."""
    return pairs.score_percentiles(side_rows, {"mediane": 0.5, "c90": 0.9})
