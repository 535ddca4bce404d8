"""Similarity of sparse vectors in long form, and the sides of examples.

An example has a left and a right term, whose signatures stay apart as sides L and R. Pairs are those of the whole
corpus; the lot (a corpus file) of an example only says where it stands in corpus order."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treillis.operators import pairs


def examples(corpus: DataFrame) -> DataFrame:
    """Usable rows of a corpus: (lot, ex, rt, ordre, split, A, B, det, definitude, syntagme); ``ordre`` breaks ties.

    Ambiguous rows, rows without a term or relation are left out."""
    kept = corpus.filter("A <> '' and B <> '' and relation is not null and coalesce(ambigu, 'non') <> 'oui'")
    return kept.select(F.col("fichier").alias("lot"), F.col("ligne_id").alias("ex"), F.col("relation").alias("rt"), F.col("ligne").alias("ordre"), "split", "A", "B", "det", "definitude", "syntagme")


def rejected(corpus: DataFrame) -> DataFrame:
    """The rows examples() leaves out, with the reason."""
    reason = F.when(F.coalesce("ambigu", F.lit("non")) == "oui", "ambigu").when((F.coalesce("A", F.lit("")) == "") | (F.coalesce("B", F.lit("")) == ""), "terme absent").when(F.col("relation").isNull(), "relation absente")
    return corpus.withColumn("motif", reason).filter("motif is not null")


def terms_of(rows: DataFrame) -> DataFrame:
    """Distinct left and right terms."""
    return rows.select(F.explode(F.array("A", "B")).alias("terme")).distinct()


def sides(rows: DataFrame, signatures: DataFrame) -> DataFrame:
    """(lot, ex, rt, ordre, split, cote, symbole, poids); a term without a signature has itself as its symbol."""
    each = rows.select("lot", "ex", "rt", "ordre", "split", F.explode(F.array(F.struct(F.lit("L").alias("cote"), F.col("A").alias("terme")), F.struct(F.lit("R").alias("cote"), F.col("B").alias("terme")))).alias("s"))
    joined = each.select("lot", "ex", "rt", "ordre", "split", "s.*").join(signatures.select("terme", "symbole", "poids"), "terme", "left")
    return joined.select("lot", "ex", "rt", "ordre", "split", "cote", F.coalesce("symbole", "terme").alias("symbole"), F.coalesce("poids", F.lit(1.0)).alias("poids"))


def with_definiteness(side_rows: DataFrame, rows: DataFrame) -> DataFrame:
    """Adds the row's own symbols DEF:det and DEF:definitude to its right side."""
    own = rows.select("lot", "ex", "rt", "ordre", "split", F.lit("R").alias("cote"), F.explode(F.array("det", "definitude")).alias("_d")).filter("_d is not null")
    return side_rows.unionByName(own.select("lot", "ex", "rt", "ordre", "split", "cote", F.concat(F.lit("DEF:"), "_d").alias("symbole"), F.lit(1.0).alias("poids")))


def squared(keys: list[str], rows: DataFrame) -> DataFrame:
    """Sum of squared weights by key."""
    return rows.groupBy(*keys).agg(F.sum(F.col("poids") * F.col("poids")).alias("carre"))


def cosine(dot: Column, norm_a: Column, norm_b: Column) -> Column:
    """dot / (norm * norm); 0 where a side is empty or nothing is shared."""
    return F.coalesce(F.try_divide(dot, norm_a * norm_b), F.lit(0.0))


def side_norms(side_rows: DataFrame) -> DataFrame:
    """(lot, ex, cote, norme)."""
    return squared(["lot", "ex", "cote"], side_rows).select("lot", "ex", "cote", F.sqrt("carre").alias("norme"))


def leaf_gram(side_rows: DataFrame) -> DataFrame:
    """Dot products of the pairs i <= j (by order) of all examples of one relation, by side: (rt, cote, i, j, produit)."""
    return pairs.gram(side_rows)


def pair_similarities(gram: DataFrame) -> DataFrame:
    """(rt, i, j, sim_l, sim_r, lien, score) of different pairs with something in common; the link is the lesser, the score the mean.

    For grams that are at hand; pairs.links finds the same without shuffling pairs."""
    own = gram.filter("i = j").select("rt", "cote", F.col("i").alias("e"), F.sqrt("produit").alias("n"))
    a, b = own.select("rt", "cote", F.col("e").alias("i"), F.col("n").alias("ni")), own.select("rt", "cote", F.col("e").alias("j"), F.col("n").alias("nj"))
    sims = gram.filter("i <> j").join(a, ["rt", "cote", "i"]).join(b, ["rt", "cote", "j"]).withColumn("sim", cosine(F.col("produit"), F.col("ni"), F.col("nj")))
    of = lambda c: F.coalesce(F.max(F.when(F.col("cote") == c, F.col("sim"))), F.lit(0.0))
    both = sims.groupBy("rt", "i", "j").agg(of("L").alias("sim_l"), of("R").alias("sim_r"))
    return both.withColumn("lien", F.least("sim_l", "sim_r")).withColumn("score", 0.5 * (F.col("sim_l") + F.col("sim_r")))


def set_measures(common: Column, size_a: Column, size_b: Column, beta: float = 0.2) -> dict[str, Column]:
    """Cosine of sets, coverage of the first, Tversky (beta 0: coverage, 1: Jaccard)."""
    return {
        "cosinus": F.coalesce(F.try_divide(common.cast("double"), F.sqrt(size_a.cast("double") * size_b)), F.lit(0.0)),
        "couverture": F.coalesce(F.try_divide(common.cast("double"), size_a), F.lit(0.0)),
        "tversky": F.coalesce(F.try_divide(common.cast("double"), common + (size_a - common) + F.lit(beta) * (size_b - common)), F.lit(0.0)),
    }


def row_term_pairs(rows: DataFrame, symbols: DataFrame) -> DataFrame:
    """(ex, n_commun, n_a, n_b, produit, carre_a, carre_b) of the two terms of each row."""
    size = symbols.groupBy("terme").agg(F.count("*").alias("n"), F.sum(F.col("poids") * F.col("poids")).alias("c"))
    pairs = rows.select("A", "B").distinct()
    a = symbols.select(F.col("terme").alias("A"), "symbole", F.col("poids").alias("pa"))
    b = symbols.select(F.col("terme").alias("B"), "symbole", F.col("poids").alias("pb"))
    shared = pairs.join(a, "A").join(b, ["B", "symbole"]).groupBy("A", "B").agg(F.count("*").alias("n_commun"), F.sum(F.col("pa") * F.col("pb")).alias("produit"))
    sized = pairs.join(size.toDF("A", "n_a", "carre_a"), "A").join(size.toDF("B", "n_b", "carre_b"), "B").join(shared, ["A", "B"], "left")
    measured = sized.select("A", "B", F.coalesce("n_commun", F.lit(0)).alias("n_commun"), "n_a", "n_b", F.coalesce("produit", F.lit(0.0)).alias("produit"), "carre_a", "carre_b")
    return rows.select("ex", "A", "B").join(measured, ["A", "B"]).drop("A", "B")


def centroids(side_rows: DataFrame) -> DataFrame:
    """Sums of the training vectors by relation and side."""
    return side_rows.groupBy("rt", "cote", "symbole").agg(F.sum("poids").alias("poids"))


def centroid_scores(rows: DataFrame, signatures: DataFrame, centers: DataFrame) -> DataFrame:
    """(ex, rt, score) against every relation: half the sum of the cosines of both sides.

    Dot products are worked out for distinct terms, so that a term held by many rows costs once. Scores have nine
    decimals, so that equal ones stay equal in whatever order their parts were summed."""
    terms = terms_of(rows)
    vectors = terms.join(signatures.select("terme", "symbole", "poids"), "terme", "left").select("terme", F.coalesce("symbole", "terme").alias("symbole"), F.coalesce("poids", F.lit(1.0)).alias("poids"))
    norm = squared(["terme"], vectors).select("terme", F.sqrt("carre").alias("nt"))
    center = squared(["rt", "cote"], centers).select("rt", "cote", F.sqrt("carre").alias("nc"))  # two rows a relation
    dots = vectors.join(centers.withColumnRenamed("poids", "pc"), "symbole").groupBy("terme", "rt", "cote").agg(F.sum(F.col("poids") * F.col("pc")).alias("produit"))
    sims = dots.join(norm, "terme").join(center, ["rt", "cote"]).select("terme", "rt", "cote", cosine(F.col("produit"), F.col("nt"), F.col("nc")).alias("sim"))
    types = centers.select("rt").distinct()
    left, right = (sims.filter(F.col("cote") == c).select(F.col("terme").alias(t), "rt", F.col("sim").alias(f"s{c}")) for c, t in (("L", "A"), ("R", "B")))
    every = rows.select("ex", "A", "B").crossJoin(types)  # a row a relation, of which there are few
    return every.join(left, ["A", "rt"], "left").join(right, ["B", "rt"], "left").select("ex", "rt", F.round(0.5 * (F.coalesce("sL", F.lit(0.0)) + F.coalesce("sR", F.lit(0.0))), 9).alias("score"))


def side_scores(asked: DataFrame, centers: DataFrame) -> DataFrame:
    """(ex, rt, score) of example sides against every relation, for sides that hold more than the terms' signatures."""
    center = squared(["rt", "cote"], centers).select("rt", "cote", F.sqrt("carre").alias("nc"))
    dots = asked.select("ex", "cote", "symbole", "poids").join(centers.withColumnRenamed("poids", "pc"), ["cote", "symbole"]).groupBy("ex", "rt", "cote").agg(F.sum(F.col("poids") * F.col("pc")).alias("produit"))
    norm = squared(["ex", "cote"], asked).select("ex", "cote", F.sqrt("carre").alias("norme"))
    sims = dots.join(norm, ["ex", "cote"]).join(center, ["rt", "cote"]).groupBy("ex", "rt").agg((0.5 * F.sum(cosine(F.col("produit"), F.col("norme"), F.col("nc")))).alias("score"))
    every = asked.select("ex").distinct().crossJoin(centers.select("rt").distinct())  # a row a relation, of which there are few
    return every.join(sims, ["ex", "rt"], "left").select("ex", "rt", F.round(F.coalesce("score", F.lit(0.0)), 9).alias("score"))
