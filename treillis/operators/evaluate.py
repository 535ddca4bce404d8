"""Evaluation of predictions (ex, attendu, predit, score, ...), statistics over folds, exact tests."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ratio(part: Column, of: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), of.cast("double")), F.lit(0.0))


def per_type(predictions: DataFrame, types: DataFrame) -> DataFrame:
    """Precision, recall and F1 of each of the given types, 0 where undefined."""
    expected = predictions.groupBy(F.col("attendu").alias("rt")).agg(F.count("*").alias("n_attendus"), F.count_if(F.col("attendu") == F.col("predit")).alias("vrais"))
    predicted = predictions.filter("predit is not null").groupBy(F.col("predit").alias("rt")).agg(F.count("*").alias("n_predits"))
    t = types.join(expected, "rt", "left").join(predicted, "rt", "left").fillna(0)
    t = t.withColumn("precision", ratio(F.col("vrais"), F.col("n_predits"))).withColumn("rappel", ratio(F.col("vrais"), F.col("n_attendus")))
    return t.withColumn("f1", ratio(2 * F.col("precision") * F.col("rappel"), F.col("precision") + F.col("rappel")))


def macro(predictions: DataFrame, types: DataFrame) -> DataFrame:
    """Unweighted means over the types, and accuracy."""
    m = per_type(predictions, types).agg(*[F.avg(c).alias(c) for c in ("precision", "rappel", "f1")])
    a = predictions.agg(F.count("*").alias("n"), F.count_if(F.col("attendu") == F.col("predit")).alias("corrects"))
    return m.crossJoin(a).withColumn("exactitude", ratio(F.col("corrects"), F.col("n")))  # one row each


def confusion(predictions: DataFrame, types: list[str]) -> DataFrame:
    """Dense matrix: a row an expected type, a column a predicted one, zeros filled in."""
    spark = predictions.sparkSession
    rows = spark.createDataFrame([(t,) for t in types], "attendu string")
    return rows.join(predictions.groupBy("attendu").pivot("predit", types).count(), "attendu", "left").fillna(0)


def lenient(ranked_answers: DataFrame, expected: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """Right answers if the second counts within a tolerance of the winner: strict and lenient numbers."""
    top = ranked_answers.filter("rang <= 2").join(expected, "ex")
    best = F.max(F.when(F.col("rang") == 1, F.col("score")))
    hit = lambda k: F.max(F.when((F.col("rang") == k) & (F.col("rt") == F.col("attendu")), F.col("score")))
    each = top.groupBy("ex").agg(best.alias("s"), hit(1).alias("h1"), hit(2).alias("h2"))
    near = F.col("h2").isNotNull() & ((F.col("s") == 0) | ((F.col("s") - F.col("h2")) / F.nullif(F.col("s"), F.lit(0.0)) <= tolerance))
    return each.agg(F.count("*").alias("n"), F.count_if(F.col("h1").isNotNull()).alias("stricts"), F.count_if(F.col("h1").isNotNull() | near).alias("indulgents"))


def abstention(predictions: DataFrame, thresholds: list[float]) -> DataFrame:
    """Kept answers, right ones among them and right ones lost, for score thresholds."""
    right = F.col("attendu") == F.col("predit")
    each = predictions.select("score", right.alias("juste"), F.explode(F.array(*map(F.lit, thresholds))).alias("seuil"))
    kept = F.col("score") >= F.col("seuil")
    return each.groupBy("seuil").agg(F.count_if(kept).alias("gardes"), F.count_if(kept & F.col("juste")).alias("justes"), F.count_if(~kept & F.col("juste")).alias("justes_perdus"), F.round(F.avg((~kept).cast("int")), 6).alias("taux"))


def score_quantiles(predictions: DataFrame) -> DataFrame:
    """Least, lower decile, median, upper decile and greatest score, of right and of wrong answers."""
    right = (F.col("attendu") == F.col("predit")).alias("juste")
    q = lambda p: F.percentile("score", F.lit(p))
    return predictions.groupBy(right).agg(F.count("*").alias("n"), F.min("score").alias("mini"), q(0.1).alias("c10"), q(0.5).alias("mediane"), q(0.9).alias("c90"), F.max("score").alias("maxi"))


def expected_rank(ranked_answers: DataFrame, expected: DataFrame) -> DataFrame:
    """The rank of the expected type among each example's answers."""
    return ranked_answers.join(expected, "ex").filter(F.col("rt") == F.col("attendu")).select("ex", "attendu", "rang", "score")


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Predictions of two methods by example: corrige, casse, autre (both wrong, differently); equal ones are left out."""
    a, b = before.select("ex", "attendu", F.col("predit").alias("avant")), after.select("ex", F.col("predit").alias("apres"))
    was, is_ = F.col("avant") == F.col("attendu"), F.col("apres") == F.col("attendu")
    kind = F.when(~was & is_, "corrige").when(was & ~is_, "casse").when(F.col("avant") != F.col("apres"), "autre")
    return a.join(b, "ex").withColumn("changement", kind).filter("changement is not null")


CAUSES = ("connaissance", "morphologie", "classe_multiple", "polysemie", "autre")


def term_traits(records: DataFrame, signatures: DataFrame, poor: int = 3) -> DataFrame:
    """What may make a term hard: poor signature, better endowed singular, refinements."""
    size = signatures.groupBy("terme").agg(F.count("*").alias("_n"))
    return records.join(size, "terme", "left").select(
        "terme", (F.coalesce("_n", F.lit(0)) < poor).alias("pauvre"), (F.coalesce(F.col("diagnostic_singulier.H_taille"), F.lit(0)) > F.coalesce(F.size("H"), F.lit(0))).alias("singulier"),
        (F.coalesce(F.size("raffinements"), F.lit(0)) >= 2).alias("polysemique"),
    )


def error_causes(predictions: DataFrame, rows: DataFrame, traits: DataFrame, tight: float = 0.05) -> DataFrame:
    """Each wrong answer with its causes (several may hold) and the first of them by priority.

    ``predictions`` needs ``ecart`` and ``second``; an unknown term counts as poor."""
    def of(side: str) -> DataFrame:
        return traits.select(F.col("terme").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in ("pauvre", "singulier", "polysemique")])

    wrong = predictions.filter("attendu <> predit").join(rows.select("ex", "A", "B"), "ex").join(of("A"), "A", "left").join(of("B"), "B", "left")
    any_ = lambda c, absent: F.coalesce(F.col(f"{c}_A"), F.lit(absent)) | F.coalesce(F.col(f"{c}_B"), F.lit(absent))
    flags = (any_("pauvre", True), any_("singulier", False), (F.col("second") == F.col("attendu")) & (F.col("ecart") <= tight), any_("polysemique", False))
    causes = F.array_compact(F.array(*[F.when(f, F.lit(c)) for f, c in zip(flags, CAUSES)]))
    return wrong.select("ex", "attendu", "predit", causes.alias("causes")).withColumn("cause", F.coalesce(F.try_element_at("causes", F.lit(1)), F.lit("autre")))


def polysemy_rates(predictions: DataFrame, rows: DataFrame, traits: DataFrame) -> DataFrame:
    """Error rate of examples with and without a polysemous term."""
    poly = traits.filter("polysemique").select("terme")
    marked = rows.select("ex", F.explode(F.array("A", "B")).alias("terme")).join(poly, "terme", "left_semi").select("ex").distinct().withColumn("polysemique", F.lit(True))
    each = predictions.join(marked, "ex", "left").select(F.coalesce("polysemique", F.lit(False)).alias("polysemique"), (F.col("attendu") != F.col("predit")).alias("faux"))
    return each.groupBy("polysemique").agg(F.count("*").alias("n"), F.count_if("faux").alias("erreurs")).withColumn("taux", ratio(F.col("erreurs"), F.col("n")))


def descent_statistics(stops: DataFrame) -> DataFrame:
    """Shares of leaf, root and inner stops, depth, evaluations and relative weight (of ``taille``, the examples of the type) of winning descents."""
    share = lambda c: F.avg(c.cast("int"))
    root = F.col("profondeur") == 0
    return stops.agg(
        F.count("*").alias("n"), share(F.col("feuille")).alias("part_feuilles"), share(root & ~F.col("feuille")).alias("part_racines"), share(~root & ~F.col("feuille")).alias("part_internes"),
        F.avg("profondeur").alias("profondeur_moyenne"), F.avg("calculs").alias("calculs_moyens"), F.max("calculs").alias("calculs_max"),
        F.avg(F.col("poids") / F.col("taille")).alias("poids_relatif"),
    )


# Folds, configurations and tests -------------------------------------------------------------------------


def aggregate(measures: DataFrame) -> DataFrame:
    """Mean and sample standard deviation of F1 by configuration."""
    return measures.groupBy("cle").agg(F.count("*").alias("n"), F.avg("f1").alias("f1_moyen"), F.stddev_samp("f1").alias("ecart_type"))


def differences(measures: DataFrame, reference: str) -> DataFrame:
    """F1 of each configuration less that of the reference on the same seed and fold."""
    ref = measures.filter(F.col("cle") == reference).select("graine", "pli", F.col("f1").alias("_r"))
    return measures.join(ref, ["graine", "pli"]).select("cle", "graine", "pli", (F.col("f1") - F.col("_r")).alias("d"))


def beats(measures: DataFrame, reference: str) -> DataFrame:
    """Whether the mean difference exceeds its standard deviation; else the configuration can't be told apart."""
    d = differences(measures, reference).groupBy("cle").agg(F.avg("d").alias("gain"), F.stddev_samp("d").alias("ecart"))
    return d.withColumn("bat", F.col("gain") > F.coalesce("ecart", F.lit(0.0))).withColumn("indistinct", F.abs("gain") <= F.coalesce("ecart", F.lit(0.0)))


def choose_simplest(measures: DataFrame, ranks: DataFrame) -> DataFrame:
    """The simplest configuration that can't be told apart from the best, ties by F1.

    ``ranks`` has cle, rang (complexity) and place (order of the candidates, which breaks the ties of the best)."""
    mean = aggregate(measures).join(ranks, "cle")
    best = mean.orderBy(F.desc("f1_moyen"), "place").limit(1).select(F.col("cle").alias("_best"))
    mine = measures.select("cle", "graine", "pli", "f1")
    top = mine.join(F.broadcast(best), F.col("cle") == F.col("_best")).select("graine", "pli", F.col("f1").alias("_f"))
    d = mine.join(top, ["graine", "pli"]).groupBy("cle").agg(F.avg(F.col("_f") - F.col("f1")).alias("_m"), F.stddev_samp(F.col("_f") - F.col("f1")).alias("_s"))
    near = d.filter(F.col("_m") <= F.coalesce("_s", F.lit(0.0))).join(mean, "cle")
    return near.orderBy("rang", F.desc("f1_moyen"), "place").limit(1).select("cle", "rang", "f1_moyen")


def indistinguishable(aggregated: DataFrame) -> DataFrame:
    """Configurations by F1, with those at most a standard deviation of the best below it."""
    best = F.max_by(F.struct("f1_moyen", "ecart_type"), F.struct(F.col("f1_moyen"), F.col("cle"))).over(Window.partitionBy())  # a row a configuration
    return aggregated.withColumn("_b", best).withColumn("indistinct", F.col("f1_moyen") >= F.col("_b.f1_moyen") - F.coalesce("_b.ecart_type", F.lit(0.0))).drop("_b")


def average_ranks(values: DataFrame, value: str, *by: str) -> DataFrame:
    """Ranks from 1, equal values sharing their mean rank."""
    w = Window.partitionBy(*by).orderBy(value)
    return values.withColumn("rang_moyen", F.rank().over(w) + (F.count("*").over(Window.partitionBy(*by, value)) - 1) / F.lit(2.0))


def wilcoxon(diffs: DataFrame, d: str = "d", *by: str) -> DataFrame:
    """Exact two-sided signed-rank test by all sign vectors, for few differences; zeros count for nothing.

    A group of more than 20 differences is an error, as there are 2**n sign vectors."""
    ranked_ = average_ranks(diffs.filter(F.abs(d) > 1e-9).withColumn("_a", F.round(F.abs(d), 9)), "_a", *by)
    groups = ranked_.groupBy(*by).agg(F.collect_list("rang_moyen").alias("_r"), F.coalesce(F.sum(F.when(F.col(d) > 0, F.col("rang_moyen"))), F.lit(0.0)).alias("w_plus"), F.count("*").alias("n"))
    groups = groups.filter(F.assert_true(F.col("n") <= 20, "more than 20 differences").isNull())
    groups = groups.withColumn("_half", F.aggregate("_r", F.lit(0.0), lambda x, y: x + y) / 2)
    each = groups.withColumn("_m", F.explode(F.sequence(F.lit(0), F.pow(F.lit(2.0), F.col("n")).cast("int") - 1)))
    signed = F.aggregate(F.transform("_r", lambda r, i: F.when(F.getbit(F.col("_m"), i) == 1, r).otherwise(0.0)), F.lit(0.0), lambda x, y: x + y)
    extreme = F.abs(signed - F.col("_half")) >= F.abs(F.col("w_plus") - F.col("_half")) - 1e-9
    return each.groupBy(*by, "n", "w_plus").agg(F.avg(extreme.cast("int")).alias("p"))


def sign_test(changed: DataFrame) -> DataFrame:
    """The sign test of corrected against broken examples, as one row."""
    counts = changed.agg(F.count_if(F.col("changement") == "corrige").alias("corriges"), F.count_if(F.col("changement") == "casse").alias("casses"))
    n, x = F.col("corriges") + F.col("casses"), F.greatest("corriges", "casses")
    log_choose = lambda k: F.aggregate(F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>")), F.lit(0.0), lambda s, j: s + F.log((n - k + j).cast("double")) - F.log(j.cast("double")))
    tail = F.aggregate(F.transform(F.sequence(x, n), lambda k: F.exp(log_choose(k) - n * F.log(F.lit(2.0)))), F.lit(0.0), lambda s, t: s + t)
    return counts.withColumn("p", F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * tail)))


def reproducibility(a: DataFrame, b: DataFrame) -> DataFrame:
    """Folds two measure tables share, how many F1 are equal to the bit, and the greatest difference."""
    both = a.select("cle", "graine", "pli", F.col("f1").alias("x")).join(b.select("cle", "graine", "pli", F.col("f1").alias("y")), ["cle", "graine", "pli"])
    return both.agg(F.count("*").alias("n"), F.count_if(F.col("x") == F.col("y")).alias("egaux"), F.max(F.abs(F.col("x") - F.col("y"))).alias("ecart_max"))
