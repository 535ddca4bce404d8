"""Problem 2: splits that keep linked records together.

Records that share a term, directly or through others, form a group. Each term stands for the smallest
record that holds it, so that the graph has record ids as nodes and at most one edge a record, and a term
held by a third of all records is a star of which one edge a distinct partner is left. Groups come from
hash-to-min over pairs (node, member): each node sends its members to its smallest one and that one to its
members, until nothing changes. Weighted rendezvous hashing then gives each group a split.

Shares: every group is placed by the same rule, and its weights say what each split still lacks in the relation most of
the group's records have. They are fitted by size class, the largest groups first, so that what large groups upset the
small ones make up for. Over all rows the shares are met within the size of the smallest class that many groups are in; in a
relation of n rows within three binomial deviations, 3 * sqrt(p * (1 - p) / n), and the rows that groups of another
relation bring into it.

Defined cases: empty and null terms link nothing; a record without terms is a group of its own; ties go to
the first split in the given order; repeated rows need ids of their own; an empty table gives no rows.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treillis.session import cut

SHARES = {"train": 0.7, "val": 0.1, "test": 0.2}


def hash_to_min(edges: DataFrame) -> DataFrame:
    """``noeud`` and ``groupe`` (the smallest node of its component) of every node of the edges (x, y)."""
    both = edges.select("x", "y").union(edges.select("y", "x"))
    own = both.select("x", F.col("x").alias("y"))
    pairs = cut(both.union(own).distinct())
    mark = None
    while True:
        seen = pairs.agg(F.count("*"), F.sum(F.xxhash64("x", "y").cast("decimal(38,0)"))).first()
        if seen == mark:
            break
        mark = seen
        least = pairs.groupBy("x").agg(F.min("y").alias("m"))
        sent = pairs.join(least, "x")
        pairs = cut(sent.select(F.explode(F.array(F.struct(F.col("m").alias("x"), F.col("y").alias("y")), F.struct(F.col("y").alias("x"), F.col("m").alias("y")))).alias("p")).select("p.x", "p.y").distinct())
    return pairs.groupBy(F.col("x").alias("noeud")).agg(F.min("y").alias("groupe"))


def groups(rows: DataFrame, key: str, terms: list[Column]) -> DataFrame:
    """``key`` and ``groupe`` (its group's smallest key) of every row."""
    held = cut(
        rows.select(F.col(key).alias("_id"), F.array_distinct(F.filter(F.array(*terms), lambda t: t.isNotNull() & (t != ""))).alias("_t"))
        .select("_id", F.explode_outer("_t").alias("_terme"))
    )
    first = held.filter("_terme is not null").groupBy("_terme").agg(F.min("_id").alias("_r"))
    ends = cut(held.join(first, "_terme", "left").groupBy("_id").agg(F.coalesce(F.min("_r"), F.col("_id")).alias("x"), F.coalesce(F.max("_r"), F.col("_id")).alias("y")))
    labels = hash_to_min(ends.filter("x <> y").select("x", "y").distinct())
    return ends.join(labels, ends.x == labels.noeud, "left").select(F.col("_id").alias(key), F.coalesce("groupe", "x").alias("groupe"))


def spread(rows: DataFrame, group: DataFrame, key: str, split: str) -> DataFrame:
    """Rows of groups whose non-null splits are more than one."""
    with_group = rows.select(key, split).join(group, key)
    mixed = with_group.groupBy("groupe").agg(F.min(split).alias("_a"), F.max(split).alias("_b")).filter("_a <> _b").select("groupe")
    return with_group.join(mixed, "groupe", "left_semi").select("groupe", key)


def _sizes(rows: DataFrame, group: DataFrame, key: str, stratum: str) -> tuple[DataFrame, DataFrame]:
    """Rows of each group by stratum (``groupe``, ``_s``, ``_n``), and of each group its stratum with most rows, its rows
    there and the size class (power of two) of all its rows."""
    counts = cut(rows.select(key, F.coalesce(F.col(stratum), F.lit("")).alias("_s")).join(group, key).groupBy("groupe", "_s").agg(F.count("*").alias("_n")))
    whole = counts.groupBy("groupe").agg(F.max(F.struct("_n", "_s")).alias("x"), F.floor(F.log2(F.sum("_n"))).cast("int").alias("_c"))
    return counts, whole.select("groupe", "_c", "x._s", "x._n")


def choose(groups: DataFrame, weights: DataFrame, shares: dict[str, float] = SHARES, seed: int = 0) -> DataFrame:
    """``groupe`` and ``split_nouveau`` by weighted rendezvous hashing: the split with the least -ln(hash) / weight.

    A group (groupe, _c, _s, _n) weighs a split by the room left for its class and stratum (``weights``: _c, _s, _w) once
    it were in it. Where it fits nowhere, the splits with most room are left; a class or stratum without weights has the plain
    shares. What a group gets depends on itself and the weights only, not on other groups."""
    plain = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(s).alias("split"), F.lit(float(p)).alias("w")) for i, (s, p) in enumerate(shares.items())])
    unit = lambda name: (F.shiftrightunsigned(F.xxhash64("groupe", name, F.lit(seed)), 11).cast("double") + 0.5) / float(1 << 53)
    of = lambda x, w: F.struct(x["i"].alias("i"), x["split"].alias("split"), w.alias("w"))
    fits = F.filter(F.transform("_w", lambda x: of(x, x["w"] - F.col("_n"))), lambda x: x["w"] > 0)
    most = F.array_max(F.transform("_w", lambda x: x["w"]))
    roomy = F.transform(F.filter("_w", lambda x: x["w"] == most), lambda x: of(x, F.lit(1.0)))
    usable = F.when(F.col("_w").isNull(), plain).when(F.size(fits) > 0, fits).otherwise(roomy)
    best = F.array_min(F.transform(usable, lambda x: F.struct((-F.log(unit(x["split"])) / x["w"]).alias("c"), x["i"].alias("i"), x["split"].alias("split"))))["split"]
    return groups.join(weights, ["_c", "_s"], "left").select("groupe", best.alias("split_nouveau"))


def fitted_weights(counts: DataFrame, sizes: DataFrame, shares: dict[str, float] = SHARES, seed: int = 0) -> DataFrame:
    """The weights (_c, _s, _w) of every size class, largest first: the rows each split still lacks in a stratum after the groups
    of all larger classes. A class is a power of two, so that there are few whatever the number of groups."""
    total = counts.groupBy("_s").agg(F.sum("_n").alias("_ns"))
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(s).alias("split"), F.lit(float(p)).alias("p")) for i, (s, p) in enumerate(shares.items())]))
    left = cut(total.select("_s", "_ns", each.alias("e")).select("_s", "e.i", "e.split", (F.col("e.p") * F.col("_ns")).alias("w")))
    classes = sorted((r[0] for r in sizes.select("_c").distinct().collect()), reverse=True)  # at most 64
    out = None
    for c in classes:
        now = left.groupBy("_s").agg(F.array_sort(F.collect_list(F.struct("i", "split", "w"))).alias("_w")).select(F.lit(c).alias("_c"), "_s", "_w")  # an entry a split
        out = now if out is None else out.union(now)
        if c == classes[-1]:
            break
        here = choose(sizes.filter(F.col("_c") == c), now, shares, seed)
        taken = counts.join(here, "groupe").groupBy("_s", F.col("split_nouveau").alias("split")).agg(F.sum("_n").alias("_t"))
        left = cut(left.join(taken, ["_s", "split"], "left").select("_s", "i", "split", (F.col("w") - F.coalesce("_t", F.lit(0))).alias("w")))
    return out if out is not None else left.select(F.lit(0).alias("_c"), "_s", F.array(F.struct("i", "split", "w")).alias("_w"))


def assign(rows: DataFrame, group: DataFrame, key: str, stratum: str, shares: dict[str, float] = SHARES, seed: int = 0, weights: DataFrame | None = None) -> DataFrame:
    """``key``, ``groupe`` and ``split_nouveau`` of every row.

    With the ``weights`` of an earlier run only groups that gained rows may move."""
    counts, sizes = _sizes(rows, group, key, stratum)
    sizes = cut(sizes)
    if weights is None:
        weights = fitted_weights(counts, sizes, shares, seed)
    return group.join(choose(sizes, weights, shares, seed), "groupe").select(key, "groupe", "split_nouveau")


def met_shares(rows: DataFrame, assigned: DataFrame, key: str, stratum: str) -> DataFrame:
    """Rows and share of each new split, by stratum and over all (stratum null, ``ensemble`` true)."""
    n = rows.select(key, F.coalesce(F.col(stratum), F.lit("")).alias(stratum)).join(assigned, key).cube(stratum, "split_nouveau").agg(F.count("*").alias("n"), F.grouping(stratum).alias("_g"), F.grouping("split_nouveau").alias("_h"))
    w = Window.partitionBy("_g", stratum)
    return (
        n.withColumn("_tout", F.max(F.when(F.col("_h") == 1, F.col("n"))).over(w))
        .filter("_h = 0")
        .select((F.col("_g") == 1).alias("ensemble"), stratum, "split_nouveau", "n", F.round(F.col("n") / F.col("_tout"), 6).alias("part"))
    )
