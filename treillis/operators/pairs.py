"""All pairs of examples, block against block.

Examples are dealt to blocks of about BLOCK rows by a hash; a task gets two blocks (or one and itself), finds the
products of all their pairs through their symbols, and gives rows of pairs, or counts of them, so that no pair is
shuffled. A symbol of most rows is spread over all pairs of blocks."""
from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treillis.session import bound_arrow_batches, cut

#: Rows of a block, and rows of it that are compared with the other block at once.
BLOCK, STRIP = 2_000, 100
#: Bins of a score for percentiles.
BINS = 10_000


#: The sides, and what is kept of an example's vectors.
SIDES = ("L", "R")
PARTS = ("cL", "cR", "sL", "sR", "pL", "pR")


def coded(*side_rows: DataFrame) -> DataFrame:
    """(cote, symbole, code) of the symbols that stand more than once on a side; the others make no pair."""
    held = reduce(DataFrame.unionByName, [x.select("cote", "symbole") for x in side_rows])
    many = held.groupBy("cote", "symbole").agg(F.count("*").alias("_n")).filter("_n > 1")
    return cut(many.select("cote", "symbole", F.monotonically_increasing_id().alias("code")))  # written, as ids aren't the same when a task is repeated


def packed(side_rows: DataFrame, codes: DataFrame, keys: list[str], sizes: bool = False) -> DataFrame:
    """A row an example: keys, sums of squares by side of all symbols (cL, cR), arrays of codes (sL, sR) and weights (pL, pR) of the coded ones,
    and, if asked for, the numbers of all symbols (nL, nR)."""
    of = lambda c, x: F.when(F.col("cote") == c, x)
    entry = F.when(F.col("code").isNotNull(), F.struct("code", "poids"))
    each = side_rows.join(codes, ["cote", "symbole"], "left").groupBy(*keys).agg(
        *[F.coalesce(F.sum(of(c, F.col("poids") * F.col("poids"))), F.lit(0.0)).alias(f"c{c}") for c in SIDES], *[F.collect_list(of(c, entry)).alias(f"_{c}") for c in SIDES], *[F.count(of(c, F.lit(1))).alias(f"n{c}") for c in SIDES],
    )
    return each.select(*keys, *[f"c{c}" for c in SIDES], *[f"n{c}" for c in SIDES if sizes], *[F.col(f"_{c}.code").alias(f"s{c}") for c in SIDES], *[F.col(f"_{c}.poids").alias(f"p{c}") for c in SIDES])


def packed_terms(rows: DataFrame, signatures: DataFrame) -> DataFrame:
    """What packed() gives of the sides of the rows (all their columns but A and B kept), with the numbers of symbols.

    A term's vector is put together once, for all rows that hold it; a term without a signature has itself as its symbol. Coded are the
    symbols that stand more than once on one of the sides."""
    place = F.explode(F.array(*[F.struct(F.lit(c).alias("cote"), F.col(t).alias("terme")) for c, t in zip(SIDES, "AB")]))
    held = rows.select(place.alias("x")).groupBy("x.terme").agg(*[F.count_if(F.col("x.cote") == c).alias(f"_{c}") for c in SIDES])
    vectors = held.join(signatures.select("terme", "symbole", "poids"), "terme", "left").withColumn("symbole", F.coalesce("symbole", "terme")).withColumn("poids", F.coalesce("poids", F.lit(1.0)))
    many = vectors.groupBy("symbole").agg(*[F.sum(f"_{c}").alias(f"_{c}") for c in SIDES]).filter(" or ".join(f"_{c} > 1" for c in SIDES))
    codes = cut(many.select("symbole", F.monotonically_increasing_id().alias("code")))  # written, as in coded()
    entry = F.when(F.col("code").isNotNull(), F.struct("code", "poids"))
    each = vectors.join(codes, "symbole", "left").groupBy("terme").agg(F.sum(F.col("poids") * F.col("poids")).alias("c"), F.count("*").alias("n"), F.collect_list(entry).alias("e"))
    out = rows
    for c, t in zip(SIDES, "AB"):
        out = out.join(each.select(F.col("terme").alias(t), F.col("c").alias(f"c{c}"), F.col("n").alias(f"n{c}"), F.col("e.code").alias(f"s{c}"), F.col("e.poids").alias(f"p{c}")), t)
    return out.drop("A", "B")


def block_pairs(side_rows: DataFrame, same: bool, block: int = BLOCK) -> DataFrame:
    """(groupe, a, b, bloc, lignes): the one or two blocks of each pair a <= b, within a relation or (``same`` false) over all."""
    bound_arrow_batches(side_rows.sparkSession)
    group = F.col("rt") if same else F.lit("")
    n = side_rows.select(group.alias("groupe"), "ex").distinct().groupBy("groupe").agg(F.ceil(F.count("*") / block).cast("int").alias("n"))
    each = packed(side_rows, coded(side_rows), ["rt", "ex", "ordre"]).filter("size(sL) + size(sR) > 0").withColumn("groupe", group)
    dealt = each.join(F.broadcast(n), "groupe").withColumn("bloc", F.pmod(F.xxhash64("ex"), "n").cast("int"))  # a row a relation
    blocks = dealt.groupBy("groupe", "bloc", "n").agg(F.collect_list(F.struct("ex", "ordre", "rt", *PARTS)).alias("lignes"))
    both = blocks.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    return both.select("groupe", F.least("bloc", "_o").alias("a"), F.greatest("bloc", "_o").alias("b"), "bloc", "lignes")


class Block:
    """The vectors of a block: by side the rows, symbols and weights of their entries, and norms; other fields by column()."""

    def __init__(self, rows: pa.StructArray):
        self.rows, self.n, self.kept = rows, len(rows), {}
        values = lambda x: x.to_numpy(zero_copy_only=False)
        of = lambda c: (np.repeat(np.arange(self.n), values(rows.field(f"s{c}").value_lengths())), *(values(rows.field(f"{x}{c}").flatten()) for x in "sp"))
        self.sides = {c: of(c) for c in SIDES}
        self.norms = {c: np.sqrt(values(rows.field(f"c{c}"))) for c in SIDES}

    def column(self, name: str) -> np.ndarray:
        if name not in self.kept:
            self.kept[name] = self.rows.field(name).to_numpy(zero_copy_only=False)
        return self.kept[name]


def strips(one: Block, two: Block, strip: int = STRIP) -> Iterator[tuple[int, int, dict[str, np.ndarray], dict[str, np.ndarray]]]:
    """By strip of rows of the first block: its bounds, and by side whether it shares a symbol with each row of the second, and the products (flat)."""
    ready = {}
    for c in SIDES:
        (ra, sa, wa), (rb, sb, wb) = one.sides[c], two.sides[c]
        order = np.argsort(sb, kind="stable")
        sb, rb, wb = sb[order], rb[order], wb[order]
        first = np.searchsorted(sb, sa)
        ready[c] = ra, wa, rb, wb, first, np.searchsorted(sb, sa, "right") - first
    for low in range(0, one.n, strip):
        high = min(low + strip, one.n)
        met, dots = {}, {}
        for c, (ra, wa, rb, wb, first, count) in ready.items():
            x, y = np.searchsorted(ra, (low, high))  # entries stand by row
            k = count[x:y]
            at = np.arange(k.sum()) + np.repeat(first[x:y] - np.cumsum(k) + k, k)
            key = np.repeat((ra[x:y] - low) * two.n, k) + rb[at]
            met[c] = np.bincount(key, minlength=(high - low) * two.n) > 0
            dots[c] = np.bincount(key, np.repeat(wa[x:y], k) * wb[at], (high - low) * two.n)
        yield low, high, met, dots


def products(part: pa.Table) -> Iterator[tuple]:
    """By strip: both blocks, the rows u and v of the pairs of different examples that share a symbol, their ids i and j (first the one that
    is first by (ordre, ex)), and by side whether it is on that side and their products."""
    blocks = [Block(x.values) for _, x in sorted(zip(part["bloc"].to_pylist(), (s for c in part["lignes"].chunks for s in c), strict=True), key=lambda x: x[0])]
    one, two = blocks[0], blocks[-1]
    (ea, oa), (eb, ob) = ((b.column("ex"), b.column("ordre")) for b in (one, two))
    for low, _, met, dots in strips(one, two):
        found = np.flatnonzero(met["L"] | met["R"])
        u, v = found // two.n + low, found % two.n
        if one is two:
            keep = u < v
            found, u, v = found[keep], u[keep], v[keep]
        swap = (oa[u] > ob[v]) | ((oa[u] == ob[v]) & (ea[u] > eb[v]))
        yield one, two, u, v, np.where(swap, eb[v], ea[u]), np.where(swap, ea[u], eb[v]), {c: m[found] for c, m in met.items()}, {c: d[found] for c, d in dots.items()}


def similarities(part: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """By strip: i, j, whether of one relation, and the similarities of both sides.

    They have nine decimals, so that equal ones stay equal in whatever order their parts were summed."""
    for one, two, u, v, i, j, _, dots in products(part):
        sims = []
        for c in SIDES:
            scale = one.norms[c][u] * two.norms[c][v]
            sims.append(np.round(np.divide(dots[c], scale, out=np.zeros(len(u)), where=scale > 0), 9))
        yield i, j, one.column("rt")[u] == two.column("rt")[v], *sims


def _table(parts: list[dict], names: list[str], types: list[pa.DataType]) -> pa.Table:
    return pa.table({c: pa.array(np.concatenate([p[c] for p in parts]) if parts else [], t) for c, t in zip(names, types, strict=True)})


def _map(side_rows: DataFrame, same: bool, block: int, function, schema: str) -> DataFrame:
    return block_pairs(side_rows, same, block).groupBy("groupe", "a", "b").applyInArrow(function, schema)


def gram(side_rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """(rt, cote, i, j, produit) of the pairs i <= j (by order) of all examples of one relation that share a symbol."""

    def run(key: tuple, part: pa.Table) -> pa.Table:
        out = {"L": [], "R": []}
        for _, _, _, _, i, j, met, dots in products(part):
            for c in SIDES:
                out[c].append({"i": i[met[c]], "j": j[met[c]], "produit": dots[c][met[c]]})
        tables = [_table(out[c], ["i", "j", "produit"], [pa.int64(), pa.int64(), pa.float64()]) for c in SIDES]
        named = [t.add_column(0, "cote", pa.repeat(c, len(t))).add_column(0, "rt", pa.repeat(key[0], len(t))) for c, t in zip(SIDES, tables)]
        return pa.concat_tables(named)

    own = side_rows.groupBy("rt", "cote", "ex").agg(F.sum(F.col("poids") * F.col("poids")).alias("produit")).select("rt", "cote", F.col("ex").alias("i"), F.col("ex").alias("j"), "produit")
    return _map(side_rows, True, block, run, "rt string, cote string, i bigint, j bigint, produit double").unionByName(own)


def links(side_rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """(rt, i, j, sim_l, sim_r, lien, score) of the pairs of different examples of one relation that share a symbol."""

    def run(key: tuple, part: pa.Table) -> pa.Table:
        parts = [{"i": i, "j": j, "sim_l": left, "sim_r": right} for i, j, _, left, right in similarities(part)]
        t = _table(parts, ["i", "j", "sim_l", "sim_r"], [pa.int64(), pa.int64(), pa.float64(), pa.float64()])
        return t.add_column(0, "rt", pa.repeat(key[0], len(t)))

    found = _map(side_rows, True, block, run, "rt string, i bigint, j bigint, sim_l double, sim_r double")
    return found.withColumn("lien", F.least("sim_l", "sim_r")).withColumn("score", 0.5 * (F.col("sim_l") + F.col("sim_r")))


def threshold_counts(side_rows: DataFrame, thresholds: list[float], block: int = BLOCK) -> DataFrame:
    """(meme, seuil, n, n_deux, n_moyenne) of all pairs that share a symbol: those over each threshold on both sides, and in the mean (six decimals)."""

    def run(key: tuple, part: pa.Table) -> pa.Table:
        counts = np.zeros((2, len(thresholds), 3), dtype=np.int64)
        for _, _, same, left, right in similarities(part):
            for m in (0, 1):
                lien, score = (np.round(x[same == m], 6) for x in (np.minimum(left, right), 0.5 * (left + right)))
                for k, t in enumerate(thresholds):
                    counts[m, k] += len(lien), (lien > t).sum(), (score > t).sum()
        rows = [{"meme": bool(m), "seuil": t, "n": int(c[0]), "n_deux": int(c[1]), "n_moyenne": int(c[2])} for m in (0, 1) for t, c in zip(thresholds, counts[m]) if c[0]]
        return pa.Table.from_pylist(rows, schema=pa.schema([("meme", pa.bool_()), ("seuil", pa.float64()), *((c, pa.int64()) for c in ("n", "n_deux", "n_moyenne"))]))

    each = _map(side_rows, False, block, run, "meme boolean, seuil double, n bigint, n_deux bigint, n_moyenne bigint")
    return each.groupBy("meme", "seuil").agg(*[F.sum(c).alias(c) for c in ("n", "n_deux", "n_moyenne")])


def score_counts(side_rows: DataFrame, exact: dict[bool, list[int]] | None = None, block: int = BLOCK) -> DataFrame:
    """(meme, bac, score, n, hauts): how many pairs that share a symbol have a score in each bin and how many over one half;
    of the bins in ``exact`` every score (and no other bin), else the middle of the bin."""

    def run(key: tuple, part: pa.Table) -> pa.Table:
        out = []
        for _, _, same, left, right in similarities(part):
            score = np.round(0.5 * (left + right), 9)
            bins = (score * BINS).astype(np.int64)
            for m in (False, True):
                s, b = score[same == m], bins[same == m]
                if exact is None:
                    out.append((m, b, (s > 0.5)))
                elif m in exact:
                    hit = np.isin(b, exact[m])
                    out.append((m, s[hit], s[hit] > 0.5))
        rows = []
        for m in (False, True):
            mine = [x for x in out if x[0] == m]
            if not mine:
                continue
            values, at, n = np.unique(np.concatenate([x[1] for x in mine]), return_inverse=True, return_counts=True)
            high = np.bincount(at, np.concatenate([x[2] for x in mine]), len(values)).astype(np.int64)
            bins = values if exact is None else (values * BINS).astype(np.int64)
            score = (values + 0.5) / BINS if exact is None else values
            rows.append(pa.table({"meme": pa.repeat(m, len(values)), "bac": pa.array(bins, pa.int64()), "score": pa.array(score, pa.float64()), "n": pa.array(n, pa.int64()), "hauts": pa.array(high, pa.int64())}))
        return pa.concat_tables(rows) if rows else pa.schema([("meme", pa.bool_()), ("bac", pa.int64()), ("score", pa.float64()), ("n", pa.int64()), ("hauts", pa.int64())]).empty_table()

    each = _map(side_rows, False, block, run, "meme boolean, bac bigint, score double, n bigint, hauts bigint")
    return each.groupBy("meme", "bac", "score").agg(F.sum("n").alias("n"), F.sum("hauts").alias("hauts"))


def score_percentiles(side_rows: DataFrame, shares: dict[str, float], block: int = BLOCK) -> DataFrame:
    """(meme, n, part_haute, and each share's exact percentile of the scores).

    A first pass counts bins, a second takes every score of the few bins that the percentiles fall in."""
    binned = score_counts(side_rows, None, block).collect()  # at most BINS rows each
    wanted: dict[bool, list[int]] = {}
    for m in (False, True):
        mine = sorted((r["bac"], r["n"]) for r in binned if r["meme"] == m)
        if mine:
            ends = np.cumsum([n for _, n in mine])
            ranks = {int(f(p * (ends[-1] - 1))) for p in shares.values() for f in (np.floor, np.ceil)}
            wanted[m] = sorted({mine[int(np.searchsorted(ends, r, "right"))][0] for r in ranks})
    rest = [tuple(r) for r in binned if r["bac"] not in wanted[r["meme"]]]
    other = side_rows.sparkSession.createDataFrame(rest, "meme boolean, bac bigint, score double, n bigint, hauts bigint")
    every = score_counts(side_rows, wanted, block).unionByName(other)
    return every.groupBy("meme").agg(F.sum("n").alias("n"), (F.sum("hauts") / F.sum("n")).alias("part_haute"), *[F.percentile("score", F.lit(p), F.col("n")).alias(c) for c, p in shares.items()])
