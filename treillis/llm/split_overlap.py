"""Problem 6: records of the evaluation splits that also stand, the same or nearly so, in training.

A text within EDITS edits of another holds one of its EDITS + 1 even segments unchanged, near the segment's place. The
evaluation texts go to shards by their segments, and a training text only to the shards that have a segment it may
hold, a fixed number whatever the size of the tables. A task builds the compressed full-text index of a shard once and
streams the training texts through it by backward search: each is cut from its end into matches, each as long as it
still has more than a few places; a text within EDITS edits holds one of EDITS + 1 disjoint matches unchanged at nearly
the same place. The places are merged to candidate pairs, and those are confirmed with a banded edit distance. (Matches
of the greatest length would miss pairs whose shared part is longer elsewhere, so they end where few places are
left.) Pairs of fields that must be equal are searched whole, between separators. Texts too short for segments meet by
what is left of them without up to EDITS letters. Equal texts are searched once and their records joined at the end.

Where a frequent part makes too many places, the matches grow beyond it into rarer letters; only if a text
has too few rare letters for EDITS + 1 matches, more places are allowed (four times as many each time), so
that no pair is lost. A segment of so many texts that they exceed a shard has shards of its own.

Defined cases: null texts have no pair; the empty text is compared like any other; rows of no split, and
empty or null fields of the pair condition, match nothing; texts of any length are compared whole.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treillis.llm.bitmap import maybe_in
from treillis.llm.canonical import consistent
from treillis.llm.fm_index import FmIndex
from treillis.session import bound_arrow_batches, cut

EDITS = 2
#: Places a match may have at first, code points of a shard, training texts that one index serves, texts below that have
#: no segments, and pairs compared at once.
PLACES, SHARD, STREAM, SHORT, AT_ONCE = 8, 400_000, 100_000, 9, 50_000
TEXT, PAIR = "texte", "paire"


def compared(value: Column) -> Column:
    """Consistent form, lower case, runs of anything but letters and digits as one space, ends trimmed."""
    return F.trim(F.regexp_replace(F.lower(consistent(value)), r"[^\p{L}\p{Nd}]+", " "))


def within(a: np.ndarray, la: np.ndarray, b: np.ndarray, lb: np.ndarray, edits: int = EDITS) -> np.ndarray:
    """Whether rows of codes are within so many edits, for all rows at once: the diagonals of the edit matrix."""
    far, width = edits + 1, 2 * edits + 1
    n = len(a)
    d = np.full((n, width), far, dtype=np.int8)  # d[:, k] is cell (i, i + k - edits)
    d[:, edits:] = np.arange(edits + 1)
    padded = np.full((n, a.shape[1] + 2 * edits + 1), -1, dtype=b.dtype)
    m = min(b.shape[1], padded.shape[1] - edits)
    padded[:, edits : edits + m] = b[:, :m]
    result = np.full(n, far, dtype=np.int8)

    def read(i: int) -> None:
        end = np.flatnonzero(la == i)
        k = lb[end] - i + edits
        fits = (k >= 0) & (k < width)
        result[end[fits]] = d[end[fits], k[fits]]

    read(0)
    for i in range(1, int(la.max(initial=0)) + 1):
        new = np.full_like(d, far)
        for k in range(width):
            j = i + k - edits
            if j < 0:
                continue
            best = np.full(n, far, dtype=np.int8)
            if j > 0:
                best = d[:, k] + (a[:, i - 1] != padded[:, edits + j - 1])
                if k > 0:
                    best = np.minimum(best, new[:, k - 1] + 1)
            if k + 1 < width:
                best = np.minimum(best, d[:, k + 1] + 1)
            new[:, k] = np.minimum(best, far)
        d = new
        read(i)
    return result <= edits


def matches(index: FmIndex, rows: np.ndarray, lengths: np.ndarray, parts: int, places: int) -> tuple[np.ndarray, ...]:
    """Backward search of rows between separators: (row, start, low, high) of ``parts`` disjoint matches each
    with at most so many places, and the rows that have too few."""
    n = len(rows)
    at = lengths - 2  # the letter to take next; separators aren't taken
    low, high = np.zeros(n, np.int64), np.full(n, index.n, np.int64)
    got = np.zeros(n, np.int64)
    out: list[tuple[np.ndarray, ...]] = []
    live = np.flatnonzero(at >= 1)
    while len(live):
        low[live], high[live] = index.step(rows[live, at[live]], low[live], high[live])
        rare = live[high[live] - low[live] <= places]
        if len(rare):
            out.append((rare, at[rare] - 1, low[rare].copy(), high[rare].copy()))
            low[rare], high[rare] = 0, index.n
            got[rare] += 1
        at[live] -= 1
        live = live[(at[live] >= 1) & (got[live] < parts)]
    few = np.flatnonzero(got < parts)
    if out:
        row, start, lo, hi = (np.concatenate(x) for x in zip(*out))
        keep = (got[row] >= parts) & (hi > lo)
        return row[keep], start[keep], lo[keep], hi[keep], few
    return (np.zeros(0, np.int64),) * 4 + (few,)


def near(index: FmIndex, texts: list[str], targets: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of texts and indexed targets within EDITS edits of each other."""
    rows, lengths = index.encode(texts)
    target_rows = index.encode(targets)[0][:, 1:]
    found: list[np.ndarray] = []
    left, places = np.arange(len(texts)), PLACES
    while len(left):
        if places >= index.n:  # fewer letters than matches: every target of fitting length is a candidate
            for text in left.tolist():
                for y in np.array_split(np.flatnonzero(np.abs(lengths[text] - 2 - index.lengths) <= EDITS), -(-len(targets) // AT_ONCE)):
                    x = np.full(len(y), text)
                    found.append(text * len(targets) + y[within(rows[x, 1:], lengths[x] - 2, target_rows[y], index.lengths[y])])
            break
        row, start, low, high, few = matches(index, rows[left], lengths[left], EDITS + 1, places)
        which, y, place = index.ranges_to_places(low, high)
        x = left[row[which]]
        close = np.abs(place - start[which]) <= EDITS
        x, y = x[close], y[close]
        fits = np.abs(lengths[x] - 2 - index.lengths[y]) <= EDITS
        pair = np.unique(x[fits] * len(targets) + y[fits])
        for part in np.array_split(pair, -(-len(pair) // AT_ONCE) or 1):
            x, y = part // len(targets), part % len(targets)
            found.append(part[within(rows[x, 1:], lengths[x] - 2, target_rows[y], index.lengths[y])])
        left, places = left[few], places * 4
    pair = np.concatenate(found) if found else np.zeros(0, np.int64)
    return pair // max(1, len(targets)), pair % max(1, len(targets))


def equal(index: FmIndex, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of texts and of the indexed targets that equal them."""
    rows, lengths = index.encode(texts)
    at, n = lengths - 1, len(rows)
    low, high = np.zeros(n, np.int64), np.full(n, index.n, np.int64)
    live = np.arange(n)
    while len(live):
        low[live], high[live] = index.step(rows[live, at[live]], low[live], high[live])
        at[live] -= 1
        live = live[(at[live] >= 0) & (high[live] > low[live])]
    which, y, _ = index.ranges_to_places(low, np.maximum(high, low))
    return which, y + 0


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shards one after the other, each with its evaluation texts (``cote`` b) first, then its training texts."""
    shard, targets, index = None, [], None
    for batch in batches:
        keys = list(zip(*(batch.column(k).to_pylist() for k in range(4))))
        sides = batch.column(4).to_pylist()
        ends = [k for k in range(1, len(keys)) if keys[k] != keys[k - 1] or sides[k] != sides[k - 1]]
        for a, b in zip([0, *ends], [*ends, len(keys)]):
            if not len(keys):
                continue
            if keys[a] != shard:
                shard, targets, index = keys[a], [], None
            texts = batch.column(5).slice(a, b - a)
            if sides[a] == 0:
                targets += texts.to_pylist()
                continue
            if not targets:
                continue
            index = index or FmIndex(targets)
            x, y = near(index, texts.to_pylist(), targets) if shard[0] == TEXT else equal(index, texts.to_pylist())
            yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(shard[0]), len(x)), texts.take(pa.array(x)), pa.array([targets[k] for k in y.tolist()], pa.string())], names=["champ", "texte_a", "texte_b"])


def _bound(length: Column, k: int) -> Column:
    """Where segment k of a text begins."""
    return F.floor(length * k / (EDITS + 1)).cast("int")


def segments(text: Column, length: Column) -> Column:
    """Digests of the EDITS + 1 even segments of a text, with its length and the segment's number."""
    cut_ = lambda k: F.substring(text, _bound(length, k) + 1, _bound(length, k + 1) - _bound(length, k))
    return F.array(*[F.xxhash64(F.lit(TEXT), length, F.lit(k), cut_(k)) for k in range(EDITS + 1)])


def held_segments(text: Column, length: Column) -> Column:
    """Digests of the segments that a text within EDITS edits may share with this one.

    With d letters more than the other, segment k may stand up to k places off its place, and up to EDITS - k places off
    where it would be if all d letters came before it; one unchanged segment is within both."""
    out = []
    for d in range(-EDITS, EDITS + 1):
        other = length - d
        for k in range(EDITS + 1):
            size = _bound(other, k + 1) - _bound(other, k)
            for off in range(max(-k, d - (EDITS - k)), min(k, d + (EDITS - k)) + 1):
                at = _bound(other, k) + off
                fits = (other >= SHORT) & (at >= 0) & (at + size <= length)
                out.append(F.when(fits, F.xxhash64(F.lit(TEXT), other, F.lit(k), F.substring(text, at + 1, size))))
    return F.array_distinct(F.array_compact(F.array(*out)))


def shortened(text: Column, length: Column) -> Column:
    """What is left of a text without up to two letters (EDITS)."""
    left = lambda i, j: F.concat(F.substring(text, F.lit(1), i - 1), F.substring(text, i + 1, j - i - 1), F.substring(text, j + 1, length))
    places = lambda i: F.sequence(i, length)
    both = F.flatten(F.transform(places(F.lit(1)), lambda i: F.transform(places(i), lambda j: left(i, j))))
    return F.array_distinct(F.concat(F.array(text), F.when(length > 0, both).otherwise(F.array().cast("array<string>"))))


class SplitOverlap:
    """The overlap between training and evaluation rows of a table with a text and two fields."""

    def __init__(self, rows: DataFrame, key: str, text: str, pair: tuple[str, str], split: str, train: str = "train", others: tuple[str, ...] = ("val", "test")):
        bound_arrow_batches(rows.sparkSession)
        self.rows, self.key, self.split = rows, key, split
        a, b = (compared(F.col(c)) for c in pair)
        side = F.when(F.col(split) == train, "a").when(F.col(split).isin(*others), "b")
        ready = rows.select(F.col(key).alias("_id"), side.alias("cote"), compared(F.col(text)).alias("_t"), a.alias("_a"), b.alias("_b")).filter("cote is not null")
        both = F.when((F.col("_a") != "") & (F.col("_b") != ""), F.concat_ws("\x02", "_a", "_b"))
        self.members = cut(
            ready.select("_id", "cote", F.explode(F.array(F.struct(F.lit(TEXT).alias("champ"), F.col("_t").alias("texte")), F.struct(F.lit(PAIR).alias("champ"), both.alias("texte")))).alias("p"))
            .select("_id", "cote", "p.champ", "p.texte")
            .filter("texte is not null")
        )

    def text_pairs(self) -> DataFrame:
        """``champ``, ``texte_a`` (training) and ``texte_b`` (evaluation) of every match between different rows' texts."""
        texts = cut(self.members.select("champ", "cote", "texte").distinct().withColumn("l", F.length("texte")))
        text, l = F.col("texte"), F.col("l")  # noqa: E741
        trains, evals = texts.filter("cote = 'a'"), texts.filter("cote = 'b'")
        whole = F.array(F.xxhash64("champ", "texte"))
        none = F.array().cast("array<bigint>")
        of_eval = F.when(F.col("champ") != TEXT, whole).when(l >= SHORT, segments(text, l)).otherwise(none)
        of_train = F.when(F.col("champ") != TEXT, whole).when(l >= SHORT - EDITS, held_segments(text, l)).otherwise(none)
        own = cut(evals.select("champ", "texte", "l", F.explode(of_eval).alias("cle")))
        sizes = own.groupBy("champ", "cle").agg(F.sum(l + 1).alias("lettres"))
        maybe = maybe_in(trains.select("champ", "texte", F.explode(of_train).alias("cle")), "cle", own, "cle")
        held = cut(maybe.join(sizes.select("champ", "cle"), ["champ", "cle"], "left_semi"))
        asked = held.groupBy("champ", "cle").agg(F.count("*").alias("demandes"))
        totals = sizes.join(asked, ["champ", "cle"]).agg(F.coalesce(F.sum("lettres"), F.lit(0)).alias("x"), F.coalesce(F.sum("demandes"), F.lit(0)).alias("y")).first()
        shards = max(1, -(-totals["x"] // SHARD), -(-totals["y"] // STREAM))
        parts, streams = F.ceil(F.col("lettres") / SHARD).cast("int"), F.ceil(F.col("demandes") / STREAM).cast("int")
        plan = cut(
            sizes.join(asked, ["champ", "cle"]).withColumn("parts", parts).withColumn("flux", streams)
            .withColumn("eclat", F.when((F.col("parts") > 1) | (F.col("flux") > 1), F.col("cle")).otherwise(F.pmod("cle", F.lit(shards))))
            .select("champ", "cle", "eclat", "parts", "flux")
        )
        number = lambda of: F.pmod(F.xxhash64("texte"), F.col(of)).cast("int")
        every = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
        shard = ["champ", "eclat", "part", "flux", "cote", "texte"]
        right = own.join(plan, ["champ", "cle"]).withColumn("part", number("parts")).withColumn("_f", every("flux")).select("champ", "eclat", "part", F.col("_f").alias("flux"), F.lit(0).alias("cote"), "texte")
        left = held.join(plan, ["champ", "cle"]).withColumn("_f", number("flux")).withColumn("part", every("parts")).select("champ", "eclat", "part", F.col("_f").alias("flux"), F.lit(1).alias("cote"), "texte")
        # A stated number of partitions, as searching costs more than the few bytes of a shard suggest.
        tasks = max(shards, int(self.rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        rows = right.union(left).distinct().repartition(tasks, *shard[:4]).sortWithinPartitions(*shard[:5])
        found = rows.select(*shard).mapInArrow(_search, "champ string, texte_a string, texte_b string")
        brief = lambda t, n, name: t.filter((F.col("champ") == TEXT) & (l < n)).select(text.alias(name), F.explode(shortened(text, l)).alias("_v"))
        near_ = maybe_in(brief(trains, SHORT + EDITS, "texte_a"), "_v", brief(evals, SHORT, "texte_b"), "_v").join(brief(evals, SHORT, "texte_b"), "_v").select("texte_a", "texte_b").distinct().filter(F.levenshtein("texte_a", "texte_b", EDITS) >= 0)
        return cut(found.distinct().union(near_.select(F.lit(TEXT).alias("champ"), "texte_a", "texte_b")))

    def pairs(self, names: tuple[str, str]) -> DataFrame:
        """Every pair of a training row and an evaluation row, the smaller key first."""
        a = self.members.filter("cote = 'a'").select(F.col("_id").alias("_a"), "champ", F.col("texte").alias("texte_a"))
        b = self.members.filter("cote = 'b'").select(F.col("_id").alias("_b"), "champ", F.col("texte").alias("texte_b"))
        both = self.text_pairs().join(a, ["champ", "texte_a"]).join(b, ["champ", "texte_b"])
        return both.select(F.least("_a", "_b").alias(names[0]), F.greatest("_a", "_b").alias(names[1])).distinct()

    def report(self, *by: str) -> DataFrame:
        """Rows of the evaluation splits, and how many of them stand in training, by the given columns; no pairs are made."""
        hit = self.text_pairs().select("champ", F.col("texte_b").alias("texte")).distinct()
        rows = self.members.filter("cote = 'b'").join(hit, ["champ", "texte"])
        marks = rows.groupBy("_id").agg(F.max(F.when(F.col("champ") == TEXT, 1).otherwise(0)).alias("_t"), F.max(F.when(F.col("champ") == PAIR, 1).otherwise(0)).alias("_p"))
        evals = self.rows.join(self.members.filter("cote = 'b'").select("_id").distinct(), F.col(self.key) == F.col("_id"), "left_semi")
        return evals.join(marks, F.col(self.key) == F.col("_id"), "left").groupBy(*by).agg(F.count("*").alias("n_lignes"), F.count("_id").alias("n_trouvees"), F.coalesce(F.sum("_t"), F.lit(0)).alias("n_par_texte"), F.coalesce(F.sum("_p"), F.lit(0)).alias("n_par_paire"))
