"""Problem 10: long passages that stand verbatim in more than one record.

Compact windows: over the hashes of all grams of a text, a node of the Cartesian tree (smallest hash at
the root, leftmost of equals) is the gram that has the least hash in a whole interval of subsequences.
The nodes whose interval is at least as wide as a span cover every span, about 2 / width of them a
character; they are found without building the tree, as the least grams of block prefixes and suffixes. A passage standing in two records has the same least gram in both, so the join on that gram's
hash loses no passage, and as the records agree on the passage word for word, one hash function decides as
well as many. The interval of a node is joined with its equals as a whole (digest of its text); intervals
that share their gram but not their text are compared by hashes of shorter spans, and only where those agree span by span.

Defined cases: null texts and texts shorter than a span have no passage; a passage repeated only within
one record isn't shared; a long text is worked on in overlapping parts and keeps every span; equal texts of
two records are wholly shared; columns other than key and text are not read.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from treillis.llm.bitmap import maybe_in
from treillis.session import bound_arrow_batches, cut

#: Least length of a passage and length of the grams hashed, in code points.
SPAN, GRAM = 200, 40
#: Code points worked on at once; positions must fit the low bits of a packed hash.
SLAB_BITS = 19
SLAB = 1 << SLAB_BITS

_BASE_1, _BASE_2 = 0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1
_C1, _C2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S33 = np.uint64(33)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _S33)) * _C1
    x = (x ^ (x >> _S33)) * _C2
    return x ^ (x >> _S33)


class _Roll:
    """Hashes of any slice of a text from sums of weighted code points, modulo 2**64."""

    tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, values: np.ndarray, base: int):
        n = len(values)
        up, down = self.tables.get(base, (np.ones(1, np.uint64),) * 2)
        if len(up) <= n:
            size = max(SLAB + SPAN, n) + 1
            inverse = pow(base, -1, 1 << 64)
            up, down = (np.concatenate((np.ones(1, np.uint64), np.full(size, b, np.uint64))).cumprod() for b in (base, inverse))
            self.tables[base] = up, down
        self.down = down
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values * up[:n])))

    def every(self, length: int) -> np.ndarray:
        n = len(self.sums) - length
        return (self.sums[length:] - self.sums[:n]) * self.down[:n]

    def slices(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.down[start]


def _codes(text: str) -> np.ndarray:
    return _mix(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64) + np.uint64(1))


def compact_windows(values: np.ndarray, doc: np.ndarray, span: int, gram: int) -> tuple[np.ndarray, ...]:
    """The compact windows at least a span wide in a slab of texts: anchor hash, digest, first and last span start.

    ``doc`` has the text of each character. The nodes of the Cartesian tree that are wide enough are those
    that are least in some span, so prefix and suffix minima of blocks find them in linear time."""
    wide = span - gram + 1
    n = len(values) - span + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 4
    roll = _Roll(values, _BASE_1)
    grams = _mix(roll.every(gram))
    low = np.uint64((1 << SLAB_BITS) * 2 - 1)
    packed = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    blocks = np.full(-(-len(packed) // wide) * wide, np.iinfo(np.uint64).max, np.uint64)
    blocks[: len(packed)] = packed
    blocks = blocks.reshape(-1, wide)
    before = np.minimum.accumulate(blocks, axis=1).ravel()
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    at = (np.minimum(after[:n], before[wide - 1 : wide - 1 + n]) & low).astype(np.int64)
    at[doc[:n] != doc[span - 1 :]] = -1  # spans of two texts
    change = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (doc[1:n] != doc[: n - 1]))))
    first, last = change, np.append(change[1:], n) - 1
    keep = at[first] >= 0
    first, last = first[keep], last[keep]
    digest = _mix(_Roll(values, _BASE_2).slices(first, last + span) + (last - first).astype(np.uint64))
    return grams[at[first]].view(np.int64), digest.view(np.int64), first, last


def _slabs(keys: pa.Array, texts: pa.Array, span: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]]:
    """Slabs of texts: hashed characters, text number and offset of each character's text part, keys of the texts."""
    parts: list[tuple[int, int, str]] = []
    size = 0

    def out():
        lengths = np.array([len(p[2]) for p in parts])
        number = np.repeat(np.arange(len(parts)), lengths)
        start = np.cumsum(lengths) - lengths
        return _codes("".join(p[2] for p in parts)), number, np.array([p[1] for p in parts]) - start, keys.take(pa.array([p[0] for p in parts], pa.int64()))

    for k, value in enumerate(texts):
        text = value.as_py()
        if text is None or len(text) < span:
            continue
        for a in range(0, len(text) - span + 1, SLAB):
            part = text[a : a + SLAB + span - 1]
            if parts and size + len(part) > SLAB:
                yield out()
                parts, size = [], 0
            parts.append((k, a, part))
            size += len(part)
    if parts:
        yield out()


def windows_of(documents: DataFrame, key: str = "doc_id", text: str = "text", span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """One row for each compact window: ``doc``, ``ancre``, ``empreinte``, and the first and last start of its spans."""
    bound_arrow_batches(documents.sparkSession)
    kind = documents.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for values, number, offset, keys in _slabs(batch.column(0), batch.column(1), span):
                anchor, digest, first, last = compact_windows(values, number, span, gram)
                which = number[first]
                yield pa.RecordBatch.from_arrays(
                    [keys.take(pa.array(which)), pa.array(anchor), pa.array(digest), pa.array((first + offset[which]).astype(np.int32)), pa.array((last + offset[which]).astype(np.int32))],
                    names=["doc", "ancre", "empreinte", "de", "a"],
                )

    long = documents.filter(F.length(text) >= span).select(key, text)
    return long.mapInArrow(run, f"doc {kind}, ancre bigint, empreinte bigint, de int, a int")


def _texts_of(wanted: DataFrame, documents: DataFrame, key: str, text: str) -> DataFrame:
    """The texts (``_t``) of the records with wanted windows, and those windows (``_w``).

    A bitmap of hashed keys goes to every task, so that texts nobody asks for aren't shuffled."""
    some = maybe_in(documents.select(F.col(key).alias("doc"), F.col(text).alias("_t")), "doc", wanted, "doc")
    lists = wanted.groupBy("doc").agg(F.collect_list(F.struct(*[c for c in wanted.columns if c != "doc"])).alias("_w"))  # bounded by one text
    return some.join(lists, "doc").select("_t", "_w")


def _step(span: int, gram: int) -> int:
    """Distance of the shorter spans that are compared before whole ones."""
    return max(1, (span - gram) // 8)


def _coarse(texts: DataFrame, kind: str, span: int, gram: int) -> DataFrame:
    """Hashes (``gros``) of every STEP-th shorter span of the given windows, counted from the anchor, with their ``place``:
    a shared span holds one that both records hash alike."""
    step = _step(span, gram)
    short = span - step + 1
    kept = ["ancre", "empreinte", "bas", "haut", "ouvert"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, want in zip(batch.column(0), batch.column(1)):
                flat, body = want.values, text.as_py()
                places, hashes = [], []
                for x, y in zip(flat.field("de").to_pylist(), flat.field("a").to_pylist()):
                    values = _codes(body[x : y + span])
                    roll = _Roll(values, _BASE_1)
                    anchor = int((_mix(roll.every(gram)) >> np.uint64(SLAB_BITS + 1)).argmin())
                    at = np.arange(anchor % step, len(values) - short + 1, step)
                    places.append(at)
                    hashes.append(_mix(roll.slices(at, at + short)))
                row = pa.array(np.repeat(np.arange(len(flat)), [len(p) for p in places]))
                columns = [flat.field(c).take(row) for c in kept]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(np.concatenate(hashes).view(np.int64)), pa.array(np.concatenate(places).astype(np.int32))], names=[*kept, "gros", "place"])

    return texts.mapInArrow(run, f"ancre bigint, empreinte bigint, bas {kind}, haut {kind}, ouvert boolean, gros bigint, place int")


def _fine(texts: DataFrame, kind: str, span: int, gram: int) -> DataFrame:
    """Hashes (``passage``) of the spans of the given windows that hold a shorter span at one of the ``grille``, by ``ecart``
    from the window's first."""
    step = _step(span, gram)
    kept = ["ancre", "empreinte", "bas", "haut", "ouvert"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, want in zip(batch.column(0), batch.column(1)):
                flat, body = want.values, text.as_py()
                starts, hashes = [], []
                for x, y, grid in zip(flat.field("de").to_pylist(), flat.field("a").to_pylist(), flat.field("grille").to_pylist()):
                    values = _codes(body[x : y + span])
                    near = (np.array(grid)[:, None] - np.arange(step)).ravel()
                    near = np.unique(near[(near >= 0) & (near <= y - x)])
                    starts.append(near)
                    hashes.append(_mix(_Roll(values, _BASE_2).slices(near, near + span)))
                row = pa.array(np.repeat(np.arange(len(flat)), [len(p) for p in starts]))
                columns = [flat.field(c).take(row) for c in kept]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(np.concatenate(starts).astype(np.int32)), pa.array(np.concatenate(hashes).view(np.int64))], names=[*kept, "ecart", "passage"])

    return texts.mapInArrow(run, f"ancre bigint, empreinte bigint, bas {kind}, haut {kind}, ouvert boolean, ecart int, passage bigint")


def _of_two(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The keys that two records or more have, at least one of them in an open window."""
    return rows.groupBy(*keys).agg(F.min("bas").alias("_b"), F.max("haut").alias("_h"), F.max("ouvert").alias("_o")).filter("_b <> _h and _o").select(*keys)


class SharedSpans:
    """The shared passages of a table of texts; the parts common to its queries.

    The windows of all texts are worked out twice, once to find the anchors of more than one record and
    once to keep the windows of those, as that is cheaper than to store or sort all of them."""

    def __init__(self, documents: DataFrame, key: str = "doc_id", text: str = "text", span: int = SPAN, gram: int = GRAM):
        self.documents, self.key, self.text, self.span, self.gram = documents, key, text, span, gram
        every = windows_of(documents, key, text, span, gram)
        # The smallest and largest record tell whether there are two; they are summed before the shuffle.
        anchors = every.groupBy("ancre").agg(F.min("doc").alias("_b"), F.max("doc").alias("_h")).filter("_b <> _h").select("ancre")
        self.windows = cut(every.join(anchors, "ancre"))
        self.groups = cut(
            self.windows.groupBy("ancre", "empreinte").agg(F.min("doc").alias("bas"), F.max("doc").alias("haut"), F.min(F.struct("doc", "de", "a")).alias("ici"))
        )

    def whole(self) -> DataFrame:
        """Windows that stand as a whole in two records or more."""
        return self.windows.join(self.groups.filter("bas <> haut").select("ancre", "empreinte"), ["ancre", "empreinte"], "left_semi")

    def spans(self, known: DataFrame | None = None) -> DataFrame:
        """Single shared spans of windows that share their anchor, not their text, with another record.

        ``known`` has records (``doc``) whose own spans aren't asked for. Coarse hashes, of which there are few,
        tell which spans are worth comparing."""
        groups, own = self.groups.withColumn("ouvert", F.col("bas") == F.col("haut")), ["ancre", "empreinte"]
        if known is not None:
            told = known.select(F.col("doc").alias("bas"), F.lit(True).alias("_k"))
            groups = groups.join(told, "bas", "left").withColumn("ouvert", F.col("ouvert") & F.col("_k").isNull())
        several = groups.groupBy("ancre").agg(F.count("*").alias("_n"), F.max("ouvert").alias("_o")).filter("_n > 1 and _o").select("ancre")
        partial = cut(groups.join(several, "ancre").select(*own, "bas", "haut", "ouvert", "ici.doc", "ici.de", "ici.a"))
        kind = self.documents.schema[self.key].dataType.simpleString()
        texts = lambda wanted: _texts_of(wanted, self.documents, self.key, self.text)
        coarse = cut(_coarse(texts(partial), kind, self.span, self.gram))
        alike = coarse.join(_of_two(coarse, ["ancre", "gros"]), ["ancre", "gros"], "left_semi").groupBy(*own).agg(F.collect_set("place").alias("grille"))  # a few of one window
        near = cut(partial.join(alike, own))
        single = cut(_fine(texts(near), kind, self.span, self.gram))
        # A span is needed only where its own window isn't shared as a whole.
        return single.filter("ouvert").join(_of_two(single, ["ancre", "passage"]), ["ancre", "passage"], "left_semi")

    def found(self) -> DataFrame:
        """Each record that holds a shared passage."""
        whole = cut(self.whole().select("doc").distinct())
        return whole.union(self.spans(whole).select(F.col("bas").alias("doc"))).distinct().select(F.col("doc").alias(self.key))

    def passages(self) -> DataFrame:
        """The maximal shared passages of each record: ``debut`` and ``fin`` (exclusive) in code points."""
        whole = self.whole().select("doc", "de", (F.col("a") + self.span).alias("fin"))
        steps = Window.partitionBy("ancre", "empreinte").orderBy("ecart")  # at most a span's spans
        runs = (
            self.spans()
            .select("ancre", "empreinte", "ecart")
            .distinct()
            .withColumn("_g", F.col("ecart") - F.row_number().over(steps))
            .groupBy("ancre", "empreinte", "_g")
            .agg(F.min("ecart").alias("_x"), F.max("ecart").alias("_y"))
        )
        part = self.windows.join(runs, ["ancre", "empreinte"]).select("doc", (F.col("de") + F.col("_x")).alias("de"), (F.col("de") + F.col("_y") + self.span).alias("fin"))
        order = Window.partitionBy("doc").orderBy("de", "fin")
        reach = F.max("fin").over(order.rowsBetween(Window.unboundedPreceding, -1))
        return (
            whole.union(part)
            .withColumn("_neuf", F.coalesce((F.col("de") > reach).cast("int"), F.lit(1)))
            .withColumn("_p", F.sum("_neuf").over(order.rowsBetween(Window.unboundedPreceding, 0)))
            .groupBy("doc", "_p")
            .agg(F.min("de").alias("debut"), F.max("fin").alias("fin"))
            .select(F.col("doc").alias(self.key), "debut", "fin")
        )

    def shares(self) -> DataFrame:
        """For each record its length and how many of its characters stand in a shared passage."""
        sums = self.passages().groupBy(self.key).agg(F.sum(F.col("fin") - F.col("debut")).alias("n_partages"), F.count("*").alias("n_passages"))
        return (
            self.documents.select(self.key, F.length(self.text).alias("n_caracteres"))
            .join(sums, self.key, "left")
            .select(self.key, "n_caracteres", F.coalesce("n_partages", F.lit(0)).alias("n_partages"), F.coalesce("n_passages", F.lit(0)).alias("n_passages"))
        )
