"""Problem 8: the ids of whole texts under a public byte-level BPE vocabulary.

Texts stay in Arrow buffers. The split into pre-tokens is computed on arrays of character classes,
not with a regular expression per text. Tier one looks every pre-token up in a minimal perfect hash
of the vocabulary and compares its bytes; tier two merges the others with a heap over linked bytes,
once per distinct pre-token of a worker's memory.

Defined cases: null and empty texts have no ids; the names of special tokens are ordinary text; rows
repeat as they are in the input; other columns are not read.
"""
from __future__ import annotations

import base64
import hashlib
import heapq
import os
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treillis.session import bound_arrow_batches

#: Folder of the public vocabularies and the vocabulary used unless told otherwise.
TOKENIZER_DIR = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Bytes worked on at once in a Python worker; a text beyond it is cut where the split is certain.
SLAB_BYTES = 1 << 20
#: Distinct merged pre-tokens a worker remembers.
MEMO_ENTRIES = 200_000

LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_MIX_1, _MIX_2, _MIX_3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0xD6E8FEB86659FD93)
_MASKS = np.array([(1 << (8 * n)) - 1 for n in range(8)] + [2**64 - 1], dtype=np.uint64)
#: The letters that may follow an apostrophe as a piece of their own.
CONTRACTIONS = ("s", "t", "m", "d", "re", "ve", "ll")
#: The code points with the Unicode property White_Space.
WHITE_SPACE = (*range(0x9, 0xE), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX_1
    x = (x ^ (x >> np.uint64(27))) * _MIX_2
    return x ^ (x >> np.uint64(31))


def _words(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and second eight bytes of each piece (zero beyond its end) and a hash of both and the length.

    ``data`` has sixteen bytes of padding."""
    wide = np.ndarray(shape=(len(data) - 15,), dtype="<u8", buffer=data, strides=(1,))
    far = np.ndarray(shape=(len(data) - 15,), dtype="<u8", buffer=data, offset=8, strides=(1,))
    first = wide[start] & _MASKS[np.minimum(length, 8)]
    second = far[start] & _MASKS[np.clip(length - 8, 0, 8)]
    return first, second, _mix(first * _MIX_3 + _mix(second + length.astype(np.uint64) * _GOLDEN))


def _slots(h: np.ndarray, shift: np.ndarray, n: int) -> np.ndarray:
    return (_mix(h + shift.astype(np.uint64) * _GOLDEN) % np.uint64(n)).astype(np.int64)


class PerfectHash:
    """A minimal perfect hash (hash and displace) of keys of at most sixteen bytes, with their values."""

    def __init__(self, keys: list[bytes], values: list[int]):
        data = np.frombuffer(b"".join(keys) + bytes(16), dtype=np.uint8)
        length = np.array([len(k) for k in keys], dtype=np.int64)
        start = np.concatenate(([0], np.cumsum(length)[:-1]))
        first, second, h = _words(data, start, length)
        if len(np.unique(h)) != len(h):
            raise ValueError("two keys have one hash")
        self.n, self.buckets = len(keys), max(1, len(keys) // 3)
        bucket = (h % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        sizes = np.bincount(bucket, minlength=self.buckets)
        begin = np.concatenate(([0], np.cumsum(sizes)))
        self.shift = np.zeros(self.buckets, dtype=np.int64)
        free, at = np.ones(self.n, dtype=bool), np.zeros(self.n, dtype=np.int64)
        for b in np.argsort(-sizes, kind="stable"):
            own = order[begin[b] : begin[b + 1]]
            if len(own) < 2:
                break
            tried = 0
            while True:
                shifts = np.arange(tried, tried + 64)
                slots = np.sort(_slots(h[own][None, :], shifts[:, None], self.n), axis=1)
                fits = free[slots].all(axis=1) & (slots[:, 1:] != slots[:, :-1]).all(axis=1)
                if fits.any():
                    self.shift[b] = shifts[np.argmax(fits)]
                    break
                tried += 64
            slots = _slots(h[own], np.full(len(own), self.shift[b]), self.n)
            free[slots], at[own] = False, slots
        rest = np.flatnonzero(free)
        single = np.flatnonzero(sizes == 1)
        self.shift[single] = -1 - rest  # a bucket of one key names its slot
        at[order[begin[single]]] = rest
        self.first, self.second = np.zeros(self.n, np.uint64), np.zeros(self.n, np.uint64)
        self.length, self.value = np.zeros(self.n, np.int64), np.zeros(self.n, np.int32)
        self.first[at], self.second[at], self.length[at], self.value[at] = first, second, length, values

    def find(self, first: np.ndarray, second: np.ndarray, h: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The values of the pieces, -1 for those that aren't keys."""
        shift = self.shift[(h % np.uint64(self.buckets)).astype(np.int64)]
        slot = np.where(shift < 0, -1 - shift, _slots(h, shift, self.n))
        same = (self.first[slot] == first) & (self.second[slot] == second) & (self.length[slot] == length)
        return np.where(same, self.value[slot], -1)


def read_ranks(content: bytes) -> dict[bytes, int]:
    """The ranks of a rank file: a line has a byte string in base 64 and its rank."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines())}


class Vocabulary:
    """Ranks of byte strings and the perfect hash of those of at most sixteen bytes."""

    def __init__(self, content: bytes, perfect: PerfectHash | None = None):
        self.ranks = read_ranks(content)
        if perfect is None:
            short = [k for k in self.ranks if len(k) <= 16]
            perfect = PerfectHash(short, [self.ranks[k] for k in short])
        self.hash = perfect


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Merges of lowest rank first, leftmost of equals: a heap of pairs over a linked list of bytes.

    A heap entry holds rank and place; it is void once the rank at its place has changed."""
    n = len(word)
    if n < 2:
        return [ranks[word]] if n else []
    get, push, pop = ranks.get, heapq.heappush, heapq.heappop
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    rank = [get(word[i : i + 2], -1) for i in range(n - 1)]
    rank.append(-1)
    heap = [r * n + i for i, r in enumerate(rank) if r >= 0]
    heapq.heapify(heap)
    while heap:
        r, i = divmod(pop(heap), n)
        if rank[i] != r:
            continue
        j = after[i]
        end = after[i] = after[j]
        rank[j] = r = -1
        if end < n:
            before[end] = i
            if (r := get(word[i : after[end]], -1)) >= 0:
                push(heap, r * n + i)
        rank[i] = r
        if (p := before[i]) >= 0:
            rank[p] = r = get(word[p:end], -1)
            if r >= 0:
                push(heap, r * n + p)
    ids, i = [], 0
    while i < n:
        ids.append(ranks[word[i : after[i]]])
        i = after[i]
    return ids


_CLASSES: list[np.ndarray] = []


def _classes() -> np.ndarray:
    """The class of every code point, made once per process."""
    if not _CLASSES:
        of = {"L": LETTER, "N": NUMBER}
        table = np.fromiter((of.get(unicodedata.category(chr(c))[0], OTHER) for c in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)
        table[list(WHITE_SPACE)] = SPACE
        _CLASSES.append(table)
    return _CLASSES[0]


def pieces(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Byte positions where a pre-token begins, in the UTF-8 bytes of texts that begin at ``starts``.

    The positions are those of the public split pattern of the vocabulary: contractions, then runs of
    letters, numbers or other characters with one space before, then white space."""
    if not len(data):
        return np.zeros(0, dtype=np.int64)
    lead = (data & 0xC0) != 0x80
    pos = np.flatnonzero(lead)
    byte = data[pos]
    code = byte.astype(np.int32)
    if (wide := np.flatnonzero(byte >= 0xC0)).size:
        at, b = pos[wide], byte[wide].astype(np.int32)
        tail = [np.where(b >= least, data[np.minimum(at + k, len(data) - 1)] & 0x3F, 0).astype(np.int32) for k, least in ((1, 0xC0), (2, 0xE0), (3, 0xF0))]
        code[wide] = np.where(b >= 0xF0, (b & 7) << 18 | tail[0] << 12 | tail[1] << 6 | tail[2], np.where(b >= 0xE0, (b & 15) << 12 | tail[0] << 6 | tail[1], (b & 31) << 6 | tail[0]))
    kind = _classes()[code]
    n = len(pos)
    opens = np.zeros(n + 1, dtype=bool)  # a text begins here
    opens[np.searchsorted(pos, starts[starts < len(data)])] = True
    opens[n] = True
    edge = np.ones(n + 1, dtype=bool)
    edge[1:n] = kind[1:] != kind[:-1]
    edge |= opens
    begin = edge.copy()
    white = kind == SPACE
    # The last white character before a visible one stands alone, or goes with what follows if it is a space.
    last = np.flatnonzero(white[: n - 1] & ~white[1:] & ~opens[1:n]) if n > 1 else np.zeros(0, np.int64)
    begin[last] = True
    joins = last[code[last] == 0x20]
    begin[joins + 1] = False
    # An apostrophe alone before letters and without such a space may begin a contraction.
    quote = np.flatnonzero((code == 0x27) & begin[:n])
    quote = quote[quote + 1 < n]
    quote = quote[edge[quote + 1] & (kind[quote + 1] == LETTER) & ~opens[quote + 1]]
    if quote.size:
        one = code[quote + 1]
        two = np.where((quote + 2 < n) & ~edge[np.minimum(quote + 2, n)], code[np.minimum(quote + 2, n - 1)], 0)
        size = np.zeros(len(quote), dtype=np.int64)
        for c in CONTRACTIONS:
            hit = one == ord(c[0])
            size = np.where((size == 0) & (hit if len(c) == 1 else hit & (two == ord(c[1]))), len(c), size)
        quote, size = quote[size > 0], size[size > 0]
        begin[quote + 1] = False
        begin[quote + 1 + size] = True
    return pos[begin[:n]]


class Encoder:
    """Encodes slabs of texts; keeps the merges of pre-tokens it has met."""

    def __init__(self, vocabulary: Vocabulary):
        self.v, self.memo = vocabulary, {}

    def _merged(self, word: bytes) -> list[int]:
        got = self.memo.get(word)
        if got is None:
            r = self.v.ranks.get(word)
            got = [r] if r is not None else merge(word, self.v.ranks)
            if len(word) <= 64:
                if len(self.memo) >= MEMO_ENTRIES:
                    self.memo.clear()
                self.memo[word] = got
        return got

    def encode(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the slab, and how many each text has; ``starts`` has the end of the data as its last."""
        begin = pieces(data, starts[:-1])
        if not len(begin):
            return np.zeros(0, np.int32), np.zeros(len(starts) - 1, np.int64)
        length = np.diff(np.append(begin, len(data)))
        padded = np.concatenate((data, np.zeros(16, np.uint8)))
        first, second, h = _words(padded, begin, length)
        value = np.where(length <= 16, self.v.hash.find(first, second, h, length), -1)
        count = np.ones(len(begin), dtype=np.int64)
        miss = np.flatnonzero(value < 0)
        if len(miss):
            raw = data.tobytes()
            short = miss[length[miss] <= 16]
            _, head, which = np.unique(h[short], return_index=True, return_inverse=True)
            same = (first[short] == first[short][head][which]) & (second[short] == second[short][head][which]) & (length[short] == length[short][head][which])
            alone = np.concatenate((miss[length[miss] > 16], short[~same]))  # long ones, and any whose hash is another's
            lead = np.concatenate((short[head], alone))
            number = np.full(len(begin), -1, dtype=np.int64)
            number[short[same]] = which[same]
            number[alone] = len(head) + np.arange(len(alone))
            lists = [self._merged(raw[b : b + n]) for b, n in zip(begin[lead].tolist(), length[lead].tolist())]
            sizes = np.fromiter(map(len, lists), np.int64, len(lists))
            flat = np.fromiter((i for x in lists for i in x), np.int32, int(sizes.sum()))
            offset = np.concatenate(([0], np.cumsum(sizes)))
            count[miss] = sizes[number[miss]]
        ends = np.cumsum(count)
        ids = np.repeat(value.astype(np.int32), count)
        if len(miss):
            k = count[miss]
            within = np.arange(int(k.sum())) - np.repeat(np.cumsum(k) - k, k)
            ids[np.repeat(ends[miss] - k, k) + within] = flat[np.repeat(offset[number[miss]], k) + within]
        edges = np.concatenate(([0], ends))[np.searchsorted(begin, starts)]
        return ids, np.diff(edges)


def _cuts(data: np.ndarray, start: int, end: int) -> list[int]:
    """Where a long text may be cut: at a blank or line end after an ASCII character that is neither."""
    cuts, at = [start], start + SLAB_BYTES
    while at < end:
        window = data[at - 1 : min(end, at + SLAB_BYTES)]
        white = (window == 0x20) | (window == 0x0A)
        fit = np.flatnonzero(white[1:] & ~white[:-1] & (window[:-1] > 0x20) & (window[:-1] < 0x80))
        if fit.size:
            cuts.append(at + int(fit[0]))
            at = cuts[-1] + SLAB_BYTES
        else:
            at += SLAB_BYTES
    return [*cuts, end]


def encode_texts(column: pa.Array, encoder: Encoder) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Slabs (number of texts, all ids, ids per text) of a column of texts, nulls as empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
    k = 0
    while k < n:
        m = max(k + 1, int(np.searchsorted(offsets, offsets[k] + SLAB_BYTES, side="right")) - 1)
        if offsets[m] - offsets[k] <= SLAB_BYTES:
            ids, sizes = encoder.encode(data[offsets[k] : offsets[m]], offsets[k : m + 1] - offsets[k])
        else:  # one long text
            parts = _cuts(data, int(offsets[k]), int(offsets[m]))
            done = [encoder.encode(data[a:b], np.array([0, b - a]))[0] for a, b in zip(parts, parts[1:])]
            ids = np.concatenate(done)
            sizes = np.array([len(ids)])
        yield m - k, ids, sizes
        k = m


_ENCODERS: dict[str, Encoder] = {}


def _encoder(handle: VocabularyFile) -> Encoder:
    """One encoder per worker process and vocabulary."""
    if handle.id not in _ENCODERS:
        _ENCODERS[handle.id] = Encoder(Vocabulary(*handle.sent.value))
    return _ENCODERS[handle.id]


class VocabularyFile:
    """A rank file (under 2 MB) and its perfect hash (under 3 MB), sent once to each executor."""

    def __init__(self, spark: SparkSession, directory: str = TOKENIZER_DIR, name: str = VOCABULARY):
        with open(os.path.join(directory, name), "rb") as f:
            content = f.read()
        self.id = hashlib.sha256(content).hexdigest()
        self.sent = spark.sparkContext.broadcast((content, Vocabulary(content).hash))


def token_ids(documents: DataFrame, vocabulary: VocabularyFile, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``ids`` of every row; one pass over the input's partitions, no shuffle."""
    bound_arrow_batches(documents.sparkSession)
    kind = documents.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocabulary)
        for batch in batches:
            at = 0
            for n, ids, sizes in encode_texts(batch.column(1), encoder):
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), lists], names=[key, "ids"])
                at += n

    return documents.select(key, text).mapInArrow(run, f"`{key}` {kind.simpleString()}, ids array<int>")


def token_counts(documents: DataFrame, vocabulary: VocabularyFile, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``n_tokens`` of every row, without the ids."""
    bound_arrow_batches(documents.sparkSession)
    kind = documents.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocabulary)
        for batch in batches:
            sizes = [s for _, _, s in encode_texts(batch.column(1), encoder)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(sizes or [np.zeros(0, np.int64)]), pa.int64())], names=[key, "n_tokens"])

    return documents.select(key, text).mapInArrow(run, f"`{key}` {kind.simpleString()}, n_tokens bigint")


def token_totals(ids: DataFrame) -> DataFrame:
    """Number of texts, of texts without ids, and of ids."""
    return ids.agg(F.count("*").alias("n_texts"), F.count_if(F.size("ids") == 0).alias("n_empty"), F.coalesce(F.sum(F.size("ids")), F.lit(0)).alias("n_ids"))
