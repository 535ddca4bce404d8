import random
from collections import defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from treillis.llm import byte_bpe, packing, shared_spans

tiktoken = pytest.importorskip("tiktoken")
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@pytest.fixture(scope="module")
def vocabulary():
    with open(f"{byte_bpe.TOKENIZER_DIR}/{byte_bpe.VOCABULARY}", "rb") as f:
        return byte_bpe.Vocabulary(f.read())


def texts(rng):
    letters = list(" \t\n'strevmdl.,é漢 　０９x1😀\r\x1c") + ["'s", "'ll", " 're", "  "]
    return [None, "", "<|endoftext|>", "a" * 5000, " " * 3000, "é" * 700, *("".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(3000))]


def test_ids_equal_the_public_encoder(spark, vocabulary, monkeypatch):
    monkeypatch.setattr(byte_bpe, "SLAB_BYTES", 1000)
    encoder = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})
    rows = list(enumerate(texts(random.Random(1)) + ["word " * 3000 + "end"]))
    want = {k: encoder.encode_ordinary(t or "") for k, t in rows}
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("ids", F.lit("x"))
    handle = byte_bpe.VocabularyFile(spark)
    assert {r[0]: r[1] for r in byte_bpe.token_ids(frame, handle).collect()} == want
    assert {r[0]: r[1] for r in byte_bpe.token_counts(frame, handle).collect()} == {k: len(v) for k, v in want.items()}
    own = byte_bpe.Encoder(vocabulary)  # small slabs in this process
    ids = [i.tolist() for _, i, s in byte_bpe.encode_texts(pa.array([t for _, t in rows]), own)]
    assert [i for x in ids for i in x] == [i for k, _ in rows for i in want[k]]
    assert byte_bpe.token_ids(frame.limit(0), handle).count() == 0


def test_perfect_hash(vocabulary):
    h = vocabulary.hash
    assert h.n == len(set(h.value.tolist())) == sum(len(k) <= 16 for k in vocabulary.ranks)


def best_fit(sizes, capacity):
    open_, bins = [], []
    for s in sorted(sizes, reverse=True):
        fits = [r for r in open_ if r >= s]
        if fits:
            open_.remove(min(fits))
            open_.append(min(fits) - s)
        else:
            open_.append(capacity - s)
    return sorted(open_)


def test_packing_is_best_fit_decreasing(spark, monkeypatch):
    monkeypatch.setattr(packing, "ITEMS_PER_BUCKET", 7)
    rng = random.Random(2)
    for n, most in ((0, 9), (1, 30), (150, 40), (150, 9)):
        rows = [(i, rng.choice([None, 0, *[rng.randrange(1, most) for _ in range(8)]])) for i in range(n)]
        frame = spark.createDataFrame(rows, "doc_id bigint, n bigint").withColumn("rang", F.lit(0))
        got = packing.pack(frame, "doc_id", "n", 20).collect()
        by, fill = defaultdict(dict), defaultdict(int)
        for r in got:
            by[r["doc_id"]][r["rang"]] = r["taille"]
            fill[r["conteneur"]] += r["taille"]
        for i, s in rows:
            s = s or 0
            assert [by[i][k] for k in range(len(by[i]))] == [20] * (s // 20) + ([s % 20] if s % 20 or not s else [])
        pieces = [r["taille"] for r in got if r["taille"]]
        assert sorted(20 - f for f in fill.values() if f) == best_fit(pieces, 20)


def test_shared_spans_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(shared_spans, "SLAB", 900)
    rng = random.Random(8)
    span, gram = 30, 8
    letters = "ab é\n"
    common = ["".join(rng.choice(letters) for _ in range(n)) for n in (29, 30, 31, 80, 400)] + ["=" * 60, "ab" * 40]
    rows = [(0, None), (1, ""), (2, "=" * 2500)]
    for i in range(3, 90):
        parts = ["".join(rng.choice(letters) for _ in range(rng.randrange(90)))]
        while rng.random() < 0.6:
            c = rng.choice(common)
            a = rng.randrange(len(c))
            parts += [c if rng.random() < 0.5 else c[a:], "".join(rng.choice(letters) for _ in range(rng.randrange(40)))]
        rows.append((i, "".join(parts)))
    rows += [(100, rows[50][1]), (101, "😀" * 40), (102, "x" + "😀" * 31)]
    own = defaultdict(set)
    for k, t in rows:
        for i in range(len(t or "") - span + 1):
            own[t[i : i + span]].add(k)
    cover = {k: {j for i in range(len(t or "") - span + 1) if len(own[t[i : i + span]]) > 1 for j in range(i, i + span)} for k, t in rows}
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("doc", F.lit("x"))
    shared = shared_spans.SharedSpans(frame, span=span, gram=gram)
    assert {r[0] for r in shared.found().collect()} == {k for k, c in cover.items() if c}
    passages = defaultdict(set)
    for k, a, b in shared.passages().collect():
        assert not passages[k] & set(range(a, b))
        passages[k] |= set(range(a, b))
    assert dict(passages) == {k: c for k, c in cover.items() if c}
    assert {r["doc_id"]: r["n_partages"] for r in shared.shares().collect()} == {k: len(c) for k, c in cover.items()}
    assert shared_spans.SharedSpans(frame.limit(0), span=span, gram=gram).found().count() == 0
