import random

import numpy as np

from treillis.llm import split_overlap as so
from treillis.llm.fm_index import FmIndex


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def edited(rng, s, n):
    s = list(s)
    for _ in range(n):
        k = rng.randrange(len(s) + 1)
        what = rng.randrange(3)
        if what == 0:
            s.insert(k, rng.choice("abcdé "))
        elif s and what == 1:
            del s[min(k, len(s) - 1)]
        elif s:
            s[min(k, len(s) - 1)] = rng.choice("abcdé ")
    return "".join(s)


def words(rng, n):
    out = ["", "a", "ab", "abc"]
    while len(out) < n:
        out.append(edited(rng, rng.choice(out), rng.randrange(4)) if rng.random() < 0.4 else "".join(rng.choice("abcdé ") for _ in range(rng.randrange(25))) + (" hot suffix" if rng.random() < 0.4 else ""))
    return list(dict.fromkeys(out))


def test_index():
    rng = random.Random(1)
    texts = words(rng, 200)
    index = FmIndex(texts)
    rows, lengths = index.encode(["ab", "hot", "zz"])
    low, high = np.zeros(3, np.int64), np.full(3, index.n, np.int64)
    for step in range(3):
        at = lengths - 2 - step
        live = np.flatnonzero(at >= 1)
        low[live], high[live] = index.step(rows[live, at[live]], low[live], high[live])
    which, text, place = index.ranges_to_places(low, high)
    got = sorted(zip(which.tolist(), text.tolist(), place.tolist()))
    assert got == sorted((k, t, p) for k, w in enumerate(("ab", "hot", "zz")) for t, s in enumerate(texts) for p in range(len(s)) if s.startswith(w, p))


def test_near_against_brute_force():
    rng = random.Random(4)
    a, b = words(rng, 220), words(rng, 220)
    x, y = so.near(FmIndex(b), a, b)
    got = list(zip(x.tolist(), y.tolist()))
    assert len(got) == len(set(got))
    assert set(got) == {(i, j) for i, s in enumerate(a) for j, t in enumerate(b) if abs(len(s) - len(t)) <= 2 and distance(s, t) <= 2}


def test_pairs_and_report(spark, monkeypatch):
    monkeypatch.setattr(so, "SHARD", 200), monkeypatch.setattr(so, "STREAM", 20), monkeypatch.setattr(so, "SHORT", 6)
    rng = random.Random(6)
    texts = words(rng, 150)
    rows = [(i, rng.choice([None, *texts, *texts]), rng.choice([None, "", "a1", "a2", "ａ1"]), rng.choice(["b1", "b2", ""]), rng.choice(["train", "val", "test", None])) for i in range(200)]
    frame = spark.createDataFrame(rows, "id bigint, syntagme string, A string, B string, split string")
    ready = {i: (None if s is None else " ".join(s.split()), (a or "").replace("ａ", "a"), b, c) for i, s, a, b, c in rows}
    want = set()
    for i, (s, a, b, c) in ready.items():
        for j, (t, d, e, f) in ready.items():
            if c == "train" and f in ("val", "test"):
                near = s is not None and t is not None and abs(len(s) - len(t)) <= 2 and distance(s, t) <= 2
                if near or a and b and (a, b) == (d, e):
                    want.add((i, j))  # training row, evaluation row
    overlap = so.SplitOverlap(frame, "id", "syntagme", ("A", "B"), "split")
    got = [tuple(r) for r in overlap.pairs(("id_a", "id_b")).collect()]
    assert len(got) == len(set(got)) and set(got) == {(min(p), max(p)) for p in want}
    report = {r["split"]: (r["n_lignes"], r["n_trouvees"]) for r in overlap.report("split").collect()}
    for s in ("val", "test"):
        assert report[s][1] == len({j for _, j in want if ready[j][3] == s})
    assert so.SplitOverlap(frame.limit(0), "id", "syntagme", ("A", "B"), "split").pairs(("a", "b")).count() == 0


def test_segments_lose_no_pair(spark):
    """Texts of few letters, so that segments and their shifts repeat: every near pair shares a segment or what is left of both."""
    rng = random.Random(12)
    texts = {"".join(rng.choice("ab") for _ in range(rng.randrange(19))) for _ in range(150)} | {"a" * n for n in range(20)}
    texts |= {edited(rng, t, 2)[:18].replace("é", "a") for t in list(texts)}
    texts = sorted({" ".join(t.split()) for t in texts})
    rows = [(k, t, None, None, rng.choice(["train", "test"])) for k, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "id bigint, syntagme string, A string, B string, split string")
    got = {(r["texte_a"], r["texte_b"]) for r in so.SplitOverlap(frame, "id", "syntagme", ("A", "B"), "split").text_pairs().collect()}
    a, b = ([t for _, t, _, _, s in rows if s == side] for side in ("train", "test"))
    assert got == {(x, y) for x in a for y in b if abs(len(x) - len(y)) <= 2 and distance(x, y) <= 2}
