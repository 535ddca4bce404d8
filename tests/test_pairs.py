import random

import pytest

from treillis.operators import pairs, quality, similarity

SIDES = "lot string, ex bigint, rt string, ordre int, split string, cote string, symbole string, poids double"


def drawn():
    rng, rows, vectors = random.Random(5), [], {}
    for ex in range(60):
        rt, sides = "rs"[ex % 3 == 0], [{c: float(rng.randrange(1, 4)) for c in "abcdefghijkl" if rng.random() < 0.15} for _ in range(2)]
        for d in sides:
            d.setdefault(f"x{rng.randrange(40)}", 1.0)
        vectors[ex] = rt, ex // 8, sides
        rows += [(f"f{ex % 8}", ex, rt, ex // 8, "train", c, s, v) for c, d in zip("LR", sides) for s, v in d.items()]
    return rows, vectors


def loops(vectors):
    """Products and similarities of all pairs, whatever their files."""
    dots, sims = {}, {}
    own = lambda d: sum(v * v for v in d.values()) ** 0.5
    for i, (ri, oi, a) in vectors.items():
        for j, (rj, oj, b) in vectors.items():
            if (oi, i) > (oj, j):
                continue
            shared = [set(x) & set(y) for x, y in zip(a, b)]
            d = [sum(x[s] * y[s] for s in k) for k, x, y in zip(shared, a, b)]
            if ri == rj:
                dots |= {(ri, c, i, j): v for c, v, k in zip("LR", d, shared) if k}
            if i != j and any(shared):
                sims[i, j] = ri == rj, *(v / (own(x) * own(y)) for v, x, y in zip(d, a, b))
    return dots, sims


@pytest.mark.parametrize("block", [7, 1_500])
def test_pairs_of_all_files(spark, block):
    rows, vectors = drawn()
    frame, (dots, sims) = spark.createDataFrame(rows, SIDES), loops(vectors)
    got = pairs.gram(frame, block).collect()
    assert len(got) == len(dots) and {(r["rt"], r["cote"], r["i"], r["j"]): r["produit"] for r in got} == pytest.approx(dots)
    found = pairs.links(frame, block).collect()
    want = {k: min(v[1:]) for k, v in sims.items() if v[0]}
    assert len(found) == len(want) and {(r["i"], r["j"]): r["lien"] for r in found} == pytest.approx(want, abs=1e-8)
    counts = {(r["meme"], r["seuil"]): (r["n"], r["n_deux"], r["n_moyenne"]) for r in pairs.threshold_counts(frame, [0.205, 0.405], block).collect()}
    for m in (False, True):
        mine = [v[1:] for v in sims.values() if v[0] == m]
        for t in (0.205, 0.405):
            assert counts[m, t] == (len(mine), sum(round(min(x), 6) > t for x in mine), sum(round(sum(x) / 2, 6) > t for x in mine))
    for r in pairs.score_percentiles(frame, {"mediane": 0.5, "c90": 0.9}, block).collect():
        scores = sorted(round(sum(v[1:]) / 2, 9) for v in sims.values() if v[0] == r["meme"])
        at = lambda p: (x := p * (len(scores) - 1), k := int(x), scores[k] + (x - k) * (scores[min(k + 1, len(scores) - 1)] - scores[k]))[-1]
        assert (r["n"], r["mediane"], r["c90"]) == (len(scores), pytest.approx(at(0.5), abs=1e-8), pytest.approx(at(0.9), abs=1e-8))
        assert r["part_haute"] == pytest.approx(sum(s > 0.5 for s in scores) / len(scores))


def test_reports_cross_files(spark):
    rows, vectors = drawn()
    frame, (dots, sims) = spark.createDataFrame(rows, SIDES), loops(vectors)
    assert similarity.leaf_gram(frame).count() == len(dots)
    assert similarity.pair_similarities(similarity.leaf_gram(frame)).count() == sum(v[0] for v in sims.values())
    assert {r["n"] for r in quality.merge_criterion_sweep(frame, [0.5]).collect()} == {sum(v[0] == m for v in sims.values()) for m in (False, True)}
    assert sum(r["n"] for r in quality.noise_signal(frame).collect()) == len(sims)
