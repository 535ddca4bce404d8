import random
from collections import Counter

from treillis.llm import term_counts as tc


def brute(rows):
    occ, rec = Counter(), Counter()
    for trait, values in rows:
        own = [v for v in values or [] if v is not None]
        occ.update((trait, v) for v in own)
        rec.update((trait, v) for v in set(own))
    return {k: (n, rec[k]) for k, n in occ.items()}


def test_counts_against_brute_force(spark, monkeypatch):
    rng = random.Random(2)
    words = ["", "a", "ab", "abc", *[f"prefix/{rng.randrange(400)}" for _ in range(300)], *[chr(97 + rng.randrange(26)) * rng.randrange(5) for _ in range(50)]]
    rows = [(rng.choice(["H", "TRT"]), rng.choice([None, [], [None], *[[rng.choice(words) for _ in range(rng.randrange(9))] for _ in range(9)]])) for _ in range(800)]
    frame = spark.createDataFrame(rows, "trait string, valeurs array<string>")
    for full, routes, entries in ((100_000, 256, 20_000), (40, 4, 10)):
        monkeypatch.setattr(tc, "FULL", full), monkeypatch.setattr(tc, "ROUTES", routes), monkeypatch.setattr(tc, "ROUTE_ENTRIES", entries), monkeypatch.setattr(tc, "BURST", 8)
        got = [tuple(r) for r in tc.counts(frame).collect()]
        assert len(got) == len({r[:2] for r in got})
        assert {r[:2]: r[2:] for r in got} == brute(rows)
    assert tc.counts(frame.limit(0)).count() == 0


def test_marks(spark):
    counted = spark.createDataFrame([("H", "a", 9, 2), ("H", "b", 9, 3), ("H", "c", 9, 21), ("H", "d", 30, 20)], "trait string, symbole string, n_occurrences bigint, n_fiches bigint")
    assert {r["symbole"]: r["marque"] for r in tc.marked(counted, 100).collect()} == {"a": "rare", "b": None, "c": "commun", "d": None}
