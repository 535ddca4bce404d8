import random
from itertools import combinations

from treillis.llm import set_join


def make(rng, n, hot=0.0):
    base, rows = [], []
    for i in range(n):
        if base and rng.random() < 0.5:
            s = set(rng.choice(base))
            for _ in range(rng.randrange(5)):
                (s.discard(rng.choice(sorted(s))) if rng.random() < 0.5 and s else s.add(rng.randrange(4000)))
        else:
            s = {rng.randrange(4000) for _ in range(rng.randrange(5, 30))} | {rng.randrange(4000, 4010) for _ in range(5)}
        if rng.random() < hot:
            s.add(-1)
        base.append(s)
        rows.append((2 * (1001 + i) if rng.random() < 0.8 else 2 * i + 1, sorted(s)))
    return rows


def brute(rows):
    out = set()
    for (u, a), (v, b) in combinations(rows, 2):
        a, b = set(a), set(b)
        if len(a) < 12 or len(b) < 12 or u % 2 and v % 2 or 10 * len(a & b) < 7 * len(a | b):
            continue
        out.add((min(u // 2, v // 2), max(u // 2, v // 2)))
    return out


def test_pairs_and_links_against_brute_force(spark, monkeypatch):
    rng = random.Random(7)
    for n, block, hot in ((250, 5_000, 0), (250, 4, 0.6), (1, 10, 0)):
        monkeypatch.setattr(set_join, "BLOCK", block)
        rows = make(rng, n, hot)
        if n > 1:
            rows += [(2 * (5000 + i), rows[0][1] + [9001, 9002, 9003, 9004, 9005, 9006]) for i in range(6)] + [(2 * 9000, []), (2 * 9001, [1])]
        join = set_join.SetJoin(spark.createDataFrame(rows, "uid bigint, valeurs array<bigint>"))
        got = [tuple(r) for r in join.pairs().collect()]
        want = brute(rows)
        assert len(got) == len(set(got)) and set(got) == want
        links = {(r["id"], r["reference"]): r["n_liens"] for r in join.links().collect()}
        for u, s in rows:
            if len(s) >= 12:
                mine = sum((u // 2, v // 2) in want or (v // 2, u // 2) in want for v, _ in rows if v != u and not (u % 2 and v % 2))
                assert links[(u // 2, bool(u % 2))] == mine


def test_sets_of_records(spark):
    records = spark.createDataFrame([(1, [("a",), ("a",), (None,), None], None, []), (2, None, None, None)], "enr_id bigint, H array<struct<forme_normalisee: string>>, TRT array<struct<type: string>>, SST array<struct<tag: string>>")
    assert {r["uid"]: len(r["valeurs"]) for r in set_join.record_sets(records).collect()} == {2: 1, 4: 0}
    refs = spark.createDataFrame([(1, "H", "a"), (1, "H", "a"), (1, "H", None)], "ref_id bigint, trait string, symbole string")
    assert [len(r["valeurs"]) for r in set_join.reference_sets(refs).collect()] == [1]
    assert set_join.SetJoin(set_join.record_sets(records)).pairs().count() == 0
