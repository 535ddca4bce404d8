import random

from pyspark.sql import functions as F

from treillis.llm import splits


def brute(rows):
    own = {}
    def root(x):
        while own[x] != x:
            x = own[x]
        return x
    first = {}
    for i, *terms in rows:
        own[i] = i
    for i, *terms in rows:
        for t in terms:
            if t:
                j = first.setdefault(t, i)
                a, b = sorted((root(i), root(j)))
                own[b] = a
    return {i: root(i) for i, *_ in rows}


def test_groups_against_brute_force(spark):
    rng = random.Random(3)
    for n, terms in ((1, 1), (60, 30), (300, 400), (300, 250)):
        rows = [(i, rng.choice([None, "", *[f"t{rng.randrange(terms)}"] * 8]), "hot" if rng.random() < 0.3 else f"t{rng.randrange(terms)}") for i in range(1, n + 1)]
        frame = spark.createDataFrame(rows, "id bigint, a string, b string")
        got = {r[0]: r[1] for r in splits.groups(frame, "id", [F.col("a"), F.col("b")]).collect()}
        assert got == brute(rows)


def test_chain_and_empty(spark):
    rows = [(i, f"t{i}", f"t{i + 1}") for i in range(1, 70)]
    frame = spark.createDataFrame(rows, "id bigint, a string, b string")
    assert {r[1] for r in splits.groups(frame, "id", [F.col("a"), F.col("b")]).collect()} == {1}
    assert splits.groups(frame.limit(0), "id", [F.col("a"), F.col("b")]).count() == 0


def test_assignment_keeps_groups_and_shares(spark):
    rng = random.Random(5)
    rows = [(i, "big" if rng.random() < 0.33 else f"t{rng.randrange(15_000)}", rng.choice(["r", "s", "s", None]), rng.choice(["train", "test", None])) for i in range(1, 20_001)]
    frame = spark.createDataFrame(rows, "id bigint, a string, relation string, split string").withColumn("groupe_x", F.lit(0))
    groups = splits.groups(frame, "id", [F.col("a")])
    done = splits.assign(frame, groups, "id", "relation")
    assert done.count() == len(rows)
    assert done.groupBy("groupe").agg(F.count_distinct("split_nouveau").alias("n")).filter("n > 1").count() == 0
    shares = {(r["ensemble"], r["relation"], r["split_nouveau"]): r["part"] for r in splits.met_shares(frame, done, "id", "relation").collect()}
    for s, p in splits.SHARES.items():
        assert abs(shares[(True, None, s)] - p) < 0.02
        assert all(abs(v - p) < 0.04 for k, v in shares.items() if k[2] == s)
    assert splits.assign(frame.limit(0), groups.limit(0), "id", "relation").count() == 0
    mixed = {tuple(r) for r in splits.spread(frame, groups, "id", "split").collect()}
    by = brute([(i, a) for i, a, *_ in rows])
    kinds = {}
    for i, _, _, s in rows:
        kinds.setdefault(by[i], set()).update({s} - {None})
    assert mixed == {(by[i], i) for i, *_ in rows if len(kinds[by[i]]) > 1}


def test_only_touched_groups_move(spark):
    rng = random.Random(6)
    rows = [(i, f"t{rng.choice([rng.randrange(40), rng.randrange(900)])}", rng.choice("rs")) for i in range(1, 2_001)]
    more = [(5_000 + i, f"t{rng.randrange(1_200)}", rng.choice("rs")) for i in range(150)]
    first, second = (spark.createDataFrame(x, "id bigint, a string, relation string") for x in (rows, rows + more))
    one, two = (splits.groups(f, "id", [F.col("a")]).cache() for f in (first, second))
    weights = splits.fitted_weights(*splits._sizes(first, one, "id", "relation")).cache()
    before, after = ({r["id"]: (r["groupe"], r["split_nouveau"]) for r in splits.assign(f, g, "id", "relation", weights=weights).collect()} for f, g in ((first, one), (second, two)))
    touched = {after[i][0] for i, *_ in more}
    assert all(after[i] == before[i] for i in before if after[i][0] not in touched)
    assert {i: s for i, (_, s) in before.items()} == {r["id"]: r["split_nouveau"] for r in splits.assign(first, one, "id", "relation").collect()}


def test_a_group_of_most_rows(spark):
    rows = [(i, "hot" if i <= 400 else f"t{i}", "r") for i in range(1, 601)]
    frame = spark.createDataFrame(rows, "id bigint, a string, relation string")
    groups = splits.groups(frame, "id", [F.col("a")])
    parts = {r["split_nouveau"]: r["part"] for r in splits.met_shares(frame, splits.assign(frame, groups, "id", "relation"), "id", "relation").filter("ensemble").collect()}
    assert all(abs(parts[s] - p) < 0.04 for s, p in splits.SHARES.items())
