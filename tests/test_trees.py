import random

import pytest
from pyspark.sql import functions as F

from treillis.operators import classify, clustering, similarity

SIDES = "lot string, ex bigint, rt string, ordre int, split string, cote string, symbole string, poids double"


def rows_of(ex, rt, left, right, lot="f", weights=None):
    return [(lot, ex, rt, ex, "train", c, s, float((weights or {}).get(s, 1))) for c, side in (("L", left), ("R", right)) for s in side]


T3 = rows_of(0, "r", "ab", "pq") + rows_of(1, "r", "abc", "pq") + rows_of(2, "r", "ad", "pr")


def cosine(a, b):
    dot = sum(v * b.get(k, 0) for k, v in a.items())
    na, nb = (sum(v * v for v in x.values()) ** 0.5 for x in (a, b))
    return dot / (na * nb) if na and nb else 0.0


def summed(x, y, union=False):
    return [{k: (1 if union else u.get(k, 0) + v.get(k, 0)) for k in {**u, **v}} for u, v in zip(x, y)]


def loop_tree(vectors, union=False, over=None, sequential=False):
    """Nodes by plain dictionaries, as an independent check: {node: (children, height, vectors)}."""
    nodes = {k: (None, None, v) for k, v in enumerate(vectors)}
    active = dict(enumerate(nodes))  # order -> node
    while len(active) > 1:
        links = {(i, j): round(min(cosine(x, y) for x, y in zip(nodes[active[i]][2], nodes[active[j]][2])), 9) for i in active for j in active if i < j}
        good = {p: v for p, v in links.items() if over is None or v > over}
        if not good:
            break
        i, j = min(good) if sequential else min(good, key=lambda p: (-good[p], p))
        a, b = active[i], active.pop(j)
        active[i] = len(nodes)
        nodes[len(nodes)] = ([a, b], links[i, j], summed(nodes[a][2], nodes[b][2], union))
    return nodes


def score(x, y):
    return round(sum(cosine(a, b) for a, b in zip(x, y)) / 2, 9)


def loop_descent(nodes, root, asked):
    at, seen, way = root, 1, [root]
    while nodes[at][0]:
        seen += 2
        best = max(nodes[at][0], key=lambda c: (score(nodes[c][2], asked), -nodes[at][0].index(c)))
        if score(nodes[best][2], asked) <= score(nodes[at][2], asked):
            break
        at = best
        way.append(at)
    return at, seen, way


def test_small_tree(spark):
    nodes = {r["noeud"]: r for r in clustering.cluster(spark.createDataFrame(T3, SIDES)).collect()}
    assert len(nodes) == 5
    assert nodes[3]["enfants"] == [0, 1] and nodes[3]["hauteur"] == pytest.approx(0.816497, abs=1e-6)
    assert nodes[4]["enfants"] == [3, 2] and nodes[4]["hauteur"] == pytest.approx(0.471405, abs=1e-6)
    assert {k: r["profondeur"] for k, r in nodes.items()} == {4: 0, 3: 1, 2: 1, 0: 2, 1: 2}
    assert {k: (r["debut"], r["fin"]) for k, r in nodes.items()} == {0: (0, 1), 1: (1, 2), 2: (2, 3), 3: (0, 2), 4: (0, 3)}
    assert {r["liens"] for r in nodes.values()} == {4}
    frame = spark.createDataFrame(T3, SIDES)
    root = clustering.node_symbols(clustering.cluster(frame).filter("parent is null"), clustering.cluster(frame), frame)
    assert {(r["cote"], r["symbole"]): r["poids"] for r in root.collect()} == {("L", "a"): 3, ("L", "b"): 2, ("L", "c"): 1, ("L", "d"): 1, ("R", "p"): 3, ("R", "q"): 2, ("R", "r"): 1}
    union = {r["noeud"]: r for r in clustering.cluster(frame, union=True).collect()}
    assert union[4]["hauteur"] == pytest.approx(0.408248, abs=1e-6)


def test_links_and_cut(spark):
    frame = spark.createDataFrame(T3, SIDES)
    links = {(r["i"], r["j"]): round(r["lien"], 6) for r in similarity.pair_similarities(similarity.leaf_gram(frame)).collect()}
    assert links == {(0, 1): 0.816497, (0, 2): 0.5, (1, 2): 0.408248}
    nodes = clustering.cluster(frame)
    for t, roots in ((0.5, {2, 3}), (0.471, {4}), (0.9, {0, 1, 2})):
        assert {r["noeud"] for r in clustering.cut_forest(nodes, t).filter("racine").collect()} == roots
    fused = clustering.cluster(frame, over=0.5).filter("parent is null")
    assert {(r["debut"], r["fin"]) for r in fused.collect()} == {(0, 2), (2, 3)}
    asked = spark.createDataFrame(rows_of(10, "r", "ab", "p"), SIDES)
    best = classify.tree_answers(asked, frame, clustering.cut_forest(nodes, 0.5)).first()
    assert (best["noeud"], best["calculs"], best["n_racines"], best["n_noeuds"]) == (0, 4, 2, 4) and best["score"] == pytest.approx(0.853553, abs=2e-6)


def test_descent_of_two_queries(spark):
    train = spark.createDataFrame(T3, SIDES)
    nodes = clustering.cluster(train)
    asked = spark.createDataFrame(rows_of(10, "r", "ab", "p") + rows_of(11, "r", "abc", "q") + rows_of(12, "s", "zz", "z"), SIDES)
    got = {r["ex"]: r for r in classify.tree_answers(asked, train, nodes, paths=True).collect()}
    assert {k: (r["noeud"], r["calculs"], r["feuille"]) for k, r in got.items()} == {10: (4, 3, False), 11: (1, 5, True), 12: (4, 3, False)}
    want = {(10, 4): 0.857326, (11, 4): 0.714475, (11, 3): 0.834679, (11, 1): 0.853553, (12, 4): 0.0}
    assert {(k, n): s for k, r in got.items() for n, s in zip(r["chemin"], r["scores"])} == pytest.approx(want, abs=2e-6)
    assert {k: r["racine"] for k, r in got.items()} == {10: 4, 11: 4, 12: 4}


def drawn(seed, files):
    rng, rows, vectors = random.Random(seed), [], {}
    for rt in "rst":
        n = {"r": 23, "s": 9, "t": 1}[rt]
        vectors[rt] = []
        for k in range(n):
            side = [{c: rng.randrange(1, 4) for c in "abcdefgh" if rng.random() < 0.3} for _ in range(2)]
            for d in side:
                if rng.random() < 0.9:
                    d.setdefault(rng.choice("axyz"), 1)
            if k and rng.random() < 0.2:
                side = rng.choice(vectors[rt])
            if k % 7 == 5:  # shares nothing with any other
                side = [{f"only{rt}{k}": 2}, {f"only{rt}{k}": 1}]
            vectors[rt].append(side)
            ex = len(rows) * 1000 + k
            rows += [(f"f{k * files // n}", ex, rt, k, "train", c, s, float(v)) for c, d in zip("LR", side) for s, v in d.items()]
        vectors[rt] = [v for v in vectors[rt] if any(v)]
    return rows, vectors


@pytest.mark.parametrize("files,cache", [(1, 1), (4, 20_000_000)])
def test_trees_span_files_and_equal_loops(spark, monkeypatch, files, cache):
    monkeypatch.setattr(clustering, "CACHE", cache)
    rows, vectors = drawn(9 + files, files)
    frame = spark.createDataFrame(rows, SIDES)
    for how in ({}, {"union": True}, {"over": 0.4}, {"over": 0.3, "sequential": True}, {"over": 0.3, "union": True}):
        got = clustering.cluster(frame, **how).collect()
        for rt, v in vectors.items():
            mine = {r["noeud"]: r for r in got if r["rt"] == rt}
            sets = [[dict.fromkeys(s, 1) for s in x] for x in v] if how.get("union") else v
            want = loop_tree(sets, **how)
            assert {k: (r["enfants"], r["hauteur"]) for k, r in mine.items()} == {k: (n[0], n[1]) for k, n in want.items()}
            for k, r in mine.items():
                assert (r["n_l"], r["n_r"]) == tuple(len(s) for s in want[k][2])
                assert r["norme_l"] == pytest.approx(sum(w * w for w in want[k][2][0].values()) ** 0.5)
            assert sorted(p for r in mine.values() if not r["enfants"] for p in range(r["debut"], r["fin"])) == list(range(len(v)))
    measures = clustering.measures(clustering.cluster(frame)).collect()
    assert len(measures) == 3 and all(m["noeuds"] == 2 * m["feuilles"] - 1 for m in measures)
    assert clustering.cluster(frame.limit(0)).count() == 0


@pytest.mark.parametrize("block", [5, 2_000])
def test_answers_equal_loops(spark, monkeypatch, block):
    """One relation a file, as in the published layout: a question of a file meets the trees of all relations."""
    monkeypatch.setattr(classify, "BLOCK", block)
    rows, vectors = drawn(3, 1)
    frame = spark.createDataFrame(rows, SIDES).withColumn("lot", F.concat(F.lit("corpus_"), "rt"))
    asked = frame.filter("ordre % 3 = 0").withColumn("ex", F.col("ex") + 7_000_000).withColumn("split", F.lit("test"))
    asked = asked.filter(F.xxhash64("symbole", "cote", "ex") % 4 != 0)
    questions = {}
    for r in asked.collect():
        questions.setdefault(r["ex"], [{}, {}])["LR".index(r["cote"])][r["symbole"]] = r["poids"]
    nodes = clustering.cluster(frame)
    answers = classify.tree_answers(asked, frame, nodes, paths=True).cache()
    trees = {rt: loop_tree(v) for rt, v in vectors.items()}
    got = {(r["ex"], r["rt"]): r for r in answers.collect()}
    assert set(got) == {(e, rt) for e in questions for rt in trees}
    for (ex, rt), r in got.items():
        tree, q = trees[rt], questions[ex]
        root = len(tree) - 1
        at, seen, way = loop_descent(tree, root, q)
        scores = {k: score(n[2], q) for k, n in tree.items()}
        assert (r["noeud"], r["calculs"], r["chemin"]) == (at, seen, way) and r["scores"] == pytest.approx([scores[k] for k in way], abs=2e-9)
        best, leaf = (min((k for k in tree if which(k)), key=lambda k: (-scores[k], k)) for which in (lambda k: True, lambda k: not tree[k][0]))  # noqa: B023
        assert (r["meilleur"], r["voisin"], r["racine"]) == (best, leaf, root)
        up = {c: k for k, n in tree.items() for c in n[0] or []}
        above = lambda k: [k] if k not in up else [*above(up[k]), k]  # noqa: B023, E731
        common = [k for k in above(at) if k in above(best)]
        assert r["niveau_commun"] == len(common) - 1 and r["dessous"] == (common[-1] == at)
    top = {r["ex"]: r for r in classify.winners(answers).collect()}
    for which, column in (("tous", "score_meilleur"), ("feuilles", "score_voisin"), ("racines", "score_racine")):
        for r in classify.best_everywhere(answers, which).collect():
            assert r["score"] == max(got[r["ex"], rt][column] for rt in trees)
    wrong = 0
    own = {ex: "rst"[0] for ex in questions} | {r["ex"]: r["rt"] for r in asked.select("ex", "rt").distinct().collect()}
    for ex in questions:
        order = sorted(trees, key=lambda rt: (-got[ex, rt]["score"], rt))  # noqa: B023
        assert (top[ex]["predit"], top[ex]["second"]) == tuple(order[:2])
        wrong += top[ex]["predit"] != own[ex]
    assert wrong > 0
    assert sum(r["n"] for r in classify.best_node_oracle(answers).groupBy("verdict").agg(F.count("*").alias("n")).collect()) == len(got)
    steps = sum(len(r["chemin"]) - 1 for r in got.values())
    assert sum(r["lourd"] + r["leger"] + r["egal"] for r in classify.branch_directions(answers, nodes).collect()) == steps
    assert classify.tree_answers(asked.limit(0), frame, nodes).count() == 0 and classify.tree_answers(asked, frame.limit(0), nodes.limit(0)).count() == 0
