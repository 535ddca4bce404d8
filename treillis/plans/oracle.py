"""SQL for the core's queries, put together from common table expressions."""
from __future__ import annotations

from treillis.model import EXCLUDED_TYPES, IDF_FAMILY, REFERENCE, RETAINED, WEIGHTED_TRAITS, Config
from treillis.plans.reference import SIGNATURES

C = "corpus_r_processus_instr_1"
_EXCLUDED = ", ".join(f"'{t}'" for t in EXCLUDED_TYPES)
_SQUEEZED = r"trim(regexp_replace({}, '[\s\p{{Z}}]+', ' ', 'g'))"

REC = "rec AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY terme ORDER BY enr_id DESC) AS rn FROM termes_jdm WHERE terme IS NOT NULL) WHERE rn = 1)"
HYP = """h0 AS (SELECT terme, unnest(H) AS e, unnest(range(len(H))) AS pos FROM rec),
h1 AS (SELECT terme, pos, e.nom AS nom, e.poids AS poids, coalesce(e.forme_normalisee, lower(e.nom)) AS forme FROM h0 WHERE e.poids > 0 AND e.nom IS NOT NULL),
h2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY terme, forme ORDER BY poids DESC, pos) AS n FROM h1) WHERE n = 1),
hyp AS (SELECT terme, nom, forme, poids, row_number() OVER (PARTITION BY terme ORDER BY poids DESC, nom, pos) AS rang_h FROM h2)"""
TRT = f"""t0 AS (SELECT terme, unnest(TRT) AS e, unnest(range(len(TRT))) AS pos FROM rec),
trt AS (SELECT terme, type, n FROM (SELECT terme, e.type AS type, e.n AS n, row_number() OVER (PARTITION BY terme, e.type ORDER BY pos DESC) AS k FROM t0
  WHERE e.type IS NOT NULL AND e.n > 0 AND e.type NOT IN ({_EXCLUDED})) WHERE k = 1)"""
SST = """s0 AS (SELECT terme, unnest(SST) AS e, unnest(range(len(SST))) AS pos FROM rec),
s1 AS (SELECT terme, e.tag AS tag, e.poids AS poids, coalesce(e.morpho, false) AS morpho, row_number() OVER (PARTITION BY terme, e.tag ORDER BY pos DESC) AS k FROM s0 WHERE e.poids > 0 AND e.tag IS NOT NULL),
sst AS (SELECT terme, tag, max(poids) AS poids, bool_or(morpho AND k = 1) AS morpho FROM s1 GROUP BY terme, tag)"""
EX = f"ex AS (SELECT fichier AS lot, ligne_id AS ex, relation AS rt, ligne AS ordre, split, A, B, det, definitude, syntagme FROM {C} WHERE A <> '' AND B <> '' AND relation IS NOT NULL AND coalesce(ambigu, 'non') <> 'oui')"
TERMS = "termes AS (SELECT DISTINCT unnest([A, B]) AS terme FROM ex)"
LEARN = "appris AS (SELECT DISTINCT x.terme FROM (SELECT unnest([A, B]) AS terme FROM ex WHERE split = 'train') AS x JOIN rec USING (terme))"
THRESHOLDS = """connus AS (SELECT trt.* FROM trt JOIN appris USING (terme)),
seuils AS (SELECT type, quantile_cont(n, 0.66) AS seuil FROM (SELECT t.type, coalesce(c.n, 0) AS n FROM (SELECT DISTINCT type FROM connus) AS t CROSS JOIN appris AS a LEFT JOIN connus AS c ON c.terme = a.terme AND c.type = t.type) GROUP BY type)"""


def signature(c: Config, name: str = "sig") -> list[str]:
    """Expressions for the signatures under a configuration, as ``name``."""
    parts = [f"SELECT terme, 'H' AS trait, 'H:' || nom AS symbole, poids / max(poids) OVER (PARTITION BY terme) AS poids, 0 AS p FROM hyp{'' if c.h is None else f' WHERE rang_h <= {c.h}'}"]
    more: list[str] = []
    if c.trt == "centile":
        more.append(THRESHOLDS)
    if c.trt != "aucun":
        kept = {"tous": "trt", "centile": "(SELECT trt.* FROM trt LEFT JOIN seuils USING (type) WHERE n > coalesce(seuil, 0))"}[c.trt]
        parts.append(f"SELECT terme, 'TRT', 'TRT:' || type, ln(1 + n) / max(ln(1 + n)) OVER (PARTITION BY terme), 0 FROM {kept}")
    if c.sst != "aucune":
        parts.append(f"SELECT terme, 'SST', 'SST:' || tag, poids / max(poids) OVER (PARTITION BY terme), 0 FROM sst{' WHERE NOT morpho' if c.sst == 'sans_morpho' else ''}")
    if c.term == "T0":
        parts.append("SELECT terme, 'terme', terme, 1.0, 1 FROM rec")
    if c.term == "T1":
        parts.append("SELECT terme, 'H', 'H:' || terme, 1.0, 1 FROM rec")
    raw = f"{name}_b AS ({' UNION ALL '.join(parts)}),\n{name}_r AS (SELECT terme, trait, symbole, poids FROM (SELECT *, row_number() OVER (PARTITION BY terme, symbole ORDER BY p DESC, poids) AS k FROM {name}_b) WHERE k = 1)"
    traits = WEIGHTED_TRAITS[c.weighting]
    weight = f"CASE WHEN trait IN ({', '.join(repr(t) for t in traits)}) THEN poids ELSE 1.0 END" if traits else "1.0::DOUBLE"
    if c.weighting not in IDF_FAMILY and c.df_min <= 1:
        final = f"{name} AS (SELECT terme, trait, symbole, {weight} AS poids FROM {name}_r WHERE {weight} > 0)"
    else:
        factor = "ln((SELECT count(*) FROM appris)::DOUBLE / coalesce(df, 1))" if c.weighting in IDF_FAMILY else "1.0::DOUBLE"
        final = (
            f"{name}_d AS (SELECT symbole, count(*) AS df FROM {name}_r JOIN appris USING (terme) GROUP BY symbole),\n"
            f"{name} AS (SELECT * FROM (SELECT terme, trait, symbole, {weight} * {factor} AS poids FROM {name}_r LEFT JOIN {name}_d USING (symbole)" + (f" WHERE coalesce(df, 0) >= {c.df_min}" if c.df_min > 1 else "") + ") WHERE poids > 0)"
        )
    return [REC, HYP, TRT, SST, EX, LEARN, *more, raw, final]


def sides(where: str, name: str, sig: str = "sig") -> str:
    return f"""{name} AS (SELECT lot, ex, rt, ordre, split, cote, coalesce(s.symbole, e.terme) AS symbole, coalesce(s.poids, 1.0) AS poids
  FROM (SELECT lot, ex, rt, ordre, split, 'L' AS cote, A AS terme FROM ex WHERE {where} UNION ALL SELECT lot, ex, rt, ordre, split, 'R', B FROM ex WHERE {where}) AS e LEFT JOIN {sig} AS s USING (terme))"""


ALL, TRAIN, ASKED = "true", "split = 'train'", "split IN ('val', 'test')"


def answers(c: Config = RETAINED, tag: str = "") -> list[str]:
    """Scores of the relations by centroid (rep), predictions with second and gap (pred)."""
    s = f"sig{tag}"
    return [
        *signature(c, s), sides(TRAIN, f"feuilles{tag}", s), sides(ASKED, f"questions{tag}", s),
        f"centres{tag} AS (SELECT rt, cote, symbole, sum(poids) AS poids FROM feuilles{tag} GROUP BY ALL)",
        f"nc{tag} AS (SELECT rt, cote, sqrt(sum(poids * poids)) AS n FROM centres{tag} GROUP BY ALL)", f"nq{tag} AS (SELECT ex, cote, sqrt(sum(poids * poids)) AS n FROM questions{tag} GROUP BY ALL)",
        f"pq{tag} AS (SELECT q.ex, c.rt, q.cote, sum(q.poids * c.poids) AS d FROM questions{tag} AS q JOIN centres{tag} AS c USING (cote, symbole) GROUP BY ALL)",
        f"""rep{tag} AS (SELECT x.ex, t.rt, round(0.5 * coalesce(sum(d / (nq{tag}.n * nc{tag}.n)), 0), 9) AS score FROM ex AS x CROSS JOIN (SELECT DISTINCT rt FROM centres{tag}) AS t
  LEFT JOIN pq{tag} AS p ON p.ex = x.ex AND p.rt = t.rt LEFT JOIN nq{tag} ON nq{tag}.ex = p.ex AND nq{tag}.cote = p.cote LEFT JOIN nc{tag} ON nc{tag}.rt = p.rt AND nc{tag}.cote = p.cote WHERE x.{ASKED} GROUP BY x.ex, t.rt)""",
        f"rang{tag} AS (SELECT *, row_number() OVER (PARTITION BY ex ORDER BY score DESC, rt) AS rang FROM rep{tag})",
        f"""pred{tag} AS (SELECT p.ex, attendu, predit, score, second, CASE WHEN s2 IS NULL OR score = 0 THEN 1.0 ELSE (score - s2) / score END AS ecart FROM
  (SELECT ex, max(CASE WHEN rang = 1 THEN rt END) AS predit, max(CASE WHEN rang = 1 THEN score END) AS score, max(CASE WHEN rang = 2 THEN rt END) AS second, max(CASE WHEN rang = 2 THEN score END) AS s2 FROM rang{tag} GROUP BY ex) AS p
  JOIN (SELECT ex, rt AS attendu FROM ex) AS e USING (ex))""",
    ]


PAIRS = [
    *signature(RETAINED), sides(TRAIN, "feuilles"),
    "nf AS (SELECT ex, cote, sqrt(sum(poids * poids)) AS n FROM feuilles GROUP BY ALL)",
]
GRAM = [*PAIRS, """gram AS (SELECT a.rt, a.cote, a.ex AS i, b.ex AS j, sum(a.poids * b.poids) AS produit FROM feuilles AS a JOIN feuilles AS b ON a.rt = b.rt AND a.cote = b.cote AND a.symbole = b.symbole
  AND (a.ordre < b.ordre OR (a.ordre = b.ordre AND a.ex <= b.ex)) GROUP BY ALL)"""]
ALL_PAIRS = [*PAIRS, """lp0 AS (SELECT a.cote, a.ex AS i, b.ex AS j, a.rt = b.rt AS meme, sum(a.poids * b.poids) AS d FROM feuilles AS a JOIN feuilles AS b ON a.cote = b.cote AND a.symbole = b.symbole AND a.ex < b.ex GROUP BY ALL),
lp1 AS (SELECT i, j, meme, p.cote, round(d / (x.n * y.n), 9) AS s FROM lp0 AS p JOIN nf AS x ON x.ex = i AND x.cote = p.cote JOIN nf AS y ON y.ex = j AND y.cote = p.cote),
lp2 AS (SELECT i, j, meme, coalesce(max(CASE WHEN cote = 'L' THEN s END), 0) AS l, coalesce(max(CASE WHEN cote = 'R' THEN s END), 0) AS r FROM lp1 GROUP BY ALL),
lp AS (SELECT i, j, meme, least(l, r) AS lien, round(0.5 * (l + r), 9) AS score FROM lp2)"""]

# Leaves are numbered in corpus order within their relation; a tree of n leaves has its root last, as node 2 n - 2.
LEAVES = [
    *signature(RETAINED), sides(TRAIN, "feuilles"), sides(ASKED, "questions"),
    "nq AS (SELECT ex, cote, sqrt(sum(poids * poids)) AS n FROM questions GROUP BY ALL)",
    "place AS (SELECT rt, ex AS feuille, (row_number() OVER (PARTITION BY rt ORDER BY lot, ordre, ex) - 1)::INT AS noeud FROM ex WHERE split = 'train')",
]
NEIGHBOURS = [
    *LEAVES,
    "nl AS (SELECT ex, cote, sqrt(sum(poids * poids)) AS n FROM feuilles GROUP BY ALL)",
    "dl AS (SELECT q.ex, f.ex AS feuille, q.cote, sum(q.poids * f.poids) AS d FROM questions AS q JOIN feuilles AS f USING (cote, symbole) GROUP BY ALL)",
    "sl AS (SELECT d.ex, d.feuille, 0.5 * sum(d / (nq.n * nl.n)) AS s FROM dl AS d JOIN nq ON nq.ex = d.ex AND nq.cote = d.cote JOIN nl ON nl.ex = d.feuille AND nl.cote = d.cote GROUP BY ALL)",
    "scores AS (SELECT q.ex, p.rt, p.noeud, round(coalesce(s, 0), 9) AS score FROM (SELECT DISTINCT ex FROM questions) AS q CROSS JOIN place AS p LEFT JOIN sl ON sl.ex = q.ex AND sl.feuille = p.feuille)",
]
ROOTS = [
    *LEAVES,
    "vr AS (SELECT rt, cote, symbole, sum(poids) AS p FROM feuilles GROUP BY ALL)",
    "nr AS (SELECT rt, cote, sqrt(sum(p * p)) AS n FROM vr GROUP BY ALL)",
    "dr AS (SELECT q.ex, v.rt, q.cote, sum(q.poids * v.p) AS d FROM questions AS q JOIN vr AS v USING (cote, symbole) GROUP BY ALL)",
    "sr AS (SELECT d.ex, d.rt, 0.5 * sum(d / (nq.n * nr.n)) AS s FROM dr AS d JOIN nq ON nq.ex = d.ex AND nq.cote = d.cote JOIN nr ON nr.rt = d.rt AND nr.cote = d.cote GROUP BY ALL)",
    "scores AS (SELECT q.ex, p.rt, p.noeud, round(coalesce(s, 0), 9) AS score FROM (SELECT DISTINCT ex FROM questions) AS q CROSS JOIN (SELECT rt, (2 * count(*) - 2)::INT AS noeud FROM place GROUP BY rt) AS p LEFT JOIN sr ON sr.ex = q.ex AND sr.rt = p.rt)",
]
MEASURES = "mes AS (SELECT l_returnflag || l_linestatus AS cle, l_linenumber AS graine, (l_suppkey % 5)::INT AS pli, round(avg(l_quantity) / 50, 9) AS f1 FROM lineitem GROUP BY ALL)"
CONTEXTS = f"""couples AS (SELECT ligne_id, fichier, relation, syntagme, string_split(unnest(string_split(candidats, ' | ')), ' / ') AS s FROM {C} WHERE candidats <> ''),
contextes AS (SELECT DISTINCT * FROM (SELECT A AS terme, 'A' AS role, 'ferme' AS origine, ligne_id, fichier, relation FROM {C} WHERE A <> '' AND B <> '' UNION ALL SELECT B, 'B', 'ferme', ligne_id, fichier, relation FROM {C} WHERE A <> '' AND B <> ''
  UNION ALL SELECT s[1], 'A', 'candidat', ligne_id, fichier, relation FROM couples WHERE len(s) = 2 UNION ALL SELECT s[2], 'B', 'candidat', ligne_id, fichier, relation FROM couples WHERE len(s) = 2))"""


def form(x: str) -> str:
    """The comparison form of a text."""
    return "lower(" + _SQUEEZED.format(f"replace(nfc_normalize({x}), '’', '''')") + ")"


def sql(parts: list[str] | str, select: str, recursive: bool = False) -> str:
    parts = [parts] if isinstance(parts, str) else list(dict.fromkeys(parts))
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(parts) + "\n" + select


def _best(scores: list[str]) -> str:
    return sql(scores, "SELECT ex, rt AS predit, noeud, round(score, 6) AS score, calculs FROM (SELECT *, count(*) OVER (PARTITION BY ex) AS calculs, row_number() OVER (PARTITION BY ex ORDER BY score DESC, rt, noeud) AS r FROM scores) WHERE r = 1")


def _split() -> str:
    white = r"[\s\p{Z}]"
    prep = rf"(de{white}+la{white}+|de{white}+l[''’]{white}*|des{white}+|du{white}+|de{white}+|d[''’]{white}*)"
    clean = lambda x: rf"trim(regexp_replace({x}, '{white}+', ' ', 'g'))"
    ends = lambda x: rf"regexp_replace({x}, '^{white}+|{white}+$', '', 'g')"
    joined = lambda a, b, last: ends(f"list_reduce(list_prepend('', list_transform(range({a}, {b}), lambda k: parts[k] || CASE WHEN k < {last} THEN blancs[k] || seps[k] ELSE '' END)), lambda x, y: x || y)")
    bare = rf"regexp_replace(brut, '(?i)^une?{white}+', '')"
    return rf"""WITH b AS (SELECT ligne_id, regexp_extract_all(syntagme, '(?i){white}{prep}', 1) AS seps, string_split_regex(syntagme, '(?i){white}{prep}') AS parts, regexp_extract_all(syntagme, '(?i)({white}){prep}', 1) AS blancs FROM {C} WHERE syntagme IS NOT NULL),
c AS (SELECT ligne_id, seps, unnest(range(1, len(seps) + 1)) AS i, parts, blancs FROM b WHERE len(seps) > 0),
d AS (SELECT ligne_id, i, seps[i] AS sep, {joined("1", "i + 1", "i")} AS A, {joined("i + 1", "len(parts) + 1", "len(parts)")} AS brut FROM c),
e AS (SELECT ligne_id, i, A, brut, {clean("sep")} AS preposition, lower(replace({clean("sep")}, '’', '''')) IN ('de la', 'de l''', 'du', 'des') AS defini FROM d),
f AS (SELECT *, NOT defini AND regexp_matches(brut, '(?i)^une?{white}+[^\s\p{{Z}}]') AS article FROM e),
g AS (SELECT *, CASE WHEN article THEN {ends(bare)} ELSE brut END AS B FROM f)
SELECT ligne_id, (row_number() OVER (PARTITION BY ligne_id ORDER BY i) - 1)::INT AS pos, A, B, preposition, CASE WHEN defini OR article THEN 'Det' ELSE 'NoDet' END AS det, CASE WHEN defini OR regexp_matches(B, '^\p{{Lu}}') THEN 'Def' ELSE 'NoDef' END AS definitude FROM g WHERE A <> '' AND B <> ''"""


TRAITS = ["tailles AS (SELECT terme, count(*) AS n FROM sig GROUP BY terme)", """durs AS (SELECT terme, coalesce(n, 0) < 3 AS pauvre, coalesce(diagnostic_singulier.H_taille, 0) > coalesce(len(H), 0) AS singulier, coalesce(len(raffinements), 0) >= 2 AS polysemique FROM rec LEFT JOIN tailles USING (terme))"""]
TYPES = "(SELECT DISTINCT rt FROM ex WHERE split = 'train')"
PER_TYPE = [
    *answers(),
    f"""types AS (SELECT rt, coalesce(n_attendus, 0) AS n_attendus, coalesce(n_predits, 0) AS n_predits, coalesce(vrais, 0)::BIGINT AS vrais FROM {TYPES} LEFT JOIN (SELECT attendu AS rt, count(*) AS n_attendus, sum((attendu = predit)::INT) AS vrais FROM pred GROUP BY 1) USING (rt) LEFT JOIN (SELECT predit AS rt, count(*) AS n_predits FROM pred GROUP BY 1) USING (rt))""",
    "pr AS (SELECT *, CASE WHEN n_predits = 0 THEN 0 ELSE vrais / n_predits END AS precision, CASE WHEN n_attendus = 0 THEN 0 ELSE vrais / n_attendus END AS rappel FROM types)",
    "prf AS (SELECT *, CASE WHEN precision + rappel = 0 THEN 0 ELSE 2 * precision * rappel / (precision + rappel) END AS f1 FROM pr)",
]


def _ablation() -> str:
    parts, selects = [], []
    for k, (name, c) in enumerate({"H": RETAINED.but(trt="aucun", sst="aucune"), "H+SST": RETAINED.but(trt="aucun"), "H+TRT": RETAINED.but(sst="aucune"), "H+TRT+SST": RETAINED}.items()):
        parts += answers(c, f"_{k}")
        selects.append(f"""SELECT '{name}' AS traits, sum(v)::BIGINT AS corrects, round(avg(CASE WHEN v = 0 THEN 0 ELSE 2 * v / (na + np) END), 6) AS f1 FROM
  (SELECT rt, coalesce(v, 0) AS v, coalesce(na, 0) AS na, coalesce(np, 0) AS np FROM {TYPES} LEFT JOIN (SELECT attendu AS rt, count(*) AS na, sum((attendu = predit)::INT) AS v FROM pred_{k} GROUP BY 1) USING (rt) LEFT JOIN (SELECT predit AS rt, count(*) AS np FROM pred_{k} GROUP BY 1) USING (rt))""")
    return sql(parts, "\nUNION ALL ".join(selects))


def oracle_sql() -> dict[str, str]:
    amb = "coalesce(ambigu, 'non') = 'oui'"
    sig = signature(RETAINED)
    changes = [*answers(), *answers(REFERENCE, "_ref"), """chg AS (SELECT a.ex, a.attendu, b.predit AS avant, a.predit AS apres, CASE WHEN b.predit <> a.attendu AND a.predit = a.attendu THEN 'corrige' WHEN b.predit = a.attendu AND a.predit <> a.attendu THEN 'casse' WHEN a.predit <> b.predit THEN 'autre' END AS changement FROM pred AS a JOIN pred_ref AS b USING (ex))"""]
    q = {
        "split_genitive": _split(),
        "resolved_splits": sql([REC, f"candidats AS ({_split()})", """juges AS (SELECT c.*, a.terme IS NOT NULL AND b.terme IS NOT NULL AS connu FROM candidats AS c LEFT JOIN rec AS a ON a.terme = c.A AND a.existe LEFT JOIN rec AS b ON b.terme = c.B AND b.existe)"""],
            "SELECT ligne_id, A, B, n_connus, n_candidats FROM (SELECT *, count(*) FILTER (connu) OVER w AS n_connus, count(*) OVER w AS n_candidats, row_number() OVER (PARTITION BY ligne_id ORDER BY connu DESC, pos) AS r FROM juges WINDOW w AS (PARTITION BY ligne_id)) WHERE r = 1"),
        "comparison_forms": f"SELECT ligne_id, {form('syntagme')} AS forme FROM {C}",
        "merge_keys": f"SELECT id, lower({_SQUEEZED.format('nfc_normalize(nom)')}) AS forme FROM noeuds",
        "language_prefixes": "SELECT prefixe, count(*) AS n FROM (SELECT regexp_extract(nom, '^([A-Za-z]{2,3}):', 1) AS prefixe FROM (SELECT unnest(H).nom AS nom FROM termes_jdm)) WHERE prefixe <> '' GROUP BY 1",
        "singular_forms": f"SELECT terme, left(terme, length(terme) - 1) AS singulier FROM (SELECT unnest([A, B]) AS terme FROM {C} UNION SELECT nom FROM noeuds UNION SELECT unnest(H).nom FROM termes_jdm) WHERE length(terme) > 3 AND right(terme, 1) IN ('s', 'x')",
        "spelling_variants": f"""WITH v AS (SELECT ligne_id, A, CASE WHEN length(A) > 3 AND right(A, 1) IN ('s', 'x') THEN left(A, length(A) - 1) END AS s FROM {C} WHERE A <> ''),
w AS (SELECT ligne_id, A, unnest([s, lower(A), lower(s), CASE WHEN contains(A, '-') THEN replace(A, '-', ' ') END, CASE WHEN contains(A, '-') THEN replace(A, '-', '') END, CASE WHEN contains(A, '’') THEN replace(A, '’', '''') END, CASE WHEN contains(A, '''') THEN replace(A, '''', '’') END, nfc_normalize(A)]) AS variante, unnest(range(8)) AS k FROM v),
x AS (SELECT ligne_id, variante, min(k) AS k FROM w WHERE variante IS NOT NULL AND variante <> A AND variante <> '' GROUP BY ALL)
SELECT ligne_id, (row_number() OVER (PARTITION BY ligne_id ORDER BY k) - 1)::INT AS pos, variante FROM x""",
        "term_dictionary": f"""WITH couples AS (SELECT relation, string_split(unnest(string_split(candidats, ' | ')), ' / ') AS s FROM {C} WHERE candidats <> ''),
t AS (SELECT A AS terme, 'A' AS role, relation, 0 AS c FROM {C} WHERE A <> '' AND B <> '' UNION ALL SELECT B, 'B', relation, 0 FROM {C} WHERE A <> '' AND B <> '' UNION ALL SELECT s[1], 'A', relation, 1 FROM couples WHERE len(s) = 2 UNION ALL SELECT s[2], 'B', relation, 1 FROM couples WHERE len(s) = 2)
SELECT terme, role, coalesce(string_agg(DISTINCT relation, '|' ORDER BY relation), '') AS relations_associees, sum((c = 0)::INT)::BIGINT AS nb_occurrences, sum((c = 1)::INT)::BIGINT AS nb_candidats_ambigus FROM t GROUP BY terme, role""",
        "term_contexts": sql(CONTEXTS, "SELECT terme, role, origine, ligne_id FROM contextes"),
        "rejected_rows": f"SELECT * FROM (SELECT ligne_id, CASE WHEN {amb} THEN 'ambigu' WHEN coalesce(A, '') = '' OR coalesce(B, '') = '' THEN 'terme absent' WHEN relation IS NULL THEN 'relation absente' END AS motif FROM {C}) WHERE motif IS NOT NULL",
        "corpus_counts": f"SELECT fichier, count(*) AS n, count(*) FILTER (split = 'train') AS n_train, count(*) FILTER (split = 'test') AS n_test, count(*) FILTER ({amb}) AS n_ambigus, count(*) FILTER (coalesce(A, '') <> '' AND coalesce(B, '') <> '') AS n_decoupes FROM {C} GROUP BY ROLLUP (fichier)",
        "term_diversity": f"SELECT role, count(*) AS n_distincts, count(*) FILTER (c >= 2) AS n_2, count(*) FILTER (c >= 3) AS n_3 FROM (SELECT role, terme, count(*) AS c FROM (SELECT 'A' AS role, A AS terme FROM {C} UNION ALL SELECT 'B', B FROM {C}) WHERE terme <> '' GROUP BY ALL) GROUP BY role",
        "definiteness": f"SELECT det, definitude, count(*) AS n FROM {C} WHERE det <> '' AND definitude <> '' GROUP BY CUBE (det, definitude)",
        "duplicates_within": f"SELECT fichier, {form('syntagme')} AS forme, count(*) AS n, min(ligne) AS premiere, max(ligne) AS derniere FROM {C} WHERE syntagme IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1",
        "duplicates_across": f"SELECT {form('syntagme')} AS forme, count(DISTINCT fichier) AS n_fichiers, count(*) AS n, count(DISTINCT relation) AS n_relations FROM {C} WHERE syntagme IS NOT NULL GROUP BY 1 HAVING count(DISTINCT fichier) > 1",
        "duplicate_pairs": f"SELECT *, CASE WHEN n_relations > 1 THEN 'relations différentes' WHEN n_formes > 1 THEN 'formes différentes' ELSE 'même syntagme' END AS nature FROM (SELECT {form('A')} AS a, {form('B')} AS b, count(*) AS n, count(DISTINCT relation) AS n_relations, count(DISTINCT {form('syntagme')}) AS n_formes FROM {C} WHERE A <> '' AND B <> '' GROUP BY 1, 2 HAVING count(*) > 1)",
        "edge_hypernyms": """WITH e AS (SELECT src, dst, max(w) AS poids FROM aretes WHERE type = 'r_genre_de' AND w > 0 GROUP BY ALL)
SELECT src AS terme, row_number() OVER (PARTITION BY src ORDER BY poids DESC, dst)::INT AS rang, dst AS nom, poids, n.type AS type_noeud, regexp_matches(dst, '^[A-Za-z]{2,3}:') AS lang_prefix FROM e LEFT JOIN noeuds AS n ON n.nom = dst""",
        "incoming_histogram": "SELECT terme, type, n, t.id AS type_id FROM (SELECT dst AS terme, type, count(*) AS n FROM aretes WHERE w > 0 GROUP BY ALL) LEFT JOIN jdm_relations_types AS t ON t.nom = type",
        "relation_types": "SELECT id, nom AS type, coalesce(n, 0) AS n, coalesce(n_positifs, 0) AS n_positifs FROM jdm_relations_types LEFT JOIN (SELECT type, count(*) AS n, count(*) FILTER (w > 0) AS n_positifs FROM aretes GROUP BY type) AS a ON a.type = nom",
        "still_missing": sql([EX, TERMS], "SELECT terme FROM termes WHERE terme NOT IN (SELECT terme FROM termes_jdm WHERE terme IS NOT NULL)"),
        "reconcile": sql([REC, EX, TERMS], "SELECT CASE WHEN r.terme IS NULL THEN 'absent de la collecte' WHEN t.terme IS NULL THEN 'hors corpus' WHEN NOT coalesce(existe, false) THEN 'absent du réseau' ELSE 'retenu' END AS etat, count(*) AS n FROM rec AS r FULL JOIN termes AS t ON r.terme = t.terme GROUP BY 1"),
        "coverage": sql([REC, CONTEXTS], "SELECT role, c.relation AS relation, count(DISTINCT c.terme) AS n_termes, count(DISTINCT CASE WHEN coalesce(existe, false) THEN c.terme END) AS n_trouves, grouping(role, c.relation)::BIGINT AS niveau FROM (SELECT DISTINCT terme, role, relation FROM contextes) AS c LEFT JOIN rec USING (terme) GROUP BY CUBE (role, c.relation)"),
        "trait_sizes": sql(REC, "SELECT trait, count(*) AS n_termes, count(*) FILTER (n = 0) AS n_vides, min(n)::INT AS mini, quantile_cont(n, 0.25) AS q1, quantile_cont(n, 0.5) AS mediane, quantile_cont(n, 0.75) AS q3, max(n)::INT AS maxi, sum(n)::BIGINT AS total FROM (SELECT unnest(['H', 'TRT', 'SST', 'raffinements']) AS trait, unnest([coalesce(len(H), 0), coalesce(len(TRT), 0), coalesce(len(SST), 0), coalesce(len(raffinements), 0)]) AS n FROM rec) GROUP BY trait"),
        "collection_noise": sql(REC, "SELECT count(*) AS n_termes, sum(n)::BIGINT AS n_entrees, sum(p)::BIGINT AS n_prefixes, sum(z)::BIGINT AS n_nuls, sum(n - f)::BIGINT AS n_doublons FROM (SELECT terme, count(*) AS n, count(*) FILTER (e.lang_prefix) AS p, count(*) FILTER (NOT coalesce(e.poids > 0, false)) AS z, count(DISTINCT coalesce(e.forme_normalisee, lower(e.nom))) AS f FROM (SELECT terme, unnest(H) AS e FROM rec) WHERE e IS NOT NULL GROUP BY terme)"),
        "polysemy": sql(REC, "SELECT coalesce(len(raffinements), 0)::INT AS n_raffinements, count(*) AS n_termes FROM rec GROUP BY 1"),
        "case_merged": sql([REC, HYP], "SELECT terme, nom, poids, rang_h::INT AS rang_h FROM hyp"),
        "hypernyms_top": sql([REC, HYP], "SELECT terme, nom, rang_h::INT AS rang_h FROM hyp WHERE rang_h <= 20"),
        "weight_decay": sql([REC, HYP], "SELECT rang_h::INT AS rang_h, count(*) AS n, round(avg(part), 6) AS part_moyenne FROM (SELECT rang_h, poids / max(poids) OVER (PARTITION BY terme) AS part FROM hyp WHERE rang_h <= 50) GROUP BY 1"),
        "trt_present": sql([REC, TRT], "SELECT terme, type, n FROM trt"),
        "trt_thresholds": sql([REC, TRT], "SELECT t.type, round(quantile_cont(coalesce(c.n, 0), 0.66), 6) AS seuil FROM (SELECT DISTINCT type FROM trt) AS t CROSS JOIN rec LEFT JOIN trt AS c ON c.terme = rec.terme AND c.type = t.type GROUP BY 1"),
        "trt_percentile": sql([REC, TRT, EX, LEARN, THRESHOLDS], "SELECT terme, type, n FROM trt LEFT JOIN seuils USING (type) WHERE n > coalesce(seuil, 0)"),
        "trt_without_frequent": sql([REC, TRT, EX, LEARN], "SELECT terme, type, n FROM trt WHERE type NOT IN (SELECT type FROM trt JOIN appris USING (terme) GROUP BY type HAVING count(*) > 0.8 * (SELECT count(*) FROM appris))"),
        "trt_top5": sql([REC, TRT], "SELECT terme, type, n FROM (SELECT *, row_number() OVER (PARTITION BY terme ORDER BY n DESC, type) AS r FROM trt) WHERE r <= 5"),
        "trt_share": sql([REC, TRT], "SELECT terme, type, n FROM (SELECT *, max(n) OVER (PARTITION BY terme) AS m FROM trt) WHERE n >= 0.05 * m"),
        "trt_top_idf": sql([REC, TRT], "SELECT terme, type, n FROM (SELECT t.*, row_number() OVER (PARTITION BY terme ORDER BY (1 + log10(n)) * ln((SELECT count(*) FROM rec)::DOUBLE / df) DESC, type) AS r FROM trt AS t JOIN (SELECT type, count(*) AS df FROM trt GROUP BY type) USING (type)) WHERE r <= 5"),
        "trt_percentiles": sql([REC, TRT, "s AS (SELECT t.type, c, quantile_cont(coalesce(k.n, 0), [0.5, 0.66, 0.75, 0.9])[i] AS seuil FROM (SELECT DISTINCT type FROM trt) AS t CROSS JOIN rec CROSS JOIN (SELECT unnest([0.5, 0.66, 0.75, 0.9])::DOUBLE AS c, unnest(range(1, 5)) AS i) LEFT JOIN trt AS k ON k.terme = rec.terme AND k.type = t.type GROUP BY t.type, c, i)"], "SELECT c AS centile, count(*) AS n, count(DISTINCT terme) AS n_termes FROM trt JOIN s USING (type) WHERE n > seuil GROUP BY c"),
        "tag_inventory": sql([REC, SST], "SELECT tag, count(*) AS n_termes, round(sum(poids), 6) AS poids, bool_or(morpho) AS morpho FROM sst GROUP BY tag"),
        "term_metadata": f"""WITH couples AS (SELECT relation, string_split(unnest(string_split(candidats, ' | ')), ' / ') AS s FROM {C} WHERE candidats <> ''),
t AS (SELECT A AS terme, 'A' AS role, relation, 1 AS c FROM {C} WHERE A <> '' AND B <> '' UNION ALL SELECT B, 'B', relation, 1 FROM {C} WHERE A <> '' AND B <> '' UNION ALL SELECT s[1], 'A', relation, 0 FROM couples WHERE len(s) = 2 UNION ALL SELECT s[2], 'B', relation, 0 FROM couples WHERE len(s) = 2)
SELECT terme, string_agg(DISTINCT role, '|' ORDER BY role) AS roles, coalesce(string_agg(DISTINCT relation, '|' ORDER BY relation), '') AS relations, count(DISTINCT CASE WHEN relation IS NOT NULL THEN role || ' ' || relation END) AS n_couples, sum(c)::BIGINT AS occurrences FROM t GROUP BY terme""",
        "sizes_by_relation": sql([*sig, CONTEXTS, "n AS (SELECT terme, count(*) AS n FROM sig GROUP BY terme)"], "SELECT relation, role, count(*) AS n_termes, min(n)::BIGINT AS mini, round(avg(n), 6) AS moyenne, max(n)::BIGINT AS maxi FROM (SELECT DISTINCT terme, role, relation FROM contextes) JOIN n USING (terme) GROUP BY relation, role"),
        "universal_symbols": sql(sig, "SELECT trait, symbole, count(*) AS df FROM sig GROUP BY ALL HAVING count(*) > 0.2 * (SELECT count(DISTINCT terme) FROM sig)"),
        "calibration_split": sql(EX, "SELECT ex, CASE WHEN r // greatest(1, n // 5) = 0 THEN 'calibrage' ELSE 'apprentissage' END AS part FROM (SELECT ex, row_number() OVER (PARTITION BY rt ORDER BY md5(42 || '|' || ex), ex) - 1 AS r, count(*) OVER (PARTITION BY rt) AS n FROM ex WHERE split = 'train')"),
        "sst_tags": sql([REC, SST], "SELECT terme, tag, poids, morpho FROM sst"),
        **{name: sql(signature(c), "SELECT terme, trait, symbole, round(poids, 6) AS poids FROM sig") for name, c in SIGNATURES.items()},
        "vocabulary": sql(sig, "SELECT symbole, row_number() OVER (ORDER BY symbole) - 1 AS dim FROM (SELECT DISTINCT symbole FROM sig)"),
        "document_frequency": sql(sig, "SELECT trait, symbole, count(*) AS df FROM sig GROUP BY ALL"),
        "signature_sizes": sql(sig, "SELECT trait, count(*) AS n_termes, min(n)::BIGINT AS mini, quantile_cont(n, 0.5) AS mediane, max(n)::BIGINT AS maxi, sum(n)::BIGINT AS total FROM (SELECT terme, trait, count(*) AS n FROM sig GROUP BY ALL UNION ALL SELECT terme, NULL, count(*) FROM sig GROUP BY terme) GROUP BY trait"),
        "poor_signatures": sql(sig, "SELECT terme, count(*) AS n FROM sig GROUP BY terme HAVING count(*) < 3"),
        "top_symbols": sql(sig, "SELECT trait, symbole, df, row_number() OVER (ORDER BY df DESC, symbole)::INT AS rang FROM (SELECT trait, symbole, count(*) AS df FROM sig GROUP BY ALL) ORDER BY df DESC, symbole LIMIT 30"),
        "best_by_trait": sql(sig, "SELECT trait, symbole, df FROM (SELECT *, row_number() OVER (PARTITION BY trait ORDER BY df DESC, symbole) AS k FROM (SELECT trait, symbole, count(*) AS df FROM sig GROUP BY ALL)) WHERE k = 1"),
        "own_symbol_carriers": sql(sig, "SELECT porte, n_porteurs, premier FROM (SELECT o.terme AS porte, s.terme AS premier, count(*) OVER (PARTITION BY o.terme) AS n_porteurs, row_number() OVER (PARTITION BY o.terme ORDER BY s.poids DESC, s.terme) AS k FROM sig AS s JOIN (SELECT DISTINCT terme FROM sig) AS o ON s.symbole = 'H:' || o.terme AND s.terme <> o.terme) WHERE k = 1"),
        "same_signatures": sql([*sig, *signature(RETAINED.but(term="T1"), "sig_1")], "SELECT count(*) AS n, count(*) FILTER (x = y) AS egales FROM (SELECT terme, list_sort(list(DISTINCT symbole)) AS x FROM sig_1 GROUP BY terme) JOIN (SELECT terme, list_sort(list(DISTINCT symbole)) AS y FROM sig GROUP BY terme) USING (terme)"),
        "rules": sql([*sig, sides(ALL, "cotes")], "SELECT lot, ex, rt, cote, count(*) AS n, round(sqrt(sum(poids * poids)), 6) AS norme FROM cotes GROUP BY ALL"),
        "term_pair_measures": sql([*sig, "t AS (SELECT terme, count(*) AS n, sum(poids * poids) AS c FROM sig GROUP BY terme)", "m AS (SELECT x.ex, a.n AS n_a, b.n AS n_b, a.c AS ca, b.c AS cb, coalesce(count(q.symbole), 0) AS n_commun, coalesce(sum(p.poids * q.poids), 0) AS d FROM ex AS x JOIN t AS a ON a.terme = x.A JOIN t AS b ON b.terme = x.B LEFT JOIN sig AS p ON p.terme = x.A LEFT JOIN sig AS q ON q.terme = x.B AND q.symbole = p.symbole GROUP BY ALL)"],
            "SELECT ex, n_commun, round(n_commun / sqrt(n_a::DOUBLE * n_b), 6) AS cosinus, round(n_commun / n_a, 6) AS couverture, round(n_commun / (n_commun + (n_a - n_commun) + 0.2::DOUBLE * (n_b - n_commun)), 6) AS tversky, round(d / (sqrt(ca) * sqrt(cb)), 6) AS pondere FROM m"),
        "reference_cosine": sql([*sig, "r AS (SELECT ref_id, trait || ':' || symbole AS symbole, poids AS q FROM signatures_ref)", "nr AS (SELECT ref_id, sqrt(sum(q * q)) AS nr FROM r GROUP BY ref_id)", "nt AS (SELECT terme, sqrt(sum(poids * poids)) AS nt FROM sig GROUP BY terme)", "s AS (SELECT terme, ref_id, round(sum(poids * q) / (any_value(nt) * any_value(nr)), 6) AS sim FROM sig JOIN r USING (symbole) JOIN nt USING (terme) JOIN nr USING (ref_id) GROUP BY ALL)"],
            "SELECT terme, ref_id, sim FROM (SELECT *, row_number() OVER (PARTITION BY terme ORDER BY sim DESC, ref_id) AS k FROM s) WHERE k = 1"),
        "leaf_gram": sql(GRAM, "SELECT rt, cote, i, j, round(produit, 6) AS produit FROM gram"),
        "pair_links": sql([*GRAM, "pl AS (SELECT g.rt, i, j, g.cote, round(produit / (x.n * y.n), 9) AS s FROM gram AS g JOIN nf AS x ON x.ex = i AND x.cote = g.cote JOIN nf AS y ON y.ex = j AND y.cote = g.cote WHERE i <> j)", "pm AS (SELECT rt, i, j, coalesce(max(CASE WHEN cote = 'L' THEN s END), 0) AS l, coalesce(max(CASE WHEN cote = 'R' THEN s END), 0) AS r FROM pl GROUP BY ALL)"],
            "SELECT rt, i, j, round(least(l, r), 6) AS lien, round(0.5 * (l + r), 6) AS score FROM pm"),
        "merge_criterion_sweep": sql(ALL_PAIRS, "SELECT meme, seuil::DOUBLE AS seuil, count(*) AS n, count(*) FILTER (round(lien, 6) > seuil) AS n_deux, count(*) FILTER (round(score, 6) > seuil) AS n_moyenne FROM lp CROSS JOIN (SELECT unnest([0.205, 0.305, 0.405, 0.505, 0.605, 0.705]) AS seuil) GROUP BY 1, 2"),
        "noise_signal": sql(ALL_PAIRS, "SELECT meme, count(*) AS n, round(quantile_cont(score, 0.5), 6) AS mediane, round(quantile_cont(score, 0.9), 6) AS c90, round(avg((score > 0.5)::INT), 6) AS part_haute FROM lp GROUP BY meme"),
        "class_centroids": sql(answers(), "SELECT rt, cote, symbole, round(poids, 6) AS poids FROM centres"),
        "centroid_answers": sql(answers(), "SELECT ex, rt, round(score, 6) AS score, rang::INT AS rang FROM rang"),
        "nearest_centroid": sql(answers(), "SELECT ex, attendu, predit, round(score, 6) AS score, second, round(ecart, 6) AS ecart, ecart < 0.05 AS serre FROM pred"),
        "nearest_neighbour": _best(NEIGHBOURS), "roots_only": _best(ROOTS),
        "decisive_symbols": sql([*answers(), "profil AS (SELECT rt AS predit, cote, symbole, round(poids / n, 6) AS part FROM centres JOIN (SELECT rt, count(*) AS n FROM ex WHERE split = 'train' GROUP BY rt) USING (rt))"],
            "SELECT ex, cote, symbole, rang::INT AS rang, part FROM (SELECT q.ex, q.cote, q.symbole, part, row_number() OVER (PARTITION BY q.ex, q.cote ORDER BY part DESC, q.symbole) AS rang FROM questions AS q JOIN pred AS p USING (ex) JOIN profil AS f ON f.predit = p.predit AND f.cote = q.cote AND f.symbole = q.symbole) WHERE rang <= 5"),
        "per_type": sql(PER_TYPE, "SELECT rt, n_attendus, n_predits, vrais, round(precision, 6) AS precision, round(rappel, 6) AS rappel, round(f1, 6) AS f1 FROM prf"),
        "macro_f1": sql(PER_TYPE, "SELECT (SELECT count(*) FROM pred) AS n, (SELECT count(*) FROM pred WHERE attendu = predit) AS corrects, round(avg(precision), 6) AS precision, round(avg(rappel), 6) AS rappel, round(avg(f1), 6) AS f1, round((SELECT avg((attendu = predit)::INT) FROM pred), 6) AS exactitude FROM prf"),
        "confusion": sql(answers(), f"SELECT a.rt AS attendu, b.rt AS predit, count(p.ex) AS n FROM {TYPES} AS a CROSS JOIN {TYPES} AS b LEFT JOIN pred AS p ON p.attendu = a.rt AND p.predit = b.rt GROUP BY 1, 2"),
        "lenient_evaluation": sql(answers(), "SELECT count(*) AS n, count(*) FILTER (attendu = predit) AS stricts, count(*) FILTER (attendu = predit OR (second = attendu AND (score = 0 OR ecart <= 0.05))) AS indulgents FROM pred"),
        "abstention": sql(answers(), "SELECT seuil::DOUBLE AS seuil, count(*) FILTER (score >= seuil) AS gardes, count(*) FILTER (score >= seuil AND attendu = predit) AS justes, count(*) FILTER (score < seuil AND attendu = predit) AS justes_perdus, round(avg((score < seuil)::INT), 6) AS taux FROM pred CROSS JOIN (SELECT unnest([0.1, 0.2, 0.3, 0.4, 0.5]) AS seuil) GROUP BY 1"),
        "score_quantiles": sql(answers(), "SELECT attendu = predit AS juste, count(*) AS n, round(min(score), 6) AS mini, round(quantile_cont(score, 0.1), 6) AS c10, round(quantile_cont(score, 0.5), 6) AS mediane, round(quantile_cont(score, 0.9), 6) AS c90, round(max(score), 6) AS maxi FROM pred GROUP BY 1"),
        "expected_ranks": sql(answers(), "SELECT p.attendu, r.rang::INT AS rang, count(*) AS n FROM rang AS r JOIN pred AS p ON p.ex = r.ex AND p.attendu = r.rt GROUP BY 1, 2"),
        "confident_errors": sql(answers(), "SELECT ex, attendu, predit, round(score, 6) AS score FROM (SELECT * FROM pred WHERE attendu <> predit ORDER BY score DESC, ex LIMIT 10)"),
        "prediction_changes": sql(changes, "SELECT * FROM chg WHERE changement IS NOT NULL"),
        "sign_test": sql([*changes, "n AS (SELECT count(*) FILTER (changement = 'corrige') AS corriges, count(*) FILTER (changement = 'casse') AS casses FROM chg)"],
            "SELECT corriges, casses, round(CASE WHEN corriges + casses = 0 THEN 1.0 ELSE least(1.0, 2 * (SELECT sum(exp(lgamma(corriges + casses + 1) - lgamma(k + 1) - lgamma(corriges + casses - k + 1) - (corriges + casses) * ln(2))) FROM (SELECT unnest(range(greatest(corriges, casses), corriges + casses + 1)) AS k))) END, 6) AS p FROM n"),
        "error_causes": sql([*answers(), *TRAITS], """SELECT CASE WHEN coalesce(a.pauvre, true) OR coalesce(b.pauvre, true) THEN 'connaissance' WHEN coalesce(a.singulier, false) OR coalesce(b.singulier, false) THEN 'morphologie' WHEN coalesce(second = attendu AND ecart <= 0.05, false) THEN 'classe_multiple'
  WHEN coalesce(a.polysemique, false) OR coalesce(b.polysemique, false) THEN 'polysemie' ELSE 'autre' END AS cause, count(*) AS n FROM pred JOIN ex USING (ex) LEFT JOIN durs AS a ON a.terme = ex.A LEFT JOIN durs AS b ON b.terme = ex.B WHERE attendu <> predit GROUP BY 1"""),
        "polysemy_rates": sql([*answers(), *TRAITS], "SELECT coalesce(a.polysemique, false) OR coalesce(b.polysemique, false) AS polysemique, count(*) AS n, count(*) FILTER (attendu <> predit) AS erreurs, round(avg((attendu <> predit)::INT), 6) AS taux FROM pred JOIN ex USING (ex) LEFT JOIN durs AS a ON a.terme = ex.A LEFT JOIN durs AS b ON b.terme = ex.B GROUP BY 1"),
        "trait_ablation": _ablation(),
        "definiteness_symbols": sql(EX, "SELECT symbole, rt, count(*) AS n FROM (SELECT rt, 'DEF:' || unnest([det, definitude]) AS symbole FROM ex) WHERE symbole IS NOT NULL GROUP BY ALL"),
        "stratified_folds": sql(EX, "SELECT graine, ex, least(r // greatest(1, n // 5), 4)::INT AS pli FROM (SELECT graine, ex, row_number() OVER (PARTITION BY graine, rt ORDER BY md5(graine || '|' || ex), ex) - 1 AS r, count(*) OVER (PARTITION BY graine, rt) AS n FROM ex CROSS JOIN (SELECT unnest([42, 43])::INT AS graine) WHERE split = 'train')"),
        "missing_tasks": sql(MEASURES, "SELECT cle, graine, pli FROM (SELECT DISTINCT cle FROM mes) CROSS JOIN (SELECT unnest(range(1, 9))::INT AS graine) CROSS JOIN (SELECT unnest(range(5))::INT AS pli) WHERE (cle, graine, pli) NOT IN (SELECT (cle, graine, pli) FROM mes)"),
        "complete_measures": sql(MEASURES, "SELECT cle, graine, pli, round(f1, 6) AS f1 FROM mes WHERE cle IN (SELECT cle FROM mes GROUP BY cle HAVING count(*) = 35)"),
        "aggregate_measures": sql([MEASURES, "a AS (SELECT cle, count(*) AS n, avg(f1) AS f1_moyen, stddev_samp(f1) AS ecart_type FROM mes GROUP BY cle)", "b AS (SELECT * FROM a ORDER BY f1_moyen DESC, cle DESC LIMIT 1)"], "SELECT a.cle, a.n, round(a.f1_moyen, 6) AS f1_moyen, round(a.ecart_type, 6) AS ecart_type, a.f1_moyen >= b.f1_moyen - coalesce(b.ecart_type, 0) AS indistinct FROM a CROSS JOIN b"),
        "paired_differences": sql([MEASURES, "d AS (SELECT m.cle, m.f1 - r.f1 AS d FROM mes AS m JOIN mes AS r ON r.cle = 'AF' AND r.graine = m.graine AND r.pli = m.pli)"], "SELECT cle, round(avg(d), 6) AS gain, round(stddev_samp(d), 6) AS ecart, avg(d) > coalesce(stddev_samp(d), 0) AS bat, abs(avg(d)) <= coalesce(stddev_samp(d), 0) AS indistinct FROM d GROUP BY cle"),
        "choose_simplest": sql([MEASURES, "a AS (SELECT cle, avg(f1) AS f1, ascii(substr(cle, 2, 1)) AS rang, ascii(cle) AS place FROM mes GROUP BY cle)", "b AS (SELECT cle FROM a ORDER BY f1 DESC, place LIMIT 1)", "d AS (SELECT m.cle, avg(t.f1 - m.f1) AS m, stddev_samp(t.f1 - m.f1) AS s FROM mes AS m JOIN mes AS t ON t.graine = m.graine AND t.pli = m.pli WHERE t.cle = (SELECT cle FROM b) GROUP BY m.cle)"],
            "SELECT cle, rang, round(f1, 6) AS f1_moyen FROM a JOIN d USING (cle) WHERE m <= coalesce(s, 0) ORDER BY rang, f1 DESC, place LIMIT 1"),
        "wilcoxon_exact": sql([MEASURES, "s AS (SELECT cle, graine, round(avg(f1), 9) AS f1 FROM mes GROUP BY ALL)", "d AS (SELECT a.cle, a.graine, round(a.f1 - r.f1, 9) AS d FROM s AS a JOIN s AS r ON r.cle = 'AF' AND r.graine = a.graine WHERE a.cle <> 'AF')",
            "k AS (SELECT cle, d, rank() OVER (PARTITION BY cle ORDER BY abs(d)) + (count(*) OVER (PARTITION BY cle, abs(d)) - 1) / 2 AS r, row_number() OVER (PARTITION BY cle ORDER BY graine) - 1 AS i FROM d WHERE abs(d) > 1e-9)", "t AS (SELECT cle, count(*) AS n, sum(CASE WHEN d > 0 THEN r ELSE 0 END) AS w, sum(r) / 2 AS h FROM k GROUP BY cle)",
            "m AS (SELECT cle, unnest(range(1 << n::INT)) AS masque FROM t)", "x AS (SELECT m.cle, masque, sum(CASE WHEN (masque >> i) & 1 = 1 THEN r ELSE 0 END) AS w FROM m JOIN k USING (cle) GROUP BY ALL)"],
            "SELECT t.cle, t.n, t.w::DOUBLE AS w_plus, round(avg((abs(x.w - h) >= abs(t.w - h) - 1e-9)::INT), 6) AS p FROM t JOIN x USING (cle) GROUP BY ALL"),
        "average_ranks": "SELECT id, (rank() OVER (PARTITION BY type ORDER BY w) + (count(*) OVER (PARTITION BY type, w) - 1) / 2)::DOUBLE AS rang_moyen FROM noeuds WHERE w IS NOT NULL",
        "reproducibility": sql(MEASURES, "SELECT count(*) AS n, count(*) FILTER (f1 = round(f1, 4)) AS egaux, round(max(abs(f1 - round(f1, 4))), 6) AS ecart_max FROM mes"),
    }
    return q
