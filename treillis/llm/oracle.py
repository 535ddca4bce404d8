"""SQL for those queries of this package that SQL can express over whole tables."""
from __future__ import annotations

_NORMAL = r"lower(regexp_replace({}, '[\s\pZ\pP!-/:-@\[-`{{-~\x85\x1C-\x1F]+', '', 'g'))"
_COPIES = f"""formes AS (SELECT enr_id, {_NORMAL.format('forme_normalisee')} AS f, list_sort(list_transform(H, lambda x: CASE WHEN x IS NULL THEN NULL ELSE
  {{'a': {_NORMAL.format('x.forme_normalisee')}, 'b': x.lang_prefix, 'c': {_NORMAL.format('x.nom')}, 'd': x.poids, 'e': x.type_noeud}} END)) AS entrees FROM termes_jdm WHERE forme_normalisee IS NOT NULL AND H IS NOT NULL),
groupes AS (SELECT enr_id, min(enr_id) OVER (PARTITION BY f, entrees) AS premier FROM formes)"""
_VALUES = """valeurs AS (SELECT enr_id, 'H' AS trait, unnest(H).forme_normalisee AS symbole FROM termes_jdm UNION ALL SELECT enr_id, 'TRT', unnest(TRT).type FROM termes_jdm UNION ALL SELECT enr_id, 'SST', unnest(SST).tag FROM termes_jdm),
comptes AS (SELECT trait, symbole, count(*) AS n_occurrences, count(DISTINCT enr_id) AS n_fiches FROM valeurs WHERE symbole IS NOT NULL GROUP BY ALL),
marques AS (SELECT *, CASE WHEN n_fiches <= 2 THEN 'rare' WHEN n_fiches > 0.2 * (SELECT count(*) FROM termes_jdm) THEN 'commun' END AS marque FROM comptes)"""
_SETS = """ensembles AS (SELECT DISTINCT enr_id AS id, 0 AS ref, trait, symbole FROM valeurs WHERE symbole IS NOT NULL UNION ALL SELECT DISTINCT ref_id, 1, trait, symbole FROM signatures_ref WHERE trait IS NOT NULL AND symbole IS NOT NULL),
tailles AS (SELECT id, ref, count(*) AS n FROM ensembles GROUP BY ALL HAVING count(*) >= 12),
grands AS (SELECT * FROM ensembles JOIN tailles USING (id, ref)),
communs AS (SELECT a.id AS id_a, b.id AS id_b, b.ref AS ref_b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c FROM grands AS a JOIN grands AS b ON a.trait = b.trait AND a.symbole = b.symbole
  AND a.ref = 0 AND (b.ref = 1 OR a.id < b.id) GROUP BY a.id, b.id, b.ref)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p3_found": f"WITH {_COPIES} SELECT premier AS enr_id_a, enr_id AS enr_id_b FROM groupes WHERE premier <> enr_id",
        "p3_records": f"WITH {_COPIES} SELECT premier AS enr_id, count(*) AS n_copies FROM groupes GROUP BY 1 UNION ALL SELECT enr_id, 1 FROM termes_jdm WHERE forme_normalisee IS NULL OR H IS NULL",
        "p4_found": f"WITH {_VALUES} SELECT trait, symbole, marque FROM marques WHERE marque IS NOT NULL",
        "p4_counts": f"WITH {_VALUES} SELECT trait, symbole, n_occurrences, n_fiches, marque FROM marques",
        "p5_found": f"WITH {_VALUES.split(',\ncomptes')[0]}, {_SETS} SELECT least(id_a, id_b) AS id_a, greatest(id_a, id_b) AS id_b FROM communs WHERE 10 * c >= 7 * (na + nb - c)",
        "p5_links": f"""WITH {_VALUES.split(',\ncomptes')[0]}, {_SETS}, proches AS (SELECT id_a, id_b, ref_b FROM communs WHERE 10 * c >= 7 * (na + nb - c)),
bouts AS (SELECT id, ref, count(*) AS n FROM (SELECT id_a AS id, 0 AS ref FROM proches UNION ALL SELECT id_b, ref_b FROM proches) GROUP BY ALL),
entiers AS (SELECT id, ref, list_sort(list(trait || chr(31) || symbole)) AS v FROM grands GROUP BY id, ref)
SELECT e.id, e.ref = 1 AS reference, min(2 * e.id + e.ref) OVER (PARTITION BY v) AS classe, count(*) OVER (PARTITION BY v) AS n_classe, coalesce(n, 0) AS n_liens FROM entiers AS e LEFT JOIN bouts USING (id, ref)""",
    }
