"""Schemas, fixed values and the configuration record."""
from __future__ import annotations

from dataclasses import dataclass, replace

#: A collected record.
ENTRY = "struct<nom: string, poids: double, type_noeud: bigint, lang_prefix: boolean, forme_normalisee: string>"
RECORD_SCHEMA = (
    "terme string, collecte_utc string, existe boolean, noeud struct<id: bigint, type: string, poids: double>, "
    f"H array<{ENTRY}>, TRT array<struct<type: string, n: bigint>>, SST array<struct<tag: string, poids: double, morpho: boolean>>, "
    "raffinements array<struct<nom: string, poids: double>>, "
    f"diagnostic_singulier struct<forme_testee: string, raison: string, existe: boolean, H_taille: int, H: array<{ENTRY}>>"
)
CLEAN_COLUMNS = ["syntagme", "A", "B", "relation", "split", "det", "definitude", "ambigu", "candidats"]
CLEAN_SCHEMA = ", ".join(f"{c} string" for c in CLEAN_COLUMNS)

#: Relation types that say nothing about a term's meaning, and morphological tags.
EXCLUDED_TYPES = (
    "r_aki", "r_wiki", "r_associated", "r_context", "r_variante", "r_translation", "r_lemma", "r_meaning/glose",
    "r_raff_sem-1", "r_sing_form", "r_der_morpho", "r_masc", "r_homophone", "r_locution", "r_error",
)
MORPHOLOGICAL_TAGS = ("DET", "NODET", "PLUR", "SING", "PLURIEL", "SINGULIER", "MASC", "FEM", "GENRE-MASC", "GENRE-FEM", "INV")
#: Fixed values of the method: entries of H kept, rank of the percentile, share of a frequent type, size of a poor
#: signature, largest isolate, share of a tight gap.
TOP_H, PERCENTILE, FREQUENT_SHARE, POOR, ISOLATE, TIGHT = 20, 0.66, 0.80, 3, 3, 0.05
IDF_FAMILY, WEIGHTED_TRAITS = ("idf", "jdm_idf"), {"jdm": ("H", "TRT", "SST"), "jdm_idf": ("H", "TRT", "SST"), "jdm_H": ("H",), "jdm_TRT": ("TRT",), "jdm_SST": ("SST",), "binaire": (), "idf": ()}


@dataclass(frozen=True)
class Config:
    """A configuration of the signatures; the order of the fields is that of complexity.

    ``h`` is the number of H entries kept (None: all), ``weighting`` one of WEIGHTED_TRAITS, ``term`` T0 (the bare
    term is a symbol), T1 (as an H symbol) or T2 (none), ``trt`` tous, aucun, sans_frequents or centile, ``sst``
    toutes, aucune or sans_morpho, ``df_min`` the least document frequency."""

    h: int | None = TOP_H
    weighting: str = "jdm"
    term: str = "T2"
    trt: str = "tous"
    sst: str = "toutes"
    df_min: int = 1

    @property
    def key(self) -> str:
        return "|".join(str(x) for x in ("tous" if self.h is None else self.h, self.weighting, self.term, self.trt, self.sst, self.df_min))

    @classmethod
    def of(cls, key: str) -> Config:
        h, weighting, term, trt, sst, df = key.split("|")
        return cls(None if h == "tous" else int(h), weighting, term, trt, sst, int(df))

    def but(self, **changes) -> Config:
        return replace(self, **changes)


RETAINED = Config()
REFERENCE = Config(weighting="binaire", term="T0")
#: The values searched, simplest first.
SEARCH = {
    "term": ("T2", "T0", "T1"),
    "h": (20, 50, 100, 200, None),
    "weighting": ("binaire", "idf", "jdm", "jdm_idf"),
    "trait_weighting": ("jdm_H", "jdm_TRT", "jdm_SST"),
    "trt": ("tous", "aucun", "sans_frequents", "centile"),
    "sst": ("toutes", "aucune", "sans_morpho"),
    "df_min": (1, 2),
}
