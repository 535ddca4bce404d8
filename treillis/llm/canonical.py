"""Problem 1: one consistent form of equal-looking text.

Consistent form: accents composed, letters and digits in their ordinary form and width, ordinary spaces,
nothing invisible, and Latin letters in words that have a Latin letter. Words wholly in another script,
letter case, punctuation, tabs and runs of plain spaces stay.

A quick-check property of every code point, worked out from the Unicode data, says whether it can stand in
a changed segment. Texts whose characters are all stable are told apart inside the JVM and never leave it.
In the others only the unstable segments, with the starter before them as context, are normalised and put
back between the unchanged parts.

Defined cases: null stays null, the empty text stays empty; texts of any length are worked on whole; rows
repeat as they are in the input; no other column is read.
"""
from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import cache, reduce

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treillis.session import bound_arrow_batches

#: Ranges of the Unicode property Default_Ignorable_Code_Point.
IGNORABLE = (
    (0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x200B, 0x200F),
    (0x202A, 0x202E), (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0), (0xFFF0, 0xFFF8),
    (0x1BCA0, 0x1BCA3), (0x1D173, 0x1D17A), (0xE0000, 0xE0FFF),
)
#: Letters of other scripts and the Latin letters that look the same.
LOOK_ALIKE = {
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "ӏ": "l", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "ԝ": "w", "х": "x", "у": "y",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ԛ": "Q", "Ѕ": "S", "Т": "T", "Ԝ": "W", "Х": "X", "У": "Y",
    "α": "a", "ι": "i", "ν": "v", "ο": "o", "ρ": "p", "υ": "u", "ϲ": "c", "ϳ": "j",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "զ": "q", "հ": "h", "ո": "n", "ս": "u", "ց": "g", "օ": "o", "Լ": "L", "Ս": "U", "Տ": "S", "Օ": "O",
    "Ꭰ": "D", "Ꭱ": "R", "Ꭲ": "T", "Ꭵ": "i", "Ꭺ": "A", "Ꭻ": "J", "Ꭼ": "E", "Ꮃ": "W", "Ꮇ": "M", "Ꮋ": "H", "Ꮐ": "G", "Ꮓ": "Z", "Ꮩ": "V", "Ꮪ": "S", "Ꮮ": "L", "Ꮯ": "C", "Ꮲ": "P", "Ꮶ": "K", "Ᏼ": "B",
    "ꓐ": "B", "ꓑ": "P", "ꓓ": "D", "ꓔ": "T", "ꓖ": "G", "ꓗ": "K", "ꓙ": "J", "ꓚ": "C", "ꓜ": "Z", "ꓝ": "F", "ꓟ": "M", "ꓠ": "N", "ꓡ": "L", "ꓢ": "S", "ꓣ": "R", "ꓦ": "V", "ꓧ": "H", "ꓪ": "W", "ꓫ": "X", "ꓬ": "Y", "ꓮ": "A", "ꓰ": "E", "ꓲ": "I", "ꓳ": "O", "ꓴ": "U",
}
#: Kinds of compatibility decomposition that give another form or width of the same character, of any
#: character and of letters only.
SAME_CHARACTER = {"<wide>", "<narrow>", "<font>"}
SAME_LETTER = {"<compat>", "<initial>", "<medial>", "<final>", "<isolated>"}
#: Code points below this one are told apart in the JVM.
FAST_BELOW = 0x2100


class _Properties:
    """What each code point becomes by itself, and the class of unstable ones."""

    def __init__(self):
        ignorable = {c for a, b in IGNORABLE for c in range(a, b + 1)}
        self.simple: dict[int, str] = {}
        self.alike = {ord(k): v for k, v in LOOK_ALIKE.items()}
        unstable = set(ignorable)
        foreign = set(self.alike)
        for c in range(sys.maxunicode + 1):
            ch = chr(c)
            category = unicodedata.category(ch)
            if c in ignorable or (category == "Cc" and not ch.isspace()):
                self.simple[c] = ""
            elif category in ("Zs", "Zl", "Zp") and c != 0x20:
                self.simple[c] = " "
            elif (tag := unicodedata.decomposition(ch)) and tag[0] == "<":
                kind = tag.split(" ", 1)[0]
                if kind in SAME_CHARACTER or (kind in SAME_LETTER and category[0] == "L"):
                    self.simple[c] = unicodedata.normalize("NFKC", ch)
            elif tag and " " in tag:
                unstable.add(int(tag.split()[1], 16))  # may compose with what stands before it
                if ord(unicodedata.normalize("NFD", ch)[0]) in self.alike:
                    foreign.add(c)
            if c in self.simple or unicodedata.combining(ch) or 0x1161 <= c <= 0x11C2 or unicodedata.normalize("NFC", ch) != ch:
                unstable.add(c)
        self.foreign = foreign
        self.unstable = unstable

    @staticmethod
    def ranges(codes: set[int]) -> list[tuple[int, int]]:
        out: list[tuple[int, int]] = []
        for c in sorted(codes):
            if out and out[-1][1] == c - 1:
                out[-1] = (out[-1][0], c)
            else:
                out.append((c, c))
        return out


@cache
def _properties() -> _Properties:
    return _Properties()


@cache
def _patterns():
    p = _properties()

    def of(codes):
        return "".join(f"\\U{a:08X}-\\U{b:08X}" for a, b in p.ranges(codes) if not 0xD800 <= a <= 0xDFFF)

    # A segment: the starter before, then unstable characters only.
    return regex.compile(f"[^{of(p.unstable)}]?[{of(p.unstable)}]+"), regex.compile(f"[{of(p.foreign)}]"), regex.compile(r"[\p{L}\p{M}]+"), regex.compile(r"\p{Script=Latin}")


def stable_pattern() -> str:
    """A Java pattern for texts all of whose characters are below FAST_BELOW and stable."""
    p = _properties()
    good = set(range(FAST_BELOW)) - p.unstable - p.foreign
    return "^[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in p.ranges(good)) + "]*\\z"


def consistent_text(text: str) -> str:
    """The consistent form of one text."""
    segment, foreign, word, latin = _patterns()
    simple, alike = _properties().simple, _properties().alike
    if segment.search(text):
        text = segment.sub(lambda m: unicodedata.normalize("NFC", m.group().translate(simple)), text)
    if foreign.search(text):
        def latinised(m):
            w = m.group()
            return unicodedata.normalize("NFC", unicodedata.normalize("NFD", w).translate(alike)) if latin.search(w) and foreign.search(w) else w

        text = word.sub(latinised, text)
    return text


@F.arrow_udf(T.StringType())
def _consistent(values: pa.Array) -> pa.Array:
    return pa.array([None if v is None else consistent_text(v) for v in values.to_pylist()], pa.string())


def consistent(value: Column) -> Column:
    """The consistent form of a column; stable texts don't go through Python."""
    return F.coalesce(_consistent(F.when(~value.rlike(stable_pattern()), value)), value)


def comparable(value: Column) -> Column:
    """Consistent form in lower case."""
    return F.lower(consistent(value))


def inconsistent(values: DataFrame) -> DataFrame:
    """Of rows (tableau, cle, champ, valeurs ARRAY<STRING>) those with a value that isn't in consistent form."""
    bound_arrow_batches(values.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [any(v is not None and consistent_text(v) != v for v in row) for row in batch.column(3).to_pylist()]
            yield batch.select([0, 1, 2]).filter(pa.array(keep, pa.bool_()))

    pattern = stable_pattern()
    some = values.withColumn("valeurs", F.filter("valeurs", lambda v: v.isNotNull() & ~v.rlike(pattern))).filter(F.size("valeurs") > 0)
    return some.select("tableau", "cle", "champ", "valeurs").mapInArrow(run, "tableau string, cle bigint, champ string")


def value_rows(frame: DataFrame, name: str, key: str, fields: dict[str, Column]) -> DataFrame:
    """The rows inconsistent() takes, from arrays of values by field."""
    pairs = F.array(*[F.struct(F.lit(f).alias("champ"), v.alias("valeurs")) for f, v in fields.items()])
    return frame.select(F.lit(name).alias("tableau"), F.col(key).cast("long").alias("cle"), F.explode(pairs).alias("_p")).select("tableau", "cle", "_p.champ", "_p.valeurs")


def found(corpus: DataFrame, records: DataFrame) -> DataFrame:
    """Each value of the corpus and of the collected records that differs from its consistent form."""
    rows = [
        value_rows(corpus, "corpus_r_processus_instr_1", "ligne_id", {c: F.array(c) for c in ("syntagme", "A", "B")}),
        value_rows(records, "termes_jdm", "enr_id", {"forme_normalisee": F.array("forme_normalisee"), "H": F.transform("H", lambda h: h["forme_normalisee"])}),
    ]
    return inconsistent(reduce(DataFrame.union, rows))
