import random
import unicodedata

from pyspark.sql import functions as F

from treillis.llm import canonical


def test_consistent_text():
    same = ["", "Écran de cinéma", "l’or\t d'été  x", "сосна", "λόγος", "x² ½ … Ⓐ", "a b"]
    assert [canonical.consistent_text(t) for t in same] == same
    cases = {
        "écran": "écran", "ｃｌé　－３": "clé -3", "𝖺𝐛𝚌": "abc", "ﬁn": "fin", "a­b​c﻿": "abc", "a b c d": "a b c d",
        "nèlaсо": "nèlaco", "datοdé": "datodé", "е́te": "éte", "e​́": "é", "́a": "́a", "ＰоRТ": "PoRT", "pin сосна": "pin сосна", "Åx": "Åx",
        "ẹ́ ọ́": "ẹ́ ọ́",
    }
    for text, want in cases.items():
        assert canonical.consistent_text(text) == unicodedata.normalize("NFC", want), text
        assert canonical.consistent_text(want) == want


def test_long_text_whole():
    text = ("abc " * 50_000) + "é" + (" xyz" * 50_000)
    assert canonical.consistent_text(text) == text.replace("é", "é")


def test_column_and_found(spark):
    rows = [(1, "a b", None, ""), (2, "ok", "ｘ", "сосна"), (3, None, None, None)]
    corpus = spark.createDataFrame(rows, "ligne_id bigint, syntagme string, A string, B string").withColumn("tableau", F.lit("x"))
    records = spark.createDataFrame([(1001, "é", [("é",), (None,), None]), (1002, "é", None), (1003, None, [])], "enr_id bigint, forme_normalisee string, H array<struct<forme_normalisee: string>>")
    got = {tuple(r) for r in canonical.found(corpus, records).collect()}
    assert got == {("corpus_r_processus_instr_1", 1, "syntagme"), ("corpus_r_processus_instr_1", 2, "A"), ("termes_jdm", 1001, "H"), ("termes_jdm", 1002, "forme_normalisee")}
    assert [r[0] for r in corpus.orderBy("ligne_id").select(canonical.consistent(F.col("syntagme"))).collect()] == ["a b", "ok", None]
    assert canonical.found(corpus.limit(0), records.limit(0)).count() == 0


def test_fast_pattern_is_safe(spark):
    texts = [(chr(c),) for c in range(1, canonical.FAST_BELOW)] + [(f"a{chr(c)}",) for c in range(1, canonical.FAST_BELOW)]
    fast = spark.createDataFrame(texts, "t string").filter(F.col("t").rlike(canonical.stable_pattern())).collect()
    assert len(fast) > 8000
    assert all(canonical.consistent_text(t) == t for (t,) in fast)


def test_segments_leave_nothing_unstable():
    properties = canonical._properties()
    rng = random.Random(11)
    unstable = sorted(c for c in properties.unstable if not 0xD800 <= c <= 0xDFFF)
    marks = [c for c in unstable if unicodedata.combining(chr(c))]
    base = [*map(ord, "aeiouAé ñqﬁ가각\tх"), 0x1100, 0x1161, 0x11A8, 0x200B, 0xAD, 0xA0, 0xFF41, 0x3099, 0x30AB]
    for _ in range(5_000):
        text = "".join(chr(rng.choice((rng.choice(base), rng.choice(unstable), rng.choice(marks)))) for _ in range(rng.randrange(1, 8)))
        out = canonical.consistent_text(text)
        assert unicodedata.is_normalized("NFC", out) and canonical.consistent_text(out) == out


def test_look_alikes_of_many_scripts():
    assert canonical.consistent_text("сanal cꓳpie Ꭺrbre pօmme") == "canal cOpie Arbre pomme"
    assert canonical.consistent_text("ꓐꓳ Ꭺ հայ") == "ꓐꓳ Ꭺ հայ"
