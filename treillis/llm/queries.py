"""The queries pN_ of the operators in this package, each over its whole tables."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from treillis.llm import byte_bpe, canonical, formatting_dups, packing, set_join, shared_spans, split_overlap, splits, term_counts
from treillis.session import cut, table

#: Tokens a container of problem 9 holds.
CAPACITY = 2048
CORPUS, RECORDS = "corpus_r_processus_instr_1", "termes_jdm"
#: Fields that make two collected records copies.
COPY_FIELDS = ["forme_normalisee", "H"]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return canonical.found(table(spark, d, CORPUS), table(spark, d, RECORDS))


def p1_corpus(spark: SparkSession, d: str) -> DataFrame:
    """The corpus with its texts in consistent form."""
    return table(spark, d, CORPUS).select("ligne_id", *[canonical.consistent(F.col(c)).alias(c) for c in ("syntagme", "A", "B")])


def p1_records(spark: SparkSession, d: str) -> DataFrame:
    """The forms of the collected records, and of the entries of their H by place, in consistent form."""
    t = table(spark, d, RECORDS)
    own = t.select("enr_id", F.lit(-1).alias("rang"), F.col("forme_normalisee").alias("forme"))
    entries = t.select("enr_id", F.posexplode("H.forme_normalisee").alias("rang", "forme"))
    return own.union(entries).withColumn("forme", canonical.consistent(F.col("forme")))


def _groups(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, d, CORPUS)
    return rows, cut(splits.groups(rows, "ligne_id", [canonical.comparable(F.col(c)) for c in ("A", "B")]))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return splits.spread(*_groups(spark, d), "ligne_id", "split")


def p2_splits(spark: SparkSession, d: str) -> DataFrame:
    return splits.assign(*_groups(spark, d), "ligne_id", "relation")


def p2_shares(spark: SparkSession, d: str) -> DataFrame:
    rows, groups = _groups(spark, d)
    return splits.met_shares(rows, splits.assign(rows, groups, "ligne_id", "relation"), "ligne_id", "relation")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return formatting_dups.copies(table(spark, d, RECORDS), "enr_id", COPY_FIELDS)


def p3_records(spark: SparkSession, d: str) -> DataFrame:
    return formatting_dups.collapsed(table(spark, d, RECORDS), "enr_id", COPY_FIELDS)


def p4_counts(spark: SparkSession, d: str) -> DataFrame:
    records = table(spark, d, RECORDS)
    return term_counts.marked(term_counts.counts(term_counts.trait_values(records)), records.count())


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_counts(spark, d).filter("marque is not null").select("trait", "symbole", "marque")


def _joined(spark: SparkSession, d: str) -> set_join.SetJoin:
    return set_join.SetJoin(set_join.record_sets(table(spark, d, RECORDS)).union(set_join.reference_sets(table(spark, d, "signatures_ref"))))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _joined(spark, d).pairs()


def p5_links(spark: SparkSession, d: str) -> DataFrame:
    return _joined(spark, d).links()


def _overlap(spark: SparkSession, d: str) -> split_overlap.SplitOverlap:
    return split_overlap.SplitOverlap(table(spark, d, CORPUS), "ligne_id", "syntagme", ("A", "B"), "split")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _overlap(spark, d).pairs(("ligne_id_a", "ligne_id_b"))


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    return _overlap(spark, d).report("split", "fichier")


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return byte_bpe.token_ids(table(spark, d, "documents"), byte_bpe.VocabularyFile(spark))


def p8_totals(spark: SparkSession, d: str) -> DataFrame:
    return byte_bpe.token_totals(p8_ids(spark, d))


def _packed(spark: SparkSession, d: str) -> DataFrame:
    counts = byte_bpe.token_counts(table(spark, d, "documents"), byte_bpe.VocabularyFile(spark))
    return packing.pack(counts, "doc_id", "n_tokens", CAPACITY)


def p9_containers(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d)


def p9_usage(spark: SparkSession, d: str) -> DataFrame:
    return packing.usage(_packed(spark, d), CAPACITY)


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return shared_spans.SharedSpans(table(spark, d, "documents")).found()


def p10_passages(spark: SparkSession, d: str) -> DataFrame:
    return shared_spans.SharedSpans(table(spark, d, "documents")).passages()


def p10_shares(spark: SparkSession, d: str) -> DataFrame:
    return shared_spans.SharedSpans(table(spark, d, "documents")).shares()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = {name: f for name, f in globals().items() if name[0] == "p" and name[1:2].isdigit()}
    return dict(sorted(own.items(), key=lambda x: (int(x[0][1:].split("_")[0]), not x[0].endswith("_found"), x[0])))
