"""Problem 3: records that differ only in formatting, collapsed and counted.

Bottom-up hashing: leaves are normalised (texts without white space, punctuation and letter case, numbers
by value), the fields of a struct are hashed in the order of their names, the digests of an unordered array
are sorted before they are hashed. Records are grouped by root digest with sums before the shuffle, and
each is then compared with the first record of its group as a whole normalised structure. A record whose
structure differs (two structures with one digest) goes to the group of its own structure.

Defined cases: records with a null root field are left out of the comparison and count once; null and empty
are different leaves; repeated entries count as often as they stand; a group held by many records is
compared in salted parts, never gathered.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treillis.session import cut

#: Characters that formatting may change: white space and punctuation, of Unicode and of ASCII.
FORMATTING = r"[\s\p{Z}\p{P}\p{Punct}\x{85}\x{1C}-\x{1F}]+"
#: Members of one group compared in one part.
PART = 10_000


def normal_leaf(value: Column, kind: T.DataType) -> Column:
    return F.lower(F.regexp_replace(value, FORMATTING, "")) if isinstance(kind, T.StringType) else value


def normal_form(value: Column, kind: T.DataType) -> Column:
    """The normalised structure: fields by name, unordered arrays sorted."""
    if isinstance(kind, T.StructType):
        fields = [normal_form(value[f.name], f.dataType).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name)]
        return F.when(value.isNotNull(), F.struct(*fields))
    if isinstance(kind, T.ArrayType):
        return F.array_sort(F.transform(value, lambda x: normal_form(x, kind.elementType)))
    return normal_leaf(value, kind)


def digest(value: Column, kind: T.DataType) -> Column:
    """The digest of a node of a normalised structure."""
    if isinstance(kind, T.StructType):
        return F.xxhash64(value.isNull(), *[digest(value[f.name], f.dataType) for f in sorted(kind.fields, key=lambda f: f.name)])
    if isinstance(kind, T.ArrayType):
        return F.xxhash64(F.size(value), F.array_sort(F.transform(value, lambda x: digest(x, kind.elementType))))
    return F.xxhash64(value.isNull(), value)


def groups(records: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """``key`` and ``premier`` (the smallest key of its group) of every record without a null field."""
    whole = records.dropna(subset=fields)
    normal = whole.select(F.col(key).alias("_id"), F.struct(*[normal_form(F.col(f), whole.schema[f].dataType).alias(f) for f in fields]).alias("_forme"))
    kind = normal.schema["_forme"].dataType
    rooted = normal.withColumn("_racine", digest(F.col("_forme"), kind))
    sizes = rooted.groupBy("_racine").agg(F.min("_id").alias("_premier"), F.count("*").alias("_n"))
    several = cut(sizes.filter("_n > 1").withColumn("_parts", F.ceil(F.col("_n") / PART).cast("int")))
    single = sizes.filter("_n = 1").select(F.col("_premier").alias("_id"), "_premier")
    members = rooted.join(several, "_racine")
    salted = members.withColumn("_sel", F.pmod(F.xxhash64("_id"), F.col("_parts")).cast("int"))
    first = members.filter("_id = _premier").select("_racine", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_sel"), F.col("_forme").alias("_modele"))
    compared = cut(salted.join(first, ["_racine", "_sel"]).select("_id", "_premier", "_racine", F.when(~F.col("_forme").eqNullSafe(F.col("_modele")), F.col("_forme")).alias("_autre")))
    same = compared.filter("_autre is null").select("_id", "_premier")
    text = F.to_json("_autre", {"ignoreNullFields": "false"})
    others = compared.filter("_autre is not null").select("_id", text.alias("_texte"))
    apart = others.join(others.groupBy("_texte").agg(F.min("_id").alias("_premier")), "_texte").select("_id", "_premier")
    return single.union(same).union(apart).select(F.col("_id").alias(key), F.col("_premier").alias("premier"))


def copies(records: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Each copy but the smallest, with the smallest key of its group."""
    return groups(records, key, fields).filter(F.col(key) != F.col("premier")).select(F.col("premier").alias(f"{key}_a"), F.col(key).alias(f"{key}_b"))


def collapsed(records: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """One row for each group, with its number of copies; a record with a null field is a group of its own."""
    left_out = records.filter(F.greatest(*[F.col(f).isNull() for f in [*fields, *fields[:1]]])).select(F.col(key), F.lit(1).cast("long").alias("n_copies"))
    return groups(records, key, fields).groupBy(F.col("premier").alias(key)).agg(F.count("*").alias("n_copies")).union(left_out)
