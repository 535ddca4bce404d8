"""A bitmap of hashed keys, of bounded size, that keeps rows nobody asks for out of a shuffle."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treillis.session import cut

#: Bits (as a power of two) of a bitmap: at most 2**17 rows of 64 bits, whatever the number of keys.
BITMAP = 23


def _slot(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(1 << BITMAP)).cast("long")


def maybe_in(rows: DataFrame, key: str, asked: DataFrame, asked_key: str) -> DataFrame:
    """The rows whose key may be among the keys of ``asked``: all that are, and few others while these are fewer than bits.

    Null keys are hashed like others. A join has to follow."""
    words = asked.select(_slot(F.col(asked_key)).alias("__bm_h")).groupBy(F.shiftright("__bm_h", 6).alias("__bm_word")).agg(F.expr("bit_or(shiftleft(1L, cast(__bm_h & 63 as int)))").alias("__bm_bits"))
    marked = rows.withColumn("__bm_h", _slot(F.col(key)))
    some = marked.join(F.broadcast(cut(words)), F.shiftright("__bm_h", 6) == F.col("__bm_word")).filter("bit_get(__bm_bits, cast(__bm_h & 63 as int)) = 1")
    return some.select(*rows.columns)
