"""Joins that keep a hot key from landing in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cleanframe.functions.columns import ref

HOT_ROWS = 1_000_000
SALTS = 64


def row_salt(df: DataFrame, salts: int = SALTS) -> Column:
    """A number below `salts` from a hash of the whole row: the same again when a lost task is repeated."""
    return F.pmod(F.xxhash64(*[ref(c) for c in df.columns]), F.lit(salts).cast("long"))


def all_salts(salts: int = SALTS) -> Column:
    return F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))


def _nullable(dtype: T.DataType) -> T.DataType:
    """A struct type whose fields may be NULL: a table read from files has these, the same one computed may not."""
    return T.StructType([T.StructField(f.name, _nullable(f.dataType)) for f in dtype]) if isinstance(dtype, T.StructType) else dtype


def spread_lookup(big: DataFrame, small: DataFrame, keys: list[str], how: str = "inner",
                  counted: DataFrame | None = None, most_rows: int | None = None) -> DataFrame:
    """Equi-join `big` to `small`, where `small` holds few rows per key but a key of `big` may be hot.

    Keys with more than HOT_ROWS rows are found by a count over key hashes, which is combined before it is
    shuffled. Only their rows are divided into salts, and only their rows in `small` are repeated. There are at
    most rows / HOT_ROWS of them (a million for 10^12 rows), which bounds what is broadcast.

    The keys are counted in `counted` if given: the table `big` was derived from, when deriving it again for the
    count would cost more. A caller who knows that `big` has at most `most_rows` rows, too few for a hot key,
    saves the count.
    """
    counted = big if counted is None else counted
    if most_rows is not None and most_rows <= HOT_ROWS:
        return big.join(small, keys, how)

    def key_hash() -> Column:
        return F.xxhash64(*[ref(k).cast(_nullable(big.schema[k].dataType)) for k in keys])

    hot = (counted.select(key_hash().alias("_hash")).groupBy("_hash").agg(F.count("*").alias("_n"))
           .where(F.col("_n") > HOT_ROWS).select("_hash", F.lit(True).alias("_hot")))

    def salted(df: DataFrame, salt: Column) -> DataFrame:
        flagged = df.withColumn("_hash", key_hash()).join(F.broadcast(hot), "_hash", "left")
        return flagged.withColumn("_salt", salt).drop("_hash", "_hot")

    none = F.lit(0).cast("long")
    spread = salted(big, F.when(F.col("_hot"), row_salt(big)).otherwise(none))
    repeated = salted(small, F.explode(F.when(F.col("_hot"), all_salts()).otherwise(F.array(none))))
    return spread.join(repeated, [*keys, "_salt"], how).drop("_salt")
