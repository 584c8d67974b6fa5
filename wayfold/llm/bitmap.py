"""Bitmaps of bounded size that tell which rows can't have a partner before anything is moved."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of 64 bits that a bitmap has at most, however many values it stands for (the sent table is about 30 MB); a power of two.
WORDS = 1 << 20


def word(h: Column, words: int = WORDS) -> Column:
    return h.bitwiseAND(F.lit(words - 1).cast("long"))


def mask(h: Column) -> Column:
    """Up to three bits of a word, from a 64-bit hash."""
    one = lambda shift: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(h, shift).bitwiseAND(F.lit(63).cast("long")).cast("int"))
    return one(24).bitwiseOR(one(34)).bitwiseOR(one(44))


def bitmap(hashes: DataFrame, flags: dict[str, Column], words: int = WORDS) -> DataFrame:
    """hashes: h (64-bit). Returns _word and, under each name, the bits of the rows for which its flag holds."""
    bits = [F.coalesce(F.bit_or(F.when(flag, mask(F.col("h")))), F.lit(0)).cast("long").alias(name) for name, flag in flags.items()]
    return hashes.groupBy(word(F.col("h"), words).alias("_word")).agg(*bits)


def known(bits: Column, h: Column) -> Column:
    """Whether a value of that hash may be in a bitmap; true for all that are."""
    return F.bitwise_not(bits).bitwiseAND(mask(h)) == 0


def probed(df: DataFrame, h: Column, filled: DataFrame, words: int = WORDS) -> DataFrame:
    """df with the bits of each row's word; rows whose word is empty go. The bitmap has ``words`` lines at most, so it is sent."""
    return df.withColumn("_word", word(h, words)).join(F.broadcast(filled), "_word").drop("_word")
