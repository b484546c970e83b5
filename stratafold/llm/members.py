"""Rows by keys of a few of them, without moving the rest.

A join by a key moves every row of both sides. Here the keys of the small side first mark bits in at most ``WORDS`` words of 64, which go to every task: a row whose bits are not
all marked has none of the keys and stays where it is; the others are joined exactly. More keys than the words can tell apart let more rows into the join, with the same result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORDS = 1 << 20


def _place(key: str) -> tuple[F.Column, F.Column]:
    """The word of a key and its two bits there."""
    h = f"xxhash64(`{key}`)"
    bits = " | ".join(f"shiftleft(1L, cast(shiftrightunsigned({h}, {at}) & 63 as int))" for at in (40, 50))
    return F.expr(f"{h} & {WORDS - 1}L"), F.expr(bits)


def _marked(rows: DataFrame, keys: DataFrame, key: str, how: str) -> DataFrame:
    word, bits = _place(key)
    words = keys.select(word.alias("__word"), bits.alias("__marks")).groupBy("__word").agg(F.expr("bit_or(__marks)").alias("__marks"))
    return rows.withColumn("__word", word).withColumn("__bits", bits).join(F.broadcast(words), "__word", how)


def possible(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows whose ``key`` is in ``keys``, and few others; ``keys`` is read once."""
    return _marked(rows, keys, key, "inner").filter("(__marks & __bits) = __bits").select(*(f"`{c}`" for c in rows.columns))


def without(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows whose ``key`` is not in ``keys``; ``rows`` is read twice, ``keys`` three times."""
    clear = _marked(rows, keys, key, "left").filter("__marks is null or (__marks & __bits) <> __bits").select(*(f"`{c}`" for c in rows.columns))
    return clear.unionByName(possible(rows, keys, key).join(keys.select(key), key, "left_anti").select(*(f"`{c}`" for c in rows.columns)))
