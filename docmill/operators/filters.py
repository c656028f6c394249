"""Rows whose key may be among wanted ones, by a small filter that is broadcast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def free_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have, in any case."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


#: Bits of the filter of :func:`possibly_in` for each wanted key, and the least and most bits; it is broadcast as at most MOST_BITS / 64 rows.
FILTER_ROOM, LEAST_BITS, MOST_BITS = 16, 1 << 16, 1 << 26


def possibly_in(rows: DataFrame, key: Column, wanted: DataFrame, wanted_key: Column, marks: int = 1) -> DataFrame:
    """Those of ``rows`` whose ``key`` may be among the ``wanted_key``: all that are, and few others.

    Keys are hashes of 64 bits. The filter has :data:`FILTER_ROOM` bits for each
    of ``wanted``, which should be a written table since it is counted; more than
    a filter of :data:`MOST_BITS` can tell apart are not filtered at all. With two ``marks`` (bits a key) fewer others pass.
    """
    n = wanted.count()
    if 2 * n > MOST_BITS:
        return rows
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (FILTER_ROOM * n).bit_length()))
    place, held = free_name(rows, "place"), free_name(rows, "held")

    def word(h: Column) -> Column:
        return F.pmod(F.shiftright(h, 6), F.lit(bits // 64))

    def bit(h: Column) -> Column:
        one = lambda x: F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(x, F.lit(64)).cast("int"))
        return one(h) if marks == 1 else one(h).bitwiseOR(one(F.shiftright(h, 40)))

    filled = wanted.groupBy(word(wanted_key).alias(place)).agg(F.bit_or(bit(wanted_key)).alias(held))
    return rows.join(F.broadcast(filled), word(key) == F.col(place)).filter(F.col(held).bitwiseAND(bit(key)) == bit(key)).select(*rows.columns)
