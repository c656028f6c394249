"""Column expressions that several training-data operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docmill.operators.filters import free_name, possibly_in  # noqa: F401

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: U+0020 and U+0009 to U+000D, as SQL text and as a Java character class.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_CLASS = r"[\x20\x09-\x0D]"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; a pure ASCII text takes the byte-wise way."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def words(text: Column) -> Column:
    """The runs of ``[^\\x20\\x09-\\x0D]``, in order."""
    bare = F.btrim(text, F.lit(BLANKS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, BLANK_CLASS + "+", -1))


def unit_hash(*cols: Column) -> Column:
    """A number in [0, 1) that depends on the columns' values only."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11) * F.lit(2.0**-53)
