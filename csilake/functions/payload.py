"""The signal payload: bracketed text, array of signed values, pair magnitudes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def payload_text(values: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(values.cast("array<string>"), ","), F.lit("]"))


def payload_array(text: Column) -> Column:
    """Bracketed text to integers; null when the text is cut off or holds anything else."""
    return F.from_json(text, "array<int>")


def pair_magnitudes(values: Column, first_word: Column) -> Column:
    """``[{pair, magnitude}]`` with ``sqrt(a*a + b*b)`` per value pair.

    A set first_word flag marks the first four values (two pairs) as invalid; they are left out.
    """
    first = F.when(first_word == 1, F.lit(2)).otherwise(F.lit(0))
    last = F.floor(F.size(values) / 2).cast("int") - 1
    pairs = F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))

    def magnitude(pair: Column) -> Column:
        a = F.get(values, pair * 2)
        b = F.get(values, pair * 2 + 1)
        return F.struct(pair.alias("pair"), F.sqrt((a * a + b * b).cast("double")).alias("magnitude"))

    return F.transform(pairs, magnitude)
