"""Sets of whole numbers as bitmaps: small, mergeable, listed again at the end.

A number belongs to a bucket of 32,768 and to a bit of that bucket's bitmap. Sets of parts (days, files, batches) are united by
``or``, bucket by bucket, so a set over all parts needs no row again.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BITS = 32_768


def bucket(number: Column) -> Column:
    return F.bitmap_bucket_number(number.cast("bigint"))


def of_numbers(number: Column) -> Column:
    """Aggregate: the bitmap of the numbers of one bucket."""
    return F.bitmap_construct_agg(F.bitmap_bit_position(number.cast("bigint")))


def united(bitmap: Column) -> Column:
    """Aggregate: the union of bitmaps of one bucket."""
    return F.bitmap_or_agg(bitmap)


def numbers(bitmap: Column, bucket_number: Column) -> Column:
    """The numbers of a bitmap as an array. Buckets from 1 on count up from their start, 0 and below count down."""
    bits = F.filter(
        F.sequence(F.lit(0), F.lit(BITS - 1)),
        lambda i: F.conv(F.hex(F.substring(bitmap, (i / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int").bitwiseAND(F.pow(F.lit(2), i % 8).cast("int")) != 0,
    )
    up = (bucket_number - 1) * BITS + 1
    return F.transform(bits, lambda i: F.when(bucket_number > 0, up + i).otherwise(bucket_number * BITS - i))
