"""The 32-bit key hash that orders an object's entries, and its buckets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEED = 0x6BADBEEF  # fixed value
MASK = 0xFFFFFFFF


def khash_of(key: str, signed: bool = False) -> int:
    """The hash of one key; ``signed`` takes bytes above 127 as negative, as some writers do."""
    a = SEED
    for b in key.encode("utf-8", "surrogatepass"):
        if signed and b > 127:
            b -= 256
        a = (a ^ (a << 13)) & MASK
        a = (a + ((a ^ b) << 8)) & MASK
    return a


def khash(key: Column) -> Column:
    """The hash of a key column (unsigned bytes), as BIGINT, by built-in functions. NULL for NULL."""
    data = F.encode(key.cast("string"), "UTF-8")
    size = F.octet_length(key.cast("string"))
    places = F.when(size > 0, F.sequence(F.lit(1), size)).otherwise(F.array().cast("array<int>"))
    codes = F.transform(places, lambda i: F.conv(F.hex(F.substring(data, i, F.lit(1))), 16, 10).cast("bigint"))

    def step(a: Column, b: Column) -> Column:
        mixed = a.bitwiseXOR(F.shiftleft(a, 13)).bitwiseAND(MASK)
        return (mixed + F.shiftleft(mixed.bitwiseXOR(b), 8)).bitwiseAND(MASK)

    return F.when(key.isNotNull(), F.aggregate(codes, F.lit(SEED).cast("bigint"), step))


def khash_bucket(hashed: Column, buckets: int = 128) -> Column:
    """The bucket of a hash: equal ranges of the 32-bit space, so that order is kept."""
    if buckets < 1 or (1 << 32) % buckets:
        raise ValueError("the number of buckets must divide 2^32")
    return F.floor(hashed / F.lit((1 << 32) // buckets)).cast("int")
