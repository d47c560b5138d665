"""Doubles as 64-bit integers that sort the same way.

The key of a positive double is its IEEE 754 bit pattern, that of a negative
one the negated pattern of its magnitude, and both zeros are 0.  Spark has no
function for the bits, so exponent and fraction are found by arithmetic that is
exact at every step: powers of two, and products with them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FRACTION = 52                  # bits of the fraction
BIAS = 1023                    # of the exponent
_HALF_WAY = 537                # 2^-1074, the least double, is the square of 2^-537


def _power(e: Column) -> Column:
    return F.pow(F.lit(2.0), e.cast("double"))


def with_order_key(df: DataFrame, value: str, key: str) -> DataFrame:
    """``df`` plus the key of the double column ``value`` (neither NULL nor NaN)."""
    size, exponent = f"__{key}_a", f"__{key}_e"
    a, e = F.col(size), F.col(exponent)
    normal = a >= 2.0 ** -1022
    out = df.withColumn(size, F.abs(F.col(value)))
    # the logarithm may round across a power of two, never further
    out = out.withColumn(exponent, F.when(normal & (a < float("inf")), F.floor(F.log2(a))))
    out = out.withColumn(exponent, e - (_power(e) > a).cast("int") + (_power(e + 1) <= a).cast("int"))
    bits = (F.when(a == float("inf"), F.lit((2 * BIAS + 1) << FRACTION))
            .when(normal, F.shiftleft(e + BIAS, FRACTION)
                  + ((a * _power(-e) - 1.0) * 2.0 ** FRACTION).cast("bigint"))
            .otherwise((a * 2.0 ** _HALF_WAY * 2.0 ** _HALF_WAY).cast("bigint")))
    return out.withColumn(key, F.when(F.col(value) < 0, -bits).otherwise(bits)).drop(size, exponent)


def from_order_key(key: Column) -> Column:
    """The double of a key."""
    bits = F.abs(key)
    e = F.shiftright(bits, FRACTION)
    m = bits.bitwiseAND(F.lit((1 << FRACTION) - 1)).cast("double")
    size = (F.when(e == 2 * BIAS + 1, F.lit(float("inf")))
            .when(e == 0, m * 2.0 ** -_HALF_WAY * 2.0 ** -_HALF_WAY)
            .otherwise((1.0 + m * 2.0 ** -FRACTION) * _power(e - BIAS)))
    return F.when(key < 0, -size).otherwise(size)
