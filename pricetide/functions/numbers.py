"""Rounding as a correctly rounded decimal of the exact binary value, and the text of a double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pricetide.functions.text import let

#: 2^27 + 1: splits a double into two halves whose products are exact.
_SPLIT = 134_217_729.0


def rounded(x: Column, digits: int) -> Column:
    """``x`` (double) to ``digits`` decimals, by its exact value and ties to even; ``F.round`` goes by the shortest decimal text.

    32.675 is a little less than its text says and gives 32.67. The product with the power of ten is taken with its error, so
    no tie is made up or missed.
    """
    scale = float(10**digits)

    def of(v: Column) -> Column:
        high = let(v * _SPLIT, lambda c: c - (c - v))
        return let(F.struct((v * scale).alias("p"), high.alias("h")), lambda s: of_product(v, s["p"], s["h"]))

    def of_product(v: Column, p: Column, high: Column) -> Column:
        error = (high * scale - p) + (v - high) * scale
        low = F.floor(p).cast("double")
        side = (p - low - 0.5) + error
        up = (side > 0) | ((side == 0) & (low % 2 != 0))
        return F.when(F.abs(p) >= 2.0**52, v).otherwise((low + up.cast("double")) / scale)

    return let(x.cast("double"), of)


def double_text(x: Column) -> Column:
    """A double as the shortest text that reads back as it, written as Python and SQL engines do: whole from 1e-4 to below 1e16.

    A cast would write 12100000.0 as 1.21E7, and some doubles with a digit too many. From 1e17 on, where two texts of one length
    read back as the double, it may be the other one that Python takes.
    """

    def of_text(e: Column) -> Column:
        parts = F.struct(
            F.regexp_extract(e, r"^-", 0).alias("sign"),
            F.regexp_replace(F.regexp_replace(e, r"^-|\.|e.*$", ""), r"(?<=.)0+$", "").alias("digits"),
            F.regexp_extract(e, r"e(.*)$", 1).cast("int").alias("power"),
        )
        return let(parts, lambda p: F.concat(p["sign"], of_digits(p["digits"], p["power"])))

    def of_digits(digits: Column, power: Column) -> Column:
        tail, size = F.substring(digits, F.greatest(power, F.lit(0)) + 2, F.lit(17)), F.abs(power)
        small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -1 - power), digits)
        plain = F.concat(F.rpad(F.substring(digits, F.lit(1), power + 1), power + 1, F.lit("0")), F.lit("."), F.when(tail == "", "0").otherwise(tail))
        fraction = F.regexp_replace(F.concat(F.left(digits, F.lit(1)), F.lit("."), F.substring(digits, 2, 17)), r"\.$", "")
        far = F.concat(fraction, F.when(power < 0, "e-").otherwise("e+"), F.when(size < 10, "0").otherwise(""), size.cast("string"))
        return F.when((power < -4) | (power > 15), far).when(power < 0, small).otherwise(plain)

    def of(v: Column) -> Column:
        tried = lambda digits, longer: let(F.format_string(f"%.{digits - 1}e", v), lambda t: F.when(t.cast("double") == v, t).otherwise(longer))
        shortest = tried(15, tried(16, F.format_string("%.16e", v)))
        odd = F.when(F.isnan(v), "nan").when(v == float("inf"), "inf").when(v == float("-inf"), "-inf")
        return F.when(v.isNotNull(), F.coalesce(odd, let(shortest, of_text)))

    return let(x, of)
