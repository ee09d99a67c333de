"""Fixed-decimal text of doubles: the exact binary value, rounded to 20 places, as C's ``printf`` prints it.

Spark's own formatting pads zeros after the shortest digits that give the double back. Here the fraction is
taken from the stored mantissa and exponent as limbs of 26 bits, and its digits are expanded five at a time: all limbs
are multiplied by 10^5, and what runs over the top are the next digits. What is left decides the rounding (to the
even digit on a tie). All of it is arithmetic on longs inside the plan, without a Python worker.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PLACES = 20
_LIMB, _LIMBS, _GROUP = 26, 5, 10**10  # 130 bits: a double below 2**-70 rounds to 0 at 20 places
_MASK = (1 << _LIMB) - 1


def _shifted(value: Column, by: Column) -> Column:
    """``value * 2**by`` cut to one limb, for any ``by`` (to the left: of the low bits that stay in the limb)."""
    up = F.call_function("shiftleft", value.bitwiseAND(F.lit(_MASK)), F.least(F.greatest(by, F.lit(0)), F.lit(_LIMB)).cast("int")).bitwiseAND(F.lit(_MASK))
    down = F.call_function("shiftright", value, F.least(F.greatest(-by, F.lit(0)), F.lit(63)).cast("int")).bitwiseAND(F.lit(_MASK))
    return F.when(by >= 0, up).otherwise(down)


def exact_text(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """``df`` with ``out`` (default: ``col``) as text with 20 decimals, rounded half to even; NULL stays NULL.

    NaN and infinities give ``nan``, ``inf`` and ``-inf``; a negative value that rounds to zero keeps its sign. Values from
    2**120 on have more digits than a decimal and raise an error.
    """
    out = out or col
    cols = [F.col(f"`{c}`") for c in df.columns if c != out]
    value = F.col(f"`{col}`").cast("double")
    finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))
    bits = F.java_method(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), F.coalesce(F.when(finite, value), F.lit(0.0))).cast("long")
    d = df.withColumn("_dt_v", value).withColumn("_dt_bits", bits)
    exponent = F.shiftright("_dt_bits", 52).bitwiseAND(F.lit(2047))
    low = F.col("_dt_bits").bitwiseAND(F.lit((1 << 52) - 1))
    # |v| = m * 2**e; a number stored without a leading 1 is far below the last place
    d = d.withColumn("_dt_m", F.when(exponent > 0, low + F.lit(1 << 52)).otherwise(F.lit(0))).withColumn("_dt_e", (exponent - 1075).cast("int"))
    d = d.withColumn("_dt_k", F.greatest(F.least(-F.col("_dt_e"), F.lit(63)), F.lit(0)).cast("int"))  # bits of m behind the point, up to all
    whole = F.call_function("shiftright", F.col("_dt_m"), F.col("_dt_k"))
    d = d.withColumn("_dt_whole", whole).withColumn("_dt_f", F.col("_dt_m") - F.call_function("shiftleft", F.col("_dt_whole"), F.col("_dt_k")))
    # the fraction is f * 2**e: limb i holds its bits of weight 2**-(26 (i + 1)) and up
    names = [f"_dt_{i}" for i in range(_LIMBS)]
    d = d.withColumns({n: F.when(F.col("_dt_e") < 0, _shifted(F.col("_dt_f"), F.col("_dt_e") + _LIMB * (i + 1))).otherwise(F.lit(0)).cast("long") for i, n in enumerate(names)})
    groups = []
    for g in range(PLACES // 10):
        carry: Column = F.lit(0)
        for i in reversed(range(_LIMBS)):
            t = F.col(names[i]) * _GROUP + carry
            d = d.withColumns({names[i]: t.bitwiseAND(F.lit(_MASK)), f"_dt_c{i}": F.shiftright(t, _LIMB)})
            carry = F.col(f"_dt_c{i}")
        groups.append(f"_dt_g{g}")
        d = d.withColumn(groups[-1], carry)
    half, rest = F.lit(1 << (_LIMB - 1)), F.lit(False)
    for n in names[1:]:
        rest = rest | (F.col(n) > 0)
    # bits below the last limb belong to numbers below 2**-70, which round to 0 in any case
    up = (F.col("_dt_0") > half) | ((F.col("_dt_0") == half) & (rest | (F.col(groups[-1]) % 2 == 1)))
    d = d.withColumn("_dt_low", F.col(groups[1]) + up.cast("long"))
    d = d.withColumn("_dt_high", F.col(groups[0]) + F.when(F.col("_dt_low") >= _GROUP, 1).otherwise(0))
    first = F.col("_dt_whole") + F.when(F.col("_dt_high") >= _GROUP, 1).otherwise(0)
    digits = lambda c: F.lpad((F.col(c) % _GROUP).cast("string"), 10, "0")
    # from 2**52 on the value is whole: m times a power of two, in decimals
    power = lambda by: F.call_function("shiftleft", F.lit(1).cast("long"), F.greatest(F.lit(0), F.least(by, F.lit(34))).cast("int")).cast("decimal(11,0)")
    large = (F.col("_dt_m").cast("decimal(16,0)") * power(F.col("_dt_e")) * power(F.col("_dt_e") - 34)).cast("string")
    whole = F.when(F.col("_dt_e") <= 0, first.cast("string")).when(F.col("_dt_e") < 68, large).otherwise(F.raise_error(F.lit("value too large for a decimal text")))
    sign = F.when(F.shiftright("_dt_bits", 63) != 0, F.lit("-")).otherwise(F.lit(""))
    text = F.concat(sign, whole, F.lit("."), digits("_dt_high"), digits("_dt_low"))
    odd = F.when(F.isnan("_dt_v"), F.lit("nan")).when(F.col("_dt_v") == float("inf"), F.lit("inf")).when(F.col("_dt_v") == float("-inf"), F.lit("-inf"))
    return d.select(*cols, F.when(F.col("_dt_v").isNotNull(), F.coalesce(odd, text)).alias(out)).select(*[F.col(f"`{c}`") for c in dict.fromkeys([*df.columns, out])])
