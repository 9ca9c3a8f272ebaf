"""Order-preserving whole numbers for fixed-width values, with native functions only.

``double_image`` maps doubles to longs in the same order (the IEEE bits of the
absolute value, with the sign of the number), ``image_double`` maps back.  Zero and
minus zero have the image 0; NaN lies above infinity.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_BIAS, _MANTISSA = 1023, 52
#: Image of infinity, and of NaN.
INFINITY = 0x7FF << _MANTISSA
NAN = INFINITY + (1 << (_MANTISSA - 1))


def _power(e: Column) -> Column:
    """2 to a whole power, in two factors of ordinary size."""
    half = F.floor(e / 2)
    return F.pow(F.lit(2.0), half) * F.pow(F.lit(2.0), e - half)


def double_image(c: Column) -> Column:
    """The image of a double; null stays null."""
    a = F.abs(c.cast("double"))
    guess = F.greatest(F.floor(F.log2(a)), F.lit(-_BIAS))  # the logarithm may round across a power of two
    e = F.when(a < _power(guess), guess - 1).when(a >= _power(guess) * 2, guess + 1).otherwise(guess)
    e = F.greatest(e, F.lit(1 - _BIAS))
    scaled = F.when(e < 0, a * _power(-e)).otherwise(a / _power(e))  # in [1, 2), below 1 if subnormal
    low = (scaled * F.lit(float(1 << _MANTISSA))).cast("long")
    bits = low + (e + _BIAS - 1).cast("long") * F.lit(1 << _MANTISSA).cast("long")
    image = F.when(a == 0, F.lit(0).cast("long")).when(a == float("inf"), F.lit(INFINITY)).otherwise(bits)
    return F.when(F.isnan(c.cast("double")), F.lit(NAN)).otherwise(F.when(c < 0, -image).otherwise(image))


def image_double(c: Column) -> Column:
    """The double of an image; null stays null."""
    bits = F.abs(c)
    e = F.shiftright(bits, _MANTISSA)
    low = bits.bitwiseAND(F.lit((1 << _MANTISSA) - 1)).cast("double") / F.lit(float(1 << _MANTISSA))
    scaled = F.when(e == 0, low).otherwise(low + 1.0)
    x = scaled * _power(F.greatest(e, F.lit(1)) - _BIAS)
    x = F.when(bits == INFINITY, F.lit(float("inf"))).when(bits > INFINITY, F.lit(float("nan"))).otherwise(x)
    return F.when(c < 0, -x).otherwise(x)


_EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"
_MICRO = "interval '0.000001' second"


def time_image(c: Column) -> Column:
    """Microseconds of a time without zone since 1970."""
    return F.call_function("div", c.cast("timestamp_ntz") - F.expr(_EPOCH), F.expr(_MICRO))


def image_time(c: Column) -> Column:
    return F.expr(_EPOCH) + c * F.expr(_MICRO)
