"""Bytes in other bases: big-endian numbers padded with the zero digit, and the bit-wise base 32 of RFC 4648."""

from __future__ import annotations

import base64
import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The digits of each base.
_AZ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_D = "0123456789"
ALPHABETS = {
    "2": "01",
    "4": "0123",
    "8": "01234567",
    "10": _D,
    "16": "0123456789ABCDEF",
    "32Hex": "0123456789ABCDEFGHIJKLMNOPQRSTUV",
    "32Z": "ybndrfg8ejkmcpqxot1uwisza345h769",
    "32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "36": _D + _AZ,
    "62": _D + _AZ + _AZ.lower(),
    "64": _AZ + _AZ.lower() + _D + "+/",
}


def width(n_bytes: int, radix: int) -> int:
    """Digits that n bytes can need."""
    return math.ceil(8 * n_bytes / math.log2(radix)) if n_bytes else 0


def to_base(data: bytes, digits: str) -> str:
    number, radix, out = int.from_bytes(data, "big"), len(digits), []
    while number:
        number, k = divmod(number, radix)
        out.append(digits[k])
    return "".join(reversed(out)).rjust(width(len(data), radix), digits[0])


def base32(data: bytes) -> str:
    """RFC 4648 without padding."""
    return base64.b32encode(data).decode().rstrip("=")


def number_in_base(number: Column, base: str, n_bytes: int) -> Column:
    """The digits of a non-negative long of n_bytes (up to 7), by Spark's own functions on longs."""
    digits = ALPHABETS[base]
    radix, w = len(digits), width(n_bytes, len(digits))
    if digits == (_D + _AZ)[:radix]:
        return F.lpad(F.conv(number.cast("string"), 10, radix), w, "0")
    step = radix.bit_length() - 1
    if radix == 1 << step:
        place = lambda i: F.shiftright(number, step * i).bitwiseAND(F.lit(radix - 1))
    else:
        place = lambda i: F.call_function("div", number, F.lit(radix**i)) % radix
    return F.concat(*[F.substring(F.lit(digits), place(i).cast("int") + 1, F.lit(1)) for i in range(w - 1, -1, -1)])


def bytes_in_base(data: Column, base: str) -> Column:
    """The digits of bytes of any length."""
    digits = ALPHABETS[base]
    if base == "16":
        return F.hex(data)

    @F.pandas_udf(StringType())
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda v: None if v is None else to_base(bytes(v), digits))

    return run(data)


@F.pandas_udf(StringType())
def rfc4648_base32(x: pd.Series) -> pd.Series:
    return x.map(lambda v: None if v is None else base32(bytes(v)))
