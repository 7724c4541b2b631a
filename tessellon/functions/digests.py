"""Digest columns by name: Spark's own functions where it has them, functions in the JVM for the rest, Arrow kernels without one.

Every name maps to a column of bytes for a column of text (its UTF-8 bytes) or bytes. Null stays null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from tessellon.functions import jvm, kernels


def _bytes(x) -> bytes:
    return x.encode() if isinstance(x, str) else bytes(x)


def _kernel(many: Callable[[list[bytes]], list[bytes]]) -> Callable[[Column], Column]:
    """An Arrow batch at a time; equal-length steps are shared by the batch's rows."""

    @F.pandas_udf(BinaryType())
    def run(x: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(x), index=x.index, dtype=object)
        some = x[x.notna()]
        if len(some):
            out[some.index] = many([_bytes(v) for v in some])
        return out

    return lambda c: run(c.cast("binary"))


def _fast(name: str, kernel: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """In the JVM where the active session has the function, else by the kernel."""
    return lambda c: jvm.of_content(c, name) if jvm.available() else kernel(c)


def _each(name: str) -> Callable[[list[bytes]], list[bytes]]:
    return lambda xs: [hashlib.new(name, x).digest() for x in xs]


def _sha2(bits: int) -> Callable[[Column], Column]:
    return lambda c: F.unhex(F.sha2(c.cast("binary"), bits))


def crc32(c: Column) -> Column:
    """Four bytes, big-endian."""
    return F.unhex(F.lpad(F.hex(F.crc32(c.cast("binary"))), 8, "0"))


ED2K_TYPE = StructType([StructField("red", BinaryType()), StructField("blue", BinaryType())])


@F.pandas_udf(ED2K_TYPE)
def _ed2k(x: pd.Series) -> pd.DataFrame:
    out = pd.DataFrame({"red": [None] * len(x), "blue": [None] * len(x)}, dtype=object)
    some = [i for i, v in enumerate(x) if v is not None]
    for i, (red, blue) in zip(some, kernels.ed2k([_bytes(x.iloc[i]) for i in some]), strict=True):
        out.iat[i, 0], out.iat[i, 1] = red, blue
    return out


def ed2k(c: Column) -> Column:
    """A struct of the red digest and, for a whole number of chunks, the blue one."""
    if not jvm.available():
        return _ed2k(c.cast("binary"))
    both = jvm.of_content(c, "ED2K+")
    blue = F.when(F.length(both) == 32, F.substring(both, 17, 16))
    return F.when(both.isNotNull(), F.struct(F.substring(both, 1, 16).alias("red"), blue.alias("blue")))


#: Name of each digest, in the order in which they are reported.
DIGESTS: dict[str, Callable[[Column], Column]] = {
    "NULL": lambda c: F.when(c.isNotNull(), F.lit(b"")),
    "CRC32": crc32,
    "CRC32C": _fast("CRC32C", _kernel(lambda xs: kernels.crc(xs, kernels.CRC32C))),
    "MD4": _fast("MD4", _kernel(kernels.md4)),
    "MD5": lambda c: F.unhex(F.md5(c.cast("binary"))),
    "SHA1": lambda c: F.unhex(F.sha1(c.cast("binary"))),
    "SHA2-256": _sha2(256),
    "SHA2-384": _sha2(384),
    "SHA2-512": _sha2(512),
    **{f"SHA3-{n}": _fast(f"SHA3-{n}", _kernel(_each(f"sha3_{n}"))) for n in (224, 256, 384, 512)},
    **{f"KECCAK-{n}": _fast(f"KECCAK-{n}", _kernel(lambda xs, n=n: kernels.keccak(xs, n))) for n in (224, 256, 384, 512)},
    "TIGER": _fast("TIGER", _kernel(kernels.tiger)),
    "TTH": _fast("TTH", _kernel(kernels.tth)),
    "ED2K": lambda c: ed2k(c)["red"],
    "ED2K2": lambda c: ed2k(c)["blue"],
}


def register(name: str, digest: Callable[[Column], Column]) -> None:
    """Add a digest of one's own."""
    DIGESTS[name.upper()] = digest


def selected(names: list[str]) -> list[str]:
    """The asked names, case aside, once each and in the registry's order; an unknown one is an error."""
    asked = {n.upper() for n in names}
    if unknown := asked - {n.upper() for n in DIGESTS}:
        raise ValueError(f"no such digest: {', '.join(sorted(unknown))}")
    return [n for n in DIGESTS if n.upper() in asked]


def digests(c: Column, names: list[str]) -> list[Column]:
    """One column for each asked digest; the others aren't computed."""
    return [DIGESTS[n](c).alias(n) for n in selected(names)]


def of_files(files, names: list[str], path: str = "path"):
    """(the columns of files, a column for each asked digest, error) of files of any size, each read once as a stream; a file that
    can't be read has no digests and an error. Needs the functions in the JVM."""
    chosen = selected(names)
    if not jvm.available(files.sparkSession):
        raise RuntimeError("streaming digests need a session with a JVM at hand")
    got = files.withColumn("__got", jvm.of_file(F.col(path), chosen))
    return got.select(*files.columns, *[F.get("__got", F.lit(i)).alias(n) for i, n in enumerate(chosen)], F.get("__got", F.lit(len(chosen))).cast("string").alias("error"))


def long_form(wide, keys: list[str], names: list[str]):
    """(keys, name, digest) rows of a frame with a column for each digest; null digests have no row."""
    pairs = F.array(*[F.struct(F.lit(n).alias("name"), F.col(f"`{n}`").alias("digest")) for n in names])
    return wide.select(*keys, F.explode(pairs).alias("p")).select(*keys, "p.name", "p.digest").filter("digest IS NOT NULL")
