import base64
import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from tessellon.functions import bases, digests, jvm, kernels


def test_vectors():
    assert kernels.md4([b"abc", b""])[0].hex() == "a448017aaf21d8525fc10ae87aa6729d"
    assert kernels.md4([b"abc", b""])[1].hex() == "31d6cfe0d16ae931b73c59d7e0c089c0"
    assert kernels.tiger([b"abc"])[0].hex() == "2aab1484e8c158f2bfb8c5ff41b57a525129131c957b5f93"
    assert kernels.tiger([b""])[0].hex() == "3293ac630c13f0245f92bbb1766e16167a4e58492dde73f3"
    assert kernels.crc([b"123456789", b""], kernels.CRC32C) == [bytes.fromhex("e3069283"), bytes(4)]
    assert kernels.crc([b"123456789"], kernels.CRC32)[0].hex() == "cbf43926"
    data = [bytes([i % 253]) * n for i, n in enumerate((0, 1, 55, 56, 63, 64, 65, 1000))]
    assert kernels.md4(data) == kernels.md4_lanes(data)
    data = [bytes(i * 31 % 256 for i in range(n)) for n in (3, 5000, 65535, 65536, 70001, 300_000)]
    assert kernels.crc(data, kernels.CRC32) == [zlib.crc32(x).to_bytes(4, "big") for x in data]
    empty = {224: "f71837502ba8e108", 256: "c5d2460186f7233c", 384: "2c23146a63a29acf", 512: "0eab42de4c3ceb92"}
    for bits, start in empty.items():
        assert kernels.keccak([b""], bits)[0].hex().startswith(start)
        data = [bytes([i % 251]) * i for i in (0, 1, 71, 72, 135, 136, 137, 500)]
        assert kernels.keccak(data, bits, 6) == [hashlib.new(f"sha3_{bits}", x).digest() for x in data]


@pytest.mark.parametrize(
    "data,want",
    [
        (b"", "LWPNACQDBZRYXW3VHJVCJ64QBZNGHOHHHZWCLNQ"),
        (b"abc", "ASD4UJSEH5M47PDYB46KBTSQTSGDKLBHYXOMUIA"),
        (b"A" * 1024, "L66Q4YVNAFWVS23X2HJIRA5ZJ7WXR3F26RSASFA"),
        (b"A" * 1025, "PZMRYHGY6LTBEH63ZWAHDORHSYTLO4LEFUIKHWY"),
        (bytes(1 << 20), "MUACEID6UTVUKTRE2MTZKOPTZTMS6A2OF6B4ZNY"),
        (bytes((1 << 20) + 777), "GTMUI3C5NS42NYNRDZC7546KFUK23ZG3IULUPCA"),
    ],
)
def test_tree_hash(data, want):
    assert bases.base32(kernels.tth([data])[0]) == want


def test_ed2k_red_and_blue(monkeypatch):
    assert kernels.ed2k([b"", b"\0"]) == [(bytes.fromhex("31d6cfe0d16ae931b73c59d7e0c089c0"), None), (bytes.fromhex("47c61a0fa8738ba77308a8a600f88e4b"), None)]
    monkeypatch.setattr(kernels, "ED2K_CHUNK", 1000)
    one = lambda x: kernels.md4([x])[0]
    a, b = b"a" * 1000, b"b" * 1000
    red, blue = kernels.ed2k([a])[0]
    assert red == one(one(a) + one(b"")) and blue == one(a)
    red, blue = kernels.ed2k([a + b])[0]
    assert red == one(one(a) + one(b) + one(b"")) and blue == one(one(a) + one(b))
    assert kernels.ed2k([a + b"b"])[0] == (one(one(a) + one(b"b")), None)


@pytest.mark.parametrize(
    "n,red,blue",
    [
        (9727999, "ac44b93fc9aff773ab0005c911f8396f", None),
        (9728000, "fc21d9af828f92a8df64beac3357425d", "d7def262a127cd79096a108e7a9fc138"),
        (9728001, "06329e9dba1373512c06386fe29e3c65", None),
        (19455999, "a4aed104a077de7e4210e7f5b131fe25", None),
        (19456000, "114b21c63a74b6ca922291a11177dd5c", "194ee9e4fa79b2ee9f8829284c466051"),
        (19456001, "e57f824d28f69fe90864e17673668457", None),
    ],
)
@pytest.mark.skipif(kernels._library_md4() is None, reason="long without the crypto library")
def test_ed2k_of_zeros(n, red, blue):
    got = kernels.ed2k([bytes(n)])[0]
    assert (got[0].hex(), got[1] and got[1].hex()) == (red, blue)


def test_columns(spark):
    df = spark.createDataFrame([(1, "abc"), (2, ""), (3, None)], "id long, text string")
    names = list(digests.DIGESTS)
    rows = {r.id: r for r in df.select("id", *digests.digests(F.col("text"), names)).collect()}
    for n in ("md5", "sha1", "sha3_256", "sha3_512"):
        key = {"md5": "MD5", "sha1": "SHA1"}.get(n, n.replace("sha3_", "SHA3-"))
        assert bytes(rows[1][key]) == hashlib.new(n, b"abc").digest() and bytes(rows[2][key]) == hashlib.new(n, b"").digest()
    assert rows[1]["CRC32"].hex() == "352441c2" and rows[1]["CRC32C"].hex() == "364b3fb7"
    assert all(rows[3][n] is None for n in names)
    assert digests.selected(["tth", "crc32", "TTH"]) == ["CRC32", "TTH"]
    with pytest.raises(ValueError):
        digests.selected(["nothing"])
    long = digests.long_form(df.select("id", *digests.digests(F.col("text"), ["MD5", "ED2K2"])), ["id"], ["MD5", "ED2K2"])
    assert sorted((r.id, r.name) for r in long.collect()) == [(1, "MD5"), (2, "MD5")]


def test_bases():
    crc = bytes.fromhex("cbf43926")
    assert bases.to_base(crc, bases.ALPHABETS["16"]) == "CBF43926"
    for b, digits in bases.ALPHABETS.items():
        text = bases.to_base(crc, digits)
        assert sum(digits.index(c) * len(digits) ** i for i, c in enumerate(reversed(text))) == int.from_bytes(crc)
        assert len(text) == bases.width(4, len(digits))
    assert bases.base32(b"foobar") == base64.b32encode(b"foobar").decode().rstrip("=")


NAMES = ["MD4", "TIGER", "TTH", "CRC32C", "KECCAK-224", "KECCAK-256", "KECCAK-384", "KECCAK-512", "SHA3-224", "SHA3-256", "SHA3-384", "SHA3-512"]


def test_the_jvm_gives_what_the_kernels_give(spark, monkeypatch):
    assert jvm.available(spark)
    data = [bytes(i * 31 % 256 for i in range(n)) for n in (0, 1, 3, 48, 49, 55, 56, 57, 63, 64, 65, 71, 72, 135, 136, 137, 1000, 1023, 1024, 1025, 2048, 4097, 70001)]
    df = spark.createDataFrame([(i, bytearray(x)) for i, x in enumerate(data)] + [(99, None)], "i int, x binary")
    columns = lambda: df.select("i", *[digests.DIGESTS[n](F.col("x")).alias(n) for n in NAMES], digests.ed2k(F.col("x")).alias("ed2k")).orderBy("i")
    fast = columns()
    assert "tessellon_digest" in fast._jdf.queryExecution().toString() and "Python" not in fast._jdf.queryExecution().toString()
    monkeypatch.setattr(jvm, "available", lambda *_: False)
    slow = columns().collect()
    assert [r[:-1] for r in fast.collect()] == [r[:-1] for r in slow]
    some = lambda rows: [(bytes(r.ed2k.red), r.ed2k.blue) for r in rows[:-1]]
    assert some(fast.collect()) == some(slow) and fast.collect()[-1].ed2k is None


def test_files_are_streamed(spark, tmp_path):
    data = bytes(i * 7 % 251 for i in range(300_000)) * 40
    (tmp_path / "big [1].bin").write_bytes(data)
    files = spark.createDataFrame([(str(tmp_path / "big [1].bin"),), (str(tmp_path / "gone"),)], "path string")
    good, bad = digests.of_files(files, [*NAMES, "ED2K", "ED2K2", "MD5", "SHA2-512"]).orderBy("path").collect()
    assert bad.error.startswith("FileNotFoundException") and bad.MD5 is None and good.error is None
    assert good.MD5 == hashlib.md5(data).digest() and good["SHA2-512"] == hashlib.sha512(data).digest() and good["SHA3-256"] == hashlib.sha3_256(data).digest()
    assert (bytes(good.ED2K), good.ED2K2) == kernels.ed2k([data])[0] and good.CRC32C == kernels.crc([data], kernels.CRC32C)[0]


def test_threads_give_the_same(spark, tmp_path):
    for n in (0, 5, (4 << 20) - 1, 4 << 20, (8 << 20) + 1025, 13 << 20):
        data = bytes(i * 7 % 251 for i in range(1021)) * (n // 1021 + 1)
        (tmp_path / "x").write_bytes(data[:n])
        asked = ["TTH", "ED2K", "MD5", "TIGER", "HEAD-7", "MEDIA-3-9"]
        one, two = (spark.range(1).select(jvm.of_file(F.lit(str(tmp_path / "x")), asked, 3, p).alias("x")).first().x for p in (False, True))
        assert one == two and bytes(one[2]) == hashlib.md5(data[:n]).digest() and bytes(one[4]) == data[:n][:7] and bytes(one[5]) == data[:n][:3]
    (tmp_path / "x").write_bytes(b"OggS" + bytes(50))
    assert len(spark.range(1).select(jvm.of_file(F.lit(str(tmp_path / "x")), ["MEDIA-3-9"]).alias("x")).first().x[0]) == 9
