"""N-gram Jaccard join by universe partition and the pigeonhole principle.

A document is the set of its distinct k-word shingles. Two sets that link differ in at most H shingles, H following from
their sizes. Sizes fall into bands; in a band every shingle is hashed into one of m segments, each segment has an
allocation of 1 or 2, and the allocations sum to more than H. So two linked sets differ by less than the allocation in
some segment: in one of allocation 1 they agree, in one of allocation 2 they differ by one shingle at most, so that the
segment's subset, or the subset with one shingle deleted, is the same. These subsets' hashes are the signatures; equal
signatures make candidates.

How many segments have allocation 2, how much is allocated in surplus (E), and which subsets are light (at most L shingles)
is chosen for each band by cost: signatures to shuffle plus expected chance pairs, from the sizes of all documents. The
surplus pays for leaving out light subsets, which unrelated sets share (no shingle, or a common one): matching segments
hold more allocation than E, and a set that has at most E in light segments leaves those out; it still has a match in
another. A set with more leaves nothing out, so two of them meet in light ones too.

Signatures are made twice: first without ids, to find those that different sets share, then with ids, but only of those, told
by a bitmap of bounded size (where it fills up, more rows are shuffled, no fewer results come). The first time they are
shuffled in blobs by ranges, five bytes each; only sets that a bitmap says may have equals bring their hash along. Candidates are narrowed by
a 512-bit parity map (its Hamming distance is at most the sets' difference), then, as that is full for large sets, by maps with
at least a bit a shingle; those left are verified on the whole sets of 64-bit shingle hashes, so that these are stored and
shuffled for pairs that link or nearly do, not for each chance pair, whose number grows with the square of the corpus. Links are explored by components, never by all pairs of a group: equal sets count as one; in some rounds,
each set is tried against a set of the first component of a signature, which links most copies; then all pairs from
different components that share a signature are tried, which is every pair that can still join two.

Defined results: null texts, empty texts and texts without words have no shingles and are linked with nothing; fewer
than k words are one shingle; very long texts are sets like others; rows that repeat an id are one document with the links
of all its texts; rows with a null id have no component; of a class's ids the smallest names it, so there are no ties; other
columns are not read; an empty table gives an empty table. Tables made on the way are deleted once nothing reads them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from tessellon.llm import kernels
from tessellon.llm.components import components
from tessellon.llm.scratch import made, materialize, release_since

WORDS = 5
PERCENT = 80
LONGS = 8
#: Bits of a signature. Chance equals only make more candidates.
SIGNATURE = 48
ROWS = 512
#: A chance pair costs as much as so many signatures, and one more for so many shingles.
PAIR_COST, PAIR_SHINGLES = 1.0, 500
#: The chance, in that cost, that two sets share a shingle.
ALIKE = 1 / 4000


def most_apart(total: int, percent: int) -> int:
    """The largest symmetric difference of two linked sets whose sizes sum to total."""
    return total * (100 - percent) // (100 + percent)


@dataclass(frozen=True)
class Band:
    """Sizes from low on; segments [0, two) have allocation 2, the rest 1."""

    low: int
    high: int  # largest size whose pairs with larger sets belong here
    top: int  # largest partner
    apart: int
    two: int = 0
    surplus: int = 0
    light: int = 0

    @property
    def segments(self) -> int:
        return self.apart + 1 + self.surplus - self.two


def bands(largest: int, percent: int, width: float = 3) -> list[Band]:
    """Bands of sizes: each about `width` times as wide, in ratio, as linked sizes can lie apart."""
    out, low = [], 1
    while low <= largest:
        high = max(low, int(low * (100 / percent) ** width) - 1)
        top = high * 100 // percent
        out.append(Band(low, high, top, most_apart(high + top, percent)))
        low = high + 1
    return out


def allocate(band: Band, sizes: dict[int, int]) -> tuple[float, Band]:
    """(cost, band) with the cheapest allocation for the given number of sets of each size.

    Shingles of a segment are taken as Poisson, and the surplus as enough with the normal distribution's probability.
    """
    n = sum(sizes.values())
    order = sorted(sizes)
    mean = sum(s * c for s, c in sizes.items()) / n if n else band.low
    some = np.array(sorted({order[len(order) * i // 6] for i in range(6)} | {int(mean)}) if order else [band.low], float)[:, None]
    surplus = np.unique(np.concatenate([np.arange(9), (band.apart + 1) * np.array([0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.75, 1, 1.25, 1.5])]).astype(int))
    best = None
    for two in sorted({0, (band.apart + 1) // 4, (band.apart + 1) // 2}):
        m = (band.apart + 1 + surplus - two).astype(float)
        mu = some / m
        pmf = [np.exp(-mu)]
        for t in range(1, 9):
            pmf.append(pmf[-1] * mu / t)
        for light in range(4):
            q, r = sum(pmf[: light + 1]), sum(pmf[: light + 2])
            weak = (m - two) * q + 2 * two * r
            spread = np.sqrt(np.maximum((m - two) * q * (1 - q) + 4 * two * r * (1 - r), 1e-12))
            tail = np.vectorize(math.erfc)((surplus + 0.5 - weak) / spread / math.sqrt(2)) / 2
            signatures = n * ((1 - tail) * ((m - two) * (1 - q) + two * (1 + mu)) + tail * (m + two * mu)).mean(0)
            chance = (m * sum(pmf[t] * ALIKE**t for t in range(light + 1, 9))).mean(0) + tail.mean(0) ** 2 * (m * pmf[0] + m * ALIKE * pmf[1]).mean(0)
            cost = signatures + (PAIR_COST + mean / PAIR_SHINGLES) * np.minimum(chance, 1) * n * n / 2
            i = int(np.argmin(cost))
            if best is None or cost[i] < best[0]:
                best = (float(cost[i]), Band(band.low, band.high, band.top, band.apart, two, int(surplus[i]), light))
    return best


def planned(sizes: dict[int, int], percent: int) -> list[Band]:
    """The cheapest bands for a histogram of set sizes."""
    plans = []
    for width in (1, 1.5, 2, 3):
        plan = [allocate(b, {s: c for s, c in sizes.items() if b.low <= s <= b.top}) for b in bands(max(sizes, default=0), percent, width)]
        plans.append((sum(c for c, _ in plan), [b for _, b in plan]))
    return min(plans, key=lambda p: p[0])[1]


class Signer:
    """Signatures of sets under a list of bands."""

    def __init__(self, plan: list[Band]):
        self.plan = plan
        self.low = np.array([b.low for b in plan] or [1])
        self.top = np.array([b.top for b in plan] or [0])

    def sign(self, value: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(signature, set index) of sets value[bounds[i]:bounds[i + 1]]."""
        n = np.diff(bounds)
        own = np.searchsorted(self.low, n, "right") - 1
        sigs, docs = [], []
        for g in np.unique(np.concatenate([own, own - 1])):
            if g < 0 or not self.plan[g].apart:
                continue
            in_g = np.flatnonzero((n > 0) & ((own == g) | ((own == g + 1) & (n <= self.top[g]))))
            if len(in_g):
                s, d = self._band(int(g), value, bounds, in_g, n[in_g])
                sigs.append(s)
                docs.append(d)
        return (np.concatenate(sigs) >> np.uint64(64 - SIGNATURE), np.concatenate(docs)) if sigs else (np.zeros(0, np.uint64), np.zeros(0, np.int64))

    def _band(self, g: int, value: np.ndarray, bounds: np.ndarray, which: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        b, m, k = self.plan[g], self.plan[g].segments, len(which)
        first = np.cumsum(n) - n
        doc = np.repeat(np.arange(k), n)
        token = value[np.repeat(bounds[which] - first, n) + np.arange(int(n.sum()))]
        seg = (kernels.mix(token + np.uint64(g + 1)) >> np.uint64(33)).astype(np.int64) % m
        key, part = doc * m + seg, kernels.mix(token ^ np.uint64(0xA5A5A5A5))
        low = np.bincount(key, (part & np.uint64(0xFFFFFFFF)).astype(np.float64), k * m).astype(np.uint64)
        high = np.bincount(key, (part >> np.uint64(32)).astype(np.float64), k * m).astype(np.uint64)
        content = low + (high << np.uint64(32))
        count = np.bincount(key, minlength=k * m)
        place = kernels.mix(np.arange(m, dtype=np.uint64) + np.uint64((g + 1) << 32))
        two = np.arange(m) < b.two
        weak = np.where(two, 2 * (count.reshape(k, m) <= b.light + 1), count.reshape(k, m) <= b.light).sum(1)
        some = (count > b.light) | np.repeat(weak > b.surplus, m)
        at = np.flatnonzero(some)
        sigs, docs = [kernels.mix(content[at] + place[at % m])], [which[at // m]]
        if b.two:
            less = seg < b.two
            less &= (count[key] > b.light + 1) | (weak > b.surplus)[doc]
            sigs.append(kernels.mix(content[key[less]] - part[less] + place[seg[less]]))
            docs.append(which[doc[less]])
        return np.concatenate(sigs), np.concatenate(docs)


def token_sets(texts, k: int) -> tuple[np.ndarray, np.ndarray]:
    return kernels.distinct(*kernels.shingles(*kernels.words(texts), k), len(texts))


def _sums(x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def parity_maps(value: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """n x LONGS 64-bit words: each shingle flips one bit."""
    n, bits = len(bounds) - 1, 64 * LONGS
    doc = np.repeat(np.arange(n), np.diff(bounds))
    at = doc * bits + (kernels.mix(value + np.uint64(77)) >> np.uint64(40)).astype(np.int64) % bits
    odd = (np.bincount(at, minlength=n * bits) & 1).astype(np.uint8)
    return np.packbits(odd.reshape(n, bits), axis=1, bitorder="little").view("<i8").reshape(n, LONGS)


MAPS = [f"b{i}" for i in range(LONGS)]


def wide_maps(value: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """A parity map of each set with more than 64 * LONGS shingles, in the least power of two of bits that has one for each; else none."""
    out = []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a <= 64 * LONGS:
            out.append(b"")
            continue
        bits = 1 << int(b - a - 1).bit_length()
        at = (kernels.mix(value[a:b] + np.uint64(78)) >> np.uint64(24)).astype(np.int64) & (bits - 1)
        out.append(np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes())
    return out


def wide_apart(a: bytes, b: bytes) -> int:
    """A lower bound of the symmetric difference of two sets from their wide maps; the larger is folded to the bits of the other."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    if len(x) < len(y):
        x, y = y, x
    if not len(y):
        return 0
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return int(np.unpackbits((x ^ y).view(np.uint8)).sum())


def summaries(docs: DataFrame, k: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n, s1, s2, b0.., wide): size, 128-bit hash and parity maps of every set; no shuffle."""
    small = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    names = ["id", "n", "s1", "s2", *MAPS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, ROWS):
                part = batch.slice(s, ROWS)
                value, bounds = token_sets(part.column(1), k)
                s1, s2 = (_sums(kernels.mix(value + np.uint64(i)), bounds).view(np.int64) for i in (5, 6))
                maps = parity_maps(value, bounds)
                wide = pa.array(wide_maps(value, bounds), pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, (np.diff(bounds), s1, s2, *maps.T)), wide], names=[*names, "wide"])

    return small.mapInArrow(kernels.trimmed(run), ", ".join(f"{c} long" for c in names) + ", wide binary")


#: A bitmap has at most 2**BITS bits.
BITS = 26


def spark_hash(x: np.ndarray) -> np.ndarray:
    """What Spark's xxhash64 gives for longs."""
    p1, p2, p3, p4, p5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turn = lambda v, n: (v << np.uint64(n)) | (v >> np.uint64(64 - n))
    h = turn(x.view(np.uint64) * p2, 31) * p1 ^ (np.uint64(42 + 8) + p5)
    h = turn(h, 27) * p1 + p4
    h = (h ^ (h >> np.uint64(33))) * p2
    h = (h ^ (h >> np.uint64(29))) * p3
    return h ^ (h >> np.uint64(32))


class Bitmap:
    """Which 64-bit keys may be in a set: no false negatives, and as few positives as two bits a key in a bounded map give.

    It is made by an aggregation over all keys; the driver gets its words, at most 2**(BITS - 6) of them.
    """

    def __init__(self, keys: DataFrame, column: str):
        self.bits = bits = min(BITS, max(16, (16 * keys.count()).bit_length()))
        h = F.xxhash64(F.col(column).cast("long"))
        places = F.array(F.shiftrightunsigned(h, 64 - bits), F.shiftrightunsigned(F.shiftleft(h, 30), 64 - bits))
        at = keys.filter(F.col(column).isNotNull()).select(F.explode(places).alias("at"))
        words = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("ones")).toArrow()
        cells = np.zeros(1 << bits - 6, "<i8")
        cells[words.column("word").to_numpy()] = words.column("ones").to_numpy()
        self.map = cells.view(np.uint8)

    def places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mixed, shift = spark_hash(keys), np.uint64(64 - self.bits)
        return (mixed >> shift).astype(np.int64), ((mixed << np.uint64(30)) >> shift).astype(np.int64)

    def may_have(self, keys: np.ndarray) -> np.ndarray:
        a, b = self.places(keys)
        bit = lambda at: (self.map[at >> 3] >> (at & 7).astype(np.uint8)) & 1
        return (bit(a) & bit(b)).astype(bool)

    def column(self, name: str) -> Column:
        """may_have() of a column of longs; null is not in it."""

        @F.pandas_udf(BooleanType())
        def test(x: pd.Series) -> pd.Series:
            return pd.Series(self.may_have(x.fillna(0).to_numpy(np.int64)) & x.notna().to_numpy())

        return test(F.col(name).cast("long"))


def without(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """docs without those whose id is in the stored ids (column id_col). Only rows that the bitmap can't clear are shuffled."""
    maybe = Bitmap(ids, id_col).column(id_col)
    clear = docs.filter(~maybe | F.col(id_col).isNull())
    return clear.unionByName(docs.filter(maybe).join(ids, id_col, "left_anti").select(*docs.columns))


def _five(x: np.ndarray) -> bytes:
    """Numbers below 2**40 as five bytes each."""
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def _from_five(blobs: list[bytes]) -> np.ndarray:
    raw = np.frombuffer(b"".join(blobs), np.uint8).reshape(-1, 5)
    return np.pad(raw, ((0, 0), (0, 3))).view("<u8").ravel()


def _twice(single: np.ndarray, value: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Values that occur in two sets at least: each single is of a set of its own, value[i] of the set own[i]."""
    order = np.lexsort((own, value))
    value, own = value[order], own[order]
    keep = np.ones(len(value), bool)
    keep[1:] = (value[1:] != value[:-1]) | (own[1:] != own[:-1])
    found, n = np.unique(np.concatenate([single, value[keep]]), return_counts=True)
    return found[n > 1]


def shared_signatures(docs: DataFrame, signer: Signer, alike: Bitmap, k: int, id_col: str, text_col: str) -> DataFrame:
    """(sig): the signatures of two different sets at least. alike: ids whose set may have equals.

    A batch sends a signature on for each set, but twice at most where the sets have no equals.
    """
    small = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).filter("id IS NOT NULL")
    bits = min(20, max(8, (8 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))).bit_length()))
    shift, none = np.uint64(SIGNATURE - bits), np.zeros(0, np.uint64)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (batch.slice(s, 4 * ROWS) for batch in batches for s in range(0, batch.num_rows, 4 * ROWS)):
            may = alike.may_have(part.column(0).to_numpy())
            singles, values, owns = [none], [none], [none]
            for s in range(0, part.num_rows, ROWS):
                value, bounds = token_sets(part.column(1)[s : s + ROWS], k)
                sig, doc = signer.sign(value, bounds)
                plain = ~may[s + doc]
                singles.append(sig[plain])
                values.append(sig[~plain])
                owns.append(_sums(kernels.mix(value + np.uint64(5)), bounds)[doc[~plain]])
            single = np.sort(np.concatenate(singles))
            single = single[np.concatenate([np.ones(min(2, len(single)), bool), single[2:] != single[:-2]])]
            value, own = np.concatenate(values), np.concatenate(owns)
            order = np.lexsort((own, value))
            value, own = value[order], own[order]
            new = np.ones(len(value), bool)
            new[1:] = (value[1:] != value[:-1]) | (own[1:] != own[:-1])
            value, own = value[new], own[new]
            edges = np.arange((1 << bits) + 1, dtype=np.uint64) << shift
            a, b = np.searchsorted(single, edges), np.searchsorted(value, edges)
            at = np.flatnonzero((np.diff(a) > 0) | (np.diff(b) > 0))
            mask = (np.uint64(1) << shift) - np.uint64(1)
            data = [[_five(single[a[i] : a[i + 1]] & mask) for i in at], [_five(value[b[i] : b[i + 1]] & mask) for i in at], [own[b[i] : b[i + 1]].tobytes() for i in at]]
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), *(pa.array(d, pa.binary()) for d in data)], names=["range", "single", "value", "own"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, have = None, []

        def found() -> pa.RecordBatch:
            single, value, own = zip(*have, strict=True)
            both = _twice(_from_five(single), _from_five(value), np.frombuffer(b"".join(own), np.uint64))
            have.clear()
            return pa.RecordBatch.from_arrays([pa.array((both | (np.uint64(now) << shift)).view(np.int64))], names=["sig"])

        for batch in batches:
            ranges = batch.column(0).to_numpy()
            for i, blobs in enumerate(zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True)):
                if have and ranges[i] != now:
                    yield found()
                now = int(ranges[i])
                have.append(blobs)
        if have:
            yield found()

    raw = small.mapInArrow(kernels.trimmed(send), "range int, single binary, value binary, own binary")
    return raw.repartition("range").sortWithinPartitions("range").mapInArrow(kernels.trimmed(meet), "sig long")


def members(docs: DataFrame, signer: Signer, some: Bitmap, k: int, id_col: str, text_col: str) -> DataFrame:
    """(sig, id) of every set and its signatures that may be in the bitmap."""
    small = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).filter("id IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, ROWS):
                part = batch.slice(s, ROWS)
                sig, doc = signer.sign(*token_sets(part.column(1), k))
                hit = some.may_have(sig)
                yield pa.RecordBatch.from_arrays([pa.array(sig[hit].view(np.int64)), part.column(0).take(pa.array(doc[hit]))], names=["sig", "id"])

    return small.mapInArrow(kernels.trimmed(run), "sig long, id long")


def _may_link(a: str, b: str, percent: int) -> Column:
    """Sizes and parity maps of sides a and b leave room for a link."""
    apart = sum((F.bit_count(F.col(f"{a}.{c}").bitwiseXOR(F.col(f"{b}.{c}"))) for c in MAPS), F.lit(0))
    total = F.col(f"{a}.n") + F.col(f"{b}.n")
    room = F.floor(total * (100 - percent) / (100 + percent))
    return (apart <= room) & (F.abs(F.col(f"{a}.n") - F.col(f"{b}.n")) <= room)


def plausible(pairs: DataFrame, info: DataFrame, percent: int) -> DataFrame:
    """(u, v) of the stored pairs (u, v) that sizes and wide maps leave room for a link; no linked pair is lost."""
    sets = info.filter("n > 0 AND id IS NOT NULL")
    u, v = (sets.select(F.col("id").alias(c), F.col("n").alias(f"n{c}"), F.col("wide").alias(f"w{c}")) for c in "uv")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = (batch.column(i).to_numpy() for i in (2, 3))
            room = (n + m) * (100 - percent) // (100 + percent)
            keep = np.abs(n - m) <= room
            for i in np.flatnonzero(keep):
                keep[i] = wide_apart(batch.column(4)[i].as_py(), batch.column(5)[i].as_py()) <= room[i]
            keep = pa.array(keep)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["u", "v"])

    both = pairs.select("u", "v").join(u, "u").join(v, "v").select("u", "v", "nu", "nv", "wu", "wv")
    return both.mapInArrow(kernels.trimmed(run), "u long, v long").distinct()  # an id may have several sets


def verified(pairs: DataFrame, info: DataFrame, docs: DataFrame, k: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """(u, v) of the stored pairs (u, v) that link. Only the sets of documents in plausible pairs are shuffled."""
    pairs = materialize(plausible(pairs, info, percent), "plausible")
    wanted = materialize(pairs.select(F.col("u").alias("id")).union(pairs.select("v")).distinct(), "wanted")
    some = Bitmap(wanted, "id")
    small = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).filter("id IS NOT NULL")

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            batch = batch.filter(pa.array(some.may_have(ids)))
            for s in range(0, batch.num_rows, ROWS):
                part = batch.slice(s, ROWS)
                value, bounds = token_sets(part.column(1), k)
                own = [value[bounds[i] : bounds[i + 1]].tobytes() for i in range(part.num_rows)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(own, pa.binary())], names=["id", "tokens"])

    sets = materialize(small.mapInArrow(kernels.trimmed(tokens), "id long, tokens binary").filter("length(tokens) > 0"), "tokens")
    both = pairs.select("u", "v").join(sets.select(F.col("id").alias("u"), F.col("tokens").alias("tu")), "u").join(sets.select(F.col("id").alias("v"), F.col("tokens").alias("tv")), "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(a.as_py(), np.uint64), np.frombuffer(b.as_py(), np.uint64)
                common = len(np.intersect1d(x, y, True))
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["u", "v"])

    return both.select("u", "v", "tu", "tv").mapInArrow(kernels.trimmed(run), "u long, v long")


#: Rounds that try one partner of each set, before all pairs of components are tried.
ROUNDS = 2
#: Smallest signatures that a set carries into the last join.
LEAST = 4


def join_components(docs: DataFrame, k: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) of every row."""
    where, spark, before = (k, percent, id_col, text_col), docs.sparkSession, made()
    info = materialize(summaries(docs, k, id_col, text_col), "sets")
    key = ["n", "s1", "s2"]
    some = info.filter("n > 0 AND id IS NOT NULL")
    classes = some.groupBy(*key).agg(F.min("id").alias("rep"), F.max("id").alias("last"), *(F.first(c).alias(c) for c in MAPS))
    classes = materialize(classes, "classes")
    sizes = {r["n"]: r["count"] for r in classes.groupBy("n").count().collect()}
    signer = Signer(planned(sizes, percent))
    # An id stands for its set; ids of equal sets give way to the smallest.
    alike = materialize(some.join(classes.filter("rep < last").select(*key, "rep"), key).select("id", "rep"), "alike")
    copies = alike.filter("id > rep").select("id").distinct()
    shared = materialize(shared_signatures(docs, signer, Bitmap(alike, "id"), k, id_col, text_col), "shared")

    member = members(docs, signer, Bitmap(shared, "sig"), k, id_col, text_col).join(copies, "id", "left_anti")
    member = materialize(member.join(shared, "sig").distinct(), "members")
    maps = classes.select(F.col("rep").alias("id"), "n", *MAPS)

    twice = some.select("id", *key).distinct().groupBy("id").agg(F.count("*").alias("c")).filter("c > 1").select("id")
    again = some.join(twice, "id", "left_semi").join(classes.select(*key, "rep"), key).select(F.col("id").alias("u"), F.col("rep").alias("v"))
    edges = materialize(again.filter("u <> v").distinct(), "links")
    now, tried = components(edges), None

    def labelled() -> DataFrame:
        """(sig, id, component) of signatures that different components share."""
        all_ = member.join(now.select(F.col("node").alias("id"), "component"), "id", "left").withColumn("component", F.coalesce("component", "id"))
        all_ = materialize(all_, "labelled")
        spread = all_.groupBy("sig").agg(F.min(F.struct("component", "id")).alias("lead"), F.max("component").alias("high")).filter("lead.component < high")
        return all_.join(materialize(spread.select("sig", "lead"), "leads"), "sig")

    for _ in range(ROUNDS):
        far = labelled().filter("component <> lead.component").select(F.greatest("id", "lead.id").alias("u"), F.least("id", "lead.id").alias("v"), F.col("id").alias("of"))
        pairs = materialize(far.groupBy("u", "v", "of").agg(F.count("*").alias("votes")), "candidates")
        if tried is not None:
            pairs = pairs.join(tried, ["u", "v"], "left_anti")
        near = pairs.join(maps.alias("a"), F.col("u") == F.col("a.id")).join(maps.alias("b"), F.col("v") == F.col("b.id")).filter(_may_link("a", "b", percent))
        best = near.groupBy("of").agg(F.max(F.struct("votes", "u", "v")).alias("p")).select("p.u", "p.v").distinct()
        best = materialize(best, "pairs")
        links = materialize(verified(best, info, docs, *where), "links")
        tried = best if tried is None else tried.union(best)
        if links.isEmpty():
            break
        edges = edges.union(links)
        now = components(edges)
        release_since(spark, before, info, classes, member, edges, now, tried)

    rows = materialize(labelled().select("sig", "id", "component"), "mixed")
    least = rows.groupBy("id").agg(F.slice(F.array_sort(F.collect_set("sig")), 1, LEAST).alias("low"))
    rows = rows.join(materialize(maps.join(least, "id"), "maps"), "id")
    a, b = rows.alias("a"), rows.alias("b")
    # Not again where a smaller signature that both have already gives the pair.
    once = F.coalesce(F.array_min(F.array_intersect("a.low", "b.low")), F.col("a.sig")) >= F.col("a.sig")
    cross = a.join(b, (F.col("a.sig") == F.col("b.sig")) & (F.col("a.component") < F.col("b.component")) & _may_link("a", "b", percent) & once)
    cross = cross.select(F.greatest("a.id", "b.id").alias("u"), F.least("a.id", "b.id").alias("v")).distinct()
    if tried is not None:
        cross = cross.join(tried, ["u", "v"], "left_anti")
    links = verified(materialize(cross, "cross"), info, docs, *where)
    final = components(edges.union(materialize(links, "links")))

    labels = classes.select(*key, "rep").join(final.withColumnRenamed("node", "rep"), "rep", "left").select(*key, F.coalesce("component", "rep").alias("component"))
    labels = materialize(labels, "labels")
    release_since(spark, before, info, labels)
    out = info.select("id", *key).join(labels, key, "left")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), component).alias("component_id"))
