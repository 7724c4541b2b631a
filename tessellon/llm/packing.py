"""Packing tokenised documents into sequences: Martello-Toth dominance reduction, then best fit decreasing.

The instance is held as a histogram of piece lengths (at most `capacity` entries, whatever the number of documents), so
the driver plans on numbers of equal pieces: a reduction or a placement is done for all pieces of a length at once. The
plan is a list of runs of equal sequences; which piece goes where follows from its rank among pieces of its length,
and that rank is found in the cluster, over groups of (length, salt), since one length may hold a third of all pieces: a
length has as many salts as its share of all pieces asks for, so that no group has more than one GROUPS-th of them.

Reduction (Martello and Toth 1990): the largest remaining piece w is fixed together with a set that dominates every other
set holding w: nothing else fits; or a piece fills the rest exactly; or only one more piece fits and the largest
that does is taken; or at most two more fit and one piece, or a pair, covers all alternatives. It is repeated until
nothing more can be fixed.

Texts are cut at white space and words are looked up only under a tokenizer file whose rules allow it; under any other
file whole texts are encoded. What a worker remembers is bounded by bytes.

Defined results: null and empty texts are documents of no ids, which still have the closing id; very long texts are
encoded whole and cut into pieces where their ids are; ties go by (id, piece); repeated rows are packed each; other
columns are not read; an empty table gives an empty table.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessellon.llm import kernels
from tessellon.llm.scratch import materialize

CAPACITY = 2048
GROUPS = 4096
#: Bytes that a worker keeps of encoded words and of their letters; beyond it they are encoded again.
WORDS_BYTES, LETTERS_BYTES = 72 << 20, 24 << 20
#: Texts whose pieces leave a worker at once.
TEXTS = 256
#: The rules of a tokenizer under which no token reaches over white space or from letters to marks.
_LETTER_RULE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
#: Texts of these characters only are encoded word by word: there, no rule of the tokenizer crosses white space,
#: and normalisation and lower case are the same in Python and in the tokenizer.
_PLAIN_BYTES = bytes([*range(0x09, 0x0E), *range(0x20, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)])
_PLAIN = re.compile(r"[\t-\r\x20-\x7e\xa1-\xac\xae-\u012f\u0131-\u017e]*")
_KNOWN: dict[str, WordEncoder] = {}
kernels.MEMORIES["packing"] = _KNOWN.clear


def plain(text: str) -> bool:
    try:
        return not text.encode("latin-1").translate(None, _PLAIN_BYTES)
    except UnicodeEncodeError:
        return _PLAIN.fullmatch(text) is not None


def cut_at_blanks(spec: bytes) -> bool:
    """Whether the tokenizer file has just the rules under which words can be encoded one by one."""
    rules = json.loads(spec)
    before = rules.get("pre_tokenizer") or {}
    steps = before.get("pretokenizers") or [{}]
    return (
        (rules.get("normalizer") or {}).get("normalizers") == _NORMALIZERS
        and len(steps) == 2
        and steps[0] == {"type": "Split", "pattern": {"Regex": _LETTER_RULE}, "behavior": "Removed", "invert": True}
        and steps[1].get("type") == "ByteLevel"
        and not steps[1].get("add_prefix_space")
        and not steps[1].get("use_regex")
        and not rules["model"].get("dropout")
        and all(t["content"].startswith("<|") for t in rules.get("added_tokens") or [])
    )


def _lean(spec: bytes) -> str:
    """The tokenizer for words that are letters in lower case, or a bar, already: blanks part them, and nothing is left to normalise."""
    rules = json.loads(spec)
    rules |= {"normalizer": None, "added_tokens": [], "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, rules["pre_tokenizer"]["pretokenizers"][1]]}}
    return json.dumps(rules)


class WordEncoder:
    """Ids of whole texts by a tokenizers file, with the ids of white-space separated words remembered."""

    def __init__(self, spec: bytes):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec.decode())
        self.by_words = cut_at_blanks(spec)
        self.known, self.letters = kernels.Remembered(WORDS_BYTES), kernels.Remembered(LETTERS_BYTES)
        self.marks = dict(zip(",.;:!?", self._whole(list(",.;:!?")), strict=True))
        bar = self.tokenizer.encode("|", add_special_tokens=False).ids
        self.bar = bar[0] if len(bar) == 1 else None
        self.lean = Tokenizer.from_str(_lean(spec)) if self.by_words else self.tokenizer

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _many(self, words: list[str], tokenizer) -> list[bytes]:
        """The ids of each word, from texts of some words each with bars between, which only a bar gives."""
        if self.bar is None or len(words) < 2:
            return self._whole(words)
        out: list[bytes] = []
        for e in tokenizer.encode_batch_fast([" | ".join(words[i : i + 128]) for i in range(0, len(words), 128)], add_special_tokens=False):
            ids = np.array(e.ids, "<u4")
            ends, raw = (4 * np.flatnonzero(ids == self.bar)).tolist(), ids.tobytes()
            out += [raw[a:b] for a, b in zip([0, *(e + 4 for e in ends)], [*ends, len(raw)], strict=True)]
        return out

    def _words(self, words: set[str]) -> dict[str, bytes]:
        """Letters, with one mark after them or none, are letters' ids and the mark's: letters and marks never share a token."""
        split, other, barred = {}, [], []
        for w in words:
            mark = w[-1]
            if "|" in w:
                barred.append(w)
                continue
            bare = w[:-1] if mark in self.marks else w
            if bare.isalpha():
                split[w] = (bare.lower(), self.marks.get(mark, b""))
            else:
                other.append(w)
        letters = self.letters.data
        new = list({b for b, _ in split.values()}.difference(letters))
        ids = dict(zip(new, self._many(new, self.lean), strict=True))
        out = {w: (ids[b] if b in ids else letters[b]) + m for w, (b, m) in split.items()}
        self.letters.keep(ids)
        out.update(zip(other, self._many(other, self.tokenizer), strict=True))
        out.update(zip(barred, self._whole(barred), strict=True))
        return out

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.by_words or "<|" in text or not plain(text):
            return self._whole([text])[0]
        words, known = text.split(), self.known.data
        if missing := set(words).difference(known):
            new = self._words(missing)
            if not self.known.keep(new):
                return b"".join([known[w] if w in known else new[w] for w in words])
        return b"".join(map(known.__getitem__, words))


def encoder(spec: bytes) -> WordEncoder:
    key = hashlib.sha256(spec).hexdigest()
    if key not in _KNOWN:
        _KNOWN.clear()
        _KNOWN[key] = WordEncoder(spec)
    return _KNOWN[key]


def _encoded(docs: DataFrame, spec: bytes, closing_id: int, id_col: str, text_col: str, cut, columns: list[tuple[str, pa.DataType, str]]) -> DataFrame:
    """(id, *columns) of the rows that cut gives for the ids of each document, closing id included."""
    small = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = small.schema["id"].dataType.simpleString()
    close = int(closing_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        own = encoder(spec)
        for batch in batches:
            for s in range(0, batch.num_rows, TEXTS):
                rows = [(i, *row) for i, t in enumerate(batch.column(1)[s : s + TEXTS]) for row in cut(own.encode(t.as_py()) + close)]
                at, *data = zip(*rows, strict=True) if rows else [[]] * (len(columns) + 1)
                ids = batch.column(0)[s : s + TEXTS].take(pa.array(at, pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(d, t) for d, (_, t, _) in zip(data, columns, strict=True))], names=[id_col, *(c for c, _, _ in columns)])

    return small.mapInArrow(kernels.trimmed(run, "packing"), ", ".join([f"`{id_col}` {id_type}", *(f"{c} {t}" for c, _, t in columns)]))


def tokenize(docs: DataFrame, spec: bytes, closing_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids binary: little-endian unsigned 32-bit, with the closing id) of every document."""
    return _encoded(docs, spec, closing_id, id_col, text_col, lambda ids: [(ids,)], [("ids", pa.binary(), "binary")])


def pieces(docs: DataFrame, spec: bytes, capacity: int = CAPACITY, closing_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """(id, piece, start, length, ids_crc32, and with_ids also ids): only documents longer than the capacity are cut."""

    def cut(ids: bytes) -> Iterator[tuple]:
        for i, at in enumerate(range(0, len(ids), 4 * capacity)):
            own = ids[at : at + 4 * capacity]
            yield (i, at // 4, len(own) // 4, zlib.crc32(own), *([own] if with_ids else []))

    columns = [("piece", pa.int32(), "int"), ("start", pa.int64(), "bigint"), ("length", pa.int64(), "bigint"), ("ids_crc32", pa.int64(), "bigint")]
    return _encoded(docs, spec, closing_id, id_col, text_col, cut, columns + [("ids", pa.binary(), "binary")] * with_ids)


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """The L2 bound of Martello and Toth: no packing has fewer sequences."""
    sizes = sorted(counts)
    best = -(-sum(w * c for w, c in counts.items()) // capacity)
    for alpha in [0, *(w for w in sizes if w <= capacity // 2)]:
        large = sum(c for w, c in counts.items() if w > capacity - alpha)
        mid = [(w, c) for w, c in counts.items() if capacity / 2 < w <= capacity - alpha]
        small = sum(w * c for w, c in counts.items() if alpha <= w <= capacity / 2)
        n_mid = sum(c for _, c in mid)
        room = capacity * n_mid - sum(w * c for w, c in mid)
        best = max(best, large + n_mid + max(0, -(-(small - room) // capacity)))
    return best


def reduce_instance(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, tuple[int, ...]]], dict[int, int]]:
    """([(number of sequences, their lengths)], what remains) after fixing dominating sets while there are any."""
    left = {w: c for w, c in counts.items() if c}
    fixed: list[tuple[int, tuple[int, ...]]] = []

    def fix(n: int, *members: int) -> None:
        fixed.append((n, members))
        for w in members:
            left[w] -= n
            if not left[w]:
                del left[w]
                sizes.pop(bisect.bisect_left(sizes, w))

    def largest(limit: int, *without: int) -> int | None:
        """The largest piece of at most limit, when those in without are taken."""
        k = bisect.bisect_right(sizes, limit)
        while k:
            w = sizes[k - 1]
            if left[w] > without.count(w):
                return w
            k -= 1
        return None

    def smallest(n: int, without: int) -> list[int]:
        out: list[int] = []
        for w in sizes:
            out += [w] * min(n - len(out), left[w] - (w == without))
            if len(out) >= n:
                break
        return out

    sizes, moved = sorted(left), True
    while moved:
        moved = False
        for w in sizes[::-1]:
            while left.get(w):
                r = capacity - w
                one = largest(r, w)
                if one is None:
                    fix(left[w] if not (2 * w <= capacity) else 1, w)
                elif one == r:
                    fix(left[w] // 2 if one == w else min(left[w], left[r]), w, r)
                else:
                    few = smallest(3, w)
                    most = left[w] // 2 if one == w else min(left[w], left[one])
                    if len(few) < 2 or few[0] + few[1] > r:
                        fix(most, w, one)
                    elif len(few) < 3 or sum(few) > r:
                        pair = [(a + b, a, b) for a in sizes if left[a] > (a == w) and a <= r and (b := largest(r - a, w, a)) is not None]
                        total, a, b = max(pair, key=lambda p: (p[0], max(p[1:])))
                        a, b = max(a, b), min(a, b)
                        half = largest(r // 2, w)
                        if one >= total:
                            fix(1, w, one)
                        elif a == one and half is not None and half <= b:
                            fix(1, w, a, b)
                        else:
                            break
                    else:
                        break
                moved = True
    return fixed, left


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, tuple[tuple[int, int], ...]]]:
    """Best fit decreasing by runs: [(number of sequences, ((length, how many of it), ...))]."""
    rooms: dict[int, list[tuple[int, tuple[tuple[int, int], ...]]]] = {}
    order: list[int] = []

    def put(room: int, n: int, has: tuple[tuple[int, int], ...]) -> None:
        if room not in rooms:
            bisect.insort(order, room)
            rooms[room] = []
        rooms[room].append((n, has))

    def place(n_bins: int, room: int, has: tuple[tuple[int, int], ...], w: int, n: int) -> None:
        """n pieces of w into n_bins equal sequences, filling one after the other."""
        each = room // w
        full, rest = divmod(n, each)
        if full:
            put(room - each * w, full, (*has, (w, each)))
        if rest:
            put(room - rest * w, 1, (*has, (w, rest)))
        if n_bins - full - bool(rest):
            put(room, n_bins - full - bool(rest), has)

    for w in sorted(counts, reverse=True):
        n = counts[w]
        while n:
            k = bisect.bisect_left(order, w)
            if k == len(order):
                bins = -(-n // (capacity // w))
                place(bins, capacity, (), w, n)
                break
            room = order.pop(k)
            groups = rooms.pop(room)
            for i, (m, has) in enumerate(groups):
                take = min(n, m * (room // w))
                if take:
                    place(m, room, has, w, take)
                else:
                    put(room, m, has)
                n -= take
    return [g for room in order for g in rooms[room]]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, tuple[tuple[int, int], ...]]]:
    """[(number of equal sequences, ((length, how many of it), ...))] for a histogram of lengths."""
    fixed, left = reduce_instance(counts, capacity)
    return [(n, tuple((w, 1) for w in members)) for n, members in fixed] + best_fit(left, capacity)


def slots(runs: list[tuple[int, tuple[tuple[int, int], ...]]]) -> tuple[np.ndarray, ...]:
    """Sorted by (length, first rank): length, first rank, pieces a sequence, first sequence, offset."""
    rows, used, base = [], {}, 0
    for n, members in runs:
        offset = 0
        for w, k in members:
            rows.append((w, used.get(w, 0), k, base, offset))
            used[w] = used.get(w, 0) + n * k
            offset += w * k
        base += n
    return tuple(np.array(sorted(rows), np.int64).reshape(-1, 5).T)


def pack(items: DataFrame, order: list[str], capacity: int = CAPACITY, length_col: str = "length") -> DataFrame:
    """items with sequence_id and offset (long). order: columns that tell pieces of a length apart.

    To the driver go at most capacity counts of lengths and capacity + GROUPS counts of groups; the plan that the tasks get
    has a row for each run of equal places.
    """
    of_length = {int(r[0]): int(r[1]) for r in items.groupBy(length_col).count().collect()}
    each = max(1, sum(of_length.values()) // GROUPS)
    parts = {w: -(-n // each) for w, n in of_length.items()}
    salts = F.lit([parts.get(w, 1) for w in range(max(parts, default=0) + 1)])
    salt = F.pmod(F.xxhash64(*order), F.get(salts, F.col(length_col).cast("int")))
    salted = items.withColumn("_salt", salt.cast("int"))
    counts = salted.groupBy(length_col, "_salt").count().toPandas().sort_values([length_col, "_salt"])
    w, salt, n = (counts[c].to_numpy(np.int64) for c in (length_col, "_salt", "count"))
    before = np.cumsum(n) - n
    first = before - before[np.searchsorted(w, w)] if len(w) else before
    where = slots(plan(of_length, capacity))
    keys, starts = w * (1 << 20) + salt, first
    rank = F.row_number().over(Window.partitionBy(length_col, "_salt").orderBy(*order))
    ranked = salted.withColumn("_rank", rank.cast("long") - 1)
    schema = items.schema.jsonValue()
    names = items.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = where[0] * (1 << 42) + where[1]
        for batch in batches:
            get = lambda c: batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64)  # noqa: B023, E731
            size = get(length_col)
            r = get("_rank") + starts[np.searchsorted(keys, size * (1 << 20) + get("_salt"))]
            k = np.searchsorted(by, size * (1 << 42) + r, "right") - 1
            q = r - where[1][k]
            seq, off = where[3][k] + q // where[2][k], where[4][k] + q % where[2][k] * size
            cols = [batch.column(batch.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(seq), pa.array(off)], names=[*names, "sequence_id", "offset"])

    from pyspark.sql.types import LongType, StructType

    out = StructType.fromJson(schema).add("sequence_id", LongType()).add("offset", LongType())
    return ranked.mapInArrow(kernels.trimmed(run, "packing"), out)


def pack_documents(docs: DataFrame, spec: bytes, capacity: int = CAPACITY, closing_id: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece; the ids themselves are in pieces()."""
    cut = pieces(docs, spec, capacity, closing_id, with_ids=False)
    return pack(materialize(cut, "pieces"), ["doc_id", "piece", "start", "ids_crc32"], capacity)
