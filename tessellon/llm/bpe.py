"""Byte-level BPE encoding and decoding by dynamic programming over prefixes.

For every prefix of a piece there is exactly one token that ends its encoding. A token t ends the prefix of length j
exactly if t's bytes end there, t encodes to itself, and the last token p of the prefix before t may stand before t,
that is, merging bytes(p) + bytes(t) gives [p, t] again. The table of last tokens is filled left to right, an append
only extends it, and an edit refills it from the first changed byte up to where it agrees with the old table.

Defined results: null and empty texts have no ids and decode to no bytes; repeated rows are encoded each; texts of any
length are encoded whole; what a worker remembers is bounded by bytes; other columns than id and text are not read; an
empty table gives an empty table.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessellon.llm import kernels

#: Bytes that a worker keeps of encoded chunks, and entries of pairs, of about 100 bytes each; beyond it they are computed again.
CHUNK_BYTES, PAIRS = 128 << 20, 500_000


def read_ranks(path: str) -> bytes:
    """The bytes of a rank file (base64 token, blank, rank on each line), read on the driver and sent to the workers."""
    with open(path, "rb") as f:
        return f.read()


class PrefixBPE:
    """Encoder and decoder for one table of ranks and one splitting pattern."""

    def __init__(self, ranks: bytes, pattern: str):
        pairs = [line.split() for line in ranks.splitlines() if line.strip()]
        self.rank = {base64.b64decode(a): int(b) for a, b in pairs}
        self.token = {r: t for t, r in self.rank.items()}
        self.raw = {r: r.to_bytes(4, "little") for r in self.token}
        self.longest = max(map(len, self.rank))
        self.matcher = ahocorasick.Automaton()
        for t, r in self.rank.items():
            self.matcher.add_word(t.decode("latin-1"), (len(t), r))
        self.matcher.make_automaton()
        self.split = regex.compile(pattern).findall
        self.pairs: dict[int, bool] = {}
        self.alone: dict[int, bool] = {}
        self.marks: dict[str, bytes] = {}
        self.chunks = kernels.Remembered(CHUNK_BYTES)

    def merge(self, data: bytes) -> list[int]:
        """Plain merging by rank; used on the few bytes of a pair of tokens only."""
        parts, rank = [data[i : i + 1] for i in range(len(data))], self.rank
        while len(parts) > 1:
            best = min(((r, i) for i in range(len(parts) - 1) if (r := rank.get(parts[i] + parts[i + 1])) is not None), default=None)
            if best is None:
                break
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [rank[p] for p in parts]

    def stands_alone(self, t: int) -> bool:
        if (ok := self.alone.get(t)) is None:
            ok = self.alone[t] = self.merge(self.token[t]) == [t]
        return ok

    def may_follow(self, p: int, t: int) -> bool:
        key = p << 32 | t
        if (ok := self.pairs.get(key)) is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            ok = self.pairs[key] = self.merge(self.token[p] + self.token[t]) == [p, t]
        return ok

    def fill(self, data: bytes, last: list[int], to: int | None = None) -> list[int]:
        """Extend last, where last[j] is the last token of data[:j] and last[0] is -1, to all prefixes of data."""
        rank, longest, pairs = self.rank.get, self.longest, self.pairs.get
        for j in range(len(last), (len(data) if to is None else to) + 1):
            for i in range(max(0, j - longest), j):
                t = rank(data[i:j])
                if t is None:
                    continue
                if i == 0:
                    ok = self.stands_alone(t)
                elif (ok := pairs(last[i] << 32 | t)) is None:  # what may follow also stands alone
                    ok = self.may_follow(last[i], t)
                if ok:
                    last.append(t)
                    break
            else:
                raise ValueError("the ranks don't hold every single byte")
        return last

    def table(self, data: bytes) -> list[int]:
        """fill(data, [-1]); the automaton finds all tokens that end at each prefix, the longest first."""
        last, pairs = [-1] * (len(data) + 1), self.pairs.get
        for end, (n, t) in self.matcher.iter(data.decode("latin-1")):
            end += 1
            if last[end] < 0:
                if n == end:
                    ok = self.stands_alone(t)
                elif (ok := pairs(last[end - n] << 32 | t)) is None:
                    ok = self.may_follow(last[end - n], t)
                if ok:
                    last[end] = t
        return last

    def read(self, last: list[int], end: int | None = None) -> list[int]:
        """The ids of the prefix of length end."""
        j, ids = len(last) - 1 if end is None else end, []
        while j:
            ids.append(last[j])
            j -= len(self.token[last[j]])
        return ids[::-1]

    def append(self, data: bytes, last: list[int], more: bytes) -> tuple[bytes, list[int]]:
        """The table after an append; what was there stays as it is."""
        return (data := data + more), self.fill(data, last)

    def edit(self, data: bytes, last: list[int], start: int, end: int, new: bytes) -> tuple[bytes, list[int], int]:
        """Replace data[start:end] by new: (data, table, prefixes filled anew).

        Behind the edit a last token depends on at most the longest token's bytes and the last tokens before it, so once
        as many consecutive entries agree with the old table, the rest of it is taken over.
        """
        edited, shift = data[:start] + new + data[end:], len(new) - (end - start)
        table, run, j = last[: start + 1], 0, start + 1
        while j <= len(edited):
            self.fill(edited, table, j)
            run = run + 1 if j - shift > end and j > start + len(new) and table[j] == last[j - shift] else 0
            j += 1
            if run >= self.longest:
                return edited, table + last[j - shift :], j - start - 1
        return edited, table, j - start - 1

    def piece(self, piece: str) -> bytes:
        """The ids, as little-endian unsigned 32-bit integers, of one match of the pattern."""
        data = piece.encode("utf-8", "surrogatepass")
        whole = self.rank.get(data)
        return self.raw[whole] if whole is not None else b"".join(map(self.raw.__getitem__, self.read(self.table(data))))

    def mark(self, mark: str) -> bytes:
        if (out := self.marks.get(mark)) is None:
            out = self.marks[mark] = self.piece(mark)
        return out

    def matches(self, text: str) -> bytes:
        return b"".join(map(self.piece, self.split(text)))

    def after_blank(self, x: str) -> bytes:
        """The ids of " " + x. Letters, with one mark after them or none, are one match, and the mark is another."""
        bare, mark = (x[:-1], x[-1]) if x and x[-1] in ",.;:!?" else (x, "")
        if bare.isalpha() and max(bare) < "\u0180":
            ids = self.chunks.data.get(bare) if mark else None
            return (self.piece(" " + bare) if ids is None else ids) + (self.mark(mark) if mark else b"")
        return self.matches(" " + x)

    def encode(self, text: str | None) -> bytes:
        """The ids of a whole text. A blank after a non-blank starts a new match of the pattern, so texts without two blanks
        in a row are cut there, and chunks met before are looked up (by what follows the blank); others are matched as a
        whole."""
        if not text:
            return b""
        if "  " in text:
            return self.matches(text)
        head, *rest = text.split(" ")
        known, new = self.chunks.data, {}
        if missing := set(rest).difference(known):
            new = {x: self.after_blank(x) for x in missing}
            if self.chunks.keep(new):
                new = {}
        out = [known[x] if x in known else new[x] for x in rest] if new else map(known.__getitem__, rest)
        return (self.matches(head) if head else b"") + b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.token.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_KNOWN: dict[str, PrefixBPE] = {}
kernels.MEMORIES["bpe"] = _KNOWN.clear


def codec(ranks: bytes, pattern: str) -> PrefixBPE:
    """One codec for each worker process and table."""
    key = hashlib.sha256(ranks + pattern.encode()).hexdigest()
    if key not in _KNOWN:
        _KNOWN.clear()
        _KNOWN[key] = PrefixBPE(ranks, pattern)
    return _KNOWN[key]


def encode(docs: DataFrame, ranks: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """(id, n_tokens long, ids binary: little-endian unsigned 32-bit; with decoded also decoded binary: the ids' bytes)."""
    small = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = small.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(ranks, pattern)
        for batch in batches:
            texts = batch.column(1)
            for s in range(0, max(len(texts), 1), 512):
                ids = [bpe.encode(t.as_py()) for t in texts[s : s + 512]]
                out = [batch.column(0)[s : s + 512], pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
                names = [id_col, "n_tokens", "ids"]
                if decoded:
                    out.append(pa.array([bpe.decode(x) for x in ids], pa.binary()))
                    names.append("decoded")
                yield pa.RecordBatch.from_arrays(out, names=names)

    schema = f"`{id_col}` {id_type}, n_tokens bigint, ids binary" + ", decoded binary" * decoded
    return small.mapInArrow(kernels.trimmed(run, "bpe"), schema)


def decode(encoded: DataFrame, ranks: bytes, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) of ids as encode() gives them; null ids give null."""
    small = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    id_type = small.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(ranks, pattern)
        for batch in batches:
            texts = [None if x is None else bpe.decode(x).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    return small.mapInArrow(kernels.trimmed(run, "bpe"), f"`{id_col}` {id_type}, text string")
