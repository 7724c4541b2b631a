"""Media containers decoded to rows: EBML elements and Matroska blocks, MP4 boxes, Ogg pages.

Each decoder is a generator over the bytes of one file, bounds-checked: what is cut off or malformed ends the level it is in,
and what was read stays. In Spark they run by Arrow batches of files; a file's rows stay in its task.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element ids with their names and kinds (m master, u unsigned, f float, s string, b bytes, d date).
EBML = {
    0x1A45DFA3: ("EbmlHeader", "m"), 0x4286: ("EbmlVersion", "u"), 0x42F7: ("EbmlReadVersion", "u"), 0x42F2: ("EbmlMaxIdLength", "u"), 0x42F3: ("EbmlMaxSizeLength", "u"),
    0x4282: ("DocType", "s"), 0x4287: ("DocTypeVersion", "u"), 0x4285: ("DocTypeReadVersion", "u"),
    0x18538067: ("Segment", "m"), 0x1549A966: ("SegmentInfo", "m"), 0x73A4: ("SegmentUId", "b"), 0x7384: ("SegmentFilename", "s"), 0x3CB923: ("PreviousUId", "b"), 0x3C83AB: ("PreviousFilename", "s"),
    0x3EB923: ("NextUId", "b"), 0x3E83BB: ("NextFilename", "s"), 0x2AD7B1: ("TimecodeScale", "u"), 0x4489: ("Duration", "f"), 0x4461: ("ProductionDate", "d"), 0x7BA9: ("Title", "s"), 0x4D80: ("MuxingApp", "s"), 0x5741: ("WritingApp", "s"),
    0x1F43B675: ("Cluster", "m"), 0xE7: ("Timecode", "u"), 0xA3: ("SimpleBlock", "x"), 0xA0: ("BlockGroup", "m"), 0xA1: ("Block", "x"),
    0x1654AE6B: ("Tracks", "m"), 0xAE: ("Track", "m"), 0xD7: ("TrackNumber", "u"), 0x73C5: ("TrackUId", "u"), 0x83: ("TrackType", "u"), 0xB9: ("FlagEnabled", "u"), 0x88: ("FlagDefault", "u"), 0x55AA: ("FlagForced", "u"), 0x9C: ("FlagLacing", "u"),
    0x6DE7: ("MinCache", "u"), 0x6DF8: ("MaxCache", "u"), 0x23E383: ("DefaultDuration", "u"), 0x234E7A: ("DefaultDecodedFieldDuration", "u"), 0x23314F: ("TrackTimecodeScale", "f"), 0x55EE: ("MaxBlockAdditionID", "u"), 0x536E: ("Name", "s"), 0x22B59C: ("Language", "s"),
    0x86: ("CodecId", "s"), 0x63A2: ("CodecPrivate", "b"), 0x258688: ("CodecName", "s"), 0x7446: ("AttachmentLink", "u"), 0x6FAB: ("TrackOverlay", "u"),
    0xE0: ("Video", "m"), 0x9A: ("Interlaced", "u"), 0x53B8: ("StereoMode", "u"), 0x53C0: ("AlphaMode", "u"), 0x53B9: ("OldStereoMode", "u"), 0xB0: ("PixelWidth", "u"), 0xBA: ("PixelHeight", "u"), 0x54AA: ("PixelCropBottom", "u"), 0x54BB: ("PixelCropTop", "u"), 0x54CC: ("PixelCropLeft", "u"), 0x54DD: ("PixelCropRight", "u"),
    0x54B0: ("DisplayWidth", "u"), 0x54BA: ("DisplayHeight", "u"), 0x54B2: ("DisplayUnit", "u"), 0x54B3: ("AspectRatioType", "u"), 0x2EB524: ("ColorSpace", "b"), 0x2383E3: ("FrameRate", "f"),
    0xE1: ("Audio", "m"), 0xB5: ("SamplingFrequency", "f"), 0x78B5: ("OutputSamplingFrequency", "f"), 0x9F: ("ChannelCount", "u"), 0x6264: ("BitDepth", "u"),
    0x6D80: ("ContentEncodings", "m"), 0x6240: ("ContentEncoding", "m"), 0x5031: ("ContentEncodingOrder", "u"), 0x5032: ("ContentEncodingScope", "u"), 0x5033: ("ContentEncodingType", "u"), 0x5034: ("ContentCompression", "m"), 0x4254: ("ContentCompAlgo", "u"), 0x5035: ("ContentEncryption", "m"), 0x47E1: ("ContentEncAlgo", "u"),
    0x1C53BB6B: ("Cues", "m"), 0xBB: ("CuePoint", "m"), 0xB3: ("CueTime", "u"), 0xB7: ("CueTrackPositions", "m"), 0xF7: ("CueTrack", "u"), 0xF1: ("CueClusterPosition", "u"), 0xF0: ("CueRelativePosition", "u"), 0xB2: ("CueDuration", "u"), 0x5378: ("CueBlockNumber", "u"),
    0x114D9B74: ("SeekHead", "m"), 0x4DBB: ("Seek", "m"), 0x53AB: ("SeekId", "b"), 0x53AC: ("SeekPosition", "u"),
    0x1941A469: ("Attachments", "m"), 0x61A7: ("AttachedFile", "m"), 0x467E: ("FileDescription", "s"), 0x466E: ("FileName", "s"), 0x4660: ("FileMimeType", "s"), 0x465C: ("FileData", "x"), 0x46AE: ("FileUId", "u"),
    0x1043A770: ("Chapters", "m"), 0x45B9: ("EditionEntry", "m"), 0x45BC: ("EditionUId", "u"), 0x45BD: ("EditionFlagHidden", "u"), 0x45DB: ("EditionFlagDefault", "u"), 0x45DD: ("EditionFlagOrdered", "u"), 0xB6: ("ChapterAtom", "m"), 0x73C4: ("ChapterUId", "u"), 0x5654: ("ChapterStringUId", "s"), 0x91: ("ChapterTimeStart", "u"), 0x92: ("ChapterTimeEnd", "u"),
    0x98: ("ChapterFlagHidden", "u"), 0x4598: ("ChapterFlagEnabled", "u"), 0x6E67: ("ChapterSegmentUId", "b"), 0x6EBC: ("ChapterSegmentEditionUId", "u"), 0x63C3: ("ChapterPhysicalEquivalent", "u"), 0x8F: ("ChapterTrack", "m"), 0x89: ("ChapterTrackNumber", "u"), 0x80: ("ChapterDisplay", "m"), 0x85: ("ChapterString", "s"), 0x437C: ("ChapterLanguage", "s"), 0x437E: ("ChapterCountry", "s"),
    0x6944: ("ChapterProcess", "m"), 0x6955: ("ChapterProcessCodecId", "u"), 0x6911: ("ChapterProcessCommand", "m"), 0x6922: ("ChapterProcessTime", "u"),
    0x1254C367: ("Tags", "m"), 0x7373: ("Tag", "m"), 0x63C0: ("Targets", "m"), 0x68CA: ("TargetTypeValue", "u"), 0x63CA: ("TargetType", "s"), 0x63C5: ("TagTrackUId", "u"), 0x63C9: ("TagEditionUId", "u"), 0x63C4: ("TagChapterUId", "u"), 0x63C6: ("TagAttachmentUId", "u"), 0x67C8: ("SimpleTag", "m"), 0x45A3: ("TagName", "s"), 0x447A: ("TagLanguage", "s"), 0x4484: ("TagDefault", "u"), 0x4487: ("TagString", "s"), 0x4485: ("TagBinary", "b"),
}
_TOP = {0x114D9B74, 0x1549A966, 0x1F43B675, 0x1654AE6B, 0x1C53BB6B, 0x1941A469, 0x1043A770, 0x1254C367, 0x1A45DFA3, 0x18538067}
MAX_VALUE = 16 << 20


def vint(data, at: int, keep_marker: bool) -> tuple[int | None, int]:
    """(value, length) of a variable-length integer; None for an unknown size. Length 0: there is none."""
    if at >= len(data) or not data[at]:
        return None, 0
    n = 9 - data[at].bit_length()
    if at + n > len(data):
        return None, 0
    value = int.from_bytes(data[at : at + n], "big")
    if keep_marker:
        return value, n
    value &= (1 << 7 * n) - 1
    return (None if value == (1 << 7 * n) - 1 else value), n


@dataclass
class Element:
    """One element: where its payload lies, how deep it is, and its value if it is no master."""

    id: int
    name: str
    kind: str
    depth: int
    parent: int
    start: int
    end: int
    known: bool
    value: object = None
    size: int | None = None  # as stated


def _scalar(kind: str, raw: bytes):
    if kind == "u":
        return int.from_bytes(raw, "big") if len(raw) <= 8 else None
    if kind == "f":
        return {0: lambda: 0.0, 4: lambda: struct.unpack(">f", raw)[0], 8: lambda: struct.unpack(">d", raw)[0]}.get(len(raw), lambda: None)()
    if kind == "s":
        return raw.split(b"\0")[0].decode("utf-8", "replace")
    if kind == "d":
        return 978307200 + int.from_bytes(raw, "big", signed=True) / 1e9 if len(raw) == 8 else None
    return bytes(raw)


def elements(data: bytes) -> Iterator[Element]:
    """All known elements in file order. A master of unknown size ends where an element stands that can't be inside it."""
    view, at, number = memoryview(data), 0, -1
    open_: list[tuple[int, int, int]] = []  # number, id, end
    while at < len(data):
        while open_ and at >= open_[-1][2] >= 0:
            open_.pop()
        limit = next((e for _, _, e in reversed(open_) if e >= 0), len(data))
        id_, n = vint(view, at, True)
        size, m = vint(view, at + n, False) if 0 < n <= 4 else (None, 0)
        if not m:
            if not open_ or limit >= len(data):
                return
            at = limit
            continue
        start = at + n + m
        while open_ and open_[-1][2] < 0 and (id_ in (0x1A45DFA3, 0x18538067) if open_[-1][1] == 0x18538067 else id_ in _TOP or id_ == open_[-1][1]):
            open_.pop()
        end = min(start + size, limit) if size is not None else -1
        known = EBML.get(id_)
        if known:
            number += 1
            name, kind = known
            e = Element(id_, name, kind, len(open_), open_[-1][0] if open_ else -1, start, end if end >= 0 else limit, size is not None, None, size)
            if kind not in "mx" and 0 <= e.end - start <= MAX_VALUE and size is not None:
                e.value = _scalar(kind, bytes(view[start : e.end]))
            elif kind == "x":
                e.value = bytes(view[start : min(e.end, start + 32)])
            yield e
            if kind == "m":
                open_.append((number, id_, end))
                at = start
                continue
        if end < 0:
            return
        at = end


@dataclass
class Tree:
    """An element with what is inside it."""

    element: Element
    inside: list[Tree] = field(default_factory=list)

    def all(self, name: str) -> list[Tree]:
        return [t for t in self.inside if t.element.name == name]

    def one(self, name: str) -> Tree | None:
        return next(iter(self.all(name)), None)

    def get(self, name: str, default=None):
        found = [t.element.value for t in self.inside if t.element.name == name and t.element.value is not None]
        return found[-1] if found else default

    def values(self, name: str) -> list:
        return [t.element.value for t in self.all(name)]


def trees(data: bytes, skip: tuple[str, ...] = ("Cluster",)) -> list[Tree]:
    """The top elements with all below them, but what is inside those in skip."""
    nodes: list[Tree] = []
    tops = []
    for e in elements(data):
        t = Tree(e)
        nodes.append(t)
        if e.parent < 0:
            tops.append(t)
        elif nodes[e.parent].element.name not in skip:
            nodes[e.parent].inside.append(t)
    return tops


def block_header(raw: bytes) -> tuple[int, int, int, int] | None:
    """(track, time relative to the cluster, flags, frames) of a block."""
    track, n = vint(raw, 0, False)
    if not n or len(raw) < n + 3:
        return None
    time, flags = struct.unpack_from(">hB", raw, n)
    frames = raw[n + 3] + 1 if flags & 0x06 and len(raw) > n + 3 else 1
    return track, time, flags, frames


def blocks(data: bytes) -> Iterator[tuple[int, int, int, int, int]]:
    """(track, time in nanoseconds, frames, size, order) of all blocks of a Matroska file.

    Scales count from where they are read on: before the segment's information all times are 0, before a track's entry its own
    scale is 1. Blocks that stand before the entries belong to their track all the same.
    """
    scale, tracks, entry, cluster, order = 0, {}, {}, 0, 0
    for e in elements(data):
        if e.name == "SegmentInfo":
            scale = 1_000_000
        elif e.name == "TimecodeScale":
            scale = e.value or 0
        elif e.name == "Track":
            entry = {}
        elif e.name in ("TrackNumber", "TrackTimecodeScale"):
            entry[e.name] = e.value
            if "TrackNumber" in entry:
                tracks[entry["TrackNumber"]] = entry.get("TrackTimecodeScale") or 1.0
        elif e.name == "Timecode":
            cluster = e.value or 0
        elif e.name in ("SimpleBlock", "Block") and (head := block_header(e.value)):
            track, time, flags, frames = head
            used = vint(e.value, 0, False)[1] + 3 + (1 if flags & 0x06 else 0)
            yield track, max(0, int((time + cluster) * tracks.get(track, 1.0) * scale)), frames, e.end - e.start - used, order
            order += 1


#: Where a segment, or its information without one, must have come, and how much a file may be longer than its segment.
SEARCHED, LONGER, LONGER_RATIO = 4 << 20, 1 << 20, 1.01


def matroska_file(data: bytes) -> tuple[Tree, Tree] | None:
    """(header, segment) of a Matroska file that has information and tracks; None for any other.

    The header comes first. A file may start with the information where the segment's own element is missing. A segment of
    known size must account for nearly the whole file.
    """
    if data[:4] != b"\x1a\x45\xdf\xa3":
        return None
    tops = trees(data)
    for i, t in enumerate(tops[1:], 1):
        if t.element.name == "Segment":
            segment = t
            break
        if t.element.name == "SegmentInfo":
            whole = Element(0x18538067, "Segment", "m", 0, -1, t.element.start, len(data), False)
            segment = Tree(whole, tops[i:])
            break
        if t.element.start > SEARCHED:
            return None
    else:
        return None
    if not segment.one("SegmentInfo") or not segment.one("Tracks"):
        return None
    if segment.element.known:
        size = segment.element.size
        if not size or any(n - size >= LONGER or n / size >= LONGER_RATIO for n in (len(data), min(len(data), segment.element.start + size))):
            return None
    return tops[0], segment


# Boxes that hold boxes, and the bytes that stand before those.
BOXES = {"moov": 0, "trak": 0, "mdia": 0, "minf": 0, "stbl": 0, "edts": 0, "dinf": 0, "udta": 0, "mvex": 0, "moof": 0, "traf": 0, "mfra": 0, "meta": 4}
BOX_DATA = {"ftyp", "mvhd", "tkhd", "mdhd", "hdlr", "stsd", "elst", "vmhd", "smhd"}


def boxes(data: bytes, start: int = 0, end: int | None = None, path: str = "", order: list[int] | None = None) -> Iterator[tuple[str, str, int, bytes | None, int]]:
    """(path, type, size, data of the boxes that are decoded, order), depth first, at most 16 deep."""
    order = order if order is not None else [0]
    end = len(data) if end is None else end
    at, k = start, 0
    while at + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, at)
        head = 8
        if size == 1 and at + 16 <= end:
            size, head = struct.unpack_from(">Q", data, at + 8)[0], 16
        elif size == 0:
            size = end - at
        if kind == b"uuid":
            head += 16
        if size < head or not all(32 <= c < 127 or c == 0xA9 for c in kind):
            return
        name = kind.decode("latin-1")
        own = f"{path}/{k}:{name}"
        stop = min(at + size, end)
        body = bytes(data[at + head : stop]) if name in BOX_DATA and stop - at - head <= MAX_VALUE else None
        yield own, name, size, body, order[0]
        order[0] += 1
        if name in BOXES and own.count("/") < 16:
            yield from boxes(data, at + head + BOXES[name], stop, own, order)
        at, k = at + size, k + 1


PAGE_SPAN_AFTER = 0x10000


def pages(data: bytes) -> Iterator[tuple[int, int, int, int, int, bytes]]:
    """(stream, page, flags, granule, length, data) of Ogg pages; up to 1 MiB of other bytes between them is passed over."""
    at = 0
    while True:
        if data[at : at + 4] != b"OggS":
            at = data.find(b"OggS", at, at + (1 << 20) + 4) if at else -1
            if at < 0:
                return
        if at + 27 > len(data):
            return
        _, flags, granule, stream, page, _, n = struct.unpack_from("<BBqIIIB", data, at + 4)
        table = data[at + 27 : at + 27 + n]
        size, body = sum(table), at + 27 + n
        if len(table) < n:
            return
        yield stream, page, flags | (PAGE_SPAN_AFTER if n and table[-1] == 255 else 0), granule, size, bytes(data[body : body + size])
        at = body + size


def _rows(files: DataFrame, decode: Callable[[bytes], Iterator[tuple]], columns: str, path: str, content: str) -> DataFrame:
    small = files.select(F.col(path).alias("path"), F.col(content).alias("content"))
    names = ["path", *(c.split()[0] for c in columns.split(", "))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for p, c in zip(batch["path"], batch["content"], strict=True):
                yield pd.DataFrame([(p, *r) for r in decode(bytes(c or b""))], columns=names)

    return small.mapInPandas(run, f"path string, {columns}")


def element_rows(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """(path, ord, parent, depth, id, name, start, size, known, text) of EBML elements."""
    make = lambda c: ((i, e.parent, e.depth, e.id, e.name, e.start, e.end - e.start, e.known, None if e.value is None or e.kind == "x" else e.value.hex() if isinstance(e.value, bytes) else str(e.value)) for i, e in enumerate(elements(c)))
    return _rows(files, make, "ord long, parent long, depth int, id long, name string, start long, size long, known boolean, text string", path, content)


def block_rows(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """(path, track, timecode_ns, frames, size, ord): what stats.track_stats takes."""
    return _rows(files, blocks, "track long, timecode_ns long, frames int, size long, ord long", path, content)


def box_rows(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    return _rows(files, boxes, "box_path string, type string, size long, data binary, ord int", path, content)


def page_rows(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    make = lambda c: ((s, p, f & 0xFF, g, n, i) for i, (s, p, f, g, n, _) in enumerate(pages(c)))
    return _rows(files, make, "stream_id long, page_index long, flags long, granule long, data_len int, ord int", path, content)
