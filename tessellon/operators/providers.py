"""What is found in a file as items: rows (path, provider, rank, root type, node, order, key, type, unit, text, items).

Providers are Python functions from bytes to a node; their rank is their place in the registry. A node is a container of
items and nodes; a node's path in the rows is the list of (type, id) from the root, so that merging is a grouping.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessellon.functions import values
from tessellon.operators import containers as C
from tessellon.operators import subtitles

# Units, stream types and enumerations as the reports write them.
NONE, BYTES, SECONDS, HERTZ, BITRATE = "Dimensionsless", "bytes", "s", "s^-1", "bit/s"
STREAMS = {1: "VideoStream", 2: "AudioStream", 0x11: "SubtitleStream"}
STEREO = ["Mono", "LeftRight", "BottomTop", "TopBottom", "CheckBoardRight", "CheckboardLeft", "RowInterleavedRight", "RowInterleavedLeft", "ColumnInterleavedRight", "ColumnInterleavedLeft", "AnaGlyphCyanRed", "RightLeft", "AnaGlyphGreenMagenta", "AlternatingFramesRight", "AlternatingFramesLeft"]
UNITS = ["Pixels", "Centimeters", "Inches", "AspectRatio", "Unknown"]
RATIOS = ["FreeResizing", "KeepAr", "Fixed", "Unknown"]


@dataclass
class Node:
    """A container: items (key, type, unit, value) and nodes. An item whose key and type are there already is left out."""

    type: str
    id: int = 0
    items: list[tuple[str, str, str, object]] = field(default_factory=list)
    nodes: list[Node] = field(default_factory=list)

    def add(self, key: str, kind: str, value, unit: str = NONE) -> None:
        if value is not None and all((k, t) != (key, kind) for k, t, _, _ in self.items):
            self.items.append((key, kind, unit, value))

    def child(self, type_: str, id_: int) -> Node:
        self.nodes.append(Node(type_, id_))
        return self.nodes[-1]


def _signed(v: int | None, bits: int) -> int | None:
    return None if v is None else (v + (1 << bits - 1)) % (1 << bits) - (1 << bits - 1)


def _box(rows: list, kind: str, under: str = "") -> bytes | None:
    """The data of the shallowest box of a type below a path."""
    found = [r for r in rows if r[1] == kind and r[0].startswith(under + "/")]
    return min(found, key=lambda r: (r[0].count("/"), r[4]))[3] if found else None


def _times(data: bytes, wide: bool) -> tuple[float | None, float | None]:
    a, b = struct.unpack_from(">QQ" if wide else ">II", data, 4)
    return tuple(t - 2082844800.0 if t else None for t in (a, b))


def mp4(data: bytes) -> Node | None:
    """MP4: brands, times, duration, and streams with their sizes, codecs and languages."""
    rows = list(C.boxes(data)) if len(data) >= 8 else []
    kinds = {r[1] for r in rows}
    if not kinds & {"ftyp", "moov"}:
        return None
    root = Node("MediaProvider")
    root.add("FileSize", "Int64", len(data), BYTES)
    if (b := _box(rows, "ftyp")) and len(b) >= 8:
        brands = [b[i : i + 4].decode("latin-1") for i in range(8, len(b) - 3, 4)]
        root.add("ContainerVersion", "String", f"MajorBrands={b[:4].decode('latin-1')} MinorVersion={int.from_bytes(b[4:8], 'big')} CompatibleBrands={'/'.join(brands)}")
    if (b := _box(rows, "mvhd")) and len(b) >= (32 if b[0] == 1 else 20):
        made, changed = _times(b, b[0] == 1)
        root.add("CreationDate", "DateTime", made)
        root.add("ModificationDate", "DateTime", changed)
        scale, length = struct.unpack_from(">IQ" if b[0] == 1 else ">II", b, 20 if b[0] == 1 else 12)
        if scale:
            root.add("Duration", "Double", length / scale, SECONDS)
    tracks = [r[0] for r in rows if r[1] == "trak"]
    kind_of = {t: (h[8:12].decode("latin-1") if (h := _box(rows, "hdlr", t)) and len(h) >= 12 else "") for t in tracks}
    root.add("SuggestedFileExtension", "ImmutableArray`1", ["m4a" if tracks and all(k == "soun" for k in kind_of.values()) else "mp4"])
    for t in tracks:
        head = _box(rows, "tkhd", t)
        wide = bool(head) and head[0] == 1
        if not head or len(head) < (96 if wide else 84) or kind_of[t] == "hint":
            continue
        number = struct.unpack_from(">I", head, 20 if wide else 12)[0]
        node = root.child({"vide": "VideoStream", "soun": "AudioStream"}.get(kind_of[t], "MediaStream"), number)
        entries, table = [], _box(rows, "stsd", t) or b""
        at = 8
        while at + 8 <= len(table):
            size = int.from_bytes(table[at : at + 4], "big")
            entries.append((table[at + 4 : at + 8].decode("latin-1"), table[at + 8 : at + max(size, 8)]))
            at += max(size, 8)
        if kind_of[t] == "vide":
            size = tuple(v >> 16 for v in struct.unpack_from(">II", head, len(head[: 96 if wide else 84]) - 8))
            same = all(struct.unpack_from(">HH", e, 24) == size for _, e in entries if len(e) >= 28)
            node.add("PixelDimensions", "Dimensions", size if same else None)
            node.add("DisplayDimensions", "Dimensions", size if same else None)
        if entries and kind_of[t] in ("vide", "soun"):
            node.add("ContainerCodecId", "String", entries[0][0])
        node.add("Id", "UInt64", number)
        for b in (head, _box(rows, "mdhd", t)):
            if b and len(b) >= 24:
                made, changed = _times(b, b[0] == 1)
                node.add("CreationDate", "DateTime", made)
                node.add("ModificationDate", "DateTime", changed)
        if (b := _box(rows, "mdhd", t)) and len(b) >= (36 if b[0] == 1 else 24):
            at = 20 if b[0] == 1 else 12
            scale, length = struct.unpack_from(">IQ" if b[0] == 1 else ">II", b, at)
            if scale:
                node.add("Duration", "TimeSpan", length / scale, SECONDS)
            packed = struct.unpack_from(">H", b, at + (12 if b[0] == 1 else 8))[0]
            language = "".join(chr(0x60 + (packed >> s & 31)) for s in (10, 5, 0))
            node.add("Language", "String", language if language != "```" else None)
    return root


def track_numbers(samples: list[tuple[int, int, int]], private: int = 0) -> dict:
    """Statistics of one track's (time, frames, size), as stats.track_stats has them for tables."""
    if not samples:
        return {}
    samples = sorted(samples, key=lambda s: s[0])
    low = high = None
    last: list[float] = []
    bins: dict[float, int] = {}
    for (t0, f0, _), (t1, _, _) in zip(samples, samples[1:], strict=False):
        r = float("inf") if t1 == t0 else 1e9 * f0 / (t1 - t0)
        r1, r2 = (last[-1] if last else r), (last[-2] if len(last) > 1 else 0.0)
        near = (r1 + r2 / 2) * 0.1
        if r != float("inf"):
            bins[r] = bins.get(r, 0) + 1
            if abs(r - r1) < near and abs(r - r2) < near:
                low, high = min(r, low or r), max(r, high or r)
        last.append(r)
    ms = (samples[-1][0] - samples[0][0]) // 1_000_000
    size, frames = private + sum(s[2] for s in samples), sum(s[1] for s in samples)
    n = sum(bins.values())
    spread = (sum(r * r for r in bins) / n - (sum(bins) / n) ** 2) if n else float("nan")
    return {
        "length": ms / 1000, "size": size, "frames": frames, "bins": list(bins.items()), "low": low, "high": high,
        "bitrate": size * 8 / (ms / 1000) if size and ms else None, "rate": frames / (ms / 1000) if frames and ms else None,
        "dominant": max(enumerate(bins.items()), key=lambda b: (b[1][1], b[0]))[1][0] if bins else None, "spread": spread**0.5 if spread >= 0 else float("nan"),
    }


def matroska(data: bytes) -> Node | None:
    """Matroska: segment, tracks with statistics of their blocks, tags, attachments, chapters."""
    if (found := C.matroska_file(data)) is None:
        return None
    header, segment = found
    info, kind = segment.all("SegmentInfo")[-1], header.get("DocType", "matroska")
    tracks = segment.one("Tracks").all("Track")
    scale = info.get("TimecodeScale", 1_000_000)
    root = Node("MediaProvider")
    root.add("FileSize", "Int64", len(data), BYTES)
    root.add("ContainerVersion", "String", f"DocType={kind} DocTypeVersion={header.get('DocTypeVersion', 1)}")
    root.add("CreationDate", "DateTime", info.get("ProductionDate"))
    length = info.get("Duration")
    root.add("Duration", "Double", None if length is None else length * scale / 1e9, SECONDS)
    for key, name, t in (("Id", "SegmentUId", "Binary"), ("PreviousId", "PreviousUId", "Binary"), ("NextId", "NextUId", "Binary"), ("PreviousName", "PreviousFilename", "String"), ("NextFileName", "NextFilename", "String"), ("WritingApp", "WritingApp", "String"), ("MuxingApp", "MuxingApp", "String")):
        root.add(key, t, info.get(name))
    types = [t.get("TrackType", 0) for t in tracks]
    stereo = any((v := t.one("Video")) is not None and v.get("StereoMode", 0) for t in tracks if t.get("TrackType") == 1)
    ext = "webm" if kind.lower() == "webm" else "mk3d" if stereo else next((e for k, e in ((1, "mkv"), (2, "mka"), (0x11, "mks")) if k in types), None)
    root.add("SuggestedFileExtension", "ImmutableArray`1", [ext] if ext else None)
    samples: dict[int, list] = {}
    for track, time, frames, size, _ in C.blocks(data):
        samples.setdefault(track, []).append((time, frames, size))
    seen: dict[str, int] = {}
    for t in tracks:
        _track(root, segment, t, samples.get(t.get("TrackNumber"), []), seen)
    tags = segment.all("Tags")
    if tags:
        _tags(root, max(enumerate(tags), key=lambda x: (len(x[1].all("Tag")), x[0]))[1])
    attached = segment.all("Attachments")
    root.add("AttachmentSize", "Int64", attached[-1].element.end - attached[-1].element.start if attached and attached[-1].element.known else 0, BYTES)
    for a in attached[-1].all("AttachedFile") if attached else []:
        node = root.child("Attachment", a.get("FileUId", 0))
        node.add("Id", "Int64", _signed(a.get("FileUId", 0), 64))
        node.add("Size", "Int64", a.element.end - a.element.start, BYTES)
        node.add("Type", "String", a.get("FileMimeType"))
        node.add("Description", "String", a.get("FileDescription"))
    for e in segment.all("Chapters")[-1].all("EditionEntry") if segment.all("Chapters") else []:
        if e.all("ChapterAtom"):
            node = root.child("Chapters", e.get("EditionUId", sum(n.type == "Chapters" for n in root.nodes)))
            node.add("Id", "Int32", _signed(e.get("EditionUId"), 32))
            for key, name in (("IsHidden", "EditionFlagHidden"), ("IsDefault", "EditionFlagDefault"), ("IsOrdered", "EditionFlagOrdered")):
                node.add(key, "Boolean", e.get(name, 0) == 1)
            for a in e.all("ChapterAtom"):
                _chapter(node, a)
    return root


def _track(root: Node, segment: C.Tree, t: C.Tree, samples: list, seen: dict[str, int]) -> None:
    kind = STREAMS.get(t.get("TrackType", 0), "MediaStream")
    node = root.child(kind, t.get("TrackUId", 0))
    private = t.get("CodecPrivate")
    if not samples and private and t.get("CodecId") in ("S_TEXT/ASS", "S_TEXT/SSA"):
        samples = [(time, 1, 0) for time in subtitles.script_times(private)]
    numbers = track_numbers(samples, len(private or b""))
    stated = t.get("DefaultDuration")
    if kind == "VideoStream" and (v := t.one("Video")):
        w, h = v.get("PixelWidth", 0), v.get("PixelHeight", 0)
        dw, dh = v.get("DisplayWidth", w), v.get("DisplayHeight", h)
        color = v.get("ColorSpace")
        node.add("AspectRatioBehavior", "AspectRatioBehavior", RATIOS[min(v.get("AspectRatioType", 0), 3)])
        node.add("ColorSpace", "Int32", _signed(int.from_bytes(color[:4], "little"), 32) if color else None)
        node.add("DisplayDimensions", "Dimensions", (dw, dh))
        node.add("DisplayUnit", "DisplayUnit", UNITS[min(v.get("DisplayUnit", 0), 4)])
        node.add("HasAlpha", "Boolean", v.get("AlphaMode", 0) != 0)
        node.add("IsInterlaced", "Boolean", v.get("Interlaced", 0) == 1)
        node.add("PixelCrop", "CropSides", tuple(v.get(f"PixelCrop{s}", 0) for s in ("Top", "Right", "Bottom", "Left")))
        node.add("PixelDimensions", "Dimensions", (w, h))
        ratio = lambda a, b: a / b if b else float("nan")
        node.add("StorageAspectRatio", "Double", ratio(w, h))
        node.add("PixelAspectRatio", "Double", ratio(h * dw, w * dh))
        node.add("DisplayAspectRatio", "Double", ratio(dw, dh))
        node.add("SampleCount", "Int64", numbers.get("frames"))
        node.add("StatedSampleRate", "Double", 1e9 / stated if stated else 0.0, HERTZ)
        mode = v.get("StereoMode", 0)
        node.add("StereoMode", "StereoModes", STEREO[mode] if mode < len(STEREO) else "Other")
    if kind == "AudioStream" and (a := t.one("Audio")):
        rate = a.get("SamplingFrequency", 8000.0)
        node.add("BitDepth", "Int32", a.get("BitDepth"))
        node.add("ChannelCount", "Int32", a.get("ChannelCount", 1))
        node.add("OutputSampleRate", "Double", a.get("OutputSamplingFrequency", rate), HERTZ)
        node.add("StatedSampleRate", "Double", rate, HERTZ)
        node.add("SampleCount", "Int64", int(int(numbers["length"] * 1e7 * rate) / 1e7) if numbers else None)
    index = seen[kind] = seen.get(kind, -1) + 1
    if numbers and kind in ("VideoStream", "AudioStream"):
        node.add("SampleRateHistogram", "List`1", [f"{values.double(r)}, {n}" for r, n in numbers["bins"]], HERTZ)
        for key, name in (("AverageSampleRate", "rate"), ("MinSampleRate", "low"), ("MaxSampleRate", "high"), ("DominantSampleRate", "dominant"), ("SampleRateVariance", "spread")):
            node.add(key, "Double", numbers[name], HERTZ)
        node.add("Bitrate", "Double", numbers["bitrate"], BITRATE)
    node.add("Index", "Int32", index)
    node.add("Id", "UInt64", t.get("TrackUId"))
    for key, name, default in (("IsDefault", "FlagDefault", 1), ("IsEnabled", "FlagEnabled", 1), ("IsForced", "FlagForced", 0)):
        node.add(key, "Boolean", t.get(name, default) == 1)
    node.add("IsOverlay", "Boolean", bool(t.all("TrackOverlay")))
    node.add("Language", "String", t.get("Language", "eng"))
    node.add("Title", "String", t.get("Name"))
    node.add("ContainerCodecId", "String", t.get("CodecId"))
    node.add("ContainerCodecName", "String", t.get("CodecName"))
    if cues := segment.all("Cues"):
        node.add("CueCount", "Int32", sum(any(p.get("CueTrack") == t.get("TrackNumber") for p in c.all("CueTrackPositions")) for c in cues[-1].all("CuePoint")))
    if private is not None:
        node.add("CodecPrivateSize", "Int32", len(private), BYTES)
        if t.get("CodecId") == "V_MS/VFW/FOURCC" and len(private) >= 40:
            node.add("ContainerCodecCC", "String", private[16:20].decode("latin-1"))
        if t.get("CodecId") == "A_MS/ACM" and len(private) >= 18:
            node.add("ContainerCodecCC", "String", f"{int.from_bytes(private[:2], 'little'):x}")
    if numbers:
        node.add("Duration", "TimeSpan", numbers["length"], SECONDS)
        node.add("Size", "Int64", numbers["size"], BYTES)


def _tags(root: Node, tags: C.Tree) -> None:
    def simple(t: C.Tree) -> str:
        inside = t.all("SimpleTag")
        value = t.get("TagString")
        value = value if value is not None else (t.get("TagBinary") or b"").hex().upper()
        return f"{t.get('TagName', '')}={value}" + (f" [{'; '.join(map(simple, inside))}]" if inside else "")

    out = []
    for tag in tags.all("Tag"):
        goals = tag.one("Targets")
        # Editions and chapters are named the other way round in the reports.
        named = (("Track", "TagTrackUId"), ("Chapter", "TagEditionUId"), ("Chapters", "TagChapterUId"), ("Attachment", "TagAttachmentUId"))
        ids = [f"{k}={v}" for k, n in named for v in (goals.values(n) if goals else [])]
        out.append((f"Targets({', '.join(ids)}) " if ids else "") + f"Tags({'; '.join(map(simple, tag.all('SimpleTag')))})")
    root.add("Tags", "List`1", out)


def _chapter(parent: Node, a: C.Tree) -> None:
    node = parent.child("Chapter", a.get("ChapterUId", sum(n.type == "Chapter" for n in parent.nodes)))
    node.add("Id", "Int32", _signed(a.get("ChapterUId"), 32))
    node.add("IdString", "String", a.get("ChapterStringUId"))
    for key in ("TimeStart", "TimeEnd"):
        ns = a.get(f"Chapter{key}")
        node.add(key, "Double", None if ns is None else ns / 1e9, "byte")
    node.add("IsHidden", "Boolean", a.get("ChapterFlagHidden", 0) == 1)
    node.add("IsEnabled", "Boolean", a.get("ChapterFlagEnabled", 1) == 1)
    node.add("SegmentId", "Binary", a.get("ChapterSegmentUId"))
    node.add("SegmentChaptersId", "Int32", _signed(a.get("ChapterSegmentEditionUId"), 32))
    node.add("PhysicalEquivalent", "Int32", _signed(a.get("ChapterPhysicalEquivalent"), 32))
    if track := a.one("ChapterTrack"):
        for v in track.values("ChapterTrackNumber"):
            node.add("AssociatedTrack", "Int32", _signed(v, 32))
    titles = [f"{d.get('ChapterString', '')} Languages({', '.join(d.values('ChapterLanguage'))}) Countries({', '.join(d.values('ChapterCountry'))})" for d in a.all("ChapterDisplay")]
    node.add("Titles", "ImmutableArray`1", titles)
    for inner in a.all("ChapterAtom"):
        _chapter(node, inner)
    node.add("HasOperations", "Boolean", bool(a.all("ChapterProcess")))


def _stream(page: bytes) -> dict:
    """What the first page of an Ogg stream says; short pages say nothing."""
    d = page
    if len(d) >= 53 and d[1:6] == b"video":
        unit = struct.unpack_from("<q", d, 17)[0]
        w, h = struct.unpack_from("<ii", d, 45)
        return {"kind": "VideoStream", "cc": d[9:13].decode("utf-8", "replace"), "rate": 1e7 / unit if unit else float("inf"), "size": (w, h), "comments": True}
    if len(d) >= 47 and d[1:6] == b"audio":
        return {"kind": "AudioStream", "cc": d[9:13].decode("utf-8", "replace"), "rate": float(struct.unpack_from("<q", d, 25)[0]), "channels": struct.unpack_from("<h", d, 45)[0], "comments": True}
    if len(d) >= 0x39 and d[1:5] == b"text":
        return {"kind": "SubtitleStream", "cc": d[9:13].decode("utf-8", "replace"), "comments": True}
    if len(d) >= 42 and d[1:7] == b"theora":
        n, m = struct.unpack_from(">II", d, 22)
        return {"kind": "VideoStream", "codec": "Theora", "rate": n / m if m else float("inf"), "size": (int.from_bytes(d[14:17], "big"), int.from_bytes(d[17:20], "big"))}
    if len(d) >= 30 and d[1:7] == b"vorbis":
        return {"kind": "AudioStream", "codec": "Vorbis", "rate": float(struct.unpack_from("<I", d, 12)[0]), "channels": d[11], "comments": True}
    if len(d) >= 79 and d[1:5] == b"FLAC":
        return {"kind": "AudioStream", "codec": "Flac", "rate": float(int.from_bytes(d[33:36], "big") >> 4), "channels": (d[35] >> 1 & 7) + 1}
    return {"kind": "MediaStream"}


def comments(data: bytes) -> dict[str, list[str]]:
    """Vorbis comments by lower-case name; nothing if they are cut off."""
    at = data.find(b"\x03vorbis")
    if at < 0:
        return {}
    at += 7
    out: dict[str, list[str]] = {}
    try:
        at += 4 + struct.unpack_from("<I", data, at)[0]
        count = struct.unpack_from("<I", data, at)[0]
        at += 4
        for _ in range(count):
            n = struct.unpack_from("<I", data, at)[0]
            if at + 4 + n > len(data):
                return {}
            name, eq, value = data[at + 4 : at + 4 + n].decode("utf-8", "replace").partition("=")
            name, value = (name.lower(), value) if eq else ("undefined", name)
            out.setdefault(name, []).append(value)
            at += 4 + n
    except struct.error:
        return {}
    return out


def ogg(data: bytes) -> Node | None:
    """Ogg: streams by number, with their sizes, lengths and comments."""
    streams: dict[int, dict] = {}
    total = 0
    for number, _, flags, granule, size, body in C.pages(data):
        if flags & 2 and number not in streams:
            streams[number] = {**_stream(body), "bytes": 0, "last": 0, "text": b"", "read": False, "has": False}
        if (s := streams.get(number)) is None:
            continue
        if s["last"] < granule < s["last"] + 10_000_000:
            s["last"] = granule
        s["bytes"] += size
        total += size
        if s.get("comments") and not s["read"]:
            s["has"] |= b"\x03vorbis" in body
            if s["has"]:
                s["text"] += body
                s["read"] = not flags & C.PAGE_SPAN_AFTER
    if not streams:
        return None
    root = Node("MediaProvider")
    root.add("FileSize", "Int64", len(data), BYTES)
    root.add("Overhead", "Int64", len(data) - total, BYTES)
    seen: dict[str, int] = {}
    for number, s in streams.items():
        node = root.child(s["kind"], number)
        index = seen[s["kind"]] = seen.get(s["kind"], -1) + 1
        if s["kind"] == "VideoStream":
            node.add("ContainerCodecCC", "String", s.get("cc"))
            node.add("PixelDimensions", "Dimensions", s["size"])
        if s["kind"] == "AudioStream":
            node.add("ChannelCount", "Int32", s["channels"])
        if s["kind"] in ("VideoStream", "AudioStream"):
            length = s["last"] / s["rate"] if s["rate"] else float("nan")
            node.add("StatedSampleRate", "Double", s["rate"], HERTZ)
            node.add("SampleCount", "Int64", s["last"])
            node.add("Duration", "TimeSpan", length, SECONDS)
            node.add("Bitrate", "Double", s["bytes"] * 8 / length if length else float("nan"), BITRATE)
        node.add("Index", "Int32", index)
        node.add("Id", "UInt64", number)
        node.add("Size", "Int64", s["bytes"], BYTES)
        node.add("ContainerCodecId", "String", s.get("codec"))
        said = comments(s["text"])
        for key in ("Title", "Language"):
            node.add(key, "String", ",".join(said[key.lower()]) if key.lower() in said else None)
        node.add("ContainerCodecCC", "String", s.get("cc"))
    all_ = list(streams.values())
    ext = "ogg" if all(s["kind"] == "AudioStream" for s in all_) else "ogv" if all(s.get("codec") for s in all_) else "ogm" if any(s.get("cc") for s in all_) else None
    root.add("SuggestedFileExtension", "ImmutableArray`1", [ext] if ext else None)
    return root


#: In the order of precedence; a media library's findings would come between these and the digests.
PROVIDERS: dict[str, Callable[[bytes], Node | None]] = {"MP4Provider": mp4, "MatroskaProvider": matroska, "OggProvider": ogg}


def register(name: str, provider: Callable[[bytes], Node | None]) -> None:
    PROVIDERS[name] = provider


ITEMS = "path string, provider string, provider_rank int, root_type string, node string, ord long, key string, type string, unit string, text string, parts array<string>"


def _flat(path: str, name: str, rank: int, node: Node, above: str, order: list[int]) -> Iterator[tuple]:
    own = f"{above}/{node.type}:{node.id}" if above or node.id else f"/{node.type}"
    root_type = own.split("/")[1].split(":")[0]
    yield path, name, rank, root_type, own, order[0], "", "", "", None, None
    order[0] += 1
    for key, kind, unit, value in node.items:
        parts = list(value) if isinstance(value, list) else None
        yield path, name, rank, root_type, own, order[0], key, kind, unit, None if parts is not None else values.TEXT[kind](value), parts
        order[0] += 1
    for child in node.nodes:
        yield from _flat(path, name, rank, child, own, order)


def rows_of(path: str, data: bytes, names: list[str] | None = None) -> list[tuple]:
    """Rows of ITEMS for one file's bytes."""
    chosen = [(n, i, make) for i, (n, make) in enumerate(PROVIDERS.items()) if names is None or n in names]
    return [r for name, rank, make in chosen if (node := make(data)) for r in _flat(path, name, rank, node, "", [0])]


def items(files: DataFrame, path: str = "path", content: str = "content", names: list[str] | None = None) -> DataFrame:
    """Rows of ITEMS for every file; each node also has a row without a key, so that empty nodes show."""
    small = files.select(F.col(path).cast("string").alias("path"), F.col(content).cast("binary").alias("content"))
    columns = [c.split()[0] for c in ITEMS.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for p, c in zip(batch["path"], batch["content"], strict=True):
                yield pd.DataFrame(rows_of(p, bytes(c or b""), names), columns=columns).astype({"provider_rank": "int32", "ord": "int64"})

    return small.mapInPandas(run, ITEMS)


def digest_items(long: DataFrame, rank: int = 5) -> DataFrame:
    """Items of digests in long form: (path, name, digest)."""
    return long.select("path", F.lit("HashProvider").alias("provider"), F.lit(rank).alias("provider_rank"), F.lit("HashProvider").alias("root_type"), F.lit("/HashProvider").alias("node"), F.monotonically_increasing_id().alias("ord"), F.col("name").alias("key"), F.lit("Binary").alias("type"), F.lit(NONE).alias("unit"), F.hex("digest").alias("text"), F.lit(None).cast("array<string>").alias("parts"))


# Identifiers of formats and the kind of stream they make.
_IDENTIFIERS = {
    "srt": "text/srt", "ssa": "text/ssa", "ass": "text/ass", "idx": "text/idx", "smi": "text/sami", "7z": "compression/7z", "zip": "compression/zip", "rar": "compression/rar", "lrc": "text/lyric", "tmp": "text/TMPlayer",
    "pjs": "text/PhoenixJapanimationSociety", "vtt": "text/vtt", "js": "text/JS", "rt": "text/RT", "smil": "SMIL", "tts": "text/TTS", "xss": "text/XombieSub", "zeg": "text/ZeroG", "sup": "text/SubtitleBitmapFile", "fsb": "text/FanSubber", "s2k": "text/Sasami2k",
}
_ARCHIVES, _MEDIA = ("7z", "zip", "rar"), ("smil",)


def format_items(detected: DataFrame, rank: int = 3) -> DataFrame:
    """Items of formats.detect(): (path, suggested_ext): the extension; for a sure format also its identifier, of archives at the
    root, of others in a stream of its own; an index file has as many streams as its idx_streams (subtitles.index_column), where
    that column is there, with their languages and numbers."""
    one = F.col("suggested_ext")
    name = F.coalesce(*[F.when(one == k, F.lit(v)) for k, v in _IDENTIFIERS.items()])
    stream = F.when(one.isin(*_MEDIA), "/MediaProvider/MediaStream:0").otherwise("/MediaProvider/SubtitleStream:0")
    none = F.lit(None).cast("string")
    row = lambda i, node, key, kind, text, parts: F.struct(F.lit(i).cast("long").alias("ord"), node.alias("node"), F.lit(key).alias("key"), F.lit(kind).alias("type"), text.alias("text"), parts.alias("parts"))
    root, empty = F.lit("/MediaProvider"), F.lit(None).cast("array<string>")
    first = row(0, root, "SuggestedFileExtension", "ImmutableArray`1", none, F.array(one))
    archive = F.when(one.isin(*_ARCHIVES), row(1, root, "FileTypeIdentifier", "String", name, empty))
    listed = (one == "idx") if "idx_streams" in detected.columns else F.lit(False)
    other = F.when(~one.isin(*_ARCHIVES) & name.isNotNull() & ~listed, row(1, stream, "ContainerCodecId", "String", name, empty))
    rows = F.array_compact(F.array(first, archive, other))
    if "idx_streams" in detected.columns:
        at = lambda x: F.concat(F.lit("/MediaProvider/SubtitleStream:"), x["ord"].cast("string"))
        several = lambda x: F.array(
            row(1, at(x), "ContainerCodecId", "String", name, empty).withField("ord", x["ord"] * 3 + 1),
            row(2, at(x), "Language", "String", x["language"], empty).withField("ord", x["ord"] * 3 + 2),
            row(3, at(x), "Index", "Int32", x["index"].cast("string"), empty).withField("ord", x["ord"] * 3 + 3),
        )
        rows = F.concat(rows, F.flatten(F.transform(F.when(listed, F.coalesce("idx_streams", F.array().cast(subtitles.STREAMS))).otherwise(F.array().cast(subtitles.STREAMS)), several)))
    rows = F.explode(rows).alias("r")
    return detected.filter(one.isNotNull()).select("path", rows).select("path", F.lit("FormatInfoProvider").alias("provider"), F.lit(rank).alias("provider_rank"), F.lit("MediaProvider").alias("root_type"), "r.node", "r.ord", "r.key", "r.type", F.lit(NONE).alias("unit"), "r.text", "r.parts")
