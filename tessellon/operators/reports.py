"""Reports as XML texts: everything found about a file, and the structure of Matroska files."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tessellon.functions import values
from tessellon.operators import containers as C
from tessellon.operators import merge


def _tree(path: str, size: int, rows: list) -> str:
    """rows: (rank, ord, root, node, key, type, unit, provider, text, parts), merged already."""
    top = ("FileInfo", {}, [("Path", {}, path), ("Size", {}, str(size))])
    made: dict[str, tuple] = {}
    for _, _, _, node, key, kind, unit, provider, text, parts in sorted(rows, key=lambda r: r[:2]):
        up, _, name = node.rpartition("/")
        if node not in made:
            element = (name.split(":")[0], {}, ([], []))
            made[node] = element
            (made[up][2][1] if up else top[2]).append(element)
        if key:
            inside = [("Item", {}, p) for p in parts] if parts is not None else (text or "")
            made[node][2][0].append((key, {"p": provider, "t": kind, "u": unit}, inside))

    def flat(e: tuple) -> tuple:
        return (e[0], e[1], [*e[2][0], *map(flat, e[2][1])]) if isinstance(e[2], tuple) else e

    return values.xml((top[0], top[1], [flat(e) for e in top[2]]))


def complete(items: DataFrame, files: DataFrame) -> DataFrame:
    """(path, xml) of every file: items of all providers, the first of equal keys and types winning. files: path, length."""
    one = merge.first_wins(items, ["path", "node"])
    packed = F.collect_list(F.struct("provider_rank", "ord", "root_type", "node", "key", "type", "unit", "provider", "text", "parts")).alias("rows")
    both = files.select("path", "length").join(one.groupBy("path").agg(packed), "path", "left")

    @F.pandas_udf(StringType())
    def write(path: pd.Series, length: pd.Series, rows: pd.Series) -> pd.Series:
        out = []
        for p, n, r in zip(path, length, rows, strict=True):
            r = [] if r is None else [tuple(x.values()) if isinstance(x, dict) else tuple(x) for x in r]
            out.append(_tree(p, n, [(*x[:9], None if x[9] is None else list(x[9])) for x in r]))
        return pd.Series(out)

    return both.select("path", write("path", "length", "rows").alias("xml"))


_FLAGS = [("Enabled", "FlagEnabled", 1), ("Default", "FlagDefault", 1), ("Forced", "FlagForced", 0), ("Lacing", "FlagLacing", 1)]


def _text(t: C.Tree, names: list[tuple[str, str, object]]) -> list[tuple]:
    """Elements in the order of names: (name, source, default)."""
    out = []
    for name, source, default in names:
        v = t.get(source, default)
        if isinstance(v, bytes):
            out.append((name, {"Size": str(len(v))}, v[:1024].hex().upper() + "..." * (len(v) > 1024)))
        else:
            out.append((name, {}, "" if v is None else values.double(v) if isinstance(v, float) else str(v)))
    return out


def _same(names: str) -> list[tuple[str, str, object]]:
    return [(n, n, None) for n in names.split()]


def _flags(t: C.Tree, flags: list[tuple[str, str, int]]) -> str:
    return ", ".join(n for n, source, default in flags if t.get(source, default) == 1) or "None"


def _atom(a: C.Tree) -> tuple:
    track = a.one("ChapterTrack")
    shown = [("ChapterDisplay", {}, [*[("ChapterLanguage", {}, v) for v in d.values("ChapterLanguage")], *[("ChapterCountry", {}, v) for v in d.values("ChapterCountry")], *_text(d, _same("ChapterString"))]) for d in a.all("ChapterDisplay")]
    flags = _flags(a, [("Hidden", "ChapterFlagHidden", 0), ("Enabled", "ChapterFlagEnabled", 1)])
    inside = [("ChapterTrack", {}, [("ChapterTrackNumber", {}, str(v)) for v in (track.values("ChapterTrackNumber") if track else [])]), *map(_atom, a.all("ChapterAtom")), *shown]
    inside += _text(a, _same("ChapterUId ChapterTimeStart ChapterTimeEnd")) + [("ChapterFlags", {}, flags)] + _text(a, _same("ChapterSegmentUId ChapterSegmentEditionUId"))
    return ("ChapterAtom", {}, inside)


def _tag(t: C.Tree) -> tuple:
    return ("SimpleTag", {}, [*map(_tag, t.all("SimpleTag")), *_text(t, _same("TagName TagLanguage TagDefault TagString TagBinary"))])


def structure(data: bytes) -> str:
    """The structure of a Matroska file; an empty File for anything else."""
    if (found := C.matroska_file(data)) is None:
        return values.xml(("File", {}, ""))
    header, segment = found
    defaults = dict(EbmlVersion=1, EbmlReadVersion=1, EbmlMaxIdLength=4, EbmlMaxSizeLength=8, DocTypeReadVersion=1, DocTypeVersion=1, DocType="matroska")
    head = ("EbmlHeader", {}, _text(header, [(n, n, d) for n, d in defaults.items()]))
    info = ("SegmentInfo", {}, _text(segment.all("SegmentInfo")[-1], _same("SegmentUId PreviousUId NextUId SegmentFilename PreviousFilename NextFilename Duration Title MuxingApp WritingApp")))
    tracks = []
    for t in segment.one("Tracks").all("Track"):
        own = _text(t, _same("TrackNumber TrackUId")) + [("TrackOverlay", {}, str(v)) for v in t.values("TrackOverlay")]
        own += _text(t, _same("TrackType")) + [("TrackFlags", {}, _flags(t, _FLAGS))]
        own += _text(t, [("MinCache", "MinCache", 0), *_same("MaxCache"), ("MaxBlockAdditionID", "MaxBlockAdditionID", 0), *_same("DefaultDuration DefaultDecodedFieldDuration TrackTimecodeScale Name"), ("Language", "Language", "eng"), *_same("CodecId CodecPrivate CodecName AttachmentLink")])
        v, a, e = t.one("Video"), t.one("Audio"), t.one("ContentEncodings")
        if v:
            w, h = v.get("PixelWidth", 0), v.get("PixelHeight", 0)
            own.append(("Video", {}, _text(v, [*_same("FrameRate ColorSpace"), ("PixelWidth", "PixelWidth", 0), ("PixelHeight", "PixelHeight", 0), ("AspectRatioType", "AspectRatioType", 0), ("StereoMode", "StereoMode", 0), ("AlphaMode", "AlphaMode", 0), *_same("OldStereoMode"), ("Interlaced", "Interlaced", 0), *[(f"PixelCrop{s}", f"PixelCrop{s}", 0) for s in ("Bottom", "Top", "Left", "Right")], ("DisplayWidth", "DisplayWidth", w), ("DisplayHeight", "DisplayHeight", h), ("DisplayUnit", "DisplayUnit", 0)])))
        else:
            own.append(("Video", {}, ""))
        rate = a.get("SamplingFrequency", 8000.0) if a else None
        own.append(("Audio", {}, _text(a, [("SamplingFrequency", "SamplingFrequency", 8000.0), ("OutputSamplingFrequency", "OutputSamplingFrequency", rate), ("ChannelCount", "ChannelCount", 1), *_same("BitDepth")]) if a else ""))
        own.append(("ContentEncodings", {}, [("ContentEncoding", {}, _text(x, [("ContentEncodingOrder", "ContentEncodingOrder", 0), ("ContentEncodingScope", "ContentEncodingScope", 1), ("ContentEncodingType", "ContentEncodingType", 0)])) for x in e.all("ContentEncoding")] if e else ""))
        tracks.append(("Track", {}, own))
    chapters = []
    for e in segment.all("Chapters")[-1].all("EditionEntry") if segment.all("Chapters") else []:
        flags = _flags(e, [("Hidden", "EditionFlagHidden", 0), ("Default", "EditionFlagDefault", 0), ("Ordered", "EditionFlagOrdered", 0)])
        chapters.append(("EditionEntry", {}, [*_text(e, _same("EditionUId")), ("EditionFlags", {}, flags), *map(_atom, e.all("ChapterAtom"))]))
    tags = [("Tags", {}, [("Tag", {}, [("Targets", {}, _text(g, _same("TargetTypeValue TargetType TagTrackUId TagEditionUId TagChapterUId TagAttachmentUId")) if (g := t.one("Targets")) else ""), *map(_tag, t.all("SimpleTag"))]) for t in s.all("Tag")]) for s in segment.all("Tags")]
    files = []
    for f in segment.all("Attachments")[-1].all("AttachedFile") if segment.all("Attachments") else []:
        size = next((x.element.end - x.element.start for x in f.all("FileData")), 0)
        files.append(("AttachedFile", {}, [*_text(f, [*_same("FileDescription FileName FileMimeType"), ("FileUId", "FileUId", 0)]), ("FileDataSize", {}, str(size))]))
    inside = [info, ("Tracks", {}, tracks), ("Chapters", {}, chapters), *tags, ("Attachments", {}, files)]
    return values.xml(("File", {}, [head, ("Segment", {}, inside)]))


def column(make: Callable[[bytes], str]) -> Callable[[Column], Column]:
    """A report made from bytes alone, as a column."""

    @F.pandas_udf(StringType())
    def run(content: pd.Series) -> pd.Series:
        return pd.Series([make(bytes(c or b"")) for c in content])

    return run


def of_contents(name: str, files: DataFrame) -> DataFrame:
    """(path, xml) of a report from bytes. files: path, content."""
    return files.select("path", column(STRUCTURES[name])(F.col("content")).alias("xml"))


def error_report(kind: str, thrown_on: str, message: str, data: dict[str, tuple[str, bool]], session: str, personal: bool = False, cause: str | None = None) -> str:
    """An error as XML. data: name to (value, whether it is personal); personal values are hashed with the session's salt."""
    shown = [(k, {}, v if personal or not own else f"Hidden({hashlib.sha512((session + v).encode()).hexdigest().upper()})") for k, (v, own) in data.items()]
    return values.xml((kind, {"thrownOn": thrown_on}, [("Message", {}, message), ("Data", {}, shown), ("Cause", {}, cause or "")]))


#: Names of the report of all items.
COMPLETE = ["Complete"]
#: Reports from bytes alone, by name.
STRUCTURES: dict[str, Callable[[bytes], str]] = {"Matroska": structure, "MediaInfoXml": lambda _: values.xml(("File", {}, ""))}
#: Reports of one's own, by name: from (items, files) to (path, xml).
OWN: dict[str, Callable[[DataFrame, DataFrame], DataFrame]] = {}


def register(name: str, report: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
    """Add a report of one's own: a function of items and files (path, length) that returns (path, xml)."""
    OWN[name] = report
