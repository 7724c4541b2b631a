import pytest

from tessellon.functions import values
from tessellon.operators import containers, providers, reports, stats
from tessellon.sources import samples as media


@pytest.fixture(scope="module")
def files(spark):
    rows = [("a.mkv", media.mkv()), ("b.ogg", media.ogg()), ("c.mp4", media.mp4()), ("d.bin", b"\x42" * 5000), ("e", b""), ("f.mkv", media.mkv()[:900])]
    return spark.createDataFrame([(p, len(c), bytearray(c)) for p, c in rows], "path string, length long, content binary")


@pytest.fixture(scope="module")
def xml(files):
    return {r.path: r.xml for r in reports.complete(providers.items(files), files).collect()}


def test_matroska(xml, files):
    s = xml["a.mkv"]
    for part in [
        '<ContainerVersion p="MatroskaProvider" t="String" u="Dimensionsless">DocType=matroska DocTypeVersion=4</ContainerVersion>',
        '<Duration p="MatroskaProvider" t="Double" u="s">2</Duration>',
        "<Item>mkv</Item>",
        '<PixelDimensions p="MatroskaProvider" t="Dimensions" u="Dimensionsless">640, 480</PixelDimensions>',
        '<DisplayDimensions p="MatroskaProvider" t="Dimensions" u="Dimensionsless">640, 360</DisplayDimensions>',
        '<StatedSampleRate p="MatroskaProvider" t="Double" u="s^-1">25</StatedSampleRate>',
        '<SampleCount p="MatroskaProvider" t="Int64" u="Dimensionsless">50</SampleCount>',
        '<Id p="MatroskaProvider" t="UInt64" u="Dimensionsless">1001</Id>',
        "<AudioStream>",
        '<ChannelCount p="MatroskaProvider" t="Int32" u="Dimensionsless">2</ChannelCount>',
        '<Title p="MatroskaProvider" t="String" u="Dimensionsless">Stereo</Title>',
        "<Item>Opening Languages(eng) Countries()</Item>",
        "Tags(TITLE=Synthetic)",
        '<Type p="MatroskaProvider" t="String" u="Dimensionsless">text/plain</Type>',
    ]:
        assert part in s, part
    dump = {r.path: r.xml for r in reports.of_contents("Matroska", files).collect()}
    for part in ["<EbmlHeader>", "<TrackNumber>2</TrackNumber>", "<CodecId>A_TEST</CodecId>", "<MuxingApp>synth-mux</MuxingApp>", f'<SegmentUId Size="16">{"AB" * 16}</SegmentUId>', "<FileDataSize>5</FileDataSize>"]:
        assert part in dump["a.mkv"], part
    assert dump["d.bin"] == "<File />" == dump["e"]


def test_ogg(xml):
    for part in [
        "<Item>ogg</Item>",
        '<ChannelCount p="OggProvider" t="Int32" u="Dimensionsless">2</ChannelCount>',
        '<StatedSampleRate p="OggProvider" t="Double" u="s^-1">48000</StatedSampleRate>',
        '<SampleCount p="OggProvider" t="Int64" u="Dimensionsless">48000</SampleCount>',
        '<Duration p="OggProvider" t="TimeSpan" u="s">00:00:01</Duration>',
        '<Title p="OggProvider" t="String" u="Dimensionsless">Synthetic Song</Title>',
        '<Language p="OggProvider" t="String" u="Dimensionsless">eng</Language>',
        '<ContainerCodecId p="OggProvider" t="String" u="Dimensionsless">Vorbis</ContainerCodecId>',
    ]:
        assert part in xml["b.ogg"], part


def test_mp4(xml):
    for part in [
        "MajorBrands=isom MinorVersion=512 CompatibleBrands=isom/iso2/avc1/mp41",
        '<Duration p="MP4Provider" t="Double" u="s">3.5</Duration>',
        "<Item>mp4</Item>",
        "<VideoStream>",
        '<PixelDimensions p="MP4Provider" t="Dimensions" u="Dimensionsless">320, 240</PixelDimensions>',
        '<ContainerCodecId p="MP4Provider" t="String" u="Dimensionsless">avc1</ContainerCodecId>',
        '<Language p="MP4Provider" t="String" u="Dimensionsless">eng</Language>',
        '<Duration p="MP4Provider" t="TimeSpan" u="s">00:00:03.5000000</Duration>',
    ]:
        assert part in xml["c.mp4"], part


def test_rows(files):
    s = {r.track: r for r in stats.track_stats(containers.block_rows(files.filter("path = 'a.mkv'")), ["track"]).collect()}
    assert (s[1].sample_count, s[1].track_size, s[1].min_sample_rate, s[1].max_sample_rate) == (50, 5000, 25.0, 25.0)
    assert containers.page_rows(files).filter("path = 'b.ogg'").count() == 12
    kinds = [r.type for r in containers.box_rows(files).filter("path = 'c.mp4'").orderBy("ord").collect()]
    assert kinds[:3] == ["ftyp", "moov", "mvhd"] and kinds[-1] == "mdat"
    names = {r.name for r in containers.element_rows(files).filter("path = 'a.mkv'").collect()}
    assert {"Segment", "Cluster", "SimpleBlock", "TagName"} <= names


def test_anything_cut_off_is_read_as_far_as_it_goes():
    for whole, read in ((media.mkv(), providers.matroska), (media.ogg(), providers.ogg), (media.mp4(), providers.mp4)):
        for n in range(0, len(whole), 37):
            read(whole[:n])
            reports.structure(whole[:n])


def test_xml_and_values(xml):
    assert xml["e"] == "<FileInfo>\n  <Path>e</Path>\n  <Size>0</Size>\n</FileInfo>"
    assert values.xml(("a b", {"k": '"<'}, [("x", {}, "1 & 2"), ("y", {}, "")])) == '<a_b k="&quot;&lt;">\n  <x>1 &amp; 2</x>\n  <y />\n</a_b>'
    assert [values.double(x) for x in (24.0, 1.5e-7, 2.5e20, 0.1)] == ["24", "1.5E-07", "2.5E+20", "0.1"]
    assert values.time_span(90000.0) == "1.01:00:00" and values.date_time(978307200.0) == "01/01/2001 00:00:00"


def _cluster(*blocks):
    return media.ebml(0x1F43B675, media.uint(0xE7, 100) + b"".join(media.ebml(0xA3, bytes([0x80 | t]) + at.to_bytes(2, "big") + b"\x80" + b"x" * 9) for t, at in blocks))


_HEAD = media.ebml(0x1A45DFA3, media.ebml(0x4282, b"matroska"))
_INFO = media.ebml(0x1549A966, media.uint(0x2AD7B1, 1000))
_TRACKS = media.ebml(0x1654AE6B, media.ebml(0xAE, media.uint(0xD7, 1) + media.uint(0x73C5, 9) + media.uint(0x83, 1) + media.ebml(0x23314F, b"\x40\x00\x00\x00")))
_VOID = media.ebml(0xEC, bytes(5000))


def test_matroska_size_rules():
    whole = _HEAD + media.ebml(0x18538067, _INFO + _TRACKS + _VOID)
    assert providers.matroska(whole) is not None
    assert providers.matroska(whole + bytes(len(whole) // 50)) is None  # a tail of two per cent
    large = _HEAD + media.ebml(0x18538067, _INFO + _TRACKS + _VOID + media.ebml(0xEC, bytes(200 << 20)))
    assert providers.matroska(large + bytes(1 << 19)) is not None and providers.matroska(large + bytes((1 << 20) + 99)) is None
    assert providers.matroska(_HEAD + media.ebml(0x18538067, _INFO + _VOID)) is None
    assert providers.matroska(_HEAD + b"\x18\x53\x80\x67\x01\xff\xff\xff\xff\xff\xff\xff" + _INFO + _TRACKS) is not None


def test_matroska_without_a_segment_element():
    node = providers.matroska(_HEAD + _INFO + _TRACKS + _cluster((1, 0), (1, 40)))
    assert node is not None and [n.type for n in node.nodes] == ["VideoStream"]
    far = b"".join(media.ebml(0x1F43B675, bytes(3 << 20)) for _ in range(3))
    assert providers.matroska(_HEAD + far + _INFO + _TRACKS) is None


def test_blocks_before_their_track_and_scale():
    data = _HEAD + media.ebml(0x18538067, _cluster((1, 5)) + _INFO + _cluster((1, 7)) + _TRACKS + _cluster((1, 9), (2, 3)) + _VOID)
    assert [(t, at) for t, at, *_ in containers.blocks(data)] == [(1, 0), (1, 107_000), (1, 218_000), (2, 103_000)]
    assert dict((k, v) for k, _, _, v in providers.matroska(data).nodes[0].items)["Size"] == 27
