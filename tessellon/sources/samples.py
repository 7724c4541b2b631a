"""Small synthetic media files, for trying the parsers where no media are at hand."""

import struct


def ebml(id_, payload):
    n = len(payload)
    size = bytes([0x80 | n]) if n < 0x7F else struct.pack(">H", 0x4000 | n) if n < 0x3FFF else struct.pack(">I", 0x10000000 | n)
    return id_.to_bytes((id_.bit_length() + 7) // 8, "big") + size + payload


def uint(id_, v):
    return ebml(id_, v.to_bytes(max(1, (v.bit_length() + 7) // 8), "big"))


def mkv():
    text = lambda i, s: ebml(i, s.encode())
    real = lambda i, v: ebml(i, struct.pack(">d", v))
    header = ebml(0x1A45DFA3, uint(0x4286, 1) + uint(0x42F7, 1) + text(0x4282, "matroska") + uint(0x4287, 4) + uint(0x4285, 2))
    info = ebml(0x1549A966, uint(0x2AD7B1, 1_000_000) + real(0x4489, 2000.0) + text(0x4D80, "synth-mux") + text(0x5741, "synth-write") + ebml(0x73A4, b"\xab" * 16))
    video = ebml(0xE0, uint(0xB0, 640) + uint(0xBA, 480) + uint(0x54B0, 640) + uint(0x54BA, 360))
    one = ebml(0xAE, uint(0xD7, 1) + uint(0x73C5, 1001) + uint(0x83, 1) + text(0x86, "V_TEST") + text(0x22B59C, "eng") + uint(0x23E383, 40_000_000) + video)
    audio = ebml(0xE1, real(0xB5, 48000.0) + uint(0x9F, 2) + uint(0x6264, 16))
    two = ebml(0xAE, uint(0xD7, 2) + uint(0x73C5, 1002) + uint(0x83, 2) + text(0x86, "A_TEST") + text(0x536E, "Stereo") + audio)
    blocks = b"".join(ebml(0xA3, b"\x81" + struct.pack(">HB", 40 * i, 0x80) + bytes([i]) * 100) + ebml(0xA3, b"\x82" + struct.pack(">HB", 40 * i, 0) + b"\7" * 20) for i in range(50))
    title = ebml(0x80, text(0x85, "Opening") + text(0x437C, "eng"))
    chapters = ebml(0x1043A770, ebml(0x45B9, uint(0x45BC, 77) + ebml(0xB6, uint(0x73C4, 1) + uint(0x91, 0) + uint(0x92, 10**9) + title)))
    tags = ebml(0x1254C367, ebml(0x7373, ebml(0x63C0, uint(0x63C5, 1001)) + ebml(0x67C8, text(0x45A3, "TITLE") + text(0x4487, "Synthetic"))))
    files = ebml(0x1941A469, ebml(0x61A7, text(0x466E, "cover.txt") + text(0x4660, "text/plain") + uint(0x46AE, 5) + ebml(0x465C, b"hello")))
    return header + ebml(0x18538067, info + ebml(0x1654AE6B, one + two) + chapters + tags + files + ebml(0x1F43B675, uint(0xE7, 0) + blocks))


def page(stream, number, flags, granule, packet):
    table = bytes([255] * (len(packet) // 255) + [len(packet) % 255])
    return b"OggS" + struct.pack("<BBqIIIB", 0, flags, granule, stream, number, 0, len(table)) + table + packet


def ogg():
    ident = b"\x01vorbis" + struct.pack("<IBI", 0, 2, 48000) + bytes(14)
    said = [b"TITLE=Synthetic Song", b"LANGUAGE=eng"]
    notes = b"\x03vorbis" + struct.pack("<I", 9) + b"synthetic" + struct.pack("<I", 2) + b"".join(struct.pack("<I", len(c)) + c for c in said)
    return page(7, 0, 2, 0, ident) + page(7, 1, 0, 0, notes) + b"".join(page(7, 2 + i, 0, (i + 1) * 4800, b"\xaa" * 300) for i in range(10))


def box(kind, payload):
    return struct.pack(">I", len(payload) + 8) + kind + payload


def mp4():
    put = lambda n, *at: b"".join(dict(at).get(i, b"\0") for i in range(n)) if not at else _put(n, at)
    mvhd = put(100, (12, struct.pack(">II", 1000, 3500)))
    tkhd = put(84, (12, struct.pack(">I", 1)), (76, struct.pack(">II", 320 << 16, 240 << 16)))
    language = (5 << 10) | (14 << 5) | 7
    mdhd = put(24, (12, struct.pack(">II", 90000, 315000)), (20, struct.pack(">H", language)))
    hdlr = put(24, (8, b"vide"))
    entry = put(78, (24, struct.pack(">HH", 320, 240)), (40, b"\0\1"))
    stsd = struct.pack(">II", 0, 1) + box(b"avc1", entry)
    mdia = box(b"mdia", box(b"mdhd", mdhd) + box(b"hdlr", hdlr) + box(b"minf", box(b"stbl", box(b"stsd", stsd))))
    moov = box(b"moov", box(b"mvhd", mvhd) + box(b"trak", box(b"tkhd", tkhd) + mdia))
    return box(b"ftyp", b"isom\0\0\x02\0isomiso2avc1mp41") + moov + box(b"mdat", bytes(5000))


def _put(n, at):
    out = bytearray(n)
    for i, b in at:
        out[i : i + len(b)] = b
    return bytes(out)


def mkv_of(number, title, width, height, blocks):
    """A Matroska file of one video track; blocks: (milliseconds, bytes), in clusters of a second."""
    text = lambda i, s: ebml(i, s.encode())
    header = ebml(0x1A45DFA3, text(0x4282, "matroska") + uint(0x4287, 4))
    info = ebml(0x1549A966, uint(0x2AD7B1, 1_000_000) + ebml(0x4489, struct.pack(">d", 500.0 * number)) + text(0x5741, f"writer {number}"))
    video = ebml(0xE0, uint(0xB0, width) + uint(0xBA, height))
    track = ebml(0xAE, uint(0xD7, 1) + uint(0x73C5, 100 + number) + uint(0x83, 1) + text(0x536E, title) + uint(0x23E383, 1_000_000 * (number + 1)) + video)
    clusters = b""
    for second in sorted({at // 1000 for at, _ in blocks}):
        own = b"".join(ebml(0xA3, b"\x81" + struct.pack(">HB", at % 1000, 0x80) + bytes(n)) for at, n in blocks if at // 1000 == second)
        clusters += ebml(0x1F43B675, uint(0xE7, 1000 * second) + own)
    return header + ebml(0x18538067, info + ebml(0x1654AE6B, track) + clusters + ebml(0xEC, bytes(4000)))


def mp4_of(number, width, height, scale, length):
    """An MP4 file of one video track with the number as its id."""
    mvhd = _put(100, ((12, struct.pack(">II", scale, length)),))
    tkhd = _put(84, ((12, struct.pack(">I", number)), (76, struct.pack(">II", width << 16, height << 16))))
    mdhd = _put(24, ((12, struct.pack(">II", scale, 2 * length)), (20, struct.pack(">H", (5 << 10) | (14 << 5) | 7))))
    stsd = struct.pack(">II", 0, 1) + box(b"avc1", _put(78, ((24, struct.pack(">HH", width, height)),)))
    mdia = box(b"mdia", box(b"mdhd", mdhd) + box(b"hdlr", _put(24, ((8, b"vide"),))) + box(b"minf", box(b"stbl", box(b"stsd", stsd))))
    return box(b"ftyp", b"isom\0\0\x02\0isom") + box(b"moov", box(b"mvhd", mvhd) + box(b"trak", box(b"tkhd", tkhd) + mdia))


def ogg_of(number, title, rate, packets):
    """An Ogg file of one Vorbis stream; packets: bytes, a tenth of a second each."""
    ident = b"\x01vorbis" + struct.pack("<IBI", 0, 2, rate) + bytes(14)
    said = [f"TITLE={title}".encode()]
    notes = b"\x03vorbis" + struct.pack("<I", 4) + b"made" + struct.pack("<I", 1) + b"".join(struct.pack("<I", len(c)) + c for c in said)
    return page(number, 0, 2, 0, ident) + page(number, 1, 0, 0, notes) + b"".join(page(number, 2 + i, 0, (i + 1) * rate // 10, bytes(n)) for i, n in enumerate(packets))
