"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from tessellon.functions import bases, kernels, render
from tessellon.operators import formats
from tessellon.plans import queries

_KEY = "o_orderkey::VARCHAR"


def _crc(text: str, polynomial: int) -> str:
    """A 32-bit check of a string: a fold over its bytes with the table of the polynomial."""
    t = "[" + ",".join(map(str, kernels.crc_table(polynomial).tolist())) + "]::BIGINT[]"
    seq = f"list_transform(range(1, octet_length(encode({text})) + 1), lambda i: ('0x' || substr(hex(encode({text})), (2 * i - 1)::INT, 2))::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {seq}), lambda a, b: xor(a >> 8, ({t})[(xor(a & 255, b) + 1)::INT])), 4294967295)"


def _digits(n: str, base: str) -> str:
    alphabet = bases.ALPHABETS[base]
    r, w = len(alphabet), bases.width(4, len(alphabet))
    powers = "[" + ",".join(str(r**i) for i in range(w - 1, -1, -1)) + "]::HUGEINT[]"
    return f"array_to_string(list_transform({powers}, lambda p: substr('{alphabet}', ((({n})::HUGEINT // p) % {r})::INT + 1, 1)), '')"


_ENDS = "(ends_with(lower(url), '{0}'))"
_EXPANDED = r"""concat('/library/', regexp_replace(regexp_extract(url, '[^/]*$'), '\.[^.]*$', ''), '/[', md5(url), ']', regexp_extract(regexp_extract(url, '[^/]*$'), '\.[^.]*$'))"""
_S = "(SELECT user_id AS track, epoch_us(ts) * 1000 AS tc, length(props)::BIGINT AS size, event_id AS ord FROM events)"
_RATES = f"""r0 AS (SELECT *, row_number() OVER w AS n, tc - lag(tc) OVER w AS gap FROM {_S} WINDOW w AS (PARTITION BY track ORDER BY tc, ord)),
r1 AS (SELECT *, CASE WHEN n > 1 THEN CASE WHEN gap = 0 THEN 'Infinity'::DOUBLE ELSE 1e9::DOUBLE * 1 / gap END END AS rate FROM r0),
r2 AS (SELECT *, CASE WHEN n = 2 THEN rate ELSE lag(rate) OVER w END AS p1, CASE WHEN n <= 3 THEN 0 ELSE lag(rate, 2) OVER w END AS p2 FROM r1 WINDOW w AS (PARTITION BY track ORDER BY tc, ord)),
bins AS (SELECT track, rate, count(*) AS c, min(n) AS f FROM r2 WHERE rate IS NOT NULL AND NOT isinf(rate) GROUP BY ALL)"""
_TS = "(((event_id * 7919 % 200000) - 1000) * 4 + event_id % 4)"
_Q = f"abs({_TS})"
_FLAGS = "[" + ", ".join(f"CASE WHEN b & {1 << i} <> 0 THEN '{n}' END" for i, n in render.STEREO_MODES.items() if i < 30) + "]"


def _list(texts: list[str]) -> str:
    quoted = [t.replace("'", "''").replace("\n", "' || chr(10) || '") for t in texts]
    return "[" + ", ".join(f"'{t}'" for t in quoted) + "]"


def _made(pairs: list[tuple[str, str, str]]) -> str:
    """(path, node, key, text) of media files made from nations: pairs of node, key and text."""
    rows = ", ".join(f"{{'node': {node}, 'key': '{key}', 'text': {text}}}" for node, key, text in pairs)
    return f"SELECT path, r.node AS node, r.key AS key, r.text AS text FROM (SELECT n_name AS path, unnest([{rows}]) AS r FROM (SELECT n_name, n_nationkey AS k FROM nation))"


#: What is in a file of samples.mkv_of(), by section: names alone are empty elements; @ stands for values of the file.
_STRUCTURE = {
    "EbmlHeader": "EbmlVersion=1 EbmlReadVersion=1 EbmlMaxIdLength=4 EbmlMaxSizeLength=8 DocTypeReadVersion=1 DocTypeVersion=4 DocType=matroska",
    "SegmentInfo": "SegmentUId PreviousUId NextUId SegmentFilename PreviousFilename NextFilename Duration=@length Title MuxingApp WritingApp=@writer",
    "Track": "TrackNumber=1 TrackUId=@uid TrackType=1 TrackFlags=@flags MinCache=0 MaxCache MaxBlockAdditionID=0 DefaultDuration=@frame DefaultDecodedFieldDuration TrackTimecodeScale Name=@name Language=eng CodecId CodecPrivate CodecName AttachmentLink",
    "Video": "FrameRate ColorSpace PixelWidth=@width PixelHeight=480 AspectRatioType=0 StereoMode=0 AlphaMode=0 OldStereoMode Interlaced=0 PixelCropBottom=0 PixelCropTop=0 PixelCropLeft=0 PixelCropRight=0 DisplayWidth=@width DisplayHeight=480 DisplayUnit=0",
}


def _structure() -> str:
    def lines(section: str, depth: int, *inside: str) -> list[str]:
        pad = "  " * depth
        own = [f"{pad}  <{n}>{v}</{n}>" if v else f"{pad}  <{n} />" for n, _, v in (x.partition("=") for x in _STRUCTURE.get(section, "").split())]
        return [f"{pad}<{section}>", *own, *inside, f"{pad}</{section}>"]

    track = lines("Track", 3, *lines("Video", 4), "        <Audio />", "        <ContentEncodings />")
    segment = lines("Segment", 1, *lines("SegmentInfo", 2), *lines("Tracks", 2, *track), "    <Chapters />", "    <Attachments />")
    out = _list(["\n".join(lines("File", 0, *lines("EbmlHeader", 1), *segment))]) + "[1]"
    for mark, value in (("length", _number("(500.0::DOUBLE * k)")), ("writer", "'writer ' || k"), ("uid", "(100 + k)::VARCHAR"), ("flags", "'Enabled, Default, Lacing'"), ("frame", "(1000000 * (k + 1))::VARCHAR"), ("name", "n_name"), ("width", "(640 + k)::VARCHAR")):
        out = f"replace({out}, '@{mark}', {value})"
    return f"SELECT n_name AS path, CASE WHEN k % 5 = 4 THEN '<File />' ELSE {out} END AS xml FROM (SELECT n_name, n_nationkey AS k FROM nation)"


def _span(ms: str) -> str:
    return f"concat(printf('%02d:%02d:%02d', ({ms}) // 3600000, ({ms}) // 60000 % 60, ({ms}) // 1000 % 60), CASE WHEN ({ms}) % 1000 = 0 THEN '' ELSE printf('.%03d0000', ({ms}) % 1000) END)"


_TOP, _VIDEO, _AUDIO = "'/MediaProvider'", "'/MediaProvider/VideoStream:' || {0}", "'/MediaProvider/AudioStream:' || {0}"


def _number(x: str) -> str:
    return f"CASE WHEN {x} = floor({x}) AND abs({x}) < 1e15 THEN {x}::BIGINT::VARCHAR ELSE upper({x}::VARCHAR) END"


def _item(provider: str, name: str, kind: str, text: str) -> str:
    return f"""'      <{name} p="{provider}" t="{kind}" u="Dimensionsless">', {text}, '</{name}>', chr(10)"""


def _items(table: str, p: str, rank: int) -> str:
    key = f"{p}_{table[:4]}key"
    pairs = [("name", f"{p}_name"), ("cents", f"round({p}_acctbal * 100)::BIGINT::VARCHAR"), (f"{table}_key", f"{key}::VARCHAR")]
    return " UNION ALL ".join(f"SELECT {p}_nationkey AS nation, {key} AS ord, '{k}' AS key, {v} AS value, '{table}' AS provider, {rank} AS rank FROM {table}" for k, v in pairs)


_LINES = "list_filter(string_split_regex({0}, '[\\r\\n]'), lambda x: x <> '')"
_RE = {k: getattr(formats, k).removeprefix("(?U)") for k in ("SRT", "LRC", "TMP", "PJS", "JS", "TTS", "MICRODVD", "FANSUBBER")}


def _detect(table: str, key: str, text: str) -> str:
    """All rules about the kind of a text, written anew for this dialect."""
    hits = lambda of, how: f"len(list_filter({of}, lambda x: {how}))"
    match = lambda name: f"regexp_matches(x, '{_RE[name]}')"
    ratio = lambda n, of, least: f"({n} > 0 AND {n} >= {least}::DOUBLE * ({of}))"
    starts = lambda *ms: "(" + " OR ".join(f"starts_with(t, {m})" for m in ms) + ")"
    zip_, short = "'PK' || chr(3) || chr(4)", ["'PK00PK'", "'Rar!'", "'fLaC'", "'RIFF'", "'WEBVTT'", "'FanSubber v'", "'// translated by Sami2Sasami'", "'.ra'", "'7z'"]
    undecided = "t = '' OR " + " OR ".join(f"(octet_length(encode(t)) < length({m}) AND starts_with({m}, t))" for m in [*short, zip_]) + " OR t IN ('.ra', '7z')"
    own = "list_filter(list_transform(ls, lambda x: trim(x)), lambda x: x <> '' AND NOT starts_with(x, '#'))"
    prose = r"length(regexp_replace(x, '[^\pL\pM\s[:punct:]]', '', 'g')) > length(x) * 0.8"
    zero = lambda fields: "{" + ", ".join(f"'{k}': {v}" for k, v in fields.items()) + "}"
    pjs = f"""list_reduce(list_prepend({zero(dict(buf="''", i=0, hits=0, l="''"))}, list_transform(ls, lambda x: {zero(dict(buf="''", i=0, hits=0, l="x"))})),
        lambda a, x: CASE WHEN NOT contains(x.l, ',"') OR ends_with(x.l, '"') THEN {zero(dict(buf="''", i="a.i + 1", hits=f"a.hits + regexp_matches(a.buf || x.l, '{_RE['PJS']}')::INT", l="''"))} ELSE {zero(dict(buf="a.buf || x.l", i="a.i", hits="a.hits", l="''"))} END)"""
    rows = "list_filter(ls, lambda x: NOT starts_with(x, '#'))"
    js = f"""list_reduce(list_prepend({zero(dict(more="false", i=0, hits=0, l="''"))}, list_transform({rows}, lambda x: {zero(dict(more="false", i=0, hits=0, l="x"))})),
        lambda a, x: {zero(dict(more=f"((regexp_matches(x.l, '{_RE['JS']}') OR a.more) AND ends_with(x.l, '{chr(92)}'))", i="a.i + 1", hits=f"a.hits + (regexp_matches(x.l, '{_RE['JS']}') OR a.more)::INT", l="''"))})"""
    sections = " + ".join(f"contains(up, '{x}')::INT" for x in formats.SECTIONS)
    tags = "list_filter(low, lambda x: starts_with(x, '<'))"
    first_of = lambda of, how: f"coalesce(list_min(list_filter(range(1, len({of}) + 1), lambda i: {how})), 0)"
    score = "10 * len(list_filter(string_split(lower(t), chr(10)), lambda x: starts_with(x, 'region') OR starts_with(x, 'style') OR starts_with(x, 'note'))) + len(list_filter(string_split(t, chr(10)), lambda x: starts_with(x, '-->')))"
    rules = {
        "srt": f"srt_at > 0 AND (vtt_at = 0 OR vtt_at > srt_at)", "ssa": "place IS NOT NULL AND place + 1 <= octet_length(encode(t))", "idx": "contains(coalesce(ls[1], ''), 'VobSub index file, v')", "smi": "contains(substr(st, 1, 10), '<sami>')",
        "7z": "false", "zip": starts(zip_, "'PK00PK'"), "rar": starts("'Rar!'"), "ra": "false", "flac": starts("'fLaC'"), "lrc": ratio(hits("ls", match("LRC")), "len(ls)", 0.8), "avi": starts("'RIFF'") + " AND substr(t, 9, 8) = 'AVI LIST'",
        "sub": f"({sections}) >= 5 OR (len(few) > 4 AND {hits('few', match('MICRODVD'))} > 0.8 * len(few))", "tmp": ratio(hits("ls", match("TMP")), "len(ls)", 0.8), "pjs": ratio("p.hits", "p.i", 0.8), "vtt": starts("'WEBVTT'") + f" AND {score} > 10",
        "js": f"j.hits > 0 AND (j.hits / j.i > 0.8 OR (j.hits / j.i > 0.5 AND {hits('low', "contains(x, 'jaco')")} > 0))", "rt": f"len({tags}) >= 10 AND " + ratio(hits(tags, "starts_with(x, '<window') OR starts_with(x, '<time begin')"), f"len({tags})", 0.6), "smil": hits("low", "starts_with(trim(x), '<smil>')") + " > 0",
        "tts": ratio(hits(own, match("TTS")), f"{hits(own, match('TTS'))} + {hits(own, f'NOT {match("TTS")} AND NOT ({prose})')}", 0.8), "xss": "contains(st, 'script=xombiesub')", "zeg": "contains(st, '% zerog')", "sup": "starts_with(t, 'PG') AND substr(t, 11, 2) = chr(22) || chr(0)",
        "fsb": starts("'FanSubber v'") + f" AND regexp_matches(coalesce(ls[1], ''), '{_RE['FANSUBBER']}')", "s2k": starts("'// translated by Sami2Sasami'"),
    }
    found = "list_filter([" + ", ".join(f"CASE WHEN {rules[k]} THEN " + ("CASE WHEN substr(st, place::INT, 1) = '+' THEN 'ass' ELSE 'ssa' END" if k == "ssa" else f"'{k}'") + " END" for k in formats.KINDS) + "], lambda x: x IS NOT NULL)"
    return f"""WITH a AS (SELECT {key}, {text} AS t, lower(substr({text}, 1, 2048)) AS st, upper(substr({text}, 1, 1024)) AS up, {_LINES.format(text)} AS every FROM {table}),
    b AS (SELECT *, coalesce(list_slice(every, 1, list_min(list_filter(range(1, len(every) + 1), lambda i: length(every[i]) > 1024)) - 1), every) AS ls, strpos(st, ' styles]') AS s_at, strpos(st, 'scripttype:') AS k_at FROM a),
    c AS (SELECT *, list_transform(ls, lambda x: lower(x)) AS low, list_slice(list_filter(list_transform(ls, lambda x: trim(x)), lambda x: x <> ''), 1, 21) AS few, {pjs} AS p, {js} AS j,
      substr(st, greatest(s_at - 4, 1), 10) AS win, substr(st, greatest(k_at, 1), 20) AS named FROM b),
    d AS (SELECT *, {first_of("ls", f"regexp_matches(ls[i], '{_RE['SRT']}')")} AS srt_at, {first_of("low", "contains(low[i], 'webvtt')")} AS vtt_at,
      coalesce(CASE WHEN s_at > 0 AND strpos(win, 'v4') > 0 THEN greatest(s_at - 4, 1) + strpos(win, 'v4') + 1 END, CASE WHEN s_at > 0 AND strpos(win, 'v3') > 0 THEN greatest(s_at - 4, 1) + strpos(win, 'v3') + 1 END,
        CASE WHEN k_at > 0 AND strpos(named, 'v4.00') > 0 THEN k_at + strpos(named, 'v4.00') + 4 END, CASE WHEN k_at > 0 AND strpos(named, 'v3.00') > 0 THEN k_at + strpos(named, 'v3.00') + 4 END) AS place FROM c),
    e AS (SELECT {key}, CASE WHEN {undecided} THEN [] ELSE {found} END AS f FROM d)
    SELECT {key}, CASE WHEN len(f) = 0 THEN NULL WHEN len(f) = 1 THEN f[1] WHEN list_contains(f, 'zip') THEN 'zip' WHEN list_contains(f, '7z') THEN '7z' WHEN list_contains(f, 'rar') THEN 'rar' ELSE array_to_string(f, ' ') END AS suggested_ext FROM e"""


_MADE = r"""CASE event_type WHEN 'view' THEN repeat(concat('[', m, ':', s, '.50] ', props, chr(10)), 5) || 'end'
  WHEN 'click' THEN repeat(concat('{', event_id, '}{', event_id + 20, '}', props, chr(13), chr(10)), 6)
  WHEN 'error' THEN repeat(concat(h, ':', m, ':', s, ':', props, chr(10)), 5)
  WHEN 'purchase' THEN concat('1', chr(10), h, ':', m, ':', s, ',000 --> ', h, ':', m, ':59,999', chr(10), props, chr(10), chr(10)) ELSE props END"""
_SHARE = "len(list_filter(ls, lambda x: regexp_matches(x, '{0}'))) >= {1} * len(ls)"

ORACLES: dict[str, str] = {
    "hash_md5": "SELECT doc_id, upper(md5(text)) AS digest FROM documents",
    "hash_sha1": "SELECT doc_id, upper(sha1(text)) AS digest FROM documents",
    "hash_sha2_256": "SELECT doc_id, upper(sha256(text)) AS digest FROM documents",
    "hash_null": "SELECT doc_id, '' AS digest FROM documents",
    "hash_crc32": f"SELECT o_orderkey, printf('%08X', {_crc(_KEY, kernels.CRC32)}) AS digest FROM orders",
    "hash_crc32c": f"SELECT o_orderkey, printf('%08X', {_crc(_KEY, kernels.CRC32C)}) AS digest FROM orders",
    "hash_crc32c_texts": f"SELECT item_id, printf('%08X', {_crc('text', kernels.CRC32C)}) AS digest FROM benchmark",
    "throughput_average": "SELECT user_id, " + ", ".join(f"round(list_reduce(list_prepend(0.0::DOUBLE, l), lambda a, x: a + (x - a) * (1 - exp(-60.0::DOUBLE / (60.0::DOUBLE * {m})))), 9) AS average_{m}" for m in (1, 5, 15)) + " FROM (SELECT user_id, list(length(props)::DOUBLE ORDER BY ts, event_id) AS l FROM events GROUP BY user_id)",
    "format_detect_documents": _detect("documents", "doc_id", "text"),
    "format_detect_texts": _detect(f"(SELECT event_id, replace({_list(queries.TEXTS)}[(event_id % {len(queries.TEXTS)} + 1)::INT], '@', (event_id % 10)::VARCHAR) AS content FROM events)", "event_id", "content"),
    "format_detect_pages": _detect("pages", "page_id", "html"),
    "report_structure": _structure(),
    "text_decode": "SELECT doc_id, text AS decoded FROM documents",
    "text_numbers": """SELECT p_partkey, regexp_replace(p_name, '[^0-9.\\-]', '', 'g') AS digits, 'ca. ' || p_retailprice || ' fps ' AS first, CASE WHEN p_partkey % 3 <> 0 AND p_size <> 0 THEN p_size::VARCHAR END AS non_default FROM part""",
    "time_parse": """SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN ((event_id % 24 * 3600 + event_id % 60 * 60 + event_id % 59) * 1000 + event_id % 1000) * 1000000 ELSE -1 END AS ns,
        CASE WHEN event_id % 5 <> 0 THEN (event_id % 10 * 3600 + event_id % 60 * 60 + event_id % 59) * 1000 + event_id % 100 * 10 ELSE -1 END AS ms FROM events""",
    "fmt_dhms": "SELECT event_id, printf('%d.%02d:%02d:%02d', s // 86400, s // 3600 % 24, s // 60 % 60, s % 60) AS rendered FROM (SELECT event_id, greatest(event_id * 7919 % 400000 - 1000, 0) AS s FROM events)",
    "xml_escape": "SELECT page_id, md5(t) AS text_md5, md5(replace(t, '\"', '&quot;')) AS attribute_md5 FROM (SELECT page_id, replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS t FROM pages)",
    "personal_hash": "SELECT c_nationkey AS nation, count(DISTINCT c_name) AS values, 128::BIGINT AS digits FROM customer GROUP BY 1",
    "provider_condense": """SELECT source, lang AS root_type, CASE WHEN bool_or(EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)) THEN 'labelled,all' ELSE 'all' END AS providers FROM documents d GROUP BY 1, 2""",
    "mkv_parse": _made([(_TOP, "Duration", _number("(k / 2.0::DOUBLE)")), (_TOP, "WritingApp", "'writer ' || k"), *[(_VIDEO.format("(100 + k)"), key, text) for key, text in (
        ("PixelDimensions", "(640 + k) || ', 480'"), ("SampleCount", "(k + 2)::VARCHAR"), ("StatedSampleRate", _number("(1e9::DOUBLE / (1000000 * (k + 1)))")), ("Title", "n_name"),
        ("Bitrate", _number("((k + 2) * 10 * (k + 1) * 8 / (250 * (k + 1) / 1000.0::DOUBLE))")), ("Duration", _span("250 * (k + 1)")), ("Size", "((k + 2) * 10 * (k + 1))::VARCHAR"))]]),
    "mp4_parse": _made([(_TOP, "Duration", _number("((500 * k + 250) / 1000.0::DOUBLE)")), *[(_VIDEO.format("(k + 1)"), key, text) for key, text in (
        ("PixelDimensions", "(320 + k) || ', 240'"), ("ContainerCodecId", "'avc1'"), ("Id", "(k + 1)::VARCHAR"), ("Duration", _span("1000 * k + 500")), ("Language", "'eng'"))]]),
    "ogg_parse": _made([(_AUDIO.format("(k + 1)"), key, text) for key, text in (
        ("StatedSampleRate", "'48000'"), ("SampleCount", "(48000 * (k + 1))::VARCHAR"), ("Duration", _span("1000 * (k + 1)")), ("Title", "n_name"),
        ("Size", "(10 * (k + 1) * (100 + k) + 30 + 29 + length(n_name))::VARCHAR"), ("Bitrate", _number("((10 * (k + 1) * (100 + k) + 30 + 29 + length(n_name)) * 8 / (k + 1)::DOUBLE)")))]),
    "multi_hash": "SELECT doc_id, upper(md5(text)) AS md5, upper(sha1(text)) AS sha1, upper(sha256(text)) AS sha2_256 FROM documents",
    "print_hashes_long": "SELECT doc_id, unnest(['MD5', 'SHA1', 'SHA2-256']) AS name, unnest(['MD5 => ' || upper(md5(text)), 'SHA1 => ' || upper(sha1(text)), 'SHA2-256 => ' || upper(sha256(text))]) AS line FROM documents",
    "base_convert": "WITH c AS (SELECT o_orderkey, " + _crc(_KEY, kernels.CRC32) + " AS n FROM orders) " + " UNION ALL ".join(f"SELECT o_orderkey, '{b}' AS base, {_digits('n', b)} AS rendered FROM c" for b in bases.ALPHABETS),
    "discover_ext_allow": f"SELECT page_id, url FROM pages WHERE {_ENDS.format('#top')} OR {_ENDS.format('/')} OR {_ENDS.format('ref=x')}",
    "discover_ext_deny": f"SELECT page_id, url FROM pages WHERE NOT ({_ENDS.format('#top')} OR {_ENDS.format('ref=x')})",
    "discover_skip_log": "SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)",
    "discover_partition": "SELECT page_id, (CASE " + " ".join(f"WHEN starts_with(url, '{p}') THEN {i}" for i, p in enumerate(queries.PREFIXES)) + f" ELSE {len(queries.PREFIXES)} END)::INTEGER AS part FROM pages",
    "discovery_totals": "SELECT source, count(*) AS files, sum(octet_length(encode(text)))::BIGINT AS bytes FROM documents GROUP BY source",
    "path_parts": r"""SELECT page_id, name AS file_name, CASE WHEN contains(url, '/') THEN regexp_replace(url, '/[^/]*$', '') ELSE '' END AS dir,
        CASE WHEN name = '.' THEN name ELSE regexp_replace(name, '\.[^.]*$', '') END AS stem, CASE WHEN name = '.' THEN '' ELSE regexp_extract(name, '\.[^.]*$') END AS ext
        FROM (SELECT page_id, url, regexp_extract(url, '[^/]*$') AS name FROM pages)""",
    "placeholder_expand": f"SELECT page_id, {_EXPANDED} AS expanded FROM pages",
    "move_plan": f"""SELECT page_id, url AS path, to_path AS destination FROM (SELECT page_id, url, concat(regexp_replace(replace(replace({_EXPANDED}, '/library/', '/shelf/'), '?', '_'), '/[^/]*$', ''), '/', regexp_extract(url, '[^/]*$')) AS to_path FROM pages)
        WHERE to_path <> '' AND to_path <> url""",
    "crc32_error_log": f"WITH c AS (SELECT o_orderkey, printf('%08X', {_crc(_KEY, kernels.CRC32)}) AS crc FROM orders) SELECT concat(crc, ' /orders/', o_orderkey, ' [00000000].txt') AS line FROM c WHERE o_orderkey % 3 = 0 AND crc <> '00000000'",
    "extension_difference": """WITH p AS (SELECT url, ['mkv', 'AVI', 'txt', ''][(page_id % 4 + 1)::INT] AS e, ['mkv mka', 'avi', ''][(page_id % 3 + 1)::INT] AS s FROM pages)
        SELECT concat(e, ' => ', CASE WHEN s = '' THEN 'unknown' ELSE s END, chr(9), url) AS line FROM p WHERE e = '' OR NOT list_contains(string_split(s, ' '), lower(e))""",
    "text_read_lines": f"""WITH l AS (SELECT doc_id, {_LINES.format("text")} AS ls FROM documents)
        SELECT doc_id, coalesce(list_min(list_filter(range(1, len(ls) + 1), lambda i: length(ls[i]) > 1024)) - 1, len(ls))::BIGINT AS n_lines FROM l""",
    "track_stats": f"""WITH t AS (SELECT track, (max(tc) - min(tc)) // 1000000 AS ms, sum(size)::BIGINT AS track_size, count(*) AS sample_count FROM {_S} GROUP BY track)
        SELECT track, ms / 1000.0::DOUBLE AS track_length, track_size, sample_count, CASE WHEN ms <> 0 AND track_size <> 0 THEN track_size * 8.0::DOUBLE / (ms / 1000.0::DOUBLE) END AS average_bitrate,
        CASE WHEN ms <> 0 THEN sample_count::DOUBLE / (ms / 1000.0::DOUBLE) END AS average_sample_rate FROM t""",
    "track_minmax_rate": f"""WITH {_RATES} SELECT track, min(rate) FILTER (ok) AS min_sample_rate, max(rate) FILTER (ok) AS max_sample_rate FROM
        (SELECT track, rate, coalesce(rate IS NOT NULL AND NOT isinf(rate) AND abs(rate - p1) < (p1 + p2 / 2) * 0.1::DOUBLE AND abs(rate - p2) < (p1 + p2 / 2) * 0.1::DOUBLE, FALSE) AS ok FROM r2) GROUP BY track""",
    "track_histogram": f"WITH {_RATES} SELECT track, rate, c AS count, f AS first FROM bins",
    "track_dominant_rate": f"WITH {_RATES} SELECT track, rate AS dominant_rate FROM (SELECT *, row_number() OVER (PARTITION BY track ORDER BY c DESC, f DESC) AS i FROM bins) WHERE i = 1",
    "track_rate_deviation": f"WITH {_RATES}, d AS (SELECT track, sum(rate * rate) / sum(c) - (sum(rate) / sum(c)) * (sum(rate) / sum(c)) AS v FROM bins GROUP BY track) SELECT track, round(CASE WHEN v >= 0 THEN sqrt(v) ELSE 'NaN'::DOUBLE END, 9) AS rate_deviation FROM d",
    "track_index": "SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS idx FROM events",
    "cluster_timecode_asof": "SELECT event_id, last_value(CASE WHEN event_type = 'error' THEN ts END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS cluster_ts FROM events",
    "composite_first_wins": f"WITH i AS ({_items('supplier', 's', 0)} UNION ALL {_items('customer', 'c', 1)}) SELECT nation, key, value, provider FROM (SELECT *, row_number() OVER (PARTITION BY nation, key ORDER BY rank, ord) AS i FROM i) WHERE i = 1",
    "provider_union": " UNION ALL ".join(f"SELECT doc_id, '{t}' AS provider, {r} AS provider_rank, '{c}' AS key, {c}::VARCHAR AS value FROM {t}" for r, (t, cs) in enumerate((("documents", ("lang", "source")), ("labels", ("quality", "toxic")))) for c in cs),
    "largest_tags": "SELECT source, doc_id, lang, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id DESC) AS i FROM documents) WHERE i = 1",
    "fmt_f64": f"""WITH v AS (SELECT event_id, value AS v, event_id::DOUBLE AS i FROM events),
        w AS (SELECT event_id, v, [i / 1048576, -i / 3e9, i * 12345.0625, 0.000123456789012345::DOUBLE + i / 64, i * 1e9 + 0.25, (i + 1) / 1e7][(event_id % 6 + 1)::INT] AS f FROM v)
        SELECT event_id, {_number("v")} AS rendered, {_number("f")} AS full_digits FROM w""",
    "fmt_timespan": f"""SELECT event_id, concat(CASE WHEN {_TS} < 0 THEN '-' ELSE '' END, CASE WHEN {_Q} // 4 >= 86400 THEN concat({_Q} // 4 // 86400, '.') ELSE '' END,
        printf('%02d:%02d:%02d', {_Q} // 4 // 3600 % 24, {_Q} // 4 // 60 % 60, {_Q} // 4 % 60), CASE WHEN {_Q} % 4 = 0 THEN '' ELSE printf('.%07d', {_Q} % 4 * 2500000) END) AS rendered FROM events""",
    "fmt_datetime": "SELECT event_id, strftime(ts, '%m/%d/%Y %H:%M:%S') AS rendered FROM events",
    "flag_names": f"WITH b AS (SELECT l_orderkey, l_linenumber, (l_orderkey * 37 + l_linenumber) % 1024 AS b FROM lineitem), n AS (SELECT l_orderkey, l_linenumber, array_to_string(list_filter({_FLAGS}, lambda x: x IS NOT NULL), ', ') AS names FROM b) SELECT l_orderkey, l_linenumber, CASE WHEN names = '' THEN 'Invalid' ELSE names END AS names FROM n",
    "xml_report": f"""WITH n AS (SELECT n_regionkey AS k, string_agg(concat('    <Nation>', chr(10), {_item("keys", "Id", "Int64", "n_nationkey")}, {_item("keys", "Name", "String", "concat(n_name, ' &lt;&amp;&gt;')")}, {_item("more", "Full_name", "String", "lower(n_name)")}, '    </Nation>', chr(10)), '' ORDER BY n_nationkey) AS items FROM nation GROUP BY 1)
        SELECT r_name AS path, concat('<FileInfo>', chr(10), '  <Path>', r_name, '</Path>', chr(10), '  <Size>', r_regionkey, '</Size>', chr(10), '  <Nations>', chr(10), items, '  </Nations>', chr(10), '</FileInfo>') AS xml FROM region JOIN n ON k = r_regionkey""",
    "null_stream": "SELECT 'NULL' || i AS tag, 8388608::BIGINT AS length, 8388608::BIGINT AS bytes, upper(md5(repeat(chr(0), 8388608))) AS md5 FROM range(3) t(i)",
    "format_detect_subtitles": f"""WITH p AS (SELECT *, lpad((event_id % 24)::VARCHAR, 2, '0') AS h, lpad((event_id % 60)::VARCHAR, 2, '0') AS m, lpad((event_id % 59)::VARCHAR, 2, '0') AS s FROM events),
        l AS (SELECT event_id, {_LINES.format(_MADE)} AS ls FROM p)
        SELECT event_id, CASE WHEN len(list_filter(ls, lambda x: regexp_matches(x, '{_RE["SRT"]}'))) > 0 THEN 'srt' WHEN {_SHARE.format('[[]..:..[.]..[]]', 0.8)} THEN 'lrc'
          WHEN len(ls) > 4 AND {_SHARE.format('^[{][0-9]*[}][{][0-9]*[}]', 0.8)} THEN 'sub' WHEN {_SHARE.format('^[0-9][0-9]:[0-9][0-9]:[0-9][0-9](.[0-9])?:', 0.8)} THEN 'tmp' END AS suggested_ext FROM l""",
}
