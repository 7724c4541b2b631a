"""Line deduplication over a suffix array of line ids, DataFrame operations only.

Every line is an id; positions whose line occurs nowhere else end runs. The suffixes at the other positions are ranked by
prefix doubling: ranks by the first 2**k lines come from sorting the distinct pairs (rank at p, rank at p + 2**k), and
an order-preserving number for each pair is handed back to the positions. Suffixes that share at least the lines
needed for `min_words` words are an interval of the array with that least common prefix; it is found by two overlapping
ranks of the largest power of two in it. In each interval the copy that stands first stays, all later ones are deleted;
the intervals at every line, forwards and backwards, cover each maximal repeated run from end to end. Doubling ends as
soon as the ranks cover the longest such prefix, which min_words bounds but for lines without words.

So a line goes exactly if it lies in a run of consecutive lines of min_words words or more that also begins earlier, in
the order of (id, text hash, line number).

Only ids are sorted and joined; hot lines are aggregated before the shuffle, and joins on them can be split. Of the texts,
only those that a bitmap of bounded size can't clear are shuffled, to meet their deletions.

Defined results: null stays null; empty texts have one empty line; a text of very many lines, or a very long line, is
worked on whole; rows that repeat an id and text are one document and all get its result; null ids stand first, and of
copies with one id the one with the smaller text hash; other columns are kept, an empty table gives an empty table. A text
of which all lines go becomes empty. Tables made on the way are deleted once nothing reads them.
"""

from __future__ import annotations

import struct

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessellon.llm.scratch import made, materialize, release_since

MIN_WORDS = 50
_LEAST = -(2**63)
DOC = ["__d", "__h"]


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.withColumn("__d", F.coalesce(F.col(id_col).cast("long"), F.lit(_LEAST))).withColumn("__h", F.xxhash64(text_col))


def line_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(__d, __h, n, words, l1, l2): the lines of every text, by number, word count and 128-bit id."""
    rows = _keyed(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), "_id", "_text").filter(F.col("_text").isNotNull())
    lines = rows.select(*DOC, F.posexplode(F.split("_text", "\n")).alias("n", "line"))
    return lines.select(*DOC, "n", F.regexp_count("line", F.lit(r"\S+")).alias("words"), F.xxhash64("line").alias("l1"), F.xxhash64("line", F.lit(1)).alias("l2"))


def ordered_ranks(keys: DataFrame, columns: list[str], name: str = "r") -> DataFrame:
    """The distinct rows of columns with numbers, from 1, that have their order. No window: ranges are sorted in parallel."""
    ranges = keys.select(*columns).distinct().repartitionByRange(*columns).sortWithinPartitions(*columns)
    return materialize(ranges.withColumn(name, F.monotonically_increasing_id() + 1), "ranks")


def repeated(lines: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(__d, __h, seg, n, before, after, left, r): positions of lines that occur elsewhere too, in segments of consecutive ones.

    before, after: words of the segment up to the line, without and with it; left: words from it on; r: rank of its line.
    """
    place = F.struct(*DOC, "n")
    known = lines.groupBy("l1", "l2").agg(F.min(place).alias("a"), F.max(place).alias("b")).filter("a < b")
    at = lines.join(ordered_ranks(known, ["l1", "l2"]), ["l1", "l2"]).select(*DOC, "n", "words", "r")
    w = Window.partitionBy(*DOC).orderBy("n")
    at = at.withColumn("last", F.lag("n").over(w)).filter("last IS NULL OR last < n").withColumn("seg", F.col("n") - F.row_number().over(w))
    s = Window.partitionBy(*DOC, "seg").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    at = at.withColumn("after", F.sum("words").over(s)).withColumn("total", F.sum("words").over(Window.partitionBy(*DOC, "seg")))
    at = at.filter(F.col("total") >= min_words).withColumn("before", F.col("after") - F.col("words"))
    return at.select(*DOC, "seg", "n", "before", "after", (F.col("total") - F.col("before")).alias("left"), "r")


def windows(at: DataFrame, min_words: int) -> DataFrame:
    """(__d, __h, start, m): from every position the fewest lines of min_words words, forwards and backwards."""
    part = Window.partitionBy(*DOC, "seg").rowsBetween(Window.unboundedPreceding, 0)
    seen = F.last(F.when(F.col("q.mark") == 1, F.col("n")), ignorenulls=True)
    ends = F.max("n").over(Window.partitionBy(*DOC, "seg"))

    def asked(key):
        return at.withColumn("end", ends + 1).withColumn("q", F.explode(F.array(F.struct(F.col("before").alias("key"), F.lit(1).alias("mark")), F.struct(key.alias("key"), F.lit(0).alias("mark")))))

    ahead = part.orderBy(F.desc("q.key"), F.desc("q.mark"), F.desc("n"))
    forward = asked(F.col("before") + min_words).withColumn("e", seen.over(ahead)).filter(F.col("q.mark") == 0)
    forward = forward.filter(F.col("left") >= min_words).select(*DOC, F.col("n").alias("start"), (F.coalesce("e", "end") - F.col("n")).alias("m"))
    behind = part.orderBy("q.key", F.desc("q.mark"), "n")
    backward = asked(F.col("after") - min_words).withColumn("e", seen.over(behind)).filter((F.col("q.mark") == 0) & F.col("e").isNotNull())
    backward = backward.select(*DOC, F.col("e").alias("start"), (F.col("n") + 1 - F.col("e")).alias("m"))
    return forward.union(backward).distinct()


def doubled(ranks: DataFrame, k: int) -> DataFrame:
    """Ranks by the first 2**(k + 1) lines from those by 2**k; a suffix that ends sooner stands first."""
    ahead = F.coalesce(F.lead("r", 2**k).over(Window.partitionBy(*DOC, "seg").orderBy("n")), F.lit(0))
    pairs = ranks.select(*DOC, "seg", "n", F.col("r").alias("ra"), ahead.alias("rb"))
    return materialize(pairs.join(ordered_ranks(pairs, ["ra", "rb"]), ["ra", "rb"]).select(*DOC, "seg", "n", "r"), "suffixes")


def deletions(lines: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(__d, __h, n): the lines that go. lines: a stored line_table()."""
    at = materialize(repeated(lines, min_words), "repeated")
    wanted = materialize(windows(at, min_words), "windows")
    longest = wanted.agg(F.max("m")).first()[0] or 0
    ranks, found = at.select(*DOC, "seg", "n", "r"), None
    for k in range(max(longest, 1).bit_length()):
        if k:
            ranks = doubled(ranks, k - 1)
        r = ranks.select(*DOC, F.col("n").alias("start"), F.col("r").alias("ra"))
        own = wanted.filter((F.col("m") >= 2**k) & (F.col("m") < 2 ** (k + 1))).join(r, [*DOC, "start"])
        if k:
            r = ranks.select(*DOC, F.col("n").alias("second"), F.col("r").alias("rb"))
            own = own.withColumn("second", (F.col("start") + F.col("m") - 2**k)).join(r, [*DOC, "second"]).drop("second")
        else:
            own = own.withColumn("rb", F.col("ra"))
        own = own.select(*DOC, "start", "m", "ra", "rb")
        found = own if found is None else found.union(own)
    found = materialize(found, "intervals")
    place = F.struct(*DOC, "start")
    first = found.groupBy("m", "ra", "rb").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter("first < last").drop("last")
    later = found.join(materialize(first, "first"), ["m", "ra", "rb"]).filter(place > F.col("first"))
    gone = later.select(*DOC, F.explode(F.sequence(F.col("start"), F.col("start") + F.col("m") - 1)).alias("n"))
    return gone.distinct()


#: The bitmap of documents with deletions has at most 2**BITS bits; where it fills up, more texts are shuffled.
BITS = 23


def may_be_among(keys: DataFrame, columns: list[str]) -> Column:
    """Whether a row's columns may be among the stored keys: no false negatives. Two bits a key, aggregated in the cluster; the
    driver gets 2**(BITS - 6) words at most and puts them into the plan as one binary literal."""
    bits = min(BITS, max(10, (16 * keys.count()).bit_length()))
    h = F.xxhash64(*columns)
    places = [F.shiftrightunsigned(h, 64 - bits), F.shiftrightunsigned(F.shiftleft(h, 30), 64 - bits)]
    at = keys.select(F.explode(F.array(*places)).alias("at"))
    words = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("at").bitwiseAND(63).cast("int"))).alias("ones"))
    cells = bytearray(1 << bits - 3)
    for r in words.collect():
        struct.pack_into("<q", cells, 8 * r["word"], r["ones"])

    def bit(place: Column) -> Column:
        byte = F.conv(F.hex(F.substring(F.lit(bytes(cells)), (F.shiftright(place, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        return F.call_function("shiftright", byte, place.bitwiseAND(7).cast("int")).bitwiseAND(1) == 1

    return bit(places[0]) & bit(places[1])


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the later copies deleted from the text, and __n_lines and __n_removed (long)."""
    before = made()
    lines = materialize(line_table(docs, id_col, text_col), "lines")
    gone = materialize(deletions(lines, min_words), "gone")
    marked = lines.join(gone.select(*DOC).distinct(), DOC, "left_semi").select(*DOC, "n").join(gone.withColumn("gone", F.lit(True)), [*DOC, "n"], "left")
    flags = marked.groupBy(*DOC).agg(F.array_sort(F.collect_set(F.struct("n", F.col("gone").isNull().alias("keep")))).alias("__flags"))
    flags = materialize(flags, "flags")
    release_since(docs.sparkSession, before, flags)
    maybe = may_be_among(flags, DOC)
    keyed, none = _keyed(docs, id_col, text_col), F.lit(None).cast(flags.schema["__flags"].dataType)
    both = keyed.filter(~maybe).withColumn("__flags", none).unionByName(keyed.filter(maybe).join(flags, DOC, "left"))
    kept = F.array_compact(F.zip_with(F.split(text_col, "\n"), "__flags", lambda line, f: F.when(f["keep"], line)))
    text = F.when(F.col("__flags").isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n"))
    n = F.when(F.col(text_col).isNull(), F.lit(0)).otherwise(F.length(text_col) - F.length(F.replace(F.col(text_col), F.lit("\n"), F.lit(""))) + 1)
    removed = F.coalesce(F.size(F.filter("__flags", lambda f: ~f["keep"])), F.lit(0))
    removed = F.when(F.col("__flags").isNull(), F.lit(0)).otherwise(removed)
    return both.select(*[text.alias(c) if c == text_col else F.col(c) for c in docs.columns], n.cast("long").alias("__n_lines"), removed.cast("long").alias("__n_removed"))


ORACLE_CTES = """
dl AS (SELECT DISTINCT doc_id, text FROM {docs} WHERE text IS NOT NULL),
ll AS (SELECT doc_id, text, n, ls[n + 1] AS line, len(regexp_extract_all(ls[n + 1], '[^ \\t\\n\\x0B\\f\\r]+')) AS w
       FROM (SELECT doc_id, text, ls, unnest(range(len(ls))) AS n FROM (SELECT *, string_split(text, chr(10)) AS ls FROM dl))),
lc AS (SELECT *, sum(w) OVER (PARTITION BY doc_id, text ORDER BY n) AS ce FROM ll),
lw AS (SELECT a.doc_id, a.text, a.n AS s, min(b.n) AS e FROM lc a JOIN lc b ON a.doc_id = b.doc_id AND a.text = b.text AND b.n >= a.n AND b.ce - (a.ce - a.w) >= 50 GROUP BY ALL
       UNION
       SELECT b.doc_id, b.text, max(a.n), b.n FROM lc a JOIN lc b ON a.doc_id = b.doc_id AND a.text = b.text AND b.n >= a.n AND b.ce - (a.ce - a.w) >= 50 GROUP BY b.doc_id, b.text, b.n),
lk AS (SELECT *, array_to_string(list_slice(string_split(text, chr(10)), s + 1, e + 1), chr(10)) AS k FROM lw),
lf AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) AS i FROM lk),
lg AS (SELECT DISTINCT doc_id, text, unnest(range(s, e + 1)) AS n FROM lf WHERE i > 1),
lt AS (SELECT l.doc_id, l.text, coalesce(string_agg(line, chr(10) ORDER BY l.n) FILTER (g.n IS NULL), '') AS new_text, count(*) AS n_lines, count(g.n) AS n_removed
       FROM ll l LEFT JOIN lg g ON l.doc_id = g.doc_id AND l.text = g.text AND l.n = g.n GROUP BY l.doc_id, l.text)
"""

ORACLE = (
    "WITH "
    + ORACLE_CTES.format(docs="documents")
    + "SELECT d.doc_id, lt.new_text AS text, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed FROM documents d LEFT JOIN lt ON d.doc_id = lt.doc_id AND d.text = lt.text"
)
