"""Chat formatting by quotation linking, DataFrame operations only.

A line's quote level is the number of `>` signs it starts with. Quoted lines are normalised (signs off, blanks squeezed,
lower case) and hashed; a hash is joined to the first message of the conversation whose own lines hold it. A message
replies to the earlier message that most lines of its outermost linked level come from, the later one of equals. Threads
follow reply links to their root by pointer doubling. A conversation's messages stand in the order (root's turn, turn),
so every reply follows what it replies to, within its thread; quotes and their `On ... wrote:` lines are dropped.

A conversation of at most `part` messages is one group, and only this shuffles its texts. Longer ones, which may hold a third
of all messages, are assembled in parts of `part` messages: keys without texts are sorted by ranges, counts a range give each
its place, and texts meet their places, then their part.

Defined results: null texts are empty messages; a null conversation is one of its own; null turns stand first and are
not linked; messages of one turn and thread stand by role, then by the MD5 of their text; repeated messages are kept each;
very long messages stay whole; an `On ... wrote:` line that no quote follows is a line like others; other columns are not
read; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessellon.llm.scratch import materialize

PART = 256
_QUOTE = r"^[ \t]*>[> \t]*"
_WROTE = r"(?s)^On .* wrote:[ \t\r]*$"
_LEAST = -(2**63)


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _quoted(line: Column) -> Column:
    return line.rlike(_QUOTE)


def normalised(line: Column) -> Column:
    """What is left of a line without quote signs, extra blanks and case."""
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(line, _QUOTE, ""), r"[ \t\r]+", " ")))


def without_quotes(text: Column) -> Column:
    """The own lines of a message, without blank lines at either end. A line `On ... wrote:` goes where a quoted one follows."""
    lines = _lines(text)
    introduces = lambda line, i: line.rlike(_WROTE) & F.coalesce(_quoted(F.get(lines, i + 1)), F.lit(False))
    own = F.filter(lines, lambda line, i: ~_quoted(line) & ~introduces(line, i))
    plain = ~F.coalesce(text, F.lit("")).contains(">")
    return F.regexp_replace(F.when(plain, F.coalesce(text, F.lit(""))).otherwise(F.array_join(own, "\n")), r"^\s+|\s+$", "")


def links(messages: DataFrame) -> DataFrame:
    """(conv, turn, parent): the message each message replies to, where its quotes tell. messages: conv, turn, text.

    Only conversations with a quote are cut into lines. What is said is pre-aggregated and stored, so that the join with a line
    that very many quote can be split.
    """
    known = messages.filter(F.col("turn").isNotNull()).select("conv", "turn", "text")
    some = materialize(known.filter(F.col("text").rlike(r"(?m)" + _QUOTE)).select("conv").distinct(), "quoting")
    line = known.join(some, "conv", "left_semi").select("conv", "turn", F.explode(_lines(F.col("text"))).alias("line"))
    level = F.length(F.regexp_replace(F.regexp_extract("line", _QUOTE, 0), "[^>]", ""))
    line = line.select("conv", "turn", level.alias("level"), normalised(F.col("line")).alias("norm")).filter("norm <> ''")
    line = materialize(line.select("conv", "turn", "level", F.xxhash64("norm").alias("h1"), F.xxhash64("norm", F.lit(1)).alias("h2")), "lines")
    said = materialize(line.filter("level = 0").groupBy("conv", "h1", "h2").agg(F.min("turn").alias("parent")), "said")
    found = line.filter("level > 0").join(said, ["conv", "h1", "h2"]).filter("parent < turn")
    votes = found.groupBy("conv", "turn", "level", "parent").agg(F.count("*").alias("n"))
    return votes.groupBy("conv", "turn").agg(F.max_by("parent", F.struct(-F.col("level"), "n", "parent")).alias("parent"))


def roots(parents: DataFrame) -> DataFrame:
    """(conv, turn, parent, root, depth) for messages with a parent, by pointer doubling. parents: stored."""
    state = parents.select("conv", "turn", "parent", F.col("parent").alias("root"), F.lit(1).cast("long").alias("depth"))
    while True:
        up = state.select("conv", F.col("turn").alias("root"), F.col("root").alias("up"), F.col("depth").alias("more"))
        state = materialize(state.join(up, ["conv", "root"], "left"), "threads")
        moved = not state.filter("up IS NOT NULL").isEmpty()
        state = state.select("conv", "turn", "parent", F.coalesce("up", "root").alias("root"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"))
        if not moved:
            return state


def messages(chats: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turn, role, text, reply_to, root_turn, depth): messages without quotes, with their links."""
    own = chats.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    own = own.withColumn("conv", F.coalesce("conv_id", F.lit(_LEAST)))
    parents = materialize(links(own), "links")
    threads = roots(parents)
    joined = own.join(threads, ["conv", "turn"], "left")
    return joined.select("conv_id", "turn", "role", without_quotes(F.col("text")).alias("text"), F.col("parent").alias("reply_to"), F.coalesce("root", "turn").alias("root_turn"), F.coalesce("depth", F.lit(0)).cast("long").alias("depth"))


def _assembled(rows: DataFrame, *key: str) -> DataFrame:
    """One row for each key from rows with their order (a struct) and what they say."""
    grouped = rows.groupBy("conv_id", *key).agg(F.array_sort(F.collect_list(F.struct("order", "turn", "said"))).alias("m"))
    return grouped.select("conv_id", "part", F.size("m").cast("long").alias("n_messages"), F.col("m.turn").alias("turns"), F.array_join("m.said", "").alias("conversation"))


def conversations(linked: DataFrame, part: int = PART) -> DataFrame:
    """(conv_id, part, n_messages, turns, conversation): messages in reply order, each as `<|role|>`, its text and a newline."""
    said = F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n"), F.col("text"), F.lit("\n"))
    rows = linked.withColumn("conv", F.coalesce("conv_id", F.lit(_LEAST))).withColumn("role", F.coalesce("role", F.lit("")))
    rows = rows.select("conv_id", "conv", "root_turn", "turn", "role", F.md5("text").alias("h"), said.alias("said"))
    large = rows.groupBy("conv").agg(F.count("*").alias("size")).filter(F.col("size") > part).select("conv", F.lit(True).alias("large"))
    rows = rows.join(materialize(large, "large"), "conv", "left")
    one = rows.filter("large IS NULL").select("conv_id", "conv", F.lit(0).cast("long").alias("part"), F.struct("root_turn", "turn", "role", "h").alias("order"), "turn", "said")
    many = _placed(rows.filter("large"), part).withColumn("part", F.floor(F.col("place") / part)).withColumn("order", F.struct("place"))
    return _assembled(one, "conv", "part").union(_assembled(many, "conv", "part"))


def _placed(rows: DataFrame, part: int) -> DataFrame:
    """(conv_id, conv, turn, said, place) of the messages of long conversations; repeated ones meet before the shuffle."""
    key = ["conv", "root_turn", "turn", "role", "h"]
    safe = [F.struct(F.col(c).alias("turn")).alias(c) if c in ("root_turn", "turn") else F.col(c) for c in key]  # null turns meet
    keys = rows.groupBy(*key).agg(F.count("*").alias("n")).repartitionByRange(*key).sortWithinPartitions(*key)
    keys = materialize(keys.withColumn("id", F.monotonically_increasing_id()).withColumn("range", F.shiftright("id", 33)), "ordered")
    sizes = keys.groupBy("conv", "range").agg(F.sum("n").alias("size"))
    before = F.sum("size").over(Window.partitionBy("conv").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    sizes = materialize(sizes.select("conv", "range", F.coalesce(before, F.lit(0)).alias("before")), "ranges")
    within = F.sum("n").over(Window.partitionBy("conv", "range").orderBy("id").rowsBetween(Window.unboundedPreceding, -1))
    places = keys.withColumn("within", F.coalesce(within, F.lit(0))).join(sizes, ["conv", "range"]).select(*safe, "n", (F.col("before") + F.col("within")).alias("first"))
    places = materialize(places, "places")
    texts = rows.select("conv_id", *safe, "said").groupBy("conv_id", *key).agg(F.first("said").alias("said"))
    placed = texts.join(places, key).withColumn("place", F.explode(F.sequence("first", F.col("first") + F.col("n") - 1)))
    return placed.select("conv_id", "conv", F.col("turn.turn").alias("turn"), "said", "place")


ORACLE = """
WITH RECURSIVE m AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations),
l AS (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line FROM m),
n AS (SELECT conv_id, turn, len(regexp_replace(regexp_extract(line, '^[ \\t]*>[> \\t]*'), '[^>]', '', 'g')) AS level,
      lower(trim(regexp_replace(regexp_replace(line, '^[ \\t]*>[> \\t]*', ''), '[ \\t\\r]+', ' ', 'g'))) AS norm FROM l),
said AS (SELECT conv_id, norm, min(turn) AS parent FROM n WHERE level = 0 AND norm <> '' GROUP BY ALL),
v AS (SELECT n.conv_id, n.turn, level, parent, count(*) AS c FROM n JOIN said USING (conv_id, norm) WHERE level > 0 AND parent < turn GROUP BY ALL),
p AS (SELECT conv_id, turn, parent FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY level, c DESC, parent DESC) AS i FROM v) WHERE i = 1),
t AS (SELECT conv_id, turn, parent AS root FROM p UNION ALL SELECT t.conv_id, t.turn, p.parent FROM t JOIN p ON p.conv_id = t.conv_id AND p.turn = t.root),
r AS (SELECT conv_id, turn, min(root) AS root FROM t GROUP BY ALL),
o AS (SELECT m.conv_id, m.turn, m.role, coalesce(root, m.turn) AS root_turn,
      regexp_replace(array_to_string(list_filter(string_split(m.text, chr(10)), lambda x, i: NOT regexp_matches(x, '^[ \\t]*>[> \\t]*')
        AND NOT (regexp_matches(x, '(?s)^On .* wrote:[ \\t\\r]*$') AND coalesce(regexp_matches(string_split(m.text, chr(10))[i + 1], '^[ \\t]*>[> \\t]*'), false))), chr(10)), '^\\s+|\\s+$', '', 'g') AS text
      FROM m LEFT JOIN r USING (conv_id, turn)),
q AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY root_turn, turn, role, md5(text)) - 1 AS place FROM o)
SELECT conv_id, (place // 256)::BIGINT AS part, count(*) AS n_messages, list(turn ORDER BY place) AS turns,
       string_agg('<|' || role || '|>' || chr(10) || text || chr(10), '' ORDER BY place) AS conversation
FROM q GROUP BY conv_id, place // 256
"""
