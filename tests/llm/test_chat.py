import hashlib
import random

import duckdb

from tessellon.llm import chat, queries
from tests.llm.fixtures import table


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, root long, conv string")


def test_links_threads_and_order(spark):
    rows = [
        (1, 0, "user", "Shall we meet at noon?\nBring the papers."),
        (1, 1, "assistant", "The weather is fine."),
        (1, 2, "user", "On Monday jo wrote:\n> shall we  meet at noon?\nYes, at noon then."),
        (1, 3, "user", "> > Shall we meet at noon?\n> Yes, at noon then.\nAgreed."),
        (1, 4, "user", "> The weather is fine.\nIt is."),
        (1, 5, "user", "> never said\nHm."),
        (2, 0, "user", "> Agreed.\nOther conversation."),
    ]
    got = {(r.conv_id, r.turn): r for r in chat.messages(frame(spark, rows)).collect()}
    assert [got[1, t].reply_to for t in range(6)] == [None, None, 0, 2, 1, None]
    assert [got[1, t].root_turn for t in range(6)] == [0, 1, 0, 0, 1, 5]
    assert [got[1, t].depth for t in range(6)] == [0, 0, 1, 2, 1, 0]
    assert got[1, 2].text == "Yes, at noon then." and got[2, 0].reply_to is None
    out = {(r.conv_id, r.part): r for r in chat.conversations(chat.messages(frame(spark, rows)), 4).collect()}
    assert out[1, 0].turns == [0, 2, 3, 1] and out[1, 1].turns == [4, 5]
    assert ">" not in "".join(line for line in out[1, 0].conversation.splitlines() if not line.startswith("<|"))


def test_a_long_chain_and_a_hot_conversation(spark):
    rows = [(7, 0, "user", "message number 0")] + [(7, i, "user", f"> message number {i - 1}\nmessage number {i}") for i in range(1, 300)]
    got = chat.messages(frame(spark, rows)).collect()
    assert sorted((r.turn, r.depth, r.root_turn) for r in got) == [(i, i, 0) for i in range(300)]
    parts = sorted((r.part, r.n_messages) for r in chat.conversations(chat.messages(frame(spark, rows)), 64).collect())
    assert parts == [(0, 64), (1, 64), (2, 64), (3, 64), (4, 44)]


def plain(rows, part):
    """Order, own lines and parts in plain Python for messages without replies."""
    want = {}
    for c, t, role, text in sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1], r[2], hashlib.md5(r[3].strip().encode()).hexdigest())):
        want.setdefault(c, []).append((t, f"<|{role}|>\n{text.strip()}\n"))
    return sorted((c, k // part, [t for t, _ in m[k : k + part]], "".join(x for _, x in m[k : k + part])) for c, m in want.items() for k in range(0, len(m), part))


def test_long_and_short_conversations_with_repeats(spark):
    rnd = random.Random(3)
    rows = [(c, rnd.randrange(30), rnd.choice(["user", "assistant"]), f"text {rnd.randrange(4)}") for c in range(8) for _ in range(rnd.choice([3, 9, 40, 200]))]
    rows += [(3, None, "user", "no turn")] * 3 + [(50, 1, "user", "the same message")] * 100
    for part in (1, 7, 64):
        got = chat.conversations(chat.messages(frame(spark, rows)), part).collect()
        assert sorted((r.conv_id, r.part, r.turns, r.conversation) for r in got) == plain(rows, part)
        assert all(r.n_messages == len(r.turns) for r in got)


def test_a_hot_quoted_line(spark):
    rows = [(1, 0, "user", "a line that all quote")] + [(1, t, "user", f"> a line that all quote\nanswer {t}") for t in range(1, 600)]
    got = chat.messages(frame(spark, rows)).collect()
    assert {r.reply_to for r in got if r.turn} == {0}


def test_only_lines_before_a_quote_introduce_it(spark):
    long = "On " + "x" * 400 + " wrote:"
    rows = [
        (1, 0, "user", "On Monday she wrote:\nOne two."),
        (1, 1, "user", f"{long}\n> One two.\nFine."),
        (1, 2, "user", "a\nOn Monday she wrote:"),
        (1, 3, "user", "On Friday he wrote:\n\n > One two.\nb"),
    ]
    got = {r.turn: r.text for r in chat.messages(frame(spark, rows)).collect()}
    assert got == {0: "On Monday she wrote:\nOne two.", 1: "Fine.", 2: "a\nOn Monday she wrote:", 3: "On Friday he wrote:\n\nb"}


def test_query_with_quotes_against_its_sql(spark, tmp_path):
    rows = [(1, 0, "user", "Shall we?\nOn Monday she wrote:"), (1, 1, "assistant", "On Monday jo wrote:\n> shall  we?\nYes."), (1, 2, "user", "> > Shall we?\n> Yes.\nGood."), (2, 0, "user", "> Yes.\nNo.")]
    frame(spark, rows).write.parquet(f"{tmp_path}/conversations.parquet")
    got = sorted(map(str, queries.op9_chat_formatting(spark, str(tmp_path)).collect()))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = con.execute(chat.ORACLE).fetchall()
    assert got == sorted(map(str, spark.createDataFrame(want, "conv_id long, part long, n_messages long, turns array<long>, conversation string").collect()))


def test_query(spark):
    want = {}
    for c, t, role, text in sorted(table("conversations", "conv_id, turn, role, text")):
        want[c] = want.get(c, "") + f"<|{role}|>\n{text.strip()}\n"
    got = queries.op9_chat_formatting(spark, "/root/testdata/sf0.001").collect()
    assert {r.conv_id: r.conversation for r in got} == want


def test_awkward(spark):
    rows = [(None, 0, "user", "a"), (None, 1, None, None), (3, None, "user", "> a\nb"), (3, 0, "user", ""), (3, 0, "user", ""), (4, 1, "user", "x " * 50_000), (4, 2, "user", "> " + "x " * 50_000 + "\nok")]
    df = frame(spark, rows)
    got = chat.messages(df).collect()
    assert len(got) == 7 and {(r.turn, r.reply_to) for r in got if r.conv_id == 4} == {(1, None), (2, 1)}
    assert sum(r.n_messages for r in chat.conversations(chat.messages(df)).collect()) == 7
    assert chat.conversations(chat.messages(df.limit(0))).count() == 0
    plan = chat.conversations(chat.messages(df))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
