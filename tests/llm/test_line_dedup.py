import random

from tessellon.llm import line_dedup, queries
from tests.llm.fixtures import awkward, table


def brute(rows, min_words):
    """A line goes if a run of min_words words around it begins earlier too."""
    docs = sorted({(i is not None, i or 0, t, i) for i, t in rows if t is not None}, key=lambda r: r[:2])
    lines = [t.split("\n") for *_, t, _ in docs]
    first, gone = {}, set()
    for d, ls in enumerate(lines):
        for s in range(len(ls)):
            for e in range(s + 1, len(ls) + 1):
                if sum(len(x.split()) for x in ls[s:e]) >= min_words:
                    run = tuple(ls[s:e])
                    if run in first:
                        gone |= {(d, n) for n in range(s, e)}
                    else:
                        first[run] = (d, s)
    return {(i, t): "\n".join(x for n, x in enumerate(ls) if (d, n) not in gone) for d, ((*_, t, i), ls) in enumerate(zip(docs, lines, strict=True))}


def compare(df, rows, min_words):
    want = brute(rows, min_words)
    got = line_dedup.dedup_lines(df, min_words)
    out = sorted((str(r.doc_id), str(r.text)) for r in got.collect())
    assert out == sorted((str(i), str(want.get((i, t)))) for i, t in rows)


def test_random_runs(spark):
    rnd = random.Random(8)
    for min_words in (3, 7):
        rows = []
        for i in range(60):
            ls = [rnd.choice(["a", "b b", "c c c", "", "d", "e e e e e e e", f"u{rnd.random()}"]) for _ in range(rnd.randint(1, 25))]
            if rows and rnd.random() < 0.5:
                old = rnd.choice(rows)[1].split("\n")
                at = rnd.randrange(len(old))
                ls[1:1] = old[at : at + rnd.randint(1, 12)]
            rows.append((i, "\n".join(ls)))
        compare(spark.createDataFrame(rows, "doc_id long, text string"), rows, min_words)


def test_query(spark):
    rows = table(columns="doc_id, text")
    want = brute(rows, 50)
    got = {r.doc_id: r for r in queries.op8_line_dedup(spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == len(rows) == len(want)
    assert all(got[i].text == x for (i, _), x in want.items())


def test_a_document_of_very_many_lines(spark):
    lines = [f"line {i} has its words" for i in range(30_000)]
    rows = [(1, "\n".join(lines)), (2, "\n".join(["head", *lines[100:20_000], "tail"])), (3, "x")]
    got = {r.doc_id: r for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].text == rows[0][1] and got[2].text == "head\ntail" and got[2]["__n_removed"] == 19_900


def test_the_bitmap_has_no_false_negatives(spark):
    keys = spark.range(2000).selectExpr("id * 977 AS a", "-id AS b")
    asked = spark.range(40_000).selectExpr("id * 977 AS a", "-id AS b")
    n = asked.filter(line_dedup.may_be_among(keys, ["a", "b"])).count()
    assert 2000 <= n < 3000
    assert keys.filter(~line_dedup.may_be_among(keys, ["a", "b"])).count() == 0
    assert asked.filter(line_dedup.may_be_among(keys.limit(0), ["a", "b"])).count() == 0


def test_main_path_is_native(spark):
    plan = line_dedup.dedup_lines(spark.createDataFrame([(1, "a")], "doc_id long, text string"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_awkward(spark):
    run = "\n".join(["many words stand here now"] * 3 + ["and more of them come after"] * 2)
    rows = [(1, None), (2, ""), (3, "\n\n"), (None, run), (4, "x\n" + run), (4, "x\n" + run), (5, run + "\n" + run), (6, "word " * 30_000), (7, "same\n" * 3_000)]
    df = awkward(spark, rows)
    got = {r.doc_id: r for r in line_dedup.dedup_lines(df, 9).collect() if r.doc_id is not None}
    assert got[1].text is None and got[2].text == "" and got[3].text == "\n\n"
    assert got[4].text == "x" and got[4]["__n_removed"] == 5 and got[5].text == ""
    assert got[6].text == "word " * 30_000 and got[7]["__n_removed"] == 2999
    out = line_dedup.dedup_lines(df, 9)
    assert out.columns == [*df.columns, "__n_lines", "__n_removed"] and out.count() == len(rows)
    assert line_dedup.dedup_lines(df.limit(0), 9).count() == 0
