
import corpus_pipeline
from tessellon.llm import language_id, pii, scratch, toxicity
from tests.llm.fixtures import table
from tests.llm.test_line_dedup import brute as dedup
from tests.llm.test_ngram_join import brute as group
from tests.llm.test_packing import check

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "toxic")
    known = ~language_id.held_out(3, 1)
    model = toxicity.fit(docs.select("doc_id", "text").filter(known), labels.filter(known))
    rows = table(columns="doc_id, text")
    scores = model.score([t for _, t in rows])
    rows = [r for r, s in zip(rows, scores, strict=True) if s < 0.7]
    runs = dedup(rows, 50)
    rows = [(i, runs[i, t]) for i, t in rows if not (runs[i, t] == "" and t.split() and runs[i, t] != t)]
    comp, _ = group(rows, 5, 80)
    rows = [(i, t) for i, t in rows if comp[i] == i]
    rows = {i: pii.redacted(t, f) for (i, t), f in zip(rows, pii.spans([t for _, t in rows], pii.field()), strict=True)}

    packed = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in packed} == set(rows)
    n, least = check(packed, rows)
    assert n <= 1.1 * least + 1


def test_stages_keep_the_columns_and_awkward_rows(spark):
    rows = [(1, None), (2, ""), (2, ""), (3, "clean words here"), (3, "clean words here"), (4, "mail a@b.co now"), (None, "no id"), (None, "no id either"), (5, "word " * 30_000)]
    # An id on two texts: one belongs to a group and is not its smallest, the other to none.
    rows += [(6, "these seven words are the same twice"), (7, "these seven words are the same twice"), (7, "a text of its own that stays")]
    df = spark.createDataFrame([(i, t, "en", "s", 0, "x") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, _score string")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, SF)
        assert out.schema.names == df.columns
        df = spark.createDataFrame(out.collect(), out.schema)
    texts = sorted((r.doc_id or 0, r.text or "") for r in df.collect())
    assert [i for i, _ in texts] == [0, 0, 1, 2, 2, 3, 4, 5, 6, 7] and dict(texts)[4] == "mail <email> now"
    assert dict(texts)[7] == "a text of its own that stays"
    assert corpus_pipeline.pack(spark, df, SF).select("doc_id").distinct().count() == 8
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, df.limit(0), SF).count() == 0


def test_stages_delete_what_the_one_before_left(spark):
    mine = scratch.materialize(spark.range(3), "mine")
    docs, most = spark.read.parquet(f"{SF}/documents.parquet").limit(60), 0
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = scratch.materialize(stage(spark, docs, SF), name)
        most = max(most, len(corpus_pipeline._LEFT))
    assert docs.count() and mine.count() == 3 and most < 12
