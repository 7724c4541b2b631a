from types import SimpleNamespace

import pytest

from tessellon.llm import queries, scratch

KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def test_the_session_has_its_own_batches_again(spark):
    own = spark.conf.get(KEY)
    with scratch.small_batches(spark):
        assert spark.conf.get(KEY) == str(scratch.BATCH)
    assert spark.conf.get(KEY) == own
    spark.conf.set(KEY, "1m")
    with scratch.small_batches(spark):
        assert spark.conf.get(KEY) == "1m"
    with pytest.raises(ZeroDivisionError), scratch.small_batches(spark, 5):
        1 / 0
    assert spark.conf.get(KEY) == "1m"
    spark.conf.set(KEY, own)
    queries.op10_byte_bpe(spark, "/root/testdata/sf0.001")
    assert spark.conf.get(KEY) == own


def test_a_cluster_must_name_its_shared_folder():
    conf = SimpleNamespace(get=lambda key, default=None: default)
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]", "k8s://x"):
        with pytest.raises(RuntimeError):
            scratch.root(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master)))
    named = SimpleNamespace(get=lambda key, default=None: "viewfs://store/x/")
    assert scratch.root(SimpleNamespace(conf=named, sparkContext=None)) == "viewfs://store/x"


def test_tables_that_are_read_stay(spark):
    before = scratch.made()
    a, b, c = (scratch.materialize(spark.range(i + 1), f"t{i}") for i in range(3))
    scratch.release_since(spark, before, a.join(c, "id"))
    assert len(scratch.made()) == len(before) + 2 and a.count() == 1 and c.count() == 3
    with pytest.raises(Exception):
        b.count()
    scratch.release_since(spark, before)
    assert scratch.made() == before
