"""From raw documents to packed training sequences: toxicity, line deduplication, near duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. A stage
that changes texts also sets n_chars anew, where docs has that column. A stage deletes what the stage before it left in the
shared folder, except what its own docs still read.

Defined results: a document is a row's (doc_id, text), so rows that share an id but not the text are documents of their own, null
ids as well; rows that repeat both are exact copies, and the near-duplicate stage keeps one of them. Of a group the document
with the smallest doc_id stays (null first, then by text hash). Rows with null or empty texts pass every stage, each of them, and are packed as
documents of the closing id alone. Very long texts are worked on whole. Extra columns, whatever their names, are kept up to the
last stage; names that begin with two underscores are the stages' own. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from tessellon.llm import bpe, language_id, line_dedup, ngram_join, packing, pii, toxicity
from tessellon.llm.scratch import made, materialize, release

#: The tables that the stage before has left in the shared folder.
_LEFT: list[str] = []


def _stage(f: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage that first deletes what the one before it left, but what its docs read."""

    @wraps(f)
    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(spark, docs, only=_LEFT)
        before = set(made())
        out = f(spark, docs, sf_dir)
        _LEFT[:] = [t for t in made() if t not in before or t in _LEFT]
        return out

    return stage


def _sized(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


@_stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents scored at the threshold or above go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    known = ~language_id.held_out(3, 1)
    model = toxicity.fit(docs.select("doc_id", "text").filter(known), labels.filter(known))
    scored = toxicity.score(docs, model, keep=True).filter(F.col("__toxic_score") < toxicity.THRESHOLD)
    return materialize(scored.drop("__toxic_score"), "clean")


@_stage
def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: later copies of repeated line runs go; a document of which nothing is left goes as a whole."""
    out = line_dedup.dedup_lines(docs).filter((F.col("__n_removed") == 0) | (F.col("__n_removed") < F.col("__n_lines")))
    return _sized(out.drop("__n_lines", "__n_removed"))


def _once(docs: DataFrame) -> DataFrame:
    """One row of each __key; of rows that differ in other columns, the one with the least hash. Copies meet before the shuffle."""
    names = [c for c in docs.columns if c != "__key"]
    hashed = [f.name for f in docs.schema if f.name != "__key" and not isinstance(f.dataType, MapType)]
    row = F.struct(*[F.col(f"`{c}`") for c in names])
    return docs.groupBy("__key").agg(F.min_by(row, F.xxhash64(*[f"`{c}`" for c in hashed])).alias("__row")).select("__key", "__row.*")


@_stage
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2, five words and a similarity of 0.8: of each group the document with the smallest id stays.

    The operator's documents are (doc_id, text), told by a 64-bit hash of both. Only rows of groups are shuffled with their texts.
    """
    keyed = docs.withColumn("__key", F.xxhash64("doc_id", "text"))
    groups = materialize(ngram_join.join_components(keyed, k=5, percent=80, id_col="__key"), "groups")
    some = groups.filter("n_shingles > 0").groupBy("__key").agg(F.first("component_id").alias("component"), F.count("*").alias("n"))
    some = materialize(some, "documents")
    ids = keyed.select("__key", "doc_id").distinct()
    mixed = materialize(some.groupBy("component").agg(F.count("*").alias("size")).filter("size > 1").select("component"), "mixed")
    ranked = materialize(some.join(mixed, "component", "left_semi").join(ids, "__key").select("component", F.struct(F.col("doc_id").isNotNull(), "doc_id", "__key").alias("place"), "__key"), "ranked")
    first = materialize(ranked.groupBy("component").agg(F.min("place").alias("first")), "first")
    losers = materialize(ranked.join(first, "component").filter("place <> first").select("__key"), "losers")
    kept = ngram_join.without(keyed, losers, "__key")
    again = materialize(some.filter("n > 1").select("__key"), "again")
    if not again.isEmpty():
        rest = ngram_join.without(kept, again, "__key")
        kept = rest.unionByName(_once(kept.join(again.join(losers, "__key", "left_anti"), "__key", "left_semi")))
    return kept.select(*docs.columns)


@_stage
def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: every span of personal data becomes its kind in angle brackets."""
    return materialize(_sized(pii.redact(docs)), "redacted")


@_stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: pieces of at most 2048 tokens in as few sequences as it can."""
    return packing.pack_documents(docs, bpe.read_ranks(public_tokenizers.path("word_bpe_49k.json")))


STAGES = [("toxicity", drop_toxic), ("line_dedup", dedup_lines), ("ngram_join", drop_near_copies), ("pii", redact), ("packing", pack)]
#: SQL can express neither the trained stages nor the tokenizer; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
        _LEFT.extend(t for t in made()[-1:])
    return STAGES[-1][1](spark, docs, sf_dir)
