"""The queries of this subpackage, with production parameters, over whole tables.

Those that send whole texts through Python and return a few columns store these at once, in batches of bounded bytes
(scratch.small_batches), so that the session keeps its own setting.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellon.llm import bpe, chat, fingerprint, language_id, line_dedup, ngram_join, packing, pii, topk, toxicity
from tessellon.llm.scratch import materialize


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = language_id.held_out(4, 2)
    model = language_id.fit(docs.filter(~out))
    return materialize(language_id.predict(docs, model).select("doc_id", out.alias("held_out"), "lang_pred", "score", "margin", "ambiguous"), "languages")


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join_components(_table(spark, sf_dir, "documents"), k=3, percent=90)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(_table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    count = lambda k: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == k))).cast("long").alias(f"n_{k}")
    digest = found.select(
        "doc_id", *[count(k) for k in pii.BASE], F.sha2(pii.joined(base), 256).alias("base_sha256"), pii.joined(F.col("spans")).alias("spans"), (F.size("spans") - F.size(base)).cast("long").alias("n_added")
    )
    return materialize(digest, "spans")


def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20, scale=64.0)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = bpe.read_ranks(public_tokenizers.path("word_bpe_49k.json"))
    return packing.pack_documents(_table(spark, sf_dir, "documents"), spec)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (_table(spark, sf_dir, t) for t in ("documents", "labels"))
    out = language_id.held_out(3, 1)
    model = toxicity.fit(docs.select("doc_id", "text").filter(~out), labels.select("doc_id", "toxic").filter(~out))
    scored = toxicity.score(docs, model).withColumn("held_out", out)
    return materialize(scored.select("doc_id", "held_out", "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted")), "toxicity")


def op7_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.with_next(_table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.withColumnsRenamed({"__n_lines": "n_lines", "__n_removed": "n_removed"})


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.conversations(chat.messages(_table(spark, sf_dir, "conversations")))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    out = bpe.encode(_table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, decoded=True)
    return materialize(out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")), "digests")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_ngram_join": op2_ngram_join,
    "op3_pii": op3_pii,
    "op4_exact_top_k": op4_exact_top_k,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_toxicity": op6_toxicity,
    "op7_fingerprint": op7_fingerprint,
    "op8_line_dedup": op8_line_dedup,
    "op9_chat_formatting": op9_chat_formatting,
    "op10_byte_bpe": op10_byte_bpe,
}
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_NGRAM_ORACLE = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^ \\t\\n\\x0B\\f\\r]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 2], ' ') AS sh FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 90 * (a.n + b.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.y FROM r JOIN l ON l.x = r.b),
m AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.component_id FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN m ON m.a = d.doc_id
"""
ORACLES: dict[str, str] = {"op2_ngram_join": _NGRAM_ORACLE, "op4_exact_top_k": topk.ORACLE, "op8_line_dedup": line_dedup.ORACLE, "op9_chat_formatting": chat.ORACLE}
