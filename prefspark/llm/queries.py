"""One query per operator over its whole table, with DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prefspark.llm import chat, extract, hmm, jaccard, langid, lexical, merkle, mixing, packing, pii, quality, search, sharding
from prefspark.llm.common import table
from prefspark.llm.sql import ORACLE  # noqa: F401

Query = Callable[[SparkSession, str], DataFrame]


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                                  with_ids=False)


def op2_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_classes(table(spark, sf_dir, "documents"))


def op3_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.uniform_shuffle(table(spark, sf_dir, "documents").select("doc_id", "text"), 40)
    text = F.coalesce("text", F.lit(""))
    return out.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"),
                      F.crc32(text).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))


def op4_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.top_k(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 50 == 0)


def op5_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score_documents(table(spark, sf_dir, "documents"))


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_preferences(chat.last_turn_swapped(table(spark, sf_dir, "conversations")))


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    part = F.crc32(F.col("doc_id").cast("string")) % 3
    samples = langid.learning_sample(docs, part != 1)
    out = langid.identify(docs.select("doc_id", "text"), samples)
    return out.select("doc_id", F.coalesce(part == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix_plan(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    out = quality.quality_rules(docs, carry_text=False)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                      "base_failed", "kept", "source", "host_docs", "host_failed")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents"))

    def of(kind):
        return F.filter("pii", lambda s: s["kind"] == kind)

    base = F.filter("pii", lambda s: s["kind"].isin(*pii.BASE))
    return found.select("doc_id", *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in pii.BASE],
                        F.sha2(pii.listed(base), 256).alias("base_sha256"), pii.listed(F.col("pii")).alias("spans"))


def op11_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lexical.ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumnRenamed("query_id", "item_id")


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.tampered_manifest(table(spark, sf_dir, "documents"))


def op13_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return extract.main_texts(pages.select("page_id", "url", "html"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Query] = {
    "op1_pack": op1_pack,
    "op2_jaccard": op2_jaccard,
    "op3_shard": op3_shard,
    "op4_search": op4_search,
    "op5_hmm": op5_hmm,
    "op6_chat": op6_chat,
    "op7_langid": op7_langid,
    "op8_mix": op8_mix,
    "op9_quality": op9_quality,
    "op10_pii": op10_pii,
    "op11_search": op11_search,
    "op12_merkle": op12_merkle,
    "op13_extract": op13_extract,
    "pipeline": pipeline,
}
