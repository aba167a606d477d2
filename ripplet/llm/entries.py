"""The queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ripplet.llm import bpe, chat, exact_dedup, fingerprint, html, packing, pii, quality, secrets, simhash, toxicity, whitening
from ripplet.llm.common import read

Query = Callable[[SparkSession, str], DataFrame]


def op1_quartile_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprint_edits(read(spark, sf_dir, "documents"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(read(spark, sf_dir, "documents"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(read(spark, sf_dir, "documents"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_report(read(spark, sf_dir, "documents"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, read(spark, sf_dir, "labels")))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(read(spark, sf_dir, "pages"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(read(spark, sf_dir, "documents"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read(spark, sf_dir, "embeddings"))


def op12_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digests(chat.format_turns(chat.with_planted(read(spark, sf_dir, "conversations"))))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_quartile_digest, op2_exact_dedup, op3_bpe, op4_pii, op5_simhash, op6_toxicity, op7_quality, op8_packing, op9_html, op10_secrets, op11_whitening, op12_chat)}


def oracle_sql() -> dict[str, str]:
    return {"op2_exact_dedup": exact_dedup.ORACLE, "op12_chat": chat.ORACLE}
