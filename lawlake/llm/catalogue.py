"""Queries of the problems of training text, over their whole tables, and the SQL of those it can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lawlake.llm import bpe, markup, packing, sentence_align, splitting
from lawlake.session import read


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return markup.found(spark, read(spark, d, "bodies"), read(spark, d, "acquired_documents"))


def p1_clean_text(spark: SparkSession, d: str) -> DataFrame:
    return markup.clean_texts(spark, read(spark, d, "bodies"), read(spark, d, "acquired_documents"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return sentence_align.found(spark, read(spark, d, "bodies"), read(spark, d, "body_sentences"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode(read(spark, d, "documents"))


def p9_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(packing.document_items(read(spark, d, "documents")))


def p10_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split(read(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_clean_text, p3_found, p8_ids, p9_containers, p10_pieces)}
SQL: dict[str, str] = {}
