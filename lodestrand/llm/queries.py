"""Queries of the text problems (p7 to p9) over the test tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.operators.common import table

from .encode import encode_corpus
from .packing import pack, pack_with_report
from .quality import document_kinds, quality_statistics


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_corpus(table(spark, sf_dir, "documents"))


def p8_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), table(spark, sf_dir, "packing_specs"))


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per spec the number of containers, those fixed by dominance, the least number possible, and the share of their capacity that is used."""
    packed, report = pack_with_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "packing_specs"))
    held = packed.groupBy("spec_id", "container_id").agg(F.sum("n_tokens").alias("used"))
    whole = held.groupBy("spec_id").agg(F.count(F.lit(1)).alias("n_containers"), F.sum("used").alias("n_tokens"), F.max("used").alias("fullest"))
    return whole.join(report.drop("planned"), "spec_id").join(table(spark, sf_dir, "packing_specs").select("spec_id", "capacity"), "spec_id").withColumn("fill", F.col("n_tokens") / (F.col("n_containers") * F.col("capacity")))


def p9_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_kinds(quality_statistics(table(spark, sf_dir, "documents"), table(spark, sf_dir, "common_words")))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p9_statistics(spark, sf_dir).where("kind <> 'ruling'").select("doc_id", "kind")


QUERIES = {f.__name__: f for f in (p7_ids, p8_packed, p8_fill, p9_found, p9_statistics)}
SQL: dict[str, str] = {}
