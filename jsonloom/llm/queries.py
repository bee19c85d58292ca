"""The pN_ queries of the problems with text, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jsonloom.llm.leakage import leaked_passages
from jsonloom.llm.mixture import mixture, mixture_shares, sized, source_rates
from jsonloom.llm.subjects import areas_of_own, fit_own, read_own_text
from jsonloom.session import stage, table


# 6 - evaluation texts in the corpus


def p6_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Every leak with its extent, also passages with a replaced word."""
    return leaked_passages(table(spark, d, "documents"), table(spark, d, "eval_item"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_leaks(spark, d).where("exact_words >= 12").select("item_id", "doc_id")


def p6_items(spark: SparkSession, d: str) -> DataFrame:
    """The test items that leaked, with the number of messages and the longest passage."""
    return p6_leaks(spark, d).groupBy("item_id").agg(F.count(F.lit(1)).alias("messages"), F.max("near_words").alias("longest"))


# 7 - mixing sources


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    rates = source_rates(sized(table(spark, d, "documents")), table(spark, d, "mix_target"))
    return rates.where("not reachable").select("source")


def _mixed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    documents = stage(sized(table(spark, d, "documents")), "sizes")
    rates = stage(source_rates(documents, table(spark, d, "mix_target")), "rates")
    return mixture(documents, rates), rates


def p7_mixture(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d)[0].select("doc_id", "source", "n_tokens", "copy")


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixture_shares(*_mixed(spark, d))


# 8 - subject areas


def p8_areas(spark: SparkSession, d: str) -> DataFrame:
    own = read_own_text(table(spark, d, "documents"), table(spark, d, "subject_label"), table(spark, d, "subject_area"))
    return areas_of_own(own, fit_own(own))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_areas(spark, d).select("doc_id", "subject_area").distinct()


def p8_composition(spark: SparkSession, d: str) -> DataFrame:
    """Messages and paragraphs by area."""
    return p8_areas(spark, d).groupBy("subject_area").agg(F.countDistinct("doc_id").alias("messages"), F.sum("paragraphs").alias("paragraphs"))


QUERIES = {f.__name__: f for f in (p6_found, p6_leaks, p6_items, p7_found, p7_mixture, p7_shares, p8_found, p8_areas, p8_composition)}
SQL: dict[str, str] = {}
