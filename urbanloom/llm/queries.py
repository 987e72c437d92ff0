"""Queries of the operators on texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urbanloom.llm.addresses import places, same_place_pairs
from urbanloom.llm.leaks import leaks, matches, without_leaks
from urbanloom.llm.quality import classify, text_statistics
from urbanloom.llm.tokenizer import encode
from urbanloom.session import table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of address rows that denote the same place."""
    return same_place_pairs(table(spark, sf_dir, "address"))


def p2_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of each address row that denotes one."""
    return places(table(spark, sf_dir, "address"))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document by byte_bpe_50k."""
    return encode(table(spark, sf_dir, "documents"), "doc_id", "text")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of an evaluation text, and these texts."""
    return leaks(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "eval_item"), "item_id", "text")


def p9_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each passage's longest verbatim run stands in the document and in the evaluation text, and its length in words."""
    return matches(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "eval_item"), "item_id", "text")


def p9_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of the documents that hold no passage of an evaluation text."""
    return without_leaks(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", p9_found(spark, sf_dir))


def p10_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of every document that isn't blank."""
    return text_statistics(table(spark, sf_dir, "documents"), "doc_id", "text")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that aren't prose, and what they are."""
    return classify(table(spark, sf_dir, "documents"), "doc_id", "text").filter(F.col("kind") != "prose").select("doc_id", "kind").distinct()


QUERIES = {"p2_found": p2_found, "p2_places": p2_places, "p8_ids": p8_ids, "p9_found": p9_found, "p9_matches": p9_matches, "p9_clean": p9_clean, "p10_found": p10_found, "p10_stats": p10_stats}
SQL: dict[str, str] = {}
