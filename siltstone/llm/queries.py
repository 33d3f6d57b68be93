"""Queries of the training-data operators, and the SQL that checks those SQL can express."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siltstone.llm import encodings, leakage, main_body, near_duplicates, packing, repeated_lines, residue

#: Vocabulary file of the queries; set the variable to another on a cluster.
TOKENIZER = os.environ.get("SILTSTONE_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    results = _table(spark, folder, "crawl_results")
    return near_duplicates.class_pairs(near_duplicates.near_duplicate_classes(results, main_body.fit_on(results)))


def p1_classes(spark: SparkSession, folder: str) -> DataFrame:
    """Class and number of links of each result."""
    results = _table(spark, folder, "crawl_results")
    return near_duplicates.near_duplicate_classes(results, main_body.fit_on(results))


def p2_text(spark: SparkSession, folder: str) -> DataFrame:
    """Main body of each page as text."""
    results = _table(spark, folder, "crawl_results")
    return main_body.body_text(results, main_body.fit_on(results))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    results = _table(spark, folder, "crawl_results")
    return main_body.main_body(results, main_body.fit_on(results))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return repeated_lines.repeated_lines(_table(spark, folder, "crawl_results"))


def p3_cleaned(spark: SparkSession, folder: str) -> DataFrame:
    """Text of each page without the lines repeated on its site."""
    results = _table(spark, folder, "crawl_results")
    return repeated_lines.without_repeated_lines(results, repeated_lines.repeated_lines(results))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    results = _table(spark, folder, "crawl_results")
    models, shown = residue.fit_and_show(results)
    return residue.residue_shown(shown, models, _table(spark, folder, "content_quality"))


def p6_containers(spark: SparkSession, folder: str) -> DataFrame:
    sizes = packing.token_sizes(_table(spark, folder, "documents"), TOKENIZER)
    return packing.pack(sizes, _table(spark, folder, "pack_sizes"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return leakage.leaked_items(_table(spark, folder, "documents"), _table(spark, folder, "eval_items"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    documents = _table(spark, folder, "documents")
    return encodings.garbled(documents, encodings.fit_models_on(documents))


def p8_restored(spark: SparkSession, folder: str) -> DataFrame:
    documents = _table(spark, folder, "documents")
    return encodings.restore(documents, encodings.fit_models_on(documents))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_classes, p2_found, p2_text, p3_found, p3_cleaned, p5_found, p6_containers, p7_found, p8_found, p8_restored)}


def _runs(table: str, key: str, text: str) -> str:
    """SQL: all runs of 13 words of a table's texts."""
    return f"(SELECT DISTINCT {key}, unnest(list_transform(range(1, len(w) - 11), lambda i: array_to_string(w[i:i + 12], ' '))) AS run FROM (SELECT {key}, regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}]+') AS w FROM {table}))"


def oracle_sql() -> dict[str, str]:
    return {"p7_found": f"SELECT DISTINCT doc_id, item_id FROM {_runs('documents', 'doc_id', 'text')} JOIN {_runs('eval_items', 'item_id', 'passage')} USING (run)"}
