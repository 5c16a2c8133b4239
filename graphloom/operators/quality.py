"""Gates over results: verdicts, matrices, rates, calibration, domains, differences (all extensions)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.quantities import dimension, in_base_units
from ..sources.documents import part


def verdicts(checks: DataFrame) -> DataFrame:
    """(report_id, verdict, n) from checks (report_id, outcome, mandatory).

    fail if a check failed, or a mandatory one was skipped; else warning if one warned; else pass.
    not_applicable counts for nothing; a report of only such checks is not_applicable.
    """
    outcome = F.col("outcome")
    bad = F.bool_or((outcome == "fail") | ((outcome == "skipped") & F.coalesce("mandatory", F.lit(False))))
    told = F.bool_or(outcome != "not_applicable")
    verdict = F.when(bad, "fail").when(F.bool_or(outcome == "warning"), "warning").when(told, "pass").otherwise("not_applicable")
    return checks.groupBy("report_id").agg(verdict.alias("verdict"), F.count("*").alias("n"))


def matrix(results: DataFrame, dimensions: list[str], passed: Column) -> DataFrame:
    """Counts and passes over every combination of the dimensions and their totals (null: all), with a level number."""
    by = results.cube(*dimensions).agg(F.count("*").alias("n"), F.count_if(passed).alias("passed"), F.grouping_id().cast("long").alias("level"))
    return by


def latencies(runs: DataFrame, by: list[str], value: str) -> DataFrame:
    """Exact median and 95th percentile of a measure by group."""
    return runs.groupBy(*by).agg(F.percentile(value, F.lit(0.5)).alias("p50"), F.percentile(value, F.lit(0.95)).alias("p95"), F.count("*").alias("n"))


def calibration_error(predictions: DataFrame, bins: int = 10) -> DataFrame:
    """(ece, n): the expected calibration error of (confidence from 0 to 1, correct boolean) over equal bins."""
    at = F.least(F.floor(F.col("confidence") * bins), F.lit(bins - 1))
    by = predictions.groupBy(at.alias("bin")).agg(F.count("*").alias("m"), F.avg("confidence").alias("c"), F.avg(F.col("correct").cast("double")).alias("a"))
    return by.agg((F.sum(F.col("m") * F.abs(F.col("c") - F.col("a"))) / F.sum("m")).alias("ece"), F.sum("m").alias("n"))


def recall_at(ranked: DataFrame, k: int) -> DataFrame:
    """(n, hits): queries, and those with a relevant candidate among their first k (query_id, identity, score, relevant)."""
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "identity"))
    by = ranked.withColumn("place", place).groupBy("query_id").agg(F.bool_or((F.col("place") <= k) & F.col("relevant")).alias("hit"))
    return by.agg(F.count("*").alias("n"), F.count_if("hit").alias("hits"))


def out_of_domain(parsed: DataFrame) -> DataFrame:
    """(doc_id, model, name, value, low, high) of parameters outside their min or max, in base units.

    Bounds of another dimension than the value's, and values that are no literals, are not compared.
    """
    nodes = part(parsed, "nodes").where("first and kind = 'parameter' and value is not null")
    bound = lambda key: F.when(dimension(F.try_element_at("attributes", F.lit(key))).eqNullSafe(dimension(F.col("value"))), in_base_units(F.try_element_at("attributes", F.lit(key))))
    rows = nodes.select("doc_id", "model", "name", in_base_units(F.col("value")).alias("value"), bound("min").alias("low"), bound("max").alias("high"))
    return rows.where((F.col("value") < F.col("low")) | (F.col("value") > F.col("high")))


def differences(left: DataFrame, right: DataFrame, key: list[str], value: str, tolerance: float) -> DataFrame:
    """(key, left, right) where two backends' values differ by more than the tolerance, or one has none."""
    a, b = left.select(*key, F.col(value).alias("left")), right.select(*key, F.col(value).alias("right"))
    apart = F.col("left").isNull() | F.col("right").isNull() | (F.abs(F.col("left") - F.col("right")) > tolerance)
    return a.join(b, key, "full_outer").where(apart & ~(F.col("left").isNull() & F.col("right").isNull()))


def too_large(documents: DataFrame, most_chars: int) -> DataFrame:
    """(doc_id, n_chars) of source texts over a limit, to be kept from parsing."""
    return documents.select("doc_id", F.length("source_text").alias("n_chars")).where(F.col("n_chars") > most_chars)


def too_many_nodes(parsed: DataFrame, most_nodes: int) -> DataFrame:
    """(doc_id, n_nodes) of documents with more nodes, at any depth, than a limit."""
    return parsed.select("doc_id", F.size("nodes").alias("n_nodes")).where(F.col("n_nodes") > most_nodes)
