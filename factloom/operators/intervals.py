"""Interval joins: the symbol around a fact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _innermost(facts: DataFrame, ranges: DataFrame, fact_key: str, best: Column) -> DataFrame:
    """(fact_key, symbol_id): of the ranges of the same root and path that hold the line, the least by best."""
    inside = (F.col("f.line") >= F.col("r.start_line")) & (F.col("f.line") <= F.col("r.end_line"))
    held = facts.alias("f").join(ranges.alias("r"), (F.col("f.root_name") == F.col("r.root_name")) & (F.col("f.rel_path") == F.col("r.rel_path")) & inside)
    return held.groupBy(F.col(f"f.{fact_key}").alias(fact_key)).agg(F.min_by("r.symbol_id", best).alias("symbol_id"))


def attach_enclosing(facts: DataFrame, symbols: DataFrame, fact_key: str) -> DataFrame:
    """facts with symbol_id: where it is null (or the column missing), the symbol with the shortest span around the line."""
    span = F.struct(F.col("r.end_line") - F.col("r.start_line"), F.col("r.start_line"), F.col("r.symbol_id"))
    found = _innermost(facts, symbols.where("start_line is not null"), fact_key, span).withColumnRenamed("symbol_id", "found_id")
    both = facts.join(found, fact_key, "left")
    return both.withColumn("symbol_id", F.coalesce("symbol_id", "found_id") if "symbol_id" in facts.columns else F.col("found_id")).drop("found_id")


def innermost_callable(sinks: DataFrame, nodes: DataFrame, sink_key: str) -> DataFrame:
    """(sink_key, symbol_id): latest start, then tightest end, then id."""
    return _innermost(sinks, nodes, sink_key, F.struct(-F.col("r.start_line"), F.col("r.end_line"), F.col("r.symbol_id")))
