"""Merging what several providers say about one fact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# From most to least directly observed.
DIRECTNESS = ("declared", "resolved", "inferred", "unresolved")


def directness(c: Column) -> Column:
    """3 for declared down to 0 for unresolved."""
    return F.lit(len(DIRECTNESS)) - F.array_position(F.array(*map(F.lit, DIRECTNESS)), c).cast("int")


def canonical(payload: Column) -> Column:
    """A payload map<string,string> as JSON text with sorted keys."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(payload))), {"ignoreNullFields": "false"})


def merge_facts(contributions: DataFrame) -> DataFrame:
    """One record per (kind, key) of contributions(kind, key, provider_id, resolution_class, payload map): the most directly observed
    payload wins, by canonical JSON among equals, never by provider. All providers are attributed; every field of a losing
    payload that differs (absent is not null) is kept as a conflict with its value and providers. Partial aggregation on (kind, key,
    payload) first, so a fact that all providers state costs one row a task."""
    variants = contributions.withColumn("text", canonical(F.col("payload"))).groupBy("kind", "key", "text").agg(
        F.max(directness(F.col("resolution_class"))).alias("rank"), F.first("payload").alias("payload"), F.collect_set("provider_id").alias("providers")
    )
    one = F.struct((-F.col("rank")).alias("neg"), "text", F.map_entries("payload").alias("fields"), "providers")
    facts = variants.groupBy("kind", "key").agg(F.array_sort(F.collect_list(one)).alias("v"))
    win = F.map_from_entries(F.col("v")[0]["fields"])
    differs = lambda e, m: ~F.map_contains_key(m, e["key"]) | ~F.try_element_at(m, e["key"]).eqNullSafe(e["value"])
    losing = F.flatten(F.transform(F.slice("v", 2, F.size("v")), lambda x: F.transform(F.filter(x["fields"], lambda e: differs(e, F.col("winner"))), lambda e: F.struct(e["key"].alias("field"), e["value"].alias("value"), F.array_sort(x["providers"]).alias("providers")))))
    tie = (F.size("v") > 1) & (F.col("v")[0]["neg"] == F.try_element_at("v", F.lit(2))["neg"])
    out = facts.withColumn("winner", win).select(
        "kind", "key", F.col("winner").alias("payload"), (-F.col("v")[0]["neg"]).alias("rank"),
        F.array_sort(F.array_distinct(F.flatten(F.transform("v", lambda x: x["providers"])))).alias("attributions"), losing.alias("conflicts"),
        F.when(F.size("v") == 1, "agreed").when(tie, "disagree at equal directness").otherwise("most directly observed").alias("precedence_reason"),
    )
    return out.withColumn("resolution_class", F.array(*map(F.lit, reversed(DIRECTNESS)))[F.col("rank")]).drop("rank")


def merge_evidence(items: DataFrame) -> DataFrame:
    """(key, text, collectors, conflicts): the text of the first collector in order stays, other texts are kept as conflicts.
    items(key, text, collector_id, collector_order)."""
    g = items.groupBy("key").agg(F.min_by("text", F.struct("collector_order", "text")).alias("text"), F.array_sort(F.collect_set("collector_id")).alias("collectors"), F.collect_set("text").alias("all"))
    return g.select("key", "text", "collectors", F.array_sort(F.array_except("all", F.array("text"))).alias("conflicts"))


def summarize_capabilities(records: DataFrame, gaps: DataFrame, declarations: DataFrame) -> DataFrame:
    """(provider_id, kind, outcome, records): a gap means absent, else the declared partial or full gives partial or supplied; a kind
    nobody mentions has no row. records, gaps(provider_id, kind), declarations(provider_id, kind, level)."""
    key = ["provider_id", "kind"]
    counts = records.groupBy(*key).agg(F.count("*").alias("n"))
    said = gaps.select(*key, F.lit(0).alias("order"), F.lit("absent").alias("outcome")).unionByName(declarations.select(*key, F.lit(1).alias("order"), F.when(F.col("level") == "full", "supplied").otherwise("partial").alias("outcome")))
    first = said.groupBy(*key).agg(F.min_by("outcome", "order").alias("outcome"))
    return first.join(counts, key, "left").select(*key, "outcome", F.coalesce("n", F.lit(0)).alias("records"))


def detect_collisions(claims: DataFrame, id_col: str, *parts: str) -> DataFrame:
    """Ids that more than one distinct tuple of parts claims, with the tuples."""
    return claims.groupBy(id_col).agg(F.array_sort(F.collect_set(F.struct(*parts))).alias("claims")).where(F.size("claims") > 1)


def contributing_providers(evidence: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(evidence, lambda e: e["provider_id"])))


def fullest_declaration(candidates: DataFrame) -> DataFrame:
    """Of the candidates(table_name, ordinal, columns, ...) for a table that with most columns, the first seen among equals."""
    best = F.max_by(F.struct(*candidates.columns), F.struct(F.size("columns"), -F.col("ordinal")))
    return candidates.groupBy(F.col("table_name").alias("k")).agg(best.alias("c")).select("c.*")
