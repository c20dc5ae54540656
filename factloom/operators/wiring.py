"""Small steps between the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import extension
from .effects import auth_check_of
from .graphs import build_traces

# Fixed values.
GAP_KINDS = {"entities": "entity", "fields": "entity-field", "relations": "entity-relation", "constraints": "entity-constraint"}


def data_model_records(fields: DataFrame, relations: DataFrame, constraints: DataFrame) -> DataFrame:
    """(kind, root_name, entity, name): a data model as structural records."""
    row = lambda df, kind, entity, name: df.select(F.lit(kind).alias("kind"), "root_name", F.col(entity).alias("entity"), F.col(name).alias("name"))
    entities = fields.select("root_name", "entity").distinct().withColumn("name", F.col("entity"))
    return row(entities, "entity", "entity", "name").unionByName(row(fields, "entity-field", "entity", "name")).unionByName(row(relations, "entity-relation", "from", "to")).unionByName(row(constraints, "entity-constraint", "entity", "expression"))


def gap_kind(c: Column) -> Column:
    """The record kind under which a data model's gap is filed; an unknown one under entity."""
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in GAP_KINDS.items() for x in kv)), c), F.lit("entity"))


def retained_values(records: DataFrame, field: str) -> DataFrame:
    """(kind, key, kept, lost): a field's winning value beside those that lost. records as merge_facts gives them."""
    lost = F.transform(F.filter("conflicts", lambda c: c["field"] == field), lambda c: c["value"])
    return records.select("kind", "key", F.try_element_at("payload", F.lit(field)).alias("kept"), F.array_sort(lost).alias("lost"))


def boundary_facts(auth: DataFrame, validations: DataFrame, handlers: DataFrame, discarded: DataFrame) -> DataFrame:
    """(boundary, root_name, detail), once each: auth(root_name, mechanism, requirement) with its check, validations(root_name, rule), handlers(root_name, handles array) sorted or
    catch-all, discarded(root_name, call)."""
    handled = F.when(F.size("handles") == 0, "catch-all").otherwise(F.array_join(F.array_sort("handles"), ","))
    row = lambda df, name, detail: df.select(F.lit(name).alias("boundary"), "root_name", detail.alias("detail"))
    return (
        row(auth, "auth", F.concat_ws(":", auth_check_of(F.col("mechanism"), F.col("requirement")), "mechanism")).unionByName(row(validations, "validation", F.col("rule")))
        .unionByName(row(handlers, "error-handling", handled)).unionByName(row(discarded, "discarded-error", F.col("call"))).distinct()
    )


def behavior_input(parts: dict[str, DataFrame]) -> DataFrame:
    """All behaviour facts (fact_id, kind, source, source_rank) of the named parts, in the order given: what assemble_behavior takes."""
    out = None
    for rank, (name, df) in enumerate(parts.items()):
        one = df.select("fact_id", "kind", F.lit(name).alias("source"), F.lit(rank).alias("source_rank"))
        out = one if out is None else out.unionByName(one)
    return out


def gather_entities(fields: DataFrame) -> DataFrame:
    """(entity, columns map root -> sorted columns) of fields(root_name, entity, name)."""
    per = fields.groupBy("entity", "root_name").agg(F.array_sort(F.collect_set("name")).alias("columns"))
    return per.groupBy("entity").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("root_name", "columns")))).alias("columns"))


def drop_generated(records: DataFrame, files: DataFrame) -> DataFrame:
    """records(root_name, rel_path, ...) outside of generated files(root_name, rel_path, classification)."""
    return records.join(files.where("classification = 'generated'").select("root_name", "rel_path"), ["root_name", "rel_path"], "left_anti")


def module_facts(modules: DataFrame, routes: DataFrame, entities: DataFrame, evidence: DataFrame, k: int = 3) -> DataFrame:
    """(module_id, endpoints, entities, prose): of each module(module_id, root_name) its routes(module_id, path), the entities(root_name, name) of its roots and at most k lines of
    evidence(root_name, text). Names and lines are gathered once for each list of roots that some module has, and join last, so what is shuffled does not hold them once a module."""
    none = F.array().cast("array<string>")
    e = routes.groupBy("module_id").agg(F.array_sort(F.collect_set("path")).alias("endpoints"))
    per = entities.groupBy("root_name").agg(F.collect_set("name").alias("names"))
    prose = evidence.groupBy("root_name").agg(F.slice(F.array_sort(F.collect_set("text")), 1, k).alias("lines"))
    owned = modules.groupBy("module_id").agg(F.array_sort(F.collect_list("root_name")).alias("roots"))
    each = owned.select("roots").distinct().select("roots", F.explode_outer("roots").alias("root_name"))
    held = each.join(per, "root_name", "left").join(prose, "root_name", "left").groupBy("roots").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("names")))).alias("entities"), F.flatten(F.array_sort(F.collect_list("lines"))).alias("prose"))
    return owned.join(e, "module_id", "left").join(held, "roots").select("module_id", F.coalesce("endpoints", none).alias("endpoints"), "entities", "prose")


def module_targets(modules: DataFrame, calls: DataFrame, files: DataFrame) -> DataFrame:
    """(module_id, target, n): what the roots of each of modules(module_id, root_name) call outside, with the number of places, a row a target (J27). calls(root_name, rel_path, start_line,
    target) in generated files(root_name, rel_path, classification) are left out (D20), a place counts once, and calls without a target for nothing. Places are counted by root and target
    before modules join, so a root with most of the calls sends a row a target."""
    places = drop_generated(calls.where("target is not null").select("root_name", "rel_path", "start_line", "target"), files).distinct()
    per = places.groupBy("root_name", "target").agg(F.count("*").alias("n"))
    return modules.select("module_id", "root_name").distinct().join(per, "root_name").groupBy("module_id", "target").agg(F.sum("n").alias("n"))


def accounting(links: DataFrame, calls: DataFrame) -> DataFrame:
    """(considered, linked, unlinked, sums): whether linked and unlinked add up to the calls."""
    c = calls.agg(F.count("*").alias("considered"))
    o = links.agg(F.count_if(F.col("outcome") == "linked").alias("linked"), F.count_if(F.col("outcome") != "linked").alias("unlinked"))
    return c.crossJoin(F.broadcast(o)).withColumn("sums", F.col("considered") == F.col("linked") + F.col("unlinked"))


def parse_strict(texts: DataFrame, schema: str) -> DataFrame:
    """(report_id, value, fault): JSON documents of texts(report_id, text) read by a schema; what does not parse as one keeps a fault and no value."""
    value = F.from_json("text", schema + ", __bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"})
    read = texts.select("report_id", value.alias("v"))
    bad = F.col("v").isNull() | F.col("v.__bad").isNotNull()
    return read.select("report_id", F.when(~bad, F.col("v").dropFields("__bad")).alias("value"), F.when(bad, "not the expected JSON").alias("fault"))


def build_entry_traces(entries: DataFrame, symbols: DataFrame, call_edges: DataFrame, type_edges: DataFrame, **bounds: int) -> DataFrame:
    """build_traces over calls and type relations together, with traceability: the share of symbols that the entry reaches, in percent."""
    total = symbols.select("id").distinct().agg(F.count("*").alias("total"))
    t = build_traces(entries, symbols, call_edges.unionByName(type_edges), **bounds).crossJoin(F.broadcast(total))
    return t.select("entry_id", "steps", "truncation", F.floor(100 * F.size("steps") / F.col("total") + 0.5).cast("long").alias("traceability"))


def languages_without(files: DataFrame, supported: tuple[str, ...]) -> DataFrame:
    """(root_name, language): file extensions of a root that no collector supports, as gaps."""
    return files.select("root_name", extension(F.col("rel_path")).alias("language")).where(~F.col("language").isin(*supported) & (F.col("language") != "")).distinct()
