"""Constraints on a behaviour model, all in one grouped pass (V1), and on sentinels (V5).

Every fact and both ends of every relation become a row under a fact's id; one aggregate counts what each id has, and every rule is a condition on these
counts. So a new rule is a line in a table and no further scan; only cycles need a walk of their own.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .behavior import nodes_on_cycles

# Fixed values.
KINDS = (
    "condition", "decision", "guard", "discarded-error", "error-handling", "value-set", "business-rule", "validation-rule", "state", "transition", "outbound-call", "data-access", "notification-call", "transaction-boundary",
    "auth-annotation", "test-relation",
)
SCOPES = ("symbol", "module", "entity", "root", "cross-root")
ACTIVATIONS = ("always", "conditional", "guarded", "scheduled", "unknown")
CONFIDENCES = ("high", "medium", "low")
#: Relation kind: the kinds that it may start from and end at (none: any). Where it leaves the family its end may be no fact.
RELATIONS = {"decision-branch": (("decision",), ()), "transition-endpoint": (("transition",), ("state",)), "rule-valueset": (("business-rule",), ("value-set",)), "guard-subject": (("guard", "validation-rule"), ())}
CROSS_FAMILY, ACYCLIC = ("guard-subject",), ("decision-branch", "rule-valueset", "guard-subject")
SENTINEL_KINDS = ("positive", "negative", "clean-absence")


def provenance_fault(e: Column) -> Column:
    """Whether an evidence struct(resolution_class, confidence, unresolved_reason, rel_path) contradicts itself: a declared fact has neither confidence nor reason, a resolved one
    no reason, an inferred one a confidence and no reason, an unresolved one a reason and no confidence; each has a place."""
    held, told, known = e["confidence"].isNotNull(), e["unresolved_reason"].isNotNull(), F.coalesce(e["confidence"].isin(*CONFIDENCES), F.lit(False))
    legal = (
        F.when(e["resolution_class"] == "declared", ~held & ~told).when(e["resolution_class"] == "resolved", ~told & (~held | known)).when(e["resolution_class"] == "inferred", ~told & known)
        .when(e["resolution_class"] == "unresolved", ~held & (F.coalesce(e["unresolved_reason"], F.lit("")) != "")).otherwise(False)
    )
    return ~legal | e["rel_path"].isNull()


def _count(condition: Column) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False)))


def validate_model(facts: DataFrame, relations: DataFrame) -> DataFrame:
    """(fact_id, code, quarantined) of every rule that a fact or relation breaks; one row an id and rule. facts(fact_id, family, kind, scope, activation, evidence array of
    struct(resolution_class, confidence, unresolved_reason, rel_path)), relations(kind, from_id, to_id, role). A kind outside of the vocabulary is quarantined: it keeps its
    scope and activation, its evidence is judged."""
    side, end = F.col("side"), F.col("relation")
    own = facts.select(
        "fact_id", F.lit("fact").alias("side"), F.col("kind").alias("fact_kind"), F.lit(None).cast("string").alias("relation"), F.lit(None).cast("string").alias("role"), F.coalesce(F.col("family") != "behavioral", F.lit(True)).alias("foreign"),
        (F.coalesce(F.size("evidence"), F.lit(0)) < 1).alias("bare"), F.coalesce(F.exists("evidence", provenance_fault), F.lit(False)).alias("faulty"),
        F.coalesce(~F.col("scope").isin(*SCOPES), F.lit(True)).alias("odd_scope"), F.coalesce(~F.col("activation").isin(*ACTIVATIONS), F.lit(True)).alias("odd_activation"),
    )
    of = lambda c, name: relations.select(F.col(c).alias("fact_id"), F.lit(name).alias("side"), F.col("kind").alias("relation"), "role")
    rows = own.unionByName(of("from_id", "from"), allowMissingColumns=True).unionByName(of("to_id", "to"), allowMissingColumns=True)
    counts = {"facts": side == "fact", "foreign": F.col("foreign"), "bare": F.col("bare"), "faulty": F.col("faulty"), "odd_scope": F.col("odd_scope"), "odd_activation": F.col("odd_activation"), "outs": side == "from", "ins": (side == "to") & ~end.isin(*CROSS_FAMILY)}
    counts |= {"no_role": (side == "from") & (F.coalesce("role", F.lit("")) == ""), "odd_role": (side == "from") & (end == "transition-endpoint") & ~F.coalesce("role", F.lit("")).isin("from-state", "to-state")}
    counts |= {f"{s} {r}": (side == s) & (end == r) for r in RELATIONS for s in ("from", "to")} | {r: (side == "from") & (end == "transition-endpoint") & (F.col("role") == r) for r in ("from-state", "to-state")}
    by_id = rows.groupBy("fact_id").agg(F.max("fact_kind").alias("kind"), *(_count(c).alias(name) for name, c in counts.items()))
    has, known = lambda name: F.col(f"`{name}`") > 0, F.coalesce(F.col("kind").isin(*KINDS), F.lit(False))
    is_ = lambda *kinds: F.coalesce(F.col("kind").isin(*kinds), F.lit(False))
    rules: dict[str, Column] = {
        "duplicate-id": F.col("facts") > 1, "wrong-family": has("foreign"), "no-evidence": has("bare"), "bad-provenance": has("faulty"), "unknown-kind": has("facts") & ~known, "illegal-scope": known & has("odd_scope"),
        "illegal-activation": known & has("odd_activation"), "from-unknown-fact": has("outs") & ~has("facts"), "to-unknown-fact": has("ins") & ~has("facts"), "no-role": has("no_role"), "wrong-role": has("odd_role"),
        "transition-states": is_("transition") & ((F.col("to-state") != 1) | (F.col("from-state") > 1)), "no-branch": is_("decision") & ~has("from decision-branch"),
    }
    for r, (starts, ends) in RELATIONS.items():
        rules |= {f"{r} {s}": has(f"{s} {r}") & ~is_(*kinds) for s, kinds in (("from", starts), ("to", ends)) if kinds}
    broken = F.array_compact(F.array(*(F.when(c, F.lit(code)) for code, c in rules.items())))
    found = by_id.select("fact_id", F.explode(broken).alias("code"))
    cycles = nodes_on_cycles(relations.where(F.col("kind").isin(*ACYCLIC)).select(F.col("from_id").alias("src"), F.col("to_id").alias("dst")))
    return found.unionByName(cycles.select(F.col("node").alias("fact_id"), F.lit("on-a-cycle").alias("code"))).withColumn("quarantined", F.col("code") == "unknown-kind")


def validate_sentinels(items: DataFrame) -> DataFrame:
    """(ledger, id, code) of rules that sentinels(ledger, id, kind, expected_status, criticality, must_find, prevents, no_dedicated_reader, evidence array of paths) break; those of a whole ledger
    have no id: both a positive and a negative one, and one for a root without a reader."""
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    n = F.count("*").over(Window.partitionBy("ledger", "id"))
    rules = {
        "duplicate-id": n > 1, "unknown-kind": F.coalesce(~F.col("kind").isin(*SENTINEL_KINDS), F.lit(True)), "no-evidence": F.coalesce(F.size("evidence"), F.lit(0)) < 1, "evidence-without-path": F.coalesce(F.exists("evidence", lambda p: F.coalesce(p, F.lit("")) == ""), F.lit(False)),
        "clean-absence-expects-absent": (F.col("kind") == "clean-absence") & F.coalesce(F.col("expected_status") != "absent", F.lit(True)), "critical-not-must-find": (F.col("criticality") == "critical") & ~F.coalesce("must_find", F.lit(False)), "prevents-nothing": empty("prevents"),
    }
    single = items.withColumn("codes", F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(code)) for code, c in rules.items())))).select("ledger", "id", F.explode("codes").alias("code")).distinct()
    whole = {"no-positive": F.col("kind") == "positive", "no-negative": F.col("kind") == "negative", "no-root-without-reader": F.coalesce("no_dedicated_reader", F.lit(False))}
    ledger = items.groupBy("ledger").agg(F.array_compact(F.array(*(F.when(~F.coalesce(F.bool_or(c), F.lit(False)), F.lit(code)) for code, c in whole.items()))).alias("codes"))
    return single.unionByName(ledger.select("ledger", F.lit(None).cast(items.schema["id"].dataType).alias("id"), F.explode("codes").alias("code")))


# Which kinds show a category of truth, and which categories are graded elsewhere.
LANES = {
    "state-set": ("state",), "transition": ("transition",), "rule": ("business-rule", "condition"), "balance": ("business-rule", "condition"), "approval-routing": ("decision", "transition", "condition"),
    "concurrency": ("transaction-boundary", "guard", "condition"), "permission": ("auth-annotation",), "validation": ("validation-rule",), "exception": ("error-handling", "discarded-error"), "activation": ("condition", "guard"),
    "test-relation": ("test-relation",), "notification": ("notification-call",), "side-effect": ("data-access", "outbound-call", "transaction-boundary"), "integration": ("outbound-call",),
}
OTHER_LANES = ("role", "object")


def folders_of(path: Column) -> Column:
    """A path itself, and every folder above it with a slash at its end."""
    parts = F.split(path, "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat(F.array_join(F.slice(parts, 1, i), "/"), F.lit("/")))
    return F.concat(F.array(path), F.slice(above, F.lit(1), F.size(parts) - 1))


def grade_truth(truth: DataFrame, locations: DataFrame, root: str, coverage: str = "not-run") -> DataFrame:
    """(id, category, criticality, must_find, status, reason) of truth(id, category, criticality, must_find, expects, evidence array of struct(root_name, path)) against
    locations(kind, root_name, rel_path) of facts.

    found where a fact of the category's kinds lies at a cited path or below a cited folder; an absence is found where none does, of any kind for a category of no
    lane, and absence of test relations only where their reader ran (coverage covered). unsupported: another lane's; unresolved: nothing cited in the root. Folders meet facts on equal keys, each
    fact's path with all folders above it, once a kind and folder."""
    lanes = F.create_map(*(x for c, kinds in LANES.items() for x in (F.lit(c), F.array(*map(F.lit, kinds)))))
    every = sorted({k for kinds in LANES.values() for k in kinds})
    absent, lane = F.col("expects") == "absent", F.try_element_at(lanes, F.col("category"))
    items = truth.withColumns({"cited": F.filter("evidence", lambda e: e["root_name"] == root), "lane": lane, "absent": F.coalesce(absent, F.lit(False))})
    items = items.withColumn("kinds", F.when(F.col("absent"), F.coalesce("lane", F.array(*map(F.lit, every)))).otherwise(F.col("lane")))
    keys = F.array_distinct(F.flatten(F.transform("cited", lambda e: F.when(e["path"].endswith("/"), F.array(e["path"])).otherwise(F.array(e["path"], F.concat(e["path"], F.lit("/")))))))
    asked = items.select("id", F.explode("kinds").alias("kind"), keys.alias("keys")).select("id", "kind", F.explode("keys").alias("key"))
    there = locations.where(F.col("root_name") == root).select("kind", F.explode(folders_of(F.col("rel_path"))).alias("key")).distinct()
    hits = asked.join(there, ["kind", "key"], "left_semi").select("id").distinct().withColumn("hit", F.lit(True))
    hit = F.col("hit").isNotNull()
    unsure = F.col("absent") & F.array_contains(F.coalesce("lane", F.array().cast("array<string>")), "test-relation") & F.lit(coverage != "covered")
    status = (
        F.when(F.col("category").isin(*OTHER_LANES), "unsupported").when(F.coalesce(F.size("cited"), F.lit(0)) < 1, "unresolved").when(F.col("absent"), F.when(~hit & ~unsure, "found").otherwise("not-found"))
        .when(F.col("lane").isNull(), "unsupported").when(hit, "found").otherwise("not-found")
    )
    reason = F.when(F.col("absent") & status.isin("found", "not-found"), F.when(unsure, "reader not run").when(hit, "unexpectedly present").otherwise("honestly absent"))
    return items.join(hits, "id", "left").select("id", "category", "criticality", "must_find", status.alias("status"), reason.alias("reason"))


def truth_gate(graded: DataFrame, ownership_disjoint: bool = True) -> DataFrame:
    """One row (total, found, not_found, unresolved, unsupported, must_find_total, must_find_found, critical_issues, denominator, passed) of grade_truth's rows."""
    s, must, within = F.col("status"), F.coalesce("must_find", F.lit(False)), F.col("status").isin("found", "not-found")
    return graded.agg(
        F.count("*").alias("total"), *(_count(s == x).alias(x.replace("-", "_")) for x in ("found", "not-found", "unresolved", "unsupported")), _count(within & must).alias("must_find_total"), _count((s == "found") & must).alias("must_find_found"),
        _count(within & (F.col("criticality") == "critical") & (s != "found")).alias("critical_issues"), _count(within).alias("denominator"),
    ).withColumn("passed", (F.col("must_find_found") == F.col("must_find_total")) & (F.col("critical_issues") == 0) & F.lit(ownership_disjoint))


# Fixed values.
COUNTED_KINDS = ("health-signal", "coverage-note", "feature", "module", "component", "structural-finding")


def payload_quantities(derived: DataFrame, kinds: tuple[str, ...] = COUNTED_KINDS) -> DataFrame:
    """(value, basis), distinct: what the payloads of derived(kind, payload) state, whatever their shape: lengths of their lists (basis list), their positive whole numbers (number), and
    every m of "n of m" and "n/m" in their text (share). Lists and numbers of the top level; a payload that is no JSON object or array has none."""
    some = derived.where(F.col("kind").isin(*kinds) & F.col("payload").isNotNull()).select("payload")
    held = some.select(F.try_parse_json("payload").alias("v")).where("v is not null")
    values = held.lateralJoin(held.sparkSession.tvf.variant_explode(F.col("v").outer())).select("value")
    shape, number = F.schema_of_variant("value"), F.try_variant_get("value", "$", "double")
    listed = values.where(shape.startswith("ARRAY")).select(F.size(F.try_variant_get("value", "$", "array<variant>")).cast("long").alias("value"), F.lit("list").alias("basis"))
    whole = values.where(shape.rlike("^(BIGINT|DECIMAL|DOUBLE)") & (number == F.floor(number))).select(number.cast("long").alias("value"), F.lit("number").alias("basis"))
    shares = some.select(F.explode(F.regexp_extract_all("payload", F.lit(r"(\d[\d,]*)\s*(?:/|of)\s*(\d[\d,]*)"), F.lit(2))).alias("m")).select(F.replace("m", F.lit(","), F.lit("")).try_cast("long").alias("value"), F.lit("share").alias("basis"))
    return reduce(DataFrame.unionByName, (listed, whole, shares)).where("value > 0").distinct()


def all_denominators(files: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """(value, basis), distinct: every quantity that the base justifies. files(root_name, rel_path, disposition): all, distinct paths, by disposition, root and both; tables (name to (kind, ...)): all of each and by
    kind; and the payloads of the table derived_records."""
    one = files.cube("root_name", "disposition").agg(F.count("*").alias("value")).select("value", F.lit("files").alias("basis"))
    paths = files.agg(F.countDistinct("rel_path").alias("value")).select("value", F.lit("paths").alias("basis"))
    rows = [t.rollup("kind").agg(F.count("*").alias("value")).select("value", F.lit(name).alias("basis")) for name, t in tables.items()]
    payloads = [payload_quantities(tables["derived_records"])] if "derived_records" in tables else []
    return reduce(DataFrame.unionByName, (one, paths, *rows, *payloads)).distinct()
