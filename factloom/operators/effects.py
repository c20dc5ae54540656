"""Boundaries, side effects and values of behaviour."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import fact_id
from ..functions.names import name_tokens, spaced
from .graphs import reverse_reach

# What a condition that checks a caller contains, the words of a mechanism that does, and those of a set of rights.
AUTH_HINTS = ("auth", "jwt", "token", "session", "passport", "permission", "guard")
AUTHN_TOKENS = ("auth", "authn", "authenticate", "authenticated", "authentication", "login", "session", "token", "jwt", "identity", "principal", "user")
ACCESS_TOKENS = ("role", "roles", "permission", "permissions", "scope", "scopes", "grant", "privilege", "authority", "acl")


def looks_like_auth(text: Column, hints: tuple[str, ...] = AUTH_HINTS) -> Column:
    """Whether a condition contains one of the hints, anywhere."""
    return F.lower(text).rlike("|".join(hints))


def auth_check_of(mechanism: Column, requirement: Column) -> Column:
    """authorization where something is required beyond being known, authentication where a whole word of the mechanism says so, else unresolved."""
    named = F.arrays_overlap(F.split(F.lower(spaced(F.coalesce(mechanism, F.lit("")))), "[^a-z0-9]+"), F.array(*map(F.lit, AUTHN_TOKENS)))
    return F.when(F.coalesce(requirement, F.lit("")) != "", "authorization").when(named, "authentication").otherwise("unresolved")


def value_set_facts(sets: DataFrame) -> DataFrame:
    return sets.select(fact_id("behavioral", "value-set", "root_name", "name").alias("fact_id"), F.lit("value-set").alias("kind"), F.size("members").alias("members"))


def rule_facts(rules: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(facts, relations): rules(rule_id, root_name, meanings, value_set_name) with confidence low unexplained, high named, else medium; each related to its set, that of the same root
    first, else the first by root of that name."""
    n = F.size("meanings")
    facts = rules.select("rule_id", F.when(n == 0, "low").when(F.col("value_set_name").isNotNull(), "high").otherwise("medium").alias("confidence"))
    own = sets.select(F.col("root_name").alias("o_root"), F.col("name").alias("o_name")).distinct()
    any_ = sets.groupBy(F.col("name").alias("a_name")).agg(F.min("root_name").alias("a_root"))
    both = rules.where("value_set_name is not null").join(own, (F.col("root_name") == F.col("o_root")) & (F.col("value_set_name") == F.col("o_name")), "left").join(any_, F.col("value_set_name") == F.col("a_name"), "left")
    root = F.coalesce("o_root", "a_root")
    return facts, both.where(root.isNotNull()).select("rule_id", root.alias("set_root"), F.col("value_set_name").alias("set_name"))


def decision_facts(decisions: DataFrame, branches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(facts, relations) of decisions(decision_id, root_name, rel_path, start_line, end_line, subject, truncated) and their branches(decision_id, branch_idx, branch_line, test,
    outcome) (B3): a decision without branches goes; every branch is a condition of its own, named under its decision, guarded where it leaves, and the relation
    decision-branch joins both with the outcome as role."""
    place = ("root_name", "rel_path", "start_line", "end_line")
    both = decisions.join(branches, "decision_id").select(*place, "subject", "branch_idx", "branch_line", "test", "outcome")
    # rows are told apart by the columns of their ids, before these long texts are made; a missing text is an empty one there
    made = both.select(*(F.coalesce(c.name, F.lit("")).alias(c.name) if c.dataType.simpleString() == "string" and c.name != "outcome" else c.name for c in both.schema)).distinct()
    of = fact_id("behavioral", "decision", *place, "subject")
    branch = fact_id("behavioral", "condition", *place, "branch_idx", "branch_line", "test")
    leaves = F.when(F.col("outcome") == "leaves", "guarded").otherwise("conditional")
    facts = made.select(*place, "subject").distinct().select(of.alias("fact_id"), F.lit("decision").alias("kind"), F.lit("conditional").alias("activation")).unionByName(made.select(branch.alias("fact_id"), F.lit("condition").alias("kind"), leaves.alias("activation")))
    return facts, made.select(of.alias("from_id"), branch.alias("to_id"), F.lit("decision-branch").alias("relation"), F.col("outcome").alias("role"))


def promote_guards(guards: DataFrame) -> DataFrame:
    """Guards(root_name, test, message, rejects, rel_path, start_line) that reject with a stated message, as validation rules."""
    g = guards.where(F.col("rejects") & (F.coalesce("message", F.lit("")) != ""))
    return g.select(fact_id("behavioral", "validation-rule", "root_name", "test", "message", "rel_path", "start_line").alias("fact_id"), "root_name", F.col("test").alias("expression"), F.col("message").alias("stated"))


def side_effect_facts(access: DataFrame, calls: DataFrame, packages: DataFrame, notifications: DataFrame) -> DataFrame:
    """(fact_id, effect, target): data access(root_name, entity, operation), outbound calls(root_name, target, to_root), external packages(root_name, package, member) and
    notifications(root_name, mechanism), once each; an unresolved link stays with its target as written."""
    return (
        access.select(fact_id("behavioral", "side-effect", F.lit("data"), "root_name", "entity", "operation").alias("fact_id"), F.concat(F.lit("data-"), "operation").alias("effect"), F.col("entity").alias("target"))
        .unionByName(calls.select(fact_id("behavioral", "side-effect", F.lit("call"), "root_name", "target").alias("fact_id"), F.when(F.col("to_root").isNull(), "unresolved-call").otherwise("service-call").alias("effect"), F.coalesce("to_root", "target").alias("target")))
        .unionByName(packages.select(fact_id("behavioral", "side-effect", F.lit("package"), "root_name", "package", "member").alias("fact_id"), F.lit("external-package").alias("effect"), F.col("package").alias("target")))
        .unionByName(notifications.select(fact_id("behavioral", "side-effect", F.lit("notify"), "root_name", "mechanism").alias("fact_id"), F.lit("notification").alias("effect"), F.col("mechanism").alias("target")))
        .dropDuplicates(["fact_id"])
    )


def located_effects(access: DataFrame, transactions: DataFrame, calls: DataFrame, packages: DataFrame, notifications: DataFrame) -> DataFrame:
    """(fact_id, kind, scope, symbol_id, category, target, detail, link): every side effect at its place, a row an id (B7). All five have root_name, rel_path, start_line, start_column;
    access(symbol_id, entity, operation, mechanism), transactions(symbol_id, mechanism, propagation), calls(symbol_id, outbound_kind, method, target, base_identifier),
    packages(symbol_id, package_name, member_name), notifications(channel, mechanism). Two effects on one line differ by column. Data access without an entity and calls without a target are
    unresolved; calls of packages are outbound calls of a category of their own. Rows of one id count once, the least of them by scope and symbol, so repeated reads and any order of rows
    give the same. Null places are "?"; an empty table adds nothing."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    place = F.concat_ws(":", text("rel_path"), *(F.coalesce(F.col(c).cast("string"), F.lit("?")) for c in ("start_line", "start_column")))
    null = F.lit(None).cast("string")
    resolved = lambda c: F.when(F.col(c).isNull(), "unresolved").otherwise("resolved")

    def row(df: DataFrame, kind: str, parts: list[Column], symbol: Column, category: Column, target: Column, detail: Column, link: Column) -> DataFrame:
        scope = F.when(symbol.isNull(), "module").otherwise("symbol")
        named = {"scope": scope, "symbol_id": symbol, "category": category, "target": target, "detail": detail, "link": link}
        return df.select(fact_id("behavioral", kind, "root_name", place, *parts).alias("fact_id"), F.lit(kind).alias("kind"), *(c.cast("string").alias(k) for k, c in named.items()))

    symbol, member = F.col("symbol_id"), F.concat_ws(".", "package_name", "member_name")
    rows = (
        row(access, "data-access", [text("operation"), text("mechanism"), text("entity")], symbol, null, F.col("entity"), F.col("operation"), resolved("entity"))
        .unionByName(row(transactions, "transaction-boundary", [text("mechanism"), text("propagation")], symbol, null, F.col("mechanism"), F.col("propagation"), null))
        .unionByName(row(calls, "outbound-call", [F.lit("service"), text("outbound_kind"), text("method"), F.coalesce("target", "base_identifier", F.lit(""))], symbol, F.lit("service"), F.col("target"), F.col("base_identifier"), resolved("target")))
        .unionByName(row(packages, "outbound-call", [F.lit("external-package"), text("package_name"), text("member_name")], symbol, F.lit("external-package"), member, F.col("package_name"), F.lit("resolved")))
        .unionByName(row(notifications, "notification-call", [text("channel"), text("mechanism")], null, null, F.col("mechanism"), F.col("channel"), null))
    )
    rest = [c for c in rows.columns if c != "fact_id"]
    return rows.groupBy("fact_id").agg(F.min(F.struct(*rest)).alias("f")).select("fact_id", "f.*")


def observe_authorization(references: DataFrame, sets: DataFrame) -> DataFrame:
    """(root_name, member, rel_path, start_line): members of sets named for access control in a check. references(root_name, member, context, rel_path, start_line),
    sets(root_name, name, members)."""
    named = sets.where(F.arrays_overlap(name_tokens(F.col("name")), F.array(*map(F.lit, ACCESS_TOKENS))))
    members = named.select("root_name", F.explode("members.name").alias("member")).distinct()
    return references.where("context = 'check'").join(members, ["root_name", "member"], "left_semi").select("root_name", "member", "rel_path", "start_line").distinct()


def observe_state_changes(references: DataFrame, state_members: DataFrame) -> DataFrame:
    """(root_name, to_state, rel_path, start_line): writes of members of state sets(root_name, member) in their own root, once a place."""
    return references.where("context = 'write'").join(state_members.select("root_name", "member").distinct(), ["root_name", "member"], "left_semi").select("root_name", F.col("member").alias("to_state"), "rel_path", "start_line").distinct()


def outbound_reach(sinks: DataFrame, edges: DataFrame, max_hops: int = 2, max_fan_in: int = 32) -> DataFrame:
    """(sink, node, hops): reverse_reach without the sinks themselves, one row per function and sink."""
    return reverse_reach(sinks, edges, max_hops, max_fan_in).where("hops > 0").groupBy("sink", "node").agg(F.min("hops").alias("hops"))


def scope_graph(nodes: DataFrame, edges: DataFrame, prefix: str) -> tuple[DataFrame, DataFrame]:
    """The nodes(id, file_path) under prefix/ with it stripped, and the edges(caller_id, callee_id) that start there."""
    p = prefix.rstrip("/") + "/"
    inside = nodes.where(F.col("file_path").startswith(p)).withColumn("file_path", F.substring("file_path", len(p) + 1, 1_000_000))
    return inside, edges.join(inside.select(F.col("id").alias("caller_id")), "caller_id", "left_semi")
