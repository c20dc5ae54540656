"""Behaviour facts and their validation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import fact_id
from .graphs import cut, nodes_on_cycles


def condition_facts(conditions: DataFrame) -> DataFrame:
    """(fact_id, kind, scope, activation): scope symbol inside a function, else module; guarded conditions are conditional."""
    return conditions.select(
        fact_id("behavioral", "condition", "root_name", "subject", "operator", F.col("literal").cast("string"), "rel_path", "start_line").alias("fact_id"), F.lit("condition").alias("kind"),
        F.when(F.col("enclosing_function").isNull(), "module").otherwise("symbol").alias("scope"), F.when(F.coalesce("guarded", F.lit(False)), "conditional").otherwise("active").alias("activation"),
    )


def guard_facts(guards: DataFrame) -> DataFrame:
    """(fact_id, kind, scope, activation, message, error_code) of guards(root_name, rel_path, start_line, test, message_kind, message, enclosing_function): a stated message is
    the rule in the code's words, an error code names a sentence that stands elsewhere."""
    return guards.select(
        fact_id("behavioral", "guard", "root_name", "rel_path", "start_line", "test", "message_kind", "message").alias("fact_id"), F.lit("guard").alias("kind"),
        F.when(F.coalesce("enclosing_function", F.lit("")) == "", "module").otherwise("symbol").alias("scope"), F.lit("guarded").alias("activation"),
        F.when(F.col("message_kind") == "stated", F.col("message")).alias("message"), F.when(F.col("message_kind") == "error-code", F.col("message")).alias("error_code"),
    )


def state_facts(members: DataFrame, compared: DataFrame) -> DataFrame:
    """(root_name, set_name, member): the members(root_name, set_name, member, value) that some comparison(root_name, set_name, value) names."""
    return members.join(compared.select("root_name", "set_name", "value").distinct(), ["root_name", "set_name", "value"], "left_semi").select("root_name", "set_name", "member").distinct()


def transition_facts(changes: DataFrame, states: DataFrame) -> DataFrame:
    """(subject, from_state, to_state, times, diagnostic): changes(subject, from_state, to_state) between states(state). An unknown target is a diagnostic
    alone, an unknown start leaves a to-only transition with one; duplicates collapse."""
    known = lambda name: states.select(F.col("state").alias(name)).distinct().withColumn(f"k_{name}", F.lit(True))
    both = changes.join(known("from_state"), "from_state", "left").join(known("to_state"), "to_state", "left")
    start, end = F.col("k_from_state").isNotNull(), F.col("k_to_state").isNotNull()
    note = F.when(~end, "target is no state").when(~start, "start is no state")
    return both.groupBy("subject", F.when(start, F.col("from_state")).alias("from_state"), F.when(end, F.col("to_state")).alias("to_state"), note.alias("diagnostic")).agg(F.count("*").alias("times"))


def test_relations(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """(test_id, target_id, status): the distinct calls of tests(is_test) to what is no test; tests without any are unknown. symbols(id, is_test), edges(caller_id,
    callee_id)."""
    tests = cut(symbols.where("is_test").select("id").distinct())
    calls = edges.select(F.col("caller_id").alias("test_id"), F.col("callee_id").alias("target_id")).join(tests.withColumnRenamed("id", "test_id"), "test_id", "left_semi").distinct()
    calls = cut(calls.join(tests.withColumnRenamed("id", "target_id"), "target_id", "left_anti").select("test_id", "target_id"))
    bare = tests.join(calls.select(F.col("test_id").alias("id")), "id", "left_anti").select(F.col("id").alias("test_id"), F.lit(None).cast("string").alias("target_id"), F.lit("unknown").alias("status"))
    return calls.withColumn("status", F.when(F.col("target_id").isNull(), "unresolved").otherwise("covered")).unionByName(bare)


def test_facts(relations: DataFrame, symbols: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(facts, receipt) of relations(root_name, test_id, target_id, target_name, relation) (B8): one fact per identity, in which a named target is kept
    apart from a symbol of the same spelling; a relation without a symbol is unresolved. The receipt (root_name, coverage) says covered only for
    roots(root_name) of which symbols(root_name) has any, else not-run."""
    bound = F.col("target_id").isNotNull()
    target = F.coalesce("target_id", "target_name", F.lit(""))
    facts = relations.select(
        fact_id("behavioral", "test-relation", "root_name", "test_id", F.when(bound, "sym").otherwise("name"), target, "relation").alias("fact_id"), F.lit("test-relation").alias("kind"),
        "root_name", "test_id", target.alias("target"), "relation", F.when(bound, "resolved").otherwise("unresolved").alias("link"),
    ).distinct()
    ran = symbols.select("root_name", F.lit("covered").alias("coverage")).distinct()
    return facts, roots.select("root_name").distinct().join(ran, "root_name", "left").select("root_name", F.coalesce("coverage", F.lit("not-run")).alias("coverage"))


def assemble_behavior(facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(facts, diagnostics) of facts(fact_id, source_rank, ...): the first source wins per id; ids that several sources state are diagnosed."""
    rest = [c for c in facts.columns if c != "fact_id"]
    best = facts.groupBy("fact_id").agg(F.min(F.struct("source_rank", *(c for c in rest if c != "source_rank"))).alias("f"), F.countDistinct("source_rank").alias("sources"))
    return best.select("fact_id", *(F.col(f"f.{c}").alias(c) for c in rest)), best.where("sources > 1").select("fact_id", F.lit("stated by several sources").alias("diagnostic"))


def validate_behavior(facts: DataFrame, relations: DataFrame, kinds: dict[str, tuple[str, ...]]) -> DataFrame:
    """(fact_id, reason): every violation. facts(fact_id, kind, evidence int), relations(relation, from_id, to_id); kinds gives the relations' legal
    (from kind, to kind). Unknown kinds are quarantined, not dropped."""
    known = sorted({k for pair in kinds.values() for k in pair})
    ids = facts.select("fact_id", "kind").distinct()
    legal = F.array(*(F.concat_ws(">", F.lit(r), F.lit(a), F.lit(b)) for r, (a, b) in kinds.items()))
    ends = relations.join(ids.select(F.col("fact_id").alias("from_id"), F.col("kind").alias("fk")), "from_id", "left").join(ids.select(F.col("fact_id").alias("to_id"), F.col("kind").alias("tk")), "to_id", "left")
    fits = F.array_contains(legal, F.concat_ws(">", "relation", "fk", "tk"))
    cycle = nodes_on_cycles(relations.select(F.col("from_id").alias("src"), F.col("to_id").alias("dst")))
    return (
        facts.groupBy("fact_id").agg(F.count("*").alias("n")).where("n > 1").select("fact_id", F.lit("id is not unique").alias("reason"))
        .unionByName(facts.where("coalesce(evidence, 0) < 1").select("fact_id", F.lit("no evidence").alias("reason")))
        .unionByName(facts.where(~F.col("kind").isin(*known)).select("fact_id", F.lit("quarantined: unknown kind").alias("reason")))
        .unionByName(ends.where("fk is null or tk is null").select(F.col("from_id").alias("fact_id"), F.lit("relation to nothing").alias("reason")))
        .unionByName(ends.where(F.col("fk").isNotNull() & F.col("tk").isNotNull() & ~fits).select(F.col("from_id").alias("fact_id"), F.lit("relation between wrong kinds").alias("reason")))
        .unionByName(cycle.select(F.col("node").alias("fact_id"), F.lit("on a cycle").alias("reason")))
        .distinct()
    )


def validate_ownership(owners: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(kind, problem): kinds with several owners, without one, or that the vocabulary does not know. owners(owner, kind), vocabulary(kind)."""
    n = owners.groupBy("kind").agg(F.countDistinct("owner").alias("n"))
    both = n.join(vocabulary.select("kind", F.lit(True).alias("known")).distinct(), "kind", "full")
    problem = F.when(F.col("known").isNull(), "unknown kind").when(F.col("n").isNull(), "no owner").when(F.col("n") > 1, "several owners")
    return both.withColumn("problem", problem).where("problem is not null").select("kind", "problem")


def capability_for(wanted: DataFrame, declared: DataFrame) -> DataFrame:
    """(kind, language, level): the exact language's declaration before that of *; null where none is declared."""
    exact = declared.where("language <> '*'").select("kind", "language", F.col("level").alias("exact"))
    star = declared.where("language = '*'").select("kind", F.col("level").alias("star"))
    return wanted.join(exact, ["kind", "language"], "left").join(star, "kind", "left").select("kind", "language", F.coalesce("exact", "star").alias("level"))
