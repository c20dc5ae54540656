"""Conditions as rules: values resolved to what the project calls them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import stable_json
from ..functions.names import field_token, name_tokens, readable_member, readable_subject

# Fixed values.
CLASSIFIER_WORDS = ("count", "type", "types", "kind", "code", "codes", "row", "rows", "value", "values", "flag", "flags", "num", "number", "id", "key", "name", "item", "items", "data", "info", "state")
COMPARATIVE = {"==": "is", "===": "is", "!=": "is not", "!==": "is not", "<>": "is not", ">": "is more than", ">=": "is at least", "<": "is less than", "<=": "is at most"}


def _scored(conditions: DataFrame, sets: DataFrame) -> DataFrame:
    """Conditions with every set whose name holds the field's word and agrees, with the score; joined on that word."""
    s = sets.withColumn("tokens", name_tokens(F.col("name"))).withColumn("token", F.explode(F.array_distinct("tokens")))
    c = conditions.withColumn("field", field_token(F.col("subject")))
    both = c.join(s.select("set_ord", F.col("root_name").alias("set_root"), F.col("name").alias("set_name"), "members", "tokens", "token"), F.col("field") == F.col("token"))
    subject = name_tokens(F.col("subject"))
    shared = F.size(F.filter("tokens", lambda t: F.array_contains(subject, t)))
    classifier = F.col("field").isin(*CLASSIFIER_WORDS)
    same = F.col("set_root") == F.col("root_name")
    score = 100 * shared - 25 * (F.size("tokens") - shared) + F.when(same, 1000).otherwise(0) - F.size("members")
    return both.withColumn("score", score).where(~(classifier & (shared < 2)) & (same | ~classifier))


def _best(scored: DataFrame, *more: str) -> DataFrame:
    return scored.groupBy("condition_id").agg(F.min_by(F.struct("set_name", "members", *more), F.struct(-F.col("score"), F.col("set_ord"))).alias("s"))


def _once(conditions: DataFrame, key: tuple[str, ...], answer: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """answer() for every condition, asked once for all that are alike in key, so that conditions never meet all sets of their word."""
    alike = stable_json(*key)
    out = answer(conditions.select(alike.alias("condition_id"), *key).distinct()).withColumnRenamed("condition_id", "alike")
    return conditions.select("condition_id", alike.alias("alike")).join(out, "alike").drop("alike")


def resolve_values(conditions: DataFrame, sets: DataFrame) -> DataFrame:
    """(condition_id, set_name, member): the best scored set that has the literal's value, first in set order among equals.
    conditions(condition_id, root_name, subject, operator, literal), one row an id, sets(set_ord, root_name, name, members array<struct<name,value>>)."""
    return _once(conditions, ("root_name", "subject", "literal"), lambda c: _resolve_values(c, sets))


def _resolve_values(conditions: DataFrame, sets: DataFrame) -> DataFrame:
    scored = _scored(conditions, sets).withColumn("hit", F.filter("members", lambda m: m["value"] == F.col("literal")))
    best = _best(scored.where(F.size("hit") > 0).withColumn("member", F.col("hit")[0]["name"]), "member")
    return best.select("condition_id", F.col("s.set_name").alias("set_name"), F.col("s.member").alias("member"))


def best_sets(conditions: DataFrame, sets: DataFrame) -> DataFrame:
    """(condition_id, set_name, members): the best scored set, whatever its values."""
    return _once(conditions, ("root_name", "subject"), lambda c: _best_sets(c, sets))


def _best_sets(conditions: DataFrame, sets: DataFrame) -> DataFrame:
    best = _best(_scored(conditions, sets))
    return best.select("condition_id", F.col("s.set_name").alias("set_name"), F.col("s.members").alias("members"))


def state_rules(conditions: DataFrame, sets: DataFrame) -> DataFrame:
    """(condition_id, statement, meanings, value_set_name): each condition in words. An ordered test against a value set names the
    members it admits, unless it admits all or none."""
    return _once(conditions, ("root_name", "subject", "operator", "literal"), lambda c: _state_rules(c, sets))


def _state_rules(conditions: DataFrame, sets: DataFrame) -> DataFrame:
    exact = resolve_values(conditions, sets).select("condition_id", F.col("set_name").alias("x_set"), "member")
    members = sets.select(F.col("name").alias("x_set"), F.col("members").alias("x_members")).dropDuplicates(["x_set"])
    near = best_sets(conditions, sets).select("condition_id", F.col("set_name").alias("n_set"), F.col("members").alias("n_members"))
    c = conditions.join(exact, "condition_id", "left").join(members, "x_set", "left").join(near, "condition_id", "left")
    c = c.withColumns({"set_name": F.coalesce("x_set", "n_set"), "all": F.when(F.col("x_set").isNotNull(), F.col("x_members")).otherwise(F.col("n_members"))})
    subject, words = readable_subject(F.col("subject")), F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in COMPARATIVE.items() for x in kv)), F.col("operator")), F.col("operator"))
    lit = F.col("literal")
    passes = lambda m: F.when(F.col("operator") == ">", m["value"] > lit).when(F.col("operator") == ">=", m["value"] >= lit).when(F.col("operator") == "<", m["value"] < lit).otherwise(m["value"] <= lit)
    admitted = F.transform(F.filter("all", passes), lambda m: readable_member(m["name"], F.col("set_name")))
    ordered = F.col("operator").isin(">", ">=", "<", "<=") & F.col("set_name").isNotNull()
    some = ordered & (F.size(admitted) > 0) & (F.size(admitted) < F.size("all"))
    named = readable_member(F.col("member"), F.col("x_set"))
    meanings = F.when(some, admitted).when(~ordered & F.col("member").isNotNull(), F.array(named)).otherwise(F.array().cast("array<string>"))
    statement = F.when(some, F.concat_ws(" ", subject, F.lit("is"), F.array_join(admitted, " or "))).when(~ordered & F.col("member").isNotNull(), F.concat_ws(" ", subject, words, named)).otherwise(F.concat_ws(" ", subject, words, lit.cast("string")))
    return c.select("condition_id", statement.alias("statement"), meanings.alias("meanings"), F.when(F.size(meanings) > 0, F.col("set_name")).alias("value_set_name"))


def is_unexplained(meanings: Column) -> Column:
    return F.size(meanings) == 0
