"""Keys and identities: injective joins of values, stable JSON, short digests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def join_key(*cols: Column | str) -> Column:
    """Values joined by | with \\ and | escaped and null as the empty string, so that different tuples never meet."""
    parts = [F.regexp_replace(F.regexp_replace(F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("")), r"\\", r"\\\\"), r"\|", r"\\|") for c in cols]
    return F.concat_ws("|", *parts)


def fact_id(family: str, kind: str, *parts: Column | str) -> Column:
    """The identity of a fact; the schema version is not part of it."""
    return join_key(F.lit(family), F.lit(kind), *parts)


#: The columns that identify a record of each kind.
LOC = ("rel_path", "start_line", "start_column")
RECORD_KEYS: dict[str, tuple[str, ...]] = {
    "source-file": ("root_name", "rel_path"),
    "symbol": ("id",),
    "call-edge": ("caller_id", "callee_name", *LOC),
    "import": ("root_name", "rel_path", "specifier"),
    "export": ("root_name", "rel_path", "name"),
    "reference": ("symbol_id", "kind", *LOC),
    "type-relation": ("subtype_id", "relation", "supertype_name"),
    "module-containment": ("root_name", "kind", "container", "member"),
    "package-dependency": ("root_name", "ecosystem", "name", "scope"),
    "build-target": ("root_name", "name"),
    "route": ("root_name", "method", "path"),
    "outbound-call": ("root_name", "caller_symbol_id", "method", "target", *LOC),
    "external-call": ("root_name", "caller_symbol_id", "package", "member"),
    "data-access": ("root_name", "symbol_id", "entity", "operation", *LOC),
    "auth-annotation": ("root_name", "symbol_id", "mechanism", "requirement", *LOC),
    "test-relation": ("root_name", "test_symbol_id", "target"),
    "validation-rule": ("root_name", "subject", "field", "rule", "expression", *LOC),
    "transaction-boundary": ("root_name", "symbol_id", "mechanism", *LOC),
    "error-handling": ("root_name", "symbol_id", "scope", *LOC),
    "condition": ("root_name", "subject", "operator", "literal", *LOC),
    "decision": ("root_name", "rel_path", "start_line", "end_line", "start_column", "branches", "subject"),
    "guard": ("root_name", "test", "message", *LOC),
    "scheduled-task": ("root_name", "mechanism", "schedule", *LOC),
    "notification-call": ("root_name", "mechanism", *LOC),
    "discarded-error": ("root_name", "call", *LOC),
    "entity": ("root_name", "name"),
    "entity-field": ("root_name", "entity", "name"),
    "entity-relation": ("root_name", "from", "to", "kind"),
    "entity-constraint": ("root_name", "entity", "kind", "fields", "expression"),
}


def record_key(kind: str) -> Column:
    return join_key(*RECORD_KEYS[kind])


def stable_json(*cols: str) -> Column:
    """JSON of the columns in name order, nulls kept."""
    return F.to_json(F.struct(*sorted(cols)), {"ignoreNullFields": "false"})


def stable_id(prefix: str, parts: Column, length: int = 16) -> Column:
    """prefix_ and the first hex digits of the digest of the sorted parts (array<string>), joined as join_key does."""
    escaped = F.transform(F.array_sort(parts), lambda p: F.regexp_replace(F.regexp_replace(p, r"\\", r"\\\\"), r"\|", r"\\|"))
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha2(F.array_join(escaped, "|"), 256), 1, length))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


#: The columns that identify a derived record of each kind.
DERIVED_KEYS: dict[str, tuple[str, ...]] = {
    "module": ("module_id",), "component": ("root_name", "folder"), "feature": ("term",), "flow": ("root_name", "method", "path"), "business-rule": ("root_name", "rel_path", "start_line", "subject", "operator", "literal"),
    "value-set": ("root_name", "name"), "trace": ("root_name", "method", "path"), "finding": ("code", "subject"),
}


def derived_key(kind: str) -> Column:
    return join_key(*DERIVED_KEYS[kind])


def symbol_id(root: Column | str, rel_path: Column | str, name: Column | str, line: Column | str) -> Column:
    """The identity of a symbol by where it stands and what it is called."""
    return join_key(root, rel_path, name, line)


def file_id(root: Column | str, rel_path: Column | str) -> Column:
    return join_key(root, rel_path)
