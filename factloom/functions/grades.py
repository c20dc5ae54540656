"""Provenance, coverage, versions and pins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
RESOLUTION_RANK = {"declared": 3, "resolved": 2, "inferred": 1, "unresolved": 0}
CONFIDENCE_RANK = {"low": 0, "medium": 1, "high": 2}
COVERAGE_ORDER = (("failed", "failed"), ("truncated", "partial"), ("unsupported", "unsupported"), ("not_applicable", "not-applicable"), ("not_requested", "not-requested"), ("observed", "observed"), ("searched", "absent"))


def ranked(c: Column, table: dict[str, int]) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), c)


def resolution_rank(c: Column) -> Column:
    return ranked(c, RESOLUTION_RANK)


def is_legal_transition(before: Column, after: Column) -> Column:
    """A resolution may only be strengthened."""
    return resolution_rank(after) >= resolution_rank(before)


def is_directly_observed(c: Column) -> Column:
    return c == "declared"


def aggregate_confidence(c: Column) -> Column:
    """The weakest level of a group; null for none. An aggregate."""
    return F.min_by(c, ranked(c, CONFIDENCE_RANK))


def classify_coverage(flags: dict[str, Column]) -> Column:
    """The state of the first flag that holds in a fixed order, unknown if none does; a missing flag is false."""
    pairs = [(flags[k], state) for k, state in COVERAGE_ORDER if k in flags]
    return reduce(lambda acc, p: acc.when(F.coalesce(p[0], F.lit(False)), p[1]), pairs[1:], F.when(F.coalesce(pairs[0][0], F.lit(False)), pairs[0][1])).otherwise("unknown")


def activation_from_observation(observable: Column, conditional: Column) -> Column:
    return F.when(~observable, "unresolved").when(conditional, "conditional").otherwise("active")


def semver(c: Column) -> Column:
    p = F.split(c, r"\.")
    return F.struct(*(F.coalesce(F.try_element_at(p, F.lit(i)).try_cast("int"), F.lit(0)).alias(n) for i, n in ((1, "major"), (2, "minor"), (3, "patch"))))


def compare_semver(a: Column, b: Column) -> Column:
    return F.when(semver(a) > semver(b), 1).when(semver(a) < semver(b), -1).otherwise(0)


def is_compatible(reader: Column, writer: Column) -> Column:
    r, w = semver(reader), semver(writer)
    return (r["major"] == w["major"]) & (r["minor"] >= w["minor"])


def pinned_by_manifest(ecosystem: Column, constraint: Column) -> Column:
    """The exact version a manifest pins, or null: plain x.y.z for npm and cargo =x.y.z, ==x for pip, vx.y.z for go."""
    npm, pip, go = r"^=?v?([0-9]+\.[0-9]+\.[0-9]+[A-Za-z0-9.+-]*)$", r"^==\s*([0-9][A-Za-z0-9.+-]*)$", r"^v([0-9]+\.[0-9]+\.[0-9]+[A-Za-z0-9.+-]*)$"
    pick = lambda p: F.nullif(F.regexp_extract(constraint, p, 1), F.lit(""))
    return F.when(ecosystem == "pip", pick(pip)).when(ecosystem == "go", pick(go)).otherwise(pick(npm))


def agrees_with_constraint(constraint: Column, version: Column) -> Column:
    """A caret or tilde constraint agrees on the major version; any other is not judged."""
    lead = F.regexp_extract(constraint, r"^[\^~]v?([0-9]+)", 1)
    return F.when(lead == "", True).otherwise(lead == F.regexp_extract(version, r"^v?([0-9]+)", 1))


def provenance_violation(p: Column) -> Column:
    """Why a provenance struct (resolution_class, source struct<rel_path,...>, confidence, unresolved_reason) is none of the four legal
    shapes; null if it is."""
    c, path = p["resolution_class"], p["source"]["rel_path"]
    return (
        F.when(c.isNull() | ~c.isin(*RESOLUTION_RANK), "unknown resolution class")
        .when((c == "inferred") & (p["confidence"].isNull() | ~p["confidence"].isin(*CONFIDENCE_RANK)), "inferred without confidence")
        .when((c != "inferred") & p["confidence"].isNotNull(), "confidence on a class that has none")
        .when((c == "unresolved") & (F.coalesce(p["unresolved_reason"], F.lit("")) == ""), "unresolved without a reason")
        .when((c != "unresolved") & p["unresolved_reason"].isNotNull(), "a reason on a resolved fact")
        .when((c != "unresolved") & path.isNull(), "no source")
    )


def locate(content: Column, offset: Column) -> Column:
    """struct(line, column), 1-based, of a 0-based character offset."""
    before = F.substring(content, F.lit(1), offset)
    return F.struct(F.size(F.split(before, "\n", -1)).alias("line"), (F.length(F.element_at(F.split(before, "\n", -1), -1)) + 1).alias("column"))


def escape_label(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, '"', "#quot;"), r"[\n\r]+", " ")


def flow_diagram(steps: Column) -> Column:
    """Diagram text of ordered steps array<struct<label string, resolved boolean>>; a step that is not resolved hangs on a dashed edge."""
    nodes = F.transform(steps, lambda s, i: F.concat(F.lit("  s"), i.cast("string"), F.lit('["'), escape_label(s["label"]), F.lit('"]')))
    edges = F.transform(F.slice(steps, 2, F.greatest(F.size(steps) - 1, F.lit(0))), lambda s, i: F.concat(F.lit("  s"), i.cast("string"), F.when(s["resolved"], " --> s").otherwise(" -.-> s"), (i + 1).cast("string")))
    return F.array_join(F.concat(F.array(F.lit("flowchart TD")), nodes, edges), "\n")


# What a coverage state counts as in a report.
COVERAGE_SECTION = {"observed": "covered", "partial": "covered", "not-applicable": "excluded", "unsupported": "gaps", "failed": "gaps", "unknown": "gaps"}


def coverage_section(state: Column) -> Column:
    """covered, excluded or gaps; a state that nobody knows is a gap."""
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in COVERAGE_SECTION.items() for x in kv)), state), F.lit("gaps"))


def is_coverage_gap(state: Column) -> Column:
    return coverage_section(state) == "gaps"


def counts_in_denominator(state: Column) -> Column:
    """What is not applicable is no part of the whole."""
    return coverage_section(state) != "excluded"


def map_diagram(edges: Column) -> Column:
    """Diagram text of struct(source, target, kind) edges in order: dashed unless internal."""
    label = lambda c: F.concat(F.lit('["'), escape_label(c), F.lit('"]'))
    node = lambda c: F.concat(F.lit("n_"), F.substring(F.sha2(c, 256), 1, 8), label(c))
    arrow = lambda e: F.when(e["kind"] == "internal", F.lit(" --> ")).otherwise(" -.-> ")
    return F.concat(F.lit("flowchart LR\n"), F.array_join(F.transform(edges, lambda e: F.concat(F.lit("  "), node(e["source"]), arrow(e), node(e["target"]))), "\n"))
