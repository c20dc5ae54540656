"""Constraints, truth, payload quantities, traces with origins, isolated collectors and the scoped base, on planted rows and by brute force."""

import random

import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

from factloom.operators import constraints, effects, flows, graphs
from factloom.sources import base, providers

EVIDENCE = "array<struct<resolution_class:string,confidence:string,unresolved_reason:string,rel_path:string>>"
FACTS = f"fact_id string, family string, kind string, scope string, activation string, evidence {EVIDENCE}"
RELATIONS = "kind string, from_id string, to_id string, role string"


def fact(i, kind, family="behavioral", scope="root", activation="always", evidence=(("declared", None, None, "a"),)):
    return (i, family, kind, scope, activation, list(evidence))


def test_each_rule_of_a_model(spark):
    facts = [
        fact("d", "decision"), fact("d2", "decision"), fact("t", "transition"), fact("t2", "transition"), fact("t3", "transition"), fact("s", "state"), fact("r", "business-rule"), fact("v", "value-set"), fact("g", "guard"), fact("dup", "condition"), fact("dup", "condition"),
        fact("far", "condition", family="structural"), fact("new", "novelty", scope="galaxy", activation=None), fact("odd", "state", scope=None, activation="never"), fact("bare", "state", evidence=()),
    ]
    legal = [("declared", None, None, "a"), ("resolved", None, None, "a"), ("resolved", "low", None, "a"), ("inferred", "high", None, "a"), ("unresolved", None, "why", "a")]
    wrong = [("declared", "high", None, "a"), ("declared", None, "x", "a"), ("resolved", "sure", None, "a"), ("resolved", None, "x", "a"), ("inferred", None, None, "a"), ("inferred", "high", "x", "a"), ("unresolved", None, "", "a"), ("unresolved", "low", "x", "a"), ("guess", None, None, "a"), ("declared", None, None, None), (None, None, None, "a")]
    facts += [fact(f"ok{i}", "state", evidence=[e]) for i, e in enumerate(legal)] + [fact(f"bad{i}", "state", evidence=[legal[0], e]) for i, e in enumerate(wrong)]
    relations = [
        ("decision-branch", "d", "g", "then"), ("transition-endpoint", "t", "s", "to-state"), ("transition-endpoint", "t", "s", "from-state"), ("transition-endpoint", "t2", "s", "to-state"), ("transition-endpoint", "t2", "s", "to-state"),
        ("rule-valueset", "r", "v", "uses"), ("guard-subject", "g", "elsewhere", "constrains"), ("guard-subject", "s", "x", "y"), ("rule-valueset", "r", "gone", ""), ("decision-branch", "v", "r", "then"), ("transition-endpoint", "ghost", "v", "middle"),
    ]
    got = {(r.fact_id, r.code) for r in constraints.validate_model(spark.createDataFrame(facts, FACTS), spark.createDataFrame(relations, RELATIONS)).collect()}
    assert got == {
        ("d2", "no-branch"), ("t2", "transition-states"), ("t3", "transition-states"), ("dup", "duplicate-id"), ("far", "wrong-family"), ("new", "unknown-kind"), ("odd", "illegal-scope"), ("odd", "illegal-activation"), ("bare", "no-evidence"),
        ("s", "guard-subject from"), ("gone", "to-unknown-fact"), ("gone", "rule-valueset to"), ("r", "no-role"), ("v", "decision-branch from"), ("v", "transition-endpoint to"), ("ghost", "from-unknown-fact"), ("ghost", "wrong-role"), ("ghost", "transition-endpoint from"),
        ("r", "on-a-cycle"), ("v", "on-a-cycle"),
    } | {(f"bad{i}", "bad-provenance") for i in range(len(wrong))}


def test_an_empty_model_is_valid(spark):
    assert constraints.validate_model(spark.createDataFrame([], FACTS), spark.createDataFrame([], RELATIONS)).collect() == []


def test_folders_and_absence(spark):
    facts = spark.createDataFrame([("condition", "r", "a/b/c.go"), ("test-relation", "r", "t/x.go"), ("condition", "q", "z.go"), (None, "r", None)], "kind string, root_name string, rel_path string")
    item = lambda i, category, expects, *cited: (i, category, "critical", True, expects, [(c if ":" in c else "r:" + c).split(":") for c in cited])
    truth = [
        item(1, "rule", "present", "a"), item(2, "rule", "present", "a/"), item(3, "rule", "present", "a/b/c.go"), item(4, "rule", "present", "a/b/c.go/"), item(5, "rule", "present", "a/bb", "a/b"), item(6, "rule", "present", "q:z.go"), item(7, "role", "present", "a"),
        item(8, "nothing", "absent", "t"), item(9, "nothing", "absent", "u/"), item(10, "test-relation", "absent", "u"), item(11, "nothing", "present", "a"), item(12, "rule", "present"), item(13, "validation", "absent", "a"), item(14, "test-relation", "absent", "t/"),
    ]
    t = spark.createDataFrame(truth, "id long, category string, criticality string, must_find boolean, expects string, evidence array<struct<root_name:string,path:string>>")
    got = {r.id: r.status for r in constraints.grade_truth(t, facts, "r").collect()}
    no, yes = "not-found", "found"
    assert got == {1: yes, 2: yes, 3: yes, 4: no, 5: yes, 6: "unresolved", 7: "unsupported", 8: no, 9: yes, 10: no, 11: "unsupported", 12: "unresolved", 13: yes, 14: no}
    ran = {r.id: (r.status, r.reason) for r in constraints.grade_truth(t, facts, "r", "covered").collect()}
    assert ran[10] == (yes, "honestly absent") and ran[14] == (no, "unexpectedly present")
    gate = constraints.truth_gate(constraints.grade_truth(t, facts, "r")).first()
    assert (gate.total, gate.denominator, gate.must_find_found, gate.critical_issues, gate.passed) == (14, 10, 6, 4, False)


def test_quantities_of_payloads(spark):
    payloads = ['{"a":[1,2],"n":7,"f":2.0,"g":2.5,"z":0,"e":[],"t":"3 of 1,200","b":true,"o":{"k":[1,2,3]}}', "[[1],5]", "not json 4/9", "12", None, '{"big": 123456789012}', '"5 of x"']
    rows = [("feature", p) for p in payloads] + [("other", '{"n":99}')]
    got = {(r.value, r.basis) for r in constraints.payload_quantities(spark.createDataFrame(rows, "kind string, payload string")).collect()}
    assert got == {(2, "list"), (7, "number"), (2, "number"), (1200, "share"), (1, "list"), (5, "number"), (9, "share"), (123456789012, "number")}


def test_traces_keep_their_origins(spark):
    r = random.Random(8)
    nodes = [f"n{i}" for i in range(30)]
    edges = [(r.choice(nodes), r.choice(nodes), i, r.choice(["call", "type"]), "resolved", "a.go", i) for i in range(45)]
    entries = [(n, n, "precise") for n in nodes[:10]]
    steps, total = graphs.entry_traces(
        spark.createDataFrame(entries, "entry_id string, node string, class string"), spark.createDataFrame([(n,) for n in nodes], "id string"),
        spark.createDataFrame(edges, "caller_id string, callee_id string, edge_ord long, edge_kind string, resolution string, rel_path string, line long"),
    )
    want, led = set(), 0
    for e, _, _ in entries:
        seen, queue = {e}, [(e, 0)]
        want.add((e, e, 0, None, None, None))
        while queue:
            n, depth = queue.pop(0)
            for a, b, i, kind, *_ in edges:
                if a == n and b not in seen:
                    seen.add(b)
                    queue.append((b, depth + 1))
                    want.add((e, b, depth + 1, n, kind, i))
        led += len(seen) > 1
    assert {(x.entry_id, x.node, x.depth, x.origin, x.edge_kind, x.line) for x in steps.collect()} == want
    row = total.first()
    assert (row.total, row.precise, row.candidate, row.reachable) == (10, 10, 0, led) and row.rate == led / 10
    origin = {(e, n): o for e, n, _, o, _, _ in want}
    paths = {(x.entry_id, x.node): x.path for x in graphs.read_back(steps, steps.select("entry_id", "node")).collect()}
    for (e, n), path in paths.items():
        back = [n]
        while origin[e, back[0]] is not None:
            back.insert(0, origin[e, back[0]])
        assert path == back and path[0] == e
    assert len(paths) == len(want)


def halves(file):
    if file["content"] == "stop":
        raise RuntimeError("stopped")
    yield {"name": file["content"], "n": len(file["content"]) // 2}


def odd(file):
    yield {"name": "first", "n": 1}
    yield {"name": "second", "n": "x" if file["rel_path"] == "b" else 2}


def test_a_failing_collector_takes_nothing_along(spark):
    files = spark.createDataFrame([("r", "a", "four"), ("r", "b", "stop"), ("r", "c", "sixsix")], "root_name string, rel_path string, content string").repartition(1)
    ran = providers.run_isolated(files, {"halves": halves, "odd": odd}, StructType([StructField("name", StringType()), StructField("n", LongType())]))
    rows, failures = providers.split_failures(ran)
    assert sorted((x.collector, x.rel_path, x.name, x.n) for x in rows.collect()) == [("halves", "a", "four", 2), ("halves", "c", "sixsix", 3), ("odd", "a", "first", 1), ("odd", "a", "second", 2), ("odd", "c", "first", 1), ("odd", "c", "second", 2)]
    assert sorted((x.collector, x.rel_path, x.reason.split(":")[0]) for x in failures.collect()) == [("halves", "b", "RuntimeError"), ("odd", "b", "ArrowInvalid")]


def test_scopes_go_through_parents_and_queries_are_logged(spark, tmp_path):
    at = str(tmp_path / "base")
    spark.createDataFrame([("s1", 1), ("s2", 2)], "snapshot_id string, root_id long").write.parquet(f"{at}/roots")
    spark.createDataFrame([(1, 10), (2, 20)], "root_id long, file_id long").write.parquet(f"{at}/files")
    spark.createDataFrame([(10, "a"), (20, "b")], "file_id long, line string").write.parquet(f"{at}/lines")
    children = {"lines": ("files", "file_id"), "files": ("roots", "root_id")}
    assert [r.line for r in base.kb_sql(spark, at, "s2", "SELECT line FROM lines", ("roots",), children, log="log").collect()] == ["b"]
    base.kb_sql(spark, at, "s1", "SELECT 1", ("roots",), children, log="log")
    with pytest.raises(ValueError, match="SELECT"):
        base.kb_sql(spark, at, "s1", "DELETE FROM lines", ("roots",), children, log="log")
    assert sorted((r.report_id, r.query) for r in spark.read.parquet(f"{at}/log").collect()) == [("s1", "SELECT 1"), ("s2", "SELECT line FROM lines")]
    for loop in ({"a": ("b", "k"), "b": ("a", "k")}, {"lines": ("nowhere", "k")}):
        with pytest.raises(ValueError, match="no snapshot scopes"):
            base.scoped_views(spark, at, "s1", ("roots",), loop)


def test_links_are_added_once(spark, tmp_path):
    at, link = str(tmp_path / "base"), "from_id string, to_id string, role string"
    first = spark.createDataFrame([("a", "b", "owns"), ("a", "b", "owns"), ("a", None, "owns")], link)
    more = spark.createDataFrame([("a", "b", "owns"), ("a", None, "owns"), ("c", "d", "uses")], link)
    assert [base.write_links(x, at, "s1") for x in (first, first, more, more)] == [2, 0, 1, 0] and base.write_links(more, at, "s2") == 3


def test_storage_findings(spark):
    rows = [(1, 1, "route", None, None, None), (2, 1, "data-access", "t", True, None), (2, 2, "data-access", "u", True, None), (3, 1, "data-access", "t", True, None), (3, 1, "data-access", "t", False, None), (4, 1, "data-access", "t", False, "unknown")]
    got = flows.storage_findings(spark.createDataFrame(rows, "feature_id long, flow_id long, kind string, entity string, indirect boolean, unresolved_reason string")).collect()
    assert sorted((r.feature_id, r.code, r.evidence) for r in got) == [(1, "feature-without-observed-storage", []), (2, "storage-observed-only-nearby", ["t", "u"]), (4, "feature-without-observed-storage", [])]


PLACE = "root_name string, rel_path string, start_line int, start_column int"


def located(spark, access=(), transactions=(), calls=(), packages=(), notifications=()):
    make = lambda rows, more: spark.createDataFrame(list(rows), f"{PLACE}, {more}")
    return effects.located_effects(
        make(access, "symbol_id string, entity string, operation string, mechanism string"), make(transactions, "symbol_id string, mechanism string, propagation string"), make(calls, "symbol_id string, outbound_kind string, method string, target string, base_identifier string"),
        make(packages, "symbol_id string, package_name string, member_name string"), make(notifications, "channel string, mechanism string"),
    )


def test_effects_at_their_places(spark):
    got = located(
        spark,
        access=[("r", "a.go", 3, 1, "f", "orders", "write", "orm"), ("r", "a.go", 3, 9, "f", None, "write", "orm"), ("r", "a.go", 3, 1, None, "orders", "write", "orm"), ("r", "a.go", 3, 1, "f", "orders", "write", "orm")],
        transactions=[("r", "a.go", 5, None, "f", "begin", None), ("r", "a.go", 5, None, None, "annotation", "required")],
        calls=[("r", "a.go", 7, None, None, "http", "GET", None, "BASE"), ("r", "a.go", 7, None, None, "http", "GET", None, "OTHER"), ("r", "a.go", 8, None, "f", "http", None, "/x", None)],
        packages=[("r", None, None, None, None, "sdk", "send"), ("r", "b.go", 1, None, None, "sdk", None)],
        notifications=[("r", "a.go", 9, None, "mail", "smtp"), ("r", "a.go", 9, None, "mail", "smtp")],
    ).collect()
    rows = {(r.kind, r.scope, r.category, r.target, r.detail, r.link) for r in got}
    assert len(got) == len({r.fact_id for r in got}) == 10
    assert rows == {
        ("data-access", "module", None, "orders", "write", "resolved"), ("data-access", "symbol", None, None, "write", "unresolved"), ("transaction-boundary", "symbol", None, "begin", None, None), ("transaction-boundary", "module", None, "annotation", "required", None),
        ("outbound-call", "module", "service", None, "BASE", "unresolved"), ("outbound-call", "module", "service", None, "OTHER", "unresolved"), ("outbound-call", "symbol", "service", "/x", None, "resolved"), ("outbound-call", "module", "external-package", "sdk.send", "sdk", "resolved"),
        ("outbound-call", "module", "external-package", "sdk", "sdk", "resolved"), ("notification-call", "module", None, "smtp", "mail", None),
    }
    assert located(spark).count() == 0


def test_what_a_data_model_leaves_out(spark):
    schema = "root_name string, entity string"
    described = spark.createDataFrame([("full", "a"), ("full", "a"), ("part", "a"), ("none", None), ("extra", "z")], schema)
    touched = spark.createDataFrame([("full", "a"), ("part", "a"), ("part", "b"), ("part", "b"), ("part", None), ("none", "q"), ("only", "q")], schema)
    got = {tuple(r) for r in flows.data_coverage_notes(described, touched, ("root_name",)).collect()}
    assert got == {("part", "further-entities-used", 1, 1), ("none", "nothing-described", 0, 0), ("only", "nothing-described", 0, 0)}
    assert [tuple(r) for r in flows.data_coverage_notes(described, touched).collect()] == [("further-entities-used", 2, 2)]
    nothing = spark.createDataFrame([], schema)
    assert [tuple(r) for r in flows.data_coverage_notes(nothing, touched).collect()] == [("nothing-described", 0, 0)]


def test_status_of_workspaces(spark):
    snapshots = spark.createDataFrame([("w", "s1", "r1", "2024"), ("w", "s2", "r2", "2024"), ("w", "s3", "r3", None), ("bare", "s4", "r4", None), ("other", "s5", "r1", "2023")], "workspace string, snapshot_id string, run_id string, published_at string")
    roots = spark.createDataFrame([("s2", "api", "main", True), ("s2", "empty", None, None), ("s1", "api", "old", False)], "snapshot_id string, root_name string, branch string, dirty boolean")
    files = spark.createDataFrame([("s2", "api", "read")] * 3 + [("s2", "api", "skipped"), ("s1", "api", "read"), ("s2", "api", None)], "snapshot_id string, root_name string, disposition string")
    checks = spark.createDataFrame([("s2", "index", "1", False, "missing"), ("s1", "index", "1", True, None), ("s2", "sql", "2", True, None)], "snapshot_id string, provider_id string, version string, available boolean, reason string")
    names = spark.createDataFrame([("w",), ("bare",), ("never",)], "workspace string")
    reports, at_root, ran = flows.status_report(names, snapshots, roots, files, checks)
    assert {(r.workspace, r.analyzed, r.snapshot_id) for r in reports.collect()} == {("w", True, "s2"), ("bare", False, None), ("never", False, None)}
    assert {(r.root_name, r.branch, r.dirty): r.counts for r in at_root.collect()} == {("api", "main", True): {"read": 3, "skipped": 1}, ("empty", None, None): {}}
    assert {(r.provider_id, r.available, r.reason) for r in ran.collect()} == {("index", False, "missing"), ("sql", True, None)}
    old = flows.status_report(names, snapshots, roots, files, checks, run_id="r1")
    assert [r.snapshot_id for r in old[0].where("analyzed").collect()] == ["s1"] and [r.counts for r in old[1].collect()] == [{"read": 1}]
