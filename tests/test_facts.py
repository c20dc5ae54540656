"""Fact operators on small hand-built rows."""

import random

import pytest
from pyspark.sql import functions as F

from factloom.functions import grades, keys, names, paths
from factloom.operators import audit, behavior, graphs, health, history, intervals, link, merge, modules, rules, scans
from factloom.sources import base, corpus


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_route_matching(spark):
    cases = [
        ("/users/:id", "/users/42", True), ("/users/:id", "/users/42/orders", False), ("/users/:id", "/users", False), ("/users/{id}", "/users/42", True), ("/users/<id>", "/users/42", True), ("/static/*", "/static/a/b/c", True),
        ("/a.c", "/abc", False), ("/a+", "/aaa", False), ("/orders/*", "/orders", True), ("/orders/items/*", "/orders", False), ("/", "", True), ("/x/", "/x", True),
    ]
    df = spark.createDataFrame(cases, "p string, q string, want boolean")
    assert df.where(paths.route_matches(F.col("p"), F.col("q")) != F.col("want")).count() == 0


def test_paths(spark):
    cases = [("https://api.example.com/v1/users", "/v1/users"), ("https://x.dev", "/"), ("https://x.dev/users?page=2#top", "/users"), ("not-a-url", None), ("/a?b", "/a")]
    assert [r.x for r in spark.createDataFrame(cases, "t string, w string").select(paths.path_of(F.col("t")).alias("x")).collect()] == [w for _, w in cases]
    assert one(spark, paths.resolve_dots(F.lit("./a/../b//c/./d"))) == "b/c/d"
    assert tuple(one(spark, paths.parse_url_template(F.lit("${config.apiBase}/v2/${id}/x?y=1")))) == ("apiBase", "/v2/:param/x")
    assert tuple(one(spark, paths.parse_route_name(F.lit("GET /x")))) == ("GET", "/x")
    assert one(spark, paths.join_route_path(F.lit("/v2/"), F.lit("leaves/"))) == "/v2/leaves"


CALLS = "call_id long, root_name string, target string, method string, base_identifier string"
ROUTES = "root_name string, method string, path string"


def test_link_calls_accounts_for_every_call(spark):
    calls = [(1, "ui", "/users", None, None), (2, "ui", None, None, None), (3, "ui", "some-queue", None, None), (4, "api", "/users", None, None), (5, "ui", "/dup", None, None), (6, "ui", "/webhooks/x", None, None), (7, "ui", "/w/1/2", None, None), (8, "ui", "/m", "POST", None)]
    routes = [("api", None, "/users"), ("a", None, "/dup"), ("b", None, "/dup"), ("api", None, "/webhooks/:provider"), ("api", None, "/webhooks/*/final/step/extra/tokens"), ("api", None, "/w/*any"), ("api", "GET", "/m"), ("api", "POST", "/m")]
    got = {r.call_id: r for r in link.link_calls(spark.createDataFrame(calls, CALLS), spark.createDataFrame(routes, ROUTES)).collect()}
    assert {i: r.outcome for i, r in got.items()} == {1: "linked", 2: "target-not-resolved", 3: "unparsed-destination", 4: "no-matching-route", 5: "ambiguous-match", 6: "linked", 7: "linked", 8: "linked"}
    assert got[1].confidence == "medium" and got[7].confidence == "low" and got[6].route_path == "/webhooks/:provider" and got[5].n_candidates == 2


def test_bindings(spark):
    routes = spark.createDataFrame([("a", None, "/x/:i"), ("b", None, "/y/:i"), ("b", None, "/x/1")], ROUTES)
    call = lambda n, base, *targets: [(n + i, "ui", t, None, base) for i, t in enumerate(targets)]
    calls = spark.createDataFrame(call(0, "one", "/x/2", "/x/3", "/x/4") + call(10, "split", "/x/2", "/y/2") + call(20, "few", "/y/3"), CALLS)
    got = {r.base_identifier: r for r in link.infer_base_bindings(calls, routes, 0.6, 2).collect()}
    assert (got["one"].bound_root, got["split"].bound_root, got["few"].bound_root) == ("a", None, None)
    assert "clear majority" in got["split"].reason or "below" in got["split"].reason
    assert "below" in got["few"].reason


def test_enclosing_prefers_the_shortest_span(spark):
    symbols = spark.createDataFrame([("outer", "r", "p", 1, 50), ("inner", "r", "p", 10, 20), ("x", "r", "p", None, None), ("other", "s", "p", 1, 99)], "symbol_id string, root_name string, rel_path string, start_line long, end_line long")
    facts = spark.createDataFrame([(1, "r", "p", 15, None), (2, "r", "p", 30, None), (3, "r", "p", 60, None), (4, "r", "p", 15, "own")], "id long, root_name string, rel_path string, line long, symbol_id string")
    got = {r.id: r.symbol_id for r in intervals.attach_enclosing(facts, symbols, "id").collect()}
    assert got == {1: "inner", 2: "outer", 3: None, 4: "own"}


def test_merge_keeps_conflicts_in_any_order(spark):
    rows = [("f", "k", "b", "inferred", {"v": "8", "w": None}), ("f", "k", "a", "declared", {"v": "7"}), ("f", "k", "c", "declared", {"v": "7"}), ("f", "t", "b", "declared", {"v": "b"}), ("f", "t", "a", "declared", {"v": "a"})]
    schema = "kind string, key string, provider_id string, resolution_class string, payload map<string,string>"
    results = []
    for seed in range(2):
        random.Random(seed).shuffle(rows)
        got = {r.key: r for r in merge.merge_facts(spark.createDataFrame(rows, schema)).collect()}
        results.append(sorted(map(str, got.values())))
    assert results[0] == results[1]
    assert got["k"].payload == {"v": "7"} and got["k"].attributions == ["a", "b", "c"] and sorted((c.field, c.value) for c in got["k"].conflicts) == [("v", "8"), ("w", None)]
    assert got["t"].payload == {"v": "a"} and got["t"].precedence_reason == "disagree at equal directness"


def edges(spark, pairs):
    return spark.createDataFrame([(a, b, i) for i, (a, b) in enumerate(pairs)], "caller_id string, callee_id string, edge_ord long")


def traces(spark, pairs, **bounds):
    ids = {x for p in pairs for x in p if x}
    r = graphs.build_traces(spark.createDataFrame([("e", "A")], "entry_id string, node string"), spark.createDataFrame([(i,) for i in ids], "id string"), edges(spark, pairs), **bounds).first()
    return [s.node for s in r.steps], r.truncation


@pytest.mark.parametrize(
    ("pairs", "bounds", "want"),
    [
        ([("A", "B"), ("B", "A")], {}, (["A", "B"], "cycle")),
        ([("A", "B"), ("A", "C"), ("B", "D"), ("C", "D")], {}, (["A", "B", "C", "D"], "completed")),
        ([("A", "B"), ("B", "C"), ("C", "D"), ("D", "E")], {"max_depth": 3}, (["A", "B", "C", "D"], "max-depth")),
        ([("A", f"N{i}") for i in range(9)], {"max_branches": 5}, (["A"], "max-branches")),
        ([("A", None), ("A", "B")], {}, (["A", "B"], "unresolved-edge")),
        ([("A", "B"), ("A", "C"), ("A", "D")], {"max_steps": 2}, (["A", "B"], "max-steps")),
    ],
)
def test_traces(spark, pairs, bounds, want):
    assert traces(spark, pairs, **bounds) == want


def test_cycles_and_scope(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("c", "a"), ("d", "a")], "from_root string, to_root string")
    assert sorted(">".join(r.cycle) for r in graphs.root_cycles(links).collect()) == ["a>b", "a>b>c"]
    assert graphs.cyclic_part(spark.createDataFrame([("a", "b"), ("b", "c")], "src string, dst string")).count() == 0
    assert graphs.cyclic_part(spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c")], "src string, dst string")).count() == 2
    got = graphs.transitive_scope(spark.createDataFrame([("root",)], "name string"), spark.createDataFrame([("x", "root"), ("y", "x"), ("z", "q")], "child string, parent string"))
    assert sorted(r.name for r in got.collect()) == ["root", "x", "y"]


def test_reverse_reach_stops_at_hubs(spark):
    e = edges(spark, [("b", "sink"), ("c", "b"), ("d", "c"), *((f"h{i}", "b") for i in range(3))])
    sinks = spark.createDataFrame([("s", "sink")], "sink string, node string")
    assert {r.node for r in graphs.reverse_reach(sinks, e, 2, 32).collect()} == {"sink", "b", "c", "h0", "h1", "h2"}
    assert {r.node for r in graphs.reverse_reach(sinks, e, 2, 2).collect()} == {"sink", "b"}


SETS = "set_ord int, root_name string, name string, members array<struct<name:string,value:bigint>>"


def test_rules_in_words(spark):
    sets = spark.createDataFrame([(0, "r", "OrderStatusC", [("OrderDraftC", 1), ("OrderPlacedC", 2), ("OrderShippedC", 3), ("OrderDeliveredC", 4)]), (1, "r", "PaymentStatusC", [("PaymentOpenC", 1), ("PaymentDoneC", 2)])], SETS)
    tests = [("order.Status", "==", 2, "status is placed"), ("order.Status", "!=", 2, "status is not placed"), ("order.Status", ">", 2, "status is shipped or delivered"), ("order.Status", ">", 0, "status is more than 0"), ("request.Hours", ">", 16, "hours is more than 16"), ("payment.Status", "==", 2, "status is done")]
    c = spark.createDataFrame([(i, "r", s, o, v) for i, (s, o, v, _) in enumerate(tests)], "condition_id long, root_name string, subject string, operator string, literal long")
    got = {r.condition_id: r for r in rules.state_rules(c, sets).collect()}
    assert [got[i].statement for i in range(len(tests))] == [w for *_, w in tests]
    assert got[5].value_set_name == "PaymentStatusC" and got[4].meanings == []


def test_divergence_is_between_decided_roots(spark):
    schema = "rule_id long, root_name string, subject string, operator string, literal long"
    found = lambda *rows: health.find_divergence(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], schema)).count()
    assert found(("a", "leave.Hours", ">", 40), ("b", "takeHours", ">=", 40)) == 2
    assert found(("a", "leave.Hours", ">", 40), ("a", "leave.Hours", ">=", 40)) == 0
    assert found(("a", "leave.Hours", ">", 40), ("a", "x.Hours", ">=", 40), ("b", "takeHours", ">", 40)) == 0
    assert found(("a", "s.Status", "==", 4), ("b", "s.Status", "!=", 4)) == 0
    assert found(("a", "rowCount", ">", 1), ("b", "tripCount", ">=", 1)) == 0


def test_prefix_features_and_modules(spark):
    named = lambda *n: spark.createDataFrame([(x,) for x in n], "name string")
    assert health.common_table_prefix(named("shop_order", "shop_item", "shop_user", "shop_cart", "audit_log")).first().prefix == "shop_"
    assert health.common_table_prefix(named("a_x", "b_y", "c_z", "d_w")).first().prefix is None
    routes = spark.createDataFrame([(p,) for p in ("/api/orders/:id", "/api/orders", "/api/orders/:id/items", "/api/orders/:id/x", "/api/orders/y")], "path string")
    f = {r.term: r for r in modules.detect_features(named("orders", "ghosts"), routes, spark.createDataFrame([("src/orders/list.go",)], "rel_path string"), ("api",)).collect()}
    assert f["order"].kept and f["order"].weight == 8 and "ghost" not in f
    e = spark.createDataFrame([("1", "/api/orders/:id"), ("2", "/api/users/:id/profile"), ("3", "/api/payments/charge"), ("4", "/api/order")], "entry_id string, path string")
    assert {(r.key, r.entries) for r in modules.form_modules(e).collect()} == {("order", 2), ("user", 1), ("payment", 1)}
    assert modules.shared_prefix_length(spark.createDataFrame([("/api/v1/x",), ("/api/v1/y",)], "path string")).first().n == 3


def test_schema_history(spark):
    ev = [("r", 1, "create", 0, "t", "a", "int"), ("r", 1, "create", 1, "t", "b", "int"), ("r", 2, "drop-column", 0, "t", "a", None), ("r", 1, "create", 0, "u", "a", "int"), ("r", 2, "drop-table", 0, "u", None, None), ("r", 3, "create", 0, "u", "z", "text")]
    df = spark.createDataFrame(ev, "root_name string, file_seq int, action string, pos int, table_name string, column_name string, type string")
    assert {(r.table_name, r.column_name) for r in history.fold_schema_history(df).collect()} == {("t", "b"), ("u", "z")}
    orm = [("r", 1, 0, "create-table", "t", None, None), ("r", 1, 1, "add-column", "t", "a", "int"), ("r", 2, 0, "add-column", "t", "a", "text"), ("r", 3, 0, "remove-column", "t", "b", None), ("r", 1, 0, "add-column", "ghost", "a", "int")]
    df = spark.createDataFrame(orm, "root_name string, file_seq int, pos int, action string, table_name string, column_name string, type string")
    assert [(r.table_name, r.column_name, r.type) for r in history.fold_orm_migrations(df).collect()] == [("t", "a", "int")]


def test_nearest_lockfile_decides(spark):
    deps = spark.createDataFrame([("r", "packages/b", "x"), ("r", "", "x"), ("r", "packages/b", "y")], "root_name string, dir string, name string")
    locks = spark.createDataFrame([("r", "", "x", "1"), ("r", "packages/b", "x", "2"), ("r", "", "y", "1"), ("r", "", "y", "2")], "root_name string, dir string, name string, version string")
    assert {(r.dir, r.name): r.version for r in history.resolve_versions(deps, locks).collect()} == {("packages/b", "x"): "2", ("", "x"): "1", ("packages/b", "y"): None}


def test_reports(spark):
    r = spark.createDataFrame([(1, "47%（1944/4109）and 1/3, internal/handlers/leave/service.go:147\n## A\n```\n# no\n```\n`feature|x` `y|z`")], "report_id long, text string")
    assert [(x.stated, x.numerator, x.denominator) for x in audit.cited_proportions(r).collect()] == [(47, 1944, 4109)]
    assert "internal/handlers/leave/service.go" in {x.path for x in audit.cited_paths(r).collect()}
    s = audit.line_sections(r, "report_id")
    assert [(x.section, x.heading) for x in s.orderBy("section").collect()] == [(0, None), (1, "A")]
    assert [x.identity for x in audit.cited_identities(s, spark.createDataFrame([("feature",)], "namespace string"), "report_id").collect()] == ["feature|x"]


def test_validation(spark):
    kinds = {"rule-valueset": ("rule", "set")}
    f = spark.createDataFrame([("r", "rule", 1), ("s", "set", 1), ("s", "set", 1), ("q", "odd", 1), ("n", "rule", 0)], "fact_id string, kind string, evidence int")
    rel = spark.createDataFrame([("rule-valueset", "r", "s"), ("rule-valueset", "s", "r"), ("rule-valueset", "r", "gone")], "relation string, from_id string, to_id string")
    got = {(r.fact_id, r.reason) for r in behavior.validate_behavior(f, rel, kinds).collect()}
    assert {("s", "id is not unique"), ("n", "no evidence"), ("q", "quarantined: unknown kind"), ("s", "relation between wrong kinds"), ("r", "relation to nothing"), ("r", "on a cycle")} <= got


def test_names(spark):
    for f, arg, want in (
        (names.singular, "categories", "category"), (names.singular, "boxes", "box"), (names.singular, "leaves", "leave"), (names.singular, "bus", "bus"), (names.singular, "class", "class"), (names.field_token, "lv.StatusCode", "code"),
        (names.classify_path, "a/tests/x.go", "test"), (names.classify_path, "db/1.sql", "schema-migration"), (names.classify_path, ".env.local", "configuration"), (names.classify_path, "README", "documentation"), (names.classify_path, "x.png", "binary-asset"),
        (names.classify_path, "x.go", "source"), (names.classify_path, "x", None), (names.looks_infrastructural, "authMiddleware", True), (names.looks_infrastructural, "orders", False), (names.subject_key, "takeHours", "hours"),
    ):
        assert one(spark, f(F.lit(arg))) == want, (f.__name__, arg)
    assert one(spark, names.readable_member(F.lit("LvWaitingHRApproveC"), F.lit("LvStatusC"))) == "waiting hrapprove"
    assert one(spark, keys.join_key(F.lit("a|b"), F.lit("c\\"), F.lit(None))) == "a\\|b|c\\\\|"
    assert one(spark, grades.compare_semver(F.lit("1.10.0"), F.lit("1.9.9"))) == 1 and one(spark, grades.pinned_by_manifest(F.lit("pip"), F.lit("==1.2"))) == "1.2"


def test_scans(spark):
    f = spark.createDataFrame([("r", "a.go", 'x\nif err != nil {\n  `binding:"required"`\n// one\n// two\ny\n// three'), ("r", "m/package.json", '{"dependencies": {"x": "^1"}, "devDependencies": {"y": "2.0.0"}}'), ("r", "m/go.sum", "a.b/c v1.2.3 h1:x\na.b/c v1.2.3/go.mod h1:x"), ("r", "yarn.lock", '"@s/p@^1":\n  version "1.5.0"\nq@2:\n  version "2.1.0"')], "root_name string, rel_path string, content string")
    got = {(r.kind, r.line, r.column, r.detail) for r in scans.scan_patterns(f).collect()}
    assert {("error-handling", 2, 1, None), ("validation-rule", 3, 4, "required")} <= got
    assert [(r.start_line, r.text) for r in scans.doc_comments(f).orderBy("start_line").collect()] == [(4, "one\ntwo"), (7, "three")]
    assert {(r.name, r.version_constraint, r.scope) for r in scans.read_manifests(f).collect()} == {("x", "^1", "runtime"), ("y", "2.0.0", "development")}
    assert {(r.name, r.version) for r in scans.read_lockfiles(f).collect()} == {("a.b/c", "1.2.3"), ("@s/p", "1.5.0"), ("q", "2.1.0")}


def test_base_at_rest(spark, tmp_path):
    at = str(tmp_path / "base")
    rec = spark.createDataFrame([("route", "r|GET|/x", "r", "a.go", 3), ("symbol", "s", "r", "a.go", None)], "kind string, record_key string, root_name string, rel_path string, line int")
    base.write_facts(rec, at, "snap1")
    base.write_facts(rec.limit(1), at, "snap2")
    assert base.read_records(spark, at, "snap1", "route", "line int, root_name string").first().line == 3
    assert base.kb_sql(spark, at, "snap2", "SELECT count(*) AS n FROM structural_records").first().n == 1
    with pytest.raises(ValueError):
        base.kb_sql(spark, at, "snap2", "DROP TABLE x")
    none = spark.createDataFrame([], "root_name string")
    assert base.publish(spark, at, "snap1", "w", "2024-01-01", none) and base.publish(spark, at, "snap2", "w", "2024-01-01", none)
    assert not base.publish(spark, at, "snap3", "w", "2024-02-01", spark.createDataFrame([("r",)], "root_name string"))
    assert base.resolve_snapshot(spark.read.parquet(f"{at}/{base.SNAPSHOTS}")) == "snap2"
    d = spark.createDataFrame([("k", "a", 1, "old"), ("k", "a", 2, "new")], "kind string, record_key string, ordinal int, payload string")
    assert base.write_derived(d, at, "snap1") == {"inserted": 1, "replaced": 1}


def test_corpus_and_inventory(spark, tmp_path):
    (tmp_path / "src" / "node_modules" / "x").mkdir(parents=True)
    (tmp_path / "src" / "a.go").write_text("// Code generated; DO NOT EDIT")
    (tmp_path / "src" / "node_modules" / "x" / "i.js").write_text("x" * 10)
    (tmp_path / "src" / "big.txt").write_text("y" * 100)
    files, failures = corpus.read_corpus(spark, {"r": str(tmp_path / "src")}, cap=50)
    assert [r.rel_path for r in failures.collect()] == ["big.txt"]
    got = {r.rel_path: r for r in corpus.inventory(files).collect()}
    assert got["a.go"].classification == "generated" and got["node_modules"].size_bytes == 10 and len(got) == 2


def test_handlers(spark):
    schema = "id string, root_name string, name string, qualified_name string, rel_path string"
    find = lambda candidates, *symbols: tuple(link.resolve_handlers(spark.createDataFrame([(1, "svc", candidates)], "route_id int, root_name string, candidates array<string>"), spark.createDataFrame([(str(i), "svc", *s) for i, s in enumerate(symbols)], schema)).first())[1:]
    assert find(["leave.Creation"], ("Creation", None, "x/leave/router.go"), ("Creation", None, "x/order/router.go")) == ("0", None)
    assert find(["leave.Creation"], ("Creation", None, "internal/leave/a.go"), ("Creation", None, "internal/leave/b.go")) == (None, "2 symbols fit")
    assert find(["swaggerFiles.Handler", "ginSwagger.WrapHandler"], ("WrapHandler", "ginSwagger.WrapHandler", "internal/handlers/swagger.go"))[0] == "0"
    assert find(["leave.Deletion", "e.CatchError"], ("Deletion", None, "h/leave/router.go"), ("Deletion", None, "h/leave/legacy.go"), ("CatchError", None, "pkg/error/error_handler.go"))[0] is None
    assert find(["leave.Pagination"], ("Pagination", None, "leave/a.go"), ("Pagination", "LeaveService::Pagination", "leave/b.go"))[0] == "0"
    assert find(["worklogService.getWorkLogsByUser"], ("getWorkLogsByUser", None, "services/worklogServices.js"))[0] == "0"
