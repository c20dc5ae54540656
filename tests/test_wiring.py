"""The steps between operators, graph import and providers on small rows."""

from pyspark.sql import functions as F

from factloom.operators import audit, effects, flows, routes, wiring
from factloom.sources import code_graph
from factloom.sources.providers import Registry


def test_strict_json_and_accounting(spark):
    t = spark.createDataFrame([(1, '{"a": 1}'), (2, "nope")], "report_id long, text string")
    got = {r.report_id: r for r in wiring.parse_strict(t, "a int").collect()}
    assert got[1].value.a == 1 and got[1].fault is None and got[2].fault and got[2].value is None
    links = spark.createDataFrame([("linked",), ("ambiguous-match",)], "outcome string")
    assert wiring.accounting(links, links).first().sums


def test_entry_traces_over_types(spark):
    edge = lambda *rows: spark.createDataFrame(rows, "caller_id string, callee_id string, edge_ord long")
    r = wiring.build_entry_traces(spark.createDataFrame([("e", "A")], "entry_id string, node string"), spark.createDataFrame([("A",), ("B",), ("C",), ("D",)], "id string"), edge(("A", "B", 0)), edge(("B", "C", 1))).first()
    assert [s.node for s in r.steps] == ["A", "B", "C"] and r.traceability == 75 and r.truncation == "completed"


def test_route_consolidation(spark):
    schema = "route_id int, root_name string, rel_path string, start_line int, method string, path string, class string, providers array<string>, verb_use boolean"
    rows = [(1, "r", "f", 30, "POST", "/oauth/token", "direct", ["a"], False), (2, "r", "f", 31, "POST", "/token", "inferred", ["b"], False), (3, "r", "g", 1, None, "/authorize", "direct", ["a"], False), (4, "r", "g", 2, None, "/something-else", "inferred", ["b"], False), (5, "r", "h", 10, "DELETE", "/worklogs", "direct", ["a"], False), (6, "r", "h", 99, "DELETE", "/", "inferred", ["b"], False), (7, "r", "h", 10, "DELETE", "/", "inferred", ["b"], False), (8, "r", "h", 1, None, "/worklogs", "inferred", ["b"], True)]
    got = {r.route_id: r for r in routes.consolidate_routes(spark.createDataFrame(rows, schema)).collect()}
    assert set(got) == {1, 3, 4, 5, 6, 8} and got[1].providers == ["a", "b"] and got[1].conflicts == ["/token"] and got[8].failure == "not an endpoint"


def test_context_picks_the_instantiated_type(spark):
    steps = spark.createDataFrame([("f", 0, "A.run"), ("f", 1, "free")], "flow_id string, pos int, symbol_id string")
    methods = spark.createDataFrame([("A.run", "A", "run"), ("B.run", "B", "run"), ("C.run", "C", "run")], "symbol_id string, type_id string, name string")
    supers = spark.createDataFrame([("A", "S"), ("B", "S"), ("C", "S")], "type_id string, super string")
    pick = lambda *types: [r.symbol_id for r in flows.contextual_steps(steps, methods, supers, spark.createDataFrame([("f", t) for t in types], "flow_id string, type_id string")).orderBy("pos").collect()]
    assert pick("B") == ["B.run", "free"] and pick("A") == ["A.run", "free"] and pick("B", "C") == ["free"]


def test_code_graph(spark, tmp_path):
    nodes = spark.createDataFrame([("1", "function", "f", "ws/api/a.go"), ("2", "function", "g", "ws/api/b.go"), ("3", "class", "K", "ws/api/sub/c.go"), ("4", "function", "x", "other/d.go")], "id string, kind string, name string, file_path string")
    edges = spark.createDataFrame([("1", "2", "calls"), ("1", "9", "calls"), ("1", "3", "instantiates"), ("3", "3", "extends"), ("4", "1", "calls")], "from_id string, to_id string, kind string")
    roots = spark.createDataFrame([("ws/api", "api"), ("ws/api/sub", "sub")], "prefix string, root_name string")
    files = spark.createDataFrame([("api", "a.go"), ("sub", "c.go")], "root_name string, rel_path string")
    got = code_graph.graph_to_facts(nodes, edges, roots, files)
    assert {(r.id, r.root_name, r.rel_path) for r in got["symbols"].collect()} == {("1", "api", "a.go"), ("3", "sub", "c.go")}
    assert {(r.to_id, r.unresolved_reason is None) for r in got["call_edges"].collect()} == {("2", True), (None, False)}
    assert [r.kind for r in got["references"].collect()] == ["instantiate"] and got["type_relations"].count() == 1


def test_providers(spark):
    reg = Registry()
    reg.register("ok", lambda files: files.select(F.lit("symbol").alias("kind"), "rel_path"), {"symbol": "full"})
    reg.register("bad", lambda files: files.select("nothing"))
    out, failures = reg.run(spark.createDataFrame([("a.go",)], "rel_path string"), "kind string, rel_path string")
    assert out.count() == 1 and [r.provider_id for r in failures.collect()] == ["bad"] and reg.declarations(spark).count() == 1


def test_authorization_and_notes(spark):
    sets = spark.createDataFrame([("r", "UserRole", [("Admin", 1)]), ("r", "Colour", [("Red", 1)])], "root_name string, name string, members array<struct<name:string,value:bigint>>")
    refs = spark.createDataFrame([("r", "Admin", "check", "a", 1), ("r", "Red", "check", "a", 2), ("r", "Admin", "write", "a", 3), ("s", "Admin", "check", "b", 1)], "root_name string, member string, context string, rel_path string, start_line int")
    assert [(r.member, r.start_line) for r in effects.observe_authorization(refs, sets).collect()] == [("Admin", 1)]
    log = spark.createDataFrame([(1, "SELECT * FROM t WHERE snapshot_id = :snapshot"), (1, "SELECT snapshot_id FROM t")], "report_id int, query string")
    assert audit.audit_query_log(log).count() == 1


def test_targets_of_modules(spark):
    """A place counts once, generated files and calls without a target do not; a root in two modules counts in both."""
    calls = spark.createDataFrame([("r", "a.go", 1, "pay"), ("r", "a.go", 1, "pay"), ("r", "a.go", 2, "pay"), ("r", "gen.go", 1, "pay"), ("r", "a.go", 3, None), ("s", "gen.go", 1, "mail"), ("alone", "x.go", 1, "pay")], "root_name string, rel_path string, start_line int, target string")
    files = spark.createDataFrame([("r", "gen.go", "generated"), ("r", "gen.go", "generated"), ("s", "gen.go", "source"), ("r", "a.go", None)], "root_name string, rel_path string, classification string")
    modules = spark.createDataFrame([("m", "r"), ("m", "r"), ("m", "s"), ("n", "r"), ("bare", "nowhere"), ("null", None)], "module_id string, root_name string")
    assert {tuple(r) for r in wiring.module_targets(modules, calls, files).collect()} == {("m", "pay", 2), ("m", "mail", 1), ("n", "pay", 2)}
    assert wiring.module_targets(modules, calls.limit(0), files).count() == 0


def test_kinds_of_gaps(spark):
    got = spark.createDataFrame([("fields",), ("constraints",), ("odd",), (None,)], "c string").select(wiring.gap_kind(F.col("c")).alias("k")).collect()
    assert sorted(r.k for r in got) == ["entity", "entity", "entity-constraint", "entity-field"]
