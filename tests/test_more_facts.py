"""Graphs, prefixes, route keys, manifests and the base at rest against brute force and hand-built rows."""

import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from factloom.functions import grades, names, paths
from factloom.operators import audit, graphs, health, history, link, scans, wiring
from factloom.sources import base, code_graph


def reach(edges, start):
    seen, todo = set(), [start]
    while todo:
        for a, b in edges:
            if a == todo[0] and b not in seen:
                seen.add(b)
                todo.append(b)
        todo.pop(0)
    return seen


def test_nodes_on_cycles_are_those_that_reach_themselves(spark):
    r = random.Random(2)
    cases = [[("A", "B"), ("B", "C"), ("C", "B")], [("a", "a"), ("a", "b")], [("a", "b"), ("b", "a"), ("b", "x"), ("x", "c"), ("c", "d"), ("d", "c")], []]
    cases += [[(f"n{r.randrange(12)}", f"n{r.randrange(12)}") for _ in range(14)] for _ in range(2)]
    for e in cases:
        got = graphs.nodes_on_cycles(spark.createDataFrame(e, "src string, dst string"))
        assert {x.node for x in got.collect()} == {n for n in itertools.chain(*e) if n in reach(e, n)}


def test_cyclic_part_is_pruned_from_both_ends(spark):
    left = graphs.cyclic_part(spark.createDataFrame([("u", "a"), ("a", "b"), ("b", "a"), ("b", "c"), ("c", "d")], "src string, dst string"))
    assert {tuple(x) for x in left.collect()} == {("a", "b"), ("b", "a")}


GROUPS = "group_id long, parent_id long, prefix string, middleware array<string>"


def test_prefixes_of_any_depth(spark):
    rows = [(i, i - 1 if i else None, f"/p{i}", [f"m{i}"]) for i in range(40)]
    got = {r.group_id: r for r in history.compose_prefixes(spark.createDataFrame(rows, GROUPS)).collect()}
    assert len(got) == 40 and got[39].prefix == "".join(f"/p{i}" for i in range(40)) and len(got[39].middleware) == 40
    with pytest.raises(ValueError):
        history.compose_prefixes(spark.createDataFrame([(1, 2, "/a", None), (2, 1, "/b", None)], GROUPS))
    assert history.compose_prefixes(spark.createDataFrame([(1, 9, "/a", None)], GROUPS)).count() == 0


def matches(pattern, path):
    p, q = pattern.rstrip("/").split("/"), path.rstrip("/").split("/")
    for i, s in enumerate(p):
        if s.startswith("*"):
            return len(q) >= i
        if i >= len(q) or not (s.startswith(":") or s == q[i]):
            return False
    return len(p) == len(q)


def test_route_candidates_are_those_of_brute_force(spark):
    """Literals in any place, parameters first, wildcards with and without a literal before them."""
    r = random.Random(6)
    words = ["a", "b", ":x", "*"]
    patterns = sorted({"/" + "/".join(w for w in (r.choice(words) for _ in range(r.randint(1, 4)))) for _ in range(60)})
    patterns = [p for p in patterns if "*" not in p[:-1]]
    calls = ["/" + "/".join(r.choice("abc") for _ in range(r.randint(1, 5))) for _ in range(40)]
    c = spark.createDataFrame([(i, "ui", t, None, None) for i, t in enumerate(calls)], "call_id long, root_name string, target string, method string, base_identifier string")
    got = link.route_candidates(c, spark.createDataFrame([("api", None, p) for p in patterns], "root_name string, method string, path string"))
    assert sorted((x.call_id, x.route_path) for x in got.collect()) == sorted((i, p) for i, t in enumerate(calls) for p in patterns if matches(p, t))


FILES = "root_name string, rel_path string, content string"
MANIFESTS = {
    "a/Cargo.toml": '[package]\nname = "x"\n[dependencies]\nserde = "1.0"\ntokio = { version = "1.3", features = ["full"] }\n# note = "2"\n[dev-dependencies]\nproptest = "1"\n[build-dependencies]\ncc = "1.1"\n',
    "b/pyproject.toml": '[project]\nname = "x"\nrequires-python = ">=3.11"\ndependencies = [\n  "requests>=2",\n  "rich[jupyter]",\n]\n[project.scripts]\nrun-me = "x:main"\n[tool.poetry.group.dev.dependencies]\npytest = "^8"\n[tool.poetry.dependencies]\npython = "^3.11"\nhttpx = "0.27"\n',
    "c/composer.json": json.dumps({"require": {"php": ">=8", "ext-json": "*", "v/p": "^2"}, "require-dev": {"v/t": "1"}}),
    "d/pom.xml": "<project><dependencies><dependency><groupId>g</groupId><artifactId>a</artifactId><version>${v}</version></dependency><dependency>\n<groupId>g</groupId><artifactId>t</artifactId><scope>test</scope></dependency></dependencies></project>",
    "e/go.mod": "module m\ngo 1.22\nrequire (\n\tgolang.org/x/y v1.2.3\n\tgithub.com/a/b v0.1.0 // indirect\n)\n", "f/package.json": json.dumps({"engines": {"node": ">=20"}, "bin": {"tool": "./t.js"}, "dependencies": {"q": "1"}}), "g/Gemfile": "gem 'x'", "h/x.csproj": "<x/>", "i/App.csproj": "<x/>",
}
LOCKS = {
    "a/Cargo.lock": 'version = 3\n[[package]]\nname = "serde"\nversion = "1.0.2"\nsource = "r"\n[[package]]\nname = "cc"\nversion = "1.1.0"\n', "b/poetry.lock": '[[package]]\nname = "httpx"\nversion = "0.27.0"\ndescription = ""\n[package.dependencies]\nname = "no"\n',
    "c/composer.lock": json.dumps({"packages": [{"name": "v/p", "version": "v2.1.0"}], "packages-dev": [{"name": "v/t", "version": "1.0"}]}), "d/pnpm-lock.yaml": "lockfileVersion: '9.0'\npackages:\n\n  '@s/p@1.2.3':\n    resolution: {integrity: x}\n\n  left-pad@1.3.0(react@18.0.0):\n    resolution: {}\n",
    "e/Gemfile.lock": "GEM\n  specs:\n    rails (7.1.2)\n      actionpack (= 7.1.2)\n    rake (13.0)\n",
}


def test_manifests(spark):
    f = spark.createDataFrame([("r", p, c) for p, c in MANIFESTS.items()], FILES)
    got = {(x.dir, x.ecosystem, x.name, x.version_constraint, x.scope) for x in scans.read_manifests(f).collect()}
    assert got == {
        ("a", "cargo", "serde", "1.0", "runtime"), ("a", "cargo", "tokio", "1.3", "runtime"), ("a", "cargo", "proptest", "1", "development"), ("a", "cargo", "cc", "1.1", "build"),
        ("b", "pip", "requests", ">=2", "runtime"), ("b", "pip", "rich", None, "runtime"), ("b", "pip", "pytest", "^8", "development"), ("b", "pip", "httpx", "0.27", "runtime"),
        ("c", "composer", "v/p", "^2", "runtime"), ("c", "composer", "v/t", "1", "development"), ("d", "maven", "g:a", "${v}", "runtime"), ("d", "maven", "g:t", None, "development"),
        ("e", "go", "golang.org/x/y", "v1.2.3", "runtime"), ("e", "go", "github.com/a/b", "v0.1.0", "transitive"), ("f", "npm", "q", "1", "runtime"),
    }
    assert {(x.platform, x.version_constraint) for x in scans.manifest_platforms(f).collect()} == {("node", ">=20"), ("go", "1.22"), ("python", ">=3.11")}
    assert {(x.dir, x.name) for x in scans.manifest_executables(f).collect()} == {("f", "tool"), ("b", "run-me")}
    assert sorted(x.ecosystem for x in scans.manifest_gaps(f).collect()) == ["bundler", "nuget"]


def test_lockfiles(spark):
    got = {(x.dir, x.name, x.version) for x in scans.read_lockfiles(spark.createDataFrame([("r", p, c) for p, c in LOCKS.items()], FILES)).collect()}
    assert got == {("a", "serde", "1.0.2"), ("a", "cc", "1.1.0"), ("b", "httpx", "0.27.0"), ("c", "v/p", "2.1.0"), ("c", "v/t", "1.0"), ("d", "@s/p", "1.2.3"), ("d", "left-pad", "1.3.0"), ("e", "rails", "7.1.2"), ("e", "rake", "13.0")}


def test_labels_and_configuration_keys(spark):
    f = spark.createDataFrame([("r", "a.vue", '<button>Save all</button><input placeholder="Your name" :label="x">'), ("r", ".env", "A_KEY=secret\nexport B=1\n# C=2"), ("r", "c.json", json.dumps({"db": {"host": "h", "pool": {"max": 3}}, "debug": True})), ("r", "d.yml", "top: 1\n  under: x\nurl://no")], FILES)
    assert {x.label for x in scans.ui_labels(f).collect()} >= {"Save all", "Your name"}
    assert {(x.rel_path, x.key) for x in scans.config_keys(f).collect()} == {(".env", "A_KEY"), (".env", "B"), ("d.yml", "top"), ("d.yml", "under")}
    assert {x.key for x in scans.json_config_keys(f).collect()} == {"db", "db.host", "db.pool", "db.pool.max", "debug"}


def test_scans_place_matches_by_line_and_column(spark):
    text = "é x.Begin(\n\n  y.Begin( z.Begin(\nInsert INSERT  INTO"
    got = scans.scan_patterns(spark.createDataFrame([("r", "a.go", text), ("r", "b.go", None), ("r", "c.txt", "x.Begin(")], FILES))
    assert sorted((x.rel_path, x.label, x.line, x.column, x.detail) for x in got.collect()) == [("a.go", "Begin", 1, 4, None), ("a.go", "Begin", 3, 4, None), ("a.go", "Begin", 3, 13, None), ("a.go", "sql", 4, 8, "INSERT  INTO")]


def test_code_graph_versions(spark, tmp_path):
    folder = str(tmp_path / "graph")
    spark.createDataFrame([("7",)], "version string").write.parquet(f"{folder}/meta")
    spark.createDataFrame([(1, "a.go")], "id long, file_path string").write.parquet(f"{folder}/nodes")
    spark.createDataFrame([(1, 2)], "from_id long, to_id long").write.parquet(f"{folder}/edges")
    nodes, edges = code_graph.read_code_graph(spark, folder, "7")
    assert nodes.count() == edges.count() == 1
    with pytest.raises(ValueError):
        code_graph.read_code_graph(spark, folder, "8")


def test_behaviour_is_validated_before_it_is_written(spark, tmp_path):
    facts = spark.createDataFrame([("a", "k"), ("b", "odd")], "fact_id string, kind string")
    rel = spark.createDataFrame([("a", "b")], "from_id string, to_id string")
    notes = lambda why: spark.createDataFrame([("b", why)], "fact_id string, reason string")
    with pytest.raises(ValueError):
        base.write_behavior(facts, rel, str(tmp_path), "s", violations=notes("no evidence"))
    base.write_behavior(facts, rel, str(tmp_path), "s", violations=notes("quarantined: unknown kind"))
    got, _ = base.read_behavior(spark, str(tmp_path), "s")
    assert {(x.fact_id, x.quarantined) for x in got.collect()} == {("a", False), ("b", True)}


def test_migrations_keep_identity_and_evidence(spark):
    f = spark.createDataFrame([("a", 1)], "fact_id string, evidence int")
    with pytest.raises(LookupError):
        base.migrate_facts(f, {}, 1, 2)
    with pytest.raises(ValueError):
        base.migrate_facts(f, {1: lambda d: d.withColumn("evidence", F.lit(2))}, 1, 2)


def test_small_functions(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(names.entity_term(F.lit("shop_order_items"), F.lit("shop_"))) == "order"
    assert one(paths.route_surface(F.lit(None).cast("string"), F.lit("a/b.vue"))) == "client" and one(paths.route_surface(F.lit("GET"), F.lit("a/b.vue"))) == "server"
    assert one(grades.counts_in_denominator(F.lit("not-applicable"))) is False and one(grades.is_coverage_gap(F.lit("never heard"))) is True
    text = one(grades.map_diagram(F.array(F.struct(F.lit("a").alias("source"), F.lit("b").alias("target"), F.lit("internal").alias("kind")))))
    assert text.startswith("flowchart LR\n  n_") and '["a"] --> n_' in text
    caps = spark.createDataFrame([("p", "k", "supplied", 2), ("o", "k", "absent", 0)], "provider_id string, kind string, outcome string, records long")
    assert [x.provider_id for x in base.read_capability_results(caps).collect()] == ["o", "p"] and base.read_capability_results(caps, "p").count() == 1
    assert [tuple(x) for x in base.read_evidence_conflicts(spark.createDataFrame([("k", "t", ["u", "v"])], "key string, text string, conflicts array<string>")).collect()] == [("k", "t", "u"), ("k", "t", "v")]
    assert audit.identity_namespaces(spark.createDataFrame([("a|b",), ("c",)], "key string")).count() == 1
    assert wiring.languages_without(spark.createDataFrame([("r", "a.rs", "")], FILES), ("go",)).first().language == "rs"
    assert one(health.severity_rank(F.lit("notice"))) == 1 and one(health.severity_rank(F.lit("odd"))) == 3
