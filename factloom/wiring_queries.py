"""More registered queries: records at rest, keys, model facts, features, behaviour input and drift, with the SQL that they are held against."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import grades, keys, names, paths
from .operators import audit, behavior, effects, flows, graphs, health, history, lexing, link, merge, modules, reads, rules, scans, wiring
from .plans import adapters as ad
from .queries import SCORED_SQL, SETS_SQL, query, size_sets, type_conditions
from .sources import base, code_graph

WORDS_SQL = "list_filter(string_split_regex(lower(regexp_replace({c}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[^a-z0-9]+'), lambda w: len(w) > 2 AND NOT regexp_matches(w, '^[0-9]+$'))"


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ad.table(spark, sf_dir, "part")


def type_word() -> F.Column:
    return F.element_at(F.split("p_type", " "), -1)


# The base at rest -----------------------------------------------------------------------------------------------------------------


@query("""SELECT p_brand || '|' || p_partkey AS record_key, p_partkey AS line, p_type AS detail FROM part WHERE p_size <= 25""")
def s7_s11_records(spark, sf_dir):
    """Written with a second kind and a second snapshot, read back typed."""
    folder = f"{graphs.shared_folder(spark)}/base-{uuid.uuid4().hex}"
    r = parts(spark, sf_dir).select(F.when(F.col("p_size") > 25, "large").otherwise("small").alias("kind"), keys.join_key("p_brand", "p_partkey").alias("record_key"), F.col("p_brand").alias("root_name"), F.col("p_partkey").alias("line"), F.col("p_type").alias("detail"))
    for snapshot in ("one", "two"):
        base.write_facts(r, folder, snapshot)
    return base.read_records(spark, folder, "two", "small", "line bigint, detail string").select("record_key", "line", "detail")


@query("""SELECT p_brand AS record_key, max(p_partkey) AS last, (SELECT count(DISTINCT p_brand) FROM part) AS inserted, (SELECT count(*) - count(DISTINCT p_brand) FROM part) AS replaced FROM part GROUP BY 1""")
def s8_s11_derived(spark, sf_dir):
    """The last of each key stays; the counts say how many keys met."""
    folder = f"{graphs.shared_folder(spark)}/base-{uuid.uuid4().hex}"
    p = parts(spark, sf_dir)
    r = p.select(F.lit("brand").alias("kind"), F.col("p_brand").alias("record_key"), F.col("p_partkey").alias("ordinal"), F.to_json(F.struct(F.col("p_partkey").alias("last"))).alias("payload"))
    n = base.write_derived(r, folder, "s")
    return base.read_derived(spark, folder, "s", "brand", "last bigint").withColumns({"inserted": F.lit(n["inserted"]).cast("long"), "replaced": F.lit(n["replaced"]).cast("long")})


@query("""SELECT DISTINCT 'o' || o_custkey AS fact_id, o_orderstatus AS kind, o_orderstatus = 'P' AS quarantined FROM orders""")
def s9_behavior(spark, sf_dir):
    """A model whose one unknown kind is quarantined, written and read."""
    folder = f"{graphs.shared_folder(spark)}/base-{uuid.uuid4().hex}"
    f = ad.table(spark, sf_dir, "orders").select(F.concat(F.lit("o"), "o_custkey").alias("fact_id"), F.col("o_orderstatus").alias("kind")).distinct()
    bad = f.where("kind = 'P'").select("fact_id", F.lit("quarantined: unknown kind").alias("reason"))
    model = f.join(bad.select("fact_id", F.lit("P").alias("kind"), F.lit(True).alias("q")), ["fact_id", "kind"], "left")
    one = model.withColumn("fact_id", F.concat_ws("#", "fact_id", "kind")).drop("q")
    notes = one.where("kind = 'P'").select("fact_id", F.lit("quarantined: unknown kind").alias("reason"))
    base.write_behavior(one, one.select(F.col("fact_id").alias("from_id"), F.col("kind").alias("to_id")), folder, "s", 10**9, 10**9, violations=notes)
    return base.read_behavior(spark, folder, "s")[0].select(F.substring_index("fact_id", "#", 1).alias("fact_id"), "kind", "quarantined")


@query(f"""WITH {ad.CONTRIBUTIONS_SQL} SELECT h.key, 'total' AS field, l.total AS value FROM head h JOIN lines l USING (key) WHERE h.total <> l.total UNION ALL SELECT h.key, 'status', l.status FROM head h JOIN lines l USING (key) WHERE h.status <> l.status""")
def s12_conflicts(spark, sf_dir):
    c = base.read_conflicts(merge.merge_facts(ad.orders_as_contributions(spark, sf_dir)))
    return c.select("key", "field", "value")


@query(f"""WITH {ad.CONTRIBUTIONS_SQL} SELECT coalesce(h.key, l.key) AS key, coalesce(h.total, l.total) AS kept, CASE WHEN h.total <> l.total THEN l.total END AS lost FROM head h FULL JOIN lines l USING (key)""")
def a4_retained_values(spark, sf_dir):
    r = wiring.retained_values(merge.merge_facts(ad.orders_as_contributions(spark, sf_dir)), "total")
    return r.select("key", "kept", F.array_join("lost", ",").alias("lost")).withColumn("lost", F.nullif("lost", F.lit("")))


@query("""SELECT c_nationkey::VARCHAR AS from_id, c_custkey::VARCHAR AS to_id, 'rule' AS role FROM customer WHERE c_nationkey = 7""")
def s13_d17_links(spark, sf_dir):
    """A feature's rules among all links."""
    c = ad.table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("feature_id"), F.col("c_custkey").alias("rule_id"))
    f = ad.table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("feature_id"), F.col("s_suppkey").alias("flow_id"))
    m = ad.table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("module_id"), F.col("n_nationkey").alias("feature_id"))
    return base.read_links(flows.feature_links(f, c, m), from_id="7", role="rule")


@query("""SELECT DISTINCT s_nationkey::VARCHAR AS from_id, s_suppkey::VARCHAR AS to_id, 'flow' AS role FROM supplier UNION SELECT DISTINCT c_nationkey::VARCHAR, c_custkey::VARCHAR, 'rule' FROM customer UNION SELECT DISTINCT n_regionkey::VARCHAR, n_nationkey::VARCHAR, 'feature' FROM nation""")
def d17_feature_links(spark, sf_dir):
    c = ad.table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("feature_id"), F.col("c_custkey").alias("rule_id"))
    f = ad.table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("feature_id"), F.col("s_suppkey").alias("flow_id"))
    return flows.feature_links(f, c, ad.table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("module_id"), F.col("n_nationkey").alias("feature_id")))


@query("""SELECT p_partkey AS fact_id, p_size + 1 AS evidence, lower(p_type) AS kind FROM part""")
def s16_migrate(spark, sf_dir):
    """Two steps that rename a kind and keep identity and evidence."""
    f = parts(spark, sf_dir).select(F.col("p_partkey").alias("fact_id"), (F.col("p_size") + 1).alias("evidence"), F.col("p_type").alias("kind"))
    return base.migrate_facts(f, {1: lambda d: d.withColumn("kind", F.upper("kind")), 2: lambda d: d.withColumn("kind", F.lower("kind"))}, 1, 3)


GRAPH_NODES_SQL = f"""{ad.GRAPH_SQL}, nodes AS (SELECT DISTINCT caller_id AS id, CASE WHEN caller_id LIKE 'p%' THEN 'import' WHEN caller_id LIKE 's%' THEN 'route' ELSE 'function' END AS kind, CASE WHEN caller_id LIKE 's%' THEN 'GET /' || caller_id ELSE 'f-' || caller_id END AS name, substr(caller_id, 1, 1) || '/' || caller_id || '.go' AS file_path FROM edges WHERE caller_id NOT LIKE 'n%'),
own AS (SELECT *, 'root-' || substr(id, 1, 1) AS root_name, id || '.go' AS rel_path FROM nodes WHERE id NOT LIKE '%7'), e AS (SELECT caller_id AS f, callee_id AS t, CASE edge_ord % 4 WHEN 0 THEN 'calls' WHEN 1 THEN 'extends' WHEN 2 THEN 'instantiates' ELSE 'reads' END AS kind FROM edges)"""


def graph_facts(spark, sf_dir) -> dict[str, DataFrame]:
    """The supply graph as a code graph; files whose name ends in 7 are not in the inventory."""
    e = graphs.cut(ad.supply_graph(spark, sf_dir))
    i = F.col("id")
    n = graphs.cut(e.select(F.col("caller_id").alias("id")).where("caller_id not like 'n%'").distinct())
    kind = F.when(i.startswith("p"), "import").when(i.startswith("s"), "route").otherwise("function")
    n = n.select("id", kind.alias("kind"), F.when(i.startswith("s"), F.concat(F.lit("GET /"), i)).otherwise(F.concat(F.lit("f-"), i)).alias("name"), F.concat(F.substring(i, 1, 1), F.lit("/"), i, F.lit(".go")).alias("file_path"))
    roots = n.select(F.substring("file_path", 1, 1).alias("prefix")).distinct().withColumn("root_name", F.concat(F.lit("root-"), "prefix"))
    files = n.where("id not like '%7'").select(F.concat(F.lit("root-"), F.substring("id", 1, 1)).alias("root_name"), F.concat("id", F.lit(".go")).alias("rel_path"))
    k = F.col("edge_ord") % 4
    edges = e.select(F.col("caller_id").alias("from_id"), F.col("callee_id").alias("to_id"), F.when(k == 0, "calls").when(k == 1, "extends").when(k == 2, "instantiates").otherwise("reads").alias("kind"))
    return code_graph.graph_to_facts(n, edges, roots, files)


@query(f"""WITH {GRAPH_NODES_SQL} SELECT 'symbols' AS records, root_name, id AS what FROM own WHERE kind = 'function' UNION ALL SELECT 'imports', root_name, name FROM own WHERE kind = 'import' UNION ALL SELECT 'routes', root_name, 'GET /' || id FROM own WHERE kind = 'route'""")
def s4_graph_records(spark, sf_dir):
    r = F.col("records")
    what = F.when(r == "symbols", F.col("id")).when(r == "imports", F.col("name")).otherwise(F.concat_ws(" ", "method", "path"))
    return graph_facts(spark, sf_dir)["nodes"].select("records", "root_name", what.alias("what"))


@query(f"""WITH {GRAPH_NODES_SQL} SELECT CASE e.kind WHEN 'calls' THEN 'call_edges' WHEN 'extends' THEN 'type_relations' ELSE 'references' END AS records, own.root_name, CASE e.kind WHEN 'instantiates' THEN 'instantiate' ELSE e.kind END AS kind, count(*) AS n, count(nodes.id) AS resolved
FROM e JOIN own ON own.id = e.f LEFT JOIN nodes ON nodes.id = e.t GROUP BY ALL""")
def s4_graph_edges(spark, sf_dir):
    return graph_facts(spark, sf_dir)["edges"].groupBy("records", "root_name", "kind").agg(F.count("*").alias("n"), F.count("to_id").alias("resolved"))


# Expressions ------------------------------------------------------------------------------------------------------------------------


@query(r"""SELECT p_partkey, p_brand || '|' || lower(p_type) || '.go|' || p_size AS symbol, p_brand || '|' || p_name AS file, p_brand || '|' || p_type AS entity, p_brand || '|GET|/' || p_partkey AS route, p_brand || '|' || p_type || '|' || p_size || '|' || p_brand || '|x|' || p_size AS rule FROM part""")
def e2_e3_record_keys(spark, sf_dir):
    p = parts(spark, sf_dir).withColumns({"root_name": F.col("p_brand"), "name": F.col("p_type"), "method": F.lit("GET"), "path": F.concat(F.lit("/"), "p_partkey"), "rel_path": F.col("p_type"), "start_line": F.col("p_size"), "subject": F.col("p_brand"), "operator": F.lit("x"), "literal": F.col("p_size")})
    return p.select("p_partkey", keys.join_key("p_brand", F.concat(F.lower("p_type"), F.lit(".go")), "p_size").alias("symbol"), keys.file_id("p_brand", "p_name").alias("file"), keys.record_key("entity").alias("entity"), keys.record_key("route").alias("route"), keys.derived_key("business-rule").alias("rule"))


@query(r"""SELECT page_id, regexp_extract(url, '^https?://([^/]*)', 1) AS base, '/v2/:param/' || page_id AS path, 'GET' AS method, CASE WHEN page_id % 2 = 0 THEN 'client' ELSE 'server' END AS surface, page_id % 3 = 0 AS test FROM pages""")
def e22_e24_templates(spark, sf_dir):
    p, i = ad.table(spark, sf_dir, "pages"), F.col("page_id")
    host = F.regexp_extract("url", "^https?://([^/]*)", 1)
    t = paths.parse_url_template(F.concat(F.lit("${config."), F.translate(host, ".", "_"), F.lit("}/v2/${id}/"), i.cast("string"), F.lit("?q=1")))
    name = paths.parse_route_name(F.concat(F.lit("GET "), t["path"]))
    path = F.when(i % 3 == 0, F.lit("src/tests/a.go")).otherwise("src/attest/a.go")
    surface = paths.route_surface(F.when(i % 2 == 1, F.lit("GET")), F.when(i % 2 == 0, "a/b.vue").otherwise("a/b.go"))
    return p.select("page_id", host.alias("h"), t["base"].alias("b"), name["path"].alias("path"), name["method"].alias("method"), surface.alias("surface"), names.is_test_path(path).alias("test")).select("page_id", F.when(F.translate("h", ".", "_") == F.col("b"), F.col("h")).alias("base"), "path", "method", "surface", "test")


@query("""SELECT event_id, CASE WHEN event_type = 'error' THEN 'unresolved' WHEN value > 50 THEN 'conditional' ELSE 'active' END AS activation, CASE WHEN value > 90 THEN 'covered' WHEN value < 5 THEN 'gaps' WHEN event_type = 'view' THEN 'covered' ELSE 'gaps' END AS section FROM events""")
def e26_e29_activation(spark, sf_dir):
    e = ad.table(spark, sf_dir, "events")
    v, t = F.col("value"), F.col("event_type")
    state = F.when(v > 90, "partial").when(v < 5, "unsupported").when(t == "view", "observed").otherwise("unheard of")
    return e.select("event_id", grades.activation_from_observation(t != "error", v > 50).alias("activation"), grades.coverage_section(state).alias("section"))


@query(f"""WITH {SETS_SQL}, {SCORED_SQL}, x1 AS (SELECT condition_id, first(name ORDER BY score DESC, ord) AS set_name FROM x WHERE list_contains(m, literal) GROUP BY 1) SELECT c.condition_id, c.operator IN ('==') AND x1.set_name IS NOT NULL AS named FROM c LEFT JOIN x1 USING (condition_id)""")
def e32_j9_state_rules(spark, sf_dir):
    """Which equality tests get a member's name in words."""
    r = rules.state_rules(type_conditions(spark, sf_dir), size_sets(spark, sf_dir))
    return r.join(type_conditions(spark, sf_dir).select("condition_id", "operator"), "condition_id").select("condition_id", ((F.col("operator") == "==") & ~rules.is_unexplained(F.col("meanings"))).alias("named"))


# Features and modules ----------------------------------------------------------------------------------------------------------------


@query(f"""WITH {ad.ROUTES_SQL}, w AS (SELECT DISTINCT path, unnest({WORDS_SQL.format(c="path")}) AS w FROM routes), t AS (SELECT DISTINCT path, CASE WHEN w LIKE '%ies' AND len(w) > 4 THEN w[:-4] || 'y' WHEN w LIKE '%ses' OR w LIKE '%xes' OR w LIKE '%hes' THEN w[:-3] WHEN w LIKE '%s' AND w NOT LIKE '%ss' AND len(w) > 3 THEN w[:-2] ELSE w END AS term FROM w),
f AS (SELECT term, count(DISTINCT path) AS weight FROM t GROUP BY 1) SELECT path, (SELECT first(f.term ORDER BY weight DESC, f.term DESC) FROM t JOIN f USING (term) WHERE t.path = r.path) AS term FROM (SELECT DISTINCT path FROM routes) r""")
def d3_j10_features(spark, sf_dir):
    """Every route's heaviest word; a word weighs as many routes as hold it."""
    r = ad.pages_as_routes(spark, sf_dir)
    term = r.select("path").distinct().withColumn("term", F.explode(F.array_distinct(F.transform(names.words(F.col("path")), names.singular)))).groupBy("term").agg(F.countDistinct("path").alias("weight"))
    return modules.feature_for_route(r, term)


@query(f"""WITH {ad.ROUTES_SQL}, g AS (SELECT string_split(path, '/')[2] AS key, count(*) AS n FROM routes WHERE string_split(path, '/')[2] <> '' GROUP BY 1), s AS (SELECT count(*) > 0 AND sum(n) < 1000000 * count(*) AS scattered FROM g)
SELECT root_name AS name, count(*) AS entries FROM routes GROUP BY 1""")
def d5_modules_by_root(spark, sf_dir):
    """With bounds that no grouping by resource meets, one module a root."""
    r = ad.pages_as_routes(spark, sf_dir).withColumn("entry_id", keys.join_key("root_name", "path"))
    return modules.form_modules_from_routes(r, most=0, least=1_000_000).select("name", "entries")


@query(f"""WITH {ad.ROUTES_SQL}, s AS (SELECT path, string_split(path, '/') AS p FROM routes), n AS (SELECT min(len(p)) AS least FROM s)
SELECT coalesce((SELECT min(i) - 1 FROM range(1, 20) t(i), n WHERE i < least AND (SELECT count(DISTINCT p[i]) FROM s WHERE i < len(p)) <> 1), least - 1)::INT AS n FROM n""")
def d2_shared_prefix(spark, sf_dir):
    return modules.shared_prefix_length(ad.pages_as_routes(spark, sf_dir))


@query("""SELECT p_size AS entity, array_to_string(list(root ORDER BY root), ',') AS roots, sum(n)::BIGINT AS columns FROM (SELECT p_size, p_brand AS root, count(DISTINCT p_type) AS n FROM part GROUP BY 1, 2) GROUP BY 1""")
def d20_gather_entities(spark, sf_dir):
    g = wiring.gather_entities(parts(spark, sf_dir).select(F.col("p_brand").alias("root_name"), F.col("p_size").alias("entity"), F.col("p_type").alias("name")))
    return g.select("entity", F.array_join(F.array_sort(F.map_keys("columns")), ",").alias("roots"), F.aggregate(F.map_values("columns"), F.lit(0).cast("long"), lambda a, c: a + F.size(c)).alias("columns"))


@query("""SELECT DISTINCT 'entity' AS kind, p_brand AS root_name, p_type AS entity, p_type AS name FROM part UNION ALL SELECT 'entity-field', p_brand, p_type, p_name FROM part UNION ALL SELECT 'entity-relation', s_name, s_suppkey::VARCHAR, s_nationkey::VARCHAR FROM supplier UNION ALL SELECT 'entity-constraint', c_mktsegment, c_custkey::VARCHAR, c_name FROM customer""")
def a6_data_model(spark, sf_dir):
    s = lambda c: F.col(c).cast("string")
    fields = parts(spark, sf_dir).select(F.col("p_brand").alias("root_name"), F.col("p_type").alias("entity"), F.col("p_name").alias("name"))
    relations = ad.table(spark, sf_dir, "supplier").select(F.col("s_name").alias("root_name"), s("s_suppkey").alias("from"), s("s_nationkey").alias("to"))
    return wiring.data_model_records(fields, relations, ad.table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("root_name"), s("c_custkey").alias("entity"), F.col("c_name").alias("expression")))


@query("""SELECT o_custkey AS id, array_to_string(list_sort(list_distinct(list(o_orderpriority))), ',') AS providers FROM orders GROUP BY 1""")
def a8_providers(spark, sf_dir):
    o = ad.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.collect_list(F.struct(F.col("o_orderpriority").alias("provider_id"), "o_orderkey")).alias("evidence"))
    return o.select("id", F.array_join(merge.contributing_providers(F.col("evidence")), ",").alias("providers"))


# Flows and findings --------------------------------------------------------------------------------------------------------------------


@query("""WITH m AS (SELECT DISTINCT c_custkey AS flow_id, s_name AS label FROM customer JOIN supplier ON s_nationkey = c_nationkey) SELECT flow_id, label FROM (SELECT *, row_number() OVER (PARTITION BY flow_id ORDER BY label) AS k FROM m) WHERE k <= 6""")
def j13_flow_outbound(spark, sf_dir):
    scopes = ad.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("flow_id"), F.col("c_nationkey").alias("scope"))
    return flows.flow_outbound(scopes, ad.table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("scope"), F.col("s_name").alias("label")))


@query("""WITH i AS (SELECT DISTINCT o_custkey AS f, o_orderkey % 7 AS ty FROM orders), st AS (SELECT o_custkey AS f, o_orderkey AS pos, o_orderkey % 50 AS s FROM orders),
m AS (SELECT DISTINCT o_orderkey % 50 AS s, (o_orderkey % 50) % 11 AS ty, (o_orderkey % 50) % 3 AS name FROM orders), here AS (SELECT st.*, m.ty, m.name FROM st JOIN m USING (s) WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.f = st.f AND i.ty = m.ty)),
c AS (SELECT h.f, h.pos, count(DISTINCT m.s) AS n, min(m.s) AS s FROM here h JOIN m ON m.name = h.name AND m.ty % 2 = h.ty % 2 AND m.s <> h.s JOIN i ON i.f = h.f AND i.ty = m.ty GROUP BY 1, 2)
SELECT st.f AS flow_id, st.pos, coalesce(c.s, st.s) AS symbol_id FROM st LEFT JOIN c USING (f, pos) WHERE c.n IS NULL OR c.n = 1""")
def j14_contextual_steps(spark, sf_dir):
    o = ad.table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    s = k % 50
    methods = o.select(s.alias("symbol_id"), (s % 11).alias("type_id"), (s % 3).alias("name")).distinct()
    return flows.contextual_steps(o.select(F.col("o_custkey").alias("flow_id"), k.alias("pos"), s.alias("symbol_id")), methods, methods.select("type_id", (F.col("type_id") % 2).alias("super")).distinct(), o.select(F.col("o_custkey").alias("flow_id"), (k % 7).alias("type_id")).distinct())


@query(f"""WITH {ad.CONDITIONS_SQL}, k AS (SELECT *, lower(regexp_extract(subject, '([A-Z]?[a-z0-9]+|[A-Z0-9]+)$', 1)) AS sk, literal % 3 = 0 AS named FROM conditions), r AS (SELECT sk, literal, root_name, min(operator) AS operator FROM k GROUP BY 1, 2, 3 HAVING count(DISTINCT operator) = 1),
two AS (SELECT sk, literal, count(*) AS n FROM r GROUP BY 1, 2 HAVING count(DISTINCT operator) > 1 AND (bool_and(operator IN ('>', '>=')) OR bool_and(operator IN ('<', '<='))))
SELECT 'rule-applied-two-ways' AS code, sk || ' ' || literal AS subject, n, 'concern' AS severity FROM two UNION ALL SELECT 'values-with-no-declared-meaning', root_name, count(*) FILTER (NOT named), 'notice' FROM k GROUP BY root_name HAVING count(*) FILTER (NOT named) > 0 AND count(*) FILTER (named) > 0
UNION ALL SELECT 'rules-restated-in-many-places', sk || ' ' || operator || ' ' || literal, count(*), 'notice' FROM k GROUP BY sk, operator, literal HAVING count(*) >= 3 UNION ALL SELECT 'failures-nobody-can-observe', event_type, count(*), 'notice' FROM events GROUP BY event_type""")
def d13_logic_findings(spark, sf_dir):
    c = ad.parts_as_conditions(spark, sf_dir).withColumn("named", F.col("literal") % 3 == 0)
    return flows.logic_findings(c, ad.table(spark, sf_dir, "events").select(F.col("event_type").alias("root_name")))


@query("""WITH f AS (SELECT DISTINCT p_type AS code, CASE WHEN p_type LIKE 'S%' THEN 'concern' WHEN p_type LIKE 'P%' THEN 'notice' ELSE 'info' END AS severity, p_brand || '-' || p_size AS name FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY name) AS k, count(*) OVER (PARTITION BY code) AS n FROM f),
g AS (SELECT code, severity, array_to_string(list(name ORDER BY name), ', ') || CASE WHEN first(n) > 8 THEN ' and ' || (first(n) - 8) || ' more' ELSE '' END AS text FROM r WHERE k <= 8 GROUP BY 1, 2)
SELECT code, severity, row_number() OVER (ORDER BY CASE severity WHEN 'concern' THEN 0 WHEN 'notice' THEN 1 ELSE 2 END, code) AS place, text FROM g""")
def d10_o1_named_findings(spark, sf_dir):
    t = F.col("p_type")
    f = parts(spark, sf_dir).select(t.alias("code"), F.when(t.startswith("S"), "concern").when(t.startswith("P"), "notice").otherwise("info").alias("severity"), F.concat_ws("-", "p_brand", "p_size").alias("name")).distinct()
    return health.named_findings(f).drop("named")


@query("""WITH a AS (SELECT source AS root_name, max(n_chars) AS d FROM documents WHERE lang <> 'fr' GROUP BY 1), b AS (SELECT source AS root_name, max(n_chars) AS d FROM documents GROUP BY 1) SELECT root_name FROM a FULL JOIN b USING (root_name) WHERE a.d IS DISTINCT FROM b.d""")
def d25_drift(spark, sf_dir):
    d = ad.table(spark, sf_dir, "documents")
    one = lambda n: d.groupBy(F.col("source").alias("root_name")).agg(F.max(n).alias("digest")).where("digest is not null")
    return health.check_drift(one(F.when(F.col("lang") != "fr", F.col("n_chars"))), one(F.col("n_chars"))).select("root_name")


@query("""SELECT EXISTS (SELECT 1 FROM (SELECT DISTINCT o_custkey FROM orders) EXCEPT SELECT c_custkey FROM customer) AS foreign_ids, NOT EXISTS (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders) AND NOT EXISTS (SELECT o_custkey FROM orders EXCEPT SELECT c_custkey FROM customer) AS same""")
def o3_identity_sets(spark, sf_dir):
    o, c = ad.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id")), ad.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    foreign = audit.missing_items(o, c).agg((F.count("*") > 0).alias("foreign_ids"))
    return foreign.withColumn("same", F.lit(audit.same_identity_set(o, c)))


@query("""WITH e AS (SELECT lower(p_type) AS name, list(DISTINCT p_brand ORDER BY p_brand) AS ids FROM part WHERE p_size < 2 GROUP BY 1) SELECT p_partkey AS relation_id, CASE WHEN ids IS NULL THEN 'unresolved' WHEN len(ids) = 1 THEN 'exact' ELSE 'ambiguous' END AS outcome, coalesce(array_to_string(ids, ','), '') AS candidates FROM part LEFT JOIN e ON e.name = lower(p_type)""")
def j22_align_endpoints(spark, sf_dir):
    p = parts(spark, sf_dir)
    r = p.select(F.col("p_partkey").alias("relation_id"), F.concat(F.lit(" "), F.upper("p_type")).alias("name"))
    return link.align_endpoints(r, p.where("p_size < 2").select(F.col("p_brand").alias("id"), F.col("p_type").alias("name"))).select("relation_id", "outcome", F.array_join("candidates", ",").alias("candidates"))


@query("""SELECT p_partkey AS symbol_id, CASE WHEN p_size % 3 <> 0 OR p_size % 2 <> 0 THEN p_brand || '|go|' || CASE WHEN p_size % 2 <> 0 THEN p_type ELSE '' END || '|' || CASE WHEN p_size % 3 <> 0 THEN p_name ELSE '' END END AS canonical_id, CASE WHEN p_size % 6 = 0 THEN 'anonymous: neither qualified name nor scope' END AS reason FROM part""")
def j22_canonical_symbols(spark, sf_dir):
    s = F.col("p_size")
    p = parts(spark, sf_dir).select(F.col("p_partkey").alias("symbol_id"), F.col("p_brand").alias("root_name"), F.lit("go").alias("language"), F.when(s % 2 != 0, F.col("p_type")).alias("scope"), F.when(s % 3 != 0, F.col("p_name")).otherwise("").alias("qualified_name"))
    return link.canonical_symbols(p)


@query("""SELECT DISTINCT c_custkey AS route_id, 'no feature holds the route' AS reason FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')""")
def d16_skipped_routes(spark, sf_dir):
    f = ad.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("route_id"), F.when(F.col("o_orderstatus") == "P", F.col("o_orderkey")).alias("feature_id"))
    return flows.skipped_routes(ad.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("route_id")), f)


# Graphs and behaviour ----------------------------------------------------------------------------------------------------------------------


@query(f"""WITH {ad.GRAPH_SQL} SELECT caller_id, callee_id FROM edges WHERE caller_id LIKE 'o%'""")
def g6_scope_graph(spark, sf_dir):
    e = ad.supply_graph(spark, sf_dir)
    n = e.select(F.col("caller_id").alias("id")).distinct().withColumn("file_path", F.concat(F.substring("id", 1, 1), F.lit("/"), "id"))
    return effects.scope_graph(n, e, "o")[1].select("caller_id", "callee_id")


@query("""SELECT o_custkey AS entry_id, CASE WHEN max(o_orderkey) % 3 = 0 THEN 'no handler is linked' ELSE 'the handler is no known symbol' END AS reason FROM orders GROUP BY 1 HAVING max(o_orderkey) % 3 <> 1""")
def g1_untraced_entries(spark, sf_dir):
    o = ad.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("entry_id")).agg(F.max("o_orderkey").alias("k"))
    r = o.select("entry_id", F.when(F.col("k") % 3 != 0, F.concat(F.when(F.col("k") % 3 == 1, "known-").otherwise("lost-"), "k")).alias("handler_id"))
    return graphs.untraced_entries(r, r.where("handler_id like 'known-%'").select(F.col("handler_id").alias("id")))


@query(f"""WITH {ad.GRAPH_SQL}, b AS (SELECT DISTINCT callee_id AS node, caller_id AS caller FROM edges WHERE callee_id IS NOT NULL), hub AS (SELECT node FROM b GROUP BY 1 HAVING count(*) > 4), s AS (SELECT DISTINCT 'n' || s_nationkey AS node FROM supplier),
h1 AS (SELECT DISTINCT s.node AS sink, caller AS node FROM s JOIN b USING (node) WHERE s.node NOT IN (SELECT node FROM hub)), h2 AS (SELECT DISTINCT sink, caller AS node FROM h1 JOIN b USING (node) WHERE node NOT IN (SELECT node FROM hub)),
x AS (SELECT node AS sink, node, 0 AS hops FROM s UNION ALL SELECT *, 1 FROM h1 UNION ALL SELECT *, 2 FROM h2)
SELECT node, CASE hops WHEN 0 THEN 'mail-' || sink ELSE 'unknown' END AS channel, CASE WHEN hops > 0 THEN 'reaches:mail-' || sink END AS label, 'low' AS confidence, CASE WHEN node IN (SELECT node FROM hub) THEN 'fan-in bound: callers not followed' WHEN hops = 2 THEN 'hop bound: callers not followed' END AS note FROM x""")
def g4_channel_notes(spark, sf_dir):
    sinks = ad.table(spark, sf_dir, "supplier").select(F.concat(F.lit("n"), "s_nationkey").alias("sink")).distinct().withColumn("node", F.col("sink"))
    return graphs.channel_notes(graphs.reverse_reach(sinks, ad.supply_graph(spark, sf_dir), 2, 4), sinks.select("sink", F.concat(F.lit("mail-"), "sink").alias("channel")))


@query("""SELECT 'behavioral|guard|' || p_brand || '|' || lower(p_brand) || '.go|' || p_partkey || '|' || p_type || '|' || CASE WHEN p_size % 2 = 0 THEN 'stated' ELSE 'error-code' END || '|' || p_name AS fact_id, CASE WHEN p_size > 25 THEN 'symbol' ELSE 'module' END AS scope, CASE WHEN p_size % 2 = 0 THEN p_name END AS message, CASE WHEN p_size % 2 = 1 THEN p_name END AS error_code FROM part""")
def b1_guard_facts(spark, sf_dir):
    return behavior.guard_facts(guards(spark, sf_dir)).select("fact_id", "scope", "message", "error_code")


def guards(spark, sf_dir):
    s = F.col("p_size")
    return parts(spark, sf_dir).select(F.col("p_brand").alias("root_name"), F.concat(F.lower("p_brand"), F.lit(".go")).alias("rel_path"), F.col("p_partkey").alias("start_line"), F.col("p_type").alias("test"), F.when(s % 2 == 0, "stated").otherwise("error-code").alias("message_kind"), F.col("p_name").alias("message"), F.when(s > 25, "f").alias("enclosing_function"), (s % 3 == 0).alias("rejects"))


@query("""SELECT 'behavioral|validation-rule|' || p_brand || '|' || p_type || '|' || p_name || '|' || lower(p_brand) || '.go|' || p_partkey AS fact_id, p_brand AS root_name, p_type AS expression, p_name AS stated FROM part WHERE p_size % 3 = 0""")
def b6_promote_guards(spark, sf_dir):
    return effects.promote_guards(guards(spark, sf_dir))


DECISIONS_SQL = """d AS (SELECT o_orderkey AS id, 'r-' || o_orderstatus AS root, 'f.go' AS path, o_orderkey AS s, o_orderkey + 9 AS e, o_orderpriority AS subject FROM orders), b AS (SELECT l_orderkey AS id, l_linenumber AS i, l_partkey AS line, l_returnflag AS test, CASE WHEN l_linestatus = 'F' THEN 'leaves' ELSE 'falls-through' END AS outcome FROM lineitem),
x AS (SELECT 'behavioral|decision|' || root || '|' || path || '|' || s || '|' || e || '|' || subject AS f, 'behavioral|condition|' || root || '|' || path || '|' || s || '|' || e || '|' || i || '|' || line || '|' || test AS t, outcome FROM d JOIN b USING (id))"""


def decisions(spark, sf_dir):
    d = ad.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("decision_id"), F.concat(F.lit("r-"), "o_orderstatus").alias("root_name"), F.lit("f.go").alias("rel_path"), F.col("o_orderkey").alias("start_line"), (F.col("o_orderkey") + 9).alias("end_line"), F.col("o_orderpriority").alias("subject"), F.lit(False).alias("truncated"))
    b = ad.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("decision_id"), F.col("l_linenumber").alias("branch_idx"), F.col("l_partkey").alias("branch_line"), F.col("l_returnflag").alias("test"), F.when(F.col("l_linestatus") == "F", "leaves").otherwise("falls-through").alias("outcome"))
    return effects.decision_facts(d, b)


@query(f"""WITH {DECISIONS_SQL} SELECT DISTINCT f AS fact_id, 'decision' AS kind, 'conditional' AS activation FROM x UNION ALL SELECT DISTINCT t, 'condition', CASE outcome WHEN 'leaves' THEN 'guarded' ELSE 'conditional' END FROM x""")
def b3_decision_facts(spark, sf_dir):
    return decisions(spark, sf_dir)[0]


@query(f"""WITH {DECISIONS_SQL} SELECT DISTINCT f AS from_id, t AS to_id, 'decision-branch' AS relation, outcome AS role FROM x""")
def b3_decision_branches(spark, sf_dir):
    return decisions(spark, sf_dir)[1]


@query("""SELECT DISTINCT p_brand AS root_name, p_type AS to_state, p_name AS rel_path, p_size AS start_line FROM part WHERE p_size % 2 = 0 AND (p_brand, p_type) IN (SELECT (p_brand, p_type) FROM part WHERE p_size = 7)""")
def j25_state_changes(spark, sf_dir):
    p = parts(spark, sf_dir)
    r = p.select(F.col("p_brand").alias("root_name"), F.col("p_type").alias("member"), F.when(F.col("p_size") % 2 == 0, "write").otherwise("read").alias("context"), F.col("p_name").alias("rel_path"), F.col("p_size").alias("start_line"))
    return effects.observe_state_changes(r, p.where("p_size = 7").select(F.col("p_brand").alias("root_name"), F.col("p_type").alias("member")))


@query("""SELECT DISTINCT 'auth' AS boundary, p_brand AS root_name, CASE WHEN p_size % 2 = 0 THEN 'authorization:gate' ELSE 'authentication:userSession' END AS detail FROM part UNION SELECT 'validation', p_brand, p_type FROM part UNION SELECT 'error-handling', p_brand, CASE WHEN p_size < 10 THEN 'catch-all' ELSE array_to_string(list_sort(string_split(p_type, ' ')), ',') END FROM part
UNION SELECT 'discarded-error', event_type, user_id::VARCHAR FROM events""")
def b5_boundary_facts(spark, sf_dir):
    p = parts(spark, sf_dir)
    root, even = F.col("p_brand").alias("root_name"), F.col("p_size") % 2 == 0
    auth = p.select(root, F.when(even, "gate").otherwise("userSession").alias("mechanism"), F.when(even, "role").alias("requirement"))
    handled = F.when(F.col("p_size") < 10, F.array().cast("array<string>")).otherwise(F.split("p_type", " "))
    return wiring.boundary_facts(auth, p.select(root, F.col("p_type").alias("rule")), p.select(root, handled.alias("handles")), ad.table(spark, sf_dir, "events").select(F.col("event_type").alias("root_name"), F.col("user_id").cast("string").alias("call")))


@query("""WITH r AS (SELECT 'r' || l_suppkey % 5 AS root, 't' || l_orderkey AS t, CASE WHEN l_partkey % 3 > 0 THEN 'x' || l_partkey END AS s, 'x' || l_partkey AS n, 'calls' AS rel FROM lineitem)
SELECT DISTINCT 'behavioral|test-relation|' || root || '|' || t || '|' || CASE WHEN s IS NULL THEN 'name' ELSE 'sym' END || '|' || n || '|' || rel AS fact_id, CASE WHEN s IS NULL THEN 'unresolved' ELSE 'resolved' END AS link FROM r""")
def b8_test_facts(spark, sf_dir):
    return test_facts(spark, sf_dir)[0].select("fact_id", "link")


@query("""SELECT DISTINCT 'r' || l_suppkey % 5 AS root_name, CASE WHEN l_suppkey % 5 < 3 THEN 'covered' ELSE 'not-run' END AS coverage FROM lineitem""")
def b8_test_receipt(spark, sf_dir):
    return test_facts(spark, sf_dir)[1]


def test_facts(spark, sf_dir):
    root, name = F.concat(F.lit("r"), F.col("l_suppkey") % 5), F.concat(F.lit("x"), "l_partkey")
    r = ad.table(spark, sf_dir, "lineitem").select(root.alias("root_name"), F.concat(F.lit("t"), "l_orderkey").alias("test_id"), F.when(F.col("l_partkey") % 3 > 0, name).alias("target_id"), name.alias("target_name"), F.lit("calls").alias("relation"))
    return behavior.test_facts(r, r.where("root_name in ('r0', 'r1', 'r2')").select("root_name"), r.select("root_name"))


@query("""SELECT DISTINCT o_custkey AS fact_id, 'order' AS kind, 'orders' AS source, 0 AS source_rank FROM orders UNION ALL SELECT c_custkey, c_mktsegment, 'customers', 1 FROM customer""")
def b10_behavior_input(spark, sf_dir):
    o = ad.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("fact_id"), F.lit("order").alias("kind")).distinct()
    return wiring.behavior_input({"orders": o, "customers": ad.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("fact_id"), F.col("c_mktsegment").alias("kind"))})


@query("""SELECT c_custkey AS module_id, coalesce((SELECT count(DISTINCT o_orderpriority) FROM orders WHERE o_custkey = c_custkey), 0)::INT AS endpoints, (SELECT count(DISTINCT s_name) FROM supplier WHERE s_nationkey = c_nationkey)::INT AS entities, least(3, (SELECT count(*) FROM (SELECT DISTINCT s_nationkey, s_suppkey % 4 FROM supplier) x WHERE x.s_nationkey = c_nationkey))::INT AS prose FROM customer""")
def j27_module_facts(spark, sf_dir):
    c, s = ad.table(spark, sf_dir, "customer"), ad.table(spark, sf_dir, "supplier")
    m = wiring.module_facts(
        c.select(F.col("c_custkey").alias("module_id"), F.col("c_nationkey").alias("root_name")), ad.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("module_id"), F.col("o_orderpriority").alias("path")),
        s.select(F.col("s_nationkey").alias("root_name"), F.col("s_name").alias("name")), s.select(F.col("s_nationkey").alias("root_name"), (F.col("s_suppkey") % 4).cast("string").alias("text")),
    )
    return m.select("module_id", F.size("endpoints").alias("endpoints"), F.size(F.coalesce("entities", F.array().cast("array<string>"))).alias("entities"), F.size(F.coalesce("prose", F.array().cast("array<string>"))).alias("prose"))


@query("""SELECT conv_id AS report_id, turn AS section, role || '|' || turn AS identity FROM conversations WHERE role || '|' || turn IN (SELECT role || '|' || turn FROM conversations WHERE turn < 5 AND turn <> 3) GROUP BY ALL""")
def j23_resolved_identities(spark, sf_dir):
    c = ad.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("report_id"), F.col("turn").alias("section"), F.concat_ws("|", "role", "turn").alias("identity"))
    known = c.where("section < 5 and section <> 3").select(F.col("identity").alias("id"))
    return audit.resolve_identities(c.distinct(), [known.where("id <> 'user|4'"), known.where("id = 'user|4'")])


@query("""SELECT DISTINCT role AS namespace FROM conversations""")
def q4_namespaces(spark, sf_dir):
    c = ad.table(spark, sf_dir, "conversations").select(F.concat_ws("|", "role", "turn", "text").alias("key"))
    return audit.identity_namespaces(c.unionByName(c.select(F.lit("bare").alias("key"))))


@query("""SELECT event_id AS report_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE (props->>'$.k')::BIGINT END AS k, CASE WHEN event_id % 5 = 0 THEN 'not the expected JSON' END AS fault FROM events""")
def q5_parse_strict(spark, sf_dir):
    e = ad.table(spark, sf_dir, "events").select(F.col("event_id").alias("report_id"), F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("{{"), "props")).otherwise(F.col("props")).alias("text"))
    return wiring.parse_strict(e, "k bigint").select("report_id", F.col("value.k").alias("k"), "fault")


@query("""SELECT o_orderkey AS report_id FROM orders WHERE o_orderstatus = 'F'""")
def q10_query_log(spark, sf_dir):
    q = F.when(F.col("o_orderstatus") == "F", "SELECT * FROM facts WHERE snapshot_id = 'x'").when(F.col("o_orderstatus") == "O", "SELECT * FROM facts WHERE snapshot_id = :snapshot").otherwise("SELECT 1")
    return audit.audit_query_log(ad.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("report_id"), q.alias("query"))).select("report_id")


@query("""WITH m AS (SELECT count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS k FROM orders) SELECT n AS considered, k AS linked, n - k AS unlinked, true AS sums FROM m""")
def v3_accounting(spark, sf_dir):
    o = ad.table(spark, sf_dir, "orders").withColumn("outcome", F.when(F.col("o_orderstatus") == "F", "linked").otherwise("no-matching-route"))
    return wiring.accounting(o, o)


@query("""WITH ev AS (SELECT l_suppkey % 20 AS root, l_partkey % 15 AS t, CASE WHEN l_returnflag IN ('A', 'R') THEN l_linenumber END AS c, l_orderkey AS f, l_partkey * 10 + l_linenumber AS pos, CASE l_returnflag WHEN 'A' THEN 'add-column' WHEN 'R' THEN 'remove-column' ELSE CASE WHEN l_linestatus = 'O' THEN 'create-table' ELSE 'drop-table' END END AS a FROM lineitem),
k AS (SELECT DISTINCT root, t, c FROM ev WHERE c IS NOT NULL), x AS (SELECT * FROM ev WHERE c IS NOT NULL UNION ALL SELECT ev.root, ev.t, k.c, f, pos, a FROM ev JOIN k ON k.root = ev.root AND k.t = ev.t WHERE a = 'drop-table'),
w AS (SELECT *, row_number() OVER (PARTITION BY root, t, c ORDER BY f DESC, pos DESC) AS n FROM x), l AS (SELECT root, t, first(a ORDER BY f DESC, pos DESC) AS a FROM ev WHERE a IN ('create-table', 'drop-table') GROUP BY 1, 2)
SELECT root AS root_name, t AS table_name, c AS column_name FROM w WHERE n = 1 AND a = 'add-column' AND (root, t) IN (SELECT (root, t) FROM l WHERE a = 'create-table')""")
def x14_orm_migrations(spark, sf_dir):
    flag = F.col("l_returnflag")
    action = F.when(flag == "A", "add-column").when(flag == "R", "remove-column").when(F.col("l_linestatus") == "O", "create-table").otherwise("drop-table")
    e = ad.table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 20).alias("root_name"), F.col("l_orderkey").alias("file_seq"), (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("pos"), action.alias("action"), (F.col("l_partkey") % 15).alias("table_name"), F.when(flag.isin("A", "R"), F.col("l_linenumber")).alias("column_name"), F.lit("t").alias("type"))
    return history.fold_orm_migrations(e).select("root_name", "table_name", "column_name")


@query("""SELECT DISTINCT 'r' AS root_name, CASE lang WHEN 'en' THEN 'go' WHEN 'de' THEN 'java' ELSE 'rs' END AS language FROM documents WHERE lang NOT IN ('en')""")
def x13_gaps(spark, sf_dir):
    ext = F.when(F.col("lang") == "en", "go").when(F.col("lang") == "de", "java").otherwise("rs")
    f = ad.table(spark, sf_dir, "documents").where("lang is not null").select(F.lit("r").alias("root_name"), F.concat_ws(".", F.col("doc_id").cast("string"), ext).alias("rel_path"))
    return wiring.languages_without(f, ("go", "py"))


def code_files(spark, sf_dir, ext, *parts):
    """One file a document: lines made of its id, and its text on one line behind a comment mark."""
    text = F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(" ")), F.lit("\r"), F.lit(" "))
    return ad.table(spark, sf_dir, "documents").select(F.lit("r").alias("root_name"), F.concat(F.col("doc_id").cast("string"), F.lit(ext)).alias("rel_path"), F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts), F.lit("\n// "), text).alias("content"))


def doc_of(df, *columns):
    return df.select(F.regexp_extract("rel_path", "([0-9]+)[.][a-z]+$", 1).cast("long").alias("doc_id"), *columns)


def name_of() -> F.Column:
    return F.col("doc_id").cast("string")


@query(r"""WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '/\*(?:/|[\s\S]*?(?:\*/|\z))|//[^\n]*|''(?:[^''\\]|\\[\s\S])*\\?(?:''|\z)|"(?:[^"\\]|\\[\s\S])*\\?(?:"|\z)|`(?:[^`\\]|\\[\s\S])*\\?(?:`|\z)|#[^\n]*') AS x FROM documents),
c AS (SELECT doc_id, list_filter(x, lambda m: m[1] IN ('/', '#')) AS x FROM t) SELECT doc_id, len(x) AS n, list_sum(list_transform(x, lambda m: length(m)))::BIGINT AS size FROM c WHERE len(x) > 0""")
def x8_comment_spans(spark, sf_dir):
    """Comments of all texts, as a lexer sees them."""
    f = ad.table(spark, sf_dir, "documents").select(F.lit("r").alias("root_name"), F.concat(name_of(), F.lit(".txt")).alias("rel_path"), F.col("text").alias("content"))
    return doc_of(lexing.comments(f), "start", "end").groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.col("end") - F.col("start")).alias("size"))


@query(r"""WITH f AS (SELECT doc_id, doc_id % 3 AS k FROM documents)
SELECT doc_id, 1::BIGINT AS line, 'block' AS form, 'About ' || doc_id || chr(10) || 'more' AS text FROM f WHERE k < 2
UNION ALL SELECT doc_id, 5, 'lines', 'first ' || doc_id || ' second' FROM f WHERE k < 2
UNION ALL SELECT doc_id, 1, 'hash', 'note ' || doc_id FROM f WHERE k = 2
UNION ALL SELECT doc_id, 2, 'hash', 'last' FROM f WHERE k = 2""")
def x8_doc_comments(spark, sf_dir):
    """Block, line and # comments; the text itself stands in the code."""
    k, text = F.col("doc_id") % 3, F.regexp_replace(F.coalesce("text", F.lit("")), r"[/*#\n\r]", " ")
    slash = F.concat(F.lit("/** About "), name_of(), F.lit("\n * more\n */ x = "), text, F.lit("\n\n//  first "), name_of(), F.lit(" \n\t// second\ny // not alone\n// a"))
    hashed = F.concat(F.lit("# note "), name_of(), F.lit("\n  #last\nz = "), text, F.lit(" # no line of its own\n#"))
    f = ad.table(spark, sf_dir, "documents").select(F.lit("r").alias("root_name"), F.concat(name_of(), F.when(k == 0, ".go").when(k == 1, ".ts").otherwise(".py")).alias("rel_path"), F.when(k < 2, slash).otherwise(hashed).alias("content"))
    return doc_of(scans.doc_items(f), "line", "form", "text")


@query(r"""SELECT doc_id, 'label' AS kind, 'Name of ' || doc_id AS name FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, 'label', 'Save it now' FROM documents WHERE doc_id % 2 = 0
UNION ALL SELECT doc_id, 'test', 'Test_' || doc_id FROM documents WHERE doc_id % 2 = 1 UNION ALL SELECT doc_id, 'test', 'testLower' FROM documents WHERE doc_id % 2 = 1""")
def x9_labels_and_tests(spark, sf_dir):
    """Labels of markup (no colon, no braces, no short or lower-case text) and test functions of Go."""
    even = F.col("doc_id") % 2 == 0
    markup = F.concat(F.lit("<input title = 'Name of "), name_of(), F.lit("' placeholder=\"{{x}}\" :label=\"y\" label: 'no'><b>\n Save it now </b><i>lower case</i><u>Ab</u>"))
    tests = F.concat(F.lit("func Test_"), name_of(), F.lit("(t) {}\nfunc testLower() {}\nfunc Tes() {}\nyup.test('no test here')"))
    f = ad.table(spark, sf_dir, "documents").select(F.lit("r").alias("root_name"), F.concat(name_of(), F.when(even, ".vue").otherwise(".go")).alias("rel_path"), F.when(even, markup).otherwise(tests).alias("content"))
    both = scans.ui_labels(f).select("rel_path", F.lit("label").alias("kind"), F.col("label").alias("name")).unionByName(scans.test_names(f).select("rel_path", F.lit("test").alias("kind"), "name"))
    return doc_of(both, "kind", "name")


@query(r"""WITH d AS (SELECT doc_id, doc_id % 4 AS k FROM documents)
SELECT doc_id, 1::BIGINT AS line, 14::BIGINT AS "column", 'https://x' || doc_id || '.example/' AS target, NULL::VARCHAR AS reason FROM d WHERE k < 3
UNION ALL SELECT doc_id, 2, 13, 'http://svc:80/' || doc_id, NULL FROM d WHERE k = 0
UNION ALL SELECT doc_id, 2, 3, NULL, 'destination is built at runtime from "https://y.example/' || doc_id || '/…"' FROM d WHERE k = 1
UNION ALL SELECT doc_id, 2, 34 + length(doc_id::VARCHAR), 'https://z.example/', NULL FROM d WHERE k = 1""")
def x2_urls(spark, sf_dir):
    """Stated, built, linked and commented URLs, beside each other in one line, and all texts as comments."""
    k = F.col("doc_id") % 4
    second = (
        F.when(k == 0, F.concat(F.lit('/* "a" */ f("http://svc:80/'), name_of(), F.lit('"); g("http://local"); h(\'// no\')'))).when(k == 1, F.concat(F.lit("f(`https://y.example/"), name_of(), F.lit('/${id}`); g("https://z.example/")')))
        .when(k == 2, F.lit("<a href = 'https://link.example/'> # 'https://hash.example/'")).otherwise("x = 'http://www.w3.org/2000/svg' // 'https://c.example/'")
    )
    f = code_files(spark, sf_dir, ".ts", F.concat(F.lit("const base = "), F.when(k < 3, F.concat(F.lit('"https://x'), name_of(), F.lit('.example/"'))).otherwise("1"), F.lit("\n")), second)
    return doc_of(reads.outbound_urls(f), "line", "column", "target", "reason")


@query(r"""WITH d AS (SELECT doc_id, doc_id % 5 AS k FROM documents)
SELECT doc_id, 'src/' AS folder, 2::BIGINT AS line, 'gorm' AS mechanism, CASE WHEN k = 4 THEN NULL ELSE 'leaves_' || doc_id END AS entity, (['write', 'delete', 'read', 'unknown', 'unknown'])[k + 1] AS operation FROM d
UNION ALL SELECT doc_id, 'js/', 1, 'sequelize', CASE WHEN k < 3 THEN 'orm_' || doc_id ELSE 'model' || doc_id END, CASE WHEN k % 2 = 0 THEN 'delete' ELSE 'write' END FROM d""")
def x5_data_usage(spark, sf_dir):
    """Constants and the chains that use them in the middle of a name, operations behind line ends and none of the next statement; models with and without a table."""
    k = F.col("doc_id") % 5
    declared = code_files(spark, sf_dir, ".go", F.concat(F.lit("T"), name_of(), F.lit(' TableName = "leaves_'), name_of(), F.lit('"'))).withColumn("rel_path", F.concat(F.lit("constant/"), "rel_path"))
    verb = F.when(k == 0, ").\n  Where(a).\n  Updates(x)").when(k == 1, ').Find(x).\n\tDelete("y")').when(k == 2, ').Where("a\n(").Count(n)').otherwise(")")
    used = code_files(spark, sf_dir, ".go", F.concat(F.lit("// db.Table(T1)\ndb.Table(pkg."), F.when(k == 4, "Nothing").otherwise(F.concat(F.lit("T"), name_of())), F.lit(".String"), verb, F.lit("\ndb.Create(z)"))).withColumn("rel_path", F.concat(F.lit("src/"), "rel_path"))
    models = code_files(spark, sf_dir, ".js", F.concat(F.lit("define('Model"), name_of(), F.lit("', { tableName: 'orm_"), name_of(), F.lit("' })"))).where(F.regexp_extract("rel_path", "^[0-9]+", 0).cast("long") % 5 < 3).withColumn("rel_path", F.concat(F.lit("src/models/m"), "rel_path"))
    calls = code_files(spark, sf_dir, ".js", F.concat(F.lit("models.Model"), name_of(), F.when(k % 2 == 0, ".destroy({})").otherwise(".bulkCreate([])"), F.lit("; models.Model"), name_of(), F.lit(".build()"))).withColumn("rel_path", F.concat(F.lit("js/"), "rel_path"))
    u = reads.data_usage(declared.unionByName(used).unionByName(models).unionByName(calls))
    return doc_of(u, F.regexp_extract("rel_path", "^[a-z]+/", 0).alias("folder"), "line", "mechanism", "entity", "operation")


@query("""SELECT p_brand AS dir, 'pkg-' || p_partkey AS name, '^' || p_size AS version_constraint, CASE p_partkey % 2 WHEN 0 THEN 'runtime' ELSE 'development' END AS scope FROM part""")
def x11_manifests(spark, sf_dir):
    """One package.json a brand."""
    p = parts(spark, sf_dir)
    held = lambda odd: F.map_from_entries(F.array_compact(F.collect_list(F.when(F.col("p_partkey") % 2 == odd, F.struct(F.concat(F.lit("pkg-"), F.col("p_partkey").cast("string")), F.concat(F.lit("^"), F.col("p_size").cast("string")))))))
    f = p.groupBy("p_brand").agg(held(0).alias("dependencies"), held(1).alias("devDependencies")).select(F.lit("r").alias("root_name"), F.concat("p_brand", F.lit("/package.json")).alias("rel_path"), F.to_json(F.struct("dependencies", "devDependencies")).alias("content"))
    return scans.read_manifests(f).select("dir", "name", "version_constraint", "scope")


@query("""SELECT p_brand AS dir, 'pkg-' || p_partkey AS name, p_size || '.0' AS version FROM part""")
def x12_lockfiles(spark, sf_dir):
    """One Cargo.lock a brand."""
    entry = F.concat(F.lit('[[package]]\nname = "pkg-'), F.col("p_partkey").cast("string"), F.lit('"\nversion = "'), F.col("p_size").cast("string"), F.lit('.0"\n'))
    f = parts(spark, sf_dir).groupBy("p_brand").agg(F.array_join(F.array_sort(F.collect_list(entry)), "\n").alias("content")).select(F.lit("r").alias("root_name"), F.concat("p_brand", F.lit("/Cargo.lock")).alias("rel_path"), "content")
    return scans.read_lockfiles(f).select("dir", "name", "version")


@query("""SELECT DISTINCT p_brand AS root_name, p_type AS member, p_name AS rel_path, p_size AS start_line FROM part p WHERE p_size % 2 = 0 AND EXISTS (SELECT 1 FROM part s WHERE s.p_brand = p.p_brand AND s.p_type = p.p_type AND s.p_size % 5 IN (0, 2))""")
def j26_authorization(spark, sf_dir):
    p, s = parts(spark, sf_dir), F.col("p_size")
    r = p.select(F.col("p_brand").alias("root_name"), F.col("p_type").alias("member"), F.when(s % 2 == 0, "check").otherwise("write").alias("context"), F.col("p_name").alias("rel_path"), s.alias("start_line"))
    sets = p.groupBy(F.col("p_brand").alias("root_name"), F.when(s % 5 == 0, "UserRoleC").when(s % 5 == 1, "DataAccessC").when(s % 5 == 2, "grant_kinds").otherwise("ColourC").alias("name")).agg(F.collect_set(F.struct(F.col("p_type").alias("name"), F.lit(1).cast("long").alias("value"))).alias("members"))
    return effects.observe_authorization(r, sets)


@query("""WITH t AS (SELECT count(*) AS n FROM (SELECT 'c' || o_custkey FROM orders UNION SELECT 'o' || o_orderkey FROM orders UNION SELECT 'n' || c_nationkey FROM customer)), g AS (SELECT o_custkey AS c, count(*) + 2 AS steps FROM orders GROUP BY 1)
SELECT 'c' || c AS entry_id, steps::BIGINT AS n_steps, 'max-depth' AS truncation, floor(100.0 * steps / n + 0.5)::BIGINT AS traceability FROM g, t""")
def g3_entry_traces(spark, sf_dir):
    """A customer's orders by calls and its nation by a type relation, one level."""
    o, c = ad.table(spark, sf_dir, "orders"), ad.table(spark, sf_dir, "customer")
    node = lambda prefix, k: F.concat(F.lit(prefix), F.col(k).cast("string"))
    calls = o.select(node("c", "o_custkey").alias("caller_id"), node("o", "o_orderkey").alias("callee_id"), F.col("o_orderkey").alias("edge_ord"))
    types = c.select(node("c", "c_custkey").alias("caller_id"), node("n", "c_nationkey").alias("callee_id"), F.lit(0).cast("long").alias("edge_ord"))
    symbols = calls.select(F.col("caller_id").alias("id")).union(calls.select("callee_id")).union(types.select("callee_id"))
    entries = calls.select(F.col("caller_id").alias("entry_id")).distinct().withColumn("node", F.col("entry_id"))
    t = wiring.build_entry_traces(entries, symbols, calls, types, max_depth=1, max_steps=100_000, max_branches=100_000)
    return t.select("entry_id", F.size("steps").cast("long").alias("n_steps"), "truncation", "traceability")


@query("""SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'order' ELSE lower(string_split(p_type, ' ')[1]) END AS term FROM part""")
def e10_entity_terms(spark, sf_dir):
    p = parts(spark, sf_dir)
    name = F.when(F.col("p_size") % 2 == 0, F.lit("shop_orders_x")).otherwise(F.concat(F.lit("shop_"), F.lower(F.element_at(F.split("p_type", " "), 1))))
    return p.select("p_partkey", names.entity_term(name, F.lit("shop_")).alias("term"))


@query(r"""WITH d AS (SELECT doc_id, doc_id % 4 AS k FROM documents)
SELECT doc_id, 2::BIGINT AS line, 'GET' AS method, CASE k WHEN 0 THEN 'mainApi' WHEN 1 THEN 'base' END AS base, CASE k WHEN 0 THEN '/v2/leaves/' || doc_id WHEN 1 THEN '/v1/:param/' || doc_id WHEN 2 THEN '/plain/' || doc_id END AS target, k = 3 AS failed FROM d
UNION ALL SELECT doc_id, 3, NULL, 'mainApi', '/v2', false FROM d""")
def x3_ui_calls(spark, sf_dir):
    """Bases derived in the file, templates, plain paths, and URLs made elsewhere."""
    k = F.col("doc_id") % 4
    url = F.when(k == 0, F.concat(F.lit("`${v2}/leaves/"), name_of(), F.lit("?q=1`, x"))).when(k == 1, F.concat(F.lit("`${cfg.base}/v1/${id}-x/"), name_of(), F.lit("`"))).when(k == 2, F.concat(F.lit("'/plain/"), name_of(), F.lit("'"))).otherwise(F.concat(F.lit("'/made/' + x"), name_of()))
    f = code_files(spark, sf_dir, ".tsx", F.concat(F.lit("const v2 = `${config.mainApi}/v2`\naxios.get<A.B<C>>("), url, F.lit(")\nhttp.request(`${v2}`); other.get('/x'); s = '/* '; // axios.get('/no')")))
    return doc_of(reads.ui_calls(f), "line", "method", "base", "target", F.col("failure").isNotNull().alias("failed"))


@query(r"""WITH d AS (SELECT doc_id, doc_id % 4 AS k FROM documents)
SELECT doc_id, (['net/smtp', 'aws-sdk-go', 'axios', 'fetch'])[k + 1] AS package_name, (['SendMail', 'GetObject', 'put', 'fetch'])[k + 1] AS member_name, 2::BIGINT AS line, (['high', 'medium', 'medium', 'low'])[k + 1] AS confidence FROM d
UNION ALL SELECT doc_id, 'axios', 'request', 3, 'medium' FROM d WHERE k = 2""")
def x4_outbound_sinks(spark, sf_dir):
    """Sinks behind their imports; a wrapper of the same name, another object's fetch, a sink without its import and comments do not count."""
    k = F.col("doc_id") % 4
    code = (
        F.when(k == 0, 'import "net/smtp"\nsmtp.SendMail(a); http.Get(b)\n/* smtp.SendMail(c) */ s3.NewX()').when(k == 1, 'import "aws-sdk-go"\nc.GetObject(ctx, x)\nc.GetObject(key); q := "/*"')
        .when(k == 2, "import axios\naxios . put (u)\naxios(v) # axios(w)").otherwise("\nfetch ('/z')\na.fetch(b); prefetch(c)")
    )
    f = ad.table(spark, sf_dir, "documents").select("doc_id", code.alias("code"), k.alias("k"), F.regexp_replace(F.coalesce("text", F.lit("")), r"[\n\r]", " ").alias("t"))
    f = f.select(F.lit("r").alias("root_name"), F.concat(name_of(), F.when(F.col("k") < 2, ".go").otherwise(".ts")).alias("rel_path"), F.concat("code", F.lit("\n// "), F.when(F.col("k") == 3, "").otherwise(F.col("t"))).alias("content"))
    return doc_of(reads.outbound_sinks(f), "package_name", "member_name", "line", "confidence")
