"""The registered queries of the fact operators and the SQL that they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import grades, keys, names, paths
from .operators import audit, behavior, effects, flows, graphs, health, history, intervals, link, merge, modules, routes, rules, scans
from .plans import adapters as ad
from .sources import base, code_graph, corpus

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its name, with the SQL that gives the same rows."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


# Scalar expressions ---------------------------------------------------------------------------------------------------------


@query(r"""
SELECT p_partkey, replace(replace(p_name, '\', '\\'), '|', '\|') || '|' || p_size || '|' AS key, 'structural|part|' || p_partkey AS fact,
       'm_' || substr(sha256(array_to_string(list_sort([p_brand, p_type]), '|')), 1, 16) AS stable, '{"p_brand":"' || p_brand || '","p_size":' || p_size || '}' AS js
FROM part""")
def e1_e5_keys(spark, sf_dir):
    p = ad.table(spark, sf_dir, "part")
    return p.select(
        "p_partkey", keys.join_key("p_name", "p_size", F.lit(None)).alias("key"), keys.fact_id("structural", "part", "p_partkey").alias("fact"),
        keys.stable_id("m", F.array("p_brand", "p_type")).alias("stable"), keys.stable_json("p_size", "p_brand").alias("js"),
    )


@query(rf"""
WITH {ad.FILES_SQL}, x AS (SELECT *, regexp_extract(lower(parse_filename(rel_path)), '^.+\.([^.]*)$', 1) AS ext FROM files)
SELECT root_name, rel_path, CASE WHEN ext = 'txt' THEN 'documentation' END AS class, NULL::VARCHAR AS language,
       contains(lower(substr(content, 1, 500)), 'generated') AND contains(lower(substr(content, 1, 500)), 'do not edit') AS generated FROM x""")
def e6_e7_s6_files(spark, sf_dir):
    path = F.col("rel_path")
    return ad.docs_as_files(spark, sf_dir).select("root_name", "rel_path", names.classify_path(path).alias("class"), names.language_of(path).alias("language"), names.looks_generated(F.col("content")).alias("generated"))


SINGULAR = "CASE WHEN w LIKE '%ies' AND len(w) > 4 THEN w[:-4] || 'y' WHEN w LIKE '%ses' OR w LIKE '%xes' OR w LIKE '%hes' THEN w[:-3] WHEN w LIKE '%s' AND w NOT LIKE '%ss' AND len(w) > 3 THEN w[:-2] ELSE w END"


@query(rf"""
SELECT doc_id, pos, w AS word, {SINGULAR} AS single FROM (
  SELECT doc_id, unnest(x) AS w, generate_subscripts(x, 1) - 1 AS pos FROM (
    SELECT doc_id, list_filter(string_split_regex(lower(regexp_replace(text, '([a-z0-9])([A-Z])', '\1 \2', 'g')), '[^a-z0-9]+'), lambda w: len(w) > 2 AND NOT regexp_matches(w, '^[0-9]+$')) AS x FROM documents))""")
def e8_e9_words(spark, sf_dir):
    d = ad.table(spark, sf_dir, "documents").select("doc_id", F.posexplode(names.words(F.col("text"))).alias("pos", "word"))
    return d.withColumn("single", names.singular(F.col("word"))).withColumn("pos", F.col("pos").cast("long"))


@query(r"""
SELECT p_partkey, list_filter(string_split_regex(lower(p_type), '[^a-z0-9]+'), lambda w: len(w) > 1)[-1] AS field, string_split(lower(p_type), ' ')[-1] AS subject,
       array_to_string(list_filter(string_split(lower(p_type), ' '), lambda w: w <> ''), ' ') AS readable, lower(p_type) AS plain,
       regexp_matches(p_type, '(?i)\b(db|database|conn(ection)?|pool)\b|\bcommon\b|\bshared\b|\bclient\b') AS infra
FROM part""")
def e11_e13_e20_names(spark, sf_dir):
    t = F.col("p_type")
    return ad.table(spark, sf_dir, "part").select(
        "p_partkey", names.field_token(t).alias("field"), names.subject_key(t).alias("subject"), names.readable_member(t, F.lit("Other")).alias("readable"), names.readable_subject(t).alias("plain"), names.looks_infrastructural(t).alias("infra"),
    )


@query(rf"""
WITH {ad.ROUTES_SQL}
SELECT page_id, regexp_extract(url, '^[a-zA-Z][A-Za-z0-9_+.-]*://[^/]*(/[^?#]*)?', 1) AS raw, path, regexp_replace(path, '^/(v[0-9]+|api)(/|$)', '\2') AS comparable, ltrim(path, '/') AS resolved,
       (len(string_split(path, '/')) * 2)::INT AS score, NOT regexp_matches(host, '\bexample\.(com|org)$') AS real, host FROM p""")
def e14_e19_paths(spark, sf_dir):
    u = F.col("url")
    p = paths.path_of(u)
    return ad.table(spark, sf_dir, "pages").select(
        "page_id", p.alias("raw"), paths.trim_slashes(p).alias("path"), paths.comparable_path(p).alias("comparable"), paths.resolve_dots(p).alias("resolved"),
        paths.specificity(p).alias("score"), paths.is_real_integration(paths.host_of(u)).alias("real"), paths.host_of(u).alias("host"),
    )


# Linking ----------------------------------------------------------------------------------------------------------------------

MATCH_SQL = r"""
calls AS (SELECT page_id AS call_id, host, string_split(path, '/') AS qs FROM p),
r AS (SELECT root_name, path, string_split(path, '/') AS ps FROM routes),
m AS (SELECT call_id, host, root_name, path, list_sum(list_transform(ps, lambda s: CASE WHEN s LIKE ':%' THEN 1 ELSE 2 END)) AS score
      FROM calls JOIN r ON len(ps) = len(qs) AND len(list_filter(list_zip(ps, qs), lambda z: NOT (z[1] LIKE ':%' OR z[1] = z[2]))) = 0)
"""
LINKED_SQL = """
best AS (SELECT call_id, count(*) AS n, min(root_name) AS to_root, min(path) AS route_path FROM (SELECT *, rank() OVER (PARTITION BY call_id ORDER BY score DESC) AS k FROM {m}) WHERE k = 1 GROUP BY 1)
SELECT p.page_id AS call_id, 'crawler' AS from_root, CASE WHEN n IS NULL THEN 'no-matching-route' WHEN n > 1 THEN 'ambiguous-match' ELSE 'linked' END AS outcome, coalesce(n, 0)::BIGINT AS n_candidates,
       CASE n WHEN 1 THEN to_root END AS to_root, CASE n WHEN 1 THEN route_path END AS route_path, CASE n WHEN 1 THEN 'medium' END AS confidence
FROM p LEFT JOIN best ON best.call_id = p.page_id"""


@query(f"WITH {ad.ROUTES_SQL}, {MATCH_SQL}, {LINKED_SQL.format(m='m')}")
def j4_link_calls(spark, sf_dir):
    return link.link_calls(ad.pages_as_calls(spark, sf_dir), ad.pages_as_routes(spark, sf_dir))


BINDING_SQL = f"""WITH {ad.ROUTES_SQL}, {MATCH_SQL},
per AS (SELECT host, root_name, count(DISTINCT call_id) AS n FROM m GROUP BY 1, 2),
top AS (SELECT host, max(n) AS matched, sum(n) AS total, first(root_name ORDER BY n DESC, root_name) AS to_root FROM per GROUP BY 1),
bindings AS (SELECT host, matched, total, considered, CASE WHEN matched IS NULL THEN 'no call fits another root''s routes' WHEN matched < 3 THEN 'below the minimum of matches' WHEN matched < 0.6 * total THEN 'no clear majority' ELSE 'bound' END AS reason, to_root
  FROM (SELECT host, count(*) AS considered FROM p GROUP BY 1) LEFT JOIN top USING (host))"""


@query(BINDING_SQL + " SELECT 'crawler' AS from_root, host AS base_identifier, CASE reason WHEN 'bound' THEN to_root END AS bound_root, coalesce(matched, 0)::BIGINT AS matched, considered, reason FROM bindings")
def j5_base_bindings(spark, sf_dir):
    return link.infer_base_bindings(ad.pages_as_calls(spark, sf_dir), ad.pages_as_routes(spark, sf_dir))


@query(BINDING_SQL + ", ms AS (SELECT m.* FROM m JOIN bindings USING (host) WHERE reason <> 'bound' OR to_root = root_name), " + LINKED_SQL.format(m="ms"))
def j6_scoped_links(spark, sf_dir):
    return link.bind_and_link(ad.pages_as_calls(spark, sf_dir), ad.pages_as_routes(spark, sf_dir))


@query(f"WITH {ad.ROUTES_SQL}, {MATCH_SQL}, l AS (WITH {LINKED_SQL.format(m='m')})" + r"""
SELECT 'internal' AS kind, from_root AS source, to_root AS target, count(*) AS weight FROM l WHERE outcome = 'linked' GROUP BY ALL
UNION ALL SELECT DISTINCT 'external', 'crawler', host, 1 FROM p JOIN l ON l.call_id = p.page_id WHERE outcome <> 'linked' AND NOT regexp_matches(host, '\bexample\.(com|org)$')
UNION ALL SELECT 'datastore', root_name, 'datastore', count(DISTINCT path) FROM routes GROUP BY ALL""")
def d8_d9_j20_project_map(spark, sf_dir):
    calls, routes = ad.pages_as_calls(spark, sf_dir), ad.pages_as_routes(spark, sf_dir)
    links = link.link_calls(calls, routes)
    return link.project_map(links, link.external_hosts(calls, links), routes.select("root_name", F.col("path").alias("name")))


@query("""WITH known AS (SELECT DISTINCT p_brand AS name, p_type AS id FROM part WHERE p_size > 45)
SELECT name, CASE WHEN ids IS NULL THEN 'unresolved' WHEN len(ids) = 1 THEN 'exact' ELSE 'ambiguous' END AS outcome, coalesce(ids, []) AS candidates
FROM (SELECT DISTINCT p_brand AS name FROM part) LEFT JOIN (SELECT name, list(id ORDER BY id) AS ids FROM known GROUP BY 1) USING (name)""")
def j22_reconcile(spark, sf_dir):
    p = ad.table(spark, sf_dir, "part")
    return link.reconcile(p.select(F.col("p_brand").alias("name")), p.where("p_size > 45").select(F.col("p_brand").alias("name"), F.col("p_type").alias("id")))


# Interval joins ---------------------------------------------------------------------------------------------------------------


@query(f"WITH {ad.POINTS_SQL} SELECT event_id, root_name, 'events' AS rel_path, line, (SELECT first(symbol_id ORDER BY e - s, s, symbol_id) FROM ranges r WHERE r.root_name = points.root_name AND line BETWEEN s AND e) AS symbol_id FROM points")
def j1_enclosing(spark, sf_dir):
    return intervals.attach_enclosing(ad.events_as_points(spark, sf_dir), ad.events_as_ranges(spark, sf_dir), "event_id")


@query(f"WITH {ad.POINTS_SQL} SELECT event_id, first(symbol_id ORDER BY s DESC, e, symbol_id) AS symbol_id FROM points JOIN ranges r ON r.root_name = points.root_name AND line BETWEEN s AND e GROUP BY 1")
def j2_innermost_callable(spark, sf_dir):
    return intervals.innermost_callable(ad.events_as_points(spark, sf_dir), ad.events_as_ranges(spark, sf_dir), "event_id")


# Merging ----------------------------------------------------------------------------------------------------------------------


@query(f"""WITH {ad.CONTRIBUTIONS_SQL}
SELECT 'order' AS kind, coalesce(h.key, l.key) AS key, coalesce(h.total, l.total) AS total, coalesce(h.status, l.status) AS status,
  CASE WHEN h.key IS NULL THEN 'lines' WHEN l.key IS NULL THEN 'header' ELSE 'header,lines' END AS providers,
  CASE WHEN h.key IS NULL OR l.key IS NULL THEN 0 ELSE (h.total <> l.total)::INT + (h.status <> l.status)::INT END AS n_conflicts,
  CASE WHEN h.key IS NOT NULL AND l.key IS NOT NULL AND h.total <> l.total THEN l.total END AS lost_total,
  CASE WHEN h.key IS NOT NULL AND l.key IS NOT NULL AND (h.total <> l.total OR h.status <> l.status) THEN 'most directly observed' ELSE 'agreed' END AS reason,
  CASE WHEN h.key IS NULL THEN 'inferred' ELSE 'declared' END AS class
FROM head h FULL JOIN lines l ON h.key = l.key""")
def a1_a2_merge_facts(spark, sf_dir):
    m = merge.merge_facts(ad.orders_as_contributions(spark, sf_dir))
    lost = F.try_element_at(F.filter("conflicts", lambda c: c["field"] == "total"), F.lit(1))["value"]
    return m.select("kind", "key", F.col("payload")["total"].alias("total"), F.col("payload")["status"].alias("status"), F.array_join("attributions", ",").alias("providers"), F.size("conflicts").alias("n_conflicts"), lost.alias("lost_total"), F.col("precedence_reason").alias("reason"), F.col("resolution_class").alias("class"))


@query("""SELECT item AS key, first(text ORDER BY o, text) AS text, list(DISTINCT c ORDER BY c) AS collectors, list_sort(list_filter(list(DISTINCT text), lambda t: t <> first(text ORDER BY o, text))) AS conflicts
FROM (SELECT o_custkey AS item, o_orderpriority AS text, 'status-' || o_orderstatus AS c, ascii(o_orderstatus) AS o FROM orders) GROUP BY 1""")
def a3_merge_evidence(spark, sf_dir):
    o = ad.table(spark, sf_dir, "orders")
    return merge.merge_evidence(o.select(F.col("o_custkey").alias("key"), F.col("o_orderpriority").alias("text"), F.concat(F.lit("status-"), F.col("o_orderstatus")).alias("collector_id"), F.ascii("o_orderstatus").alias("collector_order")))


@query("""WITH d AS (SELECT DISTINCT p_brand AS provider_id, p_type AS kind, CASE WHEN len(p_type) % 2 = 0 THEN 'supplied' ELSE 'partial' END AS outcome FROM part),
g AS (SELECT DISTINCT p_brand AS provider_id, p_type AS kind FROM part WHERE p_size = 1), r AS (SELECT p_brand AS provider_id, p_type AS kind, count(*) AS n FROM part WHERE p_size > 10 GROUP BY ALL)
SELECT d.provider_id, d.kind, CASE WHEN g.kind IS NULL THEN d.outcome ELSE 'absent' END AS outcome, coalesce(n, 0) AS records FROM d LEFT JOIN g USING (provider_id, kind) LEFT JOIN r USING (provider_id, kind)""")
def a5_capabilities(spark, sf_dir):
    p = ad.table(spark, sf_dir, "part").select(F.col("p_brand").alias("provider_id"), F.col("p_type").alias("kind"), "p_size")
    return merge.summarize_capabilities(p.where("p_size > 10"), p.where("p_size = 1"), p.withColumn("level", F.when(F.length("kind") % 2 == 0, "full").otherwise("part")))


@query("""SELECT p_type AS id, len(list(DISTINCT p_brand)) AS claims FROM part GROUP BY 1 HAVING count(DISTINCT p_brand) > 1""")
def a7_collisions(spark, sf_dir):
    p = ad.table(spark, sf_dir, "part").withColumnRenamed("p_type", "id")
    return merge.detect_collisions(p, "id", "p_brand").select("id", F.size("claims").cast("long").alias("claims"))


@query("""SELECT table_name, ordinal, len(columns) AS n FROM (SELECT o_custkey AS table_name, o_orderkey AS ordinal, list(l_partkey) AS columns,
  row_number() OVER (PARTITION BY o_custkey ORDER BY count(*) DESC, o_orderkey) AS k FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2) WHERE k = 1""")
def a9_fullest_declaration(spark, sf_dir):
    c = ad.table(spark, sf_dir, "orders").join(ad.table(spark, sf_dir, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("o_custkey").alias("table_name"), F.col("o_orderkey").alias("ordinal")).agg(F.collect_list("l_partkey").alias("columns"))
    return merge.fullest_declaration(c).select("table_name", "ordinal", F.size("columns").cast("long").alias("n"))


# Findings ---------------------------------------------------------------------------------------------------------------------


@query(f"""WITH {ad.ACCESS_SQL}, g AS (SELECT entity, coalesce(list(DISTINCT root_name ORDER BY root_name) FILTER (operation = 'write'), []) AS w, coalesce(list(DISTINCT root_name ORDER BY root_name) FILTER (operation = 'read'), []) AS r FROM access GROUP BY 1)
SELECT 'written-by-several' AS code, entity, array_to_string(w, ',') AS roots FROM g WHERE len(w) > 1
UNION ALL SELECT 'read-by-non-owner', entity, array_to_string(list_filter(r, lambda x: NOT list_contains(w, x)), ',') FROM g WHERE len(w) > 0 AND len(list_filter(r, lambda x: NOT list_contains(w, x))) > 0""")
def d10_ownership_findings(spark, sf_dir):
    return health.ownership_findings(ad.lineitem_as_access(spark, sf_dir)).withColumn("roots", F.array_join("roots", ","))


@query(f"WITH {ad.ACCESS_SQL} SELECT root_name, count(*) FILTER (operation = 'unknown') AS undetermined, count(*) AS total, (floor(100.0 * count(*) FILTER (operation = 'unknown') / count(*) + 0.5))::BIGINT AS pct FROM access GROUP BY 1")
def d10_e31_undetermined(spark, sf_dir):
    return health.undetermined_operations(ad.lineitem_as_access(spark, sf_dir)).withColumn("pct", health.percent(F.col("undetermined"), F.col("total")))


@query(f"WITH {ad.ROUTES_SQL} SELECT NULL::VARCHAR AS method, regexp_replace(path, '/:id', '/:p') AS path, array_to_string(list(DISTINCT root_name ORDER BY root_name), ',') AS roots FROM routes GROUP BY 2 HAVING count(DISTINCT root_name) > 1")
def d10_served_twice(spark, sf_dir):
    return health.served_twice(ad.pages_as_routes(spark, sf_dir), paths.comparable_path(F.col("path"))).withColumn("roots", F.array_join("roots", ","))


@query("""SELECT entity, count(DISTINCT shape) AS shapes, count(*) AS roots FROM (SELECT p_size AS entity, p_brand AS root_name, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS shape FROM part GROUP BY 1, 2) GROUP BY 1 HAVING count(DISTINCT shape) > 1""")
def d10_shapes(spark, sf_dir):
    return health.shape_disagreements(ad.table(spark, sf_dir, "part").select(F.col("p_size").alias("entity"), F.col("p_brand").alias("root_name"), F.col("p_type").alias("name")))


@query(f"""WITH {ad.CONDITIONS_SQL}, k AS (SELECT *, lower(regexp_extract(subject, '([A-Z]?[a-z0-9]+|[A-Z0-9]+)$', 1)) AS subject_key FROM conditions),
r AS (SELECT subject_key, literal, root_name, min(operator) AS operator, min(rule_id) AS rule_id FROM k GROUP BY 1, 2, 3 HAVING count(DISTINCT operator) = 1),
g AS (SELECT subject_key, literal FROM r GROUP BY 1, 2 HAVING count(DISTINCT operator) > 1 AND (bool_and(operator IN ('>', '>=')) OR bool_and(operator IN ('<', '<='))))
SELECT r.* FROM r JOIN g USING (subject_key, literal)""")
def d12_divergence(spark, sf_dir):
    c = ad.parts_as_conditions(spark, sf_dir)
    # sizes a part apart in operator meet at one literal
    return health.find_divergence(c)


@query("""SELECT p_brand, p_partkey, p_retailprice, k AS place, greatest(n - 3, 0) AS more FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS k, count(*) OVER (PARTITION BY p_brand) AS n FROM part) WHERE k <= 3""")
def w3_top_per_group(spark, sf_dir):
    p = ad.table(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_retailprice")
    return health.top_per_group(p, ["p_brand"], [F.desc("p_retailprice"), F.asc("p_partkey")], 3)


@query(f"""WITH {ad.FILES_SQL}, p AS (SELECT root_name, substr(sha256(rel_path), 1, 3) AS k, sha256(string_agg(rel_path || ':' || sha256(content), chr(10) ORDER BY rel_path, sha256(content))) AS d, count(*) AS n FROM files GROUP BY 1, 2)
SELECT root_name, sha256(string_agg(d, chr(10) ORDER BY k)) AS digest, sum(n)::BIGINT AS files FROM p GROUP BY 1""")
def d24_content_digest(spark, sf_dir):
    return health.content_digests(ad.docs_as_files(spark, sf_dir))


@query(f"""WITH {ad.FILES_SQL}, x AS (SELECT root_name, CASE WHEN size_bytes > 10000 THEN 'excluded' ELSE 'analyzed' END AS disposition FROM files)
SELECT root_name, disposition, count(*) AS files FROM x GROUP BY ROLLUP (root_name, disposition)""")
def d22_inventory_counts(spark, sf_dir):
    f = ad.docs_as_files(spark, sf_dir).withColumn("disposition", F.when(F.col("size_bytes") > 10000, "excluded").otherwise("analyzed"))
    return health.inventory_counts(f)


@query("""WITH m AS (SELECT p_type AS metric, avg(p_size) AS value FROM part WHERE p_size > 5 GROUP BY 1)
SELECT p_brand AS gate, bool_and(coalesce(value >= p_size, false)) AS passed, coalesce(array_to_string(list(DISTINCT metric ORDER BY metric) FILTER (NOT coalesce(value >= p_size, false)), ','), '') AS failing FROM part LEFT JOIN m ON metric = p_type GROUP BY 1""")
def d28_gates(spark, sf_dir):
    p = ad.table(spark, sf_dir, "part")
    g = health.evaluate_gates(p.select(F.col("p_brand").alias("gate"), F.col("p_type").alias("metric"), F.col("p_size").alias("least")), p.where("p_size > 5").groupBy(F.col("p_type").alias("metric")).agg(F.avg("p_size").alias("value")))
    return g.withColumn("failing", F.array_join(F.array_distinct("failing"), ","))


# Graphs -----------------------------------------------------------------------------------------------------------------------


@query(f"""WITH {ad.GRAPH_SQL}, deg AS (SELECT caller_id, count(*) AS n FROM edges GROUP BY 1), l1 AS (SELECT e.caller_id AS e, e.callee_id AS n, e.edge_ord AS o FROM edges e JOIN deg USING (caller_id) WHERE e.caller_id LIKE 'c%' AND deg.n <= 12),
l2 AS (SELECT e, l1.o AS o1, edges.edge_ord AS o2, edges.callee_id AS n FROM l1 JOIN edges ON edges.caller_id = l1.n JOIN deg ON deg.caller_id = l1.n AND deg.n <= 12), h AS (SELECT e, last(l1.n ORDER BY o) AS n FROM l1 JOIN deg ON deg.caller_id = l1.n AND deg.n > 12 GROUP BY 1), f AS (SELECT e, n, min((o1, o2)) AS o FROM l2 WHERE n IS NOT NULL GROUP BY 1, 2),
steps AS (SELECT DISTINCT caller_id AS e, 0 AS depth, (0::BIGINT, 0::BIGINT) AS o, caller_id AS n FROM edges WHERE caller_id LIKE 'c%' UNION ALL SELECT e, 1, (o, 0::BIGINT), n FROM l1 UNION ALL SELECT e, 2, o, n FROM f),
x AS (SELECT *, row_number() OVER (PARTITION BY e ORDER BY depth, o) AS pos FROM steps), g AS (SELECT e, count(*) AS total, max(depth) AS deep FROM steps GROUP BY 1), u AS (SELECT e, first('o' || o1 ORDER BY o1, o2) AS n FROM l2 WHERE n IS NULL GROUP BY 1),
v AS (SELECT g.e, least(total, 45)::BIGINT AS n_steps, CASE WHEN total >= 45 THEN 'max-steps' WHEN deep = 2 THEN 'max-depth' WHEN deep = 0 OR h.n IS NOT NULL THEN 'max-branches' WHEN u.n IS NOT NULL THEN 'unresolved-edge' ELSE 'completed' END AS truncation, u.n AS un, h.n AS hub FROM g LEFT JOIN u USING (e) LEFT JOIN h USING (e))
SELECT v.e AS entry_id, n_steps, truncation, CASE WHEN truncation = 'completed' THEN NULL WHEN truncation = 'unresolved-edge' THEN un WHEN truncation = 'max-branches' THEN coalesce(hub, x.n) ELSE x.n END AS detail, truncation <> 'completed' AS partial FROM v JOIN x ON x.e = v.e AND x.pos = n_steps""")
def g1_build_traces(spark, sf_dir):
    """From every customer, with bounds of which each is met by some: two levels, 12 branches, 45 steps."""
    e = graphs.cut(ad.supply_graph(spark, sf_dir))
    entries = ad.table(spark, sf_dir, "orders").select(F.concat(F.lit("c"), "o_custkey").alias("entry_id")).distinct().withColumn("node", F.col("entry_id"))
    symbols = e.select(F.col("caller_id").alias("id")).union(e.select("callee_id").where("callee_id is not null"))
    t = graphs.build_traces(entries, symbols, e, max_depth=2, max_steps=45, max_branches=12)
    return t.select("entry_id", F.size("steps").cast("long").alias("n_steps"), "truncation", "detail", "partial")


@query(f"""WITH {ad.GRAPH_SQL}, s AS (SELECT DISTINCT caller_id AS id FROM edges)
SELECT id, CASE WHEN id LIKE 'c%' THEN 'precise' WHEN id LIKE 'o%' THEN 'candidate' ELSE 'structure-root' END AS class FROM s WHERE id LIKE 'c%' OR id LIKE 'o%' OR id NOT IN (SELECT callee_id FROM edges WHERE callee_id IS NOT NULL)""")
def g2_entries(spark, sf_dir):
    e = graphs.cut(ad.supply_graph(spark, sf_dir))
    s = e.select(F.col("caller_id").alias("id")).distinct().withColumns({"kind": F.lit("function"), "visibility": F.when(F.col("id").startswith("o"), "public").otherwise("private")})
    return graphs.identify_entries(s.where("id like 'c%'").select("id"), s, e)


@query(f"""WITH {ad.GRAPH_SQL}, b AS (SELECT DISTINCT callee_id AS node, caller_id AS caller FROM edges WHERE callee_id IS NOT NULL), f AS (SELECT node, count(*) > 32 AS hub FROM b GROUP BY 1),
s AS (SELECT DISTINCT 'n' || s_nationkey AS sink FROM supplier), h1 AS (SELECT DISTINCT sink, caller AS node FROM s JOIN b ON b.node = sink JOIN f ON f.node = sink WHERE NOT hub),
h2 AS (SELECT DISTINCT sink, caller AS node FROM h1 JOIN b USING (node) JOIN f USING (node) WHERE NOT hub),
x AS (SELECT sink, sink AS node, 0 AS hops FROM s UNION ALL SELECT *, 1 FROM h1 UNION ALL SELECT *, 2 FROM h2)
SELECT sink, node, hops, coalesce(hub, false) AS hub FROM x LEFT JOIN f USING (node)""")
def g4_reverse_reach(spark, sf_dir):
    sinks = ad.table(spark, sf_dir, "supplier").select(F.concat(F.lit("n"), "s_nationkey").alias("sink")).distinct().withColumn("node", F.col("sink"))
    return graphs.reverse_reach(sinks, ad.supply_graph(spark, sf_dir))


CHANGES_SQL = "ch AS (SELECT user_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS f, event_type AS t FROM events)"


def type_changes(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return ad.table(spark, sf_dir, "events").select("user_id", F.lag("event_type").over(w).alias("from_root"), F.col("event_type").alias("to_root")).where("from_root is not null")


@query(f"""WITH RECURSIVE {CHANGES_SQL}, e AS (SELECT DISTINCT f, t FROM ch WHERE f <> t), p AS (SELECT [f, t] AS path FROM e WHERE f < t UNION ALL SELECT list_append(path, t) FROM p JOIN e ON path[-1] = f WHERE t > path[1] AND NOT list_contains(path, t))
SELECT array_to_string(path, '>') AS cycle FROM p JOIN e ON path[-1] = f AND path[1] = t WHERE len(path) <= 6""")
def g7_root_cycles(spark, sf_dir):
    return graphs.root_cycles(type_changes(spark, sf_dir)).select(F.array_join("cycle", ">").alias("cycle"))


LOOPS_SQL = f"""{CHANGES_SQL}, ty AS (SELECT DISTINCT f, t FROM ch WHERE f IS NOT NULL), loops AS (SELECT 'a:' || f AS src, 'a:' || t AS dst FROM ty UNION SELECT 'b:' || f, 'b:' || t FROM ty UNION SELECT DISTINCT 'user-' || user_id, 'a:' || event_type FROM events
  UNION SELECT DISTINCT 'b:' || event_type, 'kind-' || event_type FROM events UNION SELECT DISTINCT 'a:' || event_type, 'bridge' FROM events UNION SELECT DISTINCT 'bridge', 'b:' || event_type FROM events)"""


def looped(spark, sf_dir):
    """Users lead to event types that follow each other; a bridge leads on to a second copy of these, and they to dead ends."""
    ty = type_changes(spark, sf_dir).select("from_root", "to_root").distinct()
    e = ad.table(spark, sf_dir, "events").select("user_id", "event_type").distinct()
    named = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    pair = lambda df, src, dst: df.select(src.alias("src"), dst.alias("dst"))
    out = pair(ty, named("a:", "from_root"), named("a:", "to_root")).unionByName(pair(ty, named("b:", "from_root"), named("b:", "to_root"))).unionByName(pair(e, named("user-", "user_id"), named("a:", "event_type")))
    return out.unionByName(pair(e, named("b:", "event_type"), named("kind-", "event_type"))).unionByName(pair(e, named("a:", "event_type"), F.lit("bridge"))).unionByName(pair(e, F.lit("bridge"), named("b:", "event_type"))).distinct()


@query(f"""WITH {LOOPS_SQL} SELECT * FROM loops WHERE src NOT LIKE 'user%' AND dst NOT LIKE 'kind%'""")
def g8_cyclic_part(spark, sf_dir):
    """What only leads into cycles or out of them goes; the bridge between two stays."""
    return graphs.cyclic_part(looped(spark, sf_dir))


@query(f"""WITH RECURSIVE {LOOPS_SQL}, r AS (SELECT src, dst FROM loops WHERE src NOT LIKE 'user%' UNION SELECT r.src, loops.dst FROM r JOIN loops ON loops.src = r.dst) SELECT DISTINCT src AS node FROM r WHERE src = dst""")
def v1_nodes_on_cycles(spark, sf_dir):
    """The bridge is on none."""
    return graphs.nodes_on_cycles(looped(spark, sf_dir))


@query(f"""WITH RECURSIVE {ad.GRAPH_SQL}, k AS (SELECT DISTINCT 'n' || s_nationkey AS name FROM supplier WHERE s_nationkey < 3 UNION SELECT caller_id FROM edges JOIN k ON callee_id = name) SELECT name FROM k""")
def g9_transitive_scope(spark, sf_dir):
    e = ad.supply_graph(spark, sf_dir).where("callee_id is not null")
    scoped = ad.table(spark, sf_dir, "supplier").where("s_nationkey < 3").select(F.concat(F.lit("n"), "s_nationkey").alias("name"))
    return graphs.transitive_scope(scoped, e.select(F.col("caller_id").alias("child"), F.col("callee_id").alias("parent")))


# Rules ------------------------------------------------------------------------------------------------------------------------


def size_sets(spark, sf_dir):
    """Per brand, one value set of its part sizes, named after the types' last words; members are numbered."""
    p = ad.table(spark, sf_dir, "part")
    member = F.struct(F.concat(F.lit("Size"), F.col("p_size"), F.lit("C")).alias("name"), F.col("p_size").cast("long").alias("value"))
    t = F.element_at(F.split("p_type", " "), -1)
    return p.groupBy(F.col("p_brand").alias("root_name"), F.concat_ws("_", F.lit("Part"), t, F.lit("Set")).alias("name")).agg(F.array_sort(F.collect_set(member)).alias("members")).withColumn("set_ord", F.concat_ws("|", "root_name", "name"))


SETS_SQL = r"""s AS (SELECT p_brand AS root_name, string_split(p_type, ' ')[-1] AS w, 'Part_' || string_split(p_type, ' ')[-1] || '_Set' AS name, list(DISTINCT p_size ORDER BY p_size) AS m FROM part GROUP BY ALL),
c AS (SELECT *, string_split(subject, ' ')[-1] AS w FROM (SELECT p_partkey AS condition_id, p_brand AS root_name, p_type AS subject, (['==', '>', '<='])[p_partkey % 3 + 1] AS operator, p_size AS literal FROM part))"""


def type_conditions(spark, sf_dir):
    op = F.element_at(F.array(F.lit("=="), F.lit(">"), F.lit("<=")), (F.col("p_partkey") % 3 + 1).cast("int"))
    subject = F.regexp_replace("p_type", "^.* ", "part.")
    return ad.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("condition_id"), F.col("p_brand").alias("root_name"), subject.alias("subject"), op.alias("operator"), F.col("p_size").cast("long").alias("literal"))


SCORED_SQL = "x AS (SELECT c.condition_id, c.operator, c.literal, c.w, s.name, s.m, CASE WHEN s.root_name = c.root_name THEN 1000 ELSE 0 END - len(m) AS score, s.root_name || '|' || s.name AS ord FROM c JOIN s ON lower(c.w) = lower(s.w))"


@query(f"""WITH {SETS_SQL}, {SCORED_SQL} SELECT condition_id, first(name ORDER BY score DESC, ord) AS set_name, 'Size' || first(literal) || 'C' AS member FROM x WHERE list_contains(m, literal) GROUP BY 1""")
def j7_resolve_values(spark, sf_dir):
    return rules.resolve_values(type_conditions(spark, sf_dir), size_sets(spark, sf_dir))


@query(f"""WITH {SETS_SQL}, {SCORED_SQL} SELECT condition_id, first(name ORDER BY score DESC, ord) AS set_name, first(len(m) ORDER BY score DESC, ord) AS n FROM x GROUP BY 1""")
def j8_best_sets(spark, sf_dir):
    return rules.best_sets(type_conditions(spark, sf_dir), size_sets(spark, sf_dir)).select("condition_id", "set_name", F.size("members").cast("long").alias("n"))


# Features and modules -----------------------------------------------------------------------------------------------------------


@query("""SELECT CASE WHEN total >= 4 AND n >= 0.6 * total THEN prefix END AS prefix FROM (SELECT nullif(regexp_extract(lower(name), '^([a-z0-9]+[_-])', 1), '') AS prefix, count(*) AS n, sum(count(*)) OVER () AS total
FROM (SELECT 'shop_' || lower(p_type) AS name FROM part WHERE p_size > 10 UNION ALL SELECT lower(p_brand) FROM part WHERE p_size <= 10) GROUP BY 1) WHERE prefix IS NOT NULL ORDER BY n DESC, prefix DESC LIMIT 1""")
def d1_table_prefix(spark, sf_dir):
    p = ad.table(spark, sf_dir, "part")
    return health.common_table_prefix(p.select(F.when(F.col("p_size") > 10, F.concat(F.lit("shop_"), F.lower("p_type"))).otherwise(F.lower("p_brand")).alias("name")))


@query(f"""WITH {ad.ROUTES_SQL}, w AS (SELECT DISTINCT path, unnest(list_filter(string_split_regex(lower(path), '[^a-z0-9]+'), lambda x: len(x) > 2 AND NOT regexp_matches(x, '^[0-9]+$'))) AS w FROM routes)
SELECT string_split(path, '/')[2] AS key, string_split(path, '/')[2] AS name, count(*) AS entries FROM (SELECT root_name, path FROM routes) WHERE string_split(path, '/')[2] <> '' GROUP BY 1""")
def d4_form_modules(spark, sf_dir):
    r = ad.pages_as_routes(spark, sf_dir).withColumn("entry_id", keys.join_key("root_name", "path"))
    return modules.form_modules(r).select("key", "name", "entries")


@query(f"""WITH {ad.FILES_SQL}, x AS (SELECT root_name, string_split(rel_path, '/') AS p FROM files)
SELECT DISTINCT root_name, array_to_string(p[1:k], '/') AS container, array_to_string(p[1:k+1], '/') AS member FROM x, range(1, 5) t(k) WHERE k < len(p)""")
def x10_folder_containment(spark, sf_dir):
    return modules.folder_containment(ad.docs_as_files(spark, sf_dir))


@query(f"""WITH {ad.FILES_SQL} SELECT root_name, rel_path, CASE WHEN size_bytes % 2 = 0 THEN 'behavioural' WHEN size_bytes % 3 = 0 THEN 'infrastructural' WHEN size_bytes % 5 = 0 THEN 'technical' ELSE 'unclassified' END AS disposition FROM files""")
def d7_dispositions(spark, sf_dir):
    f = ad.docs_as_files(spark, sf_dir)
    part = lambda k: f.where(F.col("size_bytes") % k == 0)
    return modules.assign_dispositions(f.select("root_name", "rel_path"), part(2), part(3), part(5))


# Grades -------------------------------------------------------------------------------------------------------------------------


SLOTS_SQL = """slots AS (SELECT event_id, user_id, event_type, value, (['declared','resolved','inferred','unresolved'])[event_id % 4 + 1] AS class, (['low','medium','high'])[event_id % 3 + 1] AS conf FROM events)"""


def slots(spark, sf_dir):
    pick = lambda n, *v: F.element_at(F.array(*map(F.lit, v)), (F.col("event_id") % n + 1).cast("int"))
    return ad.table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", pick(4, "declared", "resolved", "inferred", "unresolved").alias("class"), pick(3, "low", "medium", "high").alias("conf"))


@query(f"""WITH {SLOTS_SQL} SELECT event_id, CASE WHEN event_type = 'error' THEN 'failed' WHEN value > 90 THEN 'partial' WHEN value < 5 THEN 'unsupported' WHEN event_type = 'view' THEN 'observed' ELSE 'unknown' END AS state,
3 - (event_id % 4) AS rank, event_id % 4 <= (event_id + 1) % 4 AS weaker_next, event_id % 4 = 0 AS direct FROM slots""")
def e26_e27_coverage(spark, sf_dir):
    v, t, c = F.col("value"), F.col("event_type"), F.col("class")
    state = grades.classify_coverage({"failed": t == "error", "truncated": v > 90, "unsupported": v < 5, "observed": t == "view"})
    after = F.element_at(F.array(*map(F.lit, merge.DIRECTNESS)), ((F.col("event_id") + 1) % 4 + 1).cast("int"))
    return slots(spark, sf_dir).select("event_id", state.alias("state"), grades.resolution_rank(c).cast("long").alias("rank"), grades.is_legal_transition(after, c).alias("weaker_next"), grades.is_directly_observed(c).alias("direct"))


@query(f"""WITH {SLOTS_SQL} SELECT user_id, (['low','medium','high'])[min(event_id % 3) + 1] AS confidence FROM slots GROUP BY 1""")
def e28_confidence(spark, sf_dir):
    return slots(spark, sf_dir).groupBy("user_id").agg(grades.aggregate_confidence(F.col("conf")).alias("confidence"))


@query(r"""SELECT p_partkey, CASE WHEN (p_size // 10, p_size % 10) > (2, 5) THEN 1 WHEN (p_size // 10, p_size % 10) < (2, 5) THEN -1 ELSE 0 END AS cmp, p_size // 10 = 2 AND p_size % 10 >= 5 AS compatible,
CASE WHEN p_partkey % 2 = 0 THEN p_size // 10 || '.' || p_size % 10 || '.0' END AS pin, p_partkey % 2 = 0 OR p_size // 10 = 2 AS agrees FROM part""")
def e25_e30_versions(spark, sf_dir):
    v = F.concat_ws(".", F.floor(F.col("p_size") / 10), F.col("p_size") % 10, F.lit("0"))
    constraint = F.when(F.col("p_partkey") % 2 == 0, v).otherwise(F.concat(F.lit("^"), v))
    return ad.table(spark, sf_dir, "part").select(
        "p_partkey", grades.compare_semver(v, F.lit("2.5.0")).alias("cmp"), grades.is_compatible(v, F.lit("2.5.0")).alias("compatible"),
        grades.pinned_by_manifest(F.lit("npm"), constraint).alias("pin"), grades.agrees_with_constraint(constraint, F.lit("2.9.9")).alias("agrees"),
    )


@query(f"""WITH {SLOTS_SQL} SELECT event_id, CASE WHEN class = 'inferred' AND value >= 50 THEN 'inferred without confidence' WHEN class <> 'inferred' AND value < 50 THEN 'confidence on a class that has none'
WHEN class = 'unresolved' AND event_type = 'click' THEN 'unresolved without a reason' WHEN class <> 'unresolved' AND event_type <> 'click' THEN 'a reason on a resolved fact' END AS violation FROM slots""")
def v4_provenance(spark, sf_dir):
    p = F.struct(F.col("class").alias("resolution_class"), F.struct(F.lit("a.go").alias("rel_path")).alias("source"), F.when(F.col("value") < 50, F.col("conf")).alias("confidence"), F.when(F.col("event_type") != "click", "dynamic").alias("unresolved_reason"))
    return slots(spark, sf_dir).withColumn("p", p).select("event_id", grades.provenance_violation(F.col("p")).alias("violation"))


@query(r"""SELECT doc_id, (len(string_split(substr(text, 1, len(text) // 2), chr(10))))::INT AS line, (len(string_split(substr(text, 1, len(text) // 2), chr(10))[-1]) + 1)::INT AS col FROM documents""")
def e34_locate(spark, sf_dir):
    at = grades.locate(F.col("text"), F.floor(F.length("text") / 2).cast("int"))
    return ad.table(spark, sf_dir, "documents").select("doc_id", at["line"].alias("line"), at["column"].alias("col"))


@query(r"""SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events""")
def e35_json_path(spark, sf_dir):
    return ad.table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query(r"""SELECT o_custkey, 'flowchart TD' || chr(10) || string_agg('  s' || k || '["' || o_orderpriority || '"]', chr(10) ORDER BY k) || coalesce(chr(10) || string_agg(CASE WHEN k > 0 THEN '  s' || (k - 1) || CASE WHEN o_orderstatus = 'F' THEN ' --> s' ELSE ' -.-> s' END || k END, chr(10) ORDER BY k), '') AS diagram
FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS k FROM orders) GROUP BY 1""")
def e33_flow_diagram(spark, sf_dir):
    o = ad.table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", F.col("o_orderpriority").alias("label"), (F.col("o_orderstatus") == "F").alias("resolved")))).alias("s"))
    return o.select("o_custkey", grades.flow_diagram(F.col("s")).alias("diagram"))


# Histories ------------------------------------------------------------------------------------------------------------------------


@query("""WITH ev AS (SELECT p.p_brand AS root_name, l_partkey % 20 AS t, l_linenumber AS c, l_orderkey AS f, CASE l_returnflag WHEN 'A' THEN 1 WHEN 'R' THEN 2 ELSE 0 END AS r, l_suppkey AS pos, l_linestatus AS ty FROM lineitem JOIN part p ON p_partkey = l_partkey),
k AS (SELECT DISTINCT root_name, t, c FROM ev WHERE r < 2), x AS (SELECT * FROM ev WHERE r < 2 UNION ALL SELECT ev.root_name, ev.t, k.c, f, r, pos, ty FROM ev JOIN k ON k.root_name = ev.root_name AND k.t = ev.t WHERE r = 2),
w AS (SELECT *, row_number() OVER (PARTITION BY root_name, t, c ORDER BY f DESC, r DESC, pos DESC, ty DESC) AS n FROM x)
SELECT root_name, t AS table_name, c AS column_name FROM w WHERE n = 1 AND r = 0""")
def x6_schema_history(spark, sf_dir):
    action = F.when(F.col("l_returnflag") == "A", "drop-column").when(F.col("l_returnflag") == "R", "drop-table").otherwise("create")
    li = ad.table(spark, sf_dir, "lineitem").join(ad.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")
    e = li.select(F.col("p_brand").alias("root_name"), F.col("l_orderkey").alias("file_seq"), action.alias("action"), F.col("l_suppkey").alias("pos"), (F.col("l_partkey") % 20).alias("table_name"), F.when(F.col("l_returnflag") != "R", F.col("l_linenumber")).alias("column_name"), F.col("l_linestatus").alias("type"))
    return history.fold_schema_history(e).drop("type")


@query(f"""WITH l AS (SELECT DISTINCT p_brand AS root_name, CASE p_size % 3 WHEN 0 THEN '' WHEN 1 THEN 'a' ELSE 'a/b' END AS dir, p_type AS name, p_size::VARCHAR AS version FROM part WHERE p_size < 25),
d AS (SELECT p_partkey AS dep, p_brand AS root_name, CASE p_partkey % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'a/b/c' ELSE 'x' END AS dir, p_type AS name FROM part),
a AS (SELECT dep, l.dir, len(l.dir) AS depth, version FROM d JOIN l ON l.root_name = d.root_name AND l.name = d.name AND (l.dir = '' OR l.dir = d.dir OR d.dir LIKE l.dir || '/%')),
n AS (SELECT dep, min(version) AS version, count(DISTINCT version) AS k FROM a WHERE depth = (SELECT max(depth) FROM a b WHERE b.dep = a.dep) GROUP BY 1)
SELECT d.dep, CASE k WHEN 1 THEN version END AS version FROM d LEFT JOIN n USING (dep)""")
def j19_resolve_versions(spark, sf_dir):
    p = ad.table(spark, sf_dir, "part")
    of = lambda c, *v: F.element_at(F.array(*map(F.lit, v)), (F.col(c) % 3 + 1).cast("int"))
    deps = p.select(F.col("p_partkey").alias("dep"), F.col("p_brand").alias("root_name"), of("p_partkey", "a", "a/b/c", "x").alias("dir"), F.col("p_type").alias("name"))
    locks = p.where("p_size < 25").select(F.col("p_brand").alias("root_name"), of("p_size", "", "a", "a/b").alias("dir"), F.col("p_type").alias("name"), F.col("p_size").cast("string").alias("version"))
    return history.resolve_versions(deps, locks).select("dep", "version")


@query("""WITH RECURSIVE g AS (SELECT c_custkey AS id, c_custkey // 4 AS parent, '/' || c_mktsegment AS prefix FROM customer),
r AS (SELECT id, prefix, 1 AS n FROM g WHERE parent = 0 UNION ALL SELECT g.id, r.prefix || g.prefix, n + 1 FROM g JOIN r ON g.parent = r.id WHERE g.parent <> 0) SELECT id AS group_id, prefix, n AS depth FROM r""")
def j29_compose_prefixes(spark, sf_dir):
    c = ad.table(spark, sf_dir, "customer")
    parent = F.floor(F.col("c_custkey") / 4)
    g = c.select(F.col("c_custkey").alias("group_id"), F.when(parent > 0, parent).alias("parent_id"), F.concat(F.lit("/"), "c_mktsegment").alias("prefix"), F.array("c_mktsegment").alias("middleware"))
    return history.compose_prefixes(g).select("group_id", "prefix", F.size("middleware").cast("long").alias("depth"))


@query("""SELECT p_partkey AS registration_id, CASE WHEN s_name IS NULL THEN '/' || p_partkey ELSE '/' || s_suppkey || '/' || p_partkey END AS path, CASE WHEN s_name IS NULL THEN 'inferred' ELSE 'direct' END AS class, CASE WHEN s_name IS NULL THEN 'file is not mounted' END AS failure
FROM part LEFT JOIN supplier ON s_nationkey = p_size""")
def j28_expand_mounts(spark, sf_dir):
    r = ad.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("registration_id"), F.lit("svc").alias("root_name"), F.col("p_size").alias("rel_path"), F.concat(F.lit("/"), "p_partkey").alias("path"))
    m = ad.table(spark, sf_dir, "supplier").select(F.lit("svc").alias("root_name"), F.col("s_nationkey").alias("rel_path"), F.concat(F.lit("/"), "s_suppkey").alias("prefix"))
    return history.expand_mounts(r, m)


# Behaviour ------------------------------------------------------------------------------------------------------------------------


@query(f"""WITH {ad.CONDITIONS_SQL} SELECT 'behavioral|condition|' || root_name || '|' || subject || '|' || operator || '|' || literal || '|' || rel_path || '|' || start_line AS fact_id, 'condition' AS kind, CASE WHEN literal > 25 THEN 'symbol' ELSE 'module' END AS scope, CASE WHEN literal % 2 = 0 THEN 'conditional' ELSE 'active' END AS activation FROM conditions""")
def b1_condition_facts(spark, sf_dir):
    c = ad.parts_as_conditions(spark, sf_dir).withColumns({"enclosing_function": F.when(F.col("literal") > 25, "f"), "guarded": F.col("literal") % 2 == 0})
    return behavior.condition_facts(c)


@query(f"""WITH {CHANGES_SQL} SELECT user_id AS subject, CASE WHEN f <> 'view' THEN f END AS from_state, CASE WHEN t <> 'view' THEN t END AS to_state, CASE WHEN t = 'view' THEN 'target is no state' WHEN f = 'view' THEN 'start is no state' END AS diagnostic, count(*) AS times FROM ch WHERE f IS NOT NULL GROUP BY ALL""")
def b4_transitions(spark, sf_dir):
    ch = type_changes(spark, sf_dir).toDF("subject", "from_state", "to_state")
    states = ad.table(spark, sf_dir, "events").where("event_type <> 'view'").select(F.col("event_type").alias("state"))
    return behavior.transition_facts(ch, states)


@query(f"""WITH {ad.GRAPH_SQL}, t AS (SELECT DISTINCT caller_id AS id FROM edges WHERE caller_id LIKE 'o%5' OR caller_id LIKE 'p%'), c AS (SELECT DISTINCT caller_id AS test_id, callee_id AS target_id FROM edges WHERE caller_id IN (SELECT id FROM t) AND (callee_id IS NULL OR callee_id NOT IN (SELECT id FROM t)))
SELECT *, CASE WHEN target_id IS NULL THEN 'unresolved' ELSE 'covered' END AS status FROM c UNION ALL SELECT id, NULL, 'unknown' FROM t WHERE id NOT IN (SELECT test_id FROM c)""")
def j17_test_relations(spark, sf_dir):
    e = graphs.cut(ad.supply_graph(spark, sf_dir))
    s = e.select(F.col("caller_id").alias("id")).distinct().withColumn("is_test", F.col("id").like("o%5") | F.col("id").like("p%"))
    return behavior.test_relations(s, e)


@query("""SELECT o_custkey AS fact_id, min(ascii(o_orderstatus)) AS source_rank, count(DISTINCT o_orderstatus) > 1 AS shared FROM orders GROUP BY 1""")
def b9_assemble(spark, sf_dir):
    o = ad.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("fact_id"), F.ascii("o_orderstatus").alias("source_rank"), "o_orderpriority")
    facts, notes = behavior.assemble_behavior(o)
    return facts.join(notes, "fact_id", "left").select("fact_id", "source_rank", F.col("diagnostic").isNotNull().alias("shared"))


@query("""SELECT p_type AS kind, CASE WHEN count(DISTINCT p_brand) > 1 THEN 'several owners' END AS problem FROM part WHERE p_size < 10 GROUP BY 1 HAVING count(DISTINCT p_brand) > 1
UNION ALL SELECT DISTINCT p_type, 'no owner' FROM part WHERE p_type NOT IN (SELECT p_type FROM part WHERE p_size < 10)""")
def v2_ownership(spark, sf_dir):
    p = ad.table(spark, sf_dir, "part")
    return behavior.validate_ownership(p.where("p_size < 10").select(F.col("p_brand").alias("owner"), F.col("p_type").alias("kind")), p.select(F.col("p_type").alias("kind")))


@query("""WITH d AS (SELECT p_type AS kind, p_brand AS language, max(p_size) AS level FROM part WHERE p_size > 40 GROUP BY ALL), s AS (SELECT p_type AS kind, min(p_size) AS level FROM part WHERE p_size > 45 GROUP BY 1), w AS (SELECT DISTINCT p_type AS kind, p_brand AS language FROM part)
SELECT w.kind, w.language, coalesce(d.level, s.level) AS level FROM w LEFT JOIN d USING (kind, language) LEFT JOIN s USING (kind)""")
def v6_capability(spark, sf_dir):
    p = ad.table(spark, sf_dir, "part").select(F.col("p_type").alias("kind"), F.col("p_brand").alias("language"), "p_size")
    declared = p.where("p_size > 40").groupBy("kind", "language").agg(F.max("p_size").alias("level")).unionByName(p.where("p_size > 45").groupBy("kind").agg(F.min("p_size").alias("level")).withColumn("language", F.lit("*")))
    return behavior.capability_for(p.select("kind", "language").distinct(), declared)


# Reports --------------------------------------------------------------------------------------------------------------------------


def reports(spark, sf_dir):
    """Conversations as reports: the turns, and a proportion of user turns that is wrong in every seventh, with cited files."""
    c = ad.table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("d"), F.count_if(F.col("role") == "user").alias("n"))
    pct = F.floor(100 * F.col("n") / F.col("d") + 0.5) + F.when(F.col("conv_id") % 7 == 0, 5).otherwise(0)
    text = F.concat(F.lit("# Counts\n"), pct.cast("string"), F.lit("% ("), F.col("n"), F.lit("/"), F.col("d"), F.lit(")\n## Files\n`part|"), F.col("conv_id") % 4, F.lit("` in lang/"), F.lit("en/"), F.col("conv_id"), F.lit(".txt and nowhere.xyz\n"))
    return c.select(F.col("conv_id").alias("report_id"), "n", "d", text.alias("text"))


REPORTS_SQL = r"""r AS (SELECT conv_id AS report_id, count(*) AS d, count(*) FILTER (role = 'user') AS n, floor(100.0 * count(*) FILTER (role = 'user') / count(*) + 0.5)::BIGINT + CASE WHEN conv_id % 7 = 0 THEN 5 ELSE 0 END AS pct FROM conversations GROUP BY conv_id)"""


@query(f"""WITH {REPORTS_SQL}, k AS (SELECT DISTINCT count(*) AS v FROM conversations WHERE role = 'user' GROUP BY conv_id UNION SELECT 2 UNION SELECT 4)
SELECT report_id, 0 AS pos, pct AS stated, n AS numerator, d AS denominator, CASE WHEN d NOT IN (SELECT v FROM k) THEN 'unknown-denominator' WHEN report_id % 7 = 0 THEN 'wrong-proportion' END AS finding FROM r""")
def q2_q7_proportions(spark, sf_dir):
    known = ad.table(spark, sf_dir, "conversations").where("role = 'user'").groupBy("conv_id").agg(F.count("*").alias("value")).select("value").union(spark.createDataFrame([(2,), (4,)], "value long"))
    return audit.audit_proportions(audit.cited_proportions(reports(spark, sf_dir)), known)


@query(f"""WITH {REPORTS_SQL} SELECT report_id, 'nowhere.xyz' AS path, 'cited-extension-absent' AS finding FROM r UNION ALL SELECT report_id, 'lang/en/' || report_id || '.txt', 'not-in-workspace' FROM r WHERE NOT EXISTS (SELECT 1 FROM documents WHERE doc_id = report_id AND lang = 'en')""")
def q1_q6_paths(spark, sf_dir):
    files = ad.table(spark, sf_dir, "documents").select(F.concat(F.lit("src/lang/"), "lang", F.lit("/"), "doc_id", F.lit(".txt")).alias("rel_path"))
    return audit.audit_paths(audit.cited_paths(reports(spark, sf_dir)), files)


@query(f"""WITH {REPORTS_SQL} SELECT report_id, 2 AS section, 'part|' || report_id % 4 AS identity FROM r""")
def q3_q4_identities(spark, sf_dir):
    s = audit.line_sections(reports(spark, sf_dir), "report_id")
    return audit.cited_identities(s, spark.createDataFrame([("part",)], "namespace string"), "report_id")


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
s AS (SELECT *, sum((regexp_matches(line, '^[A-Z][a-z]+ed under'))::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS section FROM l)
SELECT doc_id, section::BIGINT AS section, count(*) AS lines, length(string_agg(line, chr(10) ORDER BY pos))::INT AS size FROM s GROUP BY ALL""")
def x7_sections(spark, sf_dir):
    """License lines as headings."""
    s = audit.line_sections(ad.table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "^[A-Z][a-z]+ed under")
    return s.select("doc_id", "section", "lines", F.length("body").alias("size"))


@query("""WITH f AS (SELECT source AS root_name, lang AS disposition FROM documents) SELECT root_name, disposition, count(*) AS value FROM f GROUP BY CUBE (root_name, disposition)""")
def d27_denominators(spark, sf_dir):
    return audit.denominators(ad.table(spark, sf_dir, "documents").select(F.col("source").alias("root_name"), F.col("lang").alias("disposition")))


@query(f"""WITH {ad.RUNS_SQL} SELECT id, count(*) AS runs FROM runs GROUP BY 1 HAVING count(*) <> (SELECT count(DISTINCT run_id) FROM runs)""")
def o4_identity_drift(spark, sf_dir):
    return audit.identity_drift(ad.months_as_runs(spark, sf_dir))


@query("""SELECT p_type AS kind, count(DISTINCT p_brand) AS tables FROM part GROUP BY 1 HAVING count(DISTINCT p_brand) > 1""")
def o6_multi_table_kinds(spark, sf_dir):
    return audit.multi_table_kinds(ad.table(spark, sf_dir, "part").select(F.col("p_brand").alias("table_name"), F.col("p_type").alias("kind")))


@query("""SELECT DISTINCT o_custkey AS id FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')""")
def o7_missing_items(spark, sf_dir):
    o = ad.table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "id")
    return audit.missing_items(o, o.where("o_orderstatus = 'P'"))


@query("""SELECT CASE WHEN quality = 1 THEN CASE WHEN lang IS NULL THEN 'missed' ELSE 'found' END ELSE CASE WHEN lang IS NULL THEN 'clean' ELSE 'contradicted' END END AS verdict, count(*) AS n
FROM labels l LEFT JOIN (SELECT DISTINCT CASE WHEN n_chars > 1000 THEN doc_id END AS doc_id, lang FROM documents) d ON d.doc_id = l.doc_id GROUP BY 1""")
def d29_grade(spark, sf_dir):
    truth = ad.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.lit("text").alias("kind"), F.col("doc_id").alias("path"), F.when(F.col("quality") == 1, "present").otherwise("absent").alias("expects"))
    return audit.grade(truth, ad.table(spark, sf_dir, "documents").select(F.lit("text").alias("kind"), F.when(F.col("n_chars") > 1000, F.col("doc_id")).alias("path")))


# Sources and scans ----------------------------------------------------------------------------------------------------------------


@query(f"""WITH {ad.FILES_SQL}, x AS (SELECT root_name, size_bytes, CASE WHEN size_bytes % 5 = 0 THEN 'vendor/' || rel_path ELSE rel_path END AS p, contains(lower(substr(content, 1, 500)), 'generated') AND contains(lower(substr(content, 1, 500)), 'do not edit') AS g FROM files)
SELECT root_name, p AS rel_path, size_bytes::BIGINT AS size_bytes, 'analyzed' AS disposition, 'documentation' AS classification, NULL::VARCHAR AS reason FROM x WHERE p NOT LIKE 'vendor/%'
UNION ALL SELECT root_name, 'vendor', sum(size_bytes)::BIGINT, 'excluded', 'vendored', 'dependency folder' FROM x WHERE p LIKE 'vendor/%' GROUP BY 1""")
def s2_inventory(spark, sf_dir):
    f = ad.docs_as_files(spark, sf_dir)
    return corpus.inventory(f.withColumn("rel_path", F.when(F.col("size_bytes") % 5 == 0, F.concat(F.lit("vendor/"), "rel_path")).otherwise(F.col("rel_path"))))


@query("""SELECT source AS workspace, first(doc_id::VARCHAR ORDER BY n_chars DESC, doc_id::VARCHAR DESC) AS snapshot_id FROM documents WHERE lang <> 'fr' GROUP BY 1""")
def s14_latest_snapshots(spark, sf_dir):
    s = ad.table(spark, sf_dir, "documents").select(F.col("source").alias("workspace"), F.col("doc_id").cast("string").alias("snapshot_id"), F.when(F.col("lang") != "fr", F.col("n_chars")).alias("published_at"))
    return base.latest_snapshots(s)


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
c AS (SELECT *, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM l WHERE starts_with(trim(line), 'The'))
SELECT doc_id, min(pos)::BIGINT AS start_line, count(*) AS lines, (sum(length(trim(substr(trim(line), 4)))) + count(*) - 1)::BIGINT AS size FROM c GROUP BY doc_id, island""")
def x8_comment_blocks(spark, sf_dir):
    """Lines that begin with The, as comment lines."""
    f = ad.table(spark, sf_dir, "documents").select(F.lit("r").alias("root_name"), F.col("doc_id").alias("rel_path"), F.col("text").alias("content"))
    return scans.doc_comments(f, "The").select(F.col("rel_path").alias("doc_id"), "start_line", "lines", F.length("text").cast("long").alias("size"))


CODE_SQL = r"""code AS (SELECT doc_id, CASE lang WHEN 'en' THEN 'go' WHEN 'de' THEN 'java' WHEN 'fr' THEN 'ts' ELSE 'py' END AS ext,
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\bthe\b', 'x.Begin(', 'g'), '\bund\b', '@Transactional', 'g'), '\bles\b', 'catch (', 'g'), '\bque\b', 'SELECT', 'g') AS content FROM documents)"""


def docs_as_code(spark, sf_dir):
    """Documents as files of four languages, in which common words stand for what the conventions look for."""
    d = ad.table(spark, sf_dir, "documents")
    ext = F.when(F.col("lang") == "en", "go").when(F.col("lang") == "de", "java").when(F.col("lang") == "fr", "ts").otherwise("py")
    content = F.col("text")
    for word, code in (("the", "x.Begin("), ("und", "@Transactional"), ("les", "catch ("), ("que", "SELECT")):
        content = F.regexp_replace(content, rf"(?<!\w){word}(?!\w)", code)
    return d.select(F.lit("r").alias("root_name"), F.concat_ws(".", F.col("doc_id"), ext).alias("rel_path"), content.alias("content"))


@query(rf"""WITH {CODE_SQL}, l AS (SELECT doc_id, ext, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS line_no FROM code),
m AS (SELECT doc_id, line_no, line, 'Begin' AS label, '\.Begin(?:Tx)?\s*\(' AS p FROM l WHERE ext = 'go' UNION ALL SELECT doc_id, line_no, line, '@Transactional', '@Transactional\b' FROM l WHERE ext = 'java' UNION ALL SELECT doc_id, line_no, line, 'catch', '\bcatch\b\s*[({{]' FROM l WHERE ext IN ('ts', 'java', 'py')
  UNION ALL SELECT doc_id, line_no, line, 'sql', '\b(SELECT|INSERT\s+INTO|UPDATE|DELETE\s+FROM)\b' FROM l),
n AS (SELECT doc_id, label, line_no, len(CASE label WHEN 'Begin' THEN regexp_extract_all(line, '\.Begin(?:Tx)?\s*\(') WHEN '@Transactional' THEN regexp_extract_all(line, '@Transactional\b') WHEN 'catch' THEN regexp_extract_all(line, '\bcatch\b\s*[({{]') ELSE regexp_extract_all(line, '\b(SELECT|INSERT\s+INTO|UPDATE|DELETE\s+FROM)\b') END) AS n,
  length(regexp_extract(line, CASE label WHEN 'Begin' THEN '^(.*?)\.Begin(?:Tx)?\s*\(' WHEN '@Transactional' THEN '^(.*?)@Transactional\b' WHEN 'catch' THEN '^(.*?)\bcatch\b\s*[({{]' ELSE '^(.*?)\b(SELECT|INSERT\s+INTO|UPDATE|DELETE\s+FROM)\b' END, 1)) + 1 AS col FROM m)
SELECT doc_id, label, line_no::BIGINT AS line, n::BIGINT AS n, col::BIGINT AS first_column FROM n WHERE n > 0""")
def x1_scan_patterns(spark, sf_dir):
    """All conventions over whole texts, by line."""
    m = scans.scan_patterns(docs_as_code(spark, sf_dir))
    return m.groupBy(F.regexp_extract("rel_path", "^[0-9]+", 0).cast("long").alias("doc_id"), "label", "line").agg(F.count("*").alias("n"), F.min("column").alias("first_column"))


# Flows, routes and effects ----------------------------------------------------------------------------------------------------------


@query(f"""WITH {ad.ACCESS_SQL}, f AS (SELECT DISTINCT c_custkey AS flow_id, c_nationkey AS n FROM customer),
s AS (SELECT flow_id, 0 AS rank, 'part_' || flow_id AS scope FROM f UNION ALL SELECT flow_id, 1, 'supplier-' || n FROM f UNION ALL SELECT flow_id, 2, 'supplier-' || (n + 1) FROM f),
a AS (SELECT 0 AS rank, entity AS scope, entity, operation FROM access WHERE root_name LIKE '%7' UNION ALL SELECT 1, root_name, entity, operation FROM access WHERE root_name LIKE '%2' UNION ALL SELECT 2, root_name, entity, operation FROM access),
m AS (SELECT s.flow_id, s.rank, entity, operation FROM s JOIN a ON s.rank = a.rank AND s.scope = a.scope), b AS (SELECT flow_id, min(rank) AS rank FROM m GROUP BY 1),
p AS (SELECT flow_id, rank, entity, coalesce(string_agg(DISTINCT CASE operation WHEN 'unknown' THEN NULL ELSE operation END, ',' ORDER BY CASE operation WHEN 'unknown' THEN NULL ELSE operation END), '') AS ops FROM m JOIN b USING (flow_id, rank) GROUP BY ALL)
SELECT flow_id, entity, ops AS operations, rank = 2 AS indirect, greatest(n - 12, 0) AS more FROM (SELECT *, row_number() OVER (PARTITION BY flow_id ORDER BY entity) AS k, count(*) OVER (PARTITION BY flow_id) AS n FROM p) WHERE k <= 12""")
def j12_flow_data_access(spark, sf_dir):
    a = ad.lineitem_as_access(spark, sf_dir)
    f = ad.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("flow_id"), F.col("c_nationkey").alias("n"))
    level = lambda rank, scope: F.struct(F.lit(rank).alias("rank"), scope.alias("scope"))
    supplier = lambda n: F.concat(F.lit("supplier-"), n.cast("string"))
    scopes = f.select("flow_id", F.explode(F.array(level(0, F.concat(F.lit("part_"), F.col("flow_id"))), level(1, supplier(F.col("n"))), level(2, supplier(F.col("n") + 1)))).alias("s")).select("flow_id", "s.*")
    access = a.where("root_name like '%7'").select(F.lit(0).alias("rank"), F.col("entity").alias("scope"), "entity", "operation").unionByName(a.where("root_name like '%2'").select(F.lit(1).alias("rank"), F.col("root_name").alias("scope"), "entity", "operation")).unionByName(a.select(F.lit(2).alias("rank"), F.col("root_name").alias("scope"), "entity", "operation"))
    return flows.flow_data_access(scopes, access).withColumn("operations", F.array_join("operations", ","))


@query(f"""WITH {ad.CONDITIONS_SQL} SELECT root_name, rel_path, literal % 10 AS enclosing_function, array_to_string((list(DISTINCT subject ORDER BY subject))[1:6], ',') AS texts FROM conditions GROUP BY ALL""")
def j15_rule_conditions(spark, sf_dir):
    c = ad.parts_as_conditions(spark, sf_dir).select("root_name", "rel_path", (F.col("literal") % 10).alias("enclosing_function"), F.col("subject").alias("text"))
    return flows.rule_conditions(c).withColumn("texts", F.array_join("texts", ","))


@query(f"""WITH {ad.CONDITIONS_SQL}, f AS (SELECT DISTINCT p_size % 5 AS feature_id, p_brand AS root_name, lower(p_brand) || '.go' AS rel_path FROM part) SELECT DISTINCT feature_id, rule_id FROM f JOIN conditions USING (root_name, rel_path)""")
def j16_feature_rules(spark, sf_dir):
    f = ad.table(spark, sf_dir, "part").groupBy((F.col("p_size") % 5).alias("feature_id")).agg(F.collect_set(F.struct(F.col("p_brand").alias("root_name"), F.concat(F.lower("p_brand"), F.lit(".go")).alias("rel_path"))).alias("file_paths"))
    return flows.feature_rules(f, ad.parts_as_conditions(spark, sf_dir))


@query("""WITH r AS (SELECT p_brand AS feature_id, p_partkey AS rule_id, p_name AS statement, CASE WHEN p_size % 4 = 0 THEN 0 WHEN p_size >= 30 THEN 1 WHEN p_size % 3 = 0 THEN 2 END AS r FROM part)
SELECT feature_id, rule_id, statement, (['disagreed', 'repeated', 'unnamed-value'])[r + 1] AS reason FROM (SELECT *, row_number() OVER (PARTITION BY feature_id ORDER BY r, statement, rule_id) AS k FROM r WHERE r IS NOT NULL) WHERE k <= 20""")
def d14_notable_rules(spark, sf_dir):
    s = F.col("p_size")
    r = ad.table(spark, sf_dir, "part").select(F.col("p_brand").alias("feature_id"), F.col("p_partkey").alias("rule_id"), F.col("p_name").alias("statement"), (s % 4 == 0).alias("disagreed"), F.when(s >= 30, 3).otherwise(1).alias("places"), (s % 3 == 0).alias("unexplained"))
    return flows.notable_rules(r)


@query("""WITH e AS (SELECT o_custkey AS feature_id, o_orderstatus = 'F' AS a, o_orderpriority < '3' AS c, o_totalprice > 100000 AS h FROM orders), g AS (SELECT feature_id, count(*) AS total, count(*) FILTER (NOT a) AS na, count(*) FILTER (NOT c) AS nc, count(*) FILTER (NOT h) AS nh FROM e GROUP BY 1)
SELECT feature_id, 'without-auth' AS code, na AS n, total, CASE WHEN na = total THEN 'concern' ELSE 'notice' END AS severity FROM g WHERE na > 0 UNION ALL SELECT feature_id, 'without-caller', nc, total, 'info' FROM g WHERE nc > 0 UNION ALL SELECT feature_id, 'without-handler', nh, total, 'notice' FROM g WHERE nh > 0""")
def d11_feature_findings(spark, sf_dir):
    o = ad.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("feature_id"), (F.col("o_orderstatus") == "F").alias("has_auth"), (F.col("o_orderpriority") < "3").alias("has_caller"), (F.col("o_totalprice") > 100000).alias("has_handler"))
    return flows.feature_findings(o)


@query("""WITH e AS (SELECT o_custkey AS feature_id, count(DISTINCT o_orderkey) AS endpoints FROM orders GROUP BY 1), t AS (SELECT o_custkey AS feature_id, list(DISTINCT l_partkey::VARCHAR) FILTER (l_linenumber > 1) AS o, list(DISTINCT l_partkey::VARCHAR) FILTER (l_linenumber <= 1) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)
SELECT feature_id, endpoints, array_to_string(list_sort(coalesce(o, [])), ',') AS tables, array_to_string(list_sort(list_filter(coalesce(n, []), lambda x: NOT list_contains(coalesce(o, []), x))), ',') AS nearby, endpoints AS flows, (SELECT count(*) FROM orders x WHERE x.o_custkey = feature_id AND o_orderstatus = 'P') AS partial FROM e LEFT JOIN t USING (feature_id)""")
def d15_feature_facts(spark, sf_dir):
    o = ad.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("feature_id"), F.col("o_orderkey").alias("route_id"), F.col("o_orderkey").alias("flow_id"), (F.col("o_orderstatus") == "P").alias("partial"))
    t = ad.table(spark, sf_dir, "lineitem").join(o, F.col("l_orderkey") == F.col("route_id")).select("feature_id", F.col("l_partkey").cast("string").alias("entity"), (F.col("l_linenumber") <= 1).alias("nearby"))
    return flows.feature_facts(o, t, o).withColumns({"tables": F.array_join("tables", ","), "nearby": F.array_join("nearby", ",")})


@query("""WITH m AS (SELECT count(*) AS t, count(*) FILTER (o_orderstatus = 'F') AS a, count(*) FILTER (o_orderstatus = 'O') AS b, count(*) FILTER (o_orderpriority < '2') AS c, count(*) FILTER (o_orderstatus = 'P') AS p FROM orders), x AS (SELECT *, floor(100.0 * a / t + 0.5)::BIGINT AS pa, floor(100.0 * b / t + 0.5)::BIGINT AS pb, floor(100.0 * c / (t + c) + 0.5)::BIGINT AS pc, floor(100.0 * p / t + 0.5)::BIGINT AS pp FROM m)
SELECT 'unresolved-integrations' AS signal, pa AS measured, CASE WHEN pa > 50 THEN 'concern' WHEN pa > 20 THEN 'notice' ELSE 'info' END AS severity FROM x UNION ALL SELECT 'root-cycles', 0, 'info' UNION ALL SELECT 'partial-traces', pb, CASE WHEN pb > 60 THEN 'concern' WHEN pb > 30 THEN 'notice' ELSE 'info' END FROM x
UNION ALL SELECT 'untraced-entry-points', pc, 'info' FROM x UNION ALL SELECT 'behavioural-coverage', pp, CASE WHEN pp < 20 THEN 'notice' ELSE 'info' END FROM x UNION ALL SELECT 'modules-spanning-roots', c, CASE WHEN c > 0 THEN 'notice' ELSE 'info' END FROM x UNION ALL SELECT 'declared-dependencies', b, 'info' FROM x""")
def d18_health_signals(spark, sf_dir):
    """Of a run in which nothing could link entries to code."""
    o, t = ad.table(spark, sf_dir, "orders"), F.count("*")
    a, b, c, p = F.count_if(F.col("o_orderstatus") == "F"), F.count_if(F.col("o_orderstatus") == "O"), F.count_if(F.col("o_orderpriority") < "2"), F.count_if(F.col("o_orderstatus") == "P")
    named = {"considered": t, "unlinked": a, "cycles": F.sum(F.lit(0)), "traces": t, "partial": b, "untraced": c, "files": t, "behavioural": p, "spanning": c, "direct": b}
    return flows.health_signals(o.agg(*(v.alias(k) for k, v in named.items())).withColumn("linking", F.lit(False)))


@query("""WITH g AS (SELECT DISTINCT p_brand AS root, p_type AS kind, CASE WHEN p_size > 25 THEN 'big' ELSE 'small' END AS reason FROM part), t AS (SELECT count(DISTINCT p_brand) AS n FROM part)
SELECT kind, reason, CASE WHEN count(*) = (SELECT n FROM t) THEN 'all parts' ELSE string_agg(root, ', ' ORDER BY root) END AS "where" FROM g GROUP BY 1, 2""")
def d19_coverage_notes(spark, sf_dir):
    p = ad.table(spark, sf_dir, "part").select(F.col("p_brand").alias("root_name"), F.col("p_type").alias("kind"), F.when(F.col("p_size") > 25, "big").otherwise("small").alias("reason"))
    return flows.coverage_notes(p, p)


@query("""WITH r AS (SELECT DISTINCT p_type AS kind FROM part), c AS (SELECT p_type AS kind, sum(CASE WHEN p_size > 49 THEN p_size ELSE 0 END) AS n FROM part GROUP BY 1) SELECT kind, n::BIGINT AS n, n = 0 AS missing FROM r LEFT JOIN c USING (kind)""")
def d26_readiness(spark, sf_dir):
    p = ad.table(spark, sf_dir, "part").select(F.col("p_type").alias("kind"), F.when(F.col("p_size") > 49, F.col("p_size")).otherwise(0).alias("n"))
    return flows.readiness(p, p)


@query("""WITH s AS (SELECT source AS workspace, lang AS snapshot_id, max(n_chars) AS pub FROM documents WHERE lang <> 'es' GROUP BY 1, 2), l AS (SELECT workspace, first(snapshot_id ORDER BY pub DESC, snapshot_id DESC) AS snapshot_id FROM s GROUP BY 1)
SELECT w.workspace, l.snapshot_id, (SELECT count(DISTINCT source) FROM documents WHERE lang = l.snapshot_id) AS roots, (SELECT count(*) FROM documents WHERE lang = l.snapshot_id) AS files FROM (SELECT DISTINCT source AS workspace FROM documents) w LEFT JOIN l USING (workspace)""")
def d23_status(spark, sf_dir):
    d = ad.table(spark, sf_dir, "documents")
    s = d.groupBy(F.col("source").alias("workspace"), F.col("lang").alias("snapshot_id")).agg(F.max(F.when(F.col("lang") != "es", F.col("n_chars"))).alias("published_at"))
    return flows.status(s, d.select(F.col("lang").alias("snapshot_id"), F.col("source").alias("root_name")))


@query(f"""WITH {ad.ROUTES_SQL}, l AS (SELECT DISTINCT host, path FROM p)
SELECT root_name, NULL::VARCHAR AS method, path, CASE WHEN EXISTS (SELECT 1 FROM l WHERE l.host = root_name AND l.path = r.path) THEN 'crawler' ELSE '' END AS callers FROM routes r""")
def j11_frontend_callers(spark, sf_dir):
    p = ad.table(spark, sf_dir, "pages")
    links = p.select(paths.host_of(F.col("url")).alias("to_root"), paths.trim_slashes(paths.path_of(F.col("url"))).alias("route_path"), F.lit("GET").alias("method"), F.lit("crawler").alias("from_root"))
    return flows.frontend_callers(ad.pages_as_routes(spark, sf_dir), links).withColumn("callers", F.array_join("callers", ","))


@query("""WITH r AS (SELECT p_partkey AS id, p_brand AS root, p_size % 10 AS file, p_partkey % 4 AS line, CASE WHEN p_partkey % 3 = 0 THEN 'direct' ELSE 'inferred' END AS class, CASE WHEN p_partkey % 3 = 0 THEN '/v2/' || p_size % 7 ELSE '/' || p_size % 7 END AS path FROM part),
m AS (SELECT w.id, d.id AS into_id, w.line <> d.line AS far, d.line, d.path FROM r w JOIN r d ON d.class = 'direct' AND w.class = 'inferred' AND d.root = w.root AND d.file = w.file AND d.path LIKE '%' || w.path), f AS (SELECT id, first(into_id ORDER BY far, line, path, into_id) AS into_id FROM m GROUP BY 1)
SELECT r.id AS route_id, r.path, (SELECT count(DISTINCT w.path) FROM f JOIN r w ON w.id = f.id WHERE f.into_id = r.id) AS conflicts, 1 + (SELECT count(DISTINCT w.id % 5) FROM f JOIN r w ON w.id = f.id WHERE f.into_id = r.id AND w.id % 5 <> r.id % 5) AS providers FROM r WHERE r.id NOT IN (SELECT id FROM f)""")
def j18_consolidate_routes(spark, sf_dir):
    k, direct = F.col("p_partkey"), F.col("p_partkey") % 3 == 0
    tail = (F.col("p_size") % 7).cast("string")
    r = ad.table(spark, sf_dir, "part").select(k.alias("route_id"), F.col("p_brand").alias("root_name"), (F.col("p_size") % 10).alias("rel_path"), (k % 4).alias("start_line"), F.lit("GET").alias("method"), F.when(direct, F.concat(F.lit("/v2/"), tail)).otherwise(F.concat(F.lit("/"), tail)).alias("path"), F.when(direct, "direct").otherwise("inferred").alias("class"), F.array((k % 5).cast("string")).alias("providers"), F.lit(False).alias("verb_use"))
    return routes.consolidate_routes(r).select("route_id", "path", F.size("conflicts").cast("long").alias("conflicts"), F.size("providers").cast("long").alias("providers"))


@query(f"""WITH {ad.ACCESS_SQL} SELECT DISTINCT 'behavioral|side-effect|data|' || root_name || '|' || entity || '|' || operation AS fact_id, 'data-' || operation AS effect, entity AS target FROM access UNION ALL SELECT DISTINCT 'behavioral|side-effect|call|crawler|' || url, 'unresolved-call', url FROM pages
UNION ALL SELECT DISTINCT 'behavioral|side-effect|package|' || p_brand || '|' || p_type || '|' || p_size, 'external-package', p_type FROM part UNION ALL SELECT DISTINCT 'behavioral|side-effect|notify|' || event_type || '|mail', 'notification', 'mail' FROM events""")
def b7_side_effects(spark, sf_dir):
    calls = ad.pages_as_calls(spark, sf_dir).select("root_name", "target", F.lit(None).cast("string").alias("to_root"))
    packages = ad.table(spark, sf_dir, "part").select(F.col("p_brand").alias("root_name"), F.col("p_type").alias("package"), F.col("p_size").alias("member"))
    notes = ad.table(spark, sf_dir, "events").select(F.col("event_type").alias("root_name"), F.lit("mail").alias("mechanism"))
    return effects.side_effect_facts(ad.lineitem_as_access(spark, sf_dir), calls, packages, notes)


@query("""SELECT event_id, CASE WHEN event_type = 'view' THEN 'authorization' WHEN event_type IN ('signup', 'purchase') OR (event_type = 'click' AND event_id % 2 = 0) THEN 'authentication' ELSE 'unresolved' END AS "check" FROM events""")
def e21_auth_check(spark, sf_dir):
    """Whole words of a mechanism count: a user's session and a JWT do, an author or a superuser does not."""
    e, t = ad.table(spark, sf_dir, "events"), F.col("event_type")
    mechanism = F.when(t == "signup", "userSession").when(t == "purchase", "JWT-guard").when(t == "click", F.when(F.col("event_id") % 2 == 0, "requireLogin").otherwise("authorRole")).otherwise("superuser")
    return e.select("event_id", effects.auth_check_of(mechanism, F.when(t == "view", "role")).alias("check"))


@query(f"""WITH {SETS_SQL}, e AS (SELECT p_partkey AS rule_id, p_brand AS root_name, 'Part_' || string_split(p_type, ' ')[-1] || '_Set' AS name FROM part) SELECT rule_id, coalesce((SELECT s.root_name FROM s WHERE s.root_name = e.root_name AND s.name = e.name), (SELECT min(s.root_name) FROM s WHERE s.name = e.name)) AS set_root, name AS set_name FROM e WHERE name IN (SELECT name FROM s)""")
def b2_rule_sets(spark, sf_dir):
    r = ad.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("rule_id"), F.col("p_brand").alias("root_name"), F.array("p_type").alias("meanings"), F.concat_ws("_", F.lit("Part"), F.element_at(F.split("p_type", " "), -1), F.lit("Set")).alias("value_set_name"))
    return effects.rule_facts(r, size_sets(spark, sf_dir))[1]


@query(f"""WITH {ad.GRAPH_SQL}, b AS (SELECT DISTINCT callee_id AS node, caller_id AS caller FROM edges WHERE callee_id IS NOT NULL), f AS (SELECT node, count(*) > 200 AS hub FROM b GROUP BY 1), s AS (SELECT DISTINCT 'n' || s_nationkey AS sink FROM supplier),
h1 AS (SELECT DISTINCT sink, caller AS node FROM s JOIN b ON b.node = sink JOIN f ON f.node = sink WHERE NOT hub), h2 AS (SELECT DISTINCT sink, caller AS node FROM h1 JOIN b USING (node) JOIN f USING (node) WHERE NOT hub)
SELECT sink, node, 1 AS hops FROM h1 UNION ALL SELECT sink, node, 2 FROM h2""")
def g5_outbound_reach(spark, sf_dir):
    sinks = ad.table(spark, sf_dir, "supplier").select(F.concat(F.lit("n"), "s_nationkey").alias("sink")).distinct().withColumn("node", F.col("sink"))
    return effects.outbound_reach(sinks, ad.supply_graph(spark, sf_dir), 2, 200)


# Graph import, claims, assembled flows ------------------------------------------------------------------------------------------------


@query("""WITH n AS (SELECT doc_id, source || '/' || lang || '/' || doc_id || '.txt' AS fp, source, lang FROM documents), r AS (SELECT DISTINCT source AS prefix, 'big-' || source AS root FROM documents UNION SELECT DISTINCT source || '/fr', 'fr-' || source FROM documents)
SELECT doc_id AS id, CASE WHEN lang = 'fr' THEN 'fr-' || source ELSE 'big-' || source END AS root_name, CASE WHEN lang = 'fr' THEN doc_id || '.txt' ELSE lang || '/' || doc_id || '.txt' END AS rel_path FROM n""")
def s4_owned_nodes(spark, sf_dir):
    d = ad.table(spark, sf_dir, "documents")
    nodes = d.select(F.col("doc_id").alias("id"), F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id"), F.lit(".txt"))).alias("file_path"))
    s = d.select("source").distinct()
    roots = s.select(F.col("source").alias("prefix"), F.concat(F.lit("big-"), "source").alias("root_name")).union(s.select(F.concat("source", F.lit("/fr")), F.concat(F.lit("fr-"), "source")))
    return code_graph.owned_nodes(nodes, roots).select("id", "root_name", "rel_path")


@query(f"""WITH {ad.GRAPH_SQL}, n AS (SELECT DISTINCT caller_id AS id FROM edges WHERE caller_id NOT LIKE 's%') SELECT substr(caller_id, 1, 1) AS kind, count(*) AS edges, count(callee_id) AS resolved, count(*) FILTER (caller_id NOT IN (SELECT id FROM n) OR (callee_id IS NOT NULL AND callee_id NOT IN (SELECT id FROM n))) AS dangling FROM edges GROUP BY 1""")
def s5_import_report(spark, sf_dir):
    e = ad.supply_graph(spark, sf_dir).select(F.col("caller_id").alias("from_id"), F.col("callee_id").alias("to_id"), F.substring("caller_id", 1, 1).alias("kind"))
    return code_graph.import_edges_report(e, e.where("from_id not like 's%'").select(F.col("from_id").alias("id")).distinct())


@query("""WITH d AS (SELECT DISTINCT conv_id AS report_id, turn AS section, role || '|' || (turn % 5) AS identity FROM conversations), c AS (SELECT DISTINCT conv_id AS report_id, turn AS section, role || '|' || (turn % 3) AS identity FROM conversations)
SELECT *, 'declared-id-unknown' AS finding FROM d WHERE identity NOT IN ('user|0', 'assistant|1', 'user|2') UNION ALL SELECT *, 'declared-not-cited' FROM (SELECT * FROM d EXCEPT SELECT * FROM c) UNION ALL SELECT *, 'cited-not-declared' FROM (SELECT * FROM c EXCEPT SELECT * FROM d)""")
def q8_claims(spark, sf_dir):
    stated = lambda n: ad.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("report_id"), F.col("turn").alias("section"), F.concat_ws("|", "role", F.col("turn") % n).alias("identity"))
    known = spark.createDataFrame([("user|0",), ("assistant|1",), ("user|2",)], "identity string")
    return audit.audit_claims(stated(5), stated(3), known)


@query("""WITH e AS (SELECT conv_id AS report_id, 'item' || turn AS item, CASE WHEN length(text) % 5 = 0 THEN 'odd' ELSE 'yes' END AS verdict, length(text) % 3 AS ev FROM conversations), q AS (SELECT DISTINCT 'item' || turn AS item FROM conversations WHERE turn < 3)
SELECT report_id, item, 'item-missing' AS finding FROM (SELECT DISTINCT report_id FROM e) CROSS JOIN q WHERE (report_id, item) NOT IN (SELECT (report_id, item) FROM e) UNION ALL SELECT report_id, item, 'unknown-verdict' FROM e WHERE verdict = 'odd'
UNION ALL SELECT report_id, item, 'no-evidence' FROM e WHERE ev = 0 UNION ALL SELECT DISTINCT report_id, item, 'unresolved-id' FROM e WHERE ev = 2""")
def q9_checklist(spark, sf_dir):
    n = F.length("text")
    ids = F.when(n % 3 == 0, F.array().cast("array<string>")).when(n % 3 == 1, F.array(F.lit("a"))).otherwise(F.array(F.lit("a"), F.lit("zz")))
    e = ad.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("report_id"), F.concat(F.lit("item"), "turn").alias("item"), F.when(n % 5 == 0, "odd").otherwise("yes").alias("verdict"), ids.alias("evidence"), "turn")
    return audit.audit_checklist(e, e.where("turn < 3").select("item"), ("yes", "no"), spark.createDataFrame([("a",)], "identity string"))


@query("""WITH m AS (SELECT p_brand AS report_id, p_type AS field, max(p_size) AS v FROM part GROUP BY ALL), b AS (SELECT p_type AS field, max(p_size) AS v FROM part WHERE p_size < 50 GROUP BY 1) SELECT report_id, field, m.v AS stated, b.v AS actual FROM m LEFT JOIN b USING (field) WHERE m.v IS DISTINCT FROM b.v""")
def q11_manifest(spark, sf_dir):
    p = ad.table(spark, sf_dir, "part")
    m = p.groupBy(F.col("p_brand").alias("report_id"), F.col("p_type").alias("field")).agg(F.max("p_size").alias("value"))
    return audit.manifest_disagreements(m, p.where("p_size < 50").groupBy(F.col("p_type").alias("field")).agg(F.max("p_size").alias("value")))


@query("""WITH f AS (SELECT o_custkey AS report_id, o_orderpriority AS code, o_orderkey AS detail FROM orders) SELECT report_id, bool_and(code = '1-URGENT') OVER (PARTITION BY report_id) AS passed, code, n, ex AS examples FROM (SELECT report_id, code, count(*) AS n, array_to_string((list(detail ORDER BY detail))[1:5], ',') AS ex FROM f GROUP BY ALL)""")
def q12_explain(spark, sf_dir):
    f = ad.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("report_id"), F.col("o_orderpriority").alias("code"), F.col("o_orderkey").alias("detail"))
    return audit.explain_audit(f, ("1-URGENT",)).withColumn("examples", F.array_join("examples", ","))


@query("""WITH t AS (SELECT o_custkey AS id, o_orderstatus, o_orderpriority FROM orders) SELECT id, 'id is not unique' AS reason FROM t GROUP BY 1 HAVING count(*) > 1 UNION ALL SELECT id, 'critical but not must-find' FROM t WHERE o_orderstatus = 'F' AND o_orderpriority >= '3' UNION ALL SELECT id, 'absence cannot be must-find' FROM t WHERE o_orderstatus = 'O' AND o_orderpriority < '3'""")
def v5_truth(spark, sf_dir):
    o = ad.table(spark, sf_dir, "orders")
    s = F.col("o_orderstatus")
    return audit.validate_truth(o.select(F.col("o_custkey").alias("id"), F.when(s == "F", "critical").alias("criticality"), (F.col("o_orderpriority") < "3").alias("must_find"), F.when(s == "O", "clean-absence").otherwise("present").alias("expected_status"), F.lit("c").alias("claim")))


@query("""WITH p AS (SELECT o_custkey AS f, l_orderkey, l_linenumber AS ord, l_partkey::VARCHAR AS label, CASE l_returnflag WHEN 'A' THEN 'service' WHEN 'R' THEN 'data' ELSE 'handler' END AS stage, l_linestatus = 'F' AS res FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
r AS (SELECT *, CASE stage WHEN 'handler' THEN 3 WHEN 'service' THEN 4 ELSE 6 END AS rank, row_number() OVER (PARTITION BY f, stage ORDER BY ord, label) AS k FROM p)
SELECT f AS flow_id, string_agg(CASE WHEN stage <> 'service' OR k <= 12 THEN label END, ',' ORDER BY rank, ord, label) AS steps, bool_or(NOT res) AS partial, count(*) FILTER (stage = 'service' AND k > 12) AS more FROM r GROUP BY 1""")
def d16_assemble_flows(spark, sf_dir):
    stage = F.when(F.col("l_returnflag") == "A", "service").when(F.col("l_returnflag") == "R", "data").otherwise("handler")
    li = ad.table(spark, sf_dir, "lineitem").join(ad.table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    p = li.select(F.col("o_custkey").alias("flow_id"), stage.alias("stage"), F.col("l_linenumber").alias("ord"), F.col("l_partkey").cast("string").alias("label"), (F.col("l_linestatus") == "F").alias("resolved"))
    return flows.assemble_flows(p).withColumn("steps", F.array_join("steps.label", ","))


@query("""SELECT (SELECT count(*) FROM orders) AS orders, (SELECT count(*) FROM part) AS parts, (SELECT count(*) FROM documents) AS docs""")
def d21_run_context(spark, sf_dir):
    return flows.run_context(orders=ad.table(spark, sf_dir, "orders"), parts=ad.table(spark, sf_dir, "part"), docs=ad.table(spark, sf_dir, "documents"))


@query(f"""WITH {ad.FILES_SQL} SELECT root_name, 'lang-' || string_split(rel_path, '/')[1] AS folder, count(*) AS members, false AS infrastructural, string_split(rel_path, '/')[1] = 'fr' AS declared, 'containment' || CASE WHEN string_split(rel_path, '/')[1] = 'fr' THEN ',declared' ELSE '' END || CASE WHEN count(*) >= 5 THEN ',size' ELSE '' END AS signals FROM files GROUP BY 1, 2, 5, string_split(rel_path, '/')[1]""")
def d6_components(spark, sf_dir):
    f = ad.docs_as_files(spark, sf_dir).select("root_name", F.concat(F.lit("lang-"), "rel_path").alias("rel_path"))
    return modules.form_components(f, f.select("root_name", F.lit("lang-fr").alias("name"))).withColumn("signals", F.array_join("signals", ","))


@query(f"""WITH {ad.ACCESS_SQL} SELECT DISTINCT root_name, entity FROM access WHERE entity NOT IN (SELECT 'part_' || p_partkey FROM part WHERE p_size > 5)""")
def j21_undescribed(spark, sf_dir):
    described = ad.table(spark, sf_dir, "part").where("p_size > 5").select(F.concat(F.lit("part_"), "p_partkey").alias("entity"))
    return link.undescribed(ad.lineitem_as_access(spark, sf_dir), described)


@query("""WITH s AS (SELECT p_partkey AS id, p_brand AS root, string_split(p_type, ' ')[-1] AS name, p_size % 6 AS folder FROM part), c AS (SELECT p_partkey AS r, p_brand AS root, p_size % 5 AS q, string_split(p_type, ' ')[-1] AS name FROM part),
m AS (SELECT r, count(*) AS n, min(id) AS id FROM c JOIN s ON s.root = c.root AND s.name = c.name AND s.folder = c.q GROUP BY 1)
SELECT r AS route_id, CASE n WHEN 1 THEN id END AS symbol_id, CASE WHEN n IS NULL THEN 'no symbol has a candidate''s name' WHEN n > 1 THEN n || ' symbols fit' END AS reason FROM c LEFT JOIN m USING (r)""")
def j3_resolve_handlers(spark, sf_dir):
    p = ad.table(spark, sf_dir, "part")
    name = F.element_at(F.split("p_type", " "), -1)
    r = p.select(F.col("p_partkey").alias("route_id"), F.col("p_brand").alias("root_name"), F.array(F.concat(F.lit("f"), F.col("p_size") % 5, F.lit("."), name)).alias("candidates"))
    s = p.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("root_name"), name.alias("name"), F.lit(None).cast("string").alias("qualified_name"), F.concat(F.lit("f"), F.col("p_size") % 6, F.lit("/x.go")).alias("rel_path"))
    return link.resolve_handlers(r, s)
