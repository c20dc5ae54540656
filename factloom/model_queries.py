"""Registered queries of constraints, truth, denominators, traces with origins, isolated collectors and the scoped base, over all documents and labels."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .operators import constraints, effects, flows, graphs, wiring
from .plans import adapters as ad
from .queries import query
from .sources import base, providers


def documents(spark, sf_dir) -> DataFrame:
    return ad.table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars", "text")


def text_of(*parts) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def number() -> Column:
    return F.col("doc_id")


MODEL_SQL = """f AS (SELECT doc_id AS i, (['decision', 'transition', 'state', 'business-rule', 'value-set', 'guard', 'condition', 'novelty'])[doc_id % 8 + 1] AS kind FROM documents),
rel AS (SELECT i AS a, i + 1 AS b, 'decision-branch' AS r, 'then' AS role FROM f WHERE i % 8 = 0 AND i % 3 > 0
  UNION ALL SELECT i, i + 1, 'transition-endpoint', 'to-state' FROM f WHERE i % 8 = 1 UNION ALL SELECT i, i + 9, 'transition-endpoint', 'from-state' FROM f WHERE i % 8 = 1 UNION ALL SELECT i, i + 17, 'transition-endpoint', 'from-state' FROM f WHERE i % 24 = 1
  UNION ALL SELECT i, i + 1, 'rule-valueset', '' FROM f WHERE i % 8 = 3 UNION ALL SELECT i, i - 1, 'rule-valueset', 'uses' FROM f WHERE i % 16 = 4 UNION ALL SELECT i, -1, 'guard-subject', 'constrains' FROM f WHERE i % 8 = 5
  UNION ALL SELECT i, i + 1, 'transition-endpoint', 'odd' FROM f WHERE i % 16 = 6),
e AS (SELECT a.*, fa.kind AS ka, fb.kind AS kb FROM rel a LEFT JOIN f fa ON fa.i = a.a LEFT JOIN f fb ON fb.i = a.b)"""


@query(f"""WITH {MODEL_SQL} SELECT DISTINCT i::VARCHAR AS fact_id, code FROM (
SELECT i, 'no-evidence' AS code FROM f WHERE i % 11 = 0 UNION ALL SELECT i, 'bad-provenance' FROM f WHERE i % 13 = 0 AND i % 11 > 0 UNION ALL SELECT i, 'unknown-kind' FROM f WHERE kind = 'novelty'
UNION ALL SELECT i, 'illegal-scope' FROM f WHERE i % 5 = 0 AND kind <> 'novelty' UNION ALL SELECT i, 'illegal-activation' FROM f WHERE i % 7 = 0 AND kind <> 'novelty' UNION ALL SELECT i, 'wrong-family' FROM f WHERE i % 17 = 0
UNION ALL SELECT b, 'to-unknown-fact' FROM e WHERE kb IS NULL AND r <> 'guard-subject' UNION ALL SELECT a, 'no-role' FROM e WHERE role = '' UNION ALL SELECT a, 'wrong-role' FROM e WHERE role = 'odd'
UNION ALL SELECT a, 'transition-endpoint from' FROM e WHERE r = 'transition-endpoint' AND ka <> 'transition' UNION ALL SELECT b, 'transition-endpoint to' FROM e WHERE r = 'transition-endpoint' AND (kb IS NULL OR kb <> 'state')
UNION ALL SELECT a, 'rule-valueset from' FROM e WHERE r = 'rule-valueset' AND ka <> 'business-rule' UNION ALL SELECT b, 'rule-valueset to' FROM e WHERE r = 'rule-valueset' AND (kb IS NULL OR kb <> 'value-set')
UNION ALL SELECT i, 'transition-states' FROM f WHERE i % 24 = 1 UNION ALL SELECT i, 'no-branch' FROM f WHERE i % 24 = 0 UNION ALL SELECT x.a, 'on-a-cycle' FROM e x JOIN e y ON x.a = y.b AND x.b = y.a WHERE x.r = 'rule-valueset' AND y.r = 'rule-valueset')""")
def v1_model_rules(spark, sf_dir):
    """A model in which every rule is broken somewhere."""
    d = documents(spark, sf_dir).select("doc_id")
    k = number() % 8
    kinds = F.array(*map(F.lit, ("decision", "transition", "state", "business-rule", "value-set", "guard", "condition", "novelty")))
    fact = F.struct(F.when(number() % 13 == 0, "declared").otherwise("inferred").alias("resolution_class"), F.lit("high").alias("confidence"), F.lit(None).cast("string").alias("unresolved_reason"), F.lit("a.go").alias("rel_path"))
    facts = d.select(
        number().cast("string").alias("fact_id"), F.when(number() % 17 == 0, "structural").otherwise("behavioral").alias("family"), F.get(kinds, k.cast("int")).alias("kind"), F.when(number() % 5 > 0, "symbol").alias("scope"), F.when(number() % 7 > 0, "always").otherwise("never").alias("activation"),
        F.when(number() % 11 > 0, F.array(fact)).otherwise(F.array().cast("array<struct<resolution_class:string,confidence:string,unresolved_reason:string,rel_path:string>>")).alias("evidence"),
    )
    rel = lambda where, step, kind, role: F.when(where, F.struct(F.lit(kind).alias("kind"), number().cast("string").alias("from_id"), (number() + step if step else F.lit(-1)).cast("string").alias("to_id"), F.lit(role).alias("role")))
    all_ = (
        rel((k == 0) & (number() % 3 > 0), 1, "decision-branch", "then"), rel(k == 1, 1, "transition-endpoint", "to-state"), rel(k == 1, 9, "transition-endpoint", "from-state"), rel(number() % 24 == 1, 17, "transition-endpoint", "from-state"), rel(k == 3, 1, "rule-valueset", ""),
        rel(number() % 16 == 4, -1, "rule-valueset", "uses"), rel(k == 5, 0, "guard-subject", "constrains"), rel(number() % 16 == 6, 1, "transition-endpoint", "odd"),
    )
    relations = d.select(F.explode(F.array_compact(F.array(*all_))).alias("r")).select("r.*")
    return constraints.validate_model(facts, relations).drop("quarantined")


@query("""WITH i AS (SELECT doc_id % 40 AS ledger, doc_id AS id, CASE WHEN doc_id % 40 < 30 THEN (['positive', 'negative', 'clean-absence'])[doc_id % 3 + 1] ELSE 'positive' END AS kind, doc_id % 7 = 0 AS critical, doc_id % 2 = 0 AS must, doc_id % 5 = 0 AS absent, doc_id % 40 < 20 AS bare FROM documents)
SELECT DISTINCT * FROM (SELECT ledger, id, 'critical-not-must-find' AS code FROM i WHERE critical AND NOT must UNION ALL SELECT ledger, id, 'clean-absence-expects-absent' FROM i WHERE kind = 'clean-absence' AND NOT absent UNION ALL SELECT ledger, id, 'evidence-without-path' FROM i WHERE id % 9 = 0
UNION ALL SELECT ledger, NULL, 'no-negative' FROM i GROUP BY 1 HAVING NOT bool_or(kind = 'negative') UNION ALL SELECT ledger, NULL, 'no-positive' FROM i GROUP BY 1 HAVING NOT bool_or(kind = 'positive') UNION ALL SELECT ledger, NULL, 'no-root-without-reader' FROM i GROUP BY 1 HAVING NOT bool_or(bare))""")
def v5_sentinels(spark, sf_dir):
    d, ledger = documents(spark, sf_dir), number() % 40
    kind = F.when(ledger < 30, F.get(F.array(F.lit("positive"), F.lit("negative"), F.lit("clean-absence")), (number() % 3).cast("int"))).otherwise("positive")
    items = d.select(
        ledger.alias("ledger"), number().alias("id"), kind.alias("kind"), F.when(number() % 5 == 0, "absent").otherwise("present").alias("expected_status"), F.when(number() % 7 == 0, "critical").otherwise("minor").alias("criticality"), (number() % 2 == 0).alias("must_find"), F.lit("a wrong count").alias("prevents"),
        (ledger < 20).alias("no_dedicated_reader"), F.array(F.when(number() % 9 == 0, "").otherwise("a.go")).alias("evidence"),
    )
    return constraints.validate_sentinels(items)


GRADE_SQL = """lanes AS (SELECT * FROM (VALUES ('rule', ['business-rule', 'condition']), ('validation', ['validation-rule']), ('test-relation', ['test-relation']), ('integration', ['outbound-call'])) t(category, kinds)),
facts AS (SELECT (['business-rule', 'condition', 'validation-rule', 'test-relation', 'outbound-call', 'state'])[doc_id % 6 + 1] AS kind, 'f' || (doc_id % 100) || '/' || (doc_id % 3) || '/' || doc_id || '.go' AS p FROM documents),
items AS (SELECT doc_id AS id, (['rule', 'validation', 'test-relation', 'role', 'nothing', 'integration'])[doc_id % 6 + 1] AS category, quality = 0 AS absent, toxic = 1 AS must,
  CASE doc_id % 4 WHEN 0 THEN 'f' || (doc_id % 100) || '/' WHEN 1 THEN 'f' || (doc_id % 100) || '/' || (doc_id % 3) WHEN 2 THEN 'f' || (doc_id % 100) || '/' || (doc_id % 3) || '/' || doc_id || '.go' ELSE 'f' || doc_id END AS cited, doc_id % 10 = 9 AS elsewhere FROM labels),
folders AS (SELECT DISTINCT kind, k FROM (SELECT kind, p AS k FROM facts UNION ALL SELECT kind, string_split(p, '/')[1] || '/' FROM facts UNION ALL SELECT kind, string_split(p, '/')[1] || '/' || string_split(p, '/')[2] || '/' FROM facts)),
g AS (SELECT i.*, kinds, EXISTS (SELECT 1 FROM folders x WHERE (x.k = i.cited OR x.k = rtrim(i.cited, '/') || '/') AND (list_contains(kinds, x.kind) OR (kinds IS NULL AND absent))) AS hit FROM items i LEFT JOIN lanes USING (category)),
graded AS (SELECT id, category, must, CASE WHEN category = 'role' THEN 'unsupported' WHEN elsewhere THEN 'unresolved' WHEN absent THEN CASE WHEN NOT hit AND category <> 'test-relation' THEN 'found' ELSE 'not-found' END WHEN kinds IS NULL THEN 'unsupported' WHEN hit THEN 'found' ELSE 'not-found' END AS status FROM g)"""


def graded(spark, sf_dir):
    kinds = F.array(*map(F.lit, ("business-rule", "condition", "validation-rule", "test-relation", "outbound-call", "state")))
    path = text_of("f", number() % 100, "/", number() % 3, "/", number(), ".go")
    facts = documents(spark, sf_dir).select(F.get(kinds, (number() % 6).cast("int")).alias("kind"), F.lit("r").alias("root_name"), path.alias("rel_path"))
    categories = F.array(*map(F.lit, ("rule", "validation", "test-relation", "role", "nothing", "integration")))
    cited = F.when(number() % 4 == 0, text_of("f", number() % 100, "/")).when(number() % 4 == 1, text_of("f", number() % 100, "/", number() % 3)).when(number() % 4 == 2, path).otherwise(text_of("f", number()))
    truth = ad.table(spark, sf_dir, "labels").select(
        number().alias("id"), F.get(categories, (number() % 6).cast("int")).alias("category"), F.when(number() % 8 == 0, "critical").otherwise("minor").alias("criticality"), (F.col("toxic") == 1).alias("must_find"), F.when(F.col("quality") == 0, "absent").otherwise("present").alias("expects"),
        F.array(F.struct(F.when(number() % 10 == 9, "other").otherwise("r").alias("root_name"), cited.alias("path"))).alias("evidence"),
    )
    return constraints.grade_truth(truth, facts, "r")


@query(f"WITH {GRADE_SQL} SELECT id, category, status FROM graded")
def d29_grade_truth(spark, sf_dir):
    """Files, folders with and without a slash, folders that only begin alike, another root, categories of no lane, absence without a reader."""
    return graded(spark, sf_dir).select("id", "category", "status")


@query(f"""WITH {GRADE_SQL} SELECT count(*) AS total, count(*) FILTER (status = 'found') AS found, count(*) FILTER (status = 'not-found') AS not_found, count(*) FILTER (status = 'unresolved') AS unresolved, count(*) FILTER (status = 'unsupported') AS unsupported,
count(*) FILTER (must AND status IN ('found', 'not-found')) AS must_find_total, count(*) FILTER (must AND status = 'found') AS must_find_found, count(*) FILTER (id % 8 = 0 AND status = 'not-found') AS critical_issues, count(*) FILTER (status IN ('found', 'not-found')) AS denominator,
count(*) FILTER (must AND status = 'not-found') = 0 AND count(*) FILTER (id % 8 = 0 AND status = 'not-found') = 0 AS passed FROM graded""")
def d29_gate(spark, sf_dir):
    return constraints.truth_gate(graded(spark, sf_dir))


@query("""WITH p AS (SELECT CASE doc_id % 4 WHEN 0 THEN '{"a":[' || array_to_string(list_transform(range(doc_id % 9), lambda x: x::VARCHAR), ',') || '],"n":' || (doc_id % 50) || ',"s":"' || (doc_id % 7) || ' of ' || (doc_id % 30) || ',000","x":2.5,"neg":-1,"w":' || (doc_id % 5) || '.0,"o":{"k":[1]}}'
  WHEN 1 THEN '[' || doc_id || ',[1,2,3]]' WHEN 2 THEN 'broken [1,2] 3/' || (doc_id % 1000) ELSE '"text"' END AS payload FROM documents WHERE doc_id % 10 > 0),
v AS (SELECT j.type, j.value FROM p, json_each(CASE WHEN json_valid(payload) AND json_type(payload) IN ('OBJECT', 'ARRAY') THEN payload ELSE '{}' END) j)
SELECT DISTINCT value, basis FROM (SELECT json_array_length(value)::BIGINT AS value, 'list' AS basis FROM v WHERE type = 'ARRAY' UNION ALL SELECT value::DOUBLE::BIGINT, 'number' FROM v WHERE type IN ('UBIGINT', 'BIGINT', 'DOUBLE') AND value::DOUBLE = floor(value::DOUBLE)
UNION ALL SELECT replace(m, ',', '')::BIGINT, 'share' FROM (SELECT unnest(regexp_extract_all(payload, '(\\d[\\d,]*)\\s*(?:/|of)\\s*(\\d[\\d,]*)', 2)) AS m FROM p)) WHERE value > 0""")
def d27_payload_quantities(spark, sf_dir):
    """Payloads of any shape: objects, arrays, texts, and no JSON at all; a tenth are of a kind that does not count."""
    k, numbers = number() % 4, F.transform(F.sequence(F.lit(0), (number() % 9).cast("int")), lambda x: x.cast("string"))
    lists = F.array_join(F.slice(numbers, F.lit(1), (number() % 9).cast("int")), ",")
    one = text_of('{"a":[', lists, '],"n":', number() % 50, ',"s":"', number() % 7, " of ", number() % 30, ',000","x":2.5,"neg":-1,"w":', number() % 5, '.0,"o":{"k":[1]}}')
    payload = F.when(k == 0, one).when(k == 1, text_of("[", number(), ",[1,2,3]]")).when(k == 2, text_of("broken [1,2] 3/", number() % 1000)).otherwise('"text"')
    return constraints.payload_quantities(documents(spark, sf_dir).select(F.when(number() % 10 > 0, "feature").otherwise("note").alias("kind"), payload.alias("payload")))


@query("""WITH f AS (SELECT source AS r, lang AS d, concat_ws('/', lang, doc_id % 1000) AS p FROM documents), t AS (SELECT source AS kind FROM documents)
SELECT DISTINCT value, basis FROM (SELECT count(*) AS value, 'files' AS basis FROM f GROUP BY CUBE (r, d) UNION ALL SELECT count(DISTINCT p), 'paths' FROM f UNION ALL SELECT count(*), 'evidence_items' FROM t GROUP BY ROLLUP (kind))""")
def d27_all_denominators(spark, sf_dir):
    d = documents(spark, sf_dir)
    files = d.select(F.col("source").alias("root_name"), F.col("lang").alias("disposition"), F.concat_ws("/", "lang", (number() % 1000).cast("string")).alias("rel_path"))
    return constraints.all_denominators(files, {"evidence_items": d.select(F.col("source").alias("kind"))})


@query("""WITH d AS (SELECT doc_id, doc_id // 10 AS b, lang FROM documents), l AS (SELECT b, lang, min(doc_id) AS line FROM d WHERE lang IS NOT NULL GROUP BY ALL), open AS (SELECT DISTINCT b FROM d WHERE lang IS NULL)
SELECT 'd' || doc_id AS entry_id, node, depth, origin, edge_kind, line, CASE WHEN open.b IS NULL THEN 'completed' ELSE 'unresolved-edge' END AS truncation FROM (
  SELECT doc_id, b, 'd' || doc_id AS node, 0 AS depth, NULL AS origin, NULL AS edge_kind, NULL::BIGINT AS line FROM d UNION ALL SELECT doc_id, b, 'b' || b, 1, 'd' || doc_id, 'call', doc_id FROM d
  UNION ALL SELECT doc_id, d.b, 'l' || l.lang, 2, 'b' || d.b, 'type', l.line FROM d JOIN l USING (b)) x LEFT JOIN open ON open.b = x.b""")
def g3_entry_steps(spark, sf_dir):
    """Each document calls its batch, whose types are the languages of its documents, the first edge to each counts; documents without one leave an edge open."""
    return trace_tables(spark, sf_dir)[0].select("entry_id", "node", "depth", "origin", "edge_kind", "line", "truncation")


def trace_tables(spark, sf_dir):
    d = documents(spark, sf_dir).select("doc_id", F.floor(number() / 10).alias("b"), "lang")
    edge = lambda a, b, kind: d.select(a.alias("caller_id"), b.alias("callee_id"), number().alias("edge_ord"), F.lit(kind).alias("edge_kind"), F.lit("resolved").alias("resolution"), F.lit("a.go").alias("rel_path"), number().alias("line"))
    doc, batch, lang = text_of("d", number()), text_of("b", F.col("b")), text_of("l", F.col("lang"))
    edges = edge(doc, batch, "call").unionByName(edge(batch, lang, "type"))
    symbols = d.select(F.explode(F.array_compact(F.array(doc, batch, lang))).alias("id"))
    entries = d.select(doc.alias("entry_id"), doc.alias("node"), F.when(number() % 2 == 0, "precise").otherwise("candidate").alias("class"))
    return graphs.entry_traces(entries, symbols, edges, max_depth=3, max_branches=10)


@query("""SELECT count(*) AS total, count(*) FILTER (doc_id % 2 = 0) AS precise, count(*) FILTER (doc_id % 2 = 1) AS candidate, 0::BIGINT AS structure_root, count(*) AS reachable, 1.0::DOUBLE AS rate FROM documents""")
def g3_traceability(spark, sf_dir):
    return trace_tables(spark, sf_dir)[1]


def count_words(file: dict):
    """A collector that stops at files of no language."""
    if file["lang"] is None:
        raise LookupError("no reader for " + file["rel_path"])
    yield {"name": "words", "n": len([w for w in (file["content"] or "").split(" ") if w])}


def first_letters(file: dict):
    """A collector whose rows do not fit for every seventh file, after one that does."""
    yield {"name": (file["content"] or "")[:1], "n": 1}
    if int(file["rel_path"]) % 7 == 0:
        yield {"name": "odd", "n": "many"}


COLLECTED = StructType([StructField("name", StringType()), StructField("n", LongType())])


@query("""SELECT doc_id::VARCHAR AS rel_path, 'words' AS collector, 'words' AS name, len(list_filter(string_split(coalesce(text, ''), ' '), lambda w: w <> ''))::BIGINT AS n, NULL AS fault FROM documents WHERE lang IS NOT NULL
UNION ALL SELECT doc_id::VARCHAR, 'words', NULL, NULL, 'LookupError' FROM documents WHERE lang IS NULL UNION ALL SELECT doc_id::VARCHAR, 'letters', substr(coalesce(text, ''), 1, 1), 1, NULL FROM documents WHERE doc_id % 7 > 0
UNION ALL SELECT doc_id::VARCHAR, 'letters', NULL, NULL, 'ArrowInvalid' FROM documents WHERE doc_id % 7 = 0""")
def x13_isolated_collectors(spark, sf_dir):
    """One collector fails on files of no language, the other on every seventh; neither takes rows of the other or of other files along."""
    files = documents(spark, sf_dir).select(F.lit("r").alias("root_name"), number().cast("string").alias("rel_path"), F.col("text").alias("content"), "lang")
    ran = providers.run_isolated(files, {"words": count_words, "letters": first_letters}, COLLECTED)
    return ran.select("rel_path", "collector", "row.name", "row.n", F.regexp_extract("reason", "^[A-Za-z]+", 0).alias("fault"))


@query("""SELECT source, count(*) AS files, sum(n_chars)::BIGINT AS chars, 1::BIGINT AS logged FROM documents WHERE source IS NOT NULL GROUP BY 1""")
def s15_transitive_scope(spark, sf_dir):
    """Files and their sizes have no snapshot: they take that of their roots, two foreign keys away; a second snapshot has other roots."""
    folder = f"{graphs.shared_folder(spark)}/base-{uuid.uuid4().hex}"
    d = documents(spark, sf_dir)
    roots = d.where("source is not null").select("source").distinct()
    roots.select(F.explode(F.array(F.struct(F.lit("one").alias("snapshot_id"), F.col("source").alias("root_id")), F.struct(F.lit("two").alias("snapshot_id"), F.concat(F.lit("old-"), "source").alias("root_id")))).alias("r")).select("r.*").write.parquet(f"{folder}/source_roots")
    files = d.where("source is not null").select(F.explode(F.array("source", F.concat(F.lit("old-"), "source"))).alias("root_id"), "doc_id", "n_chars")
    files.select("root_id", F.concat_ws(":", "root_id", "doc_id").alias("file_id")).write.parquet(f"{folder}/files")
    files.select(F.concat_ws(":", "root_id", "doc_id").alias("file_id"), "n_chars").write.parquet(f"{folder}/sizes")
    text = "SELECT root_id AS source, count(*) AS files, sum(n_chars) AS chars FROM files JOIN sizes USING (file_id) GROUP BY root_id"
    out = base.kb_sql(spark, folder, "one", text, ("source_roots",), {"sizes": ("files", "file_id"), "files": ("source_roots", "root_id")}, log="query_log")
    log = spark.read.parquet(f"{folder}/query_log").where(F.col("query") == text).agg(F.count("*").alias("logged"))
    return out.crossJoin(F.broadcast(log))


@query("""WITH l AS (SELECT DISTINCT source AS from_id, lang AS to_id, CASE n_chars % 2 WHEN 0 THEN 'owns' ELSE 'uses' END AS role FROM documents) SELECT *, (SELECT count(*) FROM l) - (SELECT count(*) FROM l WHERE role = 'owns') AS added FROM l""")
def s8_links(spark, sf_dir):
    """Links written in part, then all twice: only what is missing is added, and the other snapshot's are not counted."""
    folder = f"{graphs.shared_folder(spark)}/base-{uuid.uuid4().hex}"
    links = documents(spark, sf_dir).select(F.col("source").alias("from_id"), F.col("lang").alias("to_id"), F.when(F.col("n_chars") % 2 == 0, "owns").otherwise("uses").alias("role"))
    base.write_links(links.where("role = 'owns'"), folder, "s")
    base.write_links(links.where("role = 'uses'"), folder, "other")
    added = base.write_links(links, folder, "s") + base.write_links(links, folder, "s")
    return spark.read.parquet(f"{folder}/ownership_links").where("snapshot_id = 's'").select("from_id", "to_id", "role", F.lit(added).cast("long").alias("added"))


@query("""WITH s AS (SELECT doc_id % 97 AS f, doc_id % 97 AS m, doc_id, n_chars FROM documents), g AS (SELECT f, count(*) FILTER (m % 4 > 0) AS observed, count(*) FILTER (m % 4 = 2 OR (m % 4 = 3 AND n_chars % 5 = 0)) AS direct, (list(DISTINCT 't' || lpad((n_chars % 20)::VARCHAR, 2, '0') ORDER BY 't' || lpad((n_chars % 20)::VARCHAR, 2, '0')) FILTER (m % 4 > 0))[1:5] AS tables FROM s GROUP BY 1)
SELECT f AS feature_id, CASE WHEN observed = 0 THEN 'feature-without-observed-storage' ELSE 'storage-observed-only-nearby' END AS code, coalesce(array_to_string(tables, ','), '') AS evidence, 'info' AS severity FROM g WHERE observed = 0 OR direct = 0""")
def d11_storage_findings(spark, sf_dir):
    """Features whose accesses are all unresolved, all nearby, all in handlers, or of both kinds."""
    m = number() % 97
    steps = documents(spark, sf_dir).select(
        m.alias("feature_id"), F.col("doc_id").alias("flow_id"), F.lit("data-access").alias("kind"), F.concat(F.lit("t"), F.lpad((F.col("n_chars") % 20).cast("string"), 2, "0")).alias("entity"),
        ((m % 4 == 1) | ((m % 4 == 3) & (F.col("n_chars") % 5 > 0))).alias("indirect"), F.when(m % 4 == 0, "built at run time").alias("unresolved_reason"),
    )
    return flows.storage_findings(steps).withColumn("evidence", F.array_join("evidence", ","))


@query("""WITH e AS (
SELECT 'behavioral|data-access|supplier-' || l_suppkey || '|o' || l_orderkey || ':' || l_linenumber || ':?|write|orm|' || CASE WHEN l_returnflag = 'N' THEN '' ELSE 'part_' || l_partkey END AS fact_id, 'data-access' AS kind,
  CASE WHEN l_returnflag = 'A' THEN NULL ELSE 'f' || l_partkey END AS symbol_id, NULL AS category, CASE WHEN l_returnflag <> 'N' THEN 'part_' || l_partkey END AS target, 'write' AS detail, CASE WHEN l_returnflag = 'N' THEN 'unresolved' ELSE 'resolved' END AS link FROM lineitem
UNION ALL SELECT 'behavioral|transaction-boundary|orders|c' || o_custkey || ':' || o_orderkey || ':1|' || o_orderstatus || '|' || o_orderpriority, 'transaction-boundary', NULL, NULL, o_orderstatus, o_orderpriority, NULL FROM orders
UNION ALL SELECT 'behavioral|outbound-call|crawler|a.ts:' || page_id || ':?|service|http|GET|' || url, 'outbound-call', NULL, 'service', CASE WHEN page_id % 3 > 0 THEN url END, url, CASE WHEN page_id % 3 > 0 THEN 'resolved' ELSE 'unresolved' END FROM pages
UNION ALL SELECT 'behavioral|outbound-call|' || p_brand || '|' || p_type || ':' || p_size || ':?|external-package|' || p_type || '|' || CASE WHEN p_size % 2 > 0 THEN 'm' || p_size ELSE '' END, 'outbound-call', 'f' || p_partkey, 'external-package', p_type || CASE WHEN p_size % 2 > 0 THEN '.m' || p_size ELSE '' END, p_type, 'resolved' FROM part
UNION ALL SELECT 'behavioral|notification-call|' || event_type || '|u' || user_id || ':' || event_id % 7 || ':?|' || event_type || '|mail', 'notification-call', NULL, NULL, 'mail', event_type, NULL FROM events)
SELECT fact_id, kind, CASE WHEN min(symbol_id) IS NULL THEN 'module' ELSE 'symbol' END AS scope, min(symbol_id) AS symbol_id, category, target, detail, link FROM e GROUP BY fact_id, kind, category, target, detail, link""")
def b7_located_effects(spark, sf_dir):
    """Data access of all lines, transactions of all orders, calls of all pages, packages of all parts and notifications of all events."""
    t, place = lambda n: ad.table(spark, sf_dir, n), lambda root, path, line, column=None: [c.alias(n) for c, n in ((root, "root_name"), (path, "rel_path"), (line, "start_line"), (F.lit(column).cast("int"), "start_column"))]
    part, none = text_of("part_", F.col("l_partkey")), F.lit(None).cast("string")
    access = t("lineitem").select(
        *place(text_of("supplier-", F.col("l_suppkey")), text_of("o", F.col("l_orderkey")), F.col("l_linenumber")), F.when(F.col("l_returnflag") != "A", text_of("f", F.col("l_partkey"))).alias("symbol_id"), F.when(F.col("l_returnflag") != "N", part).alias("entity"),
        F.lit("write").alias("operation"), F.lit("orm").alias("mechanism"),
    )
    transactions = t("orders").select(*place(F.lit("orders"), text_of("c", F.col("o_custkey")), F.col("o_orderkey"), 1), none.alias("symbol_id"), F.col("o_orderstatus").alias("mechanism"), F.col("o_orderpriority").alias("propagation"))
    calls = t("pages").select(*place(F.lit("crawler"), F.lit("a.ts"), F.col("page_id")), none.alias("symbol_id"), F.lit("http").alias("outbound_kind"), F.lit("GET").alias("method"), F.when(F.col("page_id") % 3 > 0, F.col("url")).alias("target"), F.col("url").alias("base_identifier"))
    packages = t("part").select(*place(F.col("p_brand"), F.col("p_type"), F.col("p_size")), text_of("f", F.col("p_partkey")).alias("symbol_id"), F.col("p_type").alias("package_name"), F.when(F.col("p_size") % 2 > 0, text_of("m", F.col("p_size"))).alias("member_name"))
    notes = t("events").select(*place(F.col("event_type"), text_of("u", F.col("user_id")), F.col("event_id") % 7), F.col("event_type").alias("channel"), F.lit("mail").alias("mechanism"))
    return effects.located_effects(access, transactions, calls, packages, notes)


@query("""WITH e AS (SELECT l_orderkey AS root_name, l_partkey, bool_or(l_returnflag = 'N') AS d FROM lineitem GROUP BY 1, 2), g AS (SELECT root_name, count(*) FILTER (d) AS described, count(*) FILTER (NOT d) AS undescribed FROM e GROUP BY 1)
SELECT root_name, CASE WHEN described = 0 THEN 'nothing-described' ELSE 'further-entities-used' END AS note, described, CASE WHEN described = 0 THEN 0 ELSE undescribed END AS undescribed FROM g WHERE described = 0 OR undescribed > 0""")
def d19_data_coverage(spark, sf_dir):
    """Each order is a root that uses the parts of all its lines and describes those that were not returned."""
    lines = ad.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("root_name"), F.col("l_partkey").alias("entity"), "l_returnflag")
    return flows.data_coverage_notes(lines.select("root_name", F.when(F.col("l_returnflag") == "N", F.col("entity")).alias("entity")), lines.select("root_name", "entity"), ("root_name",))


STATUS_SQL = """s AS (SELECT o_custkey AS workspace, o_orderkey AS snapshot_id, o_orderdate AS published_at FROM orders WHERE o_orderstatus <> 'P'), latest AS (SELECT workspace, arg_max(snapshot_id, (published_at, snapshot_id)) AS snapshot_id FROM s GROUP BY 1)"""


def order_status(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Customers are workspaces, their orders snapshots, the suppliers of an order its roots with the lines as files and with a check of each line number."""
    o, li, c = (ad.table(spark, sf_dir, n) for n in ("orders", "lineitem", "customer"))
    snapshots = o.select(F.col("o_custkey").alias("workspace"), F.col("o_orderkey").alias("snapshot_id"), F.lit("run").alias("run_id"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate")).alias("published_at"))
    files = li.select(F.col("l_orderkey").alias("snapshot_id"), F.col("l_suppkey").alias("root_name"), F.col("l_returnflag").alias("disposition"))
    roots = files.select("snapshot_id", "root_name").distinct().select("*", F.lit("main").alias("branch"), (F.col("root_name") % 2 == 0).alias("dirty"))
    checks = li.select(F.col("l_orderkey").alias("snapshot_id"), F.col("l_linenumber").alias("provider_id"), F.lit("1").alias("version"), (F.col("l_linenumber") % 3 > 0).alias("available"), F.when(F.col("l_linenumber") % 3 == 0, "not installed").alias("reason")).distinct()
    return flows.status_report(c.select(F.col("c_custkey").alias("workspace")), snapshots, roots, files, checks)


@query(f"""WITH {STATUS_SQL} SELECT c_custkey AS workspace, l.snapshot_id IS NOT NULL AS analyzed, l.snapshot_id FROM customer LEFT JOIN latest l ON l.workspace = c_custkey""")
def d23_reports(spark, sf_dir):
    return order_status(spark, sf_dir)[0].select("workspace", "analyzed", "snapshot_id")


@query(f"""WITH {STATUS_SQL}, n AS (SELECT l_orderkey, l_suppkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT l.workspace, l.snapshot_id, l_suppkey AS root_name, l_suppkey % 2 = 0 AS dirty, string_agg(l_returnflag || '=' || n.n, ',' ORDER BY l_returnflag) AS counts FROM latest l JOIN n ON l_orderkey = l.snapshot_id WHERE l.workspace IN (SELECT c_custkey FROM customer) GROUP BY ALL""")
def d23_root_counts(spark, sf_dir):
    counts = F.transform(F.array_sort(F.map_entries("counts")), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return order_status(spark, sf_dir)[1].select("workspace", "snapshot_id", "root_name", "dirty", F.array_join(counts, ",").alias("counts"))


@query(f"""WITH {STATUS_SQL} SELECT DISTINCT l.workspace, l.snapshot_id, l_linenumber AS provider_id, l_linenumber % 3 > 0 AS available, CASE WHEN l_linenumber % 3 = 0 THEN 'not installed' END AS reason FROM latest l JOIN lineitem ON l_orderkey = l.snapshot_id WHERE l.workspace IN (SELECT c_custkey FROM customer)""")
def d23_provider_checks(spark, sf_dir):
    return order_status(spark, sf_dir)[2].select("workspace", "snapshot_id", "provider_id", "available", "reason")


@query("""WITH c AS (SELECT source, 'service-' || n_chars % 7 AS target, count(*) AS n FROM documents WHERE doc_id % 5 > 0 GROUP BY 1, 2), m AS (SELECT DISTINCT lang AS module_id, source FROM documents)
SELECT module_id, target, sum(n)::BIGINT AS n FROM m JOIN c USING (source) GROUP BY 1, 2""")
def j27_d20_module_targets(spark, sf_dir):
    """Each document is a file with a call, every fifth one generated; languages are modules of the sources that they are written in."""
    d = documents(spark, sf_dir).select(F.col("source").alias("root_name"), number().cast("string").alias("rel_path"), F.lit(1).alias("start_line"), text_of("service-", F.col("n_chars") % 7).alias("target"), F.when(number() % 5 == 0, "generated").otherwise("source").alias("classification"), F.col("lang").alias("module_id"))
    return wiring.module_targets(d, d, d)
