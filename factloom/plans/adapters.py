"""The driver's tables as fact records: plain projections, so that SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import host_of, path_of, segments, trim_slashes


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pages_as_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outbound calls of one crawler: each page's URL is a target, its host the base."""
    p = table(spark, sf_dir, "pages")
    return p.select(F.col("page_id").alias("call_id"), F.lit("crawler").alias("root_name"), F.col("url").alias("target"), F.lit(None).cast("string").alias("method"), host_of(F.col("url")).alias("base_identifier"))


def pages_as_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes of the hosts whose least page is even: every tenth page literally, the others as /section/:id."""
    p = table(spark, sf_dir, "pages").select("page_id", host_of(F.col("url")).alias("root_name"), trim_slashes(path_of(F.col("url"))).alias("path"))
    even = p.groupBy("root_name").agg(F.min("page_id").alias("least")).where("least % 2 = 0")
    pattern = F.when(F.col("page_id") % 10 == 0, F.col("path")).otherwise(F.concat(F.lit("/"), F.try_element_at(segments(F.col("path")), F.lit(2)), F.lit("/:id")))
    return p.join(even, "root_name").select("root_name", F.lit(None).cast("string").alias("method"), pattern.alias("path")).distinct()


ROUTES_SQL = r"""
p AS (SELECT page_id, url, regexp_extract(url, '^[a-zA-Z][A-Za-z0-9_+.-]*://([^/?#]*)', 1) AS host,
      coalesce(nullif(regexp_replace(regexp_extract(url, '^[a-zA-Z][A-Za-z0-9_+.-]*://[^/]*(/[^?#]*)?', 1), '/+$', ''), ''), '/') AS path FROM pages),
routes AS (SELECT DISTINCT host AS root_name, CASE WHEN page_id % 10 = 0 THEN path ELSE '/' || string_split(path, '/')[2] || '/:id' END AS path
           FROM p WHERE host IN (SELECT host FROM p GROUP BY host HAVING min(page_id) % 2 = 0))
"""


def docs_as_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("source").alias("root_name"), F.concat_ws("/", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("rel_path"), F.col("n_chars").alias("size_bytes"), F.col("text").alias("content"))


FILES_SQL = "files AS (SELECT source AS root_name, concat_ws('/', lang, doc_id || '.txt') AS rel_path, n_chars AS size_bytes, text AS content FROM documents)"


def lineitem_as_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers reading and writing parts: R writes, A reads, N unknown."""
    op = F.when(F.col("l_returnflag") == "R", "write").when(F.col("l_returnflag") == "A", "read").otherwise("unknown")
    return table(spark, sf_dir, "lineitem").select(F.concat(F.lit("supplier-"), F.col("l_suppkey")).alias("root_name"), F.concat(F.lit("part_"), F.col("l_partkey")).alias("entity"), op.alias("operation"))


ACCESS_SQL = "access AS (SELECT 'supplier-' || l_suppkey AS root_name, 'part_' || l_partkey AS entity, CASE l_returnflag WHEN 'R' THEN 'write' WHEN 'A' THEN 'read' ELSE 'unknown' END AS operation FROM lineitem)"


def orders_as_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two providers on each order's total, in cents: the header declares it, the lines' sum infers it."""
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    payload = lambda total, status: F.create_map(F.lit("total"), total.cast("string"), F.lit("status"), status)
    head = o.select(F.col("o_orderkey").cast("string").alias("key"), F.lit("header").alias("provider_id"), F.lit("declared").alias("resolution_class"), payload(F.round(F.col("o_totalprice")).cast("long"), F.col("o_orderstatus")).alias("payload"))
    lines = li.groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("s"), F.max("l_linestatus").alias("st"))
    lines = lines.select(F.col("l_orderkey").cast("string").alias("key"), F.lit("lines").alias("provider_id"), F.lit("inferred").alias("resolution_class"), payload(F.round("s").cast("long"), F.col("st")).alias("payload"))
    return head.unionByName(lines).withColumn("kind", F.lit("order"))


CONTRIBUTIONS_SQL = """
head AS (SELECT o_orderkey::VARCHAR AS key, round(o_totalprice)::BIGINT::VARCHAR AS total, o_orderstatus AS status FROM orders),
lines AS (SELECT l_orderkey::VARCHAR AS key, round(sum(l_extendedprice::DECIMAL(18,2)))::BIGINT::VARCHAR AS total, max(l_linestatus) AS status FROM lineitem GROUP BY 1)
"""


def events_as_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts at a minute of a user's time line."""
    line = F.expr("timestampdiff(MINUTE, timestamp_ntz'1970-01-01 00:00:00', ts)")
    return table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("user-"), F.col("user_id")).alias("root_name"), F.lit("events").alias("rel_path"), line.alias("line"))


def events_as_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols: each user's days, nested in weeks; days with an even number only, so that some facts fall into the week alone."""
    day = F.expr("timestampdiff(DAY, timestamp_ntz'1970-01-01 00:00:00', ts)")
    e = table(spark, sf_dir, "events").select(F.concat(F.lit("user-"), F.col("user_id")).alias("root_name"), day.alias("d")).distinct()
    span = lambda kind, n, days: F.struct(F.concat(F.lit(kind), n).alias("symbol_id"), (n * days * 1440).alias("start_line"), (n * days * 1440 + days * 1440 - 1).alias("end_line"))
    both = e.select("root_name", F.explode(F.array(span("day-", F.when(F.col("d") % 2 == 0, F.col("d")), F.lit(1)), span("week-", F.floor(F.col("d") / 7), F.lit(7)))).alias("s"))
    return both.where("s.symbol_id is not null").select(F.concat_ws(":", "root_name", "s.symbol_id").alias("symbol_id"), "root_name", F.lit("events").alias("rel_path"), "s.start_line", "s.end_line").distinct()


POINTS_SQL = """
points AS (SELECT event_id, 'user-' || user_id AS root_name, floor(floor(epoch(ts)) / 60)::BIGINT AS line, floor(floor(epoch(ts)) / 86400)::BIGINT AS d FROM events),
ranges AS (SELECT DISTINCT root_name, root_name || ':day-' || d AS symbol_id, d * 1440 AS s, d * 1440 + 1439 AS e FROM points WHERE d % 2 = 0
           UNION SELECT DISTINCT root_name, root_name || ':week-' || (d // 7), (d // 7) * 10080, (d // 7) * 10080 + 10079 FROM points)
"""


def supply_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Call edges customer -> order -> part -> supplier -> nation -> region, in the order of their targets; order edges to parts over 150
    (in hundreds) stay unresolved."""
    t = lambda n: table(spark, sf_dir, n)
    name = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    parts = t("lineitem").select(name("o", "l_orderkey").alias("caller_id"), F.when(F.col("l_partkey") % 50 != 0, name("p", "l_partkey")).alias("callee_id"), F.col("l_partkey").alias("edge_ord")).distinct()
    return (
        t("orders").select(name("c", "o_custkey").alias("caller_id"), name("o", "o_orderkey").alias("callee_id"), F.col("o_orderkey").alias("edge_ord"))
        .unionByName(parts)
        .unionByName(t("lineitem").select(name("p", "l_partkey").alias("caller_id"), name("s", "l_suppkey").alias("callee_id"), F.col("l_suppkey").alias("edge_ord")).distinct())
        .unionByName(t("supplier").select(name("s", "s_suppkey").alias("caller_id"), name("n", "s_nationkey").alias("callee_id"), F.col("s_nationkey").cast("long").alias("edge_ord")))
        .unionByName(t("nation").select(name("n", "n_nationkey").alias("caller_id"), name("r", "n_regionkey").alias("callee_id"), F.col("n_regionkey").cast("long").alias("edge_ord")))
    )


GRAPH_SQL = """
edges AS (SELECT 'c' || o_custkey AS caller_id, 'o' || o_orderkey AS callee_id, o_orderkey AS edge_ord FROM orders
  UNION ALL SELECT DISTINCT 'o' || l_orderkey, CASE WHEN l_partkey % 50 <> 0 THEN 'p' || l_partkey END, l_partkey FROM lineitem
  UNION ALL SELECT DISTINCT 'p' || l_partkey, 's' || l_suppkey, l_suppkey FROM lineitem
  UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, s_nationkey FROM supplier
  UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_regionkey FROM nation)
"""


def parts_as_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    op = F.element_at(F.array(F.lit(">"), F.lit(">="), F.lit("<")), (F.col("p_partkey") % 3 + 1).cast("int"))
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("rule_id"), F.col("p_brand").alias("root_name"), F.concat(F.lit("part."), F.regexp_replace("p_type", " ", "")).alias("subject"), op.alias("operator"), F.col("p_size").cast("long").alias("literal"),
        F.concat(F.lower(F.col("p_brand")), F.lit(".go")).alias("rel_path"), F.col("p_partkey").alias("start_line"),
    )


CONDITIONS_SQL = r"""
conditions AS (SELECT p_partkey AS rule_id, p_brand AS root_name, 'part.' || replace(p_type, ' ', '') AS subject, (['>', '>=', '<'])[p_partkey % 3 + 1] AS operator, p_size::BIGINT AS literal, lower(p_brand) || '.go' AS rel_path, p_partkey AS start_line FROM part)
"""


def months_as_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("run_id"), F.concat(F.lit("user-"), F.col("user_id")).alias("id")).distinct()


RUNS_SQL = "runs AS (SELECT DISTINCT strftime(ts, '%Y-%m-%d') AS run_id, 'user-' || user_id AS id FROM events)"
