"""An external code graph as records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import parse_route_name

# Which record an edge kind becomes.
TYPE_EDGES = ("extends", "implements")
CALL_EDGES = ("calls",)


def read_code_graph(spark: SparkSession, path: str, version: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a graph stored as Parquet with a one-row meta table; another version is refused before anything is read."""
    found = spark.read.parquet(f"{path}/meta").first()
    if found is None or found["version"] != version:
        raise ValueError(f"graph version {found and found['version']}, {version} wanted")
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")


def owned_nodes(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """nodes(id, kind, name, file_path, ...) with root_name and rel_path: the longest of roots(root_name, prefix) that holds the path, which is cut off;
    nodes outside of all go. Each folder is looked up once, on its ancestors, so no prefix is compared with every node."""
    parts = F.split("file_path", "/")
    placed = nodes.where((F.size(parts) > 1) & F.col("id").isNotNull()).withColumn("__folder", F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/"))
    above = F.transform(F.sequence(F.lit(1), F.size(F.split("__folder", "/"))), lambda k: F.struct(F.array_join(F.slice(F.split("__folder", "/"), 1, k), "/").alias("prefix"), k.alias("depth")))
    met = placed.select("__folder").distinct().select("__folder", F.explode(above).alias("a")).select("__folder", "a.prefix", "a.depth").join(roots, "prefix")
    best = met.groupBy("__folder").agg(F.max(F.struct("depth", "prefix", "root_name")).alias("b"))
    own = placed.join(best, "__folder")
    return own.select(*nodes.columns, F.col("b.root_name").alias("root_name"), F.substring(F.col("file_path"), F.length("b.prefix") + 2, F.length("file_path")).alias("rel_path"))


def graph_to_facts(nodes: DataFrame, edges: DataFrame, roots: DataFrame, files: DataFrame) -> dict[str, DataFrame]:
    """symbols, imports, routes, call_edges, references and type_relations of a graph; only nodes in files(root_name, rel_path) count as sources; an edge whose target is not known stays, with
    a reason. edges(from_id, to_id, kind). Under nodes and edges all records of either side stand in one table, by records, for those who want more than one kind in one reading."""
    n = owned_nodes(nodes, roots).join(files.select("root_name", "rel_path"), ["root_name", "rel_path"], "left_semi")
    target = nodes.select(F.col("id").alias("to_id"), F.col("name").alias("to_name"))
    e = edges.join(n.select(F.col("id").alias("from_id"), "root_name"), "from_id").join(target, "to_id", "left")
    reason = F.when(F.col("to_name").isNull(), "target is not in the graph")
    call, kind = F.col("kind").isin(*CALL_EDGES), F.col("kind").isin(*TYPE_EDGES)
    e = e.withColumn("records", F.when(call, "call_edges").when(kind, "type_relations").when(~call & ~kind, "references")).where("records is not null")
    e = e.select("records", "root_name", "from_id", F.when(F.col("to_name").isNotNull(), F.col("to_id")).alias("to_id"), "to_name", F.when(F.col("kind") == "instantiates", "instantiate").otherwise(F.col("kind")).alias("kind"), reason.alias("unresolved_reason"))
    route = parse_route_name(F.col("name"))
    records = F.when(F.col("kind") == "import", "imports").when(F.col("kind") == "route", "routes").when(F.col("kind").isNotNull(), "symbols")
    n = n.withColumns({"records": records, "method": F.when(F.col("kind") == "route", route["method"]), "path": F.when(F.col("kind") == "route", route["path"])}).where("records is not null")
    pick = lambda df, name: df.where(F.col("records") == name)
    made = {
        "symbols": pick(n, "symbols").select("id", "root_name", "rel_path", "name", "kind"),
        "imports": pick(n, "imports").select("root_name", "rel_path", F.col("name").alias("specifier")),
        "routes": pick(n, "routes").select("id", "root_name", "rel_path", "method", "path"),
    }
    return made | {k: pick(e, k).drop("records") for k in ("call_edges", "type_relations", "references")} | {"nodes": n.select("records", "id", "root_name", "rel_path", "name", "kind", "method", "path"), "edges": e}


def import_edges_report(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(kind, edges, resolved, dangling): per edge kind, how many have a target, and how many name an id that no node has."""
    ids = nodes.select("id").distinct().withColumn("there", F.lit(True))
    both = edges.join(ids.withColumnsRenamed({"id": "from_id", "there": "f"}), "from_id", "left").join(ids.withColumnsRenamed({"id": "to_id", "there": "t"}), "to_id", "left")
    dangling = F.col("f").isNull() | (F.col("to_id").isNotNull() & F.col("t").isNull())
    return both.groupBy("kind").agg(F.count("*").alias("edges"), F.count("to_id").alias("resolved"), F.count_if(dangling).alias("dangling"))
