"""Features, modules and components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import stable_id
from ..functions.names import entity_term, looks_infrastructural, singular, words
from ..functions.paths import is_parameter, segments

# Weight of an entity against a route, and the least weight of a feature.
ENTITY_WEIGHT, MINIMUM_WEIGHT = 3, 8
NO_RESOURCE = r"^(v[0-9]+|api|rest|graphql|internal|public)$"


def detect_features(entities: DataFrame, routes: DataFrame, files: DataFrame, stopwords: tuple[str, ...] = ()) -> DataFrame:
    """(term, entities, routes, files, weight, kept): terms with at least two kinds of signals; kept from the minimum weight on.
    entities(name), routes(path), files(rel_path); an inverted index of each, full-outer joined."""
    keep = lambda w: ~w.isin(*stopwords) if stopwords else F.lit(True)
    e = entities.select(entity_term(F.col("name"), None, stopwords or ("",)).alias("term"), "name").where("term is not null").distinct().groupBy("term").agg(F.count("*").alias("entities"))
    index = lambda df, c, n: df.select(F.explode(F.array_distinct(F.filter(F.transform(words(F.col(c)), singular), keep))).alias("term"), c).distinct().groupBy("term").agg(F.count("*").alias(n))
    both = e.join(index(routes, "path", "routes"), "term", "full").join(index(files, "rel_path", "files"), "term", "full").na.fill(0)
    kinds = sum((F.col(c) > 0).cast("int") for c in ("entities", "routes", "files"))
    weight = ENTITY_WEIGHT * F.col("entities") + F.col("routes")
    return both.where(kinds >= 2).withColumn("weight", weight).withColumn("kept", weight >= MINIMUM_WEIGHT)


def feature_for_route(routes: DataFrame, features: DataFrame) -> DataFrame:
    """(path, term): the heaviest feature whose term is a word of the path, or null."""
    w = routes.select("path").distinct().withColumn("term", F.explode_outer(F.transform(words(F.col("path")), singular)))
    found = w.join(features.select("term", "weight"), "term").groupBy("path").agg(F.max_by("term", F.struct("weight", "term")).alias("term"))
    return routes.select("path").distinct().join(found, "path", "left").select("path", "term")


def shared_prefix_length(paths: DataFrame) -> DataFrame:
    """(n): how many leading segments all paths(path) share, never a path's last."""
    p = paths.select(F.posexplode(segments(F.col("path"))).alias("pos", "s"), F.size(segments(F.col("path"))).alias("n"))
    at = p.where(F.col("pos") < F.col("n") - 1).groupBy("pos").agg(F.countDistinct("s").alias("d"), F.count("*").alias("c"))
    total = paths.agg(F.count("*").alias("total"), F.min(F.size(segments(F.col("path")))).alias("least"))
    bad = at.crossJoin(F.broadcast(total)).where("d <> 1 or c <> total").agg(F.min("pos").alias("bad"))
    return bad.crossJoin(F.broadcast(total)).select(F.coalesce("bad", F.greatest(F.col("least") - 1, F.lit(0))).cast("int").alias("n"))


def resource_of(path: Column, prefix: Column | int = 0) -> Column:
    """The first segment past the shared prefix that names a resource."""
    rest = F.slice(segments(path), F.lit(prefix) + 1, F.size(segments(path)))
    return F.try_element_at(F.filter(rest, lambda s: (s != "") & ~is_parameter(s) & ~s.startswith("*") & ~F.lower(s).rlike(NO_RESOURCE)), F.lit(1))


def form_modules(entries: DataFrame, prefix: int = 0) -> DataFrame:
    """(module_id, key, name, entries): entries(entry_id, path) grouped by the singular of their resource, named by its commonest spelling
    (least among equals), with an id made of the entry keys; without a resource there is no module."""
    e = entries.withColumn("spelling", resource_of(F.col("path"), prefix)).where("spelling is not null").withColumn("key", singular(F.lower("spelling")))
    names = e.groupBy("key", "spelling").agg(F.count("*").alias("n")).groupBy("key").agg(F.min_by("spelling", F.struct(-F.col("n"), "spelling")).alias("name"))
    return _identified(e, "key").join(names, "key").select("module_id", "key", "name", "entries")


def _identified(entries: DataFrame, key: str) -> DataFrame:
    """(key, module_id, entries): an id made of the distinct entry ids of each key, which are digested in 4,096 ranges first, so that no task holds all of a key."""
    each = entries.select(key, F.col("entry_id").cast("string").alias("entry_id")).distinct().withColumn("range", F.substring(F.sha2("entry_id", 256), 1, 3))
    parts = each.groupBy(key, "range").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("entry_id")), "\n"), 256).alias("d"), F.count("*").alias("n"))
    return parts.groupBy(key).agg(stable_id("module", F.collect_list("d")).alias("module_id"), F.sum("n").alias("entries"))


def assign_dispositions(files: DataFrame, behavioural: DataFrame, infrastructural: DataFrame, technical: DataFrame) -> DataFrame:
    """files(root_name, rel_path) with disposition: the first of the three sets that holds the file, else unclassified."""
    key = ["root_name", "rel_path"]
    out = files
    for name, held in (("b", behavioural), ("i", infrastructural), ("t", technical)):
        out = out.join(held.select(*key).distinct().withColumn(name, F.lit(True)), key, "left")
    return out.withColumn("disposition", F.when(F.col("b"), "behavioural").when(F.col("i"), "infrastructural").when(F.col("t"), "technical").otherwise("unclassified")).drop("b", "i", "t")


def folder_containment(files: DataFrame) -> DataFrame:
    """(root_name, container, member): every pair of a folder and the folder or file right in it, once."""
    parts = F.split("rel_path", "/")
    upto = lambda k: F.array_join(F.slice(parts, 1, k), "/")
    pairs = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.struct(upto(k).alias("container"), upto(k + 1).alias("member")))
    return files.where(F.size(parts) > 1).select("root_name", F.explode(pairs).alias("p")).select("root_name", "p.*").distinct()


def form_modules_from_routes(routes: DataFrame, prefix: int = 0, most: int = 25, least: int = 3) -> DataFrame:
    """form_modules on routes(entry_id, root_name, path), but one module per root where that gives over most groups of under least entries on average."""
    made = form_modules(routes, prefix)
    size = made.agg(F.count("*").alias("groups"), F.sum("entries").alias("entries")).select(((F.col("groups") > most) & (F.col("entries") < least * F.col("groups"))).alias("scattered"))
    by_root = _identified(routes.select(F.col("root_name").alias("key"), "entry_id"), "key").select("module_id", "key", F.col("key").alias("name"), "entries")
    pick = lambda df, want: df.crossJoin(F.broadcast(size)).where(F.coalesce("scattered", F.lit(False)) == want).drop("scattered")
    return pick(made, False).unionByName(pick(by_root, True))


def form_components(files: DataFrame, dependencies: DataFrame, large: int = 5) -> DataFrame:
    """(root_name, folder, members, infrastructural, declared, signals): top-level folders of files(root_name, rel_path) with members, whether their name is one of infrastructure,
    whether dependencies(root_name, name) declare it, and what speaks for a component: containment, infrastructure, declared, size from large members on (D6)."""
    top = files.where(F.col("rel_path").contains("/")).groupBy("root_name", F.element_at(F.split("rel_path", "/"), 1).alias("folder")).agg(F.count("*").alias("members"))
    d = dependencies.select("root_name", F.col("name").alias("folder")).distinct().withColumn("declared", F.lit(True))
    both = top.join(d, ["root_name", "folder"], "left").select("root_name", "folder", "members", looks_infrastructural(F.col("folder")).alias("infrastructural"), F.coalesce("declared", F.lit(False)).alias("declared"))
    signals = F.array_compact(F.array(F.lit("containment"), F.when(F.col("infrastructural"), "infrastructure"), F.when(F.col("declared"), "declared"), F.when(F.col("members") >= large, "size")))
    return both.withColumn("signals", signals)
