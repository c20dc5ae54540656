"""Linking outbound calls to routes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import join_key
from ..functions.paths import host_of, is_parameter, is_real_integration, method_matches, path_of, segments, specificity, wildcard_at
from .graphs import cut


def _shape(at: Column, n: Column, wild: Column) -> Column:
    """Where a pattern has literals, how many segments it covers, and whether any may follow."""
    return F.struct(at.cast("array<int>").alias("at"), n.cast("int").alias("n"), wild.alias("wild"))


def route_patterns(routes: DataFrame) -> DataFrame:
    """(pattern, r_method, route_path, score, shape, words, n, least, most): each method and path once, with the number of its routes and its least and greatest root."""
    r = routes.where("root_name is not null and path is not null").select("root_name", F.col("method").alias("r_method"), F.col("path").alias("route_path"))
    r = r.groupBy("r_method", "route_path").agg(F.count("*").alias("n"), F.min("root_name").alias("least"), F.max("root_name").alias("most"))
    r = r.withColumns({"pattern": _pattern("r_method", "route_path"), "ps": segments(F.col("route_path")), "score": specificity(F.col("route_path"))}).withColumn("star", wildcard_at(F.col("ps")))
    covered = F.slice("ps", 1, F.coalesce("star", F.size("ps")))
    fixed = F.filter(F.transform(covered, lambda s, i: F.struct(i.alias("at"), s.alias("word"))), lambda x: ~is_parameter(x["word"]))
    return r.select("pattern", "r_method", "route_path", "score", _shape(fixed["at"], F.size(covered), F.col("star").isNotNull()).alias("shape"), fixed["word"].alias("words"), "n", "least", "most")


def _pattern(method: str, path: str) -> Column:
    return join_key(F.col(method).isNotNull(), method, path)


def pattern_candidates(calls: DataFrame, routes: DataFrame) -> DataFrame:
    """(call_id, from_root, base_identifier, pattern, route_path, score, wild, n, least, most): the patterns, of whichever root, that match a call's path and method.

    Never calls x routes: a call has one key for each shape (the places of literals) that some pattern of its length has, and meets the patterns with just those words there."""
    base = F.col("base_identifier") if "base_identifier" in calls.columns else F.lit(None).cast("string")
    c = calls.where("root_name is not null").select("call_id", F.col("root_name").alias("from_root"), base.alias("base_identifier"), F.col("method").alias("c_method"), segments(path_of(F.col("target"))).alias("qs")).where("qs is not null")
    r = route_patterns(routes)
    shapes = r.select("shape").distinct()
    size = F.size("qs")
    c = c.join(F.broadcast(shapes), F.when(F.col("shape.wild"), size >= F.col("shape.n")).otherwise(size == F.col("shape.n"))).withColumn("words", F.transform("shape.at", lambda i: F.get("qs", i)))
    met = c.join(r, ["shape", "words"]).where(method_matches(F.col("c_method"), F.col("r_method")))
    return met.select("call_id", "from_root", "base_identifier", "pattern", "route_path", "score", F.col("shape.wild").alias("wild"), "n", "least", "most")


def _by_root(routes: DataFrame) -> DataFrame:
    """(pattern, to_root, own): how many routes of a pattern a root has."""
    r = routes.where("root_name is not null and path is not null").select(_pattern("method", "path").alias("pattern"), F.col("root_name").alias("to_root"))
    return r.groupBy("pattern", "to_root").agg(F.count("*").alias("own"))


def route_candidates(calls: DataFrame, routes: DataFrame) -> DataFrame:
    """(call_id, from_root, base_identifier, to_root, route_path, score, wild): every route of another root that matches a call's path and method. A row for each of them: link_calls and
    infer_base_bindings count them by pattern instead."""
    r = routes.select(_pattern("method", "path").alias("pattern"), F.col("root_name").alias("to_root"))
    return pattern_candidates(calls, routes).join(r, "pattern").where("from_root <> to_root").select("call_id", "from_root", "base_identifier", "to_root", "route_path", "score", "wild")


def link_calls(calls: DataFrame, routes: DataFrame, candidates: DataFrame | None = None) -> DataFrame:
    """One row per call: outcome linked with its route, or why not (target-not-resolved, unparsed-destination, no-matching-route,
    ambiguous-match with the number of best candidates), so that links and unlinked add up to the calls. candidates are pattern_candidates(), with bound_root where
    only that root's routes count."""
    met = pattern_candidates(calls, routes) if candidates is None else candidates
    bound = F.col("bound_root") if "bound_root" in met.columns else F.lit(None).cast("string")
    met = met.withColumn("bound", bound).withColumn("to_root", F.coalesce("bound", "from_root")).join(_by_root(routes), ["pattern", "to_root"], "left")
    own = F.coalesce("own", F.lit(0))
    met = met.withColumn("n", F.when(F.col("bound").isNull(), F.col("n") - own).when(F.col("bound") == F.col("from_root"), 0).otherwise(own)).where("n > 0")
    other = F.when(F.col("bound").isNotNull(), F.col("bound")).when(F.col("least") == F.col("from_root"), F.col("most")).otherwise(F.col("least"))  # right where one route is left
    best = met.groupBy("call_id", "score").agg(F.sum("n").alias("n_candidates"), F.min(F.struct(other.alias("to_root"), "route_path", "wild")).alias("r"))
    best = best.groupBy("call_id").agg(F.max_by(F.struct("n_candidates", "r"), "score").alias("b")).select("call_id", "b.*")
    path = path_of(F.col("target"))
    outcome = F.when(F.col("target").isNull(), "target-not-resolved").when(path.isNull(), "unparsed-destination").when(F.col("n_candidates").isNull(), "no-matching-route").when(F.col("n_candidates") > 1, "ambiguous-match").otherwise("linked")
    linked = F.col("outcome") == "linked"
    both = calls.join(best, "call_id", "left").withColumn("outcome", outcome)
    return both.select(
        "call_id", F.col("root_name").alias("from_root"), "outcome", F.coalesce("n_candidates", F.lit(0)).alias("n_candidates"),
        F.when(linked, F.col("r.to_root")).alias("to_root"), F.when(linked, F.col("r.route_path")).alias("route_path"),
        F.when(linked, F.when(F.col("r.wild"), "low").otherwise("medium")).alias("confidence"),
    )


def infer_base_bindings(calls: DataFrame, routes: DataFrame, majority: float = 0.6, minimum_matches: int = 3, candidates: DataFrame | None = None) -> DataFrame:
    """(from_root, base_identifier, bound_root, matched, considered, reason): the root whose routes most of a base's calls fit. A call
    counts once per root; bound only with minimum_matches and majority of all root matches. Calls of a base that fit the same patterns vote as one."""
    base = calls.where("base_identifier is not null")
    met = (pattern_candidates(base, routes) if candidates is None else candidates).where("base_identifier is not null")
    alike = met.groupBy("call_id", "from_root", "base_identifier").agg(F.array_sort(F.collect_set("pattern")).alias("patterns")).groupBy("from_root", "base_identifier", "patterns").agg(F.count("*").alias("times"))
    votes = alike.withColumn("pattern", F.explode("patterns")).join(_by_root(routes), "pattern").where("from_root <> to_root").select("from_root", "base_identifier", "patterns", "times", "to_root").distinct()
    per = votes.groupBy("from_root", "base_identifier", "to_root").agg(F.sum("times").alias("n"))
    top = per.groupBy("from_root", "base_identifier").agg(F.sum("n").alias("total"), F.min(F.struct((-F.col("n")).alias("neg"), "to_root")).alias("b"))
    considered = base.groupBy(F.col("root_name").alias("from_root"), "base_identifier").agg(F.count("*").alias("considered"))
    both = considered.join(top, ["from_root", "base_identifier"], "left")
    matched = F.coalesce(-F.col("b.neg"), F.lit(0))
    reason = F.when(matched == 0, "no call fits another root's routes").when(matched < minimum_matches, "below the minimum of matches").when(matched < majority * F.col("total"), "no clear majority").otherwise("bound")
    return both.select("from_root", "base_identifier", F.when(reason == "bound", F.col("b.to_root")).alias("bound_root"), matched.alias("matched"), "considered", reason.alias("reason"))


def link_calls_scoped(calls: DataFrame, routes: DataFrame, bindings: DataFrame, candidates: DataFrame | None = None) -> DataFrame:
    """link_calls with the calls of a bound base held to its root."""
    b = bindings.where("bound_root is not null").select("from_root", "base_identifier", "bound_root")
    return link_calls(calls, routes, (pattern_candidates(calls, routes) if candidates is None else candidates).join(b, ["from_root", "base_identifier"], "left"))


def bind_and_link(calls: DataFrame, routes: DataFrame) -> DataFrame:
    """link_calls_scoped with the bindings that the same candidates give; these are made once."""
    candidates = cut(pattern_candidates(calls, routes))
    return link_calls_scoped(calls, routes, infer_base_bindings(calls, routes, candidates=candidates), candidates)


def root_dependencies(links: DataFrame) -> DataFrame:
    return links.where("outcome = 'linked'").groupBy("from_root", "to_root").agg(F.count("*").alias("calls"))


def external_hosts(calls: DataFrame, links: DataFrame) -> DataFrame:
    """(root_name, host) of real integrations that no link explains."""
    used = links.where("outcome = 'linked'").select("call_id")
    hosts = calls.join(used, "call_id", "left_anti").select("root_name", host_of(F.col("target")).alias("host")).where("host is not null")
    return hosts.where(is_real_integration(F.col("host"))).distinct()


def project_map(links: DataFrame, hosts: DataFrame, entities: DataFrame) -> DataFrame:
    """(kind, source, target, weight): internal dependencies, external hosts, and how many entities(root_name, name) a root has."""
    return (
        root_dependencies(links).select(F.lit("internal").alias("kind"), F.col("from_root").alias("source"), F.col("to_root").alias("target"), F.col("calls").alias("weight"))
        .unionByName(hosts.select(F.lit("external").alias("kind"), F.col("root_name").alias("source"), F.col("host").alias("target"), F.lit(1).cast("long").alias("weight")))
        .unionByName(entities.groupBy("root_name").agg(F.countDistinct("name").alias("weight")).select(F.lit("datastore").alias("kind"), F.col("root_name").alias("source"), F.lit("datastore").alias("target"), "weight"))
    )


def reconcile(names: DataFrame, known: DataFrame) -> DataFrame:
    """(name, outcome, candidates): unresolved, exact or ambiguous; never a forced pick. known(name, id)."""
    found = known.groupBy("name").agg(F.array_sort(F.collect_set("id")).alias("candidates"))
    n = F.coalesce(F.size("candidates"), F.lit(0))
    both = names.select("name").distinct().join(found, "name", "left")
    return both.select("name", F.when(F.col("candidates").isNull(), "unresolved").when(n == 1, "exact").otherwise("ambiguous").alias("outcome"), F.coalesce("candidates", F.array().cast("array<string>")).alias("candidates"))


def align_endpoints(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """relations(relation_id, name) with outcome and candidates: the entities(id, name) that the name, in lower case without surrounding blanks, may mean."""
    plain = lambda c: F.lower(F.trim(c))
    found = reconcile(relations.select(plain(F.col("name")).alias("name")), entities.select(plain(F.col("name")).alias("name"), "id"))
    return relations.withColumn("__n", plain(F.col("name"))).join(found.withColumnRenamed("name", "__n"), "__n").select("relation_id", "name", "outcome", "candidates")


def canonical_symbols(symbols: DataFrame) -> DataFrame:
    """(symbol_id, canonical_id, reason): symbols(symbol_id, root_name, language, scope, qualified_name) by what they are called; one with neither a qualified name nor a
    scope has no identity of its own (J22)."""
    nameless = (F.coalesce("qualified_name", F.lit("")) == "") & (F.coalesce("scope", F.lit("")) == "")
    return symbols.select("symbol_id", F.when(~nameless, join_key("root_name", "language", "scope", "qualified_name")).alias("canonical_id"), F.when(nameless, "anonymous: neither qualified name nor scope").alias("reason"))


def resolve_handlers(routes: DataFrame, symbols: DataFrame) -> DataFrame:
    """(route_id, symbol_id, reason): routes(route_id, root_name, candidates array of names such as leave.Creation) resolved to symbols(id, root_name, name, qualified_name,
    rel_path). Candidates are tried in order: of the symbols so named in the root, a qualifier takes those in a folder of its name, else those in a file of its name (a plural or a prefix counts); plain
    functions go before members (::). One left resolves, several stop with a reason, none tries the next candidate (J3). A candidate is looked up once a root, among files with their numbers of symbols: never
    routes x symbols."""
    c = routes.select("route_id", "root_name", F.posexplode("candidates").alias("pos", "candidate"))
    c = c.withColumns({"name": F.substring_index("candidate", ".", -1), "qualifier": F.lower(F.when(F.col("candidate").contains("."), F.element_at(F.split("candidate", r"\."), -2)))})
    parts = F.split(F.lower("rel_path"), "/")
    place = F.struct(F.try_element_at(parts, F.lit(-2)).alias("folder"), F.regexp_replace(F.element_at(parts, -1), "[.][a-z0-9_]+$", "").alias("stem"), F.coalesce("qualified_name", F.lit("")).contains("::").cast("int").alias("member"))
    places = symbols.groupBy("root_name", "name", "id").agg(F.collect_set(place).alias("places"))
    places = places.select("root_name", "name", "id", F.when(F.size("places") > 1, F.col("id")).alias("again"), F.explode("places").alias("p"))
    files = places.groupBy("root_name", "name", "p", "again").agg(F.countDistinct("id").alias("n"), F.min("id").alias("id")).select("root_name", "name", "p.*", "again", "n", "id")
    hint, stem = F.col("qualifier"), F.col("stem")
    folder = F.coalesce(F.col("folder") == hint, F.lit(False))
    file = (stem == hint) | ((F.length(stem) >= 4) & (stem.startswith(hint) | hint.contains(stem)))
    met = c.select("root_name", "candidate", "name", "qualifier").distinct().join(files, ["root_name", "name"]).withColumn("strength", F.when(hint.isNull(), 0).when(folder, 2).when(file, 1)).where("strength is not null")
    sums = met.groupBy("root_name", "candidate", "strength", "member").agg((F.coalesce(F.sum(F.when(F.col("again").isNull(), F.col("n"))), F.lit(0)) + F.countDistinct("again")).alias("n"), F.min("id").alias("id"))
    fit = sums.groupBy("root_name", "candidate").agg(F.max_by(F.struct("n", "id"), F.struct("strength", -F.col("member"))).alias("b")).select("root_name", "candidate", "b.*")
    per = c.select("route_id", "root_name", "pos", "candidate").join(fit, ["root_name", "candidate"])
    first = per.groupBy("route_id").agg(F.min(F.struct("pos", "n", "id")).alias("f"))
    both = routes.select("route_id").join(first, "route_id", "left")
    reason = F.when(F.col("f").isNull(), "no symbol has a candidate's name").when(F.col("f.n") > 1, F.concat(F.col("f.n").cast("string"), F.lit(" symbols fit")))
    return both.select("route_id", F.when(F.col("f.n") == 1, F.col("f.id")).alias("symbol_id"), reason.alias("reason"))


def undescribed(touched: DataFrame, described: DataFrame) -> DataFrame:
    """(root_name, entity) used but never declared."""
    return touched.select("root_name", "entity").distinct().join(described.select("entity").distinct(), "entity", "left_anti").select("root_name", "entity")
