"""Flows of routes and what features are made of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .health import find_divergence, percent, repeated_rules


def frontend_callers(routes: DataFrame, links: DataFrame) -> DataFrame:
    """routes(root_name, method, path) with callers: the roots of links(to_root, route_path, method, from_root) that reach them; a method missing on either side
    matches; an empty array says that no caller was observed."""
    key = routes.select("root_name", "path", "method").distinct()
    hit = (F.col("root_name") == F.col("to_root")) & (F.col("path") == F.col("route_path")) & (F.col("method").isNull() | F.col("l_method").isNull() | (F.upper("method") == F.upper("l_method")))
    found = key.join(links.select("to_root", "route_path", F.col("method").alias("l_method"), "from_root"), hit).groupBy("root_name", "path", "method").agg(F.array_sort(F.collect_set("from_root")).alias("callers"))
    f = found.withColumnsRenamed({"root_name": "fr", "path": "fp", "method": "fm"})
    both = routes.join(f, (F.col("root_name") == F.col("fr")) & (F.col("path") == F.col("fp")) & F.col("method").eqNullSafe(F.col("fm")), "left")
    return both.select(*routes.columns, F.coalesce("callers", F.array().cast("array<string>")).alias("callers"))


def flow_data_access(scopes: DataFrame, access: DataFrame, k: int = 12) -> DataFrame:
    """(flow_id, entity, operations, indirect, more): per flow the data of the first of its scopes that has any: scopes(flow_id, rank, scope), rank 0 the trace's
    symbols, 1 its files, 2 their packages (indirect); access(rank, scope, entity, operation). The k first entities by name, and how many more. Flows whose first scopes are the same have the same
    data, so the accesses of each set of scopes are gathered once and at most k of them meet its flows."""
    met = scopes.where("flow_id is not null").join(access.select("rank", "scope").distinct(), ["rank", "scope"], "left_semi")
    asked = met.groupBy("flow_id", "rank").agg(F.array_sort(F.collect_set("scope")).alias("asked")).groupBy("flow_id").agg(F.min(F.struct("rank", "asked")).alias("a")).select("flow_id", "a.*")
    per = asked.select("rank", "asked").distinct().withColumn("scope", F.explode("asked")).join(access, ["rank", "scope"])
    per = per.groupBy("rank", "asked", "entity").agg(F.array_sort(F.collect_set(F.when(F.col("operation") != "unknown", F.col("operation")))).alias("operations"))
    placed = per.withColumn("place", F.row_number().over(Window.partitionBy("rank", "asked").orderBy("entity")))
    found = placed.groupBy("rank", "asked").agg(F.collect_list(F.when(F.col("place") <= k, F.struct("entity", "operations"))).alias("found"), F.count("*").alias("n"))
    out = asked.join(found, ["rank", "asked"]).select("flow_id", F.explode("found").alias("f"), (F.col("rank") == 2).alias("indirect"), F.greatest(F.col("n") - k, F.lit(0)).alias("more"))
    return out.select("flow_id", "f.entity", "f.operations", "indirect", "more")


def flow_outbound(scopes: DataFrame, calls: DataFrame, k: int = 6) -> DataFrame:
    """(flow_id, label): the first k distinct labels of calls(scope, label) made in a flow's scopes(flow_id, scope). The first k of several scopes are among the first k of each, so no more
    than these meet the flows."""
    first = lambda df, by: df.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy("label"))).where(F.col("place") <= k).drop("place")
    met = scopes.join(first(calls.select("scope", "label").distinct(), "scope"), "scope").select("flow_id", "label").distinct()
    return first(met, "flow_id")


def rule_conditions(conditions: DataFrame, k: int = 6) -> DataFrame:
    """(root_name, rel_path, enclosing_function, texts): up to k distinct sorted texts of a function's conditions."""
    g = conditions.groupBy("root_name", "rel_path", "enclosing_function").agg(F.array_sort(F.collect_set("text")).alias("t"))
    return g.select("root_name", "rel_path", "enclosing_function", F.slice("t", 1, k).alias("texts"))


def feature_rules(features: DataFrame, rules: DataFrame) -> DataFrame:
    """(feature_id, rule_id): rules(rule_id, root_name, rel_path) in files that features(feature_id, file_paths array of struct(root_name, rel_path)) own."""
    owned = features.select("feature_id", F.explode("file_paths").alias("f")).select("feature_id", "f.root_name", "f.rel_path").distinct()
    return owned.join(rules, ["root_name", "rel_path"]).select("feature_id", "rule_id").distinct()


def notable_rules(rules: DataFrame, k: int = 20) -> DataFrame:
    """(feature_id, rule_id, statement, reason): disagreed, repeated (three places or more) or unnamed-value, the first k of each feature in that order, then by
    statement. rules(feature_id, rule_id, statement, disagreed, places, unexplained)."""
    reason = F.when(F.col("disagreed"), 0).when(F.col("places") >= 3, 1).when(F.col("unexplained"), 2)
    r = rules.withColumn("r", reason).where("r is not null")
    w = Window.partitionBy("feature_id").orderBy("r", "statement", "rule_id")
    names = F.array(F.lit("disagreed"), F.lit("repeated"), F.lit("unnamed-value"))
    return r.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).select("feature_id", "rule_id", "statement", names[F.col("r")].alias("reason"))


def feature_facts(endpoints: DataFrame, tables: DataFrame, flows: DataFrame) -> DataFrame:
    """(feature_id, endpoints, tables, nearby, flows, partial): endpoints(feature_id, route_id), tables(feature_id, entity, nearby), flows(feature_id, flow_id, partial); a
    table that is both counts as the feature's own."""
    e = endpoints.groupBy("feature_id").agg(F.countDistinct("route_id").alias("endpoints"))
    own, near = F.collect_set(F.when(~F.col("nearby"), F.col("entity"))), F.collect_set(F.when(F.col("nearby"), F.col("entity")))
    t = tables.groupBy("feature_id").agg(own.alias("o"), near.alias("n")).select("feature_id", F.array_sort("o").alias("tables"), F.array_sort(F.array_except("n", "o")).alias("nearby"))
    f = flows.groupBy("feature_id").agg(F.countDistinct("flow_id").alias("flows"), F.count_if("partial").alias("partial"))
    none = F.array().cast("array<string>")
    return e.join(t, "feature_id", "left").join(f, "feature_id", "left").select("feature_id", "endpoints", F.coalesce("tables", none).alias("tables"), F.coalesce("nearby", none).alias("nearby"), F.coalesce("flows", F.lit(0)).alias("flows"), F.coalesce("partial", F.lit(0)).alias("partial"))


def feature_findings(endpoints: DataFrame) -> DataFrame:
    """(feature_id, code, n, total, severity): endpoints without observed auth (a concern if all are), caller or handler. endpoints(feature_id, has_auth, has_caller,
    has_handler)."""
    g = endpoints.groupBy("feature_id").agg(F.count("*").alias("total"), *(F.count_if(~F.col(f"has_{c}")).alias(c) for c in ("auth", "caller", "handler")))
    row = lambda c, severity: F.struct(F.lit(f"without-{c}").alias("code"), F.col(c).alias("n"), severity.alias("severity"))
    rows = F.array(row("auth", F.when(F.col("auth") == F.col("total"), "concern").otherwise("notice")), row("caller", F.lit("info")), row("handler", F.lit("notice")))
    return g.select("feature_id", "total", F.explode(rows).alias("r")).where("r.n > 0").select("feature_id", "r.code", "r.n", "total", "r.severity")


def storage_findings(steps: DataFrame, named: int = 5) -> DataFrame:
    """(feature_id, code, evidence array, severity): features of which no endpoint was seen to reach a table, and those whose every observed access lies near a handler and in none; where
    nothing was observed the latter says nothing. The evidence is the first tables by name. steps(feature_id, flow_id, kind, entity, indirect, unresolved_reason), one row a step of a feature's
    flows; a feature without flows has no row and no finding."""
    seen = (F.col("kind") == "data-access") & F.col("unresolved_reason").isNull()
    g = steps.groupBy("feature_id").agg(F.count_if(seen).alias("observed"), F.count_if(seen & ~F.coalesce("indirect", F.lit(False))).alias("direct"), F.array_sort(F.collect_set(F.when(seen, F.col("entity")))).alias("tables"))
    code = F.when(F.size("tables") == 0, "feature-without-observed-storage").when((F.col("observed") > 0) & (F.col("direct") == 0), "storage-observed-only-nearby")
    return g.select("feature_id", code.alias("code"), F.slice("tables", 1, named).alias("evidence"), F.lit("info").alias("severity")).where("code is not null")


def logic_findings(rules: DataFrame, discarded: DataFrame) -> DataFrame:
    """(code, subject, n, severity): a rule applied in two ways; by root, bare numbers (of n) where others are named; one rule in three places or more; failures
    that nobody observes by root. rules(rule_id, root_name, subject, operator, literal, named boolean), discarded(root_name)."""
    two = find_divergence(rules).groupBy("subject_key", "literal").agg(F.count("*").alias("n"))
    bare = rules.groupBy("root_name").agg(F.count_if(~F.col("named")).alias("n"), F.count_if("named").alias("others")).where("n > 0 and others > 0")
    row = lambda df, code, subject, n, severity: df.select(F.lit(code).alias("code"), subject.alias("subject"), F.col(n).alias("n"), F.lit(severity).alias("severity"))
    return (
        row(two, "rule-applied-two-ways", F.concat_ws(" ", "subject_key", "literal"), "n", "concern")
        .unionByName(row(bare, "values-with-no-declared-meaning", F.col("root_name"), "n", "notice"))
        .unionByName(row(repeated_rules(rules), "rules-restated-in-many-places", F.concat_ws(" ", "subject_key", "operator", "literal"), "places", "notice"))
        .unionByName(row(discarded.groupBy("root_name").agg(F.count("*").alias("n")), "failures-nobody-can-observe", F.col("root_name"), "n", "notice"))
    )


def _graded(share: Column, concern: int, notice: int) -> Column:
    return F.when(share > concern, "concern").when(share > notice, "notice").otherwise("info")


def health_signals(measures: DataFrame) -> DataFrame:
    """(signal, measured, severity), seven rows from one row of measures(considered, unlinked, cycles, traces, partial, untraced, linking boolean, files, behavioural, spanning,
    direct): shares of outbound calls, traces, entries and files in percent, the others counted. Where no provider could have linked entries to code (linking
    is false), untraced ones say nothing of the project."""
    signal = lambda name, measured, severity: F.struct(F.lit(name).alias("signal"), measured.cast("long").alias("measured"), severity.alias("severity"))
    unlinked, partial = percent(F.col("unlinked"), F.col("considered")), percent(F.col("partial"), F.col("traces"))
    untraced, explained = percent(F.col("untraced"), F.col("traces") + F.col("untraced")), percent(F.col("behavioural"), F.col("files"))
    rows = F.array(
        signal("unresolved-integrations", unlinked, _graded(unlinked, 50, 20)),
        signal("root-cycles", F.col("cycles"), F.when(F.col("cycles") > 0, "concern").otherwise("info")),
        signal("partial-traces", partial, _graded(partial, 60, 30)),
        signal("untraced-entry-points", untraced, F.when(~F.col("linking"), "info").otherwise(_graded(untraced, 50, 20))),
        signal("behavioural-coverage", explained, F.when(explained < 20, "notice").otherwise("info")),
        signal("modules-spanning-roots", F.col("spanning"), F.when(F.col("spanning") > 0, "notice").otherwise("info")),
        signal("declared-dependencies", F.col("direct"), F.lit("info")),
    )
    return measures.select(F.explode(rows).alias("r")).select("r.*")


def coverage_notes(gaps: DataFrame, roots: DataFrame) -> DataFrame:
    """(kind, reason, where): gaps(root_name, kind, reason) once each, 'all parts' when every root has it."""
    total = roots.select("root_name").distinct().agg(F.count("*").alias("total"))
    g = gaps.groupBy("kind", "reason").agg(F.array_sort(F.collect_set("root_name")).alias("r"))
    return g.crossJoin(F.broadcast(total)).select("kind", "reason", F.when(F.size("r") == F.col("total"), "all parts").otherwise(F.array_join("r", ", ")).alias("where"))


def data_coverage_notes(described: DataFrame, touched: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, note, described, undescribed): what a data model leaves out (D19), a row a group of by (without, one row for all). Where no described(by, entity) was read the note is
    nothing-described, which tells of the readers and not of the project; else, where touched(by, entity) has more than the model, further-entities-used with their number. A model that has
    all has no row. Null entities count for nothing. One aggregate by entity, one by group."""
    one = lambda df, is_described: df.select(*by, "entity", F.lit(is_described).alias("d"))
    each = one(described, True).unionByName(one(touched, False)).groupBy(*by, "entity").agg(F.max("d").alias("d"))
    known = F.col("entity").isNotNull()
    g = each.groupBy(*by).agg(F.count_if(F.col("d") & known).alias("described"), F.count_if(~F.col("d") & known).alias("undescribed"))
    note = F.when(F.col("described") == 0, "nothing-described").when(F.col("undescribed") > 0, "further-entities-used")
    return g.select(*by, note.alias("note"), "described", F.when(F.col("described") > 0, F.col("undescribed")).otherwise(0).alias("undescribed")).where("note is not null")


def readiness(counts: DataFrame, required: DataFrame) -> DataFrame:
    """(kind, n, missing): the required(kind) kinds with how many of counts(kind, n) there are; none is missing."""
    c = counts.groupBy("kind").agg(F.sum("n").alias("n"))
    return required.select("kind").distinct().join(c, "kind", "left").select("kind", F.coalesce("n", F.lit(0)).alias("n"), (F.coalesce("n", F.lit(0)) == 0).alias("missing"))


def status(snapshots: DataFrame, files: DataFrame) -> DataFrame:
    """(workspace, snapshot_id, roots, files): the latest published snapshot of each workspace with its counts; none is a row without snapshot."""
    latest = snapshots.groupBy("workspace").agg(F.max(F.when(F.col("published_at").isNotNull(), F.struct("published_at", "snapshot_id")))["snapshot_id"].alias("snapshot_id"))
    n = files.groupBy("snapshot_id").agg(F.countDistinct("root_name").alias("roots"), F.count("*").alias("files"))
    return latest.join(n, "snapshot_id", "left").select("workspace", "snapshot_id", F.coalesce("roots", F.lit(0)).alias("roots"), F.coalesce("files", F.lit(0)).alias("files"))


def status_report(workspaces: DataFrame, snapshots: DataFrame, roots: DataFrame, files: DataFrame, checks: DataFrame, run_id: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(reports, roots, checks) of the latest published snapshot of each of workspaces(workspace), or of its snapshot of run_id (D23). snapshots(workspace, snapshot_id, run_id, published_at):
    of equal times the larger id is the latest; a workspace without one is not analyzed and has a report alone. roots(snapshot_id, root_name, branch, dirty) come with the number of
    files(snapshot_id, root_name, disposition) by disposition, an empty map where there are none; checks(snapshot_id, provider_id, version, available, reason) one a provider, the least of several."""
    published = snapshots.where("published_at is not null")
    published = published if run_id is None else published.where(F.col("run_id") == run_id)
    latest = published.groupBy("workspace").agg(F.max(F.struct("published_at", "snapshot_id", "run_id")).alias("s"))
    reports = workspaces.select("workspace").distinct().join(latest, "workspace", "left").select("workspace", F.col("s").isNotNull().alias("analyzed"), "s.snapshot_id", "s.run_id", "s.published_at")
    shown = reports.where("analyzed").select("workspace", "snapshot_id")
    per = files.groupBy("snapshot_id", "root_name", "disposition").agg(F.count("*").alias("n")).where("disposition is not null")
    counts = per.groupBy("snapshot_id", "root_name").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("disposition", "n")))).alias("counts"))
    none = F.create_map().cast("map<string,bigint>")
    ran = checks.groupBy("snapshot_id", "provider_id").agg(F.min(F.struct("version", "available", "reason")).alias("c"))
    at_root = shown.join(roots, "snapshot_id").join(counts, ["snapshot_id", "root_name"], "left").select("workspace", "snapshot_id", "root_name", "branch", "dirty", F.coalesce("counts", none).alias("counts"))
    return reports, at_root, shown.join(ran, "snapshot_id").select("workspace", "snapshot_id", "provider_id", "c.version", "c.available", "c.reason")


def contextual_steps(steps: DataFrame, methods: DataFrame, supertypes: DataFrame, instantiated: DataFrame) -> DataFrame:
    """steps(flow_id, pos, symbol_id) where a method of a type that the flow does not instantiate is replaced by the one same-named method of an instantiated type with a common
    supertype; if there are several such methods the step goes (J14). methods(symbol_id, type_id, name), supertypes(type_id, super), instantiated(flow_id, type_id)."""
    here = steps.join(methods, "symbol_id").join(instantiated.withColumn("in", F.lit(True)), ["flow_id", "type_id"], "left").where("in is null")
    kin = here.join(supertypes, "type_id").select("flow_id", "pos", "name", "super", F.col("symbol_id").alias("old"))
    other = methods.join(supertypes, "type_id").select("name", "super", "type_id", F.col("symbol_id").alias("new"))
    found = kin.join(other, ["name", "super"]).where("new <> old").join(instantiated, ["flow_id", "type_id"], "left_semi")
    choice = found.groupBy("flow_id", "pos").agg(F.collect_set("new").alias("news"))
    both = steps.join(choice, ["flow_id", "pos"], "left").where("news is null or size(news) = 1")
    return both.select("flow_id", "pos", F.coalesce(F.col("news")[0], F.col("symbol_id")).alias("symbol_id"))


def assemble_flows(parts: DataFrame, k: int = 12) -> DataFrame:
    """(flow_id, steps, partial, more): parts(flow_id, stage, ord, label, resolved) with stages caller, route, handler, service, outbound, data in this order; at most k services each,
    the rest counted; partial if a step is not resolved (D16)."""
    stage = F.array_position(F.array(*map(F.lit, ("caller", "route", "handler", "service", "outbound", "data"))), F.col("stage")).cast("int")
    w = Window.partitionBy("flow_id", "stage").orderBy("ord", "label")
    p = parts.withColumn("rank", stage).withColumn("place", F.row_number().over(w))
    kept = (F.col("stage") != "service") | (F.col("place") <= k)
    step = F.when(kept, F.struct("rank", "ord", "label", "resolved"))
    g = p.groupBy("flow_id").agg(F.array_sort(F.collect_list(step)).alias("s"), F.bool_or(~F.col("resolved")).alias("partial"), F.count_if(~kept).alias("more"))
    return g.select("flow_id", F.transform("s", lambda x: F.struct(x["label"].alias("label"), x["resolved"].alias("resolved"))).alias("steps"), "partial", "more")


def skipped_routes(routes: DataFrame, features: DataFrame) -> DataFrame:
    """(route_id, reason): the routes(route_id) that no feature(route_id, feature_id) holds, so that no flow is made of them."""
    return routes.select("route_id").distinct().join(features.where("feature_id is not null").select("route_id"), "route_id", "left_anti").withColumn("reason", F.lit("no feature holds the route"))


def feature_links(flows: DataFrame, rules: DataFrame, modules: DataFrame) -> DataFrame:
    """(from_id, to_id, role): feature to its flows(feature_id, flow_id) and rules(feature_id, rule_id), module to its features(module_id, feature_id)."""
    row = lambda df, a, b, role: df.select(F.col(a).cast("string").alias("from_id"), F.col(b).cast("string").alias("to_id"), F.lit(role).alias("role"))
    return row(flows, "feature_id", "flow_id", "flow").unionByName(row(rules, "feature_id", "rule_id", "rule")).unionByName(row(modules, "module_id", "feature_id", "feature")).distinct()


def run_context(**counted: DataFrame) -> DataFrame:
    """One row with the number of rows of each table."""
    out = None
    for name, df in counted.items():
        n = df.agg(F.count("*").alias(name))
        out = n if out is None else out.crossJoin(F.broadcast(n))
    return out
