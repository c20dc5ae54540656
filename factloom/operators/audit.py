"""Auditing written reports against the base, and comparing runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# A path-like token with an extension, and N% (n/d) with plain or full-width brackets and thousands separators.
PATH = r"(?<![A-Za-z0-9_./-])((?:[A-Za-z0-9_.-]+/)*[A-Za-z0-9_-]+(?:\.[A-Za-z0-9_-]+)*\.[A-Za-z]{1,5})(?![A-Za-z0-9_/-])"
PROPORTION = r"([0-9]+)\s*%\s*[（(]\s*([0-9][0-9,]*)\s*/\s*([0-9][0-9,]*)\s*[）)]"


def cited_paths(reports: DataFrame) -> DataFrame:
    """(report_id, path), distinct."""
    return reports.select("report_id", F.explode(F.regexp_extract_all("text", F.lit(PATH), F.lit(1))).alias("path")).distinct()


def cited_proportions(reports: DataFrame) -> DataFrame:
    """(report_id, pos, stated, numerator, denominator), in the order of the text."""
    part = lambda i: F.regexp_extract_all("text", F.lit(PROPORTION), F.lit(i))
    n = lambda c: F.regexp_replace(c, ",", "").cast("long")
    x = reports.select("report_id", F.posexplode(F.arrays_zip(part(1).alias("s"), part(2).alias("n"), part(3).alias("d"))).alias("pos", "p"))
    return x.select("report_id", F.col("pos").cast("long").alias("pos"), F.col("p.s").cast("long").alias("stated"), n(F.col("p.n")).alias("numerator"), n(F.col("p.d")).alias("denominator"))


def audit_proportions(cited: DataFrame, denominators: DataFrame) -> DataFrame:
    """cited with finding: unknown-denominator, wrong-proportion (off by over one point of the half-up share) or null. denominators(value)."""
    known = denominators.select(F.col("value").cast("long").alias("denominator")).distinct().withColumn("known", F.lit(True))
    share = F.floor(100 * F.col("numerator") / F.col("denominator") + 0.5)
    finding = F.when(F.col("known").isNull(), "unknown-denominator").when((F.col("denominator") == 0) | (F.abs(F.col("stated") - share) > 1), "wrong-proportion")
    return cited.join(known, "denominator", "left").select(*cited.columns, finding.alias("finding"))


def known_paths(cited: DataFrame, files: DataFrame) -> DataFrame:
    """The cited(report_id, path) that name one of files(rel_path): equal, or one ends with / and the other; met on the base name."""
    base = lambda c: F.element_at(F.split(c, "/"), -1)
    f = files.select("rel_path", base(F.col("rel_path")).alias("base")).distinct()
    c = cited.withColumn("base", base(F.col("path")))
    a, b = F.col("path"), F.col("rel_path")
    return c.join(f, "base").where((a == b) | a.endswith(F.concat(F.lit("/"), b)) | b.endswith(F.concat(F.lit("/"), a))).select(*cited.columns).distinct()


def audit_paths(cited: DataFrame, files: DataFrame) -> DataFrame:
    """(report_id, path, finding): extensions that no file has, and qualified paths that name none; a bare unknown name is let be."""
    ext = lambda c: F.regexp_extract(c, r"\.([A-Za-z]+)$", 1)
    exts = files.select(ext(F.col("rel_path")).alias("ext")).distinct().withColumn("has", F.lit(True))
    ok = known_paths(cited, files).withColumn("ok", F.lit(True))
    both = cited.join(ok, ["report_id", "path"], "left").withColumn("ext", ext(F.col("path"))).join(exts, "ext", "left")
    finding = F.when(F.col("ok"), None).when(F.col("has").isNull(), "cited-extension-absent").when(F.col("path").contains("/"), "not-in-workspace")
    return both.withColumn("finding", finding).where("finding is not null").select("report_id", "path", "finding")


def line_sections(texts: DataFrame, key: str, heading: str = r"^#+\s+") -> DataFrame:
    """(key, section, heading, lines, body): texts(key, text) cut at heading lines outside of fenced blocks; section 0 is what precedes the
    first. Running sums over the lines of one text (Q3, X7, W5)."""
    lines = texts.select(key, F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    w = Window.partitionBy(key).orderBy("pos")
    fence = F.sum(F.col("line").startswith("```").cast("int")).over(w)
    head = F.col("line").rlike(heading) & (F.col("fence") % 2 == 0)
    cut = lines.withColumn("fence", fence).withColumn("head", head).withColumn("section", F.sum(F.col("head").cast("int")).over(w))
    body = F.array_sort(F.collect_list(F.struct("pos", "line")))
    g = cut.groupBy(key, "section").agg(F.max(F.when(F.col("head"), F.regexp_replace("line", heading, ""))).alias("heading"), F.count("*").alias("lines"), body.alias("b"))
    return g.select(key, "section", "heading", "lines", F.array_join(F.transform("b", lambda x: x["line"]), "\n").alias("body"))


def cited_identities(sections: DataFrame, namespaces: DataFrame, key: str) -> DataFrame:
    """(key, section, identity): backticked spans whose part before the first | is a known namespace(namespace)."""
    spans = sections.select(key, "section", F.explode(F.regexp_extract_all("body", F.lit("`([^`\n]+)`"), F.lit(1))).alias("identity"))
    return spans.withColumn("namespace", F.substring_index("identity", "|", 1)).join(namespaces.select("namespace").distinct(), "namespace", "left_semi").select(key, "section", "identity").distinct()


def identity_namespaces(keys: DataFrame) -> DataFrame:
    """(namespace): the part before the first | of keys(key) that have one (Q4)."""
    return keys.where(F.col("key").contains("|")).select(F.substring_index("key", "|", 1).alias("namespace")).distinct()


def resolve_identities(cited: DataFrame, tables: list[DataFrame]) -> DataFrame:
    """The cited(report_id, section, identity) that one of the tables(id) has."""
    known = tables[0].select("id")
    for t in tables[1:]:
        known = known.unionByName(t.select("id"))
    return cited.join(known.distinct().withColumnRenamed("id", "identity"), "identity", "left_semi").select(*cited.columns)


def denominators(files: DataFrame) -> DataFrame:
    """(root_name, disposition, value): every file count the base justifies, by root, disposition, both and none (null stands for all)."""
    return files.cube("root_name", "disposition").agg(F.count("*").alias("value"))


def identity_drift(runs: DataFrame) -> DataFrame:
    """(id, runs): ids of runs(run_id, id) that are in some runs but not in all."""
    total = runs.agg(F.countDistinct("run_id").alias("total"))
    return runs.groupBy("id").agg(F.countDistinct("run_id").alias("runs")).crossJoin(F.broadcast(total)).where("runs <> total").select("id", "runs")


def same_identity_set(a: DataFrame, b: DataFrame) -> bool:
    one, two = a.select("id").distinct(), b.select("id").distinct()
    return one.exceptAll(two).isEmpty() and two.exceptAll(one).isEmpty()


def multi_table_kinds(kinds: DataFrame) -> DataFrame:
    """(kind, tables): kinds(table_name, kind) that more than one table serves."""
    return kinds.groupBy("kind").agg(F.countDistinct("table_name").alias("tables")).where("tables > 1")


def missing_items(required: DataFrame, present: DataFrame) -> DataFrame:
    return required.select("id").distinct().join(present.select("id"), "id", "left_anti")


def grade(truth: DataFrame, facts: DataFrame) -> DataFrame:
    """(verdict, n): each truth(id, kind, path, expects) against facts(kind, path): found or missed where presence is expected, clean or
    contradicted where absence is."""
    hit = truth.join(facts.select("kind", "path").distinct().withColumn("hit", F.lit(True)), ["kind", "path"], "left")
    there = F.col("hit").isNotNull()
    verdict = F.when(F.col("expects") == "present", F.when(there, "found").otherwise("missed")).otherwise(F.when(there, "contradicted").otherwise("clean"))
    return hit.groupBy(verdict.alias("verdict")).agg(F.count("*").alias("n"))


def audit_claims(declared: DataFrame, cited: DataFrame, known: DataFrame) -> DataFrame:
    """(report_id, section, identity, finding): declared ids that the base does not know or that their chapter does not cite, and cited ids that nobody
    declared. declared and cited (report_id, section, identity), known(identity)."""
    key = ["report_id", "section", "identity"]
    d, c = declared.select(*key).distinct(), cited.select(*key).distinct()
    row = lambda df, code: df.select(*key, F.lit(code).alias("finding"))
    unknown = d.join(known.select("identity").distinct(), "identity", "left_anti")
    return row(unknown, "declared-id-unknown").unionByName(row(d.join(c, key, "left_anti"), "declared-not-cited")).unionByName(row(c.join(d, key, "left_anti"), "cited-not-declared"))


def audit_checklist(entries: DataFrame, required: DataFrame, verdicts: tuple[str, ...], known: DataFrame) -> DataFrame:
    """(report_id, item, finding) over entries(report_id, item, verdict, evidence array): required(item) items that are missing, verdicts out of the list, no evidence, and
    evidence ids that known(identity) lacks."""
    wanted = required.select("item").distinct().agg(F.array_sort(F.collect_set("item")).alias("wanted"))  # one row: the items of a checklist
    held = entries.groupBy("report_id").agg(F.collect_set("item").alias("held"))
    missing = held.crossJoin(F.broadcast(wanted)).select("report_id", F.explode(F.array_except("wanted", "held")).alias("item"))
    ids = entries.select("report_id", "item", F.explode("evidence").alias("identity")).join(known.select("identity").distinct(), "identity", "left_anti")
    row = lambda df, code: df.select("report_id", "item", F.lit(code).alias("finding"))
    return (
        row(missing, "item-missing").unionByName(row(entries.where(F.col("verdict").isNull() | ~F.col("verdict").isin(*verdicts)), "unknown-verdict"))
        .unionByName(row(entries.where(F.coalesce(F.size("evidence"), F.lit(0)) < 1), "no-evidence")).unionByName(row(ids.select("report_id", "item").distinct(), "unresolved-id"))
    )


def audit_query_log(log: DataFrame) -> DataFrame:
    """Lines of log(report_id, query) that name snapshot_id without binding it."""
    return log.where(F.col("query").rlike("(?i)snapshot_id") & ~F.col("query").rlike(r"(?i)snapshot_id\s*=\s*(:snapshot|\?)"))


def manifest_disagreements(manifest: DataFrame, base: DataFrame) -> DataFrame:
    """(report_id, field, stated, actual) where manifest(report_id, field, value) and base(field, value) differ, a field missing in the base included."""
    both = manifest.join(base.select("field", F.col("value").alias("actual")), "field", "left")
    return both.where(~F.col("value").eqNullSafe(F.col("actual"))).select("report_id", "field", F.col("value").alias("stated"), "actual")


def explain_audit(findings: DataFrame, notices: tuple[str, ...] = ("uncheckable",), shown: int = 5) -> DataFrame:
    """(report_id, passed, code, n, examples): findings(report_id, code, detail) by code, shown details each; a report passes without one that is no notice."""
    w = Window.partitionBy("report_id", "code").orderBy("detail")
    ranked = findings.withColumn("k", F.row_number().over(w))
    g = ranked.groupBy("report_id", "code").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.when(F.col("k") <= shown, F.col("detail")))).alias("examples"))
    verdict = findings.groupBy("report_id").agg(F.bool_and(F.col("code").isin(*notices)).alias("passed"))
    return g.join(verdict, "report_id").select("report_id", "passed", "code", "n", "examples")


def validate_truth(items: DataFrame) -> DataFrame:
    """(id, reason) of truth rows(id, criticality, must_find, expected_status, claim) that break a rule: unique ids, critical means must-find, clean absence means that absence is
    expected, and a claim."""
    row = lambda df, why: df.select("id", F.lit(why).alias("reason"))
    return (
        row(items.groupBy("id").agg(F.count("*").alias("n")).where("n > 1"), "id is not unique")
        .unionByName(row(items.where("criticality = 'critical' and not coalesce(must_find, false)"), "critical but not must-find"))
        .unionByName(row(items.where("expected_status = 'clean-absence' and coalesce(must_find, false)"), "absence cannot be must-find"))
        .unionByName(row(items.where("coalesce(trim(claim), '') = ''"), "no claim"))
    )
