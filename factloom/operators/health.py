"""Findings about structure and logic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import subject_key

# Words that a counter may end in and that name no subject.
CLASSIFIER_KEYS = ("count", "row", "rows", "index", "size", "length", "total", "num", "number", "value", "id", "code", "type", "flag", "state")


def percent(part: Column, whole: Column) -> Column:
    """Half-up; 0 of nothing is 0."""
    return F.when(whole == 0, 0).otherwise(F.floor(100 * part / whole + 0.5)).cast("long")


def common_table_prefix(names: DataFrame) -> DataFrame:
    """One row (prefix): the leading token with its separator that at least 60 % of four or more names(name) share, or null."""
    n = names.select(F.nullif(F.regexp_extract(F.lower("name"), "^([a-z0-9]+[_-])", 1), F.lit("")).alias("prefix"))
    top = n.groupBy("prefix").agg(F.count("*").alias("n"))
    total = top.agg(F.sum("n").alias("total"), F.max(F.when(F.col("prefix").isNotNull(), F.struct("n", "prefix"))).alias("t"))
    return total.select(F.when((F.col("total") >= 4) & (F.col("t.n") >= 0.6 * F.col("total")), F.col("t.prefix")).alias("prefix"))


# Fixed values, worst first.
SEVERITIES = ("concern", "notice", "info")


def severity_rank(severity: Column) -> Column:
    """0 for the worst; unknown ones come last (O1)."""
    place = F.array_position(F.array(*map(F.lit, SEVERITIES)), severity)
    return F.when(place > 0, place - 1).otherwise(len(SEVERITIES)).cast("int")


def named_findings(findings: DataFrame, most: int = 8) -> DataFrame:
    """(code, severity, place, named, text) of findings(code, severity, name): per code the first most names and how many more there are, codes by
    severity, then name (D10, O1)."""
    total = findings.groupBy("code", "severity").agg(F.count("*").alias("n"))
    first = F.row_number().over(Window.partitionBy("code", "severity").orderBy("name"))
    named = findings.withColumn("k", first).where(F.col("k") <= most).groupBy("code", "severity").agg(F.array_sort(F.collect_list("name")).alias("named"))
    more = F.when(F.col("n") > most, F.concat(F.lit(" and "), (F.col("n") - most).cast("string"), F.lit(" more"))).otherwise("")
    place = F.row_number().over(Window.orderBy(severity_rank(F.col("severity")), "code")).cast("long")  # one row a code and severity
    return total.join(named, ["code", "severity"]).select("code", "severity", place.alias("place"), "named", F.concat(F.array_join("named", ", "), more).alias("text"))


def ownership_findings(access: DataFrame) -> DataFrame:
    """(code, entity, roots): entities written by several roots, and those read by roots that do not write them while others do;
    an unknown operation is neither. access(root_name, entity, operation)."""
    g = access.groupBy("entity").agg(F.collect_set(F.when(F.col("operation") == "write", F.col("root_name"))).alias("w"), F.collect_set(F.when(F.col("operation") == "read", F.col("root_name"))).alias("r"))
    several = F.when(F.size("w") > 1, F.struct(F.lit("written-by-several").alias("code"), F.array_sort("w").alias("roots")))
    readers = F.array_except("r", "w")
    foreign = F.when((F.size("w") > 0) & (F.size(readers) > 0), F.struct(F.lit("read-by-non-owner").alias("code"), F.array_sort(readers).alias("roots")))
    return g.select("entity", F.explode(F.array_compact(F.array(several, foreign))).alias("f")).select("f.code", "entity", "f.roots")


def undetermined_operations(access: DataFrame) -> DataFrame:
    return access.groupBy("root_name").agg(F.count_if(F.col("operation") == "unknown").alias("undetermined"), F.count("*").alias("total"))


def served_twice(routes: DataFrame, normalized: Column) -> DataFrame:
    """(method, path, roots) of endpoints that more than one root serves."""
    g = routes.groupBy("method", normalized.alias("path")).agg(F.array_sort(F.collect_set("root_name")).alias("roots"))
    return g.where(F.size("roots") > 1)


def shape_disagreements(fields: DataFrame) -> DataFrame:
    """(entity, shapes): entities that roots declare with different column sets. fields(root_name, entity, name)."""
    per = fields.groupBy("entity", "root_name").agg(F.array_join(F.array_sort(F.collect_set("name")), ",").alias("shape"))
    return per.groupBy("entity").agg(F.countDistinct("shape").alias("shapes"), F.count("*").alias("roots")).where("shapes > 1")


def find_divergence(rules: DataFrame) -> DataFrame:
    """(subject_key, literal, root_name, operator, rule_id): one variant per root and operator where roots that each use one operator
    draw one boundary differently (> against >=, < against <=). rules(rule_id, root_name, subject, operator, literal)."""
    keyed = rules.withColumn("subject_key", subject_key(F.col("subject"))).where(~F.col("subject_key").isin(*CLASSIFIER_KEYS))
    roots = keyed.groupBy("subject_key", "literal", "root_name").agg(F.collect_set("operator").alias("ops"), F.min("rule_id").alias("rule_id")).where(F.size("ops") == 1)
    g = roots.withColumn("operator", F.col("ops")[0]).groupBy("subject_key", "literal").agg(F.collect_set("operator").alias("ops"), F.collect_list(F.struct("root_name", "operator", "rule_id")).alias("variants"))
    side = lambda *ops: F.size(F.array_except("ops", F.array(*map(F.lit, ops)))) == 0
    split = g.where((F.size("ops") >= 2) & (side(">", ">=") | side("<", "<=")))
    return split.select("subject_key", "literal", F.explode("variants").alias("v")).select("subject_key", "literal", "v.*")


def repeated_rules(rules: DataFrame, least: int = 3) -> DataFrame:
    """(subject_key, operator, literal, places, roots) of rules written at least so often."""
    g = rules.groupBy(subject_key(F.col("subject")).alias("subject_key"), "operator", "literal").agg(F.count("*").alias("places"), F.countDistinct("root_name").alias("roots"))
    return g.where(F.col("places") >= least)


def top_per_group(df: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group, and how many more there are."""
    w = Window.partitionBy(*group)
    ranked = df.withColumn("place", F.row_number().over(w.orderBy(*order))).withColumn("more", F.greatest(F.count("*").over(w) - k, F.lit(0)))
    return ranked.where(F.col("place") <= k)


def content_digests(files: DataFrame, digits: int = 3) -> DataFrame:
    """(root_name, digest, files): the digest of the digests of a root's ranges, in order. A file's range is the first so many hex digits of its path's
    SHA-256; a range's digest is over its sorted (path, content digest). So no task holds more than a range, or 16 ** digits digests of one root."""
    each = files.select("root_name", F.substring(F.sha2(F.coalesce("rel_path", F.lit("")), 256), 1, digits).alias("range"), F.struct("rel_path", F.sha2(F.coalesce("content", F.lit("")), 256).alias("d")).alias("f"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("f")), lambda f: F.concat_ws(":", f["rel_path"], f["d"])), "\n")
    parts = each.groupBy("root_name", "range").agg(F.sha2(joined, 256).alias("d"), F.count("*").alias("files"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("range", "d"))), lambda p: p["d"]), "\n")
    return parts.groupBy("root_name").agg(F.sha2(whole, 256).alias("digest"), F.sum("files").alias("files"))


def check_drift(before: DataFrame, after: DataFrame) -> DataFrame:
    """Roots whose digest changed, appeared or went."""
    b = before.select("root_name", F.col("digest").alias("was"))
    both = b.join(after.select("root_name", F.col("digest").alias("now")), "root_name", "full")
    return both.where(~F.col("was").eqNullSafe(F.col("now")))


def inventory_counts(files: DataFrame) -> DataFrame:
    """Counts by root and disposition with subtotals; null stands for all."""
    return files.rollup("root_name", "disposition").agg(F.count("*").alias("files"))


def evaluate_gates(gates: DataFrame, metrics: DataFrame) -> DataFrame:
    """(gate, passed, failing): every threshold met; a missing metric fails. gates(gate, metric, least), metrics(metric, value)."""
    met = F.coalesce(F.col("value") >= F.col("least"), F.lit(False))
    return gates.join(metrics, "metric", "left").groupBy("gate").agg(F.bool_and(met).alias("passed"), F.array_sort(F.collect_list(F.when(~met, F.col("metric")))).alias("failing"))
