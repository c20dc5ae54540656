"""The base at rest: Parquet by snapshot and kind, visible once published."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

RECORDS, SNAPSHOTS = "structural_records", "snapshots"


def write_facts(records: DataFrame, base: str, snapshot_id: str, lifted: tuple[str, ...] = ("root_name", "rel_path")) -> None:
    """Append merged records(kind, record_key, ...) of one snapshot: the lifted columns beside a JSON payload of all others, one row per (kind, key)."""
    rest = [c for c in records.columns if c not in ("kind", "record_key")]
    payload = F.to_json(F.struct(*sorted(rest)), {"ignoreNullFields": "false"})
    up = [F.col(c).cast("string").alias(c) if c in records.columns else F.lit(None).cast("string").alias(c) for c in lifted]
    one = records.select(F.lit(snapshot_id).alias("snapshot_id"), "kind", "record_key", *up, payload.alias("payload")).dropDuplicates(["kind", "record_key"])
    one.write.mode("append").partitionBy("snapshot_id", "kind").parquet(f"{base}/{RECORDS}")


def write_derived(records: DataFrame, base: str, snapshot_id: str, table: str = "derived_records") -> dict[str, int]:
    """Replace the snapshot's derived records(kind, record_key, ordinal, payload); of one key the last stays. Returns counts: replaced above 0 means
    that keys collide."""
    last = records.groupBy("kind", "record_key").agg(F.max_by("payload", "ordinal").alias("payload"), F.count("*").alias("n"))
    counts = last.agg(F.count("*").alias("inserted"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("replaced")).first().asDict()
    out = last.select(F.lit(snapshot_id).alias("snapshot_id"), "kind", "record_key", "payload")
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("snapshot_id", "kind").parquet(f"{base}/{table}")
    return counts


def write_links(links: DataFrame, base: str, snapshot_id: str, table: str = "ownership_links") -> int:
    """Adds the links(from_id, to_id, role) that the snapshot does not have yet and returns how many those are: an anti join on its partition alone. Written twice nothing changes; a write that
    failed half-way leaves nothing, since files of an append are seen when its job commits."""
    spark, at = links.sparkSession, f"{base}/{table}"
    new, held = links.select("from_id", "to_id", "role").distinct(), 0
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    live = lambda: spark.read.parquet(at).where(F.col("snapshot_id") == snapshot_id).drop("snapshot_id")
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        held = live().count()
        new = new.alias("n").join(live().alias("t"), F.expr("n.from_id <=> t.from_id and n.to_id <=> t.to_id and n.role <=> t.role"), "left_anti")
    new.withColumn("snapshot_id", F.lit(snapshot_id)).write.mode("append").partitionBy("snapshot_id").parquet(at)
    return live().count() - held


def write_behavior(facts: DataFrame, relations: DataFrame, base: str, snapshot_id: str, max_facts: int = 200_000, max_relations: int = 1_000_000, violations: DataFrame | None = None) -> None:
    """Replace the snapshot's behaviour model; over the bounds nothing is written, nor with violations(fact_id, reason) other than quarantines; facts that have one of
    these are flagged quarantined."""
    if violations is not None:
        held = violations.where(F.col("reason").startswith("quarantined"))
        if not violations.where(~F.col("reason").startswith("quarantined")).isEmpty():
            raise ValueError("the behaviour model is not valid")
        facts = facts.join(held.select("fact_id", F.lit(True).alias("quarantined")).distinct(), "fact_id", "left").withColumn("quarantined", F.coalesce("quarantined", F.lit(False)))
    if facts.limit(max_facts + 1).count() > max_facts or relations.limit(max_relations + 1).count() > max_relations:
        raise ValueError("the behaviour model exceeds its bounds")
    for df, name in ((facts, "behavior_facts"), (relations, "behavior_relations")):
        df.withColumn("snapshot_id", F.lit(snapshot_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("snapshot_id").parquet(f"{base}/{name}")


def publish(spark: SparkSession, base: str, snapshot_id: str, workspace: str, published_at: str, drift: DataFrame) -> bool:
    """Make a snapshot visible by one row, unless drift (roots changed meanwhile) has any."""
    if not drift.isEmpty():
        return False
    row = spark.createDataFrame([(snapshot_id, workspace, published_at)], "snapshot_id string, workspace string, published_at string")
    row.write.mode("append").parquet(f"{base}/{SNAPSHOTS}")
    return True


def latest_snapshots(snapshots: DataFrame) -> DataFrame:
    """(workspace, snapshot_id): the latest published of each, by id among equals."""
    return snapshots.where("published_at is not null").groupBy("workspace").agg(F.max_by("snapshot_id", F.struct("published_at", "snapshot_id")).alias("snapshot_id"))


def resolve_snapshot(snapshots: DataFrame, workspace: str | None = None) -> str:
    """The latest published snapshot of the workspace; without a name there must be one workspace only."""
    found = latest_snapshots(snapshots if workspace is None else snapshots.where(F.col("workspace") == workspace)).limit(2).collect()
    if len(found) != 1:
        raise LookupError("no published snapshot" if not found else "several workspaces: name one")
    return found[0].snapshot_id


def read_records(spark: SparkSession, base: str, snapshot_id: str, kind: str, schema: StructType | str) -> DataFrame:
    """One kind of one snapshot, typed; partitions of others are not read."""
    r = spark.read.parquet(f"{base}/{RECORDS}").where((F.col("snapshot_id") == snapshot_id) & (F.col("kind") == kind))
    return r.select("record_key", F.from_json("payload", schema).alias("p")).select("record_key", "p.*")


def read_derived(spark: SparkSession, base: str, snapshot_id: str, kind: str, schema: StructType | str, table: str = "derived_records", keys: DataFrame | None = None) -> DataFrame:
    """One kind of the derived records of a snapshot, typed; of keys(record_key) alone if given."""
    r = spark.read.parquet(f"{base}/{table}").where((F.col("snapshot_id") == snapshot_id) & (F.col("kind") == kind))
    r = r if keys is None else r.join(keys.select("record_key").distinct(), "record_key", "left_semi")
    return r.select("record_key", F.from_json("payload", schema).alias("p")).select("record_key", "p.*")


def read_behavior(spark: SparkSession, base: str, snapshot_id: str) -> tuple[DataFrame, DataFrame]:
    """(facts, relations) of a snapshot's behaviour model."""
    one = lambda name: spark.read.parquet(f"{base}/{name}").where(F.col("snapshot_id") == snapshot_id).drop("snapshot_id")
    return one("behavior_facts"), one("behavior_relations")


def scoped_views(spark: SparkSession, base: str, snapshot_id: str, tables: tuple[str, ...], children: dict[str, tuple[str, str]]) -> dict[str, DataFrame]:
    """Each table with the snapshot's rows alone. children(name -> (parent, key)) have no snapshot_id and take the scope of their parent's rows, over any number of parents; one whose parents
    lead to no scoped table, or in a circle, is an error, for it could only be read unscoped."""
    views = {t: spark.read.parquet(f"{base}/{t}").where(F.col("snapshot_id") == snapshot_id) for t in tables}
    left = dict(children)
    while ready := [n for n, (parent, _) in left.items() if parent in views]:
        for name in ready:
            parent, key = left.pop(name)
            views[name] = spark.read.parquet(f"{base}/{name}").join(views[parent].select(key).distinct(), key, "left_semi")
    if left:
        raise ValueError(f"no snapshot scopes {', '.join(sorted(left))}")
    return views


def kb_sql(spark: SparkSession, base: str, snapshot_id: str, text: str, tables: tuple[str, ...] = (RECORDS,), children: dict[str, tuple[str, str]] | None = None, log: str | None = None) -> DataFrame:
    """A SELECT over scoped_views, so an unscoped read cannot be written. log names a table of the base to which the query is appended before it runs, as audit_query_log reads it; what is refused is
    not logged."""
    if not text.lstrip().lower().startswith(("select", "with")):
        raise ValueError("SELECT or WITH only")
    views = scoped_views(spark, base, snapshot_id, tables, children or {})
    out = spark.sql("WITH " + ", ".join(f"{n} AS (SELECT * FROM {{v_{n}}})" for n in views) + f" SELECT * FROM ({text})", **{f"v_{n}": v for n, v in views.items()})
    if log:
        spark.range(1).select(F.current_timestamp().alias("asked_at"), F.lit(snapshot_id).alias("report_id"), F.lit(text).alias("query")).write.mode("append").parquet(f"{base}/{log}")
    return out


def migrate_facts(facts: DataFrame, steps: dict[int, Callable[[DataFrame], DataFrame]], start: int, target: int) -> DataFrame:
    """facts(fact_id, evidence, ...) taken from version start to target by the steps; identity and evidence must stay, a missing step is an error."""
    out = facts
    for v in range(start, target):
        if v not in steps:
            raise LookupError(f"no way from version {v}")
        out = steps[v](out)
    digest = lambda df: df.select("fact_id", F.sha2(F.to_json(F.struct("evidence")), 256).alias("d"))
    if not digest(facts).exceptAll(digest(out)).isEmpty() or not digest(out).exceptAll(digest(facts)).isEmpty():
        raise ValueError("a migration changed identities or evidence")
    return out


def read_conflicts(records: DataFrame) -> DataFrame:
    """(kind, key, field, value, providers): what merged records(kind, key, conflicts) disagree on."""
    return records.select("kind", "key", F.explode("conflicts").alias("c")).select("kind", "key", "c.*")


def read_evidence_conflicts(evidence: DataFrame) -> DataFrame:
    """(key, text, other): what merged evidence(key, text, conflicts array) was told otherwise."""
    return evidence.select("key", "text", F.explode("conflicts").alias("other"))


def read_capability_results(capabilities: DataFrame, provider_id: str | None = None) -> DataFrame:
    """capabilities(provider_id, kind, outcome, records), of one provider if named, in the order of provider and kind."""
    out = capabilities if provider_id is None else capabilities.where(F.col("provider_id") == provider_id)
    return out.orderBy("provider_id", "kind")


def was_attempted(capabilities: DataFrame, kind: str) -> bool:
    """Whether any provider was asked for the kind at all."""
    return not capabilities.where(F.col("kind") == kind).isEmpty()


def read_links(links: DataFrame, from_id: str | None = None, to_id: str | None = None, role: str | None = None) -> DataFrame:
    """Ownership edges links(from_id, to_id, role) from or to a record, of one role if named."""
    out = links
    for c, v in (("from_id", from_id), ("to_id", to_id), ("role", role)):
        out = out if v is None else out.where(F.col(c) == v)
    return out
