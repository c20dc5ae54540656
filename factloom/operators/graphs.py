"""Bounded traversals and cycle checks as loops of joins (G1 to G4, G7 to G9). Each level is written out once (plans stay short) and
read again with those before it."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_own_dir: str | None = None


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where a session of one machine names none, a temporary one that ends with the process; on a cluster
    that is an error."""
    global _own_dir
    if folder := spark.sparkContext.getConf().get("spark.checkpoint.dir"):
        return folder.rstrip("/")
    if not re.fullmatch(r"local(\[[^,]*(,[^,]*)?\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="spark-factloom-")
        atexit.register(shutil.rmtree, _own_dir, ignore_errors=True)
    return f"file://{_own_dir}"


def cut(df: DataFrame) -> DataFrame:
    """df written as Parquet into the shared folder and read back."""
    path = f"{shared_folder(df.sparkSession)}/level-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes what cut() wrote, once nothing reads it any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.cut_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def build_traces(entries: DataFrame, symbols: DataFrame, edges: DataFrame, max_depth: int = 12, max_steps: int = 200, max_branches: int = 16, origins: bool = False) -> DataFrame:
    """(entry_id, steps array of struct(pos, node, depth), truncation, detail, partial) of a breadth-first walk from each entry(entry_id, node).

    Level by level: order is (position of the parent, edge_ord), a node is taken once per entry, and one row per (entry, node) crosses
    each join. A node at max_depth or with over max_branches edges is a step but not expanded; past max_steps the walk stops. An edge back to an ancestor is
    a cycle, a null callee unresolved-edge; a callee that is no symbol is skipped. The last max- event decides the truncation, else
    the first cycle or unresolved edge, else completed; detail names the node where that happened, partial is every truncation but completed.
    With origins a step also has origin and edge_ord, the node and edge by which it was reached first. edges(caller_id, callee_id, edge_ord), symbols(id)."""
    came = ["origin", "edge_ord"] if origins else []
    known = symbols.select(F.col("id").alias("callee_id")).distinct().withColumn("known", F.lit(True))
    edges = cut(edges.select("caller_id", "callee_id", "edge_ord").join(known, "callee_id", "left"))
    degree = cut(edges.groupBy(F.col("caller_id").alias("node")).agg(F.count("*").alias("degree")))

    def bounded(level: DataFrame, depth: int) -> DataFrame:
        """The level with the bound that stops a row, written once; the last level needs no degrees."""
        here = level.withColumn("degree", F.lit(0)) if depth == max_depth else level.join(degree, "node", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
        bound = F.when(F.col("pos") >= max_steps - 1, "max-steps").when(F.lit(depth == max_depth), "max-depth").when(F.col("degree") > max_branches, "max-branches")
        return cut(here.withColumn("bound", bound).drop("degree"))

    first = entries.select("entry_id", "node", F.lit(0).cast("long").alias("pos"), F.lit(0).alias("depth"), F.array("node").alias("path"), *(F.lit(None).cast(edges.schema[c].dataType).alias(o) for c, o in zip(("caller_id", "edge_ord"), came)))
    here = bounded(first, 0)
    levels, events = [here], []
    for depth in range(max_depth + 1):
        events.append(here.where((F.col("pos") < max_steps) & F.col("bound").isNotNull()).select("entry_id", F.lit(0).alias("rank"), "pos", F.lit(0).cast("long").alias("edge_ord"), F.col("bound").alias("what"), F.col("node").alias("where")))
        if depth == max_depth:
            break
        ended = here.where("bound = 'max-steps'").select("entry_id")
        out = here.where("bound is null").join(ended, "entry_id", "left_anti").drop("bound", "depth", *came).withColumnRenamed("node", "caller_id").join(edges, "caller_id")
        visited = union([t.select("entry_id", F.col("node").alias("callee_id"), F.lit(True).alias("seen")) for t in levels])
        out = out.join(visited, ["entry_id", "callee_id"], "left")
        nth = F.row_number().over(Window.partitionBy("entry_id", "callee_id").orderBy("pos", "edge_ord"))
        out = out.withColumn("nth", F.when(F.col("known") & F.col("seen").isNull(), nth))
        what = F.when(F.col("callee_id").isNull(), "unresolved-edge").when(F.col("known") & (F.col("nth").isNull() | (F.col("nth") > 1)) & F.array_contains("path", F.col("callee_id")), "cycle")
        path = F.concat("path", F.array("callee_id")) if depth + 1 < max_depth else F.lit(None).cast("array<string>")  # nothing follows the last level
        out = cut(out.withColumn("what", what).where("nth = 1 or what is not null").select("entry_id", "caller_id", "callee_id", "pos", "edge_ord", F.when(F.col("nth") == 1, path).alias("path"), "what", "nth"))
        events.append(out.where("what is not null").select("entry_id", F.lit(1).alias("rank"), "pos", "edge_ord", "what", F.col("caller_id").alias("where")))
        total = here.groupBy("entry_id").agg((F.max("pos") + 1).alias("total"))  # positions have no gaps
        place = F.row_number().over(Window.partitionBy("entry_id").orderBy("pos", "edge_ord")) - 1 + F.col("total")
        taken = out.where("nth = 1").join(total, "entry_id")
        here = bounded(taken.select("entry_id", F.col("callee_id").alias("node"), place.cast("long").alias("pos"), F.lit(depth + 1).alias("depth"), "path", *(F.col(c).alias(o) for c, o in zip(("caller_id", "edge_ord"), came))), depth + 1)
        if here.isEmpty():
            break
        levels.append(here)
    hard = F.max(F.when(F.col("rank") == 0, F.struct("pos", "what", "where")))
    soft = F.min(F.when(F.col("rank") == 1, F.struct("pos", "edge_ord", "what", "where")))
    verdict = union(events).groupBy("entry_id").agg(hard.alias("h"), soft.alias("s")).select("entry_id", F.coalesce("h.what", "s.what").alias("truncation"), F.coalesce("h.where", "s.where").alias("detail"))
    steps = union([t.select("entry_id", "node", "pos", "depth", *came) for t in levels])
    made = steps.where(F.col("pos") < max_steps).groupBy("entry_id").agg(F.array_sort(F.collect_list(F.struct("pos", "node", "depth", *came))).alias("steps"))
    ended = F.coalesce("truncation", F.lit("completed"))
    return made.join(verdict, "entry_id", "left").select("entry_id", "steps", ended.alias("truncation"), "detail", (ended != "completed").alias("partial"))


def entry_traces(entries: DataFrame, symbols: DataFrame, edges: DataFrame, **bounds: int) -> tuple[DataFrame, DataFrame]:
    """(steps, traceability) of walks over calls and type relations together (G3): edges(caller_id, callee_id, edge_ord, edge_kind, resolution, rel_path, line), entries(entry_id,
    node, class).

    steps(entry_id, pos, node, depth, origin, edge_kind, resolution, rel_path, line, truncation, detail): each step with the edge by which the walk came to it first, so that a path can be read
    back. traceability is one row: the entries, those of each class, those that led anywhere, and their share of all."""
    walked = build_traces(entries, symbols, edges, origins=True, **bounds)
    steps = walked.select("entry_id", "truncation", "detail", F.explode("steps").alias("s")).select("entry_id", "s.*", "truncation", "detail")
    facts = edges.select(F.col("caller_id").alias("origin"), F.col("callee_id").alias("node"), "edge_ord", "edge_kind", "resolution", "rel_path", "line").dropDuplicates(["origin", "node", "edge_ord"])
    steps = steps.join(facts, ["origin", "node", "edge_ord"], "left").select("entry_id", "pos", "node", "depth", "origin", "edge_kind", "resolution", "rel_path", "line", "truncation", "detail")
    both = entries.select("entry_id", "class").join(walked.select("entry_id", (F.size("steps") > 1).alias("led")), "entry_id", "left")
    of = lambda c: F.count_if(F.col("class") == c)
    total = both.agg(F.count("*").alias("total"), of("precise").alias("precise"), of("candidate").alias("candidate"), of("structure-root").alias("structure_root"), F.count_if("led").alias("reachable"))
    return steps, total.withColumn("rate", F.when(F.col("total") > 0, F.col("reachable") / F.col("total")).otherwise(0.0))


def read_back(steps: DataFrame, targets: DataFrame) -> DataFrame:
    """(entry_id, node, path array): how the walks came to targets(entry_id, node), from the entry on, by the origins of steps; one join a level."""
    deepest = steps.agg(F.max("depth")).first()[0] or 0
    at = steps.select("entry_id", F.col("node").alias("here"), "origin")
    out = targets.select("entry_id", "node", F.col("node").alias("here"), F.array("node").alias("path")).join(at, ["entry_id", "here"])
    for _ in range(deepest):
        above = at.select("entry_id", F.col("here").alias("origin"), F.col("origin").alias("next"))
        out = out.join(above, ["entry_id", "origin"], "left").select("entry_id", "node", F.when(F.col("origin").isNotNull(), F.concat(F.array("origin"), "path")).otherwise(F.col("path")).alias("path"), F.when(F.col("origin").isNotNull(), F.col("next")).alias("origin"))
    return out.select("entry_id", "node", "path")


def untraced_entries(routes: DataFrame, symbols: DataFrame) -> DataFrame:
    """(entry_id, reason): routes(entry_id, handler_id) without a handler, or whose handler is no symbol(id)."""
    known = symbols.select(F.col("id").alias("handler_id"), F.lit(True).alias("known")).distinct()
    reason = F.when(F.col("handler_id").isNull(), "no handler is linked").when(F.col("known").isNull(), "the handler is no known symbol")
    return routes.join(known, "handler_id", "left").select("entry_id", reason.alias("reason")).where("reason is not null")


def identify_entries(handlers: DataFrame, symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, class): precise for route handlers(id), candidate for public callables, structure-root for callables never called;
    the first that fits. symbols(id, kind, visibility)."""
    callable_ = symbols.where(F.col("kind").isin("function", "method"))
    called = edges.where("callee_id is not null").select(F.col("callee_id").alias("id"))
    every = (
        handlers.select("id", F.lit(0).alias("rank"))
        .unionByName(callable_.where("visibility = 'public'").select("id", F.lit(1).alias("rank")))
        .unionByName(callable_.join(called, "id", "left_anti").select("id", F.lit(2).alias("rank")))
    )
    kinds = F.array(F.lit("precise"), F.lit("candidate"), F.lit("structure-root"))
    return every.groupBy("id").agg(F.min("rank").alias("rank")).select("id", kinds[F.col("rank")].alias("class"))


def reverse_reach(sinks: DataFrame, edges: DataFrame, max_hops: int = 2, max_fan_in: int = 32) -> DataFrame:
    """(sink, node, hops, hub): callers within max_hops of each sink(sink, node), the least hop each; a node with over max_fan_in callers is
    reached but not expanded."""
    back = cut(edges.where("callee_id is not null").select(F.col("callee_id").alias("node"), F.col("caller_id").alias("caller")).distinct())
    hubs = cut(back.groupBy("node").agg(F.count("*").alias("callers")).where(F.col("callers") > max_fan_in).select("node"))
    level = cut(sinks.select("sink", "node", F.lit(0).alias("hops")).distinct())
    levels = [level]
    for hop in range(1, max_hops + 1):
        small = level.join(hubs, "node", "left_anti")
        reached = union([t.select("sink", "node") for t in levels])
        level = cut(small.join(back, "node").select("sink", F.col("caller").alias("node"), F.lit(hop).alias("hops")).distinct().join(reached, ["sink", "node"], "left_anti"))
        levels.append(level)
    return union(levels).join(hubs.withColumn("hub", F.lit(True)), "node", "left").select("sink", "node", "hops", F.coalesce("hub", F.lit(False)).alias("hub"))


def channel_notes(reached: DataFrame, channels: DataFrame, max_hops: int = 2) -> DataFrame:
    """(node, channel, label, confidence, note) of reverse_reach(): the sink's own node keeps its channel, nodes that reach it get unknown with
    reaches:<channel>, all at low confidence; note says where a bound stopped the walk. channels(sink, channel)."""
    own = F.col("hops") == 0
    note = F.when(F.col("hub"), "fan-in bound: callers not followed").when(F.col("hops") == max_hops, "hop bound: callers not followed")
    return reached.join(channels, "sink").select("node", F.when(own, F.col("channel")).otherwise("unknown").alias("channel"), F.when(~own, F.concat(F.lit("reaches:"), "channel")).alias("label"), F.lit("low").alias("confidence"), note.alias("note")).distinct()


def root_cycles(links: DataFrame, longest: int = 6) -> DataFrame:
    """(cycle): simple cycles of at most longest roots in links(from_root, to_root), each once, from its least root on. Paths start at
    their least root, so no rotation is ever built."""
    e = links.where("from_root <> to_root").select("from_root", "to_root").distinct()
    path = e.where("from_root < to_root").select(F.array("from_root", "to_root").alias("path"), F.col("to_root").alias("last"))
    found = None
    for n in range(2, longest + 1):
        step = path.join(e, path["last"] == e["from_root"]).select("path", "to_root")
        closed = step.where(F.col("to_root") == F.col("path")[0]).select(F.col("path").alias("cycle"))
        found = closed if found is None else found.unionByName(closed)
        if n < longest:
            path = cut(step.where((F.col("to_root") > F.col("path")[0]) & ~F.array_contains("path", F.col("to_root"))).select(F.concat("path", F.array("to_root")).alias("path"), F.col("to_root").alias("last")))
    return found


def cyclic_part(edges: DataFrame) -> DataFrame:
    """What is left of edges(src, dst) when nodes that lead nowhere and nodes that nothing leads to are pruned until none is: the cycles and
    what lies between them, empty iff there is none."""
    e, before = cut(edges.select("src", "dst").distinct()), -1
    while (n := e.count()) != before:
        before, old = n, e
        led = e.select(F.col("src").alias("dst")).distinct()
        back = e.select(F.col("dst").alias("src")).distinct()
        e = cut(e.join(led, "dst", "left_semi").join(back, "src", "left_semi").select("src", "dst"))
        discard(old)
    return e


def _spread(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """labels(node, label) raised along edges(src, dst) to the greatest label that reaches each node."""
    while True:
        sent = labels.join(edges, labels["node"] == edges["src"]).select(F.col("dst").alias("node"), "label")
        new = cut(labels.unionByName(sent).groupBy("node").agg(F.max("label").alias("label")))
        same = new.join(labels.withColumnRenamed("label", "was"), "node").where("label <> was").isEmpty()
        if same:
            return new
        labels = new


def nodes_on_cycles(edges: DataFrame) -> DataFrame:
    """(node): the nodes of edges(src, dst) that lie on a cycle, in strongly connected parts of several nodes or on a loop. Forward labels
    (the greatest node that reaches a node) colour the graph; inside a colour, what leads back to its own name is one part, which goes; and again."""
    loops = edges.where("src = dst").select(F.col("src").alias("node"))
    parts = [cut(loops.distinct())]
    e = cyclic_part(edges.where("src <> dst"))
    while not e.isEmpty():
        nodes = cut(e.select(F.explode(F.array("src", "dst")).alias("node")).distinct())
        colour = _spread(nodes.withColumn("label", F.col("node")), e)
        inside = e.join(colour.select(F.col("node").alias("src"), F.col("label").alias("a")), "src").join(colour.select(F.col("node").alias("dst"), F.col("label").alias("b")), "dst").where("a = b")
        inside = cut(inside.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("a").alias("label")))
        found = level = cut(colour.where("node = label").select("node", "label"))
        while not level.isEmpty():
            step = level.join(inside.withColumnRenamed("label", "l"), (F.col("node") == F.col("src")) & (F.col("label") == F.col("l"))).select(F.col("dst").alias("node"), "label").distinct()
            level = cut(step.join(found, ["node", "label"], "left_anti"))
            found = cut(found.unionByName(level))
        several = found.groupBy("label").agg(F.count("*").alias("n")).where("n > 1").select("label")
        parts.append(cut(found.join(several, "label", "left_semi").select("node")))
        gone = found.select("node")
        left = e.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti")
        e = cyclic_part(left.select("src", "dst"))
    return union(parts).distinct()


def transitive_scope(scoped: DataFrame, references: DataFrame) -> DataFrame:
    """(name): the tables of scoped(name) and all that reach them over references(child, parent)."""
    references = cut(references.select("child", "parent").where("parent is not null"))  # each level is made distinct, so repeated ones do no harm
    level = cut(scoped.select("name").distinct())
    levels = [level]
    while True:
        more = references.join(level.withColumnRenamed("name", "parent"), "parent", "left_semi").select(F.col("child").alias("name")).distinct()
        level = cut(more.join(union(levels), "name", "left_anti"))
        if level.isEmpty():
            return union(levels)
        levels.append(level)
