"""Consolidating routes that several readers state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import trim_slashes


def consolidate_routes(routes: DataFrame) -> DataFrame:
    """routes(route_id, root_name, rel_path, start_line, method, path, class, providers, verb_use) without those that another already is, with attributions united and
    the absorbed paths as conflicts; rows with verb_use (a mount of middleware, not an endpoint) go with a reason.

    An inferred route is absorbed by a direct one of its root and file whose path ends with it and whose method agrees or is missing on either side: at the same line
    any path, elsewhere in the file any but the bare /. The first direct one by (line, path, id) wins; direct ones never fold. The least direct route is
    kept for each end of a path, and an inferred route looks up its own: never inferred x direct."""
    plain = routes.where(~F.col("verb_use")).withColumn("p", trim_slashes(F.col("path")))
    weak = plain.where("class = 'inferred'")
    row = ["root_name", "rel_path", "start_line"]
    strong = plain.where("class <> 'inferred'").groupBy(*row, F.upper("method").alias("m"), "p").agg(F.min("route_id").alias("id"))
    # a method meets itself, a missing one and any: direct routes are filed under the first two, inferred ones look where they may
    own = F.coalesce(F.concat(F.lit("="), "m"), F.lit("-"))
    strong = strong.select(*row, F.explode(F.array(own, F.lit("*"))).alias("m"), "p", F.struct(F.col("start_line").alias("line"), "p", "id").alias("d"))
    ends = F.transform(F.sequence(F.lit(1), F.length("p")), lambda i: F.col("p").substr(i, F.length("p")))
    near = strong.select(*row, "m", F.explode(F.array_distinct(F.concat(F.coalesce(ends, F.array().cast("array<string>")), F.array(F.lit("/"))))).alias("end"), "d").groupBy(*row, "m", "end").agg(F.min("d").alias("d"))
    far = near.where("end <> '/'").groupBy("root_name", "rel_path", "m", "end").agg(F.min("d").alias("d"))
    asked = weak.select("route_id", *row, F.explode(F.when(F.col("method").isNull(), F.array(F.lit("*"))).otherwise(F.array(F.concat(F.lit("="), F.upper("method")), F.lit("-")))).alias("m"), F.col("p").alias("end"))
    same = asked.join(near, [*row, "m", "end"]).select("route_id", F.lit(False).alias("far"), "d")
    else_ = asked.join(far, ["root_name", "rel_path", "m", "end"]).select("route_id", F.when(F.col("start_line").isNotNull() & F.col("d.line").isNotNull(), True).alias("far"), "d")
    winner = same.unionByName(else_).groupBy("route_id").agg(F.min(F.struct("far", "d"))["d"]["id"].alias("into"))
    folded = weak.join(winner, "route_id").groupBy("into").agg(F.array_distinct(F.flatten(F.collect_set("providers"))).alias("more"), F.array_sort(F.collect_set("path")).alias("conflicts"))
    kept = plain.join(winner, "route_id", "left_anti").join(folded, F.col("route_id") == F.col("into"), "left")
    none = F.array().cast("array<string>")
    out = kept.select("route_id", "root_name", "rel_path", "start_line", "method", "path", F.array_sort(F.array_distinct(F.concat("providers", F.coalesce("more", none)))).alias("providers"), F.coalesce("conflicts", none).alias("conflicts"), F.lit(None).cast("string").alias("failure"))
    dropped = routes.where("verb_use").select("route_id", "root_name", "rel_path", "start_line", "method", "path", F.array_sort("providers").alias("providers"), none.alias("conflicts"), F.lit("not an endpoint").alias("failure"))
    return out.unionByName(dropped)
