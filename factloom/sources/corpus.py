"""Files of source roots and their inventory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import any_of
from ..functions.names import classify_path, language_of, looks_generated

# Fixed values.
DEPENDENCY_DIRECTORIES = ("node_modules", "bower_components", "vendor", ".venv", "venv", "__pycache__", "Pods", "DerivedData")
VCS_DIRECTORIES = (".git", ".hg", ".svn")
NOISE_FILES = (".DS_Store", "Thumbs.db")


def read_corpus(spark: SparkSession, roots: dict[str, str], cap: int = 1 << 20) -> tuple[DataFrame, DataFrame]:
    """(files, failures) of all roots(name -> folder): files(root_name, rel_path, size_bytes, content); a file over cap bytes is a failure row, its
    content is not read into files."""
    parts = []
    for name, folder in roots.items():
        raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
        rel = F.regexp_replace("path", "^.*?" + folder.rstrip("/").replace(".", r"\.") + "/", "")
        parts.append(raw.select(F.lit(name).alias("root_name"), rel.alias("rel_path"), F.col("length").alias("size_bytes"), F.when(F.col("length") <= cap, F.decode("content", "UTF-8")).alias("content")))
    files = parts[0]
    for p in parts[1:]:
        files = files.unionByName(p)
    return files.where(F.col("size_bytes") <= cap), files.where(F.col("size_bytes") > cap).select("root_name", "rel_path", "size_bytes", F.lit("oversize").alias("reason"))


def inventory(files: DataFrame) -> DataFrame:
    """(root_name, rel_path, size_bytes, disposition, classification, reason): one row per file, and one per excluded subtree (dependency or version-control
    folders) with the bytes below it."""
    parts = F.split("rel_path", "/")
    folders = F.slice(parts, 1, F.size(parts) - 1)
    bad = F.array_position(F.transform(folders, lambda s: s.isin(*DEPENDENCY_DIRECTORIES, *VCS_DIRECTORIES)), True)
    f = files.withColumn("cut", bad)
    kept, gone = f.where("cut = 0"), f.where("cut > 0")
    trees = gone.groupBy("root_name", F.array_join(F.slice(parts, F.lit(1), F.col("cut").cast("int")), "/").alias("rel_path")).agg(F.sum("size_bytes").alias("size_bytes"))
    kind = classify_path(F.col("rel_path"))
    generated = looks_generated(F.coalesce("content", F.lit(""))) & any_of([kind.isNull(), kind == "source"])
    noise = F.element_at(parts, -1).isin(*NOISE_FILES)
    one = kept.select("root_name", "rel_path", "size_bytes", F.when(noise, "excluded").otherwise("analyzed").alias("disposition"), F.when(generated, "generated").otherwise(F.coalesce(kind, F.lit("unknown"))).alias("classification"), F.when(noise, "noise file").alias("reason"))
    last = F.element_at(F.split("rel_path", "/"), -1)
    vcs = last.isin(*VCS_DIRECTORIES)
    return one.unionByName(trees.select("root_name", "rel_path", "size_bytes", F.lit("excluded").alias("disposition"), F.when(vcs, "unknown").otherwise("vendored").alias("classification"), F.when(vcs, "version control").otherwise("dependency folder").alias("reason")))


def source_files(files: DataFrame) -> DataFrame:
    """files with language, null where the extension does not say."""
    return files.withColumn("language", language_of(F.col("rel_path")))
