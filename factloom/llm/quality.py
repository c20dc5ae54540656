"""Quality rules with adaptive thresholds.

Text measures are taken in one pass; their distribution per (language, source) is kept in mergeable
quantile sketches (logarithmic buckets with a relative error bound: a sketch is a set of counters, merging is
adding), thresholds are read off the merged sketches, and documents are filtered by a join with them.

Defined cases: null or empty text has no words, so base_failed; null language or source is a group of its own;
small groups' quantiles lean on their language's and those on the whole corpus's, by weight; a
measure that all texts have alike, or that none has, has no bound; repeated rows are judged
one by one alike; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SYMBOLS, SPACES = b"#*$%&|<>", b" \t\n\v\f\r"
PUNCT = bytes(c for c in range(33, 127) if not chr(c).isalnum())
CAPITALS = bytes(range(65, 91))
#: measure -> which sides are bounded.
RULES = {"word_len": "both", "symbol_rate": "high", "dup_line_rate": "high", "punct_rate": "high", "capital_rate": "high", "echo_rate": "high"}
#: Quartile distances below this are none.
NO_SPREAD = 1e-6
#: The bucket of zero.
ZERO = -(2**30)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_punct", "n_capitals", "n_echoes")


def ngram_ids(ids: np.ndarray, n: int) -> np.ndarray:
    """Exact integer names of the n-grams of a sequence of ids (equal iff the n-grams are equal)."""
    names = ids.astype(np.int64)
    for k in range(1, n):
        _, names = np.unique(names[: len(ids) - k] * (int(ids.max()) + 1) + ids[k:], return_inverse=True)
    return names


def repeated_words(words: list[bytes], n: int = 5) -> int:
    """Words lying in n-word windows that occur at least twice in the text, the first occurrence included."""
    if len(words) <= n:
        return 0
    if len(words) < 50_000 and len(set(zip(*(words[i:] for i in range(n))))) == len(words) - n + 1:
        return 0
    index: dict[bytes, int] = {}
    names = ngram_ids(np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, len(words)), n)
    twice = np.bincount(names)[names] > 1
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, np.flatnonzero(twice), 1)
    np.add.at(edge, np.flatnonzero(twice) + n, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def measure(text: bytes | None) -> tuple[int, ...]:
    text = text or b""
    words = text.split()
    packed = text.translate(None, SPACES)
    lines = [x for x in text.split(b"\n") if x.strip()]
    chars = len(packed.decode("utf-8", "replace"))
    return (
        len(words),
        chars,
        len(packed) - len(packed.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        len(packed) - len(packed.translate(None, PUNCT)),
        len(packed) - len(packed.translate(None, CAPITALS)),
        sum(map(eq, words, words[1:])),
    )


def text_measures(docs: DataFrame, text_col: str = "text", keys: Iterable[str] = ("doc_id", "lang", "source")) -> DataFrame:
    """The keys and COUNTS (long) of every whole text."""
    keys = list(keys)
    picked = docs.select(*keys, F.col(text_col).cast("binary").alias("__text"))
    schema = picked.select(*keys, *(F.lit(0).cast("long").alias(c) for c in COUNTS)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [measure(t) for t in b.column(len(keys)).to_pylist()]
            cols = zip(*rows) if rows else [[] for _ in COUNTS]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *(pa.array(c, pa.int64()) for c in cols)], names=[*keys, *COUNTS])

    return picked.mapInArrow(run, schema)


def with_rates(measures: DataFrame) -> DataFrame:
    per = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return measures.withColumns({
        "word_len": per("word_chars", "n_words"),
        "symbol_rate": per("n_symbols", "n_words"),
        "dup_line_rate": per("n_dup_lines", "n_lines"),
        "punct_rate": per("n_punct", "word_chars"),
        "capital_rate": per("n_capitals", "word_chars"),
        "echo_rate": per("n_echoes", "n_words"),
    })


def quantile_sketches(df: DataFrame, by: list[str], measures: Iterable[str], error: float = 0.01) -> DataFrame:
    """One counter per (by, measure, bucket): bucket b holds values in (g^(b-1), g^b], g = (1+error)/(1-error);
    zero has a bucket of its own. Partial counts are summed map-side, so a hot group costs one row per
    task and bucket."""
    gamma = math.log((1 + error) / (1 - error))
    measures = list(measures)
    long = df.select(*by, F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), F.col(m).alias("v")) for m in measures))).alias("x"))
    bucket = F.when(F.col("x.v") <= 1e-9, F.lit(ZERO)).otherwise(F.ceil(F.log("x.v") / gamma)).cast("int")
    return long.select(*by, F.col("x.measure").alias("measure"), bucket.alias("bucket")).groupBy(*by, "measure", "bucket").agg(F.count("*").alias("n"))


def merge_sketches(sketches: DataFrame, by: list[str]) -> DataFrame:
    return sketches.groupBy(*by, "measure", "bucket").agg(F.sum("n").alias("n"))


def sketch_quantiles(sketches: DataFrame, by: list[str], quantiles: dict[str, float], error: float = 0.01) -> DataFrame:
    """(by, measure, size, one column per quantile). A group has some thousand buckets at most, whatever its rows."""
    g = (1 + error) / (1 - error)
    w = Window.partitionBy(*by, "measure")
    value = F.when(F.col("bucket") == ZERO, F.lit(0.0)).otherwise(2 * F.pow(F.lit(g), F.col("bucket")) / (g + 1))
    ranked = sketches.select(*by, "measure", value.alias("v"), F.sum("n").over(w.orderBy("bucket")).alias("upto"), F.sum("n").over(w).alias("size"))
    return ranked.groupBy(*by, "measure").agg(
        F.first("size").alias("size"),
        *(F.min(F.when(F.col("upto") >= F.ceil(F.col("size") * q), F.col("v"))).alias(k) for k, q in quantiles.items()),
    )


def leaning_quartiles(sketches: DataFrame, groups: DataFrame, prior: float, error: float = 0.01) -> DataFrame:
    """(lang, source, measure, q1, q2, q3) of every one of groups(lang, source, measure). A level's quartiles are means of its own, weighted by its rows, and of the level above, weighted as
    prior rows: (lang, source), (lang), all. Null where no level has rows of the measure."""
    q = {"q1": 0.25, "q2": 0.5, "q3": 0.75}
    fine = sketch_quantiles(sketches, ["lang", "source"], q, error)
    lang = sketch_quantiles(merge_sketches(sketches, ["lang"]), ["lang"], q, error)
    top = sketch_quantiles(merge_sketches(sketches, []), [], q, error)
    same = lambda x, *by: [F.col("g.measure") == F.col(f"{x}.measure"), *(F.col(f"g.{c}").eqNullSafe(F.col(f"{x}.{c}")) for c in by)]
    joined = groups.alias("g").join(fine.alias("f"), same("f", "lang", "source"), "left").join(lang.alias("l"), same("l", "lang"), "left").join(top.alias("t"), same("t"), "left")
    none = F.lit(0.0)
    mean = lambda x, c, above: (F.coalesce(F.col(f"{x}.size") * F.col(f"{x}.{c}"), none) + prior * above) / (F.coalesce(F.col(f"{x}.size"), none) + prior)
    return joined.select("g.lang", "g.source", "g.measure", *(mean("f", c, mean("l", c, F.col(f"t.{c}"))).alias(c) for c in q))


def adaptive_bounds(sketches: DataFrame, spread: float, prior: float, error: float = 0.01) -> DataFrame:
    """One row per (lang, source): low_<m>, high_<m> = median -+ spread * distance of the outer quartile. Where the outer quartile is the median (a measure that most texts have nothing of)
    median and quartile are those of the texts that have some, read off the same sketches without their bucket of zero. If these lie together as well there is no bound (null): all texts
    that have some have the same, so none stands out. No constant decides."""
    groups = sketches.select("lang", "source", "measure").distinct()
    every, some = leaning_quartiles(sketches, groups, prior, error), leaning_quartiles(sketches.where(F.col("bucket") != ZERO), groups, prior, error)
    both = every.alias("e").join(some.alias("s"), F.col("e.measure").eqNullSafe(F.col("s.measure")) & F.col("e.lang").eqNullSafe(F.col("s.lang")) & F.col("e.source").eqNullSafe(F.col("s.source")))

    def bound(outer: str) -> Column:
        far = lambda x: F.abs(F.col(f"{x}.{outer}") - F.col(f"{x}.q2")) > NO_SPREAD
        at = lambda x: F.col(f"{x}.q2") + spread * (F.col(f"{x}.{outer}") - F.col(f"{x}.q2"))
        return F.when(far("e"), at("e")).when(far("s"), at("s"))

    per = both.select("e.lang", "e.source", "e.measure", bound("q1").alias("low"), bound("q3").alias("high"))
    sides = [(m, side) for m, has in RULES.items() for side in (("low", "high") if has == "both" else ("high",))]
    return per.groupBy("lang", "source").agg(*(F.max(F.when(F.col("measure") == m, F.col(side))).alias(f"{side}_{m}") for m, side in sides))


def quality_verdicts(docs: DataFrame, spread: float = 14.0, prior: float = 200.0, error: float = 0.01) -> DataFrame:
    """doc_id, the counts, base_failed, n_outlying (rules broken) and kept for each row of docs(doc_id, text, lang, source)."""
    from .common import materialize

    rated = with_rates(materialize(text_measures(docs), "measures"))
    rated = rated.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    # the sketches describe the texts that the base rules let through
    sketches = quantile_sketches(rated.where(~F.col("base_failed")), ["lang", "source"], RULES, error)
    bounds = adaptive_bounds(sketches, spread, prior, error).withColumnsRenamed({"lang": "b_lang", "source": "b_source"})
    judged = rated.join(bounds, F.col("lang").eqNullSafe(F.col("b_lang")) & F.col("source").eqNullSafe(F.col("b_source")), "left")
    broken = sum(
        F.when(F.col(m) > F.col(f"high_{m}"), 1).otherwise(0) + (F.when(F.col(m) < F.col(f"low_{m}"), 1).otherwise(0) if sides == "both" else F.lit(0))
        for m, sides in RULES.items()
    )
    return judged.withColumn("n_outlying", broken.cast("long")).select(
        "doc_id", *COUNTS, "base_failed", "n_outlying", (~F.col("base_failed") & (F.col("n_outlying") == 0)).alias("kept")
    )
