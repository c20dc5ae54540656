"""Language identification by rank-order n-gram profiles.

A profile is the list of a language's most frequent 1- to 3-grams in order; a document is compared with each by
the out-of-place distance: the sum, over the document's own most frequent n-grams, of how far each stands from
its place in the profile (an absent one costs the profile's length).

Texts are reduced to lower-case letters with single blanks between words. Defined cases: a null text or one
without a letter, and any text while no language has been learnt, gets ``und`` and score 0; equal distances go to
the language first in code-point order; equal counts are ordered by n-gram; rows with a null language teach
nothing; repeated rows count as often as they occur; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import carried, crc_mod, materialize, values

UNKNOWN = "und"
PROFILE = 400
#: Profiles are broadcast: at most this many languages of PROFILE n-grams each.
MAX_LANGUAGES = 2000
#: n-grams that a task holds before it counts and sends them.
HELD_GRAMS = 1_000_000


@cache
def letters() -> np.ndarray:
    """True at each code point that is a letter."""
    return np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def grams(text: str | None) -> np.ndarray:
    """The 1-, 2- and 3-grams of a text as integers of 21 bits a character, those of one blank left out; empty without letters."""
    x = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    ok = letters()[x]
    if not ok.any():
        return np.empty(0, np.int64)
    x = np.where(ok, x, 32).astype(np.int64)
    x = np.concatenate([[32], x, [32]])
    x = x[np.concatenate([[True], (x[1:] != 32) | (x[:-1] != 32)])]
    two = x[:-1] << 21 | x[1:]
    return np.concatenate([x[x != 32], two, two[:-1] << 21 | x[2:]])


def top_grams(text: str | None, size: int) -> np.ndarray:
    codes, counts = np.unique(grams(text), return_counts=True)
    if len(codes) > size:  # ties at the edge are settled by the n-gram, so all of them must be ordered
        edge = np.partition(counts, len(counts) - size)[len(counts) - size]
        codes, counts = codes[counts >= edge], counts[counts >= edge]
    return codes[np.argsort(-counts, kind="stable")[:size]]


def learn_profiles(docs: DataFrame, size: int = PROFILE) -> DataFrame:
    """(lang, code, rank from 0) from all rows of docs(text, lang) with a language. A task sends one count per language
    and n-gram of every HELD_GRAMS, so what is shuffled follows the alphabets rather than the text."""

    def sent(by: dict[str, list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for lang, parts in by.items():
            codes, n = np.unique(np.concatenate(parts), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes, pa.int64()), pa.array(n, pa.int64())], names=["lang", "code", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by, held = {}, 0
        for b in batches:
            for lang, text in zip(values(b.column(0)), values(b.column(1))):
                by.setdefault(lang, []).append(g := grams(text))
                held += len(g)
                if held > HELD_GRAMS:
                    yield from sent(by)
                    by, held = {}, 0
        yield from sent(by)

    counts = docs.where(F.col("lang").isNotNull()).select("lang", "text").mapInArrow(count, "lang string, code long, n long")
    totals = counts.groupBy("lang", "code").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))
    return totals.withColumn("place", place).where(F.col("place") <= size).select("lang", "code", (F.col("place") - 1).alias("rank"))


def predict_languages(docs: DataFrame, profiles: DataFrame, keep: list[str], size: int = PROFILE) -> DataFrame:
    """keep, lang_pred and score (1 - distance / greatest possible distance) for each row of docs(text)."""
    rows = profiles.orderBy("lang", "rank").limit(MAX_LANGUAGES * size + 1).collect()
    if len(rows) > MAX_LANGUAGES * size:
        raise ValueError(f"over {MAX_LANGUAGES} languages: their profiles are not broadcast")
    langs = sorted({r.lang for r in rows}, key=lambda s: s.encode())
    number = {lang: i for i, lang in enumerate(langs)}
    rows.sort(key=lambda r: r.code)
    # the places of an n-gram in all profiles stand together: those of codes[i] from first[i] to first[i + 1]
    codes, first = np.unique(np.array([r.code for r in rows], np.int64), return_index=True)
    places = np.array([(number[r.lang], r.rank) for r in rows], np.int32).reshape(-1, 2)
    shared = docs.sparkSession.sparkContext.broadcast((langs, codes, np.append(first, len(rows)), places))
    picked = docs.select(*keep, F.col("text").alias("__text"))
    schema = picked.select(*keep, F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema

    def judge(text: str | None) -> tuple[str, float]:
        langs, codes, first, places = shared.value
        own = top_grams(text, size)
        if not len(own) or not langs:
            return UNKNOWN, 0.0
        at = np.searchsorted(codes, own)
        mine = np.flatnonzero(codes[np.minimum(at, len(codes) - 1)] == own)
        n = first[at[mine] + 1] - first[at[mine]]
        row = np.arange(n.sum()) + np.repeat(first[at[mine]] - (np.cumsum(n) - n), n)
        nearer = size - np.abs(places[row, 1] - np.repeat(mine, n))
        far = size * len(own) - np.bincount(places[row, 0], nearer, len(langs)).astype(np.int64)
        best = int(far.argmin())
        return langs[best], 1 - far[best] / (size * len(own))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [judge(t) for t in values(b.column(len(keep)))]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=schema.names)

    return picked.mapInArrow(run, schema)


def is_held_out(id_col: str = "doc_id") -> Column:
    return crc_mod(id_col, 4) == 2


def identify_languages(docs: DataFrame, size: int = PROFILE) -> DataFrame:
    """doc_id, held_out, lang_pred, score: learnt from the labelled rows that are not held out, predicted for all."""
    profiles = materialize(learn_profiles(docs.where(~is_held_out()), size), "profiles")
    return predict_languages(docs.withColumn("__held", is_held_out()), profiles, ["doc_id", "__held"], size).withColumnRenamed("__held", "held_out")


def keep_identified(docs: DataFrame, min_score: float = 0.2, size: int = PROFILE) -> DataFrame:
    """The rows of docs whose text is in one of the learnt languages: neither und nor below min_score."""
    profiles = materialize(learn_profiles(docs.where(~is_held_out()), size), "profiles")
    rows, names = carried(docs)
    kept = predict_languages(rows, profiles, names, size).where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= min_score))
    return kept.select(*names).toDF(*docs.columns)
