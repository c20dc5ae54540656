"""Benchmark decontamination: a prefix-filtered set join with exact verification.

Every window of ``width`` consecutive item words (a shorter item is one window) is a set of shingles of ``SHINGLE`` words (the whole window if it has
fewer), ordered by rarity: the number of documents that hold them. Exact containment needs every shingle, so the necessary
prefix is the rarest one: windows and documents are joined on it, within the length bound (the document has words enough) and the
positional bound (the shingle stands far enough from both ends), and candidates are verified word by word.

1. Windows are made of the items in parallel; a bitmap of fixed greatest size says which shingles they have.
2. A pass over the documents counts the documents with each of these shingles; a window with one in no document is dropped.
3. A second pass sends the places of prefix shingles with the words around them, so no text is shuffled.

Defined cases: null texts have no words; an item without words has no window and is never found; null ids are kept
as they are (a null item id counts as ''); repeated items are found each but listed once per id; repeated documents are judged one by
one alike; empty tables give no hits or an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import carried, materialize, slices, text_hash, values
from .hashing import mix, string_hashes

#: Lower-cases A-Z and blanks every ASCII character but letters and digits.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
SHINGLE = 3
#: Bits of the bitmap for each window, and the powers of two between which its size lies (8 MB at most).
SPARSE, LEAST_BITS, MOST_BITS = 256, 16, 26
#: Windows are broadcast up to so many (of ``width`` words each), else joined by shuffles in which every key is dealt to SALTS tasks.
BROADCAST_ROWS, SALTS = 200_000, 16


def folded_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, and the place of each text's first word and the end."""
    lists = pc.ascii_split_whitespace(pa.array([(t or b"").translate(FOLD) for t in values(texts)], pa.binary()).cast(pa.string()))
    real = pc.greater(pc.binary_length(lists.values), 0)
    upto = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False))])
    return lists.values.filter(real), upto[lists.offsets.to_numpy()]


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """The hash of the size words from each place on; the last size - 1 places have none."""
    n = max(0, len(words) - size + 1)
    out = np.full(n, size, np.uint64)
    for i in range(size):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + words[i : i + n])
    return out


def windows_of(items: DataFrame, width: int) -> DataFrame:
    """(item_id, win, n, words, size, shingles) of each window of items(item_id, text): its words, one blank between, win their hash, and the
    hashes of its shingles of size words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1):
            words, at = folded_words(b.column(1))
            hashes = string_hashes(words)
            for i, item in enumerate(values(b.column(0))):
                mine, h = words[at[i] : at[i + 1]].to_pylist(), hashes[at[i] : at[i + 1]]
                n, size = min(width, len(mine)), min(SHINGLE, len(mine))
                starts = range(len(mine) - n + 1 if mine else 0)
                shingles = shingle_hashes(h, size).view(np.int64) if mine else h
                for part in range(0, len(starts), 10_000):
                    some = starts[part : part + 10_000]
                    yield pa.RecordBatch.from_pydict({
                        "item_id": pa.array([item] * len(some), pa.string()), "n": pa.array([n] * len(some), pa.int32()), "words": pa.array([" ".join(mine[s : s + n]) for s in some], pa.string()),
                        "size": pa.array([size] * len(some), pa.int32()), "shingles": pa.array([shingles[s : s + n - size + 1] for s in some], pa.list_(pa.int64())),
                    })

    picked = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.col("text").cast("binary")).where("text is not null").distinct()
    made = picked.mapInArrow(run, "item_id string, n int, words string, size int, shingles array<long>")
    return made.select("item_id", F.sha2("words", 256).alias("win"), "n", "words", "size", "shingles")


def slots(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two places of a hash in a bitmap of 2 ** bits."""
    return h >> np.uint64(64 - bits), mix(h) >> np.uint64(64 - bits)


def shingle_bitmap(shingles: DataFrame, windows: int) -> np.ndarray:
    """The packed bitmap of shingles(h): made where they are, united in a few rows."""
    bits = int(np.clip(np.ceil(np.log2(max(1, SPARSE * windows))), LEAST_BITS, MOST_BITS))

    def made(seen: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([seen.tobytes()], pa.binary())], names=["map"])

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = None
        for b in batches:
            if b.num_rows:
                seen = np.zeros(1 << (bits - 3), np.uint8) if seen is None else seen
                for at in slots(b.column(0).to_numpy().view(np.uint64), bits):
                    np.bitwise_or.at(seen, (at >> np.uint64(3)).astype(np.intp), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        if seen is not None:
            yield made(seen)

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = None
        for b in batches:
            for m in values(b.column(0)):
                seen = np.frombuffer(m, np.uint8) if seen is None else seen | np.frombuffer(m, np.uint8)
        if seen is not None:
            yield made(seen)

    out = np.zeros(1 << (bits - 3), np.uint8)
    for r in shingles.mapInArrow(mark, "map binary").repartition(4).mapInArrow(unite, "map binary").collect():
        out |= np.frombuffer(r.map, np.uint8)
    return out


def marked(h: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    """The places in h whose hash the bitmap has."""
    bits = int(np.log2(len(bitmap))) + 3
    first, second = slots(h, bits)
    has = lambda at: (bitmap[(at >> np.uint64(3)).astype(np.intp)] >> (at & np.uint64(7)).astype(np.uint8)) & 1
    some = np.flatnonzero(has(first))
    return some[has(second[some]).astype(bool)]


def occurrences(words: pa.Array, at: np.ndarray, sizes: list[int], bitmap: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, place among all words, hash) of shingles of the given sizes that the bitmap has."""
    hashes = string_hashes(words)
    for size in sizes:
        h = shingle_hashes(hashes, size)
        place = marked(h, bitmap)
        text = np.searchsorted(at, place, "right") - 1
        inside = place + size <= at[text + 1]
        yield text[inside], place[inside], h[place[inside]]


def document_frequencies(docs: DataFrame, sizes: list[int], bitmap: Broadcast) -> DataFrame:
    """(h, docs) of the marked shingles of docs(text binary)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 0):
            for text, _, h in occurrences(*folded_words(b.column(0)), sizes, bitmap.value):
                pairs = np.unique(np.stack([h, text.astype(np.uint64)], 1), axis=0)
                found, n = np.unique(pairs[:, 0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n)], names=["h", "docs"])

    return docs.mapInArrow(run, "h long, docs long").groupBy("h").agg(F.sum("docs").alias("docs"))


def places(docs: DataFrame, sizes: list[int], bitmap: Broadcast, width: int) -> DataFrame:
    """For each row of docs(doc_id, th, text binary) its n_words and, in found, the marked shingles: hash, place, and the words around it, of
    which before stand before it."""
    schema = "doc_id long, th long, n_words long, found array<struct<h:long,at:long,before:int,around:array<string>>>"
    kind = pa.list_(pa.struct([("h", pa.int64()), ("at", pa.int64()), ("before", pa.int32()), ("around", pa.list_(pa.string()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 2):
            words, at = folded_words(b.column(2))
            found: list[list] = [[] for _ in range(b.num_rows)]
            for text, place, h in occurrences(words, at, sizes, bitmap.value):
                for t, p, x in zip(text.tolist(), place.tolist(), h.view(np.int64).tolist()):
                    lo, hi = max(int(at[t]), p - width + 1), min(int(at[t + 1]), p + width)
                    found[t].append({"h": x, "at": p - int(at[t]), "before": p - lo, "around": words[lo:hi].to_pylist()})
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.diff(at), pa.int64()), pa.array(found, kind)], names=["doc_id", "th", "n_words", "found"])

    return docs.mapInArrow(run, schema)


def dealt_join(many: DataFrame, few: DataFrame, key: str, rows: int, broadcast_rows: int) -> DataFrame:
    """Inner join on key; few has so many rows. Without broadcast, each key of many is dealt by document to SALTS tasks."""
    if rows <= broadcast_rows:
        return many.join(F.broadcast(few), key)
    salt = F.pmod(F.xxhash64("doc_id", "th"), F.lit(SALTS)).cast("int")
    return many.withColumn("__salt", salt).join(few.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), [key, "__salt"]).drop("__salt")


def decontaminate(docs: DataFrame, items: DataFrame, width: int = 10, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """doc_id, th (naming the text), n_words, n_hit (words inside an occurrence of a window), n_items, items_sha256 (of the sorted ids,
    comma-joined), spans (array of start, end), items and contaminated for each row of docs(doc_id, text)."""
    sc = docs.sparkSession.sparkContext
    picked = docs.select("doc_id", text_hash(), F.col("text").cast("binary").alias("text"))
    owned = materialize(windows_of(items, width), "windows")
    owners = owned.select("win", "item_id").distinct()
    windows = materialize(owned.groupBy("win").agg(*(F.first(c).alias(c) for c in ("n", "words", "size", "shingles"))), "sets")
    rows, sizes = windows.count(), sorted(r.size for r in windows.select("size").distinct().collect())  # of SHINGLE sizes
    each = windows.select("win", F.posexplode("shingles").alias("offset", "h"))
    bitmap = sc.broadcast(shingle_bitmap(each.select("h").distinct(), rows))
    counted = materialize(document_frequencies(picked.select("text"), sizes, bitmap), "frequencies")
    rare = each.join(counted, "h", "left").groupBy("win").agg(F.min(F.struct("docs", "h", "offset")).alias("prefix"), F.count("docs").alias("known"), F.count("*").alias("all")).where("known = all")
    prefixes = materialize(rare.join(windows.select("win", "n", "words"), "win").select("win", "n", "words", F.col("prefix.h").alias("h"), F.col("prefix.offset").alias("offset")), "prefixes")
    bitmap = sc.broadcast(shingle_bitmap(prefixes.select("h").distinct(), rows))
    read = materialize(places(picked, sizes, bitmap, width), "places")

    hits = read.select("doc_id", "th", "n_words", F.explode("found").alias("f")).select("doc_id", "th", "n_words", "f.*").distinct()
    met = dealt_join(hits, prefixes, "h", rows, broadcast_rows)
    start = F.col("at") - F.col("offset")
    fits = (start >= 0) & (start + F.col("n") <= F.col("n_words")) & (F.col("before") >= F.col("offset"))
    same = F.array_join(F.slice("around", F.col("before") - F.col("offset") + 1, F.col("n")), " ") == F.col("words")
    occurs = materialize(met.where(fits).where(same).select("doc_id", "th", start.alias("start"), (start + F.col("n")).alias("end"), "win"), "occurrences")
    spans = occurs.groupBy("doc_id", "th").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("spans"))
    named = dealt_join(occurs.select("doc_id", "th", "win").distinct(), owners, "win", owned.count(), broadcast_rows).groupBy("doc_id", "th").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    both = spans.join(named, spans["doc_id"].eqNullSafe(named["doc_id"]) & (spans["th"] == named["th"])).select(spans["doc_id"].alias("f_id"), spans["th"].alias("f_th"), "spans", "items")
    out = read.select("doc_id", "th", "n_words").join(both, F.col("doc_id").eqNullSafe(F.col("f_id")) & (F.col("th") == F.col("f_th")), "left")
    covered = F.aggregate(
        F.coalesce("spans", F.array()), F.struct(F.lit(0).cast("long").alias("upto"), F.lit(0).cast("long").alias("n")),
        lambda acc, s: F.struct(F.greatest(acc["upto"], s["end"]).alias("upto"), (acc["n"] + F.greatest(F.lit(0).cast("long"), s["end"] - F.greatest(acc["upto"], s["start"]))).alias("n")), lambda acc: acc["n"],
    )
    ids = F.coalesce("items", F.array().cast("array<string>"))
    return out.select("doc_id", "th", "n_words", covered.alias("n_hit"), F.size(ids).cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), F.coalesce("spans", F.array().cast("array<struct<start:bigint,end:bigint>>")).alias("spans"), ids.alias("items"), F.col("spans").isNotNull().alias("contaminated"))


def keep_uncontaminated(docs: DataFrame, items: DataFrame, width: int = 10) -> DataFrame:
    """The rows of docs without a word inside an item's window."""
    bad = decontaminate(docs, items, width).where("contaminated").select(F.col("doc_id").alias("__id"), F.col("th").alias("__th")).distinct()
    rows, names = carried(docs)
    rows = rows.withColumns({"__doc": F.col(names[docs.columns.index("doc_id")]), "__h": text_hash()})
    return rows.join(bad, F.col("__doc").eqNullSafe(F.col("__id")) & (F.col("__h") == F.col("__th")), "left_anti").select(*names).toDF(*docs.columns)
