"""MinHash near-duplicates by fast similarity sketching, banding and exact verification.

A document is its set of distinct n-word shingles. The sketch is filled in rounds: round i places each element
in a hashed bin with a value in [i, i+1), and from round t on in bin i-t, so that every one of the t coordinates is
filled after 2t rounds at most and, with high probability, after t ln t / |set| of them; the estimate stays
concentrated as if t independent minima had been taken. Bands of ``rows`` coordinates give candidate buckets.

Documents with equal sets are one node. A bucket is not expanded into pairs: its members are compared with one
member, verified links are contracted into components, and only buckets that still hold several components go
on, with other centres. What is left is compared pair by pair behind a bitmap filter in small buckets, and joined on the rarest
shingles (of which similar sets share one) across larger ones, so no candidate link is lost.

Defined cases: a null or empty text has an empty set, is linked with nothing and is its own component; a null
doc_id takes part in no link, has a null component and is kept; rows that repeat an id with the same text get equal
results, with another text each the component of its own text; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dealt_lookup, materialize, rows_named, slices, text_hash
from .graph import components
from .hashing import GOLDEN, ascii_words, mix, reuse_freed_memory, string_hashes

ROWS, BANDS = 5, 40
PARITY_LONGS = 32
#: Members of a bucket up to which its remaining pairs are compared within it; those of larger ones are joined on rare shingles.
SMALL_BUCKET = 32
#: Shingles of what is left are ordered by 2 to this many counters (8 MB).
COUNTER_BITS = 20


def shingle_set(hashes: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the width-word shingles of a text whose words have these hashes; of fewer words the whole sequence."""
    n = min(width, len(hashes))
    if not n:
        return np.empty(0, np.uint64)
    out = np.full(len(hashes) - n + 1, n, np.uint64)
    for i in range(n):
        out = mix(out * GOLDEN + hashes[i : len(hashes) - n + 1 + i])
    return np.unique(out)


def shingle_sets_of(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    words, at = ascii_words(texts)
    hashes = string_hashes(words)
    for lo, hi in zip(at[:-1].tolist(), at[1:].tolist()):
        yield shingle_set(hashes[lo:hi], width)


def fast_sketch(elements: np.ndarray, t: int) -> np.ndarray:
    """t coordinates (round << 32 | value) of a non-empty set."""
    out = np.full(t, np.iinfo(np.uint64).max)
    step = max(1, t // len(elements))
    for first in range(0, 2 * t, step):
        rounds = np.arange(first, min(first + step, 2 * t), dtype=np.uint64)[:, None]
        h = mix(elements[None, :] ^ mix(rounds + np.uint64(1)))
        bins = np.where(rounds < t, ((h >> np.uint64(32)) * np.uint64(t)) >> np.uint64(32), rounds - np.uint64(t) * (rounds >= t))
        np.minimum.at(out, bins.ravel().astype(np.intp), ((rounds << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF))).ravel())
        if out.max() >> np.uint64(32) < 2 * t:
            break
    return out


def band_keys(sketch: np.ndarray, rows: int) -> np.ndarray:
    parts = sketch.reshape(-1, rows)
    key = np.arange(len(parts), dtype=np.uint64) + np.uint64(1)
    for i in range(rows):
        key = mix(key * GOLDEN + parts[:, i])
    return key.view(np.int64)


def sketch_documents(docs: DataFrame, width: int, rows: int, bands: int) -> DataFrame:
    """(doc_id, th, n_shingles, set_key binary, bands array<long>); th names the text, the last two are null for empty sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reuse_freed_memory()
        for b in slices(batches, 2):
            n, keys, buckets = [], [], []
            for s in shingle_sets_of(b.column(2), width):
                n.append(len(s))
                keys.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                buckets.append(band_keys(fast_sketch(s, rows * bands), rows) if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(buckets, pa.list_(pa.int64()))], names=["doc_id", "th", "n_shingles", "set_key", "bands"])

    return docs.select("doc_id", text_hash(), "text").mapInArrow(run, "doc_id long, th long, n_shingles long, set_key binary, bands array<long>")


def parity_bits(elements: np.ndarray) -> np.ndarray:
    """64 * PARITY_LONGS bits, each the parity of the number of elements hashed to it."""
    at = (mix(elements) >> np.uint64(32)) % np.uint64(64 * PARITY_LONGS)
    return np.packbits((np.bincount(at.astype(np.int64), minlength=64 * PARITY_LONGS) & 1).astype(np.uint8)).view(np.int64)


def shingle_sets(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """(id, set array<long>, parity array<long>) of the documents whose id is in ids(id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1):
            sets = list(shingle_sets_of(b.column(1), width))
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([s.view(np.int64) for s in sets], longs), pa.array([parity_bits(s) for s in sets], longs)], names=["id", "set", "parity"])

    picked = docs.select(F.col("doc_id").alias("id"), "text").join(ids, "id", "left_semi")
    return picked.mapInArrow(run, "id long, set array<long>, parity array<long>")


def similar(a: Column, b: Column, percent: int) -> Column:
    """100 * |a and b| >= percent * |a or b|; sets whose sizes rule it out are not intersected."""
    na, nb, both = F.size(a), F.size(b), F.size(F.array_intersect(a, b))
    return F.when(100 * F.least(na, nb) >= percent * F.greatest(na, nb), 100 * both >= percent * (na + nb - both)).otherwise(False)


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    left = pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("sa")), "a")
    return left.join(sets.select(F.col("id").alias("b"), F.col("set").alias("sb")), "b").where(similar(F.col("sa"), F.col("sb"), percent)).select("a", "b")


def _star_pairs(members: DataFrame, seed: int) -> DataFrame:
    """Pairs of a bucket's members with its centre, where their components differ. members(bucket, id, component)."""
    order = F.col("id") if seed == 0 else F.xxhash64("id", F.lit(seed))
    centre = members.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.min(F.struct(order.alias("o"), "id", "component")).alias("c")).where("lo < hi")
    return members.join(centre, "bucket").where("component <> c.component").select(F.least("id", "c.id").alias("a"), F.greatest("id", "c.id").alias("b")).distinct()


def _close(m: DataFrame, other: DataFrame, percent: int) -> Column:
    """Different components, and parity bitmaps (which differ in at most as many bits as the sets in elements) that let the sets be similar."""
    apart = sum((F.bit_count(m[f"p{i}"].bitwiseXOR(other[f"p{i}_b"])) for i in range(PARITY_LONGS)), F.lit(0))
    # similar sets differ in (100 - percent) / (100 + percent) of their summed sizes at most
    return (m["component"] != other["component_b"]) & (m["id"] < other["id_b"]) & ((100 + percent) * apart <= (100 - percent) * (m["n"] + other["n_b"]))


def _met(m: DataFrame, key: str, percent: int) -> DataFrame:
    other = m.toDF(*(f"{c}_b" for c in m.columns))
    return m.join(other, (m[key] == other[f"{key}_b"]) & _close(m, other, percent)).select(m["id"].alias("a"), other["id_b"].alias("b"))


def _rare_shingles(sets: DataFrame, percent: int) -> DataFrame:
    """(id, token): the rarest shingles of each of sets(id, set), as many as a similar set must share one of, of any order of all shingles; those of one set alone left out.

    The order is by how many shingles fall into a shingle's counter, of a table of fixed size, and then by the shingle itself. So no shingle outside of these leaves its task."""
    spark = sets.sparkSession
    spot = lambda h: (mix(h) >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, n = np.unique(spot(b.column(1).flatten().to_numpy().view(np.uint64)), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n)], names=["at", "n"])

    counts = sets.select("id", "set").mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()  # one row a counter at most
    table = np.zeros(1 << COUNTER_BITS, np.int64)
    table[counts.column("at").to_numpy()] = counts.column("n").to_numpy()
    shared = spark.sparkContext.broadcast(table)

    def rarest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(1)
            flat, ends = lists.flatten().to_numpy(), np.append(0, np.cumsum(pc.list_value_length(lists).to_numpy()))
            held = shared.value[spot(flat.view(np.uint64))]
            picked = []
            for lo, hi in zip(ends[:-1].tolist(), ends[1:].tolist()):
                most = hi - lo - -(-(hi - lo) * percent // 100) + 1
                picked.append(lo + np.lexsort((flat[lo:hi], held[lo:hi]))[:most])
            of = np.repeat(np.arange(len(picked)), [len(p) for p in picked])
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(of)), pa.array(flat[np.concatenate([*picked, np.empty(0, np.int64)]).astype(np.int64)])], names=["id", "token"])

    found = materialize(sets.select("id", "set").mapInArrow(rarest, "id long, token long"), "rare_shingles")
    shared.destroy()
    return found.join(found.groupBy("token").agg(F.count("*").alias("n")).where("n > 1").select("token"), "token", "left_semi").select("id", "token")


def _residual_pairs(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose components differ and whose sets may be similar, of what the stars left in one bucket: compared within a small bucket, and among
    the members of all larger ones joined on rare shingles, so that no bucket's square is formed. No set is carried through the joins."""
    state = members.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("size")).where("lo < hi")
    bits = sets.select("id", F.size("set").alias("n"), *(F.col("parity")[i].alias(f"p{i}") for i in range(PARITY_LONGS)))
    left = materialize(members.join(state.select("bucket", "size"), "bucket").select("bucket", "id", "component", "size"), "left")
    small = left.where(F.col("size") <= SMALL_BUCKET).drop("size").join(bits, "id")
    large = left.where(F.col("size") > SMALL_BUCKET).select("id", "component").distinct()
    rare = _rare_shingles(sets.select("id", "set").join(large.select("id"), "id", "left_semi"), percent)
    dealt = large.join(rare, "id").join(bits, "id")
    return _met(small, "bucket", percent).union(_met(dealt, "token", percent)).distinct()


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, rows: int = ROWS, bands: int = BANDS, star_rounds: int = 3) -> DataFrame:
    """doc_id, th, n_shingles, component_id and kept (doc_id = component_id) for each row of docs(doc_id, text)."""
    sketches = materialize(sketch_documents(docs, width, rows, bands), "sketches")
    known = sketches.where("doc_id is not null and set_key is not null")
    nodes = known.groupBy("set_key").agg(F.min(F.struct("doc_id", "bands")).alias("x"))
    buckets = nodes.select(F.col("x.doc_id").alias("id"), F.explode("x.bands").alias("bucket"))
    busy = buckets.groupBy("bucket").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("bucket")
    busy = materialize(buckets.join(busy, "bucket"), "buckets")
    sets = materialize(shingle_sets(docs, busy.select("id").distinct(), width), "sets")

    members, labels, tried, links = busy.withColumn("component", F.col("id")), None, None, None
    for k in range(star_rounds + 1):
        pairs = _star_pairs(members, k) if k < star_rounds else _residual_pairs(members, sets, percent)
        pairs = materialize(pairs.join(tried, ["a", "b"], "left_anti") if tried else pairs, "pairs")
        tried = tried.union(pairs) if tried else pairs
        found = materialize(verified(pairs, sets, percent), "links")
        if found.isEmpty():
            continue
        links = links.union(found) if links else found
        labels = components(links)
        members = busy.join(labels.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))

    nodes = nodes.select("set_key", F.col("x.doc_id").alias("node"))
    if labels is not None:
        nodes = nodes.join(labels, "node", "left").withColumn("node", F.coalesce("component", "node"))
    out = dealt_lookup(known.select("doc_id", "th", "n_shingles", "set_key"), nodes.select("set_key", F.col("node").alias("component_id")), "set_key", ["doc_id"])
    out = out.select("doc_id", "th", "n_shingles", "component_id")
    alone = sketches.where("doc_id is null or set_key is null").select("doc_id", "th", "n_shingles", F.col("doc_id").alias("component_id"))
    out = out.unionByName(alone)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_representatives(docs: DataFrame, **options: int) -> DataFrame:
    """The rows of docs that near_duplicates() keeps, one of equal rows."""
    kept = near_duplicates(docs, **options).where("kept")
    return rows_named(docs, kept).dropDuplicates()
