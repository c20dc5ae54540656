"""Ranked lexical search: exact inner-product search in ball-trees of sparse document vectors.

A document's coordinate for a term of the items is the whole number that its occurrences add to a score per unit of the term's weight, an
item's is weight times occurrences, so scores are inner products of whole numbers. Terms are found once: the first pass writes each document's
length and the items' terms in it, from which Spark takes the counts of the corpus. Every task then builds ball-trees over the documents that
it reads, some thousands at a time: each node has a centroid and a radius for each class of terms; no document below scores more than the centroid's product
plus, class by class, the item's norm times the radius, rounded up safely. The terms that only one item has are a class of their own, so a node
without them adds nothing for them; of the others those that most items have are classes each (one radius for all terms prunes nothing, for most of a document
is no part of an item). Nodes are opened best first until no bound reaches
the last place; leaves are scored exactly in 64-bit integers. The places won in one tree bound the search in the next, and the tasks' winners meet in
Spark, first in parts of an item, then by item.

Items are streamed to the driver in blocks of bounded bytes (or one item), and each block is searched against all documents; only the items' terms are
broadcast. Coordinates are scaled by the square root of the term's weight before distances are taken, which leaves products alone.

Null texts have no terms: such documents are found by nothing and do not count, such items get no rows. Repeated documents are ranked each,
repeated items get their rows each time. Null ids come last among equal scores. Ties go to the smaller doc_id. Empty tables give no rows; other columns are not
read. A text of any length is one row of its distinct terms after the first pass.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, materialize, slices
from .hashing import ascii_words, reuse_freed_memory

#: A-Z in lower case; every byte that is in no term as a space.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
#: Documents in a tree and in a leaf, entries of all centroids, classes of terms that several items have (and as many of those that one item has).
TREE, LEAF, CENTROIDS, CLASSES = 8192, 32, 1 << 23, 256
#: Bytes of text and number of items in a block.
BLOCK_BYTES, BLOCK_ITEMS = 4 << 20, 2000
#: Parts in which an item's places are merged first.
PARTS = 64


def terms_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The terms of all texts (null: none), and the place of each text's first one and the end."""
    texts = pc.fill_null(texts, "")
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
    first, data = int(offsets[0]), texts.buffers()[2]
    data = data[first : int(offsets[-1])].to_pybytes().translate(FOLD) if data else b""
    offsets = offsets - offsets[0]
    return ascii_words(pa.StringArray.from_buffers(len(texts), pa.py_buffer(offsets.tobytes()), pa.py_buffer(data)))


def document_terms(docs: DataFrame, vocabulary) -> DataFrame:
    """doc_id, n (terms with repeats), terms (places in the broadcast vocabulary, ascending) and tfs of every document."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reuse_freed_memory()
        names = pa.array(vocabulary.value["terms"], pa.string())
        schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("tfs", pa.list_(pa.int32()))])
        for part in slices(batches, 1, 4 << 20):
            words, at = terms_of(part.column(1))
            n = np.diff(at)
            found = pc.index_in(words, value_set=names)
            known = found.is_valid().to_numpy(zero_copy_only=False)
            keys = np.repeat(np.arange(part.num_rows), n)[known] * len(names) + found.drop_null().to_numpy()
            keys, tfs = np.unique(keys, return_counts=True)
            offsets = pa.array(np.searchsorted(keys, np.arange(part.num_rows + 1) * len(names)), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(v.astype(np.int32))) for v in (keys % max(1, len(names)), tfs)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n.astype(np.int64)), *lists], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(work, "doc_id long, n long, terms array<int>, tfs array<int>")


def term_classes(q_terms: np.ndarray, offsets: np.ndarray, n_terms: int) -> np.ndarray:
    """The class of each term of a block."""
    n_items, item = np.bincount(q_terms, minlength=n_terms), np.zeros(n_terms, np.int64)
    item[q_terms] = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    shared = np.flatnonzero(n_items > 1)
    classes = CLASSES + item % CLASSES
    classes[shared[np.argsort(-n_items[shared], kind="stable")]] = np.minimum(np.arange(len(shared)), CLASSES - 1)
    return np.unique(classes, return_inverse=True)[1]


def lengths_of(n: np.ndarray, n_docs: int, all_terms: int) -> np.ndarray:
    """m of documents with n terms."""
    if 25 * int(n.max(initial=0)) * n_docs < 1 << 62:
        return 75 + (25 * n * n_docs) // all_terms
    return np.array([75 + (25 * int(x) * n_docs) // all_terms for x in n], np.int64)


class BallTree:
    """Documents as sparse rows (terms, values at offsets), their nodes being ranges of rows; children of node k are 2k+1 and 2k+2."""

    def __init__(self, offsets: np.ndarray, terms: np.ndarray, values: np.ndarray, ids: np.ndarray, scale: np.ndarray, class_of: np.ndarray) -> None:
        depth = max(0, math.ceil(math.log2(max(1, len(ids)) / LEAF)))
        self.nodes: list[tuple[int, int]] = [(0, len(ids))]
        self.first_leaf = (1 << depth) - 1
        rows, size = np.arange(len(ids)), np.diff(offsets)
        x = scale[terms] * values
        norms = np.add.reduceat(x * x, offsets[:-1])
        dense = np.zeros(len(scale))

        def dots(own: np.ndarray, pivot: int) -> np.ndarray:
            """The products of some rows with one of them."""
            lo, hi = offsets[pivot], offsets[pivot + 1]
            dense[terms[lo:hi]] = x[lo:hi]
            at = self.entries(offsets, size, own)
            out = np.add.reduceat(dense[terms[at]] * x[at], np.cumsum(size[own]) - size[own])
            dense[terms[lo:hi]] = 0
            return out

        for k in range(self.first_leaf):
            a, b = self.nodes[k]
            own, half = rows[a:b], (a + b) // 2
            if b - a > 1:
                far = own[np.argmax(norms[own] - 2 * dots(own, own[0]))]
                to_far = dots(own, far)
                other = own[np.argmax(norms[own] - 2 * to_far)]
                rows[a:b] = own[np.argsort(to_far - dots(own, other), kind="stable")]
            self.nodes += [(a, half), (half, b)]
        at = self.entries(offsets, size, rows)
        self.offsets, self.terms, self.values, self.ids = np.append(0, np.cumsum(size[rows])), terms[at], values[at], ids[rows]
        self.bound_by(scale, class_of)

    @staticmethod
    def entries(offsets: np.ndarray, size: np.ndarray, rows: np.ndarray) -> np.ndarray:
        each = size[rows]
        ends = np.cumsum(each)
        return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(offsets[rows] - (ends - each), each)

    def bound_by(self, scale: np.ndarray, class_of: np.ndarray) -> None:
        """Centroids, and radii of each class of terms, with room for what floating point loses."""
        x, kinds, n = scale[self.terms] * self.values, class_of[self.terms], int(class_of.max()) + 1
        cell = np.repeat(np.arange(len(self.ids)), np.diff(self.offsets)) * n + kinds
        squares = np.bincount(cell, x * x, len(self.ids) * n).reshape(-1, n)
        self.centers, self.radii, self.n_classes = np.zeros((len(self.nodes), len(scale))), np.zeros((len(self.nodes), n)), n
        for k, (a, b) in enumerate(self.nodes):
            if a == b:
                continue
            lo, hi = self.offsets[a], self.offsets[b]
            center = self.centers[k]
            center += np.bincount(self.terms[lo:hi], x[lo:hi], len(scale)) / (b - a)
            own = np.bincount(class_of, center * center, n)
            products = np.bincount(cell[lo:hi] - a * n, x[lo:hi] * center[self.terms[lo:hi]], (b - a) * n).reshape(-1, n)
            apart = squares[a:b] + own
            self.radii[k] = np.sqrt(np.maximum(apart - 2 * products, 0) + 1e-10 * apart).max(axis=0)

    def search(self, terms: np.ndarray, weights: np.ndarray, scale: np.ndarray, class_of: np.ndarray, best: Places) -> int:
        """Adds this tree's documents to an item's best places; returns how many leaves were scored."""
        q = weights / scale[terms]
        norms = np.sqrt(np.bincount(class_of[terms], q * q, self.n_classes))
        bounds = (self.centers[:, terms] @ q + self.radii @ norms) * (1 + 1e-9) + 1
        full = np.zeros(len(scale), np.int64)
        full[terms] = weights
        queue, opened = [(-bounds[0], 0)], 0
        while queue and -queue[0][0] >= best.least:
            k = heapq.heappop(queue)[1]
            if k < self.first_leaf:
                for child in (2 * k + 1, 2 * k + 2):
                    if bounds[child] >= best.least:
                        heapq.heappush(queue, (-bounds[child], child))
                continue
            a, b = self.nodes[k]
            if a < b:
                opened += 1
                lo, hi = self.offsets[a], self.offsets[b]
                best.add(np.add.reduceat(full[self.terms[lo:hi]] * self.values[lo:hi], self.offsets[a:b] - lo), self.ids[a:b])
        return opened


class Places:
    """The k best of an item so far; ids beyond all others stand for null."""

    def __init__(self, k: int) -> None:
        self.k, self.least = k, 1
        self.scores, self.ids = np.empty(0, np.int64), np.empty(0, np.int64)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        good = scores >= self.least
        if not good.any():
            return
        scores, ids = np.append(self.scores, scores[good]), np.append(self.ids, ids[good])
        order = np.lexsort((ids, -scores))[: self.k]
        self.scores, self.ids = scores[order], ids[order]
        if len(order) == self.k:
            self.least = int(self.scores[-1])  # an equal score may still have a smaller id


NO_ID = np.iinfo(np.int64).max


def search_trees(batches: Iterable[pa.RecordBatch], block: dict, k: int) -> Iterator[tuple[int, Places]]:
    """The places of every item of the block among the documents of the batches."""
    weights, offsets, q_terms, q_counts = (block[x] for x in ("weights", "offsets", "q_terms", "q_counts"))
    scale = np.sqrt(np.maximum(weights, 1).astype(np.float64))
    class_of = block["class_of"]
    most = max(LEAF, min(TREE, LEAF * CENTROIDS // (2 * max(1, len(weights)))))
    places = [Places(k) for _ in range(len(offsets) - 1)]
    items = [(q_terms[a:b], q_counts[a:b] * weights[q_terms[a:b]]) for a, b in pairwise(offsets.tolist())]

    def search(rows: list[pa.RecordBatch]) -> None:
        t = pa.Table.from_batches(rows).combine_chunks()
        terms, tfs = t.column("terms").combine_chunks(), t.column("tfs").combine_chunks()
        at = terms.offsets.to_numpy().astype(np.int64)
        flat, counts = terms.values.to_numpy()[at[0] : at[-1]], tfs.values.to_numpy()[at[0] : at[-1]].astype(np.int64)
        size = np.diff(at)
        m = np.repeat(lengths_of(t.column("n").to_numpy(), block["n_docs"], block["all_terms"]), size)
        values = (1_000_000_000 * counts) // (1000 * counts + 12 * m)
        ids = pc.fill_null(t.column("doc_id"), NO_ID).to_numpy()
        tree = BallTree(at - at[0], flat, values, ids, scale, class_of)
        for (own, weight), best in zip(items, places):
            if len(own):
                tree.search(own, weight, scale, class_of, best)

    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        batch = batch.filter(pc.greater(pc.list_value_length(batch.column("terms")), 0))
        at = 0
        while at < batch.num_rows:
            part = batch.slice(at, most - n)
            held.append(part)
            at, n = at + part.num_rows, n + part.num_rows
            if n == most:
                search(held)
                held, n = [], 0
    if n:
        search(held)
    return enumerate(places)


def best_documents(vectors: DataFrame, block, k: int) -> DataFrame:
    """item, doc_id, score: the k best of every task."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reuse_freed_memory()
        for item, best in search_trees(batches, block.value, k):
            if len(best.ids):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(best.ids), item, np.int32)), pa.array(best.ids, mask=best.ids == NO_ID), pa.array(best.scores)], names=["item", "doc_id", "score"])

    return vectors.mapInArrow(work, "item int, doc_id long, score long")


def first_places(found: DataFrame, k: int, *by: str) -> DataFrame:
    return found.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))).where(F.col("rank") <= k)


def item_blocks(items: DataFrame) -> Iterator[list]:
    """The distinct items (item_id, text, copies) in blocks; one block is held at a time."""
    block, held = [], 0
    for row in items.groupBy("item_id", "text").agg(F.count("*").alias("copies")).where("text is not null").toLocalIterator():
        if block and (held + len(row["text"]) * 4 > BLOCK_BYTES or len(block) == BLOCK_ITEMS):
            yield block
            block, held = [], 0
        block.append(row)
        held += len(row["text"]) * 4
    if block:
        yield block


def search_block(docs: DataFrame, block: list, id_type: str, k: int) -> DataFrame:
    """item_id, rank, doc_id, score of the items of one block against all documents."""
    spark: SparkSession = docs.sparkSession
    words, at = terms_of(pa.array([r["text"] for r in block], pa.string()))
    coded = words.dictionary_encode()
    names, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)
    keys, counts = np.unique(np.repeat(np.arange(len(block)), np.diff(at)) * max(1, len(names)) + codes, return_counts=True)
    shared = spark.sparkContext.broadcast({"terms": names})
    vectors = materialize(document_terms(docs, shared), "document_terms")
    shared.destroy()
    sums = vectors.where("n > 0").agg(F.count("*").alias("docs"), F.sum("n").alias("terms")).first()
    held = np.zeros(len(names), np.int64)
    for row in vectors.select(F.explode("terms").alias("term")).groupBy("term").count().toLocalIterator():
        held[row["term"]] = row["count"]
    n_docs = sums["docs"]
    search = {
        "weights": np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(df) + 1))) for df in held], np.int64), "n_docs": n_docs, "all_terms": sums["terms"] or 1,
        "offsets": np.searchsorted(keys, np.arange(len(block) + 1) * max(1, len(names))), "q_terms": keys % max(1, len(names)), "q_counts": counts.astype(np.int64),
    }
    search["class_of"] = term_classes(search["q_terms"], search["offsets"], len(names))
    shared = spark.sparkContext.broadcast(search)
    found = materialize(best_documents(vectors, shared, k), "best_documents")
    shared.destroy()
    discard(vectors)
    some = first_places(found.withColumn("part", F.pmod(F.xxhash64("doc_id", "score"), F.lit(PARTS))), k, "item", "part").drop("part", "rank")
    named = spark.createDataFrame([(i, r["item_id"], r["copies"]) for i, r in enumerate(block)], f"item int, item_id {id_type}, copies long")
    return first_places(some, k, "item").join(named, "item").select("item_id", F.explode(F.sequence(F.lit(1).cast("long"), "copies")), F.col("rank").cast("int").alias("rank"), "doc_id", "score").drop("col")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents (doc_id, text) for every row of items (item_id, text)."""
    items = items.select("item_id", "text")
    id_type = items.schema["item_id"].dataType.simpleString()
    found = [search_block(docs, block, id_type, k) for block in item_blocks(items)]
    empty = docs.sparkSession.createDataFrame([], f"item_id {id_type}, rank int, doc_id long, score long")
    return reduce(DataFrame.unionByName, found) if found else empty
