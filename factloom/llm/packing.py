"""Packing by vector bin packing.

Examples are placed under simultaneous limits on tokens, segments and loss-bearing tokens. A sequence is filled by the
dot-product heuristic: of the examples that fit, take the one whose demand vector has the greatest product with what is
left of the capacities, each dimension weighted by its mean demand. Documents longer than a sequence are cut into full
pieces and a rest. Pieces are dealt by hash into groups of bounded expected size and packed group by group, so at most one
part-filled sequence a group is the price of packing in parallel.

Defined cases: a null or empty text is the end id alone; repeated rows are packed each; a null doc_id is kept; pieces
of equal demand are taken in the order of (doc_id, start, crc); an empty table gives an empty result; other columns are
ignored; an example over a limit by itself is an error.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, values
from .tokens import word_encoder

END_ID = 1


def token_pieces(docs: DataFrame, tokenizer: str, size: int = 2048, keep_ids: bool = False) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens[, ids]) for each piece of at most size ids of every text and its end id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(tokenizer)
        for b in batches:
            out = [[] for _ in range(6)]
            for doc, ids in zip(values(b.column(0)), encoder.many(values(b.column(1)))):
                ids = np.append(ids, END_ID).astype("<u4")
                for at in range(0, len(ids), size):
                    piece = ids[at : at + size]
                    for c, v in zip(out, (doc, at, len(piece), zlib.crc32(piece), len(ids), piece.astype(np.int32) if keep_ids else None)):
                        c.append(v)
            arrays = [pa.array(c, pa.int64()) for c in out[:5]]
            yield pa.RecordBatch.from_arrays(arrays + [pa.array(out[5], pa.list_(pa.int32()))] * keep_ids, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"][: 5 + keep_ids])

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * keep_ids
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def dot_product_bins(demand: np.ndarray, capacity: np.ndarray) -> list[list[int]]:
    """Bins of item numbers; demand is (items, dimensions), items in order of preference among equals."""
    if (demand > capacity).any():
        raise ValueError("an example exceeds a limit by itself")
    kinds, kind, left = np.unique(demand, axis=0, return_inverse=True, return_counts=True)
    queues = [[] for _ in kinds]
    for i in range(len(demand) - 1, -1, -1):
        queues[kind.ravel()[i]].append(i)
    share = kinds / capacity
    weight = (demand / capacity).mean(0)
    bins: list[list[int]] = []
    todo = len(demand)
    while todo:
        room = capacity.copy()
        bins.append([])
        while len(fit := np.flatnonzero((left > 0) & (kinds <= room).all(1))):
            k = fit[np.argmax(share[fit] @ (weight * room / capacity))]
            bins[-1].append(queues[k].pop())
            left[k] -= 1
            todo -= 1
            room = room - kinds[k]
    return bins


def pack(pieces: DataFrame, size: int = 2048, max_segments: int = 256, max_loss: int = 2048, group_size: int = 2000) -> DataFrame:
    """pieces(doc_id, start, length, ids_crc32, loss_tokens, ...) with sequence_id and offset. pieces is read twice."""
    groups = 1 + pieces.count() // group_size
    capacity = np.array([size, max_segments, max_loss], np.int64)
    names = pieces.columns

    def place(group: pa.Table) -> pa.Table:
        order = [("length", "descending"), ("loss_tokens", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")]
        group = group.sort_by(order)
        length = group["length"].to_numpy()
        demand = np.stack([length, np.ones(len(group), np.int64), group["loss_tokens"].to_numpy()], 1)
        sequence, offset = np.zeros(len(group), np.int64), np.zeros(len(group), np.int64)
        for k, members in enumerate(dot_product_bins(demand, capacity)):
            sequence[members] = k
            offset[members] = np.cumsum(length[members]) - length[members]
        sequence += group["__group"].to_numpy() << 32
        return group.select(names).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    schema = pieces.select("*", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset")).schema
    dealt = pieces.withColumn("__group", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(groups)).cast("long"))
    return dealt.groupBy("__group").applyInArrow(place, schema)


def sequences(packed: DataFrame, size: int = 2048, pad_id: int = 0) -> DataFrame:
    """(sequence_id, ids padded to size or left at a power of two, segments) from packed pieces that kept their ids."""
    made = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "doc_id", "start", "length", "ids"))).alias("x"))
    ids = F.flatten(F.col("x.ids"))
    n = F.size(ids)
    full = F.when(F.log2(n) == F.floor(F.log2(n)), ids).otherwise(F.concat(ids, F.array_repeat(F.lit(pad_id), size - n)))
    return made.select("sequence_id", full.alias("ids"), F.transform("x", lambda s: s.dropFields("ids")).alias("segments"))


def pack_documents(docs: DataFrame, tokenizer: str, size: int = 2048, max_segments: int = 256) -> DataFrame:
    """The pieces of all texts with their places; every token of a document bears loss."""
    pieces = materialize(token_pieces(docs, tokenizer, size), "pieces").withColumn("loss_tokens", F.col("length"))
    return pack(pieces, size, max_segments, size).drop("loss_tokens")
