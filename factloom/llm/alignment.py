"""Cross-tokenizer alignment: which tokens of two vocabularies end together, and how often each pair of ids does so in the corpus.

Of each text, space+text is encoded without special tokens by a byte-level vocabulary (A) and a piece vocabulary (B), and the byte offsets
where tokens of both end cut it into groups. The ends of A and B are merged by paths: diagonals of the merge grid cut the work into pieces of
equal length, a binary search on each diagonal finds where its piece starts, all pieces are merged side by side and emit the ends that they
hold twice, and a pair that a diagonal parts is stitched together from the two pieces beside it.

Texts are worked off in slices of some MB. A slice's distinct chunks of text are encoded once each (no token or pre-token crosses the place
between a character that is not white and a space), its links are counted by pair before anything is shuffled, and the counts of all slices
meet by pair in Spark: a slice sends each pair once, however often its texts hold it. The first pass is written, so texts are encoded once.

Null and empty texts, and those whose joined tokens differ from space+text (a text with U+2581), have no tokens: zeros and ''. Repeated rows
are documents of their own and count; null ids stay null; an empty table gives no rows; other columns are not read. One text is held whole
by one task, with some 40 bytes for each of its tokens.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, slices
from .hashing import reuse_freed_memory
from .tokens import byte_alphabet

#: The characters that both tokenizers' patterns take for white space, and those of them that are no space.
OTHER = "\t-\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WHITE = f" {OTHER}"
#: A chunk starts with a space and ends before one that follows a character that is not white.
CHUNK = re.compile(f" [{WHITE}]*[^{WHITE}]*(?:[{OTHER}][{WHITE}]*[^{WHITE}]*)*")
ENDS_WHITE = re.compile(f"[{WHITE}]$")
BYTE_PIECE = re.compile("<0x([0-9A-F]{2})>")
#: Bytes of text in a slice, and steps in a piece of the merge.
SLICE, PIECE = 3 << 20, 64


def gather(flat: np.ndarray, size: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The parts of flat, of the given sizes, that which names, one after another."""
    each = size[which]
    ends = np.cumsum(each)
    return flat[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat((np.cumsum(size) - size)[which] - (ends - each), each)]


class TokenPair:
    """Both vocabularies: the ids of many chunks at once, and the bytes of each id."""

    def __init__(self, path_a: str, path_b: str) -> None:
        import public_tokenizers
        import sentencepiece
        import tiktoken

        with open(path_a, encoding="utf-8") as f:
            model = json.load(f)["model"]
        alphabet = byte_alphabet()
        ranks = {bytes(map(alphabet.__getitem__, t)): i for t, i in model["vocab"].items() if all(c in alphabet for c in t) and len(t) < 1 << 10}
        merged = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
        if merged != sorted(merged):
            raise ValueError(f"the ids of {path_a} do not follow its merges")
        special = {t["id"] for t in json.load(open(path_a, encoding="utf-8"))["added_tokens"]}
        ranks = {t: i for t, i in ranks.items() if i not in special}
        self.a = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any("▁" in n.lstrip("▁") for n in names):
            raise ValueError(f"{path_b} has pieces across spaces, so its chunks cannot be encoded apart")
        self.pieces = [bytes([int(m[1], 16)]) if self.b.is_byte(i) and (m := BYTE_PIECE.fullmatch(n)) else n.replace("▁", " ").encode() for i, n in enumerate(names)]
        self.len_a = np.zeros(max(ranks.values()) + 1, np.int64)
        self.len_a[list(ranks.values())] = [len(t) for t in ranks]
        self.len_b = np.array([len(p) for p in self.pieces])
        n_a, n_b = len(self.len_a), len(self.pieces)
        # how a token is written in the digested text, by 2 * id + whether it is the last of its group
        self.written = [f"{i}{stop}".encode() for i in range(n_a) for stop in ",|"] + [f"{i}{stop}".encode() for i in range(n_b) for stop in ",;"]
        self.n_a, self.n_b = n_a, n_b

    def ids_a(self, chunks: list[str], n_bytes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and how many each chunk has. Chunks that end in white space are encoded alone, the others together."""
        alone = [k for k, c in enumerate(chunks) if ENDS_WHITE.search(c)]
        apart = set(alone)
        ids = np.array(self.a.encode_ordinary("".join(c for k, c in enumerate(chunks) if k not in apart) if alone else "".join(chunks)), np.int64)
        together = np.delete(np.arange(len(chunks)), alone)
        size = np.zeros(len(chunks), np.int64)
        upto = np.searchsorted(np.cumsum(self.len_a[ids]), np.cumsum(n_bytes[together]), "right")
        size[together] = np.diff(upto, prepend=0)
        if not alone:
            return ids, size
        parts, at = [], 0
        for k, c in enumerate(chunks):
            if k in apart:
                parts.append(np.array(self.a.encode_ordinary(c), np.int64))
                size[k] = len(parts[-1])
            else:
                parts.append(ids[at : at + size[k]])
                at += size[k]
        return np.concatenate(parts), size

    def ids_b(self, chunks: list[str], n_bytes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids, how many each chunk has, and whether they give back the chunk's bytes. The tokenizer adds a chunk's first space itself."""
        lists = self.b.encode([c[1:] for c in chunks], num_threads=1)
        for k, (c, found) in enumerate(zip(chunks, lists)):
            if len(c) == 1 and not found:  # nothing is added before nothing: a lone space is the piece of its own
                lists[k] = [self.b.piece_to_id("▁")]
        size = np.fromiter(map(len, lists), np.int64, len(lists))
        flat = np.fromiter(chain.from_iterable(lists), np.int64, int(size.sum()))
        if b"".join(map(self.pieces.__getitem__, flat.tolist())) == "".join(chunks).encode() and (np.add.reduceat(np.append(self.len_b[flat], 0), np.cumsum(size) - size) == n_bytes).all():
            return flat, size, np.ones(len(chunks), bool)
        return flat, size, np.array([b"".join(map(self.pieces.__getitem__, found)) == c.encode() for c, found in zip(chunks, lists)], bool)


@cache
def token_pair(path_a: str, path_b: str) -> TokenPair:
    """One per Python worker."""
    return TokenPair(path_a, path_b)


def common_ends(a: np.ndarray, b: np.ndarray, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
    """The places in a and b (both strictly ascending) of the values that they share, ascending, by merge paths.

    Diagonal d of the grid holds the splits (i, d - i) of the first d values of the merge, a's first where both are equal; its binary search
    finds the one that the merge passes. Between two diagonals lies a piece of equal work that needs nothing of the others."""
    n, m = len(a), len(b)
    if not n or not m:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    diagonals = np.arange(0, n + m, piece)
    low, high = np.maximum(0, diagonals - m), np.minimum(diagonals, n)
    while (open_ := low < high).any():
        mid = (low + high) >> 1
        right = open_ & (a[np.minimum(mid, n - 1)] <= b[np.maximum(diagonals - 1 - mid, 0)])
        low, high = np.where(right, mid + 1, low), np.where(open_ & ~right, mid, high)
    i, j = low.copy(), diagonals - low
    # a pair whose diagonal lies between a's and b's value: the piece before ends with the one, the piece after starts with the other
    parted = (i > 0) & (j < m)
    parted &= a[np.maximum(i - 1, 0)] == b[np.minimum(j, m - 1)]
    found_a, found_b = [i[parted] - 1], [j[parted]]
    ahead_a, ahead_b = np.append(a, np.iinfo(np.int64).max), np.append(b, np.iinfo(np.int64).max)
    was = np.full(len(i), -1)  # the value of a that the piece took last
    for step in range(piece):
        if step == (n + m - 1) % piece + 1:  # the last piece has no more
            i, j, was = i[:-1], j[:-1], was[:-1]
        x, y = ahead_a[i], ahead_b[j]
        takes_a = x <= y
        hit = np.flatnonzero(~takes_a & (y == was))
        found_a.append(i[hit] - 1)
        found_b.append(j[hit])
        was = np.where(takes_a, x, was)
        i = i + takes_a
        j = j + ~takes_a
    at_a, at_b = np.concatenate(found_a), np.concatenate(found_b)
    order = np.argsort(at_a, kind="stable")
    return at_a[order], at_b[order]


ALIGNED = "slice long, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, links array<int>, pairs array<long>, counts array<long>"


def align_slice(texts: list[str], vocabularies: TokenPair) -> dict:
    """Of texts: the tokens, groups and digest of each, the place of each of its links among the pairs of all, these pairs and their counts."""
    per_text = [CHUNK.findall(f" {t}") if t else [] for t in texts]
    known: dict[str, int] = {}
    codes = np.array([known.setdefault(c, len(known)) for own in per_text for c in own], np.int64)
    n_chunks = np.array([len(own) for own in per_text])
    chunks = list(known)
    del per_text, known  # what follows holds arrays a few times the size of the text, so nothing is kept beyond its last use
    n_bytes = np.array([len(c.encode()) for c in chunks], np.int64)
    flat_a, size_a = vocabularies.ids_a(chunks, n_bytes) if chunks else (np.empty(0, np.int64), np.empty(0, np.int64))
    flat_b, size_b, good = vocabularies.ids_b(chunks, n_bytes) if chunks else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool))
    text_of = np.repeat(np.arange(len(texts)), n_chunks)
    bad = np.zeros(len(texts), bool)
    bad[text_of[~good[codes]]] = True
    kept = ~bad[text_of]
    codes, text_of = codes[kept], text_of[kept]

    def per(size: np.ndarray) -> np.ndarray:
        return np.bincount(text_of, size[codes], len(texts)).astype(np.int64)

    n_a, n_b, upto = per(size_a), per(size_b), np.cumsum(per(n_bytes))
    a, b = gather(flat_a.astype(np.int32), size_a, codes), gather(flat_b.astype(np.int32), size_b, codes)
    del codes, text_of, kept, chunks
    ends_a = np.cumsum(vocabularies.len_a[a])
    at_a, at_b = common_ends(ends_a, np.cumsum(vocabularies.len_b[b]))
    groups = np.diff(np.searchsorted(ends_a[at_a], upto, "right"), prepend=0)
    del ends_a
    written = np.empty(len(a) + len(b), np.int32)
    for own, at, before, first in ((a, at_a, np.append(0, at_b + 1), 0), (b, at_b, at_a + 1, vocabularies.n_a)):
        last = np.zeros(len(own), np.int32)
        last[at] = 1
        group = np.cumsum(last) - last  # of each token
        written[np.arange(len(own)) + before[group]] = 2 * (first + own) + last
    pairs = a[at_a].astype(np.int64) * vocabularies.n_b + b[at_b]
    del a, b, at_a, at_b, last, group, own, at, before
    ends = np.append(0, np.cumsum(n_a + n_b)).tolist()
    # text by text, for the numbers and parts of all texts as Python objects take many times their space
    digests = [hashlib.sha256(b"".join(map(vocabularies.written.__getitem__, written[x:y].tolist()))[:-1]).hexdigest() if y > x else "" for x, y in zip(ends[:-1], ends[1:])]
    del written
    pairs, links, counts = np.unique(pairs, return_inverse=True, return_counts=True)
    return {"n_a": n_a, "n_b": n_b, "n_groups": groups, "digests": digests, "links": links.astype(np.int32), "pairs": pairs, "counts": counts.astype(np.int64)}


def encode_and_align(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """A row per document, and one per slice with its pairs and their counts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reuse_freed_memory()
        vocabularies = token_pair(path_a, path_b)
        number = TaskContext.get().partitionId() << 33
        schema = pa.schema([("slice", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("groups_sha256", pa.string()), ("links", pa.list_(pa.int32())), ("pairs", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64()))])
        for part in slices(batches, 1, SLICE):
            x, n = align_slice([t or "" for t in part.column(1).to_pylist()], vocabularies), part.num_rows
            offsets = pa.array(np.append(0, np.cumsum(x["n_groups"])), pa.int32())
            none = pa.nulls(n, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, number)), part.column(0), pa.array(x["n_a"]), pa.array(x["n_b"]), pa.array(x["n_groups"]), pa.array(x["digests"], pa.string()), pa.ListArray.from_arrays(offsets, pa.array(x["links"])), none, none], schema=schema)
            yield pa.RecordBatch.from_pylist([{"slice": number, "pairs": x["pairs"], "counts": x["counts"]}], schema=schema)
            number += 1

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(work, ALIGNED)


RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def sum_links(docs: pa.Table, counted: pa.Table) -> pa.Table:
    """The rows of one slice with what its pairs count in the corpus."""
    total, best = np.zeros(counted.num_rows, np.int64), np.zeros(counted.num_rows, np.int64)
    place = counted.column("place").to_numpy()
    total[place], best[place] = counted.column("total").to_numpy(), counted.column("best").to_numpy()
    links = docs.column("links").combine_chunks()
    offsets, flat = links.offsets.to_numpy(), links.values.to_numpy()
    size = np.diff(offsets)
    of = np.repeat(np.arange(len(size)), size)
    flat = flat[offsets[0] : offsets[-1]]

    def summed(values: np.ndarray) -> pa.Array:
        upto = np.append(0, np.cumsum(values[flat]))
        at = offsets.astype(np.int64) - int(offsets[0])
        return pa.array(upto[at[1:]] - upto[at[:-1]])

    assert len(of) == len(flat)
    return pa.table([docs.column("doc_id"), docs.column("n_a"), docs.column("n_b"), docs.column("n_groups"), pa.array(size.astype(np.int64)), summed(best), summed(total), docs.column("groups_sha256")], names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])


def pair_counts(aligned: DataFrame, n_b: int) -> tuple[DataFrame, DataFrame]:
    """(slice, place, pair, n) of every slice's pairs; and (pair, a, b, total, best) of the corpus, best being 1 where no other A id has more links with b."""
    per_slice = aligned.where(F.col("pairs").isNotNull()).select("slice", F.posexplode(F.arrays_zip("pairs", "counts")).alias("place", "x")).select("slice", "place", F.col("x.pairs").alias("pair"), F.col("x.counts").alias("n"))
    totals = per_slice.groupBy("pair").agg(F.sum("n").alias("total")).withColumn("b", F.col("pair") % n_b)
    most = totals.groupBy("b").agg(F.max("total").alias("most"))
    return per_slice, totals.join(most, "b").select("pair", F.expr(f"pair div {n_b}").alias("a"), "b", "total", (F.col("total") == F.col("most")).cast("long").alias("best"))


def align_tokenizers(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row of docs (doc_id, text)."""
    import sentencepiece

    n_b = sentencepiece.SentencePieceProcessor(model_file=path_b).get_piece_size()
    aligned = materialize(encode_and_align(docs, path_a, path_b), "aligned")
    per_slice, counted = pair_counts(aligned, n_b)
    counted = materialize(counted, "pair_counts")
    looked_up = per_slice.join(counted, "pair").select(F.col("slice").alias("of_slice"), "place", "total", "best")
    own = aligned.where(F.col("pairs").isNull()).select("slice", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "links")
    return own.groupBy("slice").cogroup(looked_up.groupBy("of_slice")).applyInArrow(sum_links, RESULT)
