"""Exact removal of repeated 100-byte strings over the whole corpus.

A byte goes if it is covered by a ``match``-byte string that also starts earlier: in a smaller doc_id, or earlier in the same
document. Sorting every suffix of the corpus is not needed: each match-byte string has one anchor, the hash-least of its
``GRAM``-byte substrings (the rightmost of equals), which its every occurrence holds at the same place.

1. Anchors (about one in 35 positions) are hashed and counted, equal ones of a slice of texts as one row; only those whose hash occurs twice go on.
2. Around these the context is cut out that the strings with this anchor cover. Equal contexts in one task are merged
   before the shuffle, all but the earliest being repeats already, so a passage in a third of all documents costs one row a task.
3. Contexts of one anchor meet; the suffixes at all their string starts are sorted (suffix.py), equal neighbours form a class, and all
   but its earliest start are repeats. An anchor with over ``HOT`` occurrences is dealt out string by string, under the string's hash.
4. The covered spans are joined back to the texts. A text that an earlier document has as a whole is one span; only the first of such texts goes through 2 and 3.

Defined cases: a null or empty text has no bytes; texts under match bytes are never touched and repeat nothing; a null doc_id comes
after all others; rows that repeat an id with the same text are one document and get equal results, with other texts they
are ordered by a hash of the text; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import dealt_lookup, discard, materialize, slices, values
from .hashing import BYTE_CODE, mix, reuse_freed_memory
from .suffix import equal_classes, opens

MATCH, GRAM = 100, 32
WINDOW = MATCH - GRAM + 1
HOT = 20_000
#: At so many neighbouring places of a hot anchor the strings that hold it there are dealt out together.
PIECE = 12
#: Large pieces are broadcast up to so many.
FEW = 200_000
#: Strings of a text that are looked at together; a longer text is worked off in such steps.
STEP = 1 << 22


def gram_hashes(x: np.ndarray) -> np.ndarray:
    h, s, by = BYTE_CODE[x], 1, np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        while s < GRAM:
            h = h[:-s] * by + h[s:]
            s, by = 2 * s, by * by
    return mix(h)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    s = 1
    while 2 * s <= width:
        x = np.minimum(x[:-s], x[s:])
        s *= 2
    return np.minimum(x[: len(x) - (width - s)], x[width - s :])


def anchors(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(position, first string start, last string start, hash) of each anchor of a text, in order."""
    total, parts = len(text) - MATCH + 1, []
    low = np.uint64((1 << 24) - 1)
    for at in range(0, total, STEP):
        m = min(STEP, total - at)
        h = gram_hashes(np.frombuffer(text, np.uint8, m + MATCH - 1, at))
        place = np.arange(len(h) - 1, -1, -1, dtype=np.uint64)  # the rightmost of equal hashes is the least
        arg = (len(h) - 1 - (sliding_min((h & ~low) | place, WINDOW) & low)).astype(np.int64)
        first = np.concatenate([[0], np.flatnonzero(np.diff(arg)) + 1])
        last = np.concatenate([first[1:] - 1, [m - 1]])
        parts.append((arg[first] + at, first + at, last + at, h[arg[first]].view(np.int64)))
    if not parts:
        return tuple(np.empty(0, np.int64) for _ in range(4))
    for a, b in zip(parts, parts[1:]):  # an anchor on both sides of a step
        if a[0][-1] == b[0][0]:
            b[1][0] = a[1][-1]
            a[0][-1] = -1
    pos, first, last, h = (np.concatenate(c) for c in zip(*parts))
    return pos[pos >= 0], first[pos >= 0], last[pos >= 0], h[pos >= 0]


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, k, th, text): k orders documents, (k, th) names one."""
    last = F.lit((1 << 63) - 1)
    return docs.select("doc_id", F.coalesce("doc_id", last).alias("k"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), F.col("text").cast("binary").alias("text"))


def whole_copies(docs: DataFrame) -> DataFrame:
    """(k, th, start, stop): the strings of documents whose whole text, known by its SHA-256, an earlier document has."""
    named = docs.where(F.octet_length("text") >= MATCH).select("k", "th", F.lit(0).cast("long").alias("start"), (F.octet_length("text") - MATCH).cast("long").alias("stop"), F.unhex(F.sha2("text", 256)).alias("digest"))
    named = materialize(named, "named")
    firsts = named.groupBy("digest").agg(F.min("k").alias("first"), F.max("k").alias("last")).where("first < last").select("digest", "first")
    out = materialize(dealt_lookup(named, firsts, "digest", ["k", "th"]).where("k > first").select("k", "th", "start", "stop").distinct(), "copies")
    discard(named)
    return out


def repeated_anchors(docs: DataFrame, copies: DataFrame | None = None) -> DataFrame:
    """(k, th, marks): the anchors (place, h) of each document whose hash occurs more than once. place packs the anchor's position, how far before it
    its first string starts and how many more start there; h is the hash, its last bit telling whether it occurs over HOT times.

    Of the equal anchors of one slice of texts one stands for all when occurrences are counted, so an anchor in a third of all documents is one row a
    slice there; the others learn the count from it, met on slice and hash. The copies have no marks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reuse_freed_memory()
        for b in slices(batches, 2, 8 << 20):
            got = [anchors(t) for t in values(b.column(2))]
            n = [len(g[0]) for g in got]
            pos, first, last, h = (np.concatenate([g[i] for g in got]) for i in range(4))
            k, th = (np.repeat(b.column(i).to_numpy(), n) for i in (0, 1))
            _, stands, counts = np.unique(h, return_index=True, return_counts=True)
            times = np.zeros(len(h), np.int64)
            times[stands] = counts
            name = np.full(len(h), xxhash.xxh3_64_intdigest(b.column(0)[0].as_py().to_bytes(8, "little", signed=True) + b.column(1)[0].as_py().to_bytes(8, "little", signed=True)) >> 1)
            place = pos << 14 | (pos - first) << 7 | (last - first)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (name, h, k, th, place, times)], names=["slice", "h", "k", "th", "place", "times"])

    picked = docs.where(F.octet_length("text") >= MATCH).select("k", "th", "text")
    found = materialize(picked.mapInArrow(run, "slice long, h long, k long, th long, place long, times long"), "found")
    stand = found.where("times > 0").withColumn("n", F.sum("times").over(Window.partitionBy("h"))).where("n > 1")
    stand = materialize(stand.select("slice", "h", "k", "th", "place", "times", (F.col("n") > HOT).alias("hot")), "stand")
    rest = found.where("times = 0").join(stand.where("times > 1").select("slice", "h", "hot"), ["slice", "h"])
    marked = F.shiftleft(F.shiftright("h", 1), 1).bitwiseOR(F.col("hot").cast("long"))
    every = stand.unionByName(rest, allowMissingColumns=True).select("k", "th", F.struct("place", marked.alias("h")).alias("mark"))
    every = every.join(copies, ["k", "th"], "left_anti") if copies else every
    out = materialize(every.groupBy("k", "th").agg(F.collect_set("mark").alias("marks")), "anchors")
    discard(found, stand)
    return out


CONTEXT = "repeat boolean, h long, sub long, r long, k long, th long, start long, stop long, context binary"
NUMBERS = ("h", "sub", "r", "k", "th", "start", "stop")


def earliest(code: np.ndarray, k: np.ndarray, th: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two masks over strings with codes: the first of each code by (k, th, start), and those that another string of their code comes before."""
    first, again = np.ones(len(code), bool), np.zeros(len(code), bool)
    some = np.flatnonzero(np.bincount(code)[code] > 1)
    by = some[np.lexsort((start[some], th[some], k[some], code[some]))]
    new = opens(code[by])
    lead = by[np.maximum.accumulate(np.where(new, np.arange(len(by)), 0))]
    first[by] = new
    again[by] = (k[by] != k[lead]) | (th[by] != th[lead]) | (start[by] != start[lead])
    return first, again


def pieces(texts: pa.Array, row: np.ndarray, p: np.ndarray, lo: np.ndarray, hi: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """(index, first, last, sub, context) of the pieces into which the strings starting in [lo, hi] of texts[row], with an anchor at p, are cut: strings that hold the anchor
    at one of width neighbouring places are a piece. sub is a hash of what all of them share, so equal strings have equal subs; 0 where the strings are one piece."""
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2].slice(int(offsets[0]), int(offsets[-1] - offsets[0])).to_pybytes()
    q = (p - hi) // width
    n = (p - lo) // width - q + 1
    i = np.repeat(np.arange(len(n)), n)
    q = q[i] + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
    at, p, width = (offsets[:-1] - offsets[0])[row[i]], p[i], width[i]
    first, last = np.maximum(lo[i], p - width * (q + 1) + 1), np.minimum(hi[i], p - width * q)
    sub, some = np.zeros(len(i), np.int64), np.flatnonzero(width < WINDOW)
    shared = (at + p - width * q)[some]
    sub[some] = [xxhash.xxh3_64_intdigest(data[a:b], c) >> 1 | 1 for a, b, c in zip(shared.tolist(), (shared - width[some] + 1 + MATCH).tolist(), q[some].tolist())]
    return i, first, last, sub, pa.array([data[a:b] for a, b in zip((at + first).tolist(), (at + last + MATCH).tolist())], pa.binary())


def merged(parts: Iterator[tuple[tuple[np.ndarray, ...], pa.Array]]) -> Iterator[pa.RecordBatch]:
    """CONTEXT rows of parts (the columns NUMBERS, the contexts). Of equal contexts among some 64 MB of them the earliest goes on, the others are repeats. A context
    is known by its bytes: those of its first string tell its anchor and the anchor's place."""

    def batches(held: list) -> Iterator[pa.RecordBatch]:
        numbers, context = [np.concatenate(c) for c in zip(*(n for n, _ in held))], pa.concat_arrays([c for _, c in held])
        held.clear()
        first, again = earliest(context.dictionary_encode().indices.to_numpy(), *(numbers[i] for i in (3, 4, 5)))
        for some, left in ((first, context.filter(pa.array(first))), (again, None)):
            n = int(some.sum())
            columns = [c[some] if left is not None or i > 2 else np.zeros(n, np.int64) for i, c in enumerate(numbers)]
            out = [pa.array(np.full(n, left is None)), *map(pa.array, columns), pa.array([b""] * n, pa.binary()) if left is None else left]
            for at in range(0, n, 20_000):
                yield pa.RecordBatch.from_arrays([c.slice(at, 20_000) for c in out], names=["repeat", *NUMBERS, "context"])

    held, size = [], 0
    for part in parts:
        held.append(part)
        size += part[1].nbytes + 60 * len(part[1])
        if size > 64 << 20:
            yield from batches(held)
            size = 0
    if held:
        yield from batches(held)


def contexts(docs: DataFrame, marked: DataFrame) -> DataFrame:
    """CONTEXT rows: strings starting in [start, stop] of document (k, th), their bytes, and the anchor's place r in them; or, if repeat,
    strings that an equal context of the same task already repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reuse_freed_memory()

        def parts() -> Iterator[tuple]:
            for b in slices(batches, 2, 2 << 20):
                marks = b.column(3).flatten()
                row = np.repeat(np.arange(b.num_rows), pc.list_value_length(b.column(3)).to_numpy())
                place, h = marks.field("place").to_numpy(), marks.field("h").to_numpy()
                for at in range(0, len(row), 1 << 17):  # a long text's marks in parts
                    m, x, of = (c[at : at + (1 << 17)] for c in (place, h, row))
                    p = m >> 14
                    lo = p - (m >> 7 & 127)
                    i, first, last, sub, context = pieces(b.column(2), of, p, lo, lo + (m & 127), np.where(x & 1, PIECE, 128))
                    k, th = (b.column(c).to_numpy()[of[i]] for c in (0, 1))
                    yield (x[i], sub, p[i] - first, k, th, first, last), context

        yield from merged(parts())

    picked = docs.join(marked, ["k", "th"]).select("k", "th", "text", "marks")
    return materialize(picked.mapInArrow(run, CONTEXT), "contexts")


def dealt(found: DataFrame) -> DataFrame:
    """CONTEXT rows with pieces of which over HOT contexts differ cut into their strings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reuse_freed_memory()

        def parts() -> Iterator[tuple]:
            for b in slices(batches, 8):
                h, r, k, th, start, stop = (b.column(c).to_numpy() for c in ("h", "r", "k", "th", "start", "stop"))
                i, first, last, sub, context = pieces(b.column(8), np.arange(len(r)), r, np.zeros_like(r), stop - start, np.ones_like(r))
                yield (h[i], sub, r[i] - first, k[i], th[i], start[i] + first, start[i] + last), context

        yield from merged(parts())

    cut = found.where("sub <> 0")
    large = materialize(cut.groupBy("h", "sub").count().where(F.col("count") > HOT).select("h", "sub"), "large")
    n = large.count()
    if not n:
        return found
    large = F.broadcast(large) if n <= FEW else large
    strings = materialize(cut.join(large, ["h", "sub"], "left_semi").select(*found.columns).mapInArrow(run, CONTEXT), "strings")
    return found.join(large, ["h", "sub"], "left_anti").select(*found.columns).union(strings)


SPANS = pa.schema([(c, pa.int64()) for c in ("k", "th", "start", "stop")])


def repeats_in(t: pa.Table) -> pa.RecordBatch:
    """SPANS of the strings of context rows, whole groups of (h, sub), that start earlier in another or the same document."""
    h, sub, r, k, th, start, stop = (t[c].to_numpy() for c in NUMBERS)
    group = np.cumsum(opens(h, sub))
    shared = np.bincount(group)[group] > 1
    r, k, th, start, stop, group = (c[shared] for c in (r, k, th, start, stop, group))
    if not len(r):
        return pa.RecordBatch.from_pylist([], SPANS)
    parts = t["context"].filter(pa.array(shared)).combine_chunks().dictionary_encode()
    code = parts.indices.to_numpy()
    first, again = earliest(code, k, th, start)  # of equal contexts all but the earliest are repeats as a whole
    whole = [c[again] for c in (k, th, start, stop)]
    first = np.flatnonzero(first)
    first = first[np.bincount(group[first])[group[first]] > 1]
    if not len(first):
        return pa.RecordBatch.from_arrays([pa.array(c) for c in whole], schema=SPANS)
    offsets, data = np.frombuffer(parts.dictionary.buffers()[1], np.int32), np.frombuffer(parts.dictionary.buffers()[2], np.uint8)
    r, k, th, start, stop, group, base = (c[first] for c in (r, k, th, start, stop, group, offsets[code].astype(np.int64)))
    n = stop - start + 1
    row = np.repeat(np.arange(len(n)), n)
    j = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    classes = equal_classes(data, base[row] + j, group[row] * 128 + r[row] - j, MATCH)
    where = start[row] + j
    _, later = earliest(classes, k[row], th[row], where)
    opening = later & ~np.concatenate([[False], later[:-1] & (row[1:] == row[:-1])])
    closing = later & ~np.concatenate([later[1:] & (row[1:] == row[:-1]), [False]])
    some = (k[row[opening]], th[row[opening]], where[opening], where[closing])
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(whole, some)], schema=SPANS)


def repeated_starts(found: DataFrame) -> DataFrame:
    """SPANS (first and last string start) of the repeats among context rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reuse_freed_memory()
        waiting: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            h, sub = b.column("h").to_numpy(), b.column("sub").to_numpy()
            old = np.flatnonzero((h != h[-1]) | (sub != sub[-1]))
            cut = int(old[-1]) + 1 if len(old) else 0  # the last group may go on in the next batch
            if waiting and (cut or (waiting[-1].column("h")[0].as_py(), waiting[-1].column("sub")[0].as_py()) != (int(h[-1]), int(sub[-1]))):
                yield repeats_in(pa.Table.from_batches([*waiting, b.slice(0, cut)]))
                waiting = []
            elif cut:
                yield repeats_in(pa.Table.from_batches([b.slice(0, cut)]))
            waiting.append(b.slice(cut))
        if waiting:
            yield repeats_in(pa.Table.from_batches(waiting))

    dealt = found.where("not repeat").drop("repeat").repartition("h", "sub").sortWithinPartitions("h", "sub")
    return dealt.mapInArrow(run, "k long, th long, start long, stop long")


def removed(spans: pa.Array) -> list[list[tuple[int, int]]]:
    """The maximal removed runs (first byte, end) of each list of spans, in order; spans that overlap or touch are one run."""
    n = pc.fill_null(pc.list_value_length(spans), 0).to_numpy()
    flat, row = spans.flatten(), np.repeat(np.arange(len(n)), n)
    first, end = flat.field("start").to_numpy(), flat.field("stop").to_numpy() + MATCH
    by = np.lexsort((first, row))
    row, first, end = row[by], first[by], end[by]
    if not len(row):
        return [[] for _ in n]
    far = int(end.max()) + 1
    reach = np.maximum.accumulate(end + row * far)  # a text's ends lie behind those of the text before
    new = np.concatenate([[True], first[1:] + row[1:] * far > reach[:-1]])
    new[1:] |= row[1:] != row[:-1]
    runs = np.flatnonzero(new)
    ends = (reach - row * far)[np.append(runs[1:], len(row)) - 1]
    pairs, upto = list(zip(first[runs].tolist(), ends.tolist())), np.searchsorted(row[runs], np.arange(len(n) + 1)).tolist()
    return [pairs[a:b] for a, b in zip(upto, upto[1:])]


def remove_repeats(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept_text] for each row of docs(doc_id, text)."""
    docs = keyed(docs)
    copies = whole_copies(docs)
    found = dealt(contexts(docs, repeated_anchors(docs, copies)))
    spans = repeated_starts(found).union(found.where("repeat").select("k", "th", "start", "stop")).union(copies)
    spans = materialize(spans.groupBy("k", "th").agg(F.collect_set(F.struct("start", "stop")).alias("spans")), "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text, cuts in zip(values(b.column(1)), removed(b.column(2))):
                text, at, kept = text or b"", 0, []
                for first, end in cuts:
                    kept.append(text[at:first])
                    at = end
                kept = b"".join([*kept, text[at:]])
                rows.append((len(text), len(text) - len(kept), len(cuts), hashlib.sha256(kept).hexdigest(), kept))
            cols = list(zip(*rows)) if rows else [[]] * 5
            kinds = [*[pa.int64()] * 3, pa.string(), pa.binary()][: 4 + keep_text]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"][: 5 + keep_text])

    joined = docs.join(spans, ["k", "th"], "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_text binary" * keep_text)
