"""Language-model scoring: word statistics of the corpus, and a causal self-attention model on subword ids.

Word counts stay a table: the most frequent words (``head`` at most) are looked up where a text is read, the others are joined by word. The ids
of a word are those of the vocabulary file, after which the most frequent pairs of neighbouring ids in the words of the training texts become ids
of their own, in a few rounds: texts are shorter in such ids, and a window of the model reaches further. Each text is read once for
its word statistics and its ids, which are kept. The attention model (attention.py) learns from every window of the training texts in ``rounds``
rounds, each of which takes another slice of the texts: every partition of ids trains from the common parameters, and the averages
are the next common ones. All whole texts are then scored in overlapping windows of the kept ids.

Defined cases: a null or empty text is its end token alone; without training texts the word score is that of no knowledge and
the model that of its initial parameters; a null doc_id counts as the text '' when training texts are chosen; repeated rows are scored each and
count as often as they occur; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import attention as A
from .common import crc_mod, materialize, slices, values
from .hashing import ascii_words, reuse_freed_memory
from .tokens import join_pairs, neighbours, ragged, word_encoder

#: Ids of the vocabulary file, then those of joined pairs (so many rounds of at most so many), then the end and the begin of a text.
FILE_IDS, JOIN_ROUNDS, JOINS = 49_408, 3, 32_768
END = FILE_IDS + JOIN_ROUNDS * JOINS
BEGIN = END + 1
IDS = END + 2
#: Distinct words that a task holds before it sends their counts.
HELD_WORDS = 1_000_000
#: Rows in which the parameters of all shards of a round are added up before the driver gets them.
SUMS = 32


def is_held_out() -> Column:
    return crc_mod("doc_id", 10) == 0


def packed(size: np.ndarray, flat: np.ndarray) -> pa.BinaryArray:
    """Lists of ids (lengths, all ids) as 32-bit numbers."""
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32) * 4
    return pa.BinaryArray.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(flat, "<u4"))])


def numbers(ids: bytes) -> np.ndarray:
    return np.frombuffer(ids, "<u4")


def unpacked(ids: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return ragged(map(numbers, values(ids)))


def id_counts(encoded: DataFrame) -> np.ndarray:
    """How often each id occurs in the training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(IDS, np.int64)
        for b in batches:
            n += np.bincount(unpacked(b.column(0))[1], minlength=IDS)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], names=["id", "n"])

    counts = np.zeros(IDS)
    got = encoded.where("not held_out").select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    counts[got["id"].to_numpy()] = got["n"].to_numpy()
    return counts


def word_counts(docs: DataFrame) -> DataFrame:
    """(key, n) of the words of all rows of docs(text)."""

    def added(parts: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(parts).group_by("key").aggregate([("n", "sum")]).select(["key", "n_sum"]).rename_columns(["key", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for b in slices(batches, 0, 8 << 20):
            counts = ascii_words(b.column(0))[0].value_counts()
            parts.append(pa.table({"key": counts.field("values"), "n": counts.field("counts")}))
            held += len(counts)
            if held > 2 * HELD_WORDS:
                parts = [added(parts)]
                if (held := len(parts[0])) > HELD_WORDS:
                    yield from parts[0].combine_chunks().to_batches(100_000)
                    parts, held = [], 0
        if parts:
            yield from added(parts).combine_chunks().to_batches(100_000)

    return docs.select("text").mapInArrow(run, "key string, n long").groupBy("key").agg(F.sum("n").alias("n"))


def word_ids(counts: DataFrame, tokenizer: str) -> DataFrame:
    """(key, n, ids) of each row of counts(key, n); ids are those of the vocabulary file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(tokenizer)
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, packed(*encoder.words(b.column(0)))], names=["key", "n", "ids"])

    return counts.mapInArrow(run, "key string, n long, ids binary")


def frequent_pairs(words: DataFrame) -> list[tuple[np.ndarray, np.ndarray]]:
    """What join_pairs() takes: in each round, the pairs of neighbouring ids that are most frequent in words(n, ids) after those before it. The
    driver holds them alone, whose number is bounded."""

    def counted(rounds: list[tuple[np.ndarray, np.ndarray]]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                size, flat = join_pairs(*unpacked(b.column(1)), rounds)
                word, pair, inside = neighbours(size, flat)
                distinct, at = np.unique(pair[inside], return_inverse=True)
                n = np.bincount(at, b.column(0).to_numpy()[word[:-1][inside]], len(distinct))
                yield pa.RecordBatch.from_arrays([pa.array(distinct), pa.array(n.astype(np.int64))], names=["pair", "n"])

        return run

    rounds = []
    for k in range(JOIN_ROUNDS):
        pairs = words.select("n", "ids").mapInArrow(counted(rounds), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).where("n > 1")
        top = np.sort(pairs.orderBy(F.desc("n"), "pair").limit(JOINS).select("pair").toArrow()["pair"].to_numpy())
        rounds.append((top, np.arange(len(top)) + FILE_IDS + k * JOINS))
    return rounds


def train_round(texts: DataFrame, vocab: A.Vocabulary, params: dict[str, np.ndarray], rate: float) -> dict[str, np.ndarray]:
    """The parameters after every window of texts(ids): the mean of what the partitions learn from the given ones, by their windows."""
    shared = texts.sparkSession.sparkContext.broadcast((vocab, params))
    schema = "n double, params array<double>"

    def made(n: float, flat: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([n], pa.float64()), pa.array([flat], pa.list_(pa.float64()))], names=["n", "params"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reuse_freed_memory()
        vocab, start = shared.value
        trainer, n = A.Trainer(start, vocab, rate), 0
        for b in batches:
            for _, rows in A.window_blocks(map(numbers, values(b.column(0))), BEGIN):
                trainer.learn(rows)
                n += len(rows)
        if n:
            yield made(n, n * np.concatenate([v.ravel() for v in trainer.p.values()]).astype(np.float64))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, flat = 0.0, 0.0
        for b in batches:
            for k, v in zip(b.column(0), b.column(1)):
                n, flat = n + k.as_py(), flat + v.values.to_numpy()
        if n:
            yield made(n, flat)

    sums = texts.select("ids").mapInArrow(learn, schema).repartition(SUMS).mapInArrow(add, schema).toArrow()
    if not len(sums):
        return params
    flat = sum(v.values.to_numpy() for v in sums["params"]) / sum(sums["n"].to_pylist())
    ends = np.cumsum([v.size for v in params.values()])
    return {k: part.reshape(params[k].shape).astype(np.float32) for k, part in zip(params, np.split(flat, ends[:-1]))}


def fit(encoded: DataFrame, rounds: int) -> tuple[A.Vocabulary, dict[str, np.ndarray]]:
    """The vocabulary from all id counts, and parameters from all training texts. The driver holds parameters and id counts alone,
    whose sizes are fixed."""
    vocab = A.vocabulary(id_counts(encoded))
    params = A.initial(vocab)
    for k in range(rounds):
        params = train_round(encoded.where((~F.col("held_out")) & (F.col("slice") == k)), vocab, params, 0.01 / (1 + k))
    return vocab, params


def model_scores(encoded: DataFrame, vocab: A.Vocabulary, params: dict[str, np.ndarray]) -> DataFrame:
    """The rows of read_texts() with score in place of ids."""
    shared = encoded.sparkSession.sparkContext.broadcast((vocab, params))
    kept = ["row", "doc_id", "held_out", "n_tokens", "n_head", "s_head"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reuse_freed_memory()
        vocab, params = shared.value
        scorer = A.Scorer(params)
        for b in batches:
            score = np.zeros(b.num_rows)
            for text, rows in A.window_blocks(map(numbers, values(b.column(len(kept)))), BEGIN):
                score += np.bincount(text, A.log_probs(scorer, vocab, rows), b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], pa.array(score / math.log(10))], names=[*kept, "score"])

    return encoded.select(*kept, "ids").mapInArrow(run, "row long, doc_id long, held_out boolean, n_tokens long, n_head long, s_head double, score double")


def head_words(words: DataFrame, head: int, rounds: list[tuple[np.ndarray, np.ndarray]]) -> pa.Table:
    """The words of words(key, n, ids) from a number of occurrences on that at most head words reach, their ids joined."""
    steps = words.groupBy(F.floor(F.log2("n") * 16).alias("step")).agg(F.count("*").alias("words"), F.min("n").alias("n")).orderBy(F.desc("step")).collect()
    least, held = None, 0
    for r in steps:
        held += r.words
        if held > head:
            break
        least = r.n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:2], packed(*join_pairs(*unpacked(b.column(2)), rounds))], names=["key", "n", "ids"])

    return words.where(F.lit(False) if least is None else F.col("n") >= least).mapInArrow(run, "key string, n long, ids binary").toArrow()


def read_texts(docs: DataFrame, head: pa.Table, rounds: list[tuple[np.ndarray, np.ndarray]], tokenizer: str, ends: int, bottom: float, parts: int) -> DataFrame:
    """Each row of docs: row, doc_id, held_out, slice (below parts: when a training text is learnt from), n_tokens, n_head and s_head (the
    part of the head words in n_known and base_score), rest (the other words), ids (32-bit numbers)."""
    head = head.combine_chunks()
    known = pc.cast(head["key"].combine_chunks(), pa.string()) if head.num_rows else pa.array([], pa.string())
    gain = np.append(np.log10((head["n"].to_numpy() + 0.1) / bottom), 0)
    size, flat = unpacked(head["ids"].combine_chunks()) if head.num_rows else ragged([])
    shared = docs.sparkSession.sparkContext.broadcast((known, gain, np.append(size, 1), np.append(flat, np.uint32(END)), rounds))
    one = pa.struct([("word", pa.string()), ("m", pa.int64())])
    names = ["row", "doc_id", "held_out", "slice", "n_tokens", "n_head", "s_head", "rest", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, gain, size, flat, rounds = shared.value
        encoder = word_encoder(tokenizer)
        for b in slices(batches, 4, 8 << 20):
            words, at = ascii_words(b.column(4))
            coded = words.dictionary_encode()
            distinct, word = coded.dictionary, coded.indices.to_numpy()
            place = pc.fill_null(pc.index_in(distinct, value_set=known), len(known)).to_numpy(zero_copy_only=False).astype(np.int64)
            text = np.repeat(np.arange(b.num_rows), np.diff(at))
            hit = place[word] < len(known)
            s = np.bincount(text, gain[place[word]], b.num_rows) + math.log10((ends + 0.1) / bottom)
            n = np.bincount(text[hit], minlength=b.num_rows) + (ends > 0)
            pairs, m = np.unique(text[~hit] * np.int64(len(distinct) + 1) + word[~hit], return_counts=True)
            of, which = np.divmod(pairs, len(distinct) + 1)
            rest = pa.StructArray.from_arrays([distinct.take(pa.array(which)), pa.array(m, pa.int64())], fields=list(one))
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(b.num_rows + 1)), pa.int32()), rest)
            # a table of the ids of the head words, the end and the other words
            others = np.flatnonzero(place == len(known))
            more, their = join_pairs(*encoder.words(distinct.take(pa.array(others))), rounds)
            place[others] = len(known) + 1 + np.arange(len(others))
            all_size, all_flat = np.append(size, more), np.append(flat, their)
            start = np.cumsum(all_size) - all_size
            item = np.insert(place[word], at[1:], len(known))
            each = all_size[item]
            upto = np.cumsum(each)
            ids = all_flat[np.arange(each.sum()) + np.repeat(start[item] - (upto - each), each)]
            edges = upto[at[1:] + np.arange(b.num_rows)]
            n_tokens = pa.array(np.diff(at) + 1, pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[:4], n_tokens, pa.array(n, pa.int64()), pa.array(s, pa.float64()), lists, packed(np.diff(edges, prepend=0), ids)], names=names)

    picked = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", is_held_out().alias("held_out"), F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts)).cast("int").alias("slice"), "text")
    schema = "row long, doc_id long, held_out boolean, slice int, n_tokens long, n_head long, s_head double, rest array<struct<word:string,m:long>>, ids binary"
    return materialize(picked.mapInArrow(run, schema), "read")


def score_texts(docs: DataFrame, tokenizer: str, rounds: int = 3, head: int = 300_000) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score for each row of docs(doc_id, text)."""
    train = docs.where(~is_held_out())
    words = materialize(word_ids(word_counts(train), tokenizer), "words")
    counts = words.select("key", "n")
    ends = train.count()
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    total, distinct = total + ends, distinct + (ends > 0)
    bottom = total + 0.1 * (distinct + 1)
    joins = frequent_pairs(words)
    read = read_texts(docs, head_words(words, head, joins), joins, tokenizer, ends, bottom, rounds)
    scores = materialize(model_scores(read, *fit(read, rounds)), "scores")
    tail = read.select("row", F.explode("rest").alias("t")).select("row", F.col("t.word").alias("key"), F.col("t.m").alias("m"))
    c = F.coalesce("n", F.lit(0))
    tail = tail.join(counts, "key", "left").groupBy("row").agg(F.sum(F.when(c > 0, F.col("m")).otherwise(0)).alias("n_tail"), F.sum(F.col("m") * F.log10((c + 0.1) / bottom)).alias("s_tail"))
    n_known, base_score = F.col("n_head") + F.coalesce("n_tail", F.lit(0)), F.col("s_head") + F.coalesce("s_tail", F.lit(0.0))
    return scores.join(tail, "row", "left").select("doc_id", "held_out", "n_tokens", n_known.alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), base_score.alias("base_score"), "score")
