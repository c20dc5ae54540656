"""Chat formatting by token-level assembly.

Every segment (header, text) is encoded by itself with a lossless byte-level vocabulary; turns are marked by ids
reserved beyond it, so no text can produce one, and control strings inside texts are escaped besides: each
``<``, any number of backslashes and ``|`` in a row gain a backslash after the ``<``, which reading back removes. The loss mask is
the prefix sum of +1 at the first token of each assistant text and -1 after its last.

Turns are encoded where they are read. A conversation, however long, is then read in turn order as a stream: one turn is
in memory at a time. Defined cases: null text or role is empty; rows of one turn number are ordered by role, the
text's first 32 characters and its hash;
repeated rows stay; a null turn comes first; null conv_id is one conversation; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import values
from .tokens import byte_encoding

START, END = "<|im_start|>", "<|im_end|>"


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def escape_role(role: str) -> str:
    """Also free of line feeds, which end the header."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\([\\n])", lambda m: "\n" if m[1] == "n" else "\\", unescape(role))


#: The encoder's pattern works on a run of white space as one piece and fails on a million; longer runs are encoded in parts.
RUN = re.compile(r"\s{10000}")


def encode(enc, text: str) -> list[int]:
    """The ids of text, which decode to it."""
    ids, at = [], 0
    for m in RUN.finditer(text):
        ids += enc.encode_ordinary(text[at : m.end()])
        at = m.end()
    return ids + enc.encode_ordinary(text[at:])


def encode_turns(turns: DataFrame, vocabulary: str, loss_role: str = "assistant") -> DataFrame:
    """(conv_id, turn, role, text, ids, loss_mask) for each row: the ids of the whole turn with its marks, and whether each bears loss."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = byte_encoding(vocabulary)
        start, end = enc.n_vocab, enc.n_vocab + 1
        feed = enc.encode_ordinary("\n")
        for b in batches:
            ids, masks = [], []
            for role, text in zip(values(b.column(2)), values(b.column(3))):
                head, body = encode(enc, escape_role(role) + "\n"), encode(enc, escape(text))
                made = [start, *head, *body, end, *feed]
                edges = np.zeros(len(made) + 1, np.int8)
                edges[1 + len(head)] += role == loss_role
                edges[1 + len(head) + len(body)] -= role == loss_role
                ids.append(np.array(made, np.int32))
                masks.append(np.cumsum(edges[:-1]) > 0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ids, pa.list_(pa.int32())), pa.array(masks, pa.list_(pa.bool_()))], names=[*b.schema.names, "ids", "loss_mask"])

    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    schema = rows.select("*", F.expr("cast(array() as array<int>)").alias("ids"), F.expr("cast(array() as array<boolean>)").alias("loss_mask")).schema
    return rows.mapInArrow(run, schema)


class Conversation:
    """What is read back from the ids and masks of a conversation's turns, one after another."""

    def __init__(self, conv_id: int | None) -> None:
        self.conv_id, self.turns, self.loss_chars, self.chars = conv_id, 0, 0, 0
        self.text, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, enc, ids: np.ndarray, mask: np.ndarray) -> None:
        start, end = enc.n_vocab, enc.n_vocab + 1
        opens, closes = np.flatnonzero(ids == start), np.flatnonzero(ids == end)
        decode = lambda part: enc.decode(part.tolist())
        role, _, text = decode(ids[opens[0] + 1 : closes[0]]).partition("\n")
        bearing = unescape(decode(ids[mask]))
        self.turns += 1
        self.text.update(f"{unescape_role(role)}\n{unescape(text)}\n".encode())
        self.loss.update(bearing.encode())
        self.loss_chars += len(bearing)
        self.chars += len(START) + len(role) + 1 + len(text) + len(END) + len(decode(ids[closes[0] + 1 :]))

    def row(self) -> tuple:
        return self.conv_id, self.turns, self.text.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def read_back(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) of each conversation of encode_turns()."""
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def table(done: list[Conversation]) -> pa.RecordBatch:
        cols = list(zip(*(c.row() for c in done))) if done else [[]] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, now = byte_encoding(vocabulary), None
        for b in batches:
            done = []
            for i, conv in enumerate(b.column(0).to_pylist()):
                if now is None or now.conv_id != conv:
                    done += [now] if now else []
                    now = Conversation(conv)
                now.add(enc, b.column(1)[i].values.to_numpy(), b.column(2)[i].values.to_numpy(zero_copy_only=False))
            yield table(done)
        if now:
            yield table([now])

    sent = encoded.select("conv_id", "turn", "role", F.substring("text", 1, 32).alias("head"), F.xxhash64("text").alias("nth"), "ids", "loss_mask")
    ordered = sent.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "head", "nth")
    return ordered.select("conv_id", "ids", "loss_mask").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
